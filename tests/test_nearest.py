"""Nearest neighbours on uneven points, by class, and quantiles of groups above the limit."""

import time

import numpy as np
import pytest
from pyspark.sql import types as T

from chronopanel.operators import nearest, ranks, spatial

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("kind", T.StringType())])


def plain(rows, by=False):
    out = []
    xs, ys = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    for i, (k, x, y, kind) in enumerate(rows):
        other = np.array([(a is None or k is None or a != k) and j != i and (not by or c == kind) for j, (a, _, _, c) in enumerate(rows)]) & np.isfinite(xs) & np.isfinite(ys)
        d = np.hypot(xs - x, ys - y)[other] if x is not None and y is not None and np.isfinite(x + y) else np.array([])
        out.append((k, d.min() if len(d) else None))
    return out


def check(spark, rows, by=False, block_rows=64):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = nearest.nearest_distance(df, "k", by="kind" if by else None, block_rows=block_rows)
    key = lambda r: (str(r[0]), -1.0 if r[1] is None else r[1])
    a, b = sorted(((r.k, r.nn) for r in got.collect()), key=key), sorted(plain(rows, by), key=key)
    assert [x[0] for x in a] == [x[0] for x in b]
    assert [key(x)[1] for x in a] == pytest.approx([key(x)[1] for x in b], rel=1e-12, abs=1e-300)


def test_uneven(spark):
    rng = np.random.default_rng(5)
    even = [(i, *map(float, rng.uniform(0, 1, 2)), "a") for i in range(2000)]
    dense = [(3000 + i, 0.5 + float(rng.uniform(0, 1e-5)), 0.5 + float(rng.uniform(0, 1e-5)), "a") for i in range(70)]
    far = [(4000, 1e6, 1e6, "a"), (4001, -1e6, 0.0, "b")]
    began = time.time()
    check(spark, even + dense + far)
    assert time.time() - began < 120


@pytest.mark.parametrize("by", [False, True])
def test_keys_and_classes(spark, by):
    """Few keys (whole blocks of one), shared places, missing coordinates and keys, classes over many blocks."""
    rng = np.random.default_rng(6)
    rows = [(int(k < 400), float(x), float(y), "ab"[int(x > 0.6)]) for k, (x, y) in enumerate(rng.uniform(0, 1, (600, 2)))]
    rows += [(7, 0.25, 0.25, "a"), (8, 0.25, 0.25, "a"), (7, 0.3, 0.3, "b"), (7, 0.3, 0.3, "b"), (None, 0.31, 0.3, None), (None, 0.9, 0.9, None)]
    rows += [(9, None, 0.1, "a"), (9, float("nan"), 0.1, "a"), (9, float("inf"), 0.1, "a"), (11, 0.1, 0.2, "alone")]
    check(spark, rows, by)


def test_lines_and_copies(spark):
    check(spark, [(i, float(i % 50), 0.0, "a") for i in range(300)])  # one line, each place six times
    check(spark, [(1, 2.0, 2.0, "a"), (1, 2.0, 2.0, "a")])
    assert nearest.nearest_distance(spark.createDataFrame([], SCHEMA), "k").count() == 0


def test_block_with_many_queries(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rng = np.random.default_rng(8)
    check(spark, [(i, float(a), float(b), "a") for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))], block_rows=20)


def test_bound_on_blocks(spark, monkeypatch):
    """A large table has larger blocks instead of more of them."""
    monkeypatch.setattr(nearest, "MAX_BLOCKS", 2)
    rng = np.random.default_rng(10)
    check(spark, [(i, float(a), float(b), "a") for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))], block_rows=10)


def test_quantiles(spark):
    rng = np.random.default_rng(9)
    rows = [("big", float(v)) for v in np.exp(rng.normal(0, 3, 5000))] + [("ties", float(v)) for v in rng.integers(0, 3, 900)] + [("small", 2.0), ("small", 4.0), ("none", None), (None, 1.0), (None, 3.0), ("big", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for limit in (1, 500, 10_000):
        got = {r.g: (r.p10, r.p50, r.p99) for r in ranks.quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, rows=limit).collect()}
        for g in {r[0] for r in rows}:
            v = [x for k, x in rows if k == g and x is not None and x == x]
            assert got[g] == (pytest.approx(np.percentile(v, [10, 50, 99]), rel=1e-9) if v else (None, None, None))
    one = ranks.quantiles(df, [], "v", {"m": 0.5}, rows=10).collect()
    assert len(one) == 1 and one[0].m == pytest.approx(np.median([x for _, x in rows if x is not None and x == x]))


def test_quantiles_where_the_sketch_errs(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ACCURACY", 10_000_000)  # a range too narrow to hold the rank
    values = list(np.random.default_rng(1).normal(0, 1, 3000))
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda v, cuts, n: ranks.F.array(*[ranks.F.lit(99.0)] * 2))
    got = ranks.quantiles(spark.createDataFrame([(float(v),) for v in values], "v double"), [], "v", {"m": 0.25}, rows=10).first().m
    assert got == pytest.approx(np.percentile(values, 25))


def test_distance_shares_by_class(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0)], "kind string, nn double")
    got = {r.kind: r for r in spatial.distance_shares(df, (2, 4), by="kind").collect()}
    assert (got["a"].n, got["a"]["min"], got["a"]["median"], got["a"]["mean"], got["a"]["max"], got["a"].below_2) == (2, 1.0, 2.0, 2.0, 3.0, 0.5)
    assert got[None].n == 1 and got[None]["median"] == 5.0
