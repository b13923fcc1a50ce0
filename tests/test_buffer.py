"""Rows away from all rows of another table, and curves by key: no dense spot and no key is one task's."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import metrics, nearest, spatial

SCHEMA = "k bigint, x double, y double, u string"


def plain(left, right, distance, unlike):
    away = []
    for k, x, y, u in left:
        near = [r for r in right if None not in (x, y, r[1], r[2]) and np.hypot(x - r[1], y - r[2]) < distance and not (unlike and r[3] == u)]
        if not near:
            away.append(k)
    return sorted(away)


@pytest.mark.parametrize("unlike", [None, "u"])
def test_buffer(spark, unlike, monkeypatch):
    """Even and dense points, shared places, missing coordinates and values, a distance that is met exactly."""
    monkeypatch.setattr(nearest, "QUERIES", 9)
    rng = np.random.default_rng(3)
    points = [*rng.uniform(0, 1, (150, 2)), *(0.5 + rng.normal(0, 1e-4, (60, 2)))]
    rows = [(i, float(a), float(b), ("a", "b", None)[i % 3]) for i, (a, b) in enumerate(points)]
    rows += [(900, 5.0, 5.0, "a"), (901, 5.0, 5.0, "a"), (902, 5.0, 5.0, None), (903, 5.5, 5.0, "b"), (904, None, 1.0, "a"), (905, float("nan"), 1.0, None), (906, 9.0, float("inf"), "b"), (907, -0.0, 0.0, "a"), (908, 0.0, 0.0, "b")]
    left, right = rows[::2] + rows[-9:], rows[1::2] + rows[-9:-6]
    dl, dr = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (left, right))
    for distance in (0.5, 0.04, 1e-4):
        got = spatial.buffered_antijoin(dl, dr, distance, unlike=unlike, block_rows=16)
        assert got.columns == dl.columns and sorted(r.k for r in got.collect()) == plain(left, right, distance, unlike)
    same = spatial.buffered_antijoin(dl, dl, 0.05, unlike="u")  # a table with itself, as in grouped evaluation
    assert sorted(r.k for r in same.collect()) == plain(left, left, 0.05, "u")


def test_buffer_of_odd_tables(spark):
    rows = [(1, 0.0, 0.0, "a"), (2, 3.0, 0.0, None)]
    df, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert spatial.buffered_antijoin(df, none, 1.0).count() == 2 and spatial.buffered_antijoin(none, df, 1.0).count() == 0
    assert spatial.buffered_antijoin(df, df, 0.0).count() == 2 and spatial.buffered_antijoin(df, df, 1.0).count() == 0
    clashing = df.withColumnsRenamed({"k": "__x", "u": "id"})
    assert [r["__x"] for r in spatial.buffered_antijoin(clashing, clashing.where("id is null"), 1.0).collect()] == [1]


def test_curves_by_key(spark):
    """A key with most rows, ties, a key of one class, null keys in one of two columns, rows without a label."""
    rng = np.random.default_rng(5)
    rows = [("big", 1, round(float(rng.beta(1, 9)), 3), int(rng.uniform() < 0.4)) for _ in range(4000)]
    rows += [("big", None, float(rng.integers(0, 4)) / 3, int(rng.uniform() < 0.5)) for _ in range(60)]
    rows += [(None, 1, float(rng.normal()), int(i % 3 == 0)) for i in range(90)] + [("one", 2, 0.3, 1), ("one", 2, 0.7, 1), ("big", 1, 0.01, None)]
    df = spark.createDataFrame(rows, "g string, h int, score double, y int").repartition(5)
    got = metrics.roc_auc(df, ["g", "h"]).join(metrics.average_precision(df, ["g", "h"]).withColumnsRenamed({"g": "g2", "h": "h2"}), F.col("g").eqNullSafe(F.col("g2")) & F.col("h").eqNullSafe(F.col("h2")))
    got = {(r.g, r.h): (r.roc_auc, r.pr_auc) for r in got.collect()}
    cut = {(r.g, r.h): r.threshold for r in metrics.youden(df, ["g", "h"]).collect()}
    assert len(got) == len(cut) == 4
    for g, h in got:
        s, y = (np.array(x) for x in zip(*[(r[2], r[3]) for r in rows if r[:2] == (g, h) and r[3] is not None], strict=True))
        pos, neg = s[y == 1], s[y == 0]
        won = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean() if len(neg) else None
        levels = sorted(set(s), reverse=True)
        tp, n = (np.array([(a >= c).sum() for c in levels]) for a in (pos, s))
        ap = (np.diff(tp, prepend=0) / len(pos) * tp / n).sum()
        assert got[g, h] == (pytest.approx(won) if won is not None else None, pytest.approx(ap))
        if won is not None:
            j = np.round(tp / len(pos) - (n - tp) / len(neg), 12)
            assert cut[g, h] == pytest.approx(min(0.6, max(0.0, levels[int(np.argmax(j))])) if j.max() > 0 else 0.6)
    assert cut["one", 2] == 0.5
    points = metrics.curve(df, ["g", "h"]).where("g = 'big' and h = 1").orderBy(F.desc("score")).collect()
    of = [r for r in rows if r[:2] == ("big", 1)]
    assert [r.score for r in points] == sorted({r[2] for r in of}, reverse=True)
    assert [(r.tp, r.fp) for r in points] == [tuple(sum(r[3] == y and r[2] >= c.score for r in of) for y in (1, 0)) for c in points]
    empty = df.limit(0)
    assert metrics.curve(empty, ["g"]).count() == 0
    assert metrics.roc_auc(empty, ["g"]).count() == 0 and metrics.roc_auc(empty, []).first().roc_auc is None


def test_buffer_of_a_dense_spot_ends_soon(spark):
    """30,000 places a side within the distance of each other are 900 million pairs."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1e-3, (60_000, 2))
    df = spark.createDataFrame([(i, float(a), float(b), "ab"[i % 2]) for i, (a, b) in enumerate(x)], SCHEMA)
    began = time.time()
    assert spatial.buffered_antijoin(df.where("u = 'a'"), df.where("u = 'b'"), 1.0).count() == 0
    assert time.time() - began < 90
