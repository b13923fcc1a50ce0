"""Centroid clustering against plain loops, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import types as T

from chronopanel.llm import centroids

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType()), T.StructField("cluster", T.StringType())])


def rows(found):
    return sorted(tuple(r) for r in found.collect())


def ints(v):
    return [int(np.floor(64 * x)) for x in v]


def test_partial_distances_lose_nothing():
    rng = np.random.default_rng(1)
    for spread in (2, 40):  # a small spread makes ties
        x, c = rng.integers(-spread, spread, (500, 64)), rng.integers(-spread, spread, (16, 64))
        c[9] = c[4]
        number, distance = centroids.nearest(x, c, rng.permutation(64))
        whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(0, 0.1, 64).tolist()) for i in range(40)]
    same = [(100 + i, good[3][1]) for i in range(60)]  # a large group of copies
    bad = [(200, None), (201, []), (202, [0.0] * 63), (203, [float("nan")] + [0.0] * 63), (204, [float("inf")] + [0.0] * 63), (205, [None] + [0.0] * 63)]
    again = [(1, good[1][1]), (2, good[0][1])]  # a repeated row, a repeated id
    table = good + same + again
    df = spark.createDataFrame([(i, v, "kept?", "kept?") for i, v in table + bad], SCHEMA).repartition(7)
    assert rows(centroids.cluster(df)) == sorted(centroids.brute_force([(i, ints(v)) for i, v in table]))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    table = [(i, [float(i)] * 64) for i in range(n)]
    df = spark.createDataFrame([(i, v, None, None) for i, v in table], SCHEMA)
    assert rows(centroids.cluster(df)) == sorted(centroids.brute_force([(i, ints(v)) for i, v in table]))


def test_rows_without_ids_and_large_components(spark):
    table = [(None, [0.25] * 64), (1, [0.5] * 64), (2, [-1e300] + [0.0] * 63)]
    got = centroids.cluster(spark.createDataFrame([(i, v, None, None) for i, v in table], SCHEMA)).collect()
    assert {r.vec_id for r in got} == {None, 1, 2}
    held = [(None, [16] * 64), (1, [32] * 64), (2, [-centroids.BOUND] + [0] * 63)]
    key = lambda r: str(r[0])
    assert sorted((tuple(r) for r in got), key=key) == sorted(centroids.brute_force(held), key=key)
