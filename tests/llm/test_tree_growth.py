"""The k-means tree grows with the table, and odd vectors keep their distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import ann


def test_leaves_stay_small(spark):
    rng = np.random.default_rng(1)
    largest = {}
    for n in (2000, 20_000):
        x = rng.normal(0, 1, (n, 8))
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
        tree = ann.KMeansTree(x[:500], leaf_rows=ann.FIT_ROWS)
        grown = ann._grown(rows, tree, 64, 10_000, 500)
        sizes = ann._sizes(ann._located(rows, grown), grown)
        assert sizes.sum() == n and grown.leaves == len(sizes)
        largest[n] = sizes.max(), np.median(sizes)
    assert largest[20_000][0] <= 256 and largest[20_000][1] < 2 * max(largest[2000][1], 32)


def test_equal_vectors_end_growth(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "id bigint, vec array<double>")
    tree = ann.KMeansTree(np.array([[1.0, 2.0]]))
    assert ann._grown(rows, tree, 16, 100, 100).leaves == 1


def test_recall_of_a_grown_tree(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (40, 16))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(0, 1, (6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.search(df, F.col("id") % 100 == 0, leaf_rows=32, sample_rows=600, block_rows=500).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(g.vec_id))
        assert g.sort_values("rank").score.tolist() == pytest.approx(sorted(d[g.vec_id.tolist()]), abs=1e-12)
    assert got.query_id.nunique() == 60 and hit / 600 >= 0.9


def test_squares_that_overflow(spark):
    rows = [(0, [1e200, 0.0]), (1, [-1e200, 0.0]), (2, [3e200, 4e200]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(df, F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 1, 2]
    assert [r.score for r in got] == pytest.approx([1e200, 2e200, np.hypot(2.0, 4.0) * 1e200])
