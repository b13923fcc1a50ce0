"""Faults that show on larger tables."""

from pyspark.sql import functions as F

from chronopanel.operators import splits

#: Rows of label 0 and 1 of twenty groups, which placing them one by one leaves further apart than the largest of them.
UNEVEN = [
    (301, 1928), (314, 1913), (266, 1924), (264, 1898), (206, 1906), (310, 1781), (312, 1775), (290, 1796), (365, 1713), (215, 1854),
    (216, 1849), (264, 1777), (235, 1803), (266, 1748), (370, 1626), (270, 1703), (286, 1587), (346, 1509), (316, 1505), (232, 1570),
]


def test_folds_differ_by_a_group_at_most(spark):
    groups = spark.createDataFrame([(f"g{k}", a, b) for k, (a, b) in enumerate(UNEVEN)], "g string, a int, b int")
    rows = groups.select("g", F.explode(F.concat(F.array_repeat(F.lit(0), F.col("a")), F.array_repeat(F.lit(1), F.col("b")))).alias("y"))
    got = splits.balanced_folds(rows, "g", "y", 3)
    assert got.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    folds = got.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    for name, most in (("n", max(map(sum, UNEVEN))), ("p", max(b for _, b in UNEVEN))):
        assert max(f[name] for f in folds) - min(f[name] for f in folds) <= most


def test_exchanges_leave_even_folds_alone():
    assert splits.exchanged([(3, 1), (3, 1), (3, 1)], [0, 1, 2], 3) == [0, 1, 2]
    assert splits.exchanged([], [], 3) == []


def test_a_forests_changed_paths_are_the_models(spark):
    """Classes by following changed paths, and by the model on each changed row: depths at which features come again."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from chronopanel.operators import ml

    rng = np.random.default_rng(3)
    own = np.round(rng.normal(size=(300, 5)), 2)
    label = (own[:, 0] * own[:, 1] + 0.3 * own[:, 2] > 0).astype(int) + (own[:, 3] > 1)
    rows = spark.createDataFrame([(int(y), x.tolist()) for y, x in zip(label, own, strict=True)], "label int, own array<double>")
    fitted = ml.model_factory("rf", numTrees=15, maxDepth=9).fit(rows.select("label", F.lit(1.0).alias("weight"), array_to_vector("own").alias("features")))
    other = own[rng.permutation(len(own))]
    got = ml._after_change(ml._nodes(fitted), own, other)
    assert got.shape == own.shape
    for f in range(own.shape[1]):
        changed = own.copy()
        changed[:, f] = other[:, f]
        tried = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(changed)], "k int, x array<double>")
        want = fitted.transform(tried.select("k", array_to_vector("x").alias("features"))).orderBy("k").select("prediction").collect()
        assert [int(r[0]) for r in want] == got[:, f].tolist()


def test_rows_are_dealt_to_all_cores(spark):
    from chronopanel.operators import ml

    few = spark.range(1000).coalesce(1)
    assert ml.dealt(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert ml.dealt(few, most=100).rdd.getNumPartitions() == 10 and ml.dealt(few).count() == 1000


def test_folds_share_the_cores(spark):
    """A fit has its fold's share of the cores as partitions, not as many as the rows came in, and more for many rows."""
    from chronopanel.operators import ml

    df = spark.createDataFrame([(k, float(k % 7), int(k % 7 > 3), k % 3 if k < 297 else None) for k in range(300)], "k int, a double, label int, fold int")
    x = ml.assemble(df, ["a"]).repartition(32)
    share = -(-spark.sparkContext.defaultParallelism // 3)
    scored = ml.cross_validate(x, "rf", numTrees=3, maxDepth=2)
    assert scored.rdd.getNumPartitions() == 3 * share
    assert sorted(r.k for r in scored.select("k").collect()) == list(range(297))
    assert ml.cross_validate(x, "rf", most=30, numTrees=3, maxDepth=2).rdd.getNumPartitions() == 3 * 10


def test_kept_nodes_change_no_forest(spark):
    from chronopanel.operators import ml

    df = spark.createDataFrame([(float(k % 7), float(k % 11), int(k % 13 > 5), 1.0) for k in range(300)], "a double, b double, label int, weight double")
    x = ml.assemble(df, ["a", "b"]).coalesce(2)
    kept = ml.model_factory("rf", numTrees=5, maxDepth=4)
    assert kept.getCacheNodeIds()
    assert kept.fit(x).toDebugString.split("\n")[1:] == kept.copy({kept.cacheNodeIds: False}).fit(x).toDebugString.split("\n")[1:]


def test_series_of_larger_tables_have_more_tasks(spark, monkeypatch):
    from chronopanel.operators import series, table

    made, spread = [], series.spread
    monkeypatch.setattr(series, "ROWS", 40)
    monkeypatch.setattr(series, "spread", lambda df, rows, *keys: made.append((rows, spread(df, rows, *keys))) or made[-1][1])
    panel = spark.range(6).selectExpr("id as entity", "explode(sequence(0, 4)) as step").selectExpr("*", *[f"rand(1) as {b}" for b in (*table.BANDS, table.COUNT)])
    out = table.build(panel, panel.selectExpr("entity", "1.5 as area_ha").distinct(), 5)
    assert out.count() == 6 * len(table.schema(5))
    assert {rows for rows, _ in made} >= {30, 30 * len(table.ALL), 30 * len(table.INVARIANT)}
    for rows, df in made:
        assert df.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-rows // 40))


def test_samples_of_larger_tables_have_more_tasks(spark, monkeypatch):
    """A task has a bounded number of rows, whether plots are many or one is large; repeated rows and the plot null count."""
    import hashlib

    from chronopanel.operators import scenes, splits

    monkeypatch.setattr(splits, "ROWS", 100, raising=False)

    def wanted(rows, n):
        first = {}
        for plot, k, v in sorted(set(rows), key=lambda r: (hashlib.md5(f"42:{r[1]}".encode()).hexdigest(), r[1])):
            first.setdefault(plot, []).append((plot, k, v))
        return sorted((r for of in first.values() for r in of[:n]), key=str)

    many = [(f"p{k % 50}", k, float(k)) for k in range(1000)]
    large = [("a", k, float(k)) for k in range(1500)] + [(None, k, 0.5) for k in range(700)] + [("b", k, 1.0) for k in range(5)]
    for rows, tasks in ((many, 10), (large * 2, 8)):
        df = spark.createDataFrame(rows, "plot string, k int, v double")
        got = scenes.sample(df, ["plot"], "k", ["v"], 20, distinct=True)
        assert got.columns == df.columns and got.rdd.getNumPartitions() >= tasks
        assert sorted(map(tuple, got.collect()), key=str) == wanted(rows, 20)
    repeated = scenes.sample(spark.createDataFrame(large * 2, "plot string, k int, v double"), ["plot"], "k", ["v"], 20)
    assert repeated.groupBy("plot").count().where("plot <=> 'a' or plot is null").select("count").distinct().collect() == [(20,)]
    assert repeated.where("plot = 'b'").count() == 10 and repeated.distinct().where("plot <=> 'a'").count() == 10
    assert scenes.sample(spark.createDataFrame([], "plot string, k int, v double"), ["plot"], "k", ["v"]).collect() == []
