"""From features to verdicts, the best model, folds of blocks, and out-of-fold metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import detect, metrics, ml, spatial, splits


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [(k, k % 2, float(k % 2) + float(rng.normal(0, 0.2)), float(rng.normal()), f"g{k % 10}", 50.0 + k % 2 * 40) for k in range(120)]
    return spark.createDataFrame(rows, "entity int, label int, a double, b double, g string, pct double")


def test_detect(spark, table):
    model = ml.model_factory("rf", numTrees=5, maxDepth=3).fit(ml.weighted(ml.assemble(table, ["a", "b"])))
    odd = spark.createDataFrame([(900, None, float("nan"), 1.0)], "entity int, a double, b double, pct double")
    got = {r.entity: r for r in detect.detect(model, table.unionByName(odd, True).drop("label"), ["a", "b"], valid="pct").collect()}
    assert len(got) == 121 and all(0 <= r.mean_proba <= 1 for r in got.values())
    right = [(r.mean_proba >= 0.5) == (k % 2 == 1) for k, r in got.items() if k < 900]
    assert np.mean(right) > 0.95
    assert got[1].verdict == "HIGH" and got[1].data_quality == "EXCELLENT" and got[0].verdict in ("LOW", "NON-HIGH") and got[0].data_quality == "FAIR"
    assert detect.detect(model, table.select("entity", "a"), ["a", "b"]).where("data_quality = 'UNKNOWN'").count() == 120


def test_verdicts_of_a_null_group_stay(spark):
    s = spark.createDataFrame([(None, 0.9), (None, 0.7), ("x", 0.1)], "g string, score double")
    assert {r.g: r.verdict for r in detect.verdicts(s, ["g"]).collect()} == {None: "HIGH", "x": "NON-HIGH"}


def test_best(spark):
    s = spark.createDataFrame([("ab", 0.9), ("a", 0.9), ("z", None), ("c", 0.2)], "model string, f1 double")
    assert metrics.best(s, "model", "f1").first().model == "a"
    assert metrics.best(s.where("f1 is null"), "model", "f1").first().model == "z"


def test_folds_of_blocks(spark):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame([(k, *rng.uniform(0, 0.5, 2).tolist(), k % 2) for k in range(200)], "k int, lon double, lat double, y int")
    got = splits.block_folds(p, spatial.block_id(F.col("lon"), F.col("lat")), "y").withColumn("b", spatial.block_id(F.col("lon"), F.col("lat"))).collect()
    assert len(got) == 200 and all(len({r.fold for r in got if r.b == b}) == 1 for b in {r.b for r in got}) and {r.fold for r in got} == set(range(5))


def test_out_of_fold_metrics(spark, table):
    x = splits.group_folds(ml.assemble(table, ["a", "b"]), "g", "label", 3)
    scored = ml.cross_validate(x, "rf", numTrees=5, maxDepth=3)
    rows = scored.select("entity", "g", "fold").collect()
    assert sorted(r.entity for r in rows) == list(range(120)) and all(len({r.fold for r in rows if r.g == g}) == 1 for g in {r.g for r in rows})
    m = ml.fold_metrics(scored).collect()
    assert sum(r.tn + r.fp + r.fn + r.tp for r in m) == 120 and all(r.roc_auc > 0.9 for r in m)


def test_evaluate(spark, table):
    rows = ml.assemble(table, ["a", "b"]).withColumns({"x": F.col("entity") * 1.0, "y": F.lit(0.0), "fold": F.floor(F.col("entity") / 40).cast("int")})
    scored, folds, threshold = ml.evaluate(rows, "rf", x="x", y="y", buffer=10.0, numTrees=5, maxDepth=3)
    assert scored.count() == 120
    sizes = {(r.fold, r.buffered): r.tn + r.fp + r.fn + r.tp for r in folds.collect()}
    assert sizes == {(0, False): 40, (1, False): 40, (2, False): 40, (0, True): 31, (1, True): 22, (2, True): 31}
    assert 0 < threshold.first().threshold <= 0.6
    assert not ml.evaluate(rows, "rf", x="x", y="y", buffer=1000.0, numTrees=2, maxDepth=2)[1].where("buffered").count()


def test_curves_without_keys(spark):
    """One curve over all rows is that of a single group."""
    rng = np.random.default_rng(3)
    s = spark.createDataFrame([(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 900), rng.choice([0.0, 0.25, 1.0, *rng.uniform(0, 1, 300)], 900), strict=True)], "y int, score double")
    for f in (metrics.roc_auc, metrics.average_precision, metrics.youden):
        one, by = f(s, []).first(), f(s.withColumn("g", F.lit(1)), ["g"]).drop("g").first()
        assert one[0] == pytest.approx(by[0], abs=1e-12)


def test_permutation_importance(spark, table):
    model = ml.model_factory("rf", numTrees=10, maxDepth=3).fit(ml.weighted(ml.assemble(table, ["a", "b"])))
    got = ml.permutation_importance(model, table, ["a", "b"], "entity", repeats=4).collect()
    assert [r.feature for r in got] == ["a", "b"] and got[0].importance_mean > 0.3 and abs(got[1].importance_mean) < 0.1
    again = ml.permutation_importance(model, table.repartition(7), ["a", "b"], "entity", repeats=4).collect()
    assert [(r.feature, round(r.importance_mean, 12)) for r in got] == [(r.feature, round(r.importance_mean, 12)) for r in again]
    assert ml.permutation_importance(model, table, ["a", "b"], "entity", repeats=2, top=1).count() == 1
    # a plain loop over the same rule
    rows = [(r.entity, r.label, [r.a, r.b]) for r in table.collect()]
    order = [r[0] for r in table.select("entity", splits.drawn("entity", 42).alias("h")).orderBy("h", "entity").collect()]
    import random

    rng = random.Random(42)
    shifts = [rng.randrange(1, 120) for _ in range(4)]
    by = {k: (y, x) for k, y, x in rows}
    from pyspark.ml.linalg import Vectors

    base = np.mean([model.predict(Vectors.dense(x)) == y for _, y, x in rows])
    lost = []
    for s in shifts:
        hits = [model.predict(Vectors.dense([by[order[(i + s) % 120]][1][0], by[k][1][1]])) == by[k][0] for i, k in enumerate(order)]
        lost.append(base - np.mean(hits))
    assert got[0].importance_mean == pytest.approx(np.mean(lost)) and got[0].importance_std == pytest.approx(np.std(lost))
