"""Selection of features, stages on disk and whole extractions."""

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from chronopanel.operators import composite, features, ml, selection
from chronopanel.sources import stages


def test_names():
    assert [selection.leaking(n) for n in ("si_lat_mean", "temporal_correlation", "a-state", "flat_mean", "")] == [True, False, True, False, False]
    kept = [selection.season_invariant(n) for n in ("si_x", "area_ha", "NDVI_mean", "NDVI_t00", "B4_2024_09_01", "NDVI_mean_t01", "label")]
    assert kept == [True, True, True, False, False, False, False]


def test_features_of(spark):
    x = spark.createDataFrame([(1, "f", 1, float("nan"), None, "s", 3, 2.0), (2, None, 0, float("inf"), 4, None, 1, 1.0)], "plot_id int, source_file string, label int, a double, b int, text string, valid_pixel_count_t00 int, longitude double")
    rows, names = selection.features_of(x, "plot_id")
    assert names == ["a", "b"] and sorted(map(tuple, rows.collect())) == [(1, 1, "f", 0.0, 0.0), (2, 0, None, 0.0, 4.0)]
    assert selection.features_of(x, "plot_id", quality=True)[1] == ["a", "b", "valid_pixel_count_t00"]
    assert selection.features_of(x.drop("source_file"), "plot_id")[0].where("group = '2'").count() == 1
    assert selection.features_of(x.limit(0), "plot_id")[0].count() == 0
    assert "longitude" not in selection.without_places(x).columns


def test_radar_in_decibels_or_not(spark):
    rows = [(1, b, s, v) for b, vs in (("VV", [-20.0, -10.0, None, -5.0]), ("VH", [0.05, 0.2, 0.3, None])) for s, v in enumerate(vs)]
    got = {r.band: r for r in features.radar_phenology(spark.createDataFrame(rows, "entity int, band string, step int, v double")).collect()}
    assert got["VV"].sar_season_length == 2 and got["VH"].sar_season_length == 2
    assert got["VV"].sar_auc == -35.0 - (-20.0 - 5.0) / 2 and got["VH"].sar_peak_value == 0.3


def test_extract(spark):
    obs = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 0, 3.0), (1, "b", 1, 5.0), (1, "b", 1, None)], "entity int, band string, step int, value double")
    got = composite.extract(obs, 2, ["a", "b"], "a", 2).orderBy("step").collect()
    assert [(r.step, r.a, r.b, r.n_valid, r.pct_valid, r.n_cloudy, r.n_total) for r in got] == [(0, 2.0, None, 2, 50.0, 1, 2), (1, None, None, 0, 50.0, 1, 2)]


def test_stages(spark, tmp_path):
    x = spark.range(20).select("id", (F.col("id") % 3).cast("int").alias("k"), F.when(F.col("id") > 2, F.col("id") / 7).alias("v"))
    for form in ("parquet", "csv"):
        stages.write(x, f"{tmp_path}/{form}", form, ["k"])
        back = stages.read(spark, f"{tmp_path}/{form}", "id bigint, v double, k int", form).select("id", "k", "v")
        assert sorted(map(str, back.collect())) == sorted(map(str, x.collect()))
    assert (tmp_path / "csv" / "k=2").is_dir()
    cube = features.cube(x.select(F.lit(1).alias("entity"), F.lit("a").alias("band"), F.col("id").alias("step"), "v"), ["a"])
    stages.write(cube, f"{tmp_path}/cube")
    assert stages.read(spark, f"{tmp_path}/cube", "entity int, cube array<array<double>>").first() == cube.first()


def test_model_on_disk(spark, tmp_path):
    x = spark.createDataFrame([(k, k % 2, float(k % 2)) for k in range(40)], "entity int, label int, a double")
    rows = ml.assemble(x, ["a"])
    model = ml.model_factory("rf", numTrees=3, maxDepth=2).fit(ml.weighted(rows))
    stages.write_model(spark, model, f"{tmp_path}/m", ["a"], {"f1": 1.0})
    back, names, found = stages.read_model(spark, f"{tmp_path}/m", RandomForestClassificationModel.read())
    same = [np.allclose([r.score for r in ml.probability(m, rows).orderBy("entity").collect()], [r.score for r in ml.probability(model, rows).orderBy("entity").collect()]) for m in (back,)]
    assert all(same) and names == ["a"] and found == {"f1": 1.0}
