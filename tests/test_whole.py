"""The whole feature table: schema, forms, short panels; the tensor on disk; the saved plan from table to verdict."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.functions import indices
from chronopanel.operators import detector, features, selection, table
from chronopanel.plans import whole
from chronopanel.sources import stages

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("steps", [4, 15, 21, 28])
def test_width_and_order(steps):
    names = table.schema(steps)
    assert len(names) + len(table.META) == 32 * steps + 1176 and len(set(names)) == len(names)
    blocks = ["area_ha", "B2_t00", "n_total_windows", "NDVI_t00", "NDVI_auc", "VV_sar_auc", "NDVI_VV_temporal_correlation", "ndvi_may", "B2_min", "B2_monsoon_mean", "B2_interannual_diff", "VV_NDVI_ratio_mean", "si_NDVI_days_above_04", "si_B2_mean", "sar_cr_mean", "cross_ndvi_vh_corr"]
    assert sorted(blocks, key=names.index) == blocks
    per_curve = [n for n in names if n.startswith("si_EVI_")]
    assert len(per_curve) == 44 and len([n for n in names if n.startswith("sar_")]) == 14 and len([n for n in names if n.startswith("cross_")]) == 4


@pytest.fixture(scope="module")
def rows(spark):
    return whole.labelled(spark, DATA)


def test_vectors_and_wide(spark, rows, tmp_path):
    of, names = rows
    of = of.select("entity", F.col("values").alias("features"))
    for r in of.collect():
        assert len(r.features) == len(names) and np.isfinite(r.features).all()
    some = table.wide(of, names, ["sar_vv_mean", "B2_t03", "area_ha"]).collect()
    at = {n: i for i, n in enumerate(names)}
    by = {r.entity: r.features for r in of.collect()}
    assert all((r.sar_vv_mean, r.B2_t03, r.area_ha) == tuple(by[r.entity][at[n]] for n in ("sar_vv_mean", "B2_t03", "area_ha")) for r in some)
    paths = table.write_wide(of, names, str(tmp_path), 700)
    read = [spark.read.parquet(p) for p in paths]
    assert [c for df in read for c in df.columns if c != "entity"] == names and {df.count() for df in read} == {len(by)}


def test_raw_steps_keep_their_place(spark, rows):
    of, names = rows
    got = {r.entity: r["values"] for r in of.collect()}
    for r in whole.panel(spark, DATA).collect():
        for band in ("B8", "VH", "valid_pixel_count"):
            assert got[r.entity][names.index(f"{band}_t{r.step:02d}")] == pytest.approx(r[band] or 0.0)


def test_short_panel(spark):
    """Three steps, an entity without any observation, a constant one: every column is there and finite."""
    panel = [(e, k, *([None] * 12 if e == 1 else [0.5 + 0.1 * e * (k % 2)] * 12), 3.0 if e else 0.0) for e in range(3) for k in range(3)]
    df = spark.createDataFrame(panel, "entity long, step int, " + ", ".join(f"{b} double" for b in table.BANDS) + ", valid_pixel_count double")
    found = table.build(df, df.select("entity", F.lit(1.5).alias("area_ha")).distinct(), 3).toPandas()
    names = table.schema(3)
    known = set(found.feature)
    assert found.value.notna().all() and np.isfinite(found.value).all() and known <= set(names) and not found.duplicated(["entity", "feature"]).any()
    assert len(found) == 3 * len(names)
    assert found[(found.entity == 0) & (found.feature == "n_cloudy_windows")].value.item() == 3


# ---- the tensor


def test_clean_channels(spark):
    values = {("B8", 0): 1.0, ("B8", 2): 3.0, ("VV", 0): 0.1, ("VV", 1): 9.0, ("VV", 2): 0.3, ("VV", 3): 0.4, ("VV", 4): 0.5}
    long = lambda n: spark.createDataFrame([(1, b, k, values.get((b, k))) for b in ("B8", "VV", "CR") for k in range(n)], "entity long, band string, step int, v double")
    cube = features.cube(features.clean_channels(long(5), 5), ["B8", "VV", "CR"]).first().cube
    assert np.allclose(cube, np.transpose([[1.0, 2.0, 3.0, 3.0, 3.0] @ _savgol(), [0.1, 0.3, 0.4, 0.4, 0.4], [0.0] * 5]))
    short = features.cube(features.clean_channels(long(3), 3), ["B8", "VV", "CR"]).first().cube
    assert np.allclose(short, [[1.0, 0.1, 0], [0, 9.0, 0], [3.0, 0.3, 0]])  # fewer than five steps: nulls become 0, no filter
    kept = {(r.band, r.step): r.v for r in features.clean_channels(long(5), 5, keep_missing=True).collect()}
    assert kept[("B8", 1)] is None and kept[("B8", 2)] is not None and kept[("CR", 0)] is None


def _savgol():
    x = np.vander(np.arange(5), 3)
    return (x @ np.linalg.inv(x.T @ x) @ x.T).T


def test_tensor_on_disk(spark, tmp_path):
    cubes = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[3.0, 4.0]])], "entity long, cube array<array<double>>")
    stages.write_tensor(cubes, spark.createDataFrame([(1, 1)], "entity long, label int"), str(tmp_path), ["a", "b"], 1)
    read, channels, steps = stages.read_tensor(spark, str(tmp_path))
    assert (channels, steps) == (["a", "b"], 1) and {(r.entity, r.label, tuple(map(tuple, r.cube))) for r in read.collect()} == {(1, 1, ((1.0, 2.0),)), (2, None, ((3.0, 4.0),))}


def test_all_indices_at_once(spark):
    w = whole.panel(spark, DATA)
    assert set(table.INDICES) == set(indices.REGISTRY) <= set(indices.add_all(w).columns)


# ---- the saved plan


def test_leaking_names():
    assert all(map(selection.leaking, ("plot_id", "my_plot_id_2", "source-file", "date_start", "x_LAT", "group_key_hash", "lon")))
    assert not any(map(selection.leaking, ("platform", "plot", "id", "start_date", "B4_mean", "si_NDVI_slat")))
    assert not any(selection.leaking(n) for n in table.schema(15))


def test_names_fit_the_schema():
    """Season-invariant mode keeps every si_, sar_ and cross_ feature and the statistics, and no step."""
    kept = set(detector.chosen(table.schema(15), season_invariant=True))
    assert {n for n in table.schema(15) if n.startswith(("si_", "sar_", "cross_"))} | {"area_ha", "NDVI_auc", "NDVI_peak_month", "B2_p10", "NDVI_interannual_diff"} <= kept
    assert not any(n.startswith("valid_pixel_count_") or n.rsplit("_", 1)[-1].startswith("t0") for n in kept) and "n_cloudy_windows" not in kept


def test_align_both_forms(spark):
    df = spark.createDataFrame([(1, 5, None, float("nan"), "x"), (2, 6, 0.5, float("inf"), "y")], "entity long, b int, a double, c double, extra string")
    want = {1: [0.0, 5.0, 0.0, 0.0], 2: [0.5, 6.0, 0.0, 0.0]}
    wide = detector.Align(names=["a", "b", "c", "gone"]).transform(df)
    of = df.select("entity", F.array(F.col("c"), F.col("b").cast("double"), F.col("a")).alias("values"))
    packed = detector.Align(names=["a", "b", "c", "gone"], source=["c", "b", "a"]).transform(of)
    assert {r.entity: r.features.toArray().tolist() for r in wide.collect()} == want == {r.entity: r.features.toArray().tolist() for r in packed.collect()}


def test_saved_plan(spark, tmp_path):
    """Load and predict give what the plan gave; a table in another order with columns missing has these as 0."""
    rng = np.random.default_rng(4)
    data = [(i, int(a > 0), float(a), float(b), i % 3) for i, (a, b) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(data, "entity long, label int, a double, b double, plot int")
    plan = detector.train(df, ["a", "b"], by=["plot"], threshold=0.5, numTrees=5, maxDepth=3)
    plan.save(str(tmp_path / "plan"))
    loaded = detector.PipelineModel.load(str(tmp_path / "plan"))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(loaded.transform(df)) == key(plan.transform(df))
    scores = lambda p, d: {r.entity: r.score for r in detector.scorer(p).transform(d).collect()}
    lacking = df.select(F.lit(1.0).alias("other"), "plot", "a", "entity")
    assert scores(loaded, lacking) == scores(plan, df.withColumn("b", F.lit(0.0)))
    right = [(scores(plan, df)[r[0]] >= 0.5) == bool(r[1]) for r in data]
    assert np.mean(right) > 0.9
    assert {r.plot for r in loaded.transform(lacking).collect()} == {0, 1, 2}
