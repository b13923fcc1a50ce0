"""Operators on small cases with known results."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.functions import indices, scalars
from chronopanel.operators import composite, features, metrics, ml, series, spatial, splits
from chronopanel.sources import kml
from chronopanel.streaming import composite as stream


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def curve(spark, values, entity=1, band="a"):
    return spark.createDataFrame([(entity, band, i, None if v is None else float(v)) for i, v in enumerate(values)], "entity int, band string, step int, v double")


def test_indices(spark):
    l = lambda x: F.lit(float(x))  # noqa: E731, E741
    r = one(
        spark,
        ndvi=indices.index("NDVI", B8=l(0.8), B4=l(0.2)),
        none=indices.index("NDVI", B8=F.lit(None).cast("double"), B4=l(0.2)),
        cire=indices.index("CIre", B7=l(0.6), B5=l(0.2)),
        ireci=indices.index("IRECI", B7=l(0.6), B6=l(0.5), B5=l(0.3), B4=l(0.1)),
        nrpb=indices.index("NRPB", VH=l(0.05), VV=l(0.1)),
        rvi=indices.index("RVI", VV=l(0.1), VH=l(0.05)),
        msavi=indices.index("MSAVI", B8=l(0.6), B4=l(0.1)),
        clip=indices.clipped_ratio(l(1), l(-1e-8) + 1e-12),
    )
    assert r.ndvi == pytest.approx(0.6) and r.none is None and r.cire == pytest.approx(2) and r.ireci == pytest.approx(0.8333, abs=1e-4)
    assert r.nrpb == pytest.approx(-1 / 3) and r.rvi == pytest.approx(4 / 3) and r.clip == 50
    assert r.msavi == pytest.approx((2.2 - np.sqrt(2.2**2 - 4)) / 2)
    assert indices.available(["B8", "B4"]) == ["NDVI", "SAVI", "MSAVI"]


def test_decibel(spark):
    df = spark.createDataFrame([(0, -10.0, -13.0103)] * 4 + [(1, 0.1, 0.05)], "step int, VV double, VH double")
    got = composite.linear_if_db(df).withColumn("r", indices.index("RVI")).select(F.round("r", 4).alias("r")).distinct().collect()
    assert [x.r for x in got] == [1.3333]


def test_filename_dates(spark):
    cases = {"1_3aug2023.kml": "2023-08-03", "109_aug2023.kml": "2023-08-01", "survey_2023-08-03.kml": "2023-08-03", "a_2023_08_03.kml": "2023-08-03", "x_03-08-2023.kml": "2023-08-03",
             "20230803_field.kml": "2023-08-03", "100_sept2024.kml": "2024-09-01", "31feb2024.kml": "2024-02-01", "10.kml": None, "1_7_2023.kml": None}
    df = spark.createDataFrame([(k,) for k in cases], "name string").withColumn("d", scalars.filename_date(F.col("name")).cast("string"))
    assert {r.name: r.d for r in df.collect()} == cases


def test_synthetic_months(spark):
    got = [r.m for r in spark.range(21).select(scalars.synthetic_month(F.col("id").cast("int"), 21).alias("m")).collect()]
    assert got == [4, 4, 5, 6, 6, 6, 7, 8, 8, 8, 9, 10, 10, 10, 11, 12, 12, 12, 1, 2, 2]


@pytest.mark.parametrize(("values", "want"), [([None, 1.0, None, 3.0, None], [1, 1, 2, 3, 3]), ([None, None], [None, None]), ([None, 5.0], [5, 5])])
def test_gap_fill(spark, values, want):
    assert [r.v for r in series.gap_fill(curve(spark, values)).orderBy("step").collect()] == want


def test_smooth_keeps_quadratics(spark):
    x = [float(i * i - 3 * i) for i in range(9)]
    assert [r.v for r in series.smooth(curve(spark, x)).orderBy("step").collect()] == pytest.approx(x)
    assert [r.v for r in series.smooth(curve(spark, x[:3])).orderBy("step").collect()] == x[:3]


def test_runs_and_seasons(spark):
    p = features.phenology(curve(spark, [1.0, 0, 1, 0, 0])).first()
    q = features.phenology(curve(spark, [1.0, 0, 0, 1, 0])).first()
    assert (p.n_seasons, q.n_seasons) == (1, 2) and p.peak_idx == 0
    d = features.duration(curve(spark, [1.0, 0, 1, 1, 0])).first()
    assert (d.above_05, d.streak_05, d.green_span) == (3, 2, 3)
    assert features.duration(curve(spark, [0.1] * 4)).first().green_span == -4


def test_shape_and_dynamics_of_flat_and_short_series(spark):
    s = features.shape(curve(spark, [2.0] * 6)).first()
    assert (s.skewness, s.kurtosis, s.std, s.auc) == (0, 0, 0, 10)
    d = features.dynamics(curve(spark, [1.0, None, 2.0, 1.0])).first()
    assert (d.autocorr_lag1, d.n_peaks) == (0, 0)
    x = np.array([1.0, 3, 2, 5, 4, 6])
    c = x - x.mean()
    assert features.dynamics(curve(spark, x.tolist())).first().autocorr_lag1 == pytest.approx((c[:-1] * c[1:]).sum() / (5 * c.var()))


def test_harmonics_are_the_fourier_transform(spark):
    x = np.cos(2 * np.pi * np.arange(12) / 12) * 3 + 1
    h = features.harmonics(curve(spark, x.tolist()), 12).first()
    f = np.abs(np.fft.rfft(x - x.mean())) / 12
    assert (h.amp1, h.amp2, h.dominance) == pytest.approx((f[1], f[2], 1), abs=1e-6)


def test_metrics(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 20, 200) / 20
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, score double")
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert metrics.roc_auc(df, []).first().roc_auc == pytest.approx(np.mean(pairs))
    cuts = sorted(set(s), reverse=True)
    j = [((s >= t) & (y == 1)).sum() / y.sum() - ((s >= t) & (y == 0)).sum() / (1 - y).sum() for t in cuts]
    assert metrics.youden(df, []).first().threshold == pytest.approx(min(0.6, cuts[int(np.argmax(np.round(j, 12)))]))
    assert metrics.roc_auc(df.where("y = 1"), []).first().roc_auc is None and metrics.youden(df.where("y = 1"), []).first().threshold == 0.5


def test_distances(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 100, (60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "k int, x double, y double")
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) + np.diag([np.inf] * 60)
    got = {r.k: r.nn for r in spatial.nearest_distance(df, "k").collect()}
    assert [got[i] for i in range(60)] == pytest.approx(d.min(axis=1).tolist())
    far = spatial.buffered_antijoin(df.where("k < 30"), df.where("k >= 30"), 8.0)
    assert {r.k for r in far.collect()} == {i for i in range(30) if d[i, 30:].min() >= 8}
    assert spatial.nearest_distance(df.limit(1), "k").first().nn is None


def test_group_folds(spark):
    df = spark.createDataFrame([(i, i % 12, int(i % 3 == 0)) for i in range(120)], "k int, g int, y int")
    got = splits.group_folds(df, "g", "y", 4).toPandas()
    assert len(got) == 120 and (got.groupby("g").fold.nunique() == 1).all() and got.fold.nunique() == 4


RING = "77.0,29.0,0 77.01,29.0,0 77.01,29.01,0 77.0,29.01,0 77.0,29.0,0"


def test_kml(spark, tmp_path):
    doc = f"<kml xmlns='http://www.opengis.net/kml/2.2'><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>{RING}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>"
    (tmp_path / "1_3aug2023.kml").write_text(doc)
    (tmp_path / "bad.kml").write_text("<kml>")
    with zipfile.ZipFile(tmp_path / "line.kmz", "w") as z:
        z.writestr("doc.kml", f"<kml><Placemark><LineString><coordinates>{RING}</coordinates></LineString></Placemark></kml>")
    (tmp_path / "broken.kmz").write_bytes(io.BytesIO(b"no archive").getvalue())
    got = {r.source_file: r for r in kml.read_kml(spark, str(tmp_path), 1).collect()}
    assert set(got) == {"1_3aug2023.kml", "line.kmz"}
    r = got["1_3aug2023.kml"]
    assert r.area_ha == pytest.approx(107.9, rel=0.01) and (r.lon, r.lat) == pytest.approx((77.005, 29.005), abs=1e-6)
    assert str(r.anchor_date) == "2023-08-03" and str(r.date_start) == "2023-03-03" and str(got["line.kmz"].anchor_date) == "2024-09-01"


def test_models(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i % 7 > 3), i % 3) for i in range(150)], "k int, a double, b double, label int, fold int")
    x = ml.assemble(df, ["a", "b"])
    scored = ml.cross_validate(x, "rf", numTrees=5, maxDepth=3)
    assert scored.count() == 150 and ml.fold_metrics(scored).agg(F.min("roc_auc")).first()[0] > 0.95
    with pytest.raises(ValueError):
        ml.model_factory("none")


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = stream.stream_composite(events, "ts", ["user_id"], "value").writeStream.format("memory").queryName("composited").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("composited").agg(F.sum("n")).first()[0] == 1000


def test_matched_fails_on_missing_keys(spark):
    from pyspark.errors import PySparkException

    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, y int")
    assert {tuple(r) for r in splits.matched(left, right, "k").collect()} == {(1, "a", 5), (2, "b", None)}
    with pytest.raises(PySparkException, match="no match for 1"):
        splits.matched(left, right.where("k > 1"), "k").collect()
