"""Indices of whole tables, rings, hold-outs, polygons' identity, stacking and tuning."""

import random

import pytest
from pyspark.sql import functions as F

from chronopanel.functions import indices, scalars
from chronopanel.operators import ml, scenes, splits
from chronopanel.sources import kml

RING = "77.0,29.0 77.01,29.0 77.01,29.01 77.0,29.01 77.0,29.0"


def test_indices_of_a_table(spark):
    df = spark.createDataFrame([(0.8, 0.2, 9.0), (None, 0.2, 9.0)], "B8 double, B4 double, SAVI double")
    got = indices.add_all(df)
    assert got.columns == ["B8", "B4", "SAVI", "NDVI", "MSAVI"]
    assert [r.SAVI for r in got.collect()] == [9.0, 9.0] and {r.NDVI is None for r in got.collect()} == {True, False}
    plain = indices.plain_all(spark.createDataFrame([(0.5, -0.5, 0.2, 0.1, 0.1, -10.0, -10.0)], "B8 double, B4 double, B3 double, B2 double, B11 double, VV double, VH double")).first()
    assert plain.NDVI is None and plain.RVI == pytest.approx(2.0) and plain.EVI == pytest.approx(2.5 / (0.5 - 3 - 0.75 + 1))


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


@pytest.mark.parametrize(
    "points, want",
    [
        ([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], False),
        ([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], True),
        ([(0, 0), (2, 0), (2, 2), (1, -1), (0, 2), (0, 0)], True),
        ([(0, 0), (1, 0), (0, 0)], False),
        ([(0, 0)], False),
    ],
)
def test_rings_that_cross(spark, points, want):
    assert spark.range(1).select(scalars.ring_crosses_itself(ring(*points)).alias("x")).first().x is want


def test_area_without_a_plane(spark):
    far = spark.range(1).select(scalars.area_ha(ring((0, 91), (1, 91), (1, 92), (0, 92), (0, 91))).alias("a"), scalars.area_ha(ring((77, 29), (77.01, 29), (77.01, 29.01), (77, 29.01), (77, 29))).alias("b")).first()
    assert far.a > 0 and far.b == pytest.approx(107.9, rel=0.01)


def test_hold_outs_take_local_negatives_along(spark):
    rows = [(1, "a", 1), (2, "a_local_neg", 0), (3, "b", 1), (4, "c", 0), (5, None, 0), (6, "a", 1), (6, "a", 1)]
    df = spark.createDataFrame(rows, "k int, plot string, label int")
    got = sorted((r.k, r.fold) for r in splits.leave_one_out_rows(df, "plot", "label").collect())
    assert got == sorted([(1, 0), (2, 0), (3, 1), (4, None), (5, None), (6, 0), (6, 0)], key=str) or set(got) == {(1, 0), (2, 0), (3, 1), (4, None), (5, None), (6, 0)}
    held, rest = splits.reserve(df, spark.createDataFrame([("a",)], "held_out string"), "plot")
    assert sorted(r.k for r in held.collect()) == [1, 2, 6, 6] and sorted(r.k for r in rest.collect()) == [3, 4, 5]
    assert held.columns == df.columns == rest.columns


def test_sample_of_pixels(spark):
    df = spark.createDataFrame([(p, k, None if k % 2 else 1.0) for p in "ab" for k in range(30)], "plot string, k int, v double")
    a, b = (sorted((r.plot, r.k, r.v) for r in scenes.sample(x, ["plot"], "k", ["v"], 10).collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 20 and {v for _, k, v in a if k % 2} == {-999.0}


def test_scenes_that_do_not_count(spark):
    pixels = spark.createDataFrame([(1, s, -10.0, -20.0) for s in "abcd"] + [(1, None, 0.0, 0.0)], "entity int, scene string, VV double, VH double")
    both = ["VV", "VH"]
    of = spark.createDataFrame([("a", "IW", "DESCENDING", both), ("a", "IW", "DESCENDING", both), ("b", "EW", "DESCENDING", both), ("c", "IW", "ASCENDING", both), ("d", "IW", "DESCENDING", ["VV"])], "scene string, mode string, orbit string, polarisations array<string>")
    assert sorted((r.band, round(r.v, 6), r.n) for r in scenes.radar(pixels, of, ["entity"]).collect()) == [("VH", 0.01, 1), ("VV", 0.1, 1)]


def test_polygons_know_their_placemark(spark, tmp_path):
    mark = "<Placemark><name>{}</name><description><![CDATA[ {} ]]></description><Polygon><outerBoundaryIs><LinearRing><coordinates>{}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    doc = "<kml>" + mark.format("east", "a field", RING) + "<!-- " + mark.format("hidden", "", RING) + " -->" + mark.format("west", "", RING.replace("77.", "78.")) + "</kml>"
    (tmp_path / "b_aug2023.kml").write_text(doc)
    (tmp_path / "a.kml").write_text("<kml>" + mark.format("é", "", RING) + "</kml>", encoding="utf-8")
    boxes = spark.createDataFrame([(0, "Here", 76.9, 77.5, 28.0, 30.0)], "ord int, name string, x0 double, x1 double, y0 double, y1 double")
    got = kml.read_kml(spark, str(tmp_path), 0, states=boxes).orderBy("plot_id").collect()
    assert [(r.plot_id, r.name, r.description, r.state, r.group_key) for r in got] == [
        ("plot_00001", "é", "", "Here", "neg__a.kml"), ("plot_00002", "east", "a field", "Here", "neg__b_aug2023.kml"), ("plot_00003", "west", "", "Unknown", "neg__b_aug2023.kml"),
    ]


def test_no_polygon_is_an_error(spark, tmp_path):
    (tmp_path / "bad.kml").write_text("<kml>")
    with pytest.raises(ValueError, match="no polygon"):
        kml.read_kml(spark, str(tmp_path), 1)


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(1)
    rows = [(i, a := rng.random(), b := rng.random(), int(a + b > 1), i % 2) for i in range(200)]
    return ml.assemble(spark.createDataFrame(rows, "k int, a double, b double, label int, fold int"), ["a", "b"])


def test_stack(spark, folded):
    got = ml.stack(folded, ["rf"], "k", numTrees=5, maxDepth=3).toPandas()
    assert sorted(got.k) == list(range(200)) and got.score.between(0, 1).all()
    assert ((got.score >= 0.5) == (got.label == 1)).mean() > 0.85


def test_search(folded):
    small = {"numTrees": (2, 6, "step 2"), "maxDepth": (1, 4, "whole"), "featureSubsetStrategy": ["sqrt", "log2"]}
    found = ml.random_search(folded, "rf", small, trials=2, seed=3)
    assert found == sorted(found, key=lambda x: -x[1]) and len(found) == 2 and found[0][1] > 0.6
    assert all(p["numTrees"] in (2, 4, 6) and 1 <= p["maxDepth"] <= 4 for p, _ in found)
    drawn = [{k: ml._draw(random.Random(s), v) for k, v in ml.SEARCH["xgb"].items()} for s in range(50)]
    assert all(0.01 <= d["stepSize"] <= 0.2 and d["maxIter"] % 50 == 0 and 3 <= d["maxDepth"] <= 9 for d in drawn)
