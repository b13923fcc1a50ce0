"""Validity and repair of rings against plain geometry; what the reader of polygons passes over."""

import time
import zipfile

import numpy as np
from pyspark.sql import types as T

from chronopanel.operators import rings, selection, spatial
from chronopanel.sources import kml


def areas(points):
    return sorted(round(abs(rings._area(r)), 9) for r in rings.simple_rings(np.array(points, float)))


def test_simple_rings():
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert areas(square) == [4] and areas(square[::-1]) == [4]
    assert areas([(0, 0), (2, 0), (0, 2), (2, 2), (0, 0)]) == [1, 1]  # a bow
    assert areas([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]) == [4, 4]  # touches its own side
    assert areas([(0, 0), (1, 0), (1, 1), (0, 0), (-1, 0), (-1, -1), (0, 0)]) == [0.5, 0.5]  # touches a corner
    assert areas([(0, 0), (3, 3), (6, 0), (6, 3), (3, 0), (0, 3), (0, 0)]) == [2.25, 2.25, 4.5]  # crosses twice


def test_crossings_equal_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        p = rng.integers(0, 12, (int(rng.integers(4, 14)), 2)).astype(float)
        p = np.vstack([p, p[:1]])
        n, want = len(p) - 1, set()
        for i in range(n):
            for j in range(i + 1, n):
                m = rings._meet(p[i], p[i + 1], p[j], p[j + 1])
                if m is not None and not (j - i in (1, n - 1) and rings._is_end(m, p[i], p[i + 1]) and rings._is_end(m, p[j], p[j + 1])):
                    want.add((i, j))
        assert {(i, j) for i, j, _ in rings.crossings(p)} == want


def test_large_ring_is_swept():
    turn = np.linspace(0, 2 * np.pi, 20_001)
    circle = np.column_stack([np.cos(turn), np.sin(turn)])
    circle[-1] = circle[0]
    began = time.time()
    assert len(rings.simple_rings(circle)) == 1 and time.time() - began < 30


def test_repaired(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    rows = {
        "valid": (square, rings.VALID, 1), "bow": ([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)], rings.CROSSES, 2), "none": (None, "no ring", 0), "empty": ([], "no ring", 0),
        "nan": ([*square[:2], (float("nan"), 1.0), *square[3:]], "a point without a place", 0), "null": ([*square[:2], (None, 1.0), *square[3:]], "a point without a place", 0),
        "few": (square[:2] + square[:1], "too few points", 0), "open": (square[:4], "not closed", 0), "flat": ([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)], "no area", 0),
        "line": ([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)], "no area", 0), "repeated": ([square[0], *square], rings.VALID, 1),
    }
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ring", T.ArrayType(rings.POINT)), T.StructField("reason", T.StringType())])
    df = spark.createDataFrame([(k, r, "own") for k, (r, _, _) in rows.items()], schema)
    got = {r.k: (r.reason, len(r.rings or [])) for r in rings.repaired(df).collect()}
    assert got == {k: (reason, n) for k, (_, reason, n) in rows.items()}
    assert {r.k for r in rings.usable(df).collect()} == {"valid", "bow", "repeated"} and rings.repaired(df.limit(0)).count() == 0


def _placemark(coordinates, tag="Polygon"):
    inner = f"<coordinates>{coordinates}</coordinates>"
    body = f"<outerBoundaryIs><LinearRing>{inner}</LinearRing></outerBoundaryIs>" if tag == "Polygon" else inner
    return f"<Placemark><{tag}>{body}</{tag}></Placemark>"


def test_faults(spark, tmp_path):
    good, bow = "77,28 77.1,28 77.1,28.1 77,28.1 77,28", "77,28 77.1,28 77,28.1 77.1,28.1 77,28"
    kml_of = lambda *marks: f"<kml><Document>{''.join(marks)}</Document></kml>"
    (tmp_path / "a.kml").write_text(kml_of(_placemark(good), _placemark(bow), _placemark("77,28 77.1,28"), _placemark("x y", "Polygon"), _placemark("77,28 78,29 79,30", "LineString")))
    (tmp_path / "b.kml").write_text("<kml>nothing</kml>")
    (tmp_path / "c.kmz").write_bytes(b"not an archive")
    with zipfile.ZipFile(tmp_path / "d.kmz", "w") as z:
        z.writestr("readme.txt", "no kml")
    with zipfile.ZipFile(tmp_path / "e.kmz", "w") as z:
        z.writestr("doc.kml", kml_of(_placemark(good)))
    got = {(r.path.rsplit("/", 1)[-1], r.polygon_idx): r.reason for r in kml.faults(spark, str(tmp_path)).collect()}
    assert got.pop(("c.kmz", None)).startswith("unreadable archive")
    assert got == {("a.kml", 1): rings.CROSSES, ("a.kml", 2): "too few points", ("a.kml", 3): "no ring", ("a.kml", 4): "an open line", ("b.kml", None): "no coordinates", ("d.kmz", None): "no KML in the archive"}


def test_audit_of_odd_rows(spark):
    rows = [("a", 1.0, True, 77.5, 29.0, "f", "x"), ("a", None, None, None, None, None, None), ("a", 0.2, False, 10.0, 29.0, "g", "y"), (None, 2.0, True, 77.6, 29.1, "f", "x")]
    df = spark.createDataFrame(rows, "kind string, area double, valid boolean, lon double, lat double, file string, district string")
    got = {r.kind: r for r in selection.audit_places(df, ["kind"], "area", "valid", "lon", "lat", (77.0, 78.0, 28.0, 30.0), "file").collect()}
    a = got["a"]
    assert (a.n, a.n_files, a.n_invalid, a.n_inside, a.n_outside, a.pixels, a.pixels_median, a.lon_span) == (3, 2, 2, 1, 2, 120, 20.0, 0.0) and got[None].n == 1
    top = selection.most_frequent(df, ["kind"], "district", 2).collect()
    assert [(r.district, r.n) for r in sorted(top, key=lambda r: (str(r.kind), r.place)) if r.kind == "a"] == [("x", 1), ("y", 1)]
    box = spatial.extent(df, "lon", "lat").first()
    assert (box.x0, box.y0, box.x1, box.y1, box.n) == (10.0, 29.0, 77.6, 29.1, 3)


def test_large_files_are_split_at_placemarks(spark, tmp_path):
    """The same plots as from whole documents, from files that are read in many pieces; broken placemarks are listed."""
    def square(x, y):
        return f"{x},{y} {x + 0.1},{y} {x + 0.1},{y + 0.1} {x},{y + 0.1} {x},{y}"

    for name, n in (("big_2024_03_01.kml", 300), ("small.kml", 2)):
        marks = [f"<Placemark><name>p{k}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{square(77 + k * 0.01, 28)}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>" for k in range(n)]
        marks.append(f"<Placemark><name>m</name><MultiGeometry>{''.join(f'<Polygon><outerBoundaryIs><LinearRing><coordinates>{square(79, 28 + k)}</coordinates></LinearRing></outerBoundaryIs></Polygon>' for k in range(2))}</MultiGeometry></Placemark>")
        marks.append(f"<Placemark><LineString><coordinates>{square(80, 28)}</coordinates></LineString></Placemark><Placemark><name>point</name><Point><coordinates>1,2</coordinates></Point></Placemark>")
        (tmp_path / name).write_text(f"<?xml version='1.0'?><kml><Document>{''.join(marks)}</Document></kml>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = kml.read_large_kml(spark, str(tmp_path), 1).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = kml.read_kml(spark, str(tmp_path), 1).collect()
    assert len(want) == 300 + 2 + 2 * 3 and sorted(map(str, got)) == sorted(map(str, want))
    assert kml.broken_placemarks(spark, str(tmp_path)).count() == 0
    (tmp_path / "bad.kml").write_text("<kml><Document><Placemark><name>x</Polygon></Placemark></Document></kml>")
    assert [r.path.rsplit("/", 1)[-1] for r in kml.broken_placemarks(spark, str(tmp_path)).collect()] == ["bad.kml"]
