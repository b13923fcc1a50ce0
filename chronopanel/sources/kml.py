"""Polygons from KML and KMZ files."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions import scalars
from chronopanel.operators import rings, spatial, splits
from chronopanel.session import checkpointed


def _unzipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The document of each archive: doc.kml, else its first KML entry; null, and why, if there is none."""
    for b in batches:
        out, why = [], []
        for content in b["content"]:
            reason = None
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".kml")]
                    data = z.read("doc.kml" if "doc.kml" in names else names[0]) if names else None
                reason = None if names else "no KML in the archive"
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as broken:
                data, reason = None, f"unreadable archive: {broken}"
            out.append(None if data is None else data.decode("utf-8", "replace"))
            why.append(reason)
        yield pd.DataFrame({"path": b["path"], "xml": out, "fault": why})


def _documents(spark: SparkSession, paths: str | list[str], recursive: bool) -> DataFrame:
    """path, xml and fault of each file, without comments and prefixes of names; only archives go through Python."""

    def files(pattern: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(paths).select("path", "content")

    plain = files("*.{kml,KML}").select("path", F.col("content").cast("string").alias("xml"), F.lit(None).cast("string").alias("fault"))
    both = plain.union(files("*.{kmz,KMZ}").mapInPandas(_unzipped, "path string, xml string, fault string"))
    bare = F.regexp_replace(F.regexp_replace("xml", r"(?s)<!--.*?-->", ""), r"<(/?)[A-Za-z0-9]+:", "<$1")
    return both.withColumn("xml", bare)


def _shapes(xml: Column) -> Column:
    """Array of text (of the coordinates), polygon (or line), name and description, in order of the placemarks."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<Placemark\b.*?</Placemark>"), F.lit(0))
    marks = F.when(F.size(found) > 0, found).otherwise(F.array(xml))

    def said(mark: Column, tag: str) -> Column:
        text = F.regexp_extract(mark, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
        return F.trim(F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", "")).alias(tag)

    def of(mark: Column, tag: str, polygon: bool) -> Column:
        texts = F.regexp_extract_all(mark, F.lit(rf"(?s)<{tag}\b.*?<coordinates[^>]*>(.*?)</coordinates>"), F.lit(1))
        return F.transform(texts, lambda x: F.struct(x.alias("text"), F.lit(polygon).alias("polygon"), said(mark, "name"), said(mark, "description")))

    return F.flatten(F.transform(marks, lambda m: F.concat(of(m, "outerBoundaryIs", True), of(m, "LineString", False))))


def read_kml(spark: SparkSession, paths: str | list[str], label: int, state: str = "Unknown", default_anchor: str = "2024-09-01", before: int = 5, after: int = 5, recursive: bool = True, states: DataFrame | None = None) -> DataFrame:
    """A row for each polygon (outer rings, and closed lines of at least four points) of the files: plot_id (by file
    and place in it), group_key (class and file), its area in hectares, planar centroid, anchor window, and its
    placemark's name and description.

    Files that can't be read give no rows, faults() says why; if none gives any, it is an error. states: boxes as for
    spatial.range_join(), the first of which that holds the centroid names the state, else it is `state`."""
    d = polygons(_documents(spark, paths, recursive).where("xml is not null"), label, state, default_anchor, before, after, states)
    if d.isEmpty():
        raise ValueError(f"no polygon in {paths}")
    return d


def faults(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """path, polygon_idx (null for a whole file) and reason, of each file that gives no polygon and each ring that is left
    out or crosses itself: what read_kml() passes over."""
    docs = checkpointed(_documents(spark, paths, recursive))
    shapes = docs.where("xml is not null").select("path", F.posexplode(_shapes(F.col("xml"))).alias("polygon_idx", "shape"))
    drawn = shapes.withColumn("ring", scalars.parse_ring(F.col("shape.text"))).withColumn("line", ~F.col("shape.polygon"))
    first, last = F.try_element_at("ring", F.lit(1)), F.try_element_at("ring", F.lit(-1))
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("ring")).otherwise(F.concat("ring", F.array(first)))
    open_line = F.col("line") & ~scalars.is_closed(F.col("ring"))
    ring = F.when(F.size("ring") > 0, F.when(open_line, F.col("ring")).otherwise(closed))
    judged = rings.repaired(drawn.select("path", "polygon_idx", open_line.alias("open"), ring.alias("ring")))
    of_rings = judged.select("path", "polygon_idx", F.when(F.col("open"), "an open line").otherwise(F.col("reason")).alias("reason")).where(F.col("reason") != rings.VALID)
    bare = docs.where("xml is not null").join(shapes.select("path").distinct(), "path", "left_anti").select("path", F.lit("no coordinates").alias("reason"))
    whole = docs.where("xml is null").select("path", "fault").toDF("path", "reason").unionByName(bare)
    return of_rings.unionByName(whole.withColumn("polygon_idx", F.lit(None).cast("int")))


def polygons(docs: DataFrame, label: int, state: str = "Unknown", default_anchor: str = "2024-09-01", before: int = 5, after: int = 5, states: DataFrame | None = None) -> DataFrame:
    """The rows of read_kml() from documents (path and xml)."""
    d = docs.select("path", F.posexplode(_shapes(F.col("xml"))).alias("polygon_idx", "shape"))
    return _plots(d, label, state, default_anchor, before, after, states)


_RING = "struct<LinearRing: struct<coordinates: string>>"
_POLYGON = f"struct<outerBoundaryIs: {_RING}>"
_LINE = "struct<coordinates: string>"
_PLACEMARK = f"name string, description string, Polygon array<{_POLYGON}>, LineString array<{_LINE}>, MultiGeometry struct<Polygon: array<{_POLYGON}>, LineString: array<{_LINE}>>, broken string"


def read_large_kml(spark: SparkSession, paths: str | list[str], label: int, state: str = "Unknown", default_anchor: str = "2024-09-01", before: int = 5, after: int = 5, recursive: bool = True, states: DataFrame | None = None) -> DataFrame:
    """The rows of read_kml() of plain files of any size: these are split at their placemarks, each of which is a row, so
    that no document is held whole. Names have no prefixes, geometries lie in the placemark or in one MultiGeometry, all
    polygons of a placemark come before its lines. Placemarks that are not well formed are left out: see broken_placemarks()."""
    d = _placemarks(spark, paths, recursive).where("broken is null")
    of = lambda c: F.coalesce(F.col(c), F.array())
    shape = lambda polygon: lambda text: F.struct(text.alias("text"), F.lit(polygon).alias("polygon"), F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.trim(F.coalesce("description", F.lit(""))).alias("description"))
    outer = F.transform(F.concat(of("Polygon"), of("MultiGeometry.Polygon")), lambda p: p["outerBoundaryIs"]["LinearRing"]["coordinates"])
    lines = F.transform(F.concat(of("LineString"), of("MultiGeometry.LineString")), lambda p: p["coordinates"])
    shapes = F.filter(F.concat(F.transform(outer, shape(True)), F.transform(lines, shape(False))), lambda s: s["text"].isNotNull())
    d = d.select("path", "start", F.monotonically_increasing_id().alias("row"), F.posexplode(shapes).alias("k", "shape"))
    d = splits.numbered(checkpointed(d), ["path", "start", "row", "k"], "__at")
    first = d.groupBy("path").agg(F.min("__at").alias("__first"))
    d = d.join(first, "path").select("path", (F.col("__at") - F.col("__first")).cast("int").alias("polygon_idx"), "shape")
    return _plots(d, label, state, default_anchor, before, after, states)


def broken_placemarks(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """path and broken (its text) of the placemarks that read_large_kml() leaves out."""
    return checkpointed(_placemarks(spark, paths, recursive)).where("broken is not null").select("path", "broken")


def _placemarks(spark: SparkSession, paths: str | list[str], recursive: bool) -> DataFrame:
    reader = spark.read.format("xml").schema(_PLACEMARK).option("rowTag", "Placemark").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    files = reader.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{kml,KML}").load(paths)
    return files.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _plots(d: DataFrame, label: int, state: str, default_anchor: str, before: int, after: int, states: DataFrame | None) -> DataFrame:
    d = d.withColumn("ring", scalars.parse_ring(F.col("shape.text")))
    d = d.where((F.col("shape.polygon") & (F.size("ring") >= 3)) | scalars.is_closed(F.col("ring")))
    first, last = F.element_at("ring", 1), F.element_at("ring", -1)
    d = d.withColumn("ring", F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("ring")).otherwise(F.concat("ring", F.array(first))))
    d = checkpointed(d)  # else each use of a ring would parse its document again
    d = d.withColumns({"source_file": F.url_decode(F.element_at(F.split("path", "/"), -1)), "area_ha": scalars.area_ha(F.col("ring"))}).where("area_ha > 0")
    d = splits.numbered(d, ["path", "polygon_idx"], "__i")
    d = d.withColumn("anchor_date", F.coalesce(scalars.filename_date(F.col("source_file")), F.lit(default_anchor).cast("date")))
    start, end = scalars.anchor_window(F.col("anchor_date"), before, after)
    lon, lat = scalars.ring_centroid(F.col("ring"))
    kind = F.lit("pos" if label == 1 else "neg")
    out = d.select(
        "source_file", "polygon_idx", F.lit(label).alias("label"), F.lit(state).alias("state"), "area_ha", lon.alias("lon"), lat.alias("lat"), "anchor_date",
        start.alias("date_start"), end.alias("date_end"), F.col("ring").alias("geometry"), F.format_string("plot_%05d", F.col("__i") + 1).alias("plot_id"),
        F.concat_ws("__", kind, "source_file").alias("group_key"), "shape.name", "shape.description",
    )
    if states is None:
        return out
    return spatial.range_join(out, states, "plot_id", 1.0, "lon", "lat", state).withColumn("state", F.col("box")).drop("box")
