"""Which columns of a wide feature table a model may see, and statistics for an audit of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.functions import scalars
from chronopanel.operators import ranks

# Column names and parts of names.
META = ["plot_id", "group_key", "label", "source_file", "anchor_date", "date_start", "date_end", "state"]
PLACE = ["longitude", "latitude"]
QUALITY = ["pct_windows_with_valid_optical", "n_cloudy_windows", "n_total_windows"]
SUSPECT = ["lat", "lon", "longitude", "latitude", "state", "district", "plot_id", "source_file", "anchor_date", "date_start", "date_end", "group_key", "centroid"]
INVARIANT = ["si_", "sar_", "cross_"]
SHAPES = [
    "_auc", "_peak_value", "_season_length", "_amplitude", "_smoothness", "_n_growing_seasons", "_asymmetry", "_greenup_half_month", "_peak_month",
    "_max_greenup_slope", "_max_senescence_slope", "_sar_auc", "_sar_peak_value", "_sar_season_length", "_sar_std", "_temporal_correlation",
    "_mean", "_max", "_min", "_std", "_range", "_cv", "_p10", "_p25", "_p75", "_p90", "_median", "_interannual_diff", "_interannual_stability",
]


def _words(name: str) -> list[str]:
    return name.lower().replace("-", "_").split("_")


def leaking(name: str) -> bool:
    """Whether words of the name, between underscores or hyphens, tell a place or an identity. Names of more than one word
    (plot_id) match where these words follow one another."""
    words = _words(name)
    return any(words[k : k + len(hint)] == hint for hint in map(_words, SUSPECT) for k in range(len(words) - len(hint) + 1))


def tells_quality(name: str) -> bool:
    """Whether a column or a statistic of it tells the data's quality, and so the place."""
    return name in QUALITY or name.startswith("valid_pixel_count_")


def without_places(df: DataFrame) -> DataFrame:
    return df.drop(*PLACE)


def season_invariant(name: str) -> bool:
    """Whether a feature does not belong to one step or date."""
    if name == "area_ha" or name.startswith(tuple(INVARIANT)):
        return True
    last = name.rsplit("_", 1)[-1]
    dated = last.startswith("t") and last[1:].isdigit() and len(last) in (3, 4)
    return name.endswith(tuple(SHAPES)) and not dated


def group_of(df: DataFrame) -> Column:
    """The column that keeps rows of one origin together: of the file, else of the plot."""
    kept = next(c for c in ("group_key", "source_file", "plot_id") if c in df.columns)
    return F.col(kept).cast("string")


def features_of(df: DataFrame, key: str, quality: bool = False, season_invariant: bool = False) -> tuple[DataFrame, list[str]]:
    """key, label, group and the features as doubles, with their names: numeric columns that are neither meta data
    nor places, nor leak, nor (unless asked for) tell the data's quality. Nulls and non-finite values are 0."""
    chosen = season_invariant_names(df) if season_invariant else df.columns
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    names = [c for c in chosen if c in numeric and c not in (key, *META, *PLACE) and not leaking(c) and (quality or not tells_quality(c))]

    def fixed(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x).alias(c)

    return df.select(key, F.col("label").cast("int").alias("label"), group_of(df).alias("group"), *[fixed(c) for c in names]), names


def season_invariant_names(df: DataFrame) -> list[str]:
    """Those of the columns; all of them where there is none."""
    return [c for c in df.columns if season_invariant(c)] or df.columns


def _with_quantiles(found: DataFrame, df: DataFrame, by: list[str], v: str, names: dict[str, float]) -> DataFrame:
    """found (a row for each group) with quantiles of v, which bring no group to one task."""
    q = ranks.quantiles(df, by, v, names)
    key = F.struct(*by)
    return found.withColumn("__g", key).join(q.select(key.alias("__g"), *names), "__g", "left").drop("__g")


def audit(df: DataFrame, by: list[str], area: str, distinct: list[str], cap: int = 100, tiny: float = 0.5) -> DataFrame:
    """Of each group: rows, spread of areas, pixels with and without a cap for each row, tiny areas and distinct values."""
    pixels = scalars.approx_pixels(F.col(area))
    a = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(area).alias("area_min"), F.avg(area).alias("area_mean"), F.max(area).alias("area_max"),
        F.sum(pixels).alias("pixels"), F.sum(F.least(pixels, F.lit(cap))).alias("pixels_capped"), F.count_if(F.col(area) < tiny).alias("n_tiny"),
        *[F.count_distinct(c).alias(f"n_{c}s") for c in distinct],
    )
    return _with_quantiles(a, df, by, area, {"area_p10": 0.1, "area_median": 0.5, "area_p90": 0.9})


def audit_places(df: DataFrame, by: list[str], area: str, valid: str, lon: str, lat: str, box: tuple[float, float, float, float], file: str) -> DataFrame:
    """Of each group, beside what audit() gives: files, rings that are not valid, the spread of pixels of a row, rows in and
    out of the box (least and largest longitude, latitude), and the extent of those inside. A row without a place is out."""
    pixels = scalars.approx_pixels(F.col(area))
    x0, x1, y0, y1 = box
    inside = F.coalesce(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1), F.lit(False))
    rows = df.withColumns({"__pixels": F.coalesce(pixels, F.lit(0)), "__in": inside})
    of = lambda f, c: f(F.when(F.col("__in"), F.col(c)))
    a = rows.groupBy(*by).agg(
        F.count_distinct(file).alias("n_files"), F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(valid), F.lit(False))).alias("n_invalid"),
        F.sum("__pixels").alias("pixels"), F.min("__pixels").alias("pixels_min"), F.max("__pixels").alias("pixels_max"),
        F.count_if("__in").alias("n_inside"), F.count_if(~F.col("__in")).alias("n_outside"),
        of(F.min, lat).alias("lat_min"), of(F.max, lat).alias("lat_max"), of(F.min, lon).alias("lon_min"), of(F.max, lon).alias("lon_max"),
    )
    a = a.withColumns({"lat_span": F.col("lat_max") - F.col("lat_min"), "lon_span": F.col("lon_max") - F.col("lon_min")})
    return _with_quantiles(a, rows, by, "__pixels", {"pixels_median": 0.5})


def most_frequent(df: DataFrame, by: list[str], column: str, top: int = 10) -> DataFrame:
    """by, the column, n, place and n_values: the `top` most frequent values of each group, ties by value, and how many
    values there are. The limit is part of the feature."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc_nulls_last(column))
    placed = counts.withColumns({"place": F.row_number().over(order), "n_values": F.count("*").over(Window.partitionBy(*by))})
    return placed.where(F.col("place") <= top)
