"""The whole feature table: every column of the schema, by entity, from one panel of bands.

The schema is a list of names in a fixed order, as long as the number of steps asks for. Features are made in long form
in a few groups (steps, statistics of raw series, of filled and smoothed curves, radar, ratios, quality), each of as many
columns as a series has features; a join with the schema gives each its position. So no projection and no union grows
with the width of the table. `vectors` has an array for each entity in the schema's order, `wide` and `write_wide` name
its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions import indices, scalars
from chronopanel.operators import features, series
from chronopanel.session import checkpointed

# Names of columns and the order in which the table has them.
META = ["plot_id", "group_key", "label", "source_file", "anchor_date", "date_start", "date_end", "state"]
BANDS = ["B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12", "VV", "VH"]
COUNT = "valid_pixel_count"
INDICES = [
    "NDVI", "EVI", "NDWI", "LSWI", "SAVI", "MSAVI", "NBR", "NDRE", "GNDVI", "NDMI", "CIre", "IRECI", "CCCI", "GRVI", "PSRI", "RVI", "RFDI", "CR", "NRPB",
]
QUALITY = ["pct_windows_with_valid_optical", "n_cloudy_windows", "n_total_windows"]
CURVES = ["NDVI", "EVI", "NDRE", "NDMI", "LSWI"]
RADAR = ["VV", "VH", "RVI"]
ANCHORED = ["NDVI", "NDRE", "NDMI"]
INVARIANT = ["NDVI", "EVI", "NDRE", "NDMI", "LSWI", "GNDVI", "SAVI"]
SHAPED = BANDS[:10]
STATS = ["min", "max", "mean", "median", "p10", "p25", "p75", "p90", "std", "range", "cv"]
SEASONS = {"wet_mean": "monsoon_mean", "wet_std": "monsoon_std", "dry_mean": "dry_mean", "dry_std": "dry_std", "contrast": "seasonal_contrast"}
YEARS = {"year_diff": "interannual_diff", "stability": "interannual_stability"}
PHENOLOGY = {
    "auc": "auc", "peak_value": "peak_value", "peak_idx": "peak_month", "greenup_half": "greenup_half_month", "max_rise": "max_greenup_slope", "max_fall": "max_senescence_slope",
    "season_length": "season_length", "n_seasons": "n_growing_seasons", "amplitude": "amplitude", "asymmetry": "asymmetry", "smoothness": "smoothness",
}
RADAR_CURVE = ["sar_auc", "sar_peak_value", "sar_season_length", "sar_std"]
PHASES = {"early": "may", "peak": "aug_sep", "late": "dec_jan", "amp": "amp_window", "rise": "rate_rise", "fall": "rate_fall"}
DURATION = {f"{a}_{t}": f"{b}_{t}" for t in ("04", "05", "06", "07") for a, b in (("above", "days_above"), ("frac", "frac_above"), ("streak", "max_streak"))} | {"green_span": "green_span"}
SHAPE = {
    n: n for n in ("mean", "max", "min", "std", "range", "p10", "p25", "p50", "p75", "p90", "iqr", "cv", "skewness", "kurtosis", "auc", "amplitude")
} | {"peak_trough": "peak_trough_ratio"}
DYNAMICS = {
    "max_rise": "max_rise_rate", "max_fall": "max_fall_rate", "mean_abs_change": "mean_abs_change", "smoothness": "smoothness", "roughness": "roughness", "autocorr_lag1": "autocorr_lag1", "n_peaks": "n_peaks",
}
HARMONICS = {
    "amp1": "harmonic1_amp", "phase1": "harmonic1_phase", "amp2": "harmonic2_amp", "phase2": "harmonic2_phase", "amp3": "harmonic3_amp", "dominance": "harmonic1_dominance", "entropy": "spectral_entropy",
}
STRUCTURE = ["cr_mean", "cr_std", "cr_max", "rvi_mean", "rvi_std", "rvi_max", "rvi_p75", "vh_mean", "vh_std", "vh_cv", "vv_mean", "vv_std", "rvi_days_above_07", "vh_autocorr_lag1"]
CROSS = {"corr_vh": "ndvi_vh_corr", "ratio_mean": "vh_ndvi_ratio_mean", "ratio_std": "vh_ndvi_ratio_std", "corr_vv": "ndvi_vv_corr"}
RATIO = ["mean", "std", "p50"]

ALL = [*BANDS, COUNT, *INDICES]


def tag(step: int) -> str:
    return f"t{step:02d}"


def schema(steps: int) -> list[str]:
    """The numeric columns, 32 for each step and 1168 more."""
    tags = [tag(k) for k in range(steps)]
    out = ["area_ha", *[f"{b}_{t}" for t in tags for b in (*BANDS, COUNT)], *QUALITY, *[f"{b}_{t}" for t in tags for b in INDICES]]
    out += [f"{b}_{n}" for b in CURVES for n in PHENOLOGY.values()] + [f"{b}_{n}" for b in RADAR for n in RADAR_CURVE] + ["NDVI_VV_temporal_correlation"]
    out += [f"{b.lower()}_{n}" for b in ANCHORED for n in PHASES.values()]
    for names in (STATS, SEASONS.values(), YEARS.values()):
        out += [f"{b}_{n}" for b in ALL for n in names]
    out += [f"{b}_NDVI_ratio_{n}" for b in ("VV", "VH") for n in RATIO]
    out += [f"si_{b}_{n}" for b in INVARIANT for names in (DURATION, SHAPE, DYNAMICS, HARMONICS) for n in names.values()]
    out += [f"si_{b}_{n}" for b in SHAPED for n in SHAPE.values()]
    return out + [f"sar_{n}" for n in STRUCTURE] + [f"cross_{n}" for n in CROSS.values()]


def _named(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    """entity, feature, value: a row for each entry, whose column has the same name as its feature has in df."""
    pairs = F.array(*[F.struct(feature.alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c, feature in names.items()])
    return df.select("entity", F.explode(pairs).alias("p")).select("entity", "p.feature", "p.value")


def _of_series(x: DataFrame, parts: dict[str, tuple[features.Part, str, dict[str, str]]]) -> DataFrame:
    """Features of parts, whose names are a prefix, the band and the given ending. A prefix in capitals asks for the
    band in small letters."""
    found = features.together(x, {f"{k}.": p for k, (p, _, _) in parts.items()})
    band = {True: F.lower("band"), False: F.col("band")}
    names = {f"{k}.{c}": F.concat(F.lit(start.lower()), band[start.isupper()], F.lit(f"_{end}")) for k, (_, start, ends) in parts.items() for c, end in ends.items()}
    return _named(found, names)


def build(panel: DataFrame, area: DataFrame, steps: int, min_valid: int = 5, growth: float = 0.3) -> DataFrame:
    """entity, position, feature, value for each numeric column of the schema.

    panel has entity, step (0 to steps - 1, all of them) and the bands and valid_pixel_count as columns; area has entity
    and area_ha. What is null or not finite becomes 0, features that a panel is too short for are 0 as well."""
    panel = checkpointed(panel)
    n = panel.count()
    made = panel.select("entity", "step", *[F.col(b).cast("double").alias(b) for b in (*BANDS, COUNT)], *[indices.index(n).alias(n) for n in INDICES])
    raw = series.dealt(made.unpivot(["entity", "step"], ALL, "band", "v"), n * len(ALL))
    filled = series.gap_fill(raw.withColumn("f", F.col("v")), "f")
    x = checkpointed(series.smooth(filled.withColumn("s", F.col("f")), "s").select("entity", "band", "step", "v", "f", "s"))

    step = F.col("step").cast("int")
    month, year = scalars.synthetic_month(step, steps), scalars.synthetic_year(step, steps)
    same = {n: n for n in STATS}
    of_raw = {
        "stats": (features.stats_part("v", "a_"), "", same), "seasons": (features.seasonal_part(month, v="v", p="b_"), "", SEASONS),
        "years": (features.years_part(year, 2025, 2026, "v", "c_"), "", YEARS),
    }
    curves = {
        "duration": (features.duration_part(v="f", p="a_"), "si_", DURATION), "shape": (features.shape_part("f", "b_"), "si_", SHAPE), "dynamics": (features.dynamics_part("f", "c_"), "si_", DYNAMICS),
        "harmonics": (features.harmonics_part(steps, "f", "d_"), "si_", HARMONICS), "phenology": (features.phenology_part(growth, "s", "e_"), "", PHENOLOGY),
    }
    some = lambda bands: series.spread(x.where(F.col("band").isin(*bands)), n * len(bands))
    groups = [
        x.select("entity", F.concat("band", F.lit("_t"), F.lpad(F.col("step").cast("string"), 2, "0")).alias("feature"), F.col("v").alias("value")),
        _of_series(some(ALL), of_raw),
        _of_series(some(ANCHORED), {"phases": (features.window_part(steps, "v", "a_"), "_", PHASES)}).withColumn("feature", F.substring("feature", 2, 99)).withColumn("feature", F.lower("feature")),
        _of_series(some(INVARIANT), curves),
        _of_series(some(SHAPED), {"shape": (features.shape_part("f", "b_"), "si_", SHAPE)}),
    ]
    curve = features.radar_phenology(some(RADAR).select("entity", "band", "step", F.col("f").alias("v")))
    groups.append(_named(curve, {n: F.concat("band", F.lit(f"_{n}")) for n in RADAR_CURVE}))
    vh = features.together(some(["VH"]), {"": features.dynamics_part("f", "a_")})
    groups.append(_named(vh.select("entity", "autocorr_lag1"), {"autocorr_lag1": F.lit("sar_vh_autocorr_lag1")}))

    at = lambda b, v: F.max(F.when(F.col("band") == b, F.col(v)))
    both = some(["NDVI", "VV", "VH"]).groupBy("entity", "step").agg(*[at(b, v).alias(f"{b}{k}") for b in ("NDVI", "VV", "VH") for v, k in (("f", ""), ("v", "_raw"))])
    both = series.spread(checkpointed(both), n, ("entity",))
    groups.append(_named(features.radar_structure(both), {n: F.lit(f"sar_{n}") for n in STRUCTURE[:-1]}))
    groups.append(_named(features.cross_sensor(both), {n: F.lit(f"cross_{e}") for n, e in CROSS.items()}))
    groups.append(_named(features.correlation(both, "NDVI", "VV", ["entity"]), {"r": F.lit("NDVI_VV_temporal_correlation")}))
    ratios = {b: indices.clipped_ratio(F.col(f"{b}_raw"), F.col("NDVI_raw")) for b in ("VV", "VH")}
    ratio = both.select("entity", *[c.alias(b) for b, c in ratios.items()]).groupBy("entity").agg(
        *[f.alias(f"{b}_NDVI_ratio_{n}") for b in ratios for n, f in (("mean", F.avg(b)), ("std", F.stddev_pop(b)), ("p50", F.percentile(b, F.lit(0.5))))]
    )
    groups.append(_named(ratio, {c: F.lit(c) for c in ratio.columns[1:]}))
    enough = F.coalesce(F.col("v") >= min_valid, F.lit(False))
    quality = some([COUNT]).groupBy("entity").agg((F.avg(enough.cast("double")) * 100).alias(QUALITY[0]), F.count_if(~enough).alias(QUALITY[1]), F.count("*").alias(QUALITY[2]))
    groups.append(_named(quality, {c: F.lit(c) for c in QUALITY}))
    groups.append(_named(area, {"area_ha": F.lit("area_ha")}))

    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    names = panel.sparkSession.createDataFrame(list(enumerate(schema(steps))), "position int, feature string")
    value = F.when(F.abs("value") < float("inf"), F.col("value")).otherwise(0.0)
    # as many rows as the schema has columns
    return out.join(F.broadcast(names), "feature").select("entity", "position", "feature", value.alias("value"))


def vectors(table: DataFrame) -> DataFrame:
    """entity and features: its values in the schema's order, as one array of the schema's length."""
    rows = table.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("rows"))
    return rows.select("entity", F.col("rows.value").alias("features"))


def wide(of: DataFrame, names: list[str], chosen: list[str] | None = None) -> DataFrame:
    """entity and the chosen columns (all, unless given) of vectors()."""
    at = {n: i for i, n in enumerate(names)}
    return of.select("entity", *[F.get("features", at[n]).alias(n) for n in chosen or names])


def write_wide(of: DataFrame, names: list[str], at: str, size: int = 256) -> list[str]:
    """Write the columns of vectors() in groups of `size`, a Parquet folder each; their paths, in the schema's order."""
    paths = []
    for k in range(0, len(names), size):
        paths.append(f"{at}/columns-{k:05d}")
        wide(of, names, names[k : k + size]).write.mode("overwrite").parquet(paths[-1])
    return paths
