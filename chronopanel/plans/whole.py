"""Queries of the whole feature table, what is trained on it, and the tensor of cleaned channels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions import indices, scalars
from chronopanel.operators import detector, features, rings, selection, spatial, splits, table
from chronopanel.plans import oracle as o
from chronopanel.plans import queries as q
from chronopanel.plans import tables as t
from chronopanel.session import checkpointed, shared_dir
from chronopanel.sources import stages

#: Which mixture of event types stands for each band; the same text in Spark and in SQL.
MIXED = {
    "B2": "purchase", "B3": "signup", "B4": "click", "B5": "click * 0.6e0 + view * 0.4e0", "B6": "click * 0.4e0 + view * 0.6e0", "B7": "click * 0.2e0 + view * 0.8e0", "B8": "view",
    "B8A": "view * 0.9e0 + signup * 0.1e0", "B11": "error", "B12": "error * 0.7e0 + click * 0.3e0", "VV": "signup * 0.5e0 + purchase * 0.5e0", "VH": "error * 0.5e0",
}
_RATIO = "({a} - {b}) / nullif({a} + {b} + {e}, 0)"
_R = lambda a, b, e="1e-8": _RATIO.format(a=a, b=b, e=e)
_ROOT = "(2 * B8 + 1) ** 2 - 8 * (B8 - B4)"
INDEX_SQL = {
    "NDVI": _R("B8", "B4"), "EVI": "2.5 * (B8 - B4) / nullif(B8 + 6 * B4 - 7.5 * B2 + 1 + 1e-8, 0)", "NDWI": _R("B3", "B8"), "LSWI": _R("B8", "B11"),
    "SAVI": "(B8 - B4) / nullif(B8 + B4 + 0.5 + 1e-8, 0) * 1.5", "MSAVI": f"(2 * B8 + 1 - sqrt(case when {_ROOT} < 0 then 0 else {_ROOT} end)) / 2", "NBR": _R("B8", "B12"), "NDRE": _R("B8A", "B5"),
    "GNDVI": _R("B8", "B3"), "NDMI": _R("B8A", "B11"), "CIre": "B7 / nullif(B5 + 1e-10, 0) - 1", "IRECI": "(B7 - B4) / nullif(B5 / nullif(B6 + 1e-10, 0) + 1e-10, 0)",
    "CCCI": f"({_R('B8A', 'B5')}) / nullif({_R('B8', 'B4')} + 1e-10, 0)", "GRVI": _R("B3", "B4", "1e-10"), "PSRI": "(B4 - B2) / nullif(B7 + 1e-10, 0)",
    "RVI": "4 * VH / nullif(VV + VH + 1e-8, 0)", "RFDI": _R("VV", "VH"), "CR": "VH / nullif(VV + 1e-8, 0)", "NRPB": _R("VH", "VV", "1e-10"),
}
LEAST = 2


def panel(spark, d) -> DataFrame:
    """A row for each entity and step with the twelve bands and valid_pixel_count; bands without observations are null."""
    g = t.grid(spark, d)
    w = g.groupBy("entity", "step").agg(*[F.max(F.when(F.col("band") == b, F.col("v"))).alias(b) for b in t.EVENT_BANDS], F.max(F.when(F.col("band") == "view", F.col("n"))).alias(table.COUNT))
    return w.select("entity", "step", *[F.expr(e).alias(b) for b, e in MIXED.items()], F.coalesce(table.COUNT, F.lit(0)).cast("double").alias(table.COUNT))


def about(spark, d) -> DataFrame:
    """Meta data of each entity, from the customer of the same number."""
    c = t.read(spark, d, "customer")
    e = t.observed(spark, d).select("entity").distinct()
    label = (F.coalesce(F.col("c_acctbal"), F.lit(0)) > 4500).cast("int")
    return e.join(c, F.col("entity") == F.col("c_custkey"), "left").select(
        "entity", F.col("entity").cast("string").alias("plot_id"), F.concat(F.lit("file_"), (F.col("entity") / 3).cast("int").cast("string")).alias("group_key"), label.alias("label"),
        F.concat(F.lit("file_"), (F.col("entity") / 3).cast("int").cast("string"), F.lit(".kml")).alias("source_file"), F.lit("2024-01-16").alias("anchor_date"), F.lit("2024-01-01").alias("date_start"),
        F.lit("2024-01-31").alias("date_end"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("unknown")).alias("state"), (F.col("entity") % 11 + 0.5).cast("double").alias("area_ha"),
    )


_LIST = ", ".join(f'"{b}"' for b in table.ALL)
PANEL = (
    o.GRID.replace("grid as", "base as") + ", events_wide as (select entity, step, " + ", ".join(f"max(v) filter (where band = '{b}') as {b}" for b in t.EVENT_BANDS)
    + ", coalesce(max(n) filter (where band = 'view'), 0)::double as valid_pixel_count from base group by 1, 2), panel as (select entity, step, "
    + ", ".join(f'{e} as "{b}"' for b, e in MIXED.items()) + ", valid_pixel_count from events_wide)"
)
_GRID = (
    PANEL + ", made as (select *, " + ", ".join(f'{e} as "{n}"' for n, e in INDEX_SQL.items()) + " from panel), grid as (select entity, band, step, v from (select entity, step, "
    + ", ".join(f'"{b}"::double as "{b}"' for b in table.ALL) + f" from made) unpivot include nulls (v for band in ({_LIST})))"
)
_FILLED = _GRID + ", " + o.fill("grid", "filled")
_SMOOTHED = _FILLED + ", " + o.smooth("filled", "smoothed", t.STEPS - 1)
_WIDE = "wide as (select entity, step, max(v) filter (where band = 'NDVI') as view, max(v) filter (where band = 'VH') as error, max(v) filter (where band = 'VV') as signup from filled group by 1, 2)"


def _own(name: str) -> str:
    """The registered SQL over these series."""
    sql = q.SQL[name]
    for theirs, own in ((o.SMOOTHED, _SMOOTHED), (o.FILLED, _FILLED), (o.GRID, _GRID), (o.MONTHS, f"{_GRID}, {q._DATED.replace('from filled', 'from grid')}")):
        if theirs in sql:
            return sql.replace(theirs, own, 1).replace(o.WIDE, _WIDE)
    raise KeyError(name)


def _part_sql(sql: str, ends: dict[str, str], name: str, keys: str = "entity, band") -> str:
    columns = ", ".join(f'"{c}"::double as "{e}"' for c, e in ends.items())
    listed = ", ".join(f'"{e}"' for e in ends.values())
    return f"select entity, {name} as feature, value from (select {keys}, {columns} from ({sql})) unpivot include nulls (value for f in ({listed}))"


def _table_sql() -> str:
    plain, si, low = "band || '_' || f", "'si_' || band || '_' || f", "lower(band) || '_' || f"
    pick = lambda ends, *names: {c: ends[c] for c in names}
    shaped = ", ".join(f"'{b}'" for b in (*table.INVARIANT, *table.SHAPED))
    curves = ", ".join(f"'{b}'" for b in table.INVARIANT)
    of = lambda name, bands: f"select * from ({_own(name)}) where band in ({bands})"
    radar = _own("sar_phenology_db").replace("-20 * v as v", "v").replace("('error', 'signup')", "('VV', 'VH', 'RVI')")
    ratio = ", ".join(f"{f} as {b}_NDVI_ratio_{n}" for b in ("VV", "VH") for n, f in (("mean", f"avg({b})"), ("std", f"stddev_pop({b})"), ("p50", f"quantile_cont({b}, 0.5)")))
    clipped = ", ".join(f"case when {b} is null or NDVI is null then null else greatest(least({b} / nullif(NDVI + 1e-8, 0), 50), -50) end as {b}" for b in ("VV", "VH"))
    ratios = [f"{b}_NDVI_ratio_{n}" for b in ("VV", "VH") for n in table.RATIO]
    quality = f"select entity, avg(case when v >= {LEAST} then 1.0 else 0.0 end) * 100 as {table.QUALITY[0]}, count(*) filter (where not coalesce(v >= {LEAST}, false)) as {table.QUALITY[1]}, count(*) as {table.QUALITY[2]} from grid where band = 'valid_pixel_count' group by 1"
    parts = [
        f"select entity, band || '_t' || lpad(step::varchar, 2, '0') as feature, v as value from (with {_GRID} select * from grid)",
        _part_sql(_own("temporal_stats"), {n: n for n in table.STATS}, plain), _part_sql(_own("seasonal_split"), table.SEASONS, plain), _part_sql(_own("interannual_diff"), table.YEARS, plain),
        _part_sql(_own("window_anchored"), table.PHASES, low), _part_sql(of("duration_streak", curves), {c: e for c, e in table.DURATION.items() if c != "green_span"}, si),
        _part_sql(of("green_span", curves), pick(table.DURATION, "green_span"), si), _part_sql(of("shape_stats", shaped), table.SHAPE, si),
        _part_sql(of("dynamics", curves), pick(table.DYNAMICS, "max_rise", "max_fall", "mean_abs_change", "smoothness", "roughness"), si),
        _part_sql(of("autocorr_lag1", curves), pick(table.DYNAMICS, "autocorr_lag1"), si), _part_sql(of("n_peaks", curves), pick(table.DYNAMICS, "n_peaks"), si),
        _part_sql(of("harmonics", curves), {c: e for c, e in table.HARMONICS.items() if c != "entropy"}, si), _part_sql(of("spectral_entropy", curves), pick(table.HARMONICS, "entropy"), si),
        _part_sql(of("phenology_curve", ", ".join(f"'{b}'" for b in table.CURVES)), table.PHENOLOGY, plain), _part_sql(radar, {n: n for n in table.RADAR_CURVE}, plain),
        _part_sql(f"select * from ({_own('autocorr_lag1')}) where band = 'VH'", {"autocorr_lag1": "vh_autocorr_lag1"}, "'sar_' || f"), _part_sql(_own("sar_structure"), {n: n for n in table.STRUCTURE[:-1]}, "'sar_' || f", "entity"),
        _part_sql(_own("cross_sensor"), table.CROSS, "'cross_' || f", "entity"), _part_sql(_own("pearson_cross"), {"r": "NDVI_VV_temporal_correlation"}, "f", "entity"),
        _part_sql(f"with {_GRID}, w as (select entity, step, max(v) filter (where band = 'NDVI') as NDVI, max(v) filter (where band = 'VV') as VV, max(v) filter (where band = 'VH') as VH from grid group by 1, 2), c as (select entity, {clipped} from w) select entity, {ratio} from c group by 1", {c: c for c in ratios}, "f", "entity"),
        _part_sql(f"with {_GRID} {quality}", {c: c for c in table.QUALITY}, "f", "entity"), f"select entity, 'area_ha' as feature, entity % 11 + 0.5 as value from (with {o.OBS} select distinct entity from obs)",
    ]
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(table.schema(t.STEPS)))
    return f"""select e.entity, position::int as position, s.feature, round(coalesce(value, 0), 6) + 0.0 as value from (with {o.OBS} select distinct entity from obs) e cross join (values {names}) as s(position, feature)
 left join ({' union all '.join(parts)}) p on p.entity = e.entity and p.feature = s.feature"""


#: Features to which the narrower queries give fewer digits.
_FOUR = "_peak_trough_ratio$|_harmonic[12]_phase$|^sar_cr_|^cross_vh_ndvi_ratio_"


def feature_rows(spark, d) -> DataFrame:
    return table.build(panel(spark, d), about(spark, d).select("entity", "area_ha"), t.STEPS, LEAST)


@q.query(_table_sql())
def feature_table_whole(spark, d):
    """Every numeric column of the schema for every entity. As in the narrower queries, smoothness is at most 1e6 and the
    phase of a wave without amplitude is 0, as rounding would decide both."""
    x = checkpointed(feature_rows(spark, d))
    flat = x.where(F.col("feature").rlike("^si_.*_harmonic[12]_amp$") & (F.col("value") <= 1e-6)).select("entity", F.regexp_replace("feature", "_amp$", "_phase").alias("feature"), F.lit(True).alias("flat"))
    x = x.join(flat, ["entity", "feature"], "left")
    value = F.when(F.col("flat"), 0.0).when(F.col("feature").endswith("_smoothness"), F.round(F.least("value", F.lit(1e6)), 3))
    value = value.when(F.col("feature").rlike(_FOUR), F.round("value", 4)).otherwise(F.round("value", 6))
    return x.select("entity", "position", "feature", (value + 0.0).alias("value"))


# ---- the tensor of cleaned channels

CHANNELS = [*table.BANDS[:10], "NDVI", "EVI", "NDWI", "LSWI", "NDRE", "GNDVI", "SAVI", "MSAVI", "NBR", "NDMI", "VV", "VH", "RVI", "RFDI", "CR", "optical_mask"]
_MASK = f"case when valid_pixel_count >= {LEAST} then 1.0 else 0.0 end"
_CHANNELS = ", ".join(f'"{c}"' for c in CHANNELS)
_TENSOR = (
    PANEL + ", made as (select *, " + ", ".join(f'{INDEX_SQL[n]} as "{n}"' for n in CHANNELS if n in INDEX_SQL) + f", {_MASK} as optical_mask from panel), grid as (select entity, band, step, v from (select entity, step, "
    + ", ".join(f'"{c}"::double as "{c}"' for c in CHANNELS) + f" from made) unpivot include nulls (v for band in ({_CHANNELS}))), "
    + o.fill("grid", "gapless") + ", filled as (select entity, band, step, coalesce(v, 0) as v from gapless), " + o.smooth("filled", "smoothed", t.STEPS - 1)
    + """, radar as (select entity, band, step, list_sort([coalesce(lag(v) over w, 0), v, coalesce(lead(v) over w, 0)])[2] as v from filled window w as (partition by entity, band order by step))"""
)


@q.query(f"""with {_TENSOR} select entity, step, band as channel, round(case when band in ('VV', 'VH') then r.v else s.v end, 6) + 0.0 as value, cast(coalesce(c_acctbal, 0) > 4500 as int) as label
 from smoothed s join radar r using (entity, band, step) left join customer on c_custkey = entity""")
def tensor_cleaned(spark, d):
    """Twenty-six cleaned channels of each entity, written with their labels, read again and unrolled."""
    w = panel(spark, d)
    made = w.select("*", *[indices.index(n).alias(n) for n in CHANNELS if n in indices.REGISTRY], (F.col(table.COUNT) >= LEAST).cast("double").alias("optical_mask"))
    long = made.unpivot(["entity", "step"], CHANNELS, "band", "v")
    cubes = features.cube(features.clean_channels(long, t.STEPS), CHANNELS)
    at = f"{shared_dir(spark)}/tensor-{uuid.uuid4().hex}"
    stages.write_tensor(cubes, about(spark, d).select("entity", "label"), at, CHANNELS, t.STEPS)
    read, channels, _ = stages.read_tensor(spark, at)
    rows = read.select("entity", "label", F.posexplode("cube").alias("step", "row")).select("entity", "label", "step", F.posexplode("row").alias("k", "value"))
    return rows.select("entity", "step", F.get(F.array(*map(F.lit, channels)), F.col("k")).alias("channel"), (F.round("value", 6) + 0.0).alias("value"), "label")


# ---- from the table to verdicts

#: Trees of the queries' models, fewer than the 300 of production, so that a whole run takes minutes.
TREES = 40
_NAMES = detector.chosen(table.schema(t.STEPS), season_invariant=True)
#: Columns that a table at hand lacks, though the model was trained with them.
_LACKING = _NAMES[::17]


def labelled(spark, d) -> tuple[DataFrame, list[str]]:
    """Vectors of the whole table (values) with their meta data, and the names of their elements."""
    of = table.vectors(feature_rows(spark, d)).withColumnRenamed("features", "values")
    names = table.schema(t.STEPS)
    usable = F.get("values", names.index(table.QUALITY[0])).alias("usable")
    return checkpointed(about(spark, d).join(of, "entity").select("*", usable)), names


def _at_hand(rows: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """As a table that comes from elsewhere: other order, some columns missing, one that is unknown."""
    given = [n for n in reversed(names) if n not in _LACKING]
    at = {n: i for i, n in enumerate(names)}
    places = F.from_json(F.lit(str([at[n] for n in given])), "array<int>")
    values = F.concat(F.transform(places, lambda i: F.get("values", i)), F.array(F.lit(float("nan"))))
    return rows.withColumn("values", values), [*given, "unknown"]


@q.query(f"""select entity, p.feature, case when p.feature in ({", ".join(f"'{n}'" for n in _LACKING)}) then 0.0 else value end as value
 from ({q.SQL["feature_table_whole"]}) p join (values {", ".join(f"('{n}')" for n in _NAMES)}) as s(feature) using (feature) where not regexp_matches(p.feature, '_smoothness$|_phase$|^sar_cr_|^cross_|_ratio')""")
def detect_alignment(spark, d):
    """What a saved plan's alignment makes of a table in another order and with columns missing, by name. Features that
    the whole table's query gives with fewer digits are left to it."""
    rows, names = labelled(spark, d)
    at = f"{shared_dir(spark)}/align-{uuid.uuid4().hex}"
    hand, given = _at_hand(rows, names)
    detector.PipelineModel([detector.Align(names=_NAMES, source=given)]).save(at)
    found = detector.PipelineModel.load(at).transform(hand)
    from pyspark.ml.functions import vector_to_array

    listed = F.from_json(F.lit(str(_NAMES).replace("'", '"')), "array<string>")
    x = found.select("entity", F.posexplode(vector_to_array("features")).alias("k", "value")).select("entity", F.get(listed, F.col("k")).alias("feature"), (F.round("value", 6) + 0.0).alias("value"))
    return x.where(~F.col("feature").rlike("_smoothness$|_phase$|^sar_cr_|^cross_|_ratio"))


@q.query()
def detect_from_table(spark, d):
    """Trained on the whole table, saved, loaded, applied to a table in another order: a verdict for each state."""
    rows, names = labelled(spark, d)
    plan = detector.train(rows, _NAMES, source=names, by=["state"], valid="usable", numTrees=TREES)
    at = f"{shared_dir(spark)}/plan-{uuid.uuid4().hex}"
    plan.save(at)
    loaded = detector.PipelineModel.load(at)
    hand, given = _at_hand(rows, names)
    loaded.stages[0].set(loaded.stages[0].source, given)
    return loaded.transform(hand)


def _folded(spark, d) -> tuple[DataFrame, list[str]]:
    from chronopanel.operators import ml

    rows, names = q._labelled(spark, d)
    folded = splits.balanced_block_folds(rows, spatial.block_id(F.col("lon"), F.col("lat")), "label", 3)
    return ml.assemble(folded, names).select("vec_id", "label", "fold", "features"), names


@q.query()
def stacked_scores(spark, d):
    """Scores of a logistic regression over the out-of-fold scores of a forest (TREES trees) and of boosted trees (10)."""
    from chronopanel.operators import ml

    rows, _ = _folded(spark, d)
    own = {"rf": {"numTrees": TREES, "maxDepth": 8}, "xgb": {"maxIter": 10, "maxDepth": 4}}
    return ml.stack(rows, ["rf", "xgb"], "vec_id", own=own).select("vec_id", "label", "fold", "rf", "xgb", "score")


@q.query()
def tuning_trials(spark, d):
    """Six trials of a forest's parameters, in ranges of at most 30 trees of depth 6, best first."""
    from chronopanel.operators import ml

    rows, _ = _folded(spark, d)
    ranges = {"numTrees": (10, 30, "step 10"), "maxDepth": (3, 6, "whole"), "minInstancesPerNode": (1, 10, "whole"), "featureSubsetStrategy": ["sqrt", "log2"]}
    found = ml.search(rows, "rf", ranges, trials=6, at_once=2)
    return spark.createDataFrame([(k, str(sorted(p.items())), f) for k, (p, f) in enumerate(found)], "place int, params string, macro_f1 double")


# ---- folds and draws


@q.query("select count(*) as n, count(distinct source) as n_groups, 0::bigint as n_split, true as balanced from documents join labels using (doc_id)")
def balanced_folds_audit(spark, d):
    """Of folds by source: rows, sources, sources in several folds, and whether no fold's rows or positives exceed the
    least by more than the largest source's."""
    s = checkpointed(splits.balanced_folds(t.scores(spark, d), "source", "y", 3))
    groups = s.groupBy("source").agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("n"), F.sum("y").alias("p"))
    folds = s.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).agg((F.max("n") - F.min("n")).alias("dn"), (F.max("p") - F.min("p")).alias("dp"))
    a = groups.agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.count_if(F.col("folds") > 1).alias("n_split"), F.max("n").alias("most_n"), F.max("p").alias("most_p"))
    return a.join(folds).select("n", "n_groups", "n_split", ((F.col("dn") <= F.col("most_n")) & (F.col("dp") <= F.col("most_p"))).alias("balanced"))


@q.query("""with r as (select doc_id, quality, row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) as k, count(*) filter (where quality = 1) over () as n1 from labels where quality in (0, 1))
 select doc_id, quality from r where quality = 1 or k <= floor(n1 * 0.5)""")
def ratio_draw(spark, d):
    return splits.balance_ratio(t.read(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.5)


# ---- audit of places


_BOX = (77.4, 77.9, 28.9, 29.5)
_AUDITED = f"""p as (select vec_id, cast(label >= 2 as int) as kind, label + 0.125 as area, vec_id % 7 <> 0 as valid, lon, lat, vec_id // 3 as file, cast(round_even((label + 0.125) * 100, 0) as bigint) as pixels,
 lon between {_BOX[0]} and {_BOX[1]} and lat between {_BOX[2]} and {_BOX[3]} as inside, cast(floor(lon * 10) as bigint) % 6 as district from points)"""


def _audited(spark, d) -> DataFrame:
    district = (F.floor(F.col("lon") * 10) % 6).alias("district")
    file = F.floor(F.col("vec_id") / 3).alias("file")
    return t.points(spark, d).select("vec_id", (F.col("label") >= 2).cast("int").alias("kind"), (F.col("label") + 0.125).cast("double").alias("area"), (F.col("vec_id") % 7 != 0).alias("valid"), "lon", "lat", file, district)


@q.query(f"""with {o.POINTS}, {_AUDITED} select kind, count(distinct file) as n_files, count(*) as n, count(*) filter (where not valid) as n_invalid, sum(pixels)::bigint as pixels, min(pixels) as pixels_min, max(pixels) as pixels_max,
 count(*) filter (where inside) as n_inside, count(*) filter (where not inside) as n_outside, {", ".join(f"round({f}({c}) filter (where inside), 6) + 0.0 as {c}_{f}" for c in ("lat", "lon") for f in ("min", "max"))},
 {", ".join(f"round(max({c}) filter (where inside) - min({c}) filter (where inside), 6) + 0.0 as {c}_span" for c in ("lat", "lon"))}, median(pixels)::double as pixels_median from p group by 1""")
def audit_places(spark, d):
    return q.rounded(selection.audit_places(_audited(spark, d), ["kind"], "area", "valid", "lon", "lat", _BOX, "file"), ["kind"])


@q.query(f"""with {o.POINTS}, {_AUDITED}, c as (select kind, district, count(*) as n from p group by 1, 2)
 select kind, district, n, cast(row_number() over w as int) as place, count(*) over (partition by kind) as n_values from c window w as (partition by kind order by n desc, district nulls last) qualify place <= 4""")
def top_districts(spark, d):
    return selection.most_frequent(_audited(spark, d), ["kind"], "district", 4)


@q.query(f"with {o.POINTS} select label, round(min(lon), 6) + 0.0 as x0, round(min(lat), 6) + 0.0 as y0, round(max(lon), 6) + 0.0 as x1, round(max(lat), 6) + 0.0 as y1, count(*) as n from points group by 1")
def table_extent(spark, d):
    return q.rounded(spatial.extent(t.points(spark, d), "lon", "lat", ["label"]), ["label", "n"])


@q.query(f"""with {o.POINTS} select vec_id, case label when 2 then 'crosses itself' when 3 then 'no area' when 4 then 'too few points' else 'valid' end as reason, case label when 2 then 2 when 3 then 0 when 4 then 0 else 1 end as n_rings,
 (case label when 2 then 2.0 when 3 then 0.0 when 4 then 0.0 else 4.0 end)::double as area from points""")
def ring_repair(spark, d):
    """Squares; those of one class are tied like a bow and become two triangles, others are flat or too short."""
    corner = lambda x, y: F.struct((F.col("lon") + x).cast("double").alias("x"), (F.col("lat") + y).cast("double").alias("y"))
    tied = F.when(F.col("label") == 2, 0.0).when(F.col("label") == 3, 0.01).otherwise(0.02)
    high = F.when(F.col("label") == 3, 0.0).otherwise(0.02)
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.lit(0.02), F.lit(0.0)), corner(tied, high), corner(F.lit(0.02) - tied, high), corner(F.lit(0.0), F.lit(0.0)))
    ring = F.when(F.col("label") == 4, F.slice(ring, 1, 2)).otherwise(ring)
    x = rings.repaired(t.points(spark, d).select("vec_id", ring.alias("ring")))
    area = F.aggregate(F.coalesce("rings", F.array().cast("array<array<struct<x:double,y:double>>>")), F.lit(0.0), lambda a, r: a + F.abs(scalars.ring_area(r)))
    return x.select("vec_id", "reason", F.coalesce(F.size(F.col("rings")), F.lit(0)).alias("n_rings"), (F.round(area * 10_000, 3) + 0.0).alias("area"))


@q.query("""select p_partkey, coalesce(month(cast(try_strptime(nullif(regexp_extract(name, '_([0-9]{4}_[0-9]{2}_[0-9]{2})$', 1), ''), '%Y_%m_%d') as date)) in (8, 9), false) as peak_months,
 coalesce(cast(nullif(regexp_extract(name, '_t([0-9]+)$', 1), '') as int) between 5 and 9, false) as middle_steps
 from (select p_partkey, """ + q._TAGS.format(s="varchar") + " as name from part)")
def tag_phases(spark, d):
    """Absolute tags by calendar month, relative ones by a range of steps."""
    x = t.read(spark, d, "part").select("p_partkey", F.expr(q._TAGS.format(s="string")).alias("name"))
    return x.select("p_partkey", scalars.tag_in_months(F.col("name"), (8, 9)).alias("peak_months"), scalars.tag_in_steps(F.col("name"), 5, 9).alias("middle_steps"))
