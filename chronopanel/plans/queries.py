"""The registered queries: each operator over the shared tables, with its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions import indices, scalars
from chronopanel.operators import composite, detect, features, metrics, scenes, selection, series, spatial, splits
from chronopanel.plans import oracle as o
from chronopanel.plans import tables as t
from chronopanel.session import checkpointed
from chronopanel.sources import kml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ["entity", "band"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """df with its doubles rounded, and without negative zeros."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys])


# ---- windows, composites, masks


@query("""select c_custkey, cast(row_number() over (partition by c_custkey order by w) - 1 as int) as window_idx, cast(w as date) as window_start, cast(w + interval 15 day as date) as window_end from (
 select c_custkey, unnest(generate_series(cast(s as timestamp), cast(e as timestamp) - interval 1 day, interval 15 day)) as w from (
 select c_custkey, cast(a - interval 5 month as date) as s, cast(a + interval 5 month as date) as e from (select c_custkey, date '2024-01-01' + cast(c_custkey % 365 as int) as a from customer)))""")
def time_grid(spark, d):
    anchor = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int"))
    start, end = scalars.anchor_window(anchor)
    c = t.read(spark, d, "customer").select("c_custkey", start.alias("s"), end.alias("e"))
    return composite.time_grid(c, "s", "e").select("c_custkey", "window_idx", "window_start", "window_end")


@query(f"with {o.OBS} select entity, band, step, round(v, 6) + 0.0 as v, n from obs")
def median_composite(spark, d):
    return rounded(t.observed(spark, d), ["entity", "band", "step"])


@query(f"with {o.GRID} select entity, band, step, case when n >= 2 then round(v, 6) + 0.0 end as v from grid")
def valid_count_mask(spark, d):
    g = t.grid(spark, d).withColumn("v", composite.mask_few(least=2))
    return rounded(g.select("entity", "band", "step", "v"), ["entity", "band", "step"])


@query(f"with {o.GRID} select entity, round(avg(case when n >= 2 then 1.0 else 0.0 end) * 100, 6) + 0.0 as pct_valid, count(*) filter (where n < 2) as n_cloudy, count(*) as n_total from grid where band = 'view' group by 1")
def quality_summary(spark, d):
    return rounded(composite.quality_summary(t.grid(spark, d).where("band = 'view'"), 2), ["entity"])


@query("select l_suppkey, round(1 - avg(case when l_linenumber in (4, 5, 6, 7) then 1.0 else 0.0 end), 6) + 0.0 as gap_fraction from lineitem group by 1")
def cloud_gap_fraction(spark, d):
    return rounded(composite.gap_fraction(t.read(spark, d, "lineitem"), "l_suppkey", F.col("l_linenumber").isin(4, 5, 6, 7)), ["l_suppkey"])


@query("""select l_orderkey, l_linenumber, l_extendedprice / 10000 as value from lineitem where l_linenumber in (4, 5, 6, 7) and l_quantity < 30 and (l_partkey >> 3) & 1 = 0 and (l_partkey >> 5) & 1 = 0""")
def bit_mask_filter(spark, d):
    x = t.read(spark, d, "lineitem").where(composite.pixel_mask(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_partkey"), bits=(3, 5)))
    return x.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10000).alias("value"))


# ---- indices

_R = {k: v for k, v in t.ROLES.items()}
_OPT = f"with {o.FILLED}, {o.WIDE} select entity, step, "
_NDVI = "(view - click) / nullif(view + click + 1e-8, 0)"


@query(_OPT + ", ".join(f"round({e}, 6) + 0.0 as {n}" for n, e in {
    "NDVI": _NDVI,
    # rounding decides the value where the divisor is close to zero: null there, on both sides
    "EVI": "case when abs(view + 6 * click - 7.5 * purchase + 1) > 0.01 then 2.5 * (view - click) / nullif(view + 6 * click - 7.5 * purchase + 1 + 1e-8, 0) end",
    "NDWI": "(signup - view) / nullif(signup + view + 1e-8, 0)",
    "LSWI": "(view - error) / nullif(view + error + 1e-8, 0)",
    "SAVI": "(view - click) / nullif(view + click + 0.5 + 1e-8, 0) * 1.5",
    "MSAVI": "(2 * view + 1 - sqrt(case when (2 * view + 1) ** 2 - 8 * (view - click) < 0 then 0 else (2 * view + 1) ** 2 - 8 * (view - click) end)) / 2",
    "NBR": "(view - purchase) / nullif(view + purchase + 1e-8, 0)",
    "GNDVI": "(view - signup) / nullif(view + signup + 1e-8, 0)",
    "GRVI": "(signup - click) / nullif(signup + click + 1e-10, 0)",
}.items()) + " from wide")
def spectral_indices_optical(spark, d):
    w = t.wide(t.filled(spark, d))
    b = _R | {"B12": "purchase"}
    stable = F.abs(F.col("view") + 6 * F.col("click") - 7.5 * F.col("purchase") + 1) > 0.01
    names = ("NDVI", "EVI", "NDWI", "LSWI", "SAVI", "MSAVI", "NBR", "GNDVI", "GRVI")
    made = {n: indices.index(n, **b) for n in names}
    made["EVI"] = F.when(stable, made["EVI"])
    return rounded(w.select("entity", "step", *[c.alias(n) for n, c in made.items()]), ["entity", "step"])


_NDRE = "(view - click) / nullif(view + click + 1e-8, 0)"


@query(_OPT + ", ".join(f"round({e}, 4) + 0.0 as {n}" for n, e in {
    "NDRE": _NDRE,
    "NDMI": "(view - error) / nullif(view + error + 1e-8, 0)",
    "CIre": "purchase / nullif(click + 1e-10, 0) - 1",
    "IRECI": "(purchase - error) / nullif(click / nullif(signup + 1e-10, 0) + 1e-10, 0)",
    "CCCI": f"({_NDRE}) / nullif((view + 1 - error) / nullif(view + 1 + error + 1e-8, 0) + 1e-10, 0)",
    "PSRI": "(error - signup) / nullif(purchase + 1e-10, 0)",
}.items()) + " from wide")
def spectral_indices_rededge(spark, d):
    w = t.wide(t.filled(spark, d)).withColumn("view1", F.col("view") + 1)
    b = {"B8A": "view", "B5": "click", "B11": "error", "B7": "purchase", "B6": "signup", "B4": "error", "B2": "signup", "B8": "view1"}
    return rounded(w.select("entity", "step", *[indices.index(n, **b).alias(n) for n in ("NDRE", "NDMI", "CIre", "IRECI", "CCCI", "PSRI")]), ["entity", "step"], 4)


@query(_OPT + ", ".join(f"round({e}, 6) + 0.0 as {n}" for n, e in {
    "NRPB": "(error - signup) / nullif(error + signup + 1e-10, 0)",
    "RVI": "4 * error / nullif(signup + error + 1e-8, 0)",
    "RFDI": "(signup - error) / nullif(signup + error + 1e-8, 0)",
    "CR": "error / nullif(signup + 1e-8, 0)",
}.items()) + " from wide")
def sar_indices(spark, d):
    w = t.wide(t.filled(spark, d))
    return rounded(w.select("entity", "step", *[indices.index(n, VV="signup", VH="error").alias(n) for n in ("NRPB", "RVI", "RFDI", "CR")]), ["entity", "step"])


@query(f"""with {o.FILLED}, {o.WIDE}, db as (select entity, step, case when step % 2 = 0 then signup - 1.2 else signup end as vv, error as vh from wide),
 part as (select step, avg(case when vv < 0 then 1.0 else 0.0 end) filter (where vv is not null) as share from db group by 1)
 select entity, step, round(case when share > 0.75 then 10 ** (vv / 10) else vv end, 6) + 0.0 as vv, round(case when share > 0.75 then 10 ** (vh / 10) else vh end, 6) + 0.0 as vh from db join part using (step)""")
def db_autodetect(spark, d):
    w = t.wide(t.filled(spark, d))
    x = w.select("entity", "step", F.when(F.col("step") % 2 == 0, F.col("signup") - 1.2).otherwise(F.col("signup")).alias("vv"), F.col("error").alias("vh"))
    return rounded(composite.linear_if_db(x, "vv", ("vv", "vh")).select("entity", "step", "vv", "vh"), ["entity", "step"])


@query(f"""with {o.FILLED}, {o.WIDE}, r as (select entity, case when signup is null or ndvi is null then null else greatest(least(signup / (ndvi + 1e-8), 50), -50) end as r from (select *, {_NDVI} as ndvi from wide))
 select entity, round(avg(r), 4) + 0.0 as mean, round(stddev_pop(r), 4) + 0.0 as std, round(quantile_cont(r, 0.5), 4) + 0.0 as p50 from r group by 1""")
def sar_optical_ratio(spark, d):
    w = t.wide(t.filled(spark, d)).withColumn("ndvi", indices.index("NDVI", **_R))
    r = w.select("entity", indices.clipped_ratio(F.col("signup"), F.col("ndvi")).alias("r"))
    return rounded(r.groupBy("entity").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.percentile("r", F.lit(0.5)).alias("p50")), ["entity"], 4)


# ---- series


@query(f"with {o.FILLED} select entity, band, step, round(v, 6) + 0.0 as v from filled")
def gapfill_linear(spark, d):
    return rounded(t.filled(spark, d).select("entity", "band", "step", "v"), ["entity", "band", "step"])


@query(f"with {o.SMOOTHED} select entity, band, step, round(v, 6) + 0.0 as v from smoothed")
def savgol_smooth(spark, d):
    return rounded(series.smooth(t.filled(spark, d)).select("entity", "band", "step", "v"), ["entity", "band", "step"])


@query(f"""with {o.FILLED} select entity, band, step, case when v is null then null else round(list_sort([coalesce(lag(v) over w, 0), v, coalesce(lead(v) over w, 0)])[2], 6) + 0.0 end as v
 from filled window w as (partition by entity, band order by step)""")
def median_filter3(spark, d):
    return rounded(series.median3(t.filled(spark, d)).select("entity", "band", "step", "v"), ["entity", "band", "step"])


@query(f"with {o.FILLED} select entity, band, step, round(v - lag(v) over w, 6) + 0.0 as d1, round(lead(v) over w - 2 * v + lag(v) over w, 6) + 0.0 as d2 from filled window w as (partition by entity, band order by step)")
def first_second_diff(spark, d):
    return rounded(series.differences(t.filled(spark, d)).select("entity", "band", "step", "d1", "d2"), ["entity", "band", "step"])


@query(f"with {o.OBS} select entity, band, step, row_number() over (partition by entity, band order by step) - 1 as rel from obs".replace("row_number() over (partition by entity, band order by step) - 1", "cast(dense_rank() over (partition by entity order by step) - 1 as int)"))
def relative_step_rename(spark, d):
    x = composite.step_of_dates(t.observed(spark, d).withColumnRenamed("step", "date"), "entity", "date")
    return x.select("entity", "band", F.col("date").alias("step"), F.col("step").alias("rel"))


# ---- features


def _steady(df: DataFrame) -> DataFrame:
    """Smoothness is at most 1e6: for curves that are straight but for rounding, rounding would decide it."""
    return df.withColumn("smoothness", F.round(F.least(F.col("smoothness"), F.lit(1e6)), 3))


def _phases(df: DataFrame) -> DataFrame:
    return df.withColumns({f"phase{k}": F.when(F.col(f"amp{k}") > 1e-6, F.round(f"phase{k}", 4)) for k in (1, 2)})


_STATS = "min max mean median p10 p25 p75 p90 std range cv"
_CV = "case when abs(avg(v)) > 1e-8 then stddev_pop(v) / (abs(avg(v)) + 1e-8) when avg(v) is not null then 0.0 end"


@query(f"""with {o.GRID} select entity, band, {o.rounded(_STATS)} from (select entity, band, min(v) as min, max(v) as max, avg(v) as mean, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.25) as p25,
 quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.9) as p90, stddev_pop(v) as std, max(v) - min(v) as range, {_CV} as cv from grid group by 1, 2)""")
def temporal_stats(spark, d):
    return rounded(features.temporal_stats(t.grid(spark, d)), KEYS)


@query(f"""with {o.MONTHS}, s as (select entity, band, avg(v) filter (where month(month_start) in (6,7,8,9)) as wet_mean, stddev_pop(v) filter (where month(month_start) in (6,7,8,9)) as wet_std,
 avg(v) filter (where month(month_start) not in (6,7,8,9)) as dry_mean, stddev_pop(v) filter (where month(month_start) not in (6,7,8,9)) as dry_std from months group by 1, 2)
 select entity, band, {o.rounded("wet_mean wet_std dry_mean dry_std")}, round(dry_mean - wet_mean, 6) + 0.0 as contrast from s""")
def seasonal_split(spark, d):
    return rounded(features.seasonal(t.months(spark, d), F.month("month_start")), KEYS)


@query(f"""with {o.MONTHS}, y as (select entity, band, year(month_start) as y, avg(v) as m, row_number() over (partition by entity, band order by year(month_start)) as k from months group by 1, 2, 3),
 p as (select entity, band, max(m) filter (where k = 1) as a, max(m) filter (where k = 2) as b from y where k <= 2 group by 1, 2 having count(*) = 2)
 select entity, band, round(b - a, 6) + 0.0 as year_diff, round(exp(-abs(b - a)), 6) + 0.0 as stability from p""")
def interannual_diff(spark, d):
    return rounded(features.interannual(t.months(spark, d), F.year("month_start")), KEYS)


_PH = f"""with {o.SMOOTHED}, a as (select *, max(v) over s as peak, v - lag(v) over w as d1, lead(v) over w - 2 * v + lag(v) over w as d2, coalesce(v > 0.3, false) as up,
 last_value(case when v > 0.3 then step end ignore nulls) over (partition by entity, band order by step rows between unbounded preceding and 1 preceding) as before
 from smoothed window s as (partition by entity, band), w as (partition by entity, band order by step)),
 b as (select *, coalesce(min(case when v >= peak - 1e-9 * abs(peak) then step end) over (partition by entity, band), 0) as i from a),
 f as (select entity, band, coalesce(sum(v), 0) - (coalesce(max(v) filter (where step = 0), 0) + coalesce(max(v) filter (where step = 14), 0)) / 2 as auc, max(peak) as peak_value, max(i) as peak_idx,
 coalesce(min(step) filter (where step <= i and v >= 0.5 * peak), max(i)) as greenup_half, max(d1) as max_rise, min(d1) as max_fall, count(*) filter (where up) as season_length,
 count(*) filter (where up and (before is null or step - before >= 3)) as n_seasons, max(v) - quantile_cont(v, 0.1) as amplitude, stddev_pop(d2) as sd2 from b group by 1, 2)"""


@query(_PH + f""" select entity, band, {o.rounded("auc peak_value")}, peak_idx, greenup_half, {o.rounded("max_rise max_fall")}, season_length, n_seasons, {o.rounded("amplitude")},
 round(case when season_length > 0 then (peak_idx - greenup_half) / (season_length + 1e-8) else 0.0 end, 6) + 0.0 as asymmetry, case when sd2 is not null then round(least(1 / (sd2 + 1e-8), 1e6), 3) + 0.0 end as smoothness from f""")
def phenology_curve(spark, d):
    return rounded(_steady(features.phenology(series.smooth(t.filled(spark, d)))), KEYS)


@query(_PH + " select entity, band, season_length, n_seasons from f")
def growing_seasons(spark, d):
    return features.phenology(series.smooth(t.filled(spark, d))).select("entity", "band", "season_length", "n_seasons")


@query(f"""with {o.FILLED} select entity, band, round(coalesce(sum(v), 0) - (coalesce(max(v) filter (where step = 0), 0) + coalesce(max(v) filter (where step = 14), 0)) / 2, 6) + 0.0 as sar_auc, round(max(v), 6) + 0.0 as sar_peak_value,
 count(*) filter (where v > 0.1) as sar_season_length, round(stddev_pop(v), 6) + 0.0 as sar_std from filled where band in ('error', 'signup') group by 1, 2""")
def sar_phenology(spark, d):
    p = features.phenology(t.filled(spark, d).where(F.col("band").isin("error", "signup")), 0.1)
    s = features.temporal_stats(t.filled(spark, d).where(F.col("band").isin("error", "signup"))).select("entity", "band", "std")
    x = p.join(s, KEYS)
    return rounded(x.select("entity", "band", F.col("auc").alias("sar_auc"), F.col("peak_value").alias("sar_peak_value"), F.col("season_length").alias("sar_season_length"), F.col("std").alias("sar_std")), KEYS)


def _corr_sql(x: str, y: str, source: str, least: int, missing: str, name: str = "r") -> str:
    both = f"filter (where {x} is not null and {y} is not null)"
    return f"""select entity, round(case when count(*) {both} >= {least} and stddev_pop({x}) {both} >= 1e-8 and stddev_pop({y}) {both} >= 1e-8
 then (avg({x} * {y}) {both} - avg({x}) {both} * avg({y}) {both}) / (stddev_pop({x}) {both} * stddev_pop({y}) {both}) else {missing} end, 6) + 0.0 as {name} from {source} group by 1"""


@query(f"with {o.FILLED}, {o.WIDE} " + _corr_sql("view", "signup", "wide", 4, "null"))
def pearson_cross(spark, d):
    return rounded(features.correlation(t.wide(t.filled(spark, d)), "view", "signup", ["entity"]), ["entity"])


@query(f"""with {o.GRID}, a as (select entity, band, avg(v) filter (where step between 0 and 2) as early, avg(v) filter (where step between 5 and 9) as peak, avg(v) filter (where step between 12 and 14) as late from grid group by 1, 2)
 select entity, band, {o.rounded("early peak late")}, round(peak - early, 6) + 0.0 as amp, round((peak - early) / 3, 6) + 0.0 as rise, round((peak - late) / 4, 6) + 0.0 as fall from a""")
def window_anchored(spark, d):
    return rounded(features.window_anchored(t.grid(spark, d), t.STEPS), KEYS)


_TAGS = ("04", "05", "06", "07")


@query(f"with {o.FILLED}, " + ", ".join(f"""i{x} as (select entity, band, max(k) as streak from (select entity, band, count(*) as k from (select *, step - row_number() over (partition by entity, band order by step) as g from filled where v > 0.{x[1]}) group by entity, band, g) group by 1, 2)""" for x in _TAGS)
    + " select entity, band, " + ", ".join(f"count(*) filter (where v > 0.{x[1]}) as above_{x}, round(count(*) filter (where v > 0.{x[1]}) / count(*), 6) + 0.0 as frac_{x}, coalesce(max(i{x}.streak), 0) as streak_{x}" for x in _TAGS)
    + " from filled " + " ".join(f"left join i{x} using (entity, band)" for x in _TAGS) + " group by 1, 2")
def duration_streak(spark, d):
    return rounded(features.duration(t.filled(spark, d)).drop("green_span"), KEYS)


@query(f"with {o.FILLED} select entity, band, coalesce(cast(max(step) filter (where v > 0.5) as bigint), 0) - coalesce(cast(min(step) filter (where v > 0.5) as bigint), 15) as green_span from filled group by 1, 2")
def green_span(spark, d):
    return features.duration(t.filled(spark, d)).select("entity", "band", "green_span")


_SHAPE = "mean max min std range p10 p25 p50 p75 p90 iqr cv skewness kurtosis auc amplitude peak_trough"


@query(f"""with {o.FILLED}, c as (select *, v - avg(v) over (partition by entity, band) as x from filled), m as (select entity, band, avg(v) as mean, max(v) as max, min(v) as min, stddev_pop(v) as std, quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.25) as p25,
 quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.9) as p90, count(v) as n, avg(x ** 2) as m2, avg(x ** 3) as m3, avg(x ** 4) as m4, {_CV.replace("when avg(v) is not null then 0.0", "else 0.0")} as cv,
 sum(coalesce(v, 0)) - (coalesce(max(v) filter (where step = 0), 0) + coalesce(max(v) filter (where step = 14), 0)) / 2 as auc from c group by 1, 2)
 select entity, band, {o.rounded("mean max min std")}, round(max - min, 6) + 0.0 as range, {o.rounded("p10 p25 p50 p75 p90")}, round(p75 - p25, 6) + 0.0 as iqr, {o.rounded("cv")},
 round(case when n > 3 and m2 > 0 then m3 / m2 ** 1.5 else 0.0 end, 6) + 0.0 as skewness, round(case when n > 3 and m2 > 0 then m4 / (m2 * m2) - 3 else 0.0 end, 6) + 0.0 as kurtosis, {o.rounded("auc")},
 round(max - p10, 6) + 0.0 as amplitude, round(case when abs(p10) > 1e-8 then p90 / (abs(p10) + 1e-8) else 0.0 end, 4) + 0.0 as peak_trough from m""")
def shape_stats(spark, d):
    s = features.shape(t.filled(spark, d))
    return rounded(s.withColumn("peak_trough", F.round("peak_trough", 4)), KEYS)


_DYN = f"""with {o.FILLED}, a as (select *, v - lag(v) over w as d1, lead(v) over w - 2 * v + lag(v) over w as d2, avg(v) over s as m, lead(v) over w as nx, lag(v) over w as pr from filled
 window w as (partition by entity, band order by step), s as (partition by entity, band)),
 g as (select entity, band, max(d1) as max_rise, min(d1) as max_fall, avg(abs(d1)) as mean_abs_change, stddev_pop(d1) as roughness, stddev_pop(d2) as sd2, sum((v - m) * (nx - m)) as cov, avg((v - m) * (v - m)) as var, count(v) as n, count(*) filter (where v > m and pr <= m) as rises from a group by 1, 2),
 dyn as (select entity, band, max_rise, max_fall, mean_abs_change, roughness, sd2, case when n > 4 and var > 1e-8 then cov / ((n - 1) * var) else 0.0 end as autocorr_lag1, case when n > 4 then rises else 0 end as n_peaks from g)"""


@query(_DYN + f" select entity, band, {o.rounded('max_rise max_fall mean_abs_change roughness')}, case when sd2 is not null then round(least(1 / (sd2 + 1e-8), 1e6), 3) + 0.0 end as smoothness from dyn")
def dynamics(spark, d):
    return rounded(_steady(features.dynamics(t.filled(spark, d)).drop("autocorr_lag1", "n_peaks")), KEYS)


@query(_DYN + " select entity, band, round(autocorr_lag1, 6) + 0.0 as autocorr_lag1 from dyn")
def autocorr_lag1(spark, d):
    return rounded(features.dynamics(t.filled(spark, d)).select("entity", "band", "autocorr_lag1"), KEYS)


@query(_DYN + " select entity, band, n_peaks from dyn")
def n_peaks(spark, d):
    return features.dynamics(t.filled(spark, d)).select("entity", "band", F.col("n_peaks").cast("bigint").alias("n_peaks"))


_DFT = f"""with {o.FILLED}, x as (select entity, band, step, v - avg(v) over (partition by entity, band) as x from filled), f as (select entity, band, k, sum(x * cos(2 * pi() * k * step / 15)) as re, -sum(x * sin(2 * pi() * k * step / 15)) as im
 from x cross join (select unnest(range(1, 8)) as k) group by 1, 2, 3), e as (select *, sqrt(re * re + im * im) / 15 as amp, (re * re + im * im) / 225 as e from f),
 p as (select *, e / (sum(e) over (partition by entity, band) + 1e-8) as p from e),
 h as (select entity, band, max(amp) filter (where k = 1) as amp1, max(amp) filter (where k = 2) as amp2, max(amp) filter (where k = 3) as amp3, max(atan2(im, re)) filter (where k = 1) as phase1, max(atan2(im, re)) filter (where k = 2) as phase2,
 max(p) filter (where k = 1) as dominance, -sum(p * ln(p + 1e-8)) as entropy from p group by 1, 2)"""


@query(_DFT + f" select entity, band, {o.rounded('amp1 amp2 amp3')}, case when amp1 > 1e-6 then round(phase1, 4) + 0.0 end as phase1, case when amp2 > 1e-6 then round(phase2, 4) + 0.0 end as phase2, {o.rounded('dominance')} from h")
def harmonics(spark, d):
    return rounded(_phases(features.harmonics(t.filled(spark, d), t.STEPS)).drop("entropy"), KEYS)


@query(_DFT + " select entity, band, round(entropy, 6) + 0.0 as entropy from h")
def spectral_entropy(spark, d):
    return rounded(features.harmonics(t.filled(spark, d), t.STEPS).select("entity", "band", "entropy"), KEYS)


@query(f"""with {o.FILLED}, {o.WIDE}, s as (select entity, error / nullif(signup + 1e-8, 0) as cr, 4 * error / nullif(signup + error + 1e-8, 0) as rvi, error as vh, signup as vv from wide)
 select entity, round(avg(cr), 4) + 0.0 as cr_mean, round(stddev_pop(cr), 4) + 0.0 as cr_std, round(max(cr), 4) + 0.0 as cr_max, round(avg(rvi), 6) + 0.0 as rvi_mean, round(stddev_pop(rvi), 6) + 0.0 as rvi_std, round(max(rvi), 6) + 0.0 as rvi_max,
 round(quantile_cont(rvi, 0.75), 6) + 0.0 as rvi_p75, round(avg(vh), 6) + 0.0 as vh_mean, round(stddev_pop(vh), 6) + 0.0 as vh_std, round(case when abs(avg(vh)) > 1e-8 then stddev_pop(vh) / (abs(avg(vh)) + 1e-8) else 0.0 end, 6) + 0.0 as vh_cv,
 round(avg(vv), 6) + 0.0 as vv_mean, round(stddev_pop(vv), 6) + 0.0 as vv_std, count(*) filter (where rvi > 0.7) as rvi_days_above_07 from s group by 1""")
def sar_structure(spark, d):
    return rounded(_radar(t.wide(t.filled(spark, d))), ["entity"])


def _radar(w: DataFrame) -> DataFrame:
    return features.radar_structure(w, "signup", "error").withColumns({c: F.round(c, 4) for c in ("cr_mean", "cr_std", "cr_max")})


@query(f"""with {o.FILLED}, {o.WIDE}, a as ({_corr_sql("view", "error", "wide", 5, "0.0", "corr_vh")}), b as ({_corr_sql("view", "signup", "wide", 5, "0.0", "corr_vv")}),
 c as (select entity, round(avg(error / (view + 1e-8)), 4) + 0.0 as ratio_mean, round(stddev_pop(error / (view + 1e-8)), 4) + 0.0 as ratio_std from wide group by 1) select * from a join b using (entity) join c using (entity)""")
def cross_sensor(spark, d):
    return rounded(_cross(t.wide(t.filled(spark, d))), ["entity"])


def _cross(w: DataFrame) -> DataFrame:
    return features.cross_sensor(w, "view", "signup", "error").withColumns({c: F.round(c, 4) for c in ("ratio_mean", "ratio_std")})


@query(f"with {o.OBS} select entity, band, round(coalesce(avg(v), 0), 6) + 0.0 as mean, round(coalesce(stddev_pop(v), 0), 6) + 0.0 as std, round(coalesce(max(v), 0), 6) + 0.0 as max, round(coalesce(min(v), 0), 6) + 0.0 as min from obs group by 1, 2")
def tensor_aggregate(spark, d):
    return rounded(features.tensor_aggregate(t.observed(spark, d)), KEYS)


# ---- reshaping and selection


@query("""select l_returnflag, round(sum(l_quantity) filter (where l_linestatus = 'F'), 2) as "F", round(sum(l_quantity) filter (where l_linestatus = 'O'), 2) as "O" from lineitem group by 1""")
def pivot_wide(spark, d):
    p = t.read(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("""select l_orderkey, l_linenumber, band, round(value, 6) as value from (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) unpivot include nulls (value for band in (l_quantity, l_discount, l_tax))""")
def unpivot_long(spark, d):
    x = t.read(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "band", "value")
    return x.withColumn("value", F.round("value", 6))


_LONG = f"""with {o.GRID}, s as (select entity, band, min(v) as min, max(v) as max, avg(v) as mean, stddev_pop(v) as std from grid group by 1, 2), long as (select entity, 'ts_' || band || '_' || f as feature, value from
 (select entity, band, min, max, mean, std from s) unpivot include nulls (value for f in (min, max, mean, std)))"""


@query(_LONG + " select entity, feature, round(value, 6) + 0.0 as value from long where starts_with(feature, 'ts_view') or feature like '%mean'")
def feature_select_prefix(spark, d):
    x = features.to_long(features.temporal_stats(t.grid(spark, d)).select("entity", "band", "min", "max", "mean", "std"), "ts")
    return rounded(x.where(F.startswith("feature", F.lit("ts_view")) | F.endswith("feature", F.lit("mean"))), ["entity", "feature"])


@query("""select c_name, c_mktsegment, (c_mktsegment in ('label', 'plot_id', 'BUILDING') or list_has_any(string_split(c_name, '_'), ['label', 'plot_id']) or len(list_filter(string_split(c_mktsegment, '_'), lambda x: x in ('label', 'plot_id', 'BUILDING'))) > 0) as leak from customer""")
def leakage_audit(spark, d):
    return splits.leaks(t.read(spark, d, "customer").select("c_name", "c_mktsegment"), "c_mktsegment", ["label", "plot_id", "BUILDING"])


@query(f"with {o.OBS} select entity, round(coalesce(max(v) filter (where band = 'view'), 0), 6) + 0.0 as view, 0.0::double as absent, round(coalesce(max(v) filter (where band = 'click'), 0), 6) + 0.0 as click from obs group by 1")
def feature_align(spark, d):
    w = t.observed(spark, d).groupBy("entity").pivot("band", t.EVENT_BANDS).agg(F.max("v"))
    return rounded(splits.align(w, ["view", "absent", "click"]), ["entity"])


@query("select o_custkey, o_orderstatus, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice desc, o_orderkey) = 1")
def largest_per_group(spark, d):
    x = t.read(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return splits.largest_per_group(x, ["o_custkey", "o_orderstatus"], "o_totalprice", "o_orderkey")


@query("select lang, round(avg(quality), 6) + 0.0 as share, count(*) as n, avg(quality) between 0.4 and 0.6 as balanced from documents join labels using (doc_id) group by 1")
def class_balance(spark, d):
    s = t.scores(spark, d).groupBy("lang").agg(F.avg("y").alias("share"), F.count("*").alias("n"))
    return rounded(s.withColumn("balanced", F.col("share").between(0.4, 0.6)), ["lang"])


@query("select s_suppkey, cast((row_number() over (order by s_suppkey) - 1) % 4 as int) as window from supplier".replace(" as window", ' as "window"'))
def round_robin_window(spark, d):
    return splits.round_robin(t.read(spark, d, "supplier").select("s_suppkey"), 4, "s_suppkey")


@query("""select c_custkey, case when c_nationkey % 2 = 1 then 'pos' else 'neg' end || '_' || lpad(cast(row_number() over (partition by c_nationkey % 2 order by c_custkey) - 1 as varchar), 4, '0') as plot_id from customer""")
def sequential_ids(spark, d):
    x = t.read(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 2).alias("label"))
    return splits.sequential_ids(x, "label", "c_custkey").select("c_custkey", "plot_id")


# ---- dates and labels

_NAME = """case c_custkey % 8 when 0 then c_custkey || '_' || (1 + c_custkey % 28) || 'aug2023.kml' when 1 then c_custkey || '_sept2024.kml' when 2 then 'survey_2023-' || lpad(cast(1 + c_custkey % 12 as varchar), 2, '0') || '-15.kml'
 when 3 then 'x_' || lpad(cast(1 + c_custkey % 31 as varchar), 2, '0') || '-02-2023.kml' when 4 then '202308' || lpad(cast(1 + c_custkey % 31 as varchar), 2, '0') || '_field.kml' when 5 then 'f31feb2024.kml' when 6 then 'plot_' || c_custkey || '.kml' else 'a_2023_13_03.kml' end"""
_MON = "map {" + ", ".join(f"'{n}': {i}" for n, i in ({n: i + 1 for i, n in enumerate(scalars.MONTHS)} | {n: i + 1 for i, n in enumerate(scalars.LONG_MONTHS)} | {"sept": 9}).items()) + "}"


def _date_sql(y: str, m: str, d: str) -> str:
    return f"case when try_cast({y} as int) between 2000 and 2100 then try_cast({y} || '-' || lpad(cast(try_cast({m} as int) as varchar), 2, '0') || '-' || lpad(cast(try_cast({d} as int) as varchar), 2, '0') as date) end"


def _g(p: str, k: int) -> str:
    return f"nullif(regexp_extract(stem, '{p}', {k}), '')"


_P = (r"(\d{1,2})([a-z]{3,9})(\d{4})", r"([a-z]{3,9})(\d{4})", r"(\d{4})[-_](\d{2})[-_](\d{2})", r"(\d{2})[/\-](\d{2})[/\-](\d{4})", r"(\d{8})")
_DATES = ", ".join([
    _date_sql(_g(_P[0], 3), f"cast({_MON}[{_g(_P[0], 2)}] as varchar)", _g(_P[0], 1)),
    _date_sql(_g(_P[1], 2), f"cast({_MON}[{_g(_P[1], 1)}] as varchar)", "'1'"),
    _date_sql(_g(_P[2], 1), _g(_P[2], 2), _g(_P[2], 3)),
    _date_sql(_g(_P[3], 3), _g(_P[3], 2), _g(_P[3], 1)),
    _date_sql(f"substr({_g(_P[4], 1)}, 1, 4)", f"substr({_g(_P[4], 1)}, 5, 2)", f"substr({_g(_P[4], 1)}, 7, 2)"),
])


@query(f"select c_custkey, name, coalesce({_DATES}) as anchor from (select c_custkey, name, lower(regexp_replace(name, '\\.[^.]*$', '')) as stem from (select c_custkey, {_NAME} as name from customer))")
def filename_date(spark, d):
    k = F.col("c_custkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    forms = [F.concat(k, F.lit("_"), 1 + k % 28, F.lit("aug2023.kml")), F.concat(k, F.lit("_sept2024.kml")), F.concat(F.lit("survey_2023-"), two(1 + k % 12), F.lit("-15.kml")), F.concat(F.lit("x_"), two(1 + k % 31), F.lit("-02-2023.kml")), F.concat(F.lit("202308"), two(1 + k % 31), F.lit("_field.kml")), F.lit("f31feb2024.kml"), F.concat(F.lit("plot_"), k, F.lit(".kml")), F.lit("a_2023_13_03.kml")]
    name = F.when(k % 8 == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        name = name.when(k % 8 == i, f)
    x = t.read(spark, d, "customer").select("c_custkey", name.alias("name"))
    return x.withColumn("anchor", scalars.filename_date(F.col("name")))


@query("select o_orderkey, cast(cast(o_orderdate as date) - interval 5 month as date) as date_start, cast(cast(o_orderdate as date) + interval 5 month as date) as date_end from orders")
def anchor_window(spark, d):
    start, end = scalars.anchor_window(F.col("o_orderdate").cast("date"))
    return t.read(spark, d, "orders").select("o_orderkey", start.alias("date_start"), end.alias("date_end"))


@query("select p_partkey, cast(case when m = 0 then 12 else m end as int) as month from (select p_partkey, (cast(round_even(9 + (p_partkey % 21 - 10) * 0.5::double, 0) as int) % 12 + 12) % 12 as m from part)")
def synthetic_month(spark, d):
    return t.read(spark, d, "part").select("p_partkey", scalars.synthetic_month((F.col("p_partkey") % 21).cast("int"), 21).alias("month"))


_WORD = "case p_partkey % 23 " + " ".join(f"when {k} then '{w.capitalize()}_' || p_partkey" for k, (w, _) in enumerate(scalars.CLASS_WORDS)) + " when 21 then p_partkey || '' else 'corn by the river' end"


@query("select p_partkey, case " + " ".join(f"when contains(f, '{w}') then '{c}'" for w, c in scalars.CLASS_WORDS) + f" else 'unlabeled (numeric)' end as kind from (select p_partkey, lower({_WORD}) as f from part)")
def filename_class(spark, d):
    return t.read(spark, d, "part").select("p_partkey", scalars.class_of_filename(F.expr(_WORD)).alias("kind"))


@query(f"""with {o.SCORES} select doc_id, case when score >= 0.685 then 'HIGH' when score >= 0.458 then 'MODERATE' when score * 50 >= 20 then 'LOW' else 'NON-HIGH' end as verdict,
 case when score * 100 >= 80 then 'EXCELLENT' when score * 100 >= 60 then 'GOOD' when score * 100 >= 40 then 'FAIR' else 'POOR' end as data_quality from scores""")
def verdict_tiers(spark, d):
    s = F.col("score")
    return t.scores(spark, d).select("doc_id", scalars.verdict(s, s * 50).alias("verdict"), scalars.data_quality(s * 100).alias("data_quality"))


# ---- joins


@query("""select coalesce(a.k, b.k) as k, a.s1, b.s2 from (select user_id * 100 + day(ts) as k, round(median(value), 6) as s1 from events where event_type = 'view' group by 1) a
 full join (select user_id * 100 + day(ts) as k, round(median(value), 6) as s2 from events where event_type = 'error' group by 1) b on a.k = b.k""")
def outer_merge_sensors(spark, d):
    e = t.read(spark, d, "events").withColumn("k", F.col("user_id") * 100 + F.dayofmonth("ts"))
    one = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("k").agg(F.round(F.median("value"), 6).alias(name))
    return one("view", "s1").join(one("error", "s2"), "k", "full")


@query("select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey qualify row_number() over (partition by o_orderkey order by l_linenumber, l_partkey) = 1")
def first_match_join(spark, d):
    li = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").withColumn("__o", F.struct("l_linenumber", "l_partkey"))
    return composite.first_match(t.read(spark, d, "orders").select("o_orderkey"), li, ["o_orderkey"], "__o").select("o_orderkey", "l_linenumber", "l_partkey")


_BOXES = [("north", 77.0, 78.0, 29.3, 30.4), ("east", 77.65, 84.0, 28.0, 29.5), ("south", 77.0, 78.2, 28.0, 29.1), ("core", 77.5, 77.7, 29.1, 29.3)]


@query(f"with {o.POINTS} select vec_id, case " + " ".join(f"when lon between {a} and {b} and lat between {c} and {e} then '{n}'" for n, a, b, c, e in _BOXES) + " else 'Unknown' end as district from points")
def range_join_district(spark, d):
    boxes = spark.createDataFrame([(k, *b) for k, b in enumerate(_BOXES)], "ord int, name string, x0 double, x1 double, y0 double, y1 double")
    found = spatial.range_join(t.points(spark, d), boxes, "vec_id", 0.5, "lon", "lat")
    return found.select("vec_id", F.col("box").alias("district"))


@query(f"with {o.POINTS} select vec_id, case " + " ".join(f"when lon between {a} and {b} and lat between {c} and {e} then '{n}'" for n, a, b, c, e in _BOXES) + " else 'Unknown' end as district from points")
def range_lookup_district(spark, d):
    return t.points(spark, d).select("vec_id", spatial.range_lookup(_BOXES, "lon", "lat", "Unknown").alias("district"))


@query(f"with {o.POINTS}, p as (select vec_id, lon * 1000 as x, lat * 1000 as y from points) select a.vec_id, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) as nn from p a join p b on a.vec_id <> b.vec_id group by 1")
def nn_distance(spark, d):
    p = t.points(spark, d).select("vec_id", (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"))
    return spatial.nearest_distance(p, "vec_id").withColumn("nn", F.round("nn", 6))


@query(f"with {o.POINTS}, p as (select vec_id, label, lon * 1000 as x, lat * 1000 as y from points) select a.vec_id from p a where a.label < 2 and not exists (select 1 from p b where b.label >= 2 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 20)")
def buffered_antijoin(spark, d):
    p = t.points(spark, d).select("vec_id", "label", (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"))
    return spatial.buffered_antijoin(p.where("label < 2"), p.where("label >= 2"), 20.0).select("vec_id")


@query(f"with {o.POINTS} select vec_id, cast(cast(floor(lat / 0.05) as bigint) as varchar) || '_' || cast(cast(floor(lon / 0.05) as bigint) as varchar) as block from points")
def spatial_block_id(spark, d):
    return t.points(spark, d).select("vec_id", spatial.block_id(F.col("lon"), F.col("lat")).alias("block"))


@query(f"with {o.POINTS} select vec_id, round((0.01 * (1 + label)) * 0.02 * 1e4, 4) as area, round(lon + 0.005 * (1 + label), 4) as cx, round(lat + 0.01, 4) as cy from points")
def polygon_area_centroid(spark, d):
    w = F.lit(0.01) * (1 + F.col("label"))
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y"))
    z, h = F.lit(0.0), F.lit(0.02)
    p = t.points(spark, d).withColumn("ring", F.array(corner(z, z), corner(w, z), corner(w, h), corner(z, h), corner(z, z)))
    x, y = scalars.ring_centroid(F.col("ring"))
    return p.select("vec_id", F.round(scalars.ring_area(F.col("ring")) * 1e4, 4).alias("area"), F.round(x, 4).alias("cx"), F.round(y, 4).alias("cy"))


# ---- splits and evaluation


@query("select s_suppkey as held_out, cast(dense_rank() over (order by s_suppkey) - 1 as int) as fold from supplier where s_nationkey % 2 = 1")
def lopo_folds(spark, d):
    x = t.read(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 2).alias("label"))
    return splits.leave_one_out(x, "s_suppkey", "label")


@query(f"""with {o.SCORES}, g as (select source, avg(y) as share, count(*) as n from scores group by 1),
 f as (select source, cast((row_number() over (order by share nulls first, n, md5('42:' || source), source nulls first) - 1) % 5 as int) as fold from g)
 select s.doc_id, s.source, f.fold from scores s join f on s.source is not distinct from f.source""")
def group_kfold(spark, d):
    return splits.group_folds(t.scores(spark, d), "source", "y").select("doc_id", "source", "fold")


@query("select doc_id, quality from labels qualify row_number() over (partition by quality order by md5('42:' || doc_id), doc_id) <= 50")
def balanced_subsample(spark, d):
    return splits.balance(t.read(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 50)


_CM = f"""with {o.SCORES}, c as (select source, count(*) filter (where y = 0 and score < 0.5) as tn, count(*) filter (where y = 0 and score >= 0.5) as fp, count(*) filter (where y = 1 and score < 0.5) as fn, count(*) filter (where y = 1 and score >= 0.5) as tp, avg((score - y) ** 2) as brier from scores group by 1),
 m as (select *, tn + fp + fn + tp as n, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_pos, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) as f1_neg, (tp + tn) / (tn + fp + fn + tp) as po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ((tn + fp + fn + tp) ** 2) as pe from c)"""


@query(_CM + """ select source, tn, fp, fn, tp, round(coalesce(100 * tp / nullif(tp + fn, 0), 0), 2) + 0.0 as recall_pct, round(coalesce(100 * tn / nullif(tn + fp, 0), 0), 2) + 0.0 as specificity_pct, round(po, 6) + 0.0 as accuracy, round(f1_pos, 6) + 0.0 as f1_pos, round(f1_neg, 6) + 0.0 as f1_neg,
 round((f1_pos + f1_neg) / 2, 6) + 0.0 as macro_f1, round(coalesce((po - pe) / nullif(1 - pe, 0), 0), 6) + 0.0 as kappa from m""")
def confusion_metrics(spark, d):
    return rounded(metrics.confusion(t.scores(spark, d), ["source"]).drop("brier"), ["source"])


@query(_CM + " select source, round(brier, 6) + 0.0 as brier from m")
def brier(spark, d):
    return rounded(metrics.confusion(t.scores(spark, d), ["source"]).select("source", "brier"), ["source"])


@query(f"""with {o.SCORES}, g as (select source, score, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from scores group by 1, 2)
 select source, round(score, 6) + 0.0 as score, cast(sum(pos) over w as bigint) as tp, cast(sum(neg) over w as bigint) as fp, cast(sum(pos) over (partition by source) as bigint) as n_pos, cast(sum(neg) over (partition by source) as bigint) as n_neg
 from g window w as (partition by source order by score desc)""")
def score_curves(spark, d):
    """Of each source the counts of both classes at or above each distinct score: the points of both curves."""
    return rounded(metrics.curve(t.scores(spark, d), ["source"]).select("source", "score", "tp", "fp", "n_pos", "n_neg"), ["source", "tp", "fp", "n_pos", "n_neg"])


@query(f"""with {o.SCORES}, r as (select *, rank() over (partition by source order by score) + (count(*) over (partition by source, score) - 1) / 2 as mid from scores)
 select source, round((sum(mid) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2) / nullif(count(*) filter (where y = 1) * count(*) filter (where y = 0), 0), 6) + 0.0 as roc_auc from r group by 1""")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(t.scores(spark, d), ["source"]), ["source"])


@query(f"""with {o.SCORES}, g as (select source, score, count(*) filter (where y = 1) as pos, count(*) as n from scores group by 1, 2), c as (select *, sum(pos) over w as tp, sum(n) over w as k, sum(pos) over (partition by source) as p from g window w as (partition by source order by score desc))
 select source, round(sum(pos / nullif(p, 0) * tp / k), 6) + 0.0 as pr_auc from c group by 1""")
def pr_auc(spark, d):
    return rounded(metrics.average_precision(t.scores(spark, d), ["source"]), ["source"])


@query(f"""with {o.SCORES}, g as (select source, score, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from scores group by 1, 2), c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over s as p, sum(neg) over s as n from g window w as (partition by source order by score desc), s as (partition by source)),
 j as (select *, round(tp / nullif(p, 0) - fp / nullif(n, 0), 12) as j from c), b as (select * from j qualify row_number() over (partition by source order by j desc nulls last, score desc) = 1)
 select source, cast(case when p = 0 or n = 0 then 0.5 else least(greatest(case when j <= 0 then 1.0 else score end, 0.0), 0.6) end as double) as threshold from b""")
def youden(spark, d):
    return metrics.youden(t.scores(spark, d), ["source"])


@query(_CM + """, f as (select cast(substr(source, 4) as int) % 3 as model, round((f1_pos + f1_neg) / 2, 9) as macro_f1, po as accuracy from m) select model, round(avg(macro_f1), 6) + 0.0 as macro_f1_mean, round(stddev_pop(macro_f1), 6) + 0.0 as macro_f1_std, round(avg(accuracy), 6) + 0.0 as accuracy_mean, round(stddev_pop(accuracy), 6) + 0.0 as accuracy_std from f group by 1""")
def cv_summary(spark, d):
    c = metrics.confusion(t.scores(spark, d), ["source"]).withColumn("model", F.substring("source", 4, 9).cast("int") % 3)
    return rounded(metrics.summarize_folds(c, ["model"], ["macro_f1", "accuracy"]), ["model"])


@query(f"""with {o.SCORES} select source, round(avg(score), 6) + 0.0 as mean_proba, max(score) as max_proba, min(score) as min_proba, round(avg(case when score >= 0.6 then 1.0 else 0.0 end), 6) + 0.0 as fraction, cast(avg(case when score >= 0.6 then 1.0 else 0.0 end) >= 0.5 as int) as predicted from scores group by 1""")
def prediction_summary(spark, d):
    return rounded(metrics.prediction_summary(t.scores(spark, d), ["source"]), ["source"])


@query("select l_suppkey, gap from (select l_suppkey, round(1 - avg(case when l_linenumber in (1, 2) then 1.0 else 0.0 end), 9) as gap from lineitem group by 1) order by gap desc, l_suppkey limit 5")
def monsoon_reserve(spark, d):
    g = composite.gap_fraction(t.read(spark, d, "lineitem"), "l_suppkey", F.col("l_linenumber").isin(1, 2))
    return g.select("l_suppkey", F.round("gap_fraction", 9).alias("gap")).orderBy(F.desc("gap"), "l_suppkey").limit(5)


@query(f"with {o.SCORES} select lang, source, count(*) as n, round(avg(score), 6) + 0.0 as mean from scores group by 1, 2")
def audit_stats(spark, d):
    return rounded(t.scores(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("score").alias("mean")), ["lang", "source"])


@query(f"""with {o.POINTS}, p as (select vec_id, cast(label >= 2 as int) as kind, label + 0.125 as area, label as zone from points), q as (select *, cast(round_even(area * 100, 0) as bigint) as pixels from p)
 select kind, count(*) as n, min(area)::double as area_min, round(quantile_cont(area, 0.1), 6)::double as area_p10, median(area)::double as area_median, round(avg(area), 6) + 0.0 as area_mean, round(quantile_cont(area, 0.9), 6)::double as area_p90, max(area)::double as area_max,
 sum(pixels)::bigint as pixels, sum(least(pixels, 100))::bigint as pixels_capped, count(*) filter (where area < 0.5) as n_tiny, count(distinct zone) as n_zones from q group by 1""")
def audit_areas(spark, d):
    p = t.points(spark, d).select((F.col("label") >= 2).cast("int").alias("kind"), (F.col("label") + 0.125).alias("area"), F.col("label").alias("zone"))
    return rounded(selection.audit(p, ["kind"], "area", ["zone"]), ["kind"])


@query(f"""with {o.FILLED}, r as (select entity, band, step, -20 * v as v from filled where band in ('error', 'signup')), share as (select band, avg(case when v < 0 then 1.0 else 0.0 end) filter (where v is not null) > 0.75 as db from r group by 1)
 select entity, band, round(coalesce(sum(v), 0) - (coalesce(max(v) filter (where step = 0), 0) + coalesce(max(v) filter (where step = 14), 0)) / 2, 6) + 0.0 as sar_auc, round(max(v), 6) + 0.0 as sar_peak_value,
 count(*) filter (where v > case when db then -15.0 else 0.1 end) as sar_season_length, round(stddev_pop(v), 6) + 0.0 as sar_std from r join share using (band) group by 1, 2""")
def sar_phenology_db(spark, d):
    x = t.filled(spark, d).where(F.col("band").isin("error", "signup")).withColumn("v", F.col("v") * -20)
    return rounded(features.radar_phenology(x), KEYS)


@query(f"""with {o.MONTHS}, w as (select entity, band, avg(v) filter (where month(month_start) = 5) as early, avg(v) filter (where month(month_start) in (8, 9)) as peak, avg(v) filter (where month(month_start) in (12, 1)) as late from months group by 1, 2)
 select entity, band, round(early, 6) + 0.0 as early, round(peak, 6) + 0.0 as peak, round(late, 6) + 0.0 as late, round(peak - early, 6) + 0.0 as amp, round((peak - early) / 3, 6) + 0.0 as rise, round((peak - late) / 4, 6) + 0.0 as fall from w""")
def month_anchored(spark, d):
    return rounded(features.month_anchored(t.months(spark, d), F.month("month_start")), KEYS)


@query(f"""with {o.FILLED}, m as (select *, avg(v) over (partition by entity) as mean, var_pop(v) over (partition by entity) as var, count(v) over (partition by entity) as n from filled where band = 'error'),
 l as (select *, (v - mean) * (lead(v) over (partition by entity order by step) - mean) as c from m where v is not null)
 select e.entity, coalesce(round(case when max(n) > 4 and max(var) > 1e-8 then sum(c) / ((max(n) - 1) * max(var)) end, 6), 0) + 0.0 as sar_vh_autocorr_lag1 from (select distinct entity from filled) e left join l using (entity) group by 1""")
def sar_autocorrelation(spark, d):
    vh = t.filled(spark, d).where("band = 'error'")
    return rounded(features.dynamics(vh).select("entity", F.col("autocorr_lag1").alias("sar_vh_autocorr_lag1")), ["entity"])


@query(f"""with {o.GRID}, g as (select entity, step, band, case when n >= 2 then v end as v, n from grid), q as (select entity, avg(case when n >= 2 then 1.0 else 0.0 end) * 100 as pct_valid, count(*) filter (where n < 2) as n_cloudy, count(*) as n_total from g where band = 'view' group by 1)
 select g.entity, g.step, {", ".join(f"round(max(v) filter (where band = '{b}'), 6) + 0.0 as {b}" for b in t.EVENT_BANDS)}, max(n) filter (where band = 'view') as n_valid, round(any_value(pct_valid), 6) + 0.0 as pct_valid, any_value(n_cloudy) as n_cloudy, any_value(n_total) as n_total
 from g join q using (entity) group by 1, 2""")
def extract_panel(spark, d):
    """Grid, composite, join, mask, pivot and quality in one."""
    step = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 2).cast("int")
    e = t.read(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("band"), step.alias("step"), (F.col("value") / t.SCALE).alias("value"))
    found = composite.extract(e.where(f"step between 0 and {t.STEPS - 1}"), t.STEPS, t.EVENT_BANDS, "view", 2)
    return rounded(found, ["entity", "step"])


@query("""select c_custkey, coalesce(c_acctbal, 0) + 0.0 as si_balance, cast(c_nationkey as double) as area_ha, cast(c_custkey % 2 as int) as label, cast(c_nationkey as varchar) as "group" from customer""")
def feature_selection(spark, d):
    """Meta, place, quality, leaking and stepwise columns go; what is left is numbers without gaps."""
    c = t.read(spark, d, "customer")
    odd = {"B4_t00": 1.0, "latitude": 29.0, "valid_pixel_count_t00": 5, "n_cloudy_windows": 1, "si_lat_mean": 2.0}
    x = c.select("c_custkey", F.col("c_custkey").alias("plot_id"), F.col("c_nationkey").alias("group_key"), (F.col("c_custkey") % 2).cast("int").alias("label"), F.col("c_acctbal").alias("si_balance"), F.col("c_nationkey").alias("area_ha"), "c_name", *[F.lit(v).alias(n) for n, v in odd.items()])
    rows, names = selection.features_of(x, "c_custkey", season_invariant=True)
    return rows.select("c_custkey", *names, "label", "group")


@query()
def topk_importance(spark, d):
    from chronopanel.operators import ml

    rows, names = _labelled(spark, d)
    model = ml.model_factory("rf").fit(ml.dealt(ml.weighted(ml.assemble(rows, names))))
    return spark.createDataFrame(ml.importances(model, names), "feature string, importance double")


def _labelled(spark, d) -> tuple[DataFrame, list[str]]:
    """Vectors as labelled rows: places (two components, as metres) and all further components as features."""
    p = t.points(spark, d).select("vec_id", (F.col("label") >= 2).cast("int").alias("label"), "lon", "lat")
    names = [f"e{k}" for k in range(2, 64)]
    e = t.read(spark, d, "embeddings").select("vec_id", *[F.coalesce(F.get("embedding", int(n[1:])).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return p.join(e, "vec_id").withColumns({"x": F.col("lon") * 1000, "y": F.col("lat") * 1000}), names


@query()
def cross_validation(spark, d):
    """Metrics of each fold of spatial blocks, all rows and those apart from other folds, with the threshold."""
    from chronopanel.operators import ml

    rows, names = _labelled(spark, d)
    folded = splits.block_folds(ml.assemble(rows, names).drop(*names), spatial.block_id(F.col("lon"), F.col("lat")), "label")
    _, folds, threshold = ml.evaluate(folded, "rf", x="x", y="y", buffer=5.0)
    return rounded(folds.join(F.broadcast(threshold)), ["fold", "buffered"])  # one row


@query()
def permutation_topk(spark, d):
    from chronopanel.operators import ml

    rows, names = _labelled(spark, d)
    model = ml.model_factory("rf").fit(ml.dealt(ml.weighted(ml.assemble(rows, names))))
    return ml.permutation_importance(model, rows, names, "vec_id")


@query(_CM + """ , s as (select cast(substr(source, 4) as int) % 3 as model, sum(tn)::bigint as tn, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tp)::bigint as tp, count(*) as n_folds from m group by 1)
 select *, round(100 * tn / greatest(tn + fp, 1), 2) as tn_pct, round(100 * fp / greatest(tn + fp, 1), 2) as fp_pct, round(100 * fn / greatest(fn + tp, 1), 2) as fn_pct, round(100 * tp / greatest(fn + tp, 1), 2) as tp_pct from s""")
def cv_confusion(spark, d):
    c = metrics.confusion(t.scores(spark, d), ["source"]).withColumn("model", F.substring("source", 4, 9).cast("int") % 3)
    return metrics.summed_confusion(c, ["model"])


#: Index curves that go through the families beside the bands, and their SQL over `wide`.
CURVES = {
    "NDVI": _NDVI,
    "NDWI": "(signup - view) / nullif(signup + view + 1e-8, 0)",
    "LSWI": "(view - error) / nullif(view + error + 1e-8, 0)",
    "GNDVI": "(view - signup) / nullif(view + signup + 1e-8, 0)",
    "SAVI": "(view - click) / nullif(view + click + 0.5 + 1e-8, 0) * 1.5",
}
_CURVES = (
    o.GRID + ", " + o.fill("grid", "bands") + ", " + o.WIDE.replace("from filled", "from bands") + ", filled as (select entity, band, step, v from bands"
    + "".join(f" union all select entity, '{n}', step, {e} from wide" for n, e in CURVES.items()) + ")"
)
_MONTH = f"(cast(round_even(9 + (step - {t.STEPS // 2}) * 0.5::double, 0) as int) % 12 + 12) % 12"
_DATED = f"""months as (select entity, band, step, v, make_date(case when step < {t.STEPS // 2} or m >= 9 then 2025 else 2026 end, m, 1) as month_start
 from (select *, case when {_MONTH} = 0 then 12 else {_MONTH} end as m from filled))"""
#: Family, registered query whose features it has, and whether these are of an entity and band.
FAMILIES = (
    ("stats", "temporal_stats", True), ("shape", "shape_stats", True), ("duration", "duration_streak", True), ("duration", "green_span", True),
    ("dynamics", "dynamics", True), ("dynamics", "autocorr_lag1", True), ("dynamics", "n_peaks", True), ("phenology", "phenology_curve", True),
    ("harmonics", "harmonics", True), ("harmonics", "spectral_entropy", True), ("window", "window_anchored", True), ("seasonal", "seasonal_split", True),
    ("interannual", "interannual_diff", True), ("radar", "sar_structure", False), ("cross", "cross_sensor", False), ("pearson", "pearson_cross", False),
)


def _family_sql(family: str, name: str, by_band: bool) -> str:
    sql = SQL[name]
    mine = {o.MONTHS: f"{_CURVES}, {_DATED}", o.FILLED: _CURVES, o.GRID: _CURVES}
    source = next(x for x in mine if x in sql)
    before, rest = sql.split(source, 1)  # the series have the bands' wide table already, and stand for the grid
    sql = before + mine[source] + rest.replace(f", {o.WIDE}", "", 1).replace("from grid", "from filled")
    keys = "entity, band" if by_band else "entity"
    feature = f"'{family}_' || band || '_' || f" if by_band else f"'{family}_' || f"
    return f"""select entity, {feature} as feature, value from (select {keys}, columns(* exclude ({keys}))::double from ({sql})) unpivot include nulls (value for f in (columns(* exclude ({keys}))))"""


def feature_families(series_: DataFrame, wide: DataFrame) -> list[tuple[str, DataFrame]]:
    """Family and features, by entity and band of the filled series (entity, band, step, v) or by entity of the
    bands (wide). The series are dealt out by entity and band, sorted and written once; the written table keeps
    both, so no window or aggregate of a family shuffles or sorts them again."""
    n = wide.count() * (len(t.EVENT_BANDS) + len(CURVES))
    x = series.spread(checkpointed(series.dealt(series_.select("entity", "band", "step", "v"), n)), n)
    step = F.col("step").cast("int")
    return [
        ("stats", features.temporal_stats(x)),
        ("shape", features.shape(x).withColumn("peak_trough", F.round("peak_trough", 4))),
        ("duration", features.duration(x)),
        ("dynamics", _steady(features.dynamics(x))),
        ("phenology", _steady(features.phenology(series.smooth(x)))),
        ("harmonics", _phases(features.harmonics(x, t.STEPS))),
        ("window", features.window_anchored(x, t.STEPS)),
        ("seasonal", features.seasonal(x, scalars.synthetic_month(step, t.STEPS))),
        ("interannual", features.interannual(x, scalars.synthetic_year(step, t.STEPS))),
        ("radar", _radar(wide)),
        ("cross", _cross(wide)),
        ("pearson", features.correlation(wide, "view", "signup", ["entity"])),
    ]


def feature_table_long(families: list[tuple[str, DataFrame]]) -> DataFrame:
    """(entity, feature, value) of all families; nulls and non-finite values are 0."""
    out = None
    for family, f in families:
        part = features.to_long(rounded(f, [k for k in KEYS if k in f.columns]), family)
        out = part if out is None else out.unionByName(part)
    v = F.col("value")
    return out.withColumn("value", F.round(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v), 6) + 0.0)


@query("select entity, feature, round(coalesce(value, 0), 6) + 0.0 as value from (" + " union all ".join(_family_sql(*x) for x in FAMILIES) + ")")
def feature_table(spark, d):
    """All families of the bands and of the index curves."""
    bands = t.filled(spark, d).select("entity", "band", "step", "v")
    wide = checkpointed(t.wide(bands).repartition("entity"))
    bands = wide.unpivot(["entity", "step"], t.EVENT_BANDS, "band", "v")
    curves = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), indices.index(n, **_R).alias("v")) for n in CURVES])).alias("c")
    both = bands.unionByName(wide.select("entity", "step", curves).select("entity", "c.band", "step", "c.v"))
    return feature_table_long(feature_families(both, wide))


@query(f"""with {o.SCORES}, p as (select source, avg(score) as mean_proba, max(score) as max_proba, min(score) as min_proba, avg(case when score >= 0.6 then 1.0 else 0.0 end) as fraction, avg(score * 100) as pct from scores group by 1)
 select source, round(mean_proba, 6) + 0.0 as mean_proba, max_proba, min_proba, round(fraction, 6) + 0.0 as fraction, cast(fraction >= 0.5 as int) as predicted,
 case when mean_proba >= 0.685 then 'HIGH' when mean_proba >= 0.458 then 'MODERATE' when fraction * 100 >= 20 then 'LOW' else 'NON-HIGH' end as verdict,
 case when pct >= 80 then 'EXCELLENT' when pct >= 60 then 'GOOD' when pct >= 40 then 'FAIR' else 'POOR' end as data_quality from p""")
def detect_verdicts(spark, d):
    s = t.scores(spark, d).withColumn("pct", F.col("score") * 100)
    return rounded(detect.verdicts(s, ["source"], valid="pct"), ["source"])


@query(SQL["cv_summary"].replace("select model, round", "select cast(model as varchar) as model, round", 1) + " qualify row_number() over (order by round(avg(macro_f1), 6) desc, cast(model as varchar)) = 1")
def best_model(spark, d):
    return metrics.best(cv_summary(spark, d).withColumn("model", F.col("model").cast("string")), "model", "macro_f1_mean")


@query(f"""with {o.POINTS}, b as (select *, cast(cast(floor(lat / 0.05) as bigint) as varchar) || '_' || cast(cast(floor(lon / 0.05) as bigint) as varchar) as block, cast(label >= 2 as int) as y from points),
 g as (select block, avg(y) as share, count(*) as n from b group by 1), f as (select block, cast((row_number() over (order by share, n, md5('42:' || block), block) - 1) % 5 as int) as fold from g)
 select vec_id, fold from b join f using (block)""")
def spatial_block_folds(spark, d):
    p = t.points(spark, d).withColumn("y", (F.col("label") >= 2).cast("int"))
    return splits.block_folds(p, spatial.block_id(F.col("lon"), F.col("lat")), "y").select("vec_id", "fold")


@query(f"with {o.POINTS} select vec_id, round(lon - 0.01, 6) as x0, round(lat - label * 0.001, 6) as y0, round(lon + 0.02, 6) as x1, round(lat + 0.03, 6) as y1 from points")
def ring_bbox(spark, d):
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y"))
    low = -F.col("label") * 0.001
    ring = F.array(corner(F.lit(0.0), low), corner(F.lit(0.02), F.lit(0.0)), corner(F.lit(0.01), F.lit(0.03)), corner(F.lit(-0.01), F.lit(0.0)), corner(F.lit(0.0), low))
    box = scalars.ring_bbox(ring)
    return t.points(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@query("select p_partkey, case cast(floor(s * 3 / 21) as int) when 0 then 'early' when 1 then 'peak' when 2 then 'late' end as phase from (select p_partkey, p_partkey % 25 - 2 as s from part)")
def tag_phase(spark, d):
    return t.read(spark, d, "part").select("p_partkey", scalars.tag_phase(F.col("p_partkey") % 25 - 2, 21).alias("phase"))


# ---- tags, masks, caps and hold-outs


@query(f"""with {o.FILLED}, {o.WIDE}, w as (select *, power(10, -signup) as vv, power(10, -error) as vh from wide) select entity, step, round((view - click) / (view + click), 6) + 0.0 as ndvi, round((purchase - view) / (purchase + view), 6) + 0.0 as ndwi, round(4 * vh / (vv + vh + 1e-8), 6) + 0.0 as rvi from w""")
def plain_indices(spark, d):
    """The older set: normalised differences without an added term, radar taken as decibels in any case."""
    linear = {b: indices.to_linear(F.col(c) * -10) for b, c in (("VV", "signup"), ("VH", "error"))}
    ndvi, ndwi = indices.plain_ratio(F.col("view"), F.col("click")), indices.plain_ratio(F.col("purchase"), F.col("view"))
    w = t.wide(t.filled(spark, d)).select("entity", "step", ndvi.alias("ndvi"), ndwi.alias("ndwi"), indices.index("RVI", **linear).alias("rvi"))
    return rounded(w, ["entity", "step"])


@query("""select l_orderkey, l_linenumber, scene not in (1, 2, 3, 8, 9, 10) and (flags & 3072) = 0 as clear, cast(scene in (4, 5, 6, 7, 11) as int) as optical
 from (select l_orderkey, l_linenumber, l_partkey % 12 as scene, (l_suppkey * 512) % 4096 as flags from lineitem)""")
def legacy_masks(spark, d):
    scene, flags = F.col("l_partkey") % 12, (F.col("l_suppkey") * 512) % 4096
    return t.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", composite.legacy_mask(scene, flags).alias("clear"), composite.optical_flag(scene).alias("optical"))


_TAGS = "case p_partkey % 5 when 0 then 'B4_2024_0' || (p_partkey % 9 + 1) || '_15' when 1 then 'B8A_t' || lpad(cast(p_partkey % 21 as {s}), 2, '0') when 2 then 'VV_2024_02_31' when 3 then 'plot_id' else 'NDVI_t' || (p_partkey % 130) end"


@query(f"""select p_partkey, nullif(regexp_replace(name, '_([0-9]{{4}}_[0-9]{{2}}_[0-9]{{2}}|t[0-9]+)$', ''), name) as band, cast(try_strptime(nullif(regexp_extract(name, '_([0-9]{{4}}_[0-9]{{2}}_[0-9]{{2}})$', 1), ''), '%Y_%m_%d') as date) as tag_date, cast(nullif(regexp_extract(name, '_t([0-9]+)$', 1), '') as int) as tag_step
 from (select p_partkey, {_TAGS.format(s='varchar')} as name from part)""")
def time_tags(spark, d):
    n = F.col("name")
    x = t.read(spark, d, "part").select("p_partkey", F.expr(_TAGS.format(s="string")).alias("name"))
    return x.select("p_partkey", scalars.tag_band(n).alias("band"), scalars.tag_date(n).alias("tag_date"), scalars.tag_step(n).alias("tag_step"))


@query("""select p_partkey, cast(case when s < 10 or (case when m = 0 then 12 else m end) >= 9 then 2025 else 2026 end as int) as year from (select p_partkey, s, (cast(round_even(9 + (s - 10) * 0.5::double, 0) as int) % 12 + 12) % 12 as m from (select p_partkey, p_partkey % 21 as s from part))""")
def synthetic_year(spark, d):
    return t.read(spark, d, "part").select("p_partkey", scalars.synthetic_year((F.col("p_partkey") % 21).cast("int"), 21).alias("year"))


@query(f"with {o.POINTS} select vec_id, case when lon < 78 then 32643 when lon < 84 then 32644 else 32645 end as zone, cast(round_even((label + 0.125) * 100, 0) as bigint) as pixels from points where lon between 77.1 and 84.6 and lat between 23.9 and 30.4 and label + 0.125 >= 0.5")
def plot_filters(spark, d):
    area = F.col("label") + 0.125
    p = t.points(spark, d).where(scalars.in_box(F.col("lon"), F.col("lat")) & (area >= 0.5))
    return p.select("vec_id", scalars.utm_zone(F.col("lon")).alias("zone"), scalars.approx_pixels(area).alias("pixels"))


@query(f"with {o.POINTS}, p as (select vec_id, lon * 1000 as x, lat * 1000 as y from points), m as (select a.vec_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as nn from p a join p b on a.vec_id <> b.vec_id group by 1) select count(*) as n, round(min(nn), 6) + 0.0 as min, round(median(nn), 6) + 0.0 as median, round(avg(nn), 6) + 0.0 as mean, round(max(nn), 6) + 0.0 as max, " + ", ".join(f"round(avg(case when nn < {x} then 1.0 else 0.0 end), 6) + 0.0 as below_{x}" for x in (5, 20, 100)) + " from m")
def nn_shares(spark, d):
    p = t.points(spark, d).select("vec_id", (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"))
    return rounded(spatial.distance_shares(spatial.nearest_distance(p, "vec_id"), (5, 20, 100)), ["n"])


@query(
    f"""with {o.POINTS}, p as (select vec_id, cast(label >= 2 as int) as kind, lon * 1000 as x, lat * 1000 as y from points),
 m as (select a.vec_id, any_value(a.kind) as kind, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as nn from p a join p b on a.vec_id <> b.vec_id and a.kind = b.kind group by 1)
 select kind, count(*) as n, {o.rounded("min(nn)", alias="min")}, {o.rounded("median(nn)", alias="median")}, {o.rounded("avg(nn)", alias="mean")}, {o.rounded("max(nn)", alias="max")}, """
    + ", ".join(o.rounded(f"avg(case when nn < {x} then 1.0 else 0.0 end)", alias=f"below_{x}") for x in (5, 20, 100))
    + " from m group by kind"
)
def nn_by_class(spark, d):
    """Distances between places of one class, as an audit of leakage asks for them."""
    p = t.points(spark, d).select("vec_id", (F.col("label") >= 2).cast("int").alias("kind"), (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"))
    return rounded(spatial.distance_shares(spatial.nearest_distance(p, "vec_id", by="kind"), (5, 20, 100), by="kind"), ["kind", "n"])


@query("select l_suppkey, l_orderkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_quantity) <= 20")
def pixel_cap(spark, d):
    x = t.read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return splits.first_rows(x, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity"], 20)


@query("select lang, case when lang in ('fr', 'de') then 'test' else 'train' end as split, count(*) as n from documents group by 1, 2")
def region_holdout(spark, d):
    x = splits.hold_out(t.read(spark, d, "documents").select("doc_id", "lang"), "lang", ["fr", "de"], "doc_id", share=0.0)
    return x.groupBy("lang", "split").agg(F.count("*").alias("n"))


@query("""select doc_id, lang, case when test then 'test' when row_number() over (partition by test order by md5('42:' || doc_id), doc_id) <= greatest(1, floor(count(*) over (partition by test) * 0.1::double)) then 'validation' else 'train' end as split
 from (select doc_id, lang, coalesce(lang in ('fr', 'de'), false) as test from documents)""")
def region_holdout_rows(spark, d):
    """The split of each row, with the default share of validation rows."""
    return splits.hold_out(t.read(spark, d, "documents").select("doc_id", "lang"), "lang", ["fr", "de"], "doc_id")


@query("select o_custkey, o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey")
def key_alignment(spark, d):
    c = t.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return splits.matched(t.read(spark, d, "orders").select("o_custkey", "o_orderkey"), c, "o_custkey")


@query(f"with {o.FILLED} select entity, band, step as place, round(coalesce(v, 0), 6) + 0.0 as v from filled")
def tensor_build(spark, d):
    x = features.tensor(t.filled(spark, d).withColumn("v", F.coalesce("v", F.lit(0.0))))
    return rounded(x.select("entity", "band", F.posexplode("values").alias("place", "v")), ["entity", "band", "place"])


@query(f"with {o.FILLED} select entity, step as place, cast(list_position(['click','error','purchase','signup','view'], band) - 1 as int) as channel, round(coalesce(v, 0), 6) + 0.0 as v from filled")
def tensor_cube(spark, d):
    x = features.cube(t.filled(spark, d), t.EVENT_BANDS).select("entity", F.posexplode("cube").alias("place", "row"))
    return rounded(x.select("entity", "place", F.posexplode("row").alias("channel", "v")), ["entity", "place", "channel"])


# ---- scenes, rings and hold-outs


@query("""with clouds as (select l_orderkey as scene, l_linenumber as pixel, min(l_quantity) as cloud from lineitem group by 1, 2),
 p as (select l_suppkey as entity, cast(month(l_shipdate) as int) as step, l_orderkey as scene, l_linenumber as pixel, l_partkey % 12 as scl, (l_suppkey * 512) % 4096 as qa, l_extendedprice / 10000 as B8, l_tax * 1000 / 10000 as B4 from lineitem),
 c as (select entity, step, B8, B4 from p join clouds using (scene, pixel) where scene in (select o_orderkey from orders where cast(floor(o_totalprice) as bigint) % 60 < 30) and scl in (4, 5, 6, 7) and cloud < 30 and (qa & 3072) = 0)
 select entity, step, band, round(median(v), 9) + 0.0 as v, count(v) as n from (select entity, step, 'B8' as band, B8 as v from c union all select entity, step, 'B4', B4 from c) group by 1, 2, 3""")
def scenes_optical(spark, d):
    x = t.read(spark, d, "lineitem").withColumns({"scene": F.col("l_orderkey"), "pixel": F.col("l_linenumber")})
    pixels = x.select(
        F.col("l_suppkey").alias("entity"), F.month("l_shipdate").alias("step"), "scene", "pixel", (F.col("l_partkey") % 12).alias("scl"),
        ((F.col("l_suppkey") * 512) % 4096).alias("qa"), F.col("l_extendedprice").alias("B8"), (F.col("l_tax") * 1000).alias("B4"),
    )
    of = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("scene"), (F.floor("o_totalprice") % 60).alias("cloudy"))
    return rounded(scenes.optical(pixels, of, x.select("scene", "pixel", F.col("l_quantity").alias("cloud")), ["B8", "B4"], ["entity", "step"]), ["entity", "step", "band"], 9)  # medians of two have a digit more than prices


@query("""with p as (select l_suppkey as entity, cast(month(l_shipdate) as int) as step, 10 ** (-l_quantity / 10) as VV, 10 ** (-(l_quantity + l_tax * 10) / 10) as VH from lineitem
 where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey % 5 <> 0 and o_orderkey % 3 <> 0))
 select entity, step, band, round(median(v), 6) + 0.0 as v, count(v) as n from (select entity, step, 'VV' as band, VV as v from p union all select entity, step, 'VH', VH from p) group by 1, 2, 3""")
def scenes_radar(spark, d):
    pixels = t.read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.month("l_shipdate").alias("step"), F.col("l_orderkey").alias("scene"), (-F.col("l_quantity")).alias("VV"), (-F.col("l_quantity") - F.col("l_tax") * 10).alias("VH")
    )
    key = F.col("o_orderkey")
    of = t.read(spark, d, "orders").select(
        key.alias("scene"), F.when(key % 5 == 0, "EW").otherwise("IW").alias("mode"), F.when(F.col("o_orderstatus") == "F", "DESCENDING").otherwise("ASCENDING").alias("orbit"),
        F.when(key % 3 == 0, F.array(F.lit("VV"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("polarisations"),
    )
    return rounded(scenes.radar(pixels, of, ["entity", "step"]), ["entity", "step", "band"])


@query("""select l_suppkey, pixel, coalesce(B8, -999.0) + 0.0 as B8 from (select distinct l_suppkey, l_orderkey * 10 + l_linenumber as pixel, case when (l_orderkey * 10 + l_linenumber) % 7 <> 0 then (l_orderkey % 100) / 100.0::double end as B8 from lineitem)
 qualify row_number() over (partition by l_suppkey order by md5('42:' || pixel), pixel) <= 20""")
def pixel_sample(spark, d):
    pixel = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    x = t.read(spark, d, "lineitem").select("l_suppkey", pixel.alias("pixel"), F.when(pixel % 7 != 0, (F.col("l_orderkey") % 100) / 100.0).alias("B8"))
    return scenes.sample(x, ["l_suppkey"], "pixel", ["B8"], 20, distinct=True)


@query(_OPT + "-1.0::double as NDVI, " + ", ".join(f"round({e}, 6) + 0.0 as {n}" for n, e in {
    "EVI": "case when abs(view + 6 * click - 7.5 * purchase + 1) > 0.01 then 2.5 * (view - click) / nullif(view + 6 * click - 7.5 * purchase + 1 + 1e-8, 0) end",
    "NDWI": "(signup - view) / nullif(signup + view + 1e-8, 0)",
    "LSWI": "(view - error) / nullif(view + error + 1e-8, 0)",
    "SAVI": "(view - click) / nullif(view + click + 0.5 + 1e-8, 0) * 1.5",
    "MSAVI": "(2 * view + 1 - sqrt(case when (2 * view + 1) ** 2 - 8 * (view - click) < 0 then 0 else (2 * view + 1) ** 2 - 8 * (view - click) end)) / 2",
    "GNDVI": "(view - signup) / nullif(view + signup + 1e-8, 0)",
    "GRVI": "(signup - click) / nullif(signup + click + 1e-10, 0)",
}.items()) + " from wide")
def indices_of_bands(spark, d):
    """All indices that five bands give; NDVI is there before and stays."""
    stable = F.abs(F.col("view") + 6 * F.col("click") - 7.5 * F.col("purchase") + 1) > 0.01
    w = t.wide(t.filled(spark, d)).select("entity", "step", *[F.col(c).alias(b) for b, c in _R.items()], F.lit(-1.0).alias("NDVI"), F.coalesce(stable, F.lit(True)).alias("__stable"))
    x = indices.add_all(w).withColumn("EVI", F.when(F.col("__stable"), F.col("EVI"))).drop(*_R, "__stable")
    return rounded(x, ["entity", "step"])


@query(f"""with {o.FILLED}, {o.WIDE}, w as (select *, power(10, -signup) as vv, power(10, -error) as vh from wide) select entity, step, round((view - click) / nullif(view + click, 0), 6) + 0.0 as ndvi,
 case when abs(view + 6 * click - 7.5 * purchase + 1) > 0.01 then round(2.5 * (view - click) / (view + 6 * click - 7.5 * purchase + 1), 6) + 0.0 end as evi, round((signup - view) / nullif(signup + view, 0), 6) + 0.0 as ndwi,
 round((view - error) / nullif(view + error, 0), 6) + 0.0 as lswi, round(4 * vh / (vv + vh), 6) + 0.0 as rvi from w""")
def plain_indices_all(spark, d):
    x = t.wide(t.filled(spark, d)).select("entity", "step", *[F.col(c).alias(b) for b, c in _R.items()], (F.col("signup") * -10).alias("VV"), (F.col("error") * -10).alias("VH"))
    x = indices.plain_all(x).withColumn("EVI", F.when(F.abs(F.col("B8") + 6 * F.col("B4") - 7.5 * F.col("B2") + 1) > 0.01, F.col("EVI")))
    return rounded(x.select("entity", "step", *[F.col(c).alias(c.lower()) for c in ("NDVI", "EVI", "NDWI", "LSWI", "RVI")]), ["entity", "step"])


_ELLIPSOID = "6378137.0::double as a, 1 / 298.257223563::double as f"
_UTM = f"""c as (select *, f / (2 - f) as n from (select {_ELLIPSOID})), k as (select *, a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) * 0.9996 as r, 2 * sqrt(n) / (1 + n) as e, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 as a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 as a2, 61 * n ** 3 / 240 as a3 from c),
 s as (select vec_id, i, e, r, a1, a2, a3, radians(x - 75) as l, sinh(atanh(sin(radians(y))) - e * atanh(e * sin(radians(y)))) as tt from corners, k),
 q as (select *, atan2(tt, cos(l)) as xi, atanh(sin(l) / sqrt(1 + tt * tt)) as eta from s),
 flat as (select vec_id, i, r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) as x, r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) as y from q)"""
_RING = "corners as (select vec_id, i, lon + [0.0, 0.02, 0.02 * (1 + label), 0.01, 0.0][i] as x, lat + [0.0, 0.001, 0.02, 0.03, 0.0][i] as y from points, (select unnest(range(1, 6)) as i))"


def _ring(low: float = 0.001) -> Column:
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y"))
    wide = F.lit(0.02) * (1 + F.col("label"))
    return F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.lit(0.02), F.lit(low)), corner(wide, F.lit(0.02)), corner(F.lit(0.01), F.lit(0.03)), corner(F.lit(0.0), F.lit(0.0)))


@query(f"""with {o.POINTS}, {_RING}, {_UTM}, near as (select *, x - first_value(x) over w as u, y - first_value(y) over w as v from flat window w as (partition by vec_id order by i)),
 sides as (select vec_id, u * lead(v) over w - lead(u) over w * v as c from near window w as (partition by vec_id order by i)) select vec_id, round(abs(sum(c)) / 2 / 10000, 4) as area_ha from sides group by 1""")
def ring_area_utm(spark, d):
    """Hectares of each ring on the plane of zone 43."""
    return t.points(spark, d).select("vec_id", scalars.area_ha(_ring()).alias("area_ha"))


@query(f"with {o.POINTS} select vec_id, label = 2 as crosses from points")
def ring_validity(spark, d):
    """Rings of four corners, of which those of one class have two sides that cross."""
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y"))
    tied = F.when(F.col("label") == 2, 0.0).otherwise(0.02)
    straight = F.lit(0.02) - tied
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.lit(0.02), F.lit(0.0)), corner(tied, F.lit(0.02)), corner(straight, F.lit(0.02)), corner(F.lit(0.0), F.lit(0.0)))
    return t.points(spark, d).select("vec_id", scalars.ring_crosses_itself(ring).alias("crosses"))


@query("""select p_partkey, cast(case when y is not null then y else 2025 end as int) as year, cast(coalesce(m, 1) as int) as month from (select p_partkey, cast(nullif(regexp_extract(tag, '^([0-9]{4})_(0[1-9]|1[0-2])$', 1), '') as int) as y, cast(nullif(regexp_extract(tag, '^([0-9]{4})_(0[1-9]|1[0-2])$', 2), '') as int) as m
 from (select p_partkey, case p_partkey % 3 when 0 then 'x' || p_partkey else (2020 + p_partkey % 5) || '_' || lpad(cast(p_partkey % 14 as varchar), 2, '0') end as tag from part))""")
def tag_year_month(spark, d):
    k = F.col("p_partkey")
    tag = F.when(k % 3 == 0, F.concat(F.lit("x"), k)).otherwise(F.concat_ws("_", 2020 + k % 5, F.lpad((k % 14).cast("string"), 2, "0")))
    year, month = scalars.tag_year_month(tag)
    return t.read(spark, d, "part").select("p_partkey", year.alias("year"), month.alias("month"))


_PLOTS = "plots as (select doc_id, case when doc_id % 3 = 2 then 'p' || (doc_id % 40) || '_local_neg' else 'p' || (doc_id % 40 + case when doc_id % 3 = 1 then 100 else 0 end) end as plot, cast(doc_id % 3 = 0 as int) as label, n_chars from documents)"


def _plots(spark, d) -> DataFrame:
    """Documents as plots: positive ones, their local negatives and others."""
    k = F.col("doc_id")
    of = F.when(k % 3 == 2, F.concat(F.lit("p"), k % 40, F.lit("_local_neg"))).otherwise(F.concat(F.lit("p"), k % 40 + F.when(k % 3 == 1, 100).otherwise(0)))
    return t.read(spark, d, "documents").select("doc_id", of.alias("plot"), (k % 3 == 0).cast("int").alias("label"), "n_chars")


@query(f"""with {_PLOTS}, held as (select plot, cast(row_number() over (order by plot) - 1 as int) as fold from (select distinct plot from plots where label = 1))
 select doc_id, p.plot, label, fold from plots p left join held h on h.plot = regexp_replace(p.plot, '_local_neg$', '')""")
def lopo_rows(spark, d):
    return splits.leave_one_out_rows(_plots(spark, d).drop("n_chars"), "plot", "label")


@query(f"""with {_PLOTS}, held as (select plot from (select plot, round(avg((n_chars % 10) / 10.0), 9) as gap from plots where label = 1 group by 1) order by gap desc, plot limit 3)
 select doc_id, plot, case when regexp_replace(plot, '_local_neg$', '') in (select plot from held) then 'reserved' else 'train' end as part from plots""")
def reserved_rows(spark, d):
    """Rows of the three plots of the largest gaps, with their local negatives, and all others."""
    p = _plots(spark, d)
    gaps = p.where("label = 1").groupBy("plot").agg(F.round(F.avg((F.col("n_chars") % 10) / 10.0), 9).alias("gap"))
    held, rest = splits.reserve(p, gaps.orderBy(F.desc("gap"), "plot").limit(3).select(F.col("plot").alias("held_out")), "plot")
    return held.withColumn("part", F.lit("reserved")).unionByName(rest.withColumn("part", F.lit("train"))).select("doc_id", "plot", "part")


_FILE = "case file % 3 when 0 then file || '_3aug2023.kml' when 1 then file || '_2024-03-09.kml' else file || '.kml' end"


@query(f"""with {o.POINTS}, shapes as (select *, vec_id // 10 as file, vec_id % 7 <> 3 as fine from points), placed as (select *, row_number() over (partition by file order by vec_id) - 1 as idx from shapes),
 corners as (select vec_id, file, idx, i, round(lon + [0.0, 0.02, 0.02 * (1 + label), 0.01, 0.0][i], 6) as x, round(lat + [0.0, 0.001, 0.02, 0.03, 0.0][i], 6) as y from placed, (select unnest(range(1, 6)) as i) where fine),
 {_UTM}, near as (select *, x - first_value(x) over w as u, y - first_value(y) over w as v from flat window w as (partition by vec_id order by i)),
 sides as (select vec_id, u * lead(v) over w - lead(u) over w * v as c from near window w as (partition by vec_id order by i)), areas as (select vec_id, round(abs(sum(c)) / 2 / 10000, 4) as area_ha from sides group by 1),
 deg as (select *, first_value(x) over w as x0, first_value(y) over w as y0 from corners window w as (partition by vec_id order by i)),
 dside as (select vec_id, file, idx, x0, y0, (x - x0) * (lead(y) over w - y0) - (lead(x) over w - x0) * (y - y0) as c, x + lead(x) over w - 2 * x0 as sx, y + lead(y) over w - 2 * y0 as sy from deg window w as (partition by vec_id order by i)),
 centre as (select vec_id, file, cast(idx as int) as polygon_idx, max(x0) + sum(sx * c) / (3 * sum(c)) as lon, max(y0) + sum(sy * c) / (3 * sum(c)) as lat from dside group by 1, 2, 3),
 whole as (select *, {_FILE} as source_file, case file % 3 when 0 then date '2023-08-03' when 1 then date '2024-03-09' else date '2024-09-01' end as anchor_date from centre join areas using (vec_id))
 select 'plot_' || lpad(cast(row_number() over (order by source_file, polygon_idx) as varchar), 5, '0') as plot_id, 'pos__' || source_file as group_key, source_file, polygon_idx, area_ha, round(lon, 6) as lon, round(lat, 6) as lat,
 anchor_date, cast(anchor_date - interval 5 month as date) as date_start, cast(anchor_date + interval 5 month as date) as date_end, 'field ' || vec_id as name, 5 as n_points from whole""")
def kml_polygons(spark, d):
    """Points as documents of ten placemarks each: open rings, closed lines, and lines that are no polygon."""
    here = lambda dx, dy: F.format_string("%.6f,%.6f,0", F.round(F.col("lon") + dx, 6), F.round(F.col("lat") + dy, 6))
    ring = [here(F.lit(0.0), 0.0), here(F.lit(0.02), 0.001), here(F.lit(0.02) * (1 + F.col("label")), 0.02), here(F.lit(0.01), 0.03)]
    tagged = lambda tag, *inner: F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag}>"))
    of = lambda *p: tagged("coordinates", F.concat_ws(" ", *p))
    k = F.col("vec_id")
    shape = F.when(k % 7 == 3, tagged("LineString", of(*ring))).when(k % 2 == 0, tagged("Polygon", tagged("outerBoundaryIs", tagged("LinearRing", of(*ring))))).otherwise(tagged("LineString", of(*ring, ring[0])))
    marks = t.points(spark, d).select((k / 10).cast("bigint").alias("file"), k, F.when(k % 7 != 3, k).alias("fine"), tagged("Placemark", tagged("name", F.concat(F.lit("field "), k)), shape).alias("mark"))
    docs = marks.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "mark"))), lambda x: x["mark"]), "\n").alias("xml"))
    docs = docs.select(F.concat(F.lit("survey/"), F.expr(_FILE)).alias("path"), tagged("kml", "xml").alias("xml"))
    found = kml.polygons(docs, 1)
    out = found.select("plot_id", "group_key", "source_file", "polygon_idx", "area_ha", "lon", "lat", "anchor_date", "date_start", "date_end", "name", F.size("geometry").alias("n_points"))
    return out.withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


from chronopanel.plans import whole  # noqa: E402, F401  (registers its queries)
