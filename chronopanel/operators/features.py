"""Features of each series (entity and band): statistics, shape, duration, dynamics, phenology, harmonics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import indices
from chronopanel.operators import series

EPS = 1e-8
KEYS = series.KEYS


@dataclass
class Part:
    """A family of features of a series: columns along the steps, aggregates of them, and the features from these.
    Names of columns and aggregates begin with the part's own prefix, so that parts can be computed together."""

    along: Callable[[DataFrame], DataFrame]
    aggregates: dict[str, Column]
    features: dict[str, Column]


def together(df: DataFrame, parts: dict[str, Part]) -> DataFrame:
    """A row for each entity and band with the features of all parts, each after its part's name: one chain of windows
    and one aggregate, whatever the number of parts."""
    for part in parts.values():
        df = part.along(df)
    a = df.groupBy(*KEYS).agg(*[c.alias(n) for part in parts.values() for n, c in part.aggregates.items()])
    return a.select(*KEYS, *[c.alias(name + n) for name, part in parts.items() for n, c in part.features.items()])


def _alone(df: DataFrame, part: Part) -> DataFrame:
    return together(df, {"": part})


def _cv(mean: Column, std: Column) -> Column:
    return F.when(F.abs(mean) > EPS, std / (F.abs(mean) + EPS)).otherwise(F.lit(0.0))


def _quantiles(v: str) -> Column:
    return F.percentile(v, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))


def _area(v: str) -> Column:
    """Of the trapezoids between steps; nulls count as 0."""
    steps = F.struct("step", F.coalesce(v, F.lit(0.0)).alias("v"))
    return F.sum(F.coalesce(v, F.lit(0.0))) - (F.min(steps)["v"] + F.max(steps)["v"]) / 2


def stats_part(v: str = "v", p: str = "") -> Part:
    c = lambda n: F.col(p + n)
    aggregates = {f"{p}min": F.min(v), f"{p}max": F.max(v), f"{p}mean": F.avg(v), f"{p}std": F.stddev_pop(v), f"{p}q": _quantiles(v)}
    quantiles = {n: F.get(c("q"), i) for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))}
    spread = {"std": c("std"), "range": c("max") - c("min"), "cv": F.when(c("mean").isNotNull(), _cv(c("mean"), c("std")))}
    return Part(lambda d: d, aggregates, {"min": c("min"), "max": c("max"), "mean": c("mean")} | quantiles | spread)


def temporal_stats(df: DataFrame, v: str = "v") -> DataFrame:
    """Eleven statistics; nulls take no part."""
    return _alone(df, stats_part(v))


def seasonal_part(month: Column, wet: tuple[int, ...] = (6, 7, 8, 9), v: str = "v", p: str = "") -> Part:
    inside = F.coalesce(month.isin(*wet), F.lit(False))
    of = lambda c, f: f(F.when(c, F.col(v)))
    aggregates = {f"{p}wet_mean": of(inside, F.avg), f"{p}wet_std": of(inside, F.stddev_pop), f"{p}dry_mean": of(~inside, F.avg), f"{p}dry_std": of(~inside, F.stddev_pop)}
    contrast = {"contrast": F.col(f"{p}dry_mean") - F.col(f"{p}wet_mean")}
    return Part(lambda d: d, aggregates, {n: F.col(p + n) for n in ("wet_mean", "wet_std", "dry_mean", "dry_std")} | contrast)


def seasonal(df: DataFrame, month: Column, wet: tuple[int, ...] = (6, 7, 8, 9), v: str = "v") -> DataFrame:
    return _alone(df, seasonal_part(month, wet, v))


def years_part(year: Column, first: int, second: int, v: str = "v", p: str = "") -> Part:
    """interannual() of two years that are known."""
    change = F.col(f"{p}b") - F.col(f"{p}a")
    aggregates = {p + n: F.avg(F.when(year == y, F.col(v))) for n, y in (("a", first), ("b", second))}
    return Part(lambda d: d, aggregates, {"year_diff": change, "stability": F.exp(-F.abs(change))})


def interannual(df: DataFrame, year: Column, v: str = "v") -> DataFrame:
    """Difference of the means of the first two years of a series, and exp(-|difference|)."""
    a = df.withColumn("__y", year).groupBy(*KEYS, "__y").agg(F.avg(v).alias("m"))
    first = a.withColumn("__k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("__y"))).where("__k <= 2")
    two = first.groupBy(*KEYS).agg(F.max(F.when(F.col("__k") == 1, F.col("m"))).alias("a"), F.max(F.when(F.col("__k") == 2, F.col("m"))).alias("b"), F.count("*").alias("n")).where("n = 2")
    return two.select(*KEYS, (F.col("b") - F.col("a")).alias("year_diff"), F.exp(-F.abs(F.col("b") - F.col("a"))).alias("stability"))


def shape_part(v: str = "v", p: str = "") -> Part:
    c = lambda n: F.col(p + n)
    moment = lambda k: F.avg(F.pow(F.col(v) - c("__m"), F.lit(k)))
    aggregates = {
        "mean": F.avg(v), "max": F.max(v), "min": F.min(v), "std": F.stddev_pop(v), "q": _quantiles(v), "n": F.count(v),
        "m2": moment(2), "m3": moment(3), "m4": moment(4), "auc": _area(v),
    }
    p10, p25, p50, p75, p90 = (F.get(c("q"), i) for i in range(5))
    enough = (c("n") > 3) & (c("m2") > 0)
    return Part(
        lambda d: d.withColumn(p + "__m", F.avg(v).over(series.whole())),
        {p + n: x for n, x in aggregates.items()},
        {n: c(n) for n in ("mean", "max", "min", "std")}
        | {"range": c("max") - c("min"), "p10": p10, "p25": p25, "p50": p50, "p75": p75, "p90": p90, "iqr": p75 - p25, "cv": _cv(c("mean"), c("std"))}
        | {
            "skewness": F.when(enough, F.try_divide(c("m3"), F.pow(c("m2"), F.lit(1.5)))).otherwise(0.0),
            "kurtosis": F.when(enough, F.try_divide(c("m4"), c("m2") * c("m2")) - 3).otherwise(0.0),
            "auc": c("auc"), "amplitude": c("max") - p10, "peak_trough": F.when(F.abs(p10) > EPS, p90 / (F.abs(p10) + EPS)).otherwise(0.0),
        },
    )


def shape(df: DataFrame, v: str = "v") -> DataFrame:
    """Seventeen statistics of a curve; skewness and excess kurtosis are biased, 0 with three values or fewer."""
    return _alone(df, shape_part(v))


def duration_part(thresholds: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7), v: str = "v", p: str = "") -> Part:
    tags = {f"{round(t * 10):02d}": t for t in thresholds}

    def along(d: DataFrame) -> DataFrame:
        for tag, t in tags.items():
            d = series.runs(d, F.col(v) > t, f"{p}__s{tag}")
        return d

    aggregates = {}
    for tag, t in tags.items():
        above = F.count_if(F.col(v) > t)
        aggregates |= {f"{p}above_{tag}": above, f"{p}frac_{tag}": above / F.count("*"), f"{p}streak_{tag}": F.max(f"{p}__s{tag}").cast("bigint")}
    green = F.when(F.col(v) > 0.5, F.col("step"))
    aggregates[f"{p}green_span"] = (F.coalesce(F.max(green), F.lit(0)) - F.coalesce(F.min(green).cast("bigint"), F.count("*"))).cast("bigint")
    return Part(along, aggregates, {n.removeprefix(p): F.col(n) for n in aggregates})


def duration(df: DataFrame, thresholds: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7), v: str = "v") -> DataFrame:
    """Steps, share of steps and longest run above each threshold, and the span from the first to the last
    step above 0.5 (minus the number of steps if there is none)."""
    return _alone(df, duration_part(thresholds, v))


def dynamics_part(v: str = "v", p: str = "") -> Part:
    c = lambda n: F.col(p + n)
    x, m = F.col(v), c("__m")

    def along(d: DataFrame) -> DataFrame:
        valid = Window.partitionBy(*KEYS, x.isNotNull()).orderBy("step")
        d = series.differences(d, v, p + "d1", p + "d2")
        return d.withColumns({p + "__m": F.avg(v).over(series.whole()), p + "__next": F.lead(v).over(valid), p + "__prev": F.lag(v).over(valid)})

    rise = x.isNotNull() & (x > m) & (c("__prev") <= m)
    aggregates = {
        "max_rise": F.max(c("d1")), "max_fall": F.min(c("d1")), "mean_abs_change": F.avg(F.abs(c("d1"))), "roughness": F.stddev_pop(c("d1")), "sd2": F.stddev_pop(c("d2")),
        "cov": F.sum((x - m) * (c("__next") - m)), "var": F.avg((x - m) * (x - m)), "n": F.count(v), "rises": F.count_if(rise),
    }
    lag1 = F.when((c("n") > 4) & (c("var") > EPS), F.try_divide(c("cov"), (c("n") - 1) * c("var"))).otherwise(0.0)
    features = {n: c(n) for n in ("max_rise", "max_fall", "mean_abs_change", "roughness")}
    features |= {"smoothness": 1 / (c("sd2") + EPS), "autocorr_lag1": lag1, "n_peaks": F.when(c("n") > 4, c("rises")).otherwise(0)}
    return Part(along, {p + n: a for n, a in aggregates.items()}, features)


def dynamics(df: DataFrame, v: str = "v") -> DataFrame:
    """Changes between steps, smoothness, lag-1 autocorrelation and number of rises above the mean. Nulls are
    removed before values are paired for the last two, which are 0 with four values or fewer."""
    return _alone(df, dynamics_part(v))


def phenology_part(threshold: float = 0.3, v: str = "v", p: str = "") -> Part:
    c = lambda n: F.col(p + n)

    def along(d: DataFrame) -> DataFrame:
        d = series.differences(d, v, p + "d1", p + "d2")
        d = d.withColumns({p + "__peak": F.max(v).over(series.whole()), p + "__above": F.coalesce(F.col(v) > threshold, F.lit(False))})
        before = series.order().rowsBetween(Window.unboundedPreceding, -1)
        first = F.coalesce(F.min(F.when(F.col(v) >= c("__peak") - 1e-9 * F.abs(c("__peak")), F.col("step"))).over(series.whole()), F.lit(0))
        return d.withColumns({p + "__i": first, p + "__last": F.last(F.when(c("__above"), F.col("step")), ignorenulls=True).over(before)})

    half = F.when((F.col("step") <= c("__i")) & (F.col(v) >= 0.5 * c("__peak")), F.col("step"))
    new = c("__above") & (c("__last").isNull() | (F.col("step") - c("__last") >= 3))
    aggregates = {
        "peak_value": F.max(v), "peak_idx": F.max(c("__i")), "greenup_half": F.coalesce(F.min(half), F.max(c("__i"))), "season_length": F.count_if(c("__above")), "n_seasons": F.count_if(new),
        "auc": _area(v), "max_rise": F.max(c("d1")), "max_fall": F.min(c("d1")), "p10": F.percentile(v, F.lit(0.1)), "sd2": F.stddev_pop(c("d2")),
    }
    features = {n: c(n) for n in ("auc", "peak_value", "peak_idx", "greenup_half", "max_rise", "max_fall", "season_length", "n_seasons")}
    features["amplitude"] = c("peak_value") - c("p10")
    features["asymmetry"] = F.when(c("season_length") > 0, (c("peak_idx") - c("greenup_half")) / (c("season_length") + EPS)).otherwise(0.0)
    features["smoothness"] = 1 / (c("sd2") + EPS)
    return Part(along, {p + n: a for n, a in aggregates.items()}, features)


def phenology(df: DataFrame, threshold: float = 0.3, v: str = "v") -> DataFrame:
    """Peak, green-up, season and growth features of a curve (usually filled and smoothed). The peak's step is the first
    that reaches it but for rounding."""
    return _alone(df, phenology_part(threshold, v))


def _anchored_part(phase: Callable[[int], Column], v: str, p: str) -> Part:
    early, peak, late = (F.col(p + n) for n in ("early", "peak", "late"))
    aggregates = {p + n: F.avg(F.when(phase(k), F.col(v))) for k, n in enumerate(("early", "peak", "late"))}
    return Part(lambda d: d, aggregates, {"early": early, "peak": peak, "late": late, "amp": peak - early, "rise": (peak - early) / 3, "fall": (peak - late) / 4})


def window_part(steps: int, v: str = "v", p: str = "") -> Part:
    q, mid = max(1, steps // 4), steps // 2
    spans = ((0, q - 1), (mid - 2, mid + 2), (steps - q, steps - 1))
    return _anchored_part(lambda k: F.col("step").between(*spans[k]), v, p)


def window_anchored(df: DataFrame, steps: int, v: str = "v") -> DataFrame:
    """Mean early, around the middle and late, and the differences between them."""
    return _alone(df, window_part(steps, v))


def month_anchored(df: DataFrame, month: Column, phases: tuple[tuple[int, ...], ...] = ((5,), (8, 9), (12, 1)), v: str = "v") -> DataFrame:
    """As window_anchored(), with calendar months for the early, middle and late phase."""
    return _alone(df, _anchored_part(lambda k: month.isin(*phases[k]), v, ""))


def radar_phenology(df: DataFrame, v: str = "v", share: float = 0.75) -> DataFrame:
    """Area, peak, steps above a threshold and spread of radar series. A band of which more than `share` of all
    values are negative is in decibels, with a threshold of -15, others of 0.1: one aggregate row for each band,
    joined back. Nulls count as 0 in the area and nowhere else."""
    steps = F.struct("step", F.coalesce(v, F.lit(0.0)).alias("v"))
    parts = df.groupBy("band").agg(F.coalesce(F.avg(F.when(F.col(v).isNotNull(), (F.col(v) < 0).cast("double"))) > share, F.lit(False)).alias("__db"))
    above = F.col(v) > F.when(F.col("__db"), -15.0).otherwise(0.1)
    return df.join(parts, "band").groupBy(*KEYS).agg(
        (F.sum(F.coalesce(v, F.lit(0.0))) - (F.min(steps)["v"] + F.max(steps)["v"]) / 2).alias("sar_auc"), F.max(v).alias("sar_peak_value"),
        F.count_if(above).alias("sar_season_length"), F.stddev_pop(v).alias("sar_std"),
    )


def harmonics_part(steps: int, v: str = "v", p: str = "") -> Part:
    c = lambda n: F.col(p + n)
    mean, x = F.avg(v).over(series.whole()), c("__x")
    waves = range(1, steps // 2 + 1)
    angle = lambda k: F.lit(2 * 3.141592653589793 / steps) * k * F.col("step")
    aggregates = {f"{p}re{k}": F.sum(x * F.cos(angle(k))) for k in waves} | {f"{p}im{k}": -F.sum(x * F.sin(angle(k))) for k in waves}
    amp = {k: F.sqrt(c(f"re{k}") * c(f"re{k}") + c(f"im{k}") * c(f"im{k}")) / steps for k in waves}
    total = sum((a * a for a in amp.values()), F.lit(0.0))
    share = {k: a * a / (total + EPS) for k, a in amp.items()}
    none = F.lit(None).cast("double")
    features = {f"amp{k}": amp.get(k, none) for k in (1, 2, 3)}
    features |= {f"phase{k}": F.atan2(c(f"im{k}"), c(f"re{k}")) if k in waves else none for k in (1, 2)}
    features |= {"dominance": share.get(1, none), "entropy": -sum((s * F.ln(s + EPS) for s in share.values()), F.lit(0.0))}
    return Part(lambda d: d.withColumn(p + "__x", F.coalesce(F.col(v), mean) - mean), aggregates, features)


def harmonics(df: DataFrame, steps: int, v: str = "v") -> DataFrame:
    """Amplitudes and phases of the discrete Fourier transform, dominance of the first and spectral entropy.
    Nulls take the series' mean."""
    return _alone(df, harmonics_part(steps, v))


def radar_structure(w: DataFrame, vv: str = "VV", vh: str = "VH") -> DataFrame:
    """Thirteen statistics of the radar bands and their ratios, of each entity of a wide table."""
    s = w.select("entity", indices.index("CR", VV=vv, VH=vh).alias("cr"), indices.index("RVI", VV=vv, VH=vh).alias("rvi"), F.col(vh).alias("vh"), F.col(vv).alias("vv"))
    two = [f(c).alias(f"{c}_{n}") for c in ("cr", "rvi", "vh", "vv") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    a = s.groupBy("entity").agg(*two, F.max("cr").alias("cr_max"), F.max("rvi").alias("rvi_max"), F.percentile("rvi", F.lit(0.75)).alias("rvi_p75"), F.count_if(F.col("rvi") > 0.7).alias("rvi_days_above_07"))
    return a.withColumn("vh_cv", F.when(F.abs("vh_mean") > EPS, F.col("vh_std") / (F.abs("vh_mean") + EPS)).otherwise(0.0))


def cross_sensor(w: DataFrame, ndvi: str = "NDVI", vv: str = "VV", vh: str = "VH") -> DataFrame:
    """Correlation of an index with both radar bands, and its ratio to one: one aggregate of a wide table."""
    ratio = F.try_divide(F.col(vh), F.col(ndvi) + EPS)
    with_vh, with_vv = _pairs(ndvi, vh, "h_"), _pairs(ndvi, vv, "v_")
    a = w.groupBy("entity").agg(*with_vh.aggregates, *with_vv.aggregates, F.avg(ratio).alias("ratio_mean"), F.stddev_pop(ratio).alias("ratio_std"))
    return a.select("entity", with_vh.r(5, 0.0).alias("corr_vh"), with_vv.r(5, 0.0).alias("corr_vv"), "ratio_mean", "ratio_std")


class _pairs:
    """Aggregates of pairs without nulls, and Pearson's r of them."""

    def __init__(self, x: str, y: str, p: str = ""):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
        of = {"n": F.count(a), "ma": F.avg(a), "mb": F.avg(b), "mab": F.avg(a * b), "sa": F.stddev_pop(a), "sb": F.stddev_pop(b)}
        self.aggregates, self.p = [c.alias(p + n) for n, c in of.items()], p

    def r(self, least: int, missing: float | None) -> Column:
        n, ma, mb, mab, sa, sb = (F.col(self.p + x) for x in ("n", "ma", "mb", "mab", "sa", "sb"))
        fine = (n >= least) & (sa >= EPS) & (sb >= EPS)
        return F.when(fine, F.try_divide(mab - ma * mb, sa * sb)).otherwise(F.lit(missing).cast("double"))


def correlation(df: DataFrame, x: str, y: str, by: list[str], least: int = 4, missing: float | None = None) -> DataFrame:
    """Pearson's r of pairs without nulls, `missing` with fewer than `least` pairs or without spread."""
    pairs = _pairs(x, y)
    return df.groupBy(*by).agg(*pairs.aggregates).select(*by, pairs.r(least, missing).alias("r"))


def tensor_aggregate(df: DataFrame, v: str = "v") -> DataFrame:
    a = [f(v) for f in (F.avg, F.stddev_pop, F.max, F.min)]
    return df.groupBy(*KEYS).agg(*[F.coalesce(x, F.lit(0.0)).alias(n) for x, n in zip(a, ("mean", "std", "max", "min"), strict=True)])


def tensor(df: DataFrame, v: str = "v") -> DataFrame:
    """Each series as one array in order of step."""
    return df.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("step", v))).alias("s")).select(*KEYS, F.col(f"s.{v}").alias("values"))


def cube(df: DataFrame, channels: list[str], v: str = "v", missing: float = 0.0) -> DataFrame:
    """Each entity as one array (steps, in order) of arrays (values of the channels, in the given order)."""
    of = [F.coalesce(F.max(F.when(F.col("band") == c, F.col(v))), F.lit(missing)).alias(f"c{k}") for k, c in enumerate(channels)]
    rows = df.groupBy("entity", "step").agg(*of).select("entity", F.struct("step", F.array(*[f"c{k}" for k in range(len(channels))]).alias("row")).alias("s"))
    return rows.groupBy("entity").agg(F.sort_array(F.collect_list("s")).alias("s")).select("entity", F.col("s.row").alias("cube"))


def clean_channels(df: DataFrame, steps: int, radar: tuple[str, ...] = ("VV", "VH"), v: str = "v", keep_missing: bool = False) -> DataFrame:
    """Series (entity, band, step, v) as a tensor takes them: gaps filled, then the median of three for radar bands and
    Savitzky-Golay for all others, a mask included. Series without any value are 0; of panels with fewer than five steps
    only the nulls become 0. With keep_missing a step without a value stays null, for models that mask steps."""
    own = df.withColumn("__own", F.col(v))
    if steps < 5:
        out = own.withColumn("__out", F.coalesce(F.col(v), F.lit(0.0)))
    else:
        filled = series.gap_fill(own, v).withColumn(v, F.coalesce(F.col(v), F.lit(0.0)))
        both = filled.withColumns({"__radar": F.col(v), "__other": F.col(v)})
        both = series.smooth(series.median3(both, "__radar"), "__other")
        out = both.withColumn("__out", F.when(F.col("band").isin(*radar), F.col("__radar")).otherwise(F.col("__other")))
    clean = F.when(F.col("__own").isNotNull(), F.col("__out")) if keep_missing else F.col("__out")
    return out.select("entity", "band", "step", clean.alias(v))


def to_long(df: DataFrame, prefix: str) -> DataFrame:
    """(entity, feature, value) of a table of features by entity and band, or by entity."""
    names = [c for c in df.columns if c not in KEYS]
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for n in names])
    keys = [k for k in KEYS if k in df.columns]
    name = F.concat_ws("_", F.lit(prefix), *keys[1:], "p.n")
    return df.select(*keys, F.explode(pairs).alias("p")).select("entity", name.alias("feature"), F.col("p.v").alias("value"))
