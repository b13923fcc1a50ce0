"""Regular windows, composites, masks and data quality of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_grid(df: DataFrame, start: str, end: str, days: int = 15) -> DataFrame:
    """df with a row for each window [window_start, window_end) that begins before end; the last may overrun."""
    starts = F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr(f"interval {days} days"))
    out = df.where(F.col(start) < F.col(end)).select("*", F.posexplode(starts).alias("window_idx", "window_start"))
    return out.withColumn("window_end", F.date_add("window_start", days))


def composite(obs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median and count of value for each key."""
    return obs.groupBy(*keys).agg(F.median(value).alias("v"), F.count(value).alias("n"))


def densify(panel: DataFrame, steps: int, bands: list[str]) -> DataFrame:
    """A row for every entity, band and step; v is null and n 0 where nothing was observed. Each entity's
    grid is generated from the entity, so nothing but its own rows meets it."""
    entities = panel.select("entity").distinct()
    grid = entities.select("entity", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band")).select("entity", "band", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    return grid.join(panel, ["entity", "band", "step"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mask_few(v: str = "v", n: str = "n", least: int = 5) -> Column:
    return F.when(F.col(n) >= least, F.col(v))


def pixel_mask(scene: Column, cloud: Column, flags: Column, threshold: float = 30, classes: tuple[int, ...] = (4, 5, 6, 7), bits: tuple[int, ...] = (10, 11)) -> Column:
    """Scene class is allowed, cloud probability below the threshold and none of the flag bits set."""
    clear = [F.shiftright(flags, b).bitwiseAND(F.lit(1)) == 0 for b in bits]
    out = scene.isin(*classes) & (cloud < threshold)
    for c in clear:
        out = out & c
    return out


def quality_summary(grid: DataFrame, least: int = 5) -> DataFrame:
    """Percentage of an entity's steps with enough observations, and counts of cloudy and all steps."""
    ok = F.col("n") >= least
    return grid.groupBy("entity").agg((F.avg(ok.cast("double")) * 100).alias("pct_valid"), F.count_if(~ok).alias("n_cloudy"), F.count("*").alias("n_total"))


def extract(obs: DataFrame, steps: int, bands: list[str], counted: str, least: int = 5) -> DataFrame:
    """A row for each entity and step of its grid: the masked median of each band, n_valid (observations of the
    band `counted`) and the entity's quality summary by that band."""
    grid = densify(composite(obs, ["entity", "band", "step"]), steps, bands).withColumn("v", mask_few(least=least))
    of = [F.max(F.when(F.col("band") == b, F.col("v"))).alias(b) for b in bands]
    wide = grid.groupBy("entity", "step").agg(*of, F.max(F.when(F.col("band") == counted, F.col("n"))).alias("n_valid"))
    return wide.join(quality_summary(grid.where(F.col("band") == counted), least), "entity")


def gap_fraction(df: DataFrame, entity: str, mask: Column) -> DataFrame:
    return df.groupBy(entity).agg((1 - F.avg(F.coalesce(mask.cast("double"), F.lit(0.0)))).alias("gap_fraction"))


def linear_if_db(panel: DataFrame, test: str = "VV", columns: tuple[str, ...] = ("VV", "VH"), share: float = 0.75) -> DataFrame:
    """Columns turned from decibel to linear in each step where more than `share` of `test` are negative.

    The share is an aggregate over all entities of a step: one row for each step, joined back, so that no
    task sees a whole step."""
    parts = panel.groupBy("step").agg(F.avg(F.when(F.col(test).isNotNull(), (F.col(test) < 0).cast("double"))).alias("__share"))
    joined = panel.join(parts, "step", "left")
    return joined.withColumns({c: F.when(F.col("__share") > share, F.pow(F.lit(10.0), F.col(c) / 10)).otherwise(F.col(c)) for c in columns}).drop("__share")


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """Inner join with the first row of right for each key, in order of `order`; right is reduced before it is shuffled."""
    others = [c for c in right.columns if c not in on]
    first = right.groupBy(*on).agg(F.min_by(F.struct(*others), order).alias("__first"))
    return left.join(first, on).select(left["*"], "__first.*")


def step_of_dates(df: DataFrame, entity: str, date: str) -> DataFrame:
    """df with `step`: the rank of the date among the entity's dates, from 0."""
    return df.withColumn("step", F.dense_rank().over(Window.partitionBy(entity).orderBy(date)) - 1)


def legacy_mask(scene: Column, flags: Column, excluded: tuple[int, ...] = (1, 2, 3, 8, 9, 10), bits: tuple[int, ...] = (10, 11)) -> Column:
    """The older pixel mask: excluded classes instead of allowed ones, and no cloud probability."""
    return ~scene.isin(*excluded) & (flags.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0)


def optical_flag(scene: Column, classes: tuple[int, ...] = (4, 5, 6, 7, 11)) -> Column:
    return F.coalesce(scene.isin(*classes), F.lit(False)).cast("int")
