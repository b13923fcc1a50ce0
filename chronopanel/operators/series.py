"""Operators along the steps of a series: one entity and band, ordered by step.

All windows have the same partitions and order, so a chain of them shuffles and sorts once, and an
aggregation by entity and band after them not again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("entity", "band")
#: Rows of series that a task takes, some 1.2 KB each while features are made of them.
ROWS = 200_000


def spread(df: DataFrame, rows: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df (as many rows as given) by its keys in as many partitions as leave each about ROWS, one for each core at least:
    what a task holds does not grow with the table. Later windows and aggregates by these keys keep the partitions."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))
    return df.repartition(n, *keys)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Series by entity and band as spread(), sorted by step."""
    return spread(df, rows).sortWithinPartitions(*KEYS, "step")


def order() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("step")


def back() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead() -> WindowSpec:
    return order().rowsBetween(Window.currentRow, Window.unboundedFollowing)


def whole() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def at(v: str | Column, k: int) -> Column:
    """The value k steps ahead."""
    return F.lead(v, k).over(order()) if k > 0 else F.lag(v, -k).over(order()) if k else (F.col(v) if isinstance(v, str) else v)


def gap_fill(df: DataFrame, v: str = "v") -> DataFrame:
    """Nulls between values become linear in step, those at the ends the nearest value."""
    point = F.when(F.col(v).isNotNull(), F.struct(F.col("step").alias("s"), F.col(v).alias("v")))
    d = df.withColumns({"__p": F.last(point, ignorenulls=True).over(back()), "__n": F.first(point, ignorenulls=True).over(ahead())})
    p, n = F.col("__p"), F.col("__n")
    between = p["v"] + (n["v"] - p["v"]) * (F.col("step") - p["s"]) / (n["s"] - p["s"])
    filled = F.when(F.col(v).isNotNull(), F.col(v)).when(p.isNotNull() & n.isNotNull(), between).otherwise(F.coalesce(p["v"], n["v"]))
    return d.withColumn(v, filled).drop("__p", "__n")


#: Rows of the projection on quadratics over five points, times 35.
QUADRATIC = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3), (-5, 6, 12, 13, 9), (3, -5, -3, 9, 31))


def smooth(df: DataFrame, v: str = "v") -> DataFrame:
    """Savitzky-Golay of window 5 and order 2; the ends follow the quadratic of the first and last five.
    Series of fewer than five steps stay as they are (a quadratic through three points is exact)."""
    d = df.withColumns({"__i": F.row_number().over(order()) - 1, "__t": F.count("*").over(whole())})
    i, last = F.col("__i"), F.col("__t") - 1

    def fit(row: int) -> Column:
        return sum((w * at(v, k - row) for k, w in enumerate(QUADRATIC[row])), F.lit(0.0)) / 35

    out = F.when(F.col("__t") < 5, F.col(v)).when(i == 0, fit(0)).when(i == 1, fit(1)).when(i == last, fit(4)).when(i == last - 1, fit(3)).otherwise(fit(2))
    return d.withColumn("__s", out).drop(v, "__i", "__t").withColumnRenamed("__s", v)


def median3(df: DataFrame, v: str = "v") -> DataFrame:
    """Median of three with zeros beyond the ends."""
    a, b, c = F.coalesce(at(v, -1), F.lit(0.0)), F.col(v), F.coalesce(at(v, 1), F.lit(0.0))
    return df.withColumn(v, F.when(b.isNotNull(), F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))))


def differences(df: DataFrame, v: str = "v", d1: str = "d1", d2: str = "d2") -> DataFrame:
    """d1: change from the step before; d2: second difference around the step."""
    return df.withColumns({d1: F.col(v) - at(v, -1), d2: at(v, 1) - 2 * F.col(v) + at(v, -1)})


def runs(df: DataFrame, above: Column, name: str = "streak") -> DataFrame:
    """name: length so far of the run of steps for which `above` holds."""
    d = df.withColumns({"__a": F.coalesce(above, F.lit(False)), "__i": F.row_number().over(order())})
    broken = F.coalesce(F.last(F.when(~F.col("__a"), F.col("__i")), ignorenulls=True).over(back()), F.lit(0))
    return d.withColumn(name, F.when(F.col("__a"), F.col("__i") - broken).otherwise(0)).drop("__a", "__i")
