"""Exact quantiles of groups of any size: no group's values come to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.session import checkpointed

#: Of the sketches that say where a quantile is; they err by n / ACCURACY ranks.
ACCURACY = 10_000
RANGES = 1024
#: Groups of at most so many rows are sorted in one task.
ROWS = 1 << 16


def _selected(values: DataFrame, sizes: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """g, k and value for each group and k-th probability: the values between lo and hi are counted in ranges, and
    what stands below them too. Without a value where the rank is not between lo and hi."""
    spans = sizes.select("g", "n", F.posexplode("spans").alias("k", "span")).select("g", "k", "n", "span.*")
    one = F.array(*[F.lit(p) for p in probs])
    spans = spans.withColumn("at", (F.col("n") - 1) * F.get(one, F.col("k"))).withColumns({"t0": F.floor("at"), "t1": F.ceil("at")})
    near = values.join(F.broadcast(spans.select("g", "k", "lo", "hi")), "g").where("v <= hi")
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0))
    counted = near.select("g", "k", F.when(F.col("v") < F.col("lo"), F.lit(-1)).otherwise(place).alias("r"), F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
    counted = checkpointed(counted.groupBy("g", "k", "r", "v").agg(F.count("*").alias("m")))
    upto = Window.unboundedPreceding, -1
    totals = counted.groupBy("g", "k", "r").agg(F.sum("m").alias("m"))
    before = totals.select("g", "k", "r", F.coalesce(F.sum("m").over(Window.partitionBy("g", "k").orderBy("r").rowsBetween(*upto)), F.lit(0)).alias("before"), F.col("m").alias("size"))
    wanted = before.join(F.broadcast(spans.select("g", "k", "t0", "t1")), ["g", "k"]).where("r >= 0 and before <= t1 and before + size > t0")
    own = counted.join(wanted, ["g", "k", "r"])
    own = own.withColumn("b", F.col("before") + F.coalesce(F.sum("m").over(Window.partitionBy("g", "k", "r").orderBy("v").rowsBetween(*upto)), F.lit(0)))
    at = lambda t: F.max(F.when((F.col("b") <= F.col(t)) & (F.col("b") + F.col("m") > F.col(t)), F.col("v")))
    ends = own.groupBy("g", "k").agg(at("t0").alias("v0"), at("t1").alias("v1"))
    part = F.col("at") - F.col("t0")
    return spans.join(ends, ["g", "k"], "left").select("g", "k", "n", (F.col("v0") + (F.col("v1") - F.col("v0")) * part).alias("value"))


def quantiles(df: DataFrame, by: list[str], v: str, probs: dict[str, float], rows: int = ROWS) -> DataFrame:
    """by and for each name the quantile of v at that probability, linear between ranks; null where a group has no
    value. Null and NaN values take no part; null groups are groups.

    Groups of at most `rows` rows are sorted in one task each. For larger ones a sketch gives a narrow range around
    each rank; what lies below it is counted, what lies in it is counted by value. Where a sketch erred too far its
    whole group is the range. The ranges that are sent to all tasks are those of groups above `rows` rows."""
    names, ps = list(probs), tuple(probs.values())
    value = F.col(v).cast("double")
    values = df.select(F.struct(*by).alias("g") if by else F.struct(F.lit(0).alias("all")).alias("g"), F.when(~F.isnan(value), value).alias("v"))
    e = 4 / ACCURACY
    cuts = [min(1.0, max(0.0, p + d)) for p in ps for d in (-e, e)]
    sizes = values.groupBy("g").agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, cuts)), F.lit(ACCURACY)).alias("q"), F.min("v").alias("least"), F.max("v").alias("most"))
    sizes = checkpointed(sizes)
    large = sizes.where(F.col("n") > rows)
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    exact = [F.percentile("v", F.lit(p)).alias(n) for n, p in zip(names, ps, strict=True)]
    if large.isEmpty():
        found = values.groupBy("g").agg(*exact)
    else:
        small = values.join(F.broadcast(large.select("g")), "g", "left_anti").groupBy("g").agg(*exact)
        first = large.select("g", "n", F.array(*[span(F.get("q", 2 * i), F.get("q", 2 * i + 1)) for i in range(len(ps))]).alias("spans"))
        picked = checkpointed(_selected(values, first, ps))
        missed = picked.where("value is null").select("g").distinct()
        if not missed.isEmpty():
            whole = large.join(missed, "g").select("g", "n", F.array(*[span(F.col("least"), F.col("most"))] * len(ps)).alias("spans"))
            again = _selected(values, whole, ps)
            picked = picked.join(missed, "g", "left_anti").unionByName(again)
        of = [F.max(F.when(F.col("k") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
        found = small.unionByName(picked.groupBy("g").agg(*of))
    return found.select(*[F.col("g")[c].alias(c) for c in by], *names)
