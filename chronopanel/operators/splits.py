"""Balancing and leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.session import checkpointed

#: Rows that a task takes of groups that are dealt out.
ROWS = 200_000


def largest_per_group(df: DataFrame, by: list[str], size: str, tie: str) -> DataFrame:
    """The row of largest size of each group, ties to the smallest `tie`; reduced before the shuffle."""
    other = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*other), F.struct(F.col(size), -F.col(tie))).alias("b"))
    return best.select(*by, "b.*")


def drawn(key: str, seed: int) -> Column:
    """A hash of seed and key that other engines have too: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _number(h: Column) -> Column:
    """The first 32 bits of a drawn hash."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def first_drawn(df: DataFrame, by: list[str], key: str, wanted: Column, seed: int = 42) -> DataFrame:
    """df with `chosen`: whether the row is among the first `wanted` rows of its group in the order of a seeded hash of the
    key. wanted is made from `n`, the group's rows, and the group itself, `__g`.

    Rows are counted in 4,096 ranges of the hash; all of the ranges below the wanted place are chosen, none above, and only
    rows of the range that holds it are sorted, a group's range a task. Groups are few enough that a row for each of
    their ranges fits a shuffle; null groups are groups."""
    group, kept = F.struct(*by) if by else F.struct(F.lit(0).alias("all")), df.drop("chosen")
    rows = kept.withColumns({"__g": group, "__h": drawn(key, seed)}).withColumn("__b", F.coalesce(F.shiftright(_number(F.col("__h")), 20), F.lit(-1)))
    counts = rows.groupBy("__g", "__b").agg(F.count("*").alias("__m"))
    upto, whole = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__g")
    counts = counts.select("__g", "__b", "__m", F.coalesce(F.sum("__m").over(upto), F.lit(0)).alias("__before"), F.sum("__m").over(whole).alias("n"))
    counts = counts.select("__g", "__b", (wanted - F.col("__before")).alias("__left"), "__m")
    edge = counts.where("__left > 0 and __left < __m").select("__g", "__b", "__left")
    whole_ranges = counts.where("__left >= __m").select("__g", "__b", F.lit(True).alias("__all"))
    marked = rows.join(whole_ranges.unionByName(edge.withColumn("__all", F.lit(False)), allowMissingColumns=True), ["__g", "__b"], "left")
    place = F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__h", key))
    inner = marked.where("not __all").withColumn("chosen", place <= F.col("__left"))
    outer = marked.where("__all is null or __all").withColumn("chosen", F.coalesce("__all", F.lit(False)))
    return inner.unionByName(outer).select(*kept.columns, "chosen")


def balance(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each label, in the order of a seeded hash of the key."""
    return first_drawn(df, [label], key, F.lit(n), seed).where("chosen").drop("chosen")


def balance_ratio(df: DataFrame, label: str, key: str, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """All rows of label 1, and of label 0 a drawn number: `ratio` times those of label 1 (rounded down), or all if fewer.
    Rows without a label go."""
    kept = df.where(F.col(label).isin(0, 1))
    n1 = kept.agg(F.count_if(F.col(label) == 1)).first()[0]
    wanted = F.when(F.col(f"__g.{label}") == 1, F.col("n")).otherwise(F.lit(int(ratio * n1)))
    return first_drawn(kept, [label], key, wanted, seed).where("chosen").drop("chosen")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: the place (bigint, from 0) of each row in the given order, without a task that sees all
    rows. Rows are dealt out by range and sorted within partitions; a row's place is its partition's start,
    from one count for each partition, and its place there."""
    kept = df.drop(name)
    dealt = checkpointed(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    own = dealt.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = own.join(F.broadcast(starts), "__part")  # a row for each partition
    return joined.select(*kept.columns, (F.col("__start") + F.col("__at")).alias(name))


def sequential_ids(df: DataFrame, label: str, order: str) -> DataFrame:
    """df with plot_id: pos_ or neg_ and the row's place among those of its label."""
    n = numbered(df, [label, order], "__i")
    first = n.groupBy(label).agg(F.min("__i").alias("__first"))
    place = (F.col("__i") - F.col("__first")).cast("string")
    padded = F.when(F.length(place) < 4, F.lpad(place, 4, "0")).otherwise(place)
    first = first.withColumnRenamed(label, "__label")  # one row for each label, one of which may be null
    return n.join(first, n[label].eqNullSafe(first["__label"])).withColumn("plot_id", F.concat_ws("_", F.when(F.col(label) == 1, "pos").otherwise("neg"), padded)).select(*df.columns, "plot_id")


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """df with `fold`: groups stay whole; they are dealt out in turn, in order of their share of positives,
    their size and a seeded hash, so that folds resemble each other. Rows without a group are a group."""
    g = df.groupBy(group).agg(F.avg(label).alias("__share"), F.count("*").alias("__n")).withColumn("__h", drawn(group, seed))
    placed = numbered(g, ["__share", "__n", "__h", group], "__i")
    placed = placed.select(F.col(group).alias("__group"), F.pmod("__i", F.lit(folds)).cast("int").alias("fold"))
    kept = df.drop("fold")
    return kept.join(placed, kept[group].eqNullSafe(placed["__group"])).drop("__group")


def block_folds(df: DataFrame, block: Column, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """df with `fold`: rows of one spatial block stay together, dealt out as in group_folds()."""
    return group_folds(df.withColumn("__block", block), "__block", label, folds, seed).drop("__block")


def _placed(counts: list[tuple[int, ...]], scale: list[float], folds: int) -> list[int]:
    """The fold of each group, taken in the given order: that whose counts, scaled, then deviate least."""
    have, chosen = [[0.0] * len(scale) for _ in range(folds)], []
    for of in counts:
        own = [c * s for c, s in zip(of, scale, strict=True)]
        k = min(range(folds), key=lambda f: (sum((h + o) ** 2 - h * h for h, o in zip(have[f], own, strict=True)), have[f][0], f))
        have[k] = [h + o for h, o in zip(have[k], own, strict=True)]
        chosen.append(k)
    return chosen


def exchanged(counts: list[tuple[int, ...]], chosen: list[int], folds: int) -> list[int]:
    """chosen, with groups moved or exchanged between two folds as long as folds differ in some count by more than the
    largest group has of it, and a step lessens that. Where none is left that does, it stays."""
    chosen, kinds = list(chosen), range(len(counts[0]) if counts else 0)
    most = [max(1, max(c[i] for c in counts)) for i in kinds]
    have = [[0] * len(kinds) for _ in range(folds)]
    for own, k in zip(counts, chosen, strict=True):
        have[k] = [h + o for h, o in zip(have[k], own, strict=True)]

    def excess(of: list[list[int]]) -> tuple[float, float]:
        spread = [(max(h[i] for h in of) - min(h[i] for h in of)) / most[i] for i in kinds]
        return sum(max(0.0, s - 1) for s in spread), sum(s * s for s in spread)

    now = excess(have)
    while now[0] > 0:
        worst = max(kinds, key=lambda i: (max(h[i] for h in have) - min(h[i] for h in have)) / most[i])
        ends = {max(range(folds), key=lambda f: have[f][worst]), min(range(folds), key=lambda f: have[f][worst])}
        best = None
        members = {f: dict.fromkeys(counts[g] for g in range(len(counts)) if chosen[g] == f) for f in range(folds)}
        for a, b in ((a, b) for a in range(folds) for b in range(folds) if a != b and (a in ends or b in ends)):
            for x in members[a]:
                for y in (None, *members[b]):
                    change = [p - q for p, q in zip(x, y or [0] * len(x), strict=True)]
                    after = list(have)
                    after[a] = [h - c for h, c in zip(have[a], change, strict=True)]
                    after[b] = [h + c for h, c in zip(have[b], change, strict=True)]
                    then = excess(after)
                    if then < now and (best is None or then < best[0]):
                        best = (then, a, b, x, y, after)
        if best is None:
            return chosen
        now, a, b, x, y, have = best
        one = next(g for g in range(len(counts)) if chosen[g] == a and counts[g] == x)
        other = None if y is None else next(g for g in range(len(counts)) if chosen[g] == b and counts[g] == y)
        chosen[one] = b
        if other is not None:
            chosen[other] = a
    return chosen


def balanced_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42, large: int = 4096) -> DataFrame:
    """df with `fold`: groups stay whole; each goes, largest first, to the fold whose counts of labels then deviate least.

    Only totals of groups are looked at. The `large` largest are placed one by one on the driver, and exchanged where folds
    differ in rows or a label by more than the largest group has of these; the rest, none of which
    is larger, are dealt out in turn in order of their labels and size, beginning with the fold that has fewest rows. So
    the largest fold exceeds the smallest by a few of the largest groups at most. Rows without a label count in sizes."""
    labels = sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)
    totals = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"), *[F.count_if(F.col(label) == y).alias(f"__l{i}") for i, y in enumerate(labels)])
    totals = checkpointed(totals.withColumn("__h", drawn("__group", seed)))
    order = [F.desc("__n"), *[F.desc(f"__l{i}") for i in range(len(labels))], "__h", "__group"]
    top = totals.orderBy(*order).limit(large).collect()
    whole = totals.agg(F.sum("__n").alias("n"), *[F.sum(f"__l{i}").alias(f"l{i}") for i in range(len(labels))]).first()
    scale = [1 / max(1, x or 0) for x in whole]
    counts = [(r["__n"], *(r[f"__l{i}"] for i in range(len(labels)))) for r in top]
    chosen = exchanged(counts, _placed(counts, scale, folds), folds)
    have = [[0] for _ in range(folds)]
    for own, k in zip(counts, chosen, strict=True):
        have[k][0] += own[0]
    placed = [(r["__h"], r["__group"], k) for r, k in zip(top, chosen, strict=True)]
    kind = totals.schema["__group"].dataType.simpleString()
    first = df.sparkSession.createDataFrame(placed, f"__h string, __group {kind}, __fold int")  # `large` rows at most
    match = totals["__h"].eqNullSafe(first["__h"]) & totals["__group"].eqNullSafe(first["__group"])
    rest = totals.join(F.broadcast(first), match, "left_anti")
    turn = sorted(range(folds), key=lambda f: (have[f][0], f))
    dealt = numbered(rest, [*[f"__l{i}" for i in range(len(labels))], "__n", "__h", "__group"], "__i")
    dealt = dealt.select("__group", F.get(F.array(*map(F.lit, turn)), F.pmod("__i", F.lit(folds)).cast("int")).alias("__fold"))
    found = first.select("__group", "__fold").unionByName(dealt).withColumnRenamed("__fold", "fold")
    kept = df.drop("fold")
    return kept.join(found, kept[group].eqNullSafe(found["__group"])).drop("__group")


def balanced_block_folds(df: DataFrame, block: Column, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """balanced_folds() of spatial blocks; of few blocks only half as many folds are made, at least two."""
    rows = df.withColumn("__block", block)
    blocks = rows.select("__block").distinct().count()
    return balanced_folds(rows, "__block", label, min(folds, max(2, blocks // 2)), seed).drop("__block")


def leave_one_out(df: DataFrame, plot: str, label: str) -> DataFrame:
    """Fold table: each positive plot is held out once."""
    plots = df.where(F.col(label) == 1).select(F.col(plot).alias("held_out")).distinct()
    return numbered(plots, ["held_out"], "fold").withColumn("fold", F.col("fold").cast("int"))


def _paired(df: DataFrame, plots: DataFrame, plot: str, suffix: str) -> tuple[DataFrame, DataFrame, Column]:
    """df with the plot that a row goes with (its own, or that whose local negative it is), the plots, and their match."""
    base = F.when(F.col(plot).cast("string").endswith(suffix), F.left(F.col(plot), F.length(plot) - len(suffix)))
    own = df.withColumn("__own", F.col(plot).cast("string")).withColumn("__base", F.coalesce(base, F.col("__own")))
    held = plots.select(F.col("held_out").cast("string").alias("__held"), *[c for c in plots.columns if c != "held_out"])
    return own, held, own["__base"] == held["__held"]


def reserve(df: DataFrame, plots: DataFrame, plot: str, suffix: str = "_local_neg") -> tuple[DataFrame, DataFrame]:
    """Rows of the plots (column held_out) and of their local negatives, and all other rows: a semi and an anti join."""
    own, held, match = _paired(df, plots, plot, suffix)
    return tuple(own.join(held, match, f"left_{how}").drop("__own", "__base") for how in ("semi", "anti"))


def leave_one_out_rows(df: DataFrame, plot: str, label: str, suffix: str = "_local_neg") -> DataFrame:
    """df with `fold`: that in which the row is held out, with its positive plot or as one of the plot's local
    negatives; null for rows that are never held out."""
    own, held, match = _paired(df.drop("fold"), leave_one_out(df, plot, label), plot, suffix)
    return own.join(held, match, "left").drop("__own", "__base", "__held")


def round_robin(df: DataFrame, windows: int, order: str, name: str = "window") -> DataFrame:
    """df with rows dealt to windows in turn, in the given order."""
    return numbered(df, [order], name).withColumn(name, F.pmod(F.col(name), F.lit(windows)).cast("int"))


def leaks(names: DataFrame, column: str, tokens: list[str]) -> DataFrame:
    """names with `leak`: whether the name or one of its parts between underscores is a token."""
    hit = F.col(column).isin(*tokens) | F.exists(F.split(column, "_"), lambda x: x.isin(*tokens))
    return names.withColumn("leak", hit)


def align(df: DataFrame, features: list[str]) -> DataFrame:
    """Just these features in this order; missing ones, nulls, NaN and infinities become 0."""
    fixed = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c))
    return df.select("entity", *[(fixed(c) if c in df.columns else F.lit(0.0)).cast("double").alias(c) for c in features])


def first_rows(df: DataFrame, by: list[str], order: list[str | Column], n: int, distinct: bool = False) -> DataFrame:
    """The first n rows of each group; with `distinct` equal rows are one. The limit is part of the feature: a cap on the
    pixels of a plot.

    Groups are counted, then dealt out whole, some ROWS rows to a task. A group of more than a quarter of that is cut into
    such quarters by a hash of its rows' order, and the first n of each of these meet."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sizes = checkpointed(df.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("__parts", F.ceil(F.col("__n") / (ROWS // 4))))
    rows, left, parts = sizes.agg(F.sum("__n"), F.sum(F.least(F.col("__n"), F.col("__parts") * n)), F.max("__parts")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism

    def first(x: DataFrame, keys: list[str], count: int, distinct: bool) -> DataFrame:
        dealt = x.repartition(max(cores, -(-count // ROWS)), *keys)
        dealt = dealt.distinct() if distinct else dealt
        return dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")

    if (parts or 0) <= 1:
        return first(df, by, rows or 0, distinct)
    large = sizes.where("__parts > 1").select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], "__parts")
    match = F.lit(True)
    for k, c in enumerate(by):
        match = match & df[c].eqNullSafe(large[f"__{k}"])
    part = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*order), F.col("__parts"))).otherwise(0)
    dealt = df.join(F.broadcast(large), match, "left").select(*df.columns, part.alias("__part"))  # a large group has ROWS / 4 rows at least
    return first(first(dealt, [*by, "__part"], rows, distinct).drop("__part"), by, left, False)


def hold_out(df: DataFrame, column: str, values: list, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """df with `split`: test where the column is one of the values; of the rest a drawn share, and one row at least, is
    validation (none if the share is 0). Rows whose column is null are no test rows."""
    tested = df.withColumn("__test", F.coalesce(F.col(column).isin(*values), F.lit(False)))
    wanted = F.when(F.col("__g.__test"), 0).otherwise(F.greatest(F.lit(int(share > 0)), F.floor(F.col("n") * share)))
    drawn_rows = first_drawn(tested, ["__test"], key, wanted, seed)
    return drawn_rows.withColumn("split", F.when(F.col("__test"), "test").when(F.col("chosen"), "validation").otherwise("train")).drop("__test", "chosen")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right by key, which is unique there; a key that is missing there fails the job."""
    found = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean")
    return found.where(F.coalesce("__there", missing)).drop("__there")
