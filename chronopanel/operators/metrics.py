"""Evaluation of binary scores. All take columns y (0/1) and score, and keys `by` (may be empty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.session import checkpointed


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts, row percentages, accuracy, F1 by class and their mean, kappa and Brier score."""
    y, p = F.col("y") == 1, F.col("score") >= threshold
    c = df.groupBy(*by).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"), F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    f1, f0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fp + fn)
    po, pe = _div(tp + tn, n), _div((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    return c.select(*by, "tn", "fp", "fn", "tp", F.round(100 * _div(tp, tp + fn), 2).alias("recall_pct"), F.round(100 * _div(tn, tn + fp), 2).alias("specificity_pct"), po.alias("accuracy"), f1.alias("f1_pos"), f0.alias("f1_neg"), ((f1 + f0) / 2).alias("macro_f1"), _div(po - pe, 1 - pe).alias("kappa"), "brier")


def _curve(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts at each distinct score and cumulated from the highest, by key. Only distinct scores reach the windows. They
    are dealt out by sampled ranges of keys and scores, so no task sees a whole key, wherever rows or scores bunch: sums
    run within ranges and are carried on by the ranges' totals, a row for each key and range that meet."""
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)  # nulls in a struct are equal
    s = df.groupBy(key.alias("__k"), "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    order = ["__k", F.desc("score")]
    s = checkpointed(s.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__b", F.spark_partition_id()))
    down = Window.partitionBy("__k", "__b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__k")
    ranges = s.groupBy("__k", "__b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ranges = ranges.select("__k", "__b", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"__{c}") for c in "pn"], F.sum("p").over(whole).alias("P"), F.sum("n").over(whole).alias("N"))
    run = s.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    carried = {"tp": F.col("tp") + F.col("__p"), "fp": F.col("fp") + F.col("__n")}
    keys = [F.col("__k")[c].alias(c) for c in by]
    return run.join(ranges, ["__k", "__b"]).withColumns(carried).select(*keys, "score", "pos", "neg", "tp", "fp", "P", "N")


def curve(df: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos, neg, tp, fp, n_pos and n_neg: of each distinct score the rows of both classes there and at or above
    it, and those of the key. Rows without a label count in no class; an empty table gives no rows."""
    return _curve(df, by).withColumnsRenamed({"P": "n_pos", "N": "n_neg"})


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Mann-Whitney with mid-ranks; null if one class is missing."""
    c = _curve(df, by)
    won = F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2)
    return c.groupBy(*by).agg(F.try_divide(F.sum(won), (F.max("P") * F.max("N")).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    c = _curve(df, by)
    step = F.try_divide(F.col("pos").cast("double"), F.col("P").cast("double")) * F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    return c.groupBy(*by).agg(F.sum(step).alias("pr_auc"))


def youden(df: DataFrame, by: list[str], cap: float = 0.6) -> DataFrame:
    """The highest threshold of largest TPR - FPR, at most `cap`; 0.5 if one class is missing."""
    c = _curve(df, by).withColumn("j", F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")) - F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double")))
    c = c.withColumn("j", F.round("j", 12))
    best = c.groupBy(*by).agg(F.max(F.struct("j", "score")).alias("b"), F.max("P").alias("P"), F.max("N").alias("N"))
    t = F.when(F.col("b.j") <= 0, 1.0).otherwise(F.col("b.score"))
    return best.select(*by, F.when((F.col("P") == 0) | (F.col("N") == 0), 0.5).otherwise(F.least(F.greatest(t, F.lit(0.0)), F.lit(cap))).alias("threshold"))


def summarize_folds(folds: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return folds.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def summed_confusion(folds: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts summed over folds, their row percentages and the number of folds."""
    a = folds.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")], F.count("*").alias("n_folds"))
    pct = lambda c, *of: F.round(100 * _div(F.col(c), F.greatest(F.col(of[0]) + F.col(of[1]), F.lit(1))), 2).alias(f"{c}_pct")
    return a.select("*", pct("tn", "tn", "fp"), pct("fp", "tn", "fp"), pct("fn", "fn", "tp"), pct("tp", "fn", "tp"))


def prediction_summary(df: DataFrame, by: list[str], threshold: float = 0.6) -> DataFrame:
    share = F.avg((F.col("score") >= threshold).cast("double"))
    return df.groupBy(*by).agg(F.avg("score").alias("mean_proba"), F.max("score").alias("max_proba"), F.min("score").alias("min_proba"), share.alias("fraction"), (share >= 0.5).cast("int").alias("predicted"))


def best(summary: DataFrame, name: str, score: str) -> DataFrame:
    """One row: the model of the largest score, ties to the first name. Null scores come last."""
    top = F.max_by(F.struct(*summary.columns), F.struct(F.coalesce(score, F.lit(float("-inf"))), _last_first(name)))
    return summary.agg(top.alias("b")).select("b.*")


def _last_first(name: str) -> Column:
    """An array of which the largest is that of the smallest name: its characters' codes, negated, and an end."""
    return F.concat(F.transform(F.split(F.col(name).cast("string"), ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))
