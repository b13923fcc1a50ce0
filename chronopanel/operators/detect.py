"""From a feature table to a verdict of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions import scalars
from chronopanel.operators import metrics, ml, splits


def verdicts(scored: DataFrame, by: list[str], threshold: float = 0.6, valid: str | None = None) -> DataFrame:
    """by, the summary of the scores, verdict and data_quality. valid: a column with the percentage of steps
    with enough observations, of which the mean counts; without it the quality is unknown."""
    found = metrics.prediction_summary(scored, by, threshold)
    pct = scored.groupBy(*by).agg((F.avg(valid) if valid else F.lit(None).cast("double")).alias("__pct"))
    pct = pct.select(*[F.col(b).alias(f"__{b}") for b in by], "__pct")
    same = None
    for b in by:
        equal = found[b].eqNullSafe(pct[f"__{b}"])
        same = equal if same is None else same & equal
    joined = found.join(pct, same) if by else found.crossJoin(pct)  # one row each
    verdict = scalars.verdict(F.col("mean_proba"), F.col("fraction") * 100)
    return joined.select(*found.columns, verdict.alias("verdict"), scalars.data_quality(F.col("__pct")).alias("data_quality"))


def detect(model, table: DataFrame, features: list[str], by: list[str] | None = None, threshold: float = 0.6, valid: str | None = None) -> DataFrame:
    """Verdicts of a wide feature table (entity and features) by a fitted pyspark.ml model. Features that are
    missing there, nulls and non-finite values are 0, others are ignored. by: entity, unless given."""
    by = by or ["entity"]
    kept = [c for c in dict.fromkeys([*by, *([valid] if valid else [])]) if c != "entity"]
    aligned = splits.align(table, features)
    if kept:
        aligned = aligned.join(table.select("entity", *kept), "entity")
    return verdicts(ml.probability(model, ml.assemble(aligned, features)), by, threshold, valid)
