"""One saved plan from a feature table to a verdict: alignment, model, score and verdict as stages of a PipelineModel.

The stages are `pyspark.ml` transformers with their parameters as their whole state, so a pipeline of them and a fitted
model is saved and loaded as one, by `PipelineModel`'s own writer and reader, and carries the schema it was trained on.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import detect, ml, selection


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _Saved(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def _put(self, **kwargs):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})


def _clean(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)


class Align(_Saved):
    """features: the named values in this order, as a vector. What is missing, null or not finite is 0, other columns are
    ignored. The table has the names as columns; or, with `source`, an array `values` in the order of those names."""

    names = _param("names", "features of the model, in order", TypeConverters.toListString)
    source = _param("source", "names of the elements of the array `values`, if the table has that", TypeConverters.toListString)

    def __init__(self, names: list[str] | None = None, source: list[str] | None = None):
        super().__init__()
        self._setDefault(source=[])
        self._put(names=names, source=source)

    def _transform(self, df: DataFrame) -> DataFrame:
        names, source = self.getOrDefault(self.names), self.getOrDefault(self.source)
        if not source:
            found = F.array(*[_clean(F.col(f"`{n}`")) if n in df.columns else F.lit(0.0) for n in names])
        else:
            at = {n: i for i, n in enumerate(source)}
            places = F.from_json(F.lit(str([at.get(n, -1) for n in names])), "array<int>")  # a constant, of any length
            found = F.transform(places, lambda i: _clean(F.when(i >= 0, F.get(F.col("values"), i))))
        return df.withColumn("features", array_to_vector(found))


class Score(_Saved):
    """score: the probability of label 1; the model's own columns go."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features")


class Verdicts(_Saved):
    """A row for each group of rows: the summary of their scores, verdict and data quality, as detect.verdicts()."""

    by = _param("by", "columns that make a group", TypeConverters.toListString)
    threshold = _param("threshold", "score from which a row counts as positive", TypeConverters.toFloat)
    valid = _param("valid", "column with the percentage of usable steps, or none", TypeConverters.toString)

    def __init__(self, by: list[str] | None = None, threshold: float | None = None, valid: str | None = None):
        super().__init__()
        self._setDefault(by=["entity"], threshold=0.6, valid="")
        self._put(by=by, threshold=threshold, valid=valid)

    def _transform(self, df: DataFrame) -> DataFrame:
        return detect.verdicts(df, self.getOrDefault(self.by), self.getOrDefault(self.threshold), self.getOrDefault(self.valid) or None)


def chosen(names: list[str], quality: bool = False, season_invariant: bool = False) -> list[str]:
    """Names of a schema that a model may see, as selection.features_of() chooses them from a table's columns."""
    kept = [n for n in names if n not in (*selection.META, *selection.PLACE) and not selection.leaking(n) and (quality or not selection.tells_quality(n))]
    some = [n for n in kept if selection.season_invariant(n)] if season_invariant else kept
    return some or kept


def train(table: DataFrame, names: list[str], source: list[str] | None = None, model: str = "rf", by: list[str] | None = None, threshold: float = 0.6, valid: str | None = None, **params) -> PipelineModel:
    """Fit a model of the labelled rows of a table (columns by name, or the array `values` with `source`), as one plan."""
    align = Align(names=names, source=source)
    rows = ml.weighted(align.transform(table.where("label is not null")))
    fitted = ml.model_factory(model, **params).fit(rows)
    return PipelineModel([align, fitted, Score(), Verdicts(by=by, threshold=threshold, valid=valid)])


def scorer(plan: PipelineModel) -> PipelineModel:
    """The plan without its last stage: a score for each row."""
    return PipelineModel(plan.stages[:-1])


__all__ = ["Align", "PipelineModel", "Score", "Verdicts", "chosen", "scorer", "train"]
