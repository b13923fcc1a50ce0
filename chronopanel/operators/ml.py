"""Model factories, grouped cross-validation, stacking, tuning and importance on pyspark.ml."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import metrics, spatial, splits
from chronopanel.session import checkpointed, shared_dir

T = TypeVar("T")
#: Fits that run at the same time: as many as the splitters make folds.
AT_ONCE = 5
#: Least, largest and kind of each tuned parameter: whole numbers, numbers, numbers by their logarithm, or a choice.
_TREES = {"maxIter": (200, 600, "step 50"), "maxDepth": (3, 9, "whole"), "stepSize": (0.01, 0.2, "log"), "subsamplingRate": (0.6, 1.0, "number")}
SEARCH = {
    "rf": {"numTrees": (100, 600, "step 50"), "maxDepth": (4, 30, "whole"), "minInstancesPerNode": (1, 10, "whole"), "featureSubsetStrategy": ["sqrt", "log2", "0.3"]},
    "xgb": _TREES | {"minInstancesPerNode": (1, 5, "whole")},
    "lgb": _TREES | {"minInstancesPerNode": (2, 30, "whole")},
}
ALIASES = {"rf": "rf", "random_forest": "rf", "xgb": "xgb", "xgboost": "xgb", "lgb": "lgb", "lightgbm": "lgb"}


def model_factory(name: str, seed: int = 42, **params):
    kind = ALIASES.get(name.lower())
    if kind is None:
        raise ValueError(f"unknown model {name!r}; one of {sorted(ALIASES)}")
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "seed": seed}
    if kind == "rf":
        # the node that a row has reached in each tree is kept, not looked up anew from the root at each level
        return RandomForestClassifier(**common, **({"numTrees": 300, "minInstancesPerNode": 2, "maxDepth": 12, "cacheNodeIds": True} | params))
    depth = 6 if kind == "xgb" else 5
    return GBTClassifier(**common, **({"maxIter": 300, "maxDepth": depth, "stepSize": 0.05, "subsamplingRate": 0.8} | params))


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """df with `weight` that balances the classes; rows without a label stay, with a weight of null."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n"))
    per = counts.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    w = counts.join(F.broadcast(per)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return df.drop("weight").join(F.broadcast(w), label, "left")  # a row for each class


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df.fillna(0.0, features))


def probability(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def dealt(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df written once, as many rows to each partition, for a fit or another job that takes long for each row: a partition
    for each core at least, and one for `most` rows. Spark makes partitions by bytes, which are few here."""
    rows = checkpointed(df)
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return checkpointed(rows.repartition(n))


def side_by_side(jobs: list[Callable[[], T]], at_once: int = AT_ONCE) -> list[T]:
    """Results of jobs that run at the same time, each in a pool of its own where the scheduler is fair. Spark deals the
    executors out; the driver only waits."""
    if not jobs:
        return []
    context = SparkContext._active_spark_context

    def run(k: int) -> T:
        context.setLocalProperty("spark.scheduler.pool", f"fit-{k % at_once}")
        return jobs[k]()

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(run), range(len(jobs))))


def cross_validate(df: DataFrame, name: str, fold: str = "fold", most: int = 250_000, **params) -> DataFrame:
    """Out-of-fold scores of assembled rows. The folds are fitted and scored side by side, each distributed, on rows that
    are dealt out once. Each task of a fit of trees makes and sends the counts of all nodes, however few its rows, so a
    fold has as many partitions as its share of the cores, or one for `most` rows if these are more."""
    written = checkpointed(df.where(F.col(fold).isNotNull()))
    folds = sorted(r[0] for r in written.select(fold).distinct().collect())
    share = -(-df.sparkSession.sparkContext.defaultParallelism // max(1, min(AT_ONCE, len(folds))))
    rows = checkpointed(written.repartition(max(share, -(-written.count() // most))))

    def fitted(k) -> Callable[[], DataFrame]:
        def fit() -> DataFrame:
            model = model_factory(name, **params).fit(weighted(rows.where((F.col(fold) != k) & F.col("label").isNotNull())))
            return checkpointed(probability(model, rows.where(F.col(fold) == k)))  # the model goes with its fold

        return fit

    return reduce(DataFrame.unionByName, side_by_side([fitted(k) for k in folds]))


def fold_metrics(scored: DataFrame, fold: str = "fold") -> DataFrame:
    s = scored.withColumn("y", F.col("label"))
    return metrics.confusion(s, [fold]).join(metrics.roc_auc(s, [fold]), fold).join(metrics.average_precision(s, [fold]), fold)


def evaluate(df: DataFrame, name: str, fold: str = "fold", x: str | None = None, y: str | None = None, buffer: float = 500.0, **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grouped cross-validation of assembled rows: out-of-fold scores, metrics of each fold, and a row with the
    best threshold of the out-of-fold scores.

    With coordinates each fold has a second row (`buffered`) over the rows that are at least `buffer` away from
    all rows of other folds, if two or more of these remain, of both classes. Rows without a label are scored
    and count in no metric."""
    scored = checkpointed(cross_validate(df, name, fold, **params))
    labelled = scored.where(F.col("label").isNotNull())
    folds = fold_metrics(labelled, fold).withColumn("buffered", F.lit(False))
    if x is not None and y is not None:
        far = checkpointed(spatial.buffered_antijoin(labelled, labelled, buffer, x, y, fold))
        fit = far.groupBy(fold).agg(F.count("*").alias("__n"), F.min("label").alias("__lo"), F.max("label").alias("__hi")).where("__n > 1 and __lo < __hi").select(fold)
        folds = folds.unionByName(fold_metrics(far.join(fit, fold), fold).withColumn("buffered", F.lit(True)))
    return scored, folds, metrics.youden(labelled.withColumn("y", F.col("label")), [])


def stack(df: DataFrame, names: list[str], key: str, own: dict[str, dict] | None = None, **params) -> DataFrame:
    """Scores of a logistic regression, with balanced classes, on the out-of-fold scores of the named models. params are
    those of all models, `own` of each."""
    own = own or {}
    rows = checkpointed(df)
    scored = [lambda n=n: checkpointed(cross_validate(rows, n, **(params | own.get(n, {}))).select(key, F.col("score").alias(n))) for n in names]
    parts = side_by_side(scored)
    joined = rows.select(key, "label", "fold")
    for p in parts:
        joined = joined.join(p, key)
    x = VectorAssembler(inputCols=names, outputCol="features").transform(joined)
    last = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=2000)
    return probability(last.fit(weighted(x).where("weight is not null")), x)


def _draw(rng: random.Random, values):
    if isinstance(values, list):
        return rng.choice(values)
    low, high, kind = values
    if kind == "log":
        return math.exp(rng.uniform(math.log(low), math.log(high)))
    if kind == "number":
        return rng.uniform(low, high)
    step = 1 if kind == "whole" else int(kind.split()[1])
    return rng.randrange(low, high + 1, step)


def _near(rng: random.Random, values, good: list, bad: list, draws: int = 24):
    """A value that is likely among good trials and unlikely among the others: draws around good values, of which the one
    with the largest ratio of two densities (Parzen windows with a share of the whole range) is taken."""
    if isinstance(values, list):
        share = lambda v, seen: (seen.count(v) + 1) / (len(seen) + len(values))
        return max(values, key=lambda v: (share(v, good) / share(v, bad), rng.random()))
    low, high, kind = values
    to, back = (math.log, math.exp) if kind == "log" else (float, float)
    a, b = to(low), to(high)
    width = lambda seen: (b - a) / max(2.0, len(seen) ** 0.5)

    def density(x: float, seen: list) -> float:
        w = width(seen)
        return (1 / (b - a) + sum(math.exp(-(((x - to(s)) / w) ** 2) / 2) / (w * 2.5066) for s in seen)) / (len(seen) + 1)

    tried = [min(b, max(a, rng.gauss(to(rng.choice(good)), width(good)))) for _ in range(draws)]
    x = back(max(tried, key=lambda x: density(x, good) / density(x, bad)))
    if kind in ("log", "number"):
        return min(high, max(low, x))
    step = 1 if kind == "whole" else int(kind.split()[1])
    return min(low + round((x - low) / step) * step, low + (high - low) // step * step)


def search(df: DataFrame, name: str, ranges: dict | None = None, trials: int = 50, seed: int = 42, at_once: int = 4, parzen: bool = True) -> list[tuple[dict, float]]:
    """Parameters in the ranges (those of SEARCH, unless given) and their mean macro-F1 over folds, best first.

    `at_once` trials run side by side on rows that are written once. After the first two rounds parameters come from a
    tree-structured Parzen estimator (`parzen`): trials so far are cut into the best quarter and the rest, and values
    likely in the former are drawn; without it all are drawn at random."""
    rng, found = random.Random(seed), []
    ranges = SEARCH[ALIASES[name.lower()]] if ranges is None else ranges
    rows = checkpointed(df)

    def proposed() -> dict:
        if not parzen or len(found) < 2 * at_once:
            return {k: _draw(rng, v) for k, v in ranges.items()}
        ranked = [p for p, _ in sorted(found, key=lambda x: -x[1])]
        cut = max(1, len(ranked) // 4)
        return {k: _near(rng, v, [p[k] for p in ranked[:cut]], [p[k] for p in ranked[cut:]]) for k, v in ranges.items()}

    while len(found) < trials:
        tried = [proposed() for _ in range(min(at_once, trials - len(found)))]
        f1 = side_by_side([lambda p=p: fold_metrics(cross_validate(rows, name, **p)).agg(F.avg("macro_f1")).first()[0] for p in tried])
        found += zip(tried, f1, strict=True)
    return sorted(found, key=lambda x: -x[1])


def random_search(df: DataFrame, name: str, ranges: dict | None = None, trials: int = 50, seed: int = 42) -> list[tuple[dict, float]]:
    return search(df, name, ranges, trials, seed, parzen=False)


def importances(model, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))[:top]


def _nodes(model: RandomForestClassificationModel) -> list[tuple[np.ndarray, ...]] | None:
    """Feature, threshold, left and right child (-1 in leaves) and votes of the nodes of each tree of a saved forest; none
    where a tree asks for categories. As large as the forest, whatever the table."""
    spark = SparkSession.active()
    at = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.save(at)
    n = F.col("nodeData")
    split = n["split"]
    read = spark.read.parquet(f"{at}/data").select(
        "treeID", n["id"].alias("id"), split["featureIndex"].alias("feature"), F.coalesce(F.get(split["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), (split["numCategories"] >= 0).alias("categories"), n["impurityStats"].alias("stats"),
    ).orderBy("treeID", "id").toArrow()
    of = {c: read[c].combine_chunks() for c in read.column_names}
    left, categories = of["left"].to_numpy(), of["categories"].to_numpy(zero_copy_only=False)
    if np.any(categories[left >= 0]):
        return None
    stats = of["stats"].flatten().to_numpy().reshape(len(left), -1)
    total = stats.sum(axis=1, keepdims=True)
    votes = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    ends = np.flatnonzero(np.diff(of["treeID"].to_numpy())) + 1
    columns = (of["feature"].to_numpy(), of["threshold"].to_numpy(), left, of["right"].to_numpy(), votes)
    return list(zip(*[np.split(c, ends) for c in columns], strict=True))


def _after_change(trees: list[tuple[np.ndarray, ...]], own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each row and feature, the class that the trees vote for when the row's feature has its other value. A tree's
    votes change only for those features that turn the row's path at some node; only these paths are followed."""
    rows, width = own.shape
    sums = np.zeros((rows, width, trees[0][4].shape[1]))
    mine, theirs = own.ravel(), other.ravel()
    for feature, threshold, left, right, votes in trees:
        turned, base, found = np.zeros(rows * width, bool), np.zeros(rows, np.int64), []
        row, node = np.arange(rows), np.zeros(rows, np.int64)  # rows on their own paths
        cell, at = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rows and changed features, as one number, off them
        while len(row) or len(cell):
            leaf = left.take(at) < 0
            found.append((cell[leaf], at[leaf]))
            cell, at = cell[~leaf], at[~leaf]
            asked = cell - cell % width + feature.take(at)
            value = np.where(asked == cell, theirs.take(asked), mine.take(asked))
            at = np.where(value <= threshold.take(at), left.take(at), right.take(at))

            leaf = left.take(node) < 0
            base[row[leaf]] = node[leaf]
            row, node = row[~leaf], node[~leaf]
            asked, limit = row * width + feature.take(node), threshold.take(node)
            was, lower, upper = mine.take(asked) <= limit, left.take(node), right.take(node)
            turns = (was != (theirs.take(asked) <= limit)) & ~turned.take(asked)
            turned[asked[turns]] = True
            cell, at = np.concatenate([cell, asked[turns]]), np.concatenate([at, np.where(was, upper, lower)[turns]])
            node = np.where(was, lower, upper)
        cast = np.repeat(votes[base][:, None, :], width, axis=1)
        for c, k in found:
            cast.reshape(rows * width, -1)[c] = votes[k]
        sums += cast  # in the trees' order, as the model adds them
    return sums.argmax(axis=2)


def _right_after(met: DataFrame, trees: list[tuple[np.ndarray, ...]], size: int = 2048) -> DataFrame:
    """__f, __r and __right, the share of rows with the right prediction, of rows (label, own, other, __r)."""
    shared = met.sparkSession.sparkContext.broadcast(trees)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), size):
                b = whole.slice(start, size)
                values = [b[c].flatten().to_numpy().reshape(len(b), -1) for c in ("own", "other")]
                right = _after_change(shared.value, *values) == b["label"].to_numpy()[:, None]
                repeat = b["__r"].to_numpy()
                for r in np.unique(repeat):
                    sums = right[repeat == r].sum(axis=0)
                    f = np.arange(len(sums), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.full(len(f), r, np.int32)), pa.array(sums), pa.array(np.full(len(f), (repeat == r).sum()))], ["__f", "__r", "hits", "n"])

    counted = met.select(F.col("label").cast("double").alias("label"), "own", "other", "__r").mapInArrow(hits, "__f int, __r int, hits bigint, n bigint")
    return counted.groupBy("__f", "__r").agg((F.sum("hits") / F.sum("n")).alias("__right"))


def permutation_importance(model, df: DataFrame, features: list[str], key: str, repeats: int = 10, top: int = 20, seed: int = 42) -> DataFrame:
    """feature, importance_mean and importance_std: what accuracy loses when a feature's values are dealt out anew,
    the `top` largest of a table with these features, `label` and a unique key.

    Rows are numbered once in the order of a seeded hash; in each repeat a row takes a feature's value from the row
    that many places on, drawn for each repeat. All repeats and features are scored in one job: those of a forest by the
    nodes that a change reaches, those of other models by the model, a row for each changed feature."""
    rows = df.where(F.col("label").isNotNull()).fillna(0.0, features)
    rows = rows.select(key, "label", F.array(*[F.col(c).cast("double") for c in features]).alias("own"))
    placed = checkpointed(splits.numbered(rows.withColumn("__h", splits.drawn(key, seed)), ["__h", key], "__i"))
    n, rng = placed.count(), random.Random(seed)
    steps = F.array(*[F.lit(rng.randrange(1, max(n, 2))).cast("bigint") for _ in range(repeats)])
    asked = placed.select("label", "own", "__i", F.posexplode(steps).alias("__r", "__step"))
    asked = asked.withColumn("__i", F.pmod(F.col("__i") + F.col("__step"), F.lit(max(n, 1))))
    met = asked.join(placed.select("__i", F.col("own").alias("other")), "__i")
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, n * repeats // 20_000)  # neither by bytes nor of a few rows
    met = met.repartition(parts, "__i", "__r")
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    base = model.transform(placed.select("label", array_to_vector("own").alias("features"))).agg(right.alias("__base"))
    forest = isinstance(model, RandomForestClassificationModel) and not model.isSet("thresholds")
    trees = _nodes(model) if forest else None
    if trees:
        after = _right_after(met, trees)
    else:
        tried = met.select("label", "own", "other", "__r", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("__f"))
        changed = F.transform("own", lambda v, i: F.when(i == F.col("__f"), F.get("other", i)).otherwise(v))
        after = model.transform(tried.select("label", "__r", "__f", array_to_vector(changed).alias("features"))).groupBy("__f", "__r").agg(right.alias("__right"))
    lost = after.join(F.broadcast(base)).withColumn("lost", F.col("__base") - F.col("__right"))  # one row
    named = F.get(F.array(*[F.lit(c) for c in features]), F.col("__f")).alias("feature")
    out = lost.groupBy("__f").agg(F.avg("lost").alias("importance_mean"), F.stddev_pop("lost").alias("importance_std"))
    return out.select(named, "importance_mean", "importance_std").orderBy(F.desc("importance_mean"), "feature").limit(top)
