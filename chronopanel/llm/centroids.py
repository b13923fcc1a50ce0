"""Clustering of vectors around centroids by partial-distance search, in whole numbers.

A vector of 64 components becomes 64 integers, floor(64 * x). The first centroids are the vectors whose ids have
the smallest hashes. A round assigns every vector to its nearest centroid and moves each centroid to the floor of
its vectors' mean; an empty one stays. After the last round all are assigned once more.

The search adds squared differences over the dimensions in order of falling variance (over the whole table), a few
at a time. The centroid nearest over the first few gets its whole distance at once, as the bound. Any other one is
abandoned as soon as its sum is strictly above the bound, and what survives all dimensions is compared: the smallest
distance wins, of equal ones the smaller number. So the result is that of a full search.

A task adds up its own vectors for each centroid, so what is shuffled in a round is a row for each task and centroid;
the driver holds the centroids and nothing else. The integers are written once and read in each round.

Vectors that are null, of another length, or hold null or non-finite components are left out. Components beyond
2**18 count as that bound, so that no sum leaves 64 bits. Rows without an id are clustered, but start no centroid; of
rows that repeat an id the least vector comes first, and rows that repeat both can start a centroid each. With fewer
vectors than centroids there are as many centroids as vectors with ids, without any an empty result. Columns other than the id
and the vector are not passed on, so that no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import stored

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
BOUND = 1 << 24
#: Dimensions that are added between two looks at the bound.
STEP = 8
#: Vectors that are searched together.
ROWS = 1024


def integers(vector: Column) -> Column:
    scaled = lambda x: F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), x.cast("double") * SCALE))).cast("int")
    return F.transform(vector, scaled)


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and x: the integers of each vector that takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    usable = (F.size("v") == DIMS) & F.coalesce(F.forall("v", finite), F.lit(False))
    return rows.where(F.col("v").isNotNull() & usable).select("id", integers(F.col("v")).alias("x"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = vectors.where("id is not null").select(order.alias("h"), "x").orderBy("h", "x").limit(count).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, DIMS)


def by_variance(vectors: DataFrame) -> np.ndarray:
    """The dimensions in order of falling variance."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(DIMS), np.zeros(DIMS)
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * DIMS), pa.array(range(DIMS)), pa.array(total), pa.array(squares)], ["n", "dim", "s", "q"])

    sums = vectors.select("x").mapInArrow(add, "n long, dim long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    of = {r.dim: r.q / r.n - (r.s / r.n) ** 2 for r in sums.collect()}
    return np.array(sorted(range(DIMS), key=lambda d: (-of.get(d, 0.0), d)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMS)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector, and the squared distance to it."""
    x, c = x[:, order], centroids[:, order]
    sums = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(axis=2)
    guess = sums.argmin(axis=1)
    bound = ((x - c[guess]) ** 2).sum(axis=1)
    row, number = np.nonzero(sums <= bound[:, None])
    sums = sums[row, number]
    for at in range(step, DIMS, step):
        sums = sums + ((x[row, at : at + step] - c[number, at : at + step]) ** 2).sum(axis=1)
        alive = sums <= bound[row]
        row, number, sums = row[alive], number[alive], sums[alive]
    best = np.lexsort((number, sums, row))
    first = best[np.unique(row[best], return_index=True)[1]]
    return number[first].astype(np.int32), sums[first]


def _assigned(batch: pa.RecordBatch, at: int, centroids: np.ndarray, order: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for a in range(0, batch.num_rows, ROWS):
        part = batch.slice(a, ROWS)
        x = _matrix(part.column(at))
        yield part, x, *nearest(x, centroids, order)


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for batch in batches:
            for _, x, number, _ in _assigned(batch, 0, centroids, order):
                n += np.bincount(number, minlength=k)
                for j in np.unique(number):
                    total[j] += x[number == j].sum(axis=0)
        some = np.nonzero(n)[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = [F.sum(F.get("total", d)).alias(f"s{d}") for d in range(DIMS)]
    rows = vectors.select("x").mapInArrow(add, "cluster long, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *sums)
    out = centroids.copy()
    for r in rows.collect():
        out[r.cluster] = [r[f"s{d}"] // r.n for d in range(DIMS)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """The id of each vector, its cluster and squared distance, cluster_inertia, inertia and centroid_sha256."""
    rows = stored(kept(vectors, id_col, vector_col), "integers")
    order, centroids = by_variance(rows), first_centroids(rows, count)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(rows, centroids, order)
    kind = rows.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, number, distance in _assigned(batch, 1, centroids, order):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number), pa.array(distance)], ["id", "cluster", "distance"])

    if not len(centroids):
        rows = rows.limit(0)
    found = stored(rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters")
    of = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(k, of[k], sum(of.values()), sha[k]) for k in sorted(of)]
    named = found.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute_force(rows: list[tuple[int, list[int]]], count: int = CENTROIDS, rounds: int = ROUNDS) -> list[tuple]:
    """What cluster() returns, by plain loops over (id, integers), for tests."""
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)
    centroids = [list(x) for _, x in named[:count]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    find = lambda x: min((far(x, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        of = [find(x)[1] for _, x in rows]
        for k in range(len(centroids)):
            if own := [x for (_, x), j in zip(rows, of, strict=True) if j == k]:
                centroids[k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    found = [(i, *find(x)[::-1]) for i, x in rows]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, sum(e for _, j, e in found if j == k), sum(e for *_, e in found), sha[k]) for i, k, d in found]
