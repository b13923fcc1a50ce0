"""Approximate nearest neighbours by a hierarchical k-means tree.

The top of the tree is fitted on the driver on a sample of at most `sample_rows` vectors. Leaves that hold
many more than `leaf_rows` rows then get subtrees, each fitted in a task on a bounded sample of its leaf, so
the tree grows with the table, up to `max_leaves` leaves (their centres are what each worker holds; in larger
tables leaves grow). Every row is indexed: it descends to a leaf. A search goes best bin first: a priority
queue of nodes by the distance of their centre gives leaves in order. How many leaves are visited is
calibrated: for at most `calibrate_rows` vectors that no tree was fitted on, the exact neighbours are found by
brute force over all rows, in blocks, and visits widen until the mean recall reaches `target`. A query visits
more leaves if those hold fewer than k rows.

Neighbouring leaves share a bucket of about `block_rows` rows; a leaf of more rows has a bucket of its own,
dealt into blocks. A query comes once to each block of the buckets that hold its leaves. A task keeps one
block and lets the queries stream past it; it gives the k nearest in the query's leaves there, and the k
nearest of those are the result. The nearness is the Euclidean distance
in double precision, ties go to the smaller id.

Vectors that are null, empty, zero, hold null or non-finite components or differ in length from most take
no part, nor do rows without an id. Of repeated query ids the least vector asks; repeated candidates are
each found. Other columns are not passed on. Without queries or candidates the result is empty.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import stored

K = 10
BRANCHES = 16
LEAF_ROWS = 128
MAX_LEAVES = 1 << 17
#: Rows of a sample for each leaf fitted on it, at least.
FIT_ROWS = 32
SAMPLE_ROWS = 20_000
CALIBRATE_ROWS = 128
TARGET = 0.96
BLOCK_ROWS = 4096
SEED = 7


class KMeansTree:
    """centres[i] and children[i] of node i (no children: a leaf), node 0 the root; leaf[i]: its number."""

    def __init__(self, points: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS):
        self.centres, self.children, self.leaf, self.leaves = [], [], [], 0
        self._grow(points, branches, leaf_rows, np.random.default_rng(SEED))
        self.centres = np.clip(self.centres, -1e30, 1e30).astype(np.float32)

    def graft(self, trees: dict[int, KMeansTree]) -> None:
        """Put these trees in the place of leaves, and number all leaves anew."""
        at = {self.leaf[i]: i for i, below in enumerate(self.children) if not below}
        parts, base = [self.centres], len(self.centres)
        for leaf, tree in trees.items():
            moved = [[base + c - 1 for c in below] for below in tree.children]  # its root stays this node
            self.children[at[leaf]] = moved[0]
            self.children += moved[1:]
            parts.append(tree.centres[1:])
            base += len(tree.children) - 1
        self.centres, self.leaves = np.concatenate(parts), 0
        self.leaf = [-1] * len(self.children)
        for i, below in enumerate(self.children):
            if not below:
                self.leaf[i] = self.leaves
                self.leaves += 1

    def _grow(self, points: np.ndarray, branches: int, leaf_rows: int, rng: np.random.Generator) -> int:
        own = len(self.centres)
        self.centres.append(points.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        k = min(branches, -(-len(points) // leaf_rows))
        label = _kmeans(points, k, rng) if k > 1 else None
        if label is None or len(parts := np.unique(label)) < 2:
            self.leaf[own] = self.leaves
            self.leaves += 1
        else:
            self.children[own] = [self._grow(points[label == x], branches, leaf_rows, rng) for x in parts]
        return own

    def locate(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, descending to the nearest centre."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
            elif len(rows):
                nearest = _distances(points[rows], self.centres[below].astype(np.float64)).argmin(axis=1)
                todo += [(c, rows[nearest == j]) for j, c in enumerate(below)]
        return out

    def visit(self, point: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if below := self.children[node]:
                near = _distances(point[None], self.centres[below].astype(np.float64))[0]
                for d, c in zip(near.tolist(), below, strict=True):
                    heapq.heappush(heap, (d, c))
            else:
                yield self.leaf[node]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, up to a term that is the same along a row."""
    return (b * b).sum(axis=1) - 2 * a @ b.T


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        label = _distances(points, centres).argmin(axis=1)
        for j in np.unique(label):
            centres[j] = points[label == j].mean(axis=0)
    return _distances(points, centres).argmin(axis=1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec: array<double>) of the rows that take part."""
    vec = F.col("vec")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0)).where(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (most["n"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _nearest(queries: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each query the places of its k nearest points, and their distances."""
    for q, i in zip(queries, own, strict=True):
        with np.errstate(over="ignore"):
            diff = points - q
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            for row in np.flatnonzero(~np.isfinite(d)):  # the squares overflow, the distance may not
                most = np.abs(diff[row]).max()
                d[row] = most * np.sqrt(((diff[row] / most) ** 2).sum()) if np.isfinite(most) else np.inf
        others = np.flatnonzero(ids != i)
        if len(others) > k:
            others = others[d[others] <= np.partition(d[others], k - 1)[k - 1]]
        some = others[np.lexsort((ids[others], d[others]))][:k]
        yield some, d[some]


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    target: float = TARGET,
    sample_rows: int = SAMPLE_ROWS,
    calibrate_rows: int = CALIBRATE_ROWS,
    block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
    max_leaves: int = MAX_LEAVES,
) -> DataFrame:
    """query_id, rank (from 1), id_col, score. is_query: a condition on the column `id`."""
    rows = usable(vectors, id_col, vector_col)
    schema = f"query_id bigint, rank int, {id_col} bigint, score double"
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample_rows + calibrate_rows).toArrow()
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)
    # the last of the sample calibrate and take no part in fitting, unless there are few
    apart = min(calibrate_rows, drawn.num_rows // 2) if drawn.num_rows > 4 * k else 0
    fitted, held = drawn.slice(0, drawn.num_rows - apart), drawn.slice(drawn.num_rows - apart) if apart else drawn
    points = _matrix(fitted["vec"].combine_chunks())
    tree = KMeansTree(points, leaf_rows=max(FIT_ROWS, leaf_rows * len(points) // total))
    held_ids = held["id"].to_pylist() if apart else []
    tree = _grown(rows.where(~F.col("id").isin(held_ids)) if apart else rows, tree, leaf_rows, max_leaves, sample_rows)

    indexed = stored(_located(rows, tree), "leaves")
    sizes = _sizes(indexed, tree)
    some = held.slice(0, calibrate_rows)
    visits = _calibrated(indexed, tree, _matrix(some["vec"].combine_chunks()), some["id"].to_numpy(), k, target)
    bucket = _buckets(sizes, block_rows)
    blocks = np.maximum(-(-np.bincount(bucket, sizes).astype(np.int64) // block_rows), 1)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = []
                for row, q in enumerate(_matrix(part.column(1))):
                    held, own = 0, {}
                    for n, leaf in enumerate(tree.visit(q)):
                        if n >= visits and held > k:
                            break
                        held += int(sizes[leaf])
                        own.setdefault(int(bucket[leaf]), []).append(leaf)
                    out += [(row, b, block, leaves) for b, leaves in own.items() for block in range(int(blocks[b]))]
                places, buckets, block, leaves = zip(*out, strict=True)
                at_rows = pa.array(places, pa.int32())
                cols = [part.column(0).take(at_rows), part.column(1).take(at_rows), pa.array(buckets, pa.int32()), pa.array(block, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "vec", "bucket", "block", "leaves"]
    kinds = "id bigint, vec array<double>, bucket int, block int, leaves array<int>"
    queries = indexed.where(is_query).groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(asked, kinds)

    def dealing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = b.column(2).to_numpy()
            of = blocks[bucket[leaf]]
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1, dtype=np.int32)), b.column(2))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(bucket[leaf]), pa.array((b.column(3).to_numpy() % of).astype(np.int32)), own], names)

    mixed = indexed.select("id", "vec", "leaf", F.xxhash64("id", "vec").alias("mixed"))
    dealt = mixed.mapInArrow(dealing, kinds)
    meet = dealt.withColumn("asks", F.lit(False)).union(queries.withColumn("asks", F.lit(True)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block, begin = None, [], None, None
        for b in batches:
            key = np.column_stack([b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(5).to_numpy(zero_copy_only=False)])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if at != (now := tuple(key[lo, :2])):
                    at, parts, block = now, [], None
                own, found, leaves = b.column(0).slice(lo, hi - lo).to_numpy(), _matrix(b.column(1).slice(lo, hi - lo)), b.column(4).slice(lo, hi - lo)
                if not key[lo, 2]:
                    parts.append((own, found, leaves.flatten().to_numpy()))
                elif parts:
                    if block is None:
                        block = [np.concatenate(x) for x in zip(*parts, strict=True)]
                        order = np.argsort(block[2], kind="stable")
                        block = [x[order] for x in block]
                        begin = np.searchsorted(block[2], np.arange(tree.leaves + 1))
                    for q, i, visited in zip(found, own, leaves.to_pylist(), strict=True):
                        rows = np.concatenate([np.arange(begin[x], begin[x + 1]) for x in sorted(visited)])
                        (near, away), = _nearest(q[None], np.array([i]), block[1][rows], block[0][rows], k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), i)), pa.array(block[0][rows][near]), pa.array(away)], ["query_id", "id", "score"])

    found = meet.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks").mapInArrow(compare, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _buckets(sizes: np.ndarray, block_rows: int) -> np.ndarray:
    """The bucket of each leaf: leaves in order (neighbours in the tree) while they hold block_rows rows."""
    out, now, held = np.zeros(len(sizes), np.int32), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > block_rows:
            now, held = now + 1, 0
        out[leaf] = now
        held += n
    return out


def _located(rows: DataFrame, tree: KMeansTree) -> DataFrame:
    """rows (id, vec) with their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(tree.locate(_matrix(b.column(1))))], ["id", "vec", "leaf"])

    return rows.select("id", "vec").mapInArrow(run, "id bigint, vec array<double>, leaf int")


def _sizes(located: DataFrame, tree: KMeansTree) -> np.ndarray:
    sizes = np.zeros(tree.leaves, np.int64)
    for r in located.groupBy("leaf").count().collect():  # one row for each leaf of the tree at most
        sizes[r["leaf"]] = r["count"]
    return sizes


def _grown(rows: DataFrame, tree: KMeansTree, leaf_rows: int, max_leaves: int, sample_rows: int) -> KMeansTree:
    """The tree with subtrees in its leaves until these hold about leaf_rows rows, or can't be split."""
    whole = 1 << 30
    while True:
        located = _located(rows, tree)
        sizes = _sizes(located, tree)
        wide = [(int(leaf), int(n)) for leaf, n in enumerate(sizes) if n > 4 * leaf_rows]
        room = max_leaves - tree.leaves
        if not wide or room <= 0:
            return tree
        share = min(1.0, room / sum(n / leaf_rows for _, n in wide))  # of the leaves that would be made
        want = {leaf: max(2, int(share * n / leaf_rows)) for leaf, n in wide}
        take = np.zeros(tree.leaves, np.int64)
        for leaf, n in wide:
            take[leaf] = min(whole, int(whole * min(FIT_ROWS * want[leaf], sample_rows) / n))

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(b.column(3).to_numpy() < take[b.column(2).to_numpy()])).select(["vec", "leaf"])

        def fit(key: tuple, group: pa.Table) -> pa.Table:
            points = _matrix(group["vec"].combine_chunks())
            made = KMeansTree(points, leaf_rows=max(1, -(-len(points) // want[key[0].as_py()])))
            return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(made)], pa.binary())})

        mixed = located.withColumn("mixed", F.pmod(F.xxhash64("id", "vec", F.lit(SEED)), F.lit(whole)))
        sample = mixed.mapInArrow(drawn, "vec array<double>, leaf int")
        found = sample.groupBy("leaf").applyInArrow(fit, "leaf int, tree binary")
        trees = {r["leaf"]: pickle.loads(r["tree"]) for r in found.toLocalIterator()}  # max_leaves leaves in all
        trees = {leaf: x for leaf, x in trees.items() if x.leaves > 1}
        if not trees:
            return tree
        tree.graft(trees)


def _calibrated(indexed: DataFrame, tree: KMeansTree, points: np.ndarray, ids: np.ndarray, k: int, target: float) -> int:
    """Leaf visits at which the mean recall of these points' exact neighbours reaches the target."""

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            near = list(_nearest(points, ids, _matrix(b.column(1)), own, k))
            which = np.repeat(np.arange(len(points)), [len(x) for x, _ in near])
            places = np.concatenate([x for x, _ in near])
            cols = which, own[places], leaf[places], np.concatenate([d for _, d in near])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "id", "leaf", "score"])

    exact = indexed.mapInArrow(brute, "query bigint, id bigint, leaf int, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    true = exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "leaf").toPandas()  # k rows for each calibration point
    needed = []
    for query, leaves in true.groupby("query")["leaf"]:
        order = {leaf: n for n, leaf in enumerate(tree.visit(points[query]))}
        needed += [order[x] + 1 for x in leaves]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else tree.leaves
