"""Nearest neighbours in the plane, whatever the density: blocks along a Morton curve, trees by medians in them.

Places (distinct points) are sorted along a Morton curve, which halves cells where places are dense, and dealt into
blocks of about `block_rows`. A block has a tree of its own whose cells are cut at medians, so their size follows the
local density, and finds each place's nearest neighbour in the block. That distance, or the farthest corner of another
block's box, bounds the search outside: only blocks whose box is nearer than the bound are asked, once, with the bound.
What is sent to all tasks is the box of each block of classes that more than one block holds: about three at most for each
of `MAX_BLOCKS` range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.session import checkpointed

BLOCK_ROWS = 1 << 15
#: Blocks at most; of larger tables blocks have more rows.
MAX_BLOCKS = 50_000
LEAF = 32
#: Queries that a copy of a block answers.
QUERIES = 1 << 17
#: Neighbouring places that choose blocks together.
GROUP = 256
#: The number of a missing value where missing values are equal.
_NO_KEY = -(1 << 62)
_PLACE = ["c", "x", "y", "id", "free", "nn"]


class Tree:
    """Cells cut at medians of the wider side."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, free: np.ndarray):
        self.x, self.y, self.ids, self.free = x, y, ids, free
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        self._grow(0, len(x))

    def _grow(self, lo: int, hi: int) -> int:
        own, rows = len(self.nodes), self.order[lo:hi]
        x, y = self.x[rows], self.y[rows]
        box = x.min(), x.max(), y.min(), y.max()
        self.nodes.append((box, lo, hi, -1, -1))
        if hi - lo > LEAF:
            along, mid = (x if box[1] - box[0] >= box[3] - box[2] else y), (hi - lo) // 2
            self.order[lo:hi] = rows[np.argpartition(along, mid)]
            self.nodes[own] = (box, lo, hi, self._grow(lo, lo + mid), self._grow(lo + mid, hi))
        return own

    def search(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, free: np.ndarray, best: np.ndarray, own: bool) -> np.ndarray:
        """best, or the distance to the nearest place of another id if that is smaller. With `own` the queries are the
        tree's places, which are not their own neighbours."""
        best = best.copy()

        def visit(node: int, q: np.ndarray) -> None:
            box, lo, hi, left, right = self.nodes[node]
            q = q[_outside(x[q], y[q], box) <= best[q]]
            if not len(q):
                return
            if left < 0:
                rows = self.order[lo:hi]
                d = np.hypot(x[q, None] - self.x[rows], y[q, None] - self.y[rows])
                same = (ids[q, None] == self.ids[rows]) & ~(free[q, None] | self.free[rows])
                d[same] = np.inf
                if own:
                    d[q[:, None] == rows] = np.inf
                best[q] = np.minimum(best[q], d.min(axis=1))
                return
            near = _outside(x[q], y[q], self.nodes[left][0]) <= _outside(x[q], y[q], self.nodes[right][0])
            for child, of in ((left, q[near]), (right, q[~near]), (right, q[near]), (left, q[~near])):
                visit(child, of)

        visit(0, np.arange(len(x)))
        return best


def _outside(x, y, box) -> np.ndarray:
    return np.hypot(np.maximum(np.maximum(box[0] - x, x - box[1]), 0), np.maximum(np.maximum(box[2] - y, y - box[3]), 0))


def _farthest(x, y, box) -> np.ndarray:
    return np.hypot(np.maximum(np.abs(x - box[0]), np.abs(x - box[1])), np.maximum(np.abs(y - box[2]), np.abs(y - box[3])))


def morton(x: Column, y: Column, x0: float, y0: float, extent: float) -> Column:
    """The bits of both coordinates in turn, 31 of each."""

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    cell = lambda v, v0: F.floor((v - v0) / extent * ((1 << 31) - 1)).cast("bigint")
    return F.coalesce(spread(cell(x, x0)).bitwiseOR(F.shiftleft(spread(cell(y, y0)), 1)), F.lit(0))


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [np.nan_to_num(batch.column(n).to_numpy(zero_copy_only=False).astype(float), nan=np.inf) if n == "nn" else batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _within(batches: Iterator[pa.RecordBatch], block_rows: int, search: bool) -> Iterator[pa.RecordBatch]:
    """Places of a partition with their block and, where that is asked, the nearest neighbour in it."""
    part = TaskContext.get().partitionId()
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    classes = rows.column("c").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(classes[1:] != classes[:-1]) + 1).tolist(), len(classes)]
    cuts = sorted({c for a, b in zip(cuts, cuts[1:], strict=False) for c in range(a, b, block_rows)} | {len(classes)})
    for block, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own = rows.slice(a, b - a).to_batches()[0]
        x, y, ids, free, nn = _columns(own, _PLACE[1:])
        best = Tree(x, y, ids, free).search(x, y, ids, free, nn, True) if search else nn
        nn = pa.array(best, mask=np.isinf(best))
        yield pa.RecordBatch.from_arrays([*own.columns[:5], nn, *[pa.array(np.full(b - a, n, np.int64)) for n in (part, block)]], [*_PLACE, "part", "block"])


def _asked(x: np.ndarray, y: np.ndarray, ids: np.ndarray, free: np.ndarray, best: np.ndarray, boxes: np.ndarray, only: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """(query, block) for each other block that may hold a nearer neighbour."""
    out = []
    for a in range(0, len(x), GROUP):
        g = slice(a, a + GROUP)
        around = x[g].min(), x[g].max(), y[g].min(), y[g].max()
        apart = np.hypot(np.maximum(np.maximum(boxes[:, 0] - around[1], around[0] - boxes[:, 1]), 0), np.maximum(np.maximum(boxes[:, 2] - around[3], around[2] - boxes[:, 3]), 0))
        some = np.flatnonzero(apart <= best[g].max())
        box = boxes[some].T[:, None, :]
        other = mixed[some] | free[g, None] | (only[some] != ids[g, None])
        bound = np.minimum(best[g], np.where(other, _farthest(x[g, None], y[g, None], box), np.inf).min(axis=1, initial=np.inf))
        q, b = np.nonzero(other & (_outside(x[g, None], y[g, None], box) <= bound[:, None]))
        out.append(np.column_stack([q + a, some[b]]))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _finite(name: str) -> Column:
    return F.coalesce(F.abs(name) < float("inf"), F.lit(False)) & ~F.isnan(name)


def _number(df: DataFrame, key: str, name: str) -> Column:
    """The key (a column of df, now called name) as a number, null if it is null."""
    whole = df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.col(name).cast("bigint") if whole else F.when(F.col(name).isNotNull(), F.xxhash64(name))


def nearest_distance(df: DataFrame, key: str, x: str = "x", y: str = "y", by: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, nn (and by) of each row: the distance to the nearest row of another key (and the same `by`), null if there
    is none or a coordinate is missing or not finite.

    Rows at one place are one place, and 0 apart if their keys differ. A null key differs from all keys, a null `by` is
    a value like others. Keys that are not whole numbers are compared by their XXH64."""
    rows = df.select((F.col(by) if by else F.lit(0)).alias("c"), F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    known = _finite("x") & _finite("y")
    number = _number(df, key, "k")
    places = rows.where(known).groupBy("c", F.col("x") + 0.0, F.col("y") + 0.0).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count_if(number.isNull()).alias("no"), F.count("*").alias("m")).toDF("c", "x", "y", "lo", "hi", "no", "m")
    shared = (F.col("lo") < F.col("hi")) | ((F.col("no") > 0) & (F.col("m") > 1))
    free = F.coalesce(shared, F.lit(False)) | (F.col("no") > 0)
    places = checkpointed(places.select("c", "x", "y", F.coalesce("lo", F.lit(0)).alias("id"), free.alias("free"), F.when(shared, 0.0).alias("nn")))
    x0, x1, y0, y1, count = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    found = _of_places(places, (x0, x1, y0, y1), count, block_rows) if count else places.select("c", "x", "y", "nn")
    at = found.select(F.struct("c", "x", "y").alias("at"), "nn")
    joined = rows.withColumn("at", F.when(known, F.struct("c", F.col("x") + 0.0, F.col("y") + 0.0))).join(at, "at", "left")
    return joined.select(F.col("k").alias(key), *([F.col("c").alias(by)] if by else []), "nn")


def near_places(left: DataFrame, right: DataFrame, distance: float, x: str = "x", y: str = "y", unlike: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """x, y and u of left's distinct places (and values of `unlike`, else null) that have a row of right nearer than
    distance, with `unlike` one that differs in that column; nulls are equal there.

    Right's places are dealt into blocks, and each place of left asks only blocks whose box is nearer than the distance
    or the farthest corner of another block. So a dense spot costs a search in a tree for each place, not all its pairs.
    Rows without finite coordinates are near nothing."""

    def placed(df: DataFrame) -> DataFrame:
        u = F.col(unlike) if unlike else F.lit(None).cast("int")
        rows = df.select((F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"), u.alias("u"))
        number = F.coalesce(_number(df, unlike, "u"), F.lit(_NO_KEY)) if unlike else F.lit(_NO_KEY)
        return rows.where(_finite("x") & _finite("y")).withColumn("id", number)

    asking = checkpointed(placed(left).distinct())
    held = placed(right).groupBy("x", "y").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    free = F.col("lo") < F.col("hi") if unlike else F.lit(True)
    held = checkpointed(held.select(F.lit(0).alias("c"), "x", "y", F.col("lo").alias("id"), free.alias("free"), F.lit(None).cast("double").alias("nn")))
    x0, x1, y0, y1, count = held.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not count or not distance > 0:
        return asking.select("x", "y", "u").limit(0)
    corner = x0, x1, y0, y1
    local = _dealt(held, corner, count, block_rows, False)
    boxes, only, mixed, names = _boxes(_blocks(local).orderBy("part", "block").collect())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                own = batch.slice(lo, GROUP)
                yield from _sent(own, _asked(*_columns(own, _PLACE[1:]), boxes, only, mixed), names)

    queries = asking.select(F.lit(0).alias("c"), "x", "y", "id", F.lit(False).alias("free"), F.lit(float(distance)).alias("nn"))
    inside = lambda v, a, b: F.least(F.greatest(F.col(v), F.lit(a)), F.lit(b))
    code = morton(inside("x", x0, x1), inside("y", y0, y1), x0, y0, max(x1 - x0, y1 - y0) or 1.0)
    along = queries.withColumn("code", code).repartitionByRange("code", "x", "y").sortWithinPartitions("code", "x", "y").select(*_PLACE)
    asked = checkpointed(along.mapInArrow(ask, f"{_places('int')}, part long, block long"))
    near = _answers(local, asked, "int").where(F.col("nn") < distance).select("x", "y", "id").distinct()
    return asking.join(near, ["x", "y", "id"], "left_semi").select("x", "y", "u")


def _places(kind: str) -> str:
    return f"c {kind}, x double, y double, id long, free boolean, nn double"


def _dealt(places: DataFrame, corner: tuple[float, float, float, float], count: int, block_rows: int, search: bool) -> DataFrame:
    """Places with part and block, in order along the curve."""
    x0, x1, y0, y1 = corner
    order = ["c", "code", "x", "y"]
    block_rows = max(block_rows, -(-count // MAX_BLOCKS))
    parts = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // block_rows))
    coded = places.withColumn("code", morton(F.col("x"), F.col("y"), x0, y0, max(x1 - x0, y1 - y0) or 1.0))
    dealt = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*_PLACE)
    kind = places.schema["c"].dataType.simpleString()
    return checkpointed(dealt.mapInArrow(lambda b: _within(b, block_rows, search), f"{_places(kind)}, part long, block long"))


def _blocks(local: DataFrame) -> DataFrame:
    box = [f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))]
    mixed = F.bool_or("free") | (F.min("id") < F.max("id"))
    return local.groupBy("part", "block").agg(*box, F.min("id").alias("only"), mixed.alias("mixed"), F.struct(F.first("c").alias("c")).alias("g"))


def _boxes(blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.array([[b.x0, b.x1, b.y0, b.y1] for b in blocks]), np.array([b.only for b in blocks]), np.array([b.mixed for b in blocks]), np.array([(b.part, b.block) for b in blocks])


def _sent(own: pa.RecordBatch, pairs: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Queries with the part and block that they ask, for pairs of both."""
    for at in range(0, len(pairs), 8192):
        some = pairs[at : at + 8192]
        to = names[some[:, 1]]
        yield pa.RecordBatch.from_arrays([*own.take(pa.array(some[:, 0])).columns[:6], pa.array(to[:, 0]), pa.array(to[:, 1])], [*_PLACE, "part", "block"])


def _of_places(places: DataFrame, corner: tuple[float, float, float, float], count: int, block_rows: int) -> DataFrame:
    kind = places.schema["c"].dataType.simpleString()
    local = _dealt(places, corner, count, block_rows, True)
    blocks = checkpointed(_blocks(local))
    several = blocks.groupBy("g").count().where("count > 1").select("g")
    held = blocks.join(several, "g").orderBy("part", "block").collect()
    if not held:
        return local.select("c", "x", "y", "nn")
    of: dict = {}
    for b in held:
        of.setdefault(b.g.c, []).append(b)
    of = {c: _boxes(bs) for c, bs in of.items()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.column_stack([batch.column(n).to_numpy() for n in ("part", "block")])
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = batch.slice(a, b - a)
                if (c := own.column("c")[0].as_py()) not in of:
                    continue
                boxes, only, mixed, names = of[c]
                others = (names != where[a]).any(axis=1)
                pairs = _asked(*_columns(own, _PLACE[1:]), boxes[others], only[others], mixed[others])
                yield from _sent(own, pairs, names[others])

    asked = checkpointed(local.where("nn is null or nn > 0").mapInArrow(ask, f"{_places(kind)}, part long, block long"))
    more = _answers(local, asked, kind).select("c", "x", "y", "nn")
    return local.select("c", "x", "y", "nn").unionByName(more).groupBy("c", "x", "y").agg(F.min("nn").alias("nn"))


def _answers(local: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """c, x, y, id and nn of each query, by the tree of the block that it asks."""
    copies = F.broadcast(checkpointed(asked.groupBy("part", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))))
    targets = local.join(copies, ["part", "block"]).select("part", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("query"), *_PLACE)
    queries = asked.join(copies, ["part", "block"]).select("part", "block", F.pmod(F.hash("x", "y"), "copies").alias("copy"), F.lit(1).alias("query"), *_PLACE)
    keys = ["part", "block", "copy"]
    names = ["c", "x", "y", "id"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            where = np.column_stack([batch.column(n).to_numpy() for n in (*keys, "query")])
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)] if len(where) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = batch.slice(a, b - a)
                if at != (at := tuple(where[a, :3])):
                    held, tree = [], None
                if not where[a, 3]:
                    held.append(_columns(own, _PLACE[1:5]))
                    continue
                tree = tree or Tree(*map(np.concatenate, zip(*held, strict=True)))
                best = tree.search(*_columns(own, _PLACE[1:]), False)
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), pa.array(best, mask=np.isinf(best))], [*names, "nn"])

    dealt = targets.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "query")
    return dealt.mapInArrow(answer, f"c {kind}, x double, y double, id long, nn double")
