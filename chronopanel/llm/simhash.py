"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint has 64 bits: a bit is 1 if more than half of the document's word shingles have it set in
their XXH64. Two documents are linked if their fingerprints differ in at most `radius` bits; groups are
what links connect.

Search for links:

* Equal fingerprints are one node, so copies never meet in pairs.
* The bits are cut into radius + 1 bands. Fingerprints within the radius agree in a whole band, so a
  shard is one value of one band, and no link is lost between shards.
* A shard of more than `shard_rows` nodes is dealt into blocks, and each pair of blocks is a task of its
  own: a tree is never larger than shard_rows, wherever the hashes gather. (Trees of all shards have no
  size bound, so each is sent to the tasks of its own shard instead of to every executor.)
* In a BK-tree a child hangs from its parent by their Hamming distance. A search at distance d from a
  node follows only the edges from d - radius to d + radius.
* A task reports a node's links as one edge to the smallest node of the group it has found, so a dense
  shard gives as many edges as nodes.

Groups grow together by alternating star contraction, whose rounds are written to the shared folder.

Null texts count as empty; texts without words have fingerprint zero and are linked like any others.
Repeated rows and ids stay, each with its group. Null ids are no group's smallest unless it has no other.
Columns besides the id and the text are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import kept_apart, stored

RADIUS = 3
SHINGLE = 3
SEED = 42
SHARD_ROWS = 4096
_CHUNK = 1 << 16


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    found = text.encode().lower().split()
    total, ones = 0, np.zeros(64, np.int64)
    last = max(1, len(found) - words + 1) if found else 0
    for at in range(0, last, _CHUNK):
        some = found[at : min(last, at + _CHUNK) + words - 1]
        shingles = zip(*(some[k:] for k in range(words)), strict=False) if len(found) >= words else [found]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """id_col, fingerprint (bigint with the fingerprint's bits) and text_hash (XXH64) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [np.array([f(x) for x in texts], np.uint64).view(np.int64) for f in (lambda x: fingerprint(x, words), lambda x: xxhash.xxh64_intdigest(x.encode(), SEED))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], ["id", "fingerprint", "text_hash"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint bigint, text_hash bigint").withColumnRenamed("id", id_col)


class BKTree:
    """Integers under Hamming distance. A node is its value and its children by distance."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = (x, {})
                return
            node = node[1][d]

    def near(self, x: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= self.radius:
                yield value
            if children:
                if len(children) <= 2 * self.radius:
                    todo.extend(c for k, c in children.items() if -self.radius <= k - d <= self.radius)
                else:
                    todo.extend(children[k] for k in range(max(d - self.radius, 1), d + self.radius + 1) if k in children)


def _edges(values: list[int], blocks: list[int], tree_block: int, query_block: int, radius: int) -> list[tuple[int, int]]:
    """(node, smallest node it is linked with here) of one task's nodes."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    tree = BKTree(radius)
    own = [v for v, b in zip(values, blocks, strict=True) if b == tree_block]
    if tree_block != query_block:
        for x in own:
            tree.add(x)
    for x in own if tree_block == query_block else [v for v, b in zip(values, blocks, strict=True) if b == query_block]:
        for y in tree.near(x):
            a, b = top(x), top(y)
            parent[max(a, b)] = min(a, b)
        if tree_block == query_block:
            tree.add(x)
    return [(x, r) for x in parent if (r := top(x)) != x]


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, b < a, that connect just what links connect."""
    width = 64 // (radius + 1)
    cuts = [(k * width, 64 - k * width if k == radius else width) for k in range(radius + 1)]
    value = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in cuts]
    shards = nodes.select("fp", F.posexplode(F.array(*value)).alias("band", "value"))
    if width > 16:  # then values are as many as nodes, and this table has no bound
        sizes = shards.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    else:  # one row for each value of each band: at most (radius + 1) << 16
        sizes = F.broadcast(shards.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = shards.join(sizes, ["band", "value"]).select(
        "band", "value", "fp", F.ceil(F.col("n") / shard_rows).cast("int").alias("of"), F.expr(f"cast(pmod(xxhash64(fp), ceil(n / {shard_rows})) as int)").alias("block")
    )
    tasks = dealt.select("band", "value", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")).select(
        "band", "value", F.least("block", "other").alias("tree"), F.greatest("block", "other").alias("query"), "block", "fp"
    )
    key = ["band", "value", "tree", "query"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, blocks, out = None, [], [], []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out.clear()
            return made

        def signed() -> None:
            # Python's bit_count() takes the magnitude of a negative number, so nodes are unsigned here
            found = _edges([v & _ALL for v in values], blocks, at[2], at[3], radius)
            out.extend((a - (a >> 63 << 64), b - (b >> 63 << 64)) for a, b in found)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*key, "block", "fp")]
            for *k, block, fp in zip(*columns, strict=True):
                if k != at:
                    if len(values) > 1:
                        signed()
                    at, values, blocks = k, [], []
                values.append(fp)
                blocks.append(block)
            if len(out) > 10_000:
                yield batch_of()
        if len(values) > 1:
            signed()
        if out:
            yield batch_of()

    return tasks.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a bigint, b bigint")


_ALL = (1 << 64) - 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): alternating star contraction until nothing changes."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = stored(edges.where("a <> b").distinct(), "edges")
    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id_col, fingerprint (bigint), text_hash, root (the group's smallest fingerprint) and component_id (its
    smallest id) of each row."""
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("least")), "nodes")
    groups = components(links(nodes, radius, shard_rows))
    rooted = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(smallest, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id")
    return marked.join(labels, "fingerprint").select(id_col, "fingerprint", "text_hash", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates() leaves, one of each group: that of the smallest id (no id
    comes last), then of the smallest hash of its text, and one of rows that repeat both."""
    return first_of_each(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that one_of_each() leaves of groups (id_col, text_hash and root of each row)."""
    return kept_apart(docs, lambda d, key, text: _first(d, groups.select(F.col(id_col).alias(key), "text_hash", "root"), key, text), id_col, text_col)


def _first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    first = F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash")))
    kept = groups.groupBy("root").agg(first.alias("first")).select(F.col("first.no").alias("__no"), F.xxhash64("first.id").alias("__id"), F.col("first.hash").alias("__hash"), F.col("first.id").alias("__own"))
    key = ["__no", "__id", "__hash"]
    keyed = docs.withColumns({"__no": F.col(id_col).isNull(), "__id": F.xxhash64(id_col), "__hash": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    joined = keyed.join(kept, key).where(F.col(id_col).eqNullSafe(F.col("__own")))
    return joined.withColumn("__copy", F.row_number().over(Window.partitionBy(*key).orderBy(*key))).where("__copy = 1").select(*docs.columns)
