"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The same operator as `simhash`, for a similarity instead of a few bits. Groups are what links connect.
Shingles are XXH64 of five lower-cased words, or of all words of a shorter text. Fingerprints and BK-trees
give candidates, the sets themselves give links:

* Texts of equal sets are one node, so copies never meet in pairs.
* A fingerprint has `BITS` bits: a bit is 1 if more than half of the set's mixed hashes have it. Sets of
  Jaccard similarity 0.8 have a cosine of 8/9 or more, so a bit differs with a probability of 0.151 at most,
  and `RADIUS` bits are about four standard deviations above the number that differ.
* At that radius no band of bits must be equal, so shards are values of bits drawn at random: as many bits
  (`width`) as leave about `SHARD_NODES` nodes to a value, drawn anew so often (`tables`) that a pair of
  similarity 0.8 shares none with probability `MISS`.
* Each shard has a BK-tree. A shard of more than `TREE_NODES` nodes is dealt into blocks, and each pair of
  blocks has a task: the tree of one, which the other's nodes search. A subtree whose nodes are all linked with
  the one that searches is passed over, so families of thousands of near copies cost little more than their size.
* Pairs with a set below `SHORT` shingles, whose fingerprints are coarse, are found exactly instead: such sets
  differ in two shingles at most, so what is left of both without one or two shingles is equal. Sets that share
  such a rest are linked to its smallest node.
* Nodes that candidates connect are a candidate group. Only the sets of such nodes are made, after a bitmap
  of fixed size has left out most other rows, and each goes to the task of its group.
* A group of more than `block_rows` nodes is dealt into blocks, to each of which its smallest node is added.
  Groups that these links do not make one meet again: all nodes outside the group's largest part against
  all others, a pair of blocks a task. So every pair of a group is compared unless links connect it already.

Null texts count as empty. Columns besides the id and the text are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm import simhash
from chronopanel.llm.common import stored

WORDS = 5
LEAST = 0.8
BITS = 192
RADIUS = 48
MISS = 0.005
SHARD_NODES = 32
TREE_NODES = 4096
#: Sets with fewer shingles are found by what is left of them without a few; so are those they can be similar to.
SHORT = 10
BLOCK_ROWS = 256
MARKS = 1 << 26
_LANES = BITS // 64
_CHUNK = 255  # counts of one byte each
_SHIFTS = np.arange(8, dtype=np.uint64)
_ONES = np.uint64(0x0101010101010101)
_PRINT = [f"p{k}" for k in range(_LANES)]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of a text without words, that of no word."""
    found = text.encode().lower().split()
    joined = (b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, simhash.SEED) for x in joined), np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits of a set of hashes, as words of 64. Each hash is mixed once for each word."""
    total = np.zeros((_LANES, 8, 8), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        x = hashes[at : at + _CHUNK, None] + np.arange(1, _LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        total += ((x[:, :, None] >> _SHIFTS) & _ONES).sum(axis=0).view(np.uint8).reshape(_LANES, 8, 8)
    ones = (2 * total > len(hashes)).transpose(0, 2, 1)  # word, byte, bit
    return np.packbits(ones.reshape(-1), bitorder="little").view("<u8")


def plan(nodes: int, least: float = LEAST) -> tuple[int, int]:
    """Bits of a shard's value, and how often they are drawn."""
    width = min(max(12, round(log2(max(nodes, 1) / SHARD_NODES))), 40)
    same = 1 - acos(2 * least / (1 + least)) / pi
    return width, ceil(log(MISS) / log(1 - same**width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def rests(hashes: np.ndarray, least: float = LEAST) -> list[int]:
    """Hashes of a set and of all its parts that it can have in common with a set similar to it, of which one is
    below SHORT; none for larger sets. They are sums, and the number of shingles left."""
    n, total = len(hashes), int(hashes.sum(dtype=np.uint64))
    if least * n > SHORT - 1:
        return []
    h = hashes.tolist()
    gone = [[], *([i] for i in range(n)), *([i, j] for i in range(n) for j in range(i))]
    left = ((total - sum(h[i] for i in x), n - len(x)) for x in gone if n and n - len(x) >= least * n)
    keys = {(t + k * 0x9E3779B97F4A7C15) & simhash._ALL for t, k in left}
    return [k - (k >> 63 << 64) for k in sorted(keys)]


def _set_hash(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, node (XXH64 of the set of shingles), the words of the fingerprint, rests and size of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, _LANES), np.uint64)
            left, sizes = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = shingles(text)
                nodes[row], prints[row] = _set_hash(found), fingerprint(found)
                left.append(rests(found))
                sizes.append(len(found))
            cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (nodes, *prints.T)]
            cols += [pa.array(left, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["id", "text_hash", "node", *_PRINT, "rests", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    words = ", ".join(f"{p} bigint" for p in _PRINT)
    return _rows(docs, id_col, text_col).mapInArrow(run, f"id {kind}, text_hash bigint, node bigint, {words}, rests array<bigint>, size int")


def _shards(nodes: DataFrame, width: int, tables: int) -> DataFrame:
    """node and its fingerprint, once for each shard: key."""
    rng = np.random.default_rng(simhash.SEED)
    drawn = np.zeros((BITS, tables))
    for k in range(tables):
        drawn[rng.choice(BITS, width, replace=False), k] = 2.0 ** np.arange(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.column_stack([batch.column(k + 1).to_numpy() for k in range(_LANES)]).astype("<i8")
            bits = np.unpackbits(words.view(np.uint8).reshape(batch.num_rows, -1), axis=1, bitorder="little")
            keys = (bits.astype(np.float64) @ drawn).astype(np.int64) + (np.arange(tables, dtype=np.int64) << 40)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * tables
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["node", *_PRINT, "keys"])

    kept = nodes.select("node", *_PRINT)
    return kept.mapInArrow(run, "node bigint, " + ", ".join(f"{p} bigint" for p in _PRINT) + ", keys array<bigint>").select("node", *_PRINT, F.explode("keys").alias("key"))


def _linked(nodes: list[int], prints: list[int], asking: list[bool], radius: int) -> list[tuple[int, int]]:
    """(node, smallest node it is linked with here) of one task's nodes, through a BK-tree. Nodes that do not ask are
    only in the tree. A tree node is its value, its children by distance, a node of its subtree, and whether the
    subtree has nodes that are not linked with that one."""
    parent = {x: x for x in nodes}

    def top(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    root: list | None = None
    for node, x, asks in zip(nodes, prints, asking, strict=True):
        own, todo = node, [root] if root and asks else []
        while todo:
            value, children, other, mixed = todo.pop()
            if not mixed and top(other) == own:
                continue
            d = (value[0] ^ x).bit_count()
            if d <= radius:
                b = top(value[1])
                if b != own:
                    parent[max(own, b)] = own = min(own, b)
            if len(children) <= 2 * radius:
                todo.extend(c for k, c in children.items() if -radius <= k - d <= radius)
            else:
                todo.extend(children[k] for k in range(max(d - radius, 1), d + radius + 1) if k in children)
        if root is None:
            root = [(x, node), {}, node, False]
            continue
        at = root
        while True:
            if not at[3] and top(at[2]) != own:
                at[3] = True
            d = (at[0][0] ^ x).bit_count()
            if d not in at[1]:
                at[1][d] = [(x, node), {}, node, False]  # d is 0 for another node of the same fingerprint
                break
            at = at[1][d]
    return [(x, r) for x in parent if (r := top(x)) != x]


def candidates(nodes: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Edges (a, b) between nodes (node and fingerprint of each) that connect just what candidates connect."""
    shards = _shards(nodes, *plan(nodes.count()))
    full = shards.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tree_nodes)
    full = stored(full.select("key", F.ceil(F.col("n") / tree_nodes).cast("int").alias("of")), "full-shards")
    block = F.expr("cast(pmod(xxhash64(node), coalesce(of, 1)) as int)")
    dealt = shards.join(full, "key", "left").withColumn("block", block)
    other = F.explode(F.when(F.col("of") > 1, F.sequence(F.lit(0), F.col("of") - 1)).otherwise(F.array(F.lit(0))))
    tasks = dealt.select("key", "node", *_PRINT, "block", other.alias("other"))
    tasks = tasks.select("key", F.least("block", "other").alias("tree"), F.greatest("block", "other").alias("query"), "node", *_PRINT, "block")
    tasks = tasks.select("key", "tree", "query", (F.col("block") == F.col("query")).alias("asks"), "node", *_PRINT)
    keys = ["key", "tree", "query"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, prints, asking, out = None, [], [], [], []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out.clear()
            return made

        for batch in batches:
            where = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            asks, node = (batch.column(k).to_pylist() for k in (3, 4))
            words = [batch.column(k + 5).to_numpy().view(np.uint64).tolist() for k in range(_LANES)]
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if at != tuple(where[lo]):
                    if len(nodes) > 1:
                        out.extend(_linked(nodes, prints, asking, radius))
                    at, nodes, prints, asking = tuple(where[lo]), [], [], []
                nodes += node[lo:hi]
                asking += asks[lo:hi]
                prints += [sum(w << (64 * k) for k, w in enumerate(x)) for x in zip(*(w[lo:hi] for w in words), strict=True)]
            if len(out) > 10_000:
                yield batch_of()
        if len(nodes) > 1:
            out.extend(_linked(nodes, prints, asking, radius))
        if out:
            yield batch_of()

    found = tasks.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(run, "a bigint, b bigint")
    return found.where("a <> b").distinct()


def short_candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes (node, rests) that share a rest, each to the smallest of those that do."""
    keyed = nodes.select("node", F.explode("rests").alias("rest"))
    least = keyed.groupBy("rest").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("rest", "b")
    return keyed.join(least, "rest").select(F.col("node").alias("a"), "b").where("a <> b").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and set (its hashes' bytes) of the rows of docs whose key is wanted, and of few others."""
    at = F.pmod(F.col("key"), F.lit(MARKS))
    words = wanted.groupBy((at / 32).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(key, {MARKS}), 32) as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(MARKS // 32, np.uint32)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy() % MARKS
            some = batch.filter(pa.array((shared.value[key // 32] >> (key % 32).astype(np.uint32)) & np.uint32(1) == 1))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingles(x).tobytes() for x in some.column(1).to_pylist()], pa.binary())], ["key", "set"])

    return _rows(docs, id_col, text_col).select(F.xxhash64("id", "text_hash").alias("key"), "text").mapInArrow(run, "key bigint, set binary")


def _compared(tasks: DataFrame, least: float) -> DataFrame:
    """Edges (a, b), b < a, of one task's nodes: those of a query against all others of the task, but for pairs
    that links or an equal root connect. The columns are task's key (grp, x, y), node, root, query and set."""
    key = ["grp", "x", "y"]

    def links(rows: dict[int, tuple[int, bool, bytes]]) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        first: dict[int, int] = {}
        for node, (root, _, _) in rows.items():
            parent[top(node)] = top(first.setdefault(root, node))
        sets = {node: np.frombuffer(s, np.uint64) for node, (_, _, s) in rows.items()}
        for a, (_, query, _) in rows.items():
            if query:
                for b in rows:
                    small, large = sorted((len(sets[a]), len(sets[b])))
                    if small >= least * large and top(a) != top(b) and similarity(sets[a], sets[b]) >= least:
                        parent[top(a)] = top(b)
                        yield max(a, b), min(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, {}, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*key, "node", "root", "query", "set")]
            for *k, node, root, query, s in zip(*columns, strict=True):
                if k != at:
                    out.extend(links(rows))
                    at, rows = k, {}
                rows[node] = (root, query or (node in rows and rows[node][1]), s)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out.clear()
        out.extend(links(rows))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return tasks.select(*key, "node", "root", "query", "set").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id_col, text_hash and root (the group's smallest node) of each row."""
    marked = stored(marks(docs, id_col, text_col), "marks")
    row = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "text_hash"))
    of_set = [F.min(p).alias(p) for p in (*_PRINT, "rests", "size")]  # equal sets have one fingerprint
    nodes = marked.groupBy("node").agg(row.alias("row"), *of_set).select("node", F.xxhash64("row.id", "row.text_hash").alias("key"), *_PRINT, "rests", "size")
    nodes = stored(nodes, "nodes")

    near = candidates(nodes.where(F.col("size") >= SHORT)).union(short_candidates(nodes))
    near = simhash.components(near)
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    block = lambda n: F.expr(f"cast(pmod(xxhash64(node), {n}) as int)")
    dealt = stored(near.join(sizes, "root").withColumnRenamed("root", "grp").withColumn("block", block("blocks")).join(nodes.select("node", "key"), "node"), "candidates")
    sets = stored(_sets(docs, dealt, id_col, text_col).join(dealt.select("key", "node"), "key").select("node", "set"), "sets")

    everywhere = F.when(F.col("node") == F.col("grp"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    once = dealt.select("grp", "node", F.explode(everywhere).alias("x"), F.lit(0).alias("y"), F.col("node").alias("root"), F.lit(True).alias("query"))
    edges = stored(_compared(once.join(sets, "node"), least), "links")

    found = simhash.components(edges)
    rooted = dealt.where("blocks > 1").join(found, "node", "left").select("grp", "node", "block", "blocks", F.coalesce("root", "node").alias("root"))
    parts = rooted.groupBy("grp", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("grp").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("most < all")
    main = main.select("grp", "main", F.ceil((F.col("all") - F.col("most")) / block_rows).cast("int").alias("others"))
    again = stored(rooted.join(main, "grp"), "again")
    if not again.isEmpty():
        other = again.where("root <> main").select("grp", "node", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), block("others").alias("y"), F.lit(True).alias("query"))
        each = again.select("grp", "node", "root", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("y"), F.lit(False).alias("query"))
        found = simhash.components(edges.union(_compared(other.unionByName(each).join(sets, "node"), least)))
    labels = marked.join(found, "node", "left")
    return labels.select(F.col("id").alias(id_col), "text_hash", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that groups() leaves, one of each group, chosen as simhash.one_of_each() does."""
    return simhash.first_of_each(docs, groups(docs, id_col, text_col, **options), id_col, text_col)
