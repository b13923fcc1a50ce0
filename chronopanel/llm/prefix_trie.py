"""Trie of the prefixes that conversations share, from a sorted array of conversations.

Conversations are rebuilt (see `rebuilt`), sorted by their turns, and the longest common prefix (LCP) of each with the
one before it is taken. A Cartesian tree over that array has the trie's branchings as nodes, each an interval of
conversations: it reaches from a row whose LCP is below a depth to the next one that is, the all-nearest-smaller-values
problem. Nodes of equal LCP in one interval are one, and depths between a branching and the one above it are filled in
with the same interval. Every figure of a node is a sum or a minimum over its interval.

In parallel: the array is range-partitioned into blocks. A block keeps a stack of open depths; a row's LCP closes all
deeper ones. What a block cannot close (at most one node for each depth) it hands on, and the minimum of its LCPs so far
says which of the nodes handed to it still go on: its rows' share in these is a partial row. Partial rows, a few for each
block, are joined in order by depth.

No row grows with a conversation: it is cut into segments of `SEGMENT` turns, each under a hash of all turns before it,
so a segment is a small trie of its own below that prefix. The turn after a segment is looked at, but belongs to the next.
Turns are 128 bits of SHA-256 and a size, so texts are read once and never shuffled. Ranks in a conversation are counted
in range partitions and carried over their borders; the only rows that come to the driver are borders of partitions.
Conversations that are equal lie side by side, ordered by id, in as many blocks as they need. Of a node whose ids go on
over several blocks one task hashes the blocks' joined ids, piece by piece, as SHA-256 is serial.

Turns are ordered by number (null first), equal numbers by the hash of role and text; repeated rows are turns each. Null
roles and texts are empty. Rows without a conversation id are left out. Without any conversation there is no node, not even
the root. Other columns are not passed on, so that no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import stored

#: Conversation c begins with turns of c - c % FAMILY, fewer than HEADS of them.
FAMILY, HEADS = 5, 9
SEGMENT = 64
#: Rows of a range partition, about, and how many there are at most: two keys of each come to the driver and all tasks.
BLOCK_ROWS = 1 << 16
MAX_BLOCKS = 20_000
#: Segments that one window goes over.
RUN = 1024
_SYM, _HEAD = 16, 24
_SUMS = ("n", "rest", "own", "leaves")
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_FIELDS = [
    *[(name, pa.int64()) for name in _NODE], ("ends_sha256", pa.string()), ("ref_part", pa.int64()), ("ref_depth", pa.int64()), ("ref_opened", pa.int64()),
    ("part", pa.int64()), ("at_depth", pa.int64()), ("opened", pa.int64()), *[(name, pa.int64()) for name in _SUMS], ("less", pa.int64()), ("path", pa.int64()), ("ends", pa.string()),
]
_SCHEMA = pa.schema(_FIELDS)
_TYPES = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in _FIELDS)


def head_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, sym (the turn's hash) and size (bytes of its text)."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((role_col, "role"), (text_col, "text"))]
    rows = conversations.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), *said)
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    sym = F.unhex(F.substring(F.sha2(framed, 256), 1, 2 * _SYM))
    return rows.where("conv is not null").select("conv", "turn", sym.alias("sym"), F.octet_length("text").cast("bigint").alias("size"))


def _parts(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_BLOCKS, -(-rows.count() // BLOCK_ROWS)))


def _ranked(rows: DataFrame, key: str, order: list[str], rank: str) -> DataFrame:
    """rows (stored) with their rank within the key. Equal rows may go to different partitions."""
    names = rows.columns
    spread = rows.withColumn("__salt", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(_parts(rows), key, *order, "__salt").sortWithinPartitions(key, *order, "__salt").select(*names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for k in batch.column(names.index(key)).to_pylist():
                n = n + 1 if k == last else 1
                last = k
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int64()), pa.array(at, pa.int64())], [*names, "part", "at"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part long, at long"
    counted = stored(dealt.mapInArrow(count, schema), "ranks")
    borders = counted.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(F.struct(key, "at"))["at"].alias("n")).orderBy("part").collect()
    carried, last, total = [], None, 0
    for b in borders:
        if b.lo == last:
            carried.append((b.part, b.lo, total))
        total = b.n + (total if b.lo == b.hi == last else 0)
        last = b.hi
    kind = rows.schema[key].dataType.simpleString()
    more = rows.sparkSession.createDataFrame(carried, f"part long, {key} {kind}, before long")
    return counted.join(F.broadcast(more), ["part", key], "left").select(*names, (F.col("at") + F.coalesce("before", F.lit(0))).alias(rank))


def rebuilt(turns: DataFrame) -> DataFrame:
    """c, d, sym, size of the turns of rebuilt conversations, and for each an end: d after its last turn, sym null.

    Conversation c begins with the first h turns of c - c % 5, and goes on with its own after its first h, where h is
    the CRC-32 of its decimal id modulo 9."""
    placed = _ranked(stored(turns, "turns"), "conv", ["turn", "sym"], "n")
    convs = placed.where("n = 1").select(F.col("conv").alias("c"), (F.col("conv") - F.col("conv") % FAMILY).alias("p"), head_turns(F.col("conv")).alias("h"))
    first = placed.where((F.col("n") < HEADS) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("p"), "n", "sym", "size")
    heads = convs.join(first, "p").where("n <= h").select("c", F.lit(0).alias("which"), "n", "sym", "size")
    own = placed.where(F.col("n") > head_turns(F.col("conv"))).select(F.col("conv").alias("c"), F.lit(1).alias("which"), "n", "sym", "size")
    ends = convs.select("c", F.lit(2).alias("which"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("sym"), F.lit(0).cast("bigint").alias("size"))
    return _ranked(stored(heads.unionByName(own).unionByName(ends), "rebuilt"), "c", ["which", "n"], "d").select("c", "d", "sym", "size")


def _before(rows: DataFrame, how: dict[str, str], backwards: bool = False) -> DataFrame:
    """rows by c and s, and for each column of `how` (sum or bit_xor) what stands before the row: 0 if nothing does."""
    turned = lambda x: F.col(x).desc() if backwards else F.col(x)
    upto = Window.unboundedPreceding, -1
    inner, outer = Window.partitionBy("c", "run").orderBy(turned("s")).rowsBetween(*upto), Window.partitionBy("c").orderBy(turned("run")).rowsBetween(*upto)
    over = lambda name, of, w: F.coalesce(getattr(F, how[name])(of).over(w), F.lit(0))
    rows = rows.withColumn("run", F.floor(F.col("s") / RUN))
    totals = rows.groupBy("c", "run").agg(*[getattr(F, f)(x).alias(x) for x, f in how.items()]).select("c", "run", *[over(x, x, outer).alias(f"__{x}") for x in how])
    near = rows.withColumns({f"before_{x}": over(x, x, inner) for x in how}).join(totals, ["c", "run"])
    joined = {f"before_{x}": F.col(f"before_{x}").bitwiseXOR(F.col(f"__{x}")) if f == "bit_xor" else F.col(f"before_{x}") + F.col(f"__{x}") for x, f in how.items()}
    return near.withColumns(joined).drop("run", *[f"__{x}" for x in how])


def segments(turns: DataFrame, length: int = SEGMENT) -> DataFrame:
    """c, s, key, sizes, ended of each segment: key holds s, a hash of the turns before and the turns, with the one
    after the segment. A segment without turns stands for a conversation that ends where it begins."""
    s = F.floor((F.col("d") - 1) / length)
    both = F.when(((F.col("d") - 1) % length == 0) & (F.col("d") > 1), F.array(s - 1, s)).otherwise(F.array(s))
    rows = turns.select("c", F.explode(both).alias("s"), F.struct("d", "sym", "size").alias("t"))
    lists = rows.groupBy("c", "s").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    said = F.filter("ts", lambda t: t["sym"].isNotNull())
    syms = F.aggregate(said, F.lit(b"").cast("binary"), lambda a, t: F.concat(a, t["sym"]))
    table = stored(lists.select("c", "s", syms.alias("syms"), F.transform(said, lambda t: t["size"]).alias("sizes"), (F.size(said) < F.size("ts")).alias("ended")), "segments")
    deep = (F.col("s") > 0) | (F.length("syms") >= length * _SYM)
    own = {x: F.xxhash64(F.lit(seed), "s", F.substring("syms", 1, length * _SYM)) for x, seed in (("a", 1), ("b", 2))}
    long = _before(table.where(deep).withColumns(own), {"a": "bit_xor", "b": "bit_xor"})
    short = table.where(~deep).withColumns({"before_a": F.lit(0).cast("bigint"), "before_b": F.lit(0).cast("bigint")})
    number = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    key = F.concat(number("s"), number("before_a"), number("before_b"), "syms")
    return short.unionByName(long.drop("a", "b")).select("c", "s", key.alias("key"), "sizes", "ended")


class _Blocks:
    """Rows in order of key and conversation, in blocks; borders[block] holds the last key before and the first after."""

    def __init__(self, rows: DataFrame, name: str):
        names = rows.columns
        dealt = rows.repartitionByRange(_parts(rows), "key", "c").sortWithinPartitions("key", "c")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n = TaskContext.get().partitionId(), 0
            for batch in batches:
                at = pa.array(range(n, n + batch.num_rows), pa.int64())
                n += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), at], [*names, "part", "at"])

        self.rows = stored(dealt.mapInArrow(number, kinds + ", part long, at long"), name)
        ends = self.rows.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("part").collect()
        self.borders = {b.part: (bytes(ends[i - 1].hi) if i else None, bytes(ends[i + 1].lo) if i + 1 < len(ends) else None) for i, b in enumerate(ends)}

    def mapped(self, scan, schema: str) -> DataFrame:
        """scan(part, borders, rows) of each block, whose rows come in order, each with the LCPs before and after it."""
        borders, names = self.borders, self.rows.columns
        dealt = self.rows.repartition(len(borders) or 1, "part").sortWithinPartitions("part", "at")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for a in range(0, b.num_rows, 1024) for r in zip(*[c.to_pylist() for c in b.slice(a, 1024).columns], strict=True))
            yield from scan(_with_prefixes((dict(zip(names, r, strict=True)) for r in rows), borders))

        return dealt.mapInArrow(run, schema)


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys share, -1 if they belong to different tries."""
    if a is None or b is None or a[:_HEAD] != b[:_HEAD]:
        return -1
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return (n - _HEAD) // _SYM
    lo, hi = _HEAD, n  # equal up to lo, not up to hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return (lo - _HEAD) // _SYM


def _with_prefixes(rows: Iterator[dict], borders: dict) -> Iterator[tuple[dict, int, int]]:
    """Each row with its LCPs; a task may have several blocks, one after another."""
    held, before = None, -1
    for row in rows:
        if held is not None and held["part"] == row["part"]:
            after = common(held["key"], row["key"])
            yield held, before, after
            before = after
        else:
            if held is not None:
                yield held, before, common(held["key"], borders[held["part"]][1])
            before = common(borders[row["part"]][0], row["key"])
        held = row
    if held is not None:
        yield held, before, common(held["key"], borders[held["part"]][1])


def _figures(row: dict, before: int, after: int, length: int) -> tuple[list[int], int, int]:
    """Sums of sizes along a segment, bytes of nodes that it is the first to have, and whether a leaf ends with it."""
    upto = [0]
    for x in row["sizes"]:
        upto.append(upto[-1] + x)
    turns = len(upto) - 1
    own = upto[min(turns, length)] - upto[min(max(before, 0), length)]
    leaf = row["ended"] and after < turns and (turns > 0 or row["s"] == 0)
    return upto, own, int(leaf)


def _below(rows: DataFrame, length: int) -> DataFrame:
    """rows with rest, own and leaves of the same conversation's later segments, summed."""
    zeros = [F.lit(0).cast("bigint").alias(f"before_{x}") for x in ("rest", "own", "leaves")]
    deep = stored(rows.where("s > 0"), "deep")
    if deep.isEmpty():
        return rows.select("*", *zeros)

    def scan(found: Iterator[tuple[dict, int, int]]) -> Iterator[pa.RecordBatch]:
        out = []
        for row, before, after in found:
            upto, own, leaf = _figures(row, before, after, length)
            out.append((row["c"], row["s"], upto[min(len(upto) - 1, length)], own, leaf))
            if len(out) == 4096:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)

    names = ["c", "s", "rest", "own", "leaves"]
    sums = _Blocks(deep, "deep_blocks").mapped(scan, ", ".join(f"{x} long" for x in names))
    starts = rows.where((F.col("s") == 0) & (F.size("sizes") >= length)).select("c", "s", *[F.lit(0).cast("bigint").alias(x) for x in names[2:]])
    later = _before(stored(sums.unionByName(starts), "sums"), {x: "sum" for x in names[2:]}, backwards=True).drop(*names[2:])
    is_long = (F.col("s") > 0) | (F.size("sizes") >= length)
    return rows.where(~is_long).select("*", *zeros).unionByName(rows.where(is_long).join(later, ["c", "s"]).select(*rows.columns, *[f"before_{x}" for x in names[2:]]))


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [schema.field(i).type for i in range(len(names))] if schema else [pa.int64()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class _Node:
    """An open node of a block, or a block's share in one that was open before it (opened is 0)."""

    def __init__(self, opened: int, path: int = 0, less: int = 0):
        self.opened, self.path, self.less = opened, path, less
        self.sums, self.least, self.children = [0, 0, 0, 0], None, 0
        self.ends, self.waiting = [], []

    def add(self, sums: list[int], least: int) -> None:
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]
        self.least = least if self.least is None else min(self.least, least)


def saved(sums: list[int], path: int, less: int) -> int:
    """Bytes of the members' turns from this node on, less those of the distinct nodes below it."""
    n, rest, own, _ = sums
    return rest - n * path - (own - less)


def _scan(found: Iterator[tuple[dict, int, int]], length: int) -> Iterator[pa.RecordBatch]:
    """Nodes that open and close in a block, and partial rows of the others."""
    out: list[tuple] = []
    stack: list[_Node] = []
    part, s = None, 0
    blank = (None,) * 3

    def close() -> None:
        depth = len(stack) - 1
        node = stack.pop()
        whole = node.opened == 1 and not crossing
        emitted = 1 <= depth <= length or (depth == 0 and s == 0)
        if whole:
            out.extend((*row[:2], node.least, *row[3:]) for row in node.waiting)
            if emitted:
                text = hashlib.sha256(",".join(node.ends).encode()).hexdigest()
                row = (node.least, s * length + depth, None, node.sums[0], node.children, node.sums[3], saved(node.sums, node.path, node.less), text, *blank, *(None,) * 10)
                stack[-1].waiting.append(row) if stack else out.append(row)
        else:
            out.extend((*row[:8], part, depth, node.opened, *row[11:]) for row in node.waiting)
            above = (part, depth - 1, stack[-1].opened) if stack else blank
            out.append((node.least, s * length + depth if emitted else None, None, None, node.children, None, None, None, *above, part, depth, node.opened, *node.sums, node.less, node.path, ",".join(node.ends)))
        if stack:
            stack[-1].add(node.sums, node.least)

    crossing = False
    for row, before, after in found:
        if row["part"] != part:
            crossing = True
            while stack:
                close()
            part, s = row["part"], row["s"]
            stack.extend(_Node(0) for _ in range(before + 1))
        crossing = False
        upto, own, leaf = _figures(row, before, after, length)
        while len(stack) - 1 > before:
            close()
        s = row["s"]
        turns = len(upto) - 1
        for depth in range(len(stack), turns + 1):
            if depth:
                stack[-1].children += 1
            path = upto[max(depth - 1, 0)]
            stack.append(_Node(1, path, path - min(path, upto[max(before, 0)])))
        stack[-1].add([1, upto[min(turns, length)] + row["before_rest"], own + row["before_own"], leaf + row["before_leaves"]], row["c"])
        if row["ended"] and (turns or s == 0):
            stack[-1].ends.append(str(row["c"]))
        if len(out) >= 4096:
            yield _batch(out, _SCHEMA.names, _SCHEMA)
            out.clear()
    crossing = True
    while stack:
        close()
    if out:
        yield _batch(out, _SCHEMA.names, _SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial rows in order of depth and block, joined to nodes; refs names the partial rows of each."""
    names = [*_NODE, "ends_sha256", "ref_part", "ref_depth", "ref_opened", "at_depth", "refs"]
    kinds = [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 4 + [pa.list_(pa.struct([("part", pa.int64()), ("opened", pa.int64())]))]
    node, first, sha, refs = None, None, None, []

    def done() -> pa.RecordBatch:
        row = (
            node.least, first["depth"], None, node.sums[0], node.children, node.sums[3], saved(node.sums, first["path"], first["less"]), sha.hexdigest(),
            first["ref_part"], first["ref_depth"], first["ref_opened"], first["at_depth"], refs,
        )
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            for row in batch.slice(at, 16).to_pylist():
                if row["opened"]:
                    if node:
                        yield done()
                    node, first, sha, refs, some = _Node(1), row, hashlib.sha256(), [], False
                node.add([row[x] for x in _SUMS], row["conv_id"])
                node.children += row["n_children"]
                refs.append({"part": row["part"], "opened": row["opened"]})
                if row["ends"]:
                    sha.update((("," if some else "") + row["ends"]).encode())
                    some = True
    if node:
        yield done()


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", length: int = SEGMENT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    rows = stored(segments(rebuilt(turns), length), "keys")
    blocks = _Blocks(stored(_below(rows, length), "weighted"), "blocks")
    found = stored(blocks.mapped(lambda r: _scan(r, length), _TYPES), "trie")
    partial = found.where("part is not null").repartition("at_depth").sortWithinPartitions("at_depth", "part", "opened")
    merged_types = ", ".join(f"{x} long" for x in _NODE) + ", ends_sha256 string, ref_part long, ref_depth long, ref_opened long, at_depth long, refs array<struct<part: long, opened: long>>"
    merged = stored(partial.mapInArrow(_merge, merged_types), "merged")
    names = [*_NODE, "ends_sha256"]
    above = merged.select(F.col("at_depth").alias("ref_depth"), F.col("conv_id").alias("__parent"), F.explode("refs").alias("r"))
    above = above.select("ref_depth", "__parent", F.col("r.part").alias("ref_part"), F.col("r.opened").alias("ref_opened"))
    nodes = found.where("part is null")
    refs = ["ref_part", "ref_depth", "ref_opened"]
    pending = nodes.where("ref_part is not null").select(*names, *refs).unionByName(merged.where("depth is not null").select(*names, *refs))
    named = pending.join(above, refs, "left").withColumn("parent_conv_id", F.col("__parent")).select(*names)
    return nodes.where("ref_part is null").select(*names).unionByName(named)
