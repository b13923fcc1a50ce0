"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

Each document is its ids and an end id. What fills whole sequences is cut off first. The rest of the
documents of a block is taken in descending length: each goes to the sequence of lowest cost that still
has room, where a piece of n tokens costs linear * n + quadratic * n * n (attention stays within a
document). A block opens just as many sequences as its tokens need; a piece that fits none is cut at the
largest room left. So a block wastes less than one sequence, whatever the lengths are.

Blocks are runs of rows within one input partition, bounded in tokens. Nothing is shuffled, no task holds
more than a block, and a task that runs again gives the same rows. Null texts count as empty and give one
piece, the end id. Other columns of the input are not passed on; rows with equal or null ids are packed
each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.byte_bpe import encoder

CAPACITY = 1024
BLOCK_TOKENS = 1 << 21
#: The end of text in the vocabulary file, taken as one token where it stands in a text, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start within it, length, sequence, offset there) of items shorter than the capacity."""
    total = sum(lengths)
    count = -(-total // capacity)
    cost, room = np.zeros(count), np.full(count, capacity)
    queue = [[] for _ in range(capacity + 1)]
    for item, n in enumerate(lengths):
        queue[n].append((item, 0))
    out = []
    for n in range(capacity, 0, -1):
        for item, start in queue[n]:
            fits = np.where(room >= n, cost, np.inf)
            k = int(fits.argmin())
            size = n
            if room[k] < n:
                k = int(room.argmax())
                size = int(room[k])
                queue[n - size].append((item, start + size))
            out.append((item, start, size, k, int(capacity - room[k])))
            room[k] -= size
            cost[k] += linear * size + quadratic * size * size
    return out


def pack(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1 / 256,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each piece: the document's id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id and offset."""

    def tokens(text: str) -> np.ndarray:
        own = encoder(ranks_path)
        parts = [own.encode(x) for x in text.split(SPECIAL)]
        between = np.array([SPECIAL_ID], "<u4")
        joined = [x for part in parts for x in (part, between)][:-1]
        return np.concatenate((*joined, np.array([end_id], "<u4")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        used, held, size, rows = 0, [], 0, []

        def flush() -> None:
            nonlocal used, held, size
            placed = assign([len(x[2]) for x in held], capacity, linear, quadratic)
            for item, start, n, k, offset in placed:
                doc, before, ids, doc_tokens = held[item]
                rows.append((doc, before + start, n, ids[start : start + n].tobytes(), doc_tokens, first + used + k, offset))
            used += -(-size // capacity)
            held, size = [], 0

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens(text or "")
                whole = len(ids) // capacity
                for k in range(whole):
                    rows.append((doc, k * capacity, capacity, ids[k * capacity : (k + 1) * capacity].tobytes(), len(ids), first + used, 0))
                    used += 1
                if rest := len(ids) - whole * capacity:
                    held.append((doc, whole * capacity, ids[whole * capacity :].copy(), len(ids)))
                    size += rest
                    if size >= block_tokens:
                        flush()
                if len(rows) >= 2048:
                    yield batch_of()
        if held:
            flush()
        if rows:
            yield batch_of()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
