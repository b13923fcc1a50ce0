"""Byte-level BPE encoding and decoding by tree reduction.

A text is halved until a half fits a leaf, leaves are encoded alone, and neighbours are joined by
encoding anew only a window around their seam. The window grows until the tokens outside it are proven
unchanged:

* Between a character that is not white space and one that is, every match of the pre-tokenizer ends,
  whatever stands further away. So tokens before such a place on the left, and after one on the right,
  are the same in the halves and in the whole.
* Inside one match, a token sequence is the encoding of its bytes exactly if each pair of neighbouring
  tokens is the encoding of the pair's bytes. So it is enough that the window's outermost tokens form
  such pairs with their outer neighbours.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Columns of the input other
than the id and the text are not passed on, so that no name can clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 1024
SEAM = 32
WIDE = 1 << 16
_BLANKS = " \n\t\r"


class TreeEncoder:
    def __init__(self, ranks_path: str, leaf: int = LEAF):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.core = self.encoding._core_bpe
        self.leaf = leaf

    def encode(self, text: str) -> np.ndarray:
        """The ids of text as unsigned 32-bit integers."""
        return self._tree(text, 0, len(text)) if text else np.empty(0, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of leaves of ids, concatenated up the tree."""
        if len(ids) <= 4 * self.leaf:
            return self.encoding.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _plain(self, text: str) -> np.ndarray:
        if len(text) > WIDE:
            return self._unbroken(text)
        return self.encoding.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, "<u4")

    def _tree(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if _break_at(text, mid):
            return np.concatenate((left, right))
        width = SEAM
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            start = next((p for p in range(mid - 1, a, -1) if _break_at(text, p)), lo if a == lo else None)
            stop = next((p for p in range(mid + 1, b) if _break_at(text, p)), hi if b == hi else None)
            if start is not None and stop is not None:
                break
            width *= 2
        keep = len(left) - len(self._plain(text[start:mid]))
        skip = len(self._plain(text[mid:stop]))
        return np.concatenate((left[:keep], self._plain(text[start:stop]), right[skip:]))

    def _unbroken(self, text: str) -> np.ndarray:
        """A long stretch: match by match, and long matches by a tree of their bytes."""
        parts = [self._bytes(m.group().encode()) for m in _pattern().finditer(text)]
        return np.array([i for part in parts for i in part], "<u4")

    def _bytes(self, piece: bytes) -> list[int]:
        if len(piece) <= 4 * self.leaf:
            return self.core.encode_single_piece(piece)
        half = len(piece) // 2
        left, right = self._bytes(piece[:half]), self._bytes(piece[half:])
        size = self.encoding.decode_single_token_bytes
        width = 4
        while True:
            outer_left, outer_right = left[:-width], right[width:]
            middle = self.core.encode_single_piece(b"".join(map(size, left[-width:] + right[:width])))
            if self._pair(outer_left[-1:] + middle[:1]) and self._pair(middle[-1:] + outer_right[:1]):
                return outer_left + middle + outer_right
            width *= 2

    def _pair(self, ids: list[int]) -> bool:
        """Whether these one or two tokens are the encoding of their own bytes."""
        return len(ids) < 2 or self.core.encode_single_piece(self.encoding.decode_bytes(ids)) == ids


def _break_at(text: str, p: int) -> bool:
    return text[p] in _BLANKS and not text[p - 1].isspace()


@lru_cache(1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@lru_cache(4)
def encoder(ranks_path: str, leaf: int = LEAF) -> TreeEncoder:
    """One encoder for each Python worker."""
    return TreeEncoder(ranks_path, leaf)




def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Of each document: its id, ids (binary, little-endian unsigned 32-bit) and decoded (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col (binary) after it: the bytes of ids_col; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path)
        for batch in batches:
            found = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*names, out_col])

    rows = rows.drop(out_col)
    names = rows.columns
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())]))
