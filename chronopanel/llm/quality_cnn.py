"""A byte-level convolutional quality classifier in numpy.

A document's UTF-8 bytes are embedded and cut into chunks of CHUNK bytes that overlap by half and cover
all of it, however long. Learned filters slide over each chunk, WIDTH bytes wide and STRIDE apart. Each
filter's largest response in a chunk is pooled, and the mean and the maximum over the chunks are combined
into one probability. Scoring goes through a text in bounded pieces.

Training takes at most `sample_rows` labelled documents of each class, in the order of a hash of the id,
of at most `sample_bytes` bytes each, and draws a few chunks of some in each step. (That bounds only
what is learned from; scoring covers all rows and whole texts.) The sample is balanced, so the logit is
shifted to the classes' shares among all labelled rows. Training is seeded.

Null texts count as empty; they are scored like a chunk of padding. Documents with several labels count by
their mean, null labels not at all. Without labels of both classes every score is the share of label 1 (1
without any label). Repeated rows each get their score. All columns stay; a column named `score` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm.common import kept_apart

WIDTH, STRIDE, CHUNK = 8, 4, 512
CELL = CHUNK // STRIDE // 2
DIM, FILTERS = 8, 24
PAD = 256
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 16
STEPS, BATCH, DRAWN, RATE = 400, 32, 4, 0.01
SEED = 5
_CELLS = 512


@dataclass
class Model:
    table: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    head: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        return 1 / (1 + np.exp(-float(np.clip(self.pooled(text) @ self.head + self.bias, -30, 30))))

    def pooled(self, text: bytes) -> np.ndarray:
        """Mean and maximum over all chunks of each filter's largest response."""
        last = np.full(FILTERS, -np.inf, np.float32)
        total, most, chunks = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
        for cells in self._cells(text):
            pairs = np.maximum(np.vstack([last[None], cells[:-1]]), cells)
            if np.isinf(last[0]):  # the first cell alone is no chunk unless the text ends there
                pairs = pairs[1:]
            last = cells[-1]
            pairs = np.maximum(pairs, 0)
            if len(pairs):
                total, most, chunks = total + pairs.sum(axis=0), np.maximum(most, pairs.max(axis=0)), chunks + len(pairs)
        if not chunks:
            total = most = np.maximum(last, 0)
            chunks = 1
        return np.concatenate([total / chunks, most])

    def _cells(self, text: bytes) -> Iterator[np.ndarray]:
        """Largest responses in cells of half a chunk, some hundred cells at a time."""
        data = np.frombuffer(text, np.uint8)
        step = CELL * STRIDE
        count = max(1, -(-max(len(data) - WIDTH + STRIDE, 1) // step))
        for first in range(0, count, _CELLS):
            n = min(_CELLS, count - first)
            part = np.full(n * step + WIDTH - STRIDE, PAD, np.int16)
            own = data[first * step : first * step + len(part)]
            part[: len(own)] = own
            rows = self.table[part].reshape(-1)
            windows = np.lib.stride_tricks.as_strided(rows, (n * CELL, WIDTH * DIM), (STRIDE * DIM * rows.itemsize, rows.itemsize))
            yield (windows @ self.filters).reshape(n, CELL, FILTERS).max(axis=1) + self.offset


def train(texts: list[bytes], labels: np.ndarray, share: float) -> Model:
    """share: of label 1 among all labelled rows."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32)
    filters = rng.normal(0, 0.3, (WIDTH * DIM, FILTERS)).astype(np.float32)
    offset, head, bias = np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), np.zeros(1, np.float32)
    head[:] = rng.normal(0, 0.1, 2 * FILTERS)
    weights = [table, filters, offset, head, bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    size = CHUNK + WIDTH - STRIDE
    places = CHUNK // STRIDE
    padded = [np.concatenate([np.frombuffer(t, np.uint8).astype(np.int16), np.full(max(size - len(t), WIDTH), PAD, np.int16)]) for t in texts]
    at = np.arange(places)[:, None] * STRIDE + np.arange(WIDTH)
    for step in range(1, STEPS + 1):
        some = rng.integers(0, len(texts), BATCH)
        starts = [rng.integers(0, max(1, (len(padded[i]) - size) // (CHUNK // 2) + 1), DRAWN) * (CHUNK // 2) for i in some]
        data = np.stack([padded[i][s : s + size] for i, own in zip(some, starts, strict=True) for s in own])
        windows = table[data[:, at]].reshape(len(data), places, WIDTH * DIM)
        response = windows.reshape(-1, WIDTH * DIM) @ filters
        response = response.reshape(len(data), places, FILTERS)
        place = response.argmax(axis=1)
        pooled = np.take_along_axis(response, place[:, None], axis=1)[:, 0] + offset
        active = pooled > 0
        chunk = np.maximum(pooled, 0).reshape(len(some), DRAWN, FILTERS)
        which = chunk.argmax(axis=1)
        features = np.concatenate([chunk.mean(axis=1), chunk.max(axis=1)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(features @ head + bias, -30, 30)))
        error = (p - labels[some]) / len(some)
        to_features = error[:, None] * head
        to_chunk = np.repeat(to_features[:, None, :FILTERS] / DRAWN, DRAWN, axis=1)
        np.put_along_axis(to_chunk, which[:, None], np.take_along_axis(to_chunk, which[:, None], 1) + to_features[:, None, FILTERS:], 1)
        to_pooled = to_chunk.reshape(-1, FILTERS) * active
        chosen = windows[np.arange(len(data))[:, None], place]
        to_filters = np.einsum("cfw,cf->wf", chosen, to_pooled)
        to_window = to_pooled[:, :, None] * filters.T
        to_table = np.zeros_like(table)
        held = data[np.arange(len(data))[:, None, None], place[:, :, None] * STRIDE + np.arange(WIDTH)]
        np.add.at(to_table, held.reshape(-1), to_window.reshape(-1, DIM))
        slopes = [to_table, to_filters, to_pooled.sum(axis=0), error @ features + 1e-4 * head, error.sum(keepdims=True)]
        rate = RATE * (1 - (step - 1) / STEPS)
        for w, g, (m, v) in zip(weights, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    ones = float(labels.mean())
    return Model(table, filters, offset, head, float(bias[0]) + np.log(share / (1 - share)) - np.log(ones / (1 - ones)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | float:
    """A model of the labels that are not held out, or their constant share."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null and id is not null")
    marks = marks.where(~held_out("id")).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 1))
    order = F.xxhash64("id", F.lit(SEED))
    # twice as many ids as rows are wanted: some documents are missing or too long
    drawn = [marks.where(F.col("y") == y).orderBy(order, "id").limit(2 * sample_rows) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    held = texts.join(F.broadcast(drawn[0].union(drawn[1])), "id")  # at most 4 * sample_rows ids
    rows = [held.where(F.col("y") == y).orderBy(order, "id", "text").limit(sample_rows).select("text", "y").toArrow().to_pylist() for y in (0, 1)]
    if not all(rows):
        return counts[1] / sum(counts.values())
    both = rows[0] + rows[1]
    return train([r["text"].encode() for r in both], np.array([r["y"] for r in both], np.float32), counts[1] / sum(counts.values()))


def score(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """docs with score (double from 0 to 1, higher: label 1 likelier). All other columns stay, whatever their names."""
    return kept_apart(docs.drop("score"), lambda d, text: _scored(d, model, text), text_col)


def _scored(docs: DataFrame, model: Model | float, text_col: str) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            found = [model.score((x or "").encode()) if isinstance(model, Model) else model for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, pa.float64())], [*names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(run, schema)
