"""Validity and repair of polygon rings: why a ring is not valid, and the simple rings that it is made of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
VALID, CROSSES = "valid", "crosses itself"


def fault(ring: Column) -> Column:
    """Why a closed ring of (x, y) can't be used at all, or null: no ring, a point without a place, too few points, not
    closed, no area."""
    n = F.size(ring)
    far = F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    a, b = F.get(ring, 0), F.get(ring, n - 1)
    distinct = F.size(F.array_distinct(ring))
    out = F.when(ring.isNull() | (n == 0), "no ring").when(F.coalesce(far, F.lit(True)), "a point without a place").when((n < 4) | (distinct < 3), "too few points")
    flat = F.array_min(F.transform(ring, lambda p: p["x"])) == F.array_max(F.transform(ring, lambda p: p["x"]))
    level = F.array_min(F.transform(ring, lambda p: p["y"])) == F.array_max(F.transform(ring, lambda p: p["y"]))
    return out.when((a["x"] != b["x"]) | (a["y"] != b["y"]), "not closed").when(flat | level, "no area")


def crossings(points: np.ndarray) -> list[tuple[int, int, tuple[float, float]]]:
    """(i, j, place) of sides i < j of a closed ring that cross or touch, but for neighbours at their common point.

    A sweep: sides in order of their least x meet those whose largest x is not yet passed and whose y overlaps."""
    a, b = points[:-1], points[1:]
    lo, hi, n = np.minimum(a, b), np.maximum(a, b), len(points) - 1
    active, found = np.empty(0, np.int64), []
    for i in np.argsort(lo[:, 0], kind="stable"):
        active = active[hi[active, 0] >= lo[i, 0]]
        near = active[(hi[active, 1] >= lo[i, 1]) & (lo[active, 1] <= hi[i, 1])]
        for j in near.tolist():
            p, q = sorted((int(i), j))
            if (place := _meet(a[p], b[p], a[q], b[q])) is None or ((q - p in (1, n - 1)) and _is_end(place, a[p], b[p]) and _is_end(place, a[q], b[q])):
                continue
            found.append((p, q, place))
        active = np.append(active, i)
    return found


def _is_end(place: tuple[float, float], a: np.ndarray, b: np.ndarray) -> bool:
    return place in ((a[0], a[1]), (b[0], b[1]))


def _meet(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[float, float] | None:
    """The one place that two sides have in common; none for parallel ones."""
    r, s = b - a, d - c
    turn = r[0] * s[1] - r[1] * s[0]
    if turn == 0:
        return None
    t, u = ((c - a)[0] * s[1] - (c - a)[1] * s[0]) / turn, ((c - a)[0] * r[1] - (c - a)[1] * r[0]) / turn
    if not (0 <= t <= 1 and 0 <= u <= 1):
        return None
    for k, end in ((t, (a, b)), (u, (c, d))):  # at an end exactly that end's place
        if k in (0, 1):
            return float(end[int(k)][0]), float(end[int(k)][1])
    return float(a[0] + t * r[0]), float(a[1] + t * r[1])


def simple_rings(points: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed simple rings that a closed ring is cut into at the places where its sides meet; those with an area."""
    cuts: dict[int, list[tuple[float, float]]] = {}
    for i, j, place in crossings(points):
        cuts.setdefault(i, []).append(place)
        cuts.setdefault(j, []).append(place)
    path: list[tuple[float, float]] = []
    for i in range(len(points) - 1):
        start = (float(points[i, 0]), float(points[i, 1]))
        path.append(start)
        path += sorted(set(cuts.get(i, [])), key=lambda p: (p[0] - start[0]) ** 2 + (p[1] - start[1]) ** 2)
    out, open_, at = [], [], {}
    for p in [*path, path[0]]:
        if p in at:
            loop = open_[at[p] :] + [p]
            for x in open_[at[p] + 1 :]:
                del at[x]
            del open_[at[p] + 1 :]
            if len(loop) >= 4 and abs(_area(loop)) > 0:
                out.append(loop)
        else:
            at[p] = len(open_)
            open_.append(p)
    return out


def _area(loop: list[tuple[float, float]]) -> float:
    x0, y0 = loop[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(loop, loop[1:], strict=False)) / 2


def repaired(df: DataFrame, ring: str = "ring") -> DataFrame:
    """df with reason and rings: `valid` and the ring itself; `crosses itself` and the simple rings that it is cut into; or
    why it can't be used, and no ring. Rows stay as they are otherwise; rings of rows that have none are null."""
    judged = df.drop("reason", "rings").withColumn("reason", fault(F.col(ring)))
    schema = T.StructType([*judged.schema.fields, T.StructField("rings", T.ArrayType(T.ArrayType(POINT)))])
    names, at = judged.columns, judged.columns.index(ring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            rings, reasons = [], batch.column(len(names) - 1).to_pylist()
            for k, points in enumerate(batch.column(at).to_pylist()):
                if reasons[k] is not None:
                    rings.append(None)
                    continue
                found = simple_rings(np.array([(p["x"], p["y"]) for p in points], float))
                reasons[k] = "no area" if not found else VALID if len(found) == 1 and len(found[0]) >= len({(p["x"], p["y"]) for p in points}) else CROSSES
                rings.append([points] if reasons[k] == VALID else [[{"x": x, "y": y} for x, y in loop] for loop in found] or None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(reasons, pa.string()), pa.array(rings, kind)], [*names, "rings"])

    return judged.mapInArrow(run, schema)


def usable(df: DataFrame, ring: str = "ring") -> DataFrame:
    """The rows of repaired() that have rings."""
    return repaired(df, ring).where("rings is not null")
