"""Balanced folds, exact draws, hold-outs; fits side by side and the sampler of the tuner."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import ml, spatial, splits


def drawn(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def totals(rows):
    out = {}
    for fold, y in rows:
        n = out.setdefault(fold, [0, 0])
        n[0] += 1
        n[1] += y or 0
    return out


@pytest.mark.parametrize("large", [4096, 3])
def test_balanced_folds(spark, large):
    rng, rows = random.Random(1), []
    for g in range(40):
        rows += [(f"g{g}" if g else None, int(rng.random() < 0.3)) for _ in range(rng.choice([1, 2, 5, 5, 30]))]
    df = spark.createDataFrame(rows, "g string, y int")
    got = splits.balanced_folds(df, "g", "y", 4, large=large).collect()
    of = {}
    for r in got:
        of.setdefault(r.g, set()).add(r.fold)
    assert len(got) == len(rows) and all(len(f) == 1 for f in of.values())
    t = totals((r.fold, r.y) for r in got)
    spread = [max(x[i] for x in t.values()) - min(x[i] for x in t.values()) for i in (0, 1)]
    most = 30 if large > 40 else 60
    assert set(t) == {0, 1, 2, 3} and spread[0] <= most and spread[1] <= most / 2
    again = splits.balanced_folds(df.repartition(7), "g", "y", 4, large=large)
    assert {(r.g, r.fold) for r in again.collect()} == {(r.g, r.fold) for r in got}


def test_folds_of_few_blocks(spark):
    df = spark.createDataFrame([(0.01, 0.01, 1), (0.06, 0.01, 0), (0.11, 0.01, 1)], "lon double, lat double, y int")
    got = splits.balanced_block_folds(df, spatial.block_id(F.col("lon"), F.col("lat")), "y").collect()
    assert {r.fold for r in got} == {0, 1}


def test_first_drawn(spark):
    df = spark.createDataFrame([(k, "ab"[k % 3 == 0] if k % 50 else None) for k in range(3000)], "k long, g string").repartition(5)
    got = splits.first_drawn(df, ["g"], "k", F.floor(F.col("n") / 7)).collect()
    assert len(got) == 3000
    for g in ("a", "b", None):
        keys = sorted((r.k for r in got if r.g == g), key=lambda k: (drawn(k), k))
        assert {r.k for r in got if r.g == g and r.chosen} == set(keys[: len(keys) // 7])


def test_ratio_and_hold_out(spark):
    df = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(500)] + [(900, None)], "k long, y int")
    got = splits.balance_ratio(df, "y", "k", 2.5).collect()
    assert sum(r.y for r in got) == 50 and sum(1 - r.y for r in got) == 125
    few = spark.createDataFrame([(k, s) for k, s in enumerate(["x", "x", "y", None, "y"])], "k long, s string")
    found = {r.k: r.split for r in splits.hold_out(few, "s", ["x"], "k").collect()}
    assert [found[0], found[1]] == ["test", "test"] and sorted([found[2], found[3], found[4]]) == ["train", "train", "validation"]
    assert {r.split for r in splits.hold_out(few, "s", ["x"], "k", share=0.0).collect()} == {"test", "train"}
    assert splits.hold_out(few.limit(0), "s", ["x"], "k").count() == 0


def test_side_by_side():
    import threading

    gate = threading.Barrier(3, timeout=60)
    assert ml.side_by_side([lambda k=k: (gate.wait(), k)[1] for k in range(3)], 3) == [0, 1, 2]  # all three run at once
    assert ml.side_by_side([]) == []


def test_sampler_looks_near_good_trials():
    rng = random.Random(3)
    good, bad = [(100 + k) / 10 for k in range(5)], [float(k) for k in range(40, 100, 3)]
    near = [ml._near(rng, (0.0, 100.0, "number"), good, bad) for _ in range(60)]
    assert np.median(near) < 30 and all(0 <= x <= 100 for x in near)
    steps = {ml._near(rng, (200, 600, "step 50"), [200, 250], [500, 550, 600]) for _ in range(40)}
    assert steps <= set(range(200, 601, 50)) and min(steps) <= 300
    assert ml._near(rng, ["sqrt", "log2"], ["log2"] * 5, ["sqrt"] * 5) == "log2"
    assert all(0.01 <= ml._near(rng, (0.01, 0.2, "log"), [0.02], [0.1, 0.15]) <= 0.2 for _ in range(40))


def test_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(a > 0), float(a), i % 2) for i, a in enumerate(rng.normal(size=80))]
    df = ml.assemble(spark.createDataFrame(rows, "k long, label int, a double, fold int"), ["a"])
    found = ml.search(df, "rf", {"numTrees": (2, 6, "whole"), "maxDepth": (1, 3, "whole")}, trials=5, at_once=2)
    assert len(found) == 5 and [f for _, f in found] == sorted((f for _, f in found), reverse=True) and found[0][1] > 0.9
    stacked = ml.stack(df, ["rf", "xgb"], "k", own={"rf": {"numTrees": 3}, "xgb": {"maxIter": 2}}).collect()
    assert len(stacked) == 80 and np.mean([(r.score > 0.5) == bool(r.label) for r in stacked]) > 0.9
