"""Missing keys and places, dense cells, and the folder of intermediate results."""

import time
from types import SimpleNamespace

import numpy as np
import pytest

from chronopanel import session
from chronopanel.operators import ml, spatial, splits


def test_every_row_has_a_fold(spark):
    rows = [(k, None if k % 5 == 0 else f"g{k % 4}", k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, g string, label int")
    got = splits.group_folds(df, "g", "label", 3).collect()
    assert sorted(r.k for r in got) == list(range(40)) and all(r.fold in (0, 1, 2) for r in got)
    assert all(len({r.fold for r in got if r.g == g}) == 1 for g in (None, "g0", "g1", "g2", "g3"))


def test_rows_without_label_stay(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1)], "k int, label int")
    ids = {r.k: r.plot_id for r in splits.sequential_ids(df, "label", "k").collect()}
    assert ids == {1: "pos_0000", 4: "pos_0001", 2: "neg_0000", 3: "neg_0000"}
    weights = {r.k: r.weight for r in ml.weighted(df).collect()}
    assert weights == {1: 0.75, 2: 1.5, 3: None, 4: 0.75}


def test_nearest_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    dense = rng.normal(0, 1e-3, (400, 2)).tolist()
    points = [*dense, [50.0, 50.0], [50.0, 50.0], [900.0, -3.0], [float("nan"), 1.0], [None, 1.0]]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, x double, y double")
    got = {r.k: r.nn for r in spatial.nearest_distance(df, "k").collect()}
    xy = np.array(points[:-2], float)
    away = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(away, np.inf)
    assert len(got) == len(points) and got[403] is None and got[404] is None
    assert [got[k] for k in range(403)] == pytest.approx(away.min(axis=1).tolist(), abs=1e-12)


def test_nearest_of_few_rows_ends_soon(spark):
    began = time.time()
    for rows in ([], [(1, 2.0, 3.0)], [(1, 2.0, 3.0), (2, None, 3.0)], [(1, 2.0, 3.0), (2, 2.0, 3.0)]):
        got = sorted(spatial.nearest_distance(spark.createDataFrame(rows, "k int, x double, y double"), "k").collect())
        assert [(r.k, r.nn) for r in got] == [(k, 0.0 if len(rows) == 2 and rows[1][1] == 2.0 else None) for k, *_ in rows]
    assert time.time() - began < 60


def test_range_join_takes_the_first_box(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 9.0, 9.0), (4, None, 1.0), (5, 2.0, 0.0)], "k int, lon double, lat double")
    boxes = spark.createDataFrame([(1, "b", 0.0, 2.0, 0.0, 2.0), (0, "a", 1.0, 3.0, 1.0, 3.0), (2, "none", 5.0, 4.0, 0.0, 9.0)], "ord int, name string, x0 double, x1 double, y0 double, y1 double")
    got = {r.k: r.box for r in spatial.range_join(points, boxes, "k", 0.7, "lon", "lat").collect()}
    assert got == {1: "b", 2: "a", 3: "Unknown", 4: "Unknown", 5: "b"}


@pytest.mark.parametrize(("conf", "set_before", "want"), [("/c/", None, "/c"), (None, "/s", "/s"), ("/c", "/s", "/c")])
def test_shared_folder(conf, set_before, want):
    made = []
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: set_before, setCheckpointDir=made.append)
    own = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: conf))
    assert session.shared_dir(own) == want and made == ([] if set_before else [conf])


def test_no_shared_folder_on_a_cluster():
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, setCheckpointDir=None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
