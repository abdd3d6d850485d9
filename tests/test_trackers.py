"""The trackers against a filter written out step by step, planted scenes, and what every registered one must keep."""

import numpy as np
import pytest

import __spark_entry__
from loomline.operators.trackers import MEASURE, START, STEP, Motion, ObservationCentric, TwoStage, WithAppearance

SF = "/root/testdata/sf0.001"


def box(x, y=0.0, w=20.0, h=40.0):
    return [x, y, x + w, y + h]


def test_filter_against_plain_matrices():
    rng = np.random.default_rng(3)
    motion = Motion()
    motion.start(np.array([box(0), box(50, 9)]))
    state = [(np.array([10.0, 20, 800, 0.5, 0, 0, 0]), np.diag(START)), (np.array([60.0, 29, 800, 0.5, 0, 0, 0]), np.diag(START))]
    f, h = np.eye(7), np.eye(4, 7)
    for k in range(3):
        f[k, k + 4] = 1
    for _ in range(6):
        seen = np.array([box(*rng.uniform(0, 60, 2), *rng.uniform(10, 40, 2)) for _ in range(2)])
        motion.predict()
        motion.update([1, 0], seen[[1, 0]])
        for n in range(2):
            x, p = state[n]
            if x[2] + x[6] <= 0:
                x[6] = 0
            x, p = f @ x, f @ p @ f.T + np.diag(STEP)
            w, t = seen[n][2] - seen[n][0], seen[n][3] - seen[n][1]
            z = np.array([seen[n][0] + w / 2, seen[n][1] + t / 2, w * t, w / t])
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.diag(MEASURE))
            state[n] = (x + gain @ (z - h @ x), (np.eye(7) - gain @ h) @ p)
    assert np.allclose(motion.x, [s[0] for s in state]) and np.allclose(motion.p, [s[1] for s in state])


@pytest.mark.parametrize("kind", [TwoStage, ObservationCentric])
def test_steady_motion_is_one_track(kind):
    t = kind()
    names = [t.feed([box(6 * f)], [0.9])[0] for f in range(20)]
    assert set(names) == {"K0"}


def test_low_confidence_sustains_but_does_not_start():
    t = TwoStage()
    assert t.feed([box(0)], [0.4]) == ["S0"]
    assert t.feed([box(0), box(200)], [0.9, 0.55]) == ["K1", "S2"]
    assert t.feed([box(1), box(200)], [0.2, 0.2]) == ["K1", "S3"]
    assert t.feed([], []) == []


def test_tracks_end_after_idle_frames():
    t = TwoStage(most_idle=2)
    assert t.feed([box(0)], [0.9]) == ["K0"]
    for _ in range(3):
        t.feed([box(500)], [0.1])
    assert t.feed([box(0)], [0.9])[0] != "K0" and "K0" not in t.names


def test_recovery_from_the_last_box():
    """A track whose prediction ran off is found where it was last seen."""
    for kind, same in ((TwoStage, False), (ObservationCentric, True)):
        t = kind()
        for f in range(6):
            name = t.feed([box(8 * f)], [0.9])[0]
        for _ in range(4):
            t.feed([box(900, 400)], [0.1])
        assert (t.feed([box(40)], [0.9])[0] == name) is same


def test_momentum_decides_between_equal_overlaps():
    t = ObservationCentric(bonus=0.2)
    for f in range(4):
        t.feed([box(4 * f)], [0.9])
    ahead, behind = box(16 + 5), box(16 - 5)
    assert t.feed([behind, ahead], [0.9, 0.9])[1] == "K0"


def test_appearance_keeps_crossing_tracks_apart():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    t = WithAppearance(window=1000, weight=2.0)
    assert t.feed(0, [box(0), box(10)], [0.9, 0.9], [a, b]) == [(0, 0), (1, 0)]
    for f in range(1, 8):  # both stand still; the order of boxes and a swap of places make no difference
        assert t.feed(f, [box(10), box(0)], [0.9, 0.9], [a, b]) == [(0, 0), (1, 0)]


def test_pieces_by_window():
    t = WithAppearance(window=3)
    v = [np.array([1.0, 0.0])]
    assert [t.feed(f, [box(f)], [0.9], v)[0] for f in range(7)] == [(0, 0)] * 3 + [(0, 1)] * 3 + [(0, 2)]
    assert t.feed(7, [box(600)], [0.2], v) == [None]


def test_registered(spark):
    q = __spark_entry__.queries()
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    for name in ("T17_two_stage_tracker", "T18_observation_centric_tracker"):
        rows = q[name](spark, SF).collect()
        assert len(rows) == n == len({r.det_id for r in rows})
        assert all(r.tracklet.startswith(r.video) for r in rows)
    rows = q["T19_appearance_tracker"](spark, SF).collect()
    assert 0 < len(rows) == len({r.det_id for r in rows}) <= n
