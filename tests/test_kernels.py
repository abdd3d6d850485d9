"""Kernels against brute force and by their invariants."""

import itertools

import numpy as np
import pytest

from loomline.operators import kernels


def slow_linkage(n, edges, theta):
    d = np.ones((n, n))
    for i, j, s in edges:
        d[i, j] = d[j, i] = 1 - max(s, 0)
    parts = [[i] for i in range(n)]
    while len(parts) > 1:
        best = min((np.mean([d[a, b] for a in x for b in y]), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(parts), 2))
        if best[0] >= 1 - theta - 1e-12:
            break
        parts[best[1]] += parts.pop(best[2])
    return {frozenset(p) for p in parts}


@pytest.mark.parametrize("seed", range(12))
def test_average_linkage(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 12))
    edges = [(i, j, float(rng.random())) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]
    labels = kernels.average_linkage(n, edges, 0.3)
    assert {frozenset(np.flatnonzero(labels == x)) for x in set(labels)} == slow_linkage(n, edges, 0.3)


def test_forbidden_pairs_stay_apart():
    labels = kernels.average_linkage(3, [(0, 1, 0.9), (1, 2, 0.9)], 0.1, {(0, 2)})
    assert labels[0] != labels[2]
    assert len(set(kernels.average_linkage(5, [], 0.5, count=2))) == 2
    assert kernels.average_linkage(0, [], 0.5).size == 0


@pytest.mark.parametrize("seed", range(10))
def test_assignment(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2).tolist()
    cost = rng.random((n, m))
    pairs = kernels.best_assignment(cost)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
    assert len(pairs) == min(n, m)
    assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_guarded_merge_and_colours():
    labels = kernels.guarded_merge([1, 2, 3, 4], [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], [(1, 3)])
    assert labels == {1: 1, 2: 1, 3: 3, 4: 3}
    assert set(kernels.guarded_merge([1, 2, 3], [(1, 2, 1), (2, 3, 1)], [], 2).values()) == {1, 3}
    conflicts = [(1, 2), (2, 3), (1, 3), (3, 4)]
    part = kernels.colour_split([1, 2, 3, 4, 5], conflicts)
    assert all(part[i] != part[j] for i, j in conflicts)
    assert max(part.values()) == 2
    assert kernels.temporal_nms([(1, 0, 10, 0.5), (2, 10, 20, 0.9), (3, 21, 30, 0.1)]) == [2, 3]


def test_boxes():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30]], float)
    assert kernels.box_nms(boxes, np.array([0.5, 0.9, 0.1]), 0.5) == [1, 2]
    assert kernels.iou(boxes, boxes).diagonal() == pytest.approx([1, 1, 1])
    tracks = kernels.link_frames([(0, [("a", (0, 0, 10, 10))]), (1, [("b", (1, 0, 11, 10)), ("c", (50, 50, 60, 60))]), (100, [("d", (1, 0, 11, 10))])])
    assert tracks["a"] == tracks["b"] != tracks["c"]
    assert tracks["d"] not in (tracks["a"], tracks["c"])


def test_matcher():
    m = kernels.Matcher(tau=0.6, admit_tau=0.99)
    x, y = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    near = np.array([0.95, 0.31, 0])
    assert m.add("v", [1], [(0, 0, 10, 10)], x)["decision_type"] == "expand"
    assert m.add("v", [2], [(0, 0, 10, 10)], x)["admit_reason"] == "redundant"
    assert m.add("w", [1], [(0, 0, 10, 10)], near)["gid"] == 0
    assert m.add("w", [1], [(500, 500, 510, 510)], x)["vetoes"][0] == "same_frame"
    assert m.add("w", [9], [(0, 0, 1, 1)], y)["decision_type"] == "expand"
    assert kernels.Matcher(coherent=0.5).add("v", [1], [(0, 0, 1, 1)], x, 0.1)["admit_reason"] == "quarantine"


def test_linkage_of_a_day_holds_a_matrix_and_no_rows_of_pairs():
    import tracemalloc

    import pandas as pd

    from loomline.plans.live import _linked

    n = 700
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = pd.DataFrame({"seq": range(n), "day": 1, "vec": list(x), "video": "v", "camera": [f"c{k % 3}" for k in range(n)], "frame0": range(n), "frame1": range(5, n + 5)})
    tracemalloc.start()
    got = _linked(g, apart=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * n * n * 8
    s = np.round(x @ x.T, 6)
    pairs = [(i, j, s[i, j]) for i in range(n) for j in range(i + 1, n)]
    barred = {(i, j) for i in range(n) for j in range(i + 1, n) if j - i <= 5 and (j - i) % 3 == 0}
    labels = kernels.average_linkage(n, pairs, 0.25, barred)
    first = {c: int(np.flatnonzero(labels == c).min()) for c in set(labels.tolist())}
    assert got.label.tolist() == [first[c] for c in labels.tolist()]
