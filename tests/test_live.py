"""The live bank's kernels against slow versions written from their definitions, on seeded banks with ties, shared frames and places."""

import numpy as np
import pytest

from loomline.operators import live
from loomline.operators.live import Bank, Rules, Seen


def random_bank(rng):
    n, dim = int(rng.integers(2, 9)), int(rng.choice([2, 3, 4, 8]))
    ids = sorted(rng.choice(100, n, replace=False).tolist())
    tied = rng.random() < 0.33
    base = rng.normal(size=dim)
    vectors, owner, seen = [], [], {}
    for g in ids:
        for _ in range(int(rng.integers(1, 5))):
            vectors.append(live.unit(base if tied and rng.random() < 0.7 else rng.normal(size=dim)))
            owner.append(g)
        box = lambda: (x := rng.integers(0, 30, 2)).tolist() + (x + rng.integers(5, 30, 2)).tolist()
        cameras = rng.choice(["A", "B", "C"], int(rng.integers(0, 3)), replace=False).tolist()
        ranges = {c: (lo := int(rng.integers(0, 20_000)), lo + int(rng.integers(0, 8000))) for c in cameras}
        places = {int(s): [(38.92 + rng.random() / 500, -77.0 + rng.random() / 500) for _ in range(int(rng.integers(1, 3)))] for s in rng.integers(0, 6, int(rng.integers(0, 3)))}
        seen[g] = Seen({("v", int(f)): tuple(box()) for f in rng.integers(0, 8, int(rng.integers(0, 4)))}, ranges, places)
    pairs = [frozenset(p) for p in ("AB", "AC", "BC")]
    rules = Rules(
        float(rng.choice([0, 0.2, 0.35, 0.5, 0.9])), int(rng.choice([0, 100, 1000, 5000])), float(rng.choice([1, 5, 50])),
        frozenset(p for p in pairs if rng.random() < 0.4), {p: float(rng.integers(1, 200)) for p in pairs if rng.random() < 0.7},
        float(rng.choice([0, 0, 30, 150])), bool(rng.random() < 0.2),
    )
    return Bank(np.array(vectors), np.array(owner, np.int64), seen), rules, float(rng.choice([0, 0.3, 0.6, 0.9, 1.0]))


def slow_iou(a, b):
    w, h = (max(0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h + 1e-9)


def slow_apart(rules, a, b):
    frames = set(a["boxes"]) & set(b["boxes"])
    if frames and np.median([slow_iou(a["boxes"][f], b["boxes"][f]) for f in frames]) < rules.same_box_iou:
        return True
    seconds = set(a["places"]) & set(b["places"])
    if rules.geo_max_m and seconds and np.median([live.metres(a["places"][s], b["places"][s]) for s in seconds]) > rules.geo_max_m:
        return True
    for c, (lo, hi) in a["ranges"].items():
        for d, (lo2, hi2) in b["ranges"].items():
            if c == d or rules.free_cross_camera:
                continue
            gap = 0 if lo <= hi2 and lo2 <= hi else lo2 - hi if lo2 > hi else lo - hi2
            key = frozenset((c, d))
            if (gap <= rules.slop_ms and key not in rules.overlaps) or (gap > rules.slop_ms and rules.distance.get(key, 0) * 1000 / gap > rules.max_speed):
                return True
    return False


def slow_consolidate(bank, rules, tau):
    """All pairs in every round, the last of the best that nothing rules out."""
    groups = {}
    for g in bank.ids:
        s = bank.seen[g]
        middle = {t: tuple(np.median(np.array(p), axis=0)) for t, p in s.places.items()}
        groups[g] = {"ids": [g], "vectors": bank.of(g), "boxes": dict(s.boxes), "ranges": dict(s.ranges), "places": middle}
    events = []
    while True:
        names, best = sorted(groups), None
        centre = {g: live.unit(groups[g]["vectors"].mean(axis=0)) for g in names}
        for n, a in enumerate(names):
            for b in names[n + 1 :]:
                c = float(centre[a] @ centre[b])
                if c >= tau and (best is None or c >= best[0]) and not slow_apart(rules, groups[a], groups[b]):
                    best = (c, a, b)
        if best is None:
            return {g: r for r, x in groups.items() for g in x["ids"]}, events
        c, a, b = best
        events.append((a, b, round(c, 4)))
        x, y = groups[a], groups.pop(b)
        x["ids"] += y["ids"]
        x["vectors"] = np.vstack([x["vectors"], y["vectors"]])
        x["boxes"].update(y["boxes"])
        for cam, (lo, hi) in y["ranges"].items():
            x["ranges"][cam] = (min(lo, x["ranges"][cam][0]), max(hi, x["ranges"][cam][1])) if cam in x["ranges"] else (lo, hi)
        for t, p in y["places"].items():
            x["places"][t] = tuple((u + v) / 2 for u, v in zip(x["places"][t], p, strict=True)) if t in x["places"] else p


@pytest.mark.parametrize("part", range(6))
def test_consolidation(part):
    merged = 0
    for seed in range(1000):
        bank, rules, tau = random_bank(np.random.default_rng([20240611, part, seed]))
        got, want = live.consolidate(bank, rules, tau), slow_consolidate(bank, rules, tau)
        assert got == want, (part, seed)
        merged += len(got[1])
    assert merged > 500


def test_ties_merge_the_last_pair_first():
    bank = Bank(np.tile([1.0, 0, 0], (3, 1)), np.array([10, 20, 30]), {})
    assert live.consolidate(bank, Rules(), 0.5) == ({10: 10, 20: 10, 30: 10}, [(20, 30, 1.0), (10, 20, 1.0)])
    assert live.consolidate(Bank(np.zeros((0, 3)), np.zeros(0, int), {}), Rules(), 0.5) == ({}, [])


def test_scores_and_assignment():
    bank = Bank(np.array([[1.0, 0], [0.6, 0.8], [0, 1.0], [0.8, 0.6]]), np.array([5, 5, 7, 9]), {7: Seen(ranges={"A": (0, 10)})})
    v = np.array([0.0, 1.0])
    assert bank.scores(v) == [(7, 1.0), (5, pytest.approx(0.8)), (9, pytest.approx(0.6))]
    assert dict(bank.scores(v, "retrieval", 3)) == {7: 1.0, 5: pytest.approx(0.8), 9: pytest.approx(0.6)}
    assert dict(bank.scores(v, "centroid"))[5] == pytest.approx(live.unit(np.array([0.8, 0.4]))[1])
    rules = Rules(distance={frozenset("AB"): 100.0})
    assert live.assign(bank, rules, v, Seen(ranges={"B": (5, 5)}), 0.0) == 5  # 7 is on A at that time
    assert live.assign(bank, rules, v, Seen(ranges={"B": (12_010, 12_010)}), 0.0) == 5  # too far for twelve seconds
    assert live.assign(bank, rules, v, Seen(ranges={"B": (40_010, 40_010)}), 0.0) == 7
    assert live.assign(bank, rules, v, Seen(ranges={"B": (5, 5)}), 0.9) is None


def test_remap_repartition_split_and_revision():
    x, y = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    bank = Bank(np.array([x, x, y, y, x]), np.array([1, 2, 3, 3, 4]), {1: Seen({("v", 1): (0, 0, 9, 9)}, {"A": (0, 5)}), 2: Seen({("v", 1): (0, 0, 8, 8)}, {"A": (3, 9)}), 3: Seen(ranges={"B": (0, 1)}), 4: Seen(ranges={"B": (2, 3)})})
    new = bank.remapped({2: 1})
    assert new.owner.tolist() == [1, 1, 3, 3, 4] and new.seen[1].ranges == {"A": (0, 9)} and new.seen[1].boxes[("v", 1)] == (0, 0, 8, 8)
    assert live.repartition(bank, 0.6) == {1: 1, 2: 2, 3: 3, 4: 1}  # 2 is of one camera with 1, so at half its similarity to both
    welded = Bank(np.array([x, x, y, y]), np.array([1, 1, 1, 1]), {1: Seen(ranges={"A": (0, 1), "B": (0, 1), "C": (0, 1)})})
    dets = {"a": x, "b": x, "c": y, "d": y}
    out = live.split(welded, dict.fromkeys(dets, 1), dets, 0.9)
    assert out["a"] == out["b"] == 1 and out["c"] == out["d"] == 2
    assert live.revise(welded, Rules(), dict.fromkeys(dets, 1), dets, 0.5, 0.9)[1] == "split"
    assert live.revise(bank, Rules(overlaps=frozenset([frozenset("AB")])), {"a": 4}, {}, 0.9, 0.9) == ({"a": 1}, "merge")
    assert live.coherence(np.array([x, y, x]), "min") == 0 and live.coherence(np.array([x])) == 1
