"""The matcher's bank as arrays decides what exemplar by exemplar it did."""

import random

import numpy as np
import pytest

from loomline.operators import kernels


class Counted(np.ndarray):
    n = 0

    def __matmul__(self, other):
        Counted.n += 1
        return np.asarray(self) @ np.asarray(other)


def test_exemplars_are_not_compared_one_by_one():
    m = kernels.Matcher()
    m.bank = [(k, np.eye(8)[k % 8].view(Counted)) for k in range(400)]
    m.next_id, Counted.n = 400, 0
    assert m.add("v", [1], [(0, 0, 1, 1)], np.eye(8)[3])["gid"] == 3
    assert Counted.n == 0


@pytest.mark.parametrize("seed", range(8))
def test_decisions_follow_the_definition(seed):
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    kinds = rng.normal(size=(9, 4))
    kinds /= np.linalg.norm(kinds, axis=1, keepdims=True)
    m, bank, seen, fresh = kernels.Matcher(room=3, floor=0.2), [], {}, 0
    for _ in range(250):
        v = kinds[draw.randrange(9)]
        frames = sorted(draw.sample(range(40), draw.randint(1, 4)))
        boxes = [(x, y, x + 10, y + 10) for x, y in ((draw.randrange(8), draw.randrange(8)) for _ in frames)]
        best = {}
        for g, b in bank:
            best[g] = max(best.get(g, -2.0), round(float(b @ v), 12))
        chosen, tried = None, []
        for g, s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
            if s < m.tau:
                tried.append((g, "below_tau"))
                break
            over = [kernels.iou(np.array([b], float), np.array([seen[g, f]], float))[0, 0] for f, b in zip(frames, boxes, strict=True) if (g, f) in seen]
            veto = "same_frame" if over and np.median(over) < m.same_frame_iou else ""
            tried.append((g, veto))
            if not veto:
                chosen = g
                break
        kind = "expand" if chosen is None else "match"
        if chosen is None:
            chosen, fresh = fresh, fresh + 1
        seen |= {(chosen, f): b for f, b in zip(frames, boxes, strict=True)}
        own = [float(b @ v) for g, b in bank if g == chosen]
        why = "bank_full" if len(own) >= 3 else "redundant" if own and max(own) >= m.admit_tau else "incoherent" if own and min(own) < 0.2 else "added"
        if why == "added":
            bank.append((chosen, v))
        got = m.add("v", frames, boxes, v)
        assert (got["gid"], got["decision_type"], got["admit_reason"]) == (chosen, kind, why)
        assert list(zip(got["candidates"], got["vetoes"], strict=True)) == tried[:6]
