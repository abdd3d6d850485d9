"""Order-dependent kernels in numpy. Each works on one group, runs under a grouped map, and has a total order for ties."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from statistics import median

import numpy as np

FORBIDDEN = 1.0e6  # a distance that no average gets under a threshold, but that averages do carry


def average_linkage(n: int, edges: list[tuple[int, int, float]], theta: float, forbidden: set[tuple[int, int]] = frozenset(), count: int | None = None) -> np.ndarray:
    """Labels 0.. of ``n`` items. Distance is 1 - affinity, 1 without an edge, ``FORBIDDEN`` for forbidden pairs. The closest two
    clusters merge while closer than ``1 - theta`` (ties: lower indices), or until ``count`` clusters are left."""
    if n == 0:
        return np.zeros(0, np.int64)
    d = np.ones((n, n))
    for i, j, s in edges:
        d[i, j] = d[j, i] = 1.0 - min(max(s, 0.0), 1.0)
    for i, j in forbidden:
        d[i, j] = d[j, i] = FORBIDDEN
    return merge_closest(d, 1.0 - theta, count)


def merge_closest(d: np.ndarray, below: float, count: int | None = None) -> np.ndarray:
    """Average linkage of a matrix of distances, which it uses up: the closest two clusters merge while closer than ``below``, or
    until ``count`` are left. Each time half of its rows are merged away, the rest is copied to a smaller matrix."""
    n = len(d)
    if n == 0:
        return np.zeros(0, np.int64)
    np.fill_diagonal(d, np.inf)
    size, root, alive = np.ones(n), np.arange(n), n
    names = np.arange(n)  # of the rows that are left
    # Each row's least distance and its first place; a merge changes two rows, and others only where these were their nearest.
    place = d.argmin(axis=1)
    least = d[np.arange(n), place]
    while alive > (count or 1):
        i = int(least.argmin())
        i, j = sorted((i, int(place[i])))
        if not np.isfinite(d[i, j]) or (count is None and d[i, j] >= below):
            break
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        root[root == names[j]] = names[i]
        size[j] = 0
        alive -= 1
        if alive > 256 and 2 * alive <= n:
            left = np.flatnonzero(size)
            d, size, names, n = d[np.ix_(left, left)], size[left], names[left], alive
            place = d.argmin(axis=1)
            least = d[np.arange(n), place]
            continue
        stale = np.flatnonzero(((place == i) | (place == j)) & (merged > least))  # others keep their nearest, or are nearer now
        stale = np.unique(np.concatenate([stale, [i, j]]))
        place[stale] = d[stale].argmin(axis=1)
        nearer = (merged < least) | ((merged == least) & (i < place))
        place[nearer] = i
        least = d[np.arange(n), place]
    return np.unique(root, return_inverse=True)[1]


class Groups:
    """Union-find that keeps members, with a cap on size and pairs that may not meet."""

    def __init__(self, ids):
        self.parent = {i: i for i in ids}
        self.members = {i: {i} for i in ids}

    def find(self, i):
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def merge(self, i, j, forbidden: dict | None = None, cap: int | None = None) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b or (cap and len(self.members[a]) + len(self.members[b]) > cap):
            return False
        small, large = sorted((a, b), key=lambda r: (len(self.members[r]), -r))
        if forbidden and any(forbidden.get(m, frozenset()) & self.members[large] for m in self.members[small]):
            return False
        self.members[large] |= self.members.pop(small)
        self.parent[small] = large
        return True

    def labels(self) -> dict:
        return {m: min(g) for g in self.members.values() for m in g}


def guarded_merge(ids: list, edges: list[tuple], forbidden: list[tuple], cap: int | None = None) -> dict:
    """Edges ``(i, j, score)`` in order of score, then i, then j; each joins two groups unless a forbidden pair or the cap is in the way."""
    bar = defaultdict(set)
    for i, j in forbidden:
        bar[i].add(j)
        bar[j].add(i)
    groups = Groups(ids)
    for i, j, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        groups.merge(i, j, bar, cap)
    return groups.labels()


def colour_split(ids: list, conflicts: list[tuple]) -> dict:
    """Greedy colouring, most conflicts first: the part each id goes to, so that no part holds a conflict."""
    around = defaultdict(set)
    for i, j in conflicts:
        around[i].add(j)
        around[j].add(i)
    part: dict = {}
    for i in sorted(ids, key=lambda x: (-len(around[x]), x)):
        taken = {part[j] for j in around[i] if j in part}
        part[i] = next(c for c in range(len(taken) + 1) if c not in taken)
    return part


def temporal_nms(rows: list[tuple]) -> list:
    """``(id, start, end, quality)``: by quality, then id, a row stays if it meets none that stays."""
    kept: list[tuple] = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(r[1] > k[2] or k[1] > r[2] for k in kept):
            kept.append(r)
    return [r[0] for r in kept]


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs of two arrays of corner boxes."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.clip(hi - lo, 0, None).prod(axis=2)
    area = lambda x: (x[:, 2:] - x[:, :2]).prod(axis=1)
    return shared / np.maximum(area(a)[:, None] + area(b)[None, :] - shared, 1e-9)


def box_nms(boxes: np.ndarray, scores: np.ndarray, most: float = 0.5) -> list[int]:
    overlap, kept = iou(boxes, boxes), []
    for i in np.lexsort((np.arange(len(scores)), -scores)).tolist():
        if not kept or overlap[i, kept].max() <= most:
            kept.append(i)
    return kept


def greedy_match(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """One to one, best first (ties: lower indices)."""
    rows, cols, out = set(), set(), []
    for at in np.argsort(-score, axis=None, kind="stable").tolist():
        i, j = divmod(at, score.shape[1])
        if score[i, j] < least:
            break
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.append((i, j))
    return out


def best_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of least total cost (shortest augmenting paths with potentials)."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in best_assignment(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, np.int64)
        while True:
            used[j0] = True
            slack = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def link_frames(frames: list[tuple[int, list[tuple[int, tuple]]]], least: float = 0.3, most_gap: int = 30) -> dict[int, int]:
    """Greedy IoU linker: frames in order, each box continues the open track it overlaps most; ``det -> track``."""
    open_: list[list] = []  # track, last frame, last box
    out, fresh = {}, 0
    for frame, dets in frames:
        open_ = [t for t in open_ if frame - t[1] <= most_gap]
        boxes = np.array([b for _, b in dets], float).reshape(-1, 4)
        score = iou(np.array([t[2] for t in open_], float).reshape(-1, 4), boxes)
        pairs = dict((j, i) for i, j in greedy_match(score, least)) if score.size else {}
        for j, (det, box) in enumerate(dets):
            if j in pairs:
                track = open_[pairs[j]]
                track[1:] = [frame, box]
            else:
                track = [fresh, frame, box]
                open_.append(track)
                fresh += 1
            out[det] = track[0]
    return out


def _iou(a: tuple, b: tuple) -> float:
    """:func:`iou` of two boxes."""
    shared = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    return shared / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared, 1e-9)


@dataclass
class Matcher:
    """Online match, expand or quarantine. ``bank`` holds exemplars; a track joins the identity of its best exemplar over ``tau`` that
    no veto rules out, else starts one. Exemplars are admitted while the bank has room, and if neither redundant nor incoherent."""

    tau: float = 0.35
    admit_tau: float = 0.95
    floor: float = -1.0
    room: int = 20
    same_frame_iou: float = 0.5
    coherent: float = -1.0
    bank: list[tuple[int, np.ndarray]] = field(default_factory=list)
    seen: dict = field(default_factory=dict)  # identity -> (video, frame) -> box
    next_id: int = 0
    step: int = 0

    # The bank as arrays: its different vectors, and of each exemplar the identity and which of these it is.
    _kinds: dict = field(default_factory=dict)
    _x: np.ndarray | None = None
    _gid: np.ndarray = field(default_factory=lambda: np.zeros(64, np.int64))
    _of: np.ndarray = field(default_factory=lambda: np.zeros(64, np.int64))
    _own: dict = field(default_factory=dict)  # identity -> which vectors
    _indexed: int = 0

    def _index(self) -> None:
        """Takes exemplars that are new in ``bank``."""
        for gid, v in self.bank[self._indexed :]:
            v = np.asarray(v, float) + 0.0
            u = self._kinds.setdefault(v.tobytes(), len(self._kinds))
            if self._x is None:
                self._x = np.zeros((64, len(v)))
            if u == len(self._x):
                self._x = np.concatenate([self._x, np.zeros_like(self._x)])
            if self._indexed == len(self._gid):
                self._gid, self._of = (np.concatenate([c, np.zeros_like(c)]) for c in (self._gid, self._of))
            self._x[u], self._gid[self._indexed], self._of[self._indexed] = v, gid, u
            self._own.setdefault(gid, []).append(u)
            self._indexed += 1

    def _vetoed(self, gid: int, video: str, frames, boxes) -> str | None:
        past = self.seen.get(gid, {})
        both = [(b, past[video, f]) for f, b in zip(frames, boxes, strict=True) if (video, f) in past]
        if both and float(median(_iou(a, b) for a, b in both)) < self.same_frame_iou:
            return "same_frame"
        return None

    def add(self, video: str, frames, boxes, vector: np.ndarray, coherence: float = 1.0) -> dict:
        self._index()
        frames, boxes = [int(f) for f in frames], [tuple(float(c) for c in b) for b in boxes]
        vector = np.asarray(vector, float)
        sims = self._x[: len(self._kinds)] @ vector if self.bank else np.zeros(0)
        chosen, kind, tried = None, "quarantine" if coherence < self.coherent else "expand", []
        if kind == "expand" and self.bank:
            gids = self._gid[: self._indexed]
            best = np.full(int(gids.max()) + 1, -np.inf)
            np.maximum.at(best, gids, np.maximum(sims[self._of[: self._indexed]], -2.0))
            near = np.flatnonzero(best >= self.tau)
            rest = np.flatnonzero(np.isfinite(best) & (best < self.tau))
            order = near[np.lexsort((near, -best[near]))].tolist() + ([int(rest[best[rest].argmax()])] if len(rest) else [])
            for gid in order:
                sim = float(best[gid])
                if sim < self.tau:
                    tried.append((gid, sim, "below_tau"))
                    break
                veto = self._vetoed(gid, video, frames, boxes)
                tried.append((gid, sim, veto or ""))
                if veto is None:
                    chosen, kind = gid, "match"
                    break
        if chosen is None:
            chosen, self.next_id = self.next_id, self.next_id + 1
        for f, b in zip(frames, boxes, strict=True):
            self.seen.setdefault(chosen, {})[video, f] = b
        own = [float(sims[u]) for u in self._own.get(chosen, ())]
        why = (
            "quarantine" if kind == "quarantine" else "bank_full" if len(own) >= self.room
            else "redundant" if own and max(own) >= self.admit_tau else "incoherent" if own and min(own) < self.floor else "added"
        )
        if why == "added":
            self.bank.append((chosen, vector))
        self.step += 1
        return {"step": self.step - 1, "gid": chosen, "decision_type": kind, "admit_reason": why, "candidates": [g for g, _, _ in tried[:6]], "scores": [round(s, 4) for _, s, _ in tried[:6]], "vetoes": [v for _, _, v in tried[:6]]}
