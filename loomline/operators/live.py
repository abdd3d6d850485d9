"""The live bank of identities: candidate scores, vetoes, consolidation, remaps, re-partition, splits and revision.

A bank is the exemplars of identities with what their tracks have shown: boxes by (video, frame), time ranges by camera and
places by second. One bank is one scope's state, as big as the scope's identities; scopes are independent groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from loomline.operators import kernels

EARTH_M = 6371000.0


@dataclass(frozen=True)
class Rules:
    """When two identities can't be one. Camera pairs are frozensets; a pair that ``distance`` doesn't know is never too far."""

    same_box_iou: float = 0.5
    slop_ms: int = 1000
    max_speed: float = 5.0
    overlaps: frozenset = frozenset()
    distance: dict = field(default_factory=dict, hash=False)
    geo_max_m: float = 0.0  # 0: places aren't compared
    free_cross_camera: bool = False


@dataclass
class Seen:
    """What one identity has shown."""

    boxes: dict = field(default_factory=dict)  # (video, frame) -> corners
    ranges: dict = field(default_factory=dict)  # camera -> (first ms, last ms)
    places: dict = field(default_factory=dict)  # second -> [(lat, lon), ..]

    def join(self, other: Seen) -> Seen:
        """Both together: of a box that both have the other's stands; places are kept side by side."""
        ranges = dict(self.ranges)
        for camera, (lo, hi) in other.ranges.items():
            was = ranges.get(camera, (lo, hi))
            ranges[camera] = (min(was[0], lo), max(was[1], hi))
        places = {s: [*self.places.get(s, ()), *other.places.get(s, ())] for s in {**self.places, **other.places}}
        return Seen({**self.boxes, **other.boxes}, ranges, places)


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-9)


@dataclass
class Bank:
    vectors: np.ndarray
    owner: np.ndarray
    seen: dict[int, Seen]

    @property
    def ids(self) -> list[int]:
        return sorted(set(self.owner.tolist()))

    def of(self, gid: int) -> np.ndarray:
        return self.vectors[self.owner == gid]

    def centroids(self) -> np.ndarray:
        return np.array([unit(self.of(g).mean(axis=0)) for g in self.ids]).reshape(len(self.ids), self.vectors.shape[1])

    def scores(self, v: np.ndarray, mode: str = "max", k: int = 15) -> list[tuple[int, float]]:
        """Identities with their scores, best first, ties by id: the best exemplar's product (``max``), the centroid's
        (``centroid``), or the mean product of those exemplars that are among the ``k`` nearest of all (``retrieval``)."""
        if not len(self.owner):
            return []
        if mode == "centroid":
            found = dict(zip(self.ids, (self.centroids() @ v).tolist(), strict=True))
        else:
            sims = self.vectors @ v
            near = np.lexsort((np.arange(len(sims)), -sims))[: k if mode == "retrieval" else None]
            found = {g: (sims[own].mean() if mode == "retrieval" else sims[own].max()) for g in set(self.owner[near].tolist()) for own in [near[self.owner[near] == g]]}
        return sorted(((int(g), float(s)) for g, s in found.items()), key=lambda x: (-x[1], x[0]))

    def remapped(self, mapping: dict[int, int]) -> Bank:
        """The bank with ids renamed, and what meets under one id joined in ascending order of the old ids."""
        seen: dict[int, Seen] = {}
        for g in sorted(self.seen):
            new = mapping.get(g, g)
            seen[new] = seen[new].join(self.seen[g]) if new in seen else self.seen[g]
        return Bank(self.vectors, np.array([mapping.get(g, g) for g in self.owner.tolist()], np.int64), seen)


def median_iou(a: dict, b: dict) -> float | None:
    """Median overlap of the boxes that two identities have in the same frames; none without such."""
    both = sorted(a.keys() & b.keys())
    if not both:
        return None
    x, y = (np.array([side[k] for k in both], float) for side in (a, b))
    lo, hi = np.maximum(x[:, :2], y[:, :2]), np.minimum(x[:, 2:], y[:, 2:])
    shared = np.clip(hi - lo, 0, None).prod(axis=1)
    area = lambda r: (r[:, 2:] - r[:, :2]).prod(axis=1)
    return float(np.median(shared / (area(x) + area(y) - shared + 1e-9)))


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    (la, lo), (mb, mo) = np.radians(a), np.radians(b)
    h = np.sin((mb - la) / 2) ** 2 + np.cos(la) * np.cos(mb) * np.sin((mo - lo) / 2) ** 2
    return float(2 * EARTH_M * np.arcsin(np.sqrt(h)))


def veto(rules: Rules, a: Seen, b: Seen) -> str | None:
    """Why ``a`` and ``b`` can't be one identity: ``same_frame``, ``places``, ``simultaneity:camera`` or ``travel:camera``."""
    overlap = median_iou(a.boxes, b.boxes)
    if overlap is not None and overlap < rules.same_box_iou:
        return "same_frame"
    if rules.geo_max_m > 0 and (both := a.places.keys() & b.places.keys()):
        middle = lambda side, s: tuple(np.median(np.array(side.places[s], float), axis=0))
        if np.median([metres(middle(a, s), middle(b, s)) for s in both]) > rules.geo_max_m:
            return "places"
    if rules.free_cross_camera:
        return None
    for one, (lo_a, hi_a) in a.ranges.items():
        for other, (lo_b, hi_b) in b.ranges.items():
            if one == other:
                continue
            gap, pair = max(0, lo_b - hi_a, lo_a - hi_b), frozenset((one, other))
            if gap <= rules.slop_ms:
                if pair not in rules.overlaps:
                    return f"simultaneity:{one}"
            elif pair in rules.distance and rules.distance[pair] / (gap / 1000.0) > rules.max_speed:
                return f"travel:{one}"
    return None


def _averaged(seen: Seen) -> Seen:
    """Each second's places as their median, which is what consolidation starts from."""
    return Seen(seen.boxes, seen.ranges, {s: [tuple(np.median(np.array(p, float), axis=0).tolist())] for s, p in seen.places.items()})


def _welded(a: Seen, b: Seen) -> Seen:
    """Joined for consolidation: where both have a place, halfway between them."""
    out = a.join(b)
    out.places = {s: [tuple(np.mean(np.array(p, float), axis=0).tolist())] for s, p in out.places.items()}
    return out


def consolidate(bank: Bank, rules: Rules, tau: float) -> tuple[dict[int, int], list[tuple[int, int, float]]]:
    """Merges live identities by the cosine of their centroids while one of at least ``tau`` is left that no veto stops.

    The best pair goes first, of ties the last in order of ids; the lower id survives. Returns old id to survivor, and the
    merges as ``(survivor, absorbed, cosine)``. Cosines are held in a matrix of which a merge renews one row, and a pair is
    held against the vetoes only when it is the best left, and again only after one of its sides has changed.
    """
    ids = bank.ids
    n = len(ids)
    seen = [_averaged(bank.seen.get(g, Seen())) for g in ids]
    held = [bank.of(g) for g in ids]
    centre = bank.centroids()
    cos = np.full((n, n), -np.inf)
    for i in range(n):
        for j in range(i + 1, n):
            cos[i, j] = centre[i] @ centre[j]
    root, events = {g: g for g in ids}, []
    while n > 1:
        best = cos.max()
        if not best >= tau:
            break
        i, j = divmod(int(np.flatnonzero(cos.ravel() == best)[-1]), n)
        if veto(rules, seen[i], seen[j]):
            cos[i, j] = -np.inf
            continue
        events.append((ids[i], ids[j], round(float(best), 4)))
        root = {g: ids[i] if r == ids[j] else r for g, r in root.items()}
        seen[i], held[i] = _welded(seen[i], seen[j]), np.vstack([held[i], held[j]])
        centre[i] = unit(held[i].mean(axis=0))
        held[j] = held[j][:0]
        cos[j, :], cos[:, j] = -np.inf, -np.inf
        for k in range(n):
            if k != i and len(held[k]):
                cos[min(i, k), max(i, k)] = centre[min(i, k)] @ centre[max(i, k)]
    return root, events


def repartition(bank: Bank, theta: float, k: int = 15, rules: Rules | None = None) -> dict[int, int]:
    """Identities clustered anew: average linkage of centroids over their ``k`` nearest of other first cameras; each cluster takes
    its lowest id. With ``rules``, pairs whose boxes in shared frames differ are kept apart."""
    ids = bank.ids
    if len(ids) < 2:
        return {g: g for g in ids}
    centre = bank.centroids()
    camera = [min(bank.seen.get(g, Seen()).ranges, default="") for g in ids]
    sims = np.round(centre @ centre.T, 6)
    edges: dict[tuple[int, int], float] = {}
    for i in range(len(ids)):
        others = [j for j in range(len(ids)) if j != i and camera[j] != camera[i]]
        for j in sorted(others, key=lambda j: (-sims[i, j], j))[:k]:
            edges[min(i, j), max(i, j)] = sims[i, j]
    apart = set()
    if rules is not None:
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                overlap = median_iou(bank.seen.get(ids[i], Seen()).boxes, bank.seen.get(ids[j], Seen()).boxes)
                if overlap is not None and overlap < rules.same_box_iou:
                    apart.add((i, j))
    labels = kernels.average_linkage(len(ids), [(i, j, s) for (i, j), s in sorted(edges.items())], theta, apart)
    least = {}
    for g, label in zip(ids, labels.tolist(), strict=True):
        least[label] = min(g, least.get(label, g))
    return {g: least[label] for g, label in zip(ids, labels.tolist(), strict=True)}


def coherence(vectors: np.ndarray, how: str = "avg") -> float:
    """Of all pairs' products the mean, the least or the first quartile; 1 for fewer than two vectors."""
    if len(vectors) < 2:
        return 1.0
    pairs = (vectors @ vectors.T)[np.triu_indices(len(vectors), 1)]
    return float({"avg": np.mean, "min": np.min, "p25": lambda x: np.percentile(x, 25)}[how](pairs))


def halves(vectors: np.ndarray) -> np.ndarray:
    """A two-way spectral cut: the sign of the second eigenvector of the normalised non-negative affinities, 0 for the first row's side."""
    affinity = np.clip(vectors @ vectors.T, 0, None) + 1e-6
    scale = 1 / np.sqrt(affinity.sum(axis=1))
    _, axes = np.linalg.eigh(affinity * scale[:, None] * scale)
    side = axes[:, -2] * scale >= 0
    return (side != side[0]).astype(int)


def split(bank: Bank, assigned: dict, vectors: dict, least: float, how: str = "avg", passes: int = 4) -> dict:
    """Detections of incoherent identities go to the nearest centroid of the parts that their exemplars are cut into: again and
    again in two, until each part's coherence reaches ``least``, at most ``passes`` times. The part with the identity's first
    exemplar keeps its id, others get new ones. Detections without a vector, and identities with fewer than two detections or
    exemplars, stay."""
    out = dict(assigned)
    fresh = max([*assigned.values(), *bank.ids], default=-1) + 1
    for gid in bank.ids:
        own = [d for d, g in assigned.items() if g == gid and d in vectors]
        if len(own) < 2:
            continue
        parts, done = [(gid, bank.of(gid))], []
        for _ in range(passes):
            nxt = []
            for name, part in parts:
                side = halves(part) if len(part) > 1 and coherence(part, how) < least else np.zeros(len(part), int)
                if not side.any():
                    done.append((name, part))
                    continue
                nxt += [(name, part[side == 0]), (fresh, part[side == 1])]
                fresh += 1
            parts = nxt
        done += parts
        if len(done) > 1:
            centre = np.array([unit(p.mean(axis=0)) for _, p in done])
            for d in own:
                out[d] = done[int((centre @ vectors[d]).argmax())][0]
    return out


def cameras_per_id(bank: Bank) -> float:
    return float(np.mean([len(bank.seen.get(g, Seen()).ranges) for g in bank.ids])) if len(bank.owner) else 0.0


def revise(bank: Bank, rules: Rules, assigned: dict, vectors: dict, tau: float, least: float, gate: float = 2.0) -> tuple[dict, str]:
    """Splits where identities span more than ``gate`` cameras on average, else merges."""
    if cameras_per_id(bank) > gate:
        return split(bank, assigned, vectors, least), "split"
    root, _ = consolidate(bank, rules, tau)
    return {d: root.get(g, g) for d, g in assigned.items()}, "merge"


def assign(bank: Bank, rules: Rules, v: np.ndarray, shown: Seen, floor: float, mode: str = "max") -> int | None:
    """The best identity over ``floor`` that no veto rules out for what a detection shows; the bank stays as it is."""
    for gid, score in bank.scores(v, mode):
        if score < floor:
            return None
        if veto(rules, shown, bank.seen.get(gid, Seen())) is None:
            return gid
    return None
