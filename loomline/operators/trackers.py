"""Motion trackers over the boxes of one stream: two-stage, observation-centric, and with appearance.

All open tracks of a stream are one batch of constant-velocity Kalman filters, so a frame costs a few matrix operations whatever
the number of tracks. Frames without boxes don't age a track. Equal scores go to the later track, then the later box.
"""

from __future__ import annotations

import numpy as np

from loomline.operators.kernels import best_assignment, iou

# Noise of measured centre, area and aspect; of the first state; of a step.
MEASURE = np.array([1.0, 1.0, 10.0, 10.0])
START = np.array([10.0, 10.0, 10.0, 10.0, 10000.0, 10000.0, 10000.0])
STEP = np.array([1.0, 1.0, 1.0, 1.0, 0.01, 0.01, 0.0001])


def measured(boxes: np.ndarray) -> np.ndarray:
    """Corners to centre, area and aspect."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w * h, w / np.maximum(h, 1e-6)], axis=1)


def corners(state: np.ndarray) -> np.ndarray:
    w = np.sqrt(np.maximum(state[:, 2] * state[:, 3], 1e-6))
    half = np.stack([w, state[:, 2] / np.maximum(w, 1e-6)], axis=1) / 2
    return np.hstack([state[:, :2] - half, state[:, :2] + half])


def centres(boxes: np.ndarray) -> np.ndarray:
    return (boxes[:, :2] + boxes[:, 2:]) / 2


class Motion:
    """Filters in rows: centre, area, aspect, and the speed of the first three."""

    def __init__(self):
        self.x, self.p, self.idle = np.zeros((0, 7)), np.zeros((0, 7, 7)), np.zeros(0, np.int64)
        self.move = np.eye(7) + np.eye(7, k=4)

    def predict(self) -> np.ndarray:
        self.x[self.x[:, 2] + self.x[:, 6] <= 0, 6] = 0.0
        self.x = self.x @ self.move.T
        self.p = self.move @ self.p @ self.move.T + np.diag(STEP)
        self.idle += 1
        return corners(self.x)

    def update(self, rows, boxes: np.ndarray) -> None:
        rows = np.asarray(rows, np.int64)
        p = self.p[rows]
        gain = p[:, :, :4] @ np.linalg.inv(p[:, :4, :4] + np.diag(MEASURE))
        off = measured(np.asarray(boxes, float).reshape(-1, 4)) - self.x[rows, :4]
        self.x[rows] += (gain @ off[:, :, None])[:, :, 0]
        self.p[rows] = p - gain @ p[:, :4, :]
        self.idle[rows] = 0

    def start(self, boxes: np.ndarray) -> None:
        n = len(boxes)
        self.x = np.vstack([self.x, np.hstack([measured(boxes), np.zeros((n, 3))])])
        self.p = np.concatenate([self.p, np.broadcast_to(np.diag(START), (n, 7, 7))])
        self.idle = np.concatenate([self.idle, np.zeros(n, np.int64)])

    def keep(self, mask: np.ndarray) -> None:
        self.x, self.p, self.idle = self.x[mask], self.p[mask], self.idle[mask]


def best_first(score: np.ndarray, allowed: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Greedy one to one among the allowed places; ``rows`` and ``cols`` name them."""
    i, j = np.nonzero(allowed)
    free_i, free_j, out = np.ones(len(rows), bool), np.ones(len(cols), bool), []
    for k in np.lexsort((-j, -i, -score[i, j])):
        if free_i[i[k]] and free_j[j[k]]:
            free_i[i[k]] = free_j[j[k]] = False
            out.append((int(rows[i[k]]), int(cols[j[k]])))
    return out


def _rest(n: int, taken) -> np.ndarray:
    return np.setdiff1d(np.arange(n), np.fromiter(taken, np.int64))


class TwoStage:
    """Boxes of high confidence continue the predicted tracks first, those of low confidence what is left. Unmatched boxes of at
    least ``birth`` start a track; every other box is a track of its own."""

    def __init__(self, least: float = 0.3, most_idle: int = 30, high: float = 0.5, birth: float = 0.6):
        self.least, self.most_idle, self.high, self.birth = least, most_idle, high, birth
        self.motion, self.names, self.fresh = Motion(), [], 0

    def pairs(self, at: np.ndarray, boxes: np.ndarray, conf: np.ndarray) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for cols in (np.flatnonzero(conf >= self.high), np.flatnonzero(conf < self.high)):
            rows = _rest(len(at), (r for r, _ in found))
            s = iou(at[rows], boxes[cols])
            found += best_first(s, s >= self.least, rows, cols)
        return found

    def moved(self, pairs: list[tuple[int, int]], boxes: np.ndarray) -> None:
        self.motion.update([r for r, _ in pairs], boxes[[c for _, c in pairs]])

    def started(self, boxes: np.ndarray) -> None:
        self.motion.start(boxes)

    def ended(self, alive: np.ndarray) -> None:
        self.motion.keep(alive)

    def starts(self, conf: np.ndarray) -> np.ndarray:
        return conf >= max(self.high, self.birth)

    def feed(self, boxes: np.ndarray, conf: np.ndarray) -> list[str]:
        """The boxes of the next frame; a name for each: ``K`` and a number for tracks, ``S`` for boxes alone."""
        boxes, conf = np.asarray(boxes, float).reshape(-1, 4), np.asarray(conf, float)
        at = self.motion.predict()
        pairs = self.pairs(at, boxes, conf) if len(at) and len(boxes) else []
        if pairs:
            self.moved(pairs, boxes)
        names = {c: self.names[r] for r, c in pairs}
        fresh = [c for c in np.flatnonzero(self.starts(conf)).tolist() if c not in names]
        for kind, cols in (("K", fresh), ("S", [c for c in range(len(boxes)) if c not in names and c not in set(fresh)])):
            for c in cols:
                names[c], self.fresh = f"{kind}{self.fresh}", self.fresh + 1
        if fresh:
            self.started(boxes[fresh])
            self.names += [names[c] for c in fresh]
        alive = self.motion.idle <= self.most_idle
        if not alive.all():
            self.ended(alive)
            self.names = [n for n, a in zip(self.names, alive, strict=True) if a]
        return [names[c] for c in range(len(boxes))]


class ObservationCentric(TwoStage):
    """Overlap with the prediction, with a bonus where a box lies in the direction of travel; then overlap with the last box seen.
    A track that comes back is updated along the straight way from its last box."""

    def __init__(self, least: float = 0.3, most_idle: int = 30, birth: float = 0.6, back: int = 3, bonus: float = 0.2):
        super().__init__(least, most_idle, 0.0, birth)
        self.back, self.bonus = back, bonus
        self.last, self.past = np.zeros((0, 4)), []  # last box, and the last centres, of each track

    def pairs(self, at: np.ndarray, boxes: np.ndarray, conf: np.ndarray) -> list[tuple[int, int]]:
        overlap = iou(at, boxes)
        way = centres(boxes)[None] - centres(self.last)[:, None]
        speed = np.array([p[-1] - p[0] for p in self.past])
        length = np.linalg.norm(way, axis=2) * np.linalg.norm(speed, axis=1)[:, None]
        known = (np.linalg.norm(way, axis=2) > 1e-6) & (np.linalg.norm(speed, axis=1) > 1e-6)[:, None]
        turn = np.where(known, np.einsum("ijk,ik->ij", way, speed) / np.where(known, length, 1.0), 0.0)
        found = best_first(overlap + self.bonus * turn, overlap >= self.least, np.arange(len(at)), np.arange(len(boxes)))
        rows, cols = _rest(len(at), (r for r, _ in found)), _rest(len(boxes), (c for _, c in found))
        again = iou(self.last[rows], boxes[cols])
        return found + best_first(again, again >= self.least, rows, cols)

    def moved(self, pairs: list[tuple[int, int]], boxes: np.ndarray) -> None:
        for r, c in pairs:
            gap = int(self.motion.idle[r])
            for k in range(1, gap + 1):
                self.motion.update([r], self.last[r] + (boxes[c] - self.last[r]) * (k / gap))
            self.last[r] = boxes[c]
            self.past[r] = [*self.past[r], centres(boxes[c][None])[0]][-(self.back + 1) :]

    def started(self, boxes: np.ndarray) -> None:
        super().started(boxes)
        self.last = np.vstack([self.last, boxes])
        self.past += [[c] for c in centres(boxes)]

    def ended(self, alive: np.ndarray) -> None:
        super().ended(alive)
        self.last = self.last[alive]
        self.past = [p for p, a in zip(self.past, alive, strict=True) if a]


class WithAppearance:
    """Least-cost assignment over overlap with the prediction and likeness to a running mean of looks, high confidence first, then
    low confidence by overlap alone. Only boxes of high confidence start tracks; a box of low confidence that no track takes has
    none. A track is cut into pieces of at most ``window`` frames and keeps its motion and looks across the cut."""

    FAR = 1.0e6  # a cost no overlap reaches: such pairs are assigned last and then taken back

    def __init__(self, window: int = 60, least: float = 0.3, high: float = 0.5, most_idle: int = 30, weight: float = 0.5, memory: float = 0.9):
        self.window, self.least, self.high, self.most_idle, self.weight, self.memory = window, least, high, most_idle, weight, memory
        self.motion, self.looks, self.tracks, self.fresh = Motion(), np.zeros((0, 0)), [], 0  # tracks: name, piece, first frame of the piece

    def _assign(self, overlap: np.ndarray, gain: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
        cost = np.where(overlap >= self.least, 1.0 - gain, self.FAR)
        return [(int(rows[i]), int(cols[j])) for i, j in best_assignment(cost) if cost[i, j] < self.FAR / 10]

    def feed(self, frame: int, boxes: np.ndarray, conf: np.ndarray, looks: np.ndarray) -> list[tuple[int, int] | None]:
        """The boxes of the next frame; for each its track and piece, or none."""
        boxes, conf, looks = np.asarray(boxes, float).reshape(-1, 4), np.asarray(conf, float), np.asarray(looks, float)
        at = self.motion.predict()
        high, low = np.flatnonzero(conf >= self.high), np.flatnonzero(conf < self.high)
        pairs: list[tuple[int, int]] = []
        if len(at) and len(high):
            overlap = iou(at, boxes[high])
            pairs = self._assign(overlap, overlap + self.weight * (self.looks @ looks[high].T), np.arange(len(at)), high)
        rows = _rest(len(at), (r for r, _ in pairs))
        if len(rows) and len(low):
            overlap = iou(at[rows], boxes[low])
            pairs += self._assign(overlap, overlap, rows, low)
        out: list[tuple[int, int] | None] = [None] * len(boxes)
        if pairs:
            r, c = (np.array(x) for x in zip(*pairs, strict=True))
            self.motion.update(r, boxes[c])
            mixed = self.memory * self.looks[r] + (1 - self.memory) * looks[c]
            self.looks[r] = mixed / (np.linalg.norm(mixed, axis=1, keepdims=True) + 1e-9)
            for row, col in pairs:
                track = self.tracks[row]
                if track[2] is None:
                    track[1:] = [track[1] + 1, frame]
                out[col] = (track[0], track[1])
        for track in self.tracks:
            if track[2] is not None and frame - track[2] + 1 >= self.window:
                track[2] = None
        born = [c for c in high.tolist() if out[c] is None]
        if born:
            self.motion.start(boxes[born])
            own = looks[born] / (np.linalg.norm(looks[born], axis=1, keepdims=True) + 1e-9)
            self.looks = np.vstack([self.looks.reshape(-1, own.shape[1]), own])
            for c in born:
                self.tracks.append([self.fresh, 0, frame])
                out[c], self.fresh = (self.fresh, 0), self.fresh + 1
        alive = self.motion.idle <= self.most_idle
        self.motion.keep(alive)
        self.looks = self.looks[alive]
        self.tracks = [t for t, a in zip(self.tracks, alive, strict=True) if a]
        return out
