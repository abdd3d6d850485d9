"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared as their letters and digits, lower-cased. An item is cut into overlapping windows
of ``window`` characters, and again into short ones of ``part`` characters every ``stride``, so that any ``part + stride - 1``
characters of an item hold a whole one; the long ones find what has its edits close together, and a short one is not tried
where they have found its part. A window of m characters may be met with up to e = ``edit_percent`` of m edits. Such an
occurrence shares at least t = m + 1 - q (e + 1) q-grams with the window, all on diagonals (text position minus window
position) within e of one another. Shared q-grams are counted in diagonal bands of width 2^k + e that start every 2^k
diagonals, so that some band holds them all; bands with t votes are retained and verified by banded alignment. Where t would
fall under q, e is lowered; items shorter than q characters can't be found.

The benchmark's q-grams are one sorted array that every task gets; a benchmark over ``BLOCK_CHARS`` is searched in blocks
of that size, and what several blocks find in one row is put together by a shuffle of the rows found. There is no other.

Defined results: null and empty texts hold nothing, null and empty items are found nowhere; repeated rows give repeated
results; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import staged

Q = 8
BLOCK_CHARS = 400_000  # each is in about twelve windows
PORTION = 2_000_000


@dataclass(frozen=True)
class Budget:
    window: int = 160
    part: int = 60
    stride: int = 6
    edit_percent: int = 10


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is kept, and its lower case (its first character where that is several)."""
    kept = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        x = chr(c)
        if x.isalnum():
            kept[c] = True
            lower[c] = ord(x.lower()[0])
    return kept, lower


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters that are compared and their places in the text. Texts in Latin-1 stay a byte a character."""
    kept, lower = _tables()
    try:
        points = np.frombuffer(text.encode("latin-1"), np.uint8)
        lower = lower[:256].astype(np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(kept[points])
    return lower[points[at]], at


def grams(chars: np.ndarray) -> np.ndarray:
    """The q-grams as 64-bit numbers: a byte of each character (alignment compares whole characters)."""
    if len(chars) < Q:
        return np.empty(0, np.uint64)
    low = chars if chars.dtype == np.uint8 else (chars ^ (chars >> np.uint32(8))).astype(np.uint8)
    return np.ndarray(len(low) - Q + 1, "<u8", np.ascontiguousarray(low), strides=(1,)).astype(np.uint64)


def edits_allowed(m: int, percent: int) -> int:
    return max(0, min(m * percent // 100, (m + 1 - Q) // Q - 1))


def align(pattern: np.ndarray, text: np.ndarray, most: int, low: int | None = None, high: int | None = None) -> tuple[int, int, int] | None:
    """The least number of edits, at most ``most``, from ``pattern`` to a stretch of ``text``, and that stretch (start, end).
    Paths stay on the diagonals (text position minus pattern position) from ``low`` to ``high``; unbounded, all are open."""
    n, m = len(text), len(pattern)
    low, high = -m if low is None else low, n if high is None else high
    far = 1 << 30
    diagonals = np.arange(low, high + 1)
    width = len(diagonals)
    padded = np.full(m + width, -1, np.int64)  # padded[i + d - low] is text[i + d]
    lo = max(low, 0)
    hi = max(lo, min(n, m + high))
    padded[lo - low : hi - low] = text[lo:hi]
    inside = (diagonals >= 0) & (diagonals <= n)
    cost, start = np.where(inside, 0, far), diagonals.copy()
    steps = np.arange(width)
    for i, c in enumerate(pattern):
        across = cost + (padded[i : i + width] != c)
        across[(diagonals + i < 0) | (diagonals + i >= n)] = far
        down = np.append(cost[1:] + 1, far)  # the pattern's character is left out
        better = down < across
        best, origin = np.where(better, down, across), np.where(better, np.append(start[1:], 0), start)
        best[diagonals + i + 1 < 0] = far
        # Insertions run along the row: the least of best[d] - d so far, plus d.
        key = (best - steps) * (width + 1) + (width - steps)  # the nearest of ties
        run = np.minimum.accumulate(key)
        source = width - (run % (width + 1))
        cost, start = np.minimum(run // (width + 1) + steps, far), origin[source]
        cost[diagonals + i + 1 > n] = far
        if cost.min() > most:
            return None
    at = int(cost.argmin())
    return (int(cost[at]), int(start[at]), int(diagonals[at]) + m) if cost[at] <= most else None


def verify(pattern: np.ndarray, text: np.ndarray, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """The alignment on the diagonals from ``low`` to ``high``; where the pattern occurs as it is, that needs no table."""
    at = text.astype("<u4").tobytes().find(pattern.astype("<u4").tobytes())
    return (0, at // 4, at // 4 + len(pattern)) if at >= 0 and at % 4 == 0 else align(pattern, text, most, low, high)


class Index:
    def __init__(self, items: list[tuple[object, str]], budget: Budget):
        self.windows: list[tuple[object, np.ndarray, int, int, int, int]] = []  # item, characters, edits, threshold, log2 of the step, place in the item
        keys, owners, places = [], [], []
        for item, text in items:
            chars, _ = normalized(text or "")
            m = len(chars)
            if m < Q:
                continue
            cuts = {(lo, min(m, lo + n)) for n, by in ((budget.window, budget.window // 2), (budget.part, budget.stride)) for lo in [*range(0, m - n, by), max(0, m - n)]}
            for lo, hi in sorted(cuts, key=lambda c: (c[0] - c[1], c)):
                part = chars[lo:hi]
                e = edits_allowed(len(part), budget.edit_percent)
                g = grams(part)
                keys.append(g)
                owners.append(np.full(len(g), len(self.windows)))
                places.append(np.arange(len(g)))
                self.windows.append((item, part, e, len(part) + 1 - Q * (e + 1), max(3, (e + 1).bit_length()), lo))
        self.empty = not keys
        if self.empty:
            return
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.place = key[order], np.concatenate(owners)[order], np.concatenate(places)[order]
        self.unique, self.first, self.count = np.unique(self.key, return_index=True, return_counts=True)
        self.table_bits = max(16, int(len(self.unique)).bit_length() + 4)
        self.table = np.zeros(1 << self.table_bits, bool)
        self.table[self._slot(self.unique)] = True
        self.steps = np.array([w[4] for w in self.windows])
        self.edits = np.array([w[2] for w in self.windows])
        self.least = np.array([w[3] for w in self.windows])
        self.fewest = max(1, int(self.least.min()))
        self.longest = max(len(w[1]) for w in self.windows)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.table_bits)

    def _bands(self, maybe: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Numbers of window and band for bands with enough votes. Postings come in portions of about ``PORTION``, and bands that
        the text has passed are settled after each, so a frequent gram in a long text takes time but not memory."""
        total = np.cumsum(self.count[slot])
        cuts = np.unique(np.concatenate((np.searchsorted(total, np.arange(PORTION, total[-1], PORTION)) + 1, [len(maybe)])))
        out, keys, votes, lo = [], np.empty(0, np.int64), np.empty(0, np.int64), 0
        for hi in cuts.tolist():
            part, own = maybe[lo:hi], slot[lo:hi]
            reps = self.count[own]
            position = np.repeat(part, reps)
            posting = np.repeat(self.first[own], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            owner, diagonal = self.owner[posting], position - self.place[posting]
            k, e = self.steps[owner], self.edits[owner]
            band = diagonal >> k
            second = diagonal - (band << k) < e  # also in the band before
            owner, band = np.concatenate([owner, owner[second]]), np.concatenate([band, band[second] - 1])
            new, n = np.unique((owner << 32) + (band + (1 << 31)), return_counts=True)  # a number for each window and band
            if len(keys):
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                votes = np.bincount(at, np.concatenate([votes, n])).astype(np.int64)
            else:
                keys, votes = new, n
            window = keys >> 32
            passed = (((keys & 0xFFFFFFFF) - (1 << 31) + 1) << self.steps[window]) + self.edits[window] + self.longest < maybe[hi - 1]
            passed |= hi == len(maybe)
            out.append(keys[passed & (votes >= self.least[window])])
            keys, votes, lo = keys[~passed], votes[~passed], hi
        return np.sort(np.concatenate(out))

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """``(item, start, end, edits)``, code points of ``text``: for each item and stretch the verified windows, merged."""
        if self.empty or len(text) < Q:
            return []
        chars, at = normalized(text)
        g = grams(chars)
        maybe = np.flatnonzero(self.table[self._slot(g)])
        if not len(maybe):
            return []
        slot = np.searchsorted(self.unique, g[maybe])
        slot[slot == len(self.unique)] = 0
        real = self.unique[slot] == g[maybe]
        maybe, slot = maybe[real], slot[real]
        if len(maybe) < self.fewest:
            return []
        enough = self._bands(maybe, slot)
        found = []
        known: dict[object, list[tuple[int, int, int, int]]] = {}  # of an item: the parts found, in the item and in the text
        for w, b in zip((enough >> 32).tolist(), ((enough & 0xFFFFFFFF) - (1 << 31)).tolist(), strict=True):
            item, pattern, most, _, step, place = self.windows[w]
            # The band is of diagonals within the window, so of text positions of its start.
            lo = max(b << step, 0)
            high = ((b + 1) << step) + most - lo  # an occurrence's diagonals are all in the band, or in one of its neighbours
            if high < 0:
                continue  # it would begin before the text
            hi = min(lo + high + len(pattern), len(chars))
            if any(x <= place and place + len(pattern) <= y and u <= (lo + hi) // 2 < v for x, y, u, v in known.get(item, ())):
                continue
            if hit := verify(pattern, chars[lo:hi], most, (b << step) - lo, high):
                edits, start, end = hit
                known.setdefault(item, []).append((place, place + len(pattern), lo + start, lo + end))
                found.append((item, int(at[lo + start]), int(at[lo + end - 1]) + 1, edits))
        merged: list[list] = []
        for item, a, b, edits in sorted(set(found), key=lambda x: (str(x[0]), x[1], x[2])):
            if merged and merged[-1][0] == item and a <= merged[-1][2]:
                merged[-1][2:] = [max(merged[-1][2], b), min(merged[-1][3], edits)]
            else:
                merged.append([item, a, b, edits])
        return [tuple(x) for x in sorted(merged, key=lambda x: (x[1], x[2], str(x[0])))]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``BLOCK_CHARS`` characters (an item is never cut); each comes to the driver on its own."""
    items = benchmark.select("item_id", F.col("text").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r[0], r[1]) for r in (items if n == 1 else items.where(part == i)).collect()]


_indexes: dict[int, Index] = {}


def contamination(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """The rows of ``docs`` that hold benchmark passages, each once, with ``__items`` (array of ``item_id, start, end, edits``)."""
    key = benchmark.schema["item_id"].dataType.simpleString()
    found = [_search(docs, block, budget, key) for block in _blocks(benchmark)]
    if len(found) == 1:
        return found[0]
    # A row found in several blocks is put together again; equal rows are found in the same blocks, as often as they occur.
    out = None
    for n, part in enumerate(found):
        part = staged(part.withColumn("__block", F.lit(n)), "found")
        out = part if out is None else out.unionByName(part)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = out.select(F.sha2(F.to_json(row), 256).alias("__key"), row.alias("__row"), "__items", "__block")
    per = out.groupBy("__key").agg(F.first("__row").alias("__row"), F.collect_set(F.struct("__block", "__items")).alias("__parts"), F.count("*").alias("__n"))
    items = F.flatten(F.transform(F.array_sort("__parts"), lambda x: x["__items"]))
    copies = F.explode(F.sequence(F.lit(1), (F.col("__n") / F.size("__parts")).cast("int")))
    return per.select("__row", items.alias("__items"), copies.alias("__copy")).select("__row.*", "__items")


def _search(docs: DataFrame, block: list[tuple[object, str]], budget: Budget, key: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"__items array<struct<item_id:{key},start:int,end:int,edits:int>>")
    arrow = to_arrow_schema(schema).field(0).type
    name = hash((tuple(block), budget))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Index(block, budget)
        index = _indexes[name]
        for batch in batches:
            found = [index.search(t.as_py() or "") for t in batch.column("text")]
            mask = pa.array([bool(x) for x in found], pa.bool_())
            items = [[{"item_id": i, "start": a, "end": b, "edits": e} for i, a, b, e in x] for x in found if x]
            rows = batch.filter(mask)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(items, arrow)], names=[*rows.schema.names, "__items"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *schema.fields]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """``docs`` without those that hold a benchmark passage, in one pass for each block of the benchmark. What a pass leaves is
    staged for the next, so a task holds one block's index at a time."""
    for n, block in enumerate(_blocks(benchmark)):
        docs = _drop(staged(docs, "clean") if n else docs, block, budget)
    return docs


def _drop(docs: DataFrame, block: list[tuple[object, str]], budget: Budget) -> DataFrame:
    name = hash((tuple(block), budget))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Index(block, budget)
        index = _indexes[name]
        for batch in batches:
            yield batch.filter(pa.array([not index.search(t.as_py() or "") for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
