"""Best-fit packing of token sequences.

Every document is encoded, ended with an id, and cut into pieces of ``length`` ids only where it is longer. The pieces
of a partition come in windows of ``window`` pieces, the longest of a window first, and go into a bounded number of
open sequences: each into the open sequence with the least free space that holds it. Open sequences are kept in a bitset keyed by free space, so the best fit is the
lowest set bit from the piece's length on; when one more than ``open_bins`` would be open, the fullest closes. A piece's place is
known as soon as it is placed, so rows stream out and memory is bounded by the window and the open sequences.

A partition packs its own pieces, and what it leaves under-filled (by more than a ``TAIL``-th) depends on how the table is
cut. So the pieces of these sequences are packed once more in the same way, now those of many partitions together, longest
first: one task for each ``open_bins`` sequences that they would fill. Only lengths and ids of pieces are shuffled for that.

Defined results: a null or empty text is one piece with just the end id; rows that repeat are packed as often as they
occur; an empty table gives an empty result. Sequence numbers are unique, not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import staged
from loomline.llm.tokens import Encoder, encoder, texts

LENGTH = 2048
TAIL = 256
OPEN_BINS = 8192
WINDOW = 8192


class BestFit:
    """``place(n)`` gives the sequence and the offset for a piece of ``n`` ids."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.open_bins = length, open_bins
        self.bits, self.count, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.length, self.next
            self.next += 1
        if free > n:
            self.by_free[free - n].append(number)
            self.bits |= 1 << (free - n)
            self.count += 1
            if self.count > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.length - free


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = LENGTH, open_bins: int = OPEN_BINS, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, its ``ids``."""
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("sequence_id", "long"), ("offset", "long")]
    fields += [("ids", "array<int>")] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        coder, end, bins = encoder(vocabulary), Encoder._bytes([end_id]), BestFit(length, open_bins)
        base = TaskContext.get().partitionId() << 36
        kinds = [None, pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())][: len(fields)]
        waiting: list[tuple] = []

        def placed() -> pa.RecordBatch:
            waiting.sort(key=lambda p: -p[3])  # stable: ties stay in order
            spots = [bins.place(p[3]) for p in waiting]
            columns = [*zip(*waiting, strict=True)]
            columns[5:5] = [base + n for n, _ in spots], [offset for _, offset in spots]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=[n for n, _ in fields])

        for batch in batches:
            kinds[0] = batch.column("doc_id").type
            for doc, text in zip(batch.column("doc_id"), texts(batch), strict=True):
                flat = coder.encode(text) + end
                for piece, at in enumerate(range(0, len(flat), 4 * length)):
                    part = flat[at : at + 4 * length]
                    ids = (np.frombuffer(part, "<u4").astype("i4"),) if with_ids else ()
                    waiting.append((doc.as_py(), piece, at // 4, len(part) // 4, zlib.crc32(part), *ids))
                    if len(waiting) >= window:
                        yield placed()
        if waiting:
            yield placed()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    packed = staged(rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields)), "packed")
    return _together(packed, length, open_bins)


def _together(packed: DataFrame, length: int, open_bins: int) -> DataFrame:
    """``packed`` with the pieces of its under-filled sequences in new ones."""
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    slack = staged(fill.where(F.col("fill") < length - length // TAIL), "slack")
    left = slack.agg(F.count("*"), F.sum("fill")).first()
    if left[0] < 2:
        return packed
    tasks = -(-left[1] // (length * open_bins))
    tail = packed.join(slack.select("sequence_id"), "sequence_id", "left_semi").select(packed.columns)
    tail = tail.repartition(tasks, "sequence_id").sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(length, open_bins), (1 << 62) + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            spots = [bins.place(n) for n in batch.column("length").to_pylist()]
            numbers = {"sequence_id": [base + n for n, _ in spots], "offset": [offset for _, offset in spots]}
            columns = [pa.array(numbers[n], pa.int64()) if n in numbers else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    again = tail.mapInArrow(run, packed.schema)
    return packed.join(slack.select("sequence_id"), "sequence_id", "left_anti").select(packed.columns).union(again)
