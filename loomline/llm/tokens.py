"""Token ids: a cached encoder, and flat binary files of ids with 64-bit document offsets.

**Encoder.** Ids come from the ``tokenizers`` library; the vocabulary file's path is a parameter. Both kinds of
vocabulary that are supported cut a text at white space before they merge, so a text's ids are the ids of its words
in order. The encoder keeps the ids of words and of their pre-tokens that it has met twice, as bytes, in caches that are
emptied at ``WORDS`` and ``CACHE`` entries. A word outside ASCII and the Latin-1 letters goes to the library as it is, and a text
with unusual white space goes there whole, so that nothing depends on how this module classifies characters.

**Files.** A shard is three files: ``.bin`` (unsigned 16-bit ids, or 32-bit where the vocabulary needs them, little
endian, nothing else), ``.idx`` (a 64-bit offset per document and one more, counted in ids from the shard's start) and
``.doc`` (the 64-bit document ids). Shards are cut by range of ``doc_id``; a shard's base, the ids in all shards before
it, is a prefix sum over the manifest. A task writes under a name of its own attempt and the manifest names the files
of the attempt that succeeded, so a repeated task leaves no trace in the result.

Defined results: null texts are empty and have just the end id; null document ids come first and are stored as
``NO_ID``; rows that repeat are stored as often as they occur, next to one another.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import work_path

CACHE, WORDS = 150_000, 600_000
NO_ID = -(2**63)
#: A shard holds about so much text, if that makes more shards than a shuffle has partitions. The manifest, a row per shard,
#: comes to the driver: a million rows for 128 TB.
SHARD_BYTES = 128_000_000
READ_DOCS = 10_000
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_SMALL = "a-zß-öø-ÿ"
#: White space other than space and line feed, and what some libraries count as such.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
_PLAIN = re.compile(f"[\n\x20-\x7e{_L}]*")
#: The pre-token patterns of the two vocabularies, for plain words.
_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_SMALL}]+|[0-9]|[^\s{_SMALL}0-9]+")
_RUNS = re.compile(r"\s*\S+|\s+")


class _Cache(dict):
    """What ``make`` gives for a key, kept from the second time on that the key is asked for (as far as a bitmap of hashes
    tells), since most different words of a corpus come once. Emptied at ``most`` entries; results never depend on it."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.met = make, most, bytearray(1 << 20)

    def __missing__(self, key):
        out = self.make(key)
        at = hash(key)
        place, bit = at >> 3 & 0xFFFFF, 1 << (at & 7)
        if not self.met[place] & bit:
            self.met[place] |= bit
        elif len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.met = bytearray(1 << 20)
            self[key] = out
        return out


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(self.tokenizer.to_str())
        kinds = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        pre = spec.get("pre_tokenizer") or {}
        self.vocabulary = self.tokenizer.get_vocab_size()
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None:
            self.encode, self.pattern, self.lower = self._spaced, _SPACED, False
        elif spec["model"].get("end_of_word_suffix") == "</w>" and '"Removed"' in kinds and '"Lowercase"' in kinds:
            self.encode, self.pattern, self.lower = self._worded, _WORDS, True
        else:
            self.encode = self.whole
        self.tokens = _Cache(self._token, CACHE)
        self.raw = _Cache(self._chunk, WORDS)
        self.after_space = _Cache(lambda c: self._chunk(" " + c), WORDS)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.table = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}  # bytes as the library spells them

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _token(self, token: str) -> bytes:
        spelled = token.replace(" ", "\u0120").replace("\n", "\u010a") if token.isascii() else token.encode().decode("latin-1").translate(self.table)
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def _chunk(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha() and word.isascii():  # one pre-token
            return self._token(chunk.lower() if self.lower else chunk)
        if not _PLAIN.fullmatch(chunk):
            return self.whole(chunk)
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(chunk.lower() if self.lower else chunk)))

    @staticmethod
    def _odd(text: str) -> bool:
        if text.isascii():
            return any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
        return _ODD.search(text) is not None

    def _spaced(self, text: str) -> bytes:
        if self._odd(text):
            return self.whole(text)
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
            return b"".join(map(self.raw.__getitem__, _RUNS.findall(text)))
        # White space comes singly: a line feed is a token, a space goes with the word after it.
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.raw[first] + b"".join(map(self.after_space.__getitem__, rest)))
        return self.raw["\n"].join(lines)

    def _worded(self, text: str) -> bytes:
        if self._odd(text):
            return self.whole(text)
        return b"".join(map(self.raw.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and vocabulary: Python workers are used again, and their caches with them."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    for x in batch.column(name):
        yield x.as_py() or ""


def _store(out: str):
    """The file system and path of a folder, whatever its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(out) if "://" in out or out.startswith("file:") else (fs.LocalFileSystem(), out)


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, out: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the ids of ``docs`` (``doc_id``, ``text``) in ascending ``doc_id`` order and returns the manifest: a row
    per shard with ``shard, path, bits, n_docs, n_ids, base``. ``out`` is a folder that all executors share."""
    spark = docs.sparkSession
    out = out or work_path(spark, "ids")
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer; .doc files hold 64-bit ids")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(vocabulary)
        bits = 16 if coder.vocabulary <= 1 << 16 and end_id < 1 << 16 else 32
        end = Encoder._bytes([end_id])
        shard = TaskContext.get().partitionId()
        store, folder = _store(out)
        store.create_dir(folder, recursive=True)
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"
        at, offsets, ids = 0, array("q", [0]), array("q")
        stream = None
        for batch in batches:
            if stream is None and batch.num_rows:
                stream = store.open_output_stream(f"{path}.bin")
            for doc, text in zip(batch.column("doc_id"), texts(batch), strict=True):
                flat = coder.encode(text) + end
                at += len(flat) // 4
                offsets.append(at)
                ids.append(NO_ID if doc.as_py() is None else doc.as_py())
                if bits == 16:
                    both = array("H", flat)
                    flat = (both[::2] if sys.byteorder == "little" else both[1::2]).tobytes()
                stream.write(flat)
        if stream is None:
            return
        stream.close()
        for end_of_name, numbers in ((".idx", offsets), (".doc", ids)):
            with store.open_output_stream(path + end_of_name) as f:
                f.write(numbers.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "bits": [bits], "n_docs": [len(ids)], "n_ids": [at]}, schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("bits", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    made = rows.mapInArrow(write, "shard int, path string, bits int, n_docs long, n_ids long")
    # The manifest is a row per shard; only it comes to the driver, and the files are written once.
    manifest = spark.createDataFrame(made.collect(), "shard int, path string, bits int, n_docs long, n_ids long")
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read_ids(manifest: DataFrame, out: str) -> DataFrame:
    """Reads the files again: ``doc_id, start, n_tokens, ids_crc32`` of every document, from shards mapped into memory, or read by range."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        store, _ = _store(out)
        local = store.type_name == "local"

        def numbers(path: str, kind: str, lo: int, hi: int) -> np.ndarray:
            """A range of a file's numbers: mapped where the store is a local file system, else read by range."""
            width = np.dtype(kind).itemsize
            if local:
                return np.memmap(path, kind, "r")[lo:hi] if hi > lo else np.empty(0, kind)
            with store.open_input_file(path) as f:
                return np.frombuffer(f.read_at((hi - lo) * width, lo * width), kind)

        for batch in batches:
            for s in batch.to_pylist():
                kind = "<u2" if s["bits"] == 16 else "<u4"
                for lo in range(0, s["n_docs"], READ_DOCS):
                    hi = min(lo + READ_DOCS, s["n_docs"])
                    part = numbers(s["path"] + ".doc", "<i8", lo, hi).tolist()
                    cuts = numbers(s["path"] + ".idx", "<i8", lo, hi + 1).tolist()
                    ids = numbers(s["path"] + ".bin", kind, cuts[0], cuts[-1])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": [None if x == NO_ID else x for x in part],
                            "start": [s["base"] + a for a in cuts[:-1]],
                            "n_tokens": [b - a for a, b in pairwise(cuts)],
                            "ids_crc32": [zlib.crc32(ids[a - cuts[0] : b - cuts[0]].astype("<u4").tobytes()) for a, b in pairwise(cuts)],
                        },
                        schema=schema,
                    )

    n = max(manifest.count(), 1)
    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    out = work_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, vocabulary, end_id, out), out)
