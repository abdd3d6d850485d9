"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From its syntax tree a Boolean query over trigrams is derived that every match
satisfies: an alternation is an OR of its branches, a sequence an AND of what its parts and their joins demand (the
method of public code-search engines). Every block of ``BLOCK`` documents is indexed by the trigrams that some rule asks
for, postings are intersected and united as the query says, and only the documents left are searched with the
expression. A rule that demands no trigram is run over every document.

A rule's matches are taken leftmost and without overlap, then those whose length condition fails are dropped. Offsets
are code points, ends exclusive.

Defined results: null and empty texts have no spans; repeated rows repeat; matches of different kinds may overlap;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length must be
    least: int = 0  # this at least
    any_case: bool = False


#: The base rules. (For the third, the runs of 16 and more are the runs that pass the length condition.)
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Rules beyond the base: key blocks and tokens with public prefixes.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("repo_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

# A query is True (no demand), a trigram, or ("and" | "or", queries).
BLOCK = 500  # documents that an index holds, which bounds its memory
SETS = 24  # strings that a set may hold before only its trigrams are kept


def _both(op: str, parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _demand(strings: set[str]) -> object:
    """That one of the strings occurs."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tree) -> Iterator[object]:
    """The items of a sequence: a set of strings that an item is one of, or a query for an item of unknown text."""
    for op, arg in tree:
        if op is C.LITERAL:
            yield {chr(arg)}
        elif op is C.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(chr(x))
                elif kind is C.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c) for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            yield chars if chars and len(chars) <= 8 else True
        elif op is C.SUBPATTERN:
            yield from _walk_one(arg[-1])
        elif op is C.BRANCH:
            branches = [list(_walk(b)) for b in arg[1]]
            sets = [_exact(b) for b in branches]
            if all(s is not None for s in sets) and sum(map(len, sets)) <= SETS:
                yield set().union(*sets)
            else:
                yield _both("or", [_query(b) for b in branches])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            inner = list(_walk(sub))
            exact = _exact(inner)
            if low == 0 and high == 1 and exact is not None and len(exact) < SETS:
                yield exact | {""}
            elif low:
                for _ in range(min(low, 3)):
                    yield from inner
                if high != low or low > 3:
                    yield True
            else:
                yield True
        elif op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
            yield {""}
        else:
            yield True


def _walk_one(tree) -> Iterator[object]:
    items = list(_walk(tree))
    exact = _exact(items)
    if exact is not None:
        yield exact
    else:
        yield from items


def _exact(items: list) -> set[str] | None:
    out = {""}
    for x in items:
        if not isinstance(x, set) or len(out) * len(x) > SETS:
            return None
        out = {a + b for a, b in product(out, x)}
    return out


def _query(items: list) -> object:
    """Runs of known text demand their trigrams; a run is cut where it would have too many strings."""
    demands, run = [], {""}
    for x in items:
        if isinstance(x, set) and len(run) * len(x) <= SETS:
            run = {a + b for a, b in product(run, x)}
            continue
        demands.append(_demand(run))
        if isinstance(x, set):
            tails = {a[-2:] for a in run}
            run = {a + b for a, b in product(tails, x)} if len(tails) * len(x) <= SETS else x if len(x) <= SETS else {""}
        else:
            demands.append(x)
            run = {""}
    return _both("and", [*demands, _demand(run)])


def trigram_query(pattern: str) -> object:
    """What the lower-cased text of every match must contain; True where that is nothing."""

    def lower(q):
        if isinstance(q, str):
            return q.lower()
        return q if q is True else _both(q[0], [lower(x) for x in q[1]])

    return lower(_query(list(_walk(parser.parse(pattern)))))


def _leaves(q) -> set[str]:
    return {q} if isinstance(q, str) else set() if q is True else set().union(*map(_leaves, q[1]))


def _code(t: str) -> int | None:
    b = t.encode()
    return b[0] << 16 | b[1] << 8 | b[2] if len(b) == 3 else None


class Index:
    """Postings, for a block of documents, of the trigrams that the rules ask for."""

    def __init__(self, queries: list[object]):
        leaves = {t: _code(t) for q in queries for t in _leaves(q)}
        self.codes = {t: c for t, c in leaves.items() if c is not None}
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[list(self.codes.values())] = True
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def build(self, docs: list[bytes]) -> None:
        self.n = len(docs)
        ends = np.cumsum([len(d) for d in docs])
        postings: dict[int, list[np.ndarray]] = {}
        flat = self.fold[np.frombuffer(b"".join(docs), np.uint8)]
        for lo in range(0, max(len(flat) - 2, 0), 1 << 22):
            part = flat[lo : lo + (1 << 22) + 2].astype(np.uint32)
            if len(part) < 3:
                break
            grams = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            at = np.flatnonzero(self.wanted[grams])
            doc = np.searchsorted(ends, at + lo, side="right")
            inside = at + lo + 3 <= ends[doc]
            for code in np.unique(grams[at]):
                postings.setdefault(int(code), []).append(doc[inside & (grams[at] == code)])
        self.postings = {c: np.unique(np.concatenate(p)) for c, p in postings.items()}

    def find(self, q) -> np.ndarray:
        if q is True:
            return np.arange(self.n)
        if isinstance(q, str):
            if q not in self.codes:
                return np.arange(self.n)
            return self.postings.get(self.codes[q], np.empty(0, np.int64))
        lists = [self.find(x) for x in q[1]]
        if q[0] == "or":
            return np.unique(np.concatenate(lists))
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out


_indexes: dict[tuple[Rule, ...], tuple] = {}


def _prepared(rules: tuple[Rule, ...]) -> tuple:
    if rules not in _indexes:
        queries = [trigram_query(r.pattern) for r in rules]
        _indexes[rules] = queries, [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules], Index(queries)
    return _indexes[rules]


def find_spans(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text, ``(start, rule number, end)`` in order."""
    queries, patterns, index = _prepared(rules)
    index.build([t.encode("utf-8", "surrogatepass") for t in texts])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
        for i in index.find(query).tolist():
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield batch.slice(lo, BLOCK)


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, the count ``n_<kind>`` of each base rule, ``base_spans`` and ``spans`` (``kind:start:end`` by start, then rule)."""
    rules = base + more
    counts = [f"n_{r.kind}" for r in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = find_spans(batch.column("text").to_pylist(), rules)
            said = [[(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in spans] for spans in found]
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(j == k for j, _ in x) for x in said], pa.int64()) for k in range(len(base))]
            columns += [pa.array([",".join(t for j, t in x if j < len(base)) for x in said], pa.string()), pa.array([",".join(t for _, t in x) for x in said], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_spans", "spans"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_spans string, spans string")


def redact(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with every span replaced by its kind's mark (spans that overlap are one, named after the first), and ``n_chars``, where there is such a column, of the new text. A text without spans, null included, stays as it is."""
    rules, names = base + more, docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = batch.column("text").to_pylist()
            found = find_spans([t or "" for t in texts], rules)
            for i, spans in enumerate(found):
                if spans:
                    out, at, last = [], 0, None
                    for a, k, b in spans:
                        if last is None or a >= at:
                            out += [texts[i][at:a], mark.format(kind=rules[k].kind)]
                            last = k
                        at = max(at, b)
                    texts[i] = "".join([*out, texts[i][at:]])
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(texts, found, old, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, schema)
