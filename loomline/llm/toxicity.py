"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities and counts of a fixed lexicon of insults (as written, and only after undoing digits, signs, repeats
and spacing) and of a learned one (words and word beginnings that come in far more toxic than other labelled texts), their nearness to words of the second person, capitals, punctuation, digits, repeated letters, length. The
trees and the learned lexicon are fitted on the driver to a sample of labelled rows whose size is a parameter
(``Fit.rows``, the rows with the smallest hashes, without texts over ``Fit.longest``). While the trees are fitted, a row's
learned lexicon is that of the ``Fit.folds`` that it isn't in, so its own label isn't among its features; and all rows
calibrate, each by the score of trees that haven't seen its fold. Scoring is one pass without a shuffle.

Defined results: null and empty texts have features of their own (all zero) and get a score; with no labelled rows, or
of one label only, every score is the share of toxic rows (0 if there are none); labels whose id repeats count as toxic if one of
them is; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Insults in the languages of the corpus, and words of the second person.
LEXICON = frozenset(
    """idiot idiots moron morons scum clown clowns pathetic worthless trash disgusting stupid loser losers dumb fool fools
    imbecile ugly garbage filth filthy vermin pig pigs rat rats liar liars coward cowards creep creeps freak freaks jerk
    jerks hate despise useless hopeless brainless nasty vile wretch parasite parasites degenerate disgrace
    idiota imbecil estupido estupida basura asqueroso inutil idiote imbécile stupide ordure dégoûtant minable abruti
    dumm dummkopf abschaum ekelhaft wertlos widerlich trottel versager erbärmlich""".split()
)
SECOND = frozenset("you your yours yourself u ur thou du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l"})
_EDGE = "\"'`.,;:!?()[]{}<>«»“”‘’…*_-~#%&/\\=|$"
CACHE = 400_000
FEATURES = (
    "log_words", "insult_density", "log_insults", "hidden_density", "log_hidden", "near_second", "second_density", "capitals",
    "capital_words", "exclamations", "questions", "punctuation", "signs", "digits", "repeats", "spaced",
    "learned_density", "log_learned", "learned_second",
)


@dataclass(frozen=True)
class Fit:
    rows: int = 6_000  # labelled rows at most
    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    least: int = 20  # rows in a leaf
    bins: int = 32
    folds: int = 4
    longest: int = 100_000  # characters of a row that may be drawn, so the sample's size is bounded in bytes, too


def _squeezed(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if i == 0 or c != word[i - 1])


_SQUEEZED = {_squeezed(w) for w in LEXICON}


STEMS = (5, 7)  # letters of a word's beginning that the learned lexicon looks at, besides the whole word


def word_of(token: str) -> str:
    return token.strip(_EDGE).lower()


def beginnings(word: str) -> list[str]:
    return [f"{word[:k]}-" for k in STEMS if len(word) > k] + [word]


def learned_lexicon(texts: list[str], y: np.ndarray, most: int = 200) -> dict[str, float]:
    """Words and beginnings and their log odds ratios, of those whose difference is beyond four standard errors."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return {}
    words = [{word_of(t) for t in x.split()} for x in texts]
    seen = Counter(b for w, t in zip(words, y, strict=True) if t for b in {b for x in w if len(x) > 2 for b in beginnings(x)})
    wanted = {b for b, a in seen.items() if a >= max(5, n1 // 100)}
    rest = Counter(b for w, t in zip(words, y, strict=True) if not t for b in {b for x in w for b in beginnings(x) if b in wanted})
    found = []
    for b in wanted:
        p1, p0 = (seen[b] + 0.5) / (n1 + 1), (rest[b] + 0.5) / (n0 + 1)
        z = (p1 - p0) / (p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) ** 0.5
        if z >= 4 and p1 >= 4 * p0:
            found.append((-z, b, float(np.log(p1 / p0))))
    return {b: w for _, b, w in sorted(found)[:most]}


class _Kinds(dict):
    """Of a token: 1 insult, 2 hidden insult, 3 second person, 4 single letter, 5 repeated letters, 0 else; 8 is added for
    capitals, and 16 times the number of the learned lexicon's entry that weighs most."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.number = {b: i + 1 for i, b in enumerate(lexicon)}
        self.weights = np.array([0.0, *lexicon.values()])

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        word = token.strip(_EDGE)
        low = word.lower()
        loud = 8 * (len(word) > 1 and word.isupper())
        if low in LEXICON:
            kind = 1
        elif low in SECOND:
            kind = 3
        elif len(low) == 1 and low.isalpha():
            kind = 4
        else:
            kind = 2 * self.hidden(token.lower().strip("\"'.,;:?()[]{}")) or 5 * any(low[i] == low[i - 1] == low[i - 2] for i in range(2, len(low)))
        learned = max((self.number[b] for b in beginnings(low) if b in self.number), key=lambda i: self.weights[i], default=0) if self.number else 0
        code = kind + loud + 16 * learned
        if len(token) <= 40:
            self[token] = code
        return code

    @staticmethod
    def hidden(token: str) -> bool:
        if not 3 <= len(token) <= 40:
            return False
        plain = token.translate(_LEET)
        letters = "".join(c for c in plain if c.isalpha())
        if letters in LEXICON or _squeezed(letters) in LEXICON or (letters != _squeezed(letters) and _squeezed(letters) in _SQUEEZED):
            return True
        if "*" in token.strip("*"):  # masked letters
            word = token.strip("*.,")
            return any(len(w) == len(word) and all(a in ("*", b) for a, b in zip(word, w, strict=True)) for w in LEXICON)
        return False


_BYTES = np.zeros((6, 256))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"?", b".,;:'\"()-", b"#*$%&|<>@~^_=+/\\", b"0123456789")):
    _BYTES[_i, list(_chars)] = 1


def features(text: str, known: _Kinds) -> list[float]:
    tokens = text.split()
    n = max(len(tokens), 1)
    codes = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    low, loud, learned = codes & 7, codes >> 3 & 1, codes >> 4
    insults, hidden, second = np.flatnonzero(low == 1), np.flatnonzero(low == 2), np.flatnonzero(low == 3)
    spaced = 0
    single = low == 4
    if single.any():  # runs of single letters
        edges = np.flatnonzero(np.diff(np.concatenate(([0], single, [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= 3:
                run = "".join(t.strip(_EDGE) for t in tokens[a:b]).lower()
                spaced += run in LEXICON
    hits = np.concatenate([insults, hidden])

    def near(places: np.ndarray) -> float:
        if not len(places) or not len(second):
            return 0.0
        i = np.searchsorted(second, places)
        gap = np.minimum(np.abs(places - second[np.minimum(i, len(second) - 1)]), np.abs(places - second[np.maximum(i - 1, 0)]))
        return float((gap <= 5).mean())

    taught = np.flatnonzero(learned)
    raw = text.encode("utf-8", "surrogatepass")
    chars = _BYTES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(len(raw), 1)
    h = len(hidden) + spaced
    return [
        np.log1p(len(tokens)), len(insults) / n, np.log1p(len(insults)), h / n, np.log1p(h), near(hits), len(second) / n, chars[0],
        float(loud.sum()) / n, chars[1], chars[2], chars[3], chars[4], chars[5], float((low == 5).sum()) / n, spaced / n,
        float(known.weights[learned].sum()) / n, np.log1p(len(taught)), near(taught),
    ]


class Boosted:
    """Trees on binned features, for the logistic loss; each is ``depth`` levels of (feature, bin) splits in heap order."""

    def __init__(self, fit: Fit):
        self.fit = fit

    def train(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        f = self.fit
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, f.bins + 1)[1:-1])) for c in x.T]
        # Rare features are zero at most quantiles: their positive values get cuts too.
        self.cuts = [np.unique(np.concatenate([q, [0.0], np.quantile(c[c > 0], np.linspace(0, 1, 9)[1:-1])])) if (c > 0).any() else q for q, c in zip(cuts, x.T, strict=True)]
        binned = self._bin(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        self.trees = []
        for _ in range(f.trees):
            prob = 1 / (1 + np.exp(-raw))
            tree, out = self._grow(binned, y - prob, prob * (1 - prob))
            self.trees.append(tree)
            raw = raw + out
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray):
        f = self.fit
        node = np.zeros(len(g), np.int64)
        splits, width = {}, max(len(c) for c in self.cuts) + 1
        for level in range(f.depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = (1e-6, None)
                if len(rows) >= 2 * f.least:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j in range(x.shape[1]):
                        b = x[rows, j]
                        left_n, left_g, left_h = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (None, g[rows], h[rows]))
                        ok = (left_n >= f.least) & (len(rows) - left_n >= f.least)
                        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                        gain[~ok] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), (j, int(gain.argmax())))
                splits[k] = best[1]
                go = x[rows, best[1][0]] > best[1][1] if best[1] else np.zeros(len(rows), bool)
                node[rows] = 2 * k + 1 + go
        first = 2**f.depth - 1
        leaf_g, leaf_h = np.bincount(node - first, g, 2**f.depth), np.bincount(node - first, h, 2**f.depth)
        values = f.rate * leaf_g / (leaf_h + 1)
        return (splits, values), values[node - first]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._bin(x), np.full(len(x), self.base)
        for splits, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.fit.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = node == k
                    s = splits[k]
                    node[rows] = 2 * k + 1 + (binned[rows, s[0]] > s[1] if s else 0)
            out += values[node - (2**self.fit.depth - 1)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: places and non-decreasing values between which scores are interpolated."""
    order = np.argsort(raw, kind="stable")
    places, inverse = np.unique(raw[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, y[order]) / weight
    blocks: list[list[float]] = []
    for p, v, w in zip(places, value, weight, strict=True):
        blocks.append([v, w, p, p])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, hi = blocks.pop()
            v1, w1, lo, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    return xs, np.array([x for b in blocks for x in (b[0], b[0])])


_readers: dict[tuple, _Kinds] = {}


class Model:
    """Each row of the sample has the features that the lexicon of the other ``folds`` gives it. The trees that score are fitted
    to all rows; the calibration is fitted to scores that each row gets from trees of the other folds."""

    def __init__(self, texts: list[str], y: np.ndarray, fit: Fit):
        self.share = float(y.mean()) if len(y) else 0.0
        self.lexicon = learned_lexicon(texts, y)
        fold = np.arange(len(y)) % fit.folds
        x, raw = np.zeros((len(y), len(FEATURES))), np.zeros(len(y))
        for f in range(fit.folds):
            known = _Kinds(learned_lexicon([t for t, own in zip(texts, fold, strict=True) if own != f], y[fold != f]))
            for i in np.flatnonzero(fold == f):
                x[i] = features(texts[i], known)
        self.trees = None
        if len(y) >= 10 and all(0 < y[fold != f].mean() < 1 for f in range(fit.folds)):
            self.trees = Boosted(fit).train(x, y)
            for f in range(fit.folds):
                raw[fold == f] = Boosted(fit).train(x[fold != f], y[fold != f]).raw(x[fold == f])
            self.xs, self.ys = isotonic(raw, y)

    def read(self, texts: list[str]) -> np.ndarray:
        key = tuple(self.lexicon.items())
        if key not in _readers:
            _readers.clear()
            _readers[key] = _Kinds(self.lexicon)
        return np.array([features(t, _readers[key]) for t in texts], float).reshape(-1, len(FEATURES))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        # A millionth of the uncalibrated odds keeps the order within the calibration's steps.
        return (np.interp(raw, self.xs, self.ys) + 1e-6 / (1 + np.exp(-raw))) / (1 + 1e-6)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Fits to labelled rows that aren't held out: of all of them, the ``fit.rows`` with the smallest hashes."""
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("__y"))
    chosen = chosen.withColumn("__hash", F.xxhash64("doc_id")).orderBy("__hash", "doc_id").limit(fit.rows)
    # The sample's size is the parameter's, so its ids are small enough to send to every task.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").where(F.length("text") <= fit.longest)

    got = rows.select("__hash", "text", "__y").orderBy("__hash", "text").limit(fit.rows).toArrow()
    return Model(got.column("text").to_pylist(), got.column("__y").to_numpy(), fit)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(model.read(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
