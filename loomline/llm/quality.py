"""Quality rules: base counts of every text, and robust multivariate outliers by language and source.

The estimate is a minimum covariance determinant (MCD): the location and scatter of the ``support`` share of documents whose
scatter has the smallest determinant. It is sought from three deterministic starts: medians and quartile ranges alone, the
same with the correlations of spatial signs, and with those of hyperbolic tangents. Each start takes two concentration
steps; the one with the smallest determinant goes on until its determinants fall no more (``steps`` at most, see below).

Everything is DataFrame expressions. A concentration step is one pass: documents are summed by group and distance bucket, so
what is shuffled is a row per group and bucket, whatever a group's size, and the buckets nearest the centre make up the new
support. A bucket is taken whole, so ties don't depend on order; the share that is really taken gives the factor that makes
the scatter of a trimmed normal sample consistent. The least determinant that a group has met is what counts, so a step that
buckets make worse does no harm, nor does an end by ``steps``.

Three estimates are made alike: for every language and source, every language, and all documents. A document's squared
distance is the mean of those by its group's estimate and by its language's (itself drawn towards that by all) with weights
of the group's size and ``prior``: large groups stand for themselves, the smallest follow their language, and there is no
size at which one gives way to the other. The distance by all is drawn towards 0 in the same way, so a handful of documents
rejects less than a corpus does. (Distances are averaged and not scatters, since one small group full of junk
would widen any mean of scatters.)

Defined results: null or empty text has no words and fails the base rule; null language or source is a group of its
own; repeated rows count as often as they occur; an empty table gives an empty result. Every document of a group in which one
passes the base rule gets a distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import SPACE, WORD_GAP, staged

SYMBOLS = "[#*$%&|<>]"

#: The transformed statistics and the least standard deviation that each is taken to have.
STATISTICS = {"word_length": 0.08, "symbols": 0.05, "dup_lines": 0.16, "repeats": 0.18, "capitals": 0.08}


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    support: float = 0.75  # share of a group that the estimate is fitted to
    steps: int = 10  # concentration steps at most; most groups need four or five
    cutoff: float = 36.0  # squared Mahalanobis distance beyond which a document is rejected; P(chi2_5 > 36) is about 1e-6
    prior: int = 40  # the documents that the wider estimate counts for: eight for each statistic


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds ``__n_words, __word_chars, __n_symbols, __n_dup_lines, __n_lines, __n_repeat_words, __n_capitals``."""
    gap = F.lit(SPACE)
    df = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("__trimmed", F.btrim("__text", gap))
    df = df.withColumn("__words", F.when(F.length("__trimmed") > 0, F.split("__trimmed", WORD_GAP)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, gap)) > 0))
    df = df.withColumns(
        {
            "__n_words": F.size("__words").cast("long"),
            "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "__n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
            "__n_lines": F.size("__lines").cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_capitals": (F.length("__text") - F.length(F.regexp_replace("__text", "[A-Z]+", ""))).cast("long"),
            "__grams": F.when(
                F.size("__words") > 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("__words") - 3),
                    lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
                ),
            ),
        }
    ).drop("__words", "__lines", "__trimmed")
    # Only texts with a window that comes twice need its places.
    df = df.withColumn(
        "__placed",
        F.when(
            F.size("__grams") > F.size(F.array_distinct("__grams")),
            F.sort_array(F.transform("__grams", lambda x, i: F.struct(x.alias("gram"), i.alias("at")))),
        ),
    ).drop("__grams")
    same = lambda e, i: F.coalesce(F.get("__placed", i)["gram"] == e["gram"], F.lit(False))
    df = df.withColumn(
        "__at",
        F.sort_array(F.transform(F.filter("__placed", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["at"])),
    ).drop("__placed")
    covered = F.aggregate(
        F.transform("__at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return df.withColumn("__n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__at", "__text")


def _vector() -> list[Column]:
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("__word_chars", "__n_words", "__n_lines"))
    return [
        F.log((F.col("__word_chars") + 1) / (F.col("__n_words") + 1)),
        F.sqrt(F.col("__n_symbols") / chars),
        F.sqrt(F.col("__n_dup_lines") / lines),
        F.sqrt(F.col("__n_repeat_words") / words),
        F.sqrt(F.col("__n_capitals") / chars),
    ]


def with_base(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """The counts, ``__base_failed``, the group's key ``__lang, __source`` and the statistics ``__z0..``."""
    words, repeats = F.col("__n_words"), F.col("__n_repeat_words")
    return with_counts(docs).withColumns(
        {
            "__base_failed": (words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * words),
            "__lang": F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")),
            "__source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")),
        }
        | {f"__z{i}": z for i, z in enumerate(_vector())}
    )


KEY = ["__scope", "__group"]  # all: "", ""; a language: it, ""; a group: language, source
D = len(STATISTICS)
FLOORS = list(STATISTICS.values())
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


@cache
def consistency() -> list[float]:
    """For the shares 0, 0.01, .. 1 of a normal sample nearest its centre, what their covariance must be multiplied by:
    a / P(chi2_7 <= q) where P(chi2_5 <= q) = a."""

    def chi2(x: float, k: int) -> float:  # odd degrees of freedom
        out, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for n in range(1, k, 2):
            out, term = out - term, term * x / (n + 2)
        return out

    def factor(share: float) -> float:
        lo, hi = 0.0, 100.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if chi2(mid, D) < share else (lo, mid)
        return share / chi2(hi, D + 2)

    return [factor(max(a, 1) / 100) for a in range(100)] + [1.0]


def _factor(share: Column) -> Column:
    table = F.array(*[F.lit(x) for x in consistency()])
    at = F.least(F.floor(share * 100), F.lit(99)).cast("int")
    return F.get(table, at) + (share * 100 - at) * (F.get(table, at + 1) - F.get(table, at))


def _summed(rows: DataFrame, by: list[str], sums: list[Column]) -> DataFrame:
    """Sums by a struct of ``by``: partial sums are dealt out by the whole of it. By its columns they would be dealt out by the
    group alone, as the windows that follow want it, and a group's from all tasks would meet in one."""
    out = rows.groupBy(F.struct(*by).alias("cell")).agg(*sums)
    return out.select("cell.*", *out.columns[1:])


def _start(fit: DataFrame) -> DataFrame:
    """``n``, medians ``m`` and squared quartile ranges ``c`` per group, on a grid of 1/64."""
    long = fit.select(*KEY, F.posexplode(F.array(*[F.floor(F.col(f"__z{i}") * 64) for i in range(D)])).alias("i", "bucket"))
    counts = _summed(long, [*KEY, "i", "bucket"], [F.count("*").alias("n")])
    w = Window.partitionBy(*KEY, "i")
    cum = counts.withColumns({"below": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})

    def at(q: float) -> Column:
        """Within its bucket, a quantile stands where its rank does."""
        inside = (q * F.col("all") - F.col("below") + F.col("n")) / F.col("n")
        return F.min(F.when(F.col("below") >= q * F.col("all"), F.col("bucket") + F.when(F.col("bucket") > 0, inside).otherwise(0.0))) / 64.0

    q = cum.groupBy(*KEY, "i").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"), F.max("all").alias("all"))
    one = lambda i, c: F.max(F.when(F.col("i") == i, c))
    sd = lambda i: F.greatest((F.col("hi") - F.col("lo")) / 1.349, F.lit(FLOORS[i]))
    return q.groupBy(*KEY).agg(
        F.lit(0).alias("start"),
        F.max("all").alias("n"),
        *[one(i, F.col("mid")).alias(f"m{i}") for i in range(D)],
        *[(F.lit(0.0) if i != j else one(i, sd(i) * sd(i))).alias(f"c{i}{j}") for i, j in PAIRS],
    )


def _starts(fit: DataFrame, first: DataFrame) -> DataFrame:
    """``first`` and, with its locations and scales, two starts that have correlations."""
    y = [(F.col(f"__z{i}") - F.col(f"m{i}")) / F.sqrt(F.col(f"c{i}{i}")) for i in range(D)]
    rows = fit.join(first.drop("start", "n"), KEY).select(*KEY, *[v.alias(f"y{i}") for i, v in enumerate(y)])
    rows = rows.withColumn("length", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, D)), F.col("y0") * F.col("y0")))
    t = [F.tanh(F.col(f"y{i}")) for i in range(D)]
    sums = rows.groupBy(*KEY).agg(
        F.count("*").alias("rows"),
        *[F.sum(F.when(F.col("length") > 0, F.col(f"y{i}") * F.col(f"y{j}") / F.col("length"))).alias(f"a{i}{j}") for i, j in PAIRS],
        *[F.avg(t[i]).alias(f"t{i}") for i in range(D)],
        *[F.avg(t[i] * t[j]).alias(f"b{i}{j}") for i, j in PAIRS],
    )
    out = first
    both = first.join(sums, KEY)
    signs = lambda i, j: F.col(f"a{i}{j}")
    tanhs = lambda i, j: F.col(f"b{i}{j}") - F.col(f"t{i}") * F.col(f"t{j}")
    for number, f in ((1, signs), (2, tanhs)):
        scale = lambda i, j, f=f: F.sqrt(f(i, i) * f(j, j))
        r = {(i, j): F.when(scale(i, j) > 1e-9, f(i, j) / scale(i, j)).otherwise(0.0) for i, j in PAIRS if i != j}
        c = [(F.col(f"c{i}{j}") if i == j else r[i, j] * F.sqrt(F.col(f"c{i}{i}") * F.col(f"c{j}{j}"))).alias(f"c{i}{j}") for i, j in PAIRS]
        out = out.unionByName(both.select(*KEY, F.lit(number).alias("start"), "n", *[f"m{i}" for i in range(D)], *c))
    return out


def _cholesky(params: DataFrame) -> DataFrame:
    """Adds the lower factor ``l`` of ``c``, column by column, and the logarithm of the determinant."""
    for j in range(D):
        rest = {}
        for i in range(j, D):
            x = F.col(f"c{i}{j}")
            for k in range(j):
                x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            rest[f"l{i}{j}"] = F.sqrt(F.greatest(x, F.lit(FLOORS[i] ** 2 / 4))) if i == j else x / F.col(f"l{j}{j}")
        params = params.withColumn(f"l{j}{j}", rest.pop(f"l{j}{j}")).withColumns(rest)
    return params.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00")))


def _distance(of: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    y: list[Column] = []
    for i in range(D):
        x = F.col(f"__z{i}") - F.col(f"{of}m{i}")
        for j in range(i):
            x = x - F.col(f"{of}l{i}{j}") * y[j]
        y.append(x / F.col(f"{of}l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _concentrate(fit: DataFrame, params: DataFrame, support: float) -> DataFrame:
    """One concentration step of every group and start."""
    z = [F.col(f"__z{i}") for i in range(D)]
    own = [*KEY, "start"]
    factors = params.select(*own, *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS])
    near = fit.join(factors, KEY).withColumn("bucket", F.floor(F.log(_distance() + 0.01) * 16))
    sums = _summed(near, [*own, "bucket"], [F.count("*").alias("n"), *[F.sum(z[i]).alias(f"s{i}") for i in range(D)], *[F.sum(z[i] * z[j]).alias(f"p{i}{j}") for i, j in PAIRS]])
    w = Window.partitionBy(*own)
    inner = sums.withColumns({"below": F.sum("n").over(w.orderBy("bucket")) - F.col("n"), "all": F.sum("n").over(w)}).where(F.col("below") < support * F.col("all"))
    total = inner.groupBy(*own).agg(F.max("all").alias("all"), *[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(D)], *[f"p{i}{j}" for i, j in PAIRS])])
    m = {i: F.col(f"s{i}") / F.col("n") for i in range(D)}
    # The floors keep a statistic that hardly varies from rejecting what is only unusual in its last digit.
    cov = {(i, j): (F.col(f"p{i}{j}") / F.col("n") - m[i] * m[j]) * _factor(F.col("n") / F.col("all")) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    return _cholesky(total.select(*own, F.col("all").alias("n"), *[v.alias(f"m{i}") for i, v in m.items()], *[v.alias(f"c{i}{j}") for (i, j), v in cov.items()]))


def _least(params: DataFrame, by: list[str]) -> DataFrame:
    """Of several estimates of a key, the one with the smallest determinant (of ties, the first start's)."""
    values = [c for c in params.columns if c not in (*by, "logdet", "start")]
    best = params.groupBy(*by).agg(F.min(F.struct("logdet", "start", *values)).alias("best"), F.max(F.when(F.col("start") < 0, F.col("logdet"))).alias("was"))
    return best.select(*by, "was", *[F.col("best")[c].alias(c) for c in ("logdet", "start", *values)])


def estimates(rows: DataFrame, rules: QualityRules) -> DataFrame:
    """``__lang, __source`` and the ``n``, locations ``m`` and Cholesky factors ``l`` of the group (``g_``), its language (``l_``) and all (``a_``)."""
    key = lambda scope, group: F.struct(scope.alias("__scope"), group.alias("__group"))
    keys = F.array(key(F.lit(""), F.lit("")), key(F.col("__lang"), F.lit("")), key(F.col("__lang"), F.col("__source")))
    fit = rows.where(~F.col("__base_failed")).select(F.explode(keys).alias("__key"), *[f"__z{i}" for i in range(D)]).select("__key.*", *[f"__z{i}" for i in range(D)])
    first = staged(_start(fit), "start")  # a row per group; small plans replan faster than one of thirty stages
    params = staged(_cholesky(_starts(fit, first)), "starts")
    params = staged(_concentrate(fit, params, rules.support), "step")
    best = staged(_least(_concentrate(fit, params, rules.support), KEY), "best")
    for _ in range(rules.steps - 2):
        known = best.drop("was").withColumn("start", F.lit(-1))
        best = staged(_least(known.unionByName(_concentrate(fit, known, rules.support).withColumn("start", F.lit(0))), KEY), "best")
        fell = best.agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        if not fell or fell < 1e-3:
            break
    values = ["n", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS]]
    named = lambda letter: [F.col(v).alias(f"{letter}_{v}") for v in values]
    groups = best.where("__group != ''").select(F.col("__scope").alias("__lang"), F.col("__group").alias("__source"), *named("g"))
    languages = best.where("__group = '' and __scope != ''").select(F.col("__scope").alias("__lang"), *named("l"))
    whole = best.where("__scope = ''").select(*named("a"))
    return groups.join(languages, "__lang").crossJoin(F.broadcast(whole))  # the last is one row


def _drawn(rules: QualityRules) -> Column:
    """The distance by the group's estimate, drawn towards the language's, this towards that of all, and this towards none."""
    drawn = lambda n, own, wider: (n * own + rules.prior * wider) / (n + rules.prior)
    return drawn(F.col("g_n"), _distance("g_"), drawn(F.col("l_n"), _distance("l_"), drawn(F.col("a_n"), _distance("a_"), F.lit(0.0))))


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all; ``text``, ``lang``, ``source`` among those given), the counts, ``__base_failed``, ``__distance`` and ``__kept``."""
    columns = docs.columns if columns is None else columns
    counts = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words"]
    rows = with_base(docs, rules).select(*[F.col(f"`{c}`") for c in columns], *counts, "__base_failed", "__lang", "__source", *[f"__z{i}" for i in range(D)])
    rows = staged(rows, "quality")
    found = staged(estimates(rows, rules), "estimates")
    judged = rows.join(found, ["__lang", "__source"], "left").withColumn("__distance", _drawn(rules))
    kept = ~F.col("__base_failed") & F.coalesce(F.col("__distance") <= rules.cutoff, F.lit(True))
    return judged.withColumn("__kept", kept).select(*[F.col(f"`{c}`") for c in columns], *counts, "__base_failed", "__distance", "__kept")
