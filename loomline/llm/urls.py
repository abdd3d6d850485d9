"""URL filters: host-suffix and path-prefix expressions, matched to rules by short hash prefixes, then full digests.

A URL is expanded into one expression per rule shape: the host's last ``n`` labels, for each label count that rules
have, followed by the path's first ``m`` characters, for each path length that rules have. That is every expression
that can equal a rule. Each is joined to the rules on four bytes of its SHA-256 digest; the rules that share those
bytes are one bucket. The full digest then decides, and of the rules that fit the longest wins (then the longer host, then
``block``). There is one join for any number of shapes, which are read off the rule table with one aggregate. Each pair of
host and path is expanded once, however many URLs have it. The buckets are broadcast while the rules' text is small
(``BROADCAST_CHARS``); beyond, the same join shuffles and the optimizer splits hot hash prefixes.

Defined results: null URLs and those without ``://`` have an empty host and path and fit no rule; an empty rule table
fits nothing; repeated rows stay repeated; columns of the pages named ``host``, ``path``, ``rule`` or ``verdict`` give way to
the results'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import ascii_lower

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BROADCAST_CHARS = 8_000_000


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    names = ("verdict", "host", "path")
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(table.cast("array<struct<verdict:string,host:string,path:string>>")))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def match(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``."""
    rules = rules.select(
        F.lower("verdict").alias("verdict"), ascii_lower(F.col("host")).alias("host"), F.col("path").alias("path")
    ).where("host is not null and path is not null")
    bounds = rules.agg(
        F.collect_set(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.sum(F.length("host") + F.length("path")).alias("chars")
    ).first()
    labels, lengths = sorted(bounds["labels"]), sorted(bounds["lengths"])
    df = with_parts(pages, url)
    if not labels:
        found = df.withColumn("__best", F.lit(None).cast("struct<length:int,host_length:int,verdict:string,rule:string>"))
    else:
        buckets = (
            rules.withColumn("digest", _digest(F.concat("host", F.lit("\x00"), "path")))
            .groupBy(F.substring("digest", 1, 8).alias("__prefix"))
            .agg(F.collect_list(F.struct("digest", "host", "path", "verdict")).alias("__rules"))
        )
        keys = df.where(F.length("host") > 0).select(F.col("host").alias("__host"), F.col("path").alias("__path")).distinct()
        n_labels, n_path = F.size(F.split("__host", "\\.")), F.length("__path")
        parts = F.split("__host", "\\.")
        suffixes = F.transform(F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= n_labels), lambda n: F.array_join(F.slice(parts, n_labels - n + 1, n), "."))
        prefixes = F.transform(F.filter(F.array(*[F.lit(m) for m in lengths]), lambda m: m <= n_path), lambda m: F.substring(F.col("__path"), F.lit(1), m))
        expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\x00"), p))))
        keys = keys.select("__host", "__path", F.explode(expressions).alias("__expression")).withColumn("__digest", _digest(F.col("__expression")))
        hits = keys.join(F.broadcast(buckets) if bounds["chars"] <= BROADCAST_CHARS else buckets, F.substring("__digest", 1, 8) == F.col("__prefix"))
        fits = F.transform(
            F.filter("__rules", lambda r: r["digest"] == F.col("__digest")),
            lambda r: F.struct(F.length(F.concat(r["host"], r["path"])).alias("length"), F.length(r["host"]).alias("host_length"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")),
        )
        best = hits.groupBy("__host", "__path").agg(F.max(F.array_max(fits)).alias("__best")).where("__best is not null")
        found = df.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return found.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        "host",
        "path",
        F.col("__best")["rule"].alias("rule"),
        F.coalesce(F.col("__best")["verdict"], F.lit(default)).alias("verdict"),
    )
