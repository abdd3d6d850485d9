"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret scans, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``documents`` as they came, and extra ones, in order. Stages meet through Parquet in the folder that
``spark.checkpoint.dir`` names; what a stage stages for itself is deleted when it ends. Each gives an empty table for one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, near_dup, packing, quality, secrets
from loomline.llm.common import mark, read_table, release, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go: null and empty texts, too. Null languages and sources are
    groups of their own; repeated rows stay or go together."""
    return quality.judge(docs).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays. Texts without
    words and rows with a null id stay; of rows that share an id, one."""
    return near_dup.drop_duplicates(docs, near_dup.Similarity(words=5, percent=80))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none, null and empty items are found nowhere."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark of their kind and ``n_chars`` follows; null and empty texts, and null ids, stay as they are."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 ids. A null or empty text is a piece of one id; repeated rows
    are packed as often as they occur."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express fitted estimates, tokenizers or alignment; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = mark()
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, keep=1)
    return docs
