"""Helpers shared by the operators of this subpackage.

Conventions that hold for all of them:

* An operator selects the columns that it needs by name, so extra columns never clash with its own;
  operators that hand documents on keep every column they were given, in order. Working columns start with ``__``.
* A null text is an empty text, unless an operator's docstring says otherwise.
* Nothing is kept in a machine-local folder. What must be cut from its lineage is written as Parquet in the folder
  that ``spark.checkpoint.dir`` names and read again (:func:`staged`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.scratch import mark, release, staged, work_path  # noqa: F401  (the operators' way to them)

#: White space between words, as the text contracts define it: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
