"""Replay of an append-only decision log: canonical identities and the state as of a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(merges: DataFrame, at_seq: int | None) -> DataFrame:
    """``gid, root``: what merged identities have become by step ``at_seq``, by a recursive walk over merge events."""
    m = merges if at_seq is None else merges.where(F.col("at_seq") <= at_seq)
    spark = merges.sparkSession
    return spark.sql(
        """WITH RECURSIVE walk(gid, root) AS (
             SELECT old_gid, new_gid FROM {m}
             UNION ALL SELECT w.gid, m.new_gid FROM walk w JOIN {m} m ON m.old_gid = w.root)
           SELECT gid, min(root) AS root FROM walk GROUP BY gid""",
        m=m,
    )


def state(decisions: DataFrame, merges: DataFrame, at_ms: int, at_seq: int) -> DataFrame:
    """Identities as they stood: decisions that began by ``at_ms`` under the merges up to ``at_seq``."""
    roots = canonical(merges, at_seq)
    d = decisions.where(F.col("t0") <= at_ms).join(roots, "gid", "left")
    return d.groupBy(F.coalesce("root", "gid").alias("gid")).agg(
        F.count("*").alias("tracks"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras")
    )
