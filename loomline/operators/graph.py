"""Connected components by alternating large and small stars, each round cut from its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import scratch
from loomline.operators.scratch import staged


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id in ``edges`` (``a, b``) that has a neighbour: the smallest id reachable.

    Edges with a null end and loops tie nothing; repeated edges count once; no edges give an empty result.
    """
    spark = edges.sparkSession
    now = staged(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("a is not null and b is not null and lo < hi").distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
    before = sign(now)
    while True:
        since = scratch.mark()
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour (or itself).
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.where("v > u").join(near, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct(), "large")
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        near = large.groupBy("hi").agg(F.min("lo").alias("m"))
        star = large.join(near, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")))).alias("e"))
        now = staged(star.select("e.*").where("lo < hi").distinct(), "edges")
        scratch.release(spark, since, keep=1)
        after = sign(now)
        if after == before:
            break
        before = after
    roots = now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("id"), "root")
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
