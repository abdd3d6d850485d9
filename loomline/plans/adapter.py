"""The engine's virtual tables over ``events`` and ``embeddings``, and the same tables as SQL for the oracle.

Keys are functions of their rows (``seq = user_id * 100000 + day``), so no table needs a global sort or counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import expr

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    ms, camera = epoch_ms(F.col("ts")), F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string"))
    day = F.floor(ms / DAY_MS)
    x1, y1 = F.col("event_id") * 37 % 1800, F.col("event_id") * 53 % 900
    w, h = 20 + F.col("user_id") % 60, 40 + F.col("event_id") % 120
    return e.select(
        F.col("event_id").alias("det_id"), "user_id", camera.alias("camera"), F.concat(F.lit("V"), (F.col("user_id") % 4).cast("string"), F.lit("_"), day.cast("string")).alias("video"),
        day.alias("day"), (F.col("user_id") * 100000 + day).alias("seq"), ms.alias("abs_ms"), (F.floor(ms / 60000) % 1440).alias("frame_idx"),
        x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"), w.alias("w"), h.alias("h"), (F.col("event_id") % 100 / 100.0).alias("conf"), "event_type",
    )


def _mean_in_order(value: str, order: str) -> Column:
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.aggregate(rows, F.lit(0.0), lambda total, x: total + x[value], lambda total: total / F.count(value))


def tracklets(dets: DataFrame) -> DataFrame:
    """One pass of partial aggregates: counts, spans, means, first and last box.

    ``conf`` is summed in order of ``det_id``, as one thread of the oracle does: a sum in order of arrival differs in its last bits, and
    then at the bounds of buckets and rules."""
    when = F.struct("abs_ms", "det_id")
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    box = F.struct(cx.alias("cx"), cy.alias("cy"), F.col("w").alias("w"), F.col("h").alias("h"))
    t = dets.groupBy("seq").agg(
        F.min("user_id").alias("user_id"), F.min("day").alias("day"), F.min("video").alias("video"), F.min("camera").alias("camera"), F.count("*").alias("n_dets"),
        F.min("frame_idx").alias("frame0"), F.max("frame_idx").alias("frame1"), F.min("abs_ms").alias("t0"), F.max("abs_ms").alias("t1"),
        F.avg(cx).alias("cx"), F.avg(cy).alias("cy"), F.avg("w").alias("w"), F.avg("h").alias("h"), _mean_in_order("conf", "det_id").alias("conf"),
        F.min_by(box, when).alias("first"), F.max_by(box, when).alias("last"),
    )
    ends = [F.col(f"{e}.{k}").cast("double").alias(f"{e}_{k}") for e in ("first", "last") for k in ("cx", "cy", "w", "h")]
    return t.select(*[c for c in t.columns if c not in ("first", "last")], *ends)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, grp`` and the vector as doubles."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 4).alias("grp"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


def tracklet_vectors(spark: SparkSession, sf_dir: str, tracks: DataFrame) -> DataFrame:
    """Tracks with a vector each, ``vec_id = seq mod number of vectors`` (an equi-join on it)."""
    v = vectors(spark, sf_dir)
    n = v.agg(F.count("*").alias("n_vec"))
    return tracks.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("seq") % F.col("n_vec")).drop("n_vec").join(v.drop("grp"), "vec_id")


def decisions(tracks: DataFrame) -> DataFrame:
    """A decision for each track, derived from its key: identity ``user_id mod 97``, kind by ``seq mod 10``."""
    k = F.col("seq") % 10
    return tracks.select(
        "seq", "camera", "video", "t0", "t1", "n_dets", (F.col("user_id") % 97).alias("gid"),
        F.when(k < 5, "match").when(k < 8, "expand").when(k < 9, "quarantine").otherwise("forced").alias("decision_type"), (k % 2 == 0).alias("admitted"),
    )


def merges(spark: SparkSession) -> DataFrame:
    """Identity k was merged into k div 2 at step 10 k, for k = 1 .. 96."""
    return spark.range(1, 97).select(F.col("id").alias("merge_id"), (F.col("id") * 10).alias("at_seq"), F.col("id").alias("old_gid"), F.floor(F.col("id") / 2).alias("new_gid"))


def weak_tokens(tracks: DataFrame) -> DataFrame:
    """``seq, tokens``: measures of a track as bucket names."""
    t = tracks.withColumns({"tall": F.col("h") / F.col("w"), "lasted": F.col("frame1") - F.col("frame0") + 1})
    names = {"height": "h", "aspect": "tall", "duration": "lasted", "conf": "conf"}
    return t.select("seq", F.array_sort(F.array(*[F.concat(F.lit(f"{k}:"), expr.bucket(F.col(c), k)) for k, c in names.items()], F.concat(F.lit("day:"), F.col("day").cast("string")))).alias("tokens"))


#: The same tables for the oracle, as common table expressions.
DET = """det AS (
  SELECT event_id AS det_id, user_id, 'C' || (user_id % 4) AS camera, 'V' || (user_id % 4) || '_' || (epoch_us(ts) // 86400000000) AS video,
         epoch_us(ts) // 86400000000 AS day, user_id * 100000 + epoch_us(ts) // 86400000000 AS seq, epoch_us(ts) // 1000 AS abs_ms,
         (epoch_us(ts) // 60000000) % 1440 AS frame_idx, event_id * 37 % 1800 AS x1, event_id * 53 % 900 AS y1,
         event_id * 37 % 1800 + 20 + user_id % 60 AS x2, event_id * 53 % 900 + 40 + event_id % 120 AS y2,
         20 + user_id % 60 AS w, 40 + event_id % 120 AS h, (event_id % 100)::DOUBLE / 100 AS conf, event_type FROM events)"""
TRK = f"""{DET}, trk AS (
  SELECT seq, min(user_id) AS user_id, min(day) AS day, min(video) AS video, min(camera) AS camera, count(*) AS n_dets,
         min(frame_idx) AS frame0, max(frame_idx) AS frame1, min(abs_ms) AS t0, max(abs_ms) AS t1, avg((x1 + x2) / 2) AS cx,
         avg((y1 + y2) / 2) AS cy, avg(w) AS w, avg(h) AS h, avg(conf) AS conf,
         first((x1 + x2) / 2 ORDER BY abs_ms, det_id) AS first_cx, first((y1 + y2) / 2 ORDER BY abs_ms, det_id) AS first_cy,
         first(w::DOUBLE ORDER BY abs_ms, det_id) AS first_w, first(h::DOUBLE ORDER BY abs_ms, det_id) AS first_h,
         last((x1 + x2) / 2 ORDER BY abs_ms, det_id) AS last_cx, last((y1 + y2) / 2 ORDER BY abs_ms, det_id) AS last_cy,
         last(w::DOUBLE ORDER BY abs_ms, det_id) AS last_w, last(h::DOUBLE ORDER BY abs_ms, det_id) AS last_h
  FROM det GROUP BY seq)"""
VEC = """vec AS (SELECT vec_id, vec_id % 4 AS grp, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings)"""
DEC = f"""{TRK}, dec AS (
  SELECT seq, camera, video, t0, t1, n_dets, user_id % 97 AS gid,
         CASE WHEN seq % 10 < 5 THEN 'match' WHEN seq % 10 < 8 THEN 'expand' WHEN seq % 10 < 9 THEN 'quarantine' ELSE 'forced' END AS decision_type,
         (seq % 10) % 2 = 0 AS admitted FROM trk)"""
MRG = """mrg AS (SELECT i AS merge_id, i * 10 AS at_seq, i AS old_gid, i // 2 AS new_gid FROM range(1, 97) t(i))"""
