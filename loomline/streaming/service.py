"""The ingest service: micro-batches of detections become versions of tracklets, and identities are resolved every few batches.

A batch is one folder that a repeated batch overwrites, so a restart changes nothing. Tracklets that are pushed again get a newer
version; the latest counts. Nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.functions import expr

Resolve = Callable[[DataFrame], DataFrame]


def pooled(dets: DataFrame) -> DataFrame:
    """A row per track (``seq``): span, number of detections, the representative one (highest confidence, then lowest id) and
    the unit mean of its vectors. Repeated detections count once; a detection without a vector counts but for the mean."""
    d = dets.groupBy("seq", "det_id").agg(F.min(F.struct("camera", "video", "frame_idx", "abs_ms", "conf", "vec")).alias("d")).select("seq", "det_id", "d.*")
    t = d.groupBy("seq").agg(
        F.min("camera").alias("camera"), F.min("video").alias("video"), F.min("frame_idx").alias("frame0"), F.max("frame_idx").alias("frame1"),
        F.min("abs_ms").alias("t0"), F.max("abs_ms").alias("t1"), F.count("*").alias("n_dets"), F.min_by("det_id", F.struct(-F.col("conf"), "det_id")).alias("best_det"),
    )
    x = d.select("seq", F.posexplode("vec").alias("k", "x")).groupBy("seq", "k").agg(F.avg("x").alias("x"))
    v = x.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s")).select("seq", expr.unit(F.transform("s", lambda e: e["x"])).alias("vec"))
    return t.join(v, "seq", "left")


def _folder(path: str, kind: str) -> str:
    return f"{path.rstrip('/')}/{kind}"


def latest_tracklets(spark: SparkSession, path: str) -> DataFrame:
    """Of each track the version of the last batch that pushed it."""
    rows = spark.read.parquet(_folder(path, "tracklets"))
    own = [c for c in rows.columns if c not in ("seq", "batch")]
    return rows.groupBy("seq").agg(F.max_by(F.struct(*own), "batch").alias("r")).select("seq", "r.*")


def latest_identities(spark: SparkSession, path: str) -> DataFrame:
    """The last resolution, and tracks that came after it as identities of their own (``gid`` null)."""
    runs = spark.read.parquet(_folder(path, "identities"))
    last = runs.agg(F.max("run").alias("run"))
    now = runs.join(F.broadcast(last), "run", "left_semi").select("seq", "gid")
    return latest_tracklets(spark, path).select("seq").join(now, "seq", "left")


def ingest(stream: DataFrame, path: str, checkpoint: str, resolve: Resolve | None = None, every: int = 10, once: bool = False) -> StreamingQuery:
    """Starts the service over a stream of detections (``det_id, seq, camera, video, frame_idx, abs_ms, conf, vec``). After every
    ``every``-th batch ``resolve`` (tracklets to ``seq, gid``) runs over all tracklets; ``once`` stops when the input is used up."""

    def take(batch: DataFrame, number: int) -> None:
        pooled(batch).write.mode("overwrite").parquet(f"{_folder(path, 'tracklets')}/batch={number}")
        if resolve is not None and (number + 1) % every == 0:
            spark = batch.sparkSession
            resolve(latest_tracklets(spark, path)).select("seq", "gid").write.mode("overwrite").parquet(f"{_folder(path, 'identities')}/run={number}")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
