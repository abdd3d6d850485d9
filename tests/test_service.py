"""The ingest service over several micro-batches against one batch; versions, repeats and periodic resolution."""

from pyspark.sql import functions as F

import __spark_entry__
from loomline.plans.adapter import detections, tracklet_vectors, tracklets
from loomline.streaming import service

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_ingest_in_batches(spark, tmp_path):
    d = detections(spark, SF)
    v = tracklet_vectors(spark, SF, tracklets(d).select("seq")).select("seq", "vec")
    d = d.join(v, "seq").select("det_id", "seq", "camera", "video", "frame_idx", "abs_ms", "conf", "vec")
    for k in range(3):  # a track is pushed whole; the third batch repeats some of the first
        part = d.where(F.col("seq") % 2 == k) if k < 2 else d.where("seq % 2 = 0 and seq % 3 = 0")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    one = lambda t: t.select("seq", F.col("camera").alias("gid"))
    q = service.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", one, every=2, once=True)
    q.awaitTermination(120)
    columns = ("seq", "camera", "video", "frame0", "frame1", "t0", "t1", "n_dets", "best_det")
    got = service.latest_tracklets(spark, f"{tmp_path}/out")
    assert rows_of(got, *columns) == rows_of(service.pooled(d), *columns)
    assert got.where("vec is null").isEmpty()
    t = tracklets(d.withColumns({c: F.lit(1) for c in ("user_id", "day", "x1", "y1", "x2", "y2", "w", "h")}))
    assert rows_of(got, "seq", "n_dets", "t0", "t1") == rows_of(t, "seq", "n_dets", "t0", "t1")
    # The second batch resolved what had come by then; the third came after.
    ids = {r.seq: r.gid for r in service.latest_identities(spark, f"{tmp_path}/out").collect()}
    assert len(ids) == got.count() and any(ids.values())


def test_repeats_nulls_and_ties(spark):
    rows = [(1, 5, "c", "v", 3, 10, 0.5, [3.0, 4.0]), (1, 5, "c", "v", 3, 10, 0.5, [3.0, 4.0]), (2, 5, "c", "v", 4, 20, 0.5, None), (3, 6, "c", "v", 4, 20, 0.1, None)]
    df = spark.createDataFrame(rows, "det_id long, seq long, camera string, video string, frame_idx long, abs_ms long, conf double, vec array<double>")
    got = {r.seq: r for r in service.pooled(df).collect()}
    assert (got[5].n_dets, got[5].best_det, got[5].t0, got[5].t1) == (2, 1, 10, 20)
    assert [round(x, 6) for x in got[5].vec] == [0.6, 0.8] and got[6].vec is None
    assert service.pooled(df.limit(0)).count() == 0


def test_trail_and_admissions(spark):
    q = __spark_entry__.queries()
    log = q["T1_match_or_expand"](spark, SF)
    n = q["T4_admissions"](spark, SF).agg(F.sum("n")).first()[0]
    assert n == log.count()
    trail = q["T5_decision_trail"](spark, SF).collect()
    assert trail and all(0 <= r["rank"] < 6 for r in trail)
    assert all(r.candidate == r.gid and not r.veto for r in trail if r.decision_type == "match" and r["rank"] == max(x["rank"] for x in trail if x.seq == r.seq))


def test_visual_candidates(spark):
    why = {w for r in __spark_entry__.queries()["R11_weak_edges"](spark, SF).select("why").distinct().collect() for w in r.why.split(",")}
    assert why == {"tokens", "trajectory", "visual"}
