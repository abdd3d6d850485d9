"""Queries of the relational core: scans and upserts, projections and filters, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.operators import joins
from loomline.plans.adapter import DEC, DET, MRG, TRK, decisions, detections, epoch_ms, merges, table, tracklets, weak_tokens
from loomline.plans.registry import query


def _r(c, n: int = 6):
    return F.round(c, n)


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    return tracklets(detections(spark, sf))


# --- sources and sinks as table algebra -------------------------------------------------------------------------------


@query("S2_dataset_alias", "SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'B') THEN 'er_' || lower(c_mktsegment) ELSE lower(c_mktsegment) END AS db FROM customer")
def dataset_alias(spark, sf):
    c = table(spark, sf, "customer")
    low = F.lower("c_mktsegment")
    return c.select("c_custkey", F.when(F.startswith("c_mktsegment", F.lit("B")), F.concat(F.lit("er_"), low)).otherwise(low).alias("db"))


@query("S4_insert_ignore", f"WITH {DET} SELECT det_id, video FROM det WHERE det_id % 3 <> 0 UNION ALL SELECT det_id, video FROM det WHERE det_id % 2 = 0 AND det_id NOT IN (SELECT det_id FROM det WHERE det_id % 3 <> 0)")
def insert_ignore(spark, sf):
    """Rows already stored stay; of the new ones only unknown keys are added."""
    d = detections(spark, sf).select("det_id", "video")
    stored, new = d.where("det_id % 3 <> 0"), d.where("det_id % 2 = 0")
    return stored.unionByName(new.join(stored, "det_id", "left_anti"))


@query("S5_upsert_latest", f"WITH {DET} SELECT user_id, day, det_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY abs_ms DESC, det_id DESC) AS rn FROM det) WHERE rn = 1")
def upsert_latest(spark, sf):
    d = detections(spark, sf)
    last = F.max_by(F.struct("det_id", "conf"), F.struct("abs_ms", "det_id")).alias("row")
    return d.groupBy("user_id", "day").agg(last).select("user_id", "day", "row.det_id", "row.conf")


@query("S6_register_model", "SELECT event_type AS name, dense_rank() OVER (ORDER BY event_type) AS model_id FROM (SELECT DISTINCT event_type FROM events)")
def register_model(spark, sf):
    """Surrogate keys of a dimension by its natural key (the registry is small: a row per distinct key)."""
    names = table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    return names.select("name", F.dense_rank().over(Window.orderBy("name")).cast("long").alias("model_id"))


@query("S12_bundle_join", f"WITH {TRK} SELECT seq, e.vec_id, len(e.embedding)::BIGINT AS dim FROM trk JOIN embeddings e ON e.vec_id = seq % (SELECT count(*) FROM embeddings)")
def bundle_join(spark, sf):
    from loomline.plans.adapter import tracklet_vectors

    t = tracklet_vectors(spark, sf, _tracks(spark, sf).select("seq"))
    return t.select("seq", "vec_id", F.size("vec").cast("long").alias("dim"))


@query("S16_missing_vectors", f"WITH {TRK} SELECT seq FROM trk WHERE seq % 1000 NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0)")
def missing_vectors(spark, sf):
    have = table(spark, sf, "embeddings").where("vec_id % 7 <> 0").select("vec_id")
    return _tracks(spark, sf).select("seq", (F.col("seq") % 1000).alias("vec_id")).join(have, "vec_id", "left_anti").select("seq")


@query("S17_merge_shards", "SELECT vec_id, shard, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY shard DESC) AS rn FROM (SELECT vec_id, 0 AS shard, label::BIGINT AS label FROM embeddings UNION ALL SELECT vec_id, 1, label + 100 FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 2, label + 200 FROM embeddings WHERE vec_id % 5 = 0)) WHERE rn = 1")
def merge_shards(spark, sf):
    """A fallback and two shards; the later one wins."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    shards = [e.withColumn("shard", F.lit(0))]
    shards += [e.where(f"vec_id % {m} = 0").select("vec_id", (F.col("label") + 100 * k).alias("label"), F.lit(k).alias("shard")) for k, m in ((1, 2), (2, 5))]
    all_ = shards[0].unionByName(shards[1]).unionByName(shards[2])
    return all_.groupBy("vec_id").agg(F.max("shard").alias("shard"), F.max_by("label", "shard").alias("label"))


@query("S20_submission_rows", f"""WITH {DEC}
SELECT d.frame_idx AS frame, coalesce(CASE WHEN c.decision_type <> 'quarantine' THEN c.gid + 1 END, 0) AS id, greatest(d.x1 - 5, 0) AS x1, greatest(d.y1 - 5, 0) AS y1, d.x2, d.y2,
       sha256('[' || d.x1 || '.0, ' || d.y1 || '.0, ' || d.x2 || '.0, ' || d.y2 || '.0]') AS box_hash
FROM det d LEFT JOIN dec c ON c.seq = d.seq AND c.admitted""")
def submission_rows(spark, sf):
    d = detections(spark, sf)
    c = decisions(tracklets(d)).where("admitted").select("seq", F.when(F.col("decision_type") != "quarantine", F.col("gid") + 1).alias("id"))
    j = d.join(c, "seq", "left")
    zero = lambda x: F.greatest(F.col(x) - 5, F.lit(0))
    return j.select(F.col("frame_idx").alias("frame"), F.coalesce("id", F.lit(0)).alias("id"), zero("x1").alias("x1"), zero("y1").alias("y1"), "x2", "y2", expr.box_hash(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("box_hash"))


@query("S23_last_log_line", "SELECT regexp_extract(props, '\"([a-z_]+)\":', 1) AS key, max(event_id) AS line FROM events GROUP BY 1")
def last_log_line(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.regexp_extract("props", '"([a-z_]+)":', 1).alias("key"))
    return e.groupBy("key").agg(F.max("event_id").alias("line"))


@query("S24_best_history_row", "SELECT event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def best_history_row(spark, sf):
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id"))).alias("b")
    return table(spark, sf, "events").groupBy("event_type").agg(best).select("event_type", "b.event_id", _r("b.value").alias("value"))


# --- projections and filters -------------------------------------------------------------------------------------------


@query("P1_suffix_filter", f"WITH {TRK} SELECT DISTINCT video FROM trk WHERE video LIKE '%7'")
def suffix_filter(spark, sf):
    return detections(spark, sf).select("video").where(F.col("video").endswith("7")).distinct()


@query("P2_time_window", f"WITH {DET} SELECT det_id, abs_ms FROM det WHERE abs_ms BETWEEN 1705000000000 AND 1705086400000")
def time_window(spark, sf):
    t = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-11 19:06:40", "2024-01-12 19:06:40")]
    e = table(spark, sf, "events").where(F.col("ts").between(*t))  # on the stored column: it reaches the scan
    return e.select(F.col("event_id").alias("det_id"), epoch_ms(F.col("ts")).alias("abs_ms"))


@query("P4_exists_decision", f"WITH {DEC} SELECT DISTINCT camera FROM det d WHERE EXISTS (SELECT 1 FROM dec WHERE dec.seq = d.seq AND decision_type = 'forced')")
def exists_decision(spark, sf):
    d = detections(spark, sf)
    forced = decisions(tracklets(d)).where("decision_type = 'forced'").select("seq")
    return d.join(forced, "seq", "left_semi").select("camera").distinct()


@query("P6_admission_filter", f"""WITH {TRK}
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN n_dets < 2 THEN 'few_dets' WHEN conf < 0.3 THEN 'low_conf' WHEN w * h < q.cut THEN 'small_area' ELSE 'kept' END AS reason
  FROM trk JOIN (SELECT video, quantile_cont(w * h, 0.25) AS cut FROM trk GROUP BY video) q USING (video)) GROUP BY reason""")
def admission_filter(spark, sf):
    """Ordered drop reasons; the area cut is a quantile of the video."""
    t = _tracks(spark, sf).withColumn("area", F.col("w") * F.col("h"))
    cut = t.groupBy("video").agg(F.percentile("area", 0.25).alias("cut"))
    reason = F.when(F.col("n_dets") < 2, "few_dets").when(F.col("conf") < 0.3, "low_conf").when(F.col("area") < F.col("cut"), "small_area").otherwise("kept")
    return t.join(cut, "video").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("P7_anomalous_videos", f"""WITH {TRK}, v AS (SELECT video, avg(conf) AS c FROM trk GROUP BY video), m AS (SELECT median(c) AS med FROM v),
d AS (SELECT median(abs(c - med)) AS mad FROM v, m)
SELECT video, round(c, 6) AS conf FROM v, m, d WHERE c < med - 1.4826 * mad ORDER BY c, video LIMIT 10""")
def anomalous_videos(spark, sf):
    v = _tracks(spark, sf).groupBy("video").agg(F.avg("conf").alias("c"))
    med = v.agg(F.median("c").alias("med"))
    off = v.crossJoin(F.broadcast(med))
    mad = off.agg(F.median(F.abs(F.col("c") - F.col("med"))).alias("mad"))
    low = off.crossJoin(F.broadcast(mad)).where(F.col("c") < F.col("med") - 1.4826 * F.col("mad"))
    return low.orderBy("c", "video").limit(10).select("video", _r("c").alias("conf"))


@query("P8_detection_filter", f"WITH {DET} SELECT video, count(*) AS n FROM det WHERE conf >= greatest(0.2, CASE WHEN camera = 'C1' THEN 0.5 ELSE 0.0 END) AND w * h >= 2000 GROUP BY video")
def detection_filter(spark, sf):
    cut = F.greatest(F.lit(0.2), F.when(F.col("camera") == "C1", 0.5).otherwise(0.0))
    return detections(spark, sf).where((F.col("conf") >= cut) & (F.col("w") * F.col("h") >= 2000)).groupBy("video").agg(F.count("*").alias("n"))


@query("P9_density_policy", f"""WITH {DET}, s AS (SELECT video, count(*) AS n, count(*)::DOUBLE / count(DISTINCT frame_idx) AS density, quantile_cont(conf, [0.1, 0.25, 0.5]) AS q FROM det GROUP BY video)
SELECT d.video, count(*) AS kept FROM det d JOIN s USING (video) WHERE conf >= CASE WHEN n >= 90 THEN q[3] WHEN density > 1.02 THEN q[2] ELSE q[1] END GROUP BY d.video""")
def density_policy(spark, sf):
    d = detections(spark, sf).select("video", "frame_idx", "conf")
    s = d.groupBy("video").agg(F.count("*").alias("n"), (F.count("*") / F.count_distinct("frame_idx")).alias("density"), F.percentile("conf", F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5))).alias("q"))
    cut = F.when(F.col("n") >= 90, F.get("q", F.lit(2))).when(F.col("density") > 1.02, F.get("q", F.lit(1))).otherwise(F.get("q", F.lit(0)))
    return d.join(s.select("video", cut.alias("cut")), "video").where("conf >= cut").groupBy("video").agg(F.count("*").alias("kept"))


@query("P10_filter_grid", f"""WITH {DET} SELECT video, conf_cut, kept FROM (
SELECT *, row_number() OVER (PARTITION BY video ORDER BY abs(kept - 40), conf_cut) AS rn FROM (
SELECT video, c AS conf_cut, count(*) FILTER (WHERE conf >= c) AS kept FROM det, (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7)) t(c) GROUP BY video, c)) WHERE rn = 1""")
def filter_grid(spark, sf):
    cuts = [0.1, 0.3, 0.5, 0.7]
    d = detections(spark, sf).groupBy("video").agg(*[F.count_if(F.col("conf") >= c).alias(f"k{i}") for i, c in enumerate(cuts)])
    options = F.array(*[F.struct(F.abs(F.col(f"k{i}") - 40).alias("off"), F.lit(c).alias("conf_cut"), F.col(f"k{i}").alias("kept")) for i, c in enumerate(cuts)])
    return d.select("video", F.array_min(options).alias("o")).select("video", "o.conf_cut", "o.kept")


@query("P11_video_switch", f"WITH {DEC} SELECT seq, CASE WHEN right(video, 1) IN ('1', '3') THEN gid ELSE gid + 1000 END AS gid FROM dec")
def video_switch(spark, sf):
    """Two assignment tables and a policy that names the one to use for a video."""
    d = decisions(_tracks(spark, sf)).select("seq", "video", "gid")
    both = d.withColumn("source", F.lit("a")).unionByName(d.select("seq", "video", (F.col("gid") + 1000).alias("gid"), F.lit("b").alias("source")))
    policy = d.select("video").distinct().withColumn("source", F.when(F.right("video", F.lit(1)).isin("1", "3"), "a").otherwise("b"))
    return both.join(policy, ["video", "source"]).select("seq", "gid")


@query("P12_overlay", f"WITH {DEC} SELECT coalesce(s.seq, b.seq) AS seq, coalesce(s.gid + 5000, b.gid) AS gid FROM (SELECT * FROM dec WHERE seq % 2 = 0) b FULL JOIN (SELECT * FROM dec WHERE seq % 3 = 0) s ON s.seq = b.seq")
def overlay(spark, sf):
    d = decisions(_tracks(spark, sf)).select("seq", "gid")
    base, sparse = d.where("seq % 2 = 0"), d.where("seq % 3 = 0").select("seq", (F.col("gid") + 5000).alias("own"))
    return base.join(sparse, "seq", "full").select("seq", F.coalesce("own", "gid").alias("gid"))


@query("P13_box_augment", f"WITH {DET} SELECT det_id, s AS scale, greatest(x1 + dx, 0) AS x1, least((x1 + w * s + dx), 1920)::DOUBLE AS x2 FROM det, (VALUES (1.0::DOUBLE), (1.5)) a(s), (VALUES (-10), (0), (10)) b(dx)")
def box_augment(spark, sf):
    d = detections(spark, sf)
    d = d.withColumn("scale", F.explode(F.array(F.lit(1.0), F.lit(1.5)))).withColumn("dx", F.explode(F.array(F.lit(-10), F.lit(0), F.lit(10))))
    return d.select("det_id", "scale", F.greatest(F.col("x1") + F.col("dx"), F.lit(0)).alias("x1"), F.least(F.col("x1") + F.col("w") * F.col("scale") + F.col("dx"), F.lit(1920.0)).alias("x2"))


@query("P14_tiles", "SELECT r_regionkey::BIGINT AS region, x * 512 AS x, y * 384 AS y FROM region, range(0, 4) a(x), range(0, 3) b(y)")
def tiles(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("region"))
    step = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit((n - 1) * size), F.lit(size)))
    return r.withColumn("x", step(4, 512)).withColumn("y", step(3, 384)).select("region", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("P15_even_sample", f"WITH {DET} SELECT seq, det_id FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY abs_ms, det_id) - 1 AS k, count(*) OVER (PARTITION BY seq) AS n FROM det) WHERE n <= 3 OR k IN (0, (n - 1) // 2, n - 1)")
def even_sample(spark, sf):
    w = Window.partitionBy("seq")
    d = detections(spark, sf).withColumns({"k": F.row_number().over(w.orderBy("abs_ms", "det_id")) - 1, "n": F.count("*").over(w)})
    return d.where((F.col("n") <= 3) | F.col("k").isin(0) | (F.col("k") == F.floor((F.col("n") - 1) / 2)) | (F.col("k") == F.col("n") - 1)).select("seq", "det_id")


@query("P16_leakage_guard", f"WITH {DEC} SELECT seq, concat_ws(',', CASE WHEN seq % 4 = 0 THEN 'anchors' END, CASE WHEN seq % 6 = 0 THEN 'oracle' END) AS reasons FROM dec WHERE seq % 4 = 0 OR seq % 6 = 0")
def leakage_guard(spark, sf):
    d = _tracks(spark, sf).select("seq")
    why = F.array_compact(F.array(F.when(F.col("seq") % 4 == 0, F.lit("anchors")), F.when(F.col("seq") % 6 == 0, F.lit("oracle"))))
    return d.select("seq", why.alias("why")).where(F.size("why") > 0).select("seq", F.array_join("why", ",").alias("reasons"))


@query("P17_modulo_shard", f"WITH {TRK} SELECT seq, n_dets FROM trk WHERE seq % 8 = 3 ORDER BY n_dets DESC, seq LIMIT 50")
def modulo_shard(spark, sf):
    return _tracks(spark, sf).where(F.pmod("seq", F.lit(8)) == 3).orderBy(F.desc("n_dets"), "seq").limit(50).select("seq", "n_dets")


# --- joins -------------------------------------------------------------------------------------------------------------


@query("J1_assigned_detections", f"WITH {DEC} SELECT d.camera, c.gid, count(*) AS n FROM det d JOIN dec c USING (seq) GROUP BY d.camera, c.gid")
def assigned_detections(spark, sf):
    d = detections(spark, sf)
    return d.join(decisions(tracklets(d)).select("seq", "gid"), "seq").groupBy("camera", "gid").agg(F.count("*").alias("n"))


@query("J2_camera_dimension", f"WITH {DET} SELECT d.video, n.n_name AS place, count(*) AS n FROM det d LEFT JOIN nation n ON n.n_nationkey = d.user_id % 4 AND n.n_nationkey < 3 GROUP BY d.video, n.n_name")
def camera_dimension(spark, sf):
    """The dimension has a row per camera; the optimizer broadcasts it by its size."""
    n = table(spark, sf, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("place"))
    d = detections(spark, sf).select("video", (F.col("user_id") % 4).alias("k"))
    return d.join(n, "k", "left").groupBy("video", "place").agg(F.count("*").alias("n"))


@query("J4_on_clause_filter", f"WITH {DEC} SELECT t.seq, c.gid FROM trk t LEFT JOIN dec c ON c.seq = t.seq AND c.decision_type = 'match'")
def on_clause_filter(spark, sf):
    t = _tracks(spark, sf)
    return t.select("seq").join(decisions(t).where("decision_type = 'match'").select("seq", "gid"), "seq", "left")


@query("J5_parallel_array_update", f"WITH {DEC}, u AS (SELECT unnest([0, 1, 2, 3]) AS old, unnest([100, 101, 102, 103]) AS new) SELECT seq, coalesce(u.new, gid)::BIGINT AS gid FROM dec LEFT JOIN u ON u.old = gid")
def parallel_array_update(spark, sf):
    u = spark.range(1).select(F.explode(F.arrays_zip(F.array(*map(F.lit, range(4))).alias("old"), F.array(*map(F.lit, range(100, 104))).alias("new"))).alias("u")).select(F.col("u.old").cast("long").alias("gid"), F.col("u.new").cast("long").alias("new"))
    d = decisions(_tracks(spark, sf)).select("seq", "gid")
    return d.join(u, "gid", "left").select("seq", F.coalesce("new", "gid").alias("gid"))


_IOU_SQL = "coalesce((greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))::DOUBLE / nullif(a.w * a.h + b.w * b.h - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0), 0), 0)"


@query("J6_same_frame_iou", f"WITH {DET} SELECT a.det_id AS a, b.det_id AS b, round({_IOU_SQL}, 6) AS iou FROM det a JOIN det b ON a.video = b.video AND a.frame_idx = b.frame_idx AND a.det_id < b.det_id")
def same_frame_iou(spark, sf):
    d = detections(spark, sf).select("det_id", "video", "frame_idx", "x1", "y1", "x2", "y2")
    b = d.select(*[F.col(c).alias(f"b_{c}") if c not in ("video", "frame_idx") else F.col(c) for c in d.columns])
    j = d.join(b, ["video", "frame_idx"]).where("det_id < b_det_id")
    return j.select(F.col("det_id").alias("a"), F.col("b_det_id").alias("b"), _r(expr.iou(expr.half_open("x1", "y1", "x2", "y2"), expr.half_open("b_x1", "b_y1", "b_x2", "b_y2"))).alias("iou"))


@query("J7_forbidden_pairs", f"WITH {TRK} SELECT a.seq AS i, b.seq AS j FROM trk a JOIN trk b ON a.video = b.video AND a.camera = b.camera AND a.seq < b.seq AND a.frame0 <= b.frame1 AND b.frame0 <= a.frame1")
def forbidden_pairs(spark, sf):
    """Tracks that one stream shows at the same time: a range self-join, cut into buckets of two hours' frames."""
    t = _tracks(spark, sf).select("seq", "video", "camera", "frame0", "frame1")
    return joins.interval_pairs(t, ["video", "camera"], "frame0", "frame1", "seq", 120).select(F.col("a_seq").alias("i"), F.col("b_seq").alias("j"))


@query("J8_gap_pairs", f"WITH {TRK} SELECT a.seq AS i, b.seq AS j, b.frame0 - a.frame1 AS gap FROM trk a JOIN trk b ON a.video = b.video AND a.camera = b.camera AND a.seq <> b.seq AND b.frame0 - a.frame1 BETWEEN 1 AND 15")
def gap_pairs(spark, sf):
    t = _tracks(spark, sf).select("seq", "video", "camera", "frame0", "frame1")
    return joins.follows(t, ["video", "camera"], "frame0", "frame1", "seq", 15, 240).select(F.col("a_seq").alias("i"), F.col("b_seq").alias("j"), "gap")


@query("J9_time_support", f"WITH {TRK} SELECT a.seq AS i, b.seq AS j, round(exp(-greatest(0, b.t0 - a.t1, a.t0 - b.t1) / 60000.0::DOUBLE), 6) AS support FROM trk a JOIN trk b ON a.seq < b.seq AND a.day = b.day AND greatest(0, b.t0 - a.t1, a.t0 - b.t1) <= 60000")
def time_support(spark, sf):
    t = _tracks(spark, sf).select("seq", "day", "t0", "t1")
    p = joins.interval_pairs(t, ["day"], "t0", "t1", "seq", 600_000, 60_000)
    gap = expr.interval_gap(F.col("a_t0"), F.col("a_t1"), F.col("b_t0"), F.col("b_t1"))
    return p.select(F.col("a_seq").alias("i"), F.col("b_seq").alias("j"), _r(expr.decay(gap, 60000)).alias("support"))


@query("J10_last_seen_asof", f"""WITH {TRK} SELECT t.seq, max(d.abs_ms) AS seen_ms FROM trk t LEFT JOIN det d ON d.camera = 'C1' AND d.abs_ms <= t.t0 AND d.abs_ms >= t.t0 - 3600000 WHERE t.camera = 'C0' GROUP BY t.seq""")
def last_seen_asof(spark, sf):
    d = detections(spark, sf)
    left = tracklets(d).where("camera = 'C0'").select("seq", F.col("t0").alias("abs_ms"), F.lit("C1").alias("camera"))
    right = d.where("camera = 'C1'").select("camera", "abs_ms", "det_id")
    return joins.as_of(left, right, ["camera"], "abs_ms", "seq", ["det_id"], 3_600_000).select("seq", F.col("r_at").alias("seen_ms"))


@query("J11_neighbour_decisions", f"WITH {DEC} SELECT seq, lag(seq) OVER w AS previous, lead(seq) OVER w AS next FROM dec WINDOW w AS (PARTITION BY gid ORDER BY t0, seq)")
def neighbour_decisions(spark, sf):
    w = Window.partitionBy("gid").orderBy("t0", "seq")
    return decisions(_tracks(spark, sf)).select("seq", F.lag("seq").over(w).alias("previous"), F.lead("seq").over(w).alias("next"))


_TOK = """tok AS (SELECT seq, unnest([
  'aspect:' || CASE WHEN h / w < 1.7 THEN 'wide' WHEN h / w < 2.5 THEN 'body' WHEN h / w < 3.4 THEN 'tall' ELSE 'very_tall' END,
  'conf:' || CASE WHEN conf < 0.35 THEN 'low' WHEN conf < 0.55 THEN 'medium' WHEN conf < 0.75 THEN 'high' ELSE 'very_high' END, 'day:' || day,
  'duration:' || CASE WHEN frame1 - frame0 + 1 < 8 THEN 'very_short' WHEN frame1 - frame0 + 1 < 24 THEN 'short' WHEN frame1 - frame0 + 1 < 90 THEN 'medium' WHEN frame1 - frame0 + 1 < 240 THEN 'long' ELSE 'very_long' END,
  'height:' || CASE WHEN h < 80 THEN 'tiny' WHEN h < 150 THEN 'small' WHEN h < 260 THEN 'medium' WHEN h < 420 THEN 'large' ELSE 'xlarge' END]) AS token FROM trk)"""


@query("J13_token_pairs", f"WITH {TRK}, {_TOK}, rare AS (SELECT token FROM tok GROUP BY token HAVING count(*) >= 2 AND count(*) <= 0.05 * (SELECT count(*) FROM trk)), k AS (SELECT seq, token FROM tok SEMI JOIN rare USING (token)) SELECT a.seq AS i, b.seq AS j, count(*) AS n_shared FROM k a JOIN k b ON a.token = b.token AND a.seq < b.seq GROUP BY 1, 2 HAVING count(*) >= 2")
def token_pairs(spark, sf):
    return joins.token_pairs(weak_tokens(_tracks(spark, sf)), "seq", "tokens", 0.05, 2)


@query("J14_shared_frames", f"WITH {DET} SELECT a.seq AS i, b.seq AS j, count(*) AS shared, round(avg({_IOU_SQL}), 6) AS mean_iou, round(max({_IOU_SQL}), 6) AS max_iou FROM det a JOIN det b ON a.video = b.video AND a.frame_idx = b.frame_idx AND a.seq < b.seq GROUP BY a.seq, b.seq")
def shared_frames(spark, sf):
    d = detections(spark, sf).select("seq", "video", "frame_idx", "x1", "y1", "x2", "y2")
    b = d.select("video", "frame_idx", *[F.col(c).alias(f"b_{c}") for c in ("seq", "x1", "y1", "x2", "y2")])
    j = d.join(b, ["video", "frame_idx"]).where("seq < b_seq")
    iou = expr.iou(expr.half_open("x1", "y1", "x2", "y2"), expr.half_open("b_x1", "b_y1", "b_x2", "b_y2"))
    return j.groupBy(F.col("seq").alias("i"), F.col("b_seq").alias("j")).agg(F.count("*").alias("shared"), _r(F.avg(iou)).alias("mean_iou"), _r(F.max(iou)).alias("max_iou"))


@query("J15_best_match", f"""WITH {DET} SELECT p, g, iou FROM (SELECT a.det_id AS p, b.det_id AS g, round({_IOU_SQL}, 6) AS iou, row_number() OVER (PARTITION BY a.det_id ORDER BY round({_IOU_SQL}, 6) DESC, b.det_id) AS rn FROM det a JOIN det b ON a.video = b.video AND a.frame_idx = b.frame_idx AND a.det_id % 2 = 0 AND b.det_id % 2 = 1) WHERE rn = 1""")
def best_match(spark, sf):
    """Of a frame's labelled boxes (odd ids) the one that overlaps a prediction (even ids) most; ties by id."""
    d = detections(spark, sf).select("det_id", "video", "frame_idx", "x1", "y1", "x2", "y2")
    g = d.where("det_id % 2 = 1").select("video", "frame_idx", *[F.col(c).alias(f"b_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")])
    iou = _r(expr.iou(expr.half_open("x1", "y1", "x2", "y2"), expr.half_open("b_x1", "b_y1", "b_x2", "b_y2")))
    best = F.max(F.struct(iou.alias("iou"), (-F.col("b_det_id")).alias("m"))).alias("b")
    return d.where("det_id % 2 = 0").join(g, ["video", "frame_idx"]).groupBy(F.col("det_id").alias("p")).agg(best).select("p", (-F.col("b.m")).alias("g"), "b.iou")


@query("J18_align_sources", f"""WITH {DEC}, n AS (SELECT gid AS a, user_id % 50 AS b, count(*) AS n FROM dec JOIN trk USING (seq) GROUP BY 1, 2) SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM n) WHERE rn = 1""")
def align_sources(spark, sf):
    t = _tracks(spark, sf)
    n = decisions(t).join(t.select("seq", (F.col("user_id") % 50).alias("b")), "seq").groupBy(F.col("gid").alias("a"), "b").agg(F.count("*").alias("n"))
    return n.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("m"))).alias("x")).select("a", (-F.col("x.m")).alias("b"), "x.n")


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("A1_tracklet_stats", f"WITH {TRK} SELECT seq, n_dets, frame0, frame1, t0, t1, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h, round(conf, 6) AS conf FROM trk")
def tracklet_stats(spark, sf):
    return _tracks(spark, sf).select("seq", "n_dets", "frame0", "frame1", "t0", "t1", *[_r(c).alias(c) for c in ("cx", "cy", "w", "h", "conf")])


@query("A2_end_boxes", f"WITH {TRK} SELECT seq, first_cx, first_cy, last_cx, last_cy, first_w, last_h FROM trk")
def end_boxes(spark, sf):
    return _tracks(spark, sf).select("seq", "first_cx", "first_cy", "last_cx", "last_cy", "first_w", "last_h")


@query("A3_tracklet_build", f"""WITH {DET}, m AS (SELECT seq, event_type, count(*) AS n, row_number() OVER (PARTITION BY seq ORDER BY count(*) DESC, event_type) AS rn FROM det GROUP BY seq, event_type)
SELECT seq, count(*) AS n, median(w * h)::DOUBLE AS median_area, any_value(m.event_type) AS majority FROM det JOIN m USING (seq) WHERE rn = 1 GROUP BY seq""")
def tracklet_build(spark, sf):
    d = detections(spark, sf)
    kinds = d.groupBy("seq", "event_type").agg(F.count("*").alias("n")).groupBy("seq").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("majority"))
    return d.groupBy("seq").agg(F.count("*").alias("n"), F.median(F.col("w") * F.col("h")).alias("median_area")).join(kinds, "seq")


@query("A4_identity_span", f"WITH {DEC} SELECT gid, sum(n_dets)::BIGINT AS n, min(t0) AS t0, max(t1) AS t1, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras, max(seq) AS last_seq FROM dec WHERE decision_type <> 'forced' GROUP BY gid")
def identity_span(spark, sf):
    d = decisions(_tracks(spark, sf)).where("decision_type <> 'forced'")
    return d.groupBy("gid").agg(F.sum("n_dets").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"), F.max("seq").alias("last_seq"))


@query("A6_span_union", f"WITH RECURSIVE {DEC}, {MRG}, walk(gid, root) AS (SELECT old_gid, new_gid FROM mrg UNION ALL SELECT w.gid, m.new_gid FROM walk w JOIN mrg m ON m.old_gid = w.root), r AS (SELECT gid, min(root) AS root FROM walk GROUP BY gid) SELECT coalesce(r.root, d.gid) AS gid, sum(n_dets)::BIGINT AS n, min(t0) AS t0, max(t1) AS t1 FROM dec d LEFT JOIN r ON r.gid = d.gid GROUP BY 1")
def span_union(spark, sf):
    from loomline.operators import replay

    d = decisions(_tracks(spark, sf))
    roots = replay.canonical(merges(spark), None)
    return d.join(roots, "gid", "left").groupBy(F.coalesce("root", "gid").alias("gid")).agg(F.sum("n_dets").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))


@query("A7_decision_tallies", f"WITH {DEC} SELECT decision_type, admitted, count(*) AS n FROM dec GROUP BY decision_type, admitted")
def decision_tallies(spark, sf):
    return decisions(_tracks(spark, sf)).groupBy("decision_type", "admitted").agg(F.count("*").alias("n"))


@query("A7_decision_cube", f"WITH {DEC} SELECT decision_type, camera, count(*) AS n FROM dec GROUP BY CUBE (decision_type, camera)")
def decision_cube(spark, sf):
    """An extension: the tallies with all subtotals."""
    return decisions(_tracks(spark, sf)).cube("decision_type", "camera").agg(F.count("*").alias("n"))


@query("A8_counters", f"WITH {DEC} SELECT (SELECT count(*) FROM det) AS detections, (SELECT count(*) FROM trk) AS tracks, (SELECT count(DISTINCT gid) FROM dec) AS identities, (SELECT count(*) FROM (SELECT gid FROM dec GROUP BY gid HAVING count(DISTINCT camera) > 1)) AS cross_camera")
def counters(spark, sf):
    d = detections(spark, sf)
    t = tracklets(d)
    per = decisions(t).groupBy("gid").agg(F.count_distinct("camera").alias("c"))
    ids = per.agg(F.count("*").alias("identities"), F.count_if(F.col("c") > 1).alias("cross_camera"))
    return d.agg(F.count("*").alias("detections")).crossJoin(t.agg(F.count("*").alias("tracks"))).crossJoin(ids)


@query("A9_quantile_index", f"WITH {DET}, q AS (SELECT quantile_cont(abs_ms, [i / 200::DOUBLE for i in range(0, 201)]) AS q FROM det) SELECT i::BIGINT AS i, round(q[i + 1], 3)::DOUBLE AS ms FROM q, range(0, 201) t(i)")
def quantile_index(spark, sf):
    at = F.array(*[F.lit(i / 200) for i in range(201)])
    return detections(spark, sf).agg(F.percentile("abs_ms", at).alias("q")).select(F.posexplode("q").alias("i", "ms")).select(F.col("i").cast("long").alias("i"), _r("ms", 3).alias("ms"))


@query("A10_median_in_group", f"WITH {DET} SELECT video, median(conf) AS conf FROM det GROUP BY video")
def median_in_group(spark, sf):
    return detections(spark, sf).groupBy("video").agg(F.median("conf").alias("conf"))


@query("A11_distinct_counts", f"WITH {DEC} SELECT gid, count(DISTINCT seq) AS tracks, count(DISTINCT camera) AS cameras FROM dec GROUP BY gid")
def distinct_counts(spark, sf):
    return decisions(_tracks(spark, sf)).groupBy("gid").agg(F.count_distinct("seq").alias("tracks"), F.count_distinct("camera").alias("cameras"))


@query("A12_distinct_on", f"WITH {DET} SELECT DISTINCT ON (video) video, det_id, frame_idx FROM det ORDER BY video, frame_idx, det_id")
def distinct_on(spark, sf):
    first = F.min(F.struct("frame_idx", "det_id")).alias("f")
    return detections(spark, sf).groupBy("video").agg(first).select("video", "f.det_id", "f.frame_idx")


@query("A13_largest_group", f"WITH {DEC} SELECT gid, count(*) AS n FROM dec GROUP BY gid ORDER BY n DESC, gid LIMIT 1")
def largest_group(spark, sf):
    return decisions(_tracks(spark, sf)).groupBy("gid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gid").limit(1)


@query("A18_fragmentation", f"WITH {DEC}, p AS (SELECT gid, count(DISTINCT camera) AS c, count(*) AS n FROM dec GROUP BY gid) SELECT round(avg(c), 6) AS mean_cameras, round(avg((c >= 3)::INT), 6) AS share_3, round(avg((n = 1)::INT), 6) AS singles FROM p")
def fragmentation(spark, sf):
    p = decisions(_tracks(spark, sf)).groupBy("gid").agg(F.count_distinct("camera").alias("c"), F.count("*").alias("n"))
    return p.agg(_r(F.avg("c")).alias("mean_cameras"), _r(F.avg((F.col("c") >= 3).cast("int"))).alias("share_3"), _r(F.avg((F.col("n") == 1).cast("int"))).alias("singles"))


@query("A25_conf_grid", f"WITH {DET}, q AS (SELECT video, quantile_cont(conf, [0.1, 0.5, 0.9]) AS q FROM det GROUP BY video) SELECT video, round(q[1], 6) AS p10, round(q[2], 6) AS p50, round(q[3], 6) AS p90 FROM q")
def conf_grid(spark, sf):
    q = detections(spark, sf).groupBy("video").agg(F.percentile("conf", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("video", *[_r(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query("A26_concentration", f"WITH {DEC}, p AS (SELECT gid, count(*) AS n FROM dec GROUP BY gid) SELECT gid, n, round(sum(n) OVER (ORDER BY n DESC, gid) / (SELECT sum(n) FROM p), 6)::DOUBLE AS share FROM p")
def concentration(spark, sf):
    """A running share over identities; the window is over the identities' totals, not over rows."""
    p = decisions(_tracks(spark, sf)).groupBy("gid").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "gid").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("gid", "n", _r(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("A27_video_entropy", f"WITH {DEC}, p AS (SELECT gid, video, count(*) AS n FROM dec GROUP BY gid, video), s AS (SELECT *, n / sum(n) OVER (PARTITION BY gid) AS f FROM p) SELECT gid, round(-sum(f * ln(f)), 6) AS entropy, round(max(f), 6) AS dominant FROM s GROUP BY gid")
def video_entropy(spark, sf):
    p = decisions(_tracks(spark, sf)).groupBy("gid", "video").agg(F.count("*").alias("n"))
    f = p.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("gid")))
    return f.groupBy("gid").agg(_r(-F.sum(F.col("f") * F.log("f"))).alias("entropy"), _r(F.max("f")).alias("dominant"))


@query("A28_binned_recall", f"WITH {DET} SELECT least(w * h // 2000, 5) AS bin, count(*) AS n, round(avg((conf >= 0.5)::INT), 6) AS recall FROM det GROUP BY 1")
def binned_recall(spark, sf):
    b = F.least(F.floor(F.col("w") * F.col("h") / 2000), F.lit(5)).alias("bin")
    return detections(spark, sf).groupBy(b).agg(F.count("*").alias("n"), _r(F.avg((F.col("conf") >= 0.5).cast("int"))).alias("recall"))


# --- windows, sorting, sets ----------------------------------------------------------------------------------------------


@query("W4_rank_margin", f"WITH {DEC}, p AS (SELECT camera, gid, count(*) AS n FROM dec GROUP BY camera, gid), r AS (SELECT *, row_number() OVER w AS rn, n - lead(n) OVER w AS margin FROM p WINDOW w AS (PARTITION BY camera ORDER BY n DESC, gid)) SELECT camera, gid, n, margin FROM r WHERE rn = 1")
def rank_margin(spark, sf):
    p = decisions(_tracks(spark, sf)).groupBy("camera", "gid").agg(F.count("*").alias("n"))
    w = Window.partitionBy("camera").orderBy(F.desc("n"), "gid")
    return p.select("camera", "gid", "n", F.row_number().over(w).alias("rn"), (F.col("n") - F.lead("n").over(w)).alias("margin")).where("rn = 1").drop("rn")


@query("W6_rank_percent", f"WITH {DEC} SELECT seq, round(row_number() OVER w / count(*) OVER (PARTITION BY gid), 6) AS pct, t0 - lag(t1) OVER w AS gap FROM dec WINDOW w AS (PARTITION BY gid ORDER BY t0, seq)")
def rank_percent(spark, sf):
    p = Window.partitionBy("gid")
    w = p.orderBy("t0", "seq")
    return decisions(_tracks(spark, sf)).select("seq", _r(F.row_number().over(w) / F.count("*").over(p)).alias("pct"), (F.col("t0") - F.lag("t1").over(w)).alias("gap"))


@query("W8_round_robin", f"""WITH {TRK}, r AS (SELECT seq, row_number() OVER (ORDER BY n_dets DESC, seq) AS r0, row_number() OVER (ORDER BY conf DESC, seq) AS r1, row_number() OVER (ORDER BY w * h DESC, seq) AS r2 FROM trk)
SELECT seq FROM r ORDER BY least(r0, r1, r2), CASE WHEN r0 <= least(r1, r2) THEN 0 WHEN r1 <= r2 THEN 1 ELSE 2 END, seq LIMIT 60""")
def round_robin(spark, sf):
    """Best rows by several keys in turn. Only the first ``n`` of each key can be chosen, so each key is a top-n."""
    t, n = _tracks(spark, sf).select("seq", "n_dets", "conf", (F.col("w") * F.col("h")).alias("area")), 60
    out = None
    for k, c in enumerate(("n_dets", "conf", "area")):
        top = t.orderBy(F.desc(c), "seq").limit(n)
        top = top.select("seq", F.row_number().over(Window.orderBy(F.desc(c), "seq")).alias("rank"), F.lit(k).alias("key"))
        out = top if out is None else out.unionByName(top)
    return out.groupBy("seq").agg(F.min(F.struct("rank", "key")).alias("b")).orderBy("b", "seq").limit(n).select("seq")


@query("W9_family_caps", f"WITH {DEC} SELECT gid, seq FROM (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY n_dets DESC, seq) AS k FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n_dets DESC, seq) AS f FROM dec) WHERE f = 1) WHERE k <= 5")
def family_caps(spark, sf):
    order = (F.desc("n_dets"), F.col("seq"))
    d = decisions(_tracks(spark, sf)).withColumn("f", F.row_number().over(Window.partitionBy("gid").orderBy(*order))).where("f = 1")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("camera").orderBy(*order))).where("k <= 5").select("gid", "seq")


@query("W10_correlations", f"WITH {TRK}, r AS (SELECT *, rank() OVER (ORDER BY n_dets) + (count(*) OVER (PARTITION BY n_dets) - 1) / 2.0 AS ra, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2.0 AS rb FROM trk) SELECT round(corr(n_dets, conf), 6) AS pearson, round(corr(ra::DOUBLE, rb::DOUBLE), 6) AS spearman FROM r")
def correlations(spark, sf):
    """Average ranks come from counts per distinct value, so no window spans the rows."""
    t = _tracks(spark, sf).select("n_dets", "conf")

    def ranks(c: str) -> DataFrame:
        n = t.groupBy(c).agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return n.select(c, (below + 1 + (F.col("n") - 1) / 2.0).alias(f"rank_{c}"))

    r = t.join(ranks("n_dets"), "n_dets").join(ranks("conf"), "conf")
    return r.agg(_r(F.corr("n_dets", "conf")).alias("pearson"), _r(F.corr("rank_n_dets", "rank_conf")).alias("spearman"))


@query("W12_gap_fill", f"""WITH {DET}, n AS (SELECT seq, frame_idx, x1, lead(frame_idx) OVER w AS nf, lead(x1) OVER w AS nx FROM det WINDOW w AS (PARTITION BY seq ORDER BY frame_idx, det_id))
SELECT seq, f AS frame_idx, round(x1 + (nx - x1) * (f - frame_idx) / (nf - frame_idx)::DOUBLE, 6) AS x1 FROM n, range(0, 1440) t(f) WHERE nf - frame_idx BETWEEN 2 AND 30 AND f > frame_idx AND f < nf""")
def gap_fill(spark, sf):
    w = Window.partitionBy("seq").orderBy("frame_idx", "det_id")
    d = detections(spark, sf).select("seq", "frame_idx", "x1", F.lead("frame_idx").over(w).alias("nf"), F.lead("x1").over(w).alias("nx"))
    d = d.where((F.col("nf") - F.col("frame_idx")).between(2, 30)).withColumn("f", F.explode(F.sequence(F.col("frame_idx") + 1, F.col("nf") - 1)))
    at = (F.col("f") - F.col("frame_idx")) / (F.col("nf") - F.col("frame_idx"))
    return d.select("seq", F.col("f").alias("frame_idx"), _r(F.col("x1") + (F.col("nx") - F.col("x1")) * at).alias("x1"))


@query("O1_feed", f"WITH {DEC} SELECT seq, gid, t1 FROM dec ORDER BY t1 DESC, seq LIMIT 25")
def feed(spark, sf):
    return decisions(_tracks(spark, sf)).orderBy(F.desc("t1"), "seq").limit(25).select("seq", "gid", "t1")


@query("U3_card_list", f"WITH {DET} SELECT DISTINCT camera, split_part(video, '_', 2) AS card FROM det")
def card_list(spark, sf):
    return detections(spark, sf).select("camera", F.split_part("video", F.lit("_"), F.lit(2)).alias("card")).distinct()


@query("U5_canonical_walk", f"WITH RECURSIVE {MRG}, walk(gid, root) AS (SELECT old_gid, new_gid FROM mrg WHERE at_seq <= 500 UNION ALL SELECT w.gid, m.new_gid FROM walk w JOIN mrg m ON m.old_gid = w.root AND m.at_seq <= 500) SELECT gid, min(root) AS root FROM walk GROUP BY gid")
def canonical_walk(spark, sf):
    from loomline.operators import replay

    return replay.canonical(merges(spark), 500)


@query("U6_dedup_edges", f"WITH {TRK}, e AS (SELECT a.seq AS s, b.seq AS t, a.n_dets AS score FROM trk a JOIN trk b ON a.video = b.video AND a.camera = b.camera AND a.seq <> b.seq AND greatest(a.frame0, b.frame0) - least(a.frame1, b.frame1) <= 30) SELECT least(s, t) AS i, greatest(s, t) AS j, max(score) AS score FROM e GROUP BY 1, 2")
def dedup_edges(spark, sf):
    """Tracks of a stream that are at most 30 frames apart propose each other with their own scores; of either direction the best stays.
    A pair is found once, so both directions are in one row and nothing is grouped."""
    t = _tracks(spark, sf).select("seq", "video", "camera", "frame0", "frame1", "n_dets")
    p = joins.interval_pairs(t, ["video", "camera"], "frame0", "frame1", "seq", 240, 30)
    return p.select(F.col("a_seq").alias("i"), F.col("b_seq").alias("j"), F.greatest("a_n_dets", "b_n_dets").alias("score"))


@query("T20_state_as_of", f"WITH RECURSIVE {DEC}, {MRG}, walk(gid, root) AS (SELECT old_gid, new_gid FROM mrg WHERE at_seq <= 400 UNION ALL SELECT w.gid, m.new_gid FROM walk w JOIN mrg m ON m.old_gid = w.root AND m.at_seq <= 400), r AS (SELECT gid, min(root) AS root FROM walk GROUP BY gid) SELECT coalesce(r.root, d.gid) AS gid, count(*) AS tracks, min(t0) AS t0, max(t1) AS t1, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras FROM dec d LEFT JOIN r ON r.gid = d.gid WHERE d.t0 <= 1705500000000 GROUP BY 1")
def state_as_of(spark, sf):
    from loomline.operators import replay

    return replay.state(decisions(_tracks(spark, sf)), merges(spark), 1705500000000, 400)
