"""Further queries: parsing and scalar functions, imports, rankings, partition edits, candidate scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.operators import joins
from loomline.plans.adapter import DEC, DET, TRK, VEC, decisions, detections, table, tracklet_vectors, tracklets, vectors
from loomline.plans.registry import query
from loomline.plans.relational import _IOU_SQL, _r, _tracks
from loomline.plans.vectors import _GT, _labelled


@query("P3_as_of_filter", f"WITH {DEC} SELECT seq, gid FROM dec WHERE CASE WHEN seq % 5 <> 0 THEN t0 END <= 1705500000000")
def as_of_filter(spark, sf):
    """A null start excludes the row."""
    return decisions(_tracks(spark, sf)).where(F.when(F.col("seq") % 5 != 0, F.col("t0")) <= 1705500000000).select("seq", "gid")


@query("P18_rule_grid", f"WITH {TRK} SELECT m AS least_dets, c AS least_conf, count(*) AS n FROM trk, (VALUES (1), (3), (5)) a(m), (VALUES (0.2::DOUBLE), (0.5)) b(c) WHERE n_dets >= m AND conf >= c GROUP BY m, c")
def rule_grid(spark, sf):
    """One scan for the whole grid."""
    rules = F.array(*[F.struct(F.lit(m).alias("least_dets"), F.lit(c).alias("least_conf")) for m in (1, 3, 5) for c in (0.2, 0.5)])
    t = _tracks(spark, sf).select("n_dets", "conf", F.explode(rules).alias("r")).select("n_dets", "conf", "r.*")
    return t.where("n_dets >= least_dets and conf >= least_conf").groupBy("least_dets", "least_conf").agg(F.count("*").alias("n"))


@query("S18_weak_label_import", "SELECT c_custkey, 'segment:' || lower(c_mktsegment) AS token, o_n IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS o_n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def weak_label_import(spark, sf):
    """Attributes by key; columns that name an identity are left out, and rows without a track are marked."""
    c = table(spark, sf, "customer")
    kept = [x for x in c.columns if not any(w in x for w in ("global_id", "identity", "gt_"))]
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("m")).distinct()
    return c.select(*kept).join(seen, "c_custkey", "left").select("c_custkey", F.concat(F.lit("segment:"), F.lower("c_mktsegment")).alias("token"), F.coalesce("m", F.lit(False)).alias("matched"))


@query("S26_alias_coalesce", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.score') AS DOUBLE), CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) AS score FROM events")
def alias_coalesce(spark, sf):
    """One field under several names in JSON rows."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.score").cast("double"), F.get_json_object("props", "$.k").cast("double"), F.lit(-1.0)).alias("score"))


@query("A5_span_extend", f"WITH {DEC} SELECT gid, sum(n_dets)::BIGINT AS n, min(t0) AS t0, max(t1) AS t1, count(DISTINCT camera) AS cameras FROM dec GROUP BY gid")
def span_extend(spark, sf):
    """Spans are a monoid: a stored aggregate and a new batch's aggregate add up to the aggregate of both."""
    d = decisions(_tracks(spark, sf))
    span = lambda df: df.groupBy("gid").agg(F.sum("n_dets").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.collect_set("camera").alias("c"))
    both = span(d.where("seq % 4 <> 0")).unionByName(span(d.where("seq % 4 = 0")))
    return both.groupBy("gid").agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.size(F.array_distinct(F.flatten(F.collect_list("c")))).cast("long").alias("cameras"))


@query("A23_component_stats", f"WITH {DEC} SELECT gid, count(*) AS tracks, sum(n_dets)::BIGINT AS dets, count(DISTINCT video) AS videos, count(DISTINCT camera) AS cameras, max(t1) - min(t0) AS span_ms FROM dec GROUP BY gid")
def component_stats(spark, sf):
    return decisions(_tracks(spark, sf)).groupBy("gid").agg(F.count("*").alias("tracks"), F.sum("n_dets").alias("dets"), F.count_distinct("video").alias("videos"), F.count_distinct("camera").alias("cameras"), (F.max("t1") - F.min("t0")).alias("span_ms"))


@query("A24_source_stats", f"WITH {DEC} SELECT video, count(*) AS tracks, count(DISTINCT gid) AS components, median(n_dets)::DOUBLE AS median_dets FROM dec GROUP BY video")
def source_stats(spark, sf):
    return decisions(_tracks(spark, sf)).groupBy("video").agg(F.count("*").alias("tracks"), F.count_distinct("gid").alias("components"), F.median("n_dets").alias("median_dets"))


@query("W1_first_last", f"WITH {DET} SELECT seq, max(x1) FILTER (WHERE f = 1) AS first_x, max(x1) FILTER (WHERE l = 1) AS last_x FROM (SELECT seq, x1, row_number() OVER (PARTITION BY seq ORDER BY abs_ms, det_id) AS f, row_number() OVER (PARTITION BY seq ORDER BY abs_ms DESC, det_id DESC) AS l FROM det) GROUP BY seq")
def first_last(spark, sf):
    at = F.struct("abs_ms", "det_id")
    return detections(spark, sf).groupBy("seq").agg(F.min_by("x1", at).alias("first_x"), F.max_by("x1", at).alias("last_x"))


@query("W3_rank_matrix", f"WITH {DEC}, n AS (SELECT camera, gid, count(*) AS n FROM dec GROUP BY camera, gid) SELECT camera, gid, row_number() OVER (PARTITION BY camera ORDER BY n DESC, gid) AS rank FROM n")
def rank_matrix(spark, sf):
    n = decisions(_tracks(spark, sf)).groupBy("camera", "gid").agg(F.count("*").alias("n"))
    return n.select("camera", "gid", F.row_number().over(Window.partitionBy("camera").orderBy(F.desc("n"), "gid")).cast("long").alias("rank"))


@query("W5_margin_to_other", f"WITH {DEC}, n AS (SELECT gid, video, count(*) AS n FROM dec GROUP BY gid, video), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n DESC, video) AS k FROM n) SELECT a.gid, a.video, a.n - coalesce(b.n, 0) AS margin FROM r a LEFT JOIN r b ON b.gid = a.gid AND b.k = 2 WHERE a.k = 1")
def margin_to_other(spark, sf):
    """The best target and its margin over the best other one, from the two largest of each source."""
    n = decisions(_tracks(spark, sf)).groupBy("gid", "video").agg(F.count("*").alias("n"))
    w = Window.partitionBy("gid").orderBy(F.desc("n"), "video")
    r = n.withColumns({"k": F.row_number().over(w), "second": F.lead("n").over(w)}).where("k = 1")
    return r.select("gid", "video", (F.col("n") - F.coalesce("second", F.lit(0))).alias("margin"))


@query("U1_concat_sources", f"WITH {DEC} SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM dec UNION ALL SELECT 'b' FROM dec WHERE admitted) GROUP BY source")
def concat_sources(spark, sf):
    d = decisions(_tracks(spark, sf))
    return d.select(F.lit("a").alias("source")).unionByName(d.where("admitted").select(F.lit("b").alias("source"))).groupBy("source").agg(F.count("*").alias("n"))


@query("F2_flat_metres", "SELECT s_suppkey, round(sqrt(pow(s_suppkey * 0.001 * 111320, 2) + pow(s_nationkey * 0.002 * 111320 * cos(radians(38.9209)), 2)), 3) AS m FROM supplier")
def flat_metres(spark, sf):
    lat, lon = F.col("s_suppkey") * 0.001, F.col("s_nationkey") * 0.002
    return table(spark, sf, "supplier").select("s_suppkey", _r(expr.flat_m(F.lit(0.0), F.lit(0.0), lat, lon), 3).alias("m"))


@query("F7_size_likeness", f"WITH {TRK} SELECT seq, round(exp(-(abs(ln(greatest(first_h, 1) / greatest(last_h, 1))) + 0.5 * abs(ln(greatest(first_w, 1) / greatest(last_w, 1))))), 6) AS likeness FROM trk")
def size_likeness(spark, sf):
    return _tracks(spark, sf).select("seq", _r(expr.size_likeness(F.col("first_h"), F.col("first_w"), F.col("last_h"), F.col("last_w"))).alias("likeness"))


_RGB = "SELECT event_id, (event_id * 97 % 256)::DOUBLE AS r, (event_id * 57 % 256)::DOUBLE AS g, (event_id * 31 % 256)::DOUBLE AS b FROM events"


@query("F12_colour_names", f"""WITH c AS ({_RGB}), m AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM c),
h AS (SELECT *, 60 * CASE WHEN mx = mn THEN 0 WHEN mx = r THEN (CASE WHEN g >= b THEN (g - b) / (mx - mn) ELSE 6 + (g - b) / (mx - mn) END) WHEN mx = g THEN 2 + (b - r) / (mx - mn) ELSE 4 + (r - g) / (mx - mn) END AS hue, mx / 255 AS v, CASE WHEN mx > 0 THEN (mx - mn) / mx ELSE 0 END AS s FROM m)
SELECT name, count(*) AS n FROM (SELECT CASE WHEN mx < 45 THEN 'black' WHEN mx > 220 AND mx - mn < 28 THEN 'white' WHEN mx - mn < 30 THEN 'gray' WHEN hue >= 20 AND hue < 50 AND v < 0.65 THEN 'brown' WHEN hue < 15 OR hue >= 345 THEN 'red'
 WHEN hue < 45 THEN 'orange' WHEN hue < 75 THEN 'yellow' WHEN hue < 165 THEN 'green' WHEN hue < 250 THEN 'blue' WHEN hue < 310 THEN 'purple' WHEN s < 0.55 OR v > 0.65 THEN 'pink' ELSE 'red' END AS name FROM h) GROUP BY name""")
def colour_names(spark, sf):
    c = table(spark, sf, "events").select(*[(F.col("event_id") * k % 256).alias(n) for n, k in (("r", 97), ("g", 57), ("b", 31))])
    return c.groupBy(expr.colour(F.col("r"), F.col("g"), F.col("b")).alias("name")).agg(F.count("*").alias("n"))


@query("F15_name_parts", f"WITH {DET} SELECT DISTINCT video, split_part(video, '_', 1) AS place, CAST(regexp_extract(video, '([0-9]+)$', 1) AS BIGINT) AS suffix, 'C' || substr(video, 2, 1) AS camera FROM det")
def name_parts(spark, sf):
    v = detections(spark, sf).select("video").distinct()
    return v.select("video", F.split_part("video", F.lit("_"), F.lit(1)).alias("place"), F.regexp_extract("video", "([0-9]+)$", 1).cast("long").alias("suffix"), F.concat(F.lit("C"), F.substring("video", 2, 1)).alias("camera"))


@query("F17_clock_parse", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT * 1000 AS ms FROM events")
def clock_parse(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))
    return e.select("event_id", expr.clock_ms(F.col("clock")).alias("ms"))


@query("F18_latest_version", "SELECT p_brand, max(p_size) AS latest FROM part GROUP BY p_brand")
def latest_version(spark, sf):
    """The latest file of a stem by its version's numbers, not by its text."""
    f = table(spark, sf, "part").select("p_brand", "p_size", F.concat("p_brand", F.lit("_v1."), F.col("p_size").cast("string")).alias("name"))
    return f.groupBy("p_brand").agg(F.max_by("p_size", expr.version_of(F.col("name"))).alias("latest"))


@query("F20_ridge_score", f"WITH {TRK} SELECT seq, round(least(greatest(0.4 + 0.3 * (coalesce(CASE WHEN n_dets > 1 THEN conf END, 0.5) - 0.5) / 0.25 + 0.1 * (n_dets - 3) / 2.0, 0.0 - 0.05), 1.0 + 0.05), 6) AS score FROM trk")
def ridge_score(spark, sf):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    values = F.array(F.when(F.col("n_dets") > 1, F.col("conf")), F.col("n_dets").cast("double"))
    return _tracks(spark, sf).select("seq", _r(expr.ridge(values, arr(0.5, 3.0), arr(0.5, 3.0), arr(0.25, 2.0), arr(0.3, 0.1), F.lit(0.4), F.lit(0.0), F.lit(1.0))).alias("score"))


@query("F21_preview_stats", f"WITH {DEC}, p AS (SELECT gid, n_dets FROM dec WHERE decision_type = 'match') SELECT gid, count(*) AS moved, round(avg(n_dets), 6) AS preview_mean_dets, min(n_dets) AS preview_min_dets, max(n_dets) AS preview_max_dets FROM p GROUP BY gid")
def preview_stats(spark, sf):
    """Statistics of the nested items of a proposal row, without exploding them."""
    p = decisions(_tracks(spark, sf)).where("decision_type = 'match'").groupBy("gid").agg(F.collect_list(F.struct("seq", "n_dets")).alias("items"))
    dets = F.transform("items", lambda x: x["n_dets"])
    return p.select("gid", F.size("items").cast("long").alias("moved"), _r(F.aggregate(dets, F.lit(0).cast("long"), lambda a, x: a + x) / F.size("items")).alias("preview_mean_dets"), F.array_min(dets).alias("preview_min_dets"), F.array_max(dets).alias("preview_max_dets"))


@query("J16_frames_with_truth", f"WITH {DET} SELECT a.det_id FROM det a WHERE a.det_id % 2 = 0 AND EXISTS (SELECT 1 FROM det b WHERE b.video = a.video AND b.frame_idx = a.frame_idx AND b.det_id % 2 = 1 AND {_IOU_SQL} >= 0.05)")
def frames_with_truth(spark, sf):
    d = detections(spark, sf).select("det_id", "video", "frame_idx", "x1", "y1", "x2", "y2")
    g = d.where("det_id % 2 = 1").select(F.col("video").alias("b_video"), F.col("frame_idx").alias("b_frame"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    near = expr.iou(expr.half_open("x1", "y1", "x2", "y2"), expr.half_open("b_x1", "b_y1", "b_x2", "b_y2")) >= 0.05
    return d.where("det_id % 2 = 0").join(g, (F.col("video") == F.col("b_video")) & (F.col("frame_idx") == F.col("b_frame")) & near, "left_semi").select("det_id")


@query("R5_time_bonus_edges", f"WITH {TRK}, {VEC}, t AS (SELECT seq, day, t0, t1, vec FROM trk JOIN vec ON vec_id = seq % (SELECT count(*) FROM vec)) SELECT i, j, score FROM (SELECT a.seq AS i, b.seq AS j, round(round(list_dot_product(a.vec, b.vec), 6) + 0.2 * exp(-greatest(0, b.t0 - a.t1, a.t0 - b.t1) / 3600000.0::DOUBLE), 6) AS score FROM t a JOIN t b ON a.day = b.day AND a.seq < b.seq) WHERE score >= 0.3")
def time_bonus_edges(spark, sf):
    """Appearance plus a bonus that decays with the gap, for tracks of one day, where that reaches 0.3: appearance 0.1 at least."""
    t = tracklet_vectors(spark, sf, _tracks(spark, sf).select("seq", "day", "t0", "t1")).select("seq", "day", "t0", "t1", "vec")
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("sim", pa.float64()), ("gap", pa.int64())])

    def near(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (x, i, a0, a1), (y, j, b0, b1) = ((joins._matrix(t.column("vec")), *(t.column(c).to_numpy() for c in ("seq", "t0", "t1"))) for t in (left, right))
        step = max(1, (1 << 18) // len(j))  # a batch of pairs at a time
        for s in range(0, len(i), step):
            sim = np.round(x[s : s + step] @ y.T, 6)
            ok = sim >= 0.1
            if same:
                ok &= i[s : s + step, None] < j
            u, v = np.nonzero(ok)
            sim, u = sim[u, v], u + s
            gap = np.maximum(np.maximum(b0[v] - a1[u], a0[u] - b1[v]), 0)
            yield pa.RecordBatch.from_arrays([np.minimum(i[u], j[v]), np.maximum(i[u], j[v]), sim, gap], schema=schema)

    p = joins.in_blocks(t, "day", near, "i long, j long, sim double, gap long")
    score = _r(F.col("sim") + 0.2 * F.exp(-F.col("gap") / F.lit(3600000.0)))
    return p.select("i", "j", score.alias("score")).where("score >= 0.3")


@query("R2_bank_affinity", f"WITH {VEC}, s AS (SELECT a.label AS i, b.label AS j, max(round(list_dot_product(a.vec, b.vec), 6)) AS sim FROM vec a JOIN vec b ON a.label < b.label GROUP BY 1, 2) SELECT i, j, sim FROM s")
def bank_affinity(spark, sf):
    """The best exemplar pair of two banks. Exemplars meet in blocks; each block pair keeps one row per bank pair."""
    v = vectors(spark, sf)
    best = joins.best_by_label(v.select(F.col("vec_id").alias("query"), F.col("vec").alias("q_vec")), v.select(F.col("vec_id").alias("item"), "label", F.col("vec").alias("i_vec")))
    both = best.withColumnRenamed("label", "j").join(v.select(F.col("vec_id").alias("query"), F.col("label").alias("i")), "query")
    return both.where("i < j").groupBy("i", "j").agg(F.max("sim").alias("sim"))


@query("R13_confidence", f"WITH {DEC}, e AS (SELECT a.gid AS ga, b.gid AS gb, (a.n_dets + b.n_dets)::BIGINT AS w FROM dec a JOIN dec b ON a.video = b.video AND a.seq < b.seq), x AS (SELECT ga AS gid, w, ga = gb AS own FROM e UNION ALL SELECT gb, w, ga = gb FROM e) SELECT gid, round(sum(w) FILTER (WHERE own) / sum(w), 6) AS confidence FROM x GROUP BY gid")
def confidence(spark, sf):
    """Of an identity's incident edge score (pairs of a video, by their detections), the part that stays inside it; from sums by
    video and identity, without the pairs."""
    g = decisions(_tracks(spark, sf)).groupBy("video", "gid").agg(F.count("*").alias("n"), F.sum("n_dets").alias("w"))
    v = g.groupBy("video").agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    own = 2 * (F.col("n") - 1) * F.col("w")
    cross = F.col("w") * (F.col("all_n") - F.col("n")) + F.col("n") * (F.col("all_w") - F.col("w"))
    s = g.join(v, "video").groupBy("gid").agg(F.sum(own).alias("own"), F.sum(own + cross).alias("all"), F.max("n").alias("most"))
    return s.where(F.col("all") > 0).select("gid", _r(F.when(F.col("most") > 1, F.col("own") / F.col("all"))).alias("confidence"))


@query("E15_state_policy", f"WITH {DEC} SELECT seq, CASE WHEN decision_type = 'forced' THEN seq WHEN decision_type = 'quarantine' THEN -1 WHEN admitted THEN gid ELSE gid + 100000 END AS gid FROM dec")
def state_policy(spark, sf):
    """What becomes of a track by its state: kept, its own identity, dropped or set aside."""
    kind = F.col("decision_type")
    return decisions(_tracks(spark, sf)).select("seq", F.when(kind == "forced", F.col("seq")).when(kind == "quarantine", F.lit(-1)).when(F.col("admitted"), F.col("gid")).otherwise(F.col("gid") + 100000).alias("gid"))


@query("E27_quarantine_outliers", f"WITH {_GT}, m AS (SELECT gid, avg(w) AS mean, count(*) AS n FROM lab GROUP BY gid), r AS (SELECT l.seq, l.gid, row_number() OVER (PARTITION BY l.gid ORDER BY abs(l.w - m.mean) DESC, l.seq) AS k, greatest(1, floor(m.n * 0.1)) AS most FROM lab l JOIN m USING (gid)) SELECT seq, CASE WHEN k <= most THEN seq ELSE gid END AS gid FROM r")
def quarantine_outliers(spark, sf):
    """The tenth of each identity that is farthest from its mean becomes identities of their own."""
    rows = _labelled(spark, sf)
    m = rows.groupBy("gid").agg(F.avg("w").alias("mean"), F.count("*").alias("n"))
    r = rows.join(m, "gid").withColumn("k", F.row_number().over(Window.partitionBy("gid").orderBy(F.abs(F.col("w") - F.col("mean")).desc(), "seq")))
    return r.select("seq", F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), F.col("seq")).otherwise(F.col("gid")).alias("gid"))


@query("E28_source_choice", f"WITH {DEC}, s AS (SELECT video, decision_type AS source, count(*) AS n, avg(n_dets) AS c FROM dec GROUP BY 1, 2) SELECT video, source FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, c DESC, source) AS k FROM s) WHERE k = 1")
def source_choice(spark, sf):
    s = decisions(_tracks(spark, sf)).groupBy("video", F.col("decision_type").alias("source")).agg(F.count("*").alias("n"), F.avg("n_dets").alias("c"))
    return s.groupBy("video").agg(F.min_by("source", F.struct(-F.col("n"), -F.col("c"), "source")).alias("source"))


@query("E29_replay_edits", f"WITH {DEC}, e AS (SELECT seq, gid + 500 AS new, seq % 3 AS step FROM dec WHERE seq % 7 = 0 UNION ALL SELECT seq, gid + 900, 5 FROM dec WHERE seq % 14 = 0), l AS (SELECT seq, arg_max(new, step) AS new FROM e GROUP BY seq) SELECT coalesce(l.new, d.gid) AS gid, count(*) AS n FROM dec d LEFT JOIN l USING (seq) GROUP BY 1")
def replay_edits(spark, sf):
    """Accepted edits in order of step over a base assignment: the last edit of a track is what holds."""
    d = decisions(_tracks(spark, sf)).select("seq", "gid")
    e = d.where("seq % 7 = 0").select("seq", (F.col("gid") + 500).alias("new"), (F.col("seq") % 3).alias("step"))
    e = e.unionByName(d.where("seq % 14 = 0").select("seq", (F.col("gid") + 900).alias("new"), F.lit(5).cast("long").alias("step")))
    last = e.groupBy("seq").agg(F.max_by("new", "step").alias("new"))
    return d.join(last, "seq", "left").groupBy(F.coalesce("new", "gid").alias("gid")).agg(F.count("*").alias("n"))


@query("V3_box_recall", f"WITH {DET}, b AS (SELECT g.det_id, max({_IOU_SQL.replace('a.', 'g.')}) AS iou FROM det g LEFT JOIN det b ON b.video = g.video AND b.frame_idx = g.frame_idx AND b.det_id % 2 = 0 WHERE g.det_id % 2 = 1 GROUP BY g.det_id) SELECT count(*) AS n, round(avg((coalesce(iou, 0) >= 0.05)::INT), 6) AS recall, round(avg(coalesce(iou, 0)), 6) AS mean_best FROM b")
def box_recall(spark, sf):
    d = detections(spark, sf).select("det_id", "video", "frame_idx", "x1", "y1", "x2", "y2")
    p = d.where("det_id % 2 = 0").select("video", "frame_idx", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    iou = expr.iou(expr.half_open("x1", "y1", "x2", "y2"), expr.half_open("b_x1", "b_y1", "b_x2", "b_y2"))
    best = d.where("det_id % 2 = 1").join(p, ["video", "frame_idx"], "left").groupBy("det_id").agg(F.coalesce(F.max(iou), F.lit(0.0)).alias("iou"))
    return best.agg(F.count("*").alias("n"), _r(F.avg((F.col("iou") >= 0.05).cast("int"))).alias("recall"), _r(F.avg("iou")).alias("mean_best"))


@query("V4_fragments", f"WITH {_GT} SELECT label, count(DISTINCT gid) AS fragments, count(*) AS tracks FROM lab GROUP BY label")
def fragments(spark, sf):
    return _labelled(spark, sf).groupBy("label").agg(F.count_distinct("gid").alias("fragments"), F.count("*").alias("tracks"))


@query("V5_identity_f1")
def identity_f1(spark, sf):
    """Identity F1 by the best one-to-one matching of components and labels. The matrix is components by labels, a report's size;
    it is summed first, and one group solves it."""
    import pandas as pd

    from loomline.operators import kernels

    n = _labelled(spark, sf).groupBy("gid", "label").agg(F.sum("w").alias("w"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot_table(index="gid", columns="label", values="w", fill_value=0).to_numpy(float)
        hit = sum(m[i, j] for i, j in kernels.best_assignment(-m))
        return pd.DataFrame({"matched": [hit], "idf1": [round(hit / m.sum(), 6)]})

    return n.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(solve, "matched double, idf1 double")


@query("X4_ensemble_score", f"WITH {DEC}, s AS (SELECT seq, [n_dets / 10.0::DOUBLE, (seq % 100) / 100.0::DOUBLE, (gid % 10) / 10.0::DOUBLE] AS m FROM dec) SELECT seq, round(list_median(m) - 0.5 * list_stddev_pop(m), 6) AS score FROM s")
def ensemble_score(spark, sf):
    """The median of several models' scores less half their spread."""
    d = decisions(_tracks(spark, sf))
    m = F.array(F.col("n_dets") / 10.0, F.col("seq") % 100 / 100.0, F.col("gid") % 10 / 10.0)
    d = d.select("seq", F.sort_array(m).alias("m"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("mean", total(F.col("m")) / 3)
    spread = F.sqrt(total(F.transform("m", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / 3)
    return d.select("seq", _r(F.element_at("m", 2) - 0.5 * spread).alias("score"))


@query("X9_one_target_per_source", f"WITH {DEC}, p AS (SELECT gid AS source, (gid * 7 + seq % 5) % 97 AS target, sum(n_dets)::BIGINT AS w FROM dec GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, target) AS k FROM p WHERE source <> target), o AS (SELECT source, target, w FROM r WHERE k = 1) SELECT source, target, w FROM o WHERE target NOT IN (SELECT source FROM o WHERE w >= 60)")
def one_target_per_source(spark, sf):
    """Each source's best target, without chains through targets that are strong sources themselves."""
    p = decisions(_tracks(spark, sf)).groupBy(F.col("gid").alias("source"), ((F.col("gid") * 7 + F.col("seq") % 5) % 97).alias("target")).agg(F.sum("n_dets").alias("w"))
    o = p.where("source <> target").groupBy("source").agg(F.max(F.struct("w", (-F.col("target")).alias("m"))).alias("b")).select("source", (-F.col("b.m")).alias("target"), "b.w")
    return o.join(o.where("w >= 60").select(F.col("source").alias("target")), "target", "left_anti").select("source", "target", "w")


@query("X11_side_effects", f"WITH {DEC}, p AS (SELECT gid, count(*) AS n, count(*) - count(DISTINCT video) AS same, max(t1) - min(t0) AS span FROM dec GROUP BY gid) SELECT gid, concat_ws(',', CASE WHEN same > 20 THEN 'same_video' END, CASE WHEN span > 2500000000 THEN 'long_span' END, CASE WHEN n < 30 THEN 'small' END) AS reasons, CASE WHEN same > 20 AND span > 2500000000 THEN 'reject' WHEN same > 20 OR n < 30 THEN 'review' ELSE 'accept' END AS advice FROM p")
def side_effects(spark, sf):
    p = decisions(_tracks(spark, sf)).groupBy("gid").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("video")).alias("same"), (F.max("t1") - F.min("t0")).alias("span"))
    same, long, few = F.col("same") > 20, F.col("span") > 2500000000, F.col("n") < 30
    why = F.array_compact(F.array(F.when(same, F.lit("same_video")), F.when(long, F.lit("long_span")), F.when(few, F.lit("small"))))
    return p.select("gid", F.array_join(why, ",").alias("reasons"), F.when(same & long, "reject").when(same | few, "review").otherwise("accept").alias("advice"))
