"""Geodesy, keys and ids, overlap and retrieval measures, component edits by rules, proxies, projections and the frame score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import expr, geodesy
from loomline.operators import joins, kernels
from loomline.plans.adapter import DEC, DET, TRK, VEC, decisions, detections, table, tracklet_vectors, tracklets, vectors
from loomline.plans.registry import query
from loomline.plans.relational import _IOU_SQL, _r, _tracks
from loomline.plans.vectors import _GT, KNN, _labelled, knn


@query("P5_scorer_columns", f"WITH {DET} SELECT frame_idx AS frame, user_id AS id, x1, y1, x2, y2, event_type AS object_type FROM det")
def scorer_columns(spark, sf):
    return detections(spark, sf).select(F.col("frame_idx").alias("frame"), F.col("user_id").alias("id"), "x1", "y1", "x2", "y2", F.col("event_type").alias("object_type"))


@query("F3_geodesy", """WITH c AS (SELECT 1 - pow(1 - 1 / 298.257223563, 2) AS e), p AS (SELECT s_suppkey, radians(38 + s_suppkey * 0.01) AS la, radians(s_nationkey * 0.02 - 77) AS lo, (s_suppkey % 50)::DOUBLE AS alt, e, radians(38.92) AS la0, radians(-77.0) AS lo0 FROM supplier, c),
n AS (SELECT *, 6378137.0 / sqrt(1 - e * sin(la) * sin(la)) AS r, 6378137.0 / sqrt(1 - e * sin(la0) * sin(la0)) AS r0 FROM p),
x AS (SELECT *, (r + alt) * cos(la) * cos(lo) AS x, (r + alt) * cos(la) * sin(lo) AS y, (r * (1 - e) + alt) * sin(la) AS z, r0 * cos(la0) * cos(lo0) AS x0, r0 * cos(la0) * sin(lo0) AS y0, r0 * (1 - e) * sin(la0) AS z0 FROM n)
SELECT s_suppkey, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(-sin(lo0) * (x - x0) + cos(lo0) * (y - y0), 3) AS east,
round(-sin(la0) * cos(lo0) * (x - x0) - sin(la0) * sin(lo0) * (y - y0) + cos(la0) * (z - z0), 3) AS north, round(cos(la0) * cos(lo0) * (x - x0) + cos(la0) * sin(lo0) * (y - y0) + sin(la0) * (z - z0), 3) AS up FROM x""")
def geodetic(spark, sf):
    """Earth-centred coordinates of places, and east, north and up of them from one origin."""
    p = table(spark, sf, "supplier").select("s_suppkey", (38 + F.col("s_suppkey") * 0.01).alias("lat"), (F.col("s_nationkey") * 0.02 - 77).alias("lon"), (F.col("s_suppkey") % 50).cast("double").alias("alt"))
    here = geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    local = geodesy.to_enu(here, F.lit(38.92), F.lit(-77.0), F.lit(0.0))
    return p.select("s_suppkey", *[_r(c, 3).alias(n) for n, c in zip(("x", "y", "z", "east", "north", "up"), (*here, *local), strict=True)])


_KEY = "CASE seq % 3 WHEN 0 THEN video || ':' || user_id || ':' || day WHEN 1 THEN 'other:' || user_id || ':' || day ELSE 'plain' END"


@query("F16_local_track_key", f"WITH {TRK}, k AS (SELECT seq, video, {_KEY} AS key FROM trk) SELECT seq, CASE WHEN starts_with(key, video || ':') THEN video || ':' || split_part(substr(key, length(video) + 2), ':', 1) WHEN contains(key, ':') THEN video || ':' || list_extract(string_split(key, ':'), -2) END AS local_key FROM k")
def local_track_key(spark, sf):
    """A tracklet key's local track: the part after its video, else the last part but one; null where there is neither."""
    t = _tracks(spark, sf).select("seq", "video", F.expr("CASE seq % 3 WHEN 0 THEN concat(video, ':', user_id, ':', day) WHEN 1 THEN concat('other:', user_id, ':', day) ELSE 'plain' END").alias("key"))
    return t.select("seq", expr.local_track(F.col("video"), F.col("key")).alias("local_key"))


@query("F19_array_functions", f"WITH {DEC}, g AS (SELECT gid, list_sort(list(seq)) AS s, list_sort(list(DISTINCT camera)) AS c FROM dec GROUP BY gid) SELECT gid, array_to_string(s[1:6], ',') AS first_six, len(s)::BIGINT AS n, array_to_string(list_sort(list_distinct(list_concat(c, ['C0', 'C9']))), ',') AS cameras FROM g")
def array_functions(spark, sf):
    g = decisions(_tracks(spark, sf)).groupBy("gid").agg(F.sort_array(F.collect_list("seq")).alias("s"), F.collect_set("camera").alias("c"))
    union = F.array_sort(F.array_union("c", F.array(F.lit("C0"), F.lit("C9"))))
    return g.select("gid", F.array_join(F.slice("s", 1, 6), ",").alias("first_six"), F.size("s").cast("long").alias("n"), F.array_join(union, ",").alias("cameras"))


@query("F23_numeric_ids", """WITH k AS (SELECT DISTINCT CASE WHEN s_suppkey % 5 = 0 THEN 'none' || repeat('x', (s_suppkey % 7)::INT) ELSE chr(97 + (s_suppkey % 3)::INT) || '_' || (s_suppkey % 30) END AS key FROM supplier),
d AS (SELECT key, try_cast(nullif(regexp_extract(key, '([0-9]+)$', 1), '') AS BIGINT) AS digits FROM k), o AS (SELECT *, digits > 0 AND row_number() OVER (PARTITION BY digits ORDER BY key) = 1 AS own FROM d)
SELECT key, CASE WHEN coalesce(own, false) THEN digits ELSE (SELECT max(digits) FROM o) + row_number() OVER (PARTITION BY coalesce(own, false) ORDER BY key) END AS id FROM o""")
def numeric_ids(spark, sf):
    """Identity names as numbers: their last digits if no name before has them, else the next free number in order of names."""
    s = F.col("s_suppkey")
    key = F.when(s % 5 == 0, F.concat(F.lit("none"), F.repeat(F.lit("x"), (s % 7).cast("int")))).otherwise(F.concat(F.char(97 + s % 3), F.lit("_"), (s % 30).cast("string")))
    return expr.numeric_ids(table(spark, sf, "supplier").select(key.alias("key")).distinct(), "key")


@query("A10_median_overlap", f"WITH {DET} SELECT a.seq AS i, b.seq AS j, count(*) AS shared, round(median(round({_IOU_SQL}, 6)) + 1e-9, 6) AS median_iou FROM det a JOIN det b ON a.video = b.video AND a.frame_idx = b.frame_idx AND a.seq < b.seq GROUP BY a.seq, b.seq")
def median_overlap(spark, sf):
    d = detections(spark, sf).select("seq", "video", "frame_idx", "x1", "y1", "x2", "y2")
    b = d.select("video", "frame_idx", *[F.col(c).alias(f"b_{c}") for c in ("seq", "x1", "y1", "x2", "y2")])
    j = d.join(b, ["video", "frame_idx"]).where("seq < b_seq")
    iou = _r(expr.iou(expr.half_open("x1", "y1", "x2", "y2"), expr.half_open("b_x1", "b_y1", "b_x2", "b_y2")))
    return j.groupBy(F.col("seq").alias("i"), F.col("b_seq").alias("j")).agg(F.count("*").alias("shared"), _r(F.median(iou) + 1e-9).alias("median_iou"))


@query("W11_average_precision", f"WITH {KNN}, h AS (SELECT query, rank, (q_label = i_label)::INT AS hit, sum((q_label = i_label)::INT) OVER (PARTITION BY query ORDER BY rank) AS hits FROM knn) SELECT query, sum(hit)::BIGINT AS hits, round(coalesce(sum(hit * hits / rank::DOUBLE) / nullif(sum(hit), 0), 0), 6) AS ap, round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS reciprocal FROM h GROUP BY query")
def average_precision(spark, sf):
    v = vectors(spark, sf)
    label = lambda k: v.select(F.col("vec_id").alias(k), F.col("label").alias(f"{k}_label"))
    h = knn(v, 15).join(label("query"), "query").join(label("item"), "item").withColumn("hit", (F.col("query_label") == F.col("item_label")).cast("int"))
    h = h.withColumn("hits", F.sum("hit").over(Window.partitionBy("query").orderBy("rank")))
    ap = F.sum(F.col("hit") * F.col("hits") / F.col("rank").cast("double")) / F.nullif(F.sum("hit"), F.lit(0))
    return h.groupBy("query").agg(F.sum("hit").alias("hits"), _r(F.coalesce(ap, F.lit(0.0))).alias("ap"), _r(F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0))).alias("reciprocal"))


# --- component edits -------------------------------------------------------------------------------------------------------

_VIEWS = f"""{VEC}, own AS (SELECT vec_id, vec_id % 23 AS g, vec FROM vec), dims AS (SELECT g, k.k, avg(vec[k.k]) AS x FROM own, range(1, 65) k(k) GROUP BY 1, 2),
len AS (SELECT g, (k - 1) // 32 AS view, sqrt(sum(x * x)) + 1e-9 AS len FROM dims GROUP BY 1, 2),
s AS (SELECT a.g AS query, b.g AS item, (a.k - 1) // 32 AS view, sum(a.x * b.x) AS dot FROM dims a JOIN dims b ON a.k = b.k AND a.g <> b.g GROUP BY 1, 2, 3),
c AS (SELECT s.query, s.item, s.view, round(dot / (p.len * q.len) + 1e-12, 6) AS sim FROM s JOIN len p ON p.g = s.query AND p.view = s.view JOIN len q ON q.g = s.item AND q.view = s.view),
r AS (SELECT *, row_number() OVER (PARTITION BY query, view ORDER BY sim DESC, item) AS rank FROM c)"""


@query("E2_multiview_votes", f"WITH {_VIEWS} SELECT least(query, item) AS i, greatest(query, item) AS j, round(avg((rank <= 3)::INT), 6) AS vote, round(avg(sim) + 1e-12, 5) AS mean_sim, min(rank) AS best_rank FROM r GROUP BY 1, 2 HAVING avg((rank <= 3)::INT) >= 0.5")
def multiview_votes(spark, sf):
    """Pairs of components by the votes of two views of their centroids: how many of the views' rankings, from either side, hold
    the other among the first three."""
    d = vectors(spark, sf).select((F.col("vec_id") % 23).alias("g"), F.posexplode("vec").alias("k", "x")).groupBy("g", "k").agg(F.avg("x").alias("x")).withColumn("view", F.floor(F.col("k") / 32))
    length = d.groupBy("g", "view").agg((F.sqrt(F.sum(F.col("x") * F.col("x"))) + 1e-9).alias("len"))
    b = d.select("k", F.col("g").alias("item"), F.col("x").alias("y"))
    s = d.join(b, "k").where("g <> item").groupBy(F.col("g").alias("query"), "item", "view").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    side = lambda k, n: length.select(F.col("g").alias(k), "view", F.col("len").alias(n))
    c = s.join(side("query", "p"), ["query", "view"]).join(side("item", "q"), ["item", "view"]).withColumn("sim", _r(F.col("dot") / (F.col("p") * F.col("q")) + 1e-12))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("query", "view").orderBy(F.desc("sim"), "item")).cast("long"))
    vote = F.avg((F.col("rank") <= 3).cast("int"))
    return r.groupBy(F.least("query", "item").alias("i"), F.greatest("query", "item").alias("j")).agg(_r(vote).alias("vote"), _r(F.avg("sim") + 1e-12, 5).alias("mean_sim"), F.min("rank").alias("best_rank")).where("vote >= 0.5")


_BAR = "bar AS (SELECT a.gid, a.seq AS i, b.seq AS j FROM dec a JOIN dec b ON a.gid = b.gid AND a.video = b.video AND a.camera = b.camera AND a.seq < b.seq JOIN trk x ON x.seq = a.seq JOIN trk y ON y.seq = b.seq WHERE x.frame0 <= y.frame1 AND y.frame0 <= x.frame1)"


def _conflicts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Tracks with their identities, and the pairs of an identity that one stream shows at once."""
    t = _tracks(spark, sf)
    d = decisions(t).select("seq", "gid").join(t.select("seq", "video", "camera", "frame0", "frame1"), "seq")
    bars = joins.interval_pairs(d, ["gid", "video", "camera"], "frame0", "frame1", "seq", 120)
    return d, bars.select(F.col("a_gid").alias("gid"), F.col("a_seq").alias("i"), F.col("b_seq").alias("j"))


@query("E4_conflict_rates", f"WITH {DEC}, {_BAR}, e AS (SELECT gid, count(*) AS edges FROM bar GROUP BY gid), m AS (SELECT gid, count(DISTINCT s) AS nodes FROM (SELECT gid, i AS s FROM bar UNION ALL SELECT gid, j FROM bar) GROUP BY gid) SELECT d.gid, count(*) AS members, coalesce(any_value(nodes), 0) AS conflicted, round(coalesce(any_value(nodes), 0) / count(*), 6) AS node_share, round(coalesce(coalesce(any_value(edges), 0) * 2.0 / nullif(count(*) * (count(*) - 1), 0), 0), 6) AS density, coalesce(any_value(nodes), 0) * 10 <= count(*) AS clean FROM dec d LEFT JOIN e USING (gid) LEFT JOIN m USING (gid) GROUP BY d.gid")
def conflict_rates(spark, sf):
    """How much of a component is in conflict with itself: the share of its tracks, and of its pairs; clean up to a tenth of them."""
    d, bars = _conflicts(spark, sf)
    e = bars.groupBy("gid").agg(F.count("*").alias("edges"))
    m = bars.select("gid", F.explode(F.array("i", "j")).alias("s")).distinct().groupBy("gid").agg(F.count("*").alias("nodes"))
    g = d.groupBy("gid").agg(F.count("*").alias("members")).join(e, "gid", "left").join(m, "gid", "left").fillna(0, ["edges", "nodes"])
    pairs = F.nullif(F.col("members") * (F.col("members") - 1), F.lit(0))
    return g.select("gid", "members", F.col("nodes").alias("conflicted"), _r(F.col("nodes") / F.col("members")).alias("node_share"), _r(F.coalesce(F.col("edges") * 2.0 / pairs, F.lit(0.0))).alias("density"), (F.col("nodes") * 10 <= F.col("members")).alias("clean"))


@query("E5_soft_overlaps", f"WITH {DEC}, {_BAR}, f AS (SELECT a.seq AS i, b.seq AS j, avg({_IOU_SQL}) AS iou FROM det a JOIN det b ON a.video = b.video AND a.frame_idx = b.frame_idx AND a.seq < b.seq GROUP BY 1, 2) SELECT bar.i, bar.j, round(coalesce(f.iou, 0) + 1e-12, 6) AS mean_iou, coalesce(f.iou, 0) < 0.5 AS forbidden FROM bar LEFT JOIN f USING (i, j)")
def soft_overlaps(spark, sf):
    """A conflict whose boxes mostly coincide is a duplicate track and not forbidden."""
    _, bars = _conflicts(spark, sf)
    d = detections(spark, sf).select("seq", "video", "frame_idx", "x1", "y1", "x2", "y2")
    b = d.select("video", "frame_idx", *[F.col(c).alias(f"b_{c}") for c in ("seq", "x1", "y1", "x2", "y2")])
    iou = expr.iou(expr.half_open("x1", "y1", "x2", "y2"), expr.half_open("b_x1", "b_y1", "b_x2", "b_y2"))
    f = d.join(b, ["video", "frame_idx"]).where("seq < b_seq").groupBy(F.col("seq").alias("i"), F.col("b_seq").alias("j")).agg(F.avg(iou).alias("iou"))
    mean = F.coalesce("iou", F.lit(0.0))
    return bars.join(f, ["i", "j"], "left").select("i", "j", _r(mean + 1e-12).alias("mean_iou"), (mean < 0.5).alias("forbidden"))


@query("E6_teacher_consensus", f"WITH {DEC}, v AS (SELECT d.gid, t.user_id % 53 AS teacher, sum(d.n_dets)::BIGINT AS w FROM dec d JOIN trk t USING (seq) GROUP BY 1, 2), m AS (SELECT gid, teacher, w, sum(w) OVER (PARTITION BY gid)::BIGINT AS total FROM v QUALIFY row_number() OVER (PARTITION BY gid ORDER BY w DESC, teacher) = 1) SELECT a.gid AS i, b.gid AS j, a.teacher, round(least(a.w / a.total, b.w / b.total), 6) AS agreement FROM m a JOIN m b ON a.teacher = b.teacher AND a.gid < b.gid")
def teacher_consensus(spark, sf):
    """Components with one dominant teacher id, and the weaker side's share for it."""
    t = _tracks(spark, sf)
    v = decisions(t).select("seq", "gid", "n_dets").join(t.select("seq", (F.col("user_id") % 53).alias("teacher")), "seq").groupBy("gid", "teacher").agg(F.sum("n_dets").alias("w"))
    m = v.groupBy("gid").agg(F.min_by(F.struct("teacher", "w"), F.struct(-F.col("w"), "teacher")).alias("b"), F.sum("w").alias("total")).select("gid", "b.teacher", (F.col("b.w") / F.col("total")).alias("share"))
    b = m.select("teacher", F.col("gid").alias("j"), F.col("share").alias("b_share"))
    return m.join(b, "teacher").where("gid < j").select(F.col("gid").alias("i"), "j", "teacher", _r(F.least("share", "b_share")).alias("agreement"))


@query("E25_target_repair", f"WITH {_GT}, e AS (SELECT a.gid AS small, b.gid AS target, count(*) AS edges, avg(a.w + b.w) AS mean_w FROM lab a JOIN lab b ON a.label = b.label AND (a.seq + 1 = b.seq OR b.seq + 1 = a.seq) AND a.gid <> b.gid GROUP BY 1, 2), z AS (SELECT gid, count(*) AS n FROM lab GROUP BY gid), f AS (SELECT e.*, s.n AS sn, t.n AS tn FROM e JOIN z s ON s.gid = small JOIN z t ON t.gid = target WHERE t.n >= s.n AND mean_w BETWEEN 1 AND 50) SELECT small, target, edges FROM f QUALIFY row_number() OVER (PARTITION BY small ORDER BY edges DESC, round(mean_w, 9) DESC, target) = 1")
def target_repair(spark, sf):
    """Of candidate edges within ranges, each small component's best target: by edges, then weight; it is used once."""
    lab = _labelled(spark, sf).select("seq", "gid", "label", "w")
    near = lab.select(F.col("seq").alias("b_seq"), F.col("gid").alias("target"), "label", F.col("w").alias("b_w"))
    beside = lab.withColumn("b_seq", F.explode(F.array(F.col("seq") + 1, F.col("seq") - 1)))
    e = beside.join(near, ["b_seq", "label"]).where("gid <> target").groupBy(F.col("gid").alias("small"), "target").agg(F.count("*").alias("edges"), F.avg(F.col("w") + F.col("b_w")).alias("mean_w"))
    z = lab.groupBy("gid").agg(F.count("*").alias("n"))
    f = e.join(z.select(F.col("gid").alias("small"), F.col("n").alias("sn")), "small").join(z.select(F.col("gid").alias("target"), F.col("n").alias("tn")), "target").where("tn >= sn and mean_w between 1 and 50")
    best = F.min_by(F.struct("target", "edges"), F.struct(-F.col("edges"), -F.round("mean_w", 9), "target")).alias("b")
    return f.groupBy("small").agg(best).select("small", "b.target", "b.edges")


@query("R18_attach_by_votes", f"WITH {KNN}, v AS (SELECT query % 23 AS source, item % 23 AS target, count(*) AS support, max(sim) AS best FROM knn WHERE query % 23 <> item % 23 AND rank <= 5 GROUP BY 1, 2), r AS (SELECT *, best - lead(best) OVER w AS margin, row_number() OVER w AS k FROM v WHERE support >= 2 WINDOW w AS (PARTITION BY source ORDER BY best DESC, target)) SELECT source, target, support, best, round(coalesce(margin, best) + 1e-9, 6) AS margin FROM r WHERE k = 1 AND coalesce(margin, best) >= 0.005")
def attach_by_votes(spark, sf):
    """Each component's best target among those that two of its members' neighbours support, with a margin over the next."""
    k = knn(vectors(spark, sf), 5).select((F.col("query") % 23).alias("source"), (F.col("item") % 23).alias("target"), "sim").where("source <> target")
    v = k.groupBy("source", "target").agg(F.count("*").alias("support"), F.max("sim").alias("best")).where("support >= 2")
    w = Window.partitionBy("source").orderBy(F.desc("best"), "target")
    r = v.withColumns({"margin": F.coalesce(F.col("best") - F.lead("best").over(w), F.col("best")), "k": F.row_number().over(w)})
    return r.where("k = 1 and margin >= 0.005").select("source", "target", "support", "best", _r(F.col("margin") + 1e-9).alias("margin"))


@query("R19_decision_status", f"WITH {KNN}, e AS (SELECT query % 23 AS g, median(CASE WHEN query % 23 = item % 23 THEN sim END) AS inside, median(CASE WHEN query % 23 <> item % 23 THEN sim END) AS outside FROM knn GROUP BY 1) SELECT g, round(inside + 1e-9, 6) AS inside, round(outside + 1e-9, 6) AS outside, CASE WHEN inside IS NULL THEN 'forced' WHEN inside - outside >= 0.005 THEN 'committed' ELSE 'provisional' END AS status FROM e")
def decision_status(spark, sf):
    """Committed where a component's own evidence is above that of others, provisional where it isn't, forced without any."""
    own = F.col("query") % 23 == F.col("item") % 23
    e = knn(vectors(spark, sf), 15).groupBy((F.col("query") % 23).alias("g")).agg(F.median(F.when(own, F.col("sim"))).alias("inside"), F.median(F.when(~own, F.col("sim"))).alias("outside"))
    status = F.when(F.col("inside").isNull(), "forced").when(F.col("inside") - F.col("outside") >= 0.005, "committed").otherwise("provisional")
    return e.select("g", _r(F.col("inside") + 1e-9).alias("inside"), _r(F.col("outside") + 1e-9).alias("outside"), status.alias("status"))


@query("R24_pseudo_labels", f"WITH {DEC}, {VEC}, t AS (SELECT d.seq, t.day, d.gid AS p0, t.user_id % 31 AS p1, t.user_id % 53 AS p2, vec FROM dec d JOIN trk t USING (seq) JOIN vec ON vec_id = d.seq % (SELECT count(*) FROM vec)), p AS (SELECT a.seq AS i, b.seq AS j, (a.p0 = b.p0)::INT + (a.p1 = b.p1)::INT + (a.p2 = b.p2)::INT AS votes, round(list_dot_product(a.vec, b.vec), 6) AS sim FROM t a JOIN t b ON a.day = b.day AND a.seq < b.seq) SELECT i, j, sim, votes, CASE WHEN votes >= 1 THEN 1 ELSE 0 END AS label FROM p WHERE sim >= 0.25")
def pseudo_labels(spark, sf):
    """Strongly similar pairs of a day, positive where a base partition agrees and hard negatives where none does."""
    t = _tracks(spark, sf)
    b = decisions(t).select("seq", F.col("gid").alias("p0")).join(t.select("seq", "day", (F.col("user_id") % 31).alias("p1"), (F.col("user_id") % 53).alias("p2")), "seq")
    p = joins.near_pairs(tracklet_vectors(spark, sf, b.select("seq", "day")), "day", "seq", "vec", 0.25)
    side = lambda k, n: b.select(F.col("seq").alias(k), *[F.col(f"p{x}").alias(f"{n}{x}") for x in range(3)])
    p = p.join(side("i", "a"), "i").join(side("j", "b"), "j")
    votes = sum(((F.col(f"a{x}") == F.col(f"b{x}")).cast("int") for x in range(1, 3)), (F.col("a0") == F.col("b0")).cast("int"))
    return p.select("i", "j", "sim", votes.alias("votes"), F.when(votes >= 1, 1).otherwise(0).alias("label"))


# --- evaluation and scheduling ---------------------------------------------------------------------------------------------


@query("V9_missed_mass", f"WITH {_GT}, m AS (SELECT gid, label, sum(w)::BIGINT AS w FROM lab GROUP BY 1, 2), p AS (SELECT a.gid AS i, b.gid AS j, sum(a.w * b.w)::BIGINT AS mass FROM m a JOIN m b ON a.label = b.label AND a.gid < b.gid GROUP BY 1, 2) SELECT i % 10 AS family, sum(mass)::BIGINT AS missed, sum(mass) FILTER (WHERE (i + j) % 3 = 0)::BIGINT AS proposed, round(coalesce(sum(mass) FILTER (WHERE (i + j) % 3 = 0), 0) / sum(mass), 6) AS recall FROM p GROUP BY 1")
def missed_mass(spark, sf):
    """Of the pair mass that splits miss between components, what a candidate table proposes."""
    m = _labelled(spark, sf).groupBy("gid", "label").agg(F.sum("w").alias("w"))
    b = m.select("label", F.col("gid").alias("j"), F.col("w").alias("v"))
    p = m.join(b, "label").where("gid < j").groupBy(F.col("gid").alias("i"), "j").agg(F.sum(F.col("w") * F.col("v")).alias("mass"))
    hit = F.sum(F.when((F.col("i") + F.col("j")) % 3 == 0, F.col("mass")))
    return p.groupBy((F.col("i") % 10).alias("family")).agg(F.sum("mass").alias("missed"), hit.alias("proposed"), _r(F.coalesce(hit, F.lit(0)) / F.sum("mass")).alias("recall"))


@query("X10_counter_targets", f"WITH {DEC}, p AS (SELECT gid AS source, (gid * 7 + seq % 5) % 97 AS target, sum(n_dets)::BIGINT AS w, min(t0) AS t0, max(t1) AS t1 FROM dec GROUP BY 1, 2), r AS (SELECT *, row_number() OVER k AS rank, lead(target) OVER k AS opponent, lead(w) OVER k AS opponent_w, lead(t0) OVER k AS o0, lead(t1) OVER k AS o1 FROM p WINDOW k AS (PARTITION BY source ORDER BY w DESC, target)) SELECT source, target, opponent, w - coalesce(opponent_w, 0) AS lead, coalesce(t0 <= o1 AND o0 <= t1, false) AS at_once, round(coalesce(exp(-greatest(0, o0 - t1, t0 - o1) / 86400000.0::DOUBLE), 0), 6) AS support FROM r WHERE rank = 1")
def counter_targets(spark, sf):
    """Each source's best target and the one that runs against it, with the lead and how close in time the two are."""
    p = decisions(_tracks(spark, sf)).groupBy(F.col("gid").alias("source"), ((F.col("gid") * 7 + F.col("seq") % 5) % 97).alias("target")).agg(F.sum("n_dets").alias("w"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    k = Window.partitionBy("source").orderBy(F.desc("w"), "target")
    r = p.withColumns({"rank": F.row_number().over(k), **{n: F.lead(c).over(k) for n, c in (("opponent", "target"), ("opponent_w", "w"), ("o0", "t0"), ("o1", "t1"))}}).where("rank = 1")
    at_once = F.coalesce(expr.meets(F.col("t0"), F.col("t1"), F.col("o0"), F.col("o1")), F.lit(False))
    gap = F.when(F.col("o0").isNotNull(), expr.interval_gap(F.col("t0"), F.col("t1"), F.col("o0"), F.col("o1")))
    return r.select("source", "target", "opponent", (F.col("w") - F.coalesce("opponent_w", F.lit(0))).alias("lead"), at_once.alias("at_once"), _r(F.coalesce(F.exp(-gap / F.lit(86400000.0)), F.lit(0.0))).alias("support"))


@query("X12_rule_filters", f"WITH {DEC}, c AS (SELECT gid, count(*) AS n, avg((seq % 100) / 100.0::DOUBLE) AS vote, avg((seq % 7) / 7.0::DOUBLE) AS sim, count(DISTINCT video) AS videos FROM dec GROUP BY gid) SELECT gid, round(sim - 0.5 * vote, 6) AS directional, vote < 0.5 AND sim >= 0.4 AS low_vote_rescue, n <= 40 AND sim >= 0.4 AS small_fragment, round(greatest(0, 1 - videos / n::DOUBLE), 6) AS impurity_risk, videos <= 3 AS island FROM c")
def rule_filters(spark, sf):
    """Scalar scores and flags of candidates, for filters by rule."""
    c = decisions(_tracks(spark, sf)).groupBy("gid").agg(F.count("*").alias("n"), F.avg(F.col("seq") % 100 / 100.0).alias("vote"), F.avg(F.col("seq") % 7 / 7.0).alias("sim"), F.count_distinct("video").alias("videos"))
    vote, sim, n = F.col("vote"), F.col("sim"), F.col("n")
    return c.select("gid", _r(sim - 0.5 * vote).alias("directional"), ((vote < 0.5) & (sim >= 0.4)).alias("low_vote_rescue"), ((n <= 40) & (sim >= 0.4)).alias("small_fragment"), _r(F.greatest(F.lit(0.0), 1 - F.col("videos") / n.cast("double"))).alias("impurity_risk"), (F.col("videos") <= 3).alias("island"))


@query("S25_identity_counts", f"WITH {DEC} SELECT camera AS dataset, count(DISTINCT gid) AS identities, count(*) AS tracks, max(t1) AS last_ms FROM dec GROUP BY camera")
def identity_counts(spark, sf):
    return decisions(_tracks(spark, sf)).groupBy(F.col("camera").alias("dataset")).agg(F.count_distinct("gid").alias("identities"), F.count("*").alias("tracks"), F.max("t1").alias("last_ms"))


def ridge_fit(rows: DataFrame, features: list[str], target: str, penalty: float) -> dict[str, float]:
    """Ridge weights of standardised features (nulls take the median) and the intercept, from one pass of sums; what is solved on
    the driver is as large as the features are many."""
    fill = rows.agg(*[F.median(c).alias(c) for c in features]).first()
    x = [F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c] or 0))) for c in features] + [F.col(target).cast("double")]
    rows = rows.where(F.col(target).isNotNull())
    n = len(x)
    s = rows.agg(F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(n)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(n) for j in range(i + 1)]).first()
    if not s["n"]:
        return dict.fromkeys([*features, "intercept"], 0.0)
    mean = np.array([s[f"s{i}"] for i in range(n)]) / s["n"]
    cov = np.array([[s[f"p{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)]) / s["n"] - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd[sd < 1e-12] = 1.0
    k = n - 1
    w = np.linalg.solve(cov[:k, :k] / np.outer(sd[:k], sd[:k]) + penalty / s["n"] * np.eye(k), cov[:k, k] / sd[:k])
    return {**dict(zip(features, w.tolist(), strict=True)), "intercept": float(mean[k])}


@query("X1_ridge_proxy")
def ridge_proxy(spark, sf):
    """A proxy of the mean confidence from a track's size and shape."""
    w = ridge_fit(_tracks(spark, sf).select("n_dets", "w", "h", (F.col("frame1") - F.col("frame0")).alias("lasted"), "conf"), ["n_dets", "w", "h", "lasted"], "conf", 1.0)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in w.items()], "feature string, weight double")


def principal_axes(v: DataFrame, column: str, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the first axes of vectors: second moments are summed batch by batch, so the driver gets a matrix of their
    length. Axes point to where their largest component is positive."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                full = np.concatenate([x.sum(axis=0), (x.T @ x).ravel(), [len(x)]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(full))), pa.array(full)], names=["at", "value"])

    sums = v.where(F.col(column).isNotNull()).select(column).mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toPandas().value.to_numpy()
    dim = int(round((-1 + (4 * len(sums) - 3) ** 0.5) / 2))
    count = sums[-1]
    mean = sums[:dim] / count
    _, axes = np.linalg.eigh(sums[dim:-1].reshape(dim, dim) / count - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :n].T
    return mean, axes * np.sign(axes[np.arange(n), np.abs(axes).argmax(axis=1)])[:, None]


@query("F24_projection")
def projection(spark, sf):
    """Vectors on their two principal axes."""
    v = vectors(spark, sf).select("vec_id", "label", "vec")
    mean, axes = principal_axes(v, "vec")
    on = lambda a: _r(expr.dot(F.col("vec"), F.array(*map(F.lit, a.tolist()))) - float(mean @ a), 5)
    return v.select("vec_id", "label", on(axes[0]).alias("x"), on(axes[1]).alias("y"))


ALPHAS = [round(0.05 * k, 2) for k in range(1, 20)]


def frame_score(truth: DataFrame, found: DataFrame, dense: bool = False) -> DataFrame:
    """HOTA, DetA, AssA, IDF1, DetRe and DetPr, means over overlap thresholds from 0.05 to 0.95, for boxes ``video, frame, id,
    x1, y1, x2, y2`` of truth and of what was found. Ids are matched one to one over the whole table, by the overlap that they
    share; a box counts as found where its id's partner overlaps it enough. Unless the truth is dense, found ids without a
    partner don't count against precision (``unmatched``).

    Boxes meet by an equi-join on frames; only the matrix of ids by ids goes to one task.
    """
    own = lambda df, s: df.select("video", "frame", *[F.col(c).alias(f"{s}{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    iou = expr.iou(expr.half_open("g_x1", "g_y1", "g_x2", "g_y2"), expr.half_open("p_x1", "p_y1", "p_x2", "p_y2"))
    met = own(truth, "g_").join(own(found, "p_"), ["video", "frame"]).withColumn("iou", iou).where("iou > 0")
    pairs = met.groupBy("g_id", "p_id").agg(F.sum("iou").alias("weight"), F.array(*[F.count_if(F.col("iou") >= a) for a in ALPHAS]).alias("hits"))
    counts = lambda df, side: df.groupBy("id").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "id", "n")
    rows = pairs.select(F.lit("pair").alias("side"), F.col("g_id").alias("id"), F.col("p_id").alias("other"), "weight", "hits").unionByName(
        counts(truth, "g").unionByName(counts(found, "p")).select("side", "id", F.lit(None).cast("long").alias("other"), F.col("n").cast("double").alias("weight"), F.array().cast("array<bigint>").alias("hits"))
    )

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        n = {s: dict(zip(g.id[g.side == s], g.weight[g.side == s], strict=True)) for s in "gp"}
        pair = g[g.side == "pair"]
        gs, ps = sorted(set(pair.id)), sorted(set(pair.other))
        weight, hits = np.zeros((len(gs), len(ps))), {}
        for r in pair.itertuples():
            weight[gs.index(r.id), ps.index(r.other)] = r.weight
            hits[r.id, r.other] = np.array(r.hits, float)
        chosen = [(gs[i], ps[j]) for i, j in kernels.best_assignment(-weight) if weight[i, j] > 0]
        all_g, all_p = sum(n["g"].values()), sum(n["p"].values())
        loose = sum(x for p, x in n["p"].items() if p not in {p for _, p in chosen})
        counted = all_p if dense else all_p - loose
        found_at = np.array([hits[c] for c in chosen]).reshape(-1, len(ALPHAS))
        tp = found_at.sum(axis=0)
        size = np.array([n["g"][a] + n["p"][b] for a, b in chosen])[:, None]
        safe = lambda a, b: np.divide(a, b, out=np.zeros(len(ALPHAS)), where=np.asarray(b) > 0)
        ass = safe((found_at * found_at / np.maximum(size - found_at, 1)).sum(axis=0), tp)
        det = safe(tp, all_g + counted - tp)
        out = {"hota": np.sqrt(det * ass), "deta": det, "assa": ass, "idf1": safe(2 * tp, np.full(len(ALPHAS), all_g + counted)), "detre": safe(tp, np.full(len(ALPHAS), all_g)), "detpr": safe(tp, np.full(len(ALPHAS), counted))}
        return pd.DataFrame({k: [round(float(x.mean()), 6)] for k, x in out.items()} | {"unmatched": [int(loose)]})

    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(solve, "hota double, deta double, assa double, idf1 double, detre double, detpr double, unmatched long")


@query("V1_frame_score")
def hota(spark, sf):
    """Users against coarser identities whose boxes are shifted by up to 16 pixels."""
    d = detections(spark, sf)
    box = lambda shift: [(F.col(c) + shift).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    truth = d.select("video", F.col("frame_idx").alias("frame"), F.col("user_id").alias("id"), *box(F.lit(0)))
    return frame_score(truth, d.select("video", F.col("frame_idx").alias("frame"), (F.col("user_id") - F.col("user_id") % 3).alias("id"), *box(F.col("det_id") % 5 * 4)))
