"""Resolvers, partition edits and online matching. Edges come from joins; the order-dependent step is a kernel per component or scope.

A component of the edge graph is independent of all others under every kernel here, so components are what is grouped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.operators import joins, kernels
from loomline.operators.graph import components
from loomline.operators.scratch import staged
from loomline.plans.adapter import DEC, DET, TRK, VEC, decisions, detections, tracklet_vectors, tracklets, vectors, weak_tokens
from loomline.plans.registry import query
from loomline.plans.vectors import KNN, knn


def knn_edges(v: DataFrame, k: int) -> DataFrame:
    """``i, j, sim``: the symmetric union of all vectors' nearest, similarity clipped at 0."""
    p = knn(v, k).select(F.least("query", "item").alias("i"), F.greatest("query", "item").alias("j"), F.greatest("sim", F.lit(0.0)).alias("sim"))
    return p.groupBy("i", "j").agg(F.max("sim").alias("sim"))


@query("R1_knn_edges", f"WITH {KNN} SELECT least(query, item) AS i, greatest(query, item) AS j, max(greatest(sim, 0)) AS sim FROM knn WHERE rank <= 10 GROUP BY 1, 2")
def r1_edges(spark, sf):
    return knn_edges(vectors(spark, sf), 10)


def linkage(v: DataFrame, theta: float, k: int) -> DataFrame:
    """``id, label``: average linkage at ``theta`` over nearest-neighbour affinities, a kernel per component of the edges over 0.

    Unlinked items are at distance 1, so for ``theta`` > 0 clusters of different components never merge."""
    edges = staged(knn_edges(v, k).where("sim > 0"), "edges")
    roots = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))
    grouped = edges.join(roots.select(F.col("id").alias("i"), "root"), "i")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([g.i, g.j]))
        at = {x: n for n, x in enumerate(ids.tolist())}
        labels = kernels.average_linkage(len(ids), [(at[i], at[j], s) for i, j, s in zip(g.i, g.j, g.sim, strict=True)], theta)
        first = {lab: ids[labels == lab].min() for lab in set(labels.tolist())}
        return pd.DataFrame({"id": ids, "label": [first[x] for x in labels.tolist()]})

    solved = grouped.groupBy("root").applyInPandas(solve, "id long, label long")
    alone = v.select(F.col("vec_id").alias("id")).join(solved.select("id"), "id", "left_anti").select("id", F.col("id").alias("label"))
    return solved.unionByName(alone)


@query("R1_global_agglom")
def global_agglom(spark, sf):
    return linkage(vectors(spark, sf), 0.3, 10)


@query("R8_guarded_graph")
def guarded_graph(spark, sf):
    """Edges by score, except where two tracks of one stream meet in time; groups are capped at 40. Tracks without an edge stay alone."""
    t = tracklets(detections(spark, sf)).select("seq", "video", "camera", "frame0", "frame1", "day")
    bars = joins.interval_pairs(t, ["video", "camera"], "frame0", "frame1", "seq", 120).select(F.col("a_seq").alias("i"), F.col("b_seq").alias("j"), F.lit(-1.0).alias("score"))
    tv = tracklet_vectors(spark, sf, t.select("seq", "day"))
    edges = staged(joins.near_pairs(tv, "day", "seq", "vec", 0.2).withColumnRenamed("sim", "score"), "edges")
    roots = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))
    rows = edges.unionByName(bars).join(roots.select(F.col("id").alias("i"), "root"), "i")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        real, bar = g[g.score >= 0], g[g.score < 0]
        ids = sorted(set(real.i) | set(real.j))
        known = set(ids)
        barred = [(i, j) for i, j in zip(bar.i, bar.j, strict=True) if i in known and j in known]
        labels = kernels.guarded_merge(ids, list(zip(real.i, real.j, real.score, strict=True)), barred, 40)
        return pd.DataFrame({"seq": list(labels), "gid": list(labels.values())})

    solved = rows.groupBy("root").applyInPandas(solve, "seq long, gid long")
    alone = t.join(roots.select(F.col("id").alias("seq")), "seq", "left_anti").select("seq", F.col("seq").alias("gid"))
    return solved.unionByName(alone)


@query("R11_weak_edges")
def weak_edges(spark, sf):
    """Candidate pairs by appearance, tokens and trajectory, scored 0.60 appearance + 0.32 tokens + 0.08 trajectory."""
    t = tracklets(detections(spark, sf))
    tokens = weak_tokens(t)
    by_token = joins.token_pairs(tokens, "seq", "tokens", 0.05, 2).select("i", "j", F.lit("tokens").alias("why"))
    looks = tracklet_vectors(spark, sf, t.select("seq", F.xxhash64("video", "camera").alias("stream")))
    look = lambda name, v: looks.select(F.col("seq").alias(name), F.col("stream").alias(f"{v[0]}_stream"), F.col("vec").alias(v))
    by_look = joins.nearest(look("query", "q_vec"), look("item", "i_vec"), 8, apart=("q_stream", "i_stream"))
    by_look = by_look.select(F.least("query", "item").alias("i"), F.greatest("query", "item").alias("j"), F.lit("visual").alias("why")).distinct()
    own = tracklet_vectors(spark, sf, t.select("seq", "video", "camera", "frame0", "frame1")).join(tokens, "seq")
    # Pairs of one stream are made, scored and marked where its tracks meet; those that only looks or tokens suggest are the others.
    rare = joins.rare_tokens(tokens, "seq", "tokens", 0.05).withColumnRenamed("id", "seq")
    rare_of = F.transform("tokens", lambda x: F.coalesce(F.array_contains("own", x), F.lit(False)).cast("long"))
    tracks = own.join(rare, "seq", "left").select(F.concat_ws("|", "video", "camera").alias("stream"), "seq", "frame0", "frame1", "vec", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"), rare_of.alias("rare"))
    made = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("tokens", pa.bool_()), ("score", pa.float64()), ("cannot_link", pa.bool_()), ("accepted", pa.bool_())])
    by_path = joins.interval_blocks(tracks, "stream", "frame0", "frame1", "seq", _scored, made, 30, block=1 << 11)
    by_path = by_path.select("i", "j", F.when(F.col("tokens"), "tokens,trajectory").otherwise("trajectory").alias("why"), "score", "cannot_link", "accepted")
    pairs = by_token.unionByName(by_look).groupBy("i", "j").agg(F.array_join(F.sort_array(F.collect_set("why")), ",").alias("why"))
    side = lambda s, k: own.select(F.col("seq").alias(k), *[F.col(c).alias(f"{s}_{c}") for c in ("video", "camera", "frame0", "frame1", "vec_id", "tokens")])
    p = pairs.join(side("a", "i"), "i").join(side("b", "j"), "j")
    stream = (F.col("a_video") == F.col("b_video")) & (F.col("a_camera") == F.col("b_camera"))
    gap = expr.interval_gap(F.col("a_frame0"), F.col("a_frame1"), F.col("b_frame0"), F.col("b_frame1"))
    p = p.where(~(stream & (gap <= 30))).select("i", "j", "why", "a_vec_id", "b_vec_id", expr.jaccard(F.col("a_tokens"), F.col("b_tokens")).alias("alike"))
    score = 0.60 * F.col("visual") + 0.32 * F.col("alike")
    p = joins.products(p, "a_vec_id", "b_vec_id", vectors(spark, sf), "visual")
    return by_path.unionByName(p.select("i", "j", "why", F.round(score, 6).alias("score"), F.lit(False).alias("cannot_link"), (score >= 0.2).alias("accepted")))


def _scored(c: dict[str, np.ndarray]) -> Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    """Scores of pairs of one stream, from tables of all likenesses of a block."""
    kinds, at = np.unique(c["tokens"], return_inverse=True)
    has = np.zeros((len(c["seq"]), len(kinds)), np.float32)
    rare = has.copy()
    rows = np.arange(len(has))[:, None]
    has[rows, at.reshape(c["tokens"].shape)] = 1
    np.maximum.at(rare, (rows, at.reshape(c["tokens"].shape)), c["rare"])
    shared = (has @ has.T).astype(float)
    n = has.sum(axis=1)
    likeness = 0.60 * (c["vec"] @ c["vec"].T) + 0.32 * (shared / (n[:, None] + n - shared))
    by_token = rare @ rare.T >= 2
    f0, f1 = c["frame0"], c["frame1"]

    def pairs(i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        gap = np.maximum(np.maximum(f0[j] - f1[i], f0[i] - f1[j]), 0)
        score = likeness[i, j] + 0.08 * np.exp(-gap / 30.0)
        return {"i": c["seq"][i], "j": c["seq"][j], "tokens": by_token[i, j], "score": np.round(score, 6), "cannot_link": gap == 0, "accepted": (score >= 0.2) & (gap > 0)}

    return pairs


@query("R20_scoped_resolve")
def scoped_resolve(spark, sf):
    """Average linkage within each video: the scopes are the groups."""
    tv = tracklet_vectors(spark, sf, tracklets(detections(spark, sf)).select("seq", "video"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        v = np.array(g.vec.tolist())
        s = np.round(v @ v.T, 6)
        i, j = np.triu_indices(len(g), 1)
        labels = kernels.average_linkage(len(g), list(zip(i.tolist(), j.tolist(), s[i, j].tolist(), strict=True)), 0.25)
        return pd.DataFrame({"seq": g.seq, "video": g.video, "label": labels})

    return tv.select("seq", "video", "vec").groupBy("video").applyInPandas(solve, "seq long, video string, label long")


@query("E10_colour_split")
def colour_split(spark, sf):
    """Identities are split so that no part shows two tracks of one stream at a time."""
    t = tracklets(detections(spark, sf))
    d = decisions(t).select("seq", "gid").join(t.select("seq", "video", "camera", "frame0", "frame1"), "seq")
    bars = joins.interval_pairs(d, ["gid", "video", "camera"], "frame0", "frame1", "seq", 120).select(F.col("a_gid").alias("gid"), F.col("a_seq").alias("i"), F.col("b_seq").alias("j"))
    rows = d.select("gid", F.col("seq").alias("i"), F.lit(None).cast("long").alias("j")).unionByName(bars)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        pairs = g.dropna()
        parts = kernels.colour_split(g[g.j.isna()].i.tolist(), list(zip(pairs.i.astype(int), pairs.j.astype(int), strict=True)))
        return pd.DataFrame({"seq": list(parts), "gid": g.gid.iloc[0], "part": list(parts.values())})

    return rows.groupBy("gid").applyInPandas(solve, "seq long, gid long, part long")


@query("E11_temporal_nms")
def temporal_nms(spark, sf):
    t = tracklets(detections(spark, sf))
    d = decisions(t).select("seq", "gid").join(t.select("seq", "video", "frame0", "frame1", expr.quality(F.col("n_dets"), F.col("w"), F.col("h"), F.col("conf")).alias("q")), "seq")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        kept = set(kernels.temporal_nms(list(zip(g.seq, g.frame0, g.frame1, g.q.round(6), strict=True))))
        return pd.DataFrame({"seq": g.seq, "gid": [a if s in kept else s for s, a in zip(g.seq, g.gid, strict=True)], "kept": g.seq.isin(kept)})

    return d.groupBy("gid", "video").applyInPandas(solve, "seq long, gid long, kept boolean")


@query("O6_box_nms")
def box_nms(spark, sf):
    d = detections(spark, sf).select("det_id", "video", "frame_idx", "x1", "y1", "x2", "y2", "conf")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("det_id")
        kept = kernels.box_nms(g[["x1", "y1", "x2", "y2"]].to_numpy(float), g.conf.to_numpy(), 0.5)
        return g.iloc[sorted(kept)][["det_id", "video", "frame_idx"]]

    # Only frames with several boxes need the kernel.
    n = F.count("*").over(Window.partitionBy("video", "frame_idx"))
    d = d.withColumn("n", n)
    return d.where("n > 1").drop("n").groupBy("video", "frame_idx").applyInPandas(solve, "det_id long, video string, frame_idx long").unionByName(d.where("n = 1").select("det_id", "video", "frame_idx"))


@query("T16_iou_linker")
def iou_linker(spark, sf):
    """Boxes of a stream linked over frames; a stream is a group."""
    d = detections(spark, sf).select("det_id", "video", "frame_idx", "x1", "y1", "x2", "y2")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame_idx", "det_id"])
        frames = [(f, list(zip(x.det_id, x[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None), strict=True))) for f, x in g.groupby("frame_idx")]
        tracks = kernels.link_frames(frames, 0.3, 60)
        return pd.DataFrame({"det_id": list(tracks), "video": g.video.iloc[0], "track": list(tracks.values())})

    return d.groupBy("video").applyInPandas(solve, "det_id long, video string, track long")


DECISION = "scope string, seq long, step long, gid long, decision_type string, admit_reason string, candidates array<long>, scores array<double>, vetoes array<string>"


def match_rows(tracks: DataFrame, dets: DataFrame) -> DataFrame:
    """What the matcher takes: a row per track with scope, order, frames, boxes and vector."""
    boxes = dets.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "det_id", F.array("x1", "y1", "x2", "y2").alias("box")))).alias("d"))
    t = tracks.join(boxes, "seq")
    return t.select(F.col("camera").alias("scope"), "seq", "t0", "video", F.transform("d", lambda x: x["frame_idx"]).alias("frames"), F.transform("d", lambda x: x["box"]).alias("boxes"), "vec")


def fold(rows: pd.DataFrame, matcher: kernels.Matcher) -> pd.DataFrame:
    out = []
    for r in rows.sort_values(["t0", "seq"]).itertuples():
        out.append({"scope": r.scope, "seq": r.seq} | matcher.add(r.video, r.frames, r.boxes, np.asarray(r.vec, float)))
    return pd.DataFrame(out, columns=["scope", "seq", "step", "gid", "decision_type", "admit_reason", "candidates", "scores", "vetoes"])


def matched(spark: SparkSession, sf: str, min_dets: int = 1) -> DataFrame:
    d = detections(spark, sf)
    t = tracklet_vectors(spark, sf, tracklets(d).where(F.col("n_dets") >= min_dets).select("seq", "camera", "video", "t0"))
    rows = match_rows(t, d)
    return rows.groupBy("scope").applyInPandas(lambda g: fold(g, kernels.Matcher()), DECISION)


@query("T1_match_or_expand")
def match_or_expand(spark, sf):
    """The ordered fold of the matcher per camera; the streaming twin is in ``loomline.streaming``."""
    return matched(spark, sf).select("scope", "seq", "step", "gid", "decision_type", "admit_reason")


@query("T4_admissions")
def admissions(spark, sf):
    """How many tracks each identity's bank took, and why others were left out."""
    return matched(spark, sf).groupBy("scope", "gid", "admit_reason").agg(F.count("*").alias("n"))


@query("T5_decision_trail")
def decision_trail(spark, sf):
    """The candidates of each decision, at most six, with their scores and what ruled them out."""
    trail = F.posexplode(F.arrays_zip("candidates", "scores", "vetoes")).alias("rank", "c")
    m = matched(spark, sf).select("scope", "seq", "step", "gid", "decision_type", trail)
    return m.select("scope", "seq", "step", "gid", "decision_type", "rank", F.col("c.candidates").alias("candidate"), F.col("c.scores").alias("score"), F.col("c.vetoes").alias("veto"))


@query("EXT_decision_states", f"WITH {DEC} SELECT gid, CASE WHEN max((decision_type = 'forced')::INT) = 1 THEN 'forced' WHEN count(*) FILTER (WHERE admitted) * 2 >= count(*) THEN 'committed' ELSE 'provisional' END AS status FROM dec GROUP BY gid")
def decision_states(spark, sf):
    d = decisions(tracklets(detections(spark, sf)))
    forced = F.max((F.col("decision_type") == "forced").cast("int")) == 1
    return d.groupBy("gid").agg(F.when(forced, "forced").when(F.count_if("admitted") * 2 >= F.count("*"), "committed").otherwise("provisional").alias("status"))


@query("R17_consensus_votes", f"WITH {DEC}, b AS (SELECT seq, gid AS p0, user_id % 31 AS p1, user_id % 53 AS p2, day FROM dec JOIN trk USING (seq)) SELECT a.seq AS i, c.seq AS j, (a.p0 = c.p0)::INT + (a.p1 = c.p1)::INT + (a.p2 = c.p2)::INT AS votes FROM b a JOIN b c ON a.day = c.day AND a.seq < c.seq AND (a.p0 = c.p0 OR a.p1 = c.p1 OR a.p2 = c.p2)")
def consensus_votes(spark, sf):
    """Votes of base partitions for pairs of one day: an equi-join per partition, where a pair counts in the first that it shares, with
    all its votes, so pairs aren't shuffled."""
    t = tracklets(detections(spark, sf))
    b = decisions(t).select("seq", "gid").join(t.select("seq", "day", "user_id"), "seq").select("seq", "day", F.array("gid", F.col("user_id") % 31, F.col("user_id") % 53).alias("own"))
    long = b.select("seq", "day", "own", F.posexplode("own").alias("p", "label"))
    side = lambda k, own: long.select("day", "p", "label", F.col("seq").alias(k), F.col("own").alias(own))
    pairs = side("i", "a").join(side("j", "b").hint("merge"), ["day", "p", "label"]).where("i < j")
    same = [(F.get("a", F.lit(k)) == F.get("b", F.lit(k))).cast("int") for k in range(3)]
    first = F.when(same[0] == 1, 0).when(same[1] == 1, 1).otherwise(2)
    return pairs.where(F.col("p") == first).select("i", "j", (same[0] + same[1] + same[2]).alias("votes"))


@query("EXT_session_windows", f"WITH {DET}, g AS (SELECT user_id, abs_ms, (abs_ms - lag(abs_ms) OVER (PARTITION BY user_id ORDER BY abs_ms) > 3600000)::INT AS fresh FROM det), s AS (SELECT user_id, abs_ms, sum(coalesce(fresh, 0)) OVER (PARTITION BY user_id ORDER BY abs_ms ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(abs_ms) AS t0, max(abs_ms) AS t1, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    """An extension: sessions of a user with gaps of up to an hour."""
    d = detections(spark, sf)
    w = Window.partitionBy("user_id").orderBy("abs_ms")
    g = d.select("user_id", "abs_ms", F.coalesce((F.col("abs_ms") - F.lag("abs_ms").over(w) > 3_600_000).cast("int"), F.lit(0)).alias("fresh"))
    s = g.withColumn("k", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "k").agg(F.min("abs_ms").alias("t0"), F.max("abs_ms").alias("t1"), F.count("*").alias("n")).drop("k")
