"""Motion trackers as grouped maps: a stream is a group, its boxes in order of frames and ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import trackers
from loomline.plans.adapter import detections, tracklet_vectors, tracklets
from loomline.plans.registry import query

BOX = ["x1", "y1", "x2", "y2"]


def _streams(spark, sf) -> DataFrame:
    return detections(spark, sf).select("det_id", "seq", "video", "frame_idx", *BOX, "conf")


def _named(g: pd.DataFrame, tracker: trackers.TwoStage) -> pd.DataFrame:
    g = g.sort_values(["frame_idx", "det_id"])
    names = [n for _, f in g.groupby("frame_idx") for n in tracker.feed(f[BOX].to_numpy(float), f.conf.to_numpy())]
    return pd.DataFrame({"det_id": g.det_id, "video": g.video, "tracklet": [f"{v}:{n}" for v, n in zip(g.video, names, strict=True)]})


@query("T17_two_stage_tracker")
def two_stage(spark, sf):
    """Kalman prediction, then boxes of high and of low confidence."""
    return _streams(spark, sf).drop("seq").groupBy("video").applyInPandas(lambda g: _named(g, trackers.TwoStage()), "det_id long, video string, tracklet string")


@query("T18_observation_centric_tracker")
def observation_centric(spark, sf):
    """Momentum, recovery from the last box seen, and re-update after a gap."""
    return _streams(spark, sf).drop("seq").groupBy("video").applyInPandas(lambda g: _named(g, trackers.ObservationCentric()), "det_id long, video string, tracklet string")


@query("T19_appearance_tracker")
def with_appearance(spark, sf):
    """Prediction and appearance with least-cost assignment; tracks in pieces of up to 60 frames. Boxes without a track aren't returned."""
    d = _streams(spark, sf)
    v = tracklet_vectors(spark, sf, tracklets(detections(spark, sf)).select("seq")).select("seq", "vec")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame_idx", "det_id"])
        tracker = trackers.WithAppearance()
        found = [x for f, r in g.groupby("frame_idx") for x in tracker.feed(f, r[BOX].to_numpy(float), r.conf.to_numpy(), np.array(r.vec.tolist()))]
        rows = [(d, v, *x) for d, v, x in zip(g.det_id, g.video, found, strict=True) if x is not None]
        return pd.DataFrame(rows, columns=["det_id", "video", "track", "piece"])

    return d.join(v, "seq").drop("seq").groupBy("video").applyInPandas(solve, "det_id long, video string, track long, piece long")
