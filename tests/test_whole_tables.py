"""Queries that answer for every track, however short."""

import pytest

import __spark_entry__
from loomline.plans.adapter import detections, tracklets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["T1_match_or_expand", "R8_guarded_graph", "R20_scoped_resolve"])
def test_every_track(spark, name):
    want = sorted(r.seq for r in tracklets(detections(spark, SF)).select("seq").collect())
    assert sorted(r.seq for r in __spark_entry__.queries()[name](spark, SF).select("seq").collect()) == want
