"""Pairs that are made where their tracks meet: all of them, once, and no join makes or shuffles them."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from loomline.operators import joins

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [4, 1000])
@pytest.mark.parametrize("apart", [None, "camera"])
def test_interval_blocks_find_what_interval_pairs_find(spark, block, apart):
    draw = np.random.default_rng(5)
    rows = [(i, int(draw.integers(3)), int(lo), int(lo + draw.integers(9)), int(draw.integers(3))) for i, lo in enumerate(draw.integers(0, 60, 90))]
    df = spark.createDataFrame([*rows, (90, None, 1, 2, 0), (91, 0, 1, 2, None)], "id long, k long, lo long, hi long, camera long")
    got = joins.interval_blocks(df, "k", "lo", "hi", "id", lambda c: lambda i, j: {"i": c["id"][i], "j": c["id"][j]}, pa.schema([("i", pa.int64()), ("j", pa.int64())]), 2, apart, block)
    if apart is None:
        df = df.where("id < 90")
    want = joins.interval_pairs(df, ["k"], "lo", "hi", "id", 7, 2).where("a_camera <> b_camera" if apart else "true")
    found = [(r.i, r.j) for r in got.collect() if apart or 91 not in (r.i, r.j)]
    assert len(found) == len(set(found)) > 50
    assert sorted(found) == sorted((r.a_id, r.b_id) for r in want.collect())


@pytest.mark.parametrize("name", ["R11_weak_edges", "R15_geo_support"])
def test_pairs_of_intervals_come_from_no_join(spark, name):
    """Spark's interval join explodes a track into its buckets and makes every pair a row with all of both tracks."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "a_bucket" not in plan and "InArrow" in plan


def test_products_of_named_vectors(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(600)] + [(600, None)], "vec_id long, vec array<double>")
    pairs = spark.createDataFrame([(k, k % 600, k * 7 % 600) for k in range(900)] + [(900, 600, 1)], "n long, a long, b long")
    got = {r.n: r.p for r in joins.products(pairs, "a", "b", v, "p").collect()}
    assert got == {k: float((k % 600) * (k * 7 % 600) + 1) for k in range(900)}
