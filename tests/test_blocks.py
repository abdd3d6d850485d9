"""Pairs that are made by blocks: results as by definition, and no table of pairs on the way."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

import __spark_entry__
from loomline.operators import joins
from loomline.plans import edits as plans

SF = "/root/testdata/sf0.001"


def test_bonus_edges_join_no_pairs(spark):
    """After pairs are made nothing is joined: both tracks' times come with them."""
    plan = __spark_entry__.queries()["R5_time_bonus_edges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("InArrow")]


def test_verifier_sums_pairs_and_makes_none(spark, monkeypatch):
    want = plans.fit_pairs(plans.pair_features(spark, SF, plans.weak_pairs(spark, SF)), LogisticRegression(maxIter=100, regParam=0.01, tol=1e-10))
    monkeypatch.setattr(plans, "weak_pairs", None)
    got = plans._verifier(spark, SF)
    assert got.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-4)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-4)


@pytest.mark.parametrize("apart", [True, False])
def test_nearest_of_equal_vectors(spark, apart):
    """Equal items are sent as few rows, and the result is that of all pairs."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(5, 3)), 2)
    rows = [(k, int(rng.integers(0, 3)), x[int(rng.integers(0, 5))].tolist()) for k in range(60)]
    q = spark.createDataFrame(rows, "query long, q_group long, q_vec array<double>")
    i = spark.createDataFrame(rows, "item long, i_group long, i_vec array<double>")
    got = joins.nearest(q, i, 4, ("q_group", "i_group") if apart else None)
    want = []
    for a, g, v in rows:
        others = sorted((-round(float(np.dot(v, w)), 6), b) for b, h, w in rows if a != b and not (apart and g == h))
        want += [(a, b, -s, r) for r, (s, b) in enumerate(others[:4], 1)]
    found = sorted((r.query, r.rank, r.item, r.sim) for r in got.collect())
    assert [(a, r, b) for a, r, b, _ in found] == sorted((a, r, b) for a, b, _, r in want)


def test_blocks_meet_once(spark):
    import pyarrow as pa

    def pairs(left, right, same):
        i, j = left.column("id").to_numpy(), right.column("id").to_numpy()
        u, v = np.nonzero(i[:, None] < j) if same else np.nonzero(i[:, None] != j)
        yield pa.RecordBatch.from_arrays([np.minimum(i[u], j[v]), np.maximum(i[u], j[v])], names=["i", "j"])

    rows = spark.createDataFrame([(k % 2, k) for k in range(40)], "key long, id long")
    got = [(r.i, r.j) for r in joins.in_blocks(rows, "key", pairs, "i long, j long", 6).collect()]
    assert sorted(got) == [(i, j) for i in range(40) for j in range(i + 2, 40, 2)]
