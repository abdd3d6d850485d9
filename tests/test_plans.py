"""What plans of joins on pairs must not do: shuffle the pairs once more, or broadcast a side that Spark sizes before it is spread."""

import pytest

import __spark_entry__
from loomline.operators import joins

SF = "/root/testdata/sf0.001"


def above_join(df):
    """The optimized plan down to its first join."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(lines[: next(k for k, line in enumerate(lines) if "Join" in line)])


@pytest.mark.parametrize("name", ["R17_consensus_votes", "U6_dedup_edges", "J13_token_pairs"])
def test_pairs_are_not_shuffled(spark, name):
    assert "Aggregate" not in above_join(__spark_entry__.queries()[name](spark, SF))


def test_interval_pairs_broadcast_no_spread_side(spark):
    rows = spark.createDataFrame([(i, i % 2, i, i + 3) for i in range(40)], "id long, k long, lo long, hi long")
    plan = joins.interval_pairs(rows, ["k"], "lo", "hi", "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_interval_pairs_look_at_a_pair_once(spark):
    """Of each pair of sides one is in the bucket of its start alone: long intervals don't meet in every bucket they share."""
    rows = spark.createDataFrame([(i, 1, i, i + 999) for i in range(4)], "id long, k long, lo long, hi long")
    df = joins.interval_pairs(rows, ["k"], "lo", "hi", "id", 1)
    assert df.count() == 6
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == plan.count("Join Inner") == 2


@pytest.mark.parametrize("name", ["T3_vetoes"])
def test_pairs_of_intervals_broadcast_nothing(spark, name):
    assert "BroadcastHashJoin" not in __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_token_pairs(spark, least):
    rows = [(k, [f"t{(k * m) % 7}" for m in (1, 2, 3, 5)]) for k in range(30)]
    got = joins.token_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens", 1.0, least)
    want = [(i, j, len(set(a) & set(b))) for i, a in rows for j, b in rows if i < j and len(set(a) & set(b)) >= least]
    assert sorted((r.i, r.j, r.n_shared) for r in got.collect()) == sorted(want)
