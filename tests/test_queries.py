"""Registered queries against their SQL at sf0.001, and joins against brute force."""

import duckdb
import pytest

import __spark_entry__
from loomline.operators import joins
from loomline.operators.graph import components
from loomline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v

    return sorted(([one(v) for v in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


@pytest.mark.parametrize("name", ["R1_global_agglom", "R8_guarded_graph", "E10_colour_split", "E11_temporal_nms", "T16_iou_linker", "T1_match_or_expand", "R11_weak_edges", "V5_identity_f1", "R12_label_propagation"])
def test_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_interval_pairs(spark):
    rows = [(i, i % 2, (i * 37) % 50, (i * 37) % 50 + i % 9) for i in range(60)]
    got = joins.interval_pairs(spark.createDataFrame(rows, "id long, k long, lo long, hi long"), ["k"], "lo", "hi", "id", 7, 2)
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] - 2 <= b[3] and b[2] <= a[3] + 2]
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == sorted(want)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 10)], "a long, b long")
    assert {r.id: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7, 9: 7}
    assert components(edges.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """The streaming matcher over one micro-batch gives the batch fold's log."""
    from loomline.plans.adapter import detections, tracklet_vectors, tracklets
    from loomline.plans.resolve import match_rows, matched
    from loomline.streaming.matcher import match_stream

    d = detections(spark, SF)
    rows = match_rows(tracklet_vectors(spark, SF, tracklets(d).select("seq", "camera", "video", "t0")), d)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = match_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("log").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.scope, r.seq, r.step, r.gid, r.decision_type) for r in df.collect())
    assert key(spark.table("log")) == key(matched(spark, SF))
