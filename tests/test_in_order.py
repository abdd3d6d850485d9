"""Queries that compare means with bounds give the rows of their SQL in whatever order the events arrive."""

import datetime
import itertools

import duckdb
import pytest

import __spark_entry__
from loomline.plans import registry

#: Means that lie on the bound in one order of their summands and beside it in another.
BOUNDS = {"F11_bucket_tokens": 0.55, "P18_rule_grid": 0.5, "P6_admission_filter": 0.3}


def total(values):
    out = 0.0
    for v in values:
        out += v
    return out / len(values)


def crossing(bound):
    for ids in itertools.chain(*(itertools.combinations(range(100), n) for n in (3, 4))):
        means = [total([i / 100 for i in x]) for x in (ids, ids[::-1])]
        if (means[0] < bound) != (means[1] < bound):
            yield ids


@pytest.mark.parametrize("name", sorted(BOUNDS))
def test_order_of_arrival(spark, tmp_path, name):
    rows = []
    for u, ids in enumerate(itertools.islice(crossing(BOUNDS[name]), 20)):
        rows += [(100 * u + k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k), u, "view") for k in ids]
    assert rows
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    spark.createDataFrame(sorted(rows, reverse=True), schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = duck.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.select(*columns).fetchall())
