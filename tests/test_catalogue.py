"""Every core query against DuckDB on the smallest tables; the check sum against zlib."""

import zlib

import oracle
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from keyfold.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differences(con, catalogue.queries()[name](spark, SMALL), SQL[name]) == ""


def test_record_checksums(spark):
    log = {r.seq: r for r in catalogue.event_log(spark, SMALL).collect()}
    for r in catalogue.crc32_records(spark, SMALL).collect():
        e = log[r.seq]
        key, value = e.key.encode(), e.value.encode()
        body = (5 + len(key) + len(value)).to_bytes(4, "little") + bytes([e.op]) + len(key).to_bytes(4, "little") + key + value
        assert r.crc == zlib.crc32(body)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "value"] and df.count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_merge_prunes_before_the_shuffle(spark):
    """Ranking to one is cut on the map side, a key range reaches the scan, and unread columns do not."""
    from keyfold.operators import merge, reads

    plan = merge.newest_by_seq(catalogue.event_log(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    scan = reads.scan(orders.withColumnRenamed("o_orderkey", "key").withColumnRenamed("o_orderstatus", "value").selectExpr("key", "value", "o_custkey as seq", "1 as op"), 10, 50)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan and "LessThan(o_orderkey,50)" in plan and "o_comment" not in plan
