"""One order key holding a third of all line items.

The line items are derived by Spark from the driver's sf0.01 table: every row
is kept, and about a third are moved onto one existing order key.
"""

import statistics

import pytest
from pyspark.sql import functions as F

from quarry.operators import Measure, rollup_through_key
from quarry.plans import revenue_by_priority
from quarry.plans.revenue_by_priority import oracle_sql
from quarry.sources import read_table
from tests.conftest import SF_CHECK, duck, rows
from tests.eventlog import shuffle_records_read, tasks_of_tagged_jobs


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed") / "sf"
    out.mkdir()
    hot = read_table(spark, SF_CHECK, "orders").agg(F.min("o_orderkey")).first()[0]
    li = read_table(spark, SF_CHECK, "lineitem")
    moved = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(3)) == 0
    (
        li.withColumn("l_orderkey", F.when(moved, F.lit(hot)).otherwise(F.col("l_orderkey")))
        .repartition(8)
        .write.parquet(str(out / "lineitem.parquet"))
    )
    return str(out), hot


def test_hot_key_holds_a_third(spark, skewed_dir):
    d, hot = skewed_dir
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    n, n_hot = li.count(), li.where(F.col("l_orderkey") == hot).count()
    assert n == 60000
    assert 0.30 < n_hot / n < 0.37


def test_skewed_result_matches_duckdb(spark, skewed_dir):
    d, _ = skewed_dir
    # orders comes from the original tables; line items from the derived copy.
    got = rows(_query(spark, d))
    con = duck(SF_CHECK, overrides={"lineitem": f"{d}/lineitem.parquet"})
    assert got == sorted(con.execute(oracle_sql()).fetchall())


def test_no_task_receives_the_hot_keys_rows(spark, skewed_dir, event_log_dir):
    d, _ = skewed_dir
    sc = spark.sparkContext
    # At scale the orders side cannot be broadcast, so force the shuffle join,
    # and keep one task per shuffle partition so per-task load is visible.
    pinned = {
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in pinned}
    for k, v in pinned.items():
        spark.conf.set(k, v)
    df = _query(spark, d)
    sc.setLocalProperty("quarry.check", "skew")
    try:
        df.collect()
    finally:
        sc.setLocalProperty("quarry.check", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    tasks = tasks_of_tagged_jobs(event_log_dir, "quarry.check", "skew")
    assert tasks
    # A plain shuffle join sends every shipped hot row to one reducer (about
    # 23k records here); the per-order partial aggregate sends at most one
    # hot row per map task.
    assert_even(tasks)


def assert_even(tasks):
    """In each stage that shuffles much, the largest task reads about the median."""
    stages = {}
    for t in tasks:
        stages.setdefault(t["Stage ID"], []).append(shuffle_records_read(t))
    large = [s for s in stages.values() if statistics.median(s) >= 500]
    assert large
    for s in large:
        assert max(s) <= 1.5 * statistics.median(s), s


def test_hot_key_on_the_keyed_side(spark, event_log_dir):
    # A third of the orders moved onto one key: each still meets every line.
    orders = read_table(spark, SF_CHECK, "orders", ["o_orderkey", "o_orderpriority"])
    li = read_table(spark, SF_CHECK, "lineitem", ["l_orderkey"])
    hot = orders.agg(F.min("o_orderkey")).first()[0]
    moved = F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == 0
    skewed = orders.withColumn(
        "o_orderkey", F.when(moved, F.lit(hot)).otherwise(F.col("o_orderkey"))
    )

    def query():
        return rollup_through_key(
            li, "l_orderkey", skewed, "o_orderkey", ["o_orderpriority"], [Measure("n", "count")]
        )

    want = li.join(skewed, li.l_orderkey == skewed.o_orderkey).groupBy("o_orderpriority").count()
    assert rows(query()) == rows(want)
    pinned = {
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in pinned}
    for k, v in pinned.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLocalProperty("quarry.check", "keyed")
    try:
        query().collect()
    finally:
        spark.sparkContext.setLocalProperty("quarry.check", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert_even(tasks_of_tagged_jobs(event_log_dir, "quarry.check", "keyed"))


def _query(spark, skewed_root):
    return revenue_by_priority(
        spark.read.parquet(f"{skewed_root}/lineitem.parquet").select(
            "l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"
        ),
        read_table(spark, SF_CHECK, "orders", ["o_orderkey", "o_orderpriority"]),
    )

