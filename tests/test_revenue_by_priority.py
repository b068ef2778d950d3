"""Revenue per order priority against DuckDB on the driver's tables."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.plans import revenue_by_priority, revenue_by_priority_at
from quarry.plans.revenue_by_priority import oracle_sql
from quarry.sources import read_table
from tests.conftest import SF_CHECK, SF_SMOKE, duck, rows

FIRST_SHIP = dt.date(1995, 1, 2)
LAST_SHIP = dt.date(2001, 11, 4)


def oracle(sf_dir, ship_from):
    return sorted(duck(sf_dir).execute(oracle_sql(str(ship_from))).fetchall())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    ship_from=st.dates(
        min_value=FIRST_SHIP - dt.timedelta(days=30), max_value=LAST_SHIP + dt.timedelta(days=30)
    )
)
def test_any_cutoff_matches_duckdb(spark, ship_from):
    got = rows(revenue_by_priority_at(spark, SF_SMOKE, ship_from))
    assert got == oracle(SF_SMOKE, ship_from)


def test_cutoff_is_inclusive_to_the_microsecond(spark):
    li = read_table(spark, SF_SMOKE, "lineitem")
    last = li.agg({"l_shipdate": "max"}).first()[0]
    n_last = li.where(li.l_shipdate == last).count()
    got = revenue_by_priority_at(spark, SF_SMOKE, last).collect()
    assert sum(r.n_lines for r in got) == n_last
    after = revenue_by_priority_at(spark, SF_SMOKE, last + dt.timedelta(microseconds=1))
    assert after.count() == 0


def test_cutoff_before_all_data_keeps_every_joined_line(spark):
    got = revenue_by_priority_at(spark, SF_CHECK, FIRST_SHIP - dt.timedelta(days=1)).collect()
    joined = duck(SF_CHECK).execute(
        "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    ).fetchone()[0]
    assert sum(r.n_lines for r in got) == joined


def test_session_time_zone_does_not_move_the_cutoff(spark):
    base = rows(revenue_by_priority_at(spark, SF_CHECK))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("America/Los_Angeles", "Asia/Kolkata", "Pacific/Kiritimati"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert rows(revenue_by_priority_at(spark, SF_CHECK)) == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("partitions", [1, 3, 37])
def test_result_does_not_depend_on_parallelism(spark, partitions):
    base = rows(revenue_by_priority_at(spark, SF_CHECK))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        li = read_table(spark, SF_CHECK, "lineitem").repartition(partitions)
        od = read_table(spark, SF_CHECK, "orders").repartition(partitions)
        assert rows(revenue_by_priority(li, od)) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_naive_datetime_only(spark):
    with pytest.raises(ValueError):
        revenue_by_priority_at(spark, SF_SMOKE, dt.datetime(1996, 1, 1, tzinfo=dt.timezone.utc))
