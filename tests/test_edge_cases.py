"""Nulls follow SQL semantics; out-of-range amounts fail loudly.

Fixtures are derived by Spark from the driver's sf0.001 line items.
"""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.plans import revenue_by_priority
from quarry.plans.revenue_by_priority import LINEITEM_COLUMNS, ORDERS_COLUMNS, oracle_sql
from quarry.sources import read_table
from tests.conftest import SF_SMOKE, duck, rows


def _bucket(n):
    return F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(n))


def test_nulls_match_sql_semantics(spark, tmp_path):
    li = read_table(spark, SF_SMOKE, "lineitem")
    b = _bucket(10)
    holed = (
        li.withColumn("l_extendedprice", F.when(b == 0, None).otherwise(F.col("l_extendedprice")))
        .withColumn("l_discount", F.when(b == 1, None).otherwise(F.col("l_discount")))
        .withColumn("l_shipdate", F.when(b == 2, None).otherwise(F.col("l_shipdate")))
    )
    path = str(tmp_path / "lineitem.parquet")
    holed.write.parquet(path)

    got = revenue_by_priority(
        spark.read.parquet(path).select(*LINEITEM_COLUMNS),
        read_table(spark, SF_SMOKE, "orders", ORDERS_COLUMNS),
    )
    # Lines with a null amount still count; their revenue drops out of the sum.
    want = duck(SF_SMOKE, overrides={"lineitem": path}).execute(oracle_sql()).fetchall()
    assert rows(got) == sorted(want)


@pytest.mark.parametrize("column", ["l_extendedprice", "l_discount"])
@pytest.mark.parametrize("amount", [0.065, 1.005, 1e18, float("inf"), float("nan")])
def test_amounts_that_cannot_be_exact_raise(spark, column, amount):
    li = read_table(spark, SF_SMOKE, "lineitem")
    odd = li.withColumn(
        column, F.when(_bucket(100) == 0, F.lit(amount)).otherwise(F.col(column))
    ).select(*LINEITEM_COLUMNS)
    orders = read_table(spark, SF_SMOKE, "orders", ORDERS_COLUMNS)
    with pytest.raises(PySparkException, match="not a whole number of cents"):
        revenue_by_priority(odd, orders).collect()
