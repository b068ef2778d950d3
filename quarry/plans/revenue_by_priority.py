"""Revenue per order priority.

For line items shipped on or after ``ship_from``, joined to their order:
number of lines and net revenue (``price * (1 - discount)``) per
``o_orderpriority``.

Plan (``explain("formatted")``):

    lineitem scan  ReadSchema = l_orderkey, l_extendedprice, l_discount, l_shipdate
                   PushedFilters = l_shipdate >= ship_from, l_orderkey is not null
      -> partial hash aggregate per l_orderkey -> exchange(l_orderkey)
      -> final hash aggregate per l_orderkey
    orders scan    ReadSchema = o_orderkey, o_orderpriority
      -> exchange(o_orderkey)   (or a broadcast, if adaptive execution measures it small)
    sort-merge join on the order key
      -> partial hash aggregate per priority -> exchange -> final aggregate

Every stage is built-in expressions inside whole-stage codegen; no Python
runs in the tasks.  See ``quarry.operators.rollup`` for why the line items
are aggregated per order before the join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import net_price_units, ntz_literal, units_to_double
from quarry.operators import Measure, rollup_through_key
from quarry.sources import read_table

DEFAULT_SHIP_FROM = "1996-01-01"

LINEITEM_COLUMNS = ("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate")
ORDERS_COLUMNS = ("o_orderkey", "o_orderpriority")


def revenue_by_priority(
    lineitem: DataFrame,
    orders: DataFrame,
    ship_from: str | dt.date | dt.datetime = DEFAULT_SHIP_FROM,
) -> DataFrame:
    """Columns: ``o_orderpriority string, n_lines bigint, revenue double``."""
    shipped = lineitem.where(F.col("l_shipdate") >= ntz_literal(ship_from))
    return rollup_through_key(
        fact=shipped,
        fact_key="l_orderkey",
        keyed=orders,
        keyed_key="o_orderkey",
        group_cols=["o_orderpriority"],
        keyed_unique=True,
        measures=[
            Measure("n_lines", "count"),
            # Exact integer units of 1e-4, converted to double once at the end.
            Measure(
                "revenue",
                "exact_sum",
                net_price_units("l_extendedprice", "l_discount"),
                finish=units_to_double,
            ),
        ],
    )


def revenue_by_priority_at(
    spark: SparkSession, sf_dir: str, ship_from: str | dt.date | dt.datetime = DEFAULT_SHIP_FROM
) -> DataFrame:
    """``revenue_by_priority`` over the tables under ``sf_dir``."""
    return revenue_by_priority(
        read_table(spark, sf_dir, "lineitem", LINEITEM_COLUMNS),
        read_table(spark, sf_dir, "orders", ORDERS_COLUMNS),
        ship_from,
    )


def oracle_sql(ship_from: str = DEFAULT_SHIP_FROM) -> str:
    """The same query as plain SQL (DuckDB dialect; tables as views)."""
    return f"""
SELECT o.o_orderpriority AS o_orderpriority,
       count(*) AS n_lines,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l.l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS revenue
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate >= TIMESTAMP '{ship_from}'
GROUP BY o.o_orderpriority
""".strip()


ORACLE_SQL = oracle_sql()
