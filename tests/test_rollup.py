"""rollup_through_key equals join-then-aggregate, whatever the key table holds."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import cents, net_price_units, units_to_double
from quarry.operators import Measure, rollup_through_key
from quarry.sources import read_table
from tests.conftest import SF_CHECK, rows


def measures():
    return [
        Measure("n_lines", "count"),
        Measure("qty", "exact_sum", cents("l_quantity"), finish=lambda t: t.cast("bigint")),
        Measure(
            "revenue",
            "exact_sum",
            net_price_units("l_extendedprice", "l_discount"),
            finish=units_to_double,
        ),
    ]


def brute_force(fact, fact_key, keyed, keyed_key, group_cols):
    joined = fact.join(keyed, fact[fact_key] == keyed[keyed_key], "inner")
    return joined.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(cents("l_quantity")).alias("qty"),
        units_to_double(
            F.sum(net_price_units("l_extendedprice", "l_discount").cast("decimal(38,0)"))
        ).alias("revenue"),
    )


@pytest.fixture(scope="module")
def lineitem(spark):
    return read_table(spark, SF_CHECK, "lineitem")


@pytest.fixture(scope="module")
def orders(spark):
    return read_table(spark, SF_CHECK, "orders")


def test_several_group_columns(lineitem, orders):
    groups = ["o_orderpriority", "o_orderstatus"]
    got = rollup_through_key(lineitem, "l_orderkey", orders, "o_orderkey", groups, measures())
    assert rows(got) == rows(brute_force(lineitem, "l_orderkey", orders, "o_orderkey", groups))
    assert got.columns == groups + ["n_lines", "qty", "revenue"]


def test_duplicate_keys_on_the_keyed_side(lineitem, orders):
    # Some orders appear two or three times; each copy meets every line item.
    extra = orders.where(F.pmod("o_orderkey", F.lit(5)) == 0)
    dup = orders.unionByName(extra).unionByName(extra.where(F.pmod("o_orderkey", F.lit(2)) == 0))
    got = rollup_through_key(lineitem, "l_orderkey", dup, "o_orderkey", ["o_orderpriority"], measures())
    want = brute_force(lineitem, "l_orderkey", dup, "o_orderkey", ["o_orderpriority"])
    assert rows(got) == rows(want)
    assert sum(r.n_lines for r in got.collect()) > lineitem.count()


def test_null_and_unmatched_keys_drop_out(lineitem, orders):
    h = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(7))
    messy = lineitem.withColumn(
        "l_orderkey",
        F.when(h == 0, F.lit(None).cast("bigint"))
        .when(h == 1, F.col("l_orderkey") + F.lit(10**12))
        .otherwise(F.col("l_orderkey")),
    )
    got = rollup_through_key(messy, "l_orderkey", orders, "o_orderkey", ["o_orderpriority"], measures())
    want = brute_force(messy, "l_orderkey", orders, "o_orderkey", ["o_orderpriority"])
    assert rows(got) == rows(want)


def test_group_by_the_key_table_key_itself(lineitem, orders):
    got = rollup_through_key(lineitem, "l_orderkey", orders, "o_orderkey", ["o_custkey"], measures())
    want = brute_force(lineitem, "l_orderkey", orders, "o_orderkey", ["o_custkey"])
    assert rows(got) == rows(want)


def test_empty_fact(lineitem, orders):
    none = lineitem.where(F.lit(False))
    got = rollup_through_key(none, "l_orderkey", orders, "o_orderkey", ["o_orderpriority"], measures())
    assert got.count() == 0


@pytest.mark.parametrize(
    "kwargs, message",
    [
        (dict(group_cols=["l_returnflag"]), "not columns of the keyed table"),
        (dict(measures=[]), "at least one measure"),
        (dict(group_cols=[]), "at least one group column"),
    ],
)
def test_rejects_bad_arguments(lineitem, orders, kwargs, message):
    args = dict(
        fact=lineitem,
        fact_key="l_orderkey",
        keyed=orders,
        keyed_key="o_orderkey",
        group_cols=["o_orderpriority"],
        measures=measures(),
    )
    args.update(kwargs)
    with pytest.raises(ValueError, match=message):
        rollup_through_key(**args)


def test_measure_validation(spark):
    with pytest.raises(ValueError):
        Measure("x", "avg", F.col("a"))
    with pytest.raises(ValueError):
        Measure("x", "sum", F.col("a"))
    with pytest.raises(ValueError):
        Measure("x", "exact_sum")


@pytest.mark.parametrize("unique", [False, True])
def test_declared_uniqueness_never_changes_the_result(lineitem, orders, unique):
    dup = orders.unionByName(orders.where(F.pmod("o_orderkey", F.lit(4)) == 0))
    groups = ["o_orderpriority"]
    got = rollup_through_key(
        lineitem, "l_orderkey", dup, "o_orderkey", groups, measures(), keyed_unique=unique
    )
    assert rows(got) == rows(brute_force(lineitem, "l_orderkey", dup, "o_orderkey", groups))


def test_ansi_off_is_refused(spark, lineitem, orders):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            rollup_through_key(
                lineitem, "l_orderkey", orders, "o_orderkey", ["o_orderpriority"], measures()
            )
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
