"""Compare the shipped plan with a plain join-then-aggregate beyond sf0.1.

    python tools/scale_study.py OUT_DIR [--sf-dir /root/testdata/sf0.1] [--copies 10]

Derives larger tables from the given ones with Spark and writes them under
OUT_DIR (use a fresh folder; on a cluster, a shared one):

* ``uniform``: ``copies`` copies of ``orders`` and ``lineitem``, order keys
  offset per copy, line items scattered across files;
* ``hot``: the same line items with about a third moved onto one order key;
* ``clustered``: the uniform line items range-partitioned and sorted by order
  key, as when an order's lines are written together.

Then times both plans on each (fresh DataFrame per run, runs interleaved,
median of ``--runs``) and prints one line per plan and layout.  Nothing here is a registered query.
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from quarry.functions import net_price_units, ntz_literal, units_to_double  # noqa: E402
from quarry.plans import revenue_by_priority_at  # noqa: E402
from quarry.session import local_session  # noqa: E402
from quarry.sources import read_table  # noqa: E402

KEY_SPAN = 10**9  # larger than any order key in the source tables


def derive(spark, sf_dir, out, copies):
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint")))
    li = read_table(spark, sf_dir, "lineitem").select("*", copy.alias("copy"))
    li = li.withColumn("l_orderkey", F.col("l_orderkey") + F.col("copy") * KEY_SPAN).drop("copy")
    od = read_table(spark, sf_dir, "orders").select("*", copy.alias("copy"))
    od = od.withColumn("o_orderkey", F.col("o_orderkey") + F.col("copy") * KEY_SPAN).drop("copy")
    files = 8 * copies

    uniform = os.path.join(out, "uniform")
    li.repartition(files).write.parquet(f"{uniform}/lineitem.parquet")
    od.repartition(max(1, copies)).write.parquet(f"{uniform}/orders.parquet")
    base_li = read_table(spark, uniform, "lineitem")
    base_od = read_table(spark, uniform, "orders")

    hot_key = base_od.agg(F.min("o_orderkey")).first()[0]
    moved = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(3)) == 0
    hot = os.path.join(out, "hot")
    base_li.withColumn(
        "l_orderkey", F.when(moved, F.lit(hot_key)).otherwise(F.col("l_orderkey"))
    ).repartition(files).write.parquet(f"{hot}/lineitem.parquet")
    base_od.write.parquet(f"{hot}/orders.parquet")

    clustered = os.path.join(out, "clustered")
    base_li.repartitionByRange(files, "l_orderkey").sortWithinPartitions("l_orderkey").write.parquet(
        f"{clustered}/lineitem.parquet"
    )
    base_od.write.parquet(f"{clustered}/orders.parquet")
    return {"uniform": uniform, "hot": hot, "clustered": clustered}


def plain(spark, d):
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"])
    od = read_table(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    units = net_price_units("l_extendedprice", "l_discount").cast("decimal(38,0)")
    return (
        li.where(F.col("l_shipdate") >= ntz_literal("1996-01-01"))
        .join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n_lines"), units_to_double(F.sum(units)).alias("revenue"))
    )


def final_join(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    final = buf.getvalue().split("Initial Plan")[0]
    return "broadcast" if "BroadcastHashJoin" in final else "sort-merge"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("out")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--copies", type=int, default=10)
    ap.add_argument("--cpus", type=int, default=8)
    ap.add_argument("--shuffle-partitions", type=int, default=32)
    ap.add_argument("--runs", type=int, default=5)
    args = ap.parse_args()

    spark = local_session(cpus=args.cpus, shuffle_partitions=args.shuffle_partitions)
    dirs = derive(spark, args.sf_dir, args.out, args.copies)
    plans = (("shipped", revenue_by_priority_at), ("plain", plain))
    for layout, d in dirs.items():
        results, joins = {}, {}
        for name, q in plans:  # also warms up both
            df = q(spark, d)
            results[name] = sorted(df.collect())
            joins[name] = final_join(df)
        times = {name: [] for name, _ in plans}
        for _ in range(args.runs):  # interleaved, so drift hits both alike
            for name, q in plans:
                start = time.perf_counter()
                q(spark, d).collect()
                times[name].append(time.perf_counter() - start)
        for name, _ in plans:
            print(
                f"x{args.copies} {layout:9s} {name:7s} join={joins[name]:10s} "
                f"median={statistics.median(times[name]):.2f}s",
                flush=True,
            )
        print(f"x{args.copies} {layout:9s} same result: {results['shipped'] == results['plain']}")


if __name__ == "__main__":
    main()
