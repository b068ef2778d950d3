"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reached) of every node of ``links`` (``a, b``).

    Each round links every node's larger neighbours to its smallest neighbour,
    then its smaller neighbours, until nothing changes; links never become
    more.  Rounds are cut by tables in the shared folder, and a round's tables
    removed after the next.  The least neighbours are tables as well: a join of two
    tables lets Spark split the links of a hub over many tasks.
    """
    now = materialize(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while True:
        # Large star: neighbours larger than a node go to its least neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        # Small star: a node and its smaller neighbours go to the least of them.
        large = materialize(large.distinct())
        discard(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u != v")
            .distinct()
        )
        small = materialize(small)
        # Done when each node has one link, to a node that has none upwards.
        roots = small.select(F.col("v").alias("u")).distinct()
        deep = small.join(roots, "u", "left_semi").limit(1).count()
        split = small.groupBy("u").count().where("count > 1").limit(1).count()
        discard(now, large, least)
        now = small
        if not deep and not split:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
