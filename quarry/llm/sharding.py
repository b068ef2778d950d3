"""Shards balanced in bytes, tokens and rows at once, by vector bin packing.

Rows of equal text form a group, and a group stays together.  Groups go
heaviest first to the shard for which the dot product of the group's size
vector (bytes, tokens, rows, each as a part of the shard's share) with the
shard's residual capacity vector is highest.

At scale no task sees all groups:

* The heaviest items, as many classes of weight (eight to a power of two) as
  together hold at most ``TOP`` items, are placed on the driver.
* The others are dealt by coarser weight class and hash into cells of about
  ``CELL`` items.  Each cell is packed in a task of its own into the capacity
  that the heaviest left.
* Only a group of more bytes than a shard's share can't stay together in shards
  of near-equal bytes; it is split by a hash of ``doc_id`` into parts of about a
  quarter of a share.  All others are placed whole, however many rows they have.

Rows are numbered inside their part, parts inside their cell and shard, cells
inside their shard, so that slots need no sort of a whole shard.  A group above a
quarter of a shard's share of rows or bytes (there are at most ``8 * shards``,
hence the broadcast) is numbered in several tasks, by another hash of ``doc_id``.

Defined results: a null text counts as the empty text; repeated rows and rows
without a doc_id get slots of their own; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

TOP = 4096
CELL = 4096
# Classes of weight to a power of two, and powers of two to a cell's class.
STEPS = 8
OCTAVES = 4
PARTS_A_SHARD = 4
# Bytes count most in the dot product: theirs is the law that must hold.
IMPORTANCE = (64.0, 1.0, 1.0)
ROW_BYTES = 16

_ITEM = ("text_hash", "text_crc32", "size", "part")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, text_crc32, size, tokens`` of every row; no text is shuffled.

    Size: UTF-8 bytes and ``ROW_BYTES``.  Tokens: words between white space.
    Equal texts are told by hash, checksum and size together.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(whole).alias("text_hash"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        (F.octet_length(whole) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.regexp_count(whole, F.lit(r"\S+")).cast("bigint").alias("tokens"),
    )


def place(items: np.ndarray, residual: np.ndarray, first: int) -> np.ndarray:
    """Shard of each item (rows of ``items``), in the order given.

    ``residual``: shards x measures, in the items' units; changed in place.  A shard
    that a group filled with tokens or rows beyond its share has no room for more,
    but no debt that would keep it short of bytes.  Ties go to the lowest shard
    counted from ``first``.
    """
    out = np.empty(len(items), dtype=np.int64)
    shards = len(residual)
    turned = np.roll(residual, -first, axis=0)
    room = turned.copy()
    room[:, 1:] = np.maximum(room[:, 1:], 0)
    for i, (item, weighted) in enumerate(zip(items, items * IMPORTANCE, strict=True)):
        best = int(np.argmax(room @ weighted))
        turned[best] -= item
        room[best, 0] = turned[best, 0]
        room[best, 1:] = np.maximum(turned[best, 1:], 0)
        out[i] = (best + first) % shards
    residual[:] = np.roll(turned, first, axis=0)
    return out


def _weights(frame: pd.DataFrame, total: np.ndarray) -> np.ndarray:
    """Items x (bytes, tokens, rows), as parts of the whole input."""
    n = frame["n"].to_numpy(dtype=np.float64)
    own = np.column_stack(
        [n * frame["size"].to_numpy(), n * frame["tokens"].to_numpy(), n]
    )
    return own / total


def vector_pack(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (as ``measured`` gives them) with ``shard`` and ``slot``.

    ``rows`` is read several times; give a table, not a long plan.
    """
    whole = rows.agg(
        F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t")
    ).first()
    n, total_bytes = int(whole["n"]), int(whole["b"] or 0)
    total = np.maximum([total_bytes, int(whole["t"] or 0), n], 1).astype(np.float64)
    group = ["text_hash", "text_crc32", "size"]
    by_bytes = F.col("n") * F.col("size") * shards / F.lit(float(max(total_bytes, 1)))
    by_rows = F.col("n") * shards / F.lit(float(max(n, 1)))
    parts = F.when(by_bytes > 1, F.ceil(by_bytes * PARTS_A_SHARD)).otherwise(F.lit(1))
    deals = F.ceil(F.greatest(by_rows, by_bytes) * PARTS_A_SHARD / F.col("parts"))
    heavy = rows.groupBy(*group).agg(F.count("*").alias("n")).withColumn("parts", parts)
    heavy = heavy.withColumn("deals", deals).where("n > 1 and (parts > 1 or deals > 1)")
    heavy = materialize(heavy.select(*group, "parts", "deals").coalesce(1))
    split = rows.join(F.broadcast(heavy), group, "left").withColumns({
        "part": F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int"),
        "deal": F.coalesce(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("deals")), F.lit(0)).cast("int"),
    })
    dealt_rows = materialize(
        split.groupBy(*_ITEM, "deal").agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"))
    )
    items = materialize(
        dealt_rows.groupBy(*_ITEM).agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"))
    )
    measures = zip(IMPORTANCE, (F.col("size"), F.col("tokens"), F.lit(1)), total, strict=True)
    share = sum(F.col("n") * m * F.lit(w / sum(IMPORTANCE) / float(t)) for w, m, t in measures)
    items = items.withColumn("share", share)

    # The heaviest, on the driver; a count for each class of weight tells which.
    items = items.withColumn("kind", F.floor(-F.log2("share") * STEPS).cast("int"))
    counts = sorted((r["kind"], r["count"]) for r in items.groupBy("kind").count().collect())
    held, cut = 0, -1
    for kind, count in counts:
        if held + count > TOP:
            break
        held, cut = held + count, kind
    top = items.where(F.col("kind") <= cut).drop("kind").toPandas()
    top = top.sort_values(["share", *_ITEM], ascending=[False, True, True, True, True])
    top = top.reset_index(drop=True)
    capacity = np.full((shards, 3), 1.0 / shards)
    top["shard"] = place(_weights(top, total), capacity, 0)
    top["start"] = top.groupby("shard")["n"].cumsum() - top["n"]
    top["cell"] = -1
    columns = [*_ITEM, "cell", "shard", "start", "n"]
    kinds = (
        "text_hash bigint, text_crc32 bigint, size bigint, part int, cell bigint, shard int, "
        "start bigint, n bigint"
    )
    spark = rows.sparkSession
    placed = spark.createDataFrame(
        [tuple(int(v) for v in r) for r in top[columns].itertuples(index=False)], kinds
    )

    # The others, cell by cell, into what is left.
    rest = items.where(F.col("kind") > cut).withColumn(
        "kind", F.floor(F.col("kind") / (STEPS * OCTAVES)).cast("int")
    )
    cells: dict[int, int] = {}
    for kind, count in counts:
        if kind > cut:
            coarse = kind // (STEPS * OCTAVES)
            cells[coarse] = cells.get(coarse, 0) + count
    cells = {kind: -(-count // CELL) for kind, count in cells.items()}
    left = np.maximum(capacity, 0.0)
    left = left / np.maximum(left.sum(axis=0), 1e-300)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["share", *_ITEM], ascending=[False, True, True, True, True])
        cell = cell.reset_index(drop=True)
        weights = _weights(cell, total)
        residual = left * weights.sum(axis=0)
        cell["shard"] = place(weights, residual, int(cell["cell"].iloc[0]) % shards)
        cell["start"] = cell.groupby("shard")["n"].cumsum() - cell["n"]
        return cell[columns]

    if cells:
        per_kind = F.create_map(*[F.lit(int(x)) for kv in cells.items() for x in kv])
        dealt = rest.withColumn(
            "cell",
            F.col("kind").cast("bigint") * F.lit(1 << 40)
            + F.pmod(F.xxhash64(*_ITEM), per_kind[F.col("kind")]),
        )
        placed = placed.unionByName(dealt.groupBy("cell").applyInPandas(run, kinds))
    placed = materialize(placed)

    in_shard = Window.partitionBy("shard").orderBy("cell")
    offsets = (
        placed.groupBy("shard", "cell")
        .agg(F.sum("n").alias("n"))
        .select("shard", "cell", (F.sum("n").over(in_shard) - F.col("n")).alias("offset"))
    )
    started = placed.join(offsets, ["shard", "cell"]).select(
        *_ITEM, "shard", (F.col("offset") + F.col("start")).alias("start")
    )
    in_item = Window.partitionBy(*_ITEM).orderBy("deal")
    started = dealt_rows.withColumn("before", F.sum("n").over(in_item) - F.col("n")).join(
        started, [*_ITEM]
    ).select(*_ITEM, "deal", "shard", (F.col("start") + F.col("before")).alias("start"))
    in_deal = Window.partitionBy(*_ITEM, "deal").orderBy("doc_id")
    numbered = split.withColumn("rank", F.row_number().over(in_deal) - 1)
    return numbered.join(started, [*_ITEM, "deal"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``."""
    return vector_pack(materialize(measured(docs)), shards)
