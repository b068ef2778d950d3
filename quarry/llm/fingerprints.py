"""Document fingerprints by MinHash.

A text's shingles of ``WIDTH`` words are hashed to 64 bits; ``PERMUTATIONS``
universal permutations ``a * x + b`` (a odd, modulo 2^64) of them each give 16
bits of a hash of the smallest value.  (Its own top bits are zeros in long texts,
whatever they say.)  The fingerprint is those in hexadecimal, and two
fingerprints' likeness, the part of places that agree, estimates the Jaccard
similarity of the texts' shingle sets.

``fingerprint_edits`` also compares every text with an edit of itself and with
its follower.  ``near_duplicates`` joins signature bands in Spark and verifies
the Jaccard similarity of the shingle sets themselves.

Defined results: a null text counts as empty; a text without words has the
fingerprint of all ``f``, which is like itself only; a text of fewer words than
a shingle is one shingle; equal texts have equal fingerprints, and repeated
rows their own rows; ``doc_id`` is a number, date or timestamp (others raise); rows
without one come first in the order of followers, rows of one doc_id follow each other by text; an empty table gives
no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import (
    materialize,
    mix,
    shingles,
    shuffle_partitions,
    temporary_tables,
    text_chunks,
)

WIDTH = 5
PERMUTATIONS = 128
BANDS = 32
SIMILARITY = 0.8
SEED = 1
# Up to so many ids (8 bytes each, counted first) are sent to every task rather
# than shuffling texts; more are joined by a shuffle, with the same result.
SENT_IDS = 1 << 20

# Shingles that one step permutes, so that they stay in a processor's cache.
_STEP = 1 << 15


def permutations(count: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends, from a hash of their numbers and the seed."""
    numbers = np.arange(2 * count, dtype=np.uint64) + np.uint64(seed << 32)
    drawn = mix(mix(numbers) + np.uint64(seed))
    return drawn[:count] | np.uint64(1), drawn[count:]


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts x permutations: 16 bits of a hash of the smallest permuted shingle."""
    factors, addends = permutations()
    out = np.full((len(counts), PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    first = 0
    while first < len(full):
        begin = int(ends[first] - counts[full[first]])
        last = max(first + 1, int(np.searchsorted(ends, begin + _STEP, side="right")))
        x = hashes[begin : int(ends[last - 1])]
        starts = ends[first:last] - counts[full[first:last]] - begin
        least = np.empty((PERMUTATIONS, last - first), dtype=np.uint64)
        for k in range(PERMUTATIONS):
            np.minimum.reduceat(x * factors[k] + addends[k], starts, out=least[k])
        out[full[first:last]] = (mix(least) >> np.uint64(48)).T
        first = last
    return out


def of_texts(texts: pa.Array) -> np.ndarray:
    """Signatures of an Arrow string array."""
    parts = [
        signatures(*shingles(data, offsets, WIDTH))
        for _, _, data, offsets in text_chunks(texts)
    ]
    return np.concatenate(parts) if parts else np.empty((0, PERMUTATIONS), np.uint16)


def as_hex(signature: np.ndarray) -> pa.Array:
    digits = signature.astype(">u2").tobytes().hex().encode()
    width = 4 * PERMUTATIONS
    offsets = np.arange(0, len(digits) + 1, width, dtype=np.int32)
    return pa.StringArray.from_buffers(
        len(signature), pa.py_buffer(offsets.tobytes()), pa.py_buffer(digits)
    )


def _bounds_passed(bounds: list, kind) -> F.Column:
    """How many of the ascending ``bounds`` ``doc_id`` has reached, by every n-th of them and
    then the n from there; none for a null."""
    step = max(1, math.isqrt(len(bounds)))

    def reached(some: F.Column) -> F.Column:
        return F.size(F.filter(some, lambda b: b <= F.col("doc_id")))

    def listed(some: list) -> F.Column:
        return F.array(*[F.lit(b) for b in some]).cast(f"array<{kind.simpleString()}>")

    coarse = reached(listed(bounds[step - 1 :: step])) * step
    return coarse + reached(F.slice(listed(bounds), coarse + 1, step))


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows in buckets by ranges of ``doc_id``, each sorted inside and followed by
    the row after its last (``extra`` 1; the first row of all after the last).

    The ranges' bounds are values of the column, so each bound is its bucket's
    first value; they are as many as there are shuffle partitions, times four.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    wanted = min(4 * shuffle_partitions(spark), 8192)
    found = rows.agg(
        F.percentile_approx("doc_id", [(i + 1) / wanted for i in range(wanted - 1)] or [0.5], 20 * wanted).alias("at"),
        F.min("doc_id").alias("least"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    bounds = sorted({b for b in found["at"] or [] if b != found["least"] or found["nulls"]})
    kind = docs.schema[doc_id].dataType
    if bounds:
        bucket = _bounds_passed(bounds, kind)
        after = (
            rows.where(F.col("doc_id").isin(bounds))
            .groupBy("doc_id")
            .agg(F.min("text").alias("text"))
            .select((bucket - 1).alias("bucket"), F.lit(1).alias("extra"), "doc_id", "text")
        )
    else:
        bucket = F.lit(0)
        after = None
    least = F.col("doc_id").isNull() if found["nulls"] else F.col("doc_id") == F.lit(found["least"])
    first = rows.where(least).groupBy("doc_id").agg(F.min("text").alias("text"))
    parts = rows.select(bucket.alias("bucket"), F.lit(0).alias("extra"), "doc_id", "text").unionByName(
        first.select(F.lit(len(bounds)).alias("bucket"), F.lit(1).alias("extra"), "doc_id", "text")
    )
    if after is not None:
        parts = parts.unionByName(after)
    return parts.repartition("bucket").sortWithinPartitions(
        "bucket", "extra", F.asc_nulls_first("doc_id"), "text"
    )


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row its fingerprint, that of its edited text, and both likenesses.

    The edited text ends, for its last ``floor(n_chars / 2)`` code points, in as
    many (or all) of the first code points of the next text by ``doc_id``.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the row whose follower isn't known yet
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if batch.num_rows:
                for first, last, _, _ in text_chunks(batch.column(3)):
                    # One row more than the chunk: the last row's follower.
                    piece = batch.slice(first, last - first + 1)
                    if piece.num_rows > 1:
                        yield from compare(piece)
                held = batch.slice(batch.num_rows - 1)

    def compare(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bucket, extra = piece.column(0).to_numpy(), piece.column(1).to_numpy()
        at = np.flatnonzero((extra[:-1] == 0) & (bucket[:-1] == bucket[1:]))
        if not len(at):
            return
        texts = piece.column(3).to_pylist()
        own = of_texts(piece.column(3))
        edited, lengths = [], []
        for i in at:
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            lengths.append(len(texts[i]))
        changed = of_texts(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                piece.column(2).take(pa.array(at)),
                pa.array(lengths, pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                as_hex(own[at]),
                as_hex(changed),
                pa.array((own[at] == changed).mean(axis=1)),
                pa.array((own[at] == own[at + 1]).mean(axis=1)),
            ],
            names=[
                "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                "near_edited", "near_next",
            ],
        )

    return in_order(docs, doc_id, text).mapInArrow(
        run,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, k, k2, n, bands``: two hashes and the size of a text's set of distinct
    shingles, and a hash a signature band (none without words)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    salt, numbers = np.uint64(0xD6E8FEB86659FD93), np.arange(BANDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                hashes, counts = shingles(data, offsets, WIDTH)
                rows = signatures(hashes, counts).astype(np.uint64).reshape(len(counts), BANDS, -1)
                keys = np.tile(numbers, (len(counts), 1))
                for j in range(rows.shape[2]):
                    keys = mix(keys + rows[:, :, j])
                ends = np.cumsum(counts)
                sets = [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts, strict=True)]
                k = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                k2 = np.array([mix(s ^ salt).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                places = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(k.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                        pa.array(n),
                        pa.ListArray.from_arrays(
                            pa.array(places), pa.array(keys[n > 0].reshape(-1).view(np.int64))
                        ),
                    ],
                    names=["doc_id", "k", "k2", "n", "bands"],
                )

    source = docs.select(F.col(doc_id).alias("doc_id"), text)
    return source.mapInArrow(
        run, f"doc_id {kind}, k bigint, k2 bigint, n bigint, bands array<bigint>"
    )


def shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``first, shingles``: the sets of the texts that ``wanted`` names (``doc_id, k``)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                hashes, counts = shingles(data, offsets, WIDTH)
                ends = np.cumsum(counts)
                sets = [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts, strict=True)]
                k = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                places = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(k.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(places), pa.array(flat)),
                    ],
                    names=["doc_id", "k", "shingles"],
                )

    ids = wanted.select("first.doc_id").distinct()
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    source = docs.select(F.col(doc_id).alias("doc_id"), text).join(ids, "doc_id", "left_semi")
    found = source.mapInArrow(run, f"doc_id {kind}, k bigint, shingles array<bigint>")
    # Other texts of a doc_id aren't wanted; rows that repeat one are one.
    return (
        found.select(F.struct("doc_id", "k").alias("first"), "shingles")
        .join(wanted, "first", "left_semi")
        .dropDuplicates(["first"])
    )


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    doc_id: str = "doc_id",
    text: str = "text",
    every: bool = False,
) -> DataFrame:
    """``doc_id, class_id``: the smallest id that verified links lead to.

    Texts of equal shingle sets are one, and only those that share a band with
    another are read again for their sets.  They meet the band's smallest first, so
    a group of near copies costs as many comparisons as it has members and bands.
    Then those of a band that are still in different components all meet, as far as
    their sizes allow a link.  So no link of two texts that share a band is lost.
    Rows without a doc_id or without words take no part: they have no row, or with
    ``every`` one whose class is their own doc_id.
    """
    from quarry.llm.components import connected_components

    def alike(m, n) -> F.Column:
        return F.least(m, n) >= F.lit(similarity) * F.greatest(m, n)

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select("first", F.col("shingles").alias("x"))
        y = sets.select(F.col("first").alias("other"), F.col("shingles").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        return materialize(
            pairs.join(x, "first").join(y, "other")
            .where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared))
            .select(F.col("first").alias("a"), F.col("other").alias("b"))
        )

    with temporary_tables() as keep:
        known = keep(materialize(sketches(docs, doc_id, text)))
        firsts = materialize(
            known.where("n > 0 and doc_id is not null")
            .groupBy("k", "k2", "n")
            .agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
            .select(F.struct("doc_id", "k").alias("first"), "k", "k2", "n", "bands")
        )
        banded = firsts.select("first", "n", F.explode("bands").alias("key"))
        met = banded.groupBy("key").agg(
            F.min(F.struct(F.col("first").alias("other"), F.col("n").alias("m"))).alias("least"),
            F.count("*").alias("many"),
        )
        met = materialize(met.where("many > 1").select("key", "least.other", "least.m"))
        lists = materialize(banded.join(met, "key"))
        sets = materialize(
            shingle_sets(docs, materialize(lists.select("first").distinct()), doc_id, text)
        )
        star = lists.where((F.col("first") != F.col("other")) & alike("n", "m"))
        links = verified(star.select("first", "other").distinct(), sets)
        # Then all pairs of a band that are in different components.
        own = connected_components(links).select(F.col("node").alias("first"), "component")
        lists = materialize(
            lists.select("key", "first", "n")
            .join(own, "first", "left")
            .withColumn("component", F.coalesce("component", "first"))
        )
        mixed = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        mixed = materialize(mixed.where("lo != hi").select("key"))
        lists = materialize(lists.join(mixed, "key", "left_semi"))
        rest = (
            lists.alias("a")
            .join(lists.alias("b"), "key")
            .where(
                (F.col("b.first") < F.col("a.first"))
                & (F.col("a.component") != F.col("b.component"))
                & alike("a.n", "b.n")
            )
            .select(F.col("a.first").alias("first"), F.col("b.first").alias("other"))
            .distinct()
        )
        found = connected_components(links.unionByName(verified(rest, sets)))
        label = keep(materialize(
            firsts.join(found.select(F.col("node").alias("first"), "component"), "first", "left")
            .select("k", "k2", "n", F.coalesce("component", "first")["doc_id"].alias("class_id"))
        ))
    taking = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    rows = known.select("doc_id", "k", "k2", "n")
    rows = rows if every else rows.where(taking)
    class_id = F.when(taking, F.col("class_id")).otherwise(F.col("doc_id"))
    return rows.join(label, ["k", "k2", "n"], "left").select("doc_id", class_id.alias("class_id"))
