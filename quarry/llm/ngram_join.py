"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when their sets of distinct ``WIDTH``-word shingles have a
Jaccard similarity of at least ``PERCENT`` hundredths.  Then each holds at least
``a = ceil(PERCENT * n / 100)`` of the other's ``n`` shingles, and under one
order of all shingles their prefixes of ``n - a + l`` share at least ``l``: the
longer the prefix, the more shared tokens a candidate needs.

1. Texts of equal sets are one set, known by its hash.
2. Reduction.  Prefixes in hash order with ``l`` in proportion to the set; a set
   that has fewer than ``l`` prefix tokens in common with any other set links
   to none.  Tokens in 1 / ``COMMON`` of all sets or more, which are few, are told
   in the scan and aren't shuffled.
3. Of the sets left, shingles that no other of them has are dropped, and the
   rest are ordered by frequency, rarest first.  A set whose rest is smaller
   than ``a`` links to none.  Each set chooses the ``l`` from 1 to ``LONGEST`` for
   which its tokens' frequencies promise the fewest candidates.
4. Every posting list is first compared with one of its own sets, that with the
   fewest shingles of its own, so a group of near copies becomes one component
   with as many comparisons as it has members.
5. Pairs of a list that are still in different components meet if the token is in
   the prefixes that their two sizes ask for, and are compared if they share as
   many tokens as the smaller of their ``l`` in prefixes longer by it.  Nothing is
   capped, so no link between components is lost.

Shingles are 64-bit hashes; similarity is computed from whole sets of them.

Defined results: texts without words (null, empty, white space) have no
shingles and are their own component; a text of fewer words than a shingle is
one shingle; repeated rows are one class, and rows of one doc_id with different
texts are classes of their own, of which two can have the same label; rows without a doc_id get their
number of shingles and no component; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import (
    AS_IS,
    LOWER,
    materialize,
    mix,
    runs,
    shingles,
    temporary_tables,
    text_chunks,
)
from quarry.llm.components import connected_components

WIDTH = 4
PERCENT = 85
LONGEST = 4
# The reduction's l is this part of a set; a token in 1 / COMMON of all sets is
# common.  Sets that a task remembers so as not to send one twice.
REDUCE = 8
COMMON = 250
REMEMBERED = 1 << 20
# Bytes of text that are hashed at a time; the arrays take about 40 times as much.
HASHED_BYTES = 1 << 19
# Up to so many ids (8 bytes each, counted first) are sent to every task rather
# than shuffling texts; more are joined by a shuffle, with the same result.
SENT_IDS = 1 << 20


def overlap(n, percent: int):
    """Least number of shared shingles of a set of ``n`` in a link."""
    least = n * percent + 99
    return F.floor(least / 100) if isinstance(n, Column) else least // 100


def _sets(column, width: int, fold: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of rows, each with its texts' sorted distinct shingles."""
    for first, last, data, offsets in text_chunks(column):
        sets = []
        for _, _, part, own in runs(data, offsets, HASHED_BYTES):
            hashes, counts = shingles(part, own, width, fold)
            ends = np.cumsum(counts)
            sets += [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts, strict=True)]
        yield first, last, sets


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def described(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, lower: bool) -> DataFrame:
    """A row a text: ``doc_id, n``, the set's hashes ``k, k2``, its reduction prefix
    ``tokens`` (none if the task has sent that set) and, in some rows, the tokens
    ``common`` to many sets of a run, with their counts in ``times``."""
    fold = LOWER if lower else AS_IS
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for first, last, sets in _sets(batch.column(1), width, fold):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                k = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                salt = np.uint64(0xD6E8FEB86659FD93)
                k2 = np.array([mix(s ^ salt).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                tokens = []
                for i, s in enumerate(sets):
                    name = (int(k[i]), int(k2[i]))
                    if name in sent or not len(s):
                        tokens.append(s[:0])
                        continue
                    sent.add(name)
                    need = overlap(len(s), percent)
                    tokens.append(s[: len(s) - need + max(1, len(s) // REDUCE)])
                if len(sent) > REMEMBERED:
                    sent = set()
                flat = np.concatenate(tokens)
                lengths = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                new = sum(1 for t in tokens if len(t))
                values, times = np.unique(flat, return_counts=True)
                many = times >= max(8, new / (2 * COMMON))
                once = np.zeros(len(sets) + 1, dtype=np.int32)
                once[1:] = int(many.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(n),
                        _signed(k),
                        _signed(k2),
                        pa.ListArray.from_arrays(pa.array(lengths), _signed(flat)),
                        pa.ListArray.from_arrays(pa.array(once), _signed(values[many])),
                        pa.ListArray.from_arrays(pa.array(once), pa.array(times[many])),
                    ],
                    names=["doc_id", "n", "k", "k2", "tokens", "common", "times"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, n bigint, k bigint, k2 bigint, tokens array<bigint>, "
        "common array<bigint>, times array<bigint>",
    )


def shared_tokens(rows: DataFrame) -> DataFrame:
    """``k, shared``: the prefix tokens of each set that another set's prefix has too."""
    sets = rows.where(F.size("tokens") > 0).count()
    common = (
        rows.where(F.size("common") > 0)
        .select(F.explode(F.arrays_zip("common", "times")).alias("c"))
        .groupBy(F.col("c.common").alias("t"))
        .agg(F.sum("c.times").alias("times"))
        .where(F.col("times") >= max(8.0, sets / COMMON))
        .select("t")
    )
    # At most COMMON times as many as a prefix is long on average, at any input
    # size; and only a shuffle is saved by them, no token is left out.
    common = F.broadcast(materialize(common))
    postings = rows.select("k", F.explode("tokens").alias("t"))
    own_list = Window.partitionBy("t")
    rare = (
        postings.join(common, "t", "left_anti")
        .withColumn("least", F.min("k").over(own_list))
        .withColumn("most", F.max("k").over(own_list))
        .where("least != most")
        .select("k", "t")
    )
    both = rare.unionByName(postings.join(common, "t", "left_semi").select("k", "t"))
    return both.distinct().groupBy("k").agg(F.count("*").alias("shared"))


def survivors(docs: DataFrame, classes: DataFrame, rows: DataFrame, p: dict) -> DataFrame:
    """``rep, n, s``: classes that may link, with their whole sets.

    ``rep`` is the class's smallest doc_id and its set's hash, since one doc_id can
    be the smallest of several classes.
    """
    need = F.greatest(F.lit(1), F.floor(overlap(F.col("n"), p["percent"]) / REDUCE))
    kept = (
        classes.join(shared_tokens(rows), "k").where(F.col("shared") >= need).select("rep", "k")
    )
    kept = materialize(kept)
    if kept.count() <= SENT_IDS:
        kept = F.broadcast(kept)
    wanted = docs.select(
        F.col(p["doc_id"]).alias("rep"), F.col(p["text"]).alias("text")
    ).join(kept.select("rep"), "rep", "left_semi")
    kind = docs.schema[p["doc_id"]].dataType.simpleString()
    fold = LOWER if p["lower"] else AS_IS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in _sets(batch.column(1), p["width"], fold):
                k = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                lengths = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        _signed(k),
                        pa.ListArray.from_arrays(pa.array(lengths), _signed(np.concatenate(sets))),
                    ],
                    names=["rep", "k", "s"],
                )

    found = wanted.mapInArrow(run, f"rep {kind}, k bigint, s array<bigint>")
    # Other texts of a doc_id aren't the class's; rows that repeat one are.
    found = found.join(kept, ["rep", "k"], "left_semi").dropDuplicates(["rep", "k"])
    return found.select(F.struct("rep", "k").alias("rep"), F.size("s").cast("bigint").alias("n"), "s")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``rep, n, m, l, prefix``: ``m`` shingles that others have too, rarest first in the
    adaptive prefix, and the ``l`` shared tokens that its length asks for."""
    entries = sets.select("rep", F.explode("s").alias("t"))
    # Counted and joined back, as a table: a token of many sets is split over tasks.
    times = materialize(entries.groupBy("t").agg(F.count("*").alias("f")).where("f > 1"))
    counted = entries.join(times, "t")
    rest = (
        counted.groupBy("rep")
        .agg(F.count("*").alias("m"), F.sort_array(F.collect_list(F.struct("f", "t"))).alias("e"))
        .join(sets.select("rep", "n"), "rep")
        .withColumn("spare", F.col("m") - overlap(F.col("n"), percent))
        .where("spare >= 0")
    )
    # Sum over the prefix of its lists' lengths, for each candidate asked to
    # share l of them: at most that sum over l can.
    costs = [
        F.when(
            F.col("spare") + i <= F.col("m"),
            F.struct(
                (
                    F.aggregate(
                        F.slice("e", 1, (F.col("spare") + i).cast("int")),
                        F.lit(0.0),
                        lambda total, x: total + (x["f"] - 1),
                    )
                    / i
                ).alias("cost"),
                F.lit(i).alias("l"),
            ),
        )
        for i in range(1, LONGEST + 1)
    ]
    best = rest.withColumn("l", F.array_min(F.array(*costs))["l"]).where("l is not null")
    prefix = F.slice("e", 1, (F.col("spare") + F.col("l")).cast("int"))
    return best.select("rep", "n", "m", "l", F.transform(prefix, lambda x: x["t"]).alias("prefix"))


def _spare(a: str, b: str, side: str, percent: int) -> Column:
    """Tokens of ``side`` that a link of this pair can do without.

    Sizes na and nb need an overlap of ``percent * (na + nb) / (100 + percent)``,
    which is more than either needs with its smallest partner, so the pair's
    prefixes are shorter than those that the sets are listed with.
    """
    both = (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent
    return F.col(f"{side}.m") - F.ceil(both / (100 + percent))


def _meet(a: str, b: str, percent: int) -> Column:
    """The token is in both sets' shortest prefix for this pair, and the sizes allow a link."""
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    for side in (a, b):
        sizes = sizes & (F.col(f"{side}.at") <= _spare(a, b, side, percent))
    return sizes


def multi_matched(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` that share ``l`` tokens in prefixes longer by ``l - 1``,
    ``l`` being the smaller that the two sets chose."""
    x = known.select(F.col("rep").alias("a"), F.struct("n", "m", "l", "prefix").alias("x"))
    y = known.select(F.col("rep").alias("b"), F.struct("n", "m", "l", "prefix").alias("y"))
    least = F.least("x.l", "y.l")
    own = [
        F.slice(f"{side}.prefix", 1, (_spare("x", "y", side, percent) + least).cast("int"))
        for side in ("x", "y")
    ]
    return (
        pairs.join(x, "a")
        .join(y, "b")
        .where(F.size(F.array_intersect(*own)) >= least)
        .select("a", "b")
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose whole sets are similar."""
    x = sets.select(F.col("rep").alias("a"), F.col("s").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("s").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(x, "a")
        .join(y, "b")
        .where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent)
        .select("a", "b")
    )


def links(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect what any links connect."""
    known = materialize(prefixes(sets, percent))
    lists = known.select("rep", "n", "m", F.posexplode("prefix").alias("at", "t"))
    # With one set of each list: that which has most in common with others.
    pick = F.struct((F.col("m") / F.col("n")).alias("part"), "rep", "n", "m", "at")
    pivots = lists.groupBy("t").agg(F.max(pick).alias("p"), F.count("*").alias("many"))
    pivots = materialize(pivots.where("many > 1").select("t", "p.rep", "p.n", "p.m", "p.at"))
    pair = (F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"))
    first = (
        lists.alias("a")
        .join(pivots.alias("b"), "t")
        .where((F.col("a.rep") != F.col("b.rep")) & _meet("a", "b", percent))
        .select(*pair)
        .distinct()
    )
    first = materialize(multi_matched(first, known, percent))
    first = materialize(verified(first, sets, percent))
    component = connected_components(first).select(F.col("node").alias("rep"), "component")
    # Then all pairs of a list that are in different components.
    lists = materialize(
        lists.join(component, "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
    )
    mixed = lists.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_lists = materialize(
        lists.join(materialize(mixed.where("lo != hi").select("t")), "t", "left_semi")
    )
    second = (
        open_lists.alias("a")
        .join(open_lists.alias("b"), "t")
        .where(
            (F.col("a.rep") < F.col("b.rep"))
            & (F.col("a.component") != F.col("b.component"))
            & _meet("a", "b", percent)
        )
        .select(*pair)
        .distinct()
    )
    second = materialize(multi_matched(second, known, percent))
    return first.unionByName(verified(second, sets, percent))


def ngram_components(
    docs: DataFrame,
    percent: int = PERCENT,
    width: int = WIDTH,
    lower: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    p = {"percent": percent, "width": width, "lower": lower, "doc_id": doc_id, "text": text}
    with temporary_tables() as keep:
        rows = keep(materialize(described(docs, doc_id, text, width, percent, lower)))
        classes = materialize(
            rows.where("n > 0 and doc_id is not null")
            .groupBy("k", "k2", "n")
            .agg(F.min("doc_id").alias("rep"))
        )
        sets = materialize(survivors(docs, classes, rows, p))
        found = connected_components(links(sets, percent))
        labelled = keep(materialize(
            classes.join(
                found.select("node.rep", "node.k", F.col("component.rep").alias("component")),
                ["rep", "k"],
                "left",
            ).select("k", "k2", "n", F.coalesce("component", "rep").alias("component"))
        ))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        rows.select("doc_id", "n", "k", "k2")
        .join(labelled, ["k", "k2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    )
