"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector of integers, for each term its weight times its
damped count; an item is a vector of its terms' counts; the score is their inner
product.  Each partition builds ball trees over some thousands of documents at a
time: a node has the centroid of its documents and their largest distances from
it, one for each of ``BALLS`` groups of terms.  By Cauchy and Schwarz, no document
of a node scores more than the item's product with the centroid plus, in each
group, its norm times that distance.  Nodes are taken from the highest bound
down; once the bound of the next is below the item's ``k``-th best score, the rest
of the tree is left.  Bounds are made in doubles and rounded up by more than
their error; leaves are scored in integers, so the result is exact.  An item's
best scores go on from tree to tree of a task; the tasks' lists are merged.

Items come in blocks of bounded size, each searched against all documents in
two passes, for the counts of its terms and for the scores.  What the driver gets
is a block's items and one count a term; what tasks send is ``k`` rows an item.

Defined results: a text that is null or has no term is no document of the
statistics; rows that repeat a doc_id are documents of their own, and rows that
repeat an item_id items of their own; a null doc_id comes after all others of its
score; an item without terms or without documents has no rows; very long texts
are read in runs of words; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Characters of items that are searched at once.
BLOCK_CHARS = 1 << 18
# Documents of a tree and of a leaf, postings of a tree, numbers of its centroids.
TREE_DOCS, LEAF_DOCS = 4096, 16
TREE_POSTINGS, TREE_CELLS = 1 << 21, 1 << 24
# Groups of terms with a radius of their own.
BALLS = 1024
# Bytes of text that are split into words at once.
RUN_BYTES = 4 << 20
# More than the relative error of sums of products in doubles.
SLACK = 2.0**-36


def _lowered() -> bytes:
    kept = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    out = bytearray(b" " * 256)
    for b in kept:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


LOWERED = _lowered()


def term_runs(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time: ASCII letters and digits and all beyond ASCII."""
    raw = (text or "").encode().translate(LOWERED)
    first = 0
    while first < len(raw):
        last = raw.find(b" ", first + RUN_BYTES)
        last = len(raw) if last < 0 else last
        yield raw[first:last].split()
        first = last


def postings(text: str | None, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """``(terms with repeats, numbers of the vocabulary's terms, their counts)`` of a text."""
    length, found = 0, []
    for run in term_runs(text):
        length += len(run)
        ids = np.fromiter(map(vocabulary.get, run, repeat(-1)), dtype=np.int64, count=len(run))
        found.append(ids[ids >= 0])
    ids = np.concatenate(found) if found else np.empty(0, np.int64)
    numbers, counts = np.unique(ids, return_counts=True)
    return length, numbers, counts


class Items:
    """A block of items: their terms' numbers and counts."""

    def __init__(self, texts: list[str | None]):
        counted = [Counter(chain.from_iterable(term_runs(text))) for text in texts]
        terms = sorted(set().union(*counted))
        self.vocabulary = {term: i for i, term in enumerate(terms)}
        self.terms = [np.array([self.vocabulary[t] for t in c], dtype=np.int64) for c in counted]
        self.counts = [np.array([*c.values()], dtype=np.int64) for c in counted]


def _statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """``N``, ``L`` and the vocabulary's ``df``."""
    size = len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, words, df = 0, 0, np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                length, numbers, _ = postings(text.as_py(), items.vocabulary)
                documents += length > 0
                words += length
                df[numbers] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[-1, -2], seen]), pa.int64()),
                pa.array(np.concatenate([[documents, words], df[seen]]), pa.int64()),
            ],
            names=["term", "n"],
        )

    rows = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n"))
    counts = dict(rows.collect())
    df = np.array([counts.get(i, 0) for i in range(size)], dtype=np.int64)
    return counts.get(-1, 0), counts.get(-2, 0), df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64
    )


class BallTree:
    """Sparse documents (``starts`` of their runs of ``terms`` and ``values``) in nested balls.

    No document may be without terms.  ``size``: number of terms there can be.
    """

    def __init__(self, starts, terms, values, size: int, leaf: int = LEAF_DOCS, balls: int = BALLS):
        self.present, terms = np.unique(terms, return_inverse=True)
        self.ball = self.present % balls
        self.balls, self.leaf = balls, leaf
        self.column = np.full(size, -1, dtype=np.int64)
        self.column[self.present] = np.arange(len(self.present))
        lengths = np.diff(starts)
        self.order = np.arange(len(lengths))
        self.ranges, self.children, self.centroids, self.radii = [], [], [], []
        self._lengths, self._starts, self._terms, self._values = lengths, starts[:-1], terms, values
        todo = [(0, len(lengths), -1)]
        while todo:
            first, last, parent = todo.pop()
            node = len(self.ranges)
            if parent >= 0:
                self.children[parent].append(node)
            middle = self._add(first, last)
            if middle is not None:
                todo += [(middle, last, node), (first, middle, node)]
        at, own = self._gather(0, len(lengths))
        self.terms, self.values = self.present[terms[at]], values[at]
        self.starts = np.concatenate([[0], np.cumsum(lengths[self.order])])
        self.centroids, self.radii = np.array(self.centroids), np.array(self.radii)

    def _gather(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents of a node, and to which of them each belongs."""
        docs = self.order[first:last]
        lengths = self._lengths[docs]
        before = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(self._starts[docs] - before, lengths)
        return at, np.repeat(np.arange(last - first), lengths)

    def _add(self, first: int, last: int) -> int | None:
        """A node for documents ``first`` to ``last`` of the order; where it is split."""
        at, own = self._gather(first, last)
        terms, values = self._terms[at], self._values[at].astype(np.float64)
        count, size = last - first, len(self.present)
        centroid = (np.bincount(terms, values, size) / count).astype(np.float32)
        there = centroid.astype(np.float64)
        # Squared distances in each ball: c * c, and x * x - 2 * x * c where x isn't 0.
        ball = own * self.balls + self.ball[terms]
        squares = np.bincount(ball, values * values, count * self.balls).reshape(count, -1)
        crossed = np.bincount(ball, values * there[terms], count * self.balls).reshape(count, -1)
        centre = np.bincount(self.ball, there * there, self.balls)
        apart = np.maximum(squares - 2 * crossed + centre, 0) + SLACK**1.2 * (squares + centre)
        self.ranges.append((first, last))
        self.children.append([])
        self.centroids.append(centroid)
        self.radii.append(np.sqrt(apart.max(axis=0)))
        if count <= self.leaf:
            return None
        # Halves along the line from the document farthest from the centroid to
        # that farthest from it.
        def products(vector):
            return np.bincount(own, values * vector[terms], count)

        norms = squares.sum(axis=1)
        ends = []
        vector = there
        for _ in range(2):
            far = int(np.argmax(norms - 2 * products(vector)))
            vector = np.zeros(size)
            vector[terms[own == far]] = values[own == far]
            ends.append(vector)
        along = products(ends[0]) - products(ends[1])
        self.order[first:last] = self.order[first:last][np.argsort(along, kind="stable")]
        return first + count // 2

    def bounds(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """No document of a node has a larger product with the item than this."""
        column = self.column[terms]
        column, counts, ball = column[column >= 0], counts[column >= 0], terms[column >= 0] % self.balls
        norms = np.sqrt(np.bincount(ball, counts.astype(np.float64) ** 2, self.balls))
        middle = self.centroids[:, column].astype(np.float64) @ counts
        out = (middle + self.radii @ norms) * (1 + SLACK)
        return out if len(column) else np.zeros(len(out))

    def search(self, terms: np.ndarray, counts: np.ndarray, dense: np.ndarray, best: list, k: int, keys) -> int:
        """Put the tree's documents among an item's ``best``, a heap of ``(score, -key)``.

        ``dense``: zeros, one for each term.  Returns how many leaves were scored.
        """
        bounds = self.bounds(terms, counts)
        dense[terms] = counts
        heap, scored = [(-bounds[0], 0)], 0
        while heap:
            bound, node = heapq.heappop(heap)
            worst = best[0][0] if len(best) == k else 1
            if -bound < worst * (1 - SLACK):
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            scored += 1
            first, last = self.ranges[node]
            a, b = self.starts[first], self.starts[last]
            scores = np.add.reduceat(dense[self.terms[a:b]] * self.values[a:b], self.starts[first:last] - a)
            for i in np.flatnonzero(scores >= worst).tolist():
                found = (int(scores[i]), -keys[self.order[first + i]])
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        dense[terms] = 0
        return scored


NO_ID = 1 << 63  # after every doc_id


def _searched(
    docs: DataFrame, items: Items, documents: int, words: int, df: np.ndarray, k: int
) -> DataFrame:
    """``item, doc_id, score`` of each task's best documents of each item."""
    size = len(items.vocabulary)
    weight = weights(documents, df)
    most_docs = max(LEAF_DOCS, min(TREE_DOCS, TREE_CELLS // (2 * max(1, size)) * LEAF_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in items.terms]
        dense = np.zeros(size, dtype=np.int64)
        keys, lengths, terms, values, held = [], [], [], [], 0

        def search() -> None:
            if not keys:
                return
            starts = np.concatenate([[0], np.cumsum(lengths)])
            tree = BallTree(starts, np.concatenate(terms), np.concatenate(values), size)
            for own, its_terms, counts in zip(best, items.terms, items.counts):
                if len(its_terms):
                    tree.search(its_terms, counts, dense, own, k, keys)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                length, numbers, tf = postings(text.as_py(), items.vocabulary)
                if not len(numbers):
                    continue
                m = 100 - 25 + 25 * length * documents // words
                keys.append(NO_ID if doc_id is None else doc_id)
                lengths.append(len(numbers))
                terms.append(numbers)
                values.append(weight[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m)))
                held += len(numbers)
                if len(keys) >= most_docs or held >= TREE_POSTINGS:
                    search()
                    keys, lengths, terms, values, held = [], [], [], [], 0
        search()
        rows = [(i, -key, score) for i, own in enumerate(best) for score, key in own]
        if rows:
            item, key, score = zip(*rows)
            ids = pa.array([None if x == NO_ID else x for x in key], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), ids, pa.array(score, pa.int64())],
                names=["item", "doc_id", "score"],
            )

    return docs.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` highest-scoring documents.

    ``docs`` is read twice for each block of items.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    blocks = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for number in range(blocks):
        rows = asked.where(dealt == number).collect()
        block = Items([r.text for r in rows])
        found = _searched(docs, block, *_statistics(docs, block), k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(i, r.item_id) for i, r in enumerate(rows)],
            f"item bigint, item_id {asked.schema['item_id'].dataType.simpleString()}",
        )
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


_TERMS = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


def ranked_sql(k: int = 20) -> str:
    """DuckDB SQL for ``ranked_search(documents, benchmark, k)``."""
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('text')} AS terms FROM documents
), items AS (
    SELECT row_number() OVER () AS i, item_id, {_TERMS.format('text')} AS terms FROM benchmark
), totals AS (
    SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM docs WHERE len(terms) > 0
), asked AS (
    SELECT i, term, count(*) AS q FROM (SELECT i, unnest(terms) AS term FROM items) GROUP BY ALL
), tf AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), w AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, totals GROUP BY term
), m AS (
    SELECT r, doc_id, 100 - 25 + (25 * len(terms) * docs) // words AS m FROM docs, totals WHERE len(terms) > 0
), scores AS (
    SELECT i, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r
), ranked AS (
    SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
    FROM scores JOIN m USING (r) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM ranked JOIN items USING (i) JOIN m USING (r) WHERE rank <= {k}
"""
