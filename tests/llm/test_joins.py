"""Long words, hubs, hot tokens, scratch tables, rates beyond one draw, and band recall."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, components, fingerprints, mixing, ngram_join, queries
from tests.llm.cases import DOCS, clashing, edited, rows, table, words
from tests.llm.test_documents import brute_components

A, B = "ab" * 32_768, "cd" * 32_768  # blocks of 64 KiB


@pytest.mark.parametrize("size", [1 << 16, 1 << 18, 10 << 20])
def test_unlike_long_words_hash_unlike(size):
    import pyarrow as pa

    half = size // 2
    x, y = "ab" * (half // 2), "cd" * (half // 2)
    texts = [x + y, y + x, x + x, y + y, x + y[:-1] + "e", "e" + x[1:] + y]
    data, offsets = common.utf8(pa.array([" ".join(texts), texts[0]]))
    hashes, counts = common.word_hashes(data, offsets)
    assert counts.tolist() == [6, 1] and len(set(hashes.tolist())) == 6 and hashes[0] == hashes[6]


def test_shingle_sets_of_a_run_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"T{i} " + words(i, 50 + i % 300) for i in range(2000)] + ["", None, words(1, 2)] * 50)
    data, offsets = common.utf8(texts)
    assert len(data) > 4 * ngram_join.HASHED_BYTES
    hashes, counts = common.shingles(data, offsets, 5, common.LOWER)
    want = np.split(hashes, np.cumsum(counts)[:-1])
    tracemalloc.start()
    (only,) = ngram_join._sets(texts, 5, common.LOWER)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert only[:2] == (0, len(texts)) and len(only[2]) == len(texts)
    assert all(np.array_equal(got, np.unique(s)) for got, s in zip(only[2], want, strict=True))
    # Hashing the run in one step took over 30 times its bytes.
    assert peak < 20 * len(data)


def test_documents_of_swapped_blocks_are_not_one(spark):
    data = [(1, A + B, None, None, None), (2, B + A, None, None, None), (3, A + B, None, None, None)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(table(spark, data)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    near = {r.doc_id: r.class_id for r in fingerprints.near_duplicates(table(spark, data)).collect()}
    assert near == {1: 1, 2: 2, 3: 1}


def test_a_hub_and_a_path(spark):
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5064)]
    got = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5065)}


def test_groups_that_share_a_passage(spark):
    """Near copies of one text, and texts that share a passage but little else."""
    base, passage = words(1, 90), words(2, 60)
    data = [(i, edited(base, 1, i), None, None, None) for i in range(150)]
    data += [(500 + i, f"{words(100 + i, 80)} {passage}", None, None, None) for i in range(150)]
    data += [(900 + i, edited(f"{words(100 + i, 80)} {passage}", 2, i), None, None, None) for i in range(0, 150, 3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(table(spark, data)).collect()}
    assert got == brute_components(data, 4, 85)


def test_scratch_tables_are_removed(spark):
    common.discard_all(spark)
    docs = table(spark, [(i, edited(words(1, 300), 1, i), None, None, None) for i in range(9)])
    out = ngram_join.ngram_components(docs)
    left = set(common._written[spark.sparkContext.applicationId])
    assert len(left) == 2 and all(os.path.isdir(p.removeprefix("file:")) for p in left)
    assert {r.component_id for r in out.collect()} == {0}
    assert common.discard_all(spark) == 2
    assert not any(os.path.exists(p.removeprefix("file:")) for p in left)


def test_nested_scopes_keep_what_the_inner_keeps(spark):
    common.discard_all(spark)
    with common.temporary_tables() as keep:
        a = common.materialize(spark.range(3))
        with common.temporary_tables() as inner:
            b = inner(common.materialize(spark.range(4)))
            common.materialize(spark.range(5))
        assert b.count() == 4 and a.count() == 3
        c = keep(common.materialize(spark.range(6)))
    assert c.count() == 6 and common.discard_all(spark) == 1


def test_rates_beyond_one_draw(spark):
    """A source of 4 of 4004 rows is to be half of the mixture: a mean of about 500 and more."""
    data = [(i, "x" * 20, None, "big", None) for i in range(8000)] + [(9000 + i, "x" * 20, None, "tiny", None) for i in range(4)]
    out = mixing.mix_sources(table(spark, data), {"big": 0.1, "tiny": 0.9}).groupBy("doc_id", "source").count().collect()
    counts = np.array([r["count"] for r in out if r.source == "tiny"])
    assert len(counts) == 4 and abs(counts.mean() - 1801) < 5 * (1801 / 4) ** 0.5
    again = mixing.mix_sources(table(spark, data).repartition(3), {"big": 0.1, "tiny": 0.9})
    again = again.where("source = 'tiny'").groupBy("doc_id").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in again) == sorted((r.doc_id, r["count"]) for r in out if r.source == "tiny")


def test_recall_of_bands_on_a_whole_table(spark):
    """Rows that the exact join links with others, and those that the bands link likewise."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = ngram_join.ngram_components(docs, percent=80, width=5, lower=False)
    want = {r.doc_id: r.component_id for r in exact.where("n_shingles > 0").collect()}
    got = {r.doc_id: r.class_id for r in fingerprints.near_duplicates(docs).collect()}
    linked = [d for d, c in want.items() if list(want.values()).count(c) > 1]
    assert len(linked) > 50 and sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked)
    assert all(got[d] == want[d] for d in want if d not in set(linked))


@pytest.mark.parametrize("count", [1, 2, 3, 10, 99, 1000])
def test_bounds_passed(spark, count):
    import bisect

    bounds = sorted({(i * 37) % 5003 for i in range(count)})
    rows = spark.range(-3, 5010, 7).selectExpr("id as doc_id").unionByName(spark.sql("select cast(null as bigint) doc_id"))
    kind = rows.schema["doc_id"].dataType
    got = rows.select("doc_id", fingerprints._bounds_passed(bounds, kind).alias("n")).collect()
    assert all(r.n == (0 if r.doc_id is None else bisect.bisect_right(bounds, r.doc_id)) for r in got)


def test_a_class_for_every_row(spark):
    """Nulls, texts without words, repeated rows, ids with several texts, clashing names."""
    base, other = words(1, 120), words(7, 90)
    data = rows() + [(900, base, None, None, None), (900, other, None, None, None), (901, edited(other, 1, 1), None, None, None)]
    docs = clashing(table(spark, data))
    some = sorted((r.doc_id, r.class_id) for r in fingerprints.near_duplicates(docs).collect())
    out = fingerprints.near_duplicates(docs, every=True).collect()
    assert len(out) == len(data)
    blank = [d for d, t, *_ in data if d is not None and not (t or "").split()]
    assert {r.class_id for r in out if r.doc_id is None} == {None}
    rest = [(r.doc_id, r.class_id) for r in out if r.doc_id is not None]
    assert sorted(rest) == sorted(some + [(d, d) for d in blank])
    assert sorted(c for d, c in some if d == 900) == [0, 900] and (901, 900) in some
    assert fingerprints.near_duplicates(table(spark, []), every=True).collect() == []


def test_classes_of_the_given_documents(spark):
    """The registered query has each row once, and loses few links of the exact classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    brute = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80, lower=False)
    got = {r.doc_id: r.class_id for r in queries.near_duplicates(spark, "/root/testdata/sf0.01").collect()}
    linked = {d for d, (_, c) in brute.items() if c != d} | {c for d, (_, c) in brute.items() if c != d}
    assert set(got) == set(brute) and len(linked) > 50
    assert sum(got[d] == brute[d][1] for d in linked) >= 0.9 * len(linked)
    assert all(got[d] == d for d in brute if d not in linked)
