"""Ranked search against scores of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ranked
from quarry.llm.queries import op12_ranked_search
from tests.conftest import duck
from tests.llm.cases import DOCS, clashing, rows, table, words

ITEMS = "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    split = [(d[0], terms(d[1])) for d in docs]
    split = [(d, Counter(t), len(t)) for d, t in split if t]
    count, total = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for d, c, n in split:
            m = 75 + 25 * n * count // total
            score = sum(
                q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, q in asked.items() if t in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if none else d, -score))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def items():
    texts = [words(1, 12), words(1000, 30), None, "", "?! ...", "one", "ONE three Three", "é à ü 漢字", words(2, 400), "zzz"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "two"), (0, words(3, 5))]


@pytest.mark.parametrize("block_chars", [ranked.BLOCK_CHARS, 300])
def test_awkward_rows(spark, block_chars):
    data = rows() + [(7000 + i, t, None, None, None) for i, t in enumerate(["ÀB aB_c-d\x00e\x7ff", "ONE", "one one", "x" * 99])]
    docs = clashing(table(spark, data)).withColumn("item", F.lit("clash")).repartition(3)
    asked = spark.createDataFrame(items(), ITEMS).withColumn("rank", F.lit(1))
    found = ranked.ranked_search(docs, asked, 7, block_chars=block_chars)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(data, items(), 7)


def test_many_small_trees(spark, monkeypatch):
    for name, value in (("TREE_DOCS", 20), ("LEAF_DOCS", 3), ("RUN_BYTES", 50), ("BALLS", 4)):
        monkeypatch.setattr(ranked, name, value)
    data = [(i, words(i % 90, 10 + i % 50), None, None, None) for i in range(300)]
    asked = [(i, words(5000 + i, 6)) for i in range(9)]
    found = ranked.ranked_search(table(spark, data).repartition(2), spark.createDataFrame(asked, ITEMS), 20)
    assert got(found) == brute(data, asked, 20)


def test_empty_tables(spark):
    docs, asked = table(spark), spark.createDataFrame(items(), ITEMS)
    assert ranked.ranked_search(spark.createDataFrame([], DOCS), asked).count() == 0
    assert ranked.ranked_search(docs, spark.createDataFrame([], ITEMS)).count() == 0


def vectors(seed, docs, size, clusters=6):
    rng = np.random.default_rng(seed)
    terms = [np.sort(rng.choice(size // clusters, rng.integers(1, 30), replace=False)) + (i % clusters) * (size // clusters) for i in range(docs)]
    values = [rng.integers(1, 2 * 10**10, len(t)) for t in terms]
    return np.concatenate([[0], np.cumsum([len(t) for t in terms])]), np.concatenate(terms), np.concatenate(values)


@pytest.mark.parametrize("balls", [1, 16, 300])
def test_bounds_hold_and_prune(balls):
    size = 300
    starts, terms, values = vectors(1, 500, size)
    tree = ranked.BallTree(starts, terms, values, size, leaf=8, balls=balls)
    dense, rng = np.zeros(size, dtype=np.int64), np.random.default_rng(2)
    leaves = sum(not c for c in tree.children)
    for item in range(20):
        asked = rng.choice(size // 6, 10, replace=False) + (item % 6) * (size // 6)
        counts = rng.integers(1, 4, 10)
        whole = np.zeros(size, dtype=np.int64)
        whole[asked] = counts
        scores = np.add.reduceat(whole[terms] * values, starts[:-1])
        bounds = tree.bounds(asked, counts)
        for (first, last), bound in zip(tree.ranges, bounds):
            assert scores[tree.order[first:last]].max() <= bound
        best = []
        scored = tree.search(asked, counts, dense, best, 5, list(range(500)))
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s), reverse=True)[:5]
        assert sorted(best, reverse=True) == want and not dense.any()
        assert balls < size or scored < leaves / 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_whole_tables(spark, sf):
    want = duck(f"/root/testdata/{sf}").sql(ranked.ranked_sql(20)).fetchall()
    assert got(op12_ranked_search(spark, f"/root/testdata/{sf}")) == sorted(want, key=str)
    data = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    asked = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").collect()]
    if sf == "sf0.001":
        assert sorted(want, key=str) == brute(data, asked, 20)
