"""The trie of rebuilt conversations against one that is built whole."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import trie
from quarry.llm.queries import op13_conversation_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        last = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[b] for b in below)
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children.get(n, ())),
            leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest(),
        )
        for n in members
    )


def got(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def some(seed, convs, kinds=4, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            turn = None if rng.random() < 0.05 else t // (1 + (rng.random() < 0.1))
            text = rng.choice([None, "", "é ü", *[f"text {k}" for k in range(kinds)]])
            rows.append((c - 7, turn, rng.choice(["user", "assistant", None]), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nodes(spark, seed):
    rows = some(seed, 120, kinds=1 + seed) + [(None, 1, "user", "nobody's"), (3, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'clash' AS depth", "1 AS k0", "2 AS idx")
    assert got(trie.conversation_trie(df.repartition(4))) == brute(rows)


def test_equal_conversations_and_a_long_one_over_many_ranges(spark):
    same = [(5 * c, t, "user", f"t{t}") for c in range(300) for t in range(3)]
    long = [(9, t, "user", f"t{t % 5}") for t in range(700)]
    alike = [(9, None, "user", f"{i % 3}") for i in range(200)]
    rows = same + long + alike
    assert got(trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(5))) == brute(rows)


def test_small_batches_and_ranges(spark):
    rows = some(9, 40)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert got(trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute(rows)
    finally:
        spark.conf.set(key, before)


def test_hashes_that_meet_are_found_and_replaced(spark, monkeypatch):
    rows, tried, whole = some(4, 60), [], trie.field

    def weak(attempt):
        tried.append(attempt)
        return ((7, 3), (5, 2), (7, 2), (3, 2)) if attempt == 0 else whole(attempt)

    monkeypatch.setattr(trie, "field", weak)
    assert got(trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute(rows)
    assert tried == [0, 1]


def test_no_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).count() == 0


def test_powers():
    e = np.array([0, 1, 2, 5, 1000, 2**31 + 7])
    p, b = trie.field(0)[0]
    assert trie.powers(b, e, p).tolist() == [pow(b, int(x), p) for x in e]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()]
    assert got(op13_conversation_trie(spark, f"/root/testdata/{sf}")) == brute(rows)
