"""Quality scores against a dense solution, and shards against a packing one by one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, quality, sharding
from tests.llm.cases import rows, table, words


def labelled():
    clean = [(i, words(i, 40 + i % 30) + ".", 1) for i in range(150)]
    junk = [(500 + i, words(i, 50).upper().replace(" ", "## " if i % 2 else " "), 0) for i in range(130)]
    odd = [(900 + i, words(i, 30), i % 2) for i in range(40)]
    return clean + junk + odd


def dense(x, y, model):
    """Ridge weights from all rows at once."""
    z = model.features(x)
    a, b = z.T @ z, z.T @ y
    penalty = np.eye(len(a)) * 1e-3 * max(a[-1, -1], 1.0)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


@pytest.mark.parametrize("seed", range(6))
def test_isotonic_fit_equals_its_min_max_formula(seed):
    rng = np.random.default_rng(seed)
    count = rng.integers(1, 9, 40).astype(float)
    total = np.array([rng.integers(0, int(c) + 1) for c in count], dtype=float)
    want = np.array([
        max(min(total[a : b + 1].sum() / count[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1))
        for i in range(40)
    ])
    at, levels = quality.isotonic(count, total, np.arange(40.0))
    assert np.allclose(levels, np.unique(want.round(12)), atol=1e-9)
    for level, place in zip(levels, at):
        own = np.abs(want - level) < 1e-9
        assert np.isclose(place, (np.arange(40) * count)[own].sum() / count[own].sum())


def test_model_equals_a_dense_solution(spark):
    data = labelled()
    docs = spark.createDataFrame(data, "doc_id bigint, text string, label int")
    train = quality.add_statistics(docs).withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    model = quality.fit(train.repartition(4))
    x = np.concatenate([
        quality._statistics(d, o) for _, _, d, o in common.text_chunks(pa.array([t for _, t, _ in data]))
    ])
    y = np.array([label for _, _, label in data], dtype=float)
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-4)
    weights = dense(x, y, model)
    assert np.allclose(model.features(x) @ model.weights, model.features(x) @ weights, atol=2e-3)
    scored = quality.add_score(train, model).collect()
    assert np.mean([(r.score >= 0.5) == r.label for r in scored if r.doc_id < 900]) >= 0.97


def regrets(data, shards, chosen):
    """Placing groups of equal texts heaviest first, what each choice lacks to the highest dot product."""
    groups = {}
    for _, text, *_ in data:
        groups[text or ""] = groups.get(text or "", 0) + 1
    items = [
        (np.array([n * (len(t.encode()) + 16), n * len(t.split()), n], dtype=float), t) for t, n in groups.items()
    ]
    total = sum(own for own, _ in items)
    weight = np.array(sharding.IMPORTANCE)
    room, out = np.full((shards, 3), 1 / shards), []
    for own, text in sorted(items, key=lambda i: -(i[0] / total * weight).sum()):
        free = np.column_stack([room[:, 0], np.maximum(room[:, 1:], 0)])
        gain = free @ (own / total * weight)
        out.append(gain.max() - gain[chosen[text]])
        room[chosen[text]] -= own / total
    return out


@pytest.mark.parametrize("shards", [3, 5])
def test_shards_are_those_of_a_serial_packing(spark, shards):
    data = [(i, words(i, 5 + 7 * i), "en", "s", 0) for i in range(60)]
    data += [(200 + i, words(3, 26), "en", "s", 0) for i in range(4)] + [(300, None, None, None, None)]
    texts = {d: t or "" for d, t, *_ in data}
    got = sharding.shard_documents(table(spark, data), shards).collect()
    chosen = {texts[r.doc_id]: r.shard for r in got}
    assert len(got) == len(data) and all(r.shard == chosen[texts[r.doc_id]] for r in got)
    assert max(regrets(data, shards, chosen)) < 1e-9


def test_shards_of_awkward_rows_are_whole(spark):
    got = sharding.shard_documents(table(spark), 4).collect()
    assert len(got) == len(rows())
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
