"""The registered queries and the pipeline's stages on the given tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from quarry.llm import queries
from tests.conftest import SF_SMOKE, duck, rows
from tests.llm.cases import clashing, table, words
from tests.llm.test_documents import brute_components

COLUMNS = {
    "op1_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op3_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op7_approximate_nearest": ["query_id", "rank", "vec_id", "score"],
    "op8_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op11_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_ranked_search": ["item_id", "rank", "doc_id", "score"],
    "op13_conversation_trie": [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ],
}


def test_every_operator_and_the_pipeline_are_registered():
    names = contract.queries()
    assert sorted({n.split("_")[0] for n in names if n.startswith("op")}) == sorted(f"op{i}" for i in range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run
    assert set(contract.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_result_columns(spark, name):
    assert contract.queries()[name](spark, SF_SMOKE).columns[: len(COLUMNS[name])] == COLUMNS[name]


def test_mixing_equals_its_sql(spark):
    got = rows(queries.op9_mixing(spark, SF_SMOKE))
    assert got == sorted(duck(SF_SMOKE).execute(queries.ORACLE_SQL["op9_mixing"]).fetchall())


def test_held_out_accuracy(spark):
    scored = queries.op2_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = scored.where("held_out").join(labels, "doc_id")
    right = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.97


def test_components_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard_join(spark, SF_SMOKE).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], 4, 85)


@pytest.fixture(scope="module")
def staged(spark):
    """What each stage got and gave, on awkward rows among the given documents."""
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    odd = table(spark).withColumn("doc_id", F.col("doc_id") + 10_000)
    now, out = clashing(docs.unionByName(odd)), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF_SMOKE)
        after = corpus_pipeline.materialize(after)
        out.append((name, now, after))
        now = after
    return {name: (a, b) for name, a, b in out}


def test_stages_keep_the_columns(staged):
    assert list(staged) == [name for name, _ in corpus_pipeline.STAGES]
    for _, (_, after) in list(staged.items())[:-1]:
        assert tuple(after.columns) == corpus_pipeline.COLUMNS


def test_quality_stage_keeps_clean_documents(spark, staged):
    before, after = staged["quality_classifier"]
    labels = spark.read.parquet(f"{SF_SMOKE}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id", "left_semi").count()
    kept = after.join(labels.where("quality = 1"), "doc_id", "left_semi").count()
    assert kept >= 0.95 * good
    assert after.join(labels.where("quality = 0"), "doc_id", "left_semi").count() == 0


def test_quality_stage_sends_texts_to_python_once(spark):
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, SF_SMOKE)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(steps) == 1 and steps[0].split("[")[0].count("text") == 1


def test_join_stage_keeps_one_of_each_group(staged):
    before, after = staged["ngram_jaccard_join"]
    data = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    groups = brute_components(data, 5, 80)
    kept = sorted(r.doc_id for r in after.collect() if r.doc_id is not None)
    assert kept == sorted({c for _, c in groups.values()})
    assert after.where("doc_id is null").count() == before.where("doc_id is null").count()


def test_pii_stage_changes_nothing_else(staged):
    before, after = staged["pii_surrogates"]
    old = {r.doc_id: r for r in before.where("doc_id is not null").collect()}
    new = {r.doc_id: r for r in after.where("doc_id is not null").collect()}
    assert set(old) == set(new)
    assert any("@mail" in (r.text or "") for r in old.values())
    assert not any("@mail" in (r.text or "") and "example.com" in r.text.split("@mail")[1][:14] for r in new.values())
    same = [i for i in old if old[i].text == new[i].text]
    assert len(same) > 0.8 * len(old) and all(new[i] == old[i] for i in same)
    assert all(new[i].n_chars == len(new[i].text) for i in old if i not in same)


def test_mixing_and_packing_hold_all_copies(staged):
    before, after = staged["source_mixing"]
    assert after.select("doc_id").distinct().count() <= before.count()
    mixed, packed = staged["sequence_packing"]
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("s")).where("s > 2048").count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    data = [(1, words(1, 30), "en", "s", 1), (1, words(2, 30), "en", "s", 1), (2, words(3, 30), "en", "s", 1)]
    docs = table(spark, data)
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, SF_SMOKE)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, min(words(1, 30), words(2, 30))), (2, words(3, 30))])
