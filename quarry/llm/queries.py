"""The registered queries of this subpackage: thin uses of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (
    ann,
    fingerprints,
    licenses,
    mixing,
    ngram_join,
    packing,
    pages,
    pieces,
    pii,
    quality,
    ranked,
    sharding,
    trie,
)
from quarry.llm.common import materialize, table


def learnable(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels may be learnt from; null ids have no label."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def labelled(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """``statistics, label, fold`` of every row with a label to learn from."""
    marks = (
        labels.where(learnable() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg(F.col("quality").cast("double")).alias("label"))
    )
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3).cast("long") % quality.FOLDS
    return statistics.join(marks, "doc_id").select(
        "statistics", "label", fold.cast("int").alias("fold")
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 1: classes by its signature bands, Jaccard verified."""
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents"), every=True)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    described = materialize(quality.add_statistics(docs).drop("text"))
    model = quality.fit(labelled(described, table(spark, sf_dir, "labels")))
    return quality.add_score(described, model).select(
        "doc_id",
        F.coalesce(~learnable(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """Law ``bytes``: the shards' sizes are near equal."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


# The key of the surrogates; a deployment sets its own.
PII_KEY = "quarry"


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, F.col("vec_id") % 20 == 0, 20)


# The mixture that the query and the pipeline aim at, in parts of bytes.
MIX_WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, mixing.REST: 0.60}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pages.main_text(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("bigint"))


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_best_fit_packing(
    spark: SparkSession, sf_dir: str, ranks: str | None = None
) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), ranks or ranks_file())


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents"), model or piece_model(), decoded=True)
    return coded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "near_duplicates": near_duplicates,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_license_scan": op6_license_scan,
    "op7_approximate_nearest": op7_approximate_nearest,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_mixing": op9_mixing,
    "op10_html_extraction": op10_html_extraction,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op9_mixing": mixing.mix_sql(MIX_WEIGHTS, columns="doc_id, text, lang, source, n_chars, "),
    "op12_ranked_search": ranked.ranked_sql(20),
}
