"""From raw documents to packed training sequences.

Five stages, each on all that the one before kept, and each by one operator of
``quarry.llm``: documents that the quality classifier rejects go; of each group
of near copies (five-word shingles, Jaccard similarity 0.8 or more) the
document with the smallest id stays; personal data gets surrogates; sources are
replicated to target weights; token sequences are packed.  All stages but the
last return the columns of ``documents``.

Defined results: a row without a doc_id has no label and no near copies; rows of
one doc_id are one document, of which the first by text stays (of two texts under
one id the second is lost, though they be unlike); null texts count as empty, but
stay null until they are packed; texts of any length go through whole; of near
copies that tie in everything but doc_id the smallest stays, of rows alike in
doc_id and text the first by source and language; columns beyond those of
``documents``, whatever their names, go in the first stage; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import mixing, ngram_join, packing, pii, quality
from quarry.llm.common import discard, materialize, table, temporary_tables
from quarry.llm.queries import MIX_WEIGHTS, PII_KEY, labelled, ranks_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_SCORE = 0.5
COPY_WIDTH = 5
COPY_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learnt from ``labels.quality``, is at least ``KEEP_SCORE``."""
    described = materialize(quality.add_statistics(docs.select("doc_id", "text")).drop("text"))
    model = quality.fit(labelled(described, table(spark, sf_dir, "labels")))
    scored = quality.score_texts(docs.select(*COLUMNS), model)
    return scored.where(F.col("score") >= KEEP_SCORE).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    docs = docs.select(*COLUMNS)
    groups = materialize(
        ngram_join.ngram_components(docs, percent=COPY_PERCENT, width=COPY_WIDTH)
    )
    gone = materialize(groups.where("doc_id != component_id").select("doc_id").distinct())
    if gone.count() <= ngram_join.SENT_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = materialize(
        groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    )
    if repeated.limit(1).count() == 0:
        return kept.select(*COLUMNS)
    # Rows that repeat an id: the first by text.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source", "lang"))
    once = kept.join(repeated, "doc_id", "left_anti")
    several = kept.join(repeated, "doc_id", "left_semi").withColumn("__n", first)
    return once.select(*COLUMNS).unionByName(several.where("__n = 1").select(*COLUMNS))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    replaced = pii.replace_pii(docs.select(*COLUMNS), PII_KEY)
    changed = F.when(F.col("n_entities") > 0, F.length("text").cast("bigint"))
    return replaced.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources have their target parts, shuffled."""
    return mixing.mix_sources(docs.select(*COLUMNS), MIX_WEIGHTS).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with sequence and offset."""
    return packing.pack_documents(docs, ranks_file())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii_surrogates", pii_surrogates),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

# Kernel scores, shingle joins and tokens are beyond SQL; the tests compare the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with temporary_tables() as keep:
            kept = keep(materialize(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
