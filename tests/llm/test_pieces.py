"""Piece ids and texts against the library on whole texts."""

import hashlib
import uuid

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quarry.llm import pieces
from quarry.llm.queries import op11_sentencepiece, piece_model
from tests.llm.cases import DOCS, clashing, rows, table

ODD = [
    "", " ", "  ", " a", "a ", " a  b   c    ", "▁x", "a▁ ▁b", "▁", "a\tb\n\nc \n d", "\x00 \x00x",
    "<s>hi</s> <0x41> <unk>", " x　y", "é ﬁ \U0001d4b3", "漢字 かな 한국어 текст", "x" * 70_000,
    " " * 70_000, "ab " * 30_000, "� \U0010ffff", "Don't 1,000.50 (really)!  \r\n end",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def brute(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return ids, library.decode(ids)


def got(df):
    return sorted(
        ((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in df.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
    )


@pytest.mark.parametrize("block_chars, bucket_chars", [(pieces.BLOCK_CHARS, pieces.BUCKET_CHARS), (2000, 9999)])
def test_ids_and_texts_are_the_library_s(spark, library, block_chars, bucket_chars):
    data = rows() + [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    want = sorted(
        ((r[0], *brute(library, r[1])) for r in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1])
    )
    docs = clashing(table(spark, data)).withColumnRenamed("k", "ids").withColumnRenamed("n", "block")
    coded = pieces.encode(docs.repartition(3), piece_model(), block_chars=block_chars, bucket_chars=bucket_chars)
    assert got(pieces.decode(coded, piece_model())) == want


def test_chunks_join_to_the_text():
    model = pieces.Model(piece_model())
    assert model.by_words
    for text in ODD:
        joined = "".join(" " + c for c in model.chunks(text))
        assert joined[1:] == text.replace(pieces.MARK, " ")


def test_model_whose_pieces_cross_markers(spark, library, monkeypatch):
    model = pieces.Model(piece_model())
    model.by_words = False
    for text in ODD:
        assert [i for ids in model.segment(model.chunks(text)) for i in ids] == library.encode(text)


def test_distinct_chunks_are_segmented_once(spark, monkeypatch, tmp_path):
    # Workers get the module by value, so the counting is in what they get.
    class Counting(pieces.Model):
        def segment(self, chunks):
            with open(f"{tmp_path}/{id(chunks)}-{hash(tuple(chunks))}", "w") as f:
                f.write("\n".join(chunks))
            return super().segment(chunks)

    monkeypatch.setattr(pieces, "Model", Counting)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 9}" for j in range(6))) for i in range(60)], DOCS[:26])
    coded = pieces.encode(docs.repartition(5), piece_model(), block_chars=40, bucket_chars=300)
    assert coded.count() == 60
    cut = [w for f in tmp_path.iterdir() for w in f.read_text().split("\n") if w]
    assert sorted(cut) == [f"w{k}" for k in range(9)]


def test_other_rows_at_the_second_reading_raise(spark):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(9)], DOCS[:26])
    other = F.udf(lambda t: f"{t} {uuid.uuid4()}").asNondeterministic()
    docs = docs.withColumn("text", other("text"))
    with pytest.raises(Exception, match="other rows when read again"):
        pieces.encode(docs, piece_model()).collect()


def test_packed_numbers():
    for n in ([], [0], [1, 2**32 - 1, 70_000], range(1000)):
        assert pieces.unpack(pieces.pack(np.array(n, dtype=np.uint32))).tolist() == list(n)


def test_empty_table(spark):
    coded = pieces.encode(spark.createDataFrame([], DOCS), piece_model())
    assert pieces.decode(coded, piece_model()).count() == 0


def test_query_on_the_whole_table(spark, library, tmp_path):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = set()
    for doc_id, text in texts.items():
        ids, decoded = brute(library, text)
        digest = hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        want.add((doc_id, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in op11_sentencepiece(spark, sf).collect()} == want
