"""SentencePiece ids of whole texts through a table of distinct chunks, and back.

Where no piece of a model has a white-space marker behind another character, no
piece crosses from one marked word to the next, so a text's ids are the ids of
its marked words in turn.  ``encode`` writes texts, some megabytes of them a
block, as numbers into the block's list of distinct chunks (a run of markers and
the characters up to the next).  The lists are dealt by a hash of the chunk into
buckets, where equal chunks of all blocks meet and the library segments each
once.  The ids return to the blocks and take their places by position.  What is
shuffled are packed lists, numbers and ids, never the texts.  ``decode`` gives the
library's text of ids.

``docs`` is read twice, for the lists and for the numbers, and must give the same
rows in the same partitions (as files do); a block is named by a digest of its
place and its list, so other rows raise instead of giving other ids.

A model whose pieces can cross markers, or that changes texts before it cuts
them, has each whole text as its one chunk; the ids are the same.

Defined results: a null text counts as empty, whose ids are the begin and end
ids alone; repeated rows come out as often as they occur; a null doc_id is kept;
an empty table gives no rows.  A very long text is a block of its own, and a very
long word one chunk.  ``encode`` reads ``doc_id`` and ``text`` alone, whatever
other columns there are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shuffle_partitions

MARK = "▁"  # what the library writes for a blank
# What an unchanged text looks like: a compatibility letter, a combining mark,
# repeated, leading and trailing blanks.
PROBE = " ﬁ é  Ａ\t\n "

# Characters of text that share a list of distinct chunks, and that have a bucket
# for theirs.
BLOCK_CHARS = 8 << 20
BUCKET_CHARS = 8 << 20

_WORDS = re.compile(r" +[^ ]*")


class Model:
    """A model, and how its texts can be cut."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        library = self.library
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.by_words = (
            library.normalize(PROBE) == MARK + PROBE.replace(" ", MARK)
            and library.piece_to_id(MARK) != library.unk_id()
            and not any(
                crossing.search(library.id_to_piece(i)) for i in range(library.get_piece_size())
            )
        )
        self.around = (library.bos_id(), library.eos_id())

    def chunks(self, text: str) -> list[str]:
        """A text's chunks, each without its first marker, which the library adds again."""
        if not text:
            return []
        if not self.by_words:
            return [text]
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [word[1:] for word in _WORDS.findall(" " + text)]
        return text.split(" ")

    def segment(self, chunks: list[str]) -> list[list[int]]:
        found = self.library.encode(chunks, num_threads=1)
        alone = [self.library.piece_to_id(MARK)] if self.by_words else []
        return [ids if chunk else alone for chunk, ids in zip(chunks, found)]

    def text(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


class _Numbers(dict):
    """Numbers of distinct keys, in order of their first use."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def pack(numbers) -> bytes:
    """32-bit numbers, their bytes of one rank together, compressed."""
    import zstandard

    planes = np.asarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(
    batches: Iterator[pa.RecordBatch], model_file: str, block_chars: int
) -> Iterator[tuple[bytes, pa.Array, list[np.ndarray], list[str]]]:
    """``(name, doc_ids, numbers of each text, distinct chunks)`` of each block of a partition."""
    model = Model(model_file)
    place = TaskContext.get().partitionId() << 32
    ids, coded, numbers, used = [], [], _Numbers(), 0

    def block():
        name = hashlib.sha256(str(place).encode())
        for chunk in numbers:
            name.update(b"%d:" % len(chunk) + chunk.encode())
        return name.digest()[:16], pa.concat_arrays(ids), coded, list(numbers)

    for batch in batches:
        first = 0
        while first < batch.num_rows:
            last = first
            while last < batch.num_rows and used < block_chars:
                text = batch.column(1)[last].as_py() or ""
                coded.append(
                    np.array([*map(numbers.__getitem__, model.chunks(text))], dtype=np.uint32)
                )
                used += len(text) + 1
                last += 1
            ids.append(batch.column(0).slice(first, last - first))
            first = last
            if used >= block_chars:
                yield block()
                place += 1
                ids, coded, numbers, used = [], [], _Numbers(), 0
    if coded:
        yield block()


def _numbers(docs: DataFrame, model_file: str, block_chars: int) -> DataFrame:
    """A row for each block: its documents, and their texts as numbers of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "doc_ids", "counts", "numbers", "n_chunks"]
        for name, ids, coded, chunks in _blocks(batches, model_file, block_chars):
            row = [
                pa.array([name], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([pack([len(c) for c in coded])], pa.binary()),
                pa.array([pack(np.concatenate(coded))], pa.binary()),
                pa.array([len(chunks)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(row, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"block binary, doc_ids array<{kind}>, counts binary, numbers binary, n_chunks bigint"
    )


def _lists(docs: DataFrame, model_file: str, block_chars: int, buckets: int) -> DataFrame:
    """The blocks' distinct chunks, a row for each block and bucket.

    ``places`` are the chunks' numbers, ascending, as steps; ``ends`` where each ends in
    ``chunks``, in steps as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = ["bucket", "block", "places", "ends", "chunks"]
        for name, _, _, chunks in _blocks(batches, model_file, block_chars):
            raw = [chunk.encode() for chunk in chunks]
            bucket = np.array([*map(zlib.crc32, raw)], dtype=np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                at = order[a:b]
                own = [raw[i] for i in at]
                row = [
                    pa.array([bucket[at[0]]], pa.int64()),
                    pa.array([name], pa.binary()),
                    pa.array([pack(np.diff(at, prepend=0))], pa.binary()),
                    pa.array([pack([*map(len, own)])], pa.binary()),
                    pa.array([zstandard.compress(b"".join(own), 1)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(row, names=names)

    return docs.mapInArrow(
        run, "bucket bigint, block binary, places binary, ends binary, chunks binary"
    )


def _segmented(lists: DataFrame, model_file: str, buckets: int) -> DataFrame:
    """``block, places, counts, ids`` of ``lists``: a bucket's equal chunks are segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        model = Model(model_file)
        bucket, known = None, {}
        for batch in batches:
            counts, ids = [], []
            for row in batch.select(["bucket", "ends", "chunks"]).to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                raw = zstandard.decompress(row["chunks"])
                ends = np.cumsum(unpack(row["ends"]), dtype=np.int64).tolist()
                chunks = [raw[a:b] for a, b in zip([0, *ends], ends)]
                fresh = [chunk for chunk in chunks if chunk not in known]
                known.update(zip(fresh, model.segment([chunk.decode() for chunk in fresh])))
                found = [known[chunk] for chunk in chunks]
                counts.append(pack([*map(len, found)]))
                ids.append(pack(np.fromiter((i for own in found for i in own), dtype=np.uint32)))
            out = [batch.column("block"), batch.column("places")]
            out += [pa.array(counts, pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["block", "places", "counts", "ids"])

    met = lists.repartition(min(buckets, shuffle_partitions(lists.sparkSession)), "bucket")
    return met.sortWithinPartitions("bucket").mapInArrow(
        run, "block binary, places binary, counts binary, ids binary"
    )


def encode(
    docs: DataFrame,
    model_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
    bucket_chars: int = BUCKET_CHARS,
    decoded: bool = False,
) -> DataFrame:
    """``doc_id, ids`` of every whole text: 32-bit little-endian ids between begin and end ids.

    With ``decoded``, also what ``decode`` gives, in the same pass.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    buckets = 1 + (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // bucket_chars
    segmented = _segmented(_lists(docs, model_file, block_chars, buckets), model_file, buckets)
    held: list[Model] = []  # loaded once a task

    def run(texts: pa.Table, chunks: pa.Table) -> pa.Table:
        if not held:
            held.append(Model(model_file))
        begin, end = held[0].around
        rows = chunks.to_pylist()
        places = [np.cumsum(unpack(r["places"]), dtype=np.int64) for r in rows]
        if [len(texts), sum(map(len, places))] != [1, *texts.column("n_chunks").to_pylist()]:
            raise RuntimeError("docs gave other rows when read again; write them to a table first")
        order = np.argsort(np.concatenate([*places, []])).astype(np.int64)
        none = [np.empty(0, np.uint32)]
        lengths = np.concatenate(none + [unpack(r["counts"]) for r in rows]).astype(np.int64)
        flat = np.concatenate(none + [unpack(r["ids"]) for r in rows])
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        counts = unpack(texts.column("counts")[0].as_py()).astype(np.int64)
        numbers = np.split(unpack(texts.column("numbers")[0].as_py()), np.cumsum(counts)[:-1])
        out = []
        for own in numbers:
            first, length = starts[own], lengths[own]
            place = np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)
            out.append(np.concatenate([[begin], flat[place], [end]]).astype("<u4").tobytes())
        found = {"doc_id": texts.column("doc_ids").combine_chunks().flatten(), "ids": pa.array(out, pa.binary())}
        if decoded:
            found["decoded"] = pa.array(map(held[0].text, out), pa.string())
        return pa.table(found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        _numbers(docs, model_file, block_chars)
        .groupBy("block")
        .cogroup(segmented.groupBy("block"))
        .applyInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decoded)
    )


def decode(coded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the library's text of its ``ids``; null where those are null."""
    names = [c for c in coded.columns if c != "decoded"]
    at = names.index(ids)
    rows = coded.select(*[f"`{c}`" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_file)
        for batch in batches:
            texts = [None if raw is None else model.text(raw) for raw in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, decoded string")
