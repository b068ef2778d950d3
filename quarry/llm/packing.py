"""Sum-of-squares packing of token sequences.

``token_pieces`` encodes every whole text and cuts those longer than a
sequence; ``pack`` puts the pieces into sequences of at most ``capacity``
tokens.  With ``n[g]`` open sequences that have ``g`` places left, each piece
goes where the sum of ``n[g] ** 2`` becomes smallest; ties go to the smallest
gap.  Pieces are dealt by a hash into blocks of bounded size, so that a block
is one task's work at any input size.  Inside a block the longer pieces go
longest first and the short ones (``capacity / SHORT``) after them in hash order:
in falling order alone their equal lengths leave gaps that nothing fills.

Defined results: a null text counts as empty and is one end token long; texts and
runs of white space may be of any length;
repeated rows are packed as often as they occur; a null doc_id is kept; an
empty table gives no pieces.  ``token_pieces`` reads ``doc_id`` and ``text``
alone, whatever other columns there are.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

# Sequence length, the id that ends each document, the special
# token of the vocabulary and the pattern of its words.
CAPACITY = 2048
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Pieces up to this part of a sequence are short.
SHORT = 10

# About so many pieces make a block.
BLOCK_PIECES = 100_000

_SPACES = re.compile(r"\s\s")
# White space as the pattern's ``\s`` knows it; a run of so many characters is cut out.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 10_000


class Encoder:
    """Ids of whole texts under a byte-level vocabulary given as ranks.

    The pattern's look-ahead matters only where two white-space characters
    meet; other texts take the pattern without it, which is matched in linear
    time.  A long run of white space, which the matcher can't take back, is encoded
    apart: what the pattern finds in it is the run without its last character if a
    word follows, and the whole run at a text's end.  The ids are the same.
    """

    def __init__(self, ranks_file: str):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = PATTERN.replace(r"\s+(?!\S)|", "")
        self._full = tiktoken.Encoding(
            "full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
        self._plain = tiktoken.Encoding(
            "plain", pat_str=plain, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
        self._one = tiktoken.Encoding(
            "one", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens=SPECIAL
        )

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return self._part(text)
        ids, first = [], 0
        for run in _BLANKS.finditer(text):
            # A special token between ends the text for the pattern.
            ends = run.end() == len(text) or any(text.startswith(s, run.end()) for s in SPECIAL)
            last = run.end() if ends else run.end() - 1
            if last - run.start() >= LONG_RUN:
                ids += self._part(text[first : run.start()])
                ids += self._one.encode_ordinary(text[run.start() : last])
                first = last
        return ids + self._part(text[first:])

    def _part(self, text: str) -> list[int]:
        if any(s in text for s in SPECIAL):
            return self._full.encode(text, allowed_special="all")
        return (self._full if _SPACES.search(text) else self._plain).encode_ordinary(text)


def token_pieces(
    docs: DataFrame,
    ranks_file: str,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every text.

    A document is its ids and ``END_ID``.  One longer than ``capacity`` is cut
    into pieces of that length, but for the first, which takes the remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_file)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            row, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                found = array("I", encoder.encode(texts[i].as_py() or ""))
                found.append(END_ID)
                raw = memoryview(np.asarray(found, dtype="<u4").tobytes())
                a, b, k = 0, len(found) % capacity or min(capacity, len(found)), 0
                while a < len(found):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    a, b, k = b, b + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the order given, by sum of squares."""
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # [g]: open sequences with g places left
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, size in enumerate(lengths.tolist()):
        rest = capacity - size
        best, best_cost = -1, 2 * int(count[rest]) + 1 if rest else 0
        if size < capacity:
            gaps = size + np.flatnonzero(count[size:capacity])
            if len(gaps):
                left = np.where(gaps > size, count[gaps - size], -1)
                # A piece that fills a sequence closes it: n[0] isn't counted.
                cost = np.where(left < 0, 1, 2 + 2 * left) - 2 * count[gaps]
                j = int(np.argmin(cost))
                if cost[j] <= best_cost:
                    best = int(gaps[j])
        if best < 0:
            sequence[i], offset[i], gap = made, 0, rest
            made += 1
        else:
            count[best] -= 1
            sequence[i] = open_by_gap[best].pop()
            offset[i], gap = capacity - best, best - size
        if gap:
            count[gap] += 1
            open_by_gap[gap].append(int(sequence[i]))
    return sequence, offset


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  ``length`` must be 1 to ``capacity``.

    ``pieces`` is read twice; give a table, not a long plan.
    """
    blocks = max(1, -(-pieces.count() // block_pieces))
    names = [f.name for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    dealt = pieces.select(
        *names,
        F.xxhash64("doc_id", "piece", "ids_crc32").alias("__order"),
    ).withColumn("__block", F.pmod("__order", F.lit(blocks)).cast("int"))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        rank = block["length"].where(block["length"] > capacity // SHORT, 0)
        block = (
            block.assign(__rank=rank)
            .sort_values(["__rank", "__order", "length"], ascending=[False, True, True])
            .reset_index(drop=True)
        )
        sequence, offset = place(block["length"].to_numpy(), capacity)
        number = int(block["__block"].iloc[0]) if len(block) else 0
        return block[names].assign(
            sequence_id=sequence + (number << 32), offset=offset
        )

    kinds = ", ".join(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names)
    return dealt.groupBy("__block").applyInPandas(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, ranks_file: str, capacity: int = CAPACITY) -> DataFrame:
    """``token_pieces`` of ``docs``, packed."""
    return pack(materialize(token_pieces(docs, ranks_file, capacity)), capacity)
