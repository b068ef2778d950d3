"""Helpers shared by the operators of this subpackage.

* ``materialize`` cuts lineage through a Parquet table in the folder that
  ``spark.checkpoint.dir`` names, which every executor and the driver share.
* ``text_chunks`` and ``shingles`` turn Arrow string batches into numpy arrays
  of word-shingle hashes, whole texts at a time, in bounded chunks.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Odd multipliers of the hashes below (golden-ratio and
# splitmix64 constants).
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
WORD_BASE = 0x100000001B3

# Bytes of text that one numpy step works on.
CHUNK_BYTES = 4 << 20

# Bytes of a word that one polynomial covers.
WORD_BLOCK = 1 << 16

# Folders of the tables that ``materialize`` wrote, by application.
_written: dict[str, set[str]] = {}
# Temporary folders of local sessions without a shared one, by application.
_local_dirs: dict[str, str] = {}
# Each thread's open ``temporary_tables``.
_scopes = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where the setting is unset, a local session (tests) gets a temporary folder,
    which later calls use again; any other raises.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_dirs.get(app)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or (
            spark.sparkContext.master.startswith("local-cluster")
        ):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dirs[app] = tempfile.mkdtemp(prefix="quarry-")
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *sort_within: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and reread it."""
    path = work_dir(df.sparkSession)
    (df.sortWithinPartitions(*sort_within) if sort_within else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(out)
    out._quarry_table = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that no further step reads."""
    for df in tables:
        path = getattr(df, "_quarry_table", None)
        if path is not None:
            _written.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)
            _remove(df.sparkSession, path)


@contextmanager
def temporary_tables():
    """Tables that this thread writes inside are removed at the end, but for those that
    go through the function given."""
    stack = _scopes.__dict__.setdefault("open", [])
    stack.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        tables = stack.pop()
        paths = {getattr(df, "_quarry_table", None) for df in kept}
        discard(*[t for t in tables if t._quarry_table not in paths])
        if stack:  # what is kept is the outer scope's
            stack[-1] += [t for t in tables if t._quarry_table in paths]


def discard_all(spark: SparkSession) -> int:
    """Remove all tables that this session's queries wrote; how many they were.

    A query's result reads some of its tables, so this is for when all results
    have been written or collected.
    """
    written = _written.pop(spark.sparkContext.applicationId, set())
    for path in written:
        _remove(spark, path)
    return len(written)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def code_points(text) -> F.Column:
    """Length in code points; a null text counts as empty."""
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def runs(
    data: np.ndarray, offsets: np.ndarray, limit: int, most: int = 1 << 20
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of runs of whole texts of about ``limit`` bytes
    and of at most ``most`` texts."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, first + most, max(first + 1, last))
        a, b = offsets[first], offsets[last]
        yield first, last, data[a:b], offsets[first : last + 1] - a
        first = last


def text_chunks(
    column, limit: int = CHUNK_BYTES, most: int = 1 << 20
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The ``runs`` of a string column."""
    yield from runs(*utf8(column), limit, most)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a fixed permutation of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _space_table() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


SPACE = _space_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = AS_IS
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts, and words per text.

    A word's bytes are a polynomial; one longer than ``WORD_BLOCK`` is the sum of its
    blocks' polynomials, each mixed with its block's number, so that order counts.
    """
    rows = len(offsets) - 1
    if len(data) == 0:
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    before |= edge[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    after |= edge[1:]
    starts = np.flatnonzero(inside & before)
    if len(starts) == 0:
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    lengths = np.flatnonzero(inside & after) - starts + 1
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    longest = min(int(lengths.max()), WORD_BLOCK)
    powers = np.cumprod(np.full(longest, WORD_BASE, dtype=np.uint64))
    value = fold[data[inside]].astype(np.uint64) + np.uint64(1)
    value *= powers[place % WORD_BLOCK]
    if int(lengths.max()) > WORD_BLOCK:
        block = np.flatnonzero(place % WORD_BLOCK == 0)
        number = (place[block] // WORD_BLOCK).astype(np.uint64)
        value = np.add.reduceat(value, block)
        value = np.where(number == 0, value, mix(value + number * np.uint64(GOLDEN)))
        first = np.searchsorted(block, first)
    words = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(GOLDEN))
    per_text = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return words, per_text.astype(np.int64)


def shingles(
    data: np.ndarray, offsets: np.ndarray, width: int, fold: np.ndarray = AS_IS
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all ``width``-word shingles in order, and shingles per text.

    A text of fewer words has its whole word sequence as its one shingle; a
    text without words has none.
    """
    words, per_text = word_hashes(data, offsets, fold)
    if len(words) == 0:
        return words, per_text
    ends = np.cumsum(per_text)
    first = ends - per_text
    left = np.repeat(ends, per_text) - np.arange(len(words))  # words from here to the text's end
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(words), dtype=np.uint64)
    factor = 1
    for j in range(width):
        factor = factor * (GOLDEN | 1) % (1 << 64)
        total += np.where(left > j, padded[j : j + len(words)], np.uint64(0)) * np.uint64(factor)
    short = (per_text > 0) & (per_text < width)
    keep = left >= width
    keep[first[short]] = True
    total[first[short]] += per_text[short].astype(np.uint64) * np.uint64(MIX_2)
    counts = np.where(short, 1, np.maximum(per_text - width + 1, 0))
    return mix(total[keep]), counts.astype(np.int64)
