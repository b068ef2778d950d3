"""Quality classifier: kernel ridge scores from random Fourier features.

``add_statistics`` describes every whole text by ``STATISTICS``.  ``fit`` maps
the standardised statistics to random Fourier features, whose inner products
approximate a Gaussian kernel, sums the normal equations of ridge regression
per partition and over partitions in Spark, solves them on the driver (their
size depends on ``features`` alone), and calibrates by isotonic regression on
out-of-fold scores.  ``add_score`` applies the model to statistics, ``score_texts``
to texts, in one Python step.

Defined results: a null text counts as empty; empty texts have a score like
any other; equal texts have equal scores.  Training rows with a null label or
null statistics take no part; repeated rows count as often as they occur; with
no training row, or labels of one kind only, every score is the labels' mean
(0.5 without any).  Columns of the input pass through; one with the name of an
added column is replaced.

Sums over partitions are sums of integers (fixed point), so they don't depend on
the order in which tasks end.  A partition's own sums are rounded once, so rows
dealt to other partitions can change a score's last digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import SPACE, shingles, text_chunks, word_hashes

# The order of the statistics of a text.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "lower", "digits", "sentence_marks",
    "other_marks", "spaces", "line_breaks", "beyond_ascii", "short_words", "long_words",
    "distinct_words", "top_word", "distinct_triples", "line_length", "byte_entropy",
    "marks_per_word", "upper_words",
)

FIXED_POINT = float(1 << 20)
CLIP = 4.0
BINS = 1024
FOLDS = 3
# Bytes and texts that one numpy step describes; its arrays take about 100 times
# the bytes and 2 kB a text.
CHUNK_BYTES = 1 << 19
CHUNK_TEXTS = 2048


def _byte_classes() -> np.ndarray:
    """0 upper, 1 lower, 2 digit, 3 sentence mark, 4 other mark, 5 space, 6 break, 7 beyond ASCII."""
    out = np.full(256, 4, dtype=np.int64)
    out[SPACE] = 5
    out[10] = 6
    out[65:91], out[97:123], out[48:58] = 0, 1, 2
    out[[ord(c) for c in ".,;:?'\"-()"]] = 3
    out[128:] = 7
    return out


BYTE_CLASS = _byte_classes()


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    safe = np.maximum(size, 1.0)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    hist = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256)
    share = np.zeros((rows, 8))
    for kind in range(8):
        share[:, kind] = hist[:, BYTE_CLASS == kind].sum(axis=1) / safe
    p = hist / safe[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
    words, per_text = word_hashes(data, offsets)
    n_words = np.maximum(per_text, 1).astype(np.float64)
    inside = ~SPACE[data]
    chars = np.bincount(owner[inside], minlength=rows).astype(np.float64)
    # Lengths, and whether a word is all upper case, word by word.
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])) if len(data) else inside
    starts = np.flatnonzero(start)
    word_of = np.cumsum(start) - 1
    lengths = np.bincount(word_of[inside], minlength=len(starts)) if len(starts) else np.empty(0)
    text_of = owner[starts] if len(starts) else np.empty(0, np.int64)
    small = (data >= 97) & (data < 123)
    has_small = np.bincount(word_of[small], minlength=len(starts)) if len(starts) else np.empty(0)
    big = (data >= 65) & (data < 91)
    has_big = np.bincount(word_of[big], minlength=len(starts)) if len(starts) else np.empty(0)
    per = lambda mask: np.bincount(text_of[mask], minlength=rows) / n_words
    distinct, top = _distinct(words, per_text)
    triples, n_triples = shingles(data, offsets, 3)
    distinct_triples, _ = _distinct(triples, n_triples)
    marks = hist[:, BYTE_CLASS == 4].sum(axis=1)
    return np.column_stack([
        np.log1p(size), np.log1p(per_text), chars / n_words, share[:, 0], share[:, 1], share[:, 2],
        share[:, 3], share[:, 4], share[:, 5] + share[:, 6], share[:, 6], share[:, 7],
        per(lengths <= 3), per(lengths >= 12), distinct / n_words, top / n_words,
        distinct_triples / np.maximum(n_triples, 1), np.log1p(size / (hist[:, 10] + 1)), entropy,
        marks / n_words, per((has_big > 1) & (has_small == 0)),
    ])


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, its number of different hashes and the count of the commonest."""
    rows = len(counts)
    distinct, top = np.zeros(rows), np.zeros(rows)
    ends = np.cumsum(counts)
    for i in np.flatnonzero(counts):
        own = np.sort(hashes[ends[i] - counts[i] : ends[i]])
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        distinct[i], top[i] = len(at) - 1, np.diff(at).max()
    return distinct, top


def add_statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """``df`` with ``out``: the statistics of its whole ``text``, an array of doubles."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in kept]
    source, at = _with_text(df, names, text)
    width = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for first, last, data, offsets in text_chunks(column, CHUNK_BYTES, CHUNK_TEXTS):
                values = np.ascontiguousarray(_statistics(data, offsets)).ravel()
                array = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(values) + 1, width, dtype=np.int32)), pa.array(values)
                )
                cols = [batch.column(i).slice(first, last - first) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, array], names=[*names, out])

    return source.mapInArrow(run, schema)


def _quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _with_text(df: DataFrame, names: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns ``names`` of ``df`` and, if it isn't one of them, ``text``; its place."""
    own = [_quoted(n) for n in names]
    if text in names:
        return df.select(*own), names.index(text)
    return df.select(*own, _quoted(text).alias("__text")), len(names)


@dataclass(frozen=True)
class QualityModel:
    """Size fixed by the number of statistics, features and bins."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # last: intercept; empty: constant model
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        waves = np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([waves, np.ones(len(x))])

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.features(x) @ (self.weights if weights is None else weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.weights) == 0:
            return np.full(len(x), self.levels[0])
        return np.interp(self.raw(x), self.knots, self.levels)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.nan_to_num(flat.reshape(len(column), -1)) if len(column) else np.empty((0, 1))


def isotonic(counts: np.ndarray, sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit (pool adjacent violators): positions and levels of blocks."""
    blocks: list[list[float]] = []  # count, sum of labels, sum of positions
    for n, s, x in zip(counts, sums, at, strict=True):
        blocks.append([float(n), float(s), float(n * x)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 0], b[:, 1] / b[:, 0]


def fit(
    train: DataFrame,
    statistics: str = "statistics",
    label: str = "label",
    fold: str = "fold",
    features: int = 192,
    bandwidth: float = 4.0,
    ridge: float = 1e-3,
    seed: int = 7,
) -> QualityModel:
    """The model from all rows of ``train`` (``label`` 0 to 1, ``fold`` 0 to 2).

    The driver gets (features + 1) x (features + 2) sums a fold, and
    ``BINS`` counts: no more at any input size.
    """
    train = train.select(
        F.col(statistics).alias("x"),
        F.col(label).cast("double").alias("y"),
        F.coalesce(F.col(fold), F.lit(0)).cast("int").alias("fold"),
    ).where("x is not null and y is not null")
    width = len(STATISTICS)
    unit = F.lit(FIXED_POINT)
    moments = {
        r["i"]: r
        for r in train.select(F.posexplode("x").alias("i", "v"), "y")
        .groupBy("i")
        .agg(
            F.count("v").alias("n"),
            F.sum(F.round(F.col("v") * unit).cast("decimal(38,0)")).alias("s"),
            F.sum(F.round(F.col("v") * F.col("v") * unit).cast("decimal(38,0)")).alias("q"),
            F.sum(F.round(F.col("y") * unit).cast("decimal(38,0)")).alias("y"),
        )
        .collect()
    }
    rows = int(moments[0]["n"]) if moments else 0
    mean_label = float(moments[0]["y"]) / FIXED_POINT / rows if rows else 0.5
    mean, scale = np.zeros(width), np.ones(width)
    for i, r in moments.items():
        mean[i] = float(r["s"]) / FIXED_POINT / rows
        var = float(r["q"]) / FIXED_POINT / rows - mean[i] ** 2
        scale[i] = np.sqrt(var) if var > 1e-6 else 1.0
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(width, features)) / bandwidth
    phases = rng.uniform(0, 2 * np.pi, features)
    base = QualityModel(
        mean, scale, directions, phases, np.empty(0), np.zeros(1), np.array([mean_label])
    )
    if rows == 0 or mean_label in (0.0, 1.0):
        return base
    dim = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, dim, dim + 1))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = base.features(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy()
            f = batch.column(2).to_numpy() % FOLDS
            for k in range(FOLDS):
                own = z[f == k]
                total[k, :, :dim] += own.T @ own
                total[k, :, dim] += own.T @ y[f == k]
        fixed = np.rint(total * FIXED_POINT).astype(np.int64)
        if fixed.any():
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(0, fixed.size + 1, dim + 1, dtype=np.int32)),
                pa.array(fixed.ravel()),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(FOLDS * dim, dtype=np.int32)), flat], names=["row", "v"]
            )

    normal = np.zeros((FOLDS * dim, dim + 1))
    for r in (
        train.mapInArrow(sums, "row int, v array<bigint>")
        .select("row", F.posexplode("v").alias("col", "v"))
        .groupBy("row", "col")
        .agg(F.sum("v").alias("v"))
        .toLocalIterator()
    ):
        normal[r["row"], r["col"]] = r["v"] / FIXED_POINT
    normal = normal.reshape(FOLDS, dim, dim + 1)
    whole = normal.sum(axis=0)

    def solve(part: np.ndarray) -> np.ndarray:
        penalty = np.eye(dim) * ridge * max(part[dim - 1, dim - 1], 1.0)
        penalty[dim - 1, dim - 1] = 1e-9
        return np.linalg.solve(part[:, :dim] + penalty, part[:, dim])

    weights = solve(whole)
    # Without a fold, so that no row calibrates the model that it fitted.
    without = np.array([solve(whole - normal[k]) for k in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            f = batch.column(2).to_numpy() % FOLDS
            z = base.features(_matrix(batch.column(0)))
            raw = (z * without[f]).sum(axis=1)
            place = np.clip(np.rint((raw + 0.5) / 2 * BINS), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(np.rint(batch.column(1).to_numpy() * FIXED_POINT).astype(np.int64))],
                names=["bin", "y"],
            )

    bins = sorted(
        train.mapInArrow(binned, "bin int, y bigint")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("y").alias("y"))
        .collect()
    )
    at = np.array([r["bin"] for r in bins]) / BINS * 2 - 0.5
    knots, levels = isotonic(
        np.array([r["n"] for r in bins]), np.array([r["y"] / FIXED_POINT for r in bins]), at
    )
    return QualityModel(mean, scale, directions, phases, weights, knots, levels)


def add_score(
    df: DataFrame, model: QualityModel, statistics: str = "statistics", out: str = "score"
) -> DataFrame:
    """``df`` without ``statistics`` and with ``out``: the calibrated score, 0 to 1."""
    kept = [f for f in df.schema.fields if f.name not in (statistics, out)]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    names = [f.name for f in kept]
    source = df.select(*[_quoted(n) for n in names], _quoted(statistics).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.clip(model.score(_matrix(batch.column(len(names)))), 0.0, 1.0)
                cols = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score)], names=[*names, out])

    return source.mapInArrow(run, schema)


def score_texts(
    df: DataFrame, model: QualityModel, text: str = "text", out: str = "score"
) -> DataFrame:
    """``df`` with ``out``: the calibrated score of its whole ``text``, as ``add_score``
    gives it for ``add_statistics``; texts go to Python and back once."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    names = [f.name for f in kept]
    source, at = _with_text(df, names, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for first, last, data, offsets in text_chunks(column, CHUNK_BYTES, CHUNK_TEXTS):
                score = model.score(np.nan_to_num(_statistics(data, offsets)))
                cols = [batch.column(i).slice(first, last - first) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(np.clip(score, 0.0, 1.0))], names=[*names, out]
                )

    return source.mapInArrow(run, schema)
