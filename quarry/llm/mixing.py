"""Mixing sources to target weights by Poisson replication.

Each row is repeated a Poisson-distributed number of times, the mean being its
source's target repetition rate: the source's target part of the mixture's
bytes over the bytes that it has.  The count comes from inverting the
distribution at a number that is a keyed hash of ``doc_id``, so it is the same
in every run, layout and retry.  A mean rate above ``RATE`` is a sum of equal rates
that are not, each inverted at a number of its own.  Rows are exploded by their count and dealt
out and sorted by a hash of id, copy and text, so that all sources are interleaved.

Sources without a weight of their own (a null one too) share ``REST`` and one
rate.  The rates are as many as the weights given, so they travel as literals:
no join, and a source that holds a third of all rows is spread like any other.
Everything is built-in DataFrame functions.

Defined results: weights of sources that have no row are shared out among the
others; a source whose texts are all empty keeps the mean rate ``epochs``;
rows of one doc_id get the same count, rows without one the count of the empty
id; an empty table gives no rows.  All input columns pass through; ``copy`` and
``repeats`` replace input columns of these names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REST = "*"
# Fixed value: hex digits of the hash that make the uniform number, 52 bits.
HASH_DIGITS = 13
# The largest mean of one draw.
RATE = 500.0


def poisson_cdf(rate: float) -> list[float]:
    """``P(N <= k)`` for k = 0, 1, ... until no 52-bit number can lie beyond."""
    if rate > 700:
        raise ValueError(f"a mean repetition rate of {rate:g} is beyond 700")
    p = total = math.exp(-rate)
    out = [total]
    while len(out) <= rate or 1.0 - total > 2.0**-53 and p > 2.0**-70:
        p = p * rate / len(out)
        total = total + p
        out.append(total)
    return out


def _group(weights: Mapping[str, float], source: str) -> F.Column:
    named = [s for s in weights if s != REST]
    return F.when(F.col(source).isin(named), F.col(source)).otherwise(F.lit(REST))


def rates(
    docs: DataFrame, weights: Mapping[str, float], epochs: float, source: str, text: str
) -> dict[str, float]:
    """Mean repetition rate by source; ``REST`` for all sources without a weight."""
    if not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    sizes = {
        r["g"]: int(r["b"])
        for r in docs.groupBy(_group(weights, source).alias("g"))
        .agg(F.sum(size.cast("bigint")).alias("b"))
        .collect()
    }
    whole = float(sum(sizes.values()))
    given = sum(float(weights.get(g, 0.0)) for g in sorted(sizes))
    out = {}
    for group, own in sizes.items():
        part = float(weights.get(group, 0.0)) / given if given else 0.0
        out[group] = part * epochs * whole / float(own) if own else epochs
    return out


def uniform(key: F.Column, seed: int) -> F.Column:
    """A number in [0, 1) of 52 bits, from a keyed hash."""
    return _uniform(F.lit(f"{seed}:"), key)


def _uniform(begin: F.Column, key: F.Column) -> F.Column:
    digest = F.sha2(F.concat(begin, F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(2.0**52)


def _drawn(cdf: F.Column, seed: int, j: F.Column, key: F.Column) -> F.Column:
    """Draw ``j`` of a row with several."""
    u = _uniform(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":")), key)
    return F.aggregate(
        cdf, F.lit(0).cast("bigint"), lambda n, c: n + F.when(c <= u, F.lit(1)).otherwise(F.lit(0))
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    epochs: float = 1.0,
    seed: int = 9,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``copy`` (1 to ``repeats``) and ``repeats``, in shuffled order."""
    names = [c for c in docs.columns if c not in ("copy", "repeats")]
    by_rate = rates(docs, weights, epochs, source, text)
    u = uniform(F.col(doc_id), seed)
    repeats = F.lit(0)
    group = _group(weights, source)
    for name, rate in sorted(by_rate.items()):
        draws = max(1, math.ceil(rate / RATE))
        cdf = F.array(*[F.lit(c) for c in poisson_cdf(rate / draws)])
        count = F.size(F.filter(cdf, lambda c: c <= u)).cast("bigint")
        if draws > 1:
            count = F.aggregate(
                F.sequence(F.lit(1), F.lit(draws)),
                F.lit(0).cast("bigint"),
                lambda total, j: total + _drawn(cdf, seed, j, F.col(doc_id)),
            )
        repeats = F.when(group == name, count).otherwise(repeats)
    counted = docs.select(*[F.col(f"`{n}`") for n in names], repeats.cast("bigint").alias("repeats"))
    copies = counted.where("repeats > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats")))
    )
    # The text as well, as many rows may lack an id or share one.
    order = F.xxhash64(F.lit(seed), F.col(doc_id), F.col("copy"), F.col(text))
    return (
        copies.withColumn("__order", order)
        .repartition("__order")
        .sortWithinPartitions("__order")
        .select(*[f"`{n}`" for n in names], "copy", "repeats")
    )


def mix_sql(weights: Mapping[str, float], seed: int = 9, columns: str = "") -> str:
    """The same rows as DuckDB SQL (one epoch)."""
    named = ", ".join(f"'{s}'" for s in weights if s != REST)
    values = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in weights.items())
    return f"""
WITH RECURSIVE weights(grp, weight) AS (VALUES {values}),
d AS (
  SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS grp,
         strlen(coalesce(text, '')) AS bytes,
         ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, {HASH_DIGITS}))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT grp, sum(bytes)::DOUBLE AS own FROM d GROUP BY grp),
rates AS (
  SELECT s.grp, CASE WHEN own = 0 THEN 1.0::DOUBLE ELSE
    coalesce(weight, 0) / (SELECT sum(weight) FROM weights JOIN sizes USING (grp))
    * (SELECT sum(own) FROM sizes) / own END AS rate
  FROM sizes s LEFT JOIN weights USING (grp)),
cdf AS (
  SELECT grp, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT grp, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < rate + 12 * sqrt(rate) + 30),
cdfs AS (SELECT grp, list(c) AS cs FROM cdf GROUP BY grp),
counted AS (
  SELECT d.*, len(list_filter(cs, lambda x: x <= u)) AS repeats FROM d JOIN cdfs USING (grp))
SELECT {columns}unnest(generate_series(1, repeats)) AS copy, repeats FROM counted
""".strip()
