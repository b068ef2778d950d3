"""Aggregate a fact table by attributes that live on a keyed table.

``rollup_through_key`` computes the same result as

    SELECT <group_cols>, <measures>
    FROM fact JOIN keyed ON fact.<fact_key> = keyed.<keyed_key>
    GROUP BY <group_cols>

but aggregates the fact rows per join key *before* the join (eager
aggregation), then joins the per-key partials and rolls them up to
``group_cols``.  This is exact for counts and sums, whether or not the keyed
table's key is unique: every fact row still meets every matching keyed row.

Why this shape at scale:

* Skew.  If one join key holds a third of the fact rows, the partial
  aggregate collapses it to one row per map task before the shuffle, so no
  reducer receives the hot key's rows.
* Skew on the other side.  Unless the caller declares the keyed table's key
  unique, its rows are collapsed in the same way, to one row per key and group
  with their number, and the partials are multiplied by it.  (Spark's own
  splitting of skewed joins can't apply here: the fact side is an aggregate,
  not a shuffle.)  The declaration changes the plan, never the result.
* Volume.  The join and its sort see at most one row per distinct key instead
  of every fact row.
* Shuffles.  The final per-key aggregate leaves its output hash-partitioned on
  the key, which is the distribution the sort-merge join needs, so the fact
  side is shuffled once, not twice.
* Broadcast.  Neither join input has a size bound: both grow with the data.
  The join therefore carries no broadcast hint.  A session that keeps
  adaptive execution on may still switch to a broadcast at run time, and it
  decides from the measured size of the materialised shuffle, not an
  estimate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exact import combine_split_sums, split_for_sum

_KINDS = ("count", "exact_sum")


@dataclass(frozen=True)
class Measure:
    """One output column.

    * ``count``: number of fact rows (``bigint``).
    * ``exact_sum``: exact sum of a ``bigint`` ``expr``, as ``decimal(38,0)``;
      carried through both aggregation levels as two ``bigint`` parts (see
      ``quarry.functions.exact``), so the hash aggregates stay on fixed-width
      values.

    ``finish`` optionally converts the total (e.g. to ``double``) once all
    adding is done.
    """

    name: str
    kind: str
    expr: Column | None = None
    finish: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.kind not in _KINDS:
            raise ValueError(f"measure kind must be one of {_KINDS}, got {self.kind!r}")
        if self.kind != "count" and self.expr is None:
            raise ValueError(f"{self.kind} measure {self.name!r} needs an expression")

    def per_key(self) -> list[Column]:
        """Aggregates over fact rows whose per-key results are the partials."""
        if self.kind == "count":
            return [F.count(F.lit(1))]
        return [F.sum(part) for part in split_for_sum(self.expr)]

    def total(self, part_totals: list[Column]) -> Column:
        """The output value from the group totals of the partials."""
        if self.kind == "exact_sum":
            value = combine_split_sums(*part_totals)
        else:
            (value,) = part_totals
        return self.finish(value) if self.finish is not None else value


def rollup_through_key(
    fact: DataFrame,
    fact_key: str,
    keyed: DataFrame,
    keyed_key: str,
    group_cols: Sequence[str],
    measures: Sequence[Measure],
    keyed_unique: bool = False,
) -> DataFrame:
    """Group ``fact`` joined to ``keyed`` by ``group_cols`` (columns of ``keyed``).

    Raises, before any job runs, if a sum could overflow unnoticed because the
    session has ANSI mode off.
    """
    if not measures:
        raise ValueError("at least one measure is required")
    if not group_cols:
        raise ValueError("at least one group column is required")
    ansi = fact.sparkSession.conf.get("spark.sql.ansi.enabled")
    if ansi.lower() != "true":
        raise ValueError("exact sums need spark.sql.ansi.enabled = true, or overflow is silent")
    missing = [c for c in group_cols if c not in keyed.columns]
    if missing:
        raise ValueError(f"group columns {missing} are not columns of the keyed table")

    names = []  # per measure, the names of its partial columns
    partials = []
    for i, m in enumerate(measures):
        cols = []
        for j, agg in enumerate(m.per_key()):
            cols.append(f"__part_{i}_{j}")
            partials.append(agg.alias(cols[-1]))
        names.append(cols)

    # Per-key partials.  Spark plans this as partial (map-side) + final hash
    # aggregate around one exchange on the key.
    per_key = fact.groupBy(F.col(fact_key).alias("__key")).agg(*partials)

    # Only the key and group columns of ``keyed`` survive column pruning.
    kept = [F.col(keyed_key).alias("__keyed"), *[F.col(c) for c in group_cols]]
    if keyed_unique:
        keyed, times = keyed.select(*kept), lambda c: F.col(c)
    else:
        keyed = (
            keyed.select(*kept).groupBy("__keyed", *group_cols).agg(F.count(F.lit(1)).alias("__rows"))
        )
        times = lambda c: F.col(c) * F.col("__rows")
    joined = per_key.join(keyed, per_key["__key"] == keyed["__keyed"], "inner")

    # Per-key counts and sums add up to group counts and sums.
    return joined.groupBy(*group_cols).agg(
        *[
            m.total([F.sum(times(c)) for c in cols]).alias(m.name)
            for m, cols in zip(measures, names)
        ]
    )
