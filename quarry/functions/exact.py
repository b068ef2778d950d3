"""Exact sums of ``bigint`` values that cannot overflow in practice.

A plain ``sum`` of ``bigint`` overflows past 9.2e18.  A ``decimal(38,0)``
sum does not, but Spark keeps decimals wider than 18 digits as byte arrays
in its rows, so a hash aggregate over them allocates a ``BigDecimal`` for
every input row; in a per-key aggregate that is about twice the cost of a
``bigint`` sum.

Instead each value ``v`` is split as ``v = high * 2**LOW_BITS + low`` with
``high = v >> LOW_BITS`` (arithmetic shift) and ``low = v & (2**LOW_BITS - 1)``,
so ``0 <= low < 2**LOW_BITS`` even for negative ``v``.  Both parts are summed
as ``bigint`` and recombined once, as ``decimal(38,0)``, on the final rows:

* the low sum overflows only past ``2**(63 - LOW_BITS)`` (8.8e12) rows in one
  group;
* the high sum overflows only when the group's true total passes about
  ``2**(63 + LOW_BITS)`` (9.7e24).

Under ANSI mode an overflow past those bounds raises.  With ANSI mode off it
would wrap, so ``quarry.operators.rollup`` refuses to plan there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: width of the low part of a split sum.
LOW_BITS = 20


def split_for_sum(value: Column) -> tuple[Column, Column]:
    """``(high, low)`` parts of a ``bigint`` ``value``; sum each separately."""
    v = value.cast("bigint")
    return F.shiftright(v, LOW_BITS), v.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("bigint"))


def combine_split_sums(high_total: Column, low_total: Column) -> Column:
    """The exact total, ``decimal(38,0)``, from the sums of the two parts."""
    return high_total.cast("decimal(38,0)") * F.lit(1 << LOW_BITS) + low_total.cast(
        "decimal(38,0)"
    )
