"""Exact money arithmetic on whole cents.

The tables store prices and discounts as ``double`` values that are whole
cents (two decimal places).  Summing doubles gives a result that depends on
the order of addition, hence on partitioning and on which task finished
first.  Here each amount is turned into an integer number of cents, products
stay integers (``bigint``), and sums are exact and order-independent (see
``quarry.functions.exact`` for sums that a hot key or a 100 TB table would
push past the ``bigint`` range).

Integer cents also keep the hot path cheap: casting a ``double`` straight to
a ``decimal`` goes through its decimal string, and decimal products go
through ``java.math.BigDecimal``; ``rint`` plus ``bigint`` arithmetic stays
in generated code.

Nothing is rounded silently: an amount that is not a whole number of cents, or
that is beyond ``MAX_CENTS``, raises.  Nulls stay null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cents per currency unit; hundredths per whole discount;
# decimal places of a net price (cents x hundredths).
CENTS_PER_UNIT = 100
HUNDREDTHS = 100
NET_PRICE_SCALE = 4

# Largest amount taken, in cents: up to here a double tells neighbouring cents
# apart, and MAX_CENTS * (HUNDREDTHS + MAX_DISCOUNT) stays below 2**63, whether
# or not ANSI mode checks it.
MAX_CENTS = 1 << 46
MAX_DISCOUNT = 1 << 16


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(amount: str | Column, most: int = MAX_CENTS) -> Column:
    """A ``double`` amount such as ``1234.56`` as ``bigint`` cents (``123456``).

    Raises on an amount that isn't the double nearest to a whole number of
    cents, on NaN and infinity, and beyond ``most`` cents either way.
    """
    value = _col(amount)
    whole = F.rint(value * F.lit(float(CENTS_PER_UNIT)))
    exact = (whole / F.lit(float(CENTS_PER_UNIT)) == value) & (F.abs(whole) <= F.lit(float(most)))
    said = F.concat(
        F.lit("not a whole number of cents, or out of range: "), value.cast("string")
    )
    return F.when(value.isNull() | exact, whole.cast("bigint")).otherwise(F.raise_error(said))


def net_price_units(price: str | Column, discount: str | Column) -> Column:
    """``price * (1 - discount)`` exactly, as a ``bigint`` in units of 1e-4."""
    return cents(price) * (F.lit(HUNDREDTHS) - cents(discount, MAX_DISCOUNT))


def units_to_double(total: Column, scale: int = NET_PRICE_SCALE) -> Column:
    """An exact integer ``total`` in units of ``10**-scale`` as the nearest ``double``.

    The decimal's text is the exact quotient, and its cast to ``double`` is
    correctly rounded.  ``scale`` is 0 to 18; more raises.
    """
    if not 0 <= scale <= 18:
        raise ValueError(f"scale must be 0 to 18, got {scale}")
    exponent = F.lit(f"E-{scale}")
    return F.concat(total.cast("decimal(38,0)").cast("string"), exponent).cast("double")
