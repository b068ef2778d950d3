"""Column expression builders (built-in Spark functions only)."""

from quarry.functions.exact import combine_split_sums, split_for_sum
from quarry.functions.money import cents, net_price_units, units_to_double
from quarry.functions.temporal import ntz_literal

__all__ = [
    "cents",
    "combine_split_sums",
    "net_price_units",
    "ntz_literal",
    "split_for_sum",
    "units_to_double",
]
