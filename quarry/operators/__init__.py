"""Join and aggregation building blocks."""

from quarry.operators.rollup import Measure, rollup_through_key

__all__ = ["Measure", "rollup_through_key"]
