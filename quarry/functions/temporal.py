"""Time literals that compare with ``timestamp_ntz`` columns.

The date columns in the tables are ``timestamp_ntz``.  A Python ``datetime``
literal would become a zoned ``timestamp`` and drag the session time zone into
the comparison; a string cast to ``timestamp_ntz`` does not.  Catalyst folds
the cast into a literal, so the predicate still reaches the Parquet reader.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz_literal(value: str | dt.date | dt.datetime) -> Column:
    """A ``timestamp_ntz`` literal for ``value`` (ISO string, date or naive datetime)."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            raise ValueError("expected a naive datetime for a timestamp_ntz literal")
        text = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = value.isoformat()
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")
