"""Reading the driver's Parquet tables.

Each table is one Parquet dataset under ``<sf_dir>/<name>.parquet``.  Reads
compare the files' schema (one footer, whatever the table's size) with the
declared one, since Parquet reads a missing column as nulls, and select only
the requested columns, so the scan's ``ReadSchema`` is pruned and a later
``where`` on a plain column is pushed into the Parquet reader by Catalyst.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# The driver's table schemas (the same at every scale factor).
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

TABLES = tuple(SCHEMAS)


def table_path(sf_dir: str, name: str) -> str:
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    return os.path.join(sf_dir, f"{name}.parquet")


def _columns(ddl: str) -> dict[str, str]:
    """``{"a": "BIGINT", ...}`` from a flat ``"a BIGINT, b STRING"`` schema."""
    out = {}
    for field in ddl.split(", "):
        name, _, dtype = field.partition(" ")
        out[name] = dtype
    return out


def read_table(
    spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Scan one table, keeping only ``columns`` when given.

    The kept columns form the read schema itself, so the Parquet reader reads
    just those and no extra projection is planned.  Raises if the files lack one
    of them or hold it as another type.
    """
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    ddl = SCHEMAS[name]
    known = _columns(ddl)
    if columns is not None:
        missing = [c for c in columns if c not in known]
        if missing:
            raise ValueError(f"{name} has no column(s) {missing}")
        ddl = ", ".join(f"{c} {known[c]}" for c in columns)
    path = table_path(sf_dir, name)
    found = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields}
    for c in columns if columns is not None else known:
        want = known[c].lower()
        want = "bigint" if want == "long" else want
        if c not in found:
            raise ValueError(f"{name} in {sf_dir} has no column {c}")
        if found[c] != want:
            raise ValueError(f"{name}.{c} in {sf_dir} is {found[c]}, not {want}")
    return spark.read.schema(ddl).parquet(path)
