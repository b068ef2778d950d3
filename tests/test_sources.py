"""Explicit table schemas agree with the files; column subsets prune the scan."""

import pytest

from quarry.sources import TABLES, read_table
from quarry.sources.tables import SCHEMAS
from tests.conftest import SF_SMOKE, TESTDATA


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_declared_schema_is_the_file_schema(spark, sf):
    for name in TABLES:
        inferred = spark.read.parquet(f"{TESTDATA}/{sf}/{name}.parquet").schema
        declared = read_table(spark, f"{TESTDATA}/{sf}", name).schema
        assert [(f.name, f.dataType) for f in declared] == [
            (f.name, f.dataType) for f in inferred
        ], name


def test_column_subset_is_the_read_schema(spark):
    df = read_table(spark, f"{TESTDATA}/sf0.001", "orders", ["o_orderpriority", "o_orderkey"])
    assert df.columns == ["o_orderpriority", "o_orderkey"]
    assert df.count() == 1500
    assert df.where("o_orderkey IS NULL").count() == 0


def test_unknown_names_are_rejected(spark):
    with pytest.raises(ValueError, match="no column"):
        read_table(spark, f"{TESTDATA}/sf0.001", "orders", ["o_nope"])
    with pytest.raises(ValueError, match="unknown table"):
        read_table(spark, f"{TESTDATA}/sf0.001", "nope")
    assert set(SCHEMAS) == set(TABLES)


def test_missing_column_raises(spark, tmp_path):
    read_table(spark, SF_SMOKE, "lineitem").drop("l_extendedprice").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    with pytest.raises(ValueError, match="lineitem .* no column l_extendedprice"):
        read_table(spark, str(tmp_path), "lineitem", ["l_orderkey", "l_extendedprice"])
    assert read_table(spark, str(tmp_path), "lineitem", ["l_orderkey"]).count() > 0


def test_other_type_raises(spark, tmp_path):
    li = read_table(spark, SF_SMOKE, "lineitem")
    li.withColumn("l_discount", li.l_discount.cast("float")).write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    with pytest.raises(ValueError, match="lineitem.l_discount .* is float, not double"):
        read_table(spark, str(tmp_path), "lineitem")
