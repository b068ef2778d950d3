"""The driver's contract: entry, queries() and oracle_sql() agree."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SF_CHECK, SF_SMOKE, TESTDATA, duck, rows

SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER"}


def test_entry_runs_with_stable_schema(spark):
    df = contract.entry(spark)
    assert df.schema.simpleString() == (
        "struct<o_orderpriority:string,n_lines:bigint,revenue:double>"
    )
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(contract.core_queries()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("sf_dir", [SF_SMOKE, SF_CHECK, f"{TESTDATA}/sf0.1"])
@pytest.mark.parametrize("name", sorted(contract.core_queries()))
def test_query_matches_oracle(spark, name, sf_dir):
    df = contract.queries()[name](spark, sf_dir)
    con = duck(sf_dir)
    sql = contract.oracle_sql()[name]
    expected = sorted(con.execute(sql).fetchall())
    assert rows(df) == expected
    duck_schema = [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    spark_schema = [(f.name, SPARK_TO_DUCK[f.dataType.simpleString()]) for f in df.schema]
    assert spark_schema == duck_schema
