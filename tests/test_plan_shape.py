"""The physical plan is the one designed for scale (see quarry.operators.rollup)."""

import contextlib
import io
import re

import pytest

from quarry.plans import revenue_by_priority_at
from tests.conftest import SF_CHECK

CODEGEN_OPS = ("Filter", "Project", "HashAggregate", "BroadcastHashJoin", "SortMergeJoin")
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "InPandas", "MapInArrow")


def formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def node_headers(plan):
    """Lines like ``(5) HashAggregate [codegen id : 1]`` from the details section."""
    return re.findall(r"^\(\d+\) (.+)$", plan, flags=re.M)


@pytest.fixture(scope="module")
def initial_plan(spark):
    return formatted(revenue_by_priority_at(spark, SF_CHECK))


def test_scans_are_pruned_and_filtered(initial_plan):
    assert (
        "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,"
        "l_discount:double,l_shipdate:timestamp_ntz>" in initial_plan
    )
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in initial_plan
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate,1996-01-01T00:00\)", initial_plan)


def test_three_shuffles_and_map_side_combine(initial_plan):
    headers = node_headers(initial_plan)
    exchanges = [h for h in headers if h.split()[0] == "Exchange"]
    # per-order partials, orders, per-priority partials: the join reuses the
    # per-order aggregate's partitioning instead of shuffling line items again.
    assert len(exchanges) == 3
    details = initial_plan.split("\n\n")
    # Map-side combine per order key, feeding the exchange on that key ...
    assert any(
        "HashAggregate" in d
        and "Keys [1]: [l_orderkey" in d
        and re.search(r"Functions \[\d+\]: \[partial_count\(1\), partial_sum\(", d)
        for d in details
    )
    assert any("Exchange" in d and "hashpartitioning(l_orderkey" in d for d in details)
    # ... and per priority before the last one.
    assert any(
        "HashAggregate" in d and "Keys [1]: [o_orderpriority" in d and "partial_sum(__part_0_0" in d
        for d in details
    )


def test_no_broadcast_from_static_estimates(initial_plan):
    assert "BroadcastExchange" not in initial_plan
    assert "SortMergeJoin" in initial_plan


def test_no_python_in_tasks(initial_plan):
    for name in PYTHON_NODES:
        assert name not in initial_plan


def test_executed_plan_stays_in_codegen(spark):
    df = revenue_by_priority_at(spark, SF_CHECK)
    df.collect()
    plan = formatted(df)
    assert "isFinalPlan=true" in plan
    tree = plan.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    # Tree lines look like ``+- * HashAggregate (25)``; ``*`` marks whole-stage codegen.
    nodes = re.findall(r"(\* )?([A-Za-z]+)[^\n(]*\(\d+\)", tree)
    assert any(op in CODEGEN_OPS for _, op in nodes)
    for star, op in nodes:
        if op in CODEGEN_OPS:
            assert star, f"{op} runs outside whole-stage codegen"
