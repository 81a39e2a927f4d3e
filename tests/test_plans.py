"""Plan checks: no cartesian products or nested-loop joins on default paths,
filters and column pruning reach the scans."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

# every query with a SQL twin, except the streaming one (its plan is a memory table)
CHECKED = sorted(n for n in E.oracle_sql() if n != "meter_stream")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_point_lookup_pushes_filter_and_prunes(spark):
    plan = _plan(E.queries()["point_lookup"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,42)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_fragment_lengths_prunes_columns(spark):
    plan = _plan(E.queries()["fragment_lengths"](spark, SF_SMALL))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
