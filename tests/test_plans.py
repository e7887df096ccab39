"""Plan shapes: what must and must not be in the physical plans."""

from __future__ import annotations

import pytest

from portfolia import bindings as b
from portfolia.operators import integrate, quality
from portfolia.plans import QUERIES
from tests.conftest import plan_of

STREAMED = ("ingest_stream", "stream_ingest", "refresh_chain", "scheduled_metrics", "change_totals")
PYTHON = ("broker_performance_exact", "chunk_", "parse_layout", "build_chunk_table", "search_")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(STREAMED)])
def test_no_pairing_of_all_rows_and_no_row_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SinglePartition, REPARTITION"):
        assert bad not in plan
    if not name.startswith(PYTHON):
        assert "ArrowEvalPython" not in plan and "MapIn" not in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = QUERIES["risk_profiles"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "c_name" not in plan.split("== Physical Plan ==")[1]
    assert "o_orderpriority" not in plan.split("== Physical Plan ==")[1]


def test_one_scan_per_table_for_all_metrics(spark, sf_dir):
    metrics = quality.DEFAULT_METRICS.assignments["CUSTOMERS_RAW"]
    plan = plan_of(quality.run_metrics(b.policies(spark, sf_dir), "T", metrics, "2024-01-01 00:00:00"))
    assert plan.count("FileScan") == 1


def test_top_k_and_first_row_per_key(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_brokers"](spark, sf_dir))
    assert "WindowGroupLimit" in plan_of(QUERIES["dedup_keep_latest"](spark, sf_dir))


def test_level_two_has_no_window_over_brokers(spark, sf_dir):
    assert "Window" not in plan_of(QUERIES["risk_dashboard"](spark, sf_dir))



def test_levels_read_each_table_a_few_times(spark, sf_dir):
    """Hot keys are counted before the plan of the levels is made; without any, the plan has no branch for them."""
    for name, most in (("integrate_entities", 5), ("risk_dashboard", 9)):
        assert plan_of(QUERIES[name](spark, sf_dir)).count("FileScan") <= most, name
