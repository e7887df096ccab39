"""Metrics, bands, drill-down and remediation on own defect fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from portfolia.functions import bands
from portfolia.operators import quality

AT = "2024-03-01 12:00:00"


@pytest.fixture(scope="module")
def policies(spark):
    rows = [("1", "BRK001", 17), ("1", "BRK01", 18), ("1", None, 85), ("2", "brk014", 86), (None, "BRK002", None),
            (None, "BRK0022", 40), ("3", "INVALID_ID", 111)]
    return spark.createDataFrame(rows, "policy_number string, broker_id string, age long").withColumn(
        "row_id", F.monotonically_increasing_id())


def test_metrics(policies):
    out = quality.run_metrics(policies, "T", quality.DEFAULT_METRICS.assignments["CUSTOMERS_RAW"], AT)
    assert {r.metric_name: r.metric_value for r in out.collect()} == {
        "INVALID_CUSTOMER_AGE_COUNT": 3, "INVALID_BROKER_ID_COUNT": 4, "NULL_COUNT": 2,
        "DUPLICATE_COUNT": 1, "ROW_COUNT": 7}


def test_two_duplicate_columns(policies):
    metrics = [quality.duplicate_count("policy_number"), quality.duplicate_count("age"), quality.row_count()]
    out = quality.run_metrics(policies, "T", metrics, AT).collect()
    assert sorted(r.metric_value for r in out) == [0, 1, 7]


def test_empty_table(policies):
    out = quality.run_metrics(policies.where("false"), "T",
                              quality.DEFAULT_METRICS.assignments["CUSTOMERS_RAW"], AT)
    assert {r.metric_value for r in out.collect()} == {0}


def test_duplicate_drill_down_lists_rows(policies):
    # One value, three records: two numbers by design.
    assert quality.metric_scan(policies, quality.duplicate_count("policy_number")).count() == 3
    assert quality.metric_scan(policies, quality.null_count("policy_number")).count() == 2
    assert quality.metric_scan(policies, None).count() == 7
    top = quality.drill_down(policies, "CUSTOMERS_RAW", "invalid_customer_age_count", [F.col("age").desc()], 2)
    assert [r.age for r in top.collect()] == [111, 86]


@pytest.mark.parametrize("name,value,want", [
    ("NULL_COUNT", 0, "EXCELLENT"), ("NULL_COUNT", 5, "GOOD"), ("NULL_COUNT", 20, "WARNING"),
    ("NULL_COUNT", 21, "CRITICAL"), ("DUPLICATE_COUNT", 3, "GOOD"), ("DUPLICATE_COUNT", 10, "WARNING"),
    ("INVALID_X", 2, "GOOD"), ("INVALID_X", 11, "CRITICAL"), ("ROW_COUNT", 0, "UNKNOWN")])
def test_bands(spark, name, value, want):
    row = spark.range(1).select(bands.dq_status_band(F.lit(name), F.lit(value)).alias("s")).first()
    assert row.s == want


def test_perfect_table_scores_eighty(spark):
    rows = [("T", n, 0, AT) for n in ("NULL_COUNT", "DUPLICATE_COUNT", "INVALID_A", "INVALID_B")]
    df = spark.createDataFrame(rows + [("T", "ROW_COUNT", 9, AT)],
                               "table_name string, metric_name string, metric_value long, measurement_time string")
    assert quality.dq_entity_score(quality.with_status(df)).first().overall_quality_score == 80.0


def test_registry_attach_and_detach(spark):
    reg = quality.MetricRegistry().attach("T", quality.row_count(), quality.null_count("a"))
    assert reg.references(spark, "T").count() == 2
    assert reg.detach("T", "ROW_COUNT").references(spark).count() == 1
    assert reg.find("T", "null_count").columns == ("a",)


def test_remediation(policies):
    kept = quality.dedup_keep_latest(policies, "policy_number", F.col("age").desc_nulls_last(), F.col("row_id"))
    rows = kept.collect()
    named = [r for r in rows if r.policy_number is not None]
    assert sorted(r.policy_number for r in named) == ["1", "2", "3"]
    assert next(r.age for r in named if r.policy_number == "1") == 85
    assert sum(r.policy_number is None for r in rows) == 2
    surplus = quality.not_in_keepset(policies, "policy_number", "row_id",
                                     F.col("age").desc_nulls_last(), F.col("row_id"))
    assert sorted(r.age for r in surplus.collect()) == [17, 18]
    assert kept.count() + surplus.count() == policies.count()


def test_fix_null_keys(policies):
    fixed = quality.fix_null_keys(policies, "policy_number", ["row_id"])
    keys = [r.policy_number for r in fixed.collect()]
    new = [k for k in keys if k.startswith("POL_")]
    assert None not in keys and len(new) == 2 and all(len(k) == 11 for k in new)
    again = quality.fix_null_keys(policies, "policy_number", ["row_id"])
    assert sorted(keys) == sorted(r.policy_number for r in again.collect())
