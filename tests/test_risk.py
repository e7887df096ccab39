"""Scores, tiers and the three levels on small own fixtures."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from portfolia import schemas
from portfolia.functions import risk
from portfolia.operators import integrate


def _score(age, premium, claim):
    if age is None:
        base = 50
    else:
        for below, limit, over, other in risk.AGE_BANDS:
            if below is None or age < below:
                base = over if claim is not None and claim > limit else other
                break
    return base + (10 if premium and premium > 2000 else 5 if premium and premium > 1500 else 0)


def test_risk_score_edges(spark):
    ages = [None, 0, 24, 25, 34, 35, 54, 55, 120]
    premiums = [None, 0.0, 1500.0, 1500.01, 2000.0, 2000.01]
    claims = [None, 0, 50000, 50001, 75000, 75001, 100000, 100001]
    rows = [(a, p, c) for a in ages for p in premiums for c in claims]
    df = spark.createDataFrame(rows, "age long, premium double, claim long").select(
        "*", risk.risk_score(F.col("age"), F.col("premium"), F.col("claim")).alias("s"),
        risk.risk_score(F.col("age"), F.col("premium"),
                        risk.band_floor(risk.claim_band(F.col("claim")))).alias("by_band"))
    for r in df.collect():
        assert r.s == _score(r.age, r.premium, r.claim) == r.by_band
        assert r.s in {b + e for b in (20, 25, 40, 45, 50, 55, 65, 70, 85) for e in (0, 5, 10)}


def test_sql_functions_agree(spark):
    risk.register_sql_functions(spark)
    df = spark.createDataFrame([(20, 60000), (40, 5), (None, 1)], "age long, claim long")
    df = df.withColumn("premium", F.lit("1600.00").cast("decimal(10,2)"))
    for r in df.select("age", "claim", F.expr("risk_score(age, premium, claim)").alias("s")).collect():
        assert r.s == _score(r.age, 1600.0, r.claim)


def test_broker_analysis_golden(spark):
    # satisfaction 5, experience 7, training 30+, over 28 customers, mean claim 48,581.907
    df = spark.createDataFrame([(5, 7, 39, 97, 48581.907)], "s long, e long, t long, n long, c double")
    for exact in (False, True):
        a = df.select(risk.broker_performance(*[F.col(c) for c in "setnc"], exact).alias("a")).first().a
        assert (a.satisfaction_component, a.experience_component, a.training_component) == (100, 56, 60)
        assert (a.portfolio_component, a.risk_management_component) == (50, 25.7)
        assert a.total_score == 291.7 and a.performance_tier == "ELITE"


def test_broker_analysis_native_and_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 4, 5]), rng.randint(0, 20), rng.randint(0, 60), rng.randint(0, 60),
             rng.choice([0.0, None, rng.uniform(0, 2e5)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "s long, e long, t long, n long, c double")
    cols = [F.col(c) for c in "setnc"]
    out = df.select(risk.broker_performance(*cols).alias("n"), risk.broker_performance(*cols, True).alias("x"))
    for r in out.collect():
        parts = [r.x[c] for c in risk.ANALYSIS_COMPONENTS]
        assert abs(sum(parts) - r.x.total_score) <= 0.3
        assert r.n.performance_tier == r.x.performance_tier
        for f in schemas.BROKER_ANALYSIS.names:
            if f != "performance_tier":
                assert abs(r.n[f] - r.x[f]) < 0.1001
    assert math.log(28) * 15 < 50 < math.log(29) * 15


@pytest.fixture(scope="module")
def entities(spark):
    p = [("1", "BRK001", 20, 1600.0), ("1", "BRK001", 40, 3000.0), ("2", "BRK001", None, None),
         (None, "BRK002", 60, 100.0), ("3", "INVALID_ID", 30, 2500.0), ("4", None, 33, 900.0)]
    policies = spark.createDataFrame(p, "policy_number string, broker_id string, age long, prem double").select(
        "policy_number", "age", "broker_id", F.col("prem").cast("decimal(10,2)").alias("policy_annual_premium"),
        F.lit("M").alias("insured_sex"), F.lit("x").alias("insured_education_level"),
        F.lit("y").alias("insured_occupation"), F.lit(None).cast("date").alias("policy_start_date"),
        F.lit(12).cast("long").alias("policy_length_month"),
        F.lit(500).cast("decimal(10,2)").alias("policy_deductable"))
    c = [("1", 60000, True), ("1", None, None), ("1", 10, False), ("9", 5, True), (None, 7, False), ("4", 1, True)]
    claims = spark.createDataFrame(c, "policy_number string, claim_amount long, fraud_reported boolean")
    for f in schemas.CLAIMS:
        if f.name not in claims.columns:
            claims = claims.withColumn(f.name, F.lit(None).cast(f.dataType))
    brokers = spark.createDataFrame(
        [("BRK001", "Ann", "A", "London Bridge", 4.5, 12, 41), ("BRK002", "Bob", "B", "Leeds", 4.4, 12, 41)],
        "broker_id string, first_name string, last_name string, office_location string, s double, e long, t long",
    ).select("broker_id", "first_name", "last_name", "office_location",
             F.struct(F.col("s").alias("customer_satisfaction"), F.col("t").alias("training_hours_completed"),
                      F.col("e").alias("years_experience")).alias("performance_metrics"))
    for f in schemas.BROKERS:
        if f.name not in brokers.columns:
            brokers = brokers.withColumn(f.name, F.lit(None).cast(f.dataType))
    return policies, brokers, claims


def test_levels(entities):
    l1 = integrate.integrate_entities(*entities)
    assert l1.count() == 2 * 3 + 1 + 1 + 1 + 1 and len(l1.columns) == 34
    rows = integrate.risk_dashboard(*entities).collect()
    assert len(rows) == 9 and len(rows[0]) == 24
    one = [r for r in rows if r.broker_id == "BRK001"]
    assert {r.broker_customer_count for r in one} == {7}
    assert {r.broker_avg_claim for r in one} == {2 * 60010 / 7}
    # 4.5 rounds to 5, 4.4 to 4, so the second broker can only be bronze.
    assert {r.broker_tier for r in one} == {"PLATINUM"}
    assert [r.broker_tier for r in rows if r.broker_id == "BRK002"] == ["BRONZE"]
    odd = next(r for r in rows if r.broker_id == "INVALID_ID")
    assert (odd.customer_region, odd.broker_tier, odd.broker_first_name) == ("Other Region", "BRONZE", None)


def test_summed_portfolio_equals_rows(entities):
    by = ["broker_id", "customer_segment", "final_risk_level", "fraud_reported_filled"]
    rows = integrate.risk_dashboard(*entities).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("claim_amount_filled").alias("c"))
    summed = integrate.scored_portfolio(*entities).groupBy(*by).agg(
        F.sum("weight").alias("n"), F.sum("claim_total").alias("c"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, summed.collect()))


def test_stored_levels_equal_direct(entities):
    l1 = integrate.integrate_entities(*entities)
    a = integrate.dashboard_from(l1)
    b = integrate.risk_dashboard(*entities)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    m = integrate.matrix_from_dashboard(b)
    assert sorted(map(str, m.collect())) == sorted(map(str, integrate.matrix_from(*entities).collect()))
