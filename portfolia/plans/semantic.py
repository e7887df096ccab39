"""Semantic layer and business questions (items 27, 110-121)."""

from __future__ import annotations

from pyspark.sql import functions as F

from portfolia.operators import semantic as s
from portfolia.operators.feeds import count_rows
from portfolia.operators.integrate import round_half_up
from portfolia.plans.registry import query, sql
from portfolia.plans.risk import ANALYSIS_FIELDS, flat, portfolio, stats

HIGH = "(customer_risk_score >= 50 OR fraud_reported_filled)"
RATIO = """CAST(round(CAST(sum(claim_amount_filled / nullif(CAST(policy_annual_premium AS DOUBLE), 0))
  / count(nullif(policy_annual_premium, 0)) AS DECIMAL(18,6)), 4) AS DOUBLE)"""


def pct(part: str, whole: str) -> str:
    return f"CAST(round(CAST({part} * 100.0 / {whole} AS DECIMAL(18,6)), 2) AS DOUBLE)"


@query("semantic_filter", sql(
    f"SELECT final_risk_level, fraud_reported_filled, count(*) AS n FROM scored WHERE {HIGH} GROUP BY 1, 2",
    "scored"))
def _filter(spark, d):
    return portfolio(spark, d).where(s.semantic_filter()).groupBy(
        "final_risk_level", "fraud_reported_filled").agg(count_rows().alias("n"))


@query("semantic_model", sql(
    f"""SELECT customer_region, broker_tier, count(*) AS row_count,
  CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS avg_customer_risk_score,
  CAST(sum(claim_amount_filled) AS BIGINT) AS sum_claim_amount_filled,
  CAST(sum(broker_customer_count) AS DOUBLE) / count(*) AS avg_broker_customer_count,
  {RATIO} AS claim_to_premium_ratio
FROM l2 WHERE {HIGH} GROUP BY 1, 2""", "l2"))
def _model(spark, d):
    rows = portfolio(spark, d).join(stats(spark, d), "broker_id")
    return s.RISK_MODEL.query(
        rows, ["market_area", "broker_level"],
        ["count", "avg:customer_risk_rating", "sum:amount_paid", "avg:broker_portfolio_size", "loss_ratio"],
        ["risky_policies"])


@query("semantic_analysis_dimension", sql(
    f"""SELECT {", ".join(ANALYSIS_FIELDS)}, count(*) AS row_count,
  CAST(sum(broker_customer_count) AS DOUBLE) / count(*) AS avg_broker_customer_count,
  CAST(round(CAST(sum(broker_avg_claim) / count(*) AS DECIMAL(38,6)), 2) AS DOUBLE) AS avg_broker_avg_claim
FROM l2 JOIN analysis USING (broker_id) GROUP BY ALL""", "l2", "analysis"))
def _analysis_dimension(spark, d):
    rows = s.model_table(portfolio(spark, d), stats(spark, d))
    out = s.RISK_MODEL.query(
        rows, ["broker_success_evaluation"], ["count", "avg:broker_portfolio_size", "avg:mean_claim_per_broker"])
    return flat(out.withColumn("avg_broker_avg_claim", round_half_up(F.col("avg_broker_avg_claim"), 2)))


@query("m_claim_to_premium", sql(f"SELECT {RATIO} AS claim_to_premium_ratio, count(*) AS row_count FROM scored", "scored"))
def _metric(spark, d):
    return s.RISK_MODEL.query(portfolio(spark, d), metrics=["claim_to_premium_ratio", "count"])


@query("q_high_risk_share", sql(
    f"""SELECT count(*) FILTER (final_risk_level = 'HIGH') AS high_risk_policies, count(*) AS total_policies,
  {pct("count(*) FILTER (final_risk_level = 'HIGH')", "count(*)")} AS high_risk_pct FROM scored""", "scored"))
def _share(spark, d):
    return s.q_high_risk_share(portfolio(spark, d))


@query("q_fraud_claims", sql(
    """SELECT f.*, (SELECT avg_claim FROM f WHERE fraud_reported_filled)
  - (SELECT avg_claim FROM f WHERE NOT fraud_reported_filled) AS avg_difference FROM f""", "scored",
    f="""SELECT fraud_reported_filled, count(*) AS policies, CAST(sum(claim_amount_filled) AS BIGINT) AS total_claims,
  CAST(sum(claim_amount_filled) AS DOUBLE) / count(*) AS avg_claim FROM scored GROUP BY 1"""))
def _fraud(spark, d):
    return s.q_fraud_claims(portfolio(spark, d))


@query("q_tier_risk", sql(
    f"""SELECT broker_tier, CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS avg_risk_score,
  {pct("count(*) FILTER (fraud_reported_filled)", "count(*)")} AS fraud_rate, count(*) AS policies
FROM scored GROUP BY 1 ORDER BY 2, 3, 1""", "scored"))
def _tier(spark, d):
    return s.q_tier_risk(portfolio(spark, d))


@query("q_region_concentration", sql(
    f"""SELECT c.customer_region, final_risk_level, policies, {pct("policies", "n")} AS share_pct,
  avg_broker_experience
FROM (SELECT customer_region, final_risk_level, count(*) AS policies FROM scored GROUP BY 1, 2) c
JOIN (SELECT customer_region, count(*) AS n,
  CAST(sum(broker_experience) AS DOUBLE) / count(broker_experience) AS avg_broker_experience
  FROM scored GROUP BY 1) r ON r.customer_region = c.customer_region""", "scored"))
def _concentration(spark, d):
    return s.q_region_concentration(portfolio(spark, d))


TRAITS = ["broker_experience", "broker_training", "broker_satisfaction"]


@query("q_broker_profile_corr", sql(
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS trait, " + ", ".join(
            f"CAST(round(CAST(corr({t}, {m}) AS DECIMAL(18,6)), 6) AS DOUBLE) AS corr_{m}"
            for m in ("avg_risk", "avg_claim", "fraud_rate")) + " FROM per_broker" for t in TRAITS), "scored",
    per_broker="SELECT broker_id, " + ", ".join(f"max({t})::DOUBLE AS {t}" for t in TRAITS) + """,
  CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS avg_risk,
  CAST(sum(claim_amount_filled) AS DOUBLE) / count(*) AS avg_claim,
  CAST(count(*) FILTER (fraud_reported_filled) AS DOUBLE) / count(*) AS fraud_rate
FROM scored WHERE broker_experience IS NOT NULL GROUP BY 1"""))
def _profile(spark, d):
    return s.q_broker_profile_corr(portfolio(spark, d))


@query("q_high_risk_brokers", sql(
    f"""SELECT broker_id, count(*) AS high_risk_policies, max(broker_satisfaction) AS broker_satisfaction,
  max(broker_tier) AS broker_tier FROM scored WHERE {HIGH} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "scored"))
def _high_brokers(spark, d):
    return s.q_high_risk_brokers(portfolio(spark, d))


@query("q_ratio_by_tier", sql(
    f"SELECT broker_tier, {RATIO} AS claim_to_premium_ratio, count(*) AS policies FROM scored GROUP BY 1", "scored"))
def _ratio_tier(spark, d):
    return s.q_ratio_by_tier(portfolio(spark, d))


@query("q_ratio_by_tier_high_risk", sql(
    f"""SELECT broker_tier, {RATIO} AS claim_to_premium_ratio, count(*) AS policies FROM scored
WHERE {HIGH} GROUP BY 1""", "scored"))
def _ratio_tier_high(spark, d):
    return s.q_ratio_by_tier_high_risk(portfolio(spark, d))


@query("q_top_satisfaction_ratio", sql(
    """SELECT * FROM per_broker WHERE broker_satisfaction = (SELECT max(broker_satisfaction) FROM per_broker)""",
    "scored", per_broker=f"""SELECT broker_id, max(broker_satisfaction) AS broker_satisfaction,
  {RATIO} AS claim_to_premium_ratio, count(*) AS policies FROM scored WHERE {HIGH} GROUP BY 1"""))
def _top_satisfaction(spark, d):
    return s.q_top_satisfaction_ratio(portfolio(spark, d))


@query("q_worst_regions", sql(
    f"""SELECT customer_region, {RATIO} AS claim_to_premium_ratio, count(*) AS policies FROM scored
WHERE {HIGH} GROUP BY 1""", "scored"))
def _worst(spark, d):
    return s.q_worst_regions(portfolio(spark, d))
