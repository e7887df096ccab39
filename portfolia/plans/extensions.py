"""Trends, territories and segments (2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from portfolia import bindings as b
from portfolia.operators import extensions as x
from portfolia.operators.integrate import round_half_up
from portfolia.plans.registry import query, sql


@query("x_risk_trajectory", sql(
    """SELECT broker_id, count(*) AS n_claims,
  CAST(round(CAST(regr_slope(y, t) AS DECIMAL(18,8)), 3) AS DOUBLE) AS slope,
  CAST(round(CAST(regr_intercept(y, t) AS DECIMAL(18,8)), 1) AS DOUBLE) AS intercept
FROM (SELECT p.broker_id, CAST(c.claim_amount AS DOUBLE) AS y,
    CAST(date_diff('day', DATE '2000-01-01', c.incident_date) AS DOUBLE) AS t
  FROM policies p JOIN claims c USING (policy_number)
  WHERE p.broker_id IS NOT NULL AND c.claim_amount IS NOT NULL AND c.incident_date IS NOT NULL) z
GROUP BY broker_id""", "policies", "claims"))
def _trajectory(spark, d):
    rows = x.risk_trajectory(b.policies(spark, d), b.claims(spark, d))
    return rows.withColumns({"slope": round_half_up(F.col("slope"), 3), "intercept": round_half_up(F.col("intercept"), 1)})


SHARES = """
SELECT broker_id, active, n_policies, territory,
  (floor(cents / k) + CASE WHEN i <= cents - floor(cents / k) * k THEN 1 ELSE 0 END) / 100 AS share
FROM (
  SELECT p.*, active, coalesce(len(t), 1) AS k, unnest(coalesce(t, [NULL])) AS territory,
    unnest(range(1, CAST(coalesce(len(t), 1) AS BIGINT) + 1)) AS i
  FROM (SELECT broker_id, count(*) AS n_policies,
      CAST(round(coalesce(sum(CAST(policy_annual_premium AS DECIMAL(18,2))), 0) * 100) AS BIGINT) AS cents
    FROM policies GROUP BY 1) p
  LEFT JOIN (SELECT broker_id, active, list_sort(list_distinct(territory)) AS t FROM brokers) o USING (broker_id)) z"""


@query("x_territory_premium", sql(
    """SELECT territory, round(CAST(sum(share) AS DOUBLE), 2) AS premium, count(DISTINCT broker_id) AS n_brokers,
  CAST(sum(n_policies) AS BIGINT) AS n_policies FROM shares GROUP BY 1""", "policies", "brokers", shares=SHARES))
def _premium(spark, d):
    rows = x.territory_premium(b.policies(spark, d), b.brokers(spark, d))
    return rows.withColumn("premium", F.round(F.col("premium").cast("double"), 2))


@query("x_territory_gaps", sql(
    """SELECT territory, count(*) AS n_brokers, round(CAST(coalesce(sum(share), 0) AS DOUBLE), 2) AS premium
FROM (SELECT broker_id, unnest(list_distinct(territory)) AS territory FROM brokers) n
LEFT JOIN shares USING (broker_id, territory)
WHERE territory NOT IN (SELECT territory FROM shares WHERE active AND territory IS NOT NULL) GROUP BY 1""",
    "policies", "brokers", shares=SHARES))
def _gaps(spark, d):
    rows = x.territory_gaps(b.policies(spark, d), b.brokers(spark, d))
    return rows.withColumn("premium", F.round(F.col("premium").cast("double"), 2))


@query("x_segment_customers")
def _segments(spark, d):
    rows = b.policies(spark, d).withColumn("policy", F.coalesce("policy_number", F.lit("none")))
    return x.segment_customers(rows, "policy", ["age", "policy_annual_premium", "policy_length_month"], 5)
