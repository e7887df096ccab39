"""Link checks, counts and unions (items 28, 30-32, 37, 69, 79)."""

from __future__ import annotations

from pyspark.sql import functions as F

from portfolia import bindings as b
from portfolia.operators import feeds, integrate
from portfolia.plans.registry import query, sql
from portfolia.plans.risk import portfolio

NOW = "2024-03-01 12:00:00"


@query("check_broker_link", sql(
    """SELECT 'CUSTOMER-BROKER RELATIONSHIP' AS check_type, count(p.policy_number) AS customers_with_brokers,
  count(b.broker_id) AS matched_brokers
FROM policies p LEFT JOIN brokers b ON p.broker_id = b.broker_id""", "policies", "brokers"))
def _broker_link(spark, d):
    return integrate.check_broker_link(b.policies(spark, d), b.brokers(spark, d))


@query("check_claim_link", sql(
    """SELECT 'CUSTOMER-CLAIMS RELATIONSHIP' AS check_type, count(DISTINCT p.policy_number)
  AS customers_with_claims, count(c.policy_number) AS total_claims
FROM policies p JOIN claims c ON p.policy_number = c.policy_number""", "policies", "claims"))
def _claim_link(spark, d):
    return integrate.check_claim_link(b.policies(spark, d), b.claims(spark, d))


RELATION = """
SELECT 'CUSTOMER_CLAIMS_INTEGRITY' AS relationship_type, total_customers, valid_relationships,
  total_customers - valid_relationships AS missing_relationships,
  CAST(round(CAST(valid_relationships * 100.0 / total_customers AS DECIMAL(18,6)), 2) AS DOUBLE)
    AS integrity_percentage, TIMESTAMP '2024-03-01 12:00:00' AS measured_at
FROM (SELECT count(DISTINCT p.policy_number) AS total_customers,
  count(DISTINCT c.policy_number) AS valid_relationships
  FROM policies p LEFT JOIN claims c ON p.policy_number = c.policy_number) x"""


@query("relationship_quality", sql(RELATION, "policies", "claims"))
def _relationship(spark, d):
    return integrate.relationship_quality(b.policies(spark, d), b.claims(spark, d), "2024-03-01 12:00:00")


COUNTS = """
SELECT 'CUSTOMERS' AS entity, count(*) AS total_records, count(DISTINCT policy_number) AS unique_policies,
  count(DISTINCT broker_id) AS unique_brokers FROM policies
UNION ALL SELECT 'CLAIMS', count(*), count(DISTINCT policy_number), NULL FROM claims
UNION ALL SELECT 'BROKERS', count(*), count(DISTINCT broker_id), NULL FROM brokers"""


@query("entity_counts", sql(COUNTS, "policies", "claims", "brokers"))
def _entity_counts(spark, d):
    return feeds.entity_counts(b.policies(spark, d), b.claims(spark, d), b.brokers(spark, d))


@query("union_all_branches", sql(
    """SELECT policy_number, broker_id, CAST(NULL AS BIGINT) AS claim_amount, 'policy' AS branch FROM policies
UNION ALL SELECT policy_number, NULL, claim_amount, 'claim' FROM claims""", "policies", "claims"))
def _union(spark, d):
    return feeds.union_all_branches(
        b.policies(spark, d).select("policy_number", "broker_id", F.lit("policy").alias("branch")),
        b.claims(spark, d).select("policy_number", "claim_amount", F.lit("claim").alias("branch")),
    )


@query("entity_summary", sql(
    f"""SELECT *, TIMESTAMP '{NOW}' AS cleanup_time FROM (
SELECT 'CUSTOMERS' AS entity, count(*) AS record_count, count(DISTINCT customer_region) AS regions,
  count(DISTINCT broker_id) AS brokers FROM scored
UNION ALL SELECT 'CLAIMS', count(*), count(DISTINCT CASE WHEN claim_amount_filled > 0 THEN 1 END),
  count(DISTINCT policy_number) FROM scored
UNION ALL SELECT 'BROKERS', count(*), count(DISTINCT broker_office), count(DISTINCT broker_tier) FROM scored) x""",
    "scored"))
def _entity_summary(spark, d):
    return feeds.entity_summary(portfolio(spark, d), NOW)


@query("distinct_listing", sql(
    """SELECT DISTINCT insured_occupation AS occupation, insured_education_level AS education,
  insured_sex AS sex FROM policies ORDER BY 1, 2, 3""", "policies"))
def _distinct(spark, d):
    return (
        b.policies(spark, d)
        .select(F.col("insured_occupation").alias("occupation"),
                F.col("insured_education_level").alias("education"), F.col("insured_sex").alias("sex"))
        .distinct().orderBy("occupation", "education", "sex")
    )
