"""Masks, row filter, governed view, classification (items 98-103)."""

from __future__ import annotations

from pyspark.sql import functions as F

from portfolia import bindings as b
from portfolia.operators import governance as g
from portfolia.plans.registry import query, sql
from portfolia.plans.risk import matrix

ADMIN, ANALYST = g.AccessContext("ACCOUNTADMIN"), g.AccessContext("WORKSHOP_ANALYST")
GUEST, CONSUMER = g.AccessContext("PUBLIC"), g.AccessContext("PUBLIC", "ORG_DATASHARING_CONSUMER_1")
AT = "2024-03-01 12:00:00"


@query("mask_financial", sql(
    """SELECT broker_id, total_premium_volume AS full_value,
  total_premium_volume - total_premium_volume % 10000 AS masked_value FROM matrix""", "matrix"))
def _mask(spark, d):
    value = F.col("total_premium_volume")
    return matrix(spark, d).select(
        "broker_id", g.mask_financial(ADMIN, value).alias("full_value"),
        g.mask_financial(GUEST, value).alias("masked_value"))


@query("mask_performance", sql(
    """SELECT broker_id, '{"performance_tier":"' || performance_tier || '","access_level":"external_view"}' AS analyst,
  '{"masked":true,"access_level":"restricted"}' AS guest FROM analysis""", "analysis"))
def _mask_performance(spark, d):
    value = F.col("broker_performance_analysis")
    return matrix(spark, d).select(
        "broker_id", g.mask_performance(ANALYST, value).alias("analyst"),
        g.mask_performance(GUEST, value).alias("guest"))


for _key, _ctx, _where in [
    ("row_policy_admin", ADMIN, "true"),
    ("row_policy_analyst", ANALYST, "broker_id IN ('BRK001', 'BRK002', 'BRK003')"),
    ("row_policy_consumer", CONSUMER, "broker_id IN ('BRK001', 'BRK002', 'BRK003')"),
    ("row_policy_other", GUEST, "true"),
]:
    def _rows(spark, d, ctx=_ctx):
        return g.row_policy(b.policies(spark, d), ctx)

    # A filter on NULL ids keeps nothing, as in SQL.
    query(_key, sql(f"SELECT * FROM policies WHERE {_where}", "policies"))(_rows)


@query("governed_view", sql(
    f"""SELECT matrix.* EXCLUDE (avg_customer_premium, total_premium_volume),
  floor(avg_customer_premium / 10000) * 10000 AS avg_customer_premium,
  floor(total_premium_volume / 10000) * 10000 AS total_premium_volume,
  '{{"performance_tier":"' || performance_tier || '","access_level":"external_view"}}'
    AS broker_performance_analysis,
  TIMESTAMP '{AT}' AS data_access_time
FROM matrix JOIN analysis USING (broker_id) WHERE broker_id IN ('BRK001', 'BRK002', 'BRK003')""",
    "matrix", "analysis"))
def _governed(spark, d):
    return g.governed_view(matrix(spark, d), ANALYST, accessed_at=AT)


@query("governed_view_other", sql(
    f"""SELECT matrix.* EXCLUDE (avg_customer_premium, total_premium_volume),
  floor(avg_customer_premium / 10000) * 10000 AS avg_customer_premium,
  floor(total_premium_volume / 10000) * 10000 AS total_premium_volume,
  '{{"masked":true,"access_level":"restricted"}}' AS broker_performance_analysis,
  TIMESTAMP '{AT}' AS data_access_time FROM matrix""", "matrix"))
def _governed_other(spark, d):
    return g.governed_view(matrix(spark, d), GUEST, accessed_at=AT)


@query("attach_detach_policy", sql(
    """SELECT matrix.* EXCLUDE (avg_customer_premium), floor(avg_customer_premium / 10000) * 10000
  AS avg_customer_premium FROM matrix""", "matrix"))
def _detach(spark, d):
    kept = (
        g.BROKER_POLICIES.without_mask("total_premium_volume").without_mask("broker_performance_analysis")
        .without_row_filter("broker_id")
    )
    return kept.apply(matrix(spark, d).drop("broker_performance_analysis"), ANALYST)


def _class_sql(table: str, column: str, category: str, pattern: str) -> str:
    return f"""SELECT '{column}' AS column_name, '{category}' AS category, count({column}) AS n_values,
  count(*) FILTER (regexp_matches(CAST({column} AS VARCHAR), '{pattern}')) AS n_matching FROM {table}"""


@query("classify_columns", sql(
    """SELECT 'POLICIES' AS table_name, c.*,
  CAST(round(CAST(CAST(n_matching AS DOUBLE) / n_values AS DECIMAL(18,6)), 4) AS DOUBLE) AS match_rate,
  CAST(n_matching AS DOUBLE) / n_values >= 0.8 AS sensitive FROM c""", "policies",
    c="\nUNION ALL ".join([
        _class_sql("policies", "policy_number", "POLICY_ID", "^[0-9]{6,}$"),
        _class_sql("policies", "age", "AGE", "^[0-9]{1,3}$"),
        _class_sql("policies", "insured_sex", "GENDER", "^(M|F)$"),
        _class_sql("policies", "insured_occupation", "OCCUPATION", "^[A-Za-z -]+$"),
    ])))
def _classify(spark, d):
    return g.classify_columns(b.policies(spark, d), "POLICIES")


@query("classify_broker_columns", sql(
    """SELECT 'BROKERS' AS table_name, c.*,
  CAST(round(CAST(CAST(n_matching AS DOUBLE) / n_values AS DECIMAL(18,6)), 4) AS DOUBLE) AS match_rate,
  CAST(n_matching AS DOUBLE) / n_values >= 0.8 AS sensitive FROM c""", "brokers",
    c="\nUNION ALL ".join([
        _class_sql("brokers", "first_name", "NAME", "^[A-Z][A-Za-z'' -]+$"),
        _class_sql("brokers", "last_name", "NAME", "^[A-Z][A-Za-z'' -]+$"),
        _class_sql("brokers", "email", "EMAIL", "^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$"),
    ])))
def _classify_brokers(spark, d):
    return g.classify_columns(b.brokers(spark, d), "BROKERS")
