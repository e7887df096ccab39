"""Quality metrics, scores, drill-down, remediation, alerts (items 13, 20-26, 34-51, 71, 89-90, 94-96)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from portfolia import bindings as b
from portfolia.functions import bands
from portfolia.operators import alerts, integrate, quality
from portfolia.plans.integration import RELATION
from portfolia.plans.registry import MEASURED_AT, query, sql
from portfolia.sources import files


def results(spark: SparkSession, d: str) -> DataFrame:
    tables = {"CUSTOMERS_RAW": b.policies(spark, d), "CLAIMS_RAW": b.claims(spark, d)}
    return quality.table_metric(tables, MEASURED_AT)


def summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_status(results(spark, d))


@query("table_metric", sql("SELECT * FROM history", "history"))
def _table_metric(spark, d):
    return results(spark, d)


for _key, _name, _table, _metric in [
    ("dq_invalid_age", "INVALID_CUSTOMER_AGE_COUNT", "CUSTOMERS_RAW", quality.invalid_age()),
    ("dq_invalid_broker_id", "INVALID_BROKER_ID_COUNT", "CUSTOMERS_RAW", quality.invalid_broker_id()),
    ("dq_null_count", "NULL_COUNT", "CLAIMS_RAW", quality.null_count("policy_number")),
    ("dq_duplicate_count", "DUPLICATE_COUNT", "CUSTOMERS_RAW", quality.duplicate_count("policy_number")),
    ("dq_row_count", "ROW_COUNT", "CLAIMS_RAW", quality.row_count()),
]:
    def _one(spark, d, table=_table, metric=_metric):
        df = b.policies(spark, d) if table == "CUSTOMERS_RAW" else b.claims(spark, d)
        return quality.run_metrics(df, table, [metric], MEASURED_AT[0])

    query(_key, sql(
        f"""SELECT m.*, TIMESTAMP '{MEASURED_AT[0]}' AS measurement_time,
  TIMESTAMP '{MEASURED_AT[0]}' AS change_commit_time FROM measured m
WHERE table_name = '{_table}' AND metric_name = '{_name}'""", "measured"))(_one)


@query("dq_status_band", sql("SELECT * FROM summary", "summary"))
def _band(spark, d):
    return summary(spark, d)


@query("dq_status_flag", sql(
    """SELECT table_name, metric_name, metric_value, CASE WHEN metric_value = 0 THEN 'OK'
  WHEN contains(metric_name, 'INVALID') THEN 'ATTENTION_REQUIRED'
  WHEN metric_name = 'NULL_COUNT' THEN 'DATA_COMPLETENESS_ISSUE'
  WHEN contains(metric_name, 'DUPLICATE') THEN 'DATA_UNIQUENESS_ISSUE' ELSE 'OK' END AS status_flag
FROM measured""", "measured"))
def _flag(spark, d):
    one = results(spark, d).where(F.col("measurement_time") == F.lit(MEASURED_AT[0]).cast("timestamp"))
    return quality.with_flag(one).select("table_name", "metric_name", "metric_value", "status_flag")


GRADE_OF = """(SELECT name FROM (VALUES ('EXCELLENT', 90), ('GOOD', 75), ('NEEDS_ATTENTION', 60),
  ('CRITICAL', -1)) AS g(name, least_score) WHERE {} >= least_score ORDER BY least_score DESC LIMIT 1)"""


@query("quality_grade", sql(
    """SELECT age, CASE WHEN age >= 90 THEN 'EXCELLENT' WHEN age >= 75 THEN 'GOOD'
  WHEN age >= 60 THEN 'NEEDS_ATTENTION' ELSE 'CRITICAL' END AS grade, count(*) AS n
FROM policies WHERE age IS NOT NULL GROUP BY 1""", "policies"))
def _grade(spark, d):
    # Ages run over 0..99, so every grade of a 0..100 score occurs.
    rows = b.policies(spark, d).where("age IS NOT NULL")
    return rows.groupBy("age", bands.quality_grade(F.col("age")).alias("grade")).agg(
        F.count(F.lit(1)).alias("n"))


@query("integrity_grade", sql(
    """SELECT age, CASE WHEN age >= 98 THEN 'EXCELLENT' WHEN age >= 95 THEN 'GOOD'
  WHEN age >= 90 THEN 'NEEDS_ATTENTION' ELSE 'CRITICAL' END AS grade, count(*) AS n
FROM policies WHERE age IS NOT NULL GROUP BY 1""", "policies"))
def _integrity_grade(spark, d):
    rows = b.policies(spark, d).where("age IS NOT NULL")
    return rows.groupBy("age", bands.integrity_grade(F.col("age")).alias("grade")).agg(
        F.count(F.lit(1)).alias("n"))


@query("filter_metric_history", sql(
    """SELECT h.*, CASE WHEN metric_value = 0 THEN 'OK'
  WHEN contains(metric_name, 'INVALID') THEN 'ATTENTION_REQUIRED' ELSE
  coalesce(CASE metric_name WHEN 'NULL_COUNT' THEN 'DATA_COMPLETENESS_ISSUE'
    WHEN 'DUPLICATE_COUNT' THEN 'DATA_UNIQUENESS_ISSUE' END, 'OK') END AS status_flag
FROM history h WHERE table_name = 'CUSTOMERS_RAW'
ORDER BY measurement_time DESC, table_name, metric_name""", "history"))
def _history(spark, d):
    return quality.filter_metric_history(results(spark, d), ["CUSTOMERS_RAW"])


@query("filter_recent", sql(
    """SELECT * FROM summary WHERE measurement_time >= TIMESTAMP '2024-03-01 12:20:00' - INTERVAL 1 HOUR
  AND quality_status = 'CRITICAL'""", "summary"))
def _recent(spark, d):
    return quality.filter_recent(summary(spark, d), "2024-03-01 12:20:00", status="CRITICAL")


@query("filter_graded", sql("SELECT * FROM summary WHERE metric_name <> 'ROW_COUNT'", "summary"))
def _graded(spark, d):
    return quality.filter_graded(summary(spark, d))


@query("age_distribution", sql(
    """SELECT 'AGE_DISTRIBUTION_ANALYSIS' AS analysis_type, count(*) AS total_customers,
  count(*) FILTER (age < 18) AS under_age_customers, count(*) FILTER (age > 85) AS over_age_customers,
  count(*) FILTER (age IS NULL) AS null_age_customers,
  count(*) FILTER (age NOT BETWEEN 18 AND 85) AS metric_invalid_age_count FROM policies""", "policies"))
def _age(spark, d):
    return quality.age_distribution(b.policies(spark, d))


@query("broker_id_patterns", sql(
    """SELECT 'BROKER_ID_PATTERN_ANALYSIS' AS analysis_type, count(*) AS total_broker_ids,
  count(*) FILTER (regexp_matches(broker_id, '^BRK[0-9]{3}$')) AS valid_format_ids,
  count(*) FILTER (NOT regexp_matches(broker_id, '^BRK[0-9]{3}$')) AS invalid_format_ids,
  count(*) FILTER (broker_id IS NULL) AS null_broker_ids,
  count(*) FILTER (NOT regexp_matches(broker_id, '^BRK[0-9]{3}$')) AS metric_invalid_broker_count
FROM policies""", "policies"))
def _patterns(spark, d):
    return quality.broker_id_patterns(b.policies(spark, d))


SCORE = """
SELECT table_name AS entity_name, count(*) AS total_metrics,
  count(*) FILTER (quality_status = 'EXCELLENT') AS excellent_count,
  count(*) FILTER (quality_status = 'GOOD') AS good_count,
  count(*) FILTER (quality_status = 'WARNING') AS warning_count,
  count(*) FILTER (quality_status = 'CRITICAL') AS critical_count,
  CAST(round(CAST(sum(coalesce(p.points, 0))::DOUBLE / count(*) AS DECIMAL(18,6)), 1) AS DOUBLE)
    AS overall_quality_score,
  max(measurement_time) AS last_measured
FROM {} LEFT JOIN (VALUES ('EXCELLENT', 100), ('GOOD', 80), ('WARNING', 60), ('CRITICAL', 20))
  AS p(status, points) ON p.status = quality_status
GROUP BY 1"""


@query("dq_entity_score", sql(SCORE.format("summary"), "summary"))
def _score(spark, d):
    return quality.dq_entity_score(summary(spark, d))


@query("dq_entity_score_latest", sql(
    SCORE.format("(SELECT * FROM summary WHERE measurement_time = (SELECT max(measurement_time) FROM summary)) z"),
    "summary"))
def _score_latest(spark, d):
    return quality.dq_entity_score(summary(spark, d), latest_only=True)


@query("dq_report", sql(
    """SELECT 'DATA_QUALITY_ASSESSMENT' AS report_type, entity_name, total_metrics, overall_quality_score,
  CASE WHEN overall_quality_score >= 90 THEN 'EXCELLENT' WHEN overall_quality_score >= 75 THEN 'GOOD'
    WHEN overall_quality_score >= 60 THEN 'NEEDS_ATTENTION' ELSE 'CRITICAL' END AS quality_grade,
  last_measured FROM score ORDER BY overall_quality_score DESC, 2""", "summary", score=SCORE.format("summary")))
def _report(spark, d):
    return quality.dq_report(summary(spark, d))


@query("dq_integrity_report", sql(
    """SELECT *, CASE WHEN integrity_percentage >= 98 THEN 'EXCELLENT' WHEN integrity_percentage >= 95 THEN 'GOOD'
  WHEN integrity_percentage >= 90 THEN 'NEEDS_ATTENTION' ELSE 'CRITICAL' END AS integrity_grade FROM rel""",
    "policies", "claims", rel=RELATION))
def _integrity(spark, d):
    return quality.dq_integrity_report(
        integrate.relationship_quality(b.policies(spark, d), b.claims(spark, d), MEASURED_AT[0]))


ISSUES = """
SELECT 'NULL_POLICY_NUMBERS_CUSTOMERS' AS issue_type, count(*) AS affected_records,
  'CUSTOMERS_RAW' AS table_name FROM policies WHERE policy_number IS NULL
UNION ALL SELECT 'DUPLICATE_POLICY_NUMBERS_CUSTOMERS', count(*), 'CUSTOMERS_RAW' FROM policies
  WHERE policy_number IN (SELECT policy_number FROM policies GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'NULL_POLICY_NUMBERS_CLAIMS', count(*), 'CLAIMS_RAW' FROM claims WHERE policy_number IS NULL
UNION ALL SELECT 'DUPLICATE_POLICY_NUMBERS_CLAIMS', count(*), 'CLAIMS_RAW' FROM claims
  WHERE policy_number IN (SELECT policy_number FROM claims GROUP BY 1 HAVING count(*) > 1)"""


@query("dq_issue_summary", sql(ISSUES, "policies", "claims"))
def _issues(spark, d):
    return quality.dq_issue_summary(b.policies(spark, d), b.claims(spark, d))


@query("dq_issue_totals", sql(
    """SELECT CAST(sum(affected_records) AS BIGINT) AS total_issues,
  count(*) FILTER (affected_records > 0) AS issue_types FROM issues""", "policies", "claims", issues=ISSUES))
def _issue_totals(spark, d):
    return quality.dq_issue_totals(quality.dq_issue_summary(b.policies(spark, d), b.claims(spark, d)))


@query("dq_row_counts_feed", sql(
    """SELECT table_name, metric_value AS row_count, measurement_time FROM history
WHERE metric_name = 'ROW_COUNT' ORDER BY 1, 3""", "history"))
def _row_counts(spark, d):
    return quality.dq_row_counts_feed(results(spark, d))


@query("dq_status_counts", sql(
    """SELECT table_name, quality_status, count(*) AS n FROM summary WHERE quality_status <> 'UNKNOWN' GROUP BY 1, 2
UNION ALL SELECT 'ALL', quality_status, count(*) FROM summary WHERE quality_status <> 'UNKNOWN' GROUP BY 2""",
    "summary"))
def _status_counts(spark, d):
    return quality.dq_status_counts(summary(spark, d))


@query("dq_health_summary", sql(
    """SELECT count(DISTINCT table_name) AS monitored_entities,
  count(DISTINCT table_name || '.' || metric_name) AS active_metrics,
  count(*) FILTER (quality_status = 'CRITICAL') AS critical_issues FROM summary""", "summary"))
def _health(spark, d):
    return quality.dq_health_summary(summary(spark, d))


# Drill-down: all offending rows. The screen's limit is a parameter of drill_down.
for _key, _table, _metric, _where in [
    ("metric_scan_age", "policies", "INVALID_CUSTOMER_AGE_COUNT", "age < 18 OR age > 85"),
    ("metric_scan_broker_id", "policies", "INVALID_BROKER_ID_COUNT", "NOT regexp_full_match(broker_id, 'BRK[0-9]{3}')"),
    ("metric_scan_null", "policies", "NULL_COUNT", "policy_number IS NULL"),
    ("metric_scan_duplicates", "policies", "DUPLICATE_COUNT",
     "policy_number IN (SELECT policy_number FROM policies GROUP BY 1 HAVING count(*) > 1)"),
    ("metric_scan_null_claims", "claims", "NULL_COUNT", "policy_number IS NULL"),
    ("metric_scan_duplicate_claims", "claims", "DUPLICATE_COUNT",
     "policy_number IN (SELECT policy_number FROM claims GROUP BY 1 HAVING count(*) > 1)"),
]:
    def _scan(spark, d, table=_table, metric=_metric):
        df = getattr(b, table)(spark, d)
        name = "CUSTOMERS_RAW" if table == "policies" else "CLAIMS_RAW"
        return quality.metric_scan(df, quality.DEFAULT_METRICS.find(name, metric))

    query(_key, sql(f"SELECT * FROM {_table} WHERE {_where}", _table))(_scan)


@query("drill_down_top", sql(
    """SELECT policy_number, broker_id, age, policy_start_date FROM policies WHERE age < 18 OR age > 85
ORDER BY age DESC, policy_start_date DESC, policy_number NULLS FIRST, broker_id NULLS FIRST LIMIT 100""",
    "policies"))
def _drill_down(spark, d):
    rows = b.policies(spark, d).select("policy_number", "broker_id", "age", "policy_start_date")
    return quality.drill_down(
        rows, "CUSTOMERS_RAW", "INVALID_CUSTOMER_AGE_COUNT",
        [F.col("age").desc(), F.col("policy_start_date").desc(),
         F.col("policy_number").asc_nulls_first(), F.col("broker_id").asc_nulls_first()], limit=100)


# Remediation ------------------------------------------------------------------------------

KEYED = "SELECT c_custkey, " + ", ".join(b.POLICY_COLUMNS) + " FROM customer"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Policies with the source row number, which is unique."""
    return b.table(spark, d, "customer").selectExpr("c_custkey", *b.POLICY_COLUMNS)


def newest() -> list[Column]:
    return [F.col("policy_start_date").desc(), F.col("c_custkey").desc()]


KEPT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy_number
  ORDER BY policy_start_date DESC, c_custkey DESC) AS rn FROM keyed) k
WHERE rn = 1 OR policy_number IS NULL"""


@query("dedup_keep_latest", f"WITH keyed AS ({KEYED}) SELECT * EXCLUDE (rn) FROM ({KEPT}) q")
def _dedup(spark, d):
    return quality.dedup_keep_latest(keyed(spark, d), "policy_number", *newest())


@query("null_key_semi", f"WITH keyed AS ({KEYED}) SELECT * FROM keyed WHERE policy_number IS NULL")
def _null_semi(spark, d):
    return quality.null_key_semi(keyed(spark, d), "policy_number")


@query("not_in_keepset", f"""WITH keyed AS ({KEYED}), kept AS ({KEPT})
SELECT keyed.* FROM keyed WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.c_custkey = keyed.c_custkey)""")
def _not_in(spark, d):
    return quality.not_in_keepset(keyed(spark, d), "policy_number", "c_custkey", *newest())


@query("fix_null_keys", sql(
    """SELECT CASE WHEN policy_number IS NULL THEN 11 ELSE length(policy_number) END AS key_length,
  policy_number IS NULL AS generated, count(*) AS n FROM policies GROUP BY 1, 2""", "policies"))
def _fix(spark, d):
    fixed = quality.fix_null_keys(keyed(spark, d), "policy_number", ["c_custkey", "policy_start_date"])
    return fixed.groupBy(
        F.length("policy_number").cast("long").alias("key_length"),
        F.col("policy_number").rlike("^POL_[1-9][0-9]{6}$").alias("generated"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("literal_rows", sql(
    """SELECT table_name, metric_name, metric_value FROM measured
UNION ALL SELECT 'CUSTOMERS_RAW', 'ROW_COUNT', 0 WHERE (SELECT count(*) FROM measured) = 0""", "measured"))
def _literal(spark, d):
    feed = results(spark, d).where(F.col("measurement_time") == F.lit(MEASURED_AT[0]).cast("timestamp"))
    feed = feed.select("table_name", "metric_name", "metric_value")
    fallback = files.literal_rows(spark, [("CUSTOMERS_RAW", "ROW_COUNT", 0)], feed.schema.simpleString()[7:-1])
    return files.or_else(feed, fallback)


@query("literal_rows_fallback", sql(
    """SELECT table_name, metric_name, metric_value FROM measured WHERE metric_value < 0
UNION ALL SELECT 'CUSTOMERS_RAW', 'ROW_COUNT', 0 WHERE (SELECT count(*) FROM measured WHERE metric_value < 0) = 0""",
    "measured"))
def _fallback(spark, d):
    """No metric is negative, so the fallback takes the feed's place."""
    feed = results(spark, d).where("metric_value < 0").select("table_name", "metric_name", "metric_value")
    fallback = files.literal_rows(spark, [("CUSTOMERS_RAW", "ROW_COUNT", 0)], feed.schema.simpleString()[7:-1])
    return files.or_else(feed, fallback)


@query("alert_history", """
SELECT event_id, ts AS alert_time, user_id FROM events WHERE event_type = 'error'
  AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE ORDER BY ts DESC""")
def _alert_history(spark, d):
    events = b.table(spark, d, "events")
    rows = events.where("event_type = 'error'").select(
        "event_id", F.col("ts").alias("alert_time"), "user_id")
    return alerts.alert_history(rows, events.agg(F.max("ts")).scalar(), minutes=24 * 60)
