"""File loading, tables, versions, catalog checks (items 1-12, 36, 68, 78, 92-93, 95, 97).

Inputs are files that Spark writes from the given tables into the scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from portfolia import bindings as b, schemas
from portfolia.operators import alerts, feeds, integrate
from portfolia.plans.registry import query, sql
from portfolia.session import scratch_dir
from portfolia.sources import files
from portfolia.sources.versions import SnapshotTable

RAW_CLAIMS = [
    "concat('  ', CAST(policy_number AS STRING), '.0 ') AS POLICY_NUMBER", "incident_date AS Incident_Date",
    "incident_type", "incident_severity", "authorities_contacted", "incident_hour_of_the_day",
    "number_of_vehicles_involved", "bodily_injuries", "witnesses", "police_report_available",
    "claim_amount AS CLAIM_AMOUNT", "fraud_reported",
]


def claim_files(spark: SparkSession, d: str, bad: bool = False) -> str:
    """Bound claims as CSV, with keys such as `` 900085.0 `` and mixed-case names."""
    path = scratch_dir(spark, "claim_csv")
    rows = b.claims(spark, d).selectExpr(*RAW_CLAIMS)
    if bad:
        amount = F.col("CLAIM_AMOUNT")
        rows = rows.withColumn(
            "CLAIM_AMOUNT", F.when(amount % 10 == 3, F.concat(F.lit("x"), amount.cast("string")))
            .otherwise(amount.cast("string")))
    # Two kinds of files: the second has its columns in reverse order and its header in capitals.
    other = F.pmod(F.xxhash64("incident_type", "witnesses"), F.lit(2)) == 1
    files.export_records_csv(rows.where(~other), path)
    turned = rows.where(other).select(*[F.col(c).alias(c.upper()) for c in reversed(rows.columns)])
    turned.write.mode("append").options(header=True, dateFormat=files.DATE_FORMAT).csv(path)
    return path


@query("read_csv_entity", sql("SELECT * FROM claims", "claims"))
def _csv(spark, d):
    return files.read_csv_entity(spark, claim_files(spark, d), schemas.CLAIMS)


@query("copy_into_by_name", sql("SELECT *, CAST(NULL AS VARCHAR) AS adjuster FROM claims", "claims"))
def _copy(spark, d):
    schema = T.StructType([*schemas.CLAIMS, T.StructField("adjuster", T.StringType())])
    return files.copy_into_by_name(spark, claim_files(spark, d), schema)


@query("copy_keeps_raw_key", sql(
    """SELECT policy_number, CASE WHEN policy_number IS NOT NULL THEN concat(policy_number, '.0') END
  AS policy_number_raw, count(*) AS n FROM claims GROUP BY 1""", "claims"))
def _copy_raw(spark, d):
    rows = files.copy_into_by_name(spark, claim_files(spark, d), schemas.CLAIMS, raw_keys=True)
    return rows.groupBy("policy_number", "policy_number_raw").agg(F.count(F.lit(1)).alias("n"))


@query("copy_json_by_name", sql("SELECT broker_id, first_name, office_location, active FROM brokers", "brokers"))
def _copy_json(spark, d):
    wanted = ("broker_id", "first_name", "office_location", "active")
    schema = T.StructType([f for f in schemas.BROKERS if f.name in wanted])
    return files.copy_into_by_name(spark, broker_files(spark, d), schema, "json")


@query("load_skip_bad_rows", sql(
    """SELECT * FROM claims WHERE claim_amount IS NULL OR claim_amount % 10 <> 3""", "claims"))
def _skip(spark, d):
    return files.load_skip_bad_rows(spark, claim_files(spark, d, bad=True), schemas.CLAIMS)[0]


@query("load_quarantine", sql(
    "SELECT policy_number, 'claim_amount' AS bad_column FROM claims WHERE claim_amount % 10 = 3", "claims"))
def _quarantine(spark, d):
    bad = files.load_skip_bad_rows(spark, claim_files(spark, d, bad=True), schemas.CLAIMS)[1]
    return bad.select("policy_number", F.array_join("_bad", ",").alias("bad_column"))


def broker_files(spark: SparkSession, d: str) -> str:
    """Bound brokers as JSON files that hold an array each."""
    path = scratch_dir(spark, "broker_json")
    rows = b.brokers(spark, d)
    # A few files, each with an outer array of several elements.
    arrays = rows.groupBy(F.pmod(F.xxhash64("broker_id"), F.lit(5)).alias("file")).agg(
        F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ",").alias("elements"))
    arrays.select(F.concat(F.lit("["), "elements", F.lit("]")).alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    return path


@query("read_json_entity", sql(
    """SELECT broker_id, first_name, satisfaction AS customer_satisfaction, training AS training_hours_completed,
  array_to_string(specializations, '|') AS specializations, active FROM brokers""", "brokers"))
def _json(spark, d):
    rows = files.read_json_entity(spark, broker_files(spark, d), schemas.BROKERS)
    return rows.select(
        "broker_id", "first_name", "performance_metrics.customer_satisfaction",
        "performance_metrics.training_hours_completed",
        F.array_join("specializations", "|").alias("specializations"), "active")


@query("sample_raw_json", sql(
    "SELECT broker_id, office_location FROM brokers", "brokers"))
def _sample(spark, d):
    # The bound brokers are fewer than the limit, so the sample is all of them.
    records = files.sample_raw_json(spark, broker_files(spark, d), 1000)
    return records.select(*[
        F.variant_get("record", f"$.{c}", "string").alias(c) for c in ("broker_id", "office_location")])


def _types_sql() -> str:
    """The type of every written column, from its values as they are before they are written."""
    parts = []
    for c in schemas.CLAIMS.fieldNames():
        whole = f"CASE WHEN max(abs(try_cast({c} AS BIGINT))) < 2147483648 THEN 'int' ELSE 'bigint' END"
        kind = "max('double')" if c == "policy_number" else (
            f"CASE any_value(typeof({c})) WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string'"
            f" ELSE {whole if c not in ('incident_date', 'fraud_reported') else 'NULL'} END")
        parts.append(f"SELECT '{c.upper()}' AS column_name, {kind} AS type, true AS nullable FROM claims")
    return " UNION ALL ".join(parts)


@query("infer_entity_schema", sql(_types_sql(), "claims"))
def _infer(spark, d):
    return files.describe_schema(spark, files.infer_entity_schema(spark, claim_files(spark, d))).drop("ordinal")


@query("create_from_template", "SELECT count(*) AS n_rows FROM orders")
def _template(spark, d):
    schema = files.infer_entity_schema(spark, claim_files(spark, d))
    empty = files.create_from_template(spark, schema)
    loaded = files.read_csv_entity(spark, claim_files(spark, d), schema)
    return empty.unionByName(loaded).agg(F.count(F.lit(1)).alias("n_rows"))


def files_by_source(spark: SparkSession, d: str) -> str:
    """Documents as JSON lines in one folder per source."""
    path = scratch_dir(spark, "by_source")
    b.table(spark, d, "documents").select("source", "doc_id", "text").write.partitionBy("source").json(path)
    return path


@query("select_files", """SELECT source, true AS has_files, true AS has_bytes FROM documents
WHERE source LIKE 'src1%' GROUP BY source""")
def _listing(spark, d):
    found = files.select_files(spark, files_by_source(spark, d), pattern=r"/source=src1[0-9]*/", suffixes=(".json",))
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)", 1).alias("source")).agg(
        (F.count("file_name") > 0).alias("has_files"), (F.min("length") > 0).alias("has_bytes"))


@query("limit_by_storage", """SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents
GROUP BY source ORDER BY n_bytes DESC, source LIMIT 3""")
def _largest(spark, d):
    return feeds.largest_groups(b.table(spark, d, "documents"), "source", "text", 3)


@query("document_scan", """
SELECT count(*) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents""")
def _scan(spark, d):
    path = scratch_dir(spark, "docs")
    # One file per document would be slow to list, so a line holds a document.
    b.table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(path)
    lines = files.document_scan(spark, path, "*.txt").select(F.explode(F.split("raw_text", "\n")).alias("line"))
    parsed = lines.where("line <> ''").select(F.from_json("line", "doc_id long, text string").alias("r"))
    return parsed.agg(F.count(F.lit(1)).alias("n_documents"),
                      F.sum(F.length("r.text")).alias("n_chars"))


@query("write_table", sql("SELECT * FROM policies", "policies"))
def _write(spark, d):
    return files.write_table(b.policies(spark, d), scratch_dir(spark, "policies"))


@query("export_records_csv", sql(
    "SELECT policy_number, broker_id, age, policy_start_date FROM policies WHERE age < 18 OR age > 85", "policies"))
def _export(spark, d):
    path = scratch_dir(spark, "export")
    rows = b.policies(spark, d).where("age < 18 OR age > 85")
    files.export_records_csv(rows.select("policy_number", "broker_id", "age", "policy_start_date"), path)
    schema = T.StructType([f for f in schemas.POLICIES if f.name in
                           ("policy_number", "broker_id", "age", "policy_start_date")])
    return files.read_csv_entity(spark, path, schema)


# Versions: all policies at noon, newest policy per key an hour later.


def snapshots(spark: SparkSession, d: str) -> SnapshotTable:
    table = SnapshotTable(spark, scratch_dir(spark, "policies_versions"))
    table.commit(b.policies(spark, d), "2024-03-01 12:00:00")
    table.commit(b.policies(spark, d).where("policy_number IS NOT NULL"), "2024-03-01 13:00:00")
    return table


@query("read_as_of", sql("SELECT * FROM policies", "policies"))
def _as_of(spark, d):
    return snapshots(spark, d).read_as_of("2024-03-01 12:30:00")


@query("read_before", sql("SELECT * FROM policies", "policies"))
def _before(spark, d):
    return snapshots(spark, d).read_before("2024-03-01 13:00:00")


@query("restore_version", sql(
    "SELECT count(*) AS restored_rows, count(*) AS version_rows FROM policies WHERE policy_number IS NOT NULL",
    "policies"))
def _restore(spark, d):
    return snapshots(spark, d).restore_version(scratch_dir(spark, "restored"))


@query("segment_risk_asof", sql(
    """SELECT customer_segment, count(*) AS customer_count,
  CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS avg_risk_score
FROM scored GROUP BY 1 ORDER BY 3 DESC, 1""", "scored"))
def _segment(spark, d):
    policies = snapshots(spark, d).read_as_of("2024-03-01 12:59:59")
    return feeds.segment_risk(integrate.scored_portfolio(policies, b.brokers(spark, d), b.claims(spark, d)))


# Catalog checks -------------------------------------------------------------------------


def _views(spark: SparkSession, d: str) -> None:
    b.policies(spark, d).createOrReplaceTempView("customers_raw")
    b.claims(spark, d).createOrReplaceTempView("claims_raw")


@query("metadata_checks", sql(
    """SELECT 'customers_raw' AS table_name, true AS table_exists, 10 AS n_columns, 'adjuster' AS missing_columns,
  count(*) AS record_count FROM policies
UNION ALL SELECT 'claims_raw', true, 12, '', count(*) FROM claims
UNION ALL SELECT 'no_such_table', false, 0, 'x', NULL""", "policies", "claims"))
def _metadata(spark, d):
    _views(spark, d)
    required = {"customers_raw": ["policy_number", "adjuster"], "claims_raw": ["claim_amount"],
                "no_such_table": ["x"]}
    return files.metadata_checks(spark, required).withColumn(
        "missing_columns", F.array_join("missing_columns", ","))


@query("exists_probe", sql(
    """SELECT 'customers_raw' AS table_name, false AS table_missing, count(*) AS record_count FROM policies""",
    "policies"))
def _probe(spark, d):
    _views(spark, d)
    return files.exists_probe(spark, "customers_raw")


@query("alert_missing_table", sql(
    """SELECT 'CUSTOMERS_MONITOR' AS alert, 'customers_raw' AS table_name, false AS triggered,
  TIMESTAMP '2024-03-01 12:00:00' AS alert_time, count(*) AS record_count, 0 AS message_lines FROM policies
UNION ALL SELECT 'RISK_DASHBOARD_MONITOR', 'no_such_table', true, TIMESTAMP '2024-03-01 12:00:00', NULL, 7""",
    "policies"))
def _alerts(spark, d):
    _views(spark, d)
    rules = [alerts.MissingTableRule("CUSTOMERS_MONITOR", "customers_raw"),
             alerts.MissingTableRule("RISK_DASHBOARD_MONITOR", "no_such_table")]
    rows = alerts.evaluate_alerts(spark, rules, "2024-03-01 12:00:00")
    lines = F.when(F.col("message").isNull(), 0).otherwise(F.size(F.split("message", "\n")))
    return rows.withColumn("message_lines", lines).drop("message")
