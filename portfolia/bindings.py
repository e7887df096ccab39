"""Test tables seen as policies, brokers and claims.

The driver's tables hold no defects, so each defect class (missing keys,
repeated keys, malformed ids, ages out of range, orphan claims) is put in by key
arithmetic. Every row of every table is bound. The expressions are plain SQL
that Spark and DuckDB read alike, so the oracles use the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

POLICY_COLUMNS = [
    "CASE WHEN c_custkey % 20 = 7 THEN NULL WHEN c_custkey % 13 = 5 THEN '900004'"
    " ELSE CAST(900000 + c_custkey AS STRING) END AS policy_number",
    "CASE WHEN c_custkey % 29 = 0 THEN NULL"
    " WHEN c_custkey % 17 = 3 THEN concat('BK', lpad(CAST(c_nationkey AS STRING), 3, '0'))"
    " ELSE concat('BRK', lpad(CAST(c_nationkey AS STRING), 3, '0')) END AS broker_id",
    "CASE WHEN c_custkey % 31 = 1 THEN NULL ELSE CAST(c_custkey * 37 % 100 AS BIGINT) END AS age",
    "DATE '1990-01-01' + CAST(c_custkey * 7919 % 12000 AS INT) AS policy_start_date",
    "CAST(1 + c_custkey * 11 % 500 AS BIGINT) AS policy_length_month",
    "CAST(CASE WHEN c_custkey % 3 = 0 THEN 500 WHEN c_custkey % 3 = 1 THEN 1000"
    " ELSE 2000 END AS DECIMAL(10,2)) AS policy_deductable",
    "CASE WHEN c_custkey % 47 = 11 THEN NULL ELSE"
    " CAST(CAST(FLOOR(ABS(c_acctbal) * 30) AS DOUBLE) / 100 AS DECIMAL(10,2)) END"
    " AS policy_annual_premium",
    "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS insured_sex",
    "CASE WHEN c_custkey % 4 = 0 THEN 'PhD' WHEN c_custkey % 4 = 1 THEN 'MD'"
    " WHEN c_custkey % 4 = 2 THEN 'JD' ELSE 'College' END AS insured_education_level",
    "c_mktsegment AS insured_occupation",
]

BROKER_COLUMNS = [
    "concat('BRK', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS broker_id",
    "n_name AS first_name",
    "r_name AS last_name",
    "concat(lower(n_name), '@example.com') AS email",
    "CASE WHEN n_nationkey % 6 = 0 THEN 'London' WHEN n_nationkey % 6 = 1 THEN 'Manchester'"
    " WHEN n_nationkey % 6 = 2 THEN 'Birmingham' WHEN n_nationkey % 6 = 3 THEN 'Leeds'"
    " WHEN n_nationkey % 6 = 4 THEN 'Bristol' ELSE 'Cardiff' END AS office_location",
    "split(concat('Motor,', r_name), ',') AS specializations",
    "split(concat(r_name, ',', n_name), ',') AS territory",
    "CAST(42 + n_nationkey % 8 AS DOUBLE) / 10 AS satisfaction",
    "CAST(2 + n_nationkey % 14 AS BIGINT) AS experience",
    "CAST(15 + n_nationkey * 7 % 40 AS BIGINT) AS training",
    "n_nationkey % 9 <> 0 AS active",
]

CLAIM_COLUMNS = [
    "CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '999999'"
    " ELSE CAST(900000 + o_custkey AS STRING) END AS policy_number",
    "CAST(o_orderdate AS DATE) AS incident_date",
    "o_orderpriority AS incident_type",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'Minor Damage' WHEN o_orderkey % 3 = 1 THEN 'Major Damage'"
    " ELSE 'Total Loss' END AS incident_severity",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'None' WHEN o_orderkey % 4 = 1 THEN 'Police'"
    " WHEN o_orderkey % 4 = 2 THEN 'Fire' ELSE 'Other' END AS authorities_contacted",
    "CAST(o_orderkey % 24 AS INT) AS incident_hour_of_the_day",
    "CAST(1 + o_orderkey % 4 AS INT) AS number_of_vehicles_involved",
    "CAST(o_orderkey % 3 AS INT) AS bodily_injuries",
    "CAST(o_orderkey % 6 AS INT) AS witnesses",
    "CASE WHEN o_orderkey % 5 = 0 THEN '?' WHEN o_orderkey % 5 < 3 THEN 'YES' ELSE 'NO' END"
    " AS police_report_available",
    "CASE WHEN o_orderkey % 37 = 5 THEN NULL ELSE CAST(FLOOR(o_totalprice / 3) AS BIGINT) END"
    " AS claim_amount",
    "CASE WHEN o_orderkey % 31 = 7 THEN NULL ELSE o_orderstatus = 'F' END AS fraud_reported",
]


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is looked up in the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*POLICY_COLUMNS)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*CLAIM_COLUMNS)


def brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    flat = nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(*BROKER_COLUMNS)
    return flat.withColumn(
        "performance_metrics",
        F.struct(
            F.col("satisfaction").alias("customer_satisfaction"),
            F.col("training").alias("training_hours_completed"),
            F.col("experience").alias("years_experience"),
        ),
    ).drop("satisfaction", "training", "experience")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a path; the text stays whole."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias(
            "relative_path"
        ),
        "lang",
        "source",
        F.col("text").alias("raw_text"),
    )


MESSAGE_COLUMNS = [
    "conv_id",
    "turn",
    "role",
    "CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN 'tool_use' ELSE 'text' END"
    " AS type",
    "text",
]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*MESSAGE_COLUMNS)


STREAM_EVENT_COLUMNS = [
    "user_id AS stream_id",
    "ts",
    "event_id",
    "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'done'"
    " WHEN event_type = 'signup' THEN 'tool_results' WHEN event_id % 11 = 4 THEN 'tool_use' ELSE 'text' END AS kind",
    "concat(event_type, ':', CAST(event_id AS STRING), ' ') AS body",
]


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as agent event streams, one stream per user."""
    return table(spark, sf_dir, "events").selectExpr(*STREAM_EVENT_COLUMNS)
