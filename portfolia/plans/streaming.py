"""Streaming jobs run to the end over files made from the given tables (items 8, 122-125)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from portfolia import bindings as b, schemas
from portfolia.operators import quality
from portfolia.plans.registry import query, sql
from portfolia.plans.risk import L2_ROWS, flat
from portfolia.plans.sources import claim_files
from portfolia.session import scratch_dir
from portfolia.streaming import jobs

#: A task reads whole row groups, so a file of one group would be the work of one task.
ROW_GROUP_BYTES = 4 << 20


def arriving_claims(spark: SparkSession, d: str, batches: int = 2) -> DataFrame:
    """Bound claims as a stream: one file per batch, in row groups that several tasks can read."""
    landing = scratch_dir(spark, "landing")
    orders = b.table(spark, d, "orders")
    orders.repartition(batches, "o_orderkey").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(landing)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    return stream.selectExpr(*b.CLAIM_COLUMNS)


@query("ingest_stream", sql("SELECT * FROM claims", "claims"))
def _ingest(spark, d):
    raw = scratch_dir(spark, "raw")
    stream = jobs.ingest_stream(spark, claim_files(spark, d), "*.csv")
    jobs.stream_ingest_to_raw(stream, schemas.CLAIMS, raw, scratch_dir(spark, "ckpt"))
    return spark.read.parquet(f"{raw}/good").drop("batch_id")


@query("stream_ingest_to_raw", sql(
    """SELECT claim_amount % 10 = 3 AND claim_amount IS NOT NULL AS quarantined, count(*) AS n
FROM claims GROUP BY 1""", "claims"))
def _to_raw(spark, d):
    raw = scratch_dir(spark, "raw")
    stream = jobs.ingest_stream(spark, claim_files(spark, d, bad=True), "*.csv", 4)
    jobs.stream_ingest_to_raw(stream, schemas.CLAIMS, raw, scratch_dir(spark, "ckpt"))
    good = spark.read.parquet(f"{raw}/good").select(F.lit(False).alias("quarantined"))
    bad = spark.read.parquet(f"{raw}/quarantine").select(F.lit(True).alias("quarantined"))
    return good.unionByName(bad).groupBy("quarantined").agg(F.count(F.lit(1)).alias("n"))


@query("refresh_chain", sql("SELECT * FROM matrix JOIN analysis USING (broker_id)", "matrix", "analysis"))
def _refresh(spark, d):
    target = scratch_dir(spark, "refresh")
    jobs.refresh_chain(arriving_claims(spark, d), b.policies(spark, d), b.brokers(spark, d), target,
                       scratch_dir(spark, "ckpt"), n_buckets=8)
    return flat(spark.read.parquet(f"{target}/broker_matrix").drop("bucket"))


@query("refresh_chain_dashboard", sql(L2_ROWS, "l2", "analysis"))
def _refresh_dashboard(spark, d):
    target = scratch_dir(spark, "refresh")
    jobs.refresh_chain(arriving_claims(spark, d), b.policies(spark, d), b.brokers(spark, d), target,
                       scratch_dir(spark, "ckpt"), n_buckets=4)
    return flat(spark.read.parquet(f"{target}/risk_dashboard").drop("bucket"))


# Claims arrive on the day of their incident, and the table is measured every 90 days.
FIRST_DAY, EVERY = "1992-01-01", 90 * 24 * 60


@query("scheduled_metrics", sql(
    """SELECT 'CLAIMS_RAW' AS table_name, metric_name, metric_value, day AS measurement_time, day AS change_commit_time
FROM (
  SELECT tick, 'NULL_COUNT' AS metric_name, count(*) FILTER (t <= tick AND policy_number IS NULL) AS metric_value
    FROM ticks CROSS JOIN timed GROUP BY 1
  UNION ALL SELECT tick, 'ROW_COUNT', count(*) FILTER (t <= tick) FROM ticks CROSS JOIN timed GROUP BY 1
  UNION ALL SELECT tick, 'DUPLICATE_COUNT', count(*) FILTER (n > 1) FROM (
    SELECT tick, policy_number, count(*) FILTER (t <= tick) AS n FROM ticks CROSS JOIN timed
    WHERE policy_number IS NOT NULL GROUP BY 1, 2) per_value GROUP BY 1) x
CROSS JOIN LATERAL (SELECT TIMESTAMP '1992-01-01' + to_days(CAST(90 * tick AS INTEGER)) AS day) d""", "claims",
    timed="""SELECT policy_number, greatest(ceil(date_diff('day', DATE '1992-01-01', incident_date) / 90.0), 0) AS t
FROM claims""",
    ticks="SELECT unnest(range((SELECT CAST(max(t) AS BIGINT) + 1 FROM timed))) AS tick"))
def _scheduled(spark, d):
    target = scratch_dir(spark, "metrics")
    metrics = quality.DEFAULT_METRICS.assignments["CLAIMS_RAW"]
    jobs.scheduled_metrics(arriving_claims(spark, d), metrics, target, scratch_dir(spark, "ckpt"),
                           FIRST_DAY, EVERY, F.col("incident_date"))
    return jobs.metric_history(spark, "CLAIMS_RAW", metrics, target, FIRST_DAY, EVERY)


@query("change_totals", sql(
    """SELECT policy_number, count(*) AS n_rows, CAST(coalesce(sum(claim_amount), 0) AS BIGINT) AS total
FROM claims WHERE policy_number IS NOT NULL GROUP BY 1""", "claims"))
def _totals(spark, d):
    target = scratch_dir(spark, "totals")
    jobs.change_totals(arriving_claims(spark, d), "policy_number", "claim_amount", target,
                       scratch_dir(spark, "ckpt"))
    return jobs.latest_totals(spark, target, "policy_number")
