"""Table metrics, scores, drill-down and remediation (items 24-26, 34-35, 38-51, 71, 89-90, 94)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from portfolia.functions import bands
from portfolia.operators.integrate import round_half_up
from portfolia.operators.skew import key_counts, salted_join

# The limits and the id pattern the metrics check.
AGE_RANGE = (18, 85)
BROKER_ID_PATTERN = "^BRK[0-9]{3}$"


@dataclass(frozen=True)
class Metric:
    """A user-defined table metric (item 89).

    ``predicate`` marks the offending rows. A metric with ``per_value=True`` counts
    values that occur more than once; one without predicate counts rows.
    """

    name: str
    columns: tuple[str, ...] = ()
    predicate: Callable[[], Column] | None = None
    per_value: bool = False


def invalid_age(column: str = "age") -> Metric:
    """Item 38."""
    low, high = AGE_RANGE
    return Metric("INVALID_CUSTOMER_AGE_COUNT", (column,), lambda: ~F.col(column).between(low, high))


def invalid_broker_id(column: str = "broker_id") -> Metric:
    """Item 39."""
    return Metric("INVALID_BROKER_ID_COUNT", (column,), lambda: ~F.col(column).rlike(BROKER_ID_PATTERN))


def null_count(column: str) -> Metric:
    """Item 40."""
    return Metric("NULL_COUNT", (column,), lambda: F.col(column).isNull())


def duplicate_count(column: str) -> Metric:
    """Item 41: values that occur more than once; NULLs have their own metric."""
    return Metric("DUPLICATE_COUNT", (column,), per_value=True)


def row_count() -> Metric:
    """Item 42."""
    return Metric("ROW_COUNT")


@dataclass(frozen=True)
class MetricRegistry:
    """Which metrics are attached to which table, and how often they run."""

    assignments: dict[str, tuple[Metric, ...]] = field(default_factory=dict)
    schedule: str = "5 minute"

    def attach(self, table: str, *metrics: Metric) -> MetricRegistry:
        now = self.assignments.get(table, ()) + metrics
        return MetricRegistry({**self.assignments, table: now}, self.schedule)

    def detach(self, table: str, name: str) -> MetricRegistry:
        kept = tuple(m for m in self.assignments.get(table, ()) if m.name != name)
        return MetricRegistry({**self.assignments, table: kept}, self.schedule)

    def references(self, spark: SparkSession, table: str | None = None) -> DataFrame:
        rows = [
            (t, m.name, list(m.columns), self.schedule, "STARTED")
            for t, ms in self.assignments.items() if table in (None, t) for m in ms
        ]
        return spark.createDataFrame(
            rows,
            "table_name string, metric_name string, columns array<string>, schedule string,"
            " schedule_status string",
        )

    def find(self, table: str, name: str) -> Metric | None:
        return next((m for m in self.assignments.get(table, ()) if m.name == name.upper()), None)


DEFAULT_METRICS = (
    MetricRegistry()
    .attach("CUSTOMERS_RAW", invalid_age(), invalid_broker_id(), null_count("policy_number"),
            duplicate_count("policy_number"), row_count())
    .attach("CLAIMS_RAW", null_count("policy_number"), duplicate_count("policy_number"), row_count())
)


def _hits(metric: Metric) -> Column:
    if metric.predicate is None:
        return F.count(F.lit(1))
    return F.count_if(metric.predicate())


def run_metrics(df: DataFrame, table: str, metrics: Sequence[Metric], measured_at: str) -> DataFrame:
    """Run all metrics of one table and return one row per metric.

    Row metrics and the duplicate count of one key share a single scan: counts per
    key value (combined on the map side, so a hot key is one row per task), then a
    total. A table with several duplicate-checked columns takes one scan for each.
    """
    row_metrics = [m for m in metrics if not m.per_value]
    key_metrics = [m for m in metrics if m.per_value]
    names = {m: f"m{i}" for i, m in enumerate(metrics)}
    parts = []
    for i, km in enumerate(key_metrics or [None]):
        here = row_metrics if i == 0 else []
        if km is None:
            totals = df.agg(*[_hits(m).alias(names[m]) for m in here])
        else:
            key = km.columns[0]
            per_value = df.groupBy(key).agg(
                F.count(F.lit(1)).alias("_n"), *[_hits(m).alias(names[m]) for m in here]
            )
            dup = F.count_if((F.col("_n") > 1) & F.col(key).isNotNull()).alias(names[km])
            totals = per_value.agg(
                dup, *[F.coalesce(F.sum(names[m]), F.lit(0)).alias(names[m]) for m in here]
            )
        parts.append((totals, [m for m in metrics if m in here or m is km]))
    at = F.lit(measured_at).cast("timestamp")
    out = None
    for totals, ms in parts:
        rows = F.array(*[F.struct(F.lit(m.name).alias("n"), F.col(names[m]).alias("v")) for m in ms])
        part = totals.select(F.explode(rows).alias("r")).select(
            F.lit(table).alias("table_name"),
            F.col("r.n").alias("metric_name"),
            F.col("r.v").cast("long").alias("metric_value"),
            at.alias("measurement_time"),
            at.alias("change_commit_time"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def table_metric(tables: dict[str, DataFrame], measured_at: Sequence[str],
                 registry: MetricRegistry = DEFAULT_METRICS) -> DataFrame:
    """Item 89: results of every attached metric, one set per measuring time.

    The tables are read once; a measurement of unchanged tables repeats the values.
    """
    out = None
    for name, metrics in registry.assignments.items():
        part = run_metrics(tables[name], name, metrics, measured_at[0])
        out = part if out is None else out.unionByName(part)
    times = F.array(*[F.lit(t).cast("timestamp") for t in measured_at])
    return out.withColumn("measurement_time", F.explode(times))


def metric_scan(df: DataFrame, metric: Metric | None) -> DataFrame:
    """Item 90: the offending rows of a metric; all rows when none is known.

    Duplicates are found by counting values and joining back, so that a value shared
    by many rows is never gathered in one task.
    """
    if metric is None or (metric.predicate is None and not metric.per_value):
        return df
    if not metric.per_value:
        return df.where(metric.predicate())
    key = metric.columns[0]
    counts = key_counts(df, key)
    repeated = counts.where(F.col("_n") > 1).select(key)
    return salted_join(df, repeated, key, "inner", left_counts=counts, right_unique=True).select(*df.columns)


def drill_down(df: DataFrame, table: str, metric: str, order: Sequence[Column], limit: int = 50,
               registry: MetricRegistry = DEFAULT_METRICS) -> DataFrame:
    """Item 90 as a screen calls it: ordered, and at most ``limit`` rows."""
    return metric_scan(df, registry.find(table, metric)).orderBy(*order).limit(limit)


def age_distribution(policies: DataFrame) -> DataFrame:
    """Item 43."""
    low, high = AGE_RANGE
    age = F.col("age")
    return policies.agg(
        F.lit("AGE_DISTRIBUTION_ANALYSIS").alias("analysis_type"),
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(age < low).alias("under_age_customers"),
        F.count_if(age > high).alias("over_age_customers"),
        F.count_if(age.isNull()).alias("null_age_customers"),
        _hits(invalid_age()).alias("metric_invalid_age_count"),
    )


def broker_id_patterns(policies: DataFrame) -> DataFrame:
    """Item 44."""
    ok = F.col("broker_id").rlike(BROKER_ID_PATTERN)
    return policies.agg(
        F.lit("BROKER_ID_PATTERN_ANALYSIS").alias("analysis_type"),
        F.count(F.lit(1)).alias("total_broker_ids"),
        F.count_if(ok).alias("valid_format_ids"),
        F.count_if(~ok).alias("invalid_format_ids"),
        F.count_if(F.col("broker_id").isNull()).alias("null_broker_ids"),
        _hits(invalid_broker_id()).alias("metric_invalid_broker_count"),
    )


# Metric history -------------------------------------------------------------------------


def with_status(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "quality_status", bands.dq_status_band(F.col("metric_name"), F.col("metric_value"))
    )


def with_flag(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "status_flag", bands.dq_status_flag(F.col("metric_name"), F.col("metric_value"))
    )


def filter_metric_history(results: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Item 24."""
    return with_flag(results.where(F.col("table_name").isin(*tables))).orderBy(
        F.col("measurement_time").desc(), "table_name", "metric_name"
    )


def filter_recent(summary: DataFrame, now: str, table: str | None = None, status: str | None = None,
                  hours: int = 1) -> DataFrame:
    """Item 25."""
    since = F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    out = summary.where(F.col("measurement_time") >= since)
    if table:
        out = out.where(F.col("table_name") == table)
    return out.where(F.col("quality_status") == status) if status else out


def filter_graded(summary: DataFrame) -> DataFrame:
    """Item 26."""
    return summary.where((F.col("metric_name") != "ROW_COUNT") & (F.col("quality_status") != "UNKNOWN"))


def dq_entity_score(summary: DataFrame, latest_only: bool = False) -> DataFrame:
    """Item 45. Row counts have no status but count in the denominator, as specified."""
    if latest_only:
        last = summary.groupBy("table_name").agg(F.max("measurement_time").alias("measurement_time"))
        summary = summary.join(last, ["table_name", "measurement_time"], "left_semi")
    status = F.col("quality_status")
    points = F.lit(0)
    for name, value in bands.STATUS_POINTS.items():
        points = F.when(status == name, value).otherwise(points)
    return summary.groupBy(F.col("table_name").alias("entity_name")).agg(
        F.count(F.lit(1)).alias("total_metrics"),
        *[F.count_if(status == s).alias(f"{s.lower()}_count") for s in bands.STATUS_POINTS],
        round_half_up(F.sum(points) / F.count(F.lit(1)), 1).alias("overall_quality_score"),
        F.max("measurement_time").alias("last_measured"),
    )


def dq_report(summary: DataFrame) -> DataFrame:
    """Item 46."""
    return (
        dq_entity_score(summary)
        .select(
            F.lit("DATA_QUALITY_ASSESSMENT").alias("report_type"), "entity_name", "total_metrics",
            "overall_quality_score",
            bands.quality_grade(F.col("overall_quality_score")).alias("quality_grade"),
            "last_measured",
        )
        .orderBy(F.col("overall_quality_score").desc(), "entity_name")
    )


def dq_integrity_report(relationship: DataFrame) -> DataFrame:
    """Item 47."""
    return relationship.withColumn("integrity_grade", bands.integrity_grade(F.col("integrity_percentage")))


def dq_issue_summary(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Item 48: affected rows per issue type, one scan per table."""
    out = None
    for df, table, suffix in ((policies, "CUSTOMERS_RAW", "CUSTOMERS"), (claims, "CLAIMS_RAW", "CLAIMS")):
        per_value = df.groupBy("policy_number").agg(F.count(F.lit(1)).alias("n"))
        key = F.col("policy_number")
        totals = per_value.agg(
            F.coalesce(F.sum(F.when(key.isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.coalesce(F.sum(F.when(key.isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("dups"),
        )
        part = totals.select(
            F.explode(F.array(
                F.struct(F.lit(f"NULL_POLICY_NUMBERS_{suffix}").alias("t"), F.col("nulls").alias("n")),
                F.struct(F.lit(f"DUPLICATE_POLICY_NUMBERS_{suffix}").alias("t"), F.col("dups").alias("n")),
            )).alias("r")
        ).select(
            F.col("r.t").alias("issue_type"), F.col("r.n").alias("affected_records"),
            F.lit(table).alias("table_name"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def dq_issue_totals(issues: DataFrame) -> DataFrame:
    """Item 48: total affected rows and the number of issue types found."""
    return issues.agg(
        F.sum("affected_records").alias("total_issues"),
        F.count_if(F.col("affected_records") > 0).alias("issue_types"),
    )


def dq_row_counts_feed(results: DataFrame) -> DataFrame:
    """Item 49."""
    return (
        results.where(F.col("metric_name") == "ROW_COUNT")
        .select("table_name", F.col("metric_value").alias("row_count"), "measurement_time")
        .orderBy("table_name", "measurement_time")
    )


def dq_status_counts(summary: DataFrame) -> DataFrame:
    """Item 50: metrics per (table, status), with the count over all tables beside it."""
    graded = filter_graded(summary)
    per_table = graded.groupBy("table_name", "quality_status").agg(F.count(F.lit(1)).alias("n"))
    overall = per_table.groupBy("quality_status").agg(F.sum("n").alias("n"))
    return per_table.unionByName(overall.withColumn("table_name", F.lit("ALL")))


def dq_health_summary(summary: DataFrame) -> DataFrame:
    """Item 51."""
    graded = (F.col("metric_name") != "ROW_COUNT") & (F.col("quality_status") != "UNKNOWN")
    return summary.agg(
        F.countDistinct("table_name").alias("monitored_entities"),
        F.countDistinct("table_name", "metric_name").alias("active_metrics"),
        F.count_if(graded & (F.col("quality_status") == "CRITICAL")).alias("critical_issues"),
    )


# Remediation ----------------------------------------------------------------------------


def dedup_keep_latest(df: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """Item 71: the newest row per key; rows without a key are all kept.

    ``row_number() = 1`` lets Spark keep one row per key and map task before the
    shuffle, so a hot key does not travel whole.
    """
    w = Window.partitionBy(key).orderBy(*newest_first)
    kept = (
        df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1).drop("_rn")
    )
    return kept.unionByName(df.where(F.col(key).isNull()))


def null_key_semi(df: DataFrame, key: str) -> DataFrame:
    """Item 34: the rows whose key is among the offending (NULL) keys.

    An equi semi-join never matches NULL, and a null-safe one would send all these
    rows to one task; the set of NULL keys is just a predicate.
    """
    return df.where(F.col(key).isNull())


def not_in_keepset(df: DataFrame, key: str, row_id: str, *newest_first: Column) -> DataFrame:
    """Item 35: the surplus rows, those not in the keep-set of the newest row per key.

    ``row_id`` is unique, so the anti join is not skewed by a hot key.
    """
    keep = dedup_keep_latest(df, key, *newest_first).select(row_id)
    return df.join(keep, row_id, "left_anti")


#: Prefix and range of a generated policy number.
GENERATED_PREFIX, GENERATED_LOW, GENERATED_HIGH = "POL_", 1_000_000, 9_999_999


def fix_null_keys(df: DataFrame, key: str, seed_columns: Sequence[str]) -> DataFrame:
    """Item 94: fill NULL keys with a prefix and seven digits.

    The digits are a hash of ``seed_columns``: a re-run gives the same number, which
    a random draw would not.
    """
    span = GENERATED_HIGH - GENERATED_LOW + 1
    digits = F.pmod(F.xxhash64(*seed_columns), F.lit(span)) + GENERATED_LOW
    filled = F.concat(F.lit(GENERATED_PREFIX), digits.cast("string"))
    return df.withColumn(key, F.coalesce(F.col(key), filled))
