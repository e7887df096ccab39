"""Alert rules over the catalog and the alert history (items 95, 96)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from portfolia.sources.files import record_counts


@dataclass(frozen=True)
class MissingTableRule:
    name: str
    table: str
    actions: Sequence[str] = (
        "Find out why the table is gone",
        "Restore the last version if it was dropped by accident",
        "Check the data and the policies after recovery",
    )

    def message(self, at: str) -> str:
        steps = "\n".join(f"{i}. {a}" for i, a in enumerate(self.actions, 1))
        return f"ALERT TRIGGERED AT: {at}\n\nTable {self.table} has been dropped or is missing.\n\n{steps}"


def evaluate_alerts(spark: SparkSession, rules: Sequence[MissingTableRule], now: str) -> DataFrame:
    """Item 95: one row per rule with its table's row count; the message is set when it fires."""
    rows = []
    for rule in rules:
        missing = not spark.catalog.tableExists(rule.table)
        rows.append((rule.name, rule.table, missing, rule.message(now) if missing else None))
    out = spark.createDataFrame(rows, "alert string, table_name string, triggered boolean, message string")
    counts = record_counts(spark, sorted({r.table for r in rules}))
    return out.join(counts, "table_name", "left").withColumn("alert_time", F.lit(now).cast("timestamp"))


def alert_history(alerts: DataFrame, now, minutes: int = 5, time: str = "alert_time") -> DataFrame:
    """Item 96: alerts of the last minutes, newest first. ``now`` is a time or a column."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    since = now - F.make_interval(mins=F.lit(minutes))
    return alerts.where(F.col(time).between(since, now)).orderBy(F.col(time).desc())
