"""Tables kept as dated snapshots, with reads as of a time (items 68, 92, 93)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = "commit_ts timestamp, n_rows long"


class NoSuchVersion(LookupError):
    pass


@dataclass(frozen=True)
class SnapshotTable:
    """Parquet snapshots partitioned by commit time, and a log of finished commits.

    Data is written first and one log row after it, so a reader that goes through the
    log never sees half a commit. Repeating a commit replaces it.
    """

    spark: SparkSession
    path: str

    def _stamp(self, ts: str) -> str:
        return ts.replace(" ", "T").replace(":", "")

    def commit(self, df: DataFrame, ts: str) -> None:
        target = f"{self.path}/data/commit={self._stamp(ts)}"
        df.write.mode("overwrite").parquet(target)
        n = self.spark.read.parquet(target).count()
        log = self.spark.createDataFrame([(n,)], "n_rows long").select(
            F.lit(ts).cast("timestamp").alias("commit_ts"), "n_rows"
        )
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/commit={self._stamp(ts)}")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA + ", commit string").parquet(f"{self.path}/log")

    def _read(self, commits: DataFrame) -> DataFrame:
        last = commits.orderBy(F.col("commit_ts").desc()).first()
        if last is None:
            raise NoSuchVersion(f"no commit of {self.path} in that time")
        return self.spark.read.parquet(f"{self.path}/data/commit={last['commit']}")

    def read_as_of(self, ts: str) -> DataFrame:
        """Item 92: the last version committed at or before a time."""
        return self._read(self.log().where(F.col("commit_ts") <= F.lit(ts).cast("timestamp")))

    def read_before(self, ts: str) -> DataFrame:
        """Item 92: the version before the change committed at a time."""
        return self._read(self.log().where(F.col("commit_ts") < F.lit(ts).cast("timestamp")))

    def latest(self) -> DataFrame:
        return self._read(self.log())

    def restore_version(self, target: str, ts: str | None = None) -> DataFrame:
        """Item 93: write a version as the current table and report the row counts."""
        content = self.read_as_of(ts) if ts else self.latest()
        content.write.mode("overwrite").parquet(target)
        restored = self.spark.read.parquet(target)
        return restored.agg(F.count(F.lit(1)).alias("restored_rows")).withColumn(
            "version_rows", content.agg(F.count(F.lit(1))).scalar()
        )
