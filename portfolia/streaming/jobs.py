"""File-stream ingestion and refresh of derived tables (items 8, 122-125).

Each job is a Structured Streaming query with a checkpoint; ``availableNow`` processes
what has arrived and stops. Batches are written to folders named after the batch id,
so a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from portfolia.operators import quality
from portfolia.sources import files
from portfolia.streaming.refresh import Changes, refresh_chain  # noqa: F401


def ingest_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Item 8: CSV files whose name fits the pattern, as a stream of their paths; contents are read per batch."""
    reader = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", pattern)
        .schema("path string, modificationTime timestamp, length long, content binary")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select("path")


def run_available(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None],
                  mode: str = "append") -> None:
    """Process everything that has arrived, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(each_batch).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stream_ingest_to_raw(stream: DataFrame, schema: T.StructType, raw: str, checkpoint: str) -> None:
    """Item 122: append each batch to the raw table by column name; bad rows go aside.

    Each file is read by its own header. The driver holds the paths of one batch, as the file source does.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r.path for r in batch.distinct().collect())
        rows = files.split_bad_rows(files.read_csv_entity(batch.sparkSession, paths), schema)
        write_batch(rows.where(F.size("_bad") == 0).drop("_bad"), f"{raw}/good", batch_id)
        write_batch(rows.where(F.size("_bad") > 0), f"{raw}/quarantine", batch_id)

    run_available(stream, checkpoint, load)


def tick_of(arrived: Column, start: str, minutes: int) -> Column:
    """Number of the first scheduled measurement that sees a row; rows without a time belong to the first one."""
    late = F.unix_micros(arrived.cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    return F.greatest(F.coalesce(F.ceil(late / F.lit(minutes * 60_000_000)), F.lit(0)), F.lit(0)).cast("long")


CHANGE = "metric_name string, tick long, change long"


#: Every so many batches the ticks stored per value become one table.
BATCHES_PER_MERGE = 8
SEEN = "metric_name string, value string, tick long"


def two_earliest(rows: DataFrame) -> DataFrame:
    """Of every value the two earliest ticks; each task keeps two of them before anything travels."""
    order = Window.partitionBy("metric_name", "value").orderBy("tick")
    return rows.select("metric_name", "value", "tick", F.row_number().over(order).alias("_no")).where("_no <= 2").drop("_no")


def seen_before(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    """Ticks stored by the batches before this one: the last merged table and fewer than ``BATCHES_PER_MERGE`` batches."""
    first = batch_id // BATCHES_PER_MERGE * BATCHES_PER_MERGE
    paths = [f"{target}/merged/upto={first - 1}"] if first else []
    paths += [f"{target}/seen/batch_id={i}" for i in range(first, batch_id)]
    if not paths:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in SEEN.split(", "))])
    return reduce(DataFrame.unionByName, [spark.read.schema(SEEN).parquet(p) for p in paths])


def store_repeats(rows: DataFrame, target: str, batch_id: int) -> None:
    """A value counts as repeated from the tick of its second row on; what a batch changes is told as +1 and -1 at ticks.

    Stored are at most two ticks per value and batch. What a merged table replaces is emptied one merge later, so a
    batch that is run again finds all that it read.
    """
    spark = rows.sparkSession
    write_batch(two_earliest(rows), f"{target}/seen", batch_id)
    now = spark.read.schema(SEEN).parquet(f"{target}/seen/batch_id={batch_id}")
    before = seen_before(spark, target, batch_id)
    known = before.join(now.select("metric_name", "value").distinct(), ["metric_name", "value"], "left_semi")
    both = known.withColumn("old", F.col("tick")).unionByName(now.withColumn("old", F.lit(None).cast("long")))

    def second(ticks: str) -> Column:  # of at most two ticks per batch since the last merge
        return F.get(F.array_sort(F.collect_list(ticks)), F.lit(1))

    moved = both.groupBy("metric_name", "value").agg(second("old").alias("was"), second("tick").alias("tick"))
    moved = moved.where(~F.col("was").eqNullSafe(F.col("tick")))
    changes = F.inline(F.array(F.struct(F.col("tick"), F.lit(1).cast("long").alias("change")),
                               F.struct(F.col("was").alias("tick"), F.lit(-1).cast("long").alias("change"))))
    moved = moved.select("metric_name", changes).where("tick IS NOT NULL")
    write_batch(moved.groupBy("metric_name", "tick").agg(F.sum("change").alias("change")).where("change != 0"),
                f"{target}/repeated", batch_id)
    if batch_id % BATCHES_PER_MERGE == BATCHES_PER_MERGE - 1:
        two_earliest(before.unionByName(now)).write.mode("overwrite").parquet(f"{target}/merged/upto={batch_id}")
        last, empty = batch_id - BATCHES_PER_MERGE, now.limit(0).coalesce(1)
        for old in range(max(last - BATCHES_PER_MERGE + 1, 0), last + 1):
            empty.write.mode("overwrite").parquet(f"{target}/seen/batch_id={old}")
        if last >= BATCHES_PER_MERGE:
            empty.write.mode("overwrite").parquet(f"{target}/merged/upto={last - BATCHES_PER_MERGE}")


def scheduled_metrics(stream: DataFrame, metrics: Sequence[quality.Metric], target: str, checkpoint: str, start: str,
                      minutes: int = 5, arrived: Column | None = None) -> None:
    """Item 124: keep what every scheduled measurement of the table says, from arriving rows alone.

    Measurements take place at ``start`` and every ``minutes`` after it; a row is seen by all from its arrival on
    (``arrived``, or the time at which it is processed). Nothing is measured anew: counts are sums of changes per tick,
    and repeated values are known by two stored numbers per value, their two earliest ticks (and those of the batches
    since the last merge). A late row corrects the measurements since its arrival. :func:`metric_history` adds the
    changes up.
    """
    tick = tick_of(F.current_timestamp() if arrived is None else arrived, start, minutes)
    counted = [m for m in metrics if not m.per_value]

    def count(batch: DataFrame, batch_id: int) -> None:
        hits = [F.struct(F.lit(m.name).alias("metric_name"), quality._hits(m).alias("change")) for m in counted]
        sums = batch.groupBy(tick.alias("tick")).agg(F.array(*hits).alias("hits"))
        write_batch(sums.select("tick", F.inline("hits")).where("change != 0"), f"{target}/counted", batch_id)

    if counted:
        run_available(stream, f"{checkpoint}/counted", count)
    values = [F.struct(F.lit(m.name).alias("metric_name"), F.col(m.columns[0]).cast("string").alias("value"))
              for m in metrics if m.per_value]
    if values:
        rows = stream.select(tick.alias("tick"), F.inline(F.array(*values))).where("value IS NOT NULL")
        run_available(rows, f"{checkpoint}/values", lambda batch, i: store_repeats(batch, target, i))


def metric_history(spark: SparkSession, table: str, metrics: Sequence[quality.Metric], target: str, start: str,
                   minutes: int = 5, ticks: int | None = None) -> DataFrame:
    """Item 124: one row per metric and scheduled measurement, up to the last that saw a new row (or ``ticks`` of them).

    The work is one row per metric and tick that changed, whatever the size of the measured table.
    """
    per_value = {m.per_value for m in metrics}
    parts = [spark.read.schema(f"{CHANGE}, batch_id int").parquet(f"{target}/{name}")
             for name, kind in (("counted", False), ("repeated", True)) if kind in per_value]
    changes = reduce(DataFrame.unionByName, parts).groupBy("metric_name", "tick").agg(F.sum("change").alias("change"))
    last = F.lit(ticks - 1) if ticks else changes.agg(F.coalesce(F.max("tick"), F.lit(0))).scalar()
    all_ticks = spark.range(1).select(F.explode(F.array(*[F.lit(m.name) for m in metrics])).alias("metric_name"),
                                      F.sequence(F.lit(0).cast("long"), last.cast("long")).alias("ticks"))
    so_far = Window.partitionBy("metric_name").orderBy("tick")  # one row per tick
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("tick") * (minutes * 60_000_000))
    return all_ticks.select("metric_name", F.explode("ticks").alias("tick")).join(
        changes, ["metric_name", "tick"], "left").select(
        F.lit(table).alias("table_name"), "metric_name",
        F.sum(F.coalesce("change", F.lit(0))).over(so_far).alias("metric_value"),
        at.alias("measurement_time"), at.alias("change_commit_time"))


def change_totals(stream: DataFrame, key: str, amount: str, target: str, checkpoint: str, batches_per_merge: int = 8,
                  ) -> None:
    """Item 125: running row counts and sums per key; state is two numbers per key.

    Each batch writes the new totals of the keys it changes. Every ``batches_per_merge`` batches these are merged with
    the last merged table into a new one, so a reader meets one merged table and fewer than that many batches, and the
    table does not grow with the number of updates.
    """
    totals = stream.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(amount), F.lit(0)).alias("total")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{target}/updates", batch_id)
        if batch_id % batches_per_merge == batches_per_merge - 1:
            spark = batch.sparkSession
            merged = latest_totals(spark, target, key, batch_id)
            merged.write.mode("overwrite").parquet(f"{target}/merged/upto={batch_id}")
            # Only now is the new table the one to read; what it replaces is emptied, in the same order on a re-run.
            spark.createDataFrame([(batch_id,)], "upto int").write.mode("append").parquet(f"{target}/merges")
            empty = merged.limit(0).coalesce(1)
            for old in range(max(batch_id - batches_per_merge + 1, 0), batch_id):
                empty.write.mode("overwrite").parquet(f"{target}/updates/batch_id={old}")
            if batch_id >= 2 * batches_per_merge:
                empty.write.mode("overwrite").parquet(f"{target}/merged/upto={batch_id - batches_per_merge}")

    run_available(totals, checkpoint, write, mode="update")


def latest_totals(spark: SparkSession, target: str, key: str, upto: int | None = None) -> DataFrame:
    """The current total of each key: its row in the last batch that changed it, or in the last merged table."""
    spark.createDataFrame([], "upto int").write.mode("append").parquet(f"{target}/merges")
    merges = spark.read.schema("upto int").parquet(f"{target}/merges")
    last = (merges if upto is None else merges.where(F.col("upto") < upto)).agg(F.max("upto")).first()[0]
    updates = spark.read.parquet(f"{target}/updates")
    if last is not None:
        merged = spark.read.schema(updates.drop("batch_id").schema).parquet(f"{target}/merged/upto={last}")
        updates = updates.where(F.col("batch_id") > last).unionByName(merged.withColumn("batch_id", F.lit(last)))
    return updates.groupBy(key).agg(
        F.max_by("n_rows", "batch_id").alias("n_rows"), F.max_by("total", "batch_id").alias("total")
    )
