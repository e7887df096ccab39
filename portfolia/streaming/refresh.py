"""The refresh chain: three derived levels kept current by propagating changes (item 123).

Every input may change at any time: claims arrive as a stream, policies and brokers are upserted or deleted. A change
touches the buckets of the brokers concerned, and only those are read, merged and recomputed.

Tables under the target folder:

* ``policies``, ``brokers``: the rows of these inputs, partitioned by a hash of their broker;
* ``units``: a mark of the rows of every policy number and bucket, partitioned by a hash of the number;
* ``claims``: every claim once, by batch and the hash of its number;
* ``homed``: claims at the buckets where their number has ever lived, by batch and bucket. Homes are only added:
  claims left behind by a policy that moved match nothing, and are in place when it comes back;
* ``feed/run=N``: what run N changes, written before any table is touched;
* ``steps``: runs ``begun`` and ``done``, and arrived ``batch`` numbers;
* ``integrated``, ``risk_dashboard``, ``broker_matrix``: the three levels, partitioned by the hash of the broker.

Every step can be repeated with the same outcome, and a run that was cut off is applied again from its feed before
anything else. The lists of buckets on the driver have at most ``n_buckets`` numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from portfolia.operators import integrate
from portfolia.operators.skew import salted_join

STEP = "step string, no int"


class Changes(NamedTuple):
    """The keys of a table (one column) that changed, and all rows that they have now; a key without rows is gone."""

    keys: DataFrame
    rows: DataFrame


def bucket_of(n_buckets: int, *keys: str) -> Column:
    """Bucket by the first key that is set: the broker, or the policy where it has none."""
    return F.pmod(F.xxhash64(F.coalesce(*keys)), F.lit(n_buckets)).cast("int")


def among(column: str, numbers: list[int]) -> Column:
    """Whether a partition column is one of some numbers; with none of them no partition is read."""
    return F.col(column).isin(numbers) if numbers else F.lit(False)


def marks(rows: DataFrame, *keys: str) -> DataFrame:
    """Count and hash sum of the rows of each key; differs when any of its rows does."""
    mark = F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")))
    return rows.groupBy(*keys).agg(mark.alias("mark"))


def null_safe(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of the key columns of two aliased tables in which NULL equals NULL."""
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def changed_marks(old: DataFrame, now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose mark differs: the keys, ``mark`` (NULL: gone) and ``known`` (old has the key)."""
    old = old.select(*keys, F.col("mark").alias("old_mark"), F.lit(True).alias("known"))
    both = old.alias("o").join(now.alias("n"), null_safe("o", "n", keys), "full_outer")
    return both.where(~F.col("mark").eqNullSafe(F.col("old_mark"))).select(
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], "mark", F.coalesce("known", F.lit(False)).alias("known"))


def rows_of(rows: DataFrame, keys: DataFrame, by: Sequence[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is listed (or, with ``left_anti``, is not)."""
    return rows.alias("r").join(keys.select(*by).distinct().alias("k"), null_safe("r", "k", by), how)


class Chain:
    """The state of one refresh chain; see the module's text for its tables."""

    def __init__(self, spark: SparkSession, target: str, n_buckets: int, policies: T.StructType,
                 brokers: T.StructType, claims: T.StructType):
        def with_int(schema: T.StructType, *names: str) -> T.StructType:
            return T.StructType([*schema, *[T.StructField(n, T.IntegerType()) for n in names]])

        self.spark, self.target, self.n = spark, target, n_buckets
        self.units_key = ["policy_number", "bucket"]
        self.schemas = {
            "policies": with_int(policies, "bucket"), "brokers": with_int(brokers, "bucket"),
            "units": T.StructType([*with_int(T.StructType([policies["policy_number"]]), "bucket"),
                                   T.StructField("mark", T.StringType()), T.StructField("part", T.IntegerType())]),
            "claims": with_int(claims, "batch_id", "part"), "homed": with_int(claims, "batch_id", "bucket")}
        for name, schema in self.schemas.items():  # folders to read from before the first rows
            spark.createDataFrame([], schema).write.mode("append").partitionBy(*self._partitions(name)).parquet(
                f"{target}/{name}")
        spark.createDataFrame([], STEP).write.mode("append").parquet(f"{target}/steps")

    @staticmethod
    def _partitions(name: str) -> list[str]:
        return {"claims": ["batch_id", "part"], "homed": ["batch_id", "bucket"], "units": ["part"]}.get(name, ["bucket"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.target}/{name}")

    def steps(self) -> dict[str, int]:
        """The highest number of each kind of step."""
        done = self.spark.read.schema(STEP).parquet(f"{self.target}/steps")
        return {r.step: r.no for r in done.groupBy("step").agg(F.max("no").alias("no")).collect()}

    def log(self, step: str, no: int) -> None:
        self.spark.createDataFrame([(step, no)], STEP).coalesce(1).write.mode("append").parquet(f"{self.target}/steps")

    def part(self) -> Column:
        return F.pmod(F.xxhash64("policy_number"), F.lit(self.n)).cast("int")

    # --- writing buckets ---

    def replace(self, rows: DataFrame, name: str, by: str, wanted: list[int], filled: list[int]) -> DataFrame:
        """Overwrite the partitions ``wanted`` of a table, of which only ``filled`` have rows now; those rows."""
        path = f"{self.target}/{name}"
        # Few files per small bucket, several tasks for a large one.
        (rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(path))
        for b in sorted({*wanted} - {*filled}):  # a dynamic overwrite leaves partitions without new rows as they were
            self.spark.createDataFrame([], rows.drop(by).schema).coalesce(1).write.mode("overwrite").parquet(
                f"{path}/{by}={b}")
        return self.spark.read.schema(rows.schema).parquet(path).where(among(by, wanted))

    def merge(self, name: str, keys: DataFrame, rows: DataFrame, key: list[str], by: str = "bucket") -> None:
        """Put ``rows`` in the place of all rows of ``keys``; both have column ``by``. Merged rows are staged first."""
        wanted = [r[by] for r in keys.select(by).distinct().collect()]
        if not wanted:
            return
        here = self.table(name)
        kept = rows_of(here.where(among(by, wanted)), keys, key, "left_anti")
        staged = f"{self.target}/staged/{name}"
        kept.unionByName(rows.select(here.columns)).write.mode("overwrite").parquet(staged)
        merged = self.spark.read.schema(here.schema).parquet(staged)
        self.replace(merged, name, by, wanted, [r[by] for r in merged.select(by).distinct().collect()])

    def compute(self, buckets: list[int], last_batch: int) -> None:
        """The three levels of some buckets, from the policies, brokers and homed claims of these buckets."""
        if not buckets:
            return
        here = among("bucket", buckets)
        policies = self.table("policies").where(here)
        full = policies.groupBy("bucket").agg(F.max(F.col("broker_id").isNotNull()).alias("broker")).collect()
        filled, with_broker = [r.bucket for r in full], [r.bucket for r in full if r.broker]
        claims = self.table("homed").where(here & (F.col("batch_id") <= last_batch)).drop("batch_id")
        level1 = integrate.integrate_entities(
            policies, self.table("brokers").where(here).drop("bucket"), claims, also_on=("bucket",))
        level1 = self.replace(level1, "integrated", "bucket", buckets, filled)
        by_broker = bucket_of(self.n, "broker_id")
        level2 = integrate.dashboard_from(level1).withColumn("bucket", by_broker)
        level2 = self.replace(level2, "risk_dashboard", "bucket", buckets, with_broker)
        matrix = integrate.matrix_from_dashboard(level2).withColumn("bucket", by_broker)
        self.replace(matrix, "broker_matrix", "bucket", buckets, with_broker)

    # --- changes of policies and brokers ---

    def feed(self, run: int, name: str) -> str:
        return f"{self.target}/feed/run={run}/{name}"

    def begin(self, run: int, policies: DataFrame | Changes, brokers: DataFrame | Changes) -> bool:
        """Write what run ``run`` changes; whether that is anything. Whole tables are compared with the stored ones.

        A full outer join on key and mark finds the units (policy number and bucket) and brokers that differ. Given
        changes are looked up in the parts of ``units`` and the buckets of ``brokers`` that hold their keys.
        """
        units, stored = self.table("units"), self.table("brokers")
        if isinstance(policies, Changes):
            keys = policies.keys.select("policy_number").distinct().withColumn("part", self.part())
            parts = [r.part for r in keys.select("part").distinct().collect()]
            units = rows_of(units.where(among("part", parts)), keys, ["policy_number"])
            policies = policies.rows
        if isinstance(brokers, Changes):
            keys = brokers.keys.select("broker_id").distinct().withColumn("bucket", bucket_of(self.n, "broker_id"))
            buckets = [r.bucket for r in keys.select("bucket").distinct().collect()]
            stored = rows_of(stored.where(among("bucket", buckets)), keys, ["broker_id"])
            brokers = brokers.rows
        now = policies.withColumn("bucket", bucket_of(self.n, "broker_id", "policy_number"))
        found = changed_marks(units, marks(now, *self.units_key), self.units_key)
        found.withColumn("part", self.part()).write.mode("overwrite").parquet(self.feed(run, "units"))
        found = self.spark.read.parquet(self.feed(run, "units"))
        rows_of(now, found, self.units_key).write.mode("overwrite").parquet(self.feed(run, "policies"))
        now = brokers.withColumn("bucket", bucket_of(self.n, "broker_id"))
        other = changed_marks(marks(stored.select(now.columns), "broker_id"), marks(now, "broker_id"), ["broker_id"])
        other.withColumn("bucket", bucket_of(self.n, "broker_id")).write.mode("overwrite").parquet(self.feed(run, "ids"))
        other = self.spark.read.parquet(self.feed(run, "ids"))
        rows_of(now, other, ["broker_id"]).write.mode("overwrite").parquet(self.feed(run, "brokers"))
        some = not (found.isEmpty() and other.isEmpty())
        if some:
            self.log("begun", run)
        return some

    def apply(self, run: int, last_batch: int) -> None:
        """Merge a run's changes, bring claims to homes that are new for their number, recompute what is touched."""
        def read(name: str, of: str) -> DataFrame:
            return self.spark.read.schema(self.schemas[of]).parquet(self.feed(run, name))

        units = self.spark.read.parquet(self.feed(run, "units"))
        ids = self.spark.read.parquet(self.feed(run, "ids"))
        self.merge("policies", units, read("policies", "policies"), self.units_key)
        self.merge("brokers", ids, read("brokers", "brokers"), ["broker_id"])
        new = units.where("NOT known AND policy_number IS NOT NULL").select("policy_number", "bucket", "part").distinct()
        parts = [r.part for r in new.select("part").distinct().collect()]
        claims = self.table("claims").where(among("part", parts) & (F.col("batch_id") <= last_batch))
        # Runs get negative batch numbers, so that they never meet those of the stream.
        self.bring(claims.drop("batch_id", "part"), new.drop("part"), -run - 1)
        touched = units.select("bucket").unionByName(ids.select("bucket")).distinct()
        self.compute([r.bucket for r in touched.collect()], last_batch)
        self.merge("units", units, units.drop("known"), self.units_key, "part")
        self.log("done", run)

    def bring(self, claims: DataFrame, homes: DataFrame, batch_id: int) -> None:
        """Store claims at the homes (one row per number and bucket) of their number."""
        found = salted_join(claims, homes, "policy_number", "inner", right_unique=True)
        found.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.target}/homed/batch_id={batch_id}")

    # --- arriving claims ---

    def arrive(self, batch: DataFrame, batch_id: int) -> None:
        """Store a batch of claims, once by number and at its homes, and recompute the buckets of its homes.

        The stream is read once; all else reads the stored claims, which several tasks can whatever the batch came in.
        """
        if batch_id <= self.steps().get("batch", -1):
            return
        (batch.withColumn("part", self.part()).hint("rebalance", "part").write.mode("overwrite").partitionBy("part")
         .parquet(f"{self.target}/claims/batch_id={batch_id}"))
        placed = self.table("claims").where(F.col("batch_id") == batch_id)
        parts = [r.part for r in placed.where("policy_number IS NOT NULL").select("part").distinct().collect()]
        homes = self.table("units").where(among("part", parts)).select("policy_number", "bucket")
        self.bring(placed.drop("batch_id", "part"), homes, batch_id)
        touched = self.table("homed").where(F.col("batch_id") == batch_id).select("bucket").distinct()
        self.compute([r.bucket for r in touched.collect()], batch_id)
        self.log("batch", batch_id)


def refresh_chain(claim_stream: DataFrame, policies: DataFrame | Changes, brokers: DataFrame | Changes, target: str,
                  checkpoint: str, n_buckets: int = 256) -> None:
    """Item 123: keep the three levels current as claims arrive and as policies or brokers change.

    Policies and brokers are either whole tables, which are compared with the stored ones (one pass over the table
    and over the stored marks), or :class:`Changes`, which need no pass over anything: the reads are then the parts
    and buckets that hold the changed keys. The tables equal the batch result whatever came first.

    Rows: policies and claims may repeat numbers or lack them; policies without a broker form buckets by number.
    """
    from portfolia.streaming.jobs import run_available

    spark = claim_stream.sparkSession
    rows = [x.rows if isinstance(x, Changes) else x for x in (policies, brokers)]
    chain = Chain(spark, target, n_buckets, rows[0].schema, rows[1].schema, claim_stream.schema)
    steps = chain.steps()
    run, last_batch = steps.get("done", -1) + 1, steps.get("batch", -1)
    if steps.get("begun", -1) >= run:  # cut off: its feed may be half applied
        chain.apply(run, last_batch)
        run += 1
    if chain.begin(run, policies, brokers):
        chain.apply(run, last_batch)
    run_available(claim_stream, checkpoint, chain.arrive)
