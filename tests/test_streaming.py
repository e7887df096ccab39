from __future__ import annotations

import datetime as dt
import glob
import os
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from portfolia import bindings as b, schemas
from portfolia.operators import integrate, quality
from portfolia.plans import streaming as plans
from portfolia.plans.sources import RAW_CLAIMS
from portfolia.streaming import jobs, refresh
from tests.conftest import plan_of

def _drop(spark, sf_dir, folder, name, part):
    rows = b.claims(spark, sf_dir).where(F.pmod(F.xxhash64("incident_date", "claim_amount"), F.lit(2)) == part)
    table = rows.selectExpr(*RAW_CLAIMS).toPandas()
    if part:  # another order and case of columns
        table = table[table.columns[::-1]].rename(columns=str.upper)
    table.to_csv(f"{folder}/{name}", index=False)
    return rows.count()


def test_files_are_loaded_once_and_by_name(spark, sf_dir, tmp_path):
    landing, raw, ckpt = (str(tmp_path / n) for n in ("in", "raw", "ckpt"))
    os.mkdir(landing)
    n1 = _drop(spark, sf_dir, landing, "claim_data_1.csv", 0)
    _drop(spark, sf_dir, landing, "other.csv", 0)

    def load():
        stream = jobs.ingest_stream(spark, landing, "*claim_data*.csv")
        jobs.stream_ingest_to_raw(stream, schemas.CLAIMS, raw, ckpt)
        return spark.read.parquet(f"{raw}/good").count() + spark.read.parquet(f"{raw}/quarantine").count()

    assert load() == n1
    assert load() == n1  # a restart reads nothing twice
    n2 = _drop(spark, sf_dir, landing, "claim_data_2.csv", 1)
    assert load() == n1 + n2
    got = spark.read.parquet(f"{raw}/good").drop("batch_id")
    want = b.claims(spark, sf_dir)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and n1 + n2 == want.count()


def _stream(spark, sf_dir, landing, part):
    orders = b.table(spark, sf_dir, "orders")
    orders.where(part).write.mode("append").parquet(landing)
    return spark.readStream.schema(orders.schema).parquet(landing).selectExpr(*b.CLAIM_COLUMNS)


def test_refresh_equals_batch_after_each_arrival(spark, sf_dir, tmp_path):
    target, landing, ckpt = (str(tmp_path / n) for n in ("t", "in", "ckpt"))
    policies, brokers = b.policies(spark, sf_dir), b.brokers(spark, sf_dir)
    orders = b.table(spark, sf_dir, "orders")

    def check(arrived):
        claims = orders.where(arrived).selectExpr(*b.CLAIM_COLUMNS)
        for name, want in (("integrated", integrate.integrate_entities(policies, brokers, claims)),
                           ("risk_dashboard", integrate.risk_dashboard(policies, brokers, claims)),
                           ("broker_matrix", integrate.matrix_from(policies, brokers, claims))):
            got = spark.read.parquet(f"{target}/{name}").select(*want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name

    stream = _stream(spark, sf_dir, landing, "o_orderkey % 2 = 0")
    jobs.refresh_chain(stream, policies, brokers, target, ckpt, n_buckets=4)
    check("o_orderkey % 2 = 0")

    # One more claim touches one broker: the other buckets keep their files.
    before = {p: set(glob.glob(f"{p}/*.parquet")) for p in glob.glob(f"{target}/broker_matrix/bucket=*")}
    one = orders.where("o_orderkey % 2 = 1").selectExpr("o_orderkey", *b.CLAIM_COLUMNS).join(
        policies.where("broker_id IS NOT NULL AND policy_number <> '900004'"), "policy_number").first().o_orderkey
    stream = _stream(spark, sf_dir, landing, f"o_orderkey = {one}")
    jobs.refresh_chain(stream, policies, brokers, target, ckpt, n_buckets=4)
    check(f"o_orderkey % 2 = 0 OR o_orderkey = {one}")
    changed = [p for p, fs in before.items() if set(glob.glob(f"{p}/*.parquet")) != fs]
    assert len(changed) == 1


def test_metric_history_of_late_and_repeated_rows(spark, tmp_path):
    """Every measurement equals a count over the rows that had arrived, whatever the batches; late rows correct it."""
    metrics = [quality.null_count("k"), quality.duplicate_count("k"), quality.row_count()]
    start, target, ckpt = "2024-01-01 00:00:00", str(tmp_path / "m"), str(tmp_path / "c")
    rng = random.Random(4)
    rows = [(rng.choice([None, "hot", "hot", f"v{rng.randint(0, 30)}"]), rng.randint(-3, 40)) for _ in range(240)]
    schema = "k string, minute int"
    for i in range(3):
        spark.createDataFrame(rows[80 * i : 80 * i + 80], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        arrived = F.lit(start).cast("timestamp") + F.make_interval(mins=F.col("minute"))
        jobs.scheduled_metrics(stream, metrics, target, ckpt, start, 5, arrived)
    got = {(r.metric_name, str(r.measurement_time)): r.metric_value
           for r in jobs.metric_history(spark, "T", metrics, target, start, 5, ticks=9).collect()}
    want = {}
    for tick in range(9):
        seen = [k for k, minute in rows if minute <= 5 * tick]
        at = str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * tick))
        many = Counter(k for k in seen if k is not None)
        want |= {("NULL_COUNT", at): seen.count(None), ("ROW_COUNT", at): len(seen),
                 ("DUPLICATE_COUNT", at): sum(n > 1 for n in many.values())}
    assert got == want


def test_repeats_need_no_python_and_outlive_merges_and_repeated_batches(spark, tmp_path, monkeypatch):
    """Any number of batches gives what one gives; a batch run twice, just after a merge or not, changes nothing."""
    monkeypatch.setattr(jobs, "BATCHES_PER_MERGE", 2)
    rng, target = random.Random(6), str(tmp_path / "m")
    rows = [("D", rng.choice(["hot", f"v{rng.randint(0, 12)}"]), rng.randint(0, 9)) for _ in range(72)]
    for i in range(6):
        for _ in range(2):
            jobs.store_repeats(spark.createDataFrame(rows[12 * i : 12 * i + 12], jobs.SEEN), target, i)
    sums = spark.read.parquet(f"{target}/repeated").groupBy("tick").agg(F.sum("change").alias("n")).where("n != 0")
    ticks = {v: sorted(t for _, x, t in rows if x == v) for v in {v for _, v, _ in rows}}
    assert {r.tick: r.n for r in sums.collect()} == Counter(t[1] for t in ticks.values() if len(t) > 1)
    left = {r.batch_id for r in spark.read.parquet(f"{target}/seen").select("batch_id").distinct().collect()}
    assert left == {4, 5}
    plan = plan_of(jobs.two_earliest(spark.createDataFrame(rows, jobs.SEEN)))
    assert "WindowGroupLimit" in plan and "InPandas" not in plan


def test_totals_are_merged_as_batches_come(spark, tmp_path):
    landing, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None, f"k{i}"]), rng.choice([None, i])) for i in range(70)]
    for i in range(7):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], "k string, v long").coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(landing)
    jobs.change_totals(stream, "k", "v", target, ckpt, batches_per_merge=3)
    got = {r.k: (r.n_rows, r.total) for r in jobs.latest_totals(spark, target, "k").collect()}
    assert got == {k: (sum(x == k for x, _ in rows), sum(v or 0 for x, v in rows if x == k))
                   for k in {k for k, _ in rows if k is not None}}
    sizes = {r.batch_id for r in spark.read.parquet(f"{target}/updates").select("batch_id").distinct().collect()}
    assert len(sizes) <= 3 and spark.read.parquet(f"{target}/merges").count() == 2


def test_refresh_chain_equals_batch_for_any_order_of_arrival(spark, sf_dir, tmp_path):
    landing, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    os.mkdir(landing)
    claims, brokers = b.claims(spark, sf_dir), b.brokers(spark, sf_dir)
    everyone = b.policies(spark, sf_dir).where("policy_number is not null")
    late = F.pmod(F.xxhash64("policy_number"), F.lit(3)) == 0
    half = F.pmod(F.xxhash64("incident_date", "claim_amount"), F.lit(2))
    moved = everyone.withColumn("broker_id", F.when(late, "BRK001").otherwise(F.col("broker_id")))
    other = brokers.withColumn("office_location", F.lit("London"))
    seen = None
    for no, (policies, now) in enumerate([(everyone.where(~late), brokers), (everyone, brokers), (moved, other)]):
        if no < 2:
            rows = claims.where(half == no)
            rows.write.parquet(f"{landing}/{no}")
            seen = rows if seen is None else seen.unionByName(rows)
        stream = spark.readStream.schema(claims.schema).parquet(f"{landing}/*")
        jobs.refresh_chain(stream, policies, now, target, ckpt, n_buckets=3)
        want = integrate.risk_dashboard(policies, now, seen)
        got = spark.read.parquet(f"{target}/risk_dashboard").select(want.columns)
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0


def test_a_batch_is_stored_before_it_is_read_again(spark, sf_dir, tmp_path, monkeypatch):
    """Claims are brought to their homes from stored files, and arriving files can be read by several tasks."""
    monkeypatch.setattr(plans, "ROW_GROUP_BYTES", 8 << 10)
    monkeypatch.setattr(plans, "scratch_dir", lambda spark, purpose: str(tmp_path / purpose))
    read, bring = [], refresh.Chain.bring

    def seen(self, claims, homes, batch_id):
        read.append((batch_id, claims.inputFiles()))
        bring(self, claims, homes, batch_id)

    monkeypatch.setattr(refresh.Chain, "bring", seen)
    refresh.refresh_chain(plans.arriving_claims(spark, sf_dir), b.policies(spark, sf_dir), b.brokers(spark, sf_dir),
                          str(tmp_path / "out"), str(tmp_path / "ckpt"), 3)
    arrived = {i: paths for i, paths in read if i >= 0}
    assert set(arrived) == {0, 1} and all(paths and all("/out/claims/" in p for p in paths) for paths in arrived.values())
    landed = glob.glob(f"{tmp_path}/landing/*.parquet")
    assert len(landed) == 2 and all(pq.ParquetFile(p).num_row_groups > 1 for p in landed)


def test_one_change_reads_only_its_buckets_and_survives_a_cut(spark, sf_dir, tmp_path, monkeypatch):
    """Files of all other buckets are unreadable while one policy moves; the first attempt fails half way."""
    landing, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    n = 5
    claims, brokers, policies = b.claims(spark, sf_dir), b.brokers(spark, sf_dir), b.policies(spark, sf_dir)
    claims.write.parquet(landing)
    stream = spark.readStream.schema(claims.schema).parquet(landing)
    refresh.refresh_chain(stream, policies, brokers, target, ckpt, n)

    home = refresh.bucket_of(n, "broker_id", "policy_number")
    sole = policies.groupBy("policy_number").agg(F.count("*").alias("k")).where("k = 1")
    row = policies.join(sole, "policy_number").join(claims.select("policy_number").distinct(), "policy_number").where(
        "broker_id IS NOT NULL").withColumn("x", home).orderBy("policy_number").first()
    other = brokers.withColumn("y", refresh.bucket_of(n, "broker_id")).where(F.col("y") != row.x).orderBy("broker_id").first()
    key = spark.createDataFrame([(row.policy_number,)], "policy_number string")
    moved = policies.join(key, "policy_number").withColumn("broker_id", F.lit(other.broker_id)).select(policies.columns)
    part = key.select(F.pmod(F.xxhash64("policy_number"), F.lit(n))).first()[0]
    spoilt = 0
    for path in glob.glob(f"{target}/**/*.parquet", recursive=True):
        place = dict(x.split("=") for x in path.split("/") if "=" in x)
        if place.get("bucket") not in (None, str(row.x), str(other.y)) or place.get("part") not in (None, str(part)):
            with open(path, "wb") as f:
                f.write(b"unreadable")
            spoilt += 1
    assert spoilt > 20

    none = refresh.Changes(brokers.select("broker_id").limit(0), brokers.limit(0))
    compute = refresh.Chain.compute
    monkeypatch.setattr(refresh.Chain, "compute", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        refresh.refresh_chain(stream, refresh.Changes(key, moved), none, target, ckpt, n)
    monkeypatch.setattr(refresh.Chain, "compute", compute)
    nothing = refresh.Changes(key.limit(0), policies.limit(0))
    refresh.refresh_chain(stream, nothing, none, target, ckpt, n)

    now = policies.join(key, "policy_number", "left_anti").unionByName(moved)
    touched = F.col("bucket").isin([row.x, other.y])
    for name, want in (("risk_dashboard", integrate.risk_dashboard(now, brokers, claims)),
                       ("broker_matrix", integrate.matrix_from(now, brokers, claims))):
        got = spark.read.parquet(f"{target}/{name}").where(touched).select(want.columns)
        want = want.withColumn("bucket", refresh.bucket_of(n, "broker_id")).where(touched).drop("bucket")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_buckets_that_lose_their_last_row_become_empty(spark, sf_dir, tmp_path):
    target, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    claims, brokers, policies = b.claims(spark, sf_dir), b.brokers(spark, sf_dir), b.policies(spark, sf_dir)
    claims.limit(0).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(claims.schema).parquet(str(tmp_path / "in"))
    few = policies.where("broker_id IS NOT NULL").orderBy("policy_number").limit(6)
    refresh.refresh_chain(stream, few, brokers, target, ckpt, 3)
    gone = refresh.Changes(few.select("policy_number"), few.limit(0))
    refresh.refresh_chain(stream, gone, brokers, target, ckpt, 3)
    for name in ("policies", "integrated", "risk_dashboard", "broker_matrix"):
        assert spark.read.parquet(f"{target}/{name}").count() == 0, name
