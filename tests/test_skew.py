"""Skew-safe operators against plain ones, with limits small enough to take effect."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from portfolia.operators import skew
from portfolia.operators.skew import exact_quantiles, lookup_join, number_runs, salted_join


def _pairs(spark, seed, n, hot):
    rng = random.Random(seed)
    keys = ["hot"] * (n // 3) + [rng.choice(["a", "b", "c", hot, None]) for _ in range(n - n // 3)]
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v int").repartition(3)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("rows_per_salt", [5, 20, 1000])
def test_salted_join_equals_join(spark, how, rows_per_salt):
    left = _pairs(spark, 1, 90, "only_left").withColumnRenamed("v", "l")
    right = _pairs(spark, 2, 120, "only_right").withColumnRenamed("v", "r")
    got = salted_join(left, right, "k", how, rows_per_salt).select("k", "l", "r")
    want = left.join(right, "k", how).select("k", "l", "r")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salted_join_with_given_counts(spark):
    left = _pairs(spark, 3, 200, "x").withColumnRenamed("v", "l")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, r int")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    got = salted_join(left, right, "k", "left", 10, left_counts=counts, right_unique=True)
    want = left.join(right, "k", "left")
    assert sorted(map(str, got.select("k", "l", "r").collect())) == sorted(
        map(str, want.select("k", "l", "r").collect()))


def test_hot_key_is_spread(spark):
    left = spark.range(4000).select(F.lit("hot").alias("k"), "id").repartition(4)
    right = spark.createDataFrame([("hot", 1)], "k string, r int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = salted_join(left, right, "k", "inner", 200)
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.count() == 4000
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 3000


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_number_runs(spark, block):
    rng = random.Random(block)
    rows = [(c, t, rng.choice("uas")) for c in range(4) for t in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(rows, "g int, t long, v string")
    odd = F.when(F.col("v") != "s", F.col("v"))
    got = {(r.g, r.t): (r.run, r.odd) for r in
           number_runs(df, "g", "t", {"run": F.col("v"), "odd": odd}, block).collect()}
    assert len(got) == len(rows)
    for g in range(4):
        run = odd_run = 0
        prev = prev_odd = None
        for _, t, v in [r for r in rows if r[0] == g]:
            run += v != prev
            prev = v
            if v != "s":
                odd_run += v != prev_odd
                prev_odd = v
            assert got[g, t] == (run, odd_run if v != "s" else None)


@pytest.mark.parametrize(("cuts", "most", "few"), [(2, 3, 100), (16, 20, 0), (64, 65_536, 100)])
def test_exact_quantiles(spark, cuts, most, few, monkeypatch):
    """Ranges are cut again until they hold few values; a group outside any list is there, too."""
    monkeypatch.setattr(skew, "FEW", few)
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=501).round(2), "b": np.array([3.0] * 200 + [1.0, 9.0]), "c": np.array([7.5])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "g", "v", probs, cuts=cuts, most=most).collect()}
    assert len(got) == 3 * len(probs)
    for g, vs in data.items():
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(vs, p))


def test_weighted_quantiles(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", 5.0, 6), ("a", 8.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    spread = [v for _, v, w in rows for _ in range(w)]
    for r in exact_quantiles(df, "g", "v", [0.0, 0.3, 0.5, 1.0], "w").collect():
        assert r.n == 10 and r.quantile == pytest.approx(np.quantile(spread, r.prob))


def test_lookup_join_is_a_plain_join(spark):
    rows = _pairs(spark, 7, 150, "x").withColumnRenamed("v", "l")
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("z", 4)], "k string, r int")
    got = lookup_join(rows, lookup, "k").select("k", "l", "r")
    want = rows.join(lookup, "k", "left").select("k", "l", "r")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
