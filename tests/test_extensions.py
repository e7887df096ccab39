"""Trends, territories and segments against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from portfolia.operators import extensions as x


def test_moments_merge_to_one_fit(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(20)]), rng.randint(-50, 10**9)) for _ in range(300)]
    rows += [("flat", 5, 1), ("flat", 5, 2)]
    df = spark.createDataFrame(rows, "k string, x int, y long").repartition(5)
    whole = x.moments(df, "k", F.col("x"), F.col("y"))
    parts = [x.moments(df.where(F.pmod(F.xxhash64("y"), F.lit(3)) == i), "k", F.col("x"), F.col("y")) for i in range(3)]
    assert sorted(map(str, x.merged("k", *parts).collect())) == sorted(map(str, whole.collect()))
    for r in x.fitted(whole).collect():
        own = [(a, b) for k, a, b in rows if k == r.k and a is not None]
        assert r.n == len(own)
        if r.k == "flat":
            assert r.slope is None and r.intercept is None
        else:
            assert (r.slope, r.intercept) == pytest.approx(tuple(np.polyfit(*zip(*own, strict=True), 1)), rel=1e-6)


def test_trajectory_counts_a_claim_for_each_policy_of_its_number(spark):
    policies = spark.createDataFrame([("1", "B"), ("1", "B"), ("2", "B"), ("3", None), (None, "B")], "policy_number string, broker_id string")
    claims = spark.createDataFrame(
        [("1", dt.date(2000, 1, 2), 10), ("2", dt.date(2000, 1, 4), 40), ("2", None, 9), ("3", dt.date(2001, 1, 1), 7), (None, dt.date(2000, 1, 1), 1)],
        "policy_number string, incident_date date, claim_amount long")
    r, = x.risk_trajectory(policies, claims).collect()
    slope, intercept = np.polyfit([1, 1, 3], [10, 10, 40], 1)
    assert (r.broker_id, r.n_claims) == ("B", 3) and (r.slope, r.intercept) == pytest.approx((slope, intercept))


def test_territories(spark):
    policies = spark.createDataFrame([("A", 100.0), ("A", 0.01), ("B", 50.0), ("C", 7.0), (None, 3.0), ("D", None), ("X", 2.0)],
                                     "broker_id string, policy_annual_premium double")
    brokers = spark.createDataFrame(
        [("A", True, ["n", "s", "e"]), ("B", False, ["w", "n", "w", None]), ("C", True, None), ("D", True, ["far"]), ("E", True, ["empty"])],
        "broker_id string, active boolean, territory array<string>")
    got = {r.territory: (float(r.premium), r.n_brokers, r.n_policies) for r in x.territory_premium(policies, brokers).collect()}
    assert got == {"e": (33.34, 1, 2), "n": (58.34, 2, 3), "s": (33.33, 1, 2), "w": (25.0, 1, 1), "far": (0.0, 1, 1), None: (12.0, 2, 3)}
    assert sum(p for p, _, _ in got.values()) == pytest.approx(162.01)
    gaps = {r.territory: (r.n_brokers, float(r.premium)) for r in x.territory_gaps(policies, brokers).collect()}
    assert gaps == {"w": (1, 25.0), "empty": (1, 0.0)}


def test_segments_are_stable_and_equal_a_plain_run(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([20, 50, 80]) + rng.randint(0, 3), float(rng.choice([1000, 9000]) + rng.randint(0, 40)),
             rng.choice([None, 1])) for i in range(150)]
    names = ["age", "premium", "flag"]
    df = spark.createDataFrame(rows, "id long, age int, premium double, flag int")
    first = {r.id: r.segment for r in x.segment_customers(df.repartition(1), "id", names, 6).collect()}
    assert first == {r.id: r.segment for r in x.segment_customers(df.repartition(7, "age"), "id", names, 6).collect()}
    # The segments are a fixed point of plain k-means over the same scaled features.
    def scale(v, low, high):
        return x.SCALE // 2 if v is None else 0 if high == low else math.floor((v - low) / (high - low) * x.SCALE + 0.5)
    ends = [[r[i] for r in rows if r[i] is not None] for i in (1, 2, 3)]
    points = np.array([[scale(r[i], min(e), max(e)) for i, e in zip((1, 2, 3), ends, strict=True)] for r in rows], np.int64)
    label = np.array([first[r[0]] for r in rows])
    centres = np.array([(2 * points[label == j].sum(axis=0) + (label == j).sum()) // (2 * (label == j).sum()) for j in range(6)])
    far = ((points[:, None].astype(float) - centres[None]) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == label).all() and len(set(label)) == 6
    assert x.segment_customers(df.limit(0), "id", names).count() == 0
    assert {r.segment for r in x.segment_customers(df.where("id < 2"), "id", names, 6).collect()} == {0, 1}


def test_segment_passes_read_points_that_are_written_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(x, "scratch_dir", lambda spark, purpose: str(tmp_path / purpose))
    df = spark.createDataFrame([(i, i % 7, i % 3) for i in range(60)], "id long, a int, b int")
    got = x.segment_customers(df, "id", ["a", "b"], 4)
    assert spark.read.parquet(str(tmp_path / "points")).count() == 21 and got.count() == 60


def test_nearest_centre_is_the_first_of_equally_near_ones(spark):
    centres = [[x.SCALE, 0], [0, 0], [0, 0], [0, x.SCALE]]
    df = spark.createDataFrame([([0, 0],), ([x.SCALE, x.SCALE],), ([0, x.SCALE - 1],)], "_f array<long>")
    assert [r.j for r in df.select(x._nearest(centres).alias("j")).collect()] == [1, 0, 3]
    assert [r.j for r in df.select(x._nearest(centres[:1]).alias("j")).collect()] == [0, 0, 0]
