from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from portfolia import bindings as b
from portfolia.operators import governance as g
from portfolia.plans.risk import matrix
from tests.conftest import plan_of

ADMIN, ANALYST = g.AccessContext("ACCOUNTADMIN"), g.AccessContext("WORKSHOP_ANALYST")
OTHER = g.AccessContext("SOMEONE")


@pytest.fixture(scope="module")
def brokers(spark, sf_dir):
    return spark.createDataFrame(matrix(spark, sf_dir).collect(), matrix(spark, sf_dir).schema)


def test_roles(brokers):
    full = {r.broker_id: r for r in brokers.collect()}
    admin = g.governed_view(brokers, ADMIN, accessed_at="2024-01-01 00:00:00").collect()
    assert len(admin) == len(full)
    assert all(r.total_premium_volume == full[r.broker_id].total_premium_volume for r in admin)
    analyst = g.governed_view(brokers, ANALYST).collect()
    assert {r.broker_id for r in analyst} <= set(g.ISOLATED_BROKERS)
    assert all(set(json.loads(r.broker_performance_analysis)) == {"performance_tier", "access_level"}
               for r in analyst)
    # The row filter lets any other role through, the object mask does not.
    other = g.governed_view(brokers, OTHER).collect()
    assert len(other) == len(full)
    for r in other:
        value = full[r.broker_id].total_premium_volume
        assert r.total_premium_volume <= value and r.total_premium_volume % 10_000 == 0
        assert r.avg_customer_premium == 0
        assert json.loads(r.broker_performance_analysis) == {"masked": True, "access_level": "restricted"}


def test_no_role_test_is_left_in_the_plan(spark, sf_dir):
    rows = b.policies(spark, sf_dir)
    assert "BRK002" not in plan_of(g.row_policy(rows, ADMIN))
    assert "BRK002" in plan_of(g.row_policy(rows, ANALYST))
    assert "BRK002" in plan_of(g.row_policy(rows, g.AccessContext("X", "A_DATASHARING_CONSUMER")))


def test_policy_set_is_immutable(brokers):
    less = g.BROKER_POLICIES.without_mask("total_premium_volume")
    assert "total_premium_volume" in g.BROKER_POLICIES.masks and "total_premium_volume" not in less.masks
    with pytest.raises(ValueError):
        g.BROKER_POLICIES.with_mask("total_premium_volume", g.mask_financial)
    with pytest.raises(ValueError):
        less.with_mask("no_such", g.mask_financial).apply(brokers, OTHER)


def test_classification_and_tags(spark):
    df = spark.createDataFrame([("a@b.com", "M", 30), ("c@d.org", "F", 41)], "email string, sex string, age int")
    found = {r.column_name: r for r in g.classify_columns(df, "T").collect()}
    assert found["email"].sensitive and found["email"].match_rate == 1.0 and found["sex"].category == "GENDER"
    tagged = g.tag_columns(df, {"email": "EMAIL"})
    assert tagged.schema["email"].metadata == {"category": "EMAIL"}
    assert tagged.select(F.col("email")).schema["email"].metadata == {"category": "EMAIL"}


def test_classification_by_values(spark):
    rows = [("a@b.com", "123456", 1234567, "Male", "Quiet Words", 30), ("c@d.org", "7654321", 7654321, "f", "More", 41),
            (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "contact string, ref string, code long, kind string, `a.note` string, n int")
    found = {(r.column_name, r.category): r for r in g.classify_columns(df, "T").collect()}
    assert set(found) == {("contact", "EMAIL"), ("ref", "POLICY_ID"), ("code", "POLICY_ID"), ("kind", "GENDER")}
    assert all(r.sensitive and r.match_rate == 1.0 and r.n_values == 2 for r in found.values())
