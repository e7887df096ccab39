from __future__ import annotations

import pytest

from portfolia.operators import semantic as s
from portfolia.plans.risk import portfolio, stats


def test_synonyms():
    m = s.RISK_MODEL
    assert m.resolve("Market_Area") == "customer_region" and m.resolve("loss_ratio") == "claim_to_premium_ratio"
    assert m.resolve("CLAIM_FLAG") == "has_claim" and m.resolve("risky_policies") == "high_risk_policies"
    assert len(m.dimensions) == 13 and len(m.facts) == 11
    for name in ("risk_level", "broker_performance_rating"):
        with pytest.raises(s.AmbiguousName):
            m.resolve(name)
    # Within one kind the name is clear.
    assert m.resolve("risk_level", ("facts",)) == "customer_risk_score"
    with pytest.raises(KeyError):
        m.resolve("no_such_name")


def test_query(spark, sf_dir):
    rows = portfolio(spark, sf_dir)
    out = s.RISK_MODEL.query(rows, ["gender"], ["count", "sum:amount_paid", "avg:claim_payout"], limit=1)
    assert out.columns == ["insured_sex", "row_count", "sum_claim_amount_filled", "avg_claim_amount_filled"]
    r = out.first()
    assert r.avg_claim_amount_filled == r.sum_claim_amount_filled / r.row_count
    with pytest.raises(ValueError):
        s.RISK_MODEL.query(rows, [], ["max:age"])


def test_all_names_resolve_on_the_model_table(spark, sf_dir):
    rows = s.model_table(portfolio(spark, sf_dir), stats(spark, sf_dir))
    names = {*s.RISK_MODEL.dimensions, *s.RISK_MODEL.facts}
    assert {s.RISK_MODEL.totals.get(n, n) for n in names} <= set(rows.columns)
