"""Entity integration, portfolio scoring and the broker matrix (items 29-32, 52, 70, 91)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portfolia.functions import risk
from portfolia.operators.skew import lookup_join, salted_join


def mean(value: Column, weight: Column | None = None) -> Column:
    """Average as an exact sum over a count, so the result does not depend on row order."""
    if weight is None:
        return F.sum(value).cast("double") / F.count(value)
    return F.sum(value * weight).cast("double") / F.sum(F.when(value.isNotNull(), weight))


def round_half_up(value: Column, digits: int) -> Column:
    """Rounding half up of the decimal digits; values too large for six decimals have none to round."""
    return F.coalesce(F.round(value.try_cast("decimal(38,6)"), digits).cast("double"), value.cast("double"))


def nested_extract(brokers: DataFrame, round_satisfaction: bool = True) -> DataFrame:
    """Item 19: flatten the metrics object; numbers take scale 0, rounded half up."""
    m = "performance_metrics"

    def number(field: str) -> Column:
        return F.col(f"{m}.{field}").cast("decimal(38,0)").cast("long")

    satisfaction = (
        number("customer_satisfaction") if round_satisfaction else F.col(f"{m}.customer_satisfaction")
    )
    return brokers.select(
        "broker_id",
        F.col("first_name").alias("broker_first_name"),
        F.col("last_name").alias("broker_last_name"),
        F.col("email").alias("broker_email"),
        F.col("office_location").alias("broker_office"),
        F.col("specializations").alias("broker_specializations"),
        F.col("territory").alias("broker_territory"),
        satisfaction.alias("broker_satisfaction"),
        number("years_experience").alias("broker_experience"),
        number("training_hours_completed").alias("broker_training"),
        F.col("active").alias("broker_active"),
    )


POLICY_PART = [
    "policy_number", "age", "insured_sex", "insured_education_level", "insured_occupation",
    "policy_start_date", "policy_length_month", "policy_deductable", "policy_annual_premium",
    "broker_id",
]
BROKER_PART = [
    "broker_first_name", "broker_last_name", "broker_email", "broker_office",
    "broker_specializations", "broker_territory", "broker_satisfaction", "broker_experience",
    "broker_training", "broker_active",
]
CLAIM_PART = [
    "incident_date", "incident_type", "incident_severity", "authorities_contacted",
    "incident_hour_of_the_day", "number_of_vehicles_involved", "bodily_injuries", "witnesses",
    "police_report_available", "claim_amount", "fraud_reported",
]


def has_claim_fill(joined: DataFrame, matched: Column) -> DataFrame:
    """Item 18: claim flag and defaults for policies without a claim."""
    return joined.withColumns(
        {
            "has_claim": matched.cast("int"),
            "claim_amount_filled": F.coalesce(F.col("claim_amount"), F.lit(0).cast("long")),
            "fraud_reported_filled": F.coalesce(F.col("fraud_reported"), F.lit(False)),
        }
    )


def integrate_entities(
    policies: DataFrame,
    brokers: DataFrame,
    claims: DataFrame,
    round_satisfaction: bool = True,
    also_on: tuple[str, ...] = (),
) -> DataFrame:
    """Item 29 (level 1): policy, its broker and its claims; one row per policy and claim.

    The claim join salts hot policy numbers of either side. Spark broadcasts the broker
    table where its size allows. ``also_on`` names
    columns, present in policies and claims, that must be equal besides the number.
    """
    dim = nested_extract(brokers, round_satisfaction)
    joined = salted_join(
        lookup_join(policies.select(*POLICY_PART, *also_on), dim, "broker_id"),
        claims.select("policy_number", *also_on, *CLAIM_PART, F.lit(1).alias("_claim")),
        ["policy_number", *also_on],
    )
    out = has_claim_fill(joined, F.col("_claim").isNotNull())
    return out.select(
        *POLICY_PART, *BROKER_PART, *CLAIM_PART,
        "has_claim", "claim_amount_filled", "fraud_reported_filled", *also_on,
    )


def claim_profile(claims: DataFrame) -> DataFrame:
    """Claims summed per policy, score band and fraud flag: at most eight rows per policy."""
    amount = F.coalesce(F.col("claim_amount"), F.lit(0).cast("long"))
    return (
        claims.where(F.col("policy_number").isNotNull())
        .groupBy(
            "policy_number",
            risk.claim_band(amount).alias("band"),
            F.coalesce(F.col("fraud_reported"), F.lit(False)).alias("fraud"),
        )
        .agg(F.count(F.lit(1)).alias("n_claims"), F.sum(amount).alias("claim_sum"))
    )


def scored_portfolio(
    policies: DataFrame,
    brokers: DataFrame,
    claims: DataFrame,
    round_satisfaction: bool = True,
) -> DataFrame:
    """Level 2 in summed form: every aggregate over level 2 comes from here.

    Level 2 has one row per policy and claim, so a repeated policy number with many
    claims multiplies. Rows that differ only in the claim amount inside one score
    band are equal for every aggregate but the claim sum, so claims are summed
    first and each row carries ``weight``, the number of level-2 rows it stands
    for, and ``claim_total``, their filled claim amounts. Policies without a broker
    id are left out, as in level 2. A policy number shared by a third of all
    policies meets at most eight right rows, and adaptive skew handling may split
    the left side, because the result feeds aggregations on other keys.
    """
    dim = nested_extract(brokers, round_satisfaction).drop(
        "broker_email", "broker_specializations", "broker_territory", "broker_active"
    )
    rows = lookup_join(policies.where(F.col("broker_id").isNotNull()), dim, "broker_id").join(
        claim_profile(claims), "policy_number", "left"
    )
    rows = rows.withColumns(
        {
            "weight": F.coalesce(F.col("n_claims"), F.lit(1).cast("long")),
            "claim_total": F.coalesce(F.col("claim_sum"), F.lit(0).cast("long")),
            "has_claim": F.col("n_claims").isNotNull().cast("int"),
            "fraud_reported_filled": F.coalesce(F.col("fraud"), F.lit(False)),
            "customer_risk_score": risk.risk_score(
                F.col("age"), F.col("policy_annual_premium"),
                risk.band_floor(F.coalesce(F.col("band"), F.lit(0))),
            ),
        }
    )
    return rows.withColumns(
        {
            "customer_region": risk.region_of(F.col("broker_office")),
            "customer_segment": risk.segment_of(F.col("policy_annual_premium")),
            "broker_tier": risk.broker_tier(
                F.col("broker_satisfaction"), F.col("broker_experience"), F.col("broker_training")
            ),
            "final_risk_level": risk.risk_level_of(F.col("customer_risk_score")),
        }
    ).drop("n_claims", "claim_sum", "band", "fraud")


def broker_totals(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Per broker: policies, level-2 rows and the sum of filled claims, from per-policy sums."""
    per_policy = (
        claims.where(F.col("policy_number").isNotNull()).groupBy("policy_number")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.coalesce(F.col("claim_amount"), F.lit(0).cast("long"))).alias("s"),
        )
    )
    copies = (
        policies.where(F.col("broker_id").isNotNull()).groupBy("policy_number", "broker_id")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    n, s = F.coalesce(F.col("n"), F.lit(1)), F.coalesce(F.col("s"), F.lit(0))
    return (
        copies.join(per_policy, "policy_number", "left")
        .groupBy("broker_id")
        .agg(F.sum("m").alias("n_policies"), F.sum(F.col("m") * n).alias("n_rows"),
             F.sum(F.col("m") * s).alias("claim_sum"))
    )


def _stats(totals: DataFrame) -> DataFrame:
    return totals.select(
        "broker_id",
        F.col("n_rows").alias("broker_customer_count"),
        (F.col("claim_sum").cast("double") / F.col("n_rows")).alias("broker_avg_claim"),
    )


def broker_window_stats(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Item 70: level-2 rows and average filled claim per broker.

    The value a whole-partition window repeats on every row is computed once per
    broker: a window would send a hot broker to one task.
    """
    return _stats(broker_totals(policies, claims))


def broker_profile(dim: DataFrame, stats: DataFrame, exact: bool = False) -> DataFrame:
    """Everything level 2 says about a broker, one row per broker id in use.

    The analysis depends on the broker alone, so it is evaluated per broker here and
    not per policy.
    """
    return stats.join(dim, "broker_id", "left").withColumn(
        "broker_performance_analysis",
        risk.broker_performance(
            F.col("broker_satisfaction"), F.col("broker_experience"), F.col("broker_training"),
            F.col("broker_customer_count"), F.col("broker_avg_claim"), exact,
        ),
    )


DASHBOARD_COLUMNS = [
    "policy_number", "age", "insured_sex", "insured_occupation", "policy_annual_premium",
    "policy_length_month", "claim_amount_filled", "fraud_reported_filled", "has_claim",
    "broker_id", "broker_first_name", "broker_last_name", "broker_office", "broker_satisfaction",
    "broker_experience", "broker_training", "customer_region", "customer_segment",
    "broker_customer_count", "broker_avg_claim", "customer_risk_score", "broker_tier",
    "broker_performance_analysis", "final_risk_level",
]


def score_rows(integrated: DataFrame) -> DataFrame:
    """Row-level part of level 2: region, segment, score, level and tier."""
    return (
        integrated.where(F.col("broker_id").isNotNull())
        .withColumns(
            {
                "customer_region": risk.region_of(F.col("broker_office")),
                "customer_segment": risk.segment_of(F.col("policy_annual_premium")),
                "customer_risk_score": risk.risk_score(
                    F.col("age"), F.col("policy_annual_premium"), F.col("claim_amount_filled")
                ),
                "broker_tier": risk.broker_tier(
                    F.col("broker_satisfaction"), F.col("broker_experience"), F.col("broker_training")
                ),
            }
        )
        .withColumn("final_risk_level", risk.risk_level_of(F.col("customer_risk_score")))
    )


def risk_dashboard(
    policies: DataFrame,
    brokers: DataFrame,
    claims: DataFrame,
    exact: bool = False,
    round_satisfaction: bool = True,
) -> DataFrame:
    """Item 91 (level 2): 24 columns per policy and claim, for policies with a broker id.

    Broker numbers are attached to the policies before the claim join, where there
    are fewest rows, as one per-broker profile.
    """
    totals = broker_totals(policies, claims)
    left = lookup_join(
        policies.where(F.col("broker_id").isNotNull()),
        broker_profile(nested_extract(brokers, round_satisfaction), _stats(totals), exact),
        "broker_id", "inner",
    )
    joined = salted_join(
        left,
        claims.select("policy_number", "claim_amount", "fraud_reported", F.lit(1).alias("_claim")),
        "policy_number",
    )
    return score_rows(has_claim_fill(joined, F.col("_claim").isNotNull())).select(*DASHBOARD_COLUMNS)


def dashboard_from(integrated: DataFrame, exact: bool = False) -> DataFrame:
    """Level 2 from a stored level 1, as the refresh chain computes it."""
    rows = score_rows(integrated)
    totals = rows.groupBy("broker_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("claim_amount_filled").alias("claim_sum"),
        *[F.max(c).alias(c) for c in ("broker_satisfaction", "broker_experience", "broker_training")],
    )
    traits = totals.drop("n_rows", "claim_sum")
    profile = broker_profile(traits, _stats(totals), exact).drop(*traits.columns[1:])
    return lookup_join(rows, profile, "broker_id", "inner").select(*DASHBOARD_COLUMNS)


def matrix_from_dashboard(dashboard: DataFrame, exact: bool = False) -> DataFrame:
    """Level 3 from a stored level 2, whose rows count once each."""
    stats = dashboard.groupBy("broker_id").agg(
        F.max("broker_customer_count").alias("broker_customer_count"),
        F.max("broker_avg_claim").alias("broker_avg_claim"),
    )
    return broker_matrix(dashboard.withColumn("weight", F.lit(1).cast("long")), stats, exact)


def broker_matrix(
    portfolio: DataFrame, stats: DataFrame, exact: bool = False, count_mode: str = "rows"
) -> DataFrame:
    """Item 52 (level 3): one row per broker, from :func:`scored_portfolio`.

    ``count_mode="rows"`` counts level-2 rows, as the reference semantics do;
    ``"distinct"`` counts distinct policy numbers.
    """
    premium, score, w = F.col("policy_annual_premium"), F.col("customer_risk_score"), F.col("weight")
    total = F.sum("weight") if count_mode == "rows" else F.countDistinct("policy_number")
    per_broker = portfolio.groupBy("broker_id").agg(
        F.max("broker_first_name").alias("broker_first_name"),
        F.max("broker_last_name").alias("broker_last_name"),
        F.max("broker_tier").alias("broker_tier"),
        total.alias("total_customers"),
        mean(premium, w).alias("avg_customer_premium"),
        mean(score, w).alias("avg_customer_risk"),
        F.sum(premium * w).cast("double").alias("total_premium_volume"),
        F.max(F.col("broker_tier").isNotNull()).alias("broker_active"),
        F.max("broker_satisfaction").alias("_sat"),
        F.max("broker_experience").alias("_exp"),
        F.max("broker_training").alias("_trn"),
    )
    return per_broker.join(stats, "broker_id").select(
        "broker_id", "broker_first_name", "broker_last_name", "broker_tier", "total_customers",
        "avg_customer_premium", "avg_customer_risk", "total_premium_volume",
        risk.broker_performance(
            F.col("_sat"), F.col("_exp"), F.col("_trn"),
            F.col("broker_customer_count"), F.col("broker_avg_claim"), exact,
        ).alias("broker_performance_analysis"),
        "broker_active",
    )


def matrix_from(policies: DataFrame, brokers: DataFrame, claims: DataFrame, **kw) -> DataFrame:
    return broker_matrix(
        scored_portfolio(policies, brokers, claims), broker_window_stats(policies, claims), **kw
    )


# Relationship checks -----------------------------------------------------------------


def _per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def check_broker_link(policies: DataFrame, brokers: DataFrame) -> DataFrame:
    """Item 30: policies with a number, and rows that found a broker."""
    per_id = policies.groupBy("broker_id").agg(
        F.count("policy_number").alias("with_number"), F.count(F.lit(1)).alias("rows")
    )
    hits = _per_key(brokers, "broker_id", "hits")
    fan = F.coalesce(F.col("hits"), F.lit(1))
    return per_id.join(hits, "broker_id", "left").agg(
        F.lit("CUSTOMER-BROKER RELATIONSHIP").alias("check_type"),
        F.sum(F.col("with_number") * fan).alias("customers_with_brokers"),
        F.sum(F.col("rows") * F.coalesce(F.col("hits"), F.lit(0))).alias("matched_brokers"),
    )


def check_claim_link(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Item 31: policies that have claims, and joined rows, from per-key counts."""
    both = _per_key(policies, "policy_number", "p").join(
        _per_key(claims, "policy_number", "c"), "policy_number"
    )
    return both.agg(
        F.lit("CUSTOMER-CLAIMS RELATIONSHIP").alias("check_type"),
        F.count(F.lit(1)).alias("customers_with_claims"),
        F.coalesce(F.sum(F.col("p") * F.col("c")), F.lit(0)).alias("total_claims"),
    )


def relationship_quality(policies: DataFrame, claims: DataFrame, measured_at: str | None = None) -> DataFrame:
    """Item 32: distinct policies, those with a claim, and the share in percent, at a time (now if none is given)."""
    p = policies.select("policy_number").where("policy_number IS NOT NULL").distinct()
    c = claims.select("policy_number").where("policy_number IS NOT NULL").distinct()
    counted = p.join(c.withColumn("hit", F.lit(1)), "policy_number", "left").agg(
        F.count(F.lit(1)).alias("total_customers"), F.count("hit").alias("valid_relationships")
    )
    share = F.try_divide(F.col("valid_relationships") * F.lit(100.0), F.col("total_customers"))
    return counted.select(
        F.lit("CUSTOMER_CLAIMS_INTEGRITY").alias("relationship_type"),
        "total_customers",
        "valid_relationships",
        (F.col("total_customers") - F.col("valid_relationships")).alias("missing_relationships"),
        round_half_up(share, 2).alias("integrity_percentage"),
        (F.current_timestamp() if measured_at is None else F.lit(measured_at).cast("timestamp")).alias("measured_at"),
    )
