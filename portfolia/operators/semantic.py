"""Named dimensions, facts, filters and metrics, and the business questions (items 27, 110-121)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from portfolia.operators.feeds import count_rows, level_count, weight, with_analysis
from portfolia.operators.integrate import mean, round_half_up


class AmbiguousName(ValueError):
    """A synonym that stands for more than one thing."""


@dataclass(frozen=True)
class SemanticModel:
    """Names over the summed portfolio (``integrate.scored_portfolio``).

    ``dimensions`` and ``facts`` map a column to its synonyms. ``filters`` and
    ``metrics`` map a name to a column expression builder. ``totals`` gives facts that
    vary inside a summed row: the column that holds their sum over the row's weight.
    """

    dimensions: dict[str, tuple[str, ...]]
    facts: dict[str, tuple[str, ...]]
    filters: dict[str, Callable[[], Column]] = field(default_factory=dict)
    metrics: dict[str, Callable[[], Column]] = field(default_factory=dict)
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    totals: dict[str, str] = field(default_factory=dict)

    def resolve(self, name: str, kinds: Sequence[str] = ("dimensions", "facts", "filters", "metrics")) -> str:
        """The canonical name behind a name or synonym, ignoring case."""
        wanted = name.lower()
        named = [n for k in kinds for n in getattr(self, k) if n == wanted]
        if named:
            return named[0]
        found = set()
        for kind in kinds:
            for canonical in getattr(self, kind):
                synonyms = (
                    getattr(self, kind)[canonical] if kind in ("dimensions", "facts")
                    else self.aliases.get(canonical, ())
                )
                if wanted in (s.lower() for s in synonyms):
                    found.add(canonical)
        if not found:
            raise KeyError(f"unknown name: {name}")
        if len(found) > 1:
            raise AmbiguousName(f"{name} may mean {', '.join(sorted(found))}")
        return found.pop()

    def measure(self, name: str) -> tuple[str, Column]:
        """``count``, ``sum:<fact>``, ``avg:<fact>`` or a named metric."""
        if name == "count":
            return "row_count", count_rows()
        if ":" not in name:
            metric = self.resolve(name, ("metrics",))
            return metric, self.metrics[metric]()
        how, fact = name.split(":", 1)
        fact = self.resolve(fact, ("facts",))
        if fact in self.totals:
            total = F.sum(self.totals[fact])
            value = total if how == "sum" else total.cast("double") / F.sum("weight")
        else:
            value = F.sum(F.col(fact) * weight()) if how == "sum" else mean(F.col(fact), weight())
        if how not in ("sum", "avg"):
            raise ValueError(f"unknown aggregate: {how}")
        return f"{how}_{fact}", value

    def query(self, portfolio: DataFrame, dimensions: Sequence[str] = (), metrics: Sequence[str] = ("count",),
              filters: Sequence[str] = (), order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
        """Item 110: group the rows that pass the filters and compute the measures."""
        for f in filters:
            portfolio = portfolio.where(self.filters[self.resolve(f, ("filters",))]())
        dims = [self.resolve(d, ("dimensions",)) for d in dimensions]
        aggs = [column.alias(name) for name, column in map(self.measure, metrics)]
        out = portfolio.groupBy(*dims).agg(*aggs) if dims else portfolio.agg(*aggs)
        if order:
            out = out.orderBy(*order)
        return out if limit is None else out.limit(limit)


# Dimensions of the risk model and their synonyms.
DIMENSIONS = {
    "policy_number": ("policy_id", "policy_reference", "policy_code", "contract_number",
                      "insurance_policy_number", "policy_identifier"),
    "insured_sex": ("gender", "insured_gender", "policyholder_sex", "insured_person_gender",
                    "policyholder_gender"),
    "insured_occupation": ("insured_job", "insured_profession", "insured_role", "insured_work",
                           "insured_position", "insured_title", "insured_vocation", "insured_employment"),
    "fraud_reported_filled": ("fraudulent_claims", "reported_fraud", "filled_fraudulent_claims",
                              "claims_marked_as_fraud", "fraudulent_claims_filled"),
    "broker_id": ("broker_identifier", "agent_id", "insurance_agent_id", "intermediary_id", "broker_code",
                  "insurance_broker_id", "agent_code"),
    "broker_first_name": ("broker_given_name", "first_name_of_broker", "broker_forename",
                          "first_name_broker", "broker_firstname"),
    "broker_last_name": ("broker_surname", "broker_family_name", "broker_last_name_on_record",
                         "broker_full_last_name", "broker_registered_last_name"),
    "broker_office": ("broker_location", "office_location", "broker_branch", "agency_location",
                      "brokerage_office", "office_name"),
    "customer_region": ("geographic_area", "customer_location", "regional_area", "area_of_operation",
                        "customer_territory", "sales_region", "market_area"),
    "customer_segment": ("customer_category", "policy_holder_group", "client_tier", "customer_type",
                         "policy_segment", "client_classification"),
    "broker_tier": ("broker_level", "broker_rank", "broker_grade", "broker_classification",
                    "broker_category", "broker_rating"),
    "broker_performance_analysis": ("broker_performance_rating", "broker_success_evaluation",
                                    "broker_efficiency_assessment", "broker_quality_measurement",
                                    "broker_productivity_analysis"),
    "final_risk_level": ("risk_classification", "risk_category", "risk_rating", "risk_status",
                         "risk_level", "risk_assessment", "risk_profile", "risk_grade"),
}

# Facts of the risk model and their synonyms.
FACTS = {
    "age": ("years_old", "years_of_age", "age_in_years", "years_lived", "birth_age"),
    "policy_annual_premium": ("annual_policy_cost", "yearly_premium", "policy_yearly_fee",
                              "annual_insurance_cost", "yearly_insurance_premium"),
    "policy_length_month": ("policy_duration", "coverage_period", "policy_term", "coverage_length",
                            "policy_tenure", "contract_length", "insurance_term", "coverage_duration"),
    "claim_amount_filled": ("amount_paid", "claim_payout", "filled_claim_amount", "paid_claim_value",
                            "settlement_amount", "claim_settlement", "insurance_payout",
                            "claim_reimbursement", "paid_insurance_claim"),
    "has_claim": ("claim_exists", "claim_present", "claim_status", "claim_indicator", "claim_flag"),
    "broker_satisfaction": ("broker_happiness", "broker_contentment", "broker_approval_rating",
                            "broker_service_quality", "broker_performance_rating",
                            "broker_evaluation_score"),
    "broker_experience": ("broker_tenure", "years_of_service", "broker_service_length",
                          "experience_level", "broker_time_in_industry", "industry_experience"),
    "broker_training": ("broker_certification", "broker_development", "broker_education",
                        "broker_professional_development", "broker_skills_training"),
    "broker_customer_count": ("broker_portfolio_size", "broker_client_count", "broker_policyholder_count",
                              "broker_customer_base", "broker_client_base"),
    "broker_avg_claim": ("average_claim_per_broker", "broker_average_claim_amount",
                         "average_broker_claim", "broker_claim_average", "mean_claim_per_broker"),
    "customer_risk_score": ("customer_risk_rating", "risk_level", "policyholder_risk_assessment",
                            "client_risk_grade", "risk_profile_score"),
}

# Synonyms of the named filter and the named metric.
ALIASES = {
    "high_risk_policies": ("risky_policies", "elevated_risk_policies", "high_risk_portfolio",
                           "problematic_policies", "flagged_policies"),
    "claim_to_premium_ratio": ("loss_ratio", "claim_efficiency_ratio", "payout_ratio",
                               "claims_percentage", "loss_percentage", "claims_to_premium_percentage"),
}

#: Fixed value: the score at which a policy is high-risk for the named filter.
HIGH_RISK_SCORE = 50


def model_table(portfolio: DataFrame, stats: DataFrame) -> DataFrame:
    """The summed portfolio with its brokers' count, average and analysis: all names of the model resolve on it."""
    return with_analysis(portfolio.join(stats, "broker_id"))


def semantic_filter() -> Column:
    """Item 27: high score, or fraud reported."""
    return (F.col("customer_risk_score") >= HIGH_RISK_SCORE) | F.col("fraud_reported_filled")


def claim_to_premium() -> Column:
    """Item 111: average claim over premium, to four digits; rows without premium are left out.

    The claims behind a summed row share one premium, so the row's ratio sum is its
    claim total over that premium. Adding decimals keeps the result independent of order.
    """
    premium = F.col("policy_annual_premium")
    usable = premium.isNotNull() & (premium != 0)
    ratio = F.try_divide(F.col("claim_total").cast("double"), premium.cast("double")).cast("decimal(28,8)")
    return round_half_up(F.sum(ratio).cast("double") / F.sum(F.when(usable, weight())), 4)


RISK_MODEL = SemanticModel(
    dimensions=DIMENSIONS,
    facts=FACTS,
    filters={"high_risk_policies": semantic_filter},
    metrics={"claim_to_premium_ratio": claim_to_premium},
    aliases=ALIASES,
    totals={"claim_amount_filled": "claim_total"},
)


# Business questions over the summed portfolio ---------------------------------------------


def q_high_risk_share(portfolio: DataFrame) -> DataFrame:
    """Item 112."""
    out = portfolio.agg(level_count("HIGH").alias("high_risk_policies"), count_rows().alias("total_policies"))
    share = F.try_divide(F.col("high_risk_policies") * F.lit(100.0), F.col("total_policies"))
    return out.withColumn("high_risk_pct", round_half_up(share, 2))


def q_fraud_claims(portfolio: DataFrame) -> DataFrame:
    """Item 113: totals and averages by fraud flag, and the difference of the averages."""
    out = portfolio.groupBy("fraud_reported_filled").agg(
        count_rows().alias("policies"),
        F.sum("claim_total").alias("total_claims"),
        (F.sum("claim_total").cast("double") / F.sum("weight")).alias("avg_claim"),
    )
    # Two rows at most, so this window is small whatever the input.
    both = Window.partitionBy(F.lit(1))
    diff = (F.max(F.when(F.col("fraud_reported_filled"), F.col("avg_claim"))).over(both)
            - F.max(F.when(~F.col("fraud_reported_filled"), F.col("avg_claim"))).over(both))
    return out.withColumn("avg_difference", diff)


def _fraud_rate() -> Column:
    return round_half_up(
        F.try_divide(count_rows(F.col("fraud_reported_filled")) * F.lit(100.0), F.sum("weight")), 2
    )


def q_tier_risk(portfolio: DataFrame) -> DataFrame:
    """Item 114: tiers from the lowest average score up."""
    return (
        portfolio.groupBy("broker_tier")
        .agg(mean(F.col("customer_risk_score"), weight()).alias("avg_risk_score"),
             _fraud_rate().alias("fraud_rate"), count_rows().alias("policies"))
        .orderBy("avg_risk_score", "fraud_rate", "broker_tier")
    )


def q_region_concentration(portfolio: DataFrame) -> DataFrame:
    """Item 115: share of each level per region, and the region's mean broker experience."""
    cells = portfolio.groupBy("customer_region", "final_risk_level").agg(
        F.sum("weight").alias("policies"),
        F.sum(F.col("broker_experience") * weight()).alias("_exp"),
        F.sum(F.when(F.col("broker_experience").isNotNull(), weight())).alias("_exp_n"),
    )
    # One row per region and level is left, so the window is small.
    region = Window.partitionBy("customer_region")
    share = F.col("policies") * F.lit(100.0) / F.sum("policies").over(region)
    return cells.select(
        "customer_region", "final_risk_level", "policies",
        round_half_up(share, 2).alias("share_pct"),
        (F.sum("_exp").over(region).cast("double") / F.sum("_exp_n").over(region))
        .alias("avg_broker_experience"),
    )


def q_broker_profile_corr(portfolio: DataFrame) -> DataFrame:
    """Item 116: correlation over brokers of each trait with mean risk, claim and fraud rate."""
    traits = ["broker_experience", "broker_training", "broker_satisfaction"]
    per_broker = portfolio.where(F.col("broker_experience").isNotNull()).groupBy("broker_id").agg(
        *[F.max(t).cast("double").alias(t) for t in traits],
        mean(F.col("customer_risk_score"), weight()).alias("avg_risk"),
        (F.sum("claim_total").cast("double") / F.sum("weight")).alias("avg_claim"),
        (count_rows(F.col("fraud_reported_filled")).cast("double") / F.sum("weight")).alias("fraud_rate"),
    )
    out = per_broker.agg(
        *[F.corr(t, m).alias(f"{t}|{m}") for t in traits for m in ("avg_risk", "avg_claim", "fraud_rate")]
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("trait"),
                     *[round_half_up(F.col(f"`{t}|{m}`"), 6).alias(f"corr_{m}")
                       for m in ("avg_risk", "avg_claim", "fraud_rate")])
            for t in traits
        ]
    )
    return out.select(F.explode(rows).alias("r")).select("r.*")


def q_high_risk_brokers(portfolio: DataFrame, n: int = 10) -> DataFrame:
    """Item 117: brokers with most high-risk policies, and their satisfaction."""
    return (
        portfolio.where(semantic_filter())
        .groupBy("broker_id")
        .agg(count_rows().alias("high_risk_policies"),
             F.max("broker_satisfaction").alias("broker_satisfaction"),
             F.max("broker_tier").alias("broker_tier"))
        .orderBy(F.col("high_risk_policies").desc(), "broker_id")
        .limit(n)
    )


def _ratio_by(portfolio: DataFrame, key: str) -> DataFrame:
    return portfolio.groupBy(key).agg(
        claim_to_premium().alias("claim_to_premium_ratio"), count_rows().alias("policies")
    )


def q_ratio_by_tier(portfolio: DataFrame) -> DataFrame:
    """Item 118: the most efficient tier comes first."""
    return _ratio_by(portfolio, "broker_tier").orderBy(
        F.col("claim_to_premium_ratio").asc_nulls_last(), "broker_tier"
    )


def q_ratio_by_tier_high_risk(portfolio: DataFrame) -> DataFrame:
    """Item 119."""
    return q_ratio_by_tier(portfolio.where(semantic_filter()))


def q_top_satisfaction_ratio(portfolio: DataFrame) -> DataFrame:
    """Item 120: brokers of the highest satisfaction that manage high-risk policies."""
    per_broker = portfolio.where(semantic_filter()).groupBy("broker_id").agg(
        F.max("broker_satisfaction").alias("broker_satisfaction"),
        claim_to_premium().alias("claim_to_premium_ratio"),
        count_rows().alias("policies"),
    )
    best = per_broker.agg(F.max("broker_satisfaction")).scalar()
    return per_broker.where(F.col("broker_satisfaction") == best).orderBy(
        F.col("claim_to_premium_ratio").asc_nulls_last(), "broker_id"
    )


def q_worst_regions(portfolio: DataFrame) -> DataFrame:
    """Item 121."""
    return _ratio_by(portfolio.where(semantic_filter()), "customer_region").orderBy(
        F.col("claim_to_premium_ratio").desc_nulls_last(), "customer_region"
    )
