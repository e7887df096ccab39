"""Risk and broker scoring as native column expressions (items 15-18, 86-88)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from portfolia.schemas import BROKER_ANALYSIS

# Office word -> region, first match wins.
REGIONS = [
    ("London", "London Region"),
    ("Manchester", "Manchester Region"),
    ("Birmingham", "Birmingham Region"),
    ("Leeds", "Northern Region"),
]
OTHER_REGION = "Other Region"

# Segment and the premium it starts above.
SEGMENTS = [("PREMIUM", 2500), ("STANDARD", 1500)]
LOWEST_SEGMENT = "BASIC"

# Age below, claim limit, points above the limit, points otherwise.
AGE_BANDS = [(25, 50000, 85, 65), (35, 75000, 70, 45), (55, 100000, 55, 25), (None, 50000, 40, 20)]
UNKNOWN_AGE_POINTS = 50
# Premium above, extra points.
PREMIUM_POINTS = [(2000, 10), (1500, 5)]

# Level and the score it starts at.
RISK_LEVELS = [("HIGH", 75), ("MEDIUM", 50)]
LOWEST_LEVEL = "LOW"

# Tier, least satisfaction, experience and training.
BROKER_TIERS = [("PLATINUM", 4.8, 10, 40), ("GOLD", 4.5, 5, 30), ("SILVER", 4.2, 3, 20)]
LOWEST_TIER = "BRONZE"

LEVEL_NAMES = [*(name for name, _ in RISK_LEVELS), LOWEST_LEVEL]
TIER_NAMES = [*(name for name, *_ in BROKER_TIERS), LOWEST_TIER]

# Performance tier and the total it starts at.
PERFORMANCE_TIERS = [("ELITE", 250), ("SUPERIOR", 200), ("PROFICIENT", 150)]
LOWEST_PERFORMANCE = "DEVELOPING"

ANALYSIS_COMPONENTS = [f.name for f in BROKER_ANALYSIS if f.name.endswith("_component")]


def _ladder(steps: list[tuple[Column, object]], otherwise: object) -> Column:
    """First condition that holds decides."""
    out = None
    for cond, value in steps:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def region_of(office: Column) -> Column:
    """Item 15."""
    return _ladder([(office.contains(word), region) for word, region in REGIONS], OTHER_REGION)


def segment_of(premium: Column) -> Column:
    """Item 16."""
    return _ladder([(premium > limit, name) for name, limit in SEGMENTS], LOWEST_SEGMENT)


def risk_level_of(score: Column) -> Column:
    """Item 17."""
    return _ladder([(score >= limit, name) for name, limit in RISK_LEVELS], LOWEST_LEVEL)


def risk_score(age: Column, premium: Column, claim: Column) -> Column:
    """Item 86: points by age and claim, plus points for a high premium.

    A NULL claim or premium never exceeds a limit, so it takes the lower branch.
    """
    steps: list[tuple[Column, object]] = [(age.isNull(), UNKNOWN_AGE_POINTS)]
    for below, limit, above_points, other_points in AGE_BANDS:
        points = F.when(claim > limit, above_points).otherwise(other_points)
        steps.append((F.lit(True) if below is None else age < below, points))
    return _ladder(steps, None) + _ladder([(premium > p, pts) for p, pts in PREMIUM_POINTS], 0)


def claim_band(claim: Column) -> Column:
    """How many of the score's claim limits are exceeded.

    Two claims in one band give the same score for any policy, which is what
    allows claims to be summed per policy and band before the join.
    """
    limits = sorted({limit for _, limit, _, _ in AGE_BANDS})
    return sum((F.coalesce((claim > x).cast("int"), F.lit(0)) for x in limits[1:]),
               F.coalesce((claim > limits[0]).cast("int"), F.lit(0)))


def band_floor(band: Column) -> Column:
    """A claim amount that lies inside the band, to feed :func:`risk_score`."""
    limits = sorted({limit for _, limit, _, _ in AGE_BANDS})
    return F.element_at(F.array(F.lit(0), *[F.lit(x + 1) for x in limits]), band + 1)


def broker_tier(satisfaction: Column, experience: Column, training: Column) -> Column:
    """Item 87."""
    return _ladder(
        [
            ((satisfaction >= s) & (experience >= e) & (training >= t), name)
            for name, s, e, t in BROKER_TIERS
        ],
        LOWEST_TIER,
    )


def broker_performance(
    satisfaction: Column,
    experience: Column,
    training: Column,
    customers: Column,
    avg_claim: Column,
    exact: bool = False,
) -> Column:
    """Item 88: five capped components, their total and a tier, as a struct.

    The native path rounds half-even on the decimal digits. ``exact=True`` rounds
    the binary value as Python does, in an Arrow batch function; the two differ
    by 0.1 at most, on near-ties.
    """
    args = [F.coalesce(c.cast("double"), F.lit(0.0))
            for c in (satisfaction, experience, training, customers, avg_claim)]
    if exact:
        return _performance_batches(*args)
    sat, exp, trn, cust, claim = args
    parts = {
        "satisfaction_component": F.least(sat * 20, F.lit(100.0)),
        "experience_component": F.least(exp * 8, F.lit(80.0)),
        "training_component": F.least(trn * 2, F.lit(60.0)),
        "portfolio_component": F.when(cust > 0, F.least(F.ln(cust) * 15, F.lit(50.0))).otherwise(0.0),
        "risk_management_component": F.when(
            claim > 0, F.greatest(F.lit(50.0) - claim / 2000, F.lit(0.0))
        ).otherwise(0.0),
    }
    total = sum(list(parts.values())[1:], parts["satisfaction_component"])
    tier = _ladder([(total >= x, n) for n, x in PERFORMANCE_TIERS], LOWEST_PERFORMANCE)
    return F.struct(
        F.bround(total, 1).alias("total_score"),
        tier.alias("performance_tier"),
        *[F.bround(c, 1).alias(n) for n, c in parts.items()],
    )


@F.pandas_udf(BROKER_ANALYSIS)
def _performance_batches(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.DataFrame]:
    for sat, exp, trn, cust, claim in batches:
        parts = pd.DataFrame(
            {
                "satisfaction_component": (sat * 20).clip(upper=100),
                "experience_component": (exp * 8).clip(upper=80),
                "training_component": (trn * 2).clip(upper=60),
                "portfolio_component": cust.map(lambda n: min(math.log(n) * 15, 50) if n > 0 else 0.0),
                "risk_management_component": (50 - claim / 2000).clip(lower=0).where(claim > 0, 0.0),
            }
        )
        total = parts.sum(axis=1)
        tier = pd.Series(LOWEST_PERFORMANCE, index=total.index)
        for name, limit in reversed(PERFORMANCE_TIERS):
            tier = tier.mask(total >= limit, name)
        out = parts.map(lambda v: round(v, 1))
        out.insert(0, "total_score", total.map(lambda v: round(v, 1)))
        out.insert(1, "performance_tier", tier)
        yield out


def register_sql_functions(spark) -> None:
    """Items 86 to 88 for SQL callers, as temporary SQL functions."""
    ages = " ".join(
        f"WHEN {'TRUE' if below is None else f'age < {below}'} THEN IF(claim > {limit}, {hi}, {lo})"
        for below, limit, hi, lo in AGE_BANDS
    )
    extra = " ".join(f"WHEN premium > {p} THEN {pts}" for p, pts in PREMIUM_POINTS)
    tiers = " ".join(
        f"WHEN satisfaction >= {s} AND experience >= {e} AND training >= {t} THEN '{n}'"
        for n, s, e, t in BROKER_TIERS
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION risk_score(age BIGINT, premium DECIMAL(10,2), claim BIGINT)"
        f" RETURNS INT RETURN CASE WHEN age IS NULL THEN {UNKNOWN_AGE_POINTS} {ages} END"
        f" + CASE {extra} ELSE 0 END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION broker_tier(satisfaction DOUBLE, experience BIGINT,"
        f" training BIGINT) RETURNS STRING RETURN CASE {tiers} ELSE '{LOWEST_TIER}' END"
    )
    parts = {
        "satisfaction_component": "least(coalesce(satisfaction, 0) * 20, 100D)",
        "experience_component": "least(coalesce(experience, 0) * 8D, 80D)",
        "training_component": "least(coalesce(training, 0) * 2D, 60D)",
        "portfolio_component": "IF(customers > 0, least(ln(customers) * 15, 50D), 0D)",
        "risk_management_component": "IF(avg_claim > 0, greatest(50 - avg_claim / 2000, 0D), 0D)",
    }
    total = " + ".join(parts.values())
    ranks = " ".join(f"WHEN {total} >= {limit} THEN '{name}'" for name, limit in PERFORMANCE_TIERS)
    fields = ", ".join(f"'{name}', bround({part}, 1)" for name, part in parts.items())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION broker_performance(satisfaction DOUBLE, experience BIGINT,"
        " training BIGINT, customers BIGINT, avg_claim DOUBLE) RETURNS STRUCT<total_score: DOUBLE,"
        f" performance_tier: STRING, {', '.join(f'{name}: DOUBLE' for name in parts)}>"
        f" RETURN named_struct('total_score', bround({total}, 1), 'performance_tier',"
        f" CASE {ranks} ELSE '{LOWEST_PERFORMANCE}' END, {fields})"
    )
