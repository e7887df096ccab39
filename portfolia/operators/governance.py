"""Column masks, the row filter, the governed view and column classification (items 98-103).

Policies are functions on DataFrames: they protect callers that read through
:func:`governed_view`, not callers that read the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class AccessContext:
    role: str
    account: str = ""


# The roles, the account mark and the brokers the policies name.
ADMIN_ROLES = ("ACCOUNTADMIN",)
ANALYST_ROLES = ("WORKSHOP_ANALYST",)
CONSUMER_ACCOUNT_MARK = "DATASHARING_CONSUMER"
ISOLATED_BROKERS = ("BRK001", "BRK002", "BRK003")
#: Fixed value: step to which masked amounts are floored.
MASK_STEP = 10_000


def mask_financial(ctx: AccessContext, value: Column) -> Column:
    """Item 98: the amount for administrators, otherwise floored to the step.

    The role is known when the plan is built, so no role test is left in it.
    """
    if ctx.role in ADMIN_ROLES:
        return value
    return (F.floor(value / MASK_STEP) * MASK_STEP).cast("double")


def mask_performance(ctx: AccessContext, value: Column) -> Column:
    """Item 99: the analysis as JSON; its shape depends on the role."""
    if ctx.role in ADMIN_ROLES:
        return F.to_json(value)
    if ctx.role in ANALYST_ROLES:
        return F.to_json(
            F.struct(
                value["performance_tier"].alias("performance_tier"),
                F.lit("external_view").alias("access_level"),
            )
        )
    return F.to_json(F.struct(F.lit(True).alias("masked"), F.lit("restricted").alias("access_level")))


def isolate_brokers(ctx: AccessContext, broker_id: Column) -> Column:
    """Item 100: analysts and consumer accounts see three brokers, every other role all."""
    if ctx.role in ADMIN_ROLES:
        return F.lit(True)
    if ctx.role in ANALYST_ROLES or CONSUMER_ACCOUNT_MARK in ctx.account:
        return broker_id.isin(*ISOLATED_BROKERS)
    return F.lit(True)


Mask = Callable[[AccessContext, Column], Column]
RowPolicy = Callable[[AccessContext, Column], Column]


@dataclass(frozen=True)
class PolicySet:
    """Item 102: masks per column and row filters per column; changes give a new set."""

    masks: dict[str, Mask] = field(default_factory=dict)
    row_filters: dict[str, RowPolicy] = field(default_factory=dict)

    def with_mask(self, column: str, mask: Mask) -> PolicySet:
        if column in self.masks:
            raise ValueError(f"column {column} already has a mask; detach it first")
        return replace(self, masks={**self.masks, column: mask})

    def without_mask(self, column: str) -> PolicySet:
        return replace(self, masks={c: m for c, m in self.masks.items() if c != column})

    def with_row_filter(self, column: str, policy: RowPolicy) -> PolicySet:
        return replace(self, row_filters={**self.row_filters, column: policy})

    def without_row_filter(self, column: str) -> PolicySet:
        return replace(self, row_filters={c: p for c, p in self.row_filters.items() if c != column})

    def apply(self, df: DataFrame, ctx: AccessContext) -> DataFrame:
        """Row filters first: they see the unmasked values."""
        missing = (set(self.masks) | set(self.row_filters)) - set(df.columns)
        if missing:
            raise ValueError(f"policies name columns the table lacks: {sorted(missing)}")
        for column, policy in self.row_filters.items():
            df = df.where(policy(ctx, F.col(column)))
        return df.withColumns({c: m(ctx, F.col(c)) for c, m in self.masks.items()})


BROKER_POLICIES = (
    PolicySet()
    .with_mask("total_premium_volume", mask_financial)
    .with_mask("avg_customer_premium", mask_financial)
    .with_mask("broker_performance_analysis", mask_performance)
    .with_row_filter("broker_id", isolate_brokers)
)


def row_policy(df: DataFrame, ctx: AccessContext, column: str = "broker_id") -> DataFrame:
    return df.where(isolate_brokers(ctx, F.col(column)))


def governed_view(
    matrix: DataFrame,
    ctx: AccessContext,
    policies: PolicySet = BROKER_POLICIES,
    accessed_at: str | None = None,
) -> DataFrame:
    """Item 101: row filter, masks, active brokers, and the time of access."""
    at = F.lit(accessed_at).cast("timestamp") if accessed_at else F.current_timestamp()
    return policies.apply(matrix.where(F.col("broker_active")), ctx).withColumn("data_access_time", at)


# Category, its name hints, and the pattern a whole value must match.
CATEGORIES = [
    ("EMAIL", ("email", "mail"), r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$"),
    ("NAME", ("first_name", "last_name"), r"^[A-Z][A-Za-z' -]+$"),
    ("GENDER", ("sex", "gender"), r"^(M|F|m|f|male|female|Male|Female)$"),
    ("AGE", ("age",), r"^[0-9]{1,3}$"),
    ("OCCUPATION", ("occupation",), r"^[A-Za-z -]+$"),
    ("POLICY_ID", ("policy_number",), r"^[0-9]{6,}$"),
]
#: Patterns that many harmless values match too; these need a name hint.
AMBIGUOUS = ("NAME", "AGE", "OCCUPATION")
MIN_MATCH_RATE = 0.8


def classify_columns(df: DataFrame, table: str, min_rate: float = MIN_MATCH_RATE) -> DataFrame:
    """Item 103: sensitive columns, found by the share of matching values and by name hint.

    Every string or numeric column is tested for every category, ``AMBIGUOUS`` ones only where the name hints at
    them. A column is reported for the categories that its name hints at, whatever the rate, and for the others
    that its values reach ``min_rate`` of. The whole table is scanned, in one aggregation for all of them.
    """
    simple = (T.StringType, T.NumericType)
    checks = []
    for f in df.schema:
        if not isinstance(f.dataType, simple):
            continue
        for category, hints, pattern in CATEGORIES:
            hinted = any(f.name == h or f.name.endswith(f"_{h}") for h in hints)
            if hinted or category not in AMBIGUOUS:
                checks.append((f.name, category, pattern, hinted))
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "column_name string, category string, n_values long, n_matching long, table_name string, "
                "match_rate double, sensitive boolean")
    aggs = []
    for i, (column, _, pattern, _) in enumerate(checks):
        value = F.col("`" + column.replace("`", "``") + "`")
        text = value.cast("string")
        aggs += [F.count(value).alias(f"n{i}"), F.count_if(text.rlike(pattern)).alias(f"k{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("category"),
                     F.col(f"n{i}").alias("n_values"), F.col(f"k{i}").alias("n_matching"),
                     F.lit(hinted).alias("_hinted"))
            for i, (c, k, _, hinted) in enumerate(checks)
        ]
    )
    rate = F.try_divide(F.col("n_matching").cast("double"), F.col("n_values"))
    return (
        df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
        .withColumns({"table_name": F.lit(table),
                      "match_rate": F.round(rate.cast("decimal(18,6)"), 4).cast("double"),
                      "sensitive": F.coalesce(rate >= min_rate, F.lit(False))})
        .where(F.col("_hinted") | F.col("sensitive")).drop("_hinted")
    )


def tag_columns(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Record categories as column metadata, which travels with the schema."""
    return df.select(
        *[F.col(c).alias(c, metadata={"category": tags[c]}) if c in tags else F.col(c) for c in df.columns]
    )
