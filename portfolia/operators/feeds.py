"""Aggregate feeds and display numbers over the portfolio (items 14, 53-68, 74-79).

Every function takes the summed portfolio of ``integrate.scored_portfolio`` unless it
says otherwise; ``weight`` is the number of level-2 rows behind a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from portfolia.functions import risk
from portfolia.operators.integrate import mean, round_half_up
from portfolia.operators.skew import exact_quantiles
from portfolia.session import scratch_dir


def weight() -> Column:
    return F.col("weight")


def count_rows(cond: Column | None = None) -> Column:
    """Level-2 rows, or those that meet a condition."""
    rows = F.sum("weight" if cond is None else F.when(cond, weight()))
    return F.coalesce(rows, F.lit(0).cast("long"))


def level_count(level: str) -> Column:
    return count_rows(F.col("final_risk_level") == level)


def project_dashboard(dashboard: DataFrame) -> DataFrame:
    """Item 14: the 17 columns the risk screen reads, from level 2."""
    return dashboard.where(F.col("broker_id").isNotNull()).select(
        "policy_number", "age", "customer_segment", "customer_risk_score", "policy_annual_premium",
        "claim_amount_filled", "customer_region", "broker_id", "broker_tier",
        "broker_customer_count", "broker_avg_claim", "final_risk_level",
        "broker_performance_analysis", "insured_sex", "insured_occupation", "has_claim",
        "fraud_reported_filled",
    )


def risk_profiles(portfolio: DataFrame) -> DataFrame:
    """Item 53."""
    return portfolio.groupBy("customer_segment", "customer_region").agg(
        count_rows().alias("customer_count"),
        mean(F.col("customer_risk_score"), weight()).alias("avg_risk_score"),
        mean(F.col("policy_annual_premium"), weight()).alias("avg_premium"),
        level_count("HIGH").alias("high_risk_count"),
        level_count("MEDIUM").alias("medium_risk_count"),
        level_count("LOW").alias("low_risk_count"),
        F.sum("claim_total").alias("total_claims"),
    )


def broker_correlation(portfolio: DataFrame, stats: DataFrame) -> DataFrame:
    """Item 54. Tier, count, average and analysis are constant per broker, so brokers group alone."""
    per_broker = portfolio.groupBy("broker_id", "broker_tier").agg(
        count_rows().alias("managed_customers"),
        mean(F.col("customer_risk_score"), weight()).alias("portfolio_risk_score"),
        level_count("HIGH").alias("high_risk_customers"),
        mean(F.col("policy_annual_premium"), weight()).alias("avg_portfolio_premium"),
        F.sum("claim_total").alias("total_portfolio_claims"),
        F.max("customer_region").alias("primary_region"),
        *[F.max(c).alias(c) for c in BROKER_TRAITS],
    )
    return with_analysis(per_broker.join(stats, "broker_id")).drop(*BROKER_TRAITS)


BROKER_TRAITS = ["broker_satisfaction", "broker_experience", "broker_training"]


def with_analysis(rows: DataFrame) -> DataFrame:
    """Rows that carry a broker's traits, count and average, with its performance analysis."""
    columns = [F.col(c) for c in (*BROKER_TRAITS, "broker_customer_count", "broker_avg_claim")]
    return rows.withColumn("broker_performance_analysis", risk.broker_performance(*columns))


def geographic_risk(portfolio: DataFrame) -> DataFrame:
    """Item 55."""
    avg_risk = mean(F.col("customer_risk_score"), weight())
    return (
        portfolio.groupBy("customer_region")
        .agg(
            count_rows().alias("total_customers"),
            avg_risk.alias("region_avg_risk"),
            level_count("HIGH").alias("high_risk_count"),
            F.countDistinct("broker_id").alias("active_brokers"),
            mean(F.col("policy_annual_premium"), weight()).alias("region_avg_premium"),
            F.sum("claim_total").alias("region_total_claims"),
            round_half_up(avg_risk, 1).alias("risk_score_rounded"),
        )
        .orderBy(F.col("region_avg_risk").desc_nulls_last(), "customer_region")
    )


def portfolio_kpis(portfolio: DataFrame) -> DataFrame:
    """Item 56."""
    return portfolio.agg(
        count_rows().alias("total_customers"),
        level_count("HIGH").alias("high_risk_count"),
        mean(F.col("customer_risk_score"), weight()).alias("avg_risk_score"),
        F.sum("claim_total").alias("total_exposure"),
    ).withColumn(
        "high_risk_pct",
        round_half_up(F.try_divide(F.col("high_risk_count") * F.lit(100.0), F.col("total_customers")), 1),
    )


def value_counts(portfolio: DataFrame, *columns: str) -> DataFrame:
    """Item 57: rows per value of each column, in one pass, most frequent first."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    combos = portfolio.groupBy(*columns).agg(F.sum("weight").alias("weight"))
    return (
        combos.select(F.explode(pairs).alias("p"), "weight")
        .groupBy("p.column_name", "p.value")
        .agg(F.sum("weight").alias("n"))
        .orderBy("column_name", F.col("n").desc(), "value")
    )


def segment_rollup(profiles: DataFrame) -> DataFrame:
    """Item 58: an unweighted mean of the region averages, hence its name."""
    return profiles.groupBy("customer_segment").agg(
        F.sum("customer_count").alias("customer_count"),
        round_half_up(F.avg("avg_risk_score"), 4).alias("mean_of_region_avg"),
        F.sum("high_risk_count").alias("high_risk_count"),
    )


def pivot_mean(df: DataFrame, index: str, columns: str, values: str, names: Sequence[str],
               weight: str | None = None, fill: float | None = None) -> DataFrame:
    """Items 59 and 60: mean of ``values`` per index and column.

    The column names are given, so no extra job lists them and the schema is stable.
    """
    w = F.col(weight) if weight else None
    out = df.groupBy(index).agg(
        *[
            mean(F.when(F.col(columns) == n, F.col(values)),
                 None if w is None else F.when(F.col(columns) == n, w)).alias(n.lower())
            for n in names
        ]
    )
    return out if fill is None else out.na.fill(fill)


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Item 61: Pearson correlation of each pair, in one pass, as (x, y, corr).

    Pairs in which either value is NULL are left out pair by pair.
    """
    pairs = [(a, b) for a in columns for b in columns]
    cells = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs if a < b])
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("x"), F.lit(b).alias("y"),
                (F.lit(1.0) if a == b else F.col(f"`{min(a, b)}|{max(a, b)}`")).alias("r"),
            )
            for a, b in pairs
        ]
    )
    return cells.select(F.explode(rows).alias("c")).select(
        "c.x", "c.y", round_half_up(F.col("c.r"), digits).alias("corr")
    )


def component_means(matrix: DataFrame, components: Sequence[str]) -> DataFrame:
    """Item 62: mean of each analysis component over the brokers."""
    a = "broker_performance_analysis"
    return matrix.agg(
        *[mean(F.col(f"{a}.{c}").cast("decimal(12,1)")).alias(c) for c in components]
    )


def box_stats(df: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """Item 63: quartiles, range and 1.5 x IQR fences per group, exact."""
    q = exact_quantiles(df, group, value, [0.0, 0.25, 0.5, 0.75, 1.0], weight)

    def at(p: float) -> Column:
        return F.max(F.when(F.col("prob") == p, F.col("quantile")))

    wide = q.groupBy(group, "n").agg(
        at(0.0).alias("min"), at(0.25).alias("q1"), at(0.5).alias("median"),
        at(0.75).alias("q3"), at(1.0).alias("max"),
    )
    step = 1.5 * (F.col("q3") - F.col("q1"))
    return wide.withColumns(
        {"lower_fence": F.greatest(F.col("min"), F.col("q1") - step),
         "upper_fence": F.least(F.col("max"), F.col("q3") + step)}
    )


def histogram_bins(df: DataFrame, value: str, group: str, max_bins: int = 20,
                   weight: str = "weight") -> DataFrame:
    """Item 64: equal-width bins over the value's range; bins = min(max_bins, distinct values)."""
    # Counts per value come first and are written once: the range and the bins are read from these few rows.
    path = scratch_dir(df.sparkSession, "histogram")
    df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum(weight).alias("n")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    stats = counts.agg(
        F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"),
        F.least(F.lit(max_bins), F.countDistinct(value)).cast("int").alias("bins"),
    )
    counts = counts.withColumn("s", stats.select(F.struct("lo", "hi", "bins").alias("s")).scalar())
    width = (F.col("s.hi") - F.col("s.lo")) / F.col("s.bins")
    raw = F.floor((F.col(value).cast("double") - F.col("s.lo")) / width)
    bin_no = F.when(width > 0, F.least(raw, F.col("s.bins") - 1)).otherwise(0).cast("int")
    return (
        counts.withColumns({"bin": bin_no, "width": width, "lo": F.col("s.lo")})
        .groupBy(group, "bin", "width", "lo").agg(F.sum("n").alias("n"))
        .select(
            group, "bin", "n",
            round_half_up(F.col("lo") + F.col("bin") * F.col("width"), 4).alias("bin_start"),
            round_half_up(F.col("lo") + (F.col("bin") + 1) * F.col("width"), 4).alias("bin_end"),
        )
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_summary(df: DataFrame) -> DataFrame:
    """Item 65: rows, columns, and sum and mean of the first numeric column."""
    numeric = numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count")]
    if numeric:
        c = F.col(numeric[0])
        aggs += [
            F.lit(numeric[0]).alias("first_numeric"),
            F.sum(c).cast("double").alias("total"),
            mean(c).alias("average"),
        ]
    return df.agg(*aggs)


def _column_kinds(df: DataFrame) -> dict[str, str]:
    kinds = {}
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[f.name] = "datetime"
        else:
            kinds[f.name] = "categorical"
    return kinds


def profile_columns(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Item 66: kind, distinct values and NULLs of each column, and the summary that suits the table.

    Counts are exact, from one pass in which every value is a row once per task; ``counts`` (column_name, n_distinct,
    n_null), as :func:`profile_counts` makes them from sketches, take their place where a pass is too dear.
    """
    kinds = _column_kinds(df)
    n = {k: [c for c, kind in kinds.items() if kind == k] for k in ("numeric", "datetime", "categorical")}
    if n["numeric"] and n["datetime"]:
        advice = "line"
    elif n["numeric"] and n["categorical"]:
        advice = "bar"
    elif len(n["numeric"]) >= 2:
        advice = "scatter"
    else:
        advice = "histogram" if n["numeric"] else "bar"
    x = (n["datetime"] or n["categorical"] or df.columns)[0]
    y = n["numeric"][0] if n["numeric"] else None
    if counts is None:
        cells = df.select(F.inline(F.array(*[F.struct(
            F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in kinds])))
        counts = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column_name").agg(
            F.count("value").alias("n_distinct"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    facts = df.sparkSession.createDataFrame(
        [(i, c, kind, "x" if c == x else "y" if c == y else None, advice) for i, (c, kind) in enumerate(kinds.items())],
        "ordinal int, column_name string, kind string, axis string, recommended string")
    zero = F.lit(0).cast("long")
    return facts.join(counts, "column_name", "left").select(
        "ordinal", "column_name", "kind", F.coalesce("n_distinct", zero).alias("n_distinct"),
        F.coalesce("n_null", zero).alias("n_null"), "axis", "recommended")


def profile_sketches(df: DataFrame, log_size: int = 14) -> DataFrame:
    """Item 66 as stored state: rows, NULLs and a sketch of the distinct values of each column.

    Sketches of batches are merged by :func:`merge_profiles`, so a profile follows new rows without reading old ones.
    """
    kinds = _column_kinds(df)
    text = {c: F.col(f"`{c}`").cast("string") for c in kinds}
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(t).alias(f"n{i}") for i, t in enumerate(text.values())],
                  *[F.hll_sketch_agg(t, log_size).alias(f"s{i}") for i, t in enumerate(text.values())])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"n{i}")).alias("n_null"),
        F.col(f"s{i}").alias("sketch")) for i, c in enumerate(kinds)])))


def merge_profiles(*parts: DataFrame) -> DataFrame:
    """The sketches of all parts' rows together, one row per column."""
    return union_all_branches(*parts).groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("sketch").alias("sketch"))


def profile_counts(sketches: DataFrame) -> DataFrame:
    """column_name, n_distinct (estimated) and n_null of stored sketches."""
    return sketches.select("column_name", F.hll_sketch_estimate("sketch").alias("n_distinct"), "n_null")


def analytics_summary(portfolio: DataFrame) -> DataFrame:
    """Item 67."""
    return portfolio.agg(
        F.countDistinct(F.coalesce(F.col("customer_region"), F.lit(""))).alias("regions_analyzed"),
        F.countDistinct("broker_id").alias("brokers_analyzed"),
        F.countDistinct("customer_segment").alias("customer_segments"),
        F.countDistinct(F.when(F.col("broker_tier").isNotNull(), F.col("broker_id"))).alias(
            "analysed_brokers"
        ),
    )


def segment_risk(portfolio: DataFrame) -> DataFrame:
    """Item 68, over any version of the portfolio."""
    return (
        portfolio.groupBy("customer_segment")
        .agg(count_rows().alias("customer_count"),
             mean(F.col("customer_risk_score"), weight()).alias("avg_risk_score"))
        .orderBy(F.col("avg_risk_score").desc_nulls_last(), "customer_segment")
    )


def top_n_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Item 74: the order is given, so the rows are the same on every run."""
    return df.orderBy(*order).limit(n)


def largest_groups(df: DataFrame, group: str, text: str, n: int = 1) -> DataFrame:
    """Item 78: the groups whose texts take most bytes."""
    return df.groupBy(group).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("n_bytes")).orderBy(
        F.col("n_bytes").desc(), group).limit(n)


def top_brokers(matrix: DataFrame, n: int = 10) -> DataFrame:
    """Item 75."""
    a = "broker_performance_analysis"
    return (
        matrix.select(
            "broker_id",
            F.concat_ws(" ", "broker_first_name", "broker_last_name").alias("broker_name"),
            F.col(f"{a}.performance_tier").alias("performance_tier"),
            F.col(f"{a}.total_score").alias("total_score"),
            "total_customers",
        )
        .orderBy(F.col("total_score").desc_nulls_last(), "broker_id")
        .limit(n)
    )


def matrix_by_volume(matrix: DataFrame) -> DataFrame:
    """Item 76."""
    return matrix.where(F.col("broker_active")).orderBy(
        F.col("total_premium_volume").desc_nulls_last(), "broker_id"
    )


#: Fixed value: most rows an ad-hoc statement returns.
MAX_ROWS = 1000


def bounded_sql(spark: SparkSession, statement: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Item 77: run one statement and return at most ``max_rows`` rows."""
    return spark.sql(statement.strip().removesuffix(";")).limit(max_rows)


def union_all_branches(*branches: DataFrame) -> DataFrame:
    """Item 79: union by name; a column a branch lacks is NULL there."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def entity_counts(policies: DataFrame, claims: DataFrame, brokers: DataFrame) -> DataFrame:
    """Item 37. The broker branch reports its distinct ids as policies, as specified."""
    def branch(df: DataFrame, entity: str, key: str, broker: str | None) -> DataFrame:
        aggs = [F.lit(entity).alias("entity"), F.count(F.lit(1)).alias("total_records"),
                F.countDistinct(key).alias("unique_policies")]
        return df.agg(*aggs, *([F.countDistinct(broker).alias("unique_brokers")] if broker else []))

    return union_all_branches(
        branch(policies, "CUSTOMERS", "policy_number", "broker_id"),
        branch(claims, "CLAIMS", "policy_number", None),
        branch(brokers, "BROKERS", "broker_id", None),
    )


def entity_summary(portfolio: DataFrame, now: str) -> DataFrame:
    """Item 69, over level 2: three summaries of distinct counts with a given time, from one aggregate."""
    kinds = {
        "CUSTOMERS": (F.col("customer_region"), F.col("broker_id")),
        "CLAIMS": (F.when(F.col("claim_total") > 0, 1), F.col("policy_number")),
        "BROKERS": (F.col("broker_office"), F.col("broker_tier")),
    }
    counted = [F.countDistinct(c).alias(f"{kind}_{i}") for kind, pair in kinds.items() for i, c in enumerate(pair)]
    at = F.lit(now).cast("timestamp").alias("cleanup_time")
    rows = F.array(*[F.struct(F.lit(k).alias("entity"), F.col("n").alias("record_count"), F.col(f"{k}_0").alias("regions"),
                              F.col(f"{k}_1").alias("brokers")) for k in kinds])
    return portfolio.agg(count_rows().alias("n"), *counted).select(F.inline(rows), at)
