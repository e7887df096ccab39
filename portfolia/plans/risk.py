"""Risk chain and display aggregates (items 14-18, 52-67, 70, 74-76, 86-88, 91)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from portfolia import bindings as b
from portfolia.functions import risk
from portfolia.operators import feeds, integrate
from portfolia.plans.registry import query, sql

ANALYSIS = "broker_performance_analysis"


def portfolio(spark: SparkSession, d: str) -> DataFrame:
    return integrate.scored_portfolio(b.policies(spark, d), b.brokers(spark, d), b.claims(spark, d))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return integrate.broker_window_stats(b.policies(spark, d), b.claims(spark, d))


def dashboard(spark: SparkSession, d: str, **kw) -> DataFrame:
    return integrate.risk_dashboard(b.policies(spark, d), b.brokers(spark, d), b.claims(spark, d), **kw)


def matrix(spark: SparkSession, d: str, **kw) -> DataFrame:
    return integrate.matrix_from(b.policies(spark, d), b.brokers(spark, d), b.claims(spark, d), **kw)


ANALYSIS_FIELDS = ["total_score", "performance_tier", "satisfaction_component", "experience_component",
                   "training_component", "portfolio_component", "risk_management_component"]


def flat(df: DataFrame) -> DataFrame:
    """The analysis struct as columns, so that rows compare by value."""
    return df.select(*[c for c in df.columns if c != ANALYSIS], f"{ANALYSIS}.*")


PROFILES = """
SELECT customer_segment, customer_region, count(*) AS customer_count,
  CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS avg_risk_score,
  CAST(sum(policy_annual_premium) AS DOUBLE) / count(policy_annual_premium) AS avg_premium,
  count(*) FILTER (final_risk_level = 'HIGH') AS high_risk_count,
  count(*) FILTER (final_risk_level = 'MEDIUM') AS medium_risk_count,
  count(*) FILTER (final_risk_level = 'LOW') AS low_risk_count,
  CAST(sum(claim_amount_filled) AS BIGINT) AS total_claims
FROM scored GROUP BY 1, 2"""


@query("risk_profiles", sql(PROFILES, "scored"))
def _risk_profiles(spark, d):
    return feeds.risk_profiles(portfolio(spark, d))


@query("integrate_entities", sql(
    """SELECT policy_number, age, insured_sex, insured_education_level, insured_occupation,
  policy_start_date, policy_length_month, policy_deductable, policy_annual_premium, broker_id,
  broker_first_name, broker_last_name, broker_email, broker_office, broker_satisfaction,
  broker_experience, broker_training, broker_active, incident_date, incident_type, incident_severity,
  authorities_contacted, incident_hour_of_the_day, number_of_vehicles_involved, bodily_injuries,
  witnesses, police_report_available, claim_amount, fraud_reported, has_claim, claim_amount_filled,
  fraud_reported_filled,
  array_to_string(b2.specializations, '|') AS broker_specializations,
  array_to_string(b2.territory, '|') AS broker_territory
FROM l1 LEFT JOIN (SELECT broker_id AS bid, specializations, territory FROM brokers) b2 ON bid = broker_id""",
    "l1"))
def _integrate(spark, d):
    out = integrate.integrate_entities(b.policies(spark, d), b.brokers(spark, d), b.claims(spark, d))
    return out.withColumns({
        c: F.array_join(c, "|") for c in ("broker_specializations", "broker_territory")
    })


L2_ROWS = """
SELECT policy_number, age, insured_sex, insured_occupation, policy_annual_premium, policy_length_month,
  claim_amount_filled, fraud_reported_filled, has_claim, broker_id, broker_first_name,
  broker_last_name, broker_office, broker_satisfaction, broker_experience, broker_training,
  customer_region, customer_segment, broker_customer_count, broker_avg_claim, customer_risk_score,
  broker_tier, final_risk_level, total_score, performance_tier, satisfaction_component,
  experience_component, training_component, portfolio_component, risk_management_component
FROM l2 JOIN analysis USING (broker_id)"""


@query("risk_dashboard", sql(L2_ROWS, "l2", "analysis"))
def _risk_dashboard(spark, d):
    return flat(dashboard(spark, d))


@query("project_dashboard", sql(
    """SELECT policy_number, age, customer_segment, customer_risk_score, policy_annual_premium,
  claim_amount_filled, customer_region, broker_id, broker_tier, broker_customer_count,
  broker_avg_claim, final_risk_level, total_score, performance_tier, satisfaction_component,
  experience_component, training_component, portfolio_component, risk_management_component,
  insured_sex, insured_occupation, has_claim, fraud_reported_filled
FROM l2 JOIN analysis USING (broker_id)""", "l2", "analysis"))
def _project_dashboard(spark, d):
    return flat(feeds.project_dashboard(dashboard(spark, d)))


@query("region_case", sql(
    """SELECT broker_id, office_location, CASE office_location WHEN 'London' THEN 'London Region'
  WHEN 'Manchester' THEN 'Manchester Region' WHEN 'Birmingham' THEN 'Birmingham Region'
  WHEN 'Leeds' THEN 'Northern Region' ELSE 'Other Region' END AS customer_region FROM brokers""", "brokers"))
def _region(spark, d):
    return b.brokers(spark, d).select(
        "broker_id", "office_location", risk.region_of(F.col("office_location")).alias("customer_region"))


@query("segment_case", sql(
    """SELECT coalesce(s.name, 'BASIC') AS customer_segment, count(*) AS policies
FROM policies LEFT JOIN (VALUES ('PREMIUM', 2500, 1e12), ('STANDARD', 1500, 2500)) AS s(name, lo, hi)
  ON policy_annual_premium > s.lo AND policy_annual_premium <= s.hi GROUP BY 1""", "policies"))
def _segment(spark, d):
    return b.policies(spark, d).groupBy(
        risk.segment_of(F.col("policy_annual_premium")).alias("customer_segment")
    ).agg(F.count(F.lit(1)).alias("policies"))


@query("risk_level_case", sql(
    "SELECT customer_risk_score, final_risk_level, count(*) AS n FROM scored GROUP BY 1, 2", "scored"))
def _level(spark, d):
    return portfolio(spark, d).groupBy("customer_risk_score", "final_risk_level").agg(
        feeds.count_rows().alias("n"))


@query("has_claim_fill", sql(
    """SELECT has_claim, fraud_reported_filled, count(*) AS n, count(claim_amount) AS with_amount,
  CAST(sum(claim_amount_filled) AS BIGINT) AS total FROM l1 GROUP BY 1, 2""", "l1"))
def _has_claim(spark, d):
    l1 = integrate.integrate_entities(b.policies(spark, d), b.brokers(spark, d), b.claims(spark, d))
    return l1.groupBy("has_claim", "fraud_reported_filled").agg(
        F.count(F.lit(1)).alias("n"), F.count("claim_amount").alias("with_amount"),
        F.sum("claim_amount_filled").alias("total"))


@query("nested_extract", sql(
    """SELECT broker_id, CAST(floor(satisfaction + 0.5) AS BIGINT) AS broker_satisfaction,
  experience AS broker_experience, training AS broker_training FROM brokers""", "brokers"))
def _nested(spark, d):
    return integrate.nested_extract(b.brokers(spark, d)).select(
        "broker_id", "broker_satisfaction", "broker_experience", "broker_training")


@query("broker_window_stats", sql(
    "SELECT DISTINCT broker_id, broker_customer_count, broker_avg_claim FROM l2", "l2"))
def _window_stats(spark, d):
    return stats(spark, d)


@query("risk_score", sql(
    """SELECT c_custkey AS policy_row, coalesce(CASE WHEN p.claim > a.claim_limit THEN a.points_over
    ELSE a.points_else END, 50) + CASE WHEN premium > 2000 THEN 10 WHEN premium > 1500 THEN 5 ELSE 0 END
  AS customer_risk_score
FROM p LEFT JOIN age_points a ON age >= age_from AND age < age_to""",
    "age_points",
    p="""SELECT c_custkey, CASE WHEN c_custkey % 31 = 1 THEN NULL ELSE c_custkey * 37 % 100 END AS age,
  CAST(c_acctbal AS DECIMAL(10,2)) AS premium,
  CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE c_custkey * 7919 % 150000 END AS claim FROM customer"""))
def _risk_score(spark, d):
    rows = b.table(spark, d, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 31 = 1 THEN NULL ELSE c_custkey * 37 % 100 END AS age",
        "CAST(c_acctbal AS DECIMAL(10,2)) AS premium",
        "CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE c_custkey * 7919 % 150000 END AS claim")
    return rows.select(
        F.col("c_custkey").alias("policy_row"),
        risk.risk_score(F.col("age"), F.col("premium"), F.col("claim")).alias("customer_risk_score"))


@query("risk_score_sql_function", sql(
    "SELECT customer_risk_score, broker_tier, count(*) AS n FROM scored GROUP BY 1, 2", "scored"))
def _risk_score_sql(spark, d):
    risk.register_sql_functions(spark)
    rows = integrate.integrate_entities(b.policies(spark, d), b.brokers(spark, d), b.claims(spark, d))
    return rows.where("broker_id IS NOT NULL").groupBy(
        F.expr("risk_score(age, policy_annual_premium, claim_amount_filled)").alias("customer_risk_score"),
        F.expr("broker_tier(broker_satisfaction, broker_experience, broker_training)").alias("broker_tier"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("broker_performance_sql_function", sql("SELECT * FROM analysis", "analysis"))
def _performance_sql(spark, d):
    risk.register_sql_functions(spark)
    dim = integrate.nested_extract(b.brokers(spark, d))
    held = stats(spark, d).join(dim, "broker_id", "left")
    analysis = F.expr("broker_performance(broker_satisfaction, broker_experience, broker_training,"
                      " broker_customer_count, broker_avg_claim)")
    return flat(held.select("broker_id", analysis.alias(ANALYSIS)))


@query("broker_tier", sql(
    """SELECT broker_id, CASE WHEN satisfaction >= 4.8 AND experience >= 10 AND training >= 40 THEN 'PLATINUM'
  WHEN satisfaction >= 4.5 AND experience >= 5 AND training >= 30 THEN 'GOLD'
  WHEN satisfaction >= 4.2 AND experience >= 3 AND training >= 20 THEN 'SILVER' ELSE 'BRONZE' END
  AS broker_tier FROM brokers""", "brokers"))
def _tier(spark, d):
    dim = integrate.nested_extract(b.brokers(spark, d), round_satisfaction=False)
    return dim.select("broker_id", risk.broker_tier(
        F.col("broker_satisfaction"), F.col("broker_experience"), F.col("broker_training")
    ).alias("broker_tier"))


@query("broker_performance", sql("SELECT * FROM analysis", "analysis"))
def _performance(spark, d):
    return matrix(spark, d).select("broker_id", f"{ANALYSIS}.*")


@query("broker_performance_exact", sql("SELECT * FROM analysis", "analysis"))
def _performance_exact(spark, d):
    return matrix(spark, d, exact=True).select("broker_id", f"{ANALYSIS}.*")


@query("broker_matrix", sql("SELECT * FROM matrix JOIN analysis USING (broker_id)", "matrix", "analysis"))
def _matrix(spark, d):
    return flat(matrix(spark, d))


@query("broker_matrix_distinct", sql(
    """SELECT broker_id, count(DISTINCT policy_number) AS total_customers FROM scored GROUP BY 1""", "scored"))
def _matrix_distinct(spark, d):
    return matrix(spark, d, count_mode="distinct").select("broker_id", "total_customers")


@query("broker_correlation", sql(
    """SELECT broker_id, broker_tier, broker_customer_count, broker_avg_claim,
  count(*) AS managed_customers, CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS portfolio_risk_score,
  count(*) FILTER (final_risk_level = 'HIGH') AS high_risk_customers,
  CAST(sum(policy_annual_premium) AS DOUBLE) / count(policy_annual_premium) AS avg_portfolio_premium,
  CAST(sum(claim_amount_filled) AS BIGINT) AS total_portfolio_claims, max(customer_region) AS primary_region,
  any_value(a) AS a
FROM l2 JOIN analysis a USING (broker_id) GROUP BY 1, 2, 3, 4""".replace("any_value(a) AS a", ", ".join(
        f"any_value(a.{c}) AS {c}" for c in ANALYSIS_FIELDS)), "l2", "analysis"))
def _broker_correlation(spark, d):
    return flat(feeds.broker_correlation(portfolio(spark, d), stats(spark, d)))


@query("geographic_risk", sql(
    """SELECT customer_region, count(*) AS total_customers,
  CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS region_avg_risk,
  count(*) FILTER (final_risk_level = 'HIGH') AS high_risk_count,
  count(DISTINCT broker_id) AS active_brokers,
  CAST(sum(policy_annual_premium) AS DOUBLE) / count(policy_annual_premium) AS region_avg_premium,
  CAST(sum(claim_amount_filled) AS BIGINT) AS region_total_claims,
  CAST(round(CAST(CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS DECIMAL(18,6)), 1) AS DOUBLE)
    AS risk_score_rounded
FROM scored GROUP BY 1 ORDER BY region_avg_risk DESC, 1""", "scored"))
def _geographic(spark, d):
    return feeds.geographic_risk(portfolio(spark, d))


@query("portfolio_kpis", sql(
    """SELECT count(*) AS total_customers, count(*) FILTER (final_risk_level = 'HIGH') AS high_risk_count,
  CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS avg_risk_score,
  CAST(sum(claim_amount_filled) AS BIGINT) AS total_exposure,
  CAST(round(CAST(count(*) FILTER (final_risk_level = 'HIGH') * 100.0 / count(*) AS DECIMAL(18,6)), 1) AS DOUBLE)
    AS high_risk_pct
FROM scored""", "scored"))
def _kpis(spark, d):
    return feeds.portfolio_kpis(portfolio(spark, d))


@query("value_counts", sql(
    """SELECT 'final_risk_level' AS column_name, final_risk_level AS value, count(*) AS n FROM scored GROUP BY 2
UNION ALL SELECT 'broker_tier', broker_tier, count(*) FROM scored GROUP BY 2""", "scored"))
def _value_counts(spark, d):
    return feeds.value_counts(portfolio(spark, d), "final_risk_level", "broker_tier")


@query("segment_rollup", sql(
    """SELECT customer_segment, CAST(sum(customer_count) AS BIGINT) AS customer_count,
  CAST(round(CAST(avg(avg_risk_score) AS DECIMAL(18,6)), 4) AS DOUBLE) AS mean_of_region_avg,
  CAST(sum(high_risk_count) AS BIGINT) AS high_risk_count
FROM profiles GROUP BY 1""", "scored", profiles=PROFILES))
def _rollup(spark, d):
    return feeds.segment_rollup(feeds.risk_profiles(portfolio(spark, d)))


@query("region_segment_pivot", sql(
    """SELECT customer_region,
  coalesce(max(avg_risk_score) FILTER (customer_segment = 'BASIC'), 0) AS basic,
  coalesce(max(avg_risk_score) FILTER (customer_segment = 'STANDARD'), 0) AS standard,
  coalesce(max(avg_risk_score) FILTER (customer_segment = 'PREMIUM'), 0) AS premium
FROM profiles GROUP BY 1""", "scored", profiles=PROFILES))
def _pivot_segment(spark, d):
    return feeds.pivot_mean(portfolio(spark, d), "customer_region", "customer_segment",
                            "customer_risk_score", ["BASIC", "STANDARD", "PREMIUM"], "weight", fill=0.0)


@query("pivot_mean", sql(
    """SELECT broker_tier, CAST(sum(customer_risk_score) FILTER (insured_sex = 'M') AS DOUBLE)
    / count(*) FILTER (insured_sex = 'M') AS m,
  CAST(sum(customer_risk_score) FILTER (insured_sex = 'F') AS DOUBLE)
    / count(*) FILTER (insured_sex = 'F') AS f
FROM scored GROUP BY 1""", "scored"))
def _pivot(spark, d):
    return feeds.pivot_mean(portfolio(spark, d), "broker_tier", "insured_sex", "customer_risk_score",
                            ["M", "F"], "weight")


CORR_COLUMNS = ["age", "policy_annual_premium", "policy_length_month"]


def _corr_sql(x: str, y: str) -> str:
    if x == y:
        return f"SELECT '{x}' AS x, '{y}' AS y, CAST(1.0 AS DOUBLE) AS corr"
    r = f"corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))"
    return f"SELECT '{x}', '{y}', CAST(round(CAST({r} AS DECIMAL(18,6)), 6) AS DOUBLE) FROM policies"


@query("correlation_matrix", sql(
    "\nUNION ALL ".join(_corr_sql(x, y) for x in CORR_COLUMNS for y in CORR_COLUMNS), "policies"))
def _corr(spark, d):
    return feeds.correlation_matrix(b.policies(spark, d), CORR_COLUMNS)


@query("component_means", sql(
    "SELECT " + ", ".join(
        f"CAST(sum(CAST({c} AS DECIMAL(12,1))) AS DOUBLE) / count(*) AS {c}" for c in risk.ANALYSIS_COMPONENTS
    ) + " FROM analysis", "analysis"))
def _components(spark, d):
    return feeds.component_means(matrix(spark, d), risk.ANALYSIS_COMPONENTS)


def _box_sql(group: str, value: str, table: str, digits: int = 4) -> str:
    r = f"CAST(round(CAST({{}} AS DECIMAL(18,6)), {digits}) AS DOUBLE)".format
    return f"""
SELECT {group}, n, {r('q[1]')} AS min, {r('q[2]')} AS q1, {r('q[3]')} AS median, {r('q[4]')} AS q3,
  {r('q[5]')} AS max, {r('greatest(q[1], q[2] - 1.5 * (q[4] - q[2]))')} AS lower_fence,
  {r('least(q[5], q[4] + 1.5 * (q[4] - q[2]))')} AS upper_fence
FROM (SELECT {group}, count({value}) AS n, quantile_cont(CAST({value} AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS q
  FROM {table} GROUP BY 1) x"""


def _rounded_box(df: DataFrame) -> DataFrame:
    names = ["min", "q1", "median", "q3", "max", "lower_fence", "upper_fence"]
    return df.withColumns({c: integrate.round_half_up(F.col(c), 4) for c in names})


@query("box_stats", sql(_box_sql("final_risk_level", "policy_annual_premium", "scored"), "scored"))
def _box(spark, d):
    return _rounded_box(feeds.box_stats(
        portfolio(spark, d), "final_risk_level", "policy_annual_premium", "weight"))


@query("box_stats_by_tier", sql(
    _box_sql("broker_tier", "portfolio_risk_score", "per_broker"), "scored",
    per_broker="""SELECT broker_id, broker_tier, CAST(sum(customer_risk_score) AS DOUBLE) / count(*)
  AS portfolio_risk_score FROM scored GROUP BY 1, 2"""))
def _box_tier(spark, d):
    per_broker = feeds.broker_correlation(portfolio(spark, d), stats(spark, d))
    return _rounded_box(feeds.box_stats(per_broker, "broker_tier", "portfolio_risk_score"))


@query("histogram_bins", sql(
    """SELECT final_risk_level, bin, count(*) AS n,
  CAST(round(CAST(lo + bin * width AS DECIMAL(18,6)), 4) AS DOUBLE) AS bin_start,
  CAST(round(CAST(lo + (bin + 1) * width AS DECIMAL(18,6)), 4) AS DOUBLE) AS bin_end
FROM (SELECT final_risk_level, lo, width,
    CAST(least(floor((age - lo) / width), bins - 1) AS INTEGER) AS bin FROM scored,
    (SELECT min(age)::DOUBLE AS lo, least(20, count(DISTINCT age)) AS bins,
      (max(age) - min(age))::DOUBLE / least(20, count(DISTINCT age)) AS width FROM scored) s
  WHERE age IS NOT NULL) x
GROUP BY final_risk_level, bin, lo, width""", "scored"))
def _histogram(spark, d):
    return feeds.histogram_bins(portfolio(spark, d), "age", "final_risk_level")


@query("numeric_summary", sql(
    """SELECT count(*) AS row_count, 10 AS column_count, 'age' AS first_numeric,
  CAST(sum(age) AS DOUBLE) AS total, CAST(sum(age) AS DOUBLE) / count(age) AS average FROM policies""",
    "policies"))
def _numeric_summary(spark, d):
    return feeds.numeric_summary(b.policies(spark, d))


KINDS = {"DATE": "datetime", "TIMESTAMP": "datetime", "VARCHAR": "categorical", "BOOLEAN": "categorical"}
PROFILED = ["policy_number", "age", "insured_sex", "insured_occupation", "policy_annual_premium", "policy_start_date", "broker_id"]


def _profile_sql() -> str:
    kind = "CASE {} ELSE 'numeric' END".format(" ".join(f"WHEN t = '{t}' THEN '{k}'" for t, k in KINDS.items()))
    parts = [f"""SELECT {i} AS ordinal, '{c}' AS column_name, any_value(typeof({c})) AS t, count(DISTINCT {c}) AS n_distinct,
  count(*) - count({c}) AS n_null FROM policies""" for i, c in enumerate(PROFILED)]
    return f"""SELECT CAST(ordinal AS INTEGER) AS ordinal, column_name, {kind} AS kind, n_distinct, n_null,
  CASE column_name WHEN 'policy_start_date' THEN 'x' WHEN 'age' THEN 'y' END AS axis, 'line' AS recommended
FROM ({' UNION ALL '.join(parts)}) z"""


@query("profile_columns", sql(_profile_sql(), "policies"))
def _profile(spark, d):
    return feeds.profile_columns(b.policies(spark, d).select(*PROFILED))


@query("profile_from_sketches", sql(
    """SELECT column_name, n_null, true AS near FROM (SELECT 'policy_number' AS column_name,
  count(*) - count(policy_number) AS n_null FROM policies UNION ALL SELECT 'age', count(*) - count(age) FROM policies
  UNION ALL SELECT 'broker_id', count(*) - count(broker_id) FROM policies) z""", "policies"))
def _profile_sketches(spark, d):
    rows = b.policies(spark, d).select("policy_number", "age", "broker_id")
    parts = [feeds.profile_sketches(rows.where(F.pmod(F.xxhash64("policy_number", "age"), F.lit(4)) == i)) for i in range(4)]
    exact = feeds.profile_columns(rows).select("column_name", F.col("n_distinct").alias("exact"))
    found = feeds.profile_counts(feeds.merge_profiles(*parts)).join(exact, "column_name")
    return found.select("column_name", "n_null", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query("analytics_summary", sql(
    """SELECT count(DISTINCT customer_region) AS regions_analyzed, count(DISTINCT broker_id) AS brokers_analyzed,
  count(DISTINCT customer_segment) AS customer_segments, count(DISTINCT broker_id) AS analysed_brokers
FROM scored""", "scored"))
def _analytics_summary(spark, d):
    return feeds.analytics_summary(portfolio(spark, d))


@query("top_n_rows", sql(
    """SELECT policy_number, broker_id, claim_amount_filled, customer_risk_score, final_risk_level
FROM scored ORDER BY customer_risk_score DESC, claim_amount_filled DESC, policy_number NULLS FIRST, broker_id,
  policy_annual_premium DESC NULLS LAST LIMIT 10""", "scored"))
def _top_n(spark, d):
    rows = dashboard(spark, d).select(
        "policy_number", "broker_id", "claim_amount_filled", "customer_risk_score", "final_risk_level",
        "policy_annual_premium")
    return feeds.top_n_rows(
        rows, 10, F.col("customer_risk_score").desc(), F.col("claim_amount_filled").desc(),
        F.col("policy_number").asc_nulls_first(), "broker_id", F.col("policy_annual_premium").desc_nulls_last(),
    ).drop("policy_annual_premium")


@query("top_brokers", sql(
    """SELECT broker_id, concat_ws(' ', broker_first_name, broker_last_name) AS broker_name, performance_tier,
  total_score, total_customers FROM matrix JOIN analysis USING (broker_id)
ORDER BY total_score DESC, broker_id LIMIT 10""", "matrix", "analysis"))
def _top_brokers(spark, d):
    return feeds.top_brokers(matrix(spark, d))


@query("matrix_by_volume", sql(
    """SELECT broker_id, broker_tier, total_customers, total_premium_volume FROM matrix
ORDER BY total_premium_volume DESC NULLS LAST, broker_id""", "matrix"))
def _by_volume(spark, d):
    return feeds.matrix_by_volume(matrix(spark, d)).select(
        "broker_id", "broker_tier", "total_customers", "total_premium_volume")


@query("bounded_sql", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1000")
def _bounded(spark, d):
    b.table(spark, d, "events").createOrReplaceTempView("events_for_sql")
    return feeds.bounded_sql(spark, "SELECT event_id, event_type FROM events_for_sql ORDER BY event_id; ")
