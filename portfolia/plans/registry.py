"""Query registry and the tables every oracle starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from portfolia import bindings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a key, with its SQL when it has one."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _select(columns: list[str], source: str) -> str:
    return "SELECT " + ",\n  ".join(columns) + f"\nFROM {source}"


CTE = {
    "policies": _select(bindings.POLICY_COLUMNS, "customer"),
    "claims": _select(bindings.CLAIM_COLUMNS, "orders"),
    "brokers": _select(bindings.BROKER_COLUMNS, "nation JOIN region ON n_regionkey = r_regionkey"),
    "messages": _select(bindings.MESSAGE_COLUMNS, "conversations"),
    "stream_events": _select(bindings.STREAM_EVENT_COLUMNS, "events"),
    # Level 1: one row per policy and claim.
    "l1": """
SELECT p.*, b.first_name AS broker_first_name, b.last_name AS broker_last_name,
  b.email AS broker_email, b.office_location AS broker_office,
  CAST(floor(b.satisfaction + 0.5) AS BIGINT) AS broker_satisfaction,
  b.experience AS broker_experience, b.training AS broker_training, b.active AS broker_active,
  c.* EXCLUDE (policy_number),
  CASE WHEN c.policy_number IS NULL THEN 0 ELSE 1 END AS has_claim,
  coalesce(c.claim_amount, 0) AS claim_amount_filled,
  coalesce(c.fraud_reported, false) AS fraud_reported_filled
FROM policies p
LEFT JOIN brokers b ON b.broker_id = p.broker_id
LEFT JOIN claims c ON c.policy_number = p.policy_number""",
    # Score parameters as tables, looked up by range.
    "age_points": """
SELECT * FROM (VALUES (-1000, 25, 50000, 85, 65), (25, 35, 75000, 70, 45), (35, 55, 100000, 55, 25),
  (55, 1000, 50000, 40, 20)) AS t(age_from, age_to, claim_limit, points_over, points_else)""",
    # Level 2 without broker numbers.
    "scored": """
SELECT x.*,
  CASE WHEN customer_risk_score >= 75 THEN 'HIGH' WHEN customer_risk_score >= 50 THEN 'MEDIUM'
    ELSE 'LOW' END AS final_risk_level
FROM (
  SELECT l1.*,
    coalesce(CASE WHEN l1.claim_amount_filled > a.claim_limit THEN a.points_over ELSE a.points_else END, 50)
      + 5 * (CASE WHEN coalesce(policy_annual_premium, 0) > 2000 THEN 2
                  WHEN coalesce(policy_annual_premium, 0) > 1500 THEN 1 ELSE 0 END)
      AS customer_risk_score,
    coalesce(r.region, 'Other Region') AS customer_region,
    CASE WHEN coalesce(policy_annual_premium, 0) <= 1500 THEN 'BASIC'
         WHEN policy_annual_premium <= 2500 THEN 'STANDARD' ELSE 'PREMIUM' END AS customer_segment,
    CASE WHEN broker_satisfaction >= 5 AND broker_experience >= 10 AND broker_training >= 40 THEN 'PLATINUM'
         WHEN broker_satisfaction >= 5 AND broker_experience >= 5 AND broker_training >= 30 THEN 'GOLD'
         WHEN broker_satisfaction >= 5 AND broker_experience >= 3 AND broker_training >= 20 THEN 'SILVER'
         ELSE 'BRONZE' END AS broker_tier
  FROM l1
  LEFT JOIN age_points a ON l1.age >= a.age_from AND l1.age < a.age_to
  LEFT JOIN (VALUES ('London', 'London Region'), ('Manchester', 'Manchester Region'),
    ('Birmingham', 'Birmingham Region'), ('Leeds', 'Northern Region')) AS r(office, region)
    ON contains(l1.broker_office, r.office)
  WHERE l1.broker_id IS NOT NULL
) x""",
    "l2": """
SELECT scored.*,
  count(*) OVER (PARTITION BY broker_id) AS broker_customer_count,
  CAST(sum(claim_amount_filled) OVER (PARTITION BY broker_id) AS DOUBLE)
    / count(*) OVER (PARTITION BY broker_id) AS broker_avg_claim
FROM scored""",
    # The analysis per broker, as flat columns.
    "analysis": """
SELECT broker_id, round(CAST(s + e + t + p + r AS DECIMAL(18,6)), 1)::DOUBLE AS total_score,
  CASE WHEN s + e + t + p + r >= 250 THEN 'ELITE' WHEN s + e + t + p + r >= 200 THEN 'SUPERIOR'
       WHEN s + e + t + p + r >= 150 THEN 'PROFICIENT' ELSE 'DEVELOPING' END AS performance_tier,
  round(CAST(s AS DECIMAL(18,6)), 1)::DOUBLE AS satisfaction_component,
  round(CAST(e AS DECIMAL(18,6)), 1)::DOUBLE AS experience_component,
  round(CAST(t AS DECIMAL(18,6)), 1)::DOUBLE AS training_component,
  round(CAST(p AS DECIMAL(18,6)), 1)::DOUBLE AS portfolio_component,
  round(CAST(r AS DECIMAL(18,6)), 1)::DOUBLE AS risk_management_component
FROM (
  SELECT broker_id,
    CAST(least(20 * coalesce(max(broker_satisfaction), 0), 100) AS DOUBLE) AS s,
    CAST(least(8 * coalesce(max(broker_experience), 0), 80) AS DOUBLE) AS e,
    CAST(least(2 * coalesce(max(broker_training), 0), 60) AS DOUBLE) AS t,
    least(15 * ln(count(*)), 50) AS p,
    CASE WHEN sum(claim_amount_filled) > 0
      THEN greatest(50 - CAST(sum(claim_amount_filled) AS DOUBLE) / count(*) / 2000, 0) ELSE 0 END AS r
  FROM scored GROUP BY broker_id
) parts""",
    "matrix": """
SELECT scored.broker_id, max(broker_first_name) AS broker_first_name, max(broker_last_name) AS broker_last_name,
  max(broker_tier) AS broker_tier, count(*) AS total_customers,
  CAST(sum(policy_annual_premium) AS DOUBLE) / count(policy_annual_premium) AS avg_customer_premium,
  CAST(sum(customer_risk_score) AS DOUBLE) / count(*) AS avg_customer_risk,
  CAST(sum(policy_annual_premium) AS DOUBLE) AS total_premium_volume,
  true AS broker_active
FROM scored GROUP BY scored.broker_id""",
    # Measured metrics: 13 rows per measuring time.
    "measured": """
SELECT 'CUSTOMERS_RAW' AS table_name, 'INVALID_CUSTOMER_AGE_COUNT' AS metric_name,
  (SELECT count(*) FROM policies WHERE age < 18 OR age > 85) AS metric_value
UNION ALL SELECT 'CUSTOMERS_RAW', 'INVALID_BROKER_ID_COUNT',
  (SELECT count(*) FROM policies WHERE NOT regexp_full_match(broker_id, 'BRK[0-9]{3}'))
UNION ALL SELECT 'CUSTOMERS_RAW', 'NULL_COUNT', (SELECT count(*) FROM policies WHERE policy_number IS NULL)
UNION ALL SELECT 'CUSTOMERS_RAW', 'DUPLICATE_COUNT', (SELECT count(*) FROM (SELECT policy_number
  FROM policies WHERE policy_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1) d)
UNION ALL SELECT 'CUSTOMERS_RAW', 'ROW_COUNT', (SELECT count(*) FROM policies)
UNION ALL SELECT 'CLAIMS_RAW', 'NULL_COUNT', (SELECT count(*) FROM claims WHERE policy_number IS NULL)
UNION ALL SELECT 'CLAIMS_RAW', 'DUPLICATE_COUNT', (SELECT count(*) FROM (SELECT policy_number
  FROM claims WHERE policy_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1) d)
UNION ALL SELECT 'CLAIMS_RAW', 'ROW_COUNT', (SELECT count(*) FROM claims)""",
    "history": """
SELECT m.*, t.tick AS measurement_time, TIMESTAMP '2024-03-01 12:00:00' AS change_commit_time
FROM measured m, (VALUES (TIMESTAMP '2024-03-01 12:00:00'), (TIMESTAMP '2024-03-01 10:30:00')) AS t(tick)""",
    "summary": """
SELECT h.*, CASE
  WHEN l.good IS NULL THEN 'UNKNOWN' WHEN metric_value = 0 THEN 'EXCELLENT'
  WHEN metric_value <= l.good THEN 'GOOD' WHEN metric_value <= l.warning THEN 'WARNING'
  ELSE 'CRITICAL' END AS quality_status
FROM history h LEFT JOIN (VALUES ('NULL_COUNT', 5, 20), ('DUPLICATE_COUNT', 3, 10),
  ('INVALID', 2, 10)) AS l(part, good, warning) ON contains(h.metric_name, l.part)""",
}

#: Which tables each table is built from, in order.
NEEDS = {
    "l1": ["policies", "brokers", "claims"],
    "scored": ["l1", "age_points"],
    "l2": ["scored"],
    "analysis": ["scored"],
    "matrix": ["scored"],
    "measured": ["policies", "claims"],
    "history": ["measured"],
    "summary": ["history"],
}


def sql(body: str, *tables: str, **extra: str) -> str:
    """An oracle: the named tables and what they need as CTEs, then the body."""
    order: list[str] = []

    def need(name: str) -> None:
        for t in NEEDS.get(name, []):
            need(t)
        if name not in order:
            order.append(name)

    for t in tables:
        need(t)
    parts = [f"{t} AS ({CTE[t]})" for t in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body


MEASURED_AT = ["2024-03-01 12:00:00", "2024-03-01 10:30:00"]
