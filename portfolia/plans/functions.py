"""Scalar function families (items 80-83, 85)."""

from __future__ import annotations

from pyspark.sql import functions as F

from portfolia import bindings as b
from portfolia.functions import scalar
from portfolia.plans.registry import query, sql


@query("fn_string", """
SELECT c_custkey, split_part(concat('stage/', c_mktsegment, '/', c_name), '/', -1) AS last_part,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, left(c_name, 8) AS head,
  concat_ws('.', c_mktsegment, c_name) AS full_name, c_name LIKE '%9%' AS has_nine,
  regexp_matches(c_name, '^Customer#[0-9]+$') AS well_formed, suffix(lower(c_name), '1') AS ends_one,
  c_name || chr(10) || c_mktsegment AS two_lines
FROM customer""")
def _string(spark, d):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return b.table(spark, d, "customer").select(
        "c_custkey",
        scalar.last_path_part(F.concat(F.lit("stage/"), seg, F.lit("/"), name)).alias("last_part"),
        scalar.title_words(seg).alias("title"),
        F.left(name, F.lit(8)).alias("head"),
        F.concat_ws(".", seg, name).alias("full_name"),
        name.like("%9%").alias("has_nine"),
        name.rlike("^Customer#[0-9]+$").alias("well_formed"),
        F.lower(name).endswith("1").alias("ends_one"),
        F.concat(name, F.char(F.lit(10)), seg).alias("two_lines"),
    )


@query("fn_date", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS as_text, ts - INTERVAL 5 MINUTE AS five_before,
  CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS parsed, CAST(ts AS DATE) AS day
FROM events""")
def _date(spark, d):
    ts = F.col("ts").cast("timestamp")
    text = scalar.format_time(ts)
    return b.table(spark, d, "events").select(
        "event_id", text.alias("as_text"), scalar.minutes_before(ts, 5).alias("five_before"),
        F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss").alias("parsed"), ts.cast("date").alias("day"),
    )


@query("fn_math", """
SELECT o_orderkey, CAST(floor(o_totalprice / 10000) * 10000 AS BIGINT) AS floored,
  CAST(round(CAST(o_totalprice / 7 AS DECIMAL(18,6)), 2) AS DOUBLE) AS rounded,
  least(o_totalprice, 100000) AS capped, greatest(50 - o_totalprice / 2000, 0) AS lifted,
  CAST(round(CAST(CASE WHEN o_custkey > 0 THEN least(ln(o_custkey) * 15, 50) ELSE 0 END AS DECIMAL(18,6)), 4) AS DOUBLE)
    AS log_points, o_orderkey % 9 AS in_range
FROM orders""")
def _math(spark, d):
    price = F.col("o_totalprice")
    draw = scalar.repeatable_int(9, F.col("o_orderkey"))
    points = scalar.log_points(F.col("o_custkey"), 15, 50.0)
    return b.table(spark, d, "orders").select(
        "o_orderkey",
        scalar.floor_to(price, 10000).cast("long").alias("floored"),
        F.round((price / 7).cast("decimal(18,6)"), 2).cast("double").alias("rounded"),
        F.least(price, F.lit(100000.0)).alias("capped"),
        F.greatest(F.lit(50.0) - price / 2000, F.lit(0.0)).alias("lifted"),
        F.round(points.cast("decimal(18,6)"), 4).cast("double").alias("log_points"),
        F.when(draw.between(0, 8), F.col("o_orderkey") % 9).alias("in_range"),
    )


@query("fn_object", sql(
    """SELECT broker_id, '{"broker_id":"' || broker_id || '","office_location":"' || office_location || '"}'
  AS packed, office_location AS unpacked, 'INSURANCE_DOCS' AS first_type FROM brokers""", "brokers"))
def _object(spark, d):
    rows = b.brokers(spark, d).select("broker_id", "office_location")
    packed = rows.select("broker_id", scalar.object_of(rows).alias("packed"))
    variant = F.try_parse_json("packed")
    return packed.select(
        "broker_id", "packed",
        F.try_variant_get(variant, "$.office_location", "string").alias("unpacked"),
        F.element_at(F.array(F.lit("INSURANCE_DOCS")), 1).alias("first_type"),
    )


@query("fn_parse_analysis", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN value ELSE 0 END AS total_score,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN event_type ELSE 'UNKNOWN' END AS performance_tier,
  event_id % 4 <> 0 AS parsed
FROM events""")
def _parse(spark, d):
    full = F.to_json(F.struct(F.col("value").alias("total_score"), F.col("event_type").alias("performance_tier")))
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{broken "), F.col("event_type")))
        .when(F.col("event_id") % 4 == 1, full).otherwise(F.col("props"))
    )
    rows = b.table(spark, d, "events").select("event_id", scalar.parse_analysis(text).alias("a"))
    return rows.select(
        "event_id", F.col("a.total_score").alias("total_score"),
        F.col("a.performance_tier").alias("performance_tier"), F.col("a").isNotNull().alias("parsed"))
