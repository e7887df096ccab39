"""Scalar functions by family (items 80-85)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portfolia.schemas import BROKER_ANALYSIS


def last_path_part(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def title_words(name: Column) -> Column:
    """``NULL_POLICY_NUMBERS`` becomes ``Null Policy Numbers``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def format_time(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, pattern)


def minutes_before(ts: Column, minutes: int) -> Column:
    return F.timestamp_add("MINUTE", F.lit(-minutes), ts)


def floor_to(value: Column, step: int) -> Column:
    return F.floor(value / step) * step


def log_points(value: Column, factor: float, cap: float) -> Column:
    """Capped logarithm, zero for values that have none."""
    return F.when(value > 0, F.least(F.ln(value) * factor, F.lit(cap))).otherwise(0.0)


def repeatable_int(n: int, *keys: Column) -> Column:
    """A pseudo-random integer below ``n`` that a re-run repeats."""
    return F.pmod(F.xxhash64(*keys), F.lit(n))


def object_of(df: DataFrame) -> Column:
    """All columns of a row as one JSON object; NULL fields are left out."""
    return F.to_json(F.struct(*df.columns))


def flatten_rows(df: DataFrame, column: str) -> DataFrame:
    """Item 84: one row per array element, with its index."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(column).alias("index", "value"))


def parse_analysis(text: Column) -> Column:
    """Item 85: analysis JSON to a struct, with 0 or ``UNKNOWN`` for absent fields.

    Text that is not a JSON object gives NULL.
    """
    schema = BROKER_ANALYSIS.simpleString().replace("struct<", "struct<_bad:string,", 1)
    parsed = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    fields = [
        F.coalesce(parsed[f.name], F.lit("UNKNOWN" if f.name == "performance_tier" else 0.0)).alias(f.name)
        for f in BROKER_ANALYSIS
    ]
    ok = text.isNotNull() & parsed["_bad"].isNull() & F.trim(text).startswith("{")
    return F.when(ok, F.struct(*fields))
