"""Canonical table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

POLICIES = T.StructType(
    [
        T.StructField("policy_number", T.StringType()),
        T.StructField("broker_id", T.StringType()),
        T.StructField("age", T.LongType()),
        T.StructField("policy_start_date", T.DateType()),
        T.StructField("policy_length_month", T.LongType()),
        T.StructField("policy_deductable", T.DecimalType(10, 2)),
        T.StructField("policy_annual_premium", T.DecimalType(10, 2)),
        T.StructField("insured_sex", T.StringType()),
        T.StructField("insured_education_level", T.StringType()),
        T.StructField("insured_occupation", T.StringType()),
    ]
)

CLAIMS = T.StructType(
    [
        T.StructField("policy_number", T.StringType()),
        T.StructField("incident_date", T.DateType()),
        T.StructField("incident_type", T.StringType()),
        T.StructField("incident_severity", T.StringType()),
        T.StructField("authorities_contacted", T.StringType()),
        T.StructField("incident_hour_of_the_day", T.IntegerType()),
        T.StructField("number_of_vehicles_involved", T.IntegerType()),
        T.StructField("bodily_injuries", T.IntegerType()),
        T.StructField("witnesses", T.IntegerType()),
        T.StructField("police_report_available", T.StringType()),
        T.StructField("claim_amount", T.LongType()),
        T.StructField("fraud_reported", T.BooleanType()),
    ]
)

BROKERS = T.StructType(
    [
        T.StructField("broker_id", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("office_location", T.StringType()),
        T.StructField("hire_date", T.StringType()),
        T.StructField("specializations", T.ArrayType(T.StringType())),
        T.StructField("territory", T.ArrayType(T.StringType())),
        T.StructField(
            "performance_metrics",
            T.StructType(
                [
                    T.StructField("customer_satisfaction", T.DoubleType()),
                    T.StructField("training_hours_completed", T.LongType()),
                    T.StructField("years_experience", T.LongType()),
                ]
            ),
        ),
        T.StructField("certifications", T.ArrayType(T.StringType())),
        T.StructField("active", T.BooleanType()),
    ]
)

BROKER_ANALYSIS = T.StructType(
    [
        T.StructField("total_score", T.DoubleType()),
        T.StructField("performance_tier", T.StringType()),
        T.StructField("satisfaction_component", T.DoubleType()),
        T.StructField("experience_component", T.DoubleType()),
        T.StructField("training_component", T.DoubleType()),
        T.StructField("portfolio_component", T.DoubleType()),
        T.StructField("risk_management_component", T.DoubleType()),
    ]
)
