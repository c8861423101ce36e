"""Small fixed tables of levels, fields, measurements and bed states, for joins and displays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names, order and labels.
RISK = [("critical", 0, "Critical"), ("rising", 1, "Rising risk"), ("watch", 2, "Watch"), ("stable", 3, "Stable")]
FIELDS = ["chiefComplaint", "painAssessment", "presentIllness", "pastHistory", "medication", "allergy", "socialHistory", "systemReview", "physicalExam", "impression", "outcome"]
OPTIONAL_FIELDS = ("impression",)
METRICS = [("probability", 1, "right"), ("hr", 2, "left"), ("sbp", 3, "left"), ("dbp", 4, "left"), ("spo2", 5, "left"), ("bt", 6, "right")]
BED_STATES = [("critical", "Critical"), ("moderate", "Moderate"), ("low", "Low"), ("empty", "Empty")]


def risk_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RISK, "level string, rank int, label string")


def field_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, k, f not in OPTIONAL_FIELDS) for k, f in enumerate(FIELDS)], "field string, ordinal int, required boolean")


def metric_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "metric string, ordinal int, axis string")


def bed_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BED_STATES, "status string, label string")
