"""Vital signs as a stream: flags, windowed counts of abnormal values, and changes of a visit's risk tier.

Beyond the reference, which reads measurements in batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caretide import schemas
from caretide.functions import clinical

FLAGS = ("hr_abnormal", "rr_abnormal", "bp_abnormal", "bt_abnormal", "spo2_abnormal")


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of measurements, as they land in a folder."""
    return spark.readStream.schema(schemas.schema("vitals")).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def flagged(vitals: DataFrame) -> DataFrame:
    """Measurements with their flags; works on a stream and on a table alike."""
    flags = clinical.abnormal(*[F.col(c) for c in ("heart_rate", "respiratory_rate", "systolic_bp", "temperature", "spo2")])
    return vitals.select("id", "visit_id", "measured_at", *[c.alias(n) for n, c in flags.items()])


def abnormal_counts(vitals: DataFrame, window: str = "30 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Abnormal values of a visit in each window.  Measurements later than ``late`` are dropped, and state with them."""
    at = F.col("measured_at").cast("timestamp")
    bad = sum((F.col(f).cast("int") for f in FLAGS), F.lit(0))
    found = flagged(vitals).withColumn("at", at).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    return found.groupBy(F.window("at", window, slide or window), "visit_id").agg(F.sum(bad).alias("n_abnormal"), F.count("*").alias("n_measured")).select("visit_id", F.col("window.start").alias("from_time"), F.col("window.end").alias("to_time"), "n_abnormal", "n_measured")


def tier_changes(predictions: DataFrame, known: DataFrame) -> DataFrame:
    """Of a batch of predictions, the visits whose latest tier differs from the known one; unknown visits count as new."""
    last = predictions.groupBy("visit_id").agg(F.max_by("risk_score", "predicted_at").alias("risk_score"), F.max("predicted_at").alias("predicted_at"))
    now = last.select("visit_id", "predicted_at", clinical.tier(F.round(F.col("risk_score") * 100).cast("int")).alias("tier"))
    before = known.select(F.col("visit_id").alias("__visit"), F.col("tier").alias("tier_before"))
    joined = now.join(before, F.col("visit_id") == F.col("__visit"), "left").drop("__visit")
    return joined.where(~F.col("tier").eqNullSafe(F.col("tier_before")))


def follow(stream: DataFrame, sink: str, checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Append a stream to Parquet; with ``once`` what is there is processed and the query ends."""
    writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
