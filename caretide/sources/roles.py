"""Tables of the test data in the roles of the clinical tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretide.functions import clinical, dims
from caretide.sources.tables import table

# Which part a status or an event type plays.
STATUS = {"O": "active", "F": "closed", "P": "pending"}
METRIC = {"view": "heart_rate", "click": "respiratory_rate", "purchase": "systolic_bp", "signup": "temperature", "error": "spo2"}

SQL = {
    "patients": "patients AS (SELECT c_custkey AS id, c_name AS patient_number, c_mktsegment AS category, c_acctbal AS balance FROM customer)",
    "visits": """visits AS (SELECT o_orderkey AS id, o_custkey AS patient_id, o_orderdate AS arrival_time, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS triage_level,
        substr(o_orderpriority, 3) AS chief_complaint, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' ELSE 'pending' END AS status FROM orders)""",
    "vitals": """vitals AS (SELECT event_id AS id, user_id AS visit_id, ts AS measured_at, CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'click' THEN 'respiratory_rate'
        WHEN 'purchase' THEN 'systolic_bp' WHEN 'signup' THEN 'temperature' ELSE 'spo2' END AS metric, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)""",
    "predictions": "predictions AS (SELECT l_orderkey AS visit_id, l_linenumber AS line, l_shipdate AS predicted_at, CAST(round(l_discount * 1000) AS INTEGER) AS percent, l_extendedprice AS price FROM lineitem)",
    "records": """records AS (SELECT d.doc_id AS id, d.source AS visit_key, d.lang AS record_type, d.n_chars, l.quality,
        CASE WHEN l.quality = 1 THEN TIMESTAMP '2024-01-01 00:00:00' END AS confirmed_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "fields": "fields AS (SELECT conv_id AS rec_id, 'f' || (turn % 8) AS field, arg_max_null(text, turn) AS value FROM conversations GROUP BY ALL)",
    "charts": """charts AS (SELECT user_id AS rec_id, CAST(event_id % 11 AS INTEGER) AS ordinal,
        arg_max_null(CASE event_type WHEN 'error' THEN ' 미확인' WHEN 'signup' THEN 'dose 확인 필요' WHEN 'click' THEN CASE WHEN value >= 250 THEN props END ELSE props END, event_id) AS value FROM events GROUP BY ALL)""",
    "beds": """beds AS (SELECT s.s_suppkey AS bed_id, n.n_name AS ward, r.r_name AS zone, CASE WHEN s.s_acctbal < 0 THEN 'empty' WHEN s.s_acctbal >= 5000 THEN 'critical'
        WHEN s.s_acctbal >= 2500 THEN 'moderate' ELSE 'low' END AS status FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)""",
}


def with_roles(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def patients(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("patient_number"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("balance"))


def visits(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "closed").otherwise("pending")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("arrival_time"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("triage_level"), F.substr("o_orderpriority", F.lit(3)).alias("chief_complaint"), status.alias("status"),
    )


def vitals(spark: SparkSession, folder: str) -> DataFrame:
    metric = F.coalesce(F.create_map(*[F.lit(x) for pair in METRIC.items() for x in pair])[F.col("event_type")], F.lit("spo2"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("visit_id"), F.col("ts").alias("measured_at"), metric.alias("metric"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value")
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    percent = F.round(F.col("l_discount") * 1000).cast("int")
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("visit_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("predicted_at"), percent.alias("percent"), F.col("l_extendedprice").alias("price"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    joined = docs.select("doc_id", "source", "lang", "n_chars").join(labels.select("doc_id", "quality"), "doc_id", "left")
    confirmed = F.when(F.col("quality") == 1, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return joined.select(F.col("doc_id").alias("id"), F.col("source").alias("visit_key"), F.col("lang").alias("record_type"), "n_chars", "quality", confirmed.alias("confirmed_at"))


def fields(spark: SparkSession, folder: str) -> DataFrame:
    """The record of a conversation in long form: turn i speaks of field f(i mod 8), and the last such turn decides."""
    turns = table(spark, folder, "conversations")
    return turns.select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seq"), F.concat(F.lit("f"), (F.col("turn") % 8).cast("string")).alias("field"), F.col("text").alias("value"))


def charts(spark: SparkSession, folder: str) -> DataFrame:
    """Records with the eleven real fields and the real sentinels: event i of a user edits field i mod 11."""
    kind, props = F.col("event_type"), F.col("props")
    value = F.when(kind == "error", f" {clinical.UNCONFIRMED}").when(kind == "signup", f"dose {clinical.NEEDS_CONFIRMATION}").when(kind == "click", F.when(F.col("value") >= 250, props)).otherwise(props)
    name = F.get(F.array(*[F.lit(f) for f in dims.FIELDS]), (F.col("event_id") % len(dims.FIELDS)).cast("int"))
    return table(spark, folder, "events").select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("seq"), name.alias("field"), value.alias("value"))


def beds(spark: SparkSession, folder: str) -> DataFrame:
    b = F.col("s_acctbal")
    status = F.when(b < 0, "empty").when(b >= 5000, "critical").when(b >= 2500, "moderate").otherwise("low")
    joined = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("bed_id"), F.col("n_name").alias("ward"), F.col("r_name").alias("zone"), status.alias("status"))
