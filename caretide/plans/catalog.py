"""Every query of the engine by name, over the test tables in their roles, beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caretide import schemas
from caretide.functions import clinical, dims
from caretide.operators import changes, intervals, nested, reads, records, summaries, trends
from caretide.sources import roles, scratch, tables, versions
from caretide.sources.roles import with_roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# Scans, lookups and listings ------------------------------------------------------------------------------------------


@query("SELECT 'ok' AS status")
def health(spark, sf):
    return tables.alive(spark)


@query("SELECT 1 AS result")
def health_db(spark, sf):
    return tables.connected(spark)


@query(with_roles("patients") + "SELECT id, patient_number, category, row_number() OVER (ORDER BY id DESC) AS position FROM patients")
def patients_list(spark, sf):
    listed = roles.patients(spark, sf).select("id", "patient_number", "category")
    return reads.positioned(listed, reads.by_id("id", newest_first=True), [F.col("id").desc()])


@query(with_roles("patients") + "SELECT id, patient_number, category FROM patients WHERE id = 42")
def patient_by_id(spark, sf):
    return reads.by_key(roles.patients(spark, sf), id=42).select("id", "patient_number", "category")


@query(with_roles("patients") + "SELECT id, patient_number FROM patients WHERE patient_number = 'Customer#000000107'")
def patient_by_number(spark, sf):
    return reads.by_key(roles.patients(spark, sf), patient_number="Customer#000000107").select("id", "patient_number")


@query(with_roles("visits") + "SELECT id, patient_id, arrival_time, triage_level, chief_complaint, status FROM visits WHERE id = 77")
def visit_by_id(spark, sf):
    return reads.by_key(roles.visits(spark, sf), id=77)


@query(with_roles("vitals") + "SELECT id, visit_id, measured_at, metric, value FROM vitals WHERE id = 1234")
def vital_by_id(spark, sf):
    return reads.by_key(roles.vitals(spark, sf), id=1234)


@query(with_roles("predictions") + "SELECT visit_id, line, predicted_at, percent FROM predictions WHERE visit_id = 100 AND line = 3")
def prediction_by_id(spark, sf):
    return reads.by_key(roles.predictions(spark, sf), visit_id=100, line=3).select("visit_id", "line", "predicted_at", "percent")


@query(with_roles("records") + "SELECT id, visit_key, record_type, n_chars, confirmed_at FROM records WHERE id = 12")
def record_by_id(spark, sf):
    return reads.by_key(roles.records(spark, sf), id=12).select("id", "visit_key", "record_type", "n_chars", "confirmed_at")


def _by_arrival(visits: DataFrame) -> DataFrame:
    return reads.positioned(visits, reads.by_time("arrival_time", "id"), [F.col("arrival_time").desc(), F.col("id").desc()])


@query(with_roles("visits") + "SELECT id, patient_id, arrival_time, status, row_number() OVER (ORDER BY arrival_time DESC, id DESC) AS position FROM visits")
def visits_list(spark, sf):
    return _by_arrival(roles.visits(spark, sf).select("id", "patient_id", "arrival_time", "status"))


@query(with_roles("visits") + "SELECT id, arrival_time, status, row_number() OVER (ORDER BY arrival_time DESC, id DESC) AS position FROM visits WHERE status = 'active'")
def visits_by_status(spark, sf):
    return _by_arrival(reads.optional_filter(roles.visits(spark, sf), "status", "active").select("id", "arrival_time", "status"))


@query(with_roles("visits") + """SELECT 'none' AS filter, count(*) AS n FROM visits UNION ALL SELECT 'blank', count(*) FROM visits
UNION ALL SELECT 'exact', count(*) FROM visits WHERE status = 'active' UNION ALL SELECT 'other case', count(*) FROM visits WHERE status = 'ACTIVE'""")  # fmt: skip
def visits_filter_cases(spark, sf):
    visits, out = roles.visits(spark, sf), None
    for name, value in (("none", None), ("blank", ""), ("exact", "active"), ("other case", "ACTIVE")):
        one = reads.optional_filter(visits, "status", value).agg(F.count("*").alias("n")).select(F.lit(name).alias("filter"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_roles("patients", "visits") + """SELECT v.id, v.patient_id, v.arrival_time, v.status, row_number() OVER (ORDER BY arrival_time DESC, v.id DESC) AS position, true AS found
FROM visits v JOIN patients p ON v.patient_id = p.id WHERE p.id = 90""")  # fmt: skip
def visits_for_patient(spark, sf):
    found = reads.children(roles.patients(spark, sf), roles.visits(spark, sf), 90, "patient_id")
    return _by_arrival(found.select("id", "patient_id", "arrival_time", "status", "found"))


@query("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS status, false AS found")
def visits_for_missing_patient(spark, sf):
    return reads.children(roles.patients(spark, sf), roles.visits(spark, sf), -5, "patient_id").select("id", "status", "found")


@query(with_roles("vitals") + "SELECT id, measured_at, metric, value, row_number() OVER (ORDER BY measured_at, id) AS position FROM vitals WHERE visit_id = 7")
def vitals_for_visit(spark, sf):
    own = reads.children(roles.visits(spark, sf), roles.vitals(spark, sf), 7, "visit_id").drop("found")
    return reads.positioned(own, reads.by_time("measured_at", "id", newest_first=False), [F.col("measured_at"), F.col("id")]).drop("visit_id")


@query("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS metric, false AS found")
def vitals_for_missing_visit(spark, sf):
    return reads.children(roles.visits(spark, sf), roles.vitals(spark, sf), -7, "visit_id").select("id", "metric", "found")


@query(with_roles("predictions") + "SELECT line, predicted_at, percent, price, row_number() OVER (ORDER BY predicted_at DESC, line DESC, price DESC) AS position FROM predictions WHERE visit_id = 100")
def predictions_for_visit(spark, sf):
    own = reads.children(roles.visits(spark, sf), roles.predictions(spark, sf), 100, "visit_id").drop("found")
    return reads.positioned(own, reads.by_time("predicted_at", "line"), [F.col("predicted_at").desc(), F.col("line").desc(), F.col("price").desc()]).drop("visit_id")


@query("SELECT CAST(NULL AS BIGINT) AS line, CAST(NULL AS INTEGER) AS percent, false AS found")
def predictions_for_missing_visit(spark, sf):
    return reads.children(roles.visits(spark, sf), roles.predictions(spark, sf), -100, "visit_id").select(F.col("line").cast("long").alias("line"), "percent", "found")


@query(with_roles("visits") + """SELECT id AS prediction_id, patient_id, CAST(round(price / 10000) AS INTEGER) AS percent FROM (SELECT v.*, o.o_totalprice AS price FROM visits v JOIN orders o ON v.id = o.o_orderkey) WHERE id = 321""")
def prediction_by_pk(spark, sf):
    scored = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.col("o_custkey").alias("patient_id"), F.round(F.col("o_totalprice") / 10000).cast("int").alias("percent"))
    return reads.by_key(scored, prediction_id=321)


@query(with_roles("records") + """SELECT id, record_type, n_chars, confirmed_at, CASE WHEN quality = 1 THEN 'confirmed' WHEN quality IS NOT NULL THEN 'draft' ELSE 'none' END AS state,
row_number() OVER (ORDER BY id DESC) AS position FROM records WHERE visit_key = 'src3'""")  # fmt: skip
def records_for_visit(spark, sf):
    own = reads.by_key(roles.records(spark, sf), visit_key="src3")
    state = F.when(F.col("quality") == 1, "confirmed").when(F.col("quality").isNotNull(), "draft").otherwise("none")
    named = own.select("id", "record_type", "n_chars", "confirmed_at", state.alias("state"))
    return reads.positioned(named, reads.by_id("id", newest_first=True), [F.col("id").desc()])


def _written(records: DataFrame) -> DataFrame:
    """Records with a visit's number and a time of creation that does not follow their ids."""
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=((F.col("id") * 7919) % 100_003).cast("int"))
    return records.select("id", F.substr("visit_key", F.lit(4)).cast("long").alias("visit_id"), "record_type", "confirmed_at", created.alias("created_at"))


WRITTEN_SQL = """, written AS (SELECT id, CAST(substr(visit_key, 4) AS BIGINT) AS visit_id, record_type, confirmed_at,
TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * ((id * 7919) % 100003) AS created_at FROM records)
"""


@query(with_roles("records") + WRITTEN_SQL + "SELECT id, record_type, confirmed_at, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS position FROM written WHERE visit_id = 3")
def records_by_creation(spark, sf):
    own = reads.children(roles.visits(spark, sf), _written(roles.records(spark, sf)), 3, "visit_id").select("id", "record_type", "confirmed_at", "created_at")
    return reads.positioned(own, reads.by_time("created_at", "id"), [F.col("created_at").desc(), F.col("id").desc()])


@query("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS record_type, false AS found")
def records_for_missing_visit(spark, sf):
    return reads.children(roles.visits(spark, sf), _written(roles.records(spark, sf)), -3, "visit_id").select("id", "record_type", "found")


@query(with_roles("patients", "visits") + "SELECT v.id, v.patient_id, v.patient_id + 100 AS asked_id, p.id IS NOT NULL AS found FROM visits v LEFT JOIN patients p ON v.patient_id + 100 = p.id")
def parent_gate(spark, sf):
    asked = roles.visits(spark, sf).select("id", "patient_id", (F.col("patient_id") + 100).alias("asked_id"))
    return reads.gate(asked, roles.patients(spark, sf), "asked_id")


# Projections ----------------------------------------------------------------------------------------------------------


@query("""SELECT event_id AS id, strftime(ts, '%H:%M') AS hhmm, substr(strftime(ts, '%Y-%m-%d %H:%M'), 12) AS sliced, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events""")
def arrival_hhmm(spark, sf):
    at = F.col("ts")
    text = F.date_format(at, "yyyy-MM-dd HH:mm")
    return tables.table(spark, sf, "events").select(F.col("event_id").alias("id"), clinical.hhmm(at).alias("hhmm"), F.substr(text, F.lit(12)).alias("sliced"), clinical.stamp(at).alias("stamp"))


@query(with_roles("patients", "visits") + """SELECT v.id, p.category || '/' || v.triage_level AS combined, CASE WHEN v.triage_level <= 2 THEN 'urgent' ELSE 'routine' END AS urgency,
CASE v.status WHEN 'active' THEN 'In care' WHEN 'closed' THEN 'Discharged' ELSE 'Waiting' END AS status_label,
coalesce(nullif(CASE WHEN v.triage_level = 5 THEN '' ELSE v.chief_complaint END, ''), 'unconfirmed') AS complaint,
coalesce(CASE WHEN v.id % 3 > 0 THEN p.category END, '-') AS category_or_dash, CASE WHEN v.chief_complaint = 'LOW' THEN '' ELSE v.chief_complaint END AS editable,
p.patient_number || ' (' || v.status || ')' AS title
FROM visits v JOIN patients p ON v.patient_id = p.id""")  # fmt: skip
def display_strings(spark, sf):
    v, p = roles.visits(spark, sf), roles.patients(spark, sf).withColumnRenamed("id", "pid")
    blank = F.when(F.col("triage_level") == 5, "").otherwise(F.col("chief_complaint"))
    return v.join(p, v["patient_id"] == p["pid"]).select(
        "id", F.concat_ws("/", "category", F.col("triage_level").cast("string")).alias("combined"), F.when(F.col("triage_level") <= 2, "urgent").otherwise("routine").alias("urgency"),
        clinical.mapped(F.col("status"), {"active": "In care", "closed": "Discharged"}, "Waiting").alias("status_label"), clinical.or_blank(blank, "unconfirmed").alias("complaint"),
        clinical.or_null(F.when(F.col("id") % 3 > 0, F.col("category")), "-").alias("category_or_dash"), clinical.without_sentinel(F.col("chief_complaint"), "LOW").alias("editable"),
        F.format_string("%s (%s)", "patient_number", "status").alias("title"),
    )


@query(with_roles("visits") + "SELECT triage_level, chief_complaint, count(*) AS n FROM visits WHERE status = 'active' GROUP BY ALL")
def active_triage(spark, sf):
    return reads.optional_filter(roles.visits(spark, sf), "status", "active").groupBy("triage_level", "chief_complaint").agg(F.count("*").alias("n"))


@query(with_roles("records") + "SELECT id, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-05-01 12:00:00' END AS confirmed_at FROM records")
def confirm_toggle(spark, sf):
    wanted = F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False)
    return roles.records(spark, sf).select("id", clinical.confirmed_at(wanted, F.lit("2024-05-01 12:00:00").cast("timestamp_ntz")).alias("confirmed_at"))


JSON_SCHEMA = "name STRING, gender STRING, triage_level INT"


@query("""SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 <> 4 THEN 'p' || o_custkey END AS name, CAST(NULL AS VARCHAR) AS gender,
CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderkey % 5 AS INTEGER) END AS triage_level,
CASE WHEN o_orderkey % 5 = 4 THEN '' WHEN o_orderkey % 2 = 0 THEN 'name,triage_level' ELSE 'name,gender,triage_level' END AS set_fields, CASE WHEN o_orderkey % 5 = 4 THEN 422 END AS code FROM orders""")
def json_decode(spark, sf):
    k = F.col("o_orderkey")
    body = F.when(k % 5 == 4, "{broken").when(k % 2 == 0, F.format_string('{"name": "p%d", "triage_level": %d}', "o_custkey", k % 5)).otherwise(F.format_string('{"name": "p%d", "gender": null, "triage_level": %d}', "o_custkey", k % 5))
    rows = tables.table(spark, sf, "orders").select(k.alias("seq"), body.alias("body"))
    return tables.decoded(rows, JSON_SCHEMA, keep=("seq",)).withColumn("set_fields", F.array_join("set_fields", ","))


@query(with_roles("visits") + """SELECT id, '{"id":' || id || ',"status":"' || status || '","closed_by":' || CASE WHEN status = 'closed' THEN '"desk"' ELSE 'null' END || '}' AS body FROM visits""")
def json_encode(spark, sf):
    rows = roles.visits(spark, sf).select("id", "status", F.when(F.col("status") == "closed", "desk").alias("closed_by"))
    return rows.select("id", tables.encoded(rows))


# Clinical rules -------------------------------------------------------------------------------------------------------

TIER_SQL = "CASE WHEN percent >= 80 THEN 'critical' WHEN percent >= 60 THEN 'rising' WHEN percent >= 30 THEN 'watch' ELSE 'stable' END"


@query(with_roles("predictions") + f"SELECT {TIER_SQL} AS risk, count(*) AS n FROM predictions GROUP BY 1")
def risk_tier_counts(spark, sf):
    return roles.predictions(spark, sf).groupBy(clinical.tier(F.col("percent")).alias("risk")).agg(F.count("*").alias("n"))


def ranked_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Visits by risk rank, then percent downward, then id, with their places."""
    highest = roles.predictions(spark, sf).groupBy("visit_id").agg(F.max("percent").alias("percent"))
    v = roles.visits(spark, sf)
    risk = clinical.tier(F.col("percent"))
    joined = v.join(highest, v["id"] == highest["visit_id"]).select("id", "patient_id", "triage_level", "status", "percent", risk.alias("risk"), clinical.hhmm(F.col("arrival_time")).alias("arrived"))
    # the rank falls with the percent, so the percent alone orders both; many visits share one
    return reads.positioned(joined, [-F.col("percent"), *reads.by_id("id")], [F.col("percent").desc(), F.col("id")])


@query(with_roles("visits", "predictions") + f""", highest AS (SELECT visit_id, max(percent) AS percent FROM predictions GROUP BY 1),
listed AS (SELECT v.id, v.patient_id, v.triage_level, v.status, h.percent, {TIER_SQL} AS risk, strftime(v.arrival_time, '%H:%M') AS arrived FROM visits v JOIN highest h ON v.id = h.visit_id)
SELECT *, row_number() OVER (ORDER BY CASE risk WHEN 'critical' THEN 0 WHEN 'rising' THEN 1 WHEN 'watch' THEN 2 ELSE 3 END, percent DESC, id) AS position FROM listed""")  # fmt: skip
def worklist(spark, sf):
    return ranked_worklist(spark, sf)


@query(with_roles("patients", "visits", "predictions", "vitals", "records") + f""", highest AS (SELECT visit_id, max(percent) AS percent FROM predictions GROUP BY 1),
recent AS (SELECT visit_id, arg_max(metric || ' ' || strftime(measured_at, '%H:%M'), id) AS recent_vital FROM vitals GROUP BY 1)
SELECT v.id, p.patient_number, CASE WHEN p.id % 2 = 0 THEN 'female' ELSE 'male' END AS sex, p.category, strftime(v.arrival_time, '%H:%M') AS arrived, v.triage_level, coalesce(nullif(v.chief_complaint, ''), 'unconfirmed') AS complaint,
{TIER_SQL} AS risk, h.percent, t.recent_vital, CASE WHEN coalesce(r.quality = 1, false) THEN 'certified' WHEN r.quality IS NOT NULL THEN 'in progress' ELSE 'not written' END AS record_status, '/monitoring/' || v.id AS link
FROM visits v JOIN highest h ON v.id = h.visit_id JOIN patients p ON v.patient_id = p.id LEFT JOIN recent t ON t.visit_id = v.id LEFT JOIN records r ON r.id = v.id""")  # fmt: skip
def worklist_display(spark, sf):
    """The columns that the list of visits shows, the link to the detail included."""
    highest = roles.predictions(spark, sf).groupBy("visit_id").agg(F.max("percent").alias("percent"))
    p = roles.patients(spark, sf).select(F.col("id").alias("patient_id"), "patient_number", "category")
    recent = roles.vitals(spark, sf).groupBy("visit_id").agg(F.max_by(F.concat_ws(" ", "metric", clinical.hhmm(F.col("measured_at"))), "id").alias("recent_vital"))
    r = roles.records(spark, sf).select(F.col("id").alias("record_id"), "quality")
    v = roles.visits(spark, sf).withColumnRenamed("id", "visit_id")
    listed = v.join(highest, "visit_id").join(p, "patient_id").join(recent, "visit_id", "left").join(r, F.col("visit_id") == F.col("record_id"), "left")
    return listed.select(
        F.col("visit_id").alias("id"), "patient_number", F.when(F.col("patient_id") % 2 == 0, "female").otherwise("male").alias("sex"), "category", clinical.hhmm(F.col("arrival_time")).alias("arrived"),
        "triage_level", clinical.or_blank(F.col("chief_complaint"), "unconfirmed").alias("complaint"), clinical.tier(F.col("percent")).alias("risk"), "percent", "recent_vital",
        clinical.record_status(F.col("quality") == 1, F.col("quality").isNotNull(), F.lit("not written")).alias("record_status"), F.format_string("/monitoring/%d", "visit_id").alias("link"),
    )


@query(with_roles("vitals") + """SELECT id, visit_id, coalesce(metric = 'heart_rate' AND (value > 100 OR value < 50), false) AS hr_abnormal,
coalesce(metric = 'respiratory_rate' AND (value > 20 OR value < 10), false) AS rr_abnormal, coalesce(metric = 'systolic_bp' AND (value < 100 OR value > 160), false) AS bp_abnormal,
coalesce(metric = 'temperature' AND value >= 37.5, false) AS bt_abnormal, coalesce(metric = 'spo2' AND value < 94, false) AS spo2_abnormal, value IS NOT NULL AS is_measured FROM vitals""")  # fmt: skip
def abnormal_flags(spark, sf):
    of = lambda metric: F.when(F.col("metric") == metric, F.col("value"))
    flags = clinical.abnormal(of("heart_rate"), of("respiratory_rate"), of("systolic_bp"), of("temperature"), of("spo2"))
    return roles.vitals(spark, sf).select("id", "visit_id", *[c.alias(n) for n, c in flags.items()], F.col("value").isNotNull().alias("is_measured"))


@query(with_roles("predictions") + "SELECT visit_id, count(*) FILTER (WHERE percent + 20 > 100) AS n_rejected, count(*) FILTER (WHERE percent + 20 <= 100) AS n_accepted FROM predictions GROUP BY 1")
def prediction_range_rejects(spark, sf):
    ok = clinical.valid_score((F.col("percent") + 20) / 100.0)
    return roles.predictions(spark, sf).groupBy("visit_id").agg(F.count_if(~ok).alias("n_rejected"), F.count_if(ok).alias("n_accepted"))


@query(with_roles("records") + "SELECT id, CASE WHEN coalesce(quality = 1, false) THEN 'certified' WHEN quality IS NOT NULL THEN 'in progress' ELSE 'not written' END AS status FROM records")
def record_status(spark, sf):
    status = clinical.record_status(F.col("quality") == 1, F.col("quality").isNotNull(), F.lit("not written"))
    return roles.records(spark, sf).select("id", status.alias("status"))


# Nested documents -----------------------------------------------------------------------------------------------------

METRICS = ["heart_rate", "respiratory_rate", "systolic_bp", "temperature", "spo2"]
SLOTS = [f"d{k}" for k in range(1, 32)]
METRICS_SQL = "metrics(metric, ordinal) AS (VALUES ('heart_rate', 1), ('respiratory_rate', 2), ('systolic_bp', 3), ('temperature', 4), ('spo2', 5))"


@query(with_roles("vitals") + f""", own AS (SELECT visit_id, date_trunc('month', measured_at) AS month, metric, value, day(measured_at) AS slot FROM vitals),
months AS (SELECT DISTINCT visit_id, month FROM own), {METRICS_SQL}
SELECT s.visit_id, strftime(s.month, '%Y-%m') AS month, m.metric, m.ordinal, {', '.join(f'max(value) FILTER (WHERE slot = {k}) AS d{k}' for k in range(1, 32))}
FROM months s CROSS JOIN metrics m LEFT JOIN own o ON o.visit_id = s.visit_id AND o.month = s.month AND o.metric = m.metric GROUP BY ALL""")  # fmt: skip
def trend_matrix(spark, sf):
    """One row for each visit, month and metric, one column for each day of the month."""
    day = F.concat(F.lit("d"), F.dayofmonth("measured_at").cast("string"))
    points = roles.vitals(spark, sf).groupBy("visit_id", F.date_format("measured_at", "yyyy-MM").alias("month"), day.alias("slot")).pivot("metric", METRICS).agg(F.max("value"))
    ordinal = clinical.mapped(F.col("metric"), {m: k for k, m in enumerate(METRICS, 1)})
    return nested.matrix(points, ["visit_id", "month"], "slot", SLOTS, METRICS).select("visit_id", "month", "metric", ordinal.alias("ordinal"), *SLOTS)


@query(with_roles("vitals") + """, own AS (SELECT visit_id, CAST(measured_at AS DATE) AS day, metric, max(value) AS value FROM vitals GROUP BY ALL),
cells AS (SELECT visit_id, day, date_diff('day', min(day) OVER (PARTITION BY visit_id), day) + 1 AS slot FROM (SELECT DISTINCT visit_id, day FROM own)),
metrics(metric, ordinal) AS (VALUES ('heart_rate', 1), ('respiratory_rate', 2), ('systolic_bp', 3), ('temperature', 4), ('spo2', 5))
SELECT c.visit_id, c.slot, m.metric, m.ordinal, o.value FROM cells c CROSS JOIN metrics m
LEFT JOIN own o ON o.visit_id IS NOT DISTINCT FROM c.visit_id AND o.day IS NOT DISTINCT FROM c.day AND o.metric = m.metric""")  # fmt: skip
def trend_matrix_all(spark, sf):
    """All measurements as a matrix in long form; the slot is the day from each visit's first one, as 1."""
    points = roles.vitals(spark, sf).groupBy("visit_id", F.to_date("measured_at").alias("day")).pivot("metric", METRICS).agg(F.max("value"))
    first = F.min("day").over(Window.partitionBy("visit_id"))  # over days, not measurements
    slots = points.withColumn("slot", (F.datediff("day", first) + 1).cast("long"))
    ordinal = clinical.mapped(F.col("metric"), {m: k for k, m in enumerate(METRICS, 1)})
    return slots.unpivot(["visit_id", "slot"], METRICS, "metric", "value").select("visit_id", "slot", "metric", ordinal.alias("ordinal"), "value")


@query(with_roles("beds") + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'critical') AS critical, count(*) FILTER (WHERE status = 'moderate') AS moderate,
count(*) FILTER (WHERE status = 'low') AS low, count(*) FILTER (WHERE status = 'empty') AS empty FROM beds""")  # fmt: skip
def bed_status_counts(spark, sf):
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return roles.beds(spark, sf).agg(F.count("*").alias("total"), one("critical"), one("moderate"), one("low"), one("empty"))


BED_ROW = 16  #: beds in a row of the board; bounds the nested arrays


def board(spark: SparkSession, sf: str) -> DataFrame:
    """Beds nested by zone, ward and row, each with its devices; beds without any have none."""
    b = roles.beds(spark, sf)
    devices = F.filter(F.array(*[F.when(F.col("bed_id") % k == 0, F.lit(d)) for d, k in (("E", 2), ("V", 3), ("C", 5))]), lambda d: d.isNotNull())
    patient = F.when(F.col("status") != "empty", F.col("bed_id") * 10)
    full = b.select("zone", "ward", F.floor(F.col("bed_id") / BED_ROW).alias("bed_row"), "bed_id", "status", F.when(F.col("status") != "empty", devices).alias("devices"), patient.alias("patient_id"))
    return nested.gathered(full, ["zone", "ward", "bed_row"], "bed_id", ["status", "devices", "patient_id"], "beds")


@query(with_roles("beds") + """SELECT zone, ward, CAST(floor(bed_id / 16) AS BIGINT) AS bed_row, row_number() OVER (PARTITION BY zone, ward, floor(bed_id / 16) ORDER BY bed_id) AS ordinal, bed_id, status,
CASE WHEN status <> 'empty' THEN bed_id * 10 END AS patient_id, CASE WHEN status <> 'empty' THEN concat_ws(',', CASE WHEN bed_id % 2 = 0 THEN 'E' END, CASE WHEN bed_id % 3 = 0 THEN 'V' END, CASE WHEN bed_id % 5 = 0 THEN 'C' END) ELSE '' END AS devices,
status <> 'empty' AND (bed_id % 2 = 0 OR bed_id % 3 = 0 OR bed_id % 5 = 0) AS has_devices FROM beds""")  # fmt: skip
def bed_board(spark, sf):
    flat = nested.flatten(board(spark, sf), "beds", ["bed_id", "status", "devices", "patient_id"], ["zone", "ward", "bed_row"])
    return flat.withColumn("has_devices", nested.has_any("devices")).withColumn("devices", F.coalesce(F.array_join("devices", ","), F.lit("")))


@query(with_roles("beds") + """SELECT d.device, b.status, count(*) AS n FROM beds b JOIN (VALUES ('E', 2), ('V', 3), ('C', 5)) d(device, k) ON b.bed_id % d.k = 0 WHERE b.status <> 'empty' GROUP BY ALL""")
def devices_in_use(spark, sf):
    flat = nested.flatten(board(spark, sf), "beds", ["status", "devices"], ["zone"])
    return flat.select("status", F.explode("devices").alias("device")).groupBy("device", "status").agg(F.count("*").alias("n"))


@query(with_roles("beds") + """SELECT bed_id, '{"status":"' || status || '"' || CASE WHEN status <> 'empty' THEN ',"patient_id":' || bed_id * 10 || ',"ward":"' || ward || '"' ELSE '' END || '}' AS body FROM beds""")
def bed_documents(spark, sf):
    """Beds as documents; an empty bed has no occupant's members."""
    bed = nested.built({"status": F.col("status")}, {"patient_id": F.col("bed_id") * 10, "ward": F.col("ward")}, F.col("status") != "empty")
    return roles.beds(spark, sf).select("bed_id", F.to_json(bed).alias("body"))


@query(with_roles("visits") + """SELECT id, CASE id % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'chief_complaint' WHEN 2 THEN 'triage_level' ELSE 'bed' END AS field,
CASE id % 4 WHEN 0 THEN status WHEN 1 THEN chief_complaint WHEN 2 THEN CAST(triage_level AS VARCHAR) END AS value FROM visits""")  # fmt: skip
def column_by_key(spark, sf):
    k = F.col("id") % 4
    named = roles.visits(spark, sf).withColumn("field", F.when(k == 0, "status").when(k == 1, "chief_complaint").when(k == 2, "triage_level").otherwise("bed"))
    return named.select("id", "field", nested.by_name(["status", "chief_complaint", "triage_level"], F.col("field")).alias("value"))


@query(with_roles("visits") + """, shown AS (SELECT id, CASE WHEN id % 3 = 0 THEN '/records/' ELSE '/monitoring/' END || id AS path FROM visits)
SELECT id, starts_with(path, '/records') AS records, starts_with(path, '/monitoring') AS monitoring FROM shown""")  # fmt: skip
def active_route(spark, sf):
    path = F.concat(F.when(F.col("id") % 3 == 0, "/records/").otherwise("/monitoring/"), F.col("id").cast("string"))
    return roles.visits(spark, sf).select("id", *[F.startswith(path, F.lit(f"/{r}")).alias(r) for r in ("records", "monitoring")])


@query(with_roles("predictions") + f""", levels(level, rank, label) AS (VALUES ('critical', 0, 'Critical'), ('rising', 1, 'Rising risk'), ('watch', 2, 'Watch'), ('stable', 3, 'Stable')),
counted AS (SELECT {TIER_SQL} AS level, count(*) AS n FROM predictions GROUP BY 1)
SELECT l.level, l.rank, l.label, coalesce(c.n, 0) AS n FROM levels l LEFT JOIN counted c ON l.level = c.level""")  # fmt: skip
def risk_levels(spark, sf):
    """The literal table of levels, each with its predictions, none included."""
    counted = roles.predictions(spark, sf).groupBy(clinical.tier(F.col("percent")).alias("level")).agg(F.count("*").alias("n"))
    return dims.risk_meta(spark).join(counted, "level", "left").select("level", "rank", "label", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, length(text) AS n_chars FROM conversations""")
def dialogue_turns(spark, sf):
    turns = tables.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return reads.positioned(turns, reads.by_id("turn"), [F.col("turn")], within=["conv_id"])


@query(with_roles("vitals") + """, axes(metric, axis) AS (VALUES ('heart_rate', 'left'), ('systolic_bp', 'left'), ('spo2', 'left'), ('temperature', 'right'))
SELECT v.visit_id, a.axis, count(value) AS n, min(value) AS low, max(value) AS high FROM vitals v JOIN axes a ON v.metric = a.metric GROUP BY ALL""")
def series_axes(spark, sf):
    """What each of the two axes of a visit's chart has to span."""
    short = clinical.mapped(F.col("metric"), {"heart_rate": "hr", "systolic_bp": "sbp", "spo2": "spo2", "temperature": "bt"})
    drawn = roles.vitals(spark, sf).withColumn("axis", clinical.mapped(short, {m: axis for m, _, axis in dims.METRICS})).where("axis is not null")
    return drawn.groupBy("visit_id", "axis").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT conv_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY 1")
def clinician_turns(spark, sf):
    own = tables.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return own.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


# Records and their workflow -------------------------------------------------------------------------------------------

FIELDS = [f"f{k}" for k in range(8)]
OPTIONAL = ("f6",)
STATUS_SQL = (
    with_roles("fields")
    + r""", names(field, ordinal) AS (VALUES ('f0', 0), ('f1', 1), ('f2', 2), ('f3', 3), ('f4', 4), ('f5', 5), ('f6', 6), ('f7', 7)),
recs AS (SELECT DISTINCT rec_id FROM fields),
trimmed AS (SELECT r.rec_id, n.ordinal, n.field, n.field <> 'f6' AS required,
  regexp_replace(coalesce(f.value, ''), '^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g') AS v
  FROM recs r CROSS JOIN names n LEFT JOIN fields f ON f.rec_id = r.rec_id AND f.field = n.field),
statuses AS (SELECT rec_id, ordinal, field, required, CASE WHEN v = '' OR v = 'N/A' THEN 'missing' WHEN contains(v, 'ement') THEN 'review' ELSE 'complete' END AS status FROM trimmed)
"""
)


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    # the texts have stand-ins for the two sentinels
    return records.statuses(roles.fields(spark, sf), FIELDS, OPTIONAL, "seq", "N/A", "ement")


@query(STATUS_SQL + "SELECT rec_id, CAST(ordinal AS INTEGER) AS ordinal, field, status, required FROM statuses")
def field_status(spark, sf):
    return _statuses(spark, sf)


SUMMARY_SQL = STATUS_SQL + """, sums AS (SELECT rec_id, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'review') AS n_review,
count(*) FILTER (WHERE status = 'complete') AS n_complete, count(*) FILTER (WHERE status = 'missing' AND required) AS n_required_missing,
coalesce(string_agg(CASE WHEN status = 'missing' AND required THEN field END, ', ' ORDER BY ordinal), '') AS missing_fields,
arg_min(field, ordinal) FILTER (WHERE status = 'missing' AND required) AS first_missing FROM statuses GROUP BY 1)
"""


@query(SUMMARY_SQL + """SELECT *, CAST(greatest(0.0, round(CAST(100 AS DOUBLE) - 5 * n_missing - CAST(3.5 AS DOUBLE) * n_review)) AS INTEGER) AS score, n_required_missing = 0 AS gate_open FROM sums""")
def record_completeness(spark, sf):
    return records.summary(_statuses(spark, sf))


@query(SUMMARY_SQL + "SELECT rec_id, missing_fields, first_missing FROM sums WHERE n_required_missing > 0")
def missing_required(spark, sf):
    return records.summary(_statuses(spark, sf)).where("n_required_missing > 0").select("rec_id", "missing_fields", "first_missing")


@query(SUMMARY_SQL + """, talk AS (SELECT conv_id AS rec_id, count(*) FILTER (WHERE role = 'user') > 0 AS has_dialogue, count(*) FILTER (WHERE role = 'assistant') > 0 AS has_draft FROM conversations GROUP BY 1),
asked AS (SELECT s.rec_id, t.has_dialogue, t.has_draft, s.rec_id % 3 <> 0 AS was_checked, s.n_required_missing, CASE WHEN s.rec_id % 4 <> 0 THEN 'K' || (s.rec_id % 10) END AS code, s.rec_id % 5 <> 0 AS agreed FROM sums s JOIN talk t ON s.rec_id = t.rec_id)
SELECT rec_id, CAST(CASE WHEN NOT (has_dialogue AND has_draft) THEN 1 WHEN NOT (was_checked AND n_required_missing = 0) THEN 2 WHEN code IS NULL THEN 3 WHEN NOT agreed THEN 4 ELSE 5 END AS INTEGER) AS step, code FROM asked""")  # fmt: skip
def workflow_steps(spark, sf):
    talk = tables.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("rec_id")).agg((F.count_if(F.col("role") == "user") > 0).alias("has_dialogue"), (F.count_if(F.col("role") == "assistant") > 0).alias("has_draft"))
    asked = records.summary(_statuses(spark, sf)).join(talk, "rec_id")
    code = F.when(F.col("rec_id") % 4 != 0, F.concat(F.lit("K"), (F.col("rec_id") % 10).cast("string")))
    step = records.reachable(F.col("has_dialogue"), F.col("has_draft"), F.col("rec_id") % 3 != 0, F.col("n_required_missing"), code, F.col("rec_id") % 5 != 0)
    return asked.select("rec_id", step.alias("step"), code.alias("code"))


CHART_SQL = (
    with_roles("charts")
    + ", names(field, ordinal) AS (VALUES "
    + ", ".join(f"('{f}', {k})" for k, f in enumerate(dims.FIELDS))
    + r"""),
recs AS (SELECT DISTINCT rec_id FROM charts),
trimmed AS (SELECT r.rec_id, n.ordinal, n.field, n.field <> 'impression' AS required, trim(coalesce(c.value, ''), ' ') AS v
  FROM recs r CROSS JOIN names n LEFT JOIN charts c ON c.rec_id = r.rec_id AND c.ordinal = n.ordinal),
statuses AS (SELECT rec_id, ordinal, field, required, CASE WHEN v = '' OR v = '미확인' THEN 'missing' WHEN contains(v, '확인 필요') THEN 'review' ELSE 'complete' END AS status FROM trimmed),
sums AS (SELECT rec_id, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'review') AS n_review,
count(*) FILTER (WHERE status = 'complete') AS n_complete, count(*) FILTER (WHERE status = 'missing' AND required) AS n_required_missing,
coalesce(string_agg(CASE WHEN status = 'missing' AND required THEN field END, ', ' ORDER BY ordinal), '') AS missing_fields,
arg_min(field, ordinal) FILTER (WHERE status = 'missing' AND required) AS first_missing FROM statuses GROUP BY 1)
"""
)


def _charts(spark: SparkSession, sf: str) -> DataFrame:
    return records.statuses(roles.charts(spark, sf), dims.FIELDS, dims.OPTIONAL_FIELDS, "seq")


@query(CHART_SQL + "SELECT rec_id, CAST(ordinal AS INTEGER) AS ordinal, field, status, required FROM statuses")
def chart_status(spark, sf):
    """The eleven fields of every record."""
    return _charts(spark, sf)


@query(CHART_SQL + """SELECT *, CAST(greatest(0.0, round(CAST(100 AS DOUBLE) - 5 * n_missing - CAST(3.5 AS DOUBLE) * n_review)) AS INTEGER) AS score, n_required_missing = 0 AS gate_open FROM sums""")
def chart_completeness(spark, sf):
    return records.summary(_charts(spark, sf))


@query(CHART_SQL + """SELECT rec_id, CASE WHEN rec_id % 4 <> 0 THEN 'K' || (rec_id % 10) END AS code,
CAST(CASE WHEN rec_id % 7 = 0 THEN 1 WHEN NOT (rec_id % 3 <> 0 AND n_required_missing = 0) THEN 2 WHEN rec_id % 4 = 0 THEN 3 WHEN rec_id % 5 = 0 THEN 4 ELSE 5 END AS INTEGER) AS step FROM sums""")
def chart_steps(spark, sf):
    """The furthest step of every record: no required field may be missing from the third on."""
    asked, k = records.summary(_charts(spark, sf)), F.col("rec_id")
    code = F.when(k % 4 != 0, F.concat(F.lit("K"), (k % 10).cast("string")))
    step = records.reachable(F.lit(True), k % 7 != 0, k % 3 != 0, F.col("n_required_missing"), code, k % 5 != 0)
    return asked.select("rec_id", code.alias("code"), step.alias("step"))


@query("""WITH edits AS (SELECT conv_id AS rec_id, turn AS seq, 'f' || (turn % 3) AS field, text AS value FROM conversations WHERE role <> 'system'),
drafts AS (SELECT conv_id AS rec_id, max(turn) AS draft FROM conversations WHERE role = 'system' OR turn = 3 GROUP BY 1)
SELECT e.rec_id, e.field, max(e.seq) AS seq, CAST(length(arg_max(e.value, e.seq)) AS BIGINT) AS n_chars FROM edits e LEFT JOIN drafts d ON e.rec_id = d.rec_id WHERE e.seq > coalesce(d.draft, -1) GROUP BY 1, 2""")
def regenerated_fields(spark, sf):
    turns = tables.table(spark, sf, "conversations").withColumn("rec_id", F.col("conv_id")).withColumn("seq", F.col("turn"))
    edits = turns.where(F.col("role") != "system").select("rec_id", "seq", F.concat(F.lit("f"), (F.col("turn") % 3).cast("string")).alias("field"), F.col("text").alias("value"))
    drafts = turns.where((F.col("role") == "system") | (F.col("turn") == 3)).select("rec_id", "seq")
    return records.current_values(edits, drafts).select("rec_id", "field", "seq", F.length("value").cast("long").alias("n_chars"))


@query("""WITH ids AS (SELECT doc_id AS rec_id FROM documents), talks AS (SELECT DISTINCT conv_id FROM conversations) SELECT rec_id, 400 AS code FROM ids WHERE rec_id NOT IN (SELECT conv_id FROM talks)""")
def draft_refusals(spark, sf):
    ids = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("rec_id"))
    talks = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("rec_id"))
    return ids.join(talks, "rec_id", "left_anti").withColumn("code", F.lit(400))


DRAFT_CUES = {"complaint": "(?i)the", "history": "(?i)que", "exam": "(?i)und"}


@query("""WITH turns AS (SELECT conv_id AS rec_id, turn, CASE role WHEN 'user' THEN 'patient' WHEN 'assistant' THEN 'clinician' ELSE 'other' END AS role, text FROM conversations),
said AS (SELECT rec_id, turn, 'complaint' AS field, text FROM turns WHERE regexp_matches(text, '(?i)the') UNION ALL SELECT rec_id, turn, 'history', text FROM turns WHERE regexp_matches(text, '(?i)que')
UNION ALL SELECT rec_id, turn, 'exam', text FROM turns WHERE regexp_matches(text, '(?i)und') AND role = 'clinician')
SELECT rec_id, field, max(turn) AS turn, arg_max(CASE WHEN regexp_matches(text, 'nicht') THEN 'none' WHEN regexp_matches(text, 'peut|ment') THEN 'doubt' ELSE 'said' END, turn) AS kind FROM said GROUP BY 1, 2""")
def dialogue_drafts(spark, sf):
    role = clinical.mapped(F.col("role"), {"user": "patient", "assistant": "clinician"}, "other")
    turns = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("rec_id"), "turn", role.alias("role"), "text")
    drafts = records.drafted(turns, DRAFT_CUES, "nicht", "peut|ment", exam=("exam",), unsure="doubt")
    kind = F.when(F.col("value") == "none", "none").when(F.col("value") == "doubt", "doubt").otherwise("said")
    return drafts.select("rec_id", "field", "turn", kind.alias("kind"))


@query("""SELECT conv_id AS rec_id, CAST(s AS INTEGER) AS step, CASE WHEN s < conv_id % 5 + 1 THEN 'done' WHEN s = conv_id % 5 + 1 THEN 'active' ELSE 'pending' END AS state, s < conv_id % 5 + 1 AS may_go
FROM (SELECT DISTINCT conv_id FROM conversations), range(1, 6) r(s)""")
def step_states(spark, sf):
    ids = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("rec_id")).distinct()
    current = F.col("rec_id") % 5 + 1
    steps = ids.select("rec_id", F.explode(F.sequence(F.lit(1), F.lit(len(records.STEPS)))).alias("step"))
    return steps.select("rec_id", "step", clinical.step_state(F.col("step"), current).alias("state"), records.may_go(current, F.col("step")).alias("may_go"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 > 0 THEN ts ELSE TIMESTAMP '2024-06-01 08:00:00' END AS created_at FROM events")
def server_defaults(spark, sf):
    given = F.when(F.col("event_id") % 4 > 0, F.col("ts"))
    return tables.table(spark, sf, "events").select(F.col("event_id").alias("id"), clinical.or_now(given, F.lit("2024-06-01 08:00:00").cast("timestamp_ntz")).alias("created_at"))


# Codes ----------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS code, p_type AS kind, CAST(round(p_retailprice) AS BIGINT) AS fitness, rank FROM
(SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)""")
def code_candidates(spark, sf):
    """Every candidate of its group, best first; prices are whole cents."""
    cents = F.round(F.col("p_retailprice") * 100)
    ranked = reads.positioned(tables.table(spark, sf, "part"), [-F.floor("p_retailprice"), [-cents, *reads.by_id("p_partkey")]], [F.col("p_retailprice").desc(), F.col("p_partkey")], "rank", within=["p_type", "p_brand"])
    return ranked.select(F.col("p_partkey").alias("code"), F.col("p_type").alias("kind"), F.round("p_retailprice").cast("long").alias("fitness"), "rank")


@query("SELECT l.doc_id AS rec_id, p.p_partkey AS code, p.p_name AS name FROM labels l JOIN part p ON l.doc_id % 50 = p.p_partkey")
def selected_code(spark, sf):
    chosen = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("rec_id"), (F.col("doc_id") % 50).alias("code"))
    codes = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    return chosen.join(codes, "code").select("rec_id", "code", "name")


@query(with_roles("records") + """SELECT r.id AS rec_id, r.confirmed_at AS certified_at, p.p_partkey AS code, p.p_name AS name FROM records r JOIN part p ON r.id % 50 = p.p_partkey WHERE r.quality = 1""")
def certified_records(spark, sf):
    certified = roles.records(spark, sf).where(F.col("quality") == 1).select(F.col("id").alias("rec_id"), F.col("confirmed_at").alias("certified_at"), (F.col("id") % 50).alias("code"))
    codes = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    return certified.join(codes, "code").select("rec_id", "certified_at", "code", "name")


# Changes --------------------------------------------------------------------------------------------------------------


@query(with_roles("patients") + """, batch AS (SELECT o_orderkey AS seq, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS patient_number FROM orders)
SELECT b.seq, b.patient_number, CASE WHEN p.id IS NOT NULL OR row_number() OVER (PARTITION BY b.patient_number ORDER BY b.seq) > 1 THEN 409 END AS code
FROM batch b LEFT JOIN patients p ON b.patient_number = p.patient_number""")  # fmt: skip
def insert_conflicts(spark, sf):
    number = F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
    batch = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), number.alias("patient_number"))
    return changes.insert_unique(roles.patients(spark, sf).select("patient_number"), batch, "patient_number")


@query(with_roles("patients", "visits") + "SELECT v.id AS seq, v.patient_id + 100 AS patient_id, CASE WHEN p.id IS NULL THEN 404 END AS code FROM visits v LEFT JOIN patients p ON v.patient_id + 100 = p.id")
def insert_missing_parent(spark, sf):
    batch = roles.visits(spark, sf).select(F.col("id").alias("seq"), (F.col("patient_id") + 100).alias("patient_id"))
    return changes.insert_child(roles.patients(spark, sf), batch, "patient_id")


@query(with_roles("visits", "vitals") + """SELECT t.id AS seq, t.visit_id * 100 + 1000 AS visit_id, t.metric, CASE WHEN v.id IS NULL THEN 404 END AS code
FROM vitals t LEFT JOIN visits v ON t.visit_id * 100 + 1000 = v.id""")  # fmt: skip
def insert_vitals(spark, sf):
    batch = roles.vitals(spark, sf).select(F.col("id").alias("seq"), (F.col("visit_id") * 100 + 1000).alias("visit_id"), "metric")
    return changes.insert_child(roles.visits(spark, sf), batch, "visit_id")


@query(with_roles("visits") + """, batch AS (SELECT doc_id AS seq, doc_id * 20 AS visit_id, CASE WHEN doc_id % 7 > 0 THEN lang ELSE repeat(source, 20) END AS record_type, CASE WHEN doc_id % 5 > 0 THEN text END AS content FROM documents)
SELECT b.seq, b.visit_id, CASE WHEN v.id IS NULL THEN 404 WHEN record_type IS NULL OR content IS NULL OR length(record_type) > 50 THEN 422 END AS code FROM batch b LEFT JOIN visits v ON b.visit_id = v.id""")  # fmt: skip
def insert_records(spark, sf):
    k = F.col("doc_id")
    kind, content = F.when(k % 7 > 0, F.col("lang")).otherwise(F.repeat("source", F.lit(20))), F.when(k % 5 > 0, F.col("text"))
    batch = tables.table(spark, sf, "documents").select(k.alias("seq"), (k * 20).alias("visit_id"), kind.alias("record_type"), content.alias("content"))
    checks = changes.constraint_checks("records", ["record_type", "content"])
    return changes.insert_child(roles.visits(spark, sf), batch, "visit_id", *checks).select("seq", "visit_id", "code")


@query(with_roles("visits", "predictions") + """SELECT p.visit_id + 5000 AS visit_id, CASE WHEN v.id IS NULL THEN 404 WHEN percent + 20 > 100 THEN 400 END AS code, count(*) AS n
FROM predictions p LEFT JOIN visits v ON p.visit_id + 5000 = v.id GROUP BY ALL""")  # fmt: skip
def insert_predictions(spark, sf):
    batch = roles.predictions(spark, sf).select((F.col("visit_id") + 5000).alias("visit_id"), ((F.col("percent") + 20) / 100.0).alias("risk_score"))
    judged = changes.insert_child(roles.visits(spark, sf), batch, "visit_id", (~clinical.valid_score(F.col("risk_score")), changes.INVALID))
    return judged.groupBy("visit_id", "code").agg(F.count("*").alias("n"))


@query("""WITH batch AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 7 > 0 THEN CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE repeat(c_name, 6) END END AS name, c_mktsegment AS gender FROM customer)
SELECT seq, CASE WHEN name IS NULL OR length(name) > 100 OR length(gender) > 20 THEN 422 END AS code FROM batch""")
def constraint_rejects(spark, sf):
    name = F.when(F.col("c_custkey") % 7 > 0, F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise(F.repeat("c_name", F.lit(6))))
    batch = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), name.alias("name"), F.col("c_mktsegment").alias("gender"))
    return batch.select("seq", changes.first_code(*changes.constraint_checks("patients", ["name", "gender"])).alias("code"))


@query(with_roles("patients") + """, top AS (SELECT max(id) AS t FROM patients) SELECT o_orderkey AS seq, t + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders, top""")
def generated_ids(spark, sf):
    accepted = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"))
    return changes.with_ids(roles.patients(spark, sf).select("id"), accepted)


def patch_log(spark: SparkSession, sf: str) -> DataFrame:
    """Visits as patches of their patient: which fields one sets depends on its number; some set null."""
    k = F.col("o_orderkey")
    names = F.when(k % 3 == 0, F.array(F.lit("status"))).when(k % 3 == 1, F.array(F.lit("triage_level"))).otherwise(F.array(F.lit("status"), F.lit("triage_level")))
    value = lambda c: F.when(k % 5 != 0, c)
    return tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), k.alias("seq"), names.alias("set_fields"), value(F.col("o_orderstatus")).alias("status"), value(F.substring("o_orderpriority", 1, 1).cast("int")).alias("triage_level"))


@query("""SELECT o_custkey AS id, arg_max_null(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 1) AS status,
arg_max_null(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS triage_level,
bool_or(o_orderkey % 3 <> 1) AS status_set, bool_or(o_orderkey % 3 <> 0) AS triage_level_set, max(o_orderkey) AS last_seq FROM orders GROUP BY 1""")
def merge_patch_state(spark, sf):
    return changes.fold(patch_log(spark, sf), ["status", "triage_level"])


FOLD_SQL = """WITH f AS (SELECT o_custkey AS id, arg_max_null(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 1) AS status, bool_or(o_orderkey % 3 <> 1) AS s,
arg_max_null(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS triage_level, bool_or(o_orderkey % 3 <> 0) AS t FROM orders GROUP BY 1)
"""


@query(FOLD_SQL + """SELECT c.c_custkey AS id, CASE WHEN coalesce(f.s, false) THEN f.status ELSE c.c_mktsegment END AS status,
CASE WHEN coalesce(f.t, false) THEN f.triage_level ELSE c.c_nationkey END AS triage_level FROM customer c LEFT JOIN f ON c.c_custkey = f.id""")
def patched_rows(spark, sf):
    """Two columns of every customer after the whole patch log."""
    state = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_nationkey").alias("triage_level"))
    return changes.patched(state, changes.fold(patch_log(spark, sf), ["status", "triage_level"]), ["status", "triage_level"])


@query(FOLD_SQL + "SELECT c.c_custkey AS id, CASE WHEN coalesce(f.s, false) THEN f.status ELSE c.c_mktsegment END AS status FROM customer c LEFT JOIN f ON c.c_custkey = f.id")
def patched_rows_all(spark, sf):
    """Customers after the whole patch log."""
    state = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    return changes.patched(state, changes.fold(patch_log(spark, sf), ["status"]), ["status"])


def patient_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of patients, some of unknown ones, some that null a required name or make it too long."""
    k = F.col("o_orderkey")
    names = F.when(k % 3 == 0, F.array(F.lit("name"))).when(k % 3 == 1, F.array(F.lit("gender"))).otherwise(F.array(F.lit("name"), F.lit("gender")))
    name = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.repeat(F.col("o_orderpriority"), F.lit(20))).otherwise(F.col("o_orderpriority"))
    return tables.table(spark, sf, "orders").select((F.col("o_custkey") + 50).alias("id"), k.alias("seq"), names.alias("set_fields"), name.alias("name"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("gender"))


PATCHES_SQL = """WITH log AS (SELECT o_custkey + 50 AS id, o_orderkey AS seq, o_orderkey % 3 <> 1 AS n, o_orderkey % 3 <> 0 AS g,
CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN repeat(o_orderpriority, 20) ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS gender FROM orders),
judged AS (SELECT l.*, CASE WHEN c.c_custkey IS NULL THEN 404 WHEN l.n AND (l.name IS NULL OR length(l.name) > 100) OR l.g AND length(l.gender) > 20 THEN 422 END AS code FROM log l LEFT JOIN customer c ON l.id = c.c_custkey)
"""


@query(PATCHES_SQL + "SELECT id, seq, code FROM judged")
def patch_refusals(spark, sf):
    """Every patch with its code: unknown patient before broken constraint, null if it is accepted."""
    state = roles.patients(spark, sf).select("id")
    return changes.judged_patches(state, patient_patches(spark, sf), "patients", ["name", "gender"]).select("id", "seq", "code")


@query(PATCHES_SQL + """, f AS (SELECT id, arg_max_null(name, seq) FILTER (WHERE n) AS name, bool_or(n) AS n, arg_max_null(gender, seq) FILTER (WHERE g) AS gender, bool_or(g) AS g FROM judged WHERE code IS NULL GROUP BY 1)
SELECT c.c_custkey AS id, CASE WHEN coalesce(f.n, false) THEN f.name ELSE c.c_name END AS name, CASE WHEN coalesce(f.g, false) THEN f.gender ELSE c.c_mktsegment END AS gender FROM customer c LEFT JOIN f ON c.c_custkey = f.id""")
def accepted_patches(spark, sf):
    """Patients after the accepted patches alone."""
    state = roles.patients(spark, sf).select("id", F.col("patient_number").alias("name"), F.col("category").alias("gender"))
    judged = changes.judged_patches(state, patient_patches(spark, sf), "patients", ["name", "gender"]).where("code is null")
    return changes.patched(state, changes.fold(judged, ["name", "gender"]), ["name", "gender"])


@query("""WITH f AS (SELECT o_custkey AS id, arg_max_null(CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 1) AS heart_rate, bool_or(o_orderkey % 3 <> 1) AS h,
arg_max_null(CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS consciousness, bool_or(o_orderkey % 3 <> 0) AS c,
arg_max_null(o_orderdate, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS measured_at, bool_or(o_orderkey % 2 = 0) AS m FROM orders GROUP BY 1)
SELECT e.event_id AS id, e.user_id AS visit_id, CASE WHEN coalesce(f.m, false) THEN f.measured_at ELSE e.ts END AS measured_at, CASE WHEN coalesce(f.h, false) THEN f.heart_rate ELSE e.value END AS heart_rate,
CASE WHEN coalesce(f.c, false) THEN f.consciousness ELSE e.event_type END AS consciousness FROM events e LEFT JOIN f ON e.event_id = f.id""")
def patched_vitals(spark, sf):
    """Measurements after patches of time, value and consciousness; id and visit are no patchable fields."""
    k, named = F.col("o_orderkey"), lambda holds, f: F.when(holds, F.lit(f))
    fields = F.array_compact(F.array(named(k % 3 != 1, "heart_rate"), named(k % 3 != 0, "consciousness"), named(k % 2 == 0, "measured_at")))
    log = tables.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), k.alias("seq"), fields.alias("set_fields"), F.when(k % 4 > 0, F.col("o_totalprice")).alias("heart_rate"),
        F.when(k % 5 > 0, F.col("o_orderstatus")).alias("consciousness"), F.col("o_orderdate").alias("measured_at"),
    )
    state = tables.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("visit_id"), F.col("ts").alias("measured_at"), F.col("value").alias("heart_rate"), F.col("event_type").alias("consciousness"))
    own = [f for f in schemas.PATCHABLE["vitals"] if f in state.columns]
    return changes.patched(state, changes.fold(log, own), own)


@query(with_roles("records") + """, f AS (SELECT o_custkey AS id, arg_max_null(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 4 <> 1) AS content, bool_or(o_orderkey % 4 <> 1) AS c,
arg_max_null(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, o_orderkey) FILTER (WHERE o_orderkey % 4 IN (1, 2)) AS confirmed_at, bool_or(o_orderkey % 4 IN (1, 2)) AS t FROM orders GROUP BY 1)
SELECT r.id, CASE WHEN coalesce(f.c, false) THEN f.content ELSE r.record_type END AS content, CASE WHEN coalesce(f.t, false) THEN f.confirmed_at ELSE r.confirmed_at END AS confirmed_at FROM records r LEFT JOIN f ON r.id = f.id""")
def updated_records(spark, sf):
    """Records after updates of content and of the confirmed flag: true, false, null and absent."""
    k = F.col("o_orderkey")
    fields = F.array_compact(F.array(F.when(k % 4 != 1, F.lit("content")), F.when((k % 4).isin(1, 2), F.lit("confirmed"))))
    flag = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    log = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), k.alias("seq"), F.col("o_orderdate").alias("at"), fields.alias("set_fields"), F.col("o_orderpriority").alias("content"), flag.alias("confirmed"))
    state = roles.records(spark, sf).select("id", F.col("record_type").alias("content"), "confirmed_at")
    return changes.patched(state, changes.fold(changes.confirmations(log), ["content", "confirmed_at"]), ["content", "confirmed_at"])


@query("""SELECT o_orderkey AS seq, o_custkey + 50 AS id, CASE WHEN c.c_custkey IS NULL THEN 404 END AS code FROM orders LEFT JOIN customer c ON o_custkey + 50 = c.c_custkey""")
def update_unknown(spark, sf):
    log = patient_patches(spark, sf).select("seq", "id", F.array().cast("array<string>").alias("set_fields"))
    return changes.judged_patches(roles.patients(spark, sf).select("id"), log, "patients", []).select("seq", "id", "code")


@query("""WITH log AS (SELECT o_orderkey % 3 AS batch, o_orderkey AS seq, o_custkey AS id, o_orderstatus AS status FROM orders)
SELECT id, arg_max(status, seq) AS status, max(seq) AS last_seq, count(*) AS n_commands, count(DISTINCT batch) AS n_batches FROM log GROUP BY 1""")
def committed_state(spark, sf):
    """Three batches are committed to a log, one of them twice, and the state is read back from it."""
    log = tables.table(spark, sf, "orders").select((F.col("o_orderkey") % 3).alias("batch"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"))
    kept = versions.Versions(spark, scratch.new_path(spark, "commands"), log.schema)
    for k in (0, 1, 2, 1):
        kept.commit(log.where(F.col("batch") == k), k)
    return kept.tail().groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("last_seq"), F.count("*").alias("n_commands"), F.count_distinct("batch").alias("n_batches"))


def last_of(before: DataFrame, batches: DataFrame) -> DataFrame:
    """A snapshot and the batches after it as one row for each key; sums combine before the shuffle."""
    both = before.unionByName(batches)
    return both.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.sum("n").alias("n"))


@query("""SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def snapshot_and_tail(spark, sf):
    """Five batches: two are folded into a snapshot, two more follow it, and so does a late first one; the state is snapshot
    and tail together."""
    log = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"), F.lit(1).cast("long").alias("n"))
    kept = versions.Versions(spark, scratch.new_path(spark, "versions"), log.schema)
    batch = lambda k: log.where(F.col("seq") % 5 == k)
    for k in (1, 2):
        kept.commit(batch(k), k)
    kept.compact(last_of)
    for k in (3, 4, 0, 3):
        kept.commit(batch(k), k)
    return kept.state(last_of)


def commands(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts, patches and deletes of patients in one log; a third of them are of one patient."""
    k = F.col("o_orderkey")
    op = F.when((k % 5).isin(0, 1), "insert").when(k % 5 == 2, "delete").otherwise("patch")
    names = F.when(k % 4 == 1, F.array(F.lit("gender"))).when(k % 4 == 2, F.array(F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("gender")))
    name = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.repeat(F.col("o_orderpriority"), F.lit(20))).otherwise(F.col("o_orderpriority"))
    return tables.table(spark, sf, "orders").select(
        F.when(k % 3 == 0, F.lit(77).cast("long")).otherwise(F.col("o_custkey") + 50).alias("number"), k.alias("seq"), op.alias("op"), names.alias("set_fields"),
        name.alias("name"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("gender"), (k % 13 == 0).alias("held"),
    )


COMMANDS_SQL = """WITH log AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 77 ELSE o_custkey + 50 END AS number, o_orderkey AS seq, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'insert' WHEN o_orderkey % 5 = 2 THEN 'delete' ELSE 'patch' END AS op,
  o_orderkey % 4 <> 1 AS n, o_orderkey % 4 <> 2 AS g, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN repeat(o_orderpriority, 20) ELSE o_orderpriority END AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS gender, o_orderkey % 13 = 0 AS held FROM orders),
e AS (SELECT *, name IS NULL OR length(name) > 100 OR coalesce(length(gender) > 20, false) AS bad, n AND (name IS NULL OR length(name) > 100) OR g AND coalesce(length(gender) > 20, false) AS bad_patch FROM log),
s AS (SELECT e.*, coalesce(last_value(CASE WHEN op = 'insert' AND NOT bad THEN true WHEN op = 'delete' AND NOT held THEN false END IGNORE NULLS)
  OVER (PARTITION BY number ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c.c_custkey IS NOT NULL) AS there FROM e LEFT JOIN customer c ON e.number = c.c_custkey),
judged AS (SELECT *, CASE op WHEN 'insert' THEN CASE WHEN bad THEN 422 WHEN there THEN 409 END WHEN 'patch' THEN CASE WHEN NOT there THEN 404 WHEN bad_patch THEN 422 END
  ELSE CASE WHEN NOT there THEN 404 WHEN held THEN 409 END END AS code FROM s)
"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    state = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("number"))
    checks, patches = changes.constraint_checks("patients", ["name", "gender"]), changes.patch_checks("patients", ["name", "gender"])
    return changes.replayed(state, commands(spark, sf), checks, patches, "number", held=F.col("held"))


@query(COMMANDS_SQL + "SELECT number, seq, op, code FROM judged")
def command_log(spark, sf):
    """Every command with its code, judged by what those before it have left."""
    return _judged(spark, sf).select("number", "seq", "op", "code")


@query(COMMANDS_SQL + """, f AS (SELECT number, arg_max(op, seq) FILTER (WHERE op <> 'patch') AS last_op, arg_max_null(name, seq) FILTER (WHERE op = 'insert' OR op = 'patch' AND n) AS name, bool_or(op = 'insert' OR op = 'patch' AND n) AS n,
  arg_max_null(gender, seq) FILTER (WHERE op = 'insert' OR op = 'patch' AND g) AS gender, bool_or(op = 'insert' OR op = 'patch' AND g) AS g FROM judged WHERE code IS NULL GROUP BY 1)
SELECT coalesce(f.number, c.c_custkey) AS number, CASE WHEN coalesce(f.n, false) THEN f.name ELSE c.c_name END AS name, CASE WHEN coalesce(f.g, false) THEN f.gender ELSE c.c_mktsegment END AS gender
FROM customer c FULL JOIN f ON c.c_custkey = f.number WHERE coalesce(f.last_op = 'insert', c.c_custkey IS NOT NULL)""")
def command_log_state(spark, sf):
    """Patients as the whole log leaves them."""
    state = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("gender"))
    return changes.state_after(state, _judged(spark, sf), ["name", "gender"], "number")


@query(COMMANDS_SQL + """SELECT number, count(*) FILTER (WHERE code IS NULL) AS n_accepted, count(code) AS n_refused, min(seq) FILTER (WHERE code IS NOT NULL) AS first_refused, arg_min(code, seq) FILTER (WHERE code IS NOT NULL) AS first_code
FROM judged GROUP BY 1""")
def first_refusals(spark, sf):
    return changes.refusals(_judged(spark, sf), "number")


@query("""WITH log AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'patch' END AS op FROM orders),
gone AS (SELECT id, min(seq) AS g FROM log WHERE op = 'delete' GROUP BY 1) SELECT l.id, l.seq, l.op, CASE WHEN l.seq > g.g THEN 404 END AS code FROM log l LEFT JOIN gone g ON l.id = g.id""")
def commands_after_delete(spark, sf):
    op = F.when(F.col("o_orderkey") % 11 == 0, "delete").otherwise("patch")
    return changes.after_deletes(tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), op.alias("op")))


@query(with_roles("patients", "visits") + """, asked AS (SELECT o_orderkey AS seq, o_custkey + 20 AS id FROM orders)
SELECT a.seq, a.id, CASE WHEN p.id IS NULL THEN 404 WHEN a.id IN (SELECT patient_id FROM visits) THEN 409 WHEN row_number() OVER (PARTITION BY a.id ORDER BY a.seq) > 1 THEN 404 END AS code FROM asked a LEFT JOIN patients p ON a.id = p.id""")
def delete_restrict(spark, sf):
    """Patients with any visit stay; of others the first delete is accepted and the next ones find no row."""
    asked = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") + 20).alias("id"))
    return changes.delete(roles.patients(spark, sf), asked, roles.visits(spark, sf), "patient_id")


@query(with_roles("vitals") + "SELECT visit_id, count(*) AS n FROM vitals WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') GROUP BY 1")
def delete_apply(spark, sf):
    gone = tables.table(spark, sf, "events").where(F.col("event_type") == "error").select(F.col("event_id").alias("id"))
    return changes.surviving(roles.vitals(spark, sf), gone).groupBy("visit_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_actions FROM events WHERE event_type = 'click' GROUP BY 1")
def alert_actions(spark, sf):
    done = tables.table(spark, sf, "events").where(F.col("event_type") == "click").select("user_id", "ts", "event_id")
    return changes.latest(done, ["user_id"], "ts", ["event_id"], "event_id")


# Views ----------------------------------------------------------------------------------------------------------------


@query(with_roles("visits", "predictions") + f""", highest AS (SELECT visit_id, max(percent) AS percent FROM predictions GROUP BY 1)
SELECT v.id, strftime(v.arrival_time, '%Y-%m-%d') AS day, v.status, 'Your care team is watching your condition.' AS message FROM visits v JOIN highest h ON v.id = h.visit_id WHERE {TIER_SQL} <> 'stable'""")
def patient_safe_view(spark, sf):
    at_risk = roles.predictions(spark, sf).groupBy("visit_id").agg(F.max("percent").alias("percent")).where(clinical.tier(F.col("percent")) != clinical.LOWEST_TIER).select(F.col("visit_id").alias("id"))
    # an allow-list: no score, no measurement
    return roles.visits(spark, sf).join(at_risk, "id", "left_semi").select("id", F.date_format("arrival_time", "yyyy-MM-dd").alias("day"), "status", F.lit("Your care team is watching your condition.").alias("message"))


@query(with_roles("visits", "predictions", "records") + f""", highest AS (SELECT visit_id, max(percent) AS percent FROM predictions GROUP BY 1),
risks AS (SELECT v.id, {TIER_SQL} AS risk FROM visits v JOIN highest h ON v.id = h.visit_id),
r AS (SELECT count(*) AS total, count(*) FILTER (WHERE risk = 'critical') AS critical, count(*) FILTER (WHERE risk = 'rising') AS rising FROM risks),
i AS (SELECT count(*) FILTER (WHERE confirmed_at IS NULL) AS incomplete FROM records), a AS (SELECT count(*) AS alerts FROM events WHERE event_type = 'error')
SELECT total, critical, rising, critical + rising AS at_risk, incomplete, alerts FROM r, i, a""")
def kpi_summary(spark, sf):
    highest = roles.predictions(spark, sf).groupBy("visit_id").agg(F.max("percent").alias("percent"))
    v = roles.visits(spark, sf).select("id")
    risk = clinical.tier(F.col("percent"))
    counted = v.join(highest, v["id"] == highest["visit_id"]).agg(F.count("*").alias("total"), F.count_if(risk == "critical").alias("critical"), F.count_if(risk == "rising").alias("rising"))
    incomplete = roles.records(spark, sf).agg(F.count_if(F.col("confirmed_at").isNull())).scalar()
    alerts = tables.table(spark, sf, "events").where(F.col("event_type") == "error").agg(F.count("*")).scalar()
    return counted.select("total", "critical", "rising", (F.col("critical") + F.col("rising")).alias("at_risk"), incomplete.alias("incomplete"), alerts.alias("alerts"))


@query(with_roles("visits") + """SELECT id, triage_level, arrival_time, arrival_time + INTERVAL 1 HOUR * triage_level AS due, row_number() OVER (PARTITION BY triage_level, CAST(arrival_time AS DATE) ORDER BY arrival_time, id) AS position
FROM visits WHERE status = 'active'""")  # fmt: skip
def reassess_queue(spark, sf):
    active = reads.optional_filter(roles.visits(spark, sf), "status", "active")
    due = F.col("arrival_time") + F.make_dt_interval(hours=F.col("triage_level"))
    daily = active.withColumn("day", F.to_date("arrival_time"))
    ranked = reads.positioned(daily, reads.by_time("arrival_time", "id", newest_first=False), [F.col("arrival_time"), F.col("id")], within=["triage_level", "day"])
    return ranked.select("id", "triage_level", "arrival_time", due.alias("due"), "position")


@query("""SELECT event_id AS id, user_id, strftime(ts, '%H:%M') AS time, CASE WHEN value >= 400 THEN 'critical' WHEN value >= 200 THEN 'rising' WHEN value >= 100 THEN 'watch' ELSE 'stable' END AS level,
row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position FROM events WHERE event_type = 'error'""")
def alerts_newest_first(spark, sf):
    own = tables.table(spark, sf, "events").where(F.col("event_type") == "error")
    level = clinical.tier(F.col("value"), (("critical", 400), ("rising", 200), ("watch", 100)))
    placed = reads.positioned(own, reads.by_time("ts", "event_id"), [F.col("ts").desc(), F.col("event_id").desc()])
    return placed.select(F.col("event_id").alias("id"), "user_id", clinical.hhmm(F.col("ts")).alias("time"), level.alias("level"), "position")


@query("""WITH p AS (SELECT l_orderkey AS visit_id, l_shipdate AS at, max(CAST(round(l_discount * 1000) AS INTEGER)) AS percent FROM lineitem GROUP BY ALL)
SELECT v.o_orderkey AS id, v.o_orderdate AS arrival_time, (SELECT p.percent FROM p WHERE p.visit_id = v.o_orderkey AND p.at <= v.o_orderdate ORDER BY p.at DESC LIMIT 1) AS percent FROM orders v""")
def prediction_as_of(spark, sf):
    """Beyond the reference: the latest prediction at or before a moment."""
    p = roles.predictions(spark, sf).groupBy("visit_id", F.col("predicted_at").alias("at")).agg(F.max("percent").alias("percent"))
    v = roles.visits(spark, sf).select(F.col("id").alias("visit_id"), F.col("arrival_time").alias("at"))
    return reads.as_of(v, p, "visit_id", "at", "percent").select(F.col("visit_id").alias("id"), F.col("at").alias("arrival_time"), "percent")


# Time ----------------------------------------------------------------------------------------------------------------


STAYS_SQL = with_roles("vitals") + """, stays AS (SELECT event_id AS stay, user_id AS visit_id, ts AS begins, CASE WHEN event_id % 9 <> 0 THEN ts + to_hours(CAST(floor(value / 3) AS INTEGER)) END AS ends FROM events WHERE event_type = 'signup')
"""


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """Stays of a visit's key, overlapping ones, empty ones and open ones among them."""
    hours = F.make_dt_interval(hours=F.floor(F.col("value") / 3).cast("int"))
    begun = tables.table(spark, sf, "events").where(F.col("event_type") == "signup")
    return begun.select(F.col("event_id").alias("stay"), F.col("user_id").alias("visit_id"), F.col("ts").alias("begins"), F.when(F.col("event_id") % 9 != 0, F.col("ts") + hours).alias("ends"))


@query(STAYS_SQL + "SELECT v.id, v.visit_id, v.metric, s.stay FROM vitals v JOIN stays s ON v.visit_id = s.visit_id AND v.measured_at >= s.begins AND (s.ends IS NULL OR v.measured_at < s.ends)")
def vitals_within_stays(spark, sf):
    """Every measurement with each stay that holds it."""
    measured = roles.vitals(spark, sf).select("id", "visit_id", "metric", "measured_at")
    return intervals.within(measured, stays(spark, sf), "visit_id", "measured_at", "begins", "ends", ["stay"]).select("id", "visit_id", "metric", "stay")


@query(STAYS_SQL + """SELECT s.stay, count(v.id) AS n, min(v.measured_at) AS first_at, max(v.measured_at) AS last_at FROM stays s LEFT JOIN vitals v ON v.visit_id = s.visit_id AND v.measured_at >= s.begins AND (s.ends IS NULL OR v.measured_at < s.ends) GROUP BY 1""")
def stay_coverage(spark, sf):
    """How many measurements each stay holds, stays without any included."""
    held = intervals.within(roles.vitals(spark, sf).select("id", "visit_id", "measured_at"), stays(spark, sf), "visit_id", "measured_at", "begins", "ends", ["stay"])
    counted = held.groupBy("stay").agg(F.count("*").alias("__n"), F.min("measured_at").alias("first_at"), F.max("measured_at").alias("last_at"))
    return stays(spark, sf).select("stay").join(counted, "stay", "left").select("stay", F.coalesce("__n", F.lit(0)).cast("long").alias("n"), "first_at", "last_at")


def _runs_sql(sign: str) -> str:
    return with_roles("vitals") + f""", o AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS nth FROM vitals WHERE value IS NOT NULL WINDOW w AS (PARTITION BY visit_id, metric ORDER BY measured_at, id)),
g AS (SELECT *, sum(CASE WHEN value {sign} before THEN 0 ELSE 1 END) OVER (PARTITION BY visit_id, metric ORDER BY nth) AS run FROM o)
SELECT visit_id, metric, min(measured_at) AS from_time, max(measured_at) AS to_time, count(*) AS n, arg_min(value, nth) AS first_value, arg_max(value, nth) AS last_value FROM g GROUP BY visit_id, metric, run HAVING count(*) >= 3"""


@query("""WITH t AS (SELECT user_id AS visit_id, event_id AS id, ts AS scored_at, CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'rising' WHEN value >= 30 THEN 'watch' ELSE 'stable' END AS tier FROM events WHERE value IS NOT NULL),
o AS (SELECT *, lag(tier) OVER (PARTITION BY visit_id ORDER BY scored_at, id) AS tier_before FROM t) SELECT visit_id, id, scored_at, tier, tier_before FROM o WHERE tier IS DISTINCT FROM tier_before""")
def tier_transitions(spark, sf):
    """Every score of a visit that puts it into another tier than the score before."""
    scored = tables.table(spark, sf, "events").select(F.col("user_id").alias("visit_id"), F.col("event_id").alias("id"), F.col("ts").alias("scored_at"), clinical.tier(F.col("value")).alias("tier"))
    return trends.transitions(scored, "visit_id", "scored_at", "id", "tier")


@query(_runs_sql(">"))
def sustained_rises(spark, sf):
    """Three or more measurements of a kind in turn, each above the one before."""
    return trends.sustained(roles.vitals(spark, sf), ["visit_id", "metric"], "measured_at", "id", "value")


@query(_runs_sql("<"))
def sustained_falls(spark, sf):
    return trends.sustained(roles.vitals(spark, sf), ["visit_id", "metric"], "measured_at", "id", "value", rising=False)


@query(with_roles("vitals") + """SELECT visit_id, id, measured_at, count(cents) OVER w AS n, CAST(sum(cents) OVER w AS DOUBLE) / nullif(count(cents) OVER w, 0) AS mean, min(cents) OVER w AS lowest, max(cents) OVER w AS highest
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM vitals) WINDOW w AS (PARTITION BY visit_id ORDER BY measured_at RANGE BETWEEN INTERVAL 4 HOURS PRECEDING AND CURRENT ROW)""")
def last_four_hours(spark, sf):
    """Mean and extremes, in hundredths, of a visit's values in the four hours up to each measurement."""
    cents = roles.vitals(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    found = trends.recent(cents, "visit_id", "measured_at", "id", "cents")
    return found.select("visit_id", "id", "measured_at", "n", trends.mean(F.col("total"), F.col("n")).alias("mean"), "lowest", "highest")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 3 HOURS THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS from_time, max(ts) + INTERVAL 3 HOURS AS to_time, count(*) AS n FROM g GROUP BY user_id, s""")
def activity_sessions(spark, sf):
    """Events of a user at most three hours apart, as sessions."""
    return summaries.sessions(tables.table(spark, sf, "events"), ["user_id"], "ts", "3 hours")


# Summaries ------------------------------------------------------------------------------------------------------------


@query(with_roles("beds") + """, b AS (SELECT zone, CASE WHEN bed_id % 10 > 0 THEN ward END AS ward, status FROM beds)
SELECT zone, ward, status, CAST(grouping(zone, ward, status) AS INTEGER) AS level, count(*) AS n FROM b GROUP BY GROUPING SETS ((zone, ward, status), (zone, ward), (zone, status), (zone), (status), ())""")
def bed_subtotals(spark, sf):
    """Beds with all their subtotals; a bed without a ward is no subtotal over wards."""
    unassigned = roles.beds(spark, sf).withColumn("ward", F.when(F.col("bed_id") % 10 > 0, F.col("ward")))
    return summaries.subtotals(unassigned, ["zone", "ward", "status"], [["zone", "ward", "status"], ["zone", "ward"], ["zone", "status"], ["zone"], ["status"], []], F.count("*").alias("n"))


@query("""WITH spans(days) AS (VALUES (1), (7), (30)), e AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, value FROM events), t AS (SELECT max(day) AS today FROM e),
x AS (SELECT e.event_type, s.days, count(DISTINCT user_id) AS users, count(*) AS n FROM e, t, spans s WHERE day > today - s.days GROUP BY ALL)
SELECT event_type, CAST(days AS INTEGER) AS days, users, n, true AS users_within, true AS median_within FROM x""")
def activity_sketches(spark, sf):
    """Users and median value of the last day, week and month from stored daily sketches, beside the exact counts: whether the
    error is within what the sketches promise."""
    events = tables.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    path = scratch.new_path(spark, "sketches")
    summaries.daily_sketches(events, ["event_type", "day"], "user_id", "value").write.parquet(path)
    found = summaries.compared(events, spark.read.parquet(path), ["event_type"], "day", "user_id", "value", (1, 7, 30))
    return found.select("event_type", "days", "users", "n", "users_within", "median_within")


@query("""WITH a AS (SELECT o_custkey AS id, o_orderstatus AS status, substr(o_orderpriority, 1, 1) AS level, count(*) AS n FROM orders WHERE o_orderkey % 4 > 0 GROUP BY ALL),
b AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 10 > 0 THEN o_orderstatus END AS status, substr(o_orderpriority, 1, 1) AS level, count(*) AS n FROM orders WHERE o_orderkey % 4 < 3 GROUP BY ALL)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN a.status ELSE b.status END AS status, CASE WHEN a.id IS NOT NULL THEN a.level ELSE b.level END AS level, coalesce(b.n, 0) - coalesce(a.n, 0) AS n_more
FROM a FULL JOIN b ON a.id = b.id AND a.status IS NOT DISTINCT FROM b.status AND a.level IS NOT DISTINCT FROM b.level WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def version_difference(spark, sf):
    """Rows that one version of a table has more or less often than another, repeats counted."""
    k, own = F.col("o_orderkey"), tables.table(spark, sf, "orders")
    rows = lambda status: (F.col("o_custkey").alias("id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).alias("level"))
    before, after = own.where(k % 4 > 0).select(*rows(F.col("o_orderstatus"))), own.where(k % 4 < 3).select(*rows(F.when(k % 10 > 0, F.col("o_orderstatus"))))
    return summaries.difference(before, after)


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 6 > 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'gone' ELSE 'changed' END AS kind,
CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END) END AS fields
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status IS DISTINCT FROM b.status OR a.price IS DISTINCT FROM b.price""")
def changed_rows(spark, sf):
    """Rows added, gone, and changed with the names of the fields, between two versions with a key."""
    k, own = F.col("o_orderkey"), tables.table(spark, sf, "orders")
    before = own.where(k % 5 > 0).select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    after = own.where(k % 6 > 0).select(k.alias("id"), F.when(k % 3 > 0, F.col("o_orderstatus")).alias("status"), F.when(k % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"))
    changed = summaries.changes_by_key(before, after, ["id"])
    return changed.select("id", "kind", F.array_join("fields", ",").alias("fields"))


assert set(schemas.PATCHABLE) < set(schemas.DDL)
