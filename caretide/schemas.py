"""Schemas of the five stored tables and of the nested documents, and what a row must satisfy to be stored."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, types and lengths of the stored columns.
DDL = {
    "patients": "id BIGINT NOT NULL, patient_number STRING NOT NULL, name STRING NOT NULL, birth_date DATE, gender STRING, created_at TIMESTAMP_NTZ NOT NULL",
    "visits": "id BIGINT NOT NULL, patient_id BIGINT NOT NULL, arrival_time TIMESTAMP_NTZ NOT NULL, triage_level INT, chief_complaint STRING, status STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL",
    "vitals": "id BIGINT NOT NULL, visit_id BIGINT NOT NULL, measured_at TIMESTAMP_NTZ NOT NULL, heart_rate DOUBLE, respiratory_rate DOUBLE, systolic_bp DOUBLE, diastolic_bp DOUBLE, temperature DOUBLE, spo2 DOUBLE, consciousness STRING",
    "predictions": "id BIGINT NOT NULL, visit_id BIGINT NOT NULL, predicted_at TIMESTAMP_NTZ NOT NULL, risk_score DOUBLE NOT NULL, risk_level STRING NOT NULL, prediction_horizon INT, risk_factors STRING",
    "records": "id BIGINT NOT NULL, visit_id BIGINT NOT NULL, record_type STRING NOT NULL, content STRING NOT NULL, generated_by STRING, created_at TIMESTAMP_NTZ NOT NULL, confirmed_at TIMESTAMP_NTZ",
}
MAX_LENGTH = {
    "patients": {"patient_number": 50, "name": 100, "gender": 20},
    "visits": {"status": 30},
    "vitals": {"consciousness": 50},
    "predictions": {"risk_level": 30},
    "records": {"record_type": 50, "generated_by": 50},
}
PATCHABLE = {
    "patients": ("name", "birth_date", "gender"),
    "visits": ("triage_level", "chief_complaint", "status"),
    "vitals": ("measured_at", "heart_rate", "respiratory_rate", "systolic_bp", "diastolic_bp", "temperature", "spo2", "consciousness"),
    "records": ("content", "confirmed"),
}
VITAL_POINT = "slot INT, label STRING, hr INT, sbp INT, dbp INT, spo2 INT, bt DOUBLE, probability INT"
PATIENT_DOCUMENT = (
    "id STRING, sex STRING, age INT, arrived_at STRING, ktas INT, chief_complaint STRING, risk STRING, probability INT, bed STRING, record_status STRING, "
    "vitals STRUCT<hr: INT, rr: INT, sbp: INT, dbp: INT, bt: DOUBLE, spo2: INT, mental: STRING>, "
    "trend ARRAY<STRUCT<slot: INT, label: STRING, hr: INT, sbp: INT, dbp: INT, spo2: INT, bt: DOUBLE, probability: INT>>, risk_factors ARRAY<STRING>, recommendations ARRAY<STRING>"
)
BED_ZONE = "zone STRING, beds ARRAY<STRUCT<id: STRING, status: STRING, age: INT, sex: STRING, devices: ARRAY<STRING>, patient_id: STRING>>"


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def required(table: str) -> list[str]:
    return [f.name for f in schema(table).fields if not f.nullable and f.name != "id"]
