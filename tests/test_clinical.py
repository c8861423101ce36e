"""Rules worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caretide.functions import clinical


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("percent", "expected"), [(87, "critical"), (80, "critical"), (79, "rising"), (68, "rising"), (60, "rising"), (59, "watch"), (34, "watch"), (30, "watch"), (29, "stable"), (12, "stable"), (None, None)])
def test_tier(spark, percent, expected):
    assert one(spark, t=clinical.tier(F.lit(percent).cast("int"))).t == expected


@pytest.mark.parametrize(
    ("values", "bad"),
    [
        ((118, 26, 88, 37.8, 91), "hr rr bp bt spo2"),
        ((104, 24, 132, 37.4, 93), "hr rr spo2"),
        ((100, 20, 100, 37.5, 94), "bt"),
        ((50, 10, 160, 36.0, 94), ""),
        ((None, None, None, None, None), ""),
    ],
)
def test_abnormal(spark, values, bad):
    flags = clinical.abnormal(*[F.lit(v).cast("double") for v in values])
    row = one(spark, **flags)
    assert {n.removesuffix("_abnormal") for n in flags if row[n]} == set(bad.split())


@pytest.mark.parametrize(("value", "expected"), [(None, "missing"), ("", "missing"), (" \t　﻿\n", "missing"), (" N/A ", "missing"), ("N/A?", "complete"), ("statement", "review"), ("fine", "complete")])
def test_field_status(spark, value, expected):
    assert one(spark, s=clinical.field_status(F.lit(value).cast("string"), "N/A", "ement")).s == expected


@pytest.mark.parametrize(("value", "expected"), [(" 미확인\u3000", "missing"), ("미확인 항목", "complete"), ("용량 확인 필요함", "review"), ("improvement", "complete"), ("N/A", "complete")])
def test_field_status_by_default(spark, value, expected):
    assert one(spark, s=clinical.field_status(F.lit(value))).s == expected


@pytest.mark.parametrize(("missing", "review", "generated", "score"), [(3, 2, True, 78), (11, 0, True, 45), (0, 1, True, 97), (1, 0, True, 95), (30, 0, True, 0), (0, 0, False, 0)])
def test_completeness(spark, missing, review, generated, score):
    assert one(spark, s=clinical.completeness(F.lit(missing), F.lit(review), F.lit(generated))).s == score


@pytest.mark.parametrize(("score", "ok"), [(-0.01, False), (0.0, True), (1.0, True), (1.01, False), (None, False), (float("nan"), False)])
def test_valid_score(spark, score, ok):
    assert one(spark, v=clinical.valid_score(F.lit(score).cast("double"))).v is ok


def test_defaults_and_confirmation(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    row = one(
        spark, a=clinical.or_blank(F.lit(""), "x"), b=clinical.or_null(F.lit(""), "x"), c=clinical.without_sentinel(F.lit("N/A"), "N/A"),
        t=clinical.confirmed_at(F.lit(True), now), f=clinical.confirmed_at(F.lit(False), now), n=clinical.confirmed_at(F.lit(None).cast("boolean"), now),
        s1=clinical.record_status(F.lit(True), F.lit(True), F.lit("kept")), s2=clinical.record_status(F.lit(None).cast("boolean"), F.lit(True), F.lit("kept")), s3=clinical.record_status(F.lit(False), F.lit(False), F.lit("kept")),
    )
    assert (row.a, row.b, row.c, row.s1, row.s2, row.s3) == ("x", "", "", "certified", "in progress", "kept")
    assert row.t is not None and row.f is None and row.n is None
