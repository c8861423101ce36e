"""Reads, nested documents, records and changes on tiny tables."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caretide import schemas
from caretide.functions import dims
from caretide.operators import changes, nested, reads, records
from caretide.sources import session, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_positions_follow_the_order_over_all_cells(spark):
    df = spark.range(0, 5000, 7).withColumn("v", F.col("id") % 13)
    placed = reads.positioned(df, -F.col("v") * 100 + F.floor(F.col("id") / 1000), [F.col("v").desc(), F.col("id")])
    got = {r.id: r.position for r in placed.collect()}
    expected = sorted((i for i in range(0, 5000, 7)), key=lambda i: (-(i % 13), i))
    assert [got[i] for i in expected] == list(range(1, len(expected) + 1))
    assert reads.positioned(df.limit(0), F.col("id"), [F.col("id")]).count() == 0


def test_large_ids_stay_in_their_percent(spark):
    ids = [4_097_000_000, 5_000_000_000, 10, 20, 2**34, 2**34 + 1]
    df = spark.createDataFrame([(i, 95 if i > 20 else 94) for i in ids], "id long, percent int")
    placed = reads.positioned(df, [-F.col("percent"), *reads.by_id("id")], [F.col("percent").desc(), F.col("id")])
    assert [r.id for r in placed.orderBy("position").collect()] == sorted(ids, key=lambda i: (i <= 20, i))


def test_one_moment_may_hold_all_rows(spark):
    ids = [k * 300_000 for k in range(40)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("at", F.lit("2024-03-10 02:30:00").cast("timestamp_ntz"))
    placed = reads.positioned(df, reads.by_time("at", "id"), [F.col("at").desc(), F.col("id").desc()])
    assert [r.id for r in placed.orderBy("position").collect()] == ids[::-1]
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("newest_first", [True, False])
def test_moments_within_groups(spark, newest_first):
    rng = random.Random(3)
    rows_ = [(i, rng.choice(["a", None]), rng.choice(["2024-03-10 02:30:00", "2024-03-10 02:30:00.000001", "2024-03-10 03:10:59.5", "1969-12-31 23:59:59.999999"])) for i in range(200)]
    df = spark.createDataFrame(rows_, "id long, g string, t string").withColumn("at", F.col("t").cast("timestamp_ntz"))
    order = [F.col(c).desc() if newest_first else F.col(c) for c in ("at", "id")]
    placed = reads.positioned(df, reads.by_time("at", "id", newest_first), order, within=["g"])
    got = {r.id: r.position for r in placed.collect()}
    for g in ("a", None):
        own = sorted((r for r in rows_ if r[1] == g), key=lambda r: (r[2].ljust(26, "0") if "." in r[2] else r[2] + ".000000", r[0]), reverse=newest_first)
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_as_of_against_a_search(spark):
    rng = random.Random(8)
    moment = lambda: datetime(2024, 1, rng.randint(1, 4), rng.randint(0, 3), rng.choice([0, 30]))
    known = {(k, moment()): rng.choice([None, *range(9)]) for k in range(3) for _ in range(12)}
    asked = [*((n, rng.randrange(4), moment()) for n in range(58)), (58, None, moment()), (59, 1, None)]
    found = reads.as_of(spark.createDataFrame(asked, "n int, k int, at timestamp_ntz"), spark.createDataFrame([(*key, v) for key, v in known.items()], "k int, at timestamp_ntz, v int"), "k", "at", "v")
    got = {r.n: r.v for r in found.collect()}
    assert len(got) == 60
    for n, k, at in asked:
        before = [t for key, t in known if key == k and at and t <= at]
        assert got[n] == (known[k, max(before)] if before else None)


def test_missing_parent_is_not_an_empty_list(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    kids = spark.createDataFrame([(10, 1)], "id long, parent long")
    assert rows(reads.children(parents, kids, 1, "parent"), "id", "found") == [(10, True)]
    assert rows(reads.children(parents, kids, 2, "parent"), "id", "found") == []
    assert [tuple(r) for r in reads.children(parents, kids, 3, "parent").select("id", "found").collect()] == [(None, False)]


def test_optional_filter(spark):
    df = spark.createDataFrame([("active",), ("closed",)], "status string")
    assert [reads.optional_filter(df, "status", v).count() for v in (None, "", "active", "ACTIVE")] == [2, 2, 1, 0]


def test_filter_reaches_the_scan(spark, small):
    plan = reads.by_key(tables.table(spark, small, "orders"), o_orderkey=3).select("o_orderkey")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,3)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_nested_round_trip(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "zone string, bed long, status string")
    board = nested.gathered(df, ["zone"], "bed", ["status"], "beds")
    assert sorted(tuple(r) for r in nested.flatten(board, "beds", ["bed", "status"], ["zone"]).select("zone", "ordinal", "bed", "status").collect()) == [("a", 1, 1, "y"), ("a", 2, 2, "x"), ("b", 1, 5, None)]


def test_matrix(spark):
    points = spark.createDataFrame([(1, s, p) for s, p in enumerate((42, 51, 65, 76, 87))], "id long, slot int, probability int").withColumn("hr", F.lit(None).cast("int"))
    got = {r.metric: [r[str(k)] for k in range(5)] for r in nested.matrix(points, ["id"], "slot", list(range(5)), ["probability", "hr"]).collect()}
    assert got == {"probability": [42, 51, 65, 76, 87], "hr": [None] * 5}


NAMES = ["chief", "pain", "present", "past", "medication", "allergy", "social", "systems", "exam", "impression", "outcome"]


def record(spark, **values):
    return spark.createDataFrame([(1, n, values.get(n, "ok")) for n in NAMES], "rec_id long, field string, value string")


def summary(spark, **values):
    return records.summary(records.statuses(record(spark, **values), NAMES, ("impression",), None, "N/A", "ement")).first()


def test_draft_golden(spark):
    """By default arguments: six complete, two to confirm, three missing, and the gate to the third step shut."""
    told = dict(zip(dims.FIELDS, ["ok"] * 11)) | {"medication": "확인 필요", "allergy": "종류 확인 필요", "socialHistory": "미확인", "physicalExam": " ", "outcome": None}
    fields = spark.createDataFrame([(1, f, v) for f, v in told.items()], "rec_id long, field string, value string")
    status = records.statuses(fields, dims.FIELDS, dims.OPTIONAL_FIELDS)
    assert {s: {r.field for r in status.collect() if r.status == s} for s in ("missing", "review")} == {"missing": {"socialHistory", "physicalExam", "outcome"}, "review": {"medication", "allergy"}}
    r = records.summary(status).first()
    assert (r.score, r.gate_open, r.first_missing, r.n_complete) == (78, False, "socialHistory", 6)


def test_the_last_value_of_a_field_counts(spark):
    fields = spark.createDataFrame([(1, 1, "a", "x"), (1, 9, "a", None), (1, 2, "b", None), (1, 12, "b", "y")], "rec_id long, seq long, field string, value string")
    assert {r.field: r.status for r in records.statuses(fields, ["a", "b"], seq="seq").collect()} == {"a": "missing", "b": "complete"}


def test_draft_record(spark):
    r = summary(spark, medication="ement", allergy="statement", social="N/A", exam="", outcome=None)
    assert (r.score, r.n_missing, r.n_review, r.gate_open, r.first_missing, r.missing_fields) == (78, 3, 2, False, "social", "social, exam, outcome")


def test_blank_records(spark):
    r = summary(spark, impression="")
    assert (r.score, r.gate_open, r.first_missing, r.missing_fields) == (95, True, None, "")
    r = summary(spark, **dict.fromkeys(NAMES, ""))
    assert (r.score, r.n_required_missing) == (45, 10)
    assert summary(spark, pain="ement").score == 97


def test_gates_need_all_before(spark):
    step = lambda *a: spark.range(1).select(records.reachable(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in a]).alias("s")).first().s
    assert step(True, True, True, 0, "K1", True) == 5
    assert step(True, True, True, 0, "K1", False) == 4
    assert step(True, True, True, 0, None, True) == 3
    assert step(True, True, True, 1, "K1", True) == 2
    assert step(True, True, False, 0, "K1", True) == 2
    assert step(False, True, True, 0, "K1", True) == 1


def test_regenerating_overwrites_edits(spark):
    edits = spark.createDataFrame([(1, 1, "a", "old"), (1, 5, "a", "new"), (1, 2, "b", "lost"), (2, 1, "a", "kept")], "rec_id long, seq long, field string, value string")
    drafts = spark.createDataFrame([(1, 3)], "rec_id long, seq long")
    assert rows(records.current_values(edits, drafts), "rec_id", "field", "value") == [(1, "a", "new"), (2, "a", "kept")]


def test_insert_unique(spark):
    state = spark.createDataFrame([("p1",)], "k string")
    batch = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p2"), (4, None)], "seq long, k string")
    judged = changes.insert_unique(state, batch, "k")
    assert {r.seq: r.code for r in judged.collect()} == {1: 409, 2: None, 3: 409, 4: 422}
    named = spark.createDataFrame([(1, "p5", None), (2, "p5", "x"), (3, "p5", "y"), (4, "p1", None)], "seq long, k string, name string")
    judged = changes.insert_unique(state, named, "k", (F.col("name").isNull(), changes.MALFORMED))
    assert {r.seq: r.code for r in judged.collect()} == {1: 422, 2: None, 3: 409, 4: 422}  # a refused insert leaves its key free


def test_missing_parent_comes_before_bad_score(spark):
    parents = spark.createDataFrame([(1,)], "id long")
    batch = spark.createDataFrame([(1, 1, 0.5), (2, 1, 1.5), (3, 9, 1.5)], "seq long, visit_id long, score double")
    judged = changes.insert_child(parents, batch, "visit_id", (F.col("score") > 1, changes.INVALID))
    assert {r.seq: r.code for r in judged.collect()} == {1: None, 2: 400, 3: 404}


def test_patches_tell_null_from_absent(spark):
    log = spark.createDataFrame([(1, 1, ["gender"], "f", None), (1, 2, ["gender"], None, None), (2, 3, [], None, None), (3, 4, ["name"], None, "n")], "id long, seq long, set_fields array<string>, gender string, name string")
    state = spark.createDataFrame([(i, "x", "old") for i in (1, 2, 3, 4)], "id long, gender string, name string")
    after = changes.patched(state, changes.fold(log, ["gender", "name"]), ["gender", "name"])
    assert sorted((tuple(r) for r in after.collect())) == [(1, None, "old"), (2, "x", "old"), (3, "x", "n"), (4, "x", "old")]


def test_patches_that_break_a_rule_are_refused(spark):
    state = spark.createDataFrame([(1,), (2,)], "id long")
    log = spark.createDataFrame(
        [(1, 1, ["name"], None, None), (1, 2, ["gender"], None, None), (1, 3, ["name"], "n" * 101, None), (9, 4, ["name"], None, None), (2, 5, ["name", "gender"], "ok", "g" * 21), (2, 6, [], None, "g" * 30)],
        "id long, seq long, set_fields array<string>, name string, gender string",
    )
    judged = changes.judged_patches(state, log, "patients", ["name", "gender"])
    assert {r.seq: r.code for r in judged.collect()} == {1: 422, 2: None, 3: 422, 4: 404, 5: 422, 6: None}


def test_confirming_tells_false_from_absent(spark):
    log = spark.createDataFrame([(1, 1, ["confirmed"], True), (2, 2, ["confirmed"], False), (3, 3, ["confirmed"], None), (4, 4, ["content"], None), (5, 5, ["confirmed"], True), (5, 6, ["content"], False)], "id long, seq long, set_fields array<string>, confirmed boolean")
    log = log.withColumn("at", F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")).withColumn("content", F.lit("new"))
    state = spark.range(1, 6).select("id", F.lit("old").alias("content"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("confirmed_at"))
    after = changes.patched(state, changes.fold(changes.confirmations(log), ["content", "confirmed_at"]), ["content", "confirmed_at"])
    assert {r.id: (r.content, r.confirmed_at and r.confirmed_at.year) for r in after.collect()} == {1: ("old", 2024), 2: ("old", None), 3: ("old", None), 4: ("new", 2020), 5: ("new", 2024)}


def test_a_database_is_read_in_key_ranges(spark):
    url, rows_ = "jdbc:derby:memory:caretide;create=true", spark.range(100).select("id", (F.col("id") % 7).alias("visit_id"))
    rows_.write.format("jdbc").options(url=url, dbtable="vitals", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    found = tables.over_jdbc(spark, url, "vitals", bounds=(0, 100), parts=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert found.rdd.getNumPartitions() == 4 and found.where('"ID" >= 90' if "ID" in found.columns else "id >= 90").count() == 10
    with pytest.raises(ValueError):
        tables.over_jdbc(spark, "", "vitals")


def test_stored_tables_have_their_declared_schema(spark, tmp_path):
    row = [(1, 2, datetime(2024, 1, 1), 80.0, None, None, None, 36.5, None, "alert")]
    spark.createDataFrame(row, schemas.DDL["vitals"]).write.parquet(f"file://{tmp_path}/vitals")
    found = tables.stored(spark, f"file://{tmp_path}", "vitals")
    assert found.columns == schemas.schema("vitals").fieldNames() and tuple(found.first()) == row[0]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

    class Session:
        conf, sparkContext = spark.conf, Context

    from caretide.sources import scratch

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(ValueError):
            scratch.shared_folder(Session)
    assert scratch.shared_folder(spark)


def test_a_scope_keeps_a_running_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with session.scope(spark__sql__shuffle__partitions="3") as own:
        assert own.conf.get("spark.sql.shuffle.partitions") == "3" and own.range(2).count() == 2
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.range(1).count() == 1


def test_a_scope_ends_its_own_session(monkeypatch):
    ended = []

    class Started:
        def stop(self):
            ended.append(1)

    monkeypatch.setattr(session.SparkSession, "getActiveSession", staticmethod(lambda: None))
    monkeypatch.setattr(session, "session", lambda *a, **k: Started())
    with pytest.raises(KeyError), session.scope():
        raise KeyError
    assert ended == [1]


def test_deletes(spark):
    state = spark.createDataFrame([(1,), (2,)], "id long")
    kids = spark.createDataFrame([(2,)], "parent long")
    commands = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 1), (5, None)], "seq long, id long")
    judged = changes.delete(state, commands, kids, "parent")
    assert {r.seq: r.code for r in judged.collect()} == {1: None, 2: 409, 3: 404, 4: 404, 5: 404}
    assert rows(changes.surviving(state, judged.where("code is null")), "id") == [(2,)]
    log = spark.createDataFrame([(1, 1, "patch"), (1, 2, "delete"), (1, 3, "patch"), (1, 4, "delete")], "id long, seq long, op string")
    assert {r.seq: r.code for r in changes.after_deletes(log).collect()} == {1: None, 2: None, 3: 404, 4: 404}


def test_ids_go_on_from_the_largest(spark):
    state = spark.createDataFrame([(7,)], "id long")
    got = changes.with_ids(state, spark.range(100, 110).withColumnRenamed("id", "seq"), cell_rows=3)
    assert [r.id for r in got.orderBy("seq").collect()] == list(range(8, 18))
    assert changes.with_ids(state.limit(0), spark.range(1).withColumnRenamed("id", "seq")).first().id == 1


def test_json_rows(spark):
    body = ['{"name": "a", "gender": null}', '{"triage": "x"}', "{", '{"triage": 3, "extra": 1}', None]
    df = spark.createDataFrame(list(enumerate(body)), "seq long, body string")
    got = {r.seq: (r.name, r.triage, list(r.set_fields), r.code) for r in tables.decoded(df, "name STRING, gender STRING, triage INT", keep=("seq",)).collect()}
    assert got[0] == ("a", None, ["name", "gender"], None)
    assert got[1][3] == 422 and got[2][3] == 422 and got[4][3] == 422
    assert got[3] == (None, 3, ["triage"], None)


def test_declared_tables(spark):
    assert set(tables.create_missing(spark)) == set(schemas.DDL)
    tables.create_missing(spark)
    assert spark.table("vitals").schema.fieldNames()[:3] == ["id", "visit_id", "measured_at"]
    for name in schemas.DDL:
        spark.sql(f"DROP TABLE `{name}`")
