"""Commands of all kinds in one log, against an interpreter that takes one after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caretide.operators import changes
from caretide.operators.cells import block, carried

SCHEMA = "k string, seq long, op string, set_fields array<string>, a string, b string, held boolean"


def interpreted(state, log):
    """Codes by number, and the rows that are left."""
    now, codes = {k: dict(v) for k, v in state.items()}, {}
    for k, seq, op, fields, a, b, held in sorted(log, key=lambda c: c[1]):
        new, code = {"a": a, "b": b}, None
        if k is None or op not in ("insert", "patch", "delete"):
            code = 422
        elif op == "insert":
            code = 422 if a is None else 409 if k in now else None
        elif op == "patch":
            code = 404 if k not in now else 422 if "a" in (fields or ()) and a is None else None
        else:
            code = 404 if k not in now else 409 if held else None
        codes[k, seq] = code
        if code is None:
            if op == "insert":
                now[k] = new
            elif op == "patch":
                now[k] |= {f: new[f] for f in fields or ()}
            else:
                del now[k]
    return codes, now


def sample(rng, n=300):
    """A third of the commands are of one key."""
    state = {f"k{i}": {"a": "old", "b": None} for i in range(0, 12, 2)}
    log = []
    for seq in range(n):
        key = "hot" if rng.random() < 0.33 else rng.choice([None, *(f"k{i}" for i in range(12))])
        fields = rng.choice([None, [], ["a"], ["b"], ["a", "b"]])
        log.append((key, seq * 3, rng.choice(["insert", "patch", "patch", "delete", "merge"]), fields, rng.choice([None, f"a{seq}", f"a{seq}"]), rng.choice([None, f"b{seq}"]), rng.choice([True, False, None])))
    rng.shuffle(log)
    return state, log


CHECKS = lambda: [(F.col("a").isNull(), changes.MALFORMED)]
PATCHES = lambda: [(F.array_contains("set_fields", "a") & F.col("a").isNull(), changes.MALFORMED)]


def judged_of(spark, state, log, bits):
    stored = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in state.items()], "k string, a string, b string")
    frame = spark.createDataFrame(log, SCHEMA).repartition(5)
    return stored, changes.replayed(stored, frame, CHECKS(), PATCHES(), "k", held=F.col("held"), bits=bits)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("bits", [2, 5, 16])
def test_codes_and_state_equal_one_by_one(spark, seed, bits):
    state, log = sample(random.Random(seed))
    stored, judged = judged_of(spark, state, log, bits)
    codes, left = interpreted(state, log)
    assert {(r.k, r.seq): r.code for r in judged.collect()} == codes
    after = changes.state_after(stored, judged, ["a", "b"], "k")
    assert {r.k: {"a": r.a, "b": r.b} for r in after.collect()} == left
    found = {r.k: (r.n_accepted, r.n_refused, r.first_refused, r.first_code) for r in changes.refusals(judged, "k").collect()}
    for k in {c[0] for c in log}:
        own = sorted((seq, code) for (key, seq), code in codes.items() if key == k)
        refused = [x for x in own if x[1] is not None]
        assert found[k] == (len(own) - len(refused), len(refused), *(refused[0] if refused else (None, None)))


def test_two_logs_in_a_row_are_one_log(spark):
    """The state that the first half leaves is what the second half finds."""
    state, log = sample(random.Random(9))
    early, late = [c for c in log if c[1] < 450], [c for c in log if c[1] >= 450]
    stored, first = judged_of(spark, state, early, 4)
    between = {r.k: {"a": r.a, "b": r.b} for r in changes.state_after(stored, first, ["a", "b"], "k").collect()}
    stored, second = judged_of(spark, between, late, 4)
    codes, left = interpreted(state, log)
    assert {(r.k, r.seq): r.code for d in (first, second) for r in d.collect()} == codes
    assert {r.k: {"a": r.a, "b": r.b} for r in changes.state_after(stored, second, ["a", "b"], "k").collect()} == left


def test_empty_sides(spark):
    state, log = sample(random.Random(3), 40)
    stored, judged = judged_of(spark, state, [], 4)
    assert judged.count() == 0 and changes.state_after(stored, judged, ["a", "b"], "k").count() == len(state)
    stored, judged = judged_of(spark, {}, log, 4)
    codes, left = interpreted({}, log)
    assert {(r.k, r.seq): r.code for r in judged.collect()} == codes
    assert changes.state_after(stored, judged, ["a", "b"], "k").count() == len(left)


def test_no_task_orders_all_commands_of_a_key(spark):
    """Commands are ordered within (key, block of the log); only one row for each block is ordered by key."""
    log = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "insert").otherwise("delete").alias("op"), F.array().cast("array<string>").alias("set_fields"), F.lit("x").alias("a"))
    judged = changes.replayed(log.select("k").limit(0), log, [], [], "k", bits=8)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Window [" in line]
    assert len(lines) == 2 and sum("__cell0" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in lines) >= 1
    cells = log.groupBy("k", block("seq", 8)).count().agg(F.max("count")).first()[0]
    assert cells == 256 and {r.code for r in judged.collect()} == {None}


def test_carried_values(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i, rng.choice([None, i])) for i in range(250)]
    frame = spark.createDataFrame(data, "k string, t int, id long, v long")
    start = spark.createDataFrame([("a", -5)], "k string, value long")
    one = carried(frame, ["k"], F.floor(F.col("t") / 7), ["t", "id"], F.col("v"), "last", initial=start)
    more = carried(frame, ["k"], [F.floor(F.col("t") / 20), F.floor(F.col("t") / 4), F.col("t")], ["t", "id"], F.col("v"), "last", initial=start)
    got = {r.id: r.last for r in one.collect()}
    assert got == {r.id: r.last for r in more.collect()}
    for k, t, i, _ in data:
        earlier = [(x[1], x[2], x[3]) for x in data if x[0] == k and x[1] is not None and x[3] is not None and t is not None and (x[1], x[2]) < (t, i)] if k is not None and t is not None else []
        assert got[i] == (max(earlier)[2] if earlier else -5 if k == "a" and t is not None else None)


@pytest.fixture
def split_small(spark):
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_joins_split_a_key_with_a_third_of_the_commands(spark, split_small, tmp_path):
    path = str(tmp_path / "log")
    spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("seq"), F.when(F.col("id") % 11 == 0, "delete").otherwise("patch").alias("op"), F.sha2(F.col("id").cast("string"), 512).alias("body")).write.parquet(path)
    log, state = spark.read.parquet(path), spark.range(0, 60_000, 5).select(F.col("id").alias("k"))
    for judged in (
        changes.insert_unique(state, log, "k", (F.col("op") == "delete", changes.INVALID)),
        changes.after_deletes(log, "k"),
        changes.delete(state, log, spark.range(0, 60_000, 7).select(F.col("id").alias("kid")), "kid", key="k"),
    ):
        judged.write.format("noop").mode("overwrite").save()
        plans = judged._jdf.queryExecution()
        judged.collect()
        assert "skew=true" in plans.executedPlan().toString(), plans.executedPlan().toString()[:3000]


def test_of_two_actions_at_one_moment_the_larger_id_counts(spark):
    done = [(1, 5, 2, "b"), (1, 5, 1, "a"), (2, 1, 9, "c")]
    for order in (done, done[::-1]):
        got = changes.latest(spark.createDataFrame(order, "k long, at long, id long, what string").coalesce(1), ["k"], "at", ["what"])
        assert {r.k: (r.at, r.what, r.n_actions) for r in got.collect()} == {1: (5, "b", 2), 2: (1, "c", 1)}
