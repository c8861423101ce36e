"""Random batches of commands against a plain one-by-one interpreter."""

from __future__ import annotations

import random

import pytest

from caretide.functions import dims
from caretide.operators import changes, reads, records


@pytest.mark.parametrize("seed", range(4))
def test_inserts_one_by_one(spark, seed):
    rng = random.Random(seed)
    state = {f"k{rng.randrange(12)}" for _ in range(5)}
    batch = [(s, rng.choice([None, *(f"k{rng.randrange(12)}" for _ in range(9))])) for s in range(40)]
    judged = changes.insert_unique(spark.createDataFrame([(k,) for k in state], "k string"), spark.createDataFrame(batch, "seq long, k string"), "k")
    seen, expected = set(state), {}
    for seq, k in batch:
        expected[seq] = 422 if k is None else 409 if k in seen else None
        seen.add(k)
    assert {r.seq: r.code for r in judged.collect()} == expected


@pytest.mark.parametrize("seed", range(4))
def test_patches_one_by_one(spark, seed):
    rng = random.Random(seed)
    state = {i: {"a": "old", "b": None} for i in range(6)}
    log = []
    for seq in range(50):
        fields = rng.sample(["a", "b"], rng.randint(0, 2))
        log.append((rng.randrange(6), seq, fields, *[rng.choice([None, str(seq)]) for _ in range(2)]))
    frame = spark.createDataFrame(log, "id long, seq long, set_fields array<string>, a string, b string").repartition(5)
    start = spark.createDataFrame([(i, v["a"], v["b"]) for i, v in state.items()], "id long, a string, b string")
    after = changes.patched(start, changes.fold(frame, ["a", "b"]), ["a", "b"])
    for i, _, fields, a, b in log:
        state[i] |= {f: v for f, v in (("a", a), ("b", b)) if f in fields}
    assert {r.id: {"a": r.a, "b": r.b} for r in after.collect()} == state


@pytest.mark.parametrize("seed", range(3))
def test_record_counts_add_up(spark, seed):
    rng = random.Random(seed)
    values = ["", "N/A", " N/A\n", "ok", "a statement", None]
    rows = [(r, f, rng.choice(values)) for r in range(8) for f in dims.FIELDS if rng.random() < 0.8]
    status = records.statuses(spark.createDataFrame(rows, "rec_id long, field string, value string"), dims.FIELDS, dims.OPTIONAL_FIELDS)
    for r in records.summary(status).collect():
        assert r.n_missing + r.n_review + r.n_complete == 11 and 45 <= r.score <= 100
        assert r.gate_open == (r.n_required_missing == 0) and (r.first_missing is None) == r.gate_open
        assert len(list(filter(None, r.missing_fields.split(", ")))) == r.n_required_missing


def test_gate_splits_a_batch(spark):
    parents = spark.createDataFrame([(i,) for i in range(0, 20, 2)] * 2, "id long")
    batch = spark.range(40).selectExpr("id AS seq", "id % 25 AS parent")
    judged = reads.gate(batch, parents, "parent")
    assert judged.count() == 40 and judged.where("found <> (parent % 2 = 0 AND parent < 20)").count() == 0


def test_dimensions(spark):
    assert [r.level for r in dims.risk_meta(spark).orderBy("rank").collect()] == ["critical", "rising", "watch", "stable"]
    assert dims.field_dim(spark).where("required").count() == 10 and dims.metric_dim(spark).count() == 6 and dims.bed_states(spark).count() == 4
