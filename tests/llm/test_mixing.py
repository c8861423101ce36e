from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caretide.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def plain_targets(sizes: dict):
    """Shares, and what is above three times a source's words shared again, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, closed = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in closed)
        share = left / (sum(w for s, w in weight.items() if s not in closed) or 1)
        above = {s for s in sizes if s not in closed and weight[s] * share > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in closed else weight[s] * share for s in sizes}
        closed |= above


def corpus(rng, n=3000):
    names = ["hot"] * 10 + ["Zeta", "alpha", "émile", "\U0001f600", None, "tiny"]
    docs = [(k, " ".join("w" for _ in range(int(rng.paretovariate(1.5) * 20))), rng.choice(names)) for k in range(n)]
    return docs + [(n, "only word", "rare"), (n + 1, None, "none"), (n + 2, "", "none")]


def test_targets_and_what_is_taken(spark):
    docs = corpus(random.Random(3))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    rows = mixing.measured(frame)
    found = mixing.copies(rows, mixing.targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")))).collect()
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(WORDS.findall(text or ""))
    expected, taken, spread = plain_targets(sizes), Counter(), defaultdict(float)
    for r in found:
        rate = expected[r.source] / sizes[r.source] if sizes[r.source] else 0
        part = rate - int(rate + 1e-9)
        assert r["__target"] == pytest.approx(expected[r.source]) and r["__source_size"] == sizes[r.source]
        assert r["__copies"] in (int(rate + 1e-9), int(rate + 1e-9) + 1) and r["__copies"] <= 3
        taken[r.source] += r["__size"] * r["__copies"]
        spread[r.source] += r["__size"] ** 2 * part * (1 - part)
    assert len(found) == len(docs) and sum(expected.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 4.5 * max(0, spread[s]) ** 0.5 + 1e-6


def test_a_second_run_and_another_layout_draw_the_same(spark):
    docs = corpus(random.Random(4), 400) + [(9, "one row that repeats", "hot")] * 200
    runs = []
    for parts in (2, 7):
        rows = mixing.measured(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(parts))
        found = mixing.copies(rows, mixing.targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")))).collect()
        runs.append(Counter((r.doc_id, r.source, r["__copies"]) for r in found))
    assert runs[0] == runs[1]


def test_equal_rows_draw_apart(spark):
    docs = [(1, "a b c d", "big")] * 3000 + [(2, "x " * 9000, "other")]
    rows = mixing.measured(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    found = mixing.copies(rows, mixing.targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")))).where("source = 'big'").collect()
    rate = found[0]["__target"] / found[0]["__source_size"]
    assert 0 < rate % 1 < 1 and abs(sum(r["__copies"] for r in found) / 3000 - rate) < 0.05


def test_the_mix_repeats_whole_documents(spark):
    docs = corpus(random.Random(6), 300)
    frame = spark.createDataFrame([(*d, d[0] * 2) for d in docs], "doc_id long, text string, source string, `a.b` long")
    rows = mixing.measured(frame)
    times = {r.doc_id: r["__copies"] for r in mixing.copies(rows, mixing.targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")))).collect()}
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert Counter(tuple(r) for r in mixed.collect()) == Counter({(*d, d[0] * 2): times[d[0]] for d in docs if times[d[0]]})


def test_one_digest_by_hand(spark):
    row = mixing.measured(spark.createDataFrame([(5, "a b", None)], "doc_id long, text string, source string")).select("__digest", mixing.drawn(F.col("__digest")).alias("u")).first()
    digest = hashlib.md5(b"13:1:5-3:a b").hexdigest()
    assert row["__digest"] == digest and row.u == int(digest[:13], 16) / 16**13


def test_edges(spark, edge, empty):
    assert mixing.mix(empty.withColumn("source", F.lit("s"))).collect() == []
    kept = mixing.mix(edge.withColumn("source", F.when(F.col("lang") == "en", "s")))
    assert kept.columns == [*edge.columns, "source"] and kept.count() > 0
    nothing = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert mixing.mix(nothing).count() == 0


def test_no_python_worker(spark):
    rows = mixing.measured(spark.createDataFrame([(k, "a b", "s") for k in range(9)], "doc_id long, text string, source string"))
    rates = mixing.targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")))
    plan = mixing.copies(rows, rates)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
