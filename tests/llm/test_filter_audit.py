from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from caretide.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def plain_failures(docs, labels):
    first, marks, out = {}, {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    for i, text, lang in docs:
        text = text or ""
        words = WORDS.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first.get(text, i)}
        out.append((lang or "", {k for k, v in fails.items() if v}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    return out


def plain_audit(rows, filters="ABCDE"):
    """Every order applied to every row, one filter after the other."""
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley, lines = [r for r in rows if r[0] == part], defaultdict(int), {}
        for order in permutations(filters):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                lines["".join(order), step] = (len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f)
        out |= {(part, *k): (*v[:6], shapley[v[6]]) for k, v in lines.items()}
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def sample():
    rng = random.Random(5)
    pool = ["low words here", "SHOUT NOW", "a # mark", "", None, "tab\tand\x0bline " * 120, "Ünï çödé 漢字 " * 210]
    pool += [" ".join(rng.choice(["x", "y", "Zed", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([199, 200, 260]))) + rng.choice(["", " $"]) for _ in range(40)]
    docs = [(None if k % 17 == 0 else k // 2 if k % 9 == 0 else k, rng.choice(pool), rng.choice(["en", "de", "", None])) for k in range(300)] + [(7, "same row", "en")] * 3
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 320, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_against_every_order_applied_to_every_row(spark):
    docs, labels = sample()
    wide = [(*d, k, "x") for k, d in enumerate(docs)]
    frame = spark.createDataFrame(wide, "doc_id long, text string, lang string, E int, part string").repartition(3)
    rows = filter_audit.failures(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found(filter_audit.audit(rows, filter_audit.FILTERS, "part", ("good", "toxic"))) == plain_audit(plain_failures(docs, labels))


def test_the_sql_agrees(spark):
    docs, labels = sample()
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.sql("CREATE TABLE labels(doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    rows = con.sql(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({filter_audit.ORACLE_SQL})").fetchall()
    assert {r[:3]: r[3:] for r in rows} == plain_audit(plain_failures(docs, labels))


def test_cells_come_back_exactly(spark):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), *[rng.random() < 0.4 for _ in range(4)]) for _ in range(500)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, a boolean, b boolean, c boolean, d boolean"), "abcd", "part")
    got = {r.part: r.n for r in sums.selectExpr("part", "array(" + ",".join(f"s{k}" for k in range(16)) + ") AS s").select("part", filter_audit.cells("s", 4).alias("n")).collect()}
    for part in "pq":
        assert got[part] == [sum(r[0] == part and sum(v << k for k, v in enumerate(r[1:])) == m for r in rows) for m in range(16)]


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(empty, labels), filter_audit.FILTERS, "part", ("good",)).collect() == []
    rows = [tuple(r)[:3] for r in edge.collect()]
    assert found(filter_audit.audit(filter_audit.failures(edge, labels), filter_audit.FILTERS, "part", ("good", "toxic"))) == plain_audit(plain_failures(rows, []))
    with pytest.raises(ValueError):
        filter_audit.audit(edge, [], "lang")


def test_only_sums_are_shuffled_by_part(spark):
    rows = spark.range(100).selectExpr("id % 3 = 0 AS a", "id % 2 = 0 AS b", "'p' AS part")
    plan = filter_audit.audit(rows, "ab", "part")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") >= 4 and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
