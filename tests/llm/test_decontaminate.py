from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretide.llm import decontaminate as dc


def plain_matches(docs, items):
    """Every item-sized window of every document against every item."""
    sets = {i: dc.shingles_of(dc.WORDS((t or "").lower())) for i, t in items.items()}
    out = {}
    for d, text in docs.items():
        words = dc.WORDS((text or "").lower())
        own = dc.shingles_of(words)
        for i, item in sets.items():
            if not item or not own:
                continue
            if len(k := item[0]) < 5:  # a short item: its words anywhere in the text
                best = float(any(tuple(words[at : at + len(k)]) == k for at in range(len(words))))
            elif len(words) < 5:
                best = 0.0
            else:
                n = len(item)
                best = max((dc.similarity(own[k : k + n], item) for k in range(len(own) - n + 1) if set(own[k : k + n]) & set(item)), default=0.0)
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def found(docs, benchmark):
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.leaks(docs, benchmark).collect()}


def test_query(spark, small, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.query(spark, small).collect()}
    assert got == plain_matches(texts, items) and got


def test_planted_near_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = {i: " ".join(word() for _ in range(rng.choice([5, 6, 12, 40, 70]))) for i in range(30)}
    items |= {100: items[3], 101: "short one", 102: None, 103: ""}
    docs = {}
    for d in range(120):
        words = items[rng.randrange(30)].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [word()], [words[k], word()]])
        docs[d] = " ".join([word() for _ in range(rng.randint(0, 50))] + words + [word() for _ in range(rng.randint(0, 50))])
    docs |= {200: "Short, one!", 201: "a short one here for you", 202: None, 203: "", 204: " ".join(items[k] for k in range(30)).upper()}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = plain_matches(docs, items)
    assert found(frame, benchmark) == expected and {s < 1 for s in expected.values()} == {True, False}
    left = {r.doc_id for r in dc.clean(frame, benchmark).collect()}
    assert left == set(docs) - {d for d, _ in expected}


def test_index_finds_all_within_the_radius():
    rng = random.Random(1)
    fps = np.array([rng.getrandbits(64) for _ in range(150)], np.uint64)
    index = dc.HammingIndex(fps)
    queries = [rng.getrandbits(64) for _ in range(100)] + [int(rng.choice(fps)) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 24))) for _ in range(200)]
    q, i = index.within(np.array(queries, np.uint64))
    expected = [(a, b) for a, x in enumerate(queries) for b, y in enumerate(fps.tolist()) if (x ^ y).bit_count() <= index.radius]
    assert list(zip(q.tolist(), i.tolist())) == expected


def test_radius_misses_next_to_nothing_at_the_threshold():
    """Windows just at the similarity, as far apart as they can be."""
    rng, near = random.Random(9), 0
    for _ in range(400):
        n = 45
        shared = [tuple(str(rng.random()) for _ in range(5)) for _ in range(40)]
        sides = [dc.majority(np.array([dc.shingle_hash(s) for s in shared + [(str(rng.random()),) for _ in range(n - 40)]], np.uint64)) for _ in range(2)]
        near += (sides[0] ^ sides[1]).bit_count() <= dc.RADIUS
    assert near >= 398


def test_edge_rows(spark, edge, empty):
    benchmark = spark.createDataFrame([(1, "two three four five six"), (2, None), (None, "no id here"), (3, "word word word word word word")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(edge, benchmark).collect()} == {(1, 1), (None, None), (5, 3)}
    left = dc.clean(edge.withColumn("similarity", F.lit(1)), benchmark)
    assert left.columns == [*edge.columns, "similarity"] and sorted(r.doc_id for r in left.collect()) == [2, 3, 6, 7]
    assert {(r.doc_id, r.item_id) for r in dc.leaks(edge, benchmark, sent_bytes=0).collect()} == {(1, 1), (None, None), (5, 3)}
    left = dc.clean(edge.withColumn("similarity", F.lit(1)), benchmark, sent_bytes=0)
    assert left.columns == [*edge.columns, "similarity"] and sorted(r.doc_id for r in left.collect()) == [2, 3, 6, 7]
    assert dc.leaks(empty, benchmark, sent_bytes=0).count() == 0
    assert dc.leaks(empty, benchmark).count() == 0 and dc.leaks(edge, benchmark.limit(0)).count() == 0 and dc.clean(edge, benchmark.limit(0)).count() == 9


def plain_longer(docs, items):
    """Every whole document against every item with more shingles."""
    out = {}
    for d, text in docs.items():
        own = dc.shingles_of(dc.WORDS((text or "").lower()))
        for i, t in items.items():
            item = dc.shingles_of(dc.WORDS((t or "").lower()))
            if own and len(own) < len(item) and (s := dc.similarity(own, item)) >= 0.8:
                out[d, i] = round(s, 9)
    return out


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = {i: " ".join(word() for _ in range(rng.choice([4, 5, 8, 9, 14, 30, 59, 75]))) for i in range(40)}
    items |= {100: items[3], 101: " ".join(word() for _ in range(59)), 102: "same " * 14}
    docs = {200: " ".join(items[101].split()[:-1]), 201: "same " * 13, 202: items[101], 203: " ".join([word()] * 9 + items[101].split()[:-1])}
    for d in range(1000, 1300):
        words = items[rng.randrange(40)].split()
        for _ in range(rng.randint(0, 2)):
            words[(k := rng.randrange(len(words))) : k + 1] = rng.choice([[], [word()]])
            words = words[rng.randint(0, 1) :] or [word()]
        docs[d] = " ".join(words[: len(words) - rng.choice([0, 1, 2, 4, 12])])
    expected = plain_matches(docs, items) | plain_longer(docs, items)
    assert expected[200, 101] == round(54 / 55, 9) and len({i for _, i in plain_longer(docs, items)}) > 10
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert found(frame, benchmark) == expected
    assert {r.first_word + r.n_words for r in dc.leaks(frame, benchmark).where("doc_id = 200").collect()} == {58}
    assert {r.doc_id for r in dc.clean(frame, benchmark).collect()} == set(docs) - {d for d, _ in expected}


def large_case(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = {i: " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 9, 30, 59]))) for i in range(60)}
    items |= {100: "same " * 14, 101: "", 102: None, 103: items[5], 104: items[7] + " and more of it"}
    docs = {d: " ".join(word() for _ in range(rng.randint(0, 80))) for d in range(150)}
    for d in range(150, 300):
        words = items[rng.randrange(60)].split()
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [word()], words[k : k + 1]])
        docs[d] = " ".join(rng.choice([[], [word() for _ in range(20)]]) + words)
    return items, docs | {400: None, 401: "", 402: "same " * 13, 403: " ".join(t for t in items.values() if t)}


@pytest.mark.parametrize("seed", [21, 22])
def test_a_large_benchmark_is_joined(spark, seed):
    """The same leaks and the same documents kept as with a small one, and as all pairs give."""
    items, docs = large_case(seed)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = plain_matches(docs, items) | plain_longer(docs, items)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.leaks(frame, benchmark, sent_bytes=0).collect()}
    assert got == expected == found(frame, benchmark) and len({i for _, i in expected}) > 40
    assert {r.doc_id for r in dc.clean(frame, benchmark, sent_bytes=0).collect()} == set(docs) - {d for d, _ in expected}
    keys = dc.item_keys(dc._distinct(benchmark))
    sieve = dc.shingle_filter(keys)
    assert all(sieve.may_match(docs[d]) for d, _ in expected) and sum(map(sieve.may_match, docs.values())) < 1.4 * len({d for d, _ in expected})
    full = dc.shingle_filter(keys, most_bits=12)  # so few bits let nearly everything through, and lose nothing
    assert all(full.may_match(docs[d]) for d, _ in expected)


def test_whatever_matches_has_a_telling_shingle(spark):
    items, docs = large_case(5)
    benchmark = spark.createDataFrame([(str(i), t) for i, t in items.items()], "item_id string, text string")
    telling = {}
    for r in dc.telling_keys(dc.item_keys(benchmark)).collect():
        telling.setdefault(int(r.item), set()).add(r.key)
    for d, i in plain_matches(docs, items) | plain_longer(docs, items):
        words, known = dc.WORDS(docs[d].lower()), {}
        own = {int(k) for n in range(1, 6) for k in dc.grams(words, n, known).view(np.int64)}
        assert own & telling[i]
    for i, own in telling.items():
        n = len(dc.shingles_of(dc.WORDS(items[i].lower())))
        assert len(own) <= n - int(0.8 * n - 1e-9) + 1


def test_a_large_benchmark_stays_out_of_the_driver(spark, monkeypatch):
    """Neither items nor documents are fetched, one scan of the documents is made for all items, and what is fetched is bounded."""
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for i in range(3000)]
    docs = [(d, " ".join(f"w{rng.randrange(5000)}" for _ in range(200)) + " " + items[d * 7 % 3000][1]) for d in range(200)]
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    fetched, collect = [], DataFrame.collect

    def counting(self):
        rows = collect(self)
        fetched.append((len(rows), [f.dataType.simpleString() for f in self.schema.fields]))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counting)
    leaks, left = dc.leaks(frame, benchmark, sent_bytes=1 << 10), dc.clean(frame, benchmark, sent_bytes=1 << 10)
    monkeypatch.undo()
    assert all(n <= dc.MANY_SIZES + 1 and "string" not in kinds for n, kinds in fetched)
    assert {(r.doc_id, r.item_id) for r in leaks.collect()} == {(d, d * 7 % 3000) for d in range(200)} and left.count() == 0
    assert leaks._jdf.queryExecution().executedPlan().toString().count("Scan parquet") < 12


def test_one_document_of_very_many_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 7)
    rng = random.Random(3)
    items = {i: " ".join(str(rng.randrange(900)) for _ in range(12)) for i in range(600)}
    docs = {1: " ".join(items.values()), 2: "nothing here at all"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(frame, benchmark, sent_bytes=0).collect()} == {(1, i) for i in items}


def test_copies_of_an_item_take_no_room(spark):
    text = "one two three four five six seven eight nine ten " * 20
    benchmark = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    assert dc._distinct(benchmark).count() == 1
    docs = spark.createDataFrame([(1, text), (2, "nothing of the kind")], "doc_id long, text string")
    assert dc.leaks(docs, benchmark).groupBy("doc_id").count().collect() == [(1, 20_000)]


def test_a_text_made_of_items_ends_soon(lines_run):
    rng = random.Random(2)
    items = [(i, " ".join(str(rng.randrange(3000)) for _ in range(rng.randint(40, 80)))) for i in range(400)]
    ready = dc.Benchmark(items)
    text = " ".join(t for _, t in items * 5)
    assert {i for i, *_ in ready.matches(text)} == set(range(400))
    assert lines_run(ready.matches, text) < 40 * len(text.split())
