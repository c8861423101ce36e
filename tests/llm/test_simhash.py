from __future__ import annotations

import itertools
import random
import re
from math import comb

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caretide.llm import simhash
from caretide.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fingerprints):
    """Smallest reachable id of each, comparing all pairs."""
    ids = sorted(fingerprints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (fingerprints[a] ^ fingerprints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_every_pattern_of_four_differences_has_a_near_triple():
    for errors in itertools.product(range(5), repeat=6):
        assert sum(errors) > 4 or any(sum(errors[b] for b in t) <= 1 for t in simhash.TRIPLES)


def test_anchors_cover_and_pairs_meet():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4)))
        at, keys, home = simhash.anchors(np.array([a, b], np.uint64).view(np.int64))
        assert home.sum() == 12 and len(at) <= 2 * 6 * 16
        homes = {k for i, k, h in zip(at, keys, home) if h and i == 0}
        assert homes & {k for i, k in zip(at, keys) if i == 1}
    words = np.array([rng.getrandbits(30) for _ in range(200)])
    s = simhash.syndrome(words)
    assert (simhash.syndrome(words ^ simhash.FLIPS[s, 0]) == 0).all()


def test_dense_anchor_gives_the_same_groups():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = np.array(sorted({centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for _ in range(1500)}), np.uint64).view(np.int64)
    a, b = simhash._dense_links(fps)
    full = simhash.local_stars(len(fps), *np.nonzero(simhash.close(fps[:, None], fps)))
    assert (simhash.local_stars(len(fps), a, b) == full).all() and len(a) == len(fps) - len(set(full))


def test_query(spark, small, texts):
    fingerprints = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_groups(fingerprints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, small).collect()}
    assert got == {i: (f"{fingerprints[i]:016x}", groups[i]) for i in texts}


def test_chains_and_copies(spark):
    """Links only through others, and many copies of one fingerprint."""
    rng, chain = random.Random(5), [random.Random(5).getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << k for k in rng.sample(range(64), 4)))
    signed = np.array(chain, np.uint64).view(np.int64).tolist()
    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    assert {r.node: r.root for r in found.collect()} == {f: min(signed) for f in signed if f != min(signed)}
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the very same text over and over").otherwise(F.concat(F.lit("another one "), F.col("id").cast("string"))).alias("text"))
    kept = simhash.representatives(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = set(plain_groups({i: plain_fingerprint(t) for i, t in texts.items()}).values())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_components_ignore_nulls_and_loops(spark):
    rows = [(1, 2), (2, 1), (5, 5), (None, 3), (7, 6), (6, 8), (8, 9), (20, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {2: 1, 7: 6, 8: 6, 9: 6, 20: 6}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(edge, empty):
    named = edge.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0)).withColumn("root", F.lit(0))
    rows = simhash.groups(named).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (2, 3, 6)} == {2} and all(r.fp == 0 for r in rows if r.doc_id in (2, 3, 6))
    kept = simhash.representatives(named)
    assert kept.columns == named.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "7", "None"]
    assert simhash.groups(empty).count() == 0 and simhash.representatives(empty).count() == 0


def full_groups(fps):
    return simhash.local_stars(len(fps), *np.nonzero(simhash.close(fps[:, None], fps)))


def test_dense_links_of_every_shape():
    rng = random.Random(12)
    fixed = rng.getrandbits(30)
    shapes = [
        lambda: fixed | rng.getrandbits(34) << 30, lambda: fixed | rng.getrandbits(11) << 40, lambda: rng.getrandbits(64), lambda: (rng.getrandbits(6) * 0x0102040810204081) & (1 << 64) - 1 ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 2))),
    ]
    for shape in shapes:
        fps = np.array(sorted({shape() for _ in range(2500)}), np.uint64).view(np.int64)
        a, b = simhash._dense_links(fps)
        full = full_groups(fps)
        assert (simhash.local_stars(len(fps), a, b) == full).all() and len(a) == len(fps) - len(set(full.tolist()))


@pytest.fixture
def compared(monkeypatch):
    """How many comparisons are made, as a list of counts."""
    counts, pairs = [], simhash._pairs

    def counting(*args):
        for a, b in pairs(*args):
            counts.append(len(a))
            yield a, b

    monkeypatch.setattr(simhash, "_pairs", counting)
    return counts


def test_many_fingerprints_that_share_a_triple_are_not_compared_all_with_all(compared):
    """Eight times the rows, 20 times the comparisons and sorted rows: all with all would be 64 times as many."""
    rng, work = np.random.default_rng(4), []
    for n in (12_500, 100_000):
        compared.clear()
        fps = (rng.integers(0, 1 << 34, n, dtype=np.uint64) << np.uint64(30)) | np.uint64(12345)
        simhash._dense_links(np.unique(fps).view(np.int64))
        work.append(sum(compared) + n * comb(simhash._cut(n, 34), simhash.THRESHOLD))
    assert work[1] < 24 * work[0] and work[1] < 300 * 100_000


def test_blocks_follow_the_rows():
    """By the estimate a row's work, sorting included, stays within a small factor from a thousand rows to a hundred million."""
    work = [comb(b, 4) * (1 + n / 2 ** (34 * (b - 4) / b)) for n in (10**3, 10**4, 10**5, 10**6, 10**7) for b in (simhash._cut(n, 34),)]
    assert work == sorted(work) and work[-1] < 120 * work[0]


def test_a_crowd_of_equal_content_is_cut_again(compared):
    """Most rows differ in a few places only of those that vary at all, so that some blocks are the same in nearly all."""
    rng = np.random.default_rng(7)
    crowd = rng.integers(0, 1 << 20, 20_000, dtype=np.uint64) << np.uint64(40)
    stray = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)
    fps = np.unique(np.concatenate((crowd, stray))).view(np.int64)
    a, b = simhash._dense_links(fps)
    assert sum(compared) < 0.1 * len(fps) ** 2
    sample = np.concatenate((fps[:3000], fps[-1500:]))
    got = simhash.local_stars(len(fps), a, b)
    label = dict(zip(fps.tolist(), got.tolist()))
    for x, y in zip(*np.nonzero(simhash.close(sample[:, None], sample))):
        assert label[int(sample[x])] == label[int(sample[y])]


def test_hot_anchors_are_split(spark):
    """Fingerprints that share a triple's bits: their anchors are found, their meetings spread, and no link is lost."""
    rng = random.Random(6)
    word = rng.getrandbits(30)
    fps = {word | rng.getrandbits(34) << 30 for _ in range(1500)} | {rng.getrandbits(64) for _ in range(500)}
    fps |= {f ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))) for f in rng.sample(sorted(fps), 600)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    distinct = spark.createDataFrame([(f,) for f in signed.tolist()], "fp long")
    index, keys, _ = simhash.anchors(signed)
    visitors = np.unique(keys, return_counts=True)
    hot = {r.anchor for r in simhash.hot_anchors(distinct, hot=1000).collect()}
    assert {k for k, n in zip(*(v.tolist() for v in visitors)) if n > 1000} <= hot and visitors[1].max() > 1000
    largest = simhash.meetings(distinct, hot=1000).groupBy("key").count().agg(F.max("count")).first()[0]
    assert largest < visitors[1].max() / 10
    assert hot <= {k for k, n in zip(*(v.tolist() for v in visitors)) if n > 500}
    assert simhash.meetings(distinct).groupBy("key").count().agg(F.max("count")).first()[0] == visitors[1].max()
    got = {r.node: r.root for r in components(simhash.links(distinct, hot=1000)).collect()}
    full = {}
    for f, r in zip(signed.tolist(), full_groups(signed).tolist()):
        full.setdefault(r, []).append(f)
    assert got == {f: min(own) for own in full.values() for f in own if f != min(own)}
