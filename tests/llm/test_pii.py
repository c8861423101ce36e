from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretide.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            fits = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0, 9 <= len(digits) <= 15)
            if fits[kind]:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.learned())


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789 -.+@ab%()4é٣") for _ in range(rng.randint(0, 70)))
        assert pii.base_spans(text) == plain(text), text


def test_query(spark, small, texts):
    for r in pii.query(spark, small).collect():
        base = plain(texts[r.doc_id] or "")
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for *_, k in base) for kind in range(4))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) <= set(r.spans.split(","))


def test_segmentation_and_likelihood_against_all_segmentations():
    rng = random.Random(2)
    for _ in range(100):
        n = rng.randint(1, 6)
        spans = [(a, b, 0, rng.uniform(-2, 3)) for a, b in itertools.combinations(range(n + 1), 2) if rng.random() < 0.5]
        every = [c for r in range(len(spans) + 1) for c in itertools.combinations(range(len(spans)), r) if all(spans[x][1] <= spans[y][0] or spans[y][1] <= spans[x][0] for x, y in itertools.combinations(c, 2))][:5000]
        score = lambda c: sum(spans[k][3] for k in c)
        assert abs(score(pii.viterbi(n, spans)) - max(map(score, every))) < 1e-9
        if spans:
            weights = np.exp([score(c) for c in every])
            assert np.allclose(pii.marginals(n, spans), [weights[[k in c for c in every]].sum() / weights.sum() for k in range(len(spans))])


def test_held_out_sentences(finder):
    right = total = found = 0
    for text, truth in pii.sentences(300, seed=99):
        got = {(a, b) for a, b, _ in finder.find(text)[1]}
        expected = {(a, b) for a, b, _ in truth}
        right, total, found = right + len(got & expected), total + len(expected), found + len(got)
    assert right / total > 0.97 and right / found > 0.95


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("call (415) 555-0134 today", ["(415) 555-0134"]), ("write jane.doe [at] mail [dot] org please", ["jane.doe [at] mail [dot] org"]), ("ssn 123-45-6789.", ["123-45-6789"]),
        ("on 2024-01-15 the order 1234567890 of 1.234.567 came", []), ("look at the dot on it", []), ("version 10.20.30.400 and 1999-2004", []), ("", []),
    ],
)
def test_added_spans(finder, text, pieces):
    assert [text[a:b] for a, b, _ in finder.find(text)[1]] == pieces


def test_base_spans_stay_and_added_ones_keep_clear(finder, texts):
    for text in texts.values():
        base, every = finder.find(text)
        assert set(base) <= set(every)
        assert not any(a < y and x < b for a, b, _ in set(every) - set(base) for x, y, _ in base)


def test_redaction():
    assert pii.redacted("a b@c.de f", [(2, 8, 0)]) == "a <EMAIL> f"
    assert pii.redacted("0123456789", [(1, 5, 2), (3, 7, 3), (8, 9, 1)]) == "0<CARD>7<IP>9"
    assert pii.redacted("as is", []) == "as is" and pii.redacted(None, []) is None


def test_long_texts_end_soon(finder):
    for text in ("1" * 100_000, "a" * 100_000, "1." * 20_000, "+1 " * 30_000, "a@" * 50_000, "a.b" * 30_000 + "@", "x" * 200_000 + " at y dot com", "dot " * 30_000, "12 " * 60_000, "DE89 " * 30_000, "[at]" * 30_000):
        began = time.time()
        finder.find(text)
        assert time.time() - began < 20


def test_edge_rows(edge, empty):
    named = edge.withColumn("spans", F.lit(1)).withColumn("n_ip", F.lit("clash"))
    out = pii.find(named)
    assert out.columns == ["doc_id", "lang", "a.b", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert out.count() == 9 and out.where("spans <> ''").count() == 0
    left = pii.redact(named)
    assert left.columns == named.columns and sorted(map(str, left.collect())) == sorted(map(str, named.collect()))
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0


def plain_added(text, base, weight):
    """The best segmentation over all candidates of the whole text."""
    tokens, found = pii.candidates(text)
    free = [f for f in found if not any(tokens[f[0]][0] < b and a < tokens[f[1] - 1][1] for a, b, _ in base)]
    scored = [(a, b, k, sum(weight.get(f, 0.0) for f in fs)) for a, b, k, fs in free]
    return [(tokens[scored[k][0]][0], tokens[scored[k][1] - 1][1], scored[k][2]) for k in pii.viterbi(len(tokens), scored)]


def test_spans_against_the_whole_text(spark, small, texts, finder):
    """The column ``spans``: base patterns and the best segmentation over whole documents, without any stretches."""
    weight = pii.learned()
    for r in pii.query(spark, small).collect():
        text = texts[r.doc_id] or ""
        base = plain(text)
        assert r.spans == pii.written(sorted({*base, *plain_added(text, base, weight)}, key=lambda s: (s[0], s[2], s[1])))
    rng = random.Random(17)
    pieces = ["12", "345", "6789", "(415)", " ", " ", "-", ".", "  ", "call", "a", "at", "[at]", " dot ", "[DOT]", "com", "DE89", "3704 0044", "é", "_", "x" * 70, "+", "@"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))
        base = plain(text)
        assert sorted(finder.added(text, base)) == sorted(plain_added(text, base, weight)), text


def test_added_cards_pass_their_checksum(spark, finder):
    """On the larger table: a card that the model adds passes Luhn, and so few spans are added that none is a habit."""
    added = []
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        base, every = finder.find(r.text)
        added += [(r.text[a:b], k) for a, b, k in set(every) - set(base)]
    assert not [piece for piece, k in added if pii.KINDS[k] == "card" and not pii.luhn(pii.digits_of(piece))]


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("order 1234567812345678 came", []), ("version 555.123.4567 is out", []), ("part no 123-456-7890 is gone", []), ("at noon dot. at 5 dot com", []),
        ("john [AT] example [DOT] com", ["john [AT] example [DOT] com"]), ("from john At example Dot com", ["john At example Dot com"]),
        ("jo.m.smith99 [at] mail [dot] example [dot] com", ["jo.m.smith99 [at] mail [dot] example [dot] com"]), ("my number is 415 555 0134", ["415 555 0134"]),
        ("meet at example dot com", []), ("you can find us at example dot com", []), ("the ratio 555 123 4567 was measured", []), ("a total of 555 123 4567", []),
        ("write to meet.jones at example dot com", ["meet.jones at example dot com"]), ("call 555 123 4567", ["555 123 4567"]), ("meet [at] example [dot] com", ["meet [at] example [dot] com"]),
    ],
)
def test_shapes_of_other_things(finder, text, pieces):
    assert [text[a:b] for a, b, _ in finder.find(text)[1]] == pieces


def test_stored_weights_are_those_of_a_fit():
    stored, fresh = pii.learned(), pii.fitted()
    assert stored.keys() == fresh.keys() and all(abs(stored[n] - w) < 1e-4 for n, w in fresh.items())
