from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caretide.llm import byte_bpe

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.table.ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, byte_bpe.ID).tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    enc = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.table.ranks, special_tokens={})
    got = ids(enc.encode([text])[0])
    assert got == lib.encode_ordinary(text)
    assert enc.decode(np.array(got, byte_bpe.ID)) == text.encode()


def test_overlapping_merges_and_lone_pieces(encoder, library):
    for text in ("aaaaaaaaaaaaa", "ababababab", "       x", "\n\n\n", "a" * 3001, "'s't're", "1234567890" * 20, ""):
        assert ids(encoder.encode([text])[0]) == library.encode_ordinary(text)


def test_replay_equals_the_definition_where_a_new_pair_has_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 299, b"ab": 298, b"abcd": 297, b"cd": 301, b"xx": 310, b"xxx": 305, b"xxxx": 302}
    table = byte_bpe.MergeTable(ranks)
    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcdx") for _ in range(rng.randint(0, 12))).encode() for _ in range(500)]
    assert [ids(x) for x in table.replay(pieces)] == [table.encode_one(p) for p in pieces]


def test_cache_overflow_changes_nothing(encoder, texts, library):
    small = byte_bpe.BlockEncoder(encoder.table, public_tokenizers.PATTERN, cache_pieces=50)
    some = list(texts.values())[:40]
    assert [ids(x) for k in range(0, 40, 10) for x in small.encode(some[k : k + 10])] == [library.encode_ordinary(t) for t in some]


def test_query(spark, small, texts, library):
    got = {r.doc_id: r for r in byte_bpe.query(spark, small).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        expected = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(expected)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_edge_rows_round_trip(edge, empty, library):
    named = edge.withColumn("n_tokens", F.lit("clash")).withColumn("tokens", F.lit(0))
    coded = byte_bpe.encode(named, PATH, public_tokenizers.PATTERN, block_chars=1000)
    assert coded.columns == ["doc_id", "text", "lang", "a.b", "tokens", "n_tokens"]
    rows = byte_bpe.decode(coded, PATH).collect()
    assert len(rows) == 9
    for r in rows:
        assert r.tokens == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.tokens) and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_pieces_are_replayed_once_for_all_blocks(spark, library):
    """Blocks of one or two rows, many partitions, a text that a third of all rows have, a text cut piece by piece."""
    rows = [(i, "the same words again and again " * 3 if i % 3 else f"row {i} the same " * (i % 7)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string").repartition(7)
    cut = byte_bpe.pieces(docs.select("doc_id", "text"), public_tokenizers.PATTERN, block_chars=100)
    listed = cut.where("piece is not null")
    assert cut.where("codes is not null").count() == 302
    assert listed.count() == listed.select("block", "piece").distinct().count() == listed.select("block", "code").distinct().count()
    got = {r.doc_id: r.tokens for r in byte_bpe.encode_by_corpus(docs, PATH, public_tokenizers.PATTERN, ("tokens",), block_chars=100).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in docs.collect()}


def test_a_very_long_text_is_cut_without_a_list(monkeypatch, library):
    text = "One two, three!\n\n 12345 é漢字 " * 50
    pattern = byte_bpe.regex.compile(public_tokenizers.PATTERN)
    whole, parts = byte_bpe.Numbers(), byte_bpe.Numbers()
    packed = whole.of(text, pattern)
    monkeypatch.setattr(byte_bpe, "PIECES_AT_ONCE", 10)
    assert parts.of(text, pattern) == packed and list(parts) == list(whole)
    names = list(whole)
    assert "".join(names[k] for k in byte_bpe._codes(packed)) == text and len(byte_bpe._codes(b"")) == 0


def test_a_stretch_of_the_vocabulary_may_end_anywhere(spark, encoder):
    words = [f" w{i % 40}" for i in range(400)]
    df = spark.createDataFrame([(i, i, w) for i, w in enumerate(words)], "block long, code int, piece string")
    got = {r.block: np.frombuffer(r.ids, "<u2").tolist() for r in byte_bpe.replayed(df, PATH, replay_chars=20).collect()}
    assert got == {i: encoder.table.encode_one(w.encode()) for i, w in enumerate(words)}


def test_both_ways_give_the_same_rows(edge, empty):
    named = edge.withColumn("n_tokens", F.lit("clash"))
    outputs = ("tokens", "n_tokens", "ids_sha256", "decoded_sha256")
    by_block, by_corpus = (f(named, PATH, public_tokenizers.PATTERN, outputs) for f in (byte_bpe.encode, byte_bpe.encode_by_corpus))
    assert by_block.columns == by_corpus.columns and sorted(map(str, by_block.collect())) == sorted(map(str, by_corpus.collect()))
    assert byte_bpe.encode_by_corpus(empty, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_digests_in_any_portions(encoder, monkeypatch, at_once):
    monkeypatch.setattr(byte_bpe, "IDS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    lists = [[rng.randrange(50_000) for _ in range(n)] for n in (0, 1, 0, 6, 7, 8, 30, 0, 2)]
    coded = [np.array(x, byte_bpe.ID).tobytes() for x in lists]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert encoder.table.decimal_of.hashed(coded, trim=1) == [sha(",".join(map(str, x)).encode()) for x in lists]
    assert encoder.table.bytes_of.hashed(coded) == [sha(b"".join(encoder.table.piece_of[i] for i in x)) for x in lists]
