from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caretide.llm import storage, token_store

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_text(library):
    rng, encoder = random.Random(1), token_store.WordEncoder(PATH, cache_words=300)
    letters = "abcXYZéÉßñİΣςσ 　\t\n\x0b\x0c\x1c\x85'’.,!?<|>%$#&_-0129½²漢字̧́ﬁǅ\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["a<|endoftext|>b <|STARTOFTEXT|> don't DON'T it's.", "é. é́,", "İ& ", ""]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, token_store.ID).tolist() for g in got] == [library(t) for t in texts]


def test_query(spark, small, texts, library):
    got, start = {r.doc_id: r for r in token_store.query(spark, small).collect()}, 0
    for i in sorted(texts):
        ids = [*library(texts[i]), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_format_and_selective_reads(spark, small, library, texts):
    path = storage.new_path(spark, "tokens")
    token_store.write(storage.table(spark, small, "documents"), path, PATH, metadata=("lang", "source"), row_group_bytes=20_000, page_rows=10, files=3)
    files = sorted(f for f in spark.read.parquet(path).inputFiles())
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    column = next(meta.row_group(0).column(k) for k in range(meta.num_columns) if meta.row_group(0).column(k).path_in_schema.startswith("tokens"))
    assert any("DICTIONARY" in e for e in column.encodings) and column.has_offset_index
    some = token_store.read(spark, path, ("doc_id", "tokens"), ids=(5, 9))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5)" in some._jdf.queryExecution().toString()
    assert {r.doc_id: r.tokens for r in some.collect()} == {i: [*library(texts[i]), 2] for i in range(5, 10)}
    lengths = token_store.read(spark, path, ("doc_id", "n_tokens", "lang"))
    assert "tokens:array" not in lengths._jdf.queryExecution().toString() and lengths.count() == len(texts)


def test_edge_rows(spark, edge, empty, library):
    path = storage.new_path(spark, "tokens")
    token_store.write(edge.withColumn("place", F.lit(9)), path, PATH, metadata=("lang", "a.b", "place"), files=2)
    rows = token_store.read(spark, path, ("doc_id", "start", "n_tokens", "tokens")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1, 2, 3, 5, 6, 7]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(9)]
    assert rows[4].tokens == rows[5].tokens == rows[7].tokens == [2] and rows[6].tokens == [*library("word " * 60_000 + "end"), 2]
    path = storage.new_path(spark, "tokens")
    token_store.write(empty, path, PATH)
    assert token_store.read(spark, path).count() == 0
