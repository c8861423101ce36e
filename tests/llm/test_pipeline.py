from __future__ import annotations

import hashlib
import itertools

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from caretide.llm import byte_bpe, decontaminate, pii, storage, toxicity
from tests_llm_plain import plain_fingerprint, plain_groups, plain_leaks


@pytest.fixture(scope="module")
def stages(spark, small):
    """Every stage's rows, each written and read again."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.materialize(stage(spark, docs, small), name)
        out.append(docs)
    return out


def by_id(df):
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == df.count()
    return rows


def test_toxicity_stage(spark, small, stages):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    expected = {r.doc_id for r in docs.collect() if scorer.score(r.text) < 0.7}
    assert set(by_id(stages[0])) == expected


def test_dedup_stage(stages):
    groups = plain_groups({i: plain_fingerprint(r.text) for i, r in by_id(stages[0]).items()})
    assert set(by_id(stages[1])) == set(groups.values())


def test_decontaminate_stage(spark, small, stages):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    before = by_id(stages[1])
    leaked = {d for d, _ in plain_leaks({i: r.text for i, r in before.items()}, items)}
    assert set(by_id(stages[2])) == set(before) - leaked


def test_pii_stage(stages):
    finder, before, after = pii.Finder(pii.learned()), by_id(stages[2]), by_id(stages[3])
    assert set(before) == set(after)
    for i, r in before.items():
        base, _ = finder.find(r.text)
        if not finder.find(r.text)[1]:
            assert after[i] == r
        assert not pii.base_spans(after[i].text) or not base
        assert after[i].n_chars == len(after[i].text)


def test_token_stage_and_run(spark, small, stages):
    ranks = byte_bpe.encoder(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN).table.ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, rows = by_id(stages[3]), by_id(stages[4])
    assert set(before) == set(rows)
    for i, r in rows.items():
        assert r.tokens == library.encode_ordinary(before[i].text) and r.n_tokens == len(r.tokens)
        assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, small).collect()} == {(i, r.ids_sha256) for i, r in rows.items()}


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontaminate", "pii", "byte_bpe"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_take_odd_rows(spark, small, edge, empty):
    """Nulls, repeated rows and more columns go through every stage; an empty table stays empty."""
    rows = edge.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("clash"))
    for docs, most in ((rows, 5), (rows.limit(0), 0)):
        for (name, stage), last in itertools.zip_longest(corpus_pipeline.STAGES, [False] * 4 + [True]):
            found = stage(spark, docs, small)
            assert last or found.columns == docs.columns
            docs = storage.materialize(found, name)
        assert docs.count() == most
    assert decontaminate.clean(empty, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
