"""The corpus pipeline: five stages, each a corpus operator whose decisions take effect on the documents.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretide.llm import byte_bpe, decontaminate, pii, simhash, storage, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    settings = toxicity.Settings()
    model = toxicity.train(docs, storage.table(spark, sf_dir, "labels"), settings)
    scored = toxicity.score(docs, model, into="__toxicity")
    return scored.where(F.col("__toxicity") < settings.threshold).drop("__toxicity")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, storage.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to the name of its kind; ``n_chars`` follows."""
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of them and of the bytes that they decode to."""
    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN, ("tokens", "n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", keep_one_of_group),
    ("decontaminate", drop_leaks),
    ("pii", redact_personal_data),
    ("byte_bpe", tokenize),
]

#: Fingerprints, segment scores and merges have no SQL form; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; each result is written to the shared folder and read again.

    A stage's documents are removed once the next stage's are written, so two copies exist at most.
    """
    docs, path = storage.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        before, path = path, storage.new_path(spark, name)
        found.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            storage.remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
