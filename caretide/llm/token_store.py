"""Token ids of documents in Parquet: list columns, controlled row groups and page indexes, selective reads.

``write`` orders documents by id over range partitions, encodes them and writes one row per document: the ids as a list
column (dictionary encoded; other columns dictionary or delta encoded, format version 2), the count, the place of the
document within its file and any metadata columns.  Row groups and pages have set sizes, and the Parquet writer adds
column and offset indexes, so a reader fetches only the row groups and pages of the columns and ids that it asks for.
A place over all files is the file's base plus the place within it; bases come from the counts alone.

Defined cases: a null or empty text holds the end id only.  Null ids come first; repeated rows, and rows of one id, are all
kept, in the order of the input.  Very long texts are encoded whole, some hundred texts at a time at most.  An empty table
gives no rows.  A metadata column named like a column of the format is left out.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.llm import storage

ID = np.dtype("<u4")
CACHE_WORDS = 600_000
FORMAT = ("part", "place", "doc_id", "n_tokens", "tokens")


#: A word whose tail of ASCII marks is a piece of its own; an apostrophe could begin a contraction.
TAILED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)").fullmatch


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space, by way of a bounded cache of words.

    White space separates the pieces of such a tokenizer, so a text has the ids of its words in turn.  A tail of marks
    at a word's end is a piece of its own too.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for lower-case letters in normal form, the normalizer and the pattern of the pieces have nothing to do
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit = cache_words
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _learn(self, words: set[bytes]) -> None:
        """Adds unknown words.  Words of letters alone are one piece each: many go through in one text, told apart by
        their word ends."""
        known, normal = self.known, unicodedata.is_normalized
        kinds: tuple[set, set, set] = set(), set(), set()
        tailed = []

        def sort(text: str) -> None:
            kinds[2 if not text.isalpha() else 0 if text == text.lower() and normal("NFC", text) else 1].add(text)

        for word in words:
            text = word.decode()
            if not text.isalpha() and (parts := TAILED(text)) and parts[1].lower().isalpha():
                tailed.append((word, parts[1].encode(), parts[2].encode()))
                for part in parts.groups():
                    if part.encode() not in known:
                        sort(part)
            else:
                sort(text)
        for tokenizer, group in ((self.plain, kinds[0]), (self.tokenizer, kinds[1])):
            self._joined(tokenizer, list(group))
        self._one_by_one(list(kinds[2]))
        for word, stem, tail in tailed:
            known[word] = known[stem] + known[tail]

    def _joined(self, tokenizer, words: list[str]) -> None:
        chunks = [words[lo : lo + 128] for lo in range(0, len(words), 128)]
        for chunk, encoding in zip(chunks, tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(encoding.ids, ID)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(chunk):  # each word has one end at least, so equal numbers mean one each
                self._one_by_one(chunk)
                continue
            data, lo = ids.tobytes(), 0
            for word, hi in zip(chunk, (stops * 4).tolist()):
                self.known[word.encode()] = data[lo:hi]
                lo = hi

    def _one_by_one(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.known[word.encode()] = np.array(found.ids, ID).tobytes()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of UTF-8 texts.  Some hundred at a time, so that their words are still in the processor's cache."""
        out = []
        for lo in range(0, len(texts), 128):
            # special tokens are told by their case; all else is lower-cased anyway
            parts = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts[lo : lo + 128]]
            self._learn(set().union(*parts).difference(self.known))
            known = self.known.__getitem__
            out += [b"".join(map(known, words)) for words in parts]
            if len(self.known) > self.limit:
                self.known = {}
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, metadata: tuple[str, ...] = (), text: str = "text", row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10, page_rows: int = 2_000, files: int | None = None) -> None:
    """Write ``docs`` (with ``doc_id`` and ``text``) in the token format under ``path``."""
    spark = docs.sparkSession
    storage.prepare(spark)
    kept = [c for c in metadata if c not in FORMAT]
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(f"m_{c}") for c in kept])
    ordered = rows.repartitionByRange(files or storage.shuffle_partitions(spark), "doc_id", "__row").sortWithinPartitions("doc_id", "__row")
    source = ordered.select(F.spark_partition_id().alias("part"), "doc_id", *[f"`m_{c}`" for c in kept], "__text")
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), *[T.StructField(c, docs.schema[c].dataType) for c in kept],
    ])
    end = np.array([end_id], ID).tobytes()

    def run(batches):
        enc, at = word_encoder(tokenizer), 0
        for batch in batches:
            coded = [c + end for c in enc.encode(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist())]
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            ends = np.cumsum(counts)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at + ends - counts), batch.column(1), pa.array(counts), ids, *batch.columns[2:-1]], schema.names)
            at += int(ends[-1]) if len(ends) else 0

    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows)}
    storage.map_arrow(source, run, schema).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens"), ids: tuple[int, int] | None = None) -> DataFrame:
    """The columns asked for; with ``ids`` only documents from the first to the second id, skipping other pages.

    ``start`` counts the ids of all documents before this one; it costs a read of two number columns.
    """
    stored = spark.read.parquet(path)
    wanted = stored if ids is None else stored.where(F.col("doc_id").between(*ids))
    if "start" not in columns:
        return wanted.select(*columns)
    # one row per file, and there are as many files as range partitions
    totals = sorted(stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, before = [], 0
    for part, n in totals:
        base.append((part, before))
        before += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    return wanted.join(bases, "part").withColumn("start", F.col("base") + F.col("place")).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents`` through the format: places, counts and checksums of the ids as read back."""
    import public_tokenizers

    path = storage.new_path(spark, "tokens")
    write(storage.table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("word_bpe_49k.json")), metadata=("lang", "source"))
    back = read(spark, path)
    schema = T.StructType([back.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def digests(batches):
        for batch in batches:
            lists = batch.column(3)
            cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype(ID, copy=False)
            crc = [zlib.crc32(values[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], schema.names)

    return back.mapInArrow(digests, schema)
