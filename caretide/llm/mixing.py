"""Sources mixed to target weights, by built-in functions alone: whole repeats of every document and one more by chance.

The words of each source are summed; its target is its weight's share of all words, at most ``MOST`` times what it has, and
what a source cannot take goes to the others by their weights until none is above.  The rate is the target over the source's
words: every document is emitted floor(rate) times, and once more with the probability of the rest, drawn from a digest of
the document, so that a second run draws the same.

Rows that are equal in id, source and text would all draw alike, and such a row may be a third of the table.  Only rows
whose digest repeats are numbered among their equals, by ranges that split any group, and the number takes part in the draw.

Defined cases: a null text has no words, and neither has an empty one; a document without words keeps its copies, which hold
nothing; a null source is a source and comes last; a source without words has target 0 and rate 0; a null id draws by
source and text; repeated rows draw apart; very long texts are read whole; an empty table gives no rows; ``mix`` keeps all
columns of any name but those that begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretide.llm import storage
from caretide.llm.ordering import numbered

WEIGHTS = (1, 2, 3)
MOST = 3  #: times a source may be taken
SEED = 13
DIGITS = 13  #: hex digits of a digest that make a draw: 52 bits, which a double holds exactly


def size_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def drawn(digest: Column) -> Column:
    """A number from 0 to below 1."""
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def measured(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Adds ``__source``, ``__size`` and ``__digest``, which id, source and text decide."""
    named = lambda c: F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), named(id), named(source), named(text)))
    return docs.select("*", F.col(f"`{source}`").alias("__source"), size_of(F.col(f"`{text}`")).alias("__size"), digest.alias("__digest"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, weight, target, rate)`` from ``(source, size)``; weights repeat along the sources' order.

    Each round shares what is left among the sources that are still open; the driver gets three sums of it.  What a round
    closes stays closed, as the share of a weight only grows; so a round without new ones is the last.
    """
    summed = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    placed = numbered(summed, [F.col("source").asc_nulls_last()], into="nth")
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    known = storage.materialize(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("__cap")), "sources", compression="zstd")
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    closed, share = None, F.lit(0.0)
    while True:
        shut = F.lit(False) if closed is None else F.col("weight") * share >= F.col("__cap")
        held, open_weight, n = known.agg(F.coalesce(F.sum(F.when(shut, F.col("__cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~shut, F.col("weight"))), F.lit(0.0)), F.count_if(shut)).first()
        if n == closed or not open_weight:
            break
        closed, share = n, F.lit((total - held) / open_weight)
    target = F.least(F.col("__cap").cast("double"), F.col("weight") * share)
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return known.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def _numbered_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``__nth``, a row's number among the rows of its digest."""
    repeats = storage.materialize(rows.groupBy("__digest").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("__digest").alias("__again")), "repeats", compression="zstd")
    if repeats.isEmpty():
        return rows.withColumn("__nth", F.lit(0).cast("long"))
    again = F.col("__digest") == F.col("__again")
    return rows.join(repeats, again, "left_anti").withColumn("__nth", F.lit(0).cast("long")).unionByName(numbered(rows.join(repeats, again, "left_semi"), [], ["__digest"], "__nth"))


def copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Measured rows with ``__source_size``, ``__target`` and ``__copies``, how often each is emitted."""
    by_source = rates.select(F.struct("source").alias("__in"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    again = F.md5(F.concat(F.col("__digest"), F.lit(":"), F.col("__nth").cast("string")))
    draw = drawn(F.when(F.col("__nth") == 0, F.col("__digest")).otherwise(again))
    whole = F.floor("__rate").cast("long")
    more = F.when(draw < F.col("__rate") - whole, 1).otherwise(0)
    joined = _numbered_repeats(rows).withColumn("__in", F.struct(F.col("__source").alias("source"))).join(by_source, "__in")
    return joined.withColumn("__copies", whole + more).drop("__in", "__rate", "__nth")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as its source's rate and its draw say, with all its columns."""
    rows = measured(docs, text, source, id, seed)
    sizes = storage.materialize(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")), "sizes", compression="zstd")
    counted = copies(rows, targets(sizes, weights, most)).where("__copies > 0")
    return counted.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each of the ``documents``."""
    rows = storage.materialize(measured(storage.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text", "source"), "measured", compression="zstd")
    found = copies(rows, targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size"))))
    return found.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('13:' || coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(text) || ':' || text, '-')) AS digest FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY digest) - 1 AS nth FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
p AS (SELECT *, CAST(sum(cap) OVER (ORDER BY place) - cap AS BIGINT) AS held, sum(weight) OVER (ORDER BY place DESC) AS open_weight, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) AS total FROM r),
share AS (SELECT (total - held) / open_weight AS share FROM p WHERE (total - held) / open_weight * weight < cap OR cap = 0 AND total = 0 ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * share) AS target, CASE WHEN source_size > 0 THEN least(least(CAST(cap AS DOUBLE), weight * share) / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM p, share)
SELECT n.doc_id, n.size, t.source_size, t.target, n.size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(CASE WHEN nth = 0 THEN digest ELSE md5(digest || ':' || nth) END, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source"""
