"""How filters interact: what each one removes at each place of every order, from 32 signed parity sums.

A row fails some of the filters; its failures are a mask of bits.  For every set of filters the rows are summed with the
sign of their parity: plus where they fail an even number of the set, minus where an odd one.  These sums, one aggregate for
each part and label, are the Walsh-Hadamard transform of the counts of masks, and applying the transform once more gives
the counts back exactly.  Orders are then evaluated on the counts of masks, never on rows: a filter at a place removes the
masks that have its bit and none of an earlier one.  Over all orders a row that fails k filters is removed by each of them
in 1/k of the orders, which gives the Shapley sums in closed form.

Rows of equal text are found by the digest of the text: its smallest id is an aggregate that combines before the shuffle,
and only texts that repeat are joined back, from a stored table, so that Spark can split the join of a text that very many
rows share.

Defined cases: a null text is an empty one, and empty texts are equal to one another; a row without an id is never smaller
than another, nor is any id smaller than it, so it repeats nothing; rows of equal id and text do not repeat one another;
a null part is the empty string; several label rows of an id count as one that has every mark of them; labels without a
document, and null labels, mark nothing; very long texts are read whole; an empty table gives no rows; only the columns named
are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretide.llm import storage

FILTERS = "ABCDE"
MOST_FILTERS = 6  #: 64 sums and 720 orders; the result has every order of the filters


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """What a text alone decides: A under 200 words, B half of them repeat, C over 3 % capitals, D a mark of markup."""
    n, capitals = F.size(words).cast("long"), F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {"A": n < 200, "B": F.size(F.array_distinct(words)).cast("long") * 100 < n * 50, "C": capitals * 100 > F.length(text).cast("long") * 3, "D": text.rlike(r"[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, A, B, C, D, E, good, toxic)`` for every row of ``docs(doc_id, text, lang)``."""
    plain = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    own = plain.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("print"), *[c.alias(k) for k, c in text_failures(F.col("text"), F.col("words")).items()])
    rows = storage.materialize(own, "failures", compression="zstd")
    found = rows.groupBy("print").agg(F.min("doc_id").alias("__first"), F.count("*").alias("__rows")).where("__rows > 1 AND __first IS NOT NULL")
    first = storage.materialize(found.select(F.col("print").alias("__print"), "__first"), "repeated", compression="zstd")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    marks = storage.materialize(marks, "marks", compression="zstd")  # stored, so that the join has exchanges of its own
    joined = rows.join(first, F.col("print") == F.col("__print"), "left").join(marks, F.col("doc_id") == F.col("__id"), "left")
    repeats = F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False))
    return joined.select("part", *FILTERS[:4], repeats.alias("E"), *[F.coalesce(F.col(k), F.lit(False)).alias(k) for k in ("good", "toxic")])


def _sign(mask: str, other: str) -> str:
    return f"(1 - 2 * (bit_count({mask} & {other}) % 2))"


def parity_sums(rows: DataFrame, filters: Sequence[str], part: str, labels: Sequence[str] = ()) -> DataFrame:
    """``(part, labels, s0, s1, ...)``: for every set of filters the rows, each with the sign of its failures in the set."""
    mask = sum((F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    masked = rows.select(F.col(part), *labels, mask.alias("__mask"))
    return masked.groupBy(part, *labels).agg(*[F.expr(f"sum({_sign('__mask', str(s))}) AS s{s}") for s in range(1 << len(filters))])


def cells(sums: str, n: int) -> Column:
    """From the array of sums of all sets of ``n`` filters the number of rows of every mask: the same transform, over 2**n."""
    sets = f"sequence(0, {(1 << n) - 1})"
    return F.expr(f"transform({sets}, __m -> shiftright(aggregate({sets}, 0L, (__total, __s) -> __total + {sums}[__s] * {_sign('__m', '__s')}), {n}))")


def audit(rows: DataFrame, filters: Sequence[str], part: str, labels: Sequence[str] = ()) -> DataFrame:
    """One row for each part, order of the boolean columns ``filters`` and step: ``(part, filter_order, step, kept, removed,
    redundant, unique_fails, <label>_lost, shapley)``.  ``labels`` are boolean columns as well; null is false."""
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    known = rows.select(F.col(part), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, *labels)])
    # the second sum is over a few rows a part: those with a label, and all
    whole = lambda holds: F.expr("array(" + ", ".join(f"coalesce(sum(s{s}) FILTER (WHERE {holds}), 0L)" for s in range(1 << n)) + ")")
    by_part = parity_sums(known, filters, part, labels).groupBy(part).agg(whole("true").alias("__all"), *[whole(f"`{c}`").alias(f"__{c}") for c in labels])
    counted = by_part.select(part, *[cells(f"`__{c}`", n).alias(f"__{c}") for c in ("all", *labels)])
    orders = ", ".join(f"struct('{''.join(filters[k] for k in p)}' AS name, array({', '.join(str(1 << k) for k in p)}) AS bits)" for p in permutations(range(n)))
    steps = counted.withColumn("__order", F.expr(f"explode(array({orders}))")).withColumn("step", F.expr(f"explode(sequence(1, {n}))"))
    placed = steps.withColumns({"__bit": F.expr("__order.bits[step - 1]"), "__earlier": F.expr("aggregate(slice(__order.bits, 1, step - 1), 0, (a, b) -> a | b)")})

    def total(values: str, weight: str, into: str) -> Column:
        return F.expr(f"aggregate(sequence(0, {(1 << n) - 1}), 0L, (total, m) -> total + `__{values}`[m] * {weight}) AS {into}")

    here = "int(m & __bit <> 0 AND m & __earlier = 0)"
    return placed.select(
        part, F.col("__order.name").alias("filter_order"), "step", total("all", "int(m & (__bit | __earlier) = 0)", "kept"), total("all", here, "removed"),
        total("all", "int(m & __bit <> 0 AND m & __earlier <> 0)", "redundant"), total("all", "int(m = __bit)", "unique_fails"), *[total(c, here, f"`{c}_lost`") for c in labels],
        total("all", f"if(m & __bit <> 0, {math.factorial(n)} div bit_count(m), 0L)", "shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all ``documents``, by language."""
    rows = failures(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "labels"))
    return audit(rows, FILTERS, "part", ("good", "toxic"))


ORACLE_SQL = r"""WITH marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY 1),
m AS (SELECT d.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN d.doc_id > f.first_id THEN 16 ELSE 0 END AS mask FROM d JOIN firsts f ON d.text = f.text LEFT JOIN marks k ON d.doc_id = k.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY 1, 2),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS earlier FROM o, range(1, 6) r(k)),
t AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (WHERE mask & (earlier | bit) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM t"""
