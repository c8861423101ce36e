"""Sessions, subtotals, mergeable sketches and differences between versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretide.operators.cells import hour, runs

HLL_BITS = 12  #: a sketch of at most 4 KB counts within some 1.6 % (one deviation)
HLL_ERROR = 0.08  #: five deviations
KLL_SIZE = 200  #: values a level keeps; ranks are within 1.65 % with 99 % confidence
RANK_ERROR = 0.04


def sessions(rows: DataFrame, key: list[str], at: str, gap: str) -> DataFrame:
    """``(key, from_time, to_time, n)``: rows of a key each at most ``gap`` after the one before; a session ends a gap after
    its last row.

    Sessions are found within hour cells and joined over them, as a key may hold very many rows; a session is summed before
    it is shuffled.  Rows without key or moment are in none.
    """
    known = rows.select(*key, F.col(at).alias("__at")).where(F.col("__at").isNotNull())
    for k in key:
        known = known.where(F.col(k).isNotNull())
    # rows of one moment are together in any case, so one row a moment decides
    moments = known.groupBy(*key, "__at").agg(F.count("*").alias("__rows"))
    near = lambda now, before: now <= before + F.expr(f"INTERVAL {gap}")
    placed = runs(moments, key, hour("__at"), ["__at"], "__at", near, "__run")
    counted = placed.groupBy(*key, F.col("__run.__at").alias("from_time")).agg(F.max("__at").alias("__last"), F.sum("__rows").alias("n"))
    return counted.select(*key, "from_time", (F.col("__last") + F.expr(f"INTERVAL {gap}")).alias("to_time"), "n")


def subtotals(rows: DataFrame, columns: list[str], sets: list[list[str]], *sums: Column) -> DataFrame:
    """Sums of each set of columns; ``level`` has a bit for each column that a row sums over, the last column's the lowest, so
    that a null group is told from a subtotal."""
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.grouping_id(*columns).cast("int").alias("level"), *sums)


def daily_sketches(rows: DataFrame, key: list[str], counted: str, value: str) -> DataFrame:
    """For each key a sketch of the different values of ``counted`` and one of the ranks of ``value``; both merge, and null
    counts for nothing in either."""
    return rows.groupBy(*key).agg(F.hll_sketch_agg(counted, HLL_BITS).alias("counted_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("value_sketch"))


def merged(sketches: DataFrame, key: list[str]) -> DataFrame:
    """``(key, n_counted, median)`` of all sketches of a key."""
    both = sketches.groupBy(*key).agg(F.hll_union_agg("counted_sketch").alias("__counted"), F.kll_merge_agg_double("value_sketch").alias("__values"))
    return both.select(*key, F.hll_sketch_estimate("__counted").alias("n_counted"), F.kll_sketch_get_quantile_double("__values", F.lit(0.5)).alias("median"))


def compared(rows: DataFrame, daily: DataFrame, key: list[str], day: str, counted: str, value: str, spans: tuple[int, ...]) -> DataFrame:
    """For the last days of each span the exact numbers beside those of the merged sketches: ``users`` and ``n_counted``, ``n``,
    ``median`` and ``rank_error`` (how far the estimate's ranks are from one half), and whether both are within their bounds.

    Spans are a few numbers, by which rows are repeated; the estimates are one row for each key and span.
    """
    today = rows.agg(F.max(day)).scalar()
    span = lambda df: df.withColumn("days", F.explode(F.array(*[F.lit(s) for s in spans]))).where(F.col(day) > F.date_sub(today, F.col("days")))
    as_one = F.struct(*key, "days").alias("__of")  # a null key is a key
    guessed = merged(span(daily), [*key, "days"]).select(as_one, "n_counted", "median")
    asked = span(rows).select("*", as_one)
    exact = asked.groupBy("__of").agg(F.count_distinct(counted).alias("users"), F.count("*").alias("n"))
    below = asked.join(guessed.select("__of", F.col("median").alias("__median")), "__of")
    share = lambda holds: F.count_if(holds) / F.count(value)
    # a merged sketch of ranks draws by chance, so the median is told beside the ranks that were counted for it
    ranks = below.groupBy("__of").agg(F.max("__median").alias("median"), share(F.col(value) < F.col("__median")).alias("__low"), share(F.col(value) <= F.col("__median")).alias("__high"))
    found = exact.join(guessed.select("__of", "n_counted"), "__of").join(ranks, "__of")
    error = F.greatest(F.lit(0.0), F.col("__low") - 0.5, F.lit(0.5) - F.col("__high"))
    near = F.abs(F.col("n_counted") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * HLL_ERROR)
    return found.select("__of.*", "users", "n_counted", "n", "median", error.alias("rank_error"), near.alias("users_within"), (error <= RANK_ERROR).alias("median_within"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both tables with ``n_more``: how often more ``after`` has a row than ``before``; equal rows, nulls included,
    are one.  One aggregate over both, so nothing is joined and a row that repeats very often is summed first."""
    columns = before.columns
    both = before.withColumn("__n", F.lit(-1).cast("long")).unionByName(after.withColumn("__n", F.lit(1).cast("long")))
    return both.groupBy(*columns).agg(F.sum("__n").alias("n_more")).where("n_more <> 0")


def changes_by_key(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``(key, kind, fields)`` for every key whose row was ``added``, is ``gone``, or has ``changed`` in some fields; a key is
    unique in either table, and a null key is a key."""
    fields = [c for c in before.columns if c not in key]
    sides = before.select(F.struct(*key).alias("__key"), F.struct(*fields).alias("__old"), F.lit(None).cast(before.select(F.struct(*fields).alias("s")).schema["s"].dataType).alias("__new"))
    sides = sides.unionByName(after.select(F.struct(*key).alias("__key"), F.lit(None).cast(sides.schema["__old"].dataType).alias("__old"), F.struct(*fields).alias("__new")))
    met = sides.groupBy("__key").agg(F.max("__old").alias("__old"), F.max("__new").alias("__new"))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "gone").otherwise("changed")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"__old.{f}").eqNullSafe(F.col(f"__new.{f}")), F.lit(f)) for f in fields]))
    names = F.when(kind == "changed", differ).otherwise(F.array().cast("array<string>"))
    return met.where(~F.col("__old").eqNullSafe(F.col("__new"))).select("__key.*", kind.alias("kind"), names.alias("fields"))
