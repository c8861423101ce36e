"""Which intervals hold a moment, as an equi-join: no nested loop over intervals and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 6  #: each level's bins are 2 to this power times as wide as those below
LONGEST = 60  #: bits of the longest time between two moments, in microseconds
FAR = 1 << 58  #: after every moment


def micros(at: Column) -> Column:
    """Microseconds of a moment without a zone."""
    return (F.unix_date(F.to_date(at)).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def within(moments: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, keep: list[str], bits: int = 32) -> DataFrame:
    """Every row of ``moments`` beside each interval of its key with start <= at < end: the moment's columns and ``keep``.

    Time is cut into bins of 2**bits microseconds (an hour and a bit), and levels of bins each 64 times as wide.  An interval
    lies in the bins of the lowest level on which 65 of them hold it; a moment lies in one bin of each level that any
    interval uses, which are five at most.  Key, level and bin are joined; a key's rows are spread over its
    bins, and a bin with very many moments is split by the join.

    A null end is open: it has no bound.  A null key, start or moment, and an interval that ends before it starts, match
    nothing; an interval that ends as it starts holds no moment.
    """
    levels = -(-(LONGEST - bits) // RATIO)
    first, last = micros(F.col(start)), F.coalesce(micros(F.col(end)), F.lit(FAR))
    shift = lambda value, level: F.call_function("shiftright", value, F.lit(bits) + level * RATIO)
    lasting = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (last > first)).select(F.col(key).alias("__key"), first.alias("__first"), last.alias("__last"), *keep)
    fits = F.lit(levels - 1)
    for level in reversed(range(levels - 1)):
        fits = F.when(F.col("__last") - F.col("__first") <= F.lit(1 << bits + (level + 1) * RATIO), level).otherwise(fits)
    levelled = lasting.withColumn("__level", fits.cast("int"))
    cut = levelled.withColumn("__bin", F.explode(F.sequence(shift(F.col("__first"), F.col("__level")), shift(F.col("__last") - 1, F.col("__level")))))
    used = levelled.agg(F.array_sort(F.collect_set("__level"))).scalar()  # a few numbers at most
    own = moments.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__at", micros(F.col(at))).withColumn("__own_level", F.explode(used))
    binned = own.withColumn("__own_bin", shift(F.col("__at"), F.col("__own_level")))
    met = binned.join(cut, (F.col(key) == F.col("__key")) & (F.col("__own_level") == F.col("__level")) & (F.col("__own_bin") == F.col("__bin")))
    return met.where((F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__last"))).select(*moments.columns, *keep)
