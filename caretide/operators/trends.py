"""Sustained rises and falls, and statistics of the hours before a measurement, over hour cells of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caretide.operators import cells
from caretide.operators.cells import carried, hour


def sustained(rows: DataFrame, key: list[str], at: str, id: str, value: str, least: int = 3, rising: bool = True) -> DataFrame:
    """Runs of at least ``least`` measurements in turn, each above (below) the one before: key, ``from_time``, ``to_time``,
    ``n``, ``first_value`` and ``last_value``.

    A measurement that does not go on begins a run.  Runs are found within hour cells and joined over them, so no task orders
    all rows of a key; a run is summed before it is shuffled.  Null values, keys
    and moments are no measurements; of one moment the smaller id comes first.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(at).isNotNull()).select(*key, at, id, value)
    for k in key:
        known = known.where(F.col(k).isNotNull())
    goes_on = (lambda now, before: now > before) if rising else (lambda now, before: now < before)
    placed = cells.runs(known, key, hour(at), [at, id], value, goes_on, "__run")
    order = F.struct(at, id)
    found = placed.groupBy(*key, "__run").agg(F.max(at).alias("to_time"), F.count("*").alias("n"), F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))
    return found.where(F.col("n") >= least).select(*key, F.col("__run")[at].alias("from_time"), "to_time", "n", "first_value", "last_value")


def transitions(rows: DataFrame, key: str, at: str, id: str, state: str) -> DataFrame:
    """``(key, at, id, state, state_before)`` of the rows whose state is another than that of the key's row before; the first
    has null before it.  Null states count as no row; of one moment the smaller id comes first."""
    known = rows.where(F.col(state).isNotNull()).select(key, at, id, state)
    seen = carried(known, [key], hour(at), [at, id], F.col(state), f"{state}_before")
    return seen.where(F.col(key).isNotNull() & F.col(at).isNotNull() & ~F.col(state).eqNullSafe(F.col(f"{state}_before")))


def recent(rows: DataFrame, key: str, at: str, id: str, value: str, hours: int = 4) -> DataFrame:
    """``(key, id, at, n, total, lowest, highest)`` of the values in the ``hours`` up to each measurement, both ends included.

    The frame of a moment is the end of one hour cell, some whole cells, and the beginning of its own.  Whole cells are summed
    before the shuffle; the two cut ones are running sums within a key's hour, forwards for the measurements of the hour and
    backwards for the frames that begin in it.  So a task orders the rows of a key's hour, never all of a key.  ``id`` names a
    row.  A null value counts for nothing; a row without key or moment has no frame and is left out.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, id, at, value)
    starts = known.select(key, id, (F.col(at) - F.make_dt_interval(hours=F.lit(hours))).alias("__pos"), F.lit(None).cast(known.schema[value].dataType).alias(value), F.lit(True).alias("__asks"), at)
    laid = known.select(key, id, F.col(at).alias("__pos"), value, F.lit(False).alias("__asks"), at).unionByName(starts).withColumn("__cell", hour("__pos"))
    cell = Window.partitionBy(key, "__cell")
    upto = cell.orderBy("__pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = cell.orderBy(F.col("__pos").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"n": F.count, "total": F.sum, "lowest": F.min, "highest": F.max}
    part = lambda name, f: F.when(F.col("__asks"), f(value).over(since)).otherwise(f(value).over(upto)).alias(name)
    cut = laid.select(key, id, at, "__asks", "__cell", *[part(n, f) for n, f in sums.items()])
    whole = known.withColumn("__cell", hour(at)).groupBy(key, "__cell").agg(*[f(value).alias(n) for n, f in sums.items()])
    # whole cells between the two cut ones, for every hour that has a measurement
    between = Window.partitionBy(key).orderBy("__cell").rangeBetween(-(hours - 1), -1)
    again = {"n": F.sum, "total": F.sum, "lowest": F.min, "highest": F.max}
    middle = whole.select(key, "__cell", *[f(n).over(between).alias(f"__{n}") for n, f in again.items()])
    own = cut.where("NOT __asks").join(middle, [key, "__cell"])
    ends = own.select(key, id, at, F.col("n"), "total", "lowest", "highest").unionByName(own.select(key, id, at, *[F.col(f"__{n}").alias(n) for n in sums])).unionByName(cut.where("__asks").select(key, id, at, *sums))
    # three parts of each frame
    return ends.groupBy(key, id, at).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), *[again[n](n).alias(n) for n in ("total", "lowest", "highest")])


def mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total.cast("double") / n)
