"""What came before a row of its key, without ordering all rows of a key in one task.

Rows of a key lie in cells that grow along the order: hours, or blocks of a log's numbers.  A task orders the rows of a cell;
a cell carries one row, its last value, to the cells after it.  A key may hold a third of all rows or more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEFORE_ALL = -(2**63)


def hour(at: str) -> Column:
    """Cells for an order by moment, from its parts: a cast of one without a zone would fold hours of a clock change."""
    return (F.unix_date(F.to_date(at)).cast("long") * 24 + F.hour(at)).cast("long")


def minute(at: str) -> Column:
    """Finer cells for the same; a key has half a million of them a year at most."""
    return hour(at) * 60 + F.minute(at)


def block(number: str, bits: int) -> Column:
    """Cells for an order by number."""
    return F.shiftright(F.col(number).cast("long"), bits)


def carried(df: DataFrame, key: Sequence[str], cells: Column | Sequence[Column], order: Sequence[str], value: Column, into: str, initial: DataFrame | None = None) -> DataFrame:
    """Adds ``into``: the last ``value`` that is not null of the key's earlier rows, by ascending ``order``.

    ``cells`` are one level or several, each within the one before, as a day and its minutes: a task orders the rows of a cell of
    the last level, or the cells of one cell above.  ``initial`` has the key's columns and ``value``, what holds before a key's
    first row, for a key once at most.  Rows with a null in the key or without a cell get null, and stay out of the shuffle.
    """
    levels = {f"__cell{k}": c for k, c in enumerate([cells] if isinstance(cells, Column) else cells)}
    marked = df.withColumns({**levels, "__value": value})
    whole = F.lit(True)
    for k in [*key, *levels]:
        whole = whole & F.col(k).isNotNull()
    placed, none = marked.where(whole), marked.where(~whole)
    names = list(levels)
    ends = {len(names): placed.groupBy(*key, *names).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__end"))}
    for n in range(len(names) - 1, 0, -1):  # the last value of a cell is that of its last cell that has one
        ends[n] = ends[n + 1].groupBy(*key, *names[:n]).agg(F.max_by("__end", F.when(F.col("__end").isNotNull(), F.col(names[n]))).alias("__end"))
    if initial is not None:
        ends[1] = ends[1].unionByName(initial.select(*key, F.lit(BEFORE_ALL).alias(names[0]), F.col("value").alias("__end")), allowMissingColumns=True)
    begins = None
    for n in range(1, len(names) + 1):
        earlier = Window.partitionBy(*key, *names[: n - 1]).orderBy(names[n - 1]).rowsBetween(Window.unboundedPreceding, -1)
        here = ends[n].select(*key, *names[:n], F.last("__end", ignorenulls=True).over(earlier).alias("__begin"))
        if begins is not None:
            above = begins.withColumnRenamed("__begin", "__above")
            here = here.join(above, [*key, *names[: n - 1]]).select(*key, *names[:n], F.coalesce("__begin", "__above").alias("__begin"))
        begins = here
    rows = Window.partitionBy(*key, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("__own", F.last("__value", ignorenulls=True).over(rows))
    found = own.join(begins, [*key, *names], "left").withColumn(into, F.coalesce("__own", "__begin"))
    empty = F.lit(None).cast(marked.schema["__value"].dataType)
    return found.select(*df.columns, into).unionByName(none.select(*df.columns, empty.alias(into)))


def runs(df: DataFrame, key: Sequence[str], cell: Column, order: Sequence[str], value: str, goes_on: Callable[[Column, Column], Column], into: str) -> DataFrame:
    """Adds ``into``: the ``order`` columns of the row that began the run that a row is in, by ascending ``order``.

    ``goes_on(value, before)`` tells whether a value goes on with the run of the one before; the first of a key does not.  Key,
    cell and value are not null.  Runs are found within cells; a cell's first and last value and its last beginning are
    joined over the cells of a key, and one row a cell says which run its first row is in.
    """
    begins_at = F.struct(*order)
    rows = Window.partitionBy(*key, "__cell").orderBy(*order)
    placed = df.withColumn("__cell", cell)
    seen = placed.withColumns({"__before": F.lag(value).over(rows), "__nth": F.row_number().over(rows)})
    inner = seen.withColumn("__begins", F.when((F.col("__nth") > 1) & ~F.coalesce(goes_on(F.col(value), F.col("__before")), F.lit(False)), begins_at))
    own = inner.withColumn("__own", F.last("__begins", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    ends = inner.groupBy(*key, "__cell").agg(F.min(begins_at).alias("__first_at"), F.min_by(value, begins_at).alias("__first"), F.max_by(value, begins_at).alias("__last"), F.max("__begins").alias("__inner"))
    cells = Window.partitionBy(*key).orderBy("__cell")
    opens = F.when(~F.coalesce(goes_on(F.col("__first"), F.col("__previous")), F.lit(False)), F.col("__first_at"))
    joined = ends.withColumn("__previous", F.lag("__last").over(cells)).withColumn("__opens", opens)
    carry = F.last(F.coalesce("__inner", "__opens"), ignorenulls=True).over(cells.rowsBetween(Window.unboundedPreceding, -1))
    starts = joined.select(*key, "__cell", F.coalesce("__opens", carry).alias("__start"))
    return own.join(starts, [*key, "__cell"]).select(*df.columns, F.coalesce("__own", "__start").alias(into))
