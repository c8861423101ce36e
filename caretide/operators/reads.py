"""Keyed reads, optional filters and the parent gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caretide.operators.cells import carried, minute


def by_key(df: DataFrame, **key) -> DataFrame:
    """Rows whose columns equal the values; the equalities are pushed to the scan."""
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def optional_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """An exact, case-sensitive filter that null and the empty string leave out of the plan."""
    return df.where(F.col(column) == value) if value else df


def children(parents: DataFrame, kids: DataFrame, key, foreign: str, primary: str = "id") -> DataFrame:
    """Children of one parent with ``found`` true; one row with ``found`` false and nulls if there is no such parent.

    A parent without children gives no rows, which is another answer than a missing parent.
    """
    parent = by_key(parents, **{primary: key}).select(F.col(primary).alias("__key"))
    own = by_key(kids, **{foreign: key}).join(parent, F.col(foreign) == F.col("__key"), "left_semi").withColumn("found", F.lit(True))
    asked = kids.sparkSession.range(1).select(F.lit(key).alias("__asked"))
    missing = asked.join(parent, F.col("__asked") == F.col("__key"), "left_anti").select(F.lit(False).alias("found"))
    return own.unionByName(missing, allowMissingColumns=True)


def gate(rows: DataFrame, parents: DataFrame, foreign: str, primary: str = "id") -> DataFrame:
    """Every row with ``found``: whether its parent exists.  The key side is one distinct column."""
    keys = parents.select(F.col(primary).alias("__key")).distinct()
    return rows.join(keys, rows[foreign] == F.col("__key"), "left").withColumn("found", F.col("__key").isNotNull()).drop("__key")


ID_BLOCK = 20  #: bits of an id that a cell leaves open: at most a million rows with different ids


def by_id(id: str, newest_first: bool = False) -> list[Column]:
    """Cells for an order by id: one for each million ids."""
    block = F.shiftright(F.col(id).cast("long"), ID_BLOCK)
    return [-block if newest_first else block]


def by_time(at: str, id: str, newest_first: bool = True) -> list[Column | list[Column]]:
    """Cells for an order by moment, then id: minutes, and within one its moments in blocks of a million ids.

    All rows may have one day, one second or one moment; no cell has more rows than a block has ids.
    """
    # from the parts of the moment, as a cast of one without a zone would fold hours of a clock change
    minute = F.unix_date(F.to_date(at)).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)
    micros = (F.extract(F.lit("SECOND"), F.col(at)) * 1_000_000).cast("long")
    cell = [micros, F.shiftright(F.col(id).cast("long"), ID_BLOCK)]
    return [-minute, [-c for c in cell]] if newest_first else [minute, cell]


def positioned(df: DataFrame, cells: Column | list[Column | list[Column]], order: list[Column], into: str = "position", within: list[str] | None = None) -> DataFrame:
    """The place of every row in a total order (of its group of ``within``), without sorting all rows in one task.

    ``cells`` are coarse longs that grow along the order, one level below the other; a level may have several columns.
    Rows are numbered within their cell, and the counts of earlier cells are added level by level: a task sees the rows of
    a cell, the cells of one cell above it, or the cells of the top level, which the caller keeps to some millions.
    """
    within, levels, names = list(within or []), [], []
    for k, level in enumerate(cells if isinstance(cells, list) else [cells]):
        columns = level if isinstance(level, list) else [level]
        levels.append([f"__cell{k}_{j}" for j in range(len(columns))])
        # a cell is never null, so the joins ask for the very partitions that the numbering has made
        names += [F.coalesce(c.cast("long"), F.lit(-(2**63))).alias(n) for n, c in zip(levels[-1], columns)]
    keyed = df.select("*", *names, *[F.struct(F.col(c)).alias(f"__in_{c}") for c in within])
    groups = [f"__in_{c}" for c in within]
    own = groups + [n for level in levels for n in level]
    counts, before = keyed.groupBy(*own).agg(F.count("*").alias("__n")), None
    for k, level in enumerate(levels):
        above = groups + [n for upper in levels[:k] for n in upper]
        cell = counts if k == len(levels) - 1 else counts.groupBy(*above, *level).agg(F.sum("__n").alias("__n"))
        earlier = (Window.partitionBy(*above) if above else Window).orderBy(*level)
        here = cell.select(*above, *level, (F.sum("__n").over(earlier) - F.col("__n")).alias(f"__before{k}"))
        before = here if before is None else here.join(before, above)
    offset = sum((F.col(f"__before{k}") for k in range(1, len(levels))), F.col("__before0"))
    numbered = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    placed = numbered.join(before, own)
    return placed.select(*df.columns, (offset + F.col("__nth")).cast("long").alias(into))


def as_of(asked: DataFrame, known: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``asked`` with the ``value`` of the latest row of ``known`` of the same key at or before the moment, null if none.

    A null key or moment finds none, and does not meet others in one place; of known rows of equal key and moment any one
    counts.  Both sides are laid together in minutes of a key, so a task sorts a key's minute, never all of a key.
    """
    held = F.when(~F.col("__asks"), F.struct(F.col(value).alias("v")))  # wrapped: a value may be null itself
    blank = asked.withColumn(value, F.lit(None).cast(known.schema[value].dataType)).withColumn("__asks", F.lit(True))
    # a known row without a key or a moment is found by none
    both = known.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, value, F.lit(False).alias("__asks")).unionByName(blank, allowMissingColumns=True)
    # of one moment the known rows come first
    found = carried(both, [key], minute(at), [at, "__asks"], held, "__found").where("__asks")
    return found.select(*[F.col("__found")["v"].alias(value) if c == value else F.col(c) for c in [*asked.columns, value]])
