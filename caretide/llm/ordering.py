"""Numbers of rows in a total order of each group, with no group gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caretide.llm import storage


def numbered(df: DataFrame, order: Sequence[Column | str], group: Sequence[str] = (), into: str = "index", size: str | None = None) -> DataFrame:
    """``df`` with each row's place from 0 in the order of its group, and as ``size`` the number of rows of the group.

    Rows are dealt out by ranges of (group, order, stored number), so that a group of any size, and rows that are equal in
    all columns, spread over all tasks.  A task numbers the rows of a range; one row for each group and range carries what
    stands before it.  Rows that tie in the order take places in the order in which they were stored.

    A null group is a group; names that begin with ``__place`` are taken; nulls in the order stand where the order puts them; an empty table gives no rows.
    """
    spark, groups = df.sparkSession, [f"__place_in_{k}" for k in range(len(group))]
    keyed = df.select("*", F.monotonically_increasing_id().alias("__place_salt"), *[F.struct(F.col(c)).alias(g) for g, c in zip(groups, group)])
    salted = storage.materialize(keyed, "salted", compression="zstd")
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = salted.repartitionByRange(storage.shuffle_partitions(spark), *groups, *sort, "__place_salt").withColumn("__place_range", F.spark_partition_id())
    ranged = storage.materialize(ranged, "ranged", compression="zstd")
    counts = ranged.groupBy(*groups, "__place_range").agg(F.count("*").alias("__place_n"))
    within = Window.partitionBy(*groups)
    before = (F.sum("__place_n").over(within.orderBy("__place_range")) - F.col("__place_n")).alias("__place_before")
    totals = counts.select(*groups, "__place_range", before, F.sum("__place_n").over(within).alias("__place_size"))
    nth = F.row_number().over(Window.partitionBy(*groups, "__place_range").orderBy(*sort, "__place_salt"))
    placed = ranged.withColumn("__place_nth", nth).join(totals, [*groups, "__place_range"])
    more = [] if size is None else [F.col("__place_size").alias(size)]
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__place_before") + F.col("__place_nth") - 1).alias(into), *more)
