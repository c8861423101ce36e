"""Nested documents: flattening, boards, and series turned into matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(df: DataFrame, array: str, fields: list[str], keep: list[str], into: str = "ordinal") -> DataFrame:
    """One row for each struct of an array, with its place from 1; rows with an empty or null array give none."""
    found = df.select(*keep, F.posexplode(array).alias("__at", "__item"))
    return found.select(*keep, (F.col("__at") + 1).cast("long").alias(into), *[F.col(f"__item.{f}").alias(f) for f in fields])


def gathered(df: DataFrame, group: list[str], order: str, fields: list[str], into: str) -> DataFrame:
    """The inverse: an array of structs for each group, in the order of a column.  Groups are to be of bounded size."""
    items = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return df.groupBy(*group).agg(items.alias(into))


def matrix(points: DataFrame, ids: list[str], slot: str, slots: list, metrics: list[str]) -> DataFrame:
    """Points (ids, slot, one column for each metric) to one row for each metric and one column for each slot.

    A later point of the same slot must not exist; absent points stay null.
    """
    long = points.unpivot([*ids, slot], metrics, "metric", "value")
    return long.groupBy(*ids, "metric").pivot(slot, slots).agg(F.max("value"))


def built(required: dict[str, Column], optional: dict[str, Column], present: Column) -> Column:
    """A struct whose optional members are null where ``present`` does not hold."""
    return F.struct(*[c.alias(n) for n, c in required.items()], *[F.when(present, c).alias(n) for n, c in optional.items()])


def by_name(columns: list[str], name: Column) -> Column:
    """The value of the column that another column names, as text; null for other names."""
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])[name]


def has_any(array: str) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0
