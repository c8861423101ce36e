"""Reading, writing and probing stored tables; JSON rows in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder; filters and column choices reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the five tables, under its declared schema."""
    return spark.read.schema(schemas.schema(name)).parquet(f"{folder}/{name}")


def create_missing(spark: SparkSession, database: str | None = None) -> list[str]:
    """Create each declared table that does not exist; gives the names of all."""
    names = []
    for name, ddl in schemas.DDL.items():
        full = f"`{database}`.`{name}`" if database else f"`{name}`"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({ddl}) USING parquet")
        names.append(name)
    return names


def over_jdbc(spark: SparkSession, url: str, name: str, key: str = "id", bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table, read in ``parts`` key ranges when bounds are given; fails at once without a URL."""
    if not url:
        raise ValueError("no database URL")
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, pushDownPredicate="true", **options)
    if bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def alive(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))


def connected(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 1 AS result")


def decoded(rows: DataFrame, schema: T.StructType | str, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON bodies as columns, the names of the keys present as ``set_fields``, and ``code`` 422 where one is no row.

    A key that is present with null is named in ``set_fields``; an absent one is not: a patch needs the difference.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col(body), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    present = F.array_intersect(known, F.coalesce(F.json_object_keys(F.col(body)), F.array().cast("array<string>")))
    bad = F.col("__row").isNull() | F.col("__row._bad").isNotNull()
    found = rows.select(*keep, present.alias("set_fields"), parsed.alias("__row"))
    return found.select(*keep, "set_fields", *[F.col(f"__row.{f.name}").alias(f.name) for f in schema.fields], F.when(bad, F.lit(422)).alias("code"))


def encoded(rows: DataFrame, columns: list[str] | None = None, into: str = "body") -> Column:
    """A row as JSON; nulls are written, so that every column of the response is there."""
    return F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}).alias(into)
