"""Shared-folder storage and small helpers that every corpus operator uses.

Intermediate tables are written to the folder named by ``spark.checkpoint.dir``, which driver and executors share, so a
lost executor costs a re-read and never a result.  Where the setting is missing, a local master gets a temporary folder;
on a cluster that is an error.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from caretide.sources.scratch import new_path, remove, shared_folder

__all__ = ["map_arrow", "materialize", "new_path", "prepare", "remove", "shared_folder", "shuffle_partitions", "table"]


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most ``rows`` rows, so a batch of long texts fits a Python worker; workers that find this package.

    The first is a setting of the session and stays lower, as plans read it only when they run; it is never raised.  The second matters where the driver has the package on its own path only; a cluster gets it by ``--py-files`` as ever.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for columns of any name: a name with a dot would be taken for a field of a struct."""
    names = df.columns
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)
