"""Places for stored intermediate and committed tables, on storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Without the setting a local master gets a temporary one, once per session;
    on a cluster that would be another folder on every machine, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        jsc = context._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="caretide-"))
        named = jsc.getCheckpointDir().get()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the application ends."""
    path = f"{shared_folder(spark)}/caretide/{uuid.uuid4().hex}-{name}"
    fs, hadoop_path = file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = file_system(spark, path)
    fs.delete(hadoop_path, True)


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path
