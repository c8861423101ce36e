from __future__ import annotations

import os
import re
from pathlib import Path

from caretide.llm import storage

FOLDER = Path(storage.__file__).parent


def test_tables_go_to_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = storage.new_path(spark, "thing")
    assert not named or path.startswith(named.rstrip("/") + "/caretide/")
    assert path != storage.new_path(spark, "thing") and storage.shared_folder(spark) == storage.shared_folder(spark)
    kept = storage.materialize(spark.range(5), "five")
    plan = kept._jdf.queryExecution().toString()
    assert kept.count() == 5 and "FileScan parquet" in plan and "Range" not in plan
    spark.range(3).write.parquet(path)
    storage.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))


def test_columns_of_any_name_pass(spark):
    df = spark.createDataFrame([(1, "x", None)], "`a.b` int, `c d` string, `e``f` int")
    names = df.columns
    same = storage.map_arrow(df, lambda batches: (b for b in batches if b.schema.names == names), df.schema)
    assert same.columns == df.columns and [tuple(r) for r in same.collect()] == [(1, "x", None)]


def test_batches_only_ever_shrink(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for start, end in (("10000", "1024"), ("50", "50"), ("0", "1024"), ("-1", "1024")):
            spark.conf.set(key, start)
            storage.prepare(spark)
            assert spark.conf.get(key) == end
    finally:
        spark.conf.set(key, before)


def test_operators_keep_to_the_rules():
    """Nothing local to a machine, nothing that a lost executor takes with it, no all-pairs join, no hidden import errors."""
    for file in FOLDER.glob("*.py"):
        source = file.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|\.rdd\b|except ImportError|except ModuleNotFoundError", source), file
        assert "tempfile" not in source or file.name == "storage.py"
    for file in FOLDER.parent.rglob("*.py"):
        assert FOLDER in file.parents or "caretide.llm" not in file.read_text(), file
