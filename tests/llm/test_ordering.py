from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caretide.llm.ordering import numbered


@pytest.mark.parametrize("nulls_first", [True, False])
def test_places_follow_the_order_of_each_group(spark, nulls_first):
    order = F.col("v").asc_nulls_first() if nulls_first else F.col("v").desc_nulls_last()
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", None if i % 13 == 0 else i * 37 % 101) for i in range(600)]
    found = numbered(spark.createDataFrame(rows, "id int, g string, v int").repartition(5), [order, "id"], ["g"], "place", "n").collect()
    groups = defaultdict(list)
    for r in found:
        groups[r.g].append(r)
    expected = defaultdict(list)
    for i, g, v in rows:
        expected[g].append((i, v))
    for g, own in groups.items():
        key = (lambda r: (r[1] is not None, r[1] or 0, r[0])) if nulls_first else (lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        assert [r.id for r in sorted(own, key=lambda r: r.place)] == [i for i, _ in sorted(expected[g], key=key)]
        assert {r.place for r in own} == set(range(len(own))) and {r.n for r in own} == {len(own)}


def test_equal_rows_spread_over_tasks(spark):
    found = numbered(spark.range(8000).select(F.lit(1).alias("v")).repartition(4), ["v"], (), "place", "n")
    assert Counter(r.place for r in found.collect()) == Counter(range(8000))
    stored = [p for p in found.inputFiles() if "-ranged/" in p]
    assert len(stored) >= 3 and max(spark.read.parquet(p).count() for p in stored) < 4000


def test_no_rows(spark):
    assert numbered(spark.createDataFrame([], "g string, v int"), ["v"], ["g"]).collect() == []
