"""Intervals, runs, frames and sessions over cells of time, against plain searches; one key has a third of the rows."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from caretide.operators import intervals, summaries, trends

START = dt.datetime(2024, 3, 10)


def moment(rng, hours=60):
    return START + dt.timedelta(seconds=rng.choice([0, 1800, 3600, *(rng.randrange(hours * 3600) for _ in range(9))]), microseconds=rng.choice([0, 0, 1]))


def measurements(rng, n=400):
    return [(i, "hot" if rng.random() < 0.33 else rng.choice(["a", "b", "c", None]), None if rng.random() < 0.03 else moment(rng), rng.choice([None, *range(12)])) for i in range(n)]


SCHEMA = "id long, k string, at timestamp_ntz, v long"


@pytest.mark.parametrize("bits", [28, 32, 40])
def test_moments_within_intervals(spark, bits):
    rng = random.Random(bits)
    points = measurements(rng)
    lengths = [None, dt.timedelta(0), dt.timedelta(microseconds=1), dt.timedelta(minutes=5), dt.timedelta(hours=7), dt.timedelta(days=900), dt.timedelta(hours=-3)]
    stays = []
    for s in range(120):
        begins, length = moment(rng), rng.choice(lengths)
        stays.append((s, rng.choice(["hot", "hot", "a", "b", None]), None if s % 31 == 0 else begins, None if length is None else begins + length))
    frame = spark.createDataFrame(points, SCHEMA)
    other = spark.createDataFrame(stays, "stay long, k string, begins timestamp_ntz, ends timestamp_ntz")
    found = intervals.within(frame, other.withColumnRenamed("k", "k2").withColumnRenamed("k2", "k"), "k", "at", "begins", "ends", ["stay"], bits)
    expected = sorted((p[0], s[0]) for p in points for s in stays if p[1] is not None and p[1] == s[1] and p[2] and s[2] and s[2] <= p[2] and (s[3] is None or p[2] < s[3]))
    assert sorted((r.id, r.stay) for r in found.collect()) == expected and expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_and_open_intervals_lie_in_few_bins(spark):
    """A century beside a second: no interval is cut into its hours."""
    stays = spark.createDataFrame([(1, "a", START - dt.timedelta(days=36_500), None), (2, "a", START - dt.timedelta(days=36_500), START), (3, "a", START, START + dt.timedelta(seconds=1))], "stay long, k string, begins timestamp_ntz, ends timestamp_ntz")
    points = spark.createDataFrame([(1, "a", START, 0), (2, "a", START - dt.timedelta(seconds=1), 0), (3, "a", dt.datetime(2999, 1, 1), 0), (4, "a", dt.datetime(1899, 1, 1), 0)], SCHEMA)
    found = intervals.within(points, stays, "k", "at", "begins", "ends", ["stay"])
    assert sorted((r.id, r.stay) for r in found.collect()) == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 1)]
    assert intervals.within(points, stays.limit(0), "k", "at", "begins", "ends", ["stay"]).count() == 0


@pytest.mark.parametrize("rising", [True, False])
def test_sustained_runs(spark, rising):
    rng = random.Random(rising)
    data = measurements(rng, 600)
    got = sorted(tuple(r) for r in trends.sustained(spark.createDataFrame(data, SCHEMA).repartition(5), ["k"], "at", "id", "v", rising=rising).collect())
    expected = []
    for k in {d[1] for d in data} - {None}:
        own, runs = sorted((d[2], d[0], d[3]) for d in data if d[1] == k and d[2] and d[3] is not None), []
        for row in own:
            if runs and (row[2] > runs[-1][-1][2] if rising else row[2] < runs[-1][-1][2]):
                runs[-1].append(row)
            else:
                runs.append([row])
        expected += [(k, r[0][0], r[-1][0], len(r), r[0][2], r[-1][2]) for r in runs if len(r) >= 3]
    assert got == sorted(expected) and len(expected) > 10


@pytest.mark.parametrize("hours", [1, 2, 4])
def test_frames_of_hours(spark, hours):
    data = measurements(random.Random(hours))
    got = {r.id: (r.n, r.total, r.lowest, r.highest) for r in trends.recent(spark.createDataFrame(data, SCHEMA).repartition(5), "k", "at", "id", "v", hours).collect()}
    expected = {}
    for i, k, at, _ in data:
        if k is not None and at is not None:
            own = [d[3] for d in data if d[1] == k and d[2] and at - dt.timedelta(hours=hours) <= d[2] <= at and d[3] is not None]
            expected[i] = (len(own), sum(own) if own else None, min(own, default=None), max(own, default=None))
    assert got == expected


def test_sessions(spark):
    data = measurements(random.Random(7))
    got = sorted(tuple(r) for r in summaries.sessions(spark.createDataFrame(data, SCHEMA), ["k"], "at", "40 minutes").collect())
    expected, gap = [], dt.timedelta(minutes=40)
    for k in {d[1] for d in data} - {None}:
        times = sorted(d[2] for d in data if d[1] == k and d[2])
        cuts = [0, *[i for i in range(1, len(times)) if times[i] > times[i - 1] + gap], len(times)]
        expected += [(k, times[a], times[b - 1] + gap, b - a) for a, b in zip(cuts, cuts[1:])]
    assert got == sorted(expected)
    built_in = spark.createDataFrame(data, SCHEMA).where("k IS NOT NULL AND at IS NOT NULL").groupBy("k", F.session_window(F.col("at").cast("timestamp"), "40 minutes")).count()
    assert sorted((r.k, r["count"]) for r in built_in.collect()) == sorted((x[0], x[3]) for x in expected)


def test_windows_order_cells_of_a_key(spark):
    """Every window is over the rows of a key's cell, or over the cells of a key: none orders the rows of a key."""
    frame = spark.createDataFrame(measurements(random.Random(1), 20), SCHEMA)
    for df in (trends.sustained(frame, ["k"], "at", "id", "v"), trends.recent(frame, "k", "at", "id", "v"), trends.transitions(frame, "k", "at", "id", "v"), summaries.sessions(frame, ["k"], "at", "1 hour")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        specs = re.findall(r"windowspecdefinition\(([^()]*)", plan)
        assert len(specs) >= 2 and all("__cell" in spec for spec in specs) and "Python" not in plan


def test_subtotals_keep_null_groups_apart(spark):
    beds = spark.createDataFrame([("z", None, 1), ("z", None, 1), ("z", "w", 1), (None, "w", 1)], "zone string, ward string, n int")
    got = {(r.zone, r.ward, r.level): r.n for r in summaries.subtotals(beds, ["zone", "ward"], [["zone", "ward"], ["zone"], []], F.count("*").alias("n")).collect()}
    assert got == {("z", None, 0): 2, ("z", "w", 0): 1, (None, "w", 0): 1, ("z", None, 1): 3, (None, None, 1): 1, (None, None, 3): 4}


def test_sketches_merge_like_sets(spark):
    rows = spark.range(20_000).select((F.col("id") % 5).alias("day"), F.when(F.col("id") % 50 != 0, F.pmod(F.hash("id"), F.lit(3000))).alias("who"), (F.col("id") % 1000).cast("double").alias("v"))
    daily = summaries.daily_sketches(rows, ["day"], "who", "v")
    got = summaries.merged(daily.withColumn("all", F.lit(1)), ["all"]).first()
    exact = rows.agg(F.count_distinct("who")).first()[0]
    assert abs(got.n_counted - exact) <= summaries.HLL_ERROR * exact and abs(got.median - 500) <= 1000 * summaries.RANK_ERROR
    at_once = summaries.merged(summaries.daily_sketches(rows.withColumn("all", F.lit(1)), ["all"], "who", "v"), ["all"]).first()
    assert at_once.n_counted == got.n_counted


def test_spans_are_compared_with_exact_numbers(spark):
    rng = random.Random(4)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(10)]
    data = [(rng.choice(["a", None]), rng.choice(days), rng.randrange(700), float(rng.randrange(300))) for _ in range(4000)] + [("a", days[-1], None, None)]
    rows = spark.createDataFrame(data, "k string, day date, who int, v double")
    found = summaries.compared(rows, summaries.daily_sketches(rows, ["k", "day"], "who", "v"), ["k"], "day", "who", "v", (1, 4, 10)).collect()
    assert len(found) == 6
    for r in found:
        own = [d for d in data if d[0] == r.k and d[1] > days[-1] - dt.timedelta(days=r.days)]
        values = [d[3] for d in own if d[3] is not None]
        assert (r.users, r.n) == (len({d[2] for d in own} - {None}), len(own)) and r.users_within and r.median_within
        low, high = sum(v < r.median for v in values) / len(values), sum(v <= r.median for v in values) / len(values)
        assert r.rank_error == pytest.approx(max(0.0, low - 0.5, 0.5 - high))


def test_differences_count_repeats_and_nulls(spark):
    schema = "id long, v string"
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "x"), (None, None)], schema)
    after = spark.createDataFrame([(1, "a"), (2, None), (2, None), (2, None), (4, "y"), (None, None)], schema)
    assert {tuple(r) for r in summaries.difference(before, after).collect()} == {(1, "a", -1), (2, None, 1), (3, "x", -1), (4, "y", 1)}
    assert summaries.difference(before, before).count() == 0
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (None, "n", 1)], "id long, v string, w int")
    new = spark.createDataFrame([(1, "a", None), (2, "B", None), (4, "d", 1), (None, None, 1)], "id long, v string, w int")
    got = {r.id: (r.kind, r.fields) for r in summaries.changes_by_key(old, new, ["id"]).collect()}
    assert got == {2: ("changed", ["v", "w"]), 3: ("gone", []), 4: ("added", []), None: ("changed", ["v"])}
