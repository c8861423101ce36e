"""Snapshot, tail and manifests: whole or not at all, whatever fails in between."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from caretide.sources import versions
from caretide.sources.versions import Taken, Versions

SCHEMA = "k long, n long"


def fold(before, batches):
    return before.unionByName(batches).groupBy("k").agg(F.sum("n").alias("n"))


@pytest.fixture
def log(spark, tmp_path):
    return Versions(spark, str(tmp_path / "log"), SCHEMA)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_state_is_snapshot_and_tail(spark, log):
    assert log.newest().version == 0 and content(log.state(fold)) == []
    log.commit(batch(spark, (1, 1), (2, 1)), 1)
    log.commit(batch(spark, (1, 10)), 2)
    assert content(log.state(fold)) == [(1, 11), (2, 1)]
    made = log.compact(fold)
    assert made.version == 3 and made.batches == {} and content(log.snapshot()) == [(1, 11), (2, 1)] and content(log.tail()) == []
    log.commit(batch(spark, (2, 5)), 3)
    assert content(log.state(fold)) == [(1, 11), (2, 6)] and content(log.tail()) == [(2, 5)]
    log.compact(fold)
    assert content(log.snapshot()) == [(1, 11), (2, 6)]


def test_a_commit_that_is_repeated_replaces_itself(spark, log):
    log.commit(batch(spark, (1, 1)), 1)
    log.commit(batch(spark, (1, 7)), 1)
    assert content(log.state(fold)) == [(1, 7)]
    log.compact(fold)
    log.commit(batch(spark, (1, 7)), 1)  # it has gone into the snapshot
    assert content(log.state(fold)) == [(1, 7)]


@pytest.mark.parametrize("at", ["data", "manifest", "rename"])
def test_a_commit_that_dies_leaves_the_old_state(spark, log, monkeypatch, at):
    log.commit(batch(spark, (1, 1)), 1)
    if at == "data":
        broken = batch(spark, (2, 2)).withColumn("n", F.when(F.col("k") == 2, F.raise_error(F.lit("killed")).cast("long")))
        with pytest.raises(Exception, match="killed"):
            log.commit(broken, 2)
    else:

        def dies(*_):
            raise KeyboardInterrupt

        monkeypatch.setattr(*((versions, "asdict") if at == "manifest" else (Versions, "_publish")), dies)
        with pytest.raises(KeyboardInterrupt):
            log.commit(batch(spark, (2, 2)), 2)
        monkeypatch.undo()
    assert content(log.state(fold)) == [(1, 1)] and log.newest().version == 1
    log.commit(batch(spark, (2, 2)), 2)
    assert content(log.state(fold)) == [(1, 1), (2, 2)]
    assert len(log.clean()) == 1  # what the dead commit had written, whole or in part


def test_a_manifest_cut_short_is_passed_over(spark, log, tmp_path):
    log.commit(batch(spark, (1, 1)), 1)
    log.commit(batch(spark, (1, 2)), 2)
    newest = sorted((tmp_path / "log/manifests").glob("0*.json"))[-1]
    text = newest.read_text()
    for cut in ("", text[: len(text) // 2], text.replace('"whole": true', '"whole": false')):
        newest.write_text(cut)
        (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
        assert log.newest().version == 1 and content(log.state(fold)) == [(1, 1)]
    log.commit(batch(spark, (1, 5)), 2)
    assert log.newest().version == 3 and content(log.state(fold)) == [(1, 6)]


def test_commits_at_one_time_all_count(spark, log):
    threads = [threading.Thread(target=log.commit, args=(batch(spark, (k, 1)), k, 50)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert content(log.state(fold)) == [(k, 1) for k in range(4)]


def test_a_taken_number_is_refused(spark, log):
    log.commit(batch(spark, (1, 1)), 1)
    with pytest.raises(Taken):
        log._publish(versions.Manifest(1))


def test_a_batch_that_changes_while_it_is_folded_stops_the_fold(spark, log):
    log.commit(batch(spark, (1, 1)), 1)

    def slow(before, batches):
        found = fold(before, batches)
        log.commit(batch(spark, (1, 3)), 1)
        return found

    with pytest.raises(Taken):
        log.compact(slow)
    assert content(log.state(fold)) == [(1, 3)]


def test_a_batch_that_comes_while_others_are_folded_stays_in_the_tail(spark, log):
    log.commit(batch(spark, (1, 1)), 1)

    def slow(before, batches):
        found = fold(before, batches)
        log.commit(batch(spark, (2, 3)), 2)
        return found

    log.compact(slow)
    assert content(log.snapshot()) == [(1, 1)] and content(log.tail()) == [(2, 3)]


def test_a_reader_of_late_batches_opens_their_files_only(spark, log):
    for k in range(4):
        log.commit(batch(spark, (k, k)), k)
    names = {k: v for k, v in log.newest().batches.items()}
    late = log.tail(after=1)
    assert content(late) == [(2, 2), (3, 3)]
    assert {f.split("/data/")[1].split("/")[0] for f in late.inputFiles()} == {names[2], names[3]}


def test_old_readers_go_on_until_cleaned(spark, log):
    log.commit(batch(spark, (1, 1)), 1)
    old = log.newest()
    log.compact(fold)
    assert content(log.tail(manifest=old)) == [(1, 1)]
    assert log.clean(keep=1) and content(log.state(fold)) == [(1, 1)]


def test_numbers_of_folded_batches_stay_few(spark, log):
    for k in range(6):
        log.commit(batch(spark, (k, 1)), k)
        if k % 2:
            log.compact(fold)
    assert log.newest().folded == ((0, 5),) and log.newest().holds(3) and not log.newest().holds(6)
    assert versions.ranges({1, 2, 9, 4}, ((5, 7),)) == ((1, 2), (4, 7), (9, 9))
    assert content(log.state(fold)) == [(k, 1) for k in range(6)]
