"""Streams with state: sessions, tier changes of each visit with a timer, and a sink into a log of versions.

Beyond the reference.  Rows may come late and out of order; what comes later than the watermark is dropped by the engine,
which counts it (``dropped``), and what a visit's state has already passed is given as ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caretide.functions import clinical
from caretide.sources.versions import Versions

CHANGES = "visit_id long, at timestamp, id long, tier string, tier_before string, what string"
STATE = "tier string, at long, id long"


def sessions(rows: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """``(key, from_time, to_time, n)``: each session once it is over, as the watermark passes its end.

    Partial sessions are merged before they are stored, so a key with very many rows sends one row a task and session.
    """
    timed = rows.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    counted = timed.groupBy(key, F.session_window("__at", gap).alias("__w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("__w.start").alias("from_time"), F.col("__w.end").alias("to_time"), "n")


def tier_changes(scores: DataFrame, late: str = "10 minutes", patience_minutes: int = 120) -> DataFrame:
    """Of a stream of ``(visit_id, id, at, percent)``: a row ``changed`` for each score that puts a visit into another tier than
    the one before, ``late`` for a score older than the visit's last one, and ``silent`` when a visit has had no score for some
    time.  Scores of a batch are taken in the order of moment and id; the state of a visit is its last tier and moment."""
    tiers = scores.select(F.col("visit_id").cast("long").alias("visit_id"), F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), clinical.tier(F.col("percent")).alias("tier"))
    known = tiers.where("visit_id IS NOT NULL AND at IS NOT NULL AND tier IS NOT NULL").withWatermark("at", late)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tier, last, last_id = state.get if state.exists else (None, None, None)
        moment = lambda us: pd.Timestamp(us, unit="us")
        out = []
        if state.hasTimedOut:
            out.append((key[0], moment(last), last_id, tier, tier, "silent"))
            state.update((tier, last, last_id))  # without a timer: told once
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
            for at, row, now in zip(rows["at"].astype("datetime64[us]").astype("int64"), rows["id"], rows["tier"]):
                if last is not None and (at, row) <= (last, last_id):
                    out.append((key[0], moment(at), row, now, tier, "late"))
                    continue
                if now != tier:
                    out.append((key[0], moment(at), row, now, tier, "changed"))
                tier, last, last_id = now, int(at), int(row)
            state.update((tier, last, last_id))
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + patience_minutes * 60_000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    return known.groupBy("visit_id").applyInPandasWithState(follow, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def into_log(rows: DataFrame, log: Versions, checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Commit every micro-batch as the log's batch of the same number.

    After a failure the engine runs a batch again under its number, with the same rows, and the commit takes the place of the
    one before; so each row is in the log once.  One checkpoint belongs to one log.
    """
    writer = rows.writeStream.foreachBatch(lambda batch, number: log.commit(batch, number) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def dropped(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over the recent batches of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
