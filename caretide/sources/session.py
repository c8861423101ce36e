"""Sessions: one place for the settings that plans count on, and a scope that always ends what it began."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Plans are changed as they run: partitions joined, skewed joins split, small sides broadcast once their size is known.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "caretide", master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one with ``SETTINGS`` and ``settings`` (dots of a name as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def scope(name: str = "caretide", master: str | None = None, **settings: str) -> Iterator[SparkSession]:
    """A session for a block of work.  One that was there before stays, with its own settings for the block; a new one is
    stopped whatever happens."""
    running = SparkSession.getActiveSession()
    if running is not None:
        own = running.newSession()
        for key, value in settings.items():
            own.conf.set(key.replace("__", "."), value)
        yield own
        return
    started = session(name, master, **settings)
    try:
        yield started
    finally:
        started.stop()
