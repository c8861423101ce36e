"""A log of batches as versions: each is a small manifest, written last, that names a snapshot and the batches after it.

A commit writes the rows to a folder of its own and then one manifest, under the next number, by a rename that fails where
the number is taken.  Readers take the newest manifest that is whole and read the folders that it names and no others; a
commit that dies before its rename leaves the old version as it was, and what it wrote is never looked at.  A batch that is
committed again takes the place of the one before it, so a commit may be repeated.  Compaction folds snapshot and batches
into a new snapshot; older manifests go on naming the old folders until ``clean`` removes what no kept version names.

The manifest has a line for each batch since the last snapshot and no row of data.  Committers in several processes need a
file system whose rename fails where the target exists, as that of a cluster does; within one process a lock sees to it.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.sources.scratch import file_system

_PUBLISHING = threading.Lock()
END = "whole"  #: the last key of a manifest; a file cut short has none


class Taken(RuntimeError):
    """Another commit has the number; the caller may read the newest version and try again."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    snapshot: str | None = None
    folded: tuple[tuple[int, int], ...] = ()  #: numbers of the batches in the snapshot, as first and last of ranges
    batches: dict[int, str] = field(default_factory=dict)

    def holds(self, number: int) -> bool:
        """Whether the batch has gone into the snapshot."""
        return any(lo <= number <= hi for lo, hi in self.folded)


def ranges(numbers: set[int], more: tuple[tuple[int, int], ...] = ()) -> tuple[tuple[int, int], ...]:
    """Numbers and ranges as few ranges; numbers that follow one another, as those of a stream do, make one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*more, *((n, n) for n in numbers)]):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return tuple(out)


class Versions:
    """Versions of one log in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # manifests

    def numbers(self) -> list[int]:
        """Numbers of the manifests that are there, newest first."""
        fs, folder = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _read(self, number: int) -> Manifest | None:
        fs, file = file_system(self.spark, self._name(number))
        stream = fs.open(file)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        if not found.pop(END, False):
            return None
        return Manifest(found["version"], found["snapshot"], tuple(map(tuple, found["folded"])), {int(k): v for k, v in found["batches"].items()})

    def _name(self, number: int) -> str:
        return f"{self.path}/manifests/{number:020d}.json"

    def newest(self) -> Manifest:
        """The newest whole manifest; before the first commit an empty one."""
        for number in self.numbers():
            if found := self._read(number):
                return found
        return Manifest()

    def _publish(self, manifest: Manifest) -> Manifest:
        """Write beside and rename: the number is taken by one commit only."""
        fs, target = file_system(self.spark, self._name(manifest.version))
        _, beside = file_system(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(asdict(manifest) | {END: True}).encode()))
        finally:
            stream.close()
        with _PUBLISHING:
            published = not fs.exists(target) and fs.rename(beside, target)
        if not published:
            fs.delete(beside, False)
            raise Taken(f"version {manifest.version} is taken")
        return manifest

    def _next(self) -> int:
        """After every number that is there, whole or not."""
        return max(self.numbers(), default=0) + 1

    # writing

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, batch: DataFrame, number: int, tries: int = 5) -> Manifest:
        """Make ``batch`` the log's batch ``number``.  A batch that has already gone into a snapshot is left as it is there."""
        now = self.newest()
        if now.holds(number):
            return now
        name = self._write(batch, f"batch-{number}")
        for left in reversed(range(tries)):
            now = self.newest()
            if now.holds(number):
                return now
            try:
                return self._publish(replace(now, version=self._next(), batches={**now.batches, number: name}))
            except Taken:
                if not left:
                    raise
        raise Taken("no try was allowed")

    def compact(self, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> Manifest:
        """Fold the newest version's snapshot and tail into a new snapshot.  Batches committed meanwhile stay in the tail;
        if one of those folded was replaced meanwhile, the old version stays."""
        base = self.newest()
        name = self._write(fold(self.snapshot(base), self.tail(manifest=base)), "snapshot")
        now = self.newest()
        if now.snapshot != base.snapshot or any(now.batches.get(k) != v for k, v in base.batches.items()):
            raise Taken("the versions that were folded have changed")
        rest = {k: v for k, v in now.batches.items() if k not in base.batches}
        return self._publish(Manifest(self._next(), name, ranges(set(base.batches), now.folded), rest))

    def clean(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the ``keep`` newest whole versions names; not while a commit is under way."""
        kept, named = 0, set()
        for number in self.numbers():
            found = self._read(number)
            if kept < keep and found:
                kept += 1
                named |= {found.snapshot, *found.batches.values()}
            elif kept >= keep:
                fs, file = file_system(self.spark, self._name(number))
                fs.delete(file, False)
        fs, folder = file_system(self.spark, f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named] if fs.exists(folder) else []
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]

    # reading

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def snapshot(self, manifest: Manifest | None = None) -> DataFrame:
        """Rows of the snapshot, none before the first compaction."""
        manifest = manifest or self.newest()
        return self._rows([manifest.snapshot] if manifest.snapshot else [])

    def tail(self, after: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Rows of the batches since the snapshot, or of those beyond a number; only their files are read."""
        manifest = manifest or self.newest()
        return self._rows([v for k, v in sorted(manifest.batches.items()) if after is None or k > after])

    def state(self, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """What compaction would make of the newest version."""
        manifest = self.newest()
        return fold(self.snapshot(manifest), self.tail(manifest=manifest))
