"""The event table as append batches, and snapshots of the state they fold to.

A batch is a folder that one append writes whole. A snapshot holds the partial state of every fold and
the names of the batches in it; the state now is that of the newest snapshot merged with the other batches, whatever
the times of their events. So a step reads what was appended since, not the history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from capledger.operators.registry import FOLDS, Fold
from capledger.schemas import TABLES
from capledger.session import stage
from capledger.sources.sinks import folders
from capledger.sources.tables import reconcile

BATCH = "batch="


class EventLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.events_path, self.state_path = f"{self.root}/registry_events", f"{self.root}/registry_state"

    def append(self, events: DataFrame, stamp: str) -> None:
        """One more batch; ``stamp`` begins its name. A retry writes a batch of the same events, which no fold notices."""
        reconcile(events, TABLES["registry_events"]).write.parquet(f"{self.events_path}/{BATCH}{stamp}-{uuid.uuid4().hex}")

    def batches(self) -> list[str]:
        return [f for f in folders(self.spark, self.events_path) if f.startswith(BATCH)]

    def events(self, batches: list[str] | None = None) -> DataFrame:
        """The events of some batches, or of all; only their files are listed and read."""
        schema = TABLES["registry_events"]
        names = self.batches() if batches is None else batches
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.events_path}/{n}" for n in names])

    def _newest(self) -> str | None:
        """The newest whole snapshot; the list of its batches is written last."""
        for name in reversed(folders(self.spark, self.state_path)):
            if "batches" in folders(self.spark, f"{self.state_path}/{name}"):
                return f"{self.state_path}/{name}"
        return None

    def _parts(self) -> tuple[str | None, list[str]]:
        """The newest snapshot and the batches it has not seen."""
        newest = self._newest()
        if newest is None:
            return None, self.batches()
        seen = {r["name"] for r in self.spark.read.schema("name string").parquet(f"{newest}/batches").collect()}
        return newest, [b for b in self.batches() if b not in seen]

    def _partial(self, name: str, fold: Fold, newest: str | None, later: list[str]) -> DataFrame:
        if newest is None:
            return fold.state(self.events(later))
        known = self.spark.read.schema(fold.state(self.events([])).schema).parquet(f"{newest}/{name}")
        return fold.merge(known, self.events(later)) if later else known

    def state(self, name: str) -> DataFrame:
        """What a fold of all events gives."""
        fold = FOLDS[name]
        return fold.finish(self._partial(name, fold, *self._parts()))

    def snapshot(self, stamp: str) -> None:
        """Write the state as it is; ``stamp`` must sort behind those of earlier snapshots."""
        newest, later = self._parts()
        path = f"{self.state_path}/{stamp}-{uuid.uuid4().hex}"
        tail = stage(self.events(later), "later-events")
        for name, fold in FOLDS.items():
            if newest is None:
                state = fold.state(tail)
            else:
                state = fold.merge(self.spark.read.schema(fold.state(tail).schema).parquet(f"{newest}/{name}"), tail)
            state.write.parquet(f"{path}/{name}")
        seen = self.spark.createDataFrame([], "name string")
        if newest is not None:
            seen = self.spark.read.schema("name string").parquet(f"{newest}/batches")
        seen.unionByName(self.spark.createDataFrame([(b,) for b in later], "name string")).write.parquet(f"{path}/batches")
