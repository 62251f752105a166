"""Snapshots of the registry state: equal to the full fold, whatever order batches come in."""

import datetime as dt
import json
import random

import pytest
from row_lists import rows

from capledger.operators import registry
from capledger.schemas import TABLES
from capledger.sources.eventlog import EventLog


def random_events(rng, n):
    out = []
    for i in range(n):
        kind = rng.choice(["uploaded", "extracted", "generated", "regenerated", "approved", "run_started", "run_ended", "other"])
        version, sql, run = f"V{rng.randrange(6)}", f"S{rng.randrange(8)}", f"R{rng.randrange(12)}"
        payload = {
            "uploaded": {"gcs_uri": f"u{i}", "supersedes": rng.choice([None, f"V{rng.randrange(6)}"])},
            "run_ended": {"run_status": rng.choice(["succeeded", "failed", None])},
        }.get(kind, {"generated_sql": f"text {i}", "model_version": f"m{i}"})
        out.append((
            i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(200)), kind, f"P{rng.randrange(3)}", rng.choice([version, version, None]),
            sql if kind in ("generated", "regenerated", "approved") or rng.random() < 0.3 else None, run if kind.startswith("run") else None,
            rng.choice(["ann", "bob", None]), rng.choice([json.dumps(payload)] * 5 + [None, "{bad"]),
        ))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_and_tail_equal_the_full_fold(spark, folder, seed):
    rng = random.Random(seed)
    log, events = EventLog(spark, folder), random_events(rng, 240)
    rng.shuffle(events)  # batches hold events of any time
    every = spark.createDataFrame(events, TABLES["registry_events"])
    for name in registry.FOLDS:
        assert log.state(name).isEmpty()
    for k in range(4):
        part = events[60 * k : 60 * k + 60] + rng.sample(events[: 60 * k + 60], 10)  # some once more
        log.append(spark.createDataFrame(part, TABLES["registry_events"]), f"{rng.randrange(1000):03d}")
        if k in (0, 2):
            log.snapshot(f"{k}")
    assert len(log.batches()) == 4 and log.events().count() == 280
    for name, fold in registry.FOLDS.items():
        assert rows(log.state(name)) == rows(fold(every)), name


def test_only_later_batches_are_read(spark, folder):
    log, events = EventLog(spark, folder), random_events(random.Random(9), 90)
    log.append(spark.createDataFrame(events[:60], TABLES["registry_events"]), "7")
    log.snapshot("a")
    early = set(log.batches())
    log.append(spark.createDataFrame(events[60:], TABLES["registry_events"]), "3")  # sorts before the batch of the snapshot
    (late,) = set(log.batches()) - early
    for name in registry.FOLDS:
        read = [f for f in log.state(name).inputFiles() if "/registry_events/" in f]
        assert read and all(f"/{late}/" in f for f in read), name
    log.snapshot("b")
    assert not [f for name in registry.FOLDS for f in log.state(name).inputFiles() if "/registry_events/" in f]
    # A snapshot that was not finished is not used.
    spark.range(1).write.parquet(f"{folder}/registry_state/c-unfinished/documents")
    assert rows(log.state("runs")) == rows(registry.run_state(spark.createDataFrame(events, TABLES["registry_events"])))


def test_state_is_narrower_than_the_events(spark, folder):
    """However often an entity changes, its state is one row."""
    events = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), "regenerated" if i else "generated", "P", "V", "S", None, "ann", '{"generated_sql": "x"}') for i in range(500)]
    state = registry.sql_version_state.state(spark.createDataFrame(events, TABLES["registry_events"]))
    assert state.count() == 1
