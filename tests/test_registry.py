import datetime as dt
import json

import pytest
from row_lists import rows
from pyspark.sql import functions as F

from capledger.operators import audit, registry
from capledger.plans import catalogue
from capledger.schemas import TABLES

T0 = dt.datetime(2024, 1, 1)


def events_of(spark, steps):
    """Steps ``(type, version, sql, run, payload)``, one hour apart."""
    data = [
        (i, T0 + dt.timedelta(hours=i), kind, "P", version, sql, run, f"actor{i}", json.dumps(payload) if payload else None)
        for i, (kind, version, sql, run, payload) in enumerate(steps)
    ]
    return spark.createDataFrame(data, TABLES["registry_events"])


def hour(n):
    return T0 + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def story(spark):
    """Two approved rule versions and three runs on P-V1; P-V2 supersedes it."""
    draft = lambda text, **more: {"generated_sql": text, "agent_trace": "{}", "extraction_json": "{}", "clause_citations": '{"summary": "first"}', "model_version": "m1", **more}
    return events_of(
        spark,
        [
            ("uploaded", "P-V1", None, None, {"gcs_uri": "u1", "supersedes": None}),  # 0
            ("generated", "P-V1", "S1", None, draft("one")),  # 1
            ("run_started", "P-V1", "S1", "R0", None),  # 2 not approved yet
            ("run_ended", "P-V1", "S1", "R0", {"run_status": "failed"}),  # 3
            ("approved", "P-V1", "S1", None, None),  # 4
            ("approved", "P-V1", "S1", None, None),  # 5 approved twice
            ("run_started", "P-V1", "S1", "R1", None),  # 6
            ("run_ended", "P-V1", "S1", "R1", {"run_status": "succeeded"}),  # 7
            ("generated", "P-V1", "S2", None, draft("two", clause_citations='{"summary": {"nested": 1}}')),  # 8
            ("approved", "P-V1", "S2", None, None),  # 9
            ("run_started", "P-V1", "S2", "R2", None),  # 10 still running
            ("uploaded", "P-V2", None, None, {"gcs_uri": "u2", "supersedes": "P-V1"}),  # 11
            ("generated", "P-V2", "S3", None, draft("three")),  # 12
            ("approved", "P-V2", "S3", None, None),  # 13
            ("regenerated", "P-V2", "S3", None, draft("three again")),  # 14 clears the approval
            ("run_started", "P-V2", "S3", "R3", None),  # 15
            ("approved", "P-V2", "S9", None, None),  # 16 never generated
            ("uploaded", "P-V3", None, None, {"gcs_uri": "u3", "supersedes": "P-V2"}),  # 17
            ("run_started", "P-V3", None, "R4", None),  # 18 no rule version
        ],
    ).cache()


def test_documents(story):
    got = {r.policy_version_id: (r.status, r.uploaded_at, r.uploaded_by, r.gcs_uri, r.supersedes_policy_version_id) for r in registry.document_state(story).collect()}
    assert got == {
        "P-V1": ("superseded", hour(0), "actor0", "u1", None),
        "P-V2": ("superseded", hour(11), "actor11", "u2", "P-V1"),
        "P-V3": ("draft", hour(17), "actor17", "u3", "P-V2"),
    }


def test_document_status_precedence(spark):
    steps = [("uploaded", "A", None, None, {}), ("uploaded", "B", None, None, {}), ("uploaded", "C", None, None, {}), ("extracted", "B", None, None, {}), ("generated", "C", "S", None, {}), ("approved", "C", "S", None, None), ("approved", "A", None, None, None), ("uploaded", "D", None, None, {"supersedes": "missing"})]
    got = {r.policy_version_id: r.status for r in registry.document_state(events_of(spark, steps)).collect()}
    assert got == {"A": "draft", "B": "extracted", "C": "approved", "D": "draft"}


def test_sql_versions(story):
    got = {r.sql_version_id: (r.validation_status, r.approved_by, r.approved_at, r.generated_sql) for r in registry.sql_version_state(story).collect()}
    assert got == {
        "S1": ("approved", "actor5", hour(5), "one"),
        "S2": ("approved", "actor9", hour(9), "two"),
        "S3": ("pending", None, None, "three again"),
    }


def test_runs_and_gate(story):
    runs = registry.run_state(story)
    got = {r.run_id: (r.run_status, r.started_at, r.ended_at) for r in runs.collect()}
    assert got["R0"] == ("failed", hour(2), hour(3)) and got["R2"] == ("running", hour(10), None)
    gate = registry.run_gate(story)
    assert {r.run_id: r.approved_at_start for r in gate.collect()} == {"R0": False, "R1": True, "R2": True, "R3": False}
    violations = {r.run_id: r.reason for r in registry.gate_violations(runs, gate).collect()}
    assert violations == {"R0": "not_approved_at_start", "R3": "not_approved_at_start", "R4": "no_sql_version"}
    orphans = registry.orphan_events(story, registry.sql_version_state(story))
    assert [(r.event_id, r.sql_version_id) for r in orphans.collect()] == [(16, "S9")]


def test_order_within_one_instant(spark):
    """Equal times: drafts come first, then approvals, then starts, whatever their ids."""
    at = [("generated", 1), ("approved", 2), ("run_started", 3), ("regenerated", 4), ("run_started", 5)]
    data = [(i, T0, kind, "P", "P-V1", "S", f"R{i}" if kind == "run_started" else None, "a", "{}") for kind, i in at]
    events = spark.createDataFrame(data, TABLES["registry_events"])
    assert {r.run_id: r.approved_at_start for r in registry.run_gate(events).collect()} == {"R3": True, "R5": True}
    assert registry.sql_version_state(events).first().validation_status == "approved"
    later = events.where("event_type <> 'approved'").unionByName(
        events.where("event_type = 'approved'").withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 1 SECOND"))
    )
    assert not any(r.approved_at_start for r in registry.run_gate(later).collect())


def test_retried_events_change_nothing(story):
    twice = story.unionByName(story)
    for fold in (registry.document_state, registry.sql_version_state, registry.run_state):
        assert rows(fold(twice)) == rows(fold(story))
    for fold in (registry.run_gate, registry.extractions):
        assert rows(fold(twice)) == rows(fold(story))
    runs = registry.run_state(story)
    assert rows(registry.gate_violations(runs, registry.run_gate(twice))) == rows(registry.gate_violations(runs, registry.run_gate(story)))


def test_lookups(story):
    docs, sqls = registry.document_state(story), registry.sql_version_state(story)
    assert rows(audit.latest_approved_sql(sqls).drop("agent_trace")) == [("P-V1", "S2", hour(9), "two")]
    assert rows(audit.latest_policy_version(docs)) == [("P", "P-V3", 3)]
    baseline = audit.superseded_baseline(docs, sqls)
    uris = {r.policy_version_id: r.gcs_uri for r in docs.collect()}
    assert all(r.supersedes_gcs_uri == uris[r.supersedes_policy_version_id] for r in baseline.collect())
    assert rows(baseline.drop("supersedes_gcs_uri")) == [("P-V2", "P-V1", "S2"), ("P-V3", "P-V2", None)]
    ordered = [r.sql_version_id for r in audit.sql_versions_by_policy(sqls, docs, "P").collect()]
    assert ordered == ["S2", "S1", "S3"]
    assert audit.sql_versions_by_policy(sqls, docs, "other").isEmpty()
    details = {r.sql_version_id: r.supersedes_policy_version_id for r in audit.sql_version_details(sqls, docs).collect()}
    assert details == {"S1": None, "S2": None, "S3": "P-V1"}
    wanted = docs.sparkSession.createDataFrame([("P-V1",), ("nope",)], "policy_version_id string")
    assert rows(audit.must_exist(wanted, docs, "policy_version_id")) == [("nope",)]


def test_lineage(story):
    docs, sqls, runs = registry.document_state(story), registry.sql_version_state(story), registry.run_state(story)
    chain = audit.lineage_chain(runs, docs, registry.extractions(story), sqls)
    got = {r.run_id: r for r in chain.collect()}
    assert sorted(got) == ["R0", "R1", "R2", "R3"]  # one row per run, none without a rule version
    assert got["R1"].extraction_summary is None  # latest extraction's summary is an object
    assert got["R3"].extraction_summary == "first"
    assert got["R1"].run_started == "2024-01-01T06:00:00+00:00" and got["R2"].run_ended is None
    edges = audit.lineage_edges(chain.where("run_id = 'R3'")).orderBy("seq").collect()
    assert [(e.src, e.dst) for e in edges] == [
        ("PDF P", "Version P-V2"), ("Version P-V2", "Extraction m1"), ("Extraction m1", "SQL S3"),
        ("SQL S3", "Approved by N/A"), ("Approved by N/A", "Run R3"), ("Run R3", "RWA Outputs"),
    ]


def test_timelines(story):
    docs, sqls, runs = registry.document_state(story), registry.sql_version_state(story), registry.run_state(story)
    got = [(r.policy_version_id, r.sql_version_id, r.run_id) for r in audit.policy_timeline(docs, sqls, runs, "P").collect()]
    assert sorted(got, key=repr) == sorted(
        [("P-V1", "S1", "R0"), ("P-V1", "S1", "R1"), ("P-V1", "S2", "R2"), ("P-V2", "S3", "R3"), ("P-V3", None, "R4")], key=repr
    )
    first = docs.where("policy_version_id = 'P-V1'")
    points = audit.policy_event_timeline(first, sqls, runs.where("policy_version_id = 'P-V1'"))
    kinds = [r.event_kind for r in points.collect()]
    assert sorted(kinds) == ["Run"] * 3 + ["SQL Approval"] * 2 + ["Upload"]  # each event once
    one = audit.policy_event_timeline(docs, sqls, runs, "P").collect()
    assert [r.event_ts for r in one] == sorted(r.event_ts for r in one)


def test_timeline_keeps_versions_and_rules_without_activity(spark):
    events = events_of(spark, [("uploaded", "A", None, None, {}), ("uploaded", "B", None, None, {}), ("generated", "B", "S", None, {})])
    got = audit.policy_timeline(registry.document_state(events), registry.sql_version_state(events), registry.run_state(events))
    assert sorted(((r.policy_version_id, r.sql_version_id, r.run_id) for r in got.collect()), key=repr) == [("A", None, None), ("B", "S", None)]


def test_extraction_details(spark):
    events = events_of(
        spark,
        [
            ("uploaded", "A", None, None, {}),
            ("extracted", "A", None, None, {"extraction_json": "{broken", "model_version": "m1"}),
            ("uploaded", "B", None, None, {"supersedes": "A"}),
            ("generated", "B", "S", None, {"extraction_json": '{"b": 1,  "a": 2}', "model_version": "m2", "agent_trace": None}),
        ],
    )
    got = {r.policy_version_id: r for r in audit.extraction_details(registry.extractions(events), registry.sql_version_state(events), registry.document_state(events)).collect()}
    assert got["A"].extraction_json == "{broken" and got["A"].sql_version_id is None
    assert got["B"].extraction_json == '{"a":2,"b":1}' and got["B"].supersedes_policy_version_id == "A"


def test_lineage_coverage(spark, story):
    docs, sqls, runs = registry.document_state(story), registry.sql_version_state(story), registry.run_state(story)
    outputs = spark.createDataFrame(
        [("R1", "P", "P-V1", "S1")] * 3 + [("R4", "P", "P-V3", None), ("RX", "P", "P-V1", "S1"), ("R1", "P", "P-V1", "S9")],
        "run_id string, policy_id string, policy_version_id string, sql_version_id string",
    )
    assert tuple(audit.lineage_coverage(audit.output_stamps(outputs), runs, sqls, docs).first()) == (6, 3, 0.5)
    assert tuple(audit.lineage_coverage(audit.output_stamps(outputs.limit(0)), runs, sqls, docs).first()) == (0, 0, 0.0)


def test_recent_runs_and_objects(spark, story):
    recent = registry.recent_runs(registry.run_state(story), 2).collect()
    assert [r.label for r in recent] == ["R4 (running) — P-V3", "R3 (running) — P-V2"]
    objects = spark.createDataFrame([(f"u{i}", hour(i)) for i in range(5)], "uri string, updated timestamp_ntz")
    got = audit.policy_objects(objects, registry.document_state(story), limit=3).collect()
    assert [(r.uri, r.policy_version_id, r.registered) for r in got] == [("u4", None, False), ("u3", "P-V3", True), ("u2", "P-V2", True)]
    every = audit.policy_objects(objects, registry.document_state(story)).collect()
    assert len(every) == 5


def test_derived_registry_sizes(spark, sf):
    """Counts known for the sf0.01 events."""
    if not sf.endswith("sf0.01"):
        pytest.skip("counts are those of sf0.01")
    sqls = catalogue.QUERIES["sql_version_state"](spark, sf)
    assert dict(sqls.groupBy("validation_status").count().collect()) == {"approved": 444, "pending": 907}
    runs = catalogue.QUERIES["run_state"](spark, sf)
    assert dict(runs.groupBy("run_status").count().collect()) == {"succeeded": runs.where("run_status = 'succeeded'").count(), "failed": runs.where("run_status = 'failed'").count()}
    assert runs.count() == 3995 and runs.where("policy_version_id IS NULL").count() == 350
    assert runs.where(F.col("sql_version_id").isNotNull()).count() == 1465
    late = catalogue.QUERIES["gate_violations"](spark, sf).where("reason = 'not_approved_at_start'")
    assert late.count() == 1465 - 476
