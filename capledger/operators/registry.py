"""Policy registry: append-only events and the state they fold to.

An event is one row of ``registry_events``. Order inside a key is always
(event_ts, event_id). Every fold is one ``groupBy`` on the entity key, whose aggregates
are maxima of (order, value) structs and flags: partial states of any parts of the events merge by the
same maxima, so late and repeated events need no second thought.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.functions.scalars import run_label
from capledger.operators.ordered import running
from capledger.schemas import DRAFT_PAYLOAD, TABLES

DRAFT = ("generated", "regenerated")


def _at() -> Column:
    return F.struct("event_ts", "event_id")


def _when(kinds: str | tuple[str, ...], value: Column) -> Column:
    kinds = (kinds,) if isinstance(kinds, str) else kinds
    return F.when(F.col("event_type").isin(*kinds), value)


def _latest(kinds: str | tuple[str, ...], **values: Column) -> Column:
    """(event_ts, event_id, values) of an event of these kinds; its maximum over a key is the last one."""
    return _when(kinds, F.struct("event_ts", "event_id", *[v.alias(n) for n, v in values.items()]))


@dataclass(frozen=True)
class Fold:
    """How events fold to an entity's state: what an event says of a key (``rows``: key and state columns), whose
    maxima are the partial state, and what users see of it (``finish``)."""

    key: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]

    def _maxima(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.key).agg(*[F.max(c).alias(c) for c in rows.columns if c not in self.key])

    def state(self, events: DataFrame) -> DataFrame:
        """Partial state of some events."""
        return self._maxima(self.rows(events))

    def merge(self, state: DataFrame, events: DataFrame) -> DataFrame:
        """Partial state of what ``state`` has seen and of more events, earlier, later or the same ones."""
        return self._maxima(state.unionByName(self.state(events)))

    def __call__(self, events: DataFrame) -> DataFrame:
        return self.finish(self.state(events))


def new_events(df: DataFrame, event_type: str, at: Column, payload: Column | None = None) -> DataFrame:
    """Rows of ``df`` as registry events; columns it lacks stay NULL.

    Without an ``event_id`` the id is a hash of what the event says, so a retry
    appends the same event again, which no fold notices.
    """
    if "event_id" not in df.columns:
        keys = [c for c in ("policy_version_id", "sql_version_id", "run_id") if c in df.columns]
        df = df.withColumn("event_id", F.xxhash64(F.lit(event_type), at, *[F.coalesce(k, F.lit("")) for k in keys]))
    given = df.withColumns(
        {
            "event_type": F.lit(event_type),
            "event_ts": at,
            "payload": payload if payload is not None else F.lit(None).cast("string"),
        }
    )
    return given.select(
        *[
            (F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES["registry_events"].fields
        ]
    )


def _document_rows(events: DataFrame) -> DataFrame:
    """An upload that points to a version also adds a row under that version's key, so the fold needs no self join."""
    supersedes = F.get_json_object("payload", "$.supersedes")
    own = F.struct(F.col("policy_version_id").alias("key"), F.lit(False).alias("replaced"))
    pointed = F.struct(_when("uploaded", supersedes).alias("key"), F.lit(True).alias("replaced"))
    keyed = (
        events.where(F.col("event_type").isin("uploaded", "extracted", "generated", "approved"))
        .select("*", F.explode(F.array(own, pointed)).alias("entry"))
        .where(F.col("entry.key").isNotNull())
    )
    mine = ~F.col("entry.replaced")
    uploaded = _latest(
        "uploaded", policy_id=F.col("policy_id"), actor=F.col("actor"), gcs_uri=F.get_json_object("payload", "$.gcs_uri"), supersedes=supersedes
    )
    seen = lambda *kinds: mine & F.col("event_type").isin(*kinds)
    return keyed.select(
        F.col("entry.key").alias("policy_version_id"),
        F.when(mine, uploaded).alias("uploaded"),
        F.col("entry.replaced").alias("replaced"),
        (seen("approved") & F.col("sql_version_id").isNotNull()).alias("approved"),
        seen("extracted", "generated").alias("extracted"),
    )


def _documents(state: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("replaced"), "superseded")
        .when(F.col("approved"), "approved")
        .when(F.col("extracted"), "extracted")
        .otherwise("draft")
    )
    return state.where(F.col("uploaded").isNotNull()).select(
        "uploaded.policy_id", "policy_version_id", F.col("uploaded.event_ts").alias("uploaded_at"),
        F.col("uploaded.actor").alias("uploaded_by"), "uploaded.gcs_uri", status.alias("status"),
        F.col("uploaded.supersedes").alias("supersedes_policy_version_id"),
    )


# Uploaded versions with their derived status; superseded is what another upload points to.
document_state = Fold(("policy_version_id",), _document_rows, _documents)


def _sql_version_rows(events: DataFrame) -> DataFrame:
    return events.where(F.col("sql_version_id").isNotNull() & F.col("event_type").isin("approved", *DRAFT)).select(
        "sql_version_id",
        _latest("generated", policy_version_id=F.col("policy_version_id")).alias("created"),
        _latest(DRAFT, payload=F.col("payload")).alias("drafted"),
        _latest("approved", actor=F.col("actor")).alias("signed"),
    )


def _sql_versions(state: DataFrame) -> DataFrame:
    draft = F.from_json("drafted.payload", DRAFT_PAYLOAD)
    approved = F.col("signed").isNotNull() & (F.col("signed.event_ts") >= F.col("drafted.event_ts"))
    return state.where(F.col("created").isNotNull()).select(
        "sql_version_id",
        "created.policy_version_id",
        draft["generated_sql"].alias("generated_sql"),
        draft["agent_trace"].alias("agent_trace"),
        draft["schema_snapshot"].alias("schema_snapshot"),
        F.when(approved, "approved").otherwise("pending").alias("validation_status"),
        F.when(approved, F.col("signed.actor")).alias("approved_by"),
        F.when(approved, F.col("signed.event_ts")).alias("approved_at"),
    )


# Rule versions; approved only while the last approval is not before the last draft (inside one instant drafts come first).
sql_version_state = Fold(("sql_version_id",), _sql_version_rows, _sql_versions)


def _extraction_rows(events: DataFrame) -> DataFrame:
    named = events.where(F.col("event_type").isin("extracted", "generated") & F.col("policy_version_id").isNotNull())
    return named.select("event_id", "policy_version_id", F.col("event_ts").alias("created_at"), "payload")


def _extractions(state: DataFrame) -> DataFrame:
    draft = F.from_json("payload", DRAFT_PAYLOAD)
    return state.select(
        "policy_version_id",
        draft["extraction_json"].alias("extraction_json"),
        draft["clause_citations"].alias("clause_citations"),
        draft["model_version"].alias("model_version"),
        "created_at",
        "event_id",
    )


# One row per extracted or generated event of a policy version, however often it was appended; may repeat per version.
extractions = Fold(("event_id", "policy_version_id", "created_at"), _extraction_rows, _extractions)


def _run_rows(events: DataFrame) -> DataFrame:
    ids = {c: F.col(c) for c in ("policy_id", "policy_version_id", "sql_version_id")}
    return events.where(F.col("run_id").isNotNull() & F.col("event_type").isin("run_started", "run_ended")).select(
        "run_id",
        _latest("run_started", **ids).alias("started"),
        _latest("run_ended", status=F.get_json_object("payload", "$.run_status")).alias("ended"),
    )


def _runs(state: DataFrame) -> DataFrame:
    return state.where(F.col("started").isNotNull()).select(
        "run_id", "started.policy_id", "started.policy_version_id", "started.sql_version_id",
        F.coalesce("ended.status", F.lit("running")).alias("run_status"),
        F.col("started.event_ts").alias("started_at"), F.col("ended.event_ts").alias("ended_at"),
    )


run_state = Fold(("run_id",), _run_rows, _runs)

FOLDS = {"documents": document_state, "sql_versions": sql_version_state, "extractions": extractions, "runs": run_state}


def run_gate(events: DataFrame) -> DataFrame:
    """Each started run that names a rule version, once: was that version approved then?

    The last draft or approval of the version before the start decides. Inside one
    instant drafts come first, then approvals, then starts; events of one kind and
    instant follow their ids. Of a start that was appended more than once the last counts,
    as it does in ``run_state``.
    """
    rank = F.when(F.col("event_type").isin(*DRAFT), 0).when(F.col("event_type") == "approved", 1).otherwise(2)
    relevant = events.where(
        F.col("sql_version_id").isNotNull() & F.col("event_type").isin("approved", "run_started", *DRAFT)
    ).select("sql_version_id", "event_ts", rank.alias("step"), "event_id", "event_type", "run_id")
    order = ["event_ts", "step", "event_id"]
    change = _when(("approved", *DRAFT), F.struct(*order))
    seen = running(relevant, ["sql_version_id"], order, {"state": ("max", change)})
    started = seen.where(F.col("event_type") == "run_started")
    return started.groupBy("run_id").agg(
        F.max_by(F.coalesce(F.col("state.step") == 1, F.lit(False)), F.struct("event_ts", "event_id")).alias("approved_at_start")
    )


def gate_violations(runs: DataFrame, gate: DataFrame) -> DataFrame:
    """Runs that must not have executed, with the reason."""
    reason = F.when(F.col("sql_version_id").isNull(), "no_sql_version").when(
        ~F.coalesce("approved_at_start", F.lit(False)), "not_approved_at_start"
    )
    return (
        runs.join(gate, "run_id", "left")
        .select("run_id", "sql_version_id", "run_status", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def orphan_events(events: DataFrame, sql_versions: DataFrame) -> DataFrame:
    """Draft changes and approvals of a rule version that was never generated, and drafts of none.

    Events without a rule version match nothing and stay out of the shuffle.
    """
    named = F.col("sql_version_id").isNotNull()
    touching = events.where(
        F.col("event_type").isin("regenerated", "approved") | (~named & (F.col("event_type") == "generated"))
    ).select("event_id", "event_type", "policy_version_id", "sql_version_id")
    unknown = touching.where(named).join(sql_versions.select("sql_version_id"), "sql_version_id", "left_anti")
    return touching.where(~named).unionByName(unknown)


def stamp_outputs(
    runs: DataFrame, cells: DataFrame, rule_version: Column, as_of: Column, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Report output rows: every run gets the cells of its rule version and its ids, and
    keeps its columns in ``keep``.

    ``cells`` (``policy_version, portfolio, risk_bucket, rwa_exact``) should be a
    written table: its exact size then lets Catalyst broadcast it below the
    configured threshold, and beyond that the join is a shuffled one.
    """
    return (
        runs.withColumn("policy_version", rule_version)
        .join(cells, "policy_version")
        .select(
            "portfolio", "risk_bucket", "rwa_exact", F.col("rwa_exact").cast("double").alias("rwa_amount"),
            as_of.cast("date").alias("as_of_date"), "run_id", "policy_id", "policy_version_id", "sql_version_id", *keep,
        )
    )


def allowed(runs: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of ``runs`` (or of outputs) whose run had approved rules at its start. Gate the
    runs before stamping outputs: they are fewer by the number of cells."""
    return runs.join(gate.where("approved_at_start"), "run_id", "left_semi")


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    label = run_label(F.col("run_id"), F.col("run_status"), F.col("policy_version_id"))
    return (
        runs.orderBy(F.desc("started_at"), F.desc("run_id"))
        .limit(limit)
        .select(
            "run_id", "run_status", "started_at", label.alias("label"), "policy_id", "policy_version_id", "sql_version_id"
        )
    )


def stored_amounts(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """``total_rwa`` of all stored outputs and ``total_rwa_latest_run`` of the last succeeded run."""
    succeeded = F.col("run_status") == "succeeded"
    latest_run = runs.where(succeeded).agg(F.max_by("run_id", F.struct("started_at", "run_id"))).scalar()
    return outputs.agg(
        F.sum("rwa_exact").alias("total_rwa"),
        F.sum(F.when(F.col("run_id") == latest_run, F.col("rwa_exact"))).alias("total_rwa_latest_run"),
    )


def computed_amounts(runs: DataFrame, cells: DataFrame, rule_version: Column) -> DataFrame:
    """The same without writing an output: each rule version's total, times the succeeded runs of it."""
    totals = cells.groupBy("policy_version").agg(F.sum("rwa_exact").cast("decimal(26,8)").alias("amount"))
    counted = (
        runs.where(F.col("run_status") == "succeeded")
        .groupBy(rule_version.alias("policy_version"))
        .agg(F.count("*").cast("decimal(11,0)").alias("n"), F.max(F.struct("started_at", "run_id")).alias("newest"))
    )
    amount = F.coalesce("amount", F.lit(0).cast("decimal(26,8)"))
    return counted.join(totals, "policy_version", "left").agg(
        F.sum(amount * F.col("n")).alias("total_rwa"), F.max_by(amount, "newest").alias("total_rwa_latest_run")
    )


def dashboard_kpis(documents: DataFrame, sql_versions: DataFrame, runs: DataFrame, amounts: DataFrame) -> DataFrame:
    """The counters in one row, with the two sums of ``amounts``. ``total_rwa`` adds up every run
    ever written, as the dashboard always has."""
    parts = [
        documents.agg(F.count("*").alias("total_policies")),
        sql_versions.agg(F.count_if(F.col("validation_status") == "approved").alias("approved_sql")),
        runs.agg(F.count_if(F.col("run_status") == "succeeded").alias("successful_runs")),
        amounts,
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.unionByName(part, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return row.agg(
        *[zero(c).alias(c) for c in ("total_policies", "approved_sql", "successful_runs")],
        *[zero(c).cast("double").alias(c) for c in ("total_rwa", "total_rwa_latest_run")],
    )
