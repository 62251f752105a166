"""The policy workflow over written tables: upload, draft, approve, execute.

Every step takes a frame of any number of policies and appends registry events in
bulk; ``at`` is the time of the step, so a retried step writes the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions.scalars import mint_id, object_path, progress_text, summary_text, version_id
from capledger.operators import audit, registry, rule_text, rules
from capledger.operators.rules import effective_rules, layered
from capledger.schemas import TABLES
from capledger.session import stage
from capledger.sources import sinks
from capledger.sources.eventlog import EventLog

RULE_COLUMNS = [
    "sql_version_id", "policy_version", "kind", "asset_class", "risk_bucket", "risk_weight", "min_amount",
    "multiplier", "precedence", "origin", "drafted_at",
]


class Registry:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = EventLog(spark, self.root)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def initialise(self) -> None:
        """An event table without events."""
        self.log.append(self.spark.createDataFrame([], TABLES["registry_events"]), "0")

    def _append(self, df: DataFrame, event_type: str, at: datetime, payload: Column | None = None) -> None:
        when = F.lit(at).cast("timestamp_ntz")
        self.log.append(registry.new_events(df, event_type, when, payload), f"{at:%Y%m%dT%H%M%S}-{event_type}")

    def snapshot(self, at: datetime) -> None:
        """Persist the state, so that later steps read it and the events since."""
        self.log.snapshot(f"{at:%Y%m%dT%H%M%S%f}")

    # --- state ---------------------------------------------------------------

    def events(self) -> DataFrame:
        return self.log.events()

    def documents(self) -> DataFrame:
        return self.log.state("documents")

    def sql_versions(self) -> DataFrame:
        return self.log.state("sql_versions")

    def extractions(self) -> DataFrame:
        return self.log.state("extractions")

    def runs(self) -> DataFrame:
        return self.log.state("runs")

    def outputs(self) -> DataFrame:
        return sinks.read_outputs(self.spark, self._path("rwa_report_outputs"))

    def rule_rows(self) -> DataFrame:
        return self.spark.read.parquet(self._path("rule_rows"))

    def rules_at(self, when: Column) -> DataFrame:
        """Rule rows of each rule version's newest draft not later than ``when``."""
        stored = self.rule_rows().where(F.col("drafted_at") <= when)
        newest = stored.groupBy("sql_version_id").agg(F.max("drafted_at").alias("drafted_at"))
        return stored.join(newest, ["sql_version_id", "drafted_at"], "left_semi")

    def _store_rules(self, delta: DataFrame, ids: DataFrame, documents: DataFrame, when: Column) -> DataFrame:
        """Append the complete rules of a draft: ``delta`` (by ``policy_version``) over the approved rules
        of the version that each one supersedes. ``ids`` maps ``policy_version`` to ``sql_version_id``.
        Returns the rules as text, by ``sql_version_id``."""
        if self._has_rules():
            baselines = audit.superseded_baseline(documents, self.sql_versions())
            complete = layered(self.rules_at(when), baselines, delta)
        else:
            complete = delta.withColumns({"precedence": F.lit(0), "origin": F.lit("V1")})
        complete = complete.join(ids, "policy_version").withColumn("drafted_at", when)
        complete = stage(complete.select(*RULE_COLUMNS), "rule_rows")
        complete.write.mode("append").parquet(self._path("rule_rows"))
        texts = rule_text.rendered(effective_rules(complete.withColumn("policy_version", F.col("sql_version_id"))))
        return stage(texts.select(F.col("policy_version").alias("_version"), F.col("generated_sql").alias("_rendered")), "rendered")

    # --- steps ---------------------------------------------------------------

    def upload(self, files: DataFrame, at: datetime) -> DataFrame:
        """Register ``(policy_id, filename, actor, supersedes)`` rows; a NULL policy_id is a
        new policy. Returns the rows with their ids."""
        when = F.lit(at).cast("timestamp_ntz")
        stamp = when.cast("string")
        rows = files.withColumn(
            "policy_id", F.coalesce("policy_id", mint_id("POL-", F.col("filename"), F.col("actor"), stamp))
        )
        rows = rows.withColumn("policy_version_id", version_id(F.col("policy_id"), F.col("filename"), stamp))
        rows = rows.withColumn("gcs_uri", object_path(F.col("policy_version_id"), F.col("filename")))
        self._append(rows, "uploaded", at, F.to_json(F.struct("gcs_uri", "supersedes")))
        return rows

    def draft(self, delta: DataFrame, texts: DataFrame, at: datetime) -> DataFrame:
        """Generate a rule version per policy version.

        ``delta`` has rule rows by ``policy_version``; ``texts`` has one row per
        ``policy_version_id`` with ``summary``, ``generated_sql``, ``agent_trace`` and
        ``schema_snapshot``. Where the version supersedes one with approved rules, the
        new rules lie over those. A draft without text gets its rules as text. Versions never uploaded raise.
        """
        when = F.lit(at).cast("timestamp_ntz")
        documents = stage(self.documents(), "documents")
        if not audit.must_exist(texts, documents, "policy_version_id").isEmpty():
            raise ValueError("draft for a policy version that was not uploaded")
        rows = texts.join(documents.select("policy_version_id", "policy_id", "gcs_uri"), "policy_version_id").withColumn(
            "sql_version_id", mint_id("SQL-", F.col("policy_version_id"), when.cast("string"))
        )
        rows = stage(
            rows.withColumn(
                "summary", summary_text(F.col("summary"), F.concat(F.lit("Policy "), "policy_version_id", F.lit(" parsed.")))
            ),
            "drafts",
        )
        ids = rows.select(F.col("policy_version_id").alias("policy_version"), "sql_version_id")
        rows = _with_text(rows, self._store_rules(delta, ids, documents, when))
        payload = F.to_json(
            F.struct(
                "generated_sql",
                "agent_trace",
                "schema_snapshot",
                F.to_json(F.struct(F.col("gcs_uri").alias("policy_gcs_uri"), "summary", "schema_snapshot")).alias("extraction_json"),
                F.to_json(F.struct("summary")).alias("clause_citations"),
                F.lit("rules-v1").alias("model_version"),
            )
        )
        self._append(rows, "generated", at, payload)
        return rows.withColumn("progress", progress_text("Extraction complete: ", F.col("summary")))

    def _has_rules(self) -> bool:
        """Is there any generated rule version yet?"""
        return not self.events().where(F.col("event_type") == "generated").isEmpty()

    def regenerate(self, texts: DataFrame, at: datetime, delta: DataFrame | None = None) -> None:
        """New text, trace and snapshot for ``sql_version_id`` rows; approval is cleared.

        ``delta`` has the new draft's rule rows by ``sql_version_id``; a version without text gets them as text. Runs
        use the text of the draft that was approved.
        """
        when = F.lit(at).cast("timestamp_ntz")
        if delta is not None:
            ids = self.sql_versions().select("sql_version_id", F.col("policy_version_id").alias("policy_version"))
            ids = stage(ids.join(delta.select("sql_version_id").distinct(), "sql_version_id", "left_semi"), "redrafts")
            named = delta.join(ids, "sql_version_id").drop("sql_version_id")
            texts = _with_text(texts, self._store_rules(named, ids, stage(self.documents(), "documents"), when))
        payload = F.to_json(F.struct("generated_sql", "agent_trace", "schema_snapshot"))
        self._append(texts, "regenerated", at, payload)

    def approve(self, versions: DataFrame, at: datetime) -> None:
        """``(sql_version_id, actor)`` rows; the policy version is looked up. Versions never drafted raise."""
        if not audit.must_exist(versions, self.sql_versions(), "sql_version_id").isEmpty():
            raise ValueError("approval of a rule version that was not drafted")
        rows = versions.join(self.sql_versions().select("sql_version_id", "policy_version_id"), "sql_version_id")
        self._append(stage(rows, "approvals"), "approved", at)

    def execute(self, requests: DataFrame, exposures: DataFrame, at: datetime, mapping: DataFrame | None = None) -> DataFrame:
        """Run ``(policy_id, policy_version_id, sql_version_id)`` rows: the text of each rule version's approved draft
        over the relations ``exposures`` and ``risk_weight_mapping`` (``mapping``; empty if not given).

        A run whose rules were not approved by then ends as failed and writes nothing; so does one whose text is refused
        (``rule_text.refusal``) or fails, with the reason beside its status. Other runs go on; an error of a
        text's job is raised when all is written.
        """
        when = F.lit(at).cast("timestamp_ntz")
        runs = stage(
            requests.withColumn("run_id", mint_id("RUN-", F.col("sql_version_id"), when.cast("string"))), "requests"
        )
        self._append(runs, "run_started", at)

        def ended(df: DataFrame, status: str, reason: Column) -> None:
            ending = F.to_json(F.struct(F.lit(status).alias("run_status"), reason.alias("reason")))
            self._append(df, "run_ended", at, ending)

        gate = registry.run_gate(self.events().join(runs.select("sql_version_id").distinct(), "sql_version_id", "left_semi"))
        approved = gate.where("approved_at_start").select("run_id")
        allowed = stage(runs.join(approved, "run_id", "left_semi"), "allowed")
        try:
            drafts = registry.sql_version_state(self.events().where(F.col("event_ts") <= when)).select("sql_version_id", "generated_sql")
            versions = allowed.groupBy("sql_version_id").agg(F.max("policy_id").alias("policy_id"), F.max("policy_version_id").alias("policy_version_id"))
            if mapping is None:
                mapping = self.spark.createDataFrame([], TABLES["risk_weight_mapping"])
            relations = {"exposures": exposures, "risk_weight_mapping": mapping}
            cells, failures = rule_text.run_texts(stage(versions.join(drafts, "sql_version_id", "left"), "approved_texts"), relations)
            done = allowed.join(failures.select("sql_version_id"), "sql_version_id", "left_anti")
            outputs = registry.stamp_outputs(done, cells, F.col("sql_version_id"), when).drop("rwa_exact")
            sinks.publish_outputs(outputs, self._path("rwa_report_outputs"), done)
        except Exception:
            ended(runs, "failed", F.lit(None).cast("string"))
            raise
        ended(done, "succeeded", F.lit(None).cast("string"))
        ended(allowed.join(failures, "sql_version_id"), "failed", F.col("reason"))
        ended(runs.join(allowed.select("run_id"), "run_id", "left_anti"), "failed", F.lit("not approved"))
        broken = failures.where("raised").first()
        if broken is not None:
            raise RuntimeError(f"{broken.sql_version_id}: {broken.reason}")
        return runs


def _with_text(rows: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rows of drafts, ``generated_sql`` trimmed; the rendered rules where it is empty."""
    given = F.nullif(F.trim("generated_sql"), F.lit(""))
    joined = rows.join(rendered, F.col("sql_version_id") == F.col("_version"), "left")
    return stage(joined.withColumn("generated_sql", F.coalesce(given, F.col("_rendered"))).drop("_version", "_rendered"), "texts")
