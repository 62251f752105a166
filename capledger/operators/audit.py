"""Lineage, timelines and version lookups over the registry state.

Each lookup answers for every key at once; filter the result for one id. Tables
that may hold several rows per version are reduced to the latest one before they
are joined, so no lookup multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.functions.scalars import iso_text, json_or_raw, json_scalar
from capledger.operators.ordered import latest, union_all


def must_exist(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requested keys the table does not hold; raise in the caller when non-empty."""
    return wanted.select(key).distinct().join(table, key, "left_anti")


def latest_approved_sql(sql_versions: DataFrame) -> DataFrame:
    return latest(
        sql_versions.where(F.col("validation_status") == "approved"),
        "policy_version_id",
        ["approved_at", "sql_version_id"],
        ["sql_version_id", "approved_at", "generated_sql", "agent_trace"],
    ).withColumn("agent_trace", json_or_raw(F.col("agent_trace")))


def latest_policy_version(documents: DataFrame) -> DataFrame:
    """Newest version per policy and how many versions it has (its version number)."""
    return documents.groupBy("policy_id").agg(
        F.max_by("policy_version_id", F.struct("uploaded_at", "policy_version_id")).alias("policy_version_id"),
        F.count("*").alias("version_no"),
    )


def superseded_baseline(documents: DataFrame, sql_versions: DataFrame) -> DataFrame:
    """For each superseding version: the version it replaces with its object and latest approved rules."""
    baseline = latest_approved_sql(sql_versions).select(
        F.col("policy_version_id").alias("supersedes_policy_version_id"),
        F.col("sql_version_id").alias("baseline_sql_version_id"),
    )
    replaced = documents.select(
        F.col("policy_version_id").alias("supersedes_policy_version_id"), F.col("gcs_uri").alias("supersedes_gcs_uri")
    )
    return (
        documents.where(F.col("supersedes_policy_version_id").isNotNull())
        .select("policy_version_id", "supersedes_policy_version_id")
        .join(replaced, "supersedes_policy_version_id", "left")
        .join(baseline, "supersedes_policy_version_id", "left")
        .select("policy_version_id", "supersedes_policy_version_id", "supersedes_gcs_uri", "baseline_sql_version_id")
    )


def sql_version_details(sql_versions: DataFrame, documents: DataFrame) -> DataFrame:
    return sql_versions.join(
        documents.select("policy_version_id", "supersedes_policy_version_id"), "policy_version_id"
    ).select(
        "sql_version_id", "policy_version_id", "validation_status", "supersedes_policy_version_id",
        "generated_sql", json_or_raw(F.col("agent_trace")).alias("agent_trace"),
    )


def sql_versions_by_policy(sql_versions: DataFrame, documents: DataFrame, policy_id: str | None = None) -> DataFrame:
    """Rule versions with their policy; for one policy in approval order, newest first."""
    rows = sql_versions.join(documents.select("policy_version_id", "policy_id"), "policy_version_id").select(
        "policy_id", "sql_version_id", "policy_version_id", "validation_status", "approved_at", "approved_by", "generated_sql"
    )
    if policy_id is None:
        return rows
    return rows.where(F.col("policy_id") == policy_id).orderBy(F.desc_nulls_last("approved_at"), "sql_version_id")


def extraction_details(extractions: DataFrame, sql_versions: DataFrame, documents: DataFrame) -> DataFrame:
    newest = latest(
        extractions, "policy_version_id", ["created_at", "event_id"],
        ["extraction_json", "clause_citations", "model_version"],
    )
    newest_sql = latest(
        sql_versions, "policy_version_id", ["approved_at", "sql_version_id"],
        ["sql_version_id", "generated_sql", "agent_trace"],
    )
    return (
        newest.join(newest_sql, "policy_version_id", "left")
        .join(documents.select("policy_version_id", "supersedes_policy_version_id"), "policy_version_id", "left")
        .select(
            "policy_version_id", "sql_version_id", "model_version", "supersedes_policy_version_id", "generated_sql",
            *[json_or_raw(F.col(c)).alias(c) for c in ("extraction_json", "clause_citations", "agent_trace")],
        )
    )


def lineage_chain(
    runs: DataFrame, documents: DataFrame, extractions: DataFrame, sql_versions: DataFrame
) -> DataFrame:
    """Run -> document -> latest extraction -> rule version, one row per run.

    Everything known per rule version is put together first, so the runs, the
    largest table, are shuffled once.
    """
    docs = documents.select(
        "policy_id", "policy_version_id", "gcs_uri", "uploaded_by", "uploaded_at",
        F.col("status").alias("policy_status"),
    )
    newest = latest(
        extractions, "policy_version_id", ["created_at", "event_id"],
        ["model_version", "created_at", "clause_citations"],
    )
    sqls = sql_versions.select("sql_version_id", "policy_version_id", "validation_status", "approved_by", "approved_at")
    versions = sqls.join(docs.join(newest, "policy_version_id", "left"), "policy_version_id")
    return (
        runs.join(versions, ["sql_version_id", "policy_version_id", "policy_id"])
        .select(
            "run_id", "policy_id", "policy_version_id", "sql_version_id", "gcs_uri", "uploaded_by",
            iso_text(F.col("uploaded_at")).alias("uploaded_at"), "policy_status", "model_version",
            iso_text(F.col("created_at")).alias("extraction_at"),
            json_scalar(F.col("clause_citations"), "$.summary").alias("extraction_summary"),
            "validation_status", "approved_by", iso_text(F.col("approved_at")).alias("approved_at"),
            "run_status", iso_text(F.col("started_at")).alias("run_started"),
            iso_text(F.col("ended_at")).alias("run_ended"),
        )
    )


def lineage_edges(chain: DataFrame) -> DataFrame:
    """Six edges between seven nodes for each run of a lineage chain."""
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    nodes = [
        F.concat(F.lit("PDF "), text("policy_id", "?")),
        F.concat(F.lit("Version "), text("policy_version_id", "?")),
        F.concat(F.lit("Extraction "), text("model_version", "N/A")),
        F.concat(F.lit("SQL "), text("sql_version_id", "?")),
        F.concat(F.lit("Approved by "), text("approved_by", "N/A")),
        F.concat(F.lit("Run "), text("run_id", "?")),
        F.lit("RWA Outputs"),
    ]
    edges = F.array(
        *[
            F.struct(F.lit(i + 1).cast("bigint").alias("seq"), nodes[i].alias("src"), nodes[i + 1].alias("dst"))
            for i in range(6)
        ]
    )
    return chain.select("run_id", F.inline(edges))


def output_stamps(outputs: DataFrame) -> DataFrame:
    """Stored output rows counted per combination of stamped ids."""
    return outputs.groupBy("run_id", "policy_id", "policy_version_id", "sql_version_id").agg(F.count("*").alias("n"))


def computed_stamps(runs: DataFrame, cells: DataFrame, rule_version: Column) -> DataFrame:
    """The same without an output: each succeeded run with the number of cells its rule version gives."""
    sizes = cells.groupBy("policy_version").agg(F.count("*").alias("n"))
    done = runs.where(F.col("run_status") == "succeeded").withColumn("policy_version", rule_version)
    return done.join(sizes, "policy_version").select("run_id", "policy_id", "policy_version_id", "sql_version_id", "n")


def lineage_coverage(
    stamps: DataFrame, runs: DataFrame, sql_versions: DataFrame, documents: DataFrame
) -> DataFrame:
    """Share of report output rows whose run, rule version and document all exist.

    ``stamps`` has one row per combination of stamped ids; the keys they are looked up by
    are unique on the other side.
    """
    version, document = ["sql_version_id", "policy_version_id"], ["policy_id", "policy_version_id"]
    marked = (
        stamps.join(runs.select("run_id", F.lit(True).alias("has_run")), "run_id", "left")
        .join(sql_versions.select(*version, F.lit(True).alias("has_version")), version, "left")
        .join(documents.select(*document, F.lit(True).alias("has_document")), document, "left")
    )
    linked = F.expr("has_run AND has_version AND has_document")
    counted = marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_outputs"),
        F.coalesce(F.sum(F.when(linked, F.col("n"))), F.lit(0)).alias("linked_outputs"),
    )
    share = F.when(F.col("total_outputs") == 0, F.lit(0.0)).otherwise(F.col("linked_outputs") / F.col("total_outputs"))
    return counted.withColumn("linked_share", share)


def policy_timeline(
    documents: DataFrame, sql_versions: DataFrame, runs: DataFrame, policy_id: str | None = None
) -> DataFrame:
    """Version, its rule versions and the runs of each: one row per run, plus rule
    versions never run and versions without either.

    Rows grow with documents + rule versions + runs, never with their product. The
    larger side of each join stands left, where a hot version can be split, and the
    keys looked up by the anti joins are made distinct first.
    """
    if policy_id is not None:
        documents = documents.where(F.col("policy_id") == policy_id)
        runs = runs.where(F.col("policy_id") == policy_id)
    key = ["policy_version_id", "sql_version_id"]
    run_rows = runs.select(*key, "run_id", "run_status", "started_at", "ended_at")
    sql_rows = sql_versions.select(*key, "validation_status", "approved_at", "approved_by")
    never_run = sql_rows.join(run_rows.select(*key).distinct(), key, "left_anti")
    activity = run_rows.join(sql_rows, key, "left").unionByName(never_run, allowMissingColumns=True)
    docs = documents.select(
        "policy_id", "policy_version_id", "uploaded_at", "uploaded_by", F.col("status").alias("policy_status"),
        "supersedes_policy_version_id",
    )
    active = run_rows.select("policy_version_id").union(sql_rows.select("policy_version_id")).distinct()
    idle = docs.join(active, "policy_version_id", "left_anti")
    rows = activity.join(docs, "policy_version_id").unionByName(idle, allowMissingColumns=True).select(
        *docs.columns, "sql_version_id", "validation_status", "approved_at", "approved_by",
        "run_id", "run_status", "started_at", "ended_at",
    )
    return rows if policy_id is None else rows.orderBy("uploaded_at", "sql_version_id", "started_at", "run_id")


def policy_event_timeline(
    documents: DataFrame, sql_versions: DataFrame, runs: DataFrame, policy_id: str | None = None
) -> DataFrame:
    """Upload, SQL Approval and Run points, each event once."""
    def points(df: DataFrame, ts: str, kind: str, subject: str, detail) -> DataFrame:
        return df.where(F.col(ts).isNotNull()).select(
            "policy_id", F.col(ts).alias("event_ts"), F.lit(kind).alias("event_kind"),
            F.concat_ws(" ", F.col(subject), detail).alias("text"),
        )

    by = lambda c: F.concat(F.lit("by "), F.coalesce(F.col(c), F.lit("N/A")))
    approvals = sql_versions.where(F.col("approved_at").isNotNull()).join(
        documents.select("policy_version_id", "policy_id"), "policy_version_id"
    )
    rows = union_all(
        [
            points(documents, "uploaded_at", "Upload", "policy_version_id", by("uploaded_by")),
            points(approvals, "approved_at", "SQL Approval", "sql_version_id", by("approved_by")),
            points(runs, "started_at", "Run", "run_id", F.coalesce(F.col("run_status"), F.lit("N/A"))),
        ]
    )
    if policy_id is None:
        return rows
    return rows.where(F.col("policy_id") == policy_id).orderBy("event_ts", "event_kind", "text")


def policy_objects(objects: DataFrame, documents: DataFrame, limit: int = 100) -> DataFrame:
    """The most recently updated files with their registration, if any.

    A left join keeps every file, so the newest ``limit`` files hold the newest
    ``limit`` joined rows. The update time of the last of them is a filter the file
    scan can use (hashes are then taken from few files), and only registrations of
    those files meet them. A file always has an update time.
    """
    newest = [F.desc("updated"), F.desc("uri")]
    oldest_kept = objects.select("updated").orderBy(F.desc("updated")).limit(limit).agg(F.min("updated")).scalar()
    kept = objects.where(F.col("updated") >= oldest_kept).orderBy(*newest).limit(limit)
    registry = documents.select(
        F.col("gcs_uri").alias("uri"), "policy_id", "policy_version_id", "uploaded_by", "status"
    ).join(kept.select("uri"), "uri", "left_semi")
    return (
        kept.join(registry, "uri", "left")
        .orderBy(*newest, "policy_version_id")
        .limit(limit)
        .withColumn("registered", F.col("policy_version_id").isNotNull())
    )
