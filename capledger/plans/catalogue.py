"""The registered queries: operators bound to the given tables.

A registry that several branches of one query read is written once (``stage``);
a query with one branch reads it straight through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions import scalars
from capledger.operators import audit, capital, compare, hunks, registry, rule_text, rules, text
from capledger.operators import transactions as tx
from capledger.operators.ordered import union_all
from capledger.session import scratch_path, stage
from capledger.schemas import TRANSACTIONAL_TABLES
from capledger.sources import adapters, files, sinks, tables
from capledger.sources.eventlog import EventLog
from capledger.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs -----------------------------------------------------------


def _v1(spark: SparkSession) -> DataFrame:
    return rules.alone(adapters.v1_rules(spark), "V1")


def _v2(spark: SparkSession) -> DataFrame:
    return rules.overlay(adapters.v1_rules(spark), adapters.v2_delta(spark), "V2")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Exact RWA cells of both rule versions, keyed like runs."""
    cube = rules.position_cube(adapters.exposures(spark, sf))
    return rules.weighted_cells(cube, _v1(spark).unionByName(_v2(spark)))


def _comparison(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_pair(_cells(spark, sf), "V1", "V2", run_column="policy_version")


def _total_by_version(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).groupBy("policy_version").agg(F.sum("rwa_exact").cast("double").alias("rwa_amount"))


def _events(spark: SparkSession, sf: str, drafts: bool = False, staged: bool = False) -> DataFrame:
    events = adapters.registry_events(spark, sf, drafts)
    return stage(events, "registry_events") if staged else events


def _outputs(spark: SparkSession, sf: str, runs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Report outputs of the succeeded runs."""
    cells = stage(_cells(spark, sf), "rwa_cells")
    done = runs.where(F.col("run_status") == "succeeded")
    return registry.stamp_outputs(done, cells, adapters.rule_version_of(), F.col("started_at"), keep)


def _run_pairs(runs: DataFrame) -> DataFrame:
    """Consecutive runs of each policy with the rule version of each that succeeded."""
    version = F.when(F.col("run_status") == "succeeded", adapters.rule_version_of())
    return stage(compare.run_pairs(runs, version), "run_pairs")


def _by_run(spark: SparkSession, sf: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An answer for every pair of consecutive runs: worked out once per pair of rule
    versions, which is all that a computed output depends on."""
    pairs = _run_pairs(registry.run_state(_events(spark, sf)))
    return compare.for_runs(stage(answer(compare.compare_versions(_cells(spark, sf), pairs)), "pair_answers"), pairs)


def _chain(events: DataFrame) -> DataFrame:
    return audit.lineage_chain(
        registry.run_state(events),
        registry.document_state(events),
        registry.extractions(events),
        registry.sql_version_state(events),
    )


# --- rules and risk-weighted assets ------------------------------------------


@query
def rwa_by_policy_version(spark, sf):
    both = _v1(spark).unionByName(_v2(spark))
    return rules.rwa_by_policy_version(adapters.exposures(spark, sf), both)


@query
def rwa_all_rule_kinds(spark, sf):
    composite = rules.overlay(adapters.v1_rules(spark), adapters.kind_delta(spark), "V2K")
    return rules.rwa_by_policy_version(adapters.exposures(spark, sf), composite, thresholds=True)


@query
def rule_overlay(spark, sf):
    base, delta = adapters.instrument_rules(spark, sf)
    composite = rules.overlay(base, delta, "V2").where(~F.col("excluded"))
    return composite.select("asset_class", "risk_bucket", F.col("risk_weight").cast("double").alias("risk_weight"), "origin")


@query
def rule_delta(spark, sf):
    base, delta = adapters.instrument_rules(spark, sf)
    return rules.rule_delta(rules.alone(base, "V1"), rules.overlay(base, delta, "V2"))


@query
def feedback_adjusted_rwa(spark, sf):
    adjusted = rules.overlay(adapters.v1_rules(spark), adapters.feedback(spark), "V1-adjusted")
    cube = rules.position_cube(adapters.exposures(spark, sf))
    cells = rules.weighted_cells(cube, _v1(spark).unionByName(adjusted))
    pair = compare.compare_pair(cells, "V1", "V1-adjusted", run_column="policy_version")
    return pair.select(
        "portfolio", "risk_bucket",
        F.col("baseline").cast("double").alias("rwa_before"), F.col("updated").cast("double").alias("rwa_after"),
    )


@query
def reconciliation(spark, sf):
    kinds = rules.overlay(adapters.v1_rules(spark), adapters.kind_delta(spark), "V2K")
    every = _v1(spark).unionByName(_v2(spark)).unionByName(kinds)
    return rules.reconciliation(adapters.exposures(spark, sf), every)


@query
def rule_text_execution(spark, sf):
    """The rules of three versions rendered as text and run, beside the same rules as rows."""
    kinds = rules.overlay(adapters.v1_rules(spark), adapters.kind_delta(spark), "V2K")
    every = _v1(spark).unionByName(_v2(spark)).unionByName(kinds)
    facts = stage(adapters.exposures(spark, sf), "exposures")
    versions = rule_text.rendered(every).select(
        F.col("policy_version").alias("sql_version_id"), F.lit(None).cast("string").alias("policy_id"),
        F.col("policy_version").alias("policy_version_id"), "generated_sql",
    )
    mapping = _v1(spark).select("asset_class", "risk_bucket", "risk_weight")
    cells, _ = rule_text.run_texts(stage(versions, "texts"), {"exposures": facts, "risk_weight_mapping": mapping})
    return rule_text.against_rules(cells, rules.weighted_cells(rules.position_cube(facts, every), every))


# --- comparison, stress, capital ---------------------------------------------


@query
def rwa_comparison(spark, sf):
    return compare.rwa_comparison(_comparison(spark, sf))


@query
def run_pair_comparison(spark, sf):
    return _by_run(spark, sf, lambda cells: compare.published(cells, compare.PAIR))


@query
def run_pair_summary(spark, sf):
    return _by_run(spark, sf, compare.comparison_summary)


@query
def run_pair_waterfall(spark, sf):
    return _by_run(spark, sf, compare.delta_waterfall)


@query
def run_pair_stress(spark, sf):
    return _by_run(spark, sf, compare.stress_grid)


@query
def run_pair_stress_by_bucket(spark, sf):
    return _by_run(spark, sf, compare.stress_by_bucket)


@query
def run_pair_drivers(spark, sf):
    return _by_run(spark, sf, compare.delta_drivers)


@query
def run_pair_top_drivers(spark, sf):
    return _by_run(spark, sf, compare.top_drivers)


@query
def run_pair_sensitivity(spark, sf):
    return _by_run(spark, sf, compare.bucket_sensitivity)


@query
def comparison_summary(spark, sf):
    return compare.comparison_summary(_comparison(spark, sf)).drop(*compare.PAIR)


@query
def delta_waterfall(spark, sf):
    return compare.delta_waterfall(_comparison(spark, sf)).drop(*compare.PAIR)


@query
def stress_grid(spark, sf):
    return compare.stress_grid(_comparison(spark, sf)).drop(*compare.PAIR)


@query
def stress_by_bucket(spark, sf):
    return compare.stress_by_bucket(_comparison(spark, sf)).drop(*compare.PAIR)


@query
def capital_ratios(spark, sf):
    return capital.capital_ratios(_total_by_version(spark, sf), ["policy_version"])


@query
def capital_buffers(spark, sf):
    return capital.capital_buffers(_total_by_version(spark, sf), ["policy_version"])


@query
def top_portfolios(spark, sf):
    return compare.top_portfolios(_cells(spark, sf))


@query
def delta_drivers(spark, sf):
    return compare.delta_drivers(_comparison(spark, sf)).drop(*compare.PAIR)


@query
def bucket_sensitivity(spark, sf):
    return compare.bucket_sensitivity(_comparison(spark, sf)).drop(*compare.PAIR)


def _amounts(runs: DataFrame, cells: DataFrame) -> DataFrame:
    return registry.computed_amounts(runs, cells, adapters.rule_version_of())


@query
def dashboard_kpis(spark, sf):
    events = _events(spark, sf, staged=True)
    runs = stage(registry.run_state(events), "report_runs")
    return registry.dashboard_kpis(
        registry.document_state(events), registry.sql_version_state(events), runs, _amounts(runs, _cells(spark, sf))
    )


@query
def context_bundle(spark, sf):
    events = _events(spark, sf, drafts=True, staged=True)
    runs = stage(registry.run_state(events), "report_runs")
    by_version = stage(_cells(spark, sf), "rwa_cells")
    metrics = registry.dashboard_kpis(
        registry.document_state(events), registry.sql_version_state(events), runs, _amounts(runs, by_version)
    )
    pairs = _run_pairs(runs)
    cells = compare.for_runs(stage(compare.compare_versions(by_version, pairs), "pair_cells"), pairs)
    return compare.context_bundle(cells, _chain(events), metrics).select("policy_id", "run_a", "run_b", "context_json")


# --- registry state ----------------------------------------------------------


@query
def document_state(spark, sf):
    return registry.document_state(_events(spark, sf))


@query
def sql_version_state(spark, sf):
    return registry.sql_version_state(_events(spark, sf)).select(
        "sql_version_id", "policy_version_id", "validation_status", "approved_by", "approved_at"
    )


@query
def run_state(spark, sf):
    return registry.run_state(_events(spark, sf)).select(
        "run_id", "policy_id", "policy_version_id", "sql_version_id", "run_status", "started_at", "ended_at"
    )


def _by_snapshot(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A state from a snapshot over the first half of the time and a tail that starts before its end."""
    events = _events(spark, sf, staged=True)
    span = events.agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("b")).selectExpr(
        "CAST(a AS TIMESTAMP) + (CAST(b AS TIMESTAMP) - CAST(a AS TIMESTAMP)) / 2 AS middle",
        "CAST(a AS TIMESTAMP) + (CAST(b AS TIMESTAMP) - CAST(a AS TIMESTAMP)) / 3 AS third",
    ).first()
    log = EventLog(spark, scratch_path(spark, "event_log"))
    if span.middle is not None:
        cut = lambda value: F.lit(value).cast("timestamp_ntz")
        log.append(events.where(F.col("event_ts") <= cut(span.middle)), "early")
        log.snapshot("1")
        log.append(events.where(F.col("event_ts") >= cut(span.third)), "late")
    return log.state(name)


@query
def document_state_from_snapshot(spark, sf):
    return _by_snapshot(spark, sf, "documents")


@query
def sql_version_state_from_snapshot(spark, sf):
    return _by_snapshot(spark, sf, "sql_versions").select(
        "sql_version_id", "policy_version_id", "validation_status", "approved_by", "approved_at"
    )


@query
def run_state_from_snapshot(spark, sf):
    return _by_snapshot(spark, sf, "runs")


@query
def latest_approved_sql(spark, sf):
    return audit.latest_approved_sql(_drafted_sql(spark, sf))


@query
def latest_policy_version(spark, sf):
    return audit.latest_policy_version(registry.document_state(_events(spark, sf)))


@query
def superseded_baseline(spark, sf):
    events = _events(spark, sf, staged=True)
    return audit.superseded_baseline(registry.document_state(events), registry.sql_version_state(events))


@query
def gated_report_outputs(spark, sf):
    events = _events(spark, sf, staged=True)
    allowed = registry.allowed(registry.run_state(events), registry.run_gate(events))
    return _outputs(spark, sf, allowed).drop("rwa_exact")


@query
def gate_violations(spark, sf):
    events = _events(spark, sf, staged=True)
    return registry.gate_violations(registry.run_state(events), registry.run_gate(events))


@query
def orphan_events(spark, sf):
    events = _events(spark, sf, staged=True)
    return registry.orphan_events(events, registry.sql_version_state(events))


@query
def recent_runs(spark, sf):
    return registry.recent_runs(registry.run_state(_events(spark, sf)))


# --- lineage and lookups -----------------------------------------------------


@query
def lineage_coverage(spark, sf):
    events = _events(spark, sf, staged=True)
    runs = stage(registry.run_state(events), "report_runs")
    stamps = audit.computed_stamps(runs, _cells(spark, sf), adapters.rule_version_of())
    return audit.lineage_coverage(
        stamps, runs, registry.sql_version_state(events), registry.document_state(events)
    )


@query
def lineage_chain(spark, sf):
    return _chain(_events(spark, sf, drafts=True, staged=True))


@query
def lineage_edges(spark, sf):
    return audit.lineage_edges(_chain(_events(spark, sf, drafts=True, staged=True)))


@query
def policy_timeline(spark, sf):
    events = _events(spark, sf, staged=True)
    return audit.policy_timeline(
        registry.document_state(events), registry.sql_version_state(events), registry.run_state(events)
    )


@query
def policy_event_timeline(spark, sf):
    events = _events(spark, sf, staged=True)
    return audit.policy_event_timeline(
        registry.document_state(events), registry.sql_version_state(events), registry.run_state(events)
    )


@query
def sql_versions_by_policy(spark, sf):
    events = _events(spark, sf, drafts=True, staged=True)
    return audit.sql_versions_by_policy(registry.sql_version_state(events), registry.document_state(events))


@query
def extraction_details(spark, sf):
    events = _events(spark, sf, drafts=True, staged=True)
    return audit.extraction_details(
        registry.extractions(events), registry.sql_version_state(events), registry.document_state(events)
    )


@query
def sql_version_details(spark, sf):
    events = _events(spark, sf, drafts=True, staged=True)
    return audit.sql_version_details(registry.sql_version_state(events), registry.document_state(events))


@query
def table_browse(spark, sf):
    return tables.browse(tables.scan(spark, sf, "documents"), 200)


@query
def policy_objects(spark, sf):
    listing = audit.policy_objects(adapters.file_objects(spark, sf), adapters.registered_files(spark, sf))
    return listing


# --- rule text ---------------------------------------------------------------


def _drafted_sql(spark: SparkSession, sf: str) -> DataFrame:
    return registry.sql_version_state(_events(spark, sf, drafts=True))


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    found = files.file_columns(spark, {t: f"{sf}/{t}.parquet" for t in ("events", "documents")})
    return text.schema_drift(_drafted_sql(spark, sf), stage(files.live_columns(found), "live_columns"))


@query
def schema_drift(spark, sf):
    return _drift(spark, sf)


@query
def schema_drift_counts(spark, sf):
    return text.drift_counts(_drift(spark, sf))


@query
def sql_version_diff(spark, sf):
    return text.line_diff(adapters.rule_texts(spark, sf))


@query
def sql_version_hunks(spark, sf):
    return hunks.diff_hunks(adapters.rule_texts(spark, sf))


@query
def clause_table(spark, sf):
    return text.clause_table(_drafted_sql(spark, sf))


@query
def clause_type_counts(spark, sf):
    return text.clause_type_counts(text.clause_table(_drafted_sql(spark, sf)))


@query
def clause_traceability(spark, sf):
    return text.clause_traceability(_drafted_sql(spark, sf))


# --- transactions ------------------------------------------------------------


def _money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


AMOUNTS = ("transaction_amount", "credit_limit")


def _sink(spark: SparkSession, name: str) -> tuple[str, str]:
    root = scratch_path(spark, name)
    return f"{root}/rows", f"{root}/checkpoint"


@query
def breach_events(spark, sf):
    return _money(tx.breaches(adapters.transactions(spark, sf), F.col("transaction_time")), *AMOUNTS)


@query
def breach_by_cardholder(spark, sf):
    return tx.breach_by_cardholder(adapters.transactions(spark, sf))


@query
def breach_stream(spark, sf):
    rows, checkpoint = _sink(spark, "breach_stream")
    feed = adapters.transactions_from(tables.stream(spark, sf, "events"))
    monitor.breach_monitor(feed, rows, checkpoint, available_now=True).awaitTermination()
    return _money(tables.scan_declared(spark, rows, "breach_events").drop("breached_at"), *AMOUNTS)


@query
def feed_metrics_stream(spark, sf):
    rows, checkpoint = _sink(spark, "feed_metrics_stream")
    feed = adapters.transactions_from(tables.stream(spark, sf, "events"))
    monitor.metrics_stream(
        feed, tx.is_breach(), "breach_count", rows, checkpoint, available_now=True
    ).awaitTermination()
    return monitor.current_metrics(spark, rows)


@query
def transaction_feed(spark, sf):
    return _money(tx.transaction_feed(adapters.transactions(spark, sf)), *AMOUNTS)


def _coarse() -> Column:
    """The score to two decimals, as far as two solvers agree."""
    return F.round("fraud_score", 2).alias("fraud_score")


@query
def fraud_scores(spark, sf):
    swipes = adapters.transactions(spark, sf)
    scored = tx.score(tx.train(swipes), swipes)
    return _money(scored, *AMOUNTS).select("transaction_id", *AMOUNTS, "predicted_label", _coarse(), "alert")


@query
def class_probabilities(spark, sf):
    swipes = adapters.transactions(spark, sf)
    both = tx.class_probabilities(tx.train(swipes), swipes)
    return both.select("transaction_id", F.round("ordinary", 2).alias("ordinary"), F.round("fraud", 2).alias("fraud"))


@query
def scored_feed(spark, sf):
    swipes = adapters.transactions(spark, sf)
    scored = tx.scored_feed(tx.train(swipes), swipes)
    return _money(scored, *AMOUNTS).select(
        "transaction_id", "cardholder_id", *AMOUNTS, "transaction_time", "predicted_label", _coarse(), "alert"
    )


@query
def fraud_feed_metrics(spark, sf):
    swipes = adapters.transactions(spark, sf)
    scored = tx.score(tx.train(swipes), swipes)
    return tx.feed_metrics(scored, F.col("predicted_label") == 1, "fraud_count")


@query
def scored_stream(spark, sf):
    rows, checkpoint = _sink(spark, "scored_stream")
    model = tx.train(adapters.transactions(spark, sf))
    feed = adapters.transactions_from(tables.stream(spark, sf, "events"))
    scored = monitor.score_stream(model, feed, rows, checkpoint, available_now=True)
    scored.awaitTermination()
    return spark.read.parquet(rows).select("transaction_id", "predicted_label", _coarse(), "alert")


@query
def fallback_feed(spark, sf):
    """What the feed shows while there is no model."""
    return _money(tx.feed_or_fallback(None, adapters.transactions(spark, sf)), *AMOUNTS)


@query
def raw_breaches(spark, sf):
    """The newest rows of the breach sink, which have a time of their own."""
    rows, checkpoint = _sink(spark, "raw_breaches")
    feed = adapters.transactions_from(tables.stream(spark, sf, "events"))
    monitor.breach_monitor(feed, rows, checkpoint, available_now=True, breached_at=F.col("transaction_time")).awaitTermination()
    return _money(monitor.raw_fallback(spark, rows), *AMOUNTS)


@query
def breach_stamps(spark, sf):
    """Every breach is stamped with the time at which it is found."""
    stamped = tx.breaches(adapters.transactions(spark, sf), F.current_timestamp().cast("timestamp_ntz"))
    now = F.current_timestamp().cast("timestamp_ntz")
    return stamped.select("transaction_id", F.coalesce(F.col("breached_at") == now, F.lit(False)).alias("stamped_now"))


# --- sources and sinks -------------------------------------------------------


@query
def document_intake(spark, sf):
    """Documents as uploads: minted ids, object path, summary and progress text."""
    docs = tables.scan(spark, sf, "documents")
    policy = scalars.mint_id("POL-", F.col("source"), F.col("doc_id").cast("string"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    rows = docs.select("doc_id", policy.alias("policy_id"), name.alias("filename"), "text")
    rows = rows.withColumn("policy_version_id", scalars.version_id(F.col("policy_id"), F.col("filename")))
    summary = scalars.summary_text(F.col("text"), F.concat(F.lit("Policy "), "policy_version_id", F.lit(" parsed.")))
    return rows.select(
        "doc_id", "policy_id", "policy_version_id", scalars.object_path(F.col("policy_version_id"), F.col("filename")).alias("gcs_uri"),
        summary.alias("summary"), scalars.progress_text("Extraction complete: ", summary).alias("progress"),
    )


@query
def unlabelled_documents(spark, sf):
    """Documents that the label table does not know."""
    return audit.must_exist(tables.scan(spark, sf, "documents"), tables.scan(spark, sf, "labels"), "doc_id")


@query
def live_schema_snapshot(spark, sf):
    """The snapshot that a draft stores, of two tables as their files are now."""
    found = files.file_columns(spark, {t: f"{sf}/{t}.parquet" for t in ("events", "documents")})
    return tables.schema_snapshot(files.live_columns(found), "demo", "capital")


@query
def table_listing(spark, sf):
    """The files of the given tables as an object listing: how many, and which have a body and a hash."""
    listed = files.object_listing(spark, sf).where("uri LIKE '%/documents.parquet%' AND uri NOT LIKE '%/\\_%' AND uri NOT LIKE '%/.%'")
    hashed = listed.where("size > 0 AND length(md5_hash) = 32 AND updated IS NOT NULL")
    return hashed.agg((F.count("*") > 0).alias("listed"), F.max("content_type").alias("content_type"))


@query
def rewritten_breaches(spark, sf):
    """A sink table refreshed, appended to and read back; a column it lacks stays NULL, one it does not know goes."""
    path = scratch_path(spark, "rewritten")
    found = tx.breaches(adapters.transactions(spark, sf), F.col("transaction_time"))
    large = F.col("transaction_amount") > 2 * F.col("credit_limit")
    sinks.refresh(found.limit(1), path, "breach_events")
    sinks.refresh(found.where(large).withColumn("note", F.lit("dropped")), path, "breach_events")
    sinks.append(found.where(~large).drop("cardholder_id"), path, "breach_events")
    return _money(tables.scan_declared(spark, path, "breach_events"), *AMOUNTS)


@query
def reset_tables(spark, sf):
    """Rows of the transactional tables before and after a reset."""
    root = scratch_path(spark, "reset")
    events = _events(spark, sf, drafts=True, staged=True)
    runs = registry.run_state(events)
    states = {
        "policy_documents": registry.document_state(events), "policy_extractions": registry.extractions(events),
        "policy_sql_versions": registry.sql_version_state(events), "report_runs": runs,
        "rwa_report_outputs": _outputs(spark, sf, registry.allowed(runs, registry.run_gate(events))),
    }
    for name, state in states.items():
        sinks.refresh(state, f"{root}/{name}", name)

    def counted(column: str) -> DataFrame:
        parts = [
            tables.scan_declared(spark, f"{root}/{name}", name).agg(F.count("*").alias(column)).withColumn("table_name", F.lit(name))
            for name in TRANSACTIONAL_TABLES
        ]
        return stage(union_all(parts), column)

    before = counted("rows_before")
    sinks.reset(spark, root)
    return before.join(counted("rows_after"), "table_name").select("table_name", "rows_before", "rows_after")


@query
def derived_rwa_table(spark, sf):
    """RWA by version as a table of the catalog."""
    sinks.derive_table(QUERIES["rwa_by_policy_version"](spark, sf), "rwa_by_policy_version_derived", scratch_path(spark, "derived"))
    return spark.table("rwa_by_policy_version_derived")


@query
def rerun_report_outputs(spark, sf):
    """Outputs written twice, the first time with other amounts: the last attempt of each run counts."""
    path = scratch_path(spark, "report_outputs")
    outputs = stage(QUERIES["gated_report_outputs"](spark, sf), "outputs")
    sinks.publish_outputs(outputs.withColumn("rwa_amount", F.col("rwa_amount") + 1), path)
    sinks.publish_outputs(outputs, path)
    return sinks.read_outputs(spark, path)


def _exported(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The folder of an audit export of all runs, and their lineage."""
    root = scratch_path(spark, "audit_export")
    events = _events(spark, sf, drafts=True, staged=True)
    chain = stage(_chain(events), "lineage")
    comparison = compare.rwa_comparison(_comparison(spark, sf)).withColumn("run_id", F.lit("V1-V2"))
    sinks.export_audit(chain, registry.sql_version_state(events), comparison, root)
    return root, chain


@query
def exported_lineage(spark, sf):
    """The lineage of every run, read back from the JSON of the audit export."""
    root, chain = _exported(spark, sf)
    return spark.read.schema(chain.schema).json(f"{root}/lineage_metadata").select(*chain.columns)


@query
def exported_comparison(spark, sf):
    """The comparison, read back from the CSV of the audit export."""
    root, _ = _exported(spark, sf)
    table = spark.read.option("header", True).csv(f"{root}/rwa_comparison")
    amounts = [F.col(c).cast("double").alias(c) for c in ("rwa_baseline", "rwa_updated", "rwa_delta")]
    return table.select("portfolio", "risk_bucket", *amounts)


@query
def exported_graph_lines(spark, sf):
    """The lineage graph of the last run, written and read back as text."""
    root, chain = _exported(spark, sf)
    last = chain.agg(F.max("run_id")).first()[0]
    events = _events(spark, sf, drafts=True, staged=True)
    sinks.export_run(chain, registry.sql_version_state(events), last or "", f"{root}/one")
    return spark.read.schema("value string").text(f"{root}/one/lineage_graph")
