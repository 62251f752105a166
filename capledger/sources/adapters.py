"""Domain frames derived from the star-schema and event tables.

Column rules only: every derived row comes from a row of the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.operators.ordered import running
from capledger.schemas import TABLES
from capledger.sources.tables import scan

# Rule versions for the part types. PROMO has no V1 rule.
V1_MAPPING = (
    ("ECONOMY", "Low", "0.20"),
    ("SMALL", "Low", "0.20"),
    ("STANDARD", "Medium", "0.50"),
    ("MEDIUM", "Medium", "0.50"),
    ("LARGE", "High", "1.00"),
)
V2_MAPPING = (("SMALL", "Medium", "0.50"), ("PROMO", "VeryHigh", "1.50"))
V2_EXCLUDED = ("MEDIUM",)

# Credit limits by user_id % 4.
CARD_LIMITS = (250, 100, 500, 75)

# Columns of the snapshot stored with each generated rule version.
EVENTS_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rule_rows(spark: SparkSession, rows: list[str]) -> DataFrame:
    """Rule rows from SQL value tuples ``(kind, class, bucket, weight, min amount, multiplier)``."""
    return spark.sql(
        "SELECT kind, asset_class, CAST(bucket AS STRING) AS risk_bucket,"
        " CAST(weight AS DECIMAL(7,4)) AS risk_weight, CAST(min_amount AS DECIMAL(18,2)) AS min_amount,"
        " CAST(multiplier AS DECIMAL(7,4)) AS multiplier"
        f" FROM VALUES {', '.join(rows)} AS t(kind, asset_class, bucket, weight, min_amount, multiplier)"
    )


def _mapping(rows) -> list[str]:
    return [f"('mapping', '{c}', '{b}', {w}, NULL, NULL)" for c, b, w in rows]


def v1_rules(spark: SparkSession) -> DataFrame:
    return rule_rows(spark, _mapping(V1_MAPPING))


def v2_delta(spark: SparkSession) -> DataFrame:
    return rule_rows(
        spark, _mapping(V2_MAPPING) + [f"('exclusion', '{c}', NULL, NULL, NULL, NULL)" for c in V2_EXCLUDED]
    )


def kind_delta(spark: SparkSession) -> DataFrame:
    """One rule of every kind."""
    return rule_rows(
        spark,
        [
            "('mapping', 'PROMO', 'VeryHigh', 1.50, NULL, NULL)",
            "('exclusion', 'MEDIUM', NULL, NULL, NULL, NULL)",
            "('threshold', 'LARGE', NULL, NULL, 50000, NULL)",
            "('calculation', 'ECONOMY', NULL, NULL, NULL, 1.25)",
            "('definition', 'STANDARD', NULL, NULL, NULL, NULL)",
        ],
    )


def feedback(spark: SparkSession) -> DataFrame:
    """Manual override: 2.5 times the weight for LARGE."""
    return rule_rows(spark, ["('calculation', 'LARGE', NULL, NULL, NULL, 2.5)"])


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as exposures of a market segment to a part type; one without its part has no
    class, one without its order or customer no portfolio.

    Orders meet customers before they meet line items, so the fact side is
    shuffled once per key and the wide join carries three columns.
    """
    line = scan(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("exposure_amount")
    )
    part = scan(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("asset_class"))
    customer = scan(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("portfolio")
    )
    booked = (
        scan(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        .join(customer, "o_custkey", "left")
        .select("l_orderkey", "portfolio")
    )
    return line.join(part, "l_partkey", "left").join(booked, "l_orderkey", "left").select("portfolio", "asset_class", "exposure_amount")


def instrument_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base and update rules with one rule per part.

    Base: the V1 rule of the part's type. Update: sizes divisible by 5 move to
    VeryHigh 1.50 (also parts without a base rule), sizes that leave 3 by 7 are excluded.
    """
    part = scan(spark, sf_dir, "part").select(
        F.concat(F.lit("PART-"), "p_partkey").alias("asset_class"), "p_type", "p_size"
    )
    none = {"min_amount": F.lit(None).cast("decimal(18,2)"), "multiplier": F.lit(None).cast("decimal(7,4)")}
    by_type = v1_rules(spark).select(F.col("asset_class").alias("p_type"), "kind", "risk_bucket", "risk_weight")
    base = part.join(by_type, "p_type").select("kind", "asset_class", "risk_bucket", "risk_weight").withColumns(none)
    moved, excluded = F.col("p_size") % 5 == 0, F.col("p_size") % 7 == 3
    delta = part.where(moved | excluded).select(
        F.when(excluded, "exclusion").otherwise("mapping").alias("kind"),
        "asset_class",
        F.when(~excluded, "VeryHigh").alias("risk_bucket"),
        F.when(~excluded, F.lit("1.50").cast("decimal(7,4)")).alias("risk_weight"),
    ).withColumns(none)
    return base, delta


def transactions_from(events: DataFrame) -> DataFrame:
    """Card swipes; also applies to a streaming frame. The label disagrees with the
    limit rule on every 50th event."""
    first = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(CARD_LIMITS[:3]))
    return events.selectExpr(
        "concat('TX-', event_id) AS transaction_id",
        "concat('CH-', 1001 + user_id % 4) AS cardholder_id",
        "CAST(value AS DECIMAL(18,2)) AS transaction_amount",
        f"CAST(CASE user_id % 4 {first} ELSE {CARD_LIMITS[3]} END AS DECIMAL(18,2)) AS credit_limit",
        "ts AS transaction_time",
        "event_id % 50 = 0 AS flipped",
    ).selectExpr(
        "* EXCEPT (flipped)",
        "CAST((transaction_amount > credit_limit) <> flipped AS INT) AS is_fraud_label",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from(scan(spark, sf_dir, "events"))


def _column_rows(columns: str) -> str:
    """SQL array of (column_name, data_type) structs from a DDL-like list."""
    rows = [c.split() for c in columns.split(", ")]
    return "array(" + ", ".join(f"named_struct('column_name', '{c}', 'data_type', '{t}')" for c, t in rows) + ")"


def _draft_payload(with_text: bool) -> str:
    """SQL for a generated rule version from the event's number ``k``: text, trace and
    snapshot, with missing fields, an unreadable trace and a missing snapshot among
    them. Without ``with_text`` drafts carry no payload."""
    if not with_text:
        return "NULL"
    clause_type = "element_at(array('threshold', 'mapping', 'calculation', 'exclusion', 'definition'), CAST(({n}) % 5 + 1 AS INT))"
    first = "concat(IF(k % 3 = 0, 'V1-C', 'C'), k % 10)"
    second = "concat('V2-C', k % 13)"
    citation = (
        "named_struct('clause_id', {id}, 'clause_text', concat('weight rule ', k), 'clause_type', {type},"
        " 'sql_section', 'weights')"
    )
    citations = "array_compact(array({}, {}))".format(
        citation.format(id=first, type=f"IF(k % 7 <> 0, {clause_type.format(n='k')}, NULL)"),
        "IF(k % 2 = 0, {}, NULL)".format(
            citation.format(id=f"IF(k % 11 <> 0, {second}, NULL)", type=clause_type.format(n="k + 1"))
        ),
    )
    summary = r"""concat('rules "', k, '"\nrevised')"""
    uri = "concat('policies/source-', k, '.pdf')"
    trace = (
        f"to_json(named_struct('policy_gcs_uri', {uri}, 'model', 'rules', 'clause_citations', {citations},"
        f" 'summary', {summary}))"
    )
    text = rf"""concat_ws('\n',
        IF(k % 4 <> 1, concat('-- [', {first}, '] weights'), NULL),
        'SELECT portfolio, risk_bucket, SUM(exposure_amount * risk_weight)',
        IF(k % 6 = 0, '-- [C77] carried over', NULL),
        IF(k % 2 = 0 AND k % 11 <> 0, concat('-- [', {second}, '] update'), NULL),
        'GROUP BY portfolio, risk_bucket')"""
    events = (
        f"concat(filter({_column_rows(EVENTS_COLUMNS)}, (c, i) -> NOT (k % 3 = 0 AND i = k % 6)),"
        f" slice({_column_rows('legacy_k int')}, 1, IF(k % 4 = 1, 1, 0)))"
    )
    tables = (
        f"IF(k % 5 <> 0, map('events', {events}, 'documents', {_column_rows(DOCUMENTS_COLUMNS)}),"
        f" map('events', {events}))"
    )
    return f"""to_json(named_struct(
        'generated_sql', {text},
        'agent_trace', IF(k % 25 = 24, '{{unreadable', {trace}),
        'schema_snapshot',
            IF(k % 10 = 9, NULL, to_json(named_struct('project', 'demo', 'dataset', 'capital', 'tables', {tables}))),
        'extraction_json', to_json(named_struct('policy_gcs_uri', {uri}, 'summary', {summary})),
        'clause_citations', to_json(named_struct('summary', {summary})),
        'model_version', concat('template-v', k % 3)))"""


def registry_events(spark: SparkSession, sf_dir: str, drafts: bool = True) -> DataFrame:
    """User events as registry events of the user's policy.

    Sign-ups upload versions, clicks generate (or, every fourth id, regenerate) rule
    versions, views approve, purchases and errors are succeeded and failed runs.
    Everything attaches to the newest rule version of the current policy version;
    events before the first upload have neither. Without ``drafts`` the rule texts,
    traces and snapshots are not built.
    """
    generates = "event_type = 'click' AND event_id % 4 <> 0"
    position = "named_struct('ts', ts, 'event_id', event_id)"
    ordered = running(
        scan(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"),
        ["user_id"],
        ["ts", "event_id"],
        {
            "version": ("sum", F.expr("IF(event_type = 'signup', 1, 0)")),
            "upload": ("max", F.expr(f"IF(event_type = 'signup', {position}, NULL)")),
            "draft": ("max", F.expr(f"IF({generates}, {position}, NULL)")),
        },
    )
    return (
        ordered.selectExpr(
            "event_id",
            "ts AS event_ts",
            "event_type AS kind",
            "concat('POL-', user_id) AS policy_id",
            "IF(version > 0, concat('POL-', user_id, '-V', version), NULL) AS policy_version_id",
            "IF(version > 1, concat('POL-', user_id, '-V', version - 1), NULL) AS supersedes",
            "IF(draft > upload, concat('SQL-', draft.event_id), NULL) AS sql_version_id",
            "IF(event_type IN ('purchase', 'error'), concat('RUN-', event_id), NULL) AS run_id",
            "concat('analyst-', event_id % 5) AS actor",
            "CAST(get_json_object(props, '$.k') AS INT) AS k",
            f"""explode(CASE WHEN event_type = 'signup' THEN array('uploaded')
                WHEN {generates} THEN array('generated')
                WHEN event_type = 'click' THEN array('regenerated')
                WHEN event_type = 'view' THEN array('approved')
                WHEN event_type IN ('purchase', 'error') THEN array('run_started', 'run_ended') END) AS event_type""",
        )
        .selectExpr(
            "event_id", "event_ts", "event_type", "policy_id", "policy_version_id", "sql_version_id", "run_id", "actor",
            f"""CASE WHEN event_type = 'uploaded' THEN to_json(named_struct(
                    'gcs_uri', concat('policies/', policy_version_id, '/policy.pdf'), 'supersedes', supersedes))
                WHEN event_type IN ('generated', 'regenerated') THEN {_draft_payload(drafts)}
                WHEN event_type = 'run_ended' THEN
                    to_json(named_struct('run_status', IF(kind = 'purchase', 'succeeded', 'failed')))
                END AS payload""",
        )
    )


def rule_version_of(policy_version_id: str = "policy_version_id") -> Column:
    """Odd policy versions run the V1 rules, even ones the composite V2 rules; a run of no version runs V1."""
    number = F.regexp_extract(policy_version_id, r"-V(\d+)$", 1).cast("bigint")
    return F.when(number % 2 == 0, "V2").otherwise("V1")


def file_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an object listing; a later id is a later update."""
    return scan(spark, sf_dir, "documents").select(
        F.format_string("policies/doc-%012d.txt", "doc_id").alias("uri"),
        F.lit("text/plain").alias("content_type"),
        F.col("n_chars").alias("size"),
        F.col("doc_id").alias("updated"),
        F.md5("text").alias("md5_hash"),
    )


def registered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as the registered files."""
    schema = TABLES["policy_documents"]
    labels = scan(spark, sf_dir, "labels").select(
        F.format_string("policies/doc-%012d.txt", "doc_id").alias("gcs_uri"),
        F.concat(F.lit("POL-"), "doc_id").alias("policy_id"),
        F.concat(F.lit("POL-"), "doc_id", F.lit("-V1")).alias("policy_version_id"),
        F.lit("draft").alias("status"),
    )
    return labels.withColumn("uploaded_by", F.lit(None).cast(schema["uploaded_by"].dataType))


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions of their source's rule text."""
    return scan(spark, sf_dir, "documents").select(
        F.col("source").alias("policy_id"), F.col("doc_id").alias("version_no"), "text"
    )
