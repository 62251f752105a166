"""Declared table schemas and money types."""

from pyspark.sql import types as T

# Products stay inside decimal(38): (18,2) x (7,4), summed.
MONEY = T.DecimalType(18, 2)
WEIGHT = T.DecimalType(7, 4)
STRING = T.StringType()
LONG = T.LongType()
INT = T.IntegerType()
DOUBLE = T.DoubleType()
TIME = T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Table layouts users of the registry already rely on.
TABLES = {
    "exposures": _schema(portfolio=STRING, asset_class=STRING, exposure_amount=MONEY),
    "risk_weight_mapping": _schema(asset_class=STRING, risk_bucket=STRING, risk_weight=WEIGHT),
    "simulated_transactions": _schema(
        transaction_id=STRING, cardholder_id=STRING, transaction_amount=MONEY, credit_limit=MONEY,
        transaction_time=TIME, is_fraud_label=INT,
    ),
    "breach_events": _schema(
        transaction_id=STRING, cardholder_id=STRING, transaction_amount=MONEY, credit_limit=MONEY, breached_at=TIME
    ),
    "policy_documents": _schema(
        policy_id=STRING, policy_version_id=STRING, uploaded_at=TIME, uploaded_by=STRING, gcs_uri=STRING,
        status=STRING, supersedes_policy_version_id=STRING,
    ),
    "policy_objects": _schema(uri=STRING, content_type=STRING, size=LONG, updated=TIME, md5_hash=STRING),
    "policy_extractions": _schema(
        policy_version_id=STRING, extraction_json=STRING, clause_citations=STRING, model_version=STRING,
        created_at=TIME,
    ),
    "policy_sql_versions": _schema(
        sql_version_id=STRING, policy_version_id=STRING, generated_sql=STRING, agent_trace=STRING,
        schema_snapshot=STRING, validation_status=STRING, approved_by=STRING, approved_at=TIME,
    ),
    "report_runs": _schema(
        run_id=STRING, policy_id=STRING, policy_version_id=STRING, sql_version_id=STRING, run_status=STRING,
        started_at=TIME, ended_at=TIME,
    ),
    "rwa_report_outputs": _schema(
        portfolio=STRING, risk_bucket=STRING, rwa_amount=DOUBLE, as_of_date=T.DateType(), run_id=STRING,
        policy_id=STRING, policy_version_id=STRING, sql_version_id=STRING,
    ),
    "registry_events": _schema(
        event_id=LONG, event_ts=TIME, event_type=STRING, policy_id=STRING, policy_version_id=STRING,
        sql_version_id=STRING, run_id=STRING, actor=STRING, payload=STRING,
    ),
}

# The given tables the queries read. A declared schema spares every
# query the pass over file footers that inference takes.
SOURCES = {
    "customer": _schema(
        c_custkey=LONG, c_name=STRING, c_nationkey=INT, c_acctbal=DOUBLE, c_mktsegment=STRING
    ),
    "part": _schema(
        p_partkey=LONG, p_name=STRING, p_brand=STRING, p_type=STRING, p_size=INT, p_retailprice=DOUBLE
    ),
    "orders": _schema(
        o_orderkey=LONG, o_custkey=LONG, o_orderstatus=STRING, o_totalprice=DOUBLE, o_orderdate=TIME,
        o_orderpriority=STRING,
    ),
    "lineitem": _schema(
        l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=DOUBLE,
        l_extendedprice=DOUBLE, l_discount=DOUBLE, l_tax=DOUBLE, l_returnflag=STRING, l_linestatus=STRING,
        l_shipdate=TIME,
    ),
    "events": _schema(event_id=LONG, ts=TIME, user_id=LONG, event_type=STRING, value=DOUBLE, props=STRING),
    "documents": _schema(doc_id=LONG, text=STRING, lang=STRING, source=STRING, n_chars=LONG),
    "labels": _schema(doc_id=LONG, quality=INT, toxic=INT),
}

# Tables a demo reset empties; the seeded rule tables are refreshed instead.
TRANSACTIONAL_TABLES = (
    "policy_documents",
    "policy_extractions",
    "policy_sql_versions",
    "report_runs",
    "rwa_report_outputs",
)

COLUMN_ROWS = _schema(table_name=STRING, ordinal=INT, column_name=STRING, data_type=STRING)

# JSON payloads.
TRACE = _schema(
    policy_gcs_uri=STRING,
    model=STRING,
    generated_at=STRING,
    clause_citations=T.ArrayType(
        _schema(clause_id=STRING, clause_text=STRING, clause_type=STRING, sql_section=STRING)
    ),
    summary=STRING,
    user_feedback=STRING,
    original_policy_gcs_uri=STRING,
)
SNAPSHOT = _schema(
    project=STRING, dataset=STRING, tables=T.MapType(STRING, T.ArrayType(_schema(column_name=STRING, data_type=STRING)))
)
# What a generated / regenerated event carries in ``payload``.
DRAFT_PAYLOAD = _schema(
    generated_sql=STRING, agent_trace=STRING, schema_snapshot=STRING, extraction_json=STRING, clause_citations=STRING,
    model_version=STRING,
)
