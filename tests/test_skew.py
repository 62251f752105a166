"""The queries on tables where one key holds a third of all rows."""

import tempfile

import duckdb
import pytest
from check_oracle import TABLES, compare, duck

from __spark_entry__ import oracle_sql, queries
from pyspark.sql import functions as F

from capledger.operators import compare as run_compare, hunks

@pytest.fixture(scope="module")
def skewed():
    """sf0.001 with a third of each table moved to one user, source, part, customer and order."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    hot = {
        "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id)",
        "documents": "* REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source)",
        "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey)",
        "lineitem": "* REPLACE (CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey,"
        " CASE WHEN l_linenumber % 3 = 1 THEN 9 ELSE l_orderkey END AS l_orderkey)",
    }
    con = duckdb.connect()
    for table in TABLES:
        con.execute(
            f"COPY (SELECT {hot.get(table, '*')} FROM '/root/testdata/sf0.001/{table}.parquet')"
            f" TO '{root}/{table}.parquet' (FORMAT parquet)"
        )
    return root


NAMES = [
    "rwa_by_policy_version", "rwa_all_rule_kinds", "reconciliation", "run_pair_comparison", "dashboard_kpis",
    "document_state", "sql_version_state", "run_state", "gated_report_outputs", "gate_violations", "lineage_chain",
    "lineage_coverage", "policy_timeline", "policy_event_timeline", "sql_version_diff", "breach_by_cardholder",
]


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, skewed, name):
    assert compare(duck(skewed), spark, skewed, name, queries()[name], oracle_sql()[name]) is None


def test_run_pairs_are_dealt_out_by_their_results(spark, monkeypatch):
    monkeypatch.setattr(run_compare, "ROWS_A_TASK", 100)
    results = spark.range(50).selectExpr("'V1' AS run_a", "'V2' AS run_b", "id AS cell")
    pairs = spark.range(0, 40, 1, 1).selectExpr("'p' AS policy_id", "concat('a', id) AS run_a", "concat('b', id) AS run_b", "'V1' AS carry_a", "'V2' AS carry_b")
    found = run_compare.for_runs(results, pairs)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert found.distinct().count() == 2000


def test_hunks_align_digests_only(spark):
    texts = spark.createDataFrame([("p", 1, "a\nb"), ("p", 2, "a\nc")], "policy_id string, version_no long, text string")
    assert "line" not in hunks._sided_lines(texts, hunks.version_pairs(texts)).columns
