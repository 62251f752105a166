"""Plans that must hold at any scale."""

import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from capledger.operators import compare, rules
from capledger.plans import catalogue
from capledger.sources import adapters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_columns(text, table):
    return re.search(rf"{table}\.parquet.*?ReadSchema: struct<(.*?)>", text).group(1)


def test_facts_are_read_once_and_narrow(spark, sf):
    text = plan(queries()["rwa_by_policy_version"](spark, sf))
    assert text.count("lineitem.parquet") == 1  # two rule versions, one pass
    assert scan_columns(text, "lineitem") == "l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double"
    assert scan_columns(text, "part") == "p_partkey:bigint,p_type:string"
    assert scan_columns(text, "customer") == "c_custkey:bigint,c_mktsegment:string"
    cube = rules.position_cube(adapters.exposures(spark, sf))
    assert "partial_sum" in plan(cube)


def test_rules_meet_the_cube_not_the_facts(spark, sf):
    text = plan(queries()["rwa_by_policy_version"](spark, sf))
    assert text.index("BroadcastHashJoin [asset_class") < text.index("partial_sum(exposure_amount")


def test_run_filter_reaches_the_output_scan(spark, folder):
    spark.createDataFrame(
        [("r1", "P", "Low", 1.0)], "run_id string, portfolio string, risk_bucket string, rwa_amount double"
    ).write.parquet(folder + "/flat")
    outputs = spark.read.parquet(folder + "/flat").withColumn("rwa_exact", F.col("rwa_amount").cast("decimal(34,8)"))
    text = plan(compare.compare_pair(outputs, "r1", "r2"))
    assert "PushedFilters: [In(run_id, [r1,r2])]" in text and "Join" not in text


def test_no_cross_join_anywhere(spark, sf, monkeypatch):
    monkeypatch.setattr(catalogue, "stage", lambda df, name: df)
    for name, query in queries().items():
        if any(word in name for word in ("stream", "fraud", "scored")) or re.match(r"op\d+_|pipeline", name):
            continue  # these run jobs of their own
        text = plan(query(spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_top_k_does_not_sort_the_table(spark, sf):
    for name in ("table_browse", "recent_runs", "transaction_feed"):
        text = plan(queries()[name](spark, sf))
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text, name


def test_listing_cut_off_reaches_the_scan(spark, sf):
    text = plan(queries()["policy_objects"](spark, sf))
    assert re.search(r"FileScan parquet \[doc_id#\d+L,text.*DataFilters: \[.*>= Subquery", text)


def test_drift_and_traceability_shuffle_only_for_the_fold(spark, sf, monkeypatch):
    drafted = catalogue._drafted_sql(spark, sf)
    base = plan(drafted.select("sql_version_id", "agent_trace", "generated_sql")).count("Exchange hashpartitioning")
    assert plan(queries()["clause_traceability"](spark, sf)).count("Exchange hashpartitioning") == base
    assert plan(queries()["schema_drift"](spark, sf)).count("Exchange hashpartitioning") == base


def test_rule_texts_are_not_built_when_not_asked_for(spark, sf):
    assert "clause_citations" not in plan(catalogue._events(spark, sf))
    assert "clause_citations" in plan(catalogue._events(spark, sf, drafts=True))


def test_top_drivers_are_limited_before_the_shuffle(spark):
    cells = spark.createDataFrame([], "policy_id string, run_a string, run_b string, portfolio string, risk_bucket string, delta decimal(34,8)")
    text = plan(compare.top_drivers(cells.repartition(4)))
    assert text.index("WindowGroupLimit") != text.rindex("WindowGroupLimit") and "Partial" in text
