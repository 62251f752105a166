import datetime as dt
import hashlib
import json
import os
from decimal import Decimal

import pytest
from row_lists import rows
from pyspark.sql import functions as F

from capledger import session
from capledger.operators import text as text_ops
from capledger.schemas import SOURCES, TABLES
from capledger.sources import adapters, files, sinks, tables
from capledger.workflow import Registry


def test_declared_schemas_are_those_of_the_files(spark, sf):
    for table, schema in SOURCES.items():
        found = spark.read.parquet(f"{sf}/{table}.parquet").schema
        assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in schema], table


def test_append_refresh_reset(spark, folder):
    path = f"{folder}/exposures"
    frame = tables.literal_rows(spark, "exposures", [("P", "A", Decimal("1.00"))])
    sinks.refresh(frame, path, "exposures")
    sinks.append(frame, path, "exposures")
    assert tables.scan_declared(spark, path, "exposures").count() == 2
    sinks.refresh(frame, path, "exposures")
    assert tables.scan_declared(spark, path, "exposures").count() == 1
    sinks.reset(spark, folder)
    for table in ("policy_documents", "rwa_report_outputs"):
        empty = tables.scan_declared(spark, f"{folder}/{table}", table)
        assert empty.isEmpty() and set(empty.columns) == set(TABLES[table].names)


def test_reconcile(spark):
    old = spark.createDataFrame([("P", 5, "gone")], "portfolio string, exposure_amount int, extra string")
    got = tables.reconcile(old, TABLES["exposures"])
    assert got.schema.simpleString() == TABLES["exposures"].simpleString()
    assert rows(got) == [("P", None, Decimal("5.00"))]


def test_rerun_replaces_only_its_run(spark, folder):
    path = f"{folder}/rwa_report_outputs"

    def outputs(run, amount):
        return spark.createDataFrame(
            [("P", "Low", amount, dt.date(2024, 1, 1), run, "p", "p-V1", "s")], TABLES["rwa_report_outputs"]
        )

    sinks.publish_outputs(outputs("r1", 1.0).unionByName(outputs("r2", 2.0)), path)
    before = set(os.listdir(f"{path}/rows"))
    sinks.publish_outputs(outputs("r1", 5.0), path)
    sinks.publish_outputs(outputs("r1", 5.0), path)
    assert before < set(os.listdir(f"{path}/rows"))  # nothing is rewritten
    got = sinks.read_outputs(spark, path)
    assert rows(got.select("run_id", "rwa_amount")) == [("r1", 5.0), ("r2", 2.0)]
    plan = got.where("run_id = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(run_id), EqualTo(run_id,r1)]" in plan
    dated = got.where("as_of_date = DATE'2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(as_of_date" in dated
    # A rerun without rows takes the old ones away; another date does not keep them; an unlisted attempt is not seen.
    sinks.publish_outputs(outputs("r1", 9.0).limit(0), path, spark.createDataFrame([("r1",)], "run_id string"))
    assert rows(sinks.read_outputs(spark, path).select("run_id")) == [("r2",)]
    sinks.publish_outputs(outputs("r2", 7.0).withColumn("as_of_date", F.lit(dt.date(2024, 2, 2))), path)
    outputs("r3", 1.0).write.partitionBy("as_of_date").parquet(f"{path}/rows/attempt=99999999999999999999-x")
    assert rows(sinks.read_outputs(spark, path).select("run_id", "rwa_amount", "as_of_date")) == [("r2", 7.0, dt.date(2024, 2, 2))]


def test_writers_of_one_date_lose_nothing(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    def publish(i):
        frame = spark.createDataFrame([("P", "Low", float(i), dt.date(2024, 1, 1), f"r{i}", "p", "p-V1", "s")], TABLES["rwa_report_outputs"])
        sinks.publish_outputs(frame, f"{folder}/o")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(publish, range(8)))
    assert rows(sinks.read_outputs(spark, f"{folder}/o").select("run_id")) == [(f"r{i}",) for i in range(8)]


def test_object_listing(spark, folder):
    os.makedirs(f"{folder}/policies/v1")
    big = 3 * files.BLOCK + 5
    bodies = {"policies/v1/a.pdf": b"abc", "policies/v1/b.TXT": b"x", "policies/empty.csv": b"", "top": b"\x00" * big, "other/noext.": b"1"}
    os.makedirs(f"{folder}/other/nothing")
    for name, body in bodies.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(body)
    listing = files.object_listing(spark, folder)
    got = {r.uri.removeprefix(f"file://{folder}/"): r for r in listing.collect()}
    assert {k: (r.size, r.md5_hash) for k, r in got.items()} == {k: (len(b), hashlib.md5(b).hexdigest()) for k, b in bodies.items()}
    types = {k: r.content_type for k, r in got.items()}
    assert types["policies/v1/a.pdf"] == "application/pdf" and types["policies/v1/b.TXT"] == "text/plain" and types["top"] == files.UNKNOWN_TYPE
    assert all(r.updated is not None for r in got.values())
    assert listing.rdd.getNumPartitions() == 3  # the folder itself and each one below it
    unhashed = files.object_listing(spark, f"{folder}/policies", with_hash=False).collect()
    assert len(unhashed) == 3 and not any(r.md5_hash for r in unhashed)
    assert files.object_listing(spark, f"{folder}/missing").count() == 0


def test_no_body_is_read_without_the_hash(spark, folder):
    with open(f"{folder}/x.txt", "wb") as f:
        f.write(b"secret")
    os.chmod(f"{folder}/x.txt", 0)
    reader = files.ObjectReader(folder, False)
    reader._md5 = None  # would fail when called
    assert [r[2] for p in reader.partitions() for r in reader.read(p)] == [6]


def test_schema_of_every_file(spark, folder):
    spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "a bigint, b string, c timestamp_ntz").write.parquet(f"{folder}/t")
    spark.createDataFrame([(1, "a", [1.0])], "a int, b string, d array<float>").write.mode("append").parquet(f"{folder}/t")
    spark.createDataFrame([], "e date, f decimal(18,2), g struct<x:int>").write.parquet(f"{folder}/u")
    columns = files.file_columns(spark, {"t": f"{folder}/t", "u": f"{folder}/u"})
    assert columns.select("file").distinct().count() == len(os.popen(f"ls {folder}/[tu]/*.parquet").read().split())
    live = files.live_columns(columns)
    assert rows(live.select("table_name", "column_name", "data_type", "in_all_files").where("table_name = 'u'")) == [
        ("u", "e", "date", True), ("u", "f", "decimal(18,2)", True), ("u", "g", "struct<x:int>", True),
    ]
    every = {(r.column_name, r.data_type) for r in live.where("table_name = 't'").collect()}
    assert every == {("a", "bigint"), ("a", "int"), ("b", "string"), ("c", "timestamp_ntz"), ("d", "array<float>")}
    snapshot = {"tables": {"t": [{"column_name": n, "data_type": k} for n, k in (("a", "bigint"), ("b", "string"), ("c", "timestamp_ntz"), ("z", "int"))]}}
    sqls = spark.createDataFrame([("S", json.dumps(snapshot))], "sql_version_id string, schema_snapshot string")
    drift = rows(text_ops.schema_drift(sqls, live.where("table_name = 't'")).select("column_path", "kind", "verdict"))
    assert drift == sorted([
        ("t.d", "added", "removed_columns"), ("t.z", "removed", "removed_columns"), ("t.a", "retyped", "removed_columns"),
        ("t.c", "missing", "removed_columns"),
    ], key=repr)
    merged = spark.createDataFrame([], files.FILE_COLUMNS)
    assert files.live_columns(merged).count() == 0


def test_catalog_columns(spark):
    spark.sql("SELECT 1 AS a, 'x' AS b").createOrReplaceTempView("probe_view")
    got = tables.catalog_columns(spark).where("table_name = 'probe_view'")
    assert rows(got) == [("probe_view", 0, "a", "int"), ("probe_view", 1, "b", "string")]


def test_browse(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "id int, v string")
    assert [r.id for r in tables.browse(df).collect()] == [3, 1, None]
    assert [r.id for r in tables.browse(df, 1).collect()] == [3]


def test_stage_reads_back_the_same_rows(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    staged = session.stage(df, "probe")
    assert rows(staged) == rows(df)
    assert "FileScan parquet" in staged._jdf.queryExecution().executedPlan().toString()
    assert session.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.fixture(scope="module")
def registry(spark):
    import tempfile

    return Registry(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def day(n):
    return dt.datetime(2024, 5, n)


FLAT = (
    "SELECT portfolio, 'Low' AS risk_bucket, SUM(exposure_amount * CASE asset_class WHEN 'A' THEN 0.2 ELSE 0.5 END) AS rwa_amount"
    " FROM IDENTIFIER(:exposures) GROUP BY portfolio"
)


def test_workflow_end_to_end(spark, registry, folder):
    registry.initialise()
    assert registry.runs().isEmpty() and registry.outputs().isEmpty()
    exposures = tables.literal_rows(
        spark, "exposures", [("Book", "A", Decimal("100.00")), ("Book", "B", Decimal("10.00"))]
    )
    file_row = "policy_id string, filename string, actor string, supersedes string"
    first = registry.upload(spark.createDataFrame([(None, "one.pdf", "ann", None)], file_row), day(1)).first()
    assert first.gcs_uri == f"policies/{first.policy_version_id}/one.pdf"

    def text(version, body):
        return spark.createDataFrame(
            [(version, None, body and f" {body} ", '{"clause_citations": []}', None)],
            "policy_version_id string, summary string, generated_sql string, agent_trace string, schema_snapshot string",
        )

    def rules(version, *values):
        return adapters.rule_rows(spark, list(values)).withColumn("policy_version", F.lit(version))

    v1 = rules(first.policy_version_id, "('mapping', 'A', 'Low', 0.2, NULL, NULL)", "('mapping', 'B', 'Low', 0.5, NULL, NULL)")
    with pytest.raises(ValueError):
        registry.draft(v1, text("missing", "x"), day(2))
    s1 = registry.draft(v1, text(first.policy_version_id, FLAT), day(2)).first()
    assert s1.summary == f"Policy {first.policy_version_id} parsed."

    def execute(version, at):
        request = spark.createDataFrame(
            [(first.policy_id, version.policy_version_id, version.sql_version_id)],
            "policy_id string, policy_version_id string, sql_version_id string",
        )
        return registry.execute(request, exposures, at).first().run_id

    early = execute(s1, day(3))
    registry.approve(spark.createDataFrame([(s1.sql_version_id, "bob")], "sql_version_id string, actor string"), day(4))
    good = execute(s1, day(5))
    status = {r.run_id: r.run_status for r in registry.runs().collect()}
    assert status == {early: "failed", good: "succeeded"}
    assert rows(registry.outputs().select("run_id", "risk_bucket", "rwa_amount")) == [(good, "Low", 25.0)]
    assert execute(s1, day(5)) == good  # a retry is the same run and changes nothing
    assert registry.outputs().count() == 1 and registry.runs().count() == 2

    second = registry.upload(
        spark.createDataFrame([(first.policy_id, "two.pdf", "ann", first.policy_version_id)], file_row), day(6)
    ).first()
    v2 = rules(second.policy_version_id, "('mapping', 'B', 'High', 1.0, NULL, NULL)")
    s2 = registry.draft(v2, text(second.policy_version_id, None), day(7)).first()
    registry.approve(spark.createDataFrame([(s2.sql_version_id, "bob")], "sql_version_id string, actor string"), day(8))
    merged = execute(s2, day(9))
    assert rows(registry.outputs().where(F.col("run_id") == merged).select("risk_bucket", "rwa_amount")) == [("High", 10.0), ("Low", 20.0)]

    registry.regenerate(text(None, "SELECT 3").withColumn("sql_version_id", F.lit(s2.sql_version_id)), day(10))
    state = {r.sql_version_id: (r.validation_status, r.generated_sql) for r in registry.sql_versions().collect()}
    assert state[s2.sql_version_id][0] == "pending" and state[s1.sql_version_id] == ("approved", FLAT)
    docs = {r.policy_version_id: r.status for r in registry.documents().collect()}
    assert docs == {first.policy_version_id: "superseded", second.policy_version_id: "approved"}

    from capledger.operators import audit, compare

    chain = audit.lineage_chain(registry.runs(), registry.documents(), registry.extractions(), registry.sql_versions())
    cells = compare.compare_pair(registry.outputs().withColumn("rwa_exact", F.col("rwa_amount").cast("decimal(34,8)")), good, merged)
    compared = compare.rwa_comparison(cells).withColumn("run_id", F.lit(merged))
    sinks.export_audit(chain, registry.sql_versions(), compared, folder)
    summary = spark.read.json(f"{folder}/run_summary").where(F.col("run_id") == good).first().value
    assert json.loads(summary)["approved_by"] == "bob" and len(json.loads(summary)) == 11
    table = spark.read.option("header", True).csv(f"{folder}/rwa_comparison")
    assert {r.run_id for r in table.collect()} == {merged}
    assert rows(table.drop("run_id", "part")) == [("Book", "High", "0.0", "10.0", "10.0"), ("Book", "Low", "25.0", "20.0", "-5.0")]
    graph = spark.read.json(f"{folder}/lineage_graph").where(F.col("run_id") == good)
    assert graph.where("value like '%RUN --> OUT%'").count() == 1
    sinks.export_run(chain, registry.sql_versions(), good, f"{folder}/one")
    assert spark.read.text(f"{folder}/one/lineage_graph").where("value like '%RUN --> OUT%'").count() == 1
    sql_text = spark.read.json(f"{folder}/generated_sql").where(F.col("run_id") == good)
    assert [r.value for r in sql_text.collect()] == [FLAT]
    lineage = spark.read.json(f"{folder}/lineage_metadata")
    assert lineage.count() == 3


def test_runs_use_the_approved_draft(spark, folder):
    registry = Registry(spark, folder)
    registry.initialise()
    exposures = tables.literal_rows(spark, "exposures", [("Book", "A", Decimal("20.00"))])
    version = registry.upload(
        spark.createDataFrame([(None, "x.pdf", "ann", None)], "policy_id string, filename string, actor string, supersedes string"), day(1)
    ).first()
    texts = spark.createDataFrame(
        [(version.policy_version_id, "s", None, "{}", None)],
        "policy_version_id string, summary string, generated_sql string, agent_trace string, schema_snapshot string",
    )
    def rule(weight):
        return adapters.rule_rows(spark, [f"('mapping', 'A', 'Low', {weight}, NULL, NULL)"])

    sql = registry.draft(rule(0.5).withColumn("policy_version", F.lit(version.policy_version_id)), texts, day(2)).first()
    approval = spark.createDataFrame([(sql.sql_version_id, "bob")], "sql_version_id string, actor string")
    request = spark.createDataFrame([(version.policy_id, version.policy_version_id, sql.sql_version_id)], "policy_id string, policy_version_id string, sql_version_id string")

    def amounts(at):
        run = registry.execute(request, exposures, at).first().run_id
        return [r.rwa_amount for r in registry.outputs().where(F.col("run_id") == run).collect()]

    registry.approve(approval, day(3))
    assert amounts(day(4)) == [10.0]
    again = texts.drop("policy_version_id").withColumn("sql_version_id", F.lit(sql.sql_version_id))
    registry.regenerate(again, day(5), rule(2.5).withColumn("sql_version_id", F.lit(sql.sql_version_id)))
    assert amounts(day(6)) == []  # not approved
    registry.approve(approval, day(7))
    registry.approve(approval, day(7))  # a retry
    assert amounts(day(8)) == [50.0]
    assert amounts(day(4)) == [10.0]  # the old run again: the draft of its time
    assert registry.outputs().count() == 2 and registry.extractions().count() == 1
    with pytest.raises(ValueError):
        registry.approve(spark.createDataFrame([("SQL-none", "bob")], "sql_version_id string, actor string"), day(9))


def test_a_new_column_in_the_files_is_drift(spark, sf, folder):
    import shutil

    from capledger.plans import catalogue

    for table in ("events", "documents"):
        shutil.copy(f"{sf}/{table}.parquet", f"{folder}/{table}.parquet")
    before = catalogue.QUERIES["schema_drift"](spark, folder).where("column_path = 'documents.extra'").count()
    wide = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    wide.write.parquet(f"{folder}/wide")
    shutil.copytree(f"{folder}/wide", f"{folder}/drifted/documents.parquet")
    shutil.copy(f"{sf}/events.parquet", f"{folder}/drifted/events.parquet")
    after = catalogue.QUERIES["schema_drift"](spark, f"{folder}/drifted").where("column_path = 'documents.extra'")
    assert before == 0 and after.count() > 0


def test_failed_execution_is_recorded(spark, folder):
    registry = Registry(spark, folder)
    registry.initialise()
    version = registry.upload(
        spark.createDataFrame([(None, "x.pdf", "ann", None)], "policy_id string, filename string, actor string, supersedes string"), day(1)
    ).first()
    texts = spark.createDataFrame(
        [(version.policy_version_id, "s", None, "{}", None)],
        "policy_version_id string, summary string, generated_sql string, agent_trace string, schema_snapshot string",
    )
    rule = adapters.rule_rows(spark, ["('mapping', 'A', 'Low', 0.2, NULL, NULL)"]).withColumn("policy_version", F.lit(version.policy_version_id))
    sql = registry.draft(rule, texts, day(2)).first()
    registry.approve(spark.createDataFrame([(sql.sql_version_id, "bob")], "sql_version_id string, actor string"), day(3))
    request = spark.createDataFrame([(version.policy_id, version.policy_version_id, sql.sql_version_id)], "policy_id string, policy_version_id string, sql_version_id string")
    broken = spark.createDataFrame([("P", "A", 1.0)], "portfolio string, asset_class string, exposure_amount double").withColumn(
        "exposure_amount", F.raise_error(F.lit("unreadable exposure")).cast("decimal(18,2)")
    )
    with pytest.raises(Exception, match="unreadable exposure"):
        registry.execute(request, broken, day(4))
    assert [r.run_status for r in registry.runs().collect()] == ["failed"]


def test_derived_table(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("rwa_report_probe")
    sinks.derive_table(spark.table("rwa_report_probe"), "rwa_outputs_probe")
    try:
        assert rows(spark.table("rwa_outputs_probe")) == [(1,)]
    finally:
        spark.sql("DROP TABLE rwa_outputs_probe")
