"""Appends, refreshes and exports."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capledger.schemas import TABLES, TRANSACTIONAL_TABLES
from capledger.sources.tables import reconcile

PARTITIONED = {"rwa_report_outputs": "as_of_date"}
# Files of one date in the report outputs, and folders of one kind in an audit export, at most.
SPREAD = 32


def append(df: DataFrame, path: str, table: str) -> None:
    reconcile(df, TABLES[table]).write.mode("append").parquet(path)


def refresh(df: DataFrame, path: str, table: str) -> None:
    """Full refresh of one table."""
    writer = reconcile(df, TABLES[table]).write.mode("overwrite").option("partitionOverwriteMode", "static")
    if table in PARTITIONED:
        writer = writer.partitionBy(PARTITIONED[table])
    writer.parquet(path)


def reset(spark: SparkSession, root: str) -> None:
    """Empty the transactional tables, keeping their schemas."""
    for table in TRANSACTIONAL_TABLES:
        refresh(spark.createDataFrame([], TABLES[table]), f"{root}/{table}", table)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path, sorted; none where the path is missing."""
    if not _exists(spark, path):
        return []
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(found) if f.isDirectory())


def publish_outputs(outputs: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Append report outputs as one more attempt of their runs (``run_id`` rows; those of ``outputs`` if not given).

    Nothing is read or rewritten, so a rerun costs what the run costs, and writers at the same time do not disturb one
    another, on one date neither. An attempt counts from when its runs are listed, which is written last; a write that
    broke off leaves nothing to see. ``read_outputs`` takes the last attempt of each run.
    """
    attempt = f"attempt={time.time_ns():020d}-{uuid.uuid4().hex}"
    new = reconcile(outputs, TABLES["rwa_report_outputs"])
    day = PARTITIONED["rwa_report_outputs"]
    spread = new.repartition(day, F.pmod(F.xxhash64("run_id"), F.lit(SPREAD)))
    spread.write.partitionBy(day).parquet(f"{path}/rows/{attempt}")
    if runs is None:
        runs = outputs.sparkSession.read.schema("run_id string").parquet(f"{path}/rows/{attempt}")
    runs.select("run_id").distinct().write.parquet(f"{path}/attempts/{attempt}")


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Report outputs: the rows of each run's last attempt. Filters on date and run reach the scan of the rows."""
    schema = TABLES["rwa_report_outputs"]
    if not folders(spark, f"{path}/attempts"):
        return spark.createDataFrame([], schema)
    attempts = spark.read.schema("run_id string, attempt string").parquet(f"{path}/attempts")
    last = attempts.groupBy("run_id").agg(F.max("attempt").alias("attempt"))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])).parquet(f"{path}/rows")
    return rows.join(last, ["run_id", "attempt"], "left_semi").select(*schema.names)


def derive_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """A catalog table from a frame; at ``path``, or in the warehouse if not given."""
    writer = df.write.mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


# Fields of the run summary.
SUMMARY_FIELDS = (
    "run_id", "policy_id", "policy_version_id", "sql_version_id", "run_status", "run_started", "run_ended",
    "approved_by", "approved_at", "uploaded_by", "gcs_uri",
)

# Lines of the lineage graph source and the columns that fill them.
GRAPH_LINES = (
    ("graph LR", ()),
    ("    PDF[Policy PDF %s] --> VER[Version %s]", ("policy_id", "policy_version_id")),
    ("    VER --> EXT[Extraction model: %s]", ("model_version",)),
    ("    EXT --> SQL[SQL %s]", ("sql_version_id",)),
    ("    SQL --> APPROVE[Approved by %s]", ("approved_by",)),
    ("    APPROVE --> RUN[Run %s]", ("run_id",)),
    ("    RUN --> OUT[RWA Outputs]", ()),
)


def _text(column: str) -> Column:
    """Every value as text; a missing one reads None."""
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def run_summary(chain: DataFrame) -> DataFrame:
    """The summary fields of each run as one JSON document, all text."""
    return chain.select("run_id", F.to_json(F.struct(*[_text(f).alias(f) for f in SUMMARY_FIELDS])).alias("summary"))


def lineage_graph(chain: DataFrame) -> DataFrame:
    """Graph source text per run."""
    filled = [
        F.format_string(line, *[F.coalesce(c, F.lit("N/A")) for c in columns]) if columns else F.lit(line)
        for line, columns in GRAPH_LINES
    ]
    return chain.select("run_id", F.concat_ws("\n", *filled).alias("value"))


def run_texts(chain: DataFrame, sql_versions: DataFrame) -> DataFrame:
    """The rule text that each run names."""
    stored = sql_versions.select("sql_version_id", F.col("generated_sql").alias("value"))
    return chain.select("run_id", "sql_version_id").join(stored, "sql_version_id").where("value IS NOT NULL").select("run_id", "value")


def export_audit(chain: DataFrame, sql_versions: DataFrame, comparison: DataFrame, root: str) -> None:
    """Audit package for every run in ``chain``: one folder per content kind, in at most ``SPREAD``
    hashed parts, the run a column everywhere. ``comparison`` has a ``run_id`` and goes out as
    CSV, with header, all text; the rest as JSON lines."""

    def spread(df: DataFrame):
        part = F.pmod(F.xxhash64("run_id"), F.lit(SPREAD))
        return df.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part")

    spread(chain).json(f"{root}/lineage_metadata")
    spread(run_summary(chain).withColumnRenamed("summary", "value")).json(f"{root}/run_summary")
    spread(lineage_graph(chain)).json(f"{root}/lineage_graph")
    spread(run_texts(chain, sql_versions)).json(f"{root}/generated_sql")
    text = comparison.select(*[_text(c).alias(c) for c in comparison.columns])
    spread(text).option("header", True).csv(f"{root}/rwa_comparison")


def export_run(chain: DataFrame, sql_versions: DataFrame, run_id: str, root: str) -> None:
    """The texts of one run as text files."""
    one = chain.where(F.col("run_id") == run_id)
    for name, df in (
        ("run_summary", run_summary(one).withColumnRenamed("summary", "value")),
        ("lineage_graph", lineage_graph(one)),
        ("generated_sql", run_texts(one, sql_versions)),
    ):
        df.select("value").coalesce(1).write.mode("overwrite").text(f"{root}/{name}")
