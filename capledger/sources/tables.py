"""Scans, literal rows, file listings and schema metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capledger.schemas import COLUMN_ROWS, SOURCES, TABLES


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SOURCES[table]).parquet(f"{sf_dir}/{table}.parquet")


def scan_declared(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path)


def stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1000) -> DataFrame:
    """The same table as a file stream, a bounded number of files per micro-batch.

    The bracket makes the path a glob, so a single file and a directory of part
    files are both accepted.
    """
    return (
        spark.readStream.schema(SOURCES[table])
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{sf_dir}/{table}.parque[t]")
    )


def literal_rows(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, TABLES[table])


def browse(df: DataFrame, limit: int = 100) -> DataFrame:
    """Raw table view: all columns, first column descending, first ``limit`` rows."""
    return df.orderBy(F.col(df.columns[0]).desc()).limit(limit)


def frame_columns(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Column rows (metadata only) of the given frames."""
    rows = [
        (name, i, field.name, field.dataType.simpleString())
        for name, df in frames.items()
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMN_ROWS)


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Column rows (metadata only) of every table in a catalog database."""
    rows = []
    for table in spark.catalog.listTables(database):
        name = table.name if table.isTemporary or not database else f"{database}.{table.name}"
        for i, column in enumerate(spark.catalog.listColumns(name)):
            rows.append((table.name, i, column.name, column.dataType))
    return spark.createDataFrame(rows, COLUMN_ROWS)


def schema_snapshot(columns: DataFrame, project: str, dataset: str) -> DataFrame:
    """One row holding the nested snapshot JSON: columns by ordinal inside each table."""
    per_table = columns.groupBy("table_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type"))),
            lambda c: F.struct(c["column_name"].alias("column_name"), c["data_type"].alias("data_type")),
        ).alias("columns")
    )
    tables = F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "columns"))))
    return per_table.agg(tables.alias("tables")).select(
        F.to_json(F.struct(F.lit(project).alias("project"), F.lit(dataset).alias("dataset"), "tables")).alias(
            "schema_snapshot"
        ),
        F.size(F.map_keys("tables")).alias("table_count"),
    )


def reconcile(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Read-side schema evolution: missing columns become NULL, extra ones go, types are cast."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
