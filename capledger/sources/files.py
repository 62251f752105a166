"""Files as data: an object listing of one partition per prefix, and the schema of every file of a table."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Suffix to content type.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "json": "application/json",
    "csv": "text/csv",
    "txt": "text/plain",
    "sql": "application/sql",
}
UNKNOWN_TYPE = "application/octet-stream"
# Bytes of a body that are hashed at once.
BLOCK = 1 << 22
LISTING = "uri string, content_type string, size bigint, updated timestamp, md5_hash string"
FILE_COLUMNS = "table_name string, file string, ordinal int, column_name string, data_type string"

# Its functions travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Object listing


class Prefix(InputPartition):
    """A folder to list with all below it, or without."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.deep = deep


class ObjectReader(DataSourceReader):
    def __init__(self, path: str, hashed: bool):
        self.path, self.hashed = path, hashed

    def partitions(self) -> list[Prefix]:
        """The folders right below the path, and the files that lie in it."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        below = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Prefix(root, False), *(Prefix(f.path, True) for f in below if f.type == fs.FileType.Directory)]

    def _md5(self, files, path: str) -> str:
        digest = hashlib.md5()
        with files.open_input_stream(path) as body:
            while block := body.read(BLOCK):
                digest.update(block)
        return digest.hexdigest()

    def read(self, partition: Prefix) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        for found in files.get_file_info(fs.FileSelector(partition.value, recursive=partition.deep, allow_not_found=True)):
            if found.type == fs.FileType.File:
                kind = CONTENT_TYPES.get(found.extension.lower(), UNKNOWN_TYPE)
                yield scheme + found.path, kind, found.size, found.mtime, self._md5(files, found.path) if self.hashed else None


class ObjectSource(DataSource):
    """``spark.read.format("objects").option("hash", "true").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options["path"], self.options.get("hash", "true") == "true")


def object_listing(spark: SparkSession, path: str, with_hash: bool = True) -> DataFrame:
    """File metadata below ``path``, empty files included; without the hash no file body is opened.

    Each folder right below the path is listed by a task of its own; bodies are hashed block by block, so a file may
    have any size. A path that does not exist has no files.
    """
    spark.dataSource.register(ObjectSource)
    return spark.read.format("objects").option("hash", str(with_hash).lower()).load(path)


# Schemas of files


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(table, file) rows to one row per column of each file, read from its footer."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_type

    for batch in batches:
        for table, file in zip(*(batch.column(c).to_pylist() for c in ("table_name", "file"))):
            files, path = fs.FileSystem.from_uri(file)
            schema = pq.read_schema(path, filesystem=files)
            names, kinds = schema.names, [from_arrow_type(t, prefer_timestamp_ntz=True).simpleString() for t in schema.types]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([table] * len(names), pa.string()), pa.array([file] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()),
                    pa.array(names, pa.string()), pa.array(kinds, pa.string()),
                ],
                names=["table_name", "file", "ordinal", "column_name", "data_type"],
            )


def _opens(uri: str) -> bool:
    """Whether Python can open files of this store."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(uri)
    except Exception:  # noqa: BLE001 - an unknown scheme, or a store whose library is missing
        return False
    return True


def file_columns(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """One row per (table, file, column) with the type each file has it in, for Parquet tables at the given paths.

    Footers are read in tasks. In a store that only Spark reads, a table counts as one file with the schema that Spark
    merges from all footers.
    """
    listed, merged = [], []
    for name, path in tables.items():
        # A declared schema: listing alone, no footer is read here.
        found = spark.read.schema("_ int").parquet(path).inputFiles()
        if found and not _opens(found[0]):
            fields = spark.read.option("mergeSchema", "true").parquet(path).schema.fields
            merged += [(name, path, i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)]
        else:
            listed += [(name, f) for f in found]
    files = spark.createDataFrame(listed, "table_name string, file string")
    parts = max(1, min(len(listed), spark.sparkContext.defaultParallelism * 4))
    rows = files.repartition(parts, "file").mapInArrow(_footers, FILE_COLUMNS)
    return rows.unionByName(spark.createDataFrame(merged, FILE_COLUMNS)) if merged else rows


def live_columns(columns: DataFrame) -> DataFrame:
    """The live schema: ``table_name, ordinal, column_name, data_type, in_all_files``, a row per type that any file has a column in."""
    totals = columns.groupBy("table_name").agg(F.countDistinct("file").alias("_files"))
    held = columns.groupBy("table_name", "column_name").agg(
        F.min("ordinal").alias("ordinal"), F.collect_set("data_type").alias("_types"), F.countDistinct("file").alias("_held")
    )
    return held.join(totals, "table_name").select(
        "table_name", "ordinal", "column_name", F.explode("_types").alias("data_type"), (F.col("_held") == F.col("_files")).alias("in_all_files")
    )
