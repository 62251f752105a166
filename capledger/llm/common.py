"""Expressions and helpers that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capledger.session import scratch_path, stage

# A frame at most this large (as written to Parquet) may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Array of the maximal runs of digits, letters a-z and non-ASCII characters, after lower-casing A-Z.
    A NULL text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    return F.array_remove(parts, "")


def stage_compact(df: DataFrame, name: str) -> DataFrame:
    """Like ``stage``, with zstandard pages: for wide binary or text columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Size of the files below a staged frame."""
    jvm, total = spark._jvm, 0
    conf = spark._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged frame with a broadcast hint if its files are at most ``limit`` bytes; else without,
    so that the join is shuffled."""
    return F.broadcast(df) if staged_bytes(df.sparkSession, df) <= limit else df


def running_start(df: DataFrame, group: list[str], order: list[str], weight: str | None, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (rows, if None) over the rows of the same group that come before.

    Rows are range-partitioned and sorted by group and order, and written with their partition
    number. Sums run inside (partition, group) only, and each group's partition totals are carried
    over the partition numbers, so a group of any size is spread over many tasks. Equal rows follow
    one another in any order.
    """
    part, pos = "_rs_part", "_rs_pos"
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    placed = stage(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumns({part: F.spark_partition_id(), pos: F.monotonically_increasing_id()}),
        "ordered",
    )
    inside = Window.partitionBy(part, *group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = (
        placed.groupBy(part, *group)
        .agg(F.sum(amount).alias("_rs_sum"))
        .select(
            F.col(part).alias("_rs_p"),
            *[F.col(c).alias(f"_rs_g{i}") for i, c in enumerate(group)],
            F.coalesce(F.sum("_rs_sum").over(along), zero).alias("_rs_base"),
        )
    )
    same = F.col(part) == F.col("_rs_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_rs_g{i}"))
    return (
        placed.withColumn("_rs_local", F.coalesce(F.sum(amount).over(inside), zero))
        .join(carried, same)
        .select(*df.columns, (F.col("_rs_local") + F.col("_rs_base")).alias(name))
    )


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column, digest: Column, also: Column | None = None) -> DataFrame:
    """Rows of ``docs`` that ``kept`` (id, digest, number of equal rows[, content]) names, all columns, one row each.

    Of equal rows, the smallest by all columns stays; rows that others equal are the only ones grouped.
    """
    names = ["__kept_id", "__kept_digest", "__kept_times", "__kept_content"][: len(kept.columns)]
    kept = stage(kept.toDF(*names), "kept")
    same = key.eqNullSafe(F.col(names[0])) & (digest == F.col(names[1]))
    if also is not None:
        same = same & (F.col(names[3]).isNull() | (F.col(names[3]) == also))
    once = docs.join(small(kept.where(F.col(names[2]) == 1)), same, "left_semi")
    repeated = (
        docs.join(small(kept.where(F.col(names[2]) > 1)), same)
        .groupBy(*[n for n in names if n != names[2]])
        .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__kept_row"))
    )
    return once.unionByName(repeated.select("__kept_row.*"))


def decoded_bytes(df: DataFrame) -> int:
    """What the rows of a staged frame of plain columns take in memory: eight bytes a column and the bytes of strings."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    row = sum(wide, F.lit(16 + 8 * len(df.columns)))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged frame with a broadcast hint if its decoded rows take at most ``limit`` bytes; else without."""
    return F.broadcast(df) if staged_bytes(df.sparkSession, df) <= limit and decoded_bytes(df) <= limit else df
