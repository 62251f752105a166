"""Exact deduplication: 128-bit content hash, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.llm.common import ascii_lower, keep_rows, small
from capledger.session import stage


def content(text: Column) -> Column:
    """What is compared: A-Z lower-cased; NULL counts as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Id, content and its 128-bit hash."""
    body = docs.select(F.col(key).alias("_id"), content(F.col(text)).alias("_body"))
    return body.withColumn("_hash", F.unhex(F.md5("_body")))


def collided(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hashes that different contents share; none, as a rule.

    Grouping compares the hash first and then the bytes. Copies are combined before the shuffle,
    so that a group of any size costs one row a task.
    """
    texts = _hashed(docs, key, text).groupBy("_hash", "_body").agg(F.count("*").alias("_n"))
    return texts.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")


def members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (id, content) and task that read it: ``_id, _hash, _other, _sha, _task, _times, keep_id,
    keep_task, group_size``.

    ``_other`` is the content itself where its hash is shared by another one, else NULL; ``_times`` counts
    rows of the task that repeat both id and content, so it is bounded by a task's input. The largest id of
    equal contents is kept, from the task ``keep_task``; NULL ids are smaller than all others, and ``keep_id`` is NULL
    only where a group has no other id.
    """
    shared = small(stage(collided(docs, key, text), "collided"))
    marked = _hashed(docs, key, text).join(shared.withColumn("_shared", F.lit(True)), "_hash", "left")
    rows = stage(
        marked.select(
            "_id", "_hash", F.when(F.col("_shared"), F.col("_body")).alias("_other"), F.unhex(F.sha2("_body", 256)).alias("_sha"),
            F.spark_partition_id().alias("_task"),
        )
        .groupBy("_id", "_hash", "_other", "_sha", "_task")
        .agg(F.count("*").alias("_times")),
        "contents",
    )
    # A struct with a NULL id is smaller than any other.
    kept = F.max(F.struct("_id", "_task"))
    groups = rows.groupBy("_hash", "_other").agg(kept["_id"].alias("keep_id"), kept["_task"].alias("keep_task"), F.sum("_times").alias("group_size"))
    groups = groups.withColumnsRenamed({"_hash": "_h", "_other": "_o"})
    return rows.join(groups, (F.col("_hash") == F.col("_h")) & F.col("_other").eqNullSafe(F.col("_o"))).drop("_h", "_o")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, keep_id, group_size, kept, text_sha256``.

    Exactly one row of each group of equal contents is kept: one with the largest id. Rows that
    repeat id and content are told apart by their number only, so the first of them is the kept one.
    NULL texts equal empty ones. An empty table gives an empty result. Other columns play no part.
    """
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_task") == F.col("keep_task"))
    return (
        members(docs, key, text)
        .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
        .select(
            F.col("_id").alias(key),
            "keep_id",
            "group_size",
            (kept & (F.col("_nth") == 1)).alias("kept"),
            F.lower(F.hex("_sha")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept row of each group with all its columns.

    Among rows that repeat id and content, the smallest by all columns stays.
    """
    kept = members(docs, key, text).where(F.col("_id").eqNullSafe(F.col("keep_id")))
    kept = kept.groupBy("_id", "_hash", "_other").agg(F.sum("_times").alias("_times"))
    body = content(F.col(text))
    return keep_rows(docs, kept.select("_id", "_hash", "_times", "_other"), F.col(key), F.unhex(F.md5(body)), body)
