"""Line deduplication over a range-partitioned line index, returning keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.llm.common import ascii_lower, small
from capledger.session import stage

# Stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"
MIN_DOCUMENTS = 10


def split_lines(text: Column) -> Column:
    """Lines between line feeds; NULL or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line with a key: ``_hash, _doc, _body, _pos, _first``, written in range partitions.

    Keys are stripped, lower-cased (A-Z) lines; empty keys are left out. Rows are range-partitioned by
    key hash (128 bits) and document with a secondary sort by position, so that the lines of a very
    common key are spread by document; ``_first`` marks the first occurrence inside a document.
    ``_body`` tells rows that repeat an id apart.
    """
    bare = F.trim("_line", F.lit(BLANKS))
    lines = (
        docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
        .select("_doc", F.xxhash64("_text").alias("_body"), F.posexplode(split_lines(F.col("_text"))).alias("_pos", "_line"))
        .where(bare != "")
        .select(F.unhex(F.md5(ascii_lower(bare))).alias("_hash"), "_doc", "_body", "_pos")
    )
    stream = Window.partitionBy("_hash", "_doc").orderBy("_body", "_pos")
    ordered = lines.repartitionByRange("_hash", "_doc").sortWithinPartitions("_hash", "_doc", "_body", "_pos")
    return stage(ordered.withColumn("_first", F.row_number().over(stream) == 1), "lines")


def common_lines(index: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Hashes of the keys found in at least ``min_documents`` documents."""
    documents = index.where("_first").groupBy("_hash").agg(F.count("*").alias("_n"))
    return documents.where(F.col("_n") >= min_documents).select("_hash")


def repeated_lines(index: DataFrame) -> DataFrame:
    """Positions of all but the first occurrence of each key: ``_doc, _body, _pos``.

    The first occurrence is the smallest by (document, row, position); NULL ids come first.
    """
    at = F.struct("_doc", "_body", "_pos")
    first = index.where("_first").groupBy(F.col("_hash").alias("_h")).agg(F.min(at).alias("_at"))
    return index.join(first, F.col("_hash") == F.col("_h")).where(~at.eqNullSafe(F.col("_at"))).select("_doc", "_body", "_pos")


def _runs(positions: Column, n_lines: Column) -> Column:
    """Run-length coded bitmap of the lines that stay: (first line, number of lines), from sorted dropped positions."""
    closed = F.concat(F.array(F.lit(-1)), positions, F.array(n_lines))
    gaps = F.zip_with(
        F.slice(closed, F.lit(1), F.size(closed) - 1),
        F.slice(closed, F.lit(2), F.size(closed) - 1),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return F.filter(gaps, lambda g: g["length"] > 0)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """Dropped positions (``_doc, _body, _pos``) as one sorted array per document row."""
    return dropped.groupBy("_doc", "_body").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int | None = MIN_DOCUMENTS
) -> DataFrame:
    """Per input row: ``key, n_lines, n_dropped, keep_runs, kept_text``.

    Lines whose key is found in at least ``min_documents`` documents go, all of them; with None, all but
    the first occurrence of each key go instead. ``keep_runs`` is the keep bitmap, run-length coded.
    Rows with the same id count as one document, NULL ids together as one; rows that repeat id and
    text get the same result each. Lines of blanks only always stay. A NULL text is one empty line.
    An empty table gives an empty result; other columns play no part.
    """
    index = line_index(docs, key, text)
    if min_documents is None:
        dropped = repeated_lines(index)
    else:
        common = stage(common_lines(index, min_documents), "common-lines")
        dropped = index.join(small(common), "_hash", "left_semi").select("_doc", "_body", "_pos")
    gone = stage(keep_bitmaps(dropped).withColumnsRenamed({"_doc": "_d", "_body": "_b"}), "dropped-lines")
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    rows = rows.select("_doc", F.xxhash64("_text").alias("_body"), F.coalesce("_text", F.lit("")).alias("_text"))
    joined = rows.join(small(gone), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_body") == F.col("_b")), "left")
    lines = split_lines(F.col("_text"))
    kept = F.array_join(
        F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n"
    )
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("_positions", F.coalesce("_gone", F.array().cast("array<int>")))
        .withColumn("keep_runs", _runs(F.col("_positions"), F.col("n_lines").cast("int")))
        .select(
            F.col("_doc").alias(key),
            "n_lines",
            F.size("_positions").cast("long").alias("n_dropped"),
            "keep_runs",
            F.when(F.size("_positions") == 0, F.col("_text")).otherwise(kept).alias("kept_text"),
        )
    )
