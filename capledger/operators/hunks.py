"""Ordered line diffs of consecutive versions: aligned lines, and hunks with context around what changed."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.functions.scalars import lines
from capledger.operators.text import version_pairs
from capledger.session import stage

CONTEXT = 3

# Its functions travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def longest_chain(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence: piles in order, each new one on the first pile whose top is not
    smaller; the chain runs back from the last pile's top to what was the top of the pile before."""
    tops, at, before = [], [], []
    for i, place in enumerate(places):
        pile = bisect_left(tops, place)
        before.append(at[pile - 1] if pile else None)
        if pile == len(tops):
            tops.append(place)
            at.append(i)
        else:
            tops[pile], at[pile] = place, i
    chain, i = [], at[-1] if at else None
    while i is not None:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each pair (places in both versions, ordered by the first) that the longest chain keeps."""
    for batch in batches:
        kept = [[row[i] for i in longest_chain([p["b"] for p in row])] for row in batch.column("anchors").to_pylist()]
        kind = batch.schema.field("anchors").type
        yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(kept, kind)], names=["pair", "anchors"])


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _sided_lines(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, side, version_no, pos, digest, nth``: each version's lines on the right of the pair it completes and on the left
    of the pair it opens. ``nth`` numbers equal lines of a version, so (digest, nth) stands once on a side. Lines are
    their 128-bit digests here."""
    ends = [F.struct(F.col(f"version_{s}").alias("version_no"), F.lit(s).alias("side")) for s in ("a", "b")]
    membership = (
        pairs.select(F.col("version_b").alias("pair"), F.inline(F.array(*ends)))
        .groupBy("version_no").agg(F.collect_list(F.struct("pair", "side")).alias("pairs"))
    )
    digests = texts.select("version_no", F.transform(lines(F.col("text")), _digest).alias("digests")).join(membership, "version_no")
    placed = digests.select("version_no", "pairs", F.posexplode("digests").alias("pos", "digest"))
    nth = F.row_number().over(Window.partitionBy("version_no", "digest").orderBy("pos"))
    return placed.withColumn("nth", nth).select(F.inline("pairs"), "version_no", "pos", "digest", "nth")


def aligned_lines(sided: DataFrame) -> DataFrame:
    """``pair, side, version_no, pos, digest, k, partner``: ``k`` matches stand before or at a line; ``partner`` is the place of a matched line in
    the other version.

    Anchors are the lines that stand once on both sides, the n-th equal one of a version counting as one of its own.
    The longest chain of them that keeps the order of both versions is the alignment. Rows come by pair, so what follows
    inside a pair needs no further shuffle.
    """
    place = lambda s: F.max(F.when(F.col("side") == s, F.col("pos")))
    anchors = sided.repartition("pair").groupBy("pair", "digest", "nth").agg(place("a").alias("a"), place("b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    listed = anchors.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("anchors"))
    chains = listed.mapInArrow(_chains, listed.schema).select("pair", F.posexplode("anchors").alias("at", "anchor"))
    ends = [F.struct(F.lit(s).alias("side"), F.col(f"anchor.{s}").alias("pos"), F.col(f"anchor.{t}").alias("partner")) for s, t in ("ab", "ba")]
    matched = chains.select("pair", (F.col("at") + 1).alias("match"), F.inline(F.array(*ends)))
    before = Window.partitionBy("pair", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = sided.drop("nth").join(matched, ["pair", "side", "pos"], "left").repartition("pair")
    return rows.withColumn("k", F.coalesce(F.max("match").over(before), F.lit(0))).drop("match")


def diff_hunks(texts: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``policy_id, version_a, version_b, hunk, row, kind, line_a, line_b, line`` of all consecutive versions.

    Lines as ``line_diff`` takes them. Between two matches removed lines stand before added ones. Kept are the
    changed lines and ``context`` matched ones around them; rows that follow one another are a hunk, both numbered
    from 1 within a pair. Line numbers count from 1; a removed line has no ``line_b``, an added one no ``line_a``.
    A pair without changes has no rows; the counts of added less removed lines are the ``net`` of ``line_diff``. All
    windows are over the lines of one pair, which two texts hold. ``version_no`` must be unique in ``texts``.
    Digests are aligned; the lines themselves move once, to the rows that are kept.
    """
    pairs = stage(version_pairs(texts), "version-pairs")
    aligned = aligned_lines(stage(_sided_lines(texts, pairs), "sided-lines")).where("side = 'a' OR partner IS NULL")
    kind = F.when(F.col("partner").isNotNull(), "context").when(F.col("side") == "a", "removed").otherwise("added")
    step = F.when(F.col("partner").isNotNull(), 0).when(F.col("side") == "a", 1).otherwise(2)
    order = Window.partitionBy("pair").orderBy("k", "step", "pos")
    rows = aligned.select("pair", "side", "version_no", "pos", "partner", "digest", "k", step.alias("step"), kind.alias("kind")).withColumn("place", F.row_number().over(order))
    changed = F.when(F.col("kind") != "context", F.col("place"))
    last = F.max(changed).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(changed).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = rows.withColumns({"last": last, "following": following}).where(
        (F.col("place") - F.col("last") <= context) | (F.col("following") - F.col("place") <= context)
    )
    opens = F.coalesce(F.lag("place").over(order) < F.col("place") - 1, F.lit(True)).cast("int")
    numbered = near.withColumn("opens", opens).withColumns({"hunk": F.sum("opens").over(order), "row": F.row_number().over(order)})
    mine, other = F.col("pos") + 1, F.col("partner") + 1
    named = numbered.join(pairs.withColumn("pair", F.col("version_b")), "pair")
    bodies = texts.select("version_no", F.explode(lines(F.col("text"))).alias("line")).withColumn("digest", _digest(F.col("line")))
    bodies = bodies.groupBy("version_no", "digest").agg(F.first("line").alias("line"))
    return named.join(bodies, ["version_no", "digest"]).select(
        "policy_id", "version_a", "version_b", F.col("hunk").cast("int").alias("hunk"), "row", "kind",
        F.when(F.col("side") == "a", mine).alias("line_a"), F.when(F.col("side") == "b", mine).otherwise(other).alias("line_b"), "line",
    )
