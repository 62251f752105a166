"""Near-duplicates by weighted Jaccard similarity of word shingles: BagMinHash, bands, verified multisets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capledger.llm.common import broadcast_if_small, keep_rows, small, stage_compact
from capledger.llm.graph import components
from capledger.llm.shingles import CHUNK, WORDS, chunks, mix, multisets, slices
from capledger.session import stage

THRESHOLD = 0.8
# 21 bands of 6 registers find a pair of similarity 0.8 with probability 0.998.
BANDS, ROWS = 21, 6
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _blocks(text: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weight levels of each element: blocks [0,1), [1,2), [2,4), [4,8), ... that start below its count.

    (text, seed, start, width, count) of every block.
    """
    k = np.where(count > 1, np.floor(np.log2(np.maximum(count - 1, 1))).astype(np.int64) + 2, 1)
    row = np.repeat(np.arange(len(count)), k)
    level = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    start = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level < 2, 1.0, start)
    seed = mix(shingle[row] + (level.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    return text[row], seed, start, width, count[row].astype(np.float64)


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """BagMinHash signatures (texts x registers) of weighted sets; zeros where a set is empty.

    Each (shingle, weight block) is a Poisson process in time with the block's width as rate; a point has a
    register and a height inside the block, all drawn from the shingle's hash, and is a point of every
    set whose weight reaches above its height. A register keeps the earliest point, so two sets agree on
    it with the probability of their weighted Jaccard similarity. A process stops when its time
    passes the latest register of its set.
    """
    doc, seed, start, width, weight = _blocks(text, shingle, count)
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, dtype=np.uint64)
    time, point = np.zeros(len(doc)), 0
    limit = np.full(texts, np.inf)
    while len(doc):
        point += 2
        wait = mix(seed + np.uint64((point - 1) * int(_GOLDEN) % (1 << 64)))
        place = mix(seed + np.uint64(point * int(_GOLDEN) % (1 << 64)))
        time = time - np.log(((wait >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        height = start + (place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width
        low = np.flatnonzero((height < weight) & (time <= limit[doc]))
        cell = doc[low] * registers + (((place[low] >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, cell, time[low])
        won = time[low] == earliest[cell]
        winner[cell[won]] = place[low][won]
        open_ = np.unique(doc)
        limit[open_] = earliest.reshape(texts, registers)[open_].max(axis=1)
        on = time <= limit[doc]
        doc, seed, start, width, weight, time = (a[on] for a in (doc, seed, start, width, weight, time))
    return winner.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    n = len(signature)
    steps = mix(np.arange(1, rows + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    keys = (signature.reshape(n, bands, rows) * steps).sum(axis=2, dtype=np.uint64)
    return mix(keys + np.arange(bands, dtype=np.uint64) * _GOLDEN)


def _sign(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text")
            for first, last, raw, offsets in chunks(column):
                doc, shingle, count = multisets(raw, offsets, size)
                n = last - first
                signature = signatures(doc, shingle, count, n, bands * rows)
                some = np.bincount(doc, minlength=n) > 0
                keys = band_keys(signature, bands, rows)[some].ravel().view(np.int64)
                ends = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int64()))
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_node"), lists], names=["_id", "_node", "_bands"])

    return sign


class Bags(dict):
    """Shingles, counts and their sum by text; so many bytes of texts are remembered."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.room = size, 2 * CHUNK

    def __missing__(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        _, shingle, count = multisets(raw, np.array([0, len(raw)]), self.size)
        self.room -= len(raw)
        if self.room < 0:
            self.clear()
            self.room = 2 * CHUNK
        self[text] = (shingle, count, int(count.sum()))
        return self[text]


def _overlap(size: int):
    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags(size)
        for batch in slices(batches, "_right"):
            common, union = [], []
            for left, right in zip(batch.column("_left").to_pylist(), batch.column("_right").to_pylist()):
                (sa, ca, na), (sb, cb, nb) = bags[left], bags[right]
                _, i, j = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
                both = int(np.minimum(ca[i], cb[j]).sum())
                common.append(both)
                union.append(na + nb - both)
            columns = [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(union, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "common", "union"])

    return overlap


def differences(hub: tuple[np.ndarray, np.ndarray, int], other: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, int, np.ndarray]:
    """(occurrences of the hub that the other lacks, occurrences it has beyond the hub, one number for each of both).

    Two texts have the same number where both lack the same occurrence, or both have the same one more.
    """
    shingle, at = np.unique(np.concatenate((hub[0], other[0])), return_inverse=True)
    more = np.bincount(at, np.concatenate((-hub[1], other[1])), len(shingle)).astype(np.int64)
    times = np.abs(more)
    copy = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    mark = mix(shingle + (more > 0) * _GOLDEN)
    return int(-more[more < 0].sum()), int(more[more > 0].sum()), mix(np.repeat(mark, times) + copy.astype(np.uint64) * _GOLDEN)


def _differ(size: int):
    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags(size)
        for batch in slices(batches, "_text"):
            found = [(bags[h][2], *differences(bags[h], bags[t])) for h, t in zip(batch.column("_hub_text").to_pylist(), batch.column("_text").to_pylist())]
            ends = np.concatenate(([0], np.cumsum([len(f[3]) for f in found]))).astype(np.int32)
            flat = np.concatenate([f[3] for f in found]) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_hub"), batch.column("_node"), batch.column("_own"), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                ],
                names=["_hub", "_node", "_own", "_whole", "_lost", "_new", "_marks"],
            )

    return differ


def may_link(stars: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """Pairs ``a, b`` of texts around a hub that may reach the threshold, for stars ``_hub, _node, _own``; exact bounds only.

    Let x lack l and have n occurrences beyond a hub of h, y likewise, and k be what they lack or have in common. They share
    h - l_x - l_y + k of h + n_x + n_y - k, so they link if k >= (t (h + n_x + n_y) - h + l_x + l_y) / (1 + t) for
    the threshold t. Where both link with the hub they are in one component. Where x does not, d = t (h + n_x) - h + l_x
    is above 0; then k >= d, and k >= (t n_y + l_y) / (1 + t): without a common difference no pair links. So pairs come from
    an index of the differences, not from the group: each text's are ordered by how many texts of the hub have them, the
    rarest first, and a pair meets at its first common one, which leaves as many behind it on both sides as the
    pair needs. Differences that one text has alone only count as places.
    """
    t = F.lit(threshold)
    hubs = stage(stars.select(F.col("_hub").alias("_w")).distinct(), "hubs")
    bodies = texts.join(broadcast_if_small(hubs), F.col("_node") == F.col("_w")).select("_w", F.col("_text").alias("_hub_text"))
    bodies = stage_compact(bodies, "hub-texts")
    rows = stars.join(texts, "_node").join(broadcast_if_small(bodies), F.col("_hub") == F.col("_w"))
    rows = rows.select("_hub", "_node", "_own", "_hub_text", "_text")
    schema = "_hub binary, _node binary, _own binary, _whole long, _lost long, _new long, _marks array<long>"
    found = stage(rows.mapInArrow(_differ(size), schema), "differences")
    shared = found.select("_hub", F.explode("_marks").alias("_mark")).groupBy(F.col("_hub").alias("_h"), F.col("_mark").alias("_m")).agg(F.count("*").alias("_n"))
    marks = found.select("_hub", "_node", "_own", "_whole", "_lost", "_new", F.explode("_marks").alias("_mark"))
    marks = marks.join(shared.where("_n > 1"), (F.col("_hub") == F.col("_h")) & (F.col("_mark") == F.col("_m"))).drop("_h", "_m")
    # How many differences follow in the order, this one included.
    behind = F.row_number().over(Window.partitionBy("_hub", "_node").orderBy(F.desc("_n"), F.desc("_mark")))
    deficit = t * (F.col("_whole") + F.col("_new")) - F.col("_whole") + F.col("_lost")
    least = F.greatest((t * F.col("_new") + F.col("_lost")) / (1 + t), deficit)
    placed = stage(marks.withColumns({"_behind": behind, "_deficit": deficit, "_least": least}).drop("_n", "_whole"), "marks")
    slack = F.lit(1e-9)
    far = placed.where((F.col("_deficit") > slack) & (F.col("_behind") >= F.col("_deficit") - slack))
    near = placed.where(F.col("_behind") >= F.col("_least") - slack).select(
        *[F.col(c).alias(c + "y") for c in ("_hub", "_mark", "_node", "_own", "_lost", "_new", "_behind")]
    )
    need = (F.col("_deficit") + t * F.col("_newy") + F.col("_losty")) / (1 + t)
    meet = (
        (F.col("_hub") == F.col("_huby"))
        & (F.col("_mark") == F.col("_marky"))
        & (F.col("_own") != F.col("_owny"))
        & (F.least("_behind", "_behindy") >= need - slack)
    )
    return far.join(near, meet).select(F.least("_node", "_nodey").alias("a"), F.greatest("_node", "_nodey").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, size: int = WORDS) -> DataFrame:
    """Exact multiset overlap of each pair ``a, b``: ``a, b, common, union``."""
    left = texts.select(F.col("_node").alias("a"), F.col("_text").alias("_left"))
    right = texts.select(F.col("_node").alias("b"), F.col("_text").alias("_right"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "_left", "_right")
    return stage(rows.mapInArrow(_overlap(size), "a binary, b binary, common long, union long"), "overlaps")


def _linked(threshold: float):
    return F.col("common") >= F.col("union") * F.lit(threshold) - F.lit(1e-9)


def _joined(measured: DataFrame, threshold: float) -> DataFrame:
    """``_node, _own``: components of the measured pairs that link."""
    linked = measured.where(_linked(threshold)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return stage(components(linked).toDF("_node", "_own"), "components")


def _stars(members: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket's hub and its other texts, smaller text first."""
    apart = members.where("_node <> _hub")
    return apart.select(F.least("_hub", "_node").alias("a"), F.greatest("_hub", "_node").alias("b")).distinct()


def near_links(signed: DataFrame, docs: DataFrame, text: str, threshold: float, size: int) -> DataFrame:
    """Components of the texts that a band brings together and whose overlap reaches the threshold: ``_node, _own``.

    Every text of a bucket is compared with one of them, drawn anew for each bucket. A bucket whose texts all link with it
    is done, for a pair inside a component needs no link of its own. In the others, texts are compared with the one
    that has the most links so far. In buckets that then hold several components, the pairs that may link them come from
    ``may_link``.
    """
    once = stage(signed.groupBy("_node").agg(F.first("_bands").alias("_bands")), "signed-texts")
    placed = once.select("_node", F.explode("_bands").alias("_key"))
    drawn = F.min_by("_node", F.xxhash64("_node", "_key"))
    buckets = placed.groupBy(F.col("_key").alias("_k")).agg(F.count("*").alias("_n"), drawn.alias("_hub")).where("_n > 1")
    shared = stage(placed.join(buckets, F.col("_key") == F.col("_k")).select("_key", "_node", "_hub"), "buckets")
    wanted = stage(shared.select(F.col("_node").alias("_w")).distinct(), "candidates")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.unhex(F.md5(body)).alias("_node"), body.alias("_text"))
    texts = stage_compact(
        rows.join(small(wanted), F.col("_node") == F.col("_w"), "left_semi").groupBy("_node").agg(F.first("_text").alias("_text")),
        "candidate-texts",
    )
    measured = verify(_stars(shared), texts, size)

    linked = measured.where(_linked(threshold)).select("a", "b")
    apart = shared.where("_node <> _hub").withColumns({"a": F.least("_hub", "_node"), "b": F.greatest("_hub", "_node")}).join(linked, ["a", "b"], "left_anti")
    open_ = apart.select(F.col("_key").alias("_k")).distinct()
    ends = linked.select(F.explode(F.array("a", "b")).alias("_node")).groupBy("_node").agg(F.count("*").alias("_links"))
    left = stage(shared.join(open_, F.col("_key") == F.col("_k"), "left_semi").select("_key", "_node"), "open-buckets")
    most = F.max_by("_node", F.struct(F.coalesce("_links", F.lit(0)), "_node"))
    hubs = left.join(ends, "_node", "left").groupBy(F.col("_key").alias("_k")).agg(most.alias("_hub"))
    left = stage(left.join(hubs, F.col("_key") == F.col("_k")).select("_key", "_node", "_hub"), "open-buckets")
    measured = measured.unionByName(verify(_stars(left).join(measured, ["a", "b"], "left_anti"), texts, size))
    found = _joined(measured, threshold)

    stars = _still_open(left, found).where("_node <> _hub").select("_hub", "_node", "_own").distinct()
    rest = may_link(stage(stars, "open-stars"), texts, threshold, size)
    last = verify(rest, texts, size).where(_linked(threshold))
    if last.isEmpty():
        return found
    # Components of components: what a link joins are the classes of its ends.
    owner = lambda side: found.select(F.col("_node").alias(side), F.col("_own").alias(f"_{side}"))
    classes = last.select("a", "b").join(owner("a"), "a", "left").join(owner("b"), "b", "left")
    joined = components(classes.select(F.coalesce("_a", "a").alias("u"), F.coalesce("_b", "b").alias("v"))).toDF("_was", "_own")
    joined = stage(joined, "joined-classes")
    moved = found.withColumnRenamed("_own", "_was").join(joined, "_was", "left").select("_node", F.coalesce("_own", "_was").alias("_own"))
    alone = joined.withColumnRenamed("_was", "_node").join(found, "_node", "left_anti")
    return moved.unionByName(alone.select("_node", "_own"))


def _still_open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of buckets that hold texts of several components, with their component ``_own``."""
    owned = buckets.join(found, "_node", "left").withColumn("_own", F.coalesce("_own", "_node"))
    open_ = owned.groupBy(F.col("_key").alias("_k")).agg(F.min("_own").alias("_lo"), F.max("_own").alias("_hi")).where("_lo <> _hi")
    return owned.join(open_, F.col("_key") == F.col("_k"), "left_semi")


def _members(docs: DataFrame, key: str, text: str, threshold: float, size: int, bands: int, rows: int) -> DataFrame:
    """One row per distinct (id, text) and task that read it: ``_id, _node, _times, class_id, class_size, _kept``; so ``_times``
    is bounded by a task's input."""
    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("_id"), F.unhex(F.md5(body)).alias("_node"), body.alias("_text"))
    kind = dict(read.dtypes)["_id"]
    made = read.mapInArrow(_sign(size, bands, rows), f"_id {kind}, _node binary, _bands array<long>")
    signed = stage(made.withColumn("_task", F.spark_partition_id()), "signatures")
    found = near_links(signed, docs, text, threshold, size)
    ids = signed.groupBy("_id", "_node", "_task").agg(F.count("*").alias("_times"))
    classed = stage(
        ids.join(found, "_node", "left").select("_id", "_node", "_task", "_times", F.coalesce("_own", "_node").alias("_class")),
        "classes",
    )
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_node").alias("node"), F.col("_task").alias("task")))
    classes = classed.groupBy(F.col("_class").alias("_c")).agg(best.alias("_keep"), F.sum("_times").alias("class_size"))
    joined = classed.join(classes, F.col("_class") == F.col("_c"))
    is_kept = F.col("_id").eqNullSafe(F.col("_keep.id")) & (F.col("_node") == F.col("_keep.node")) & (F.col("_task") == F.col("_keep.task"))
    return joined.select("_id", "_node", "_times", F.col("_keep.id").alias("class_id"), "class_size", is_kept.alias("_kept"))


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = WORDS,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per input row: ``key, class_id, class_size, kept``.

    A link joins two texts whose multisets of ``size``-word shingles have a weighted Jaccard similarity of
    at least ``threshold``; classes are the components of the links, named by their least id, and one row
    of each class is kept: one with that id. Equal texts share a class, so do NULL and empty ones; other texts
    without words are alone. NULL ids are larger than all others. Of rows that repeat id and text, the
    first is the kept one. An empty table gives an empty result; other columns play no part.
    """
    return (
        _members(docs, key, text, threshold, size, bands, rows)
        .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
        .select(F.col("_id").alias(key), "class_id", "class_size", (F.col("_kept") & (F.col("_nth") == 1)).alias("kept"))
    )


def drop_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = WORDS,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """The kept row of each class with all its columns; among rows that repeat id and text, the smallest by all columns."""
    members = _members(docs, key, text, threshold, size, bands, rows)
    kept = members.groupBy("_id", "_node").agg(F.sum("_times").alias("_times"), F.bool_or("_kept").alias("_kept")).where("_kept")
    body = F.coalesce(F.col(text), F.lit(""))
    return keep_rows(docs, kept.select("_id", "_node", "_times"), F.col(key), F.unhex(F.md5(body)))
