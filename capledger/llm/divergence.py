"""How the sources of a language differ in their terms: packed and radix-sorted term counts, exact divergences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.llm.common import broadcast_if_small
from capledger.llm.shingles import LOWER, chunks
from capledger.session import stage

LEAST_DOCUMENTS, TOP = 10, 10
# Shares are parts of this many.
SCALE = 1_000_000_000
# Bytes of text whose terms are sorted at once (at least one text).
CHUNK = 8 << 20
# Cells of one block of terms and sources, and of the sums a worker keeps.
CELLS = 1 << 20
_BYTES = np.arange(256)
LETTER = ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_SIXTEEN = np.uint64(0xFFFF)


def term_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, first, end, text number) of every run of letters and non-ASCII bytes."""
    low = LOWER[raw]
    inside = np.append(LETTER[low], False)
    border = np.zeros(len(raw) + 1, dtype=bool)
    border[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~border
    first = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False) & ~np.append(border[1:], True)
    end = np.flatnonzero(inside & ~after) + 1
    return low, first, end, np.searchsorted(offsets, first, "right") - 1


def words64(low: np.ndarray, first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Terms as ``n`` numbers of eight bytes each, the first byte highest; no term holds a zero byte, so the
    zeros behind a short one stand for nothing else and numbers sort as bytes do."""
    padded = np.concatenate((low, np.zeros(8 * n, dtype=np.uint8)))
    packed = np.zeros((len(first), n), dtype=np.uint64)
    for i in range(8 * n):
        byte = np.where(i < length, padded[first + i], 0).astype(np.uint64)
        packed[:, i // 8] |= byte << np.uint64(56 - 8 * (i % 8))
    return packed


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by several unsigned columns, the first one highest: one counting pass per 16 bits, from the lowest.
    Sixteen bits that all rows share need no pass."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            part = ((key >> np.uint64(shift)) & _SIXTEEN).astype(np.uint16)
            if len(part) and part.min() != part.max():
                order = order[np.argsort(part[order], kind="stable")]
    return order


def run_counts(columns: list[np.ndarray], text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first row, rows, distinct texts) of every run of equal columns; texts ascend inside a run."""
    new = np.zeros(len(text), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)
    fresh = new.copy()
    fresh[1:] |= text[1:] != text[:-1]
    return first, np.diff(np.append(first, len(text))), np.add.reduceat(fresh, first, dtype=np.int64) if len(first) else first


def _unpacked(packed: np.ndarray) -> pa.Array:
    """Packed terms as strings."""
    cells = packed.astype(">u8").view(np.uint8).reshape(len(packed), -1)
    ends = np.concatenate(([0], np.cumsum((cells != 0).sum(axis=1)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends), pa.py_buffer(cells[cells != 0])])


def count_terms(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, count, texts with it) of some texts, bucket by bucket of the terms' lengths.

    Terms of up to 8 and up to 16 bytes become one and two numbers, which are radix-sorted with their group and
    counted by runs; a longer term goes to the bucket of its length, where the rows of bytes are sorted.
    """
    low, first, end, text = term_spans(raw, offsets)
    length = end - first
    for n in (1, 2):
        at = np.flatnonzero((length > 8 * (n - 1)) & (length <= 8 * n))
        if not len(at):
            continue
        packed, own, of = words64(low, first[at], length[at], n), group[text[at]].astype(np.uint64), text[at]
        order = radix_order([own, *packed.T])
        packed, own, of = packed[order], own[order], of[order]
        start, count, texts = run_counts([own, *packed.T], of)
        yield own[start].astype(np.int64), _unpacked(packed[start]), count, texts
    for size in np.unique(length[length > 16]):
        at = np.flatnonzero(length == size)
        # At most so many bytes are laid out side by side; equal terms of several parts add up later.
        for part in np.array_split(at, -(-len(at) * int(size) // CHUNK)):
            rows = np.array([low[a : a + size].tobytes() for a in first[part]], dtype=f"S{size}")
            order = np.lexsort((rows, group[text[part]]))
            rows, own, of = rows[order], group[text[part]][order], text[part][order]
            start, count, texts = run_counts([own, rows], of)
            yield own[start], pa.array(rows[start].tolist(), pa.binary()), count, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, offsets in chunks(batch.column("_text"), CHUNK):
            part = pa.Table.from_batches([batch.slice(first, last - first)])
            names = part.select(["_lang", "_source"]).group_by(["_lang", "_source"]).aggregate([])
            known = {tuple(r.values()): i for i, r in enumerate(names.to_pylist())}
            pairs = zip(part.column("_lang").to_pylist(), part.column("_source").to_pylist())
            group = np.array([known[p] for p in pairs], dtype=np.int64)
            for own, term, count, texts in count_terms(raw, offsets, group):
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.column("_lang").combine_chunks().take(at), names.column("_source").combine_chunks().take(at),
                        term.cast(pa.string()), pa.array(count, pa.int64()), pa.array(texts, pa.int64()),
                    ],
                    names=["_lang", "_source", "term", "n", "docs"],
                )


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``_lang, _source, term, n, docs``: occurrences and documents of every term in every group. NULLs count as empty."""
    parts = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "_lang"), (source, "_source"), (text, "_text"))]
    counted = docs.select(*parts).mapInArrow(_count, "_lang string, _source string, term string, n long, docs long")
    return counted.groupBy("_lang", "_source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)) in whole numbers: three long-division steps of a thousand each, so
    totals of up to 9 * 10^15 do not overflow."""
    rest, quotient = count + 2, F.lit(0).cast("long")
    whole = total + 2 * kept
    for _ in range(3):
        quotient = quotient * 1000 + F.call_function("div", rest * 1000, whole)
        rest = F.pmod(rest * 1000, whole)
    return quotient + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _row_gaps(source: np.ndarray, term: np.ndarray, p: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per source i, the sums over terms for all sources j > i of what both have beyond what each has alone:
    f(p_i, p_j) - f(p_i, z_j) - f(z_i, p_j) + f(z_i, z_j), z a source's share for no occurrence. A term
    that one of them lacks adds zero.
    """

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a - b) ** 2 // (a + b)

    dense = np.tile(floor, (int(term[-1]) + 1, 1))
    dense[term, source] = p
    for i in range(len(floor) - 1):
        held = dense[dense[:, i] != floor[i]]
        x, y, none = held[:, i : i + 1], held[:, i + 1 :], floor[i + 1 :]
        yield i, (f(x, y) - f(x, none) - f(floor[i], y) + f(floor[i], none)).sum(axis=0)


def _co_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language, list of (source, p, z)) of terms to sums per language and pair of sources."""
    sums: dict[tuple[str, str, str], int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in sums], pa.string()) for i in range(3)] + [pa.array(list(sums.values()), pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(columns, names=["_lang", "_a", "_b", "both"])

    for batch in batches:
        for lang in batch.column("_lang").unique().to_pylist():
            part = batch.filter(pc.equal(batch.column("_lang"), lang))
            sources = pc.count_distinct(part.column("_in").flatten().field("source")).as_py()
            step = max(1, CELLS // sources)
            for low in range(0, part.num_rows, step):
                lists = part.column("_in").slice(low, step)
                inner, size = lists.flatten(), pc.list_value_length(lists).to_numpy()
                coded = inner.field("source").dictionary_encode()
                names = coded.dictionary.to_pylist()
                place = np.argsort(np.argsort(np.array(names, dtype=object)))
                source = place[coded.indices.to_numpy(zero_copy_only=False)]
                p, z = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("p", "z"))
                floor = np.zeros(len(names), dtype=np.int64)
                floor[source] = z
                names.sort()
                for i, row in _row_gaps(source, np.repeat(np.arange(len(size)), size), p, floor):
                    for j in np.flatnonzero(row):
                        sums[lang, names[i], names[i + 1 + j]] += int(row[j])
                    if len(sums) > CELLS:
                        yield out()
    yield out()


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the term shares of each source stand from the other sources of
    its language (part ``pair``, all of them) and which terms it has more of than the language (part ``term``, the first ``top``).

    Kept are the terms in at least ``least`` documents of the language; shares are whole parts of ``SCALE``, with two
    occurrences added to each term, and all sums are exact. Over all kept terms a pair's value is split into what needs the
    sources' totals alone, what needs the count of one source (by distinct counts, not by terms), and what needs both,
    which is summed in blocks of terms without a row per pair of a term's sources.

    NULL text, language and source read as empty; a source without terms is a source; a language without kept terms
    gives pairs of value 0. Repeated rows are documents each. An empty table gives an empty result; other
    columns play no part.
    """
    counts = stage(term_counts(docs, lang, source, text), "term-counts")
    kept = counts.groupBy("_lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = stage(kept.drop("docs"), "kept-terms")
    langs = stage(kept.groupBy("_lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "languages")
    rows = stage(
        counts.select("_lang", "_source", "term", "n").join(kept, ["_lang", "term"]), "kept-counts"
    )
    empty = F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(source), F.lit("")).alias("_source")
    totals = rows.groupBy("_lang", "_source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (
        docs.select(*empty).distinct().join(totals, ["_lang", "_source"], "left").join(broadcast_if_small(langs), "_lang", "left")
        .select("_lang", "_source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")])
    )
    # A language without kept terms has no share to speak of.
    floor = F.when(F.col("kept") > 0, share(zero, F.col("total"), F.greatest("kept", F.lit(1))))
    groups = stage(groups.withColumn("z", floor), "groups")
    shared = rows.join(broadcast_if_small(groups), ["_lang", "_source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    shared = stage(shared, "shares")
    return _pairs(groups, shared).unionByName(_terms(shared, top)).select(
        F.col("_lang").alias(lang), F.col("_source").alias(source), "part", "item", "value", "rank"
    )


def _pairs(groups: DataFrame, shared: DataFrame) -> DataFrame:
    """Every two sources of a language, both ways round."""
    other = groups.select("_lang", F.col("_source").alias("item"), F.col("z").alias("zo"))
    # One source's counts against the other's none: distinct counts times sources.
    levels = shared.groupBy("_lang", "_source", "p", "z").agg(F.count("*").alias("m"))
    alone = (
        levels.join(broadcast_if_small(stage(other, "sources")), "_lang").where("_source <> item")
        .groupBy("_lang", "_source", "item").agg(F.sum(F.col("m") * (gap(F.col("p"), F.col("zo")) - gap(F.col("z"), F.col("zo")))).alias("value"))
    )
    inside = shared.groupBy("_lang", "term").agg(F.collect_list(F.struct(F.col("_source").alias("source"), "p", "z")).alias("_in"))
    both = inside.where(F.size("_in") > 1).select("_lang", "_in").mapInArrow(_co_gaps, "_lang string, _a string, _b string, both long")
    both = both.groupBy("_lang", "_a", "_b").agg(F.sum("both").alias("value"))
    base = groups.join(other, "_lang").where("_source <> item").select(
        "_lang", "_source", "item", F.coalesce(F.col("kept") * gap(F.col("z"), F.col("zo")), F.lit(0)).alias("value")
    )
    turned = alone.select("_lang", F.col("item").alias("_source"), F.col("_source").alias("item"), "value")
    ways = [both.select("_lang", F.col(a).alias("_source"), F.col(b).alias("item"), "value") for a, b in (("_a", "_b"), ("_b", "_a"))]
    total = base.unionByName(alone).unionByName(turned).unionByName(ways[0]).unionByName(ways[1])
    total = total.groupBy("_lang", "_source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("_lang", "_source").orderBy(F.desc("value"), "item"))
    return total.select("_lang", "_source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(shared: DataFrame, top: int) -> DataFrame:
    """The terms that a source has more of than its language, the furthest first."""
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = shared.withColumn("q", q).where("p > q").withColumn("value", gap(F.col("p"), F.col("q")))
    rank = F.row_number().over(Window.partitionBy("_lang", "_source").orderBy(F.desc("value"), "term"))
    first = more.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.select("_lang", "_source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
