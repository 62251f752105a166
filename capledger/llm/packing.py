"""Mixture-controlled packing: every window takes its share of tokens from each source's queue."""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from capledger.llm.common import running_start, small, stage_compact
from capledger.llm.shingles import buffers, slices
from capledger.session import stage

WINDOW = 2048
# The id that ends a document, and the text of the vocabulary's special token.
END_ID = 1
SPECIAL = "<|endoftext|>"
# Sources with a queue of their own, the largest; all others share one more.
MOST_QUEUES = 1023
# Pieces remembered by a worker, and cells of one layout matrix.
MEMORY = 600_000
CELLS = 1 << 17
# White space that a cut before a blank would tear apart.
_TORN = re.compile(r"\s (?:\s|\Z)")


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


class Encoder(dict):
    """Token ids of a text as little-endian 32-bit numbers, ``END_ID`` last.

    Texts are cut before blanks, where the vocabulary's pre-tokenizer cuts too, and the ids of each piece
    after a blank are remembered. The ranks file holds the same vocabulary as the tokenizer's; texts that contain the
    special token go through the tokenizer itself.
    """

    def __init__(self, tokenizer: str | None):
        import public_tokenizers
        import tiktoken

        super().__init__()
        self.path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
        with open(os.path.splitext(self.path)[0] + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pattern = public_tokenizers.PATTERN
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = packed(self.encode(" " + piece))
        if len(piece) < 40:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        end = np.uint32(END_ID).tobytes()
        if SPECIAL in text:
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids) + end
        if _TORN.search(text):
            return packed(self.encode(text)) + end
        first, *rest = text.split(" ")
        return b"".join([packed(self.encode(first)), *map(self.__getitem__, rest), end])


def _encode(tokenizer: str | None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, before = Encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in slices(batches, "_text"):
            queues, ids, counts, starts = batch.column("_queue").to_pylist(), [], [], []
            for queue, text in zip(queues, batch.column("_text").to_pylist()):
                ids.append(encoder.ids(text or ""))
                counts.append(len(ids[-1]) // 4)
                starts.append(before.get(queue, 0))
                before[queue] = starts[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_queue"),
                    pa.array([task] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["_id", "_queue", "_task", "_local", "_tokens", "_ids"],
            )

    return encode


def tokenize(docs: DataFrame, key: str, text: str, source: str, tokenizer: str | None) -> DataFrame:
    """Token ids of every document, written once, with task number and start inside (task, source)."""
    rows = docs.select(F.col(key).alias("_id"), F.col(source).alias("_queue"), F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)
    schema = f"_id {kinds['_id']}, _queue {kinds['_queue']}, _task int, _local long, _tokens long, _ids binary"
    return stage_compact(rows.mapInArrow(_encode(tokenizer), schema), "token-ids")


@dataclass(frozen=True)
class Schedule:
    """Deficit round-robin in closed form.

    Token j of a queue with T tokens is due at time (j + 1/2) / T: a queue that is served at its times has its share
    of all tokens to within one token at any time. Tokens are served in the order of their times, the first queue in a
    tie, so windows fill whatever the shares are, a queue with less than a token a window waits its turn
    over several, and what it is owed is carried on. How much of each queue stands before a window is a search
    for the time by which so many tokens are due, so any task can lay out any window without the windows before it.
    """

    totals: np.ndarray
    window: int

    @property
    def windows(self) -> int:
        return int(-(-self.totals.sum() // self.window))

    def served(self, w: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) before each window (rows).

        By the time B / N between half a queue's token less and more than B tokens are due per queue. What is due well
        before that is counted; what is due around it is sorted.
        """
        total, queues = int(self.totals.sum()), len(self.totals)
        border = np.minimum(w.astype(np.int64) * self.window, total)
        slack = queues / 2 + 1

        def due(tokens: np.ndarray, more: int) -> np.ndarray:
            counts = np.floor(tokens[:, None] / total * self.totals + 0.5).astype(np.int64) + more
            return np.clip(counts, 0, self.totals)

        counts, high = due(border - slack, -1), due(border + slack, 1)
        open_ = (high - counts).ravel()
        cell = np.repeat(np.arange(len(open_)), open_)
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(open_) - open_, open_)
        row, queue = np.divmod(cell, queues)
        time = (counts.ravel()[cell] + nth + 0.5) / self.totals[queue]
        order = np.lexsort((queue, time, row))
        per_row = np.bincount(row, minlength=len(w))
        place = np.arange(len(cell)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        taken = cell[order[place < np.repeat(border - counts.sum(axis=1), per_row)]]
        return counts + np.bincount(taken, minlength=counts.size).reshape(counts.shape)

    def pieces(self, queue: np.ndarray, start: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, start in document, length, window, offset) of every piece, for documents at ``start`` of their queue."""
        total, slack = int(self.totals.sum()), len(self.totals) / 2 + 2
        share = total / self.totals[queue]
        first = np.maximum(np.floor((start * share - slack) / self.window).astype(np.int64), 0)
        last = np.minimum(np.floor(((start + tokens) * share + slack) / self.window).astype(np.int64), self.windows - 1)
        spans = last - first + 1
        step = max(1, CELLS // len(self.totals))
        ends = np.cumsum(spans)
        for low in range(0, int(spans.sum()), step):
            k = np.arange(low, min(low + step, int(spans.sum())))
            row = np.searchsorted(ends, k, "right")
            w = first[row] + k - (ends[row] - spans[row])
            borders, here = np.unique(np.concatenate((w, w + 1)), return_inverse=True)
            served = self.served(borders)
            before, after = served[here[: len(k)]], served[here[len(k) :]]
            here, q = np.arange(len(k)), queue[row]
            a = np.maximum(start[row], before[here, q])
            b = np.minimum(start[row] + tokens[row], after[here, q])
            ahead = np.cumsum(after - before, axis=1) - (after - before)
            offset = ahead[here, q] + a - before[here, q]
            some = b > a
            yield row[some], (a - start[row])[some], (b - a)[some], w[some], offset[some]


def _lay_out(totals: list[int], window: int):
    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(np.array(totals, dtype=np.int64), window)
        for batch in slices(batches, "_ids"):
            if not batch.num_rows:
                continue
            numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_number", "_start", "_tokens")]
            raw, at = buffers(batch.column("_ids"))
            for row, start, length, w, offset in schedule.pieces(*numbers):
                # Pieces follow one another as the ids do, so the same bytes serve with other borders.
                ends = np.append(at[row] + 4 * start, at[row[-1:]] + 4 * (start + length)[-1:]) if len(row) else np.zeros(1)
                parts = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(row)),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        batch.column("_tokens").take(pa.array(row)),
                        pa.array(w, pa.int64()),
                        pa.array(offset, pa.int64()),
                        parts,
                    ],
                    names=["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return lay_out


def _queues(totals: DataFrame, most: int) -> tuple[list[Row], int]:
    """The ``most`` largest sources, which have a queue of their own, and the tokens that all others share (0: none)."""
    own = totals.orderBy(F.desc("_sum"), "_queue").limit(most).collect()
    return own, (totals.agg(F.sum("_sum")).first()[0] or 0) - sum(r["_sum"] for r in own)


def _shared_starts(ids: DataFrame, sums: DataFrame, bases: DataFrame) -> DataFrame:
    """``_queue, _task, _local, _start``: places in one queue of all documents of the sources in ``bases``, in the order of
    the times at which the middle of a document is due in its source."""
    totals = sums.groupBy(F.col("_queue").alias("_q")).agg(F.sum("_sum").alias("_total"))
    starts = stage(bases.join(totals, F.col("_b").eqNullSafe(F.col("_q"))).select("_b", "_t", "_base", "_total"), "queue-starts")
    rows = ids.select("_queue", "_task", "_local", "_tokens").join(
        small(starts), F.col("_queue").eqNullSafe(F.col("_b")) & (F.col("_task") == F.col("_t"))
    )
    time = (F.col("_base") + F.col("_local") + F.col("_tokens") / 2) / F.col("_total")
    rows = rows.select("_queue", "_task", "_local", "_tokens", time.alias("_time"), F.lit(0).alias("_all"))
    return running_start(rows, ["_all"], ["_time", "_queue", "_task", "_local"], "_tokens", "_start").select("_queue", "_task", "_local", "_start")


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", window: int = WINDOW,
    tokenizer: str | None = None, queues: int = MOST_QUEUES,
) -> DataFrame:
    """One row per piece: ``key, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian 32-bit).

    Each source is a queue of its documents; target proportions are the sources' shares of all tokens. Every
    window but the last is full. Before any window, a queue has had its share to within half a token and half as
    many tokens as there are queues times its share; what a queue is owed is carried to the next window, whichever
    task lays it out. Documents follow one another in a queue in the order of the input's tasks. Beyond the ``queues`` largest
    sources all others share one queue, where each source's documents stand evenly spread: by the time at which their
    middle is due.
    A NULL source is a source; a NULL or empty text is the end id alone; repeated rows are packed each. An
    empty table gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    ids = tokenize(docs, key, text, source, tokenizer)
    sums = stage(ids.groupBy("_queue", "_task").agg(F.sum("_tokens").alias("_sum")), "queue-tokens")
    own, shared = _queues(sums.groupBy("_queue").agg(F.sum("_sum").alias("_sum")), queues)
    totals = [r["_sum"] for r in own] + [shared] * (shared > 0)
    kind = dict(ids.dtypes)["_queue"]
    numbers = spark.createDataFrame([(r["_queue"], i) for i, r in enumerate(own)], f"_q {kind}, _number long")
    bases = running_start(sums, ["_queue"], ["_task"], "_sum", "_base").withColumnsRenamed({"_queue": "_b", "_task": "_t"})
    numbered = F.broadcast(numbers), F.col("_b").eqNullSafe(F.col("_q"))
    owned = stage(bases.join(*numbered).select("_b", "_t", "_number", "_base"), "queue-starts")
    same = F.col("_queue").eqNullSafe(F.col("_b")) & (F.col("_task") == F.col("_t"))
    columns = ["_id", "_number", "_start", "_tokens", "_ids"]
    placed = ids.join(small(owned), same).withColumn("_start", F.col("_base") + F.col("_local")).select(*columns)
    if shared:
        rest = _shared_starts(ids, sums, bases.join(*numbered, "left_anti"))
        rest = rest.withColumn("_number", F.lit(len(own)).cast("long")).withColumnsRenamed({"_queue": "_b", "_task": "_t", "_local": "_l"})
        placed = placed.unionByName(ids.join(rest, same & (F.col("_local") == F.col("_l"))).select(*columns))
    schema = (
        f"_id {dict(ids.dtypes)['_id']}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return placed.mapInArrow(_lay_out(totals, window), schema).withColumnRenamed("_id", key)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """Pieces joined to one padded row per sequence: ``sequence_id, ids, length``. A sequence has ``window`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(np.uint32(pad_id).tobytes().hex()), F.lit(window) - F.col("length").cast("int")))
    joined = pieces.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("length"))
    return joined.withColumn("ids", F.concat("ids", pad))
