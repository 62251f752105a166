"""Toxicity: noisy-channel deobfuscation under a character language model, then a score of the restored text."""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.common import small
from capledger.llm.shingles import buffers, slices
from capledger.session import stage

# Letters that a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}

# The sample that the scorer learns from: at most so many labelled rows, chosen by a hash of their ids.
SAMPLE_ROWS = 8_000
# Features the scorer may use, the ones that tell the labels apart best in the sample.
FEATURES = 4096
# Letters of the language model: a border and a to z, accents folded; it looks three letters back.
ORDER, LETTERS = 4, 27
# Log-probabilities of the channel: a letter written as a symbol, a letter repeated, letters spaced out, or as it is.
AS_SYMBOL, REPEATED, SPACED, AS_IS = math.log(0.05), math.log(0.1), math.log(0.02), math.log(0.9)
# Longer tokens are decoded each time, not remembered.
LONGEST = 64

_SYMBOLS = re.escape("".join(LEET))
_SINGLE = rf"(?:[^\W\d_]|[{_SYMBOLS}])"
# Tokens whose lattice has more than one path: symbols among letters, runs of one letter, and spaced single letters or
# symbols, which are left alone without a letter among them.
_SUSPECT = re.compile(
    rf"(?<![\w{_SYMBOLS}])(?:(?=[^\W\d_{_SYMBOLS}]*[{_SYMBOLS}])(?=[{_SYMBOLS}]*[^\W\d_])[^\W_{_SYMBOLS}]*"
    rf"(?:[{_SYMBOLS}][^\W\d_]*)+(?![\w@=])"
    r"|[^\W\d_]*?([^\W\d_])(?i:\1)[^\W\d_]*"
    rf"|{_SINGLE}([ ._*-]){_SINGLE}(?:\2{_SINGLE})+(?!\w))"
)
# Mail addresses, addresses with a scheme or www, and decimal or dotted numbers. What follows a dot inside one is no token.
_ADDRESS = re.compile(
    r"(?<![\w.%+-])[\w.%+-]++@[\w-]+(?:\.[\w-]+)+|(?<!\w)(?:[A-Za-z][A-Za-z0-9+-]*+://|[Ww]{3}\.)\S+|(?<![\w.,])\d+(?:[.,]\d+)+"
)
_DOUBLE = re.compile(r"(.)\1")
_WORD = re.compile(r"[^\W\d_]+")


class Folds(dict):
    """Number of a letter in the language model: 1 to 26 with accents folded, 0 for anything else. Numbers are
    remembered; a plain class, so that it travels to workers that lack this package."""

    def __missing__(self, letter: str) -> int:
        plain = unicodedata.normalize("NFD", letter.lower())[:1]
        number = ord(plain) - 96 if "a" <= plain <= "z" else 0
        if len(self) < 4096:
            self[letter] = number
        return number


fold = Folds().__getitem__


def _folds() -> np.ndarray:
    """Model number of every code point below U+0250; other code points are borders."""
    return np.array([fold(chr(c)) for c in range(0x250)], dtype=np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every run of ``ORDER`` letters, borders included, over whole texts."""
    folds = _folds()
    total = np.zeros(LETTERS**ORDER, dtype=np.int64)
    for batch in batches:
        column = batch.column("_text")
        raw, offsets = buffers(column)
        for at in range(0, len(column)):
            text = bytes(raw[offsets[at] : offsets[at + 1]]).decode(errors="replace")
            points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
            letters = folds[np.minimum(points, 0x24F)] * (points < 0x250)
            letters = np.concatenate((np.zeros(ORDER - 1, np.int32), letters, np.zeros(1, np.int32)))
            code = np.zeros(len(letters) - ORDER + 1, dtype=np.int32)
            for i in range(ORDER):
                code = code * LETTERS + letters[i : len(letters) - ORDER + 1 + i]
            total += np.bincount(code, minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["code", "n"])


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``code, n``: runs of four letters over all documents, at most 27^4 rows."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Log-probability of a letter after three others, from interpolated counts of all orders.

    The table has 27^4 entries at most, whatever the corpus.
    """
    rows = counts.toPandas()
    table = np.zeros(LETTERS**ORDER)
    table[rows["code"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    table = table.reshape((LETTERS,) * ORDER)
    estimate = np.full(LETTERS, 1 / LETTERS)
    for order in range(1, ORDER + 1):
        seen = table.sum(axis=tuple(range(ORDER - order))) if order < ORDER else table
        kinds = (seen > 0).sum(axis=-1, keepdims=True)
        total = seen.sum(axis=-1, keepdims=True)
        estimate = (seen + kinds * estimate) / np.maximum(total + kinds, 1) + (total == 0) * estimate
    return np.log(estimate).astype(np.float32).reshape(LETTERS ** (ORDER - 1), LETTERS)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """Per place of an obfuscated token, the strings it may restore to with the channel's log-probability."""
    gap = None
    if len(token) > 4 and not token[1].isalnum() and token[1] not in LEET and token[1::2] == token[1] * len(token[1::2]):
        gap = token[1]
    i = 0
    while i < len(token):
        c = token[i]
        if gap is not None and i % 2:
            yield [("", SPACED), (c, AS_IS)]
            i += 1
            continue
        end = i + 1
        while end < len(token) and token[end] == c and gap is None:
            end += 1
        run = end - i
        # Spaced out, a repeated letter or symbol stands two before.
        again = [("", REPEATED)] if gap is not None and i and token[i - 2] == c else []
        if c in LEET:
            # Punctuation at the end may well be meant.
            meant = end == len(token) and not c.isdigit()
            place = [(x, AS_SYMBOL) for x in LEET[c]] + [(c, AS_IS if meant else 3 * AS_SYMBOL)]
            yield place + again
            for _ in range(run - 1):
                yield place if meant else [*place, ("", REPEATED)]
        elif run > 2:
            yield [(c, (run - 1) * REPEATED), (c * 2, (run - 2) * REPEATED + AS_IS), (c * run, run * AS_IS - 1)]
        elif run == 2:
            # Plain words double letters too.
            yield [(c, 2 * REPEATED), (c * 2, 2 * AS_IS)]
        else:
            yield [(c, AS_IS), *again]
        i = end


def decode(token: str, model: np.ndarray | list[list[float]]) -> str:
    """Most probable restored text of a token: Viterbi over its lattice, with the last three letters as state.

    A path is a chain of back pointers that paths share, so a token of any length is decoded whole.
    """
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    width = LETTERS ** (ORDER - 2)
    for place in chain(lattice(token), [[("\0", 0.0)]]):
        numbered = [(out, cost, [fold(letter) for letter in out]) for out, cost in place]
        reached: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            for out, cost, numbers in numbered:
                s, p = state, score + cost
                for number in numbers:
                    p += float(model[s][number])
                    s = (s % width) * LETTERS + number
                known = reached.get(s)
                if known is None or p > known[0]:
                    reached[s] = (p, (out, path) if out else path)
        states = reached
    path, parts = max(states.values(), key=lambda x: x[0])[1], []
    while path is not None:
        parts.append(path[0])
        path = path[1]
    return "".join(reversed(parts))[:-1]


def decode_double(token: str, at: int, model: np.ndarray | list[list[float]]) -> str:
    """As ``decode`` for letters whose only run is the two at ``at``: the two paths differ by the next few letters."""
    numbers = [0, 0, 0, *map(fold, token), 0]
    once = numbers[at + 1 : at + 4] + numbers[at + 5 : at + 8]
    twice = numbers[at + 1 : at + 8]

    def score(path: list[int]) -> float:
        return sum(float(model[(path[i - 3] * LETTERS + path[i - 2]) * LETTERS + path[i - 1]][path[i]]) for i in range(3, len(path)))

    keep = score(twice) + 2 * AS_IS > score(once) + 2 * REPEATED
    return token if keep else token[:at] + token[at + 1 :]


class Restorer:
    """Restores obfuscated tokens of whole texts; decoded tokens are remembered."""

    def __init__(self, model: np.ndarray):
        # Lists give single numbers faster than arrays.
        self.model, self.known = model.tolist(), {}
        self.inside: tuple[str, Iterator[re.Match], int, int] | None = None

    def _addressed(self, text: str, at: int) -> bool:
        """Whether a place lies inside an address or number of the text; places of one text come in order."""
        if self.inside is None or self.inside[0] is not text:
            self.inside = (text, _ADDRESS.finditer(text), 0, 0)
        _, more, start, end = self.inside
        while end <= at and (found := next(more, None)):
            start, end = found.span()
        self.inside = (text, more, start, end)
        return start < at < end

    def _restored(self, match: re.Match) -> str:
        if match[2] and not any(map(str.isalpha, match[0])):
            return match[0]
        if match.start() and match.string[match.start() - 1] == "." and self._addressed(match.string, match.start()):
            return match[0]
        token = match[0].lower()
        if len(token) > LONGEST:
            return decode(token, self.model)
        if token not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            double = _DOUBLE.search(token) if token.isalpha() else None
            if double and not _DOUBLE.search(token, double.start() + 1):
                self.known[token] = decode_double(token, double.start(), self.model)
            else:
                self.known[token] = decode(token, self.model)
        return self.known[token]

    def restore(self, text: str | None) -> str:
        self.inside = None
        return _SUSPECT.sub(self._restored, text) if text else ""


def features(text: str) -> set[str]:
    """Restored text as a set: its words, and their first four and five letters (marked)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:4] + "+" for w in words if len(w) > 4} | {w[:5] + "+" for w in words if len(w) > 5}


@dataclass(frozen=True)
class Scorer:
    """Logistic score over the chosen features' presence."""

    weights: dict[str, float]
    bias: float

    def score(self, restored: str) -> float:
        found = self.bias + sum(self.weights[f] for f in features(restored) if f in self.weights) if restored else self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, found))))


def _spread(model: np.ndarray):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in slices(batches, "_text"):
            found = [sorted(features(restorer.restore(t))) for t in batch.column("_text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(at), batch.column("_label").take(at), pa.array([x for f in found for x in f], pa.string())],
                names=["_row", "_label", "feature"],
            )

    return spread


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, n: int, penalty: float = 1.0, sweeps: int = 60) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression on binary features by coordinate descent with bounded Newton steps."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if len(owner) else np.empty(0, np.int64)
    order = np.argsort(column, kind="stable")
    holders = np.split(owner[order], np.cumsum(np.bincount(column, minlength=n))[:-1]) if n else []
    weight, reach = np.zeros(n), np.ones(n)
    bias = math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    margin = np.full(len(rows), bias)
    for _ in range(sweeps):
        largest = 0.0
        for j, at in enumerate(holders):
            if not len(at):
                continue
            p = 1 / (1 + np.exp(-margin[at]))
            slope, bend = (p - labels[at]).sum(), max((p * (1 - p)).sum(), 0.01 * len(at))
            goal = weight[j] - slope / bend
            new = math.copysign(max(abs(goal) - penalty / bend, 0.0), goal)
            step = max(-reach[j], min(reach[j], new - weight[j]))
            reach[j] = max(2 * abs(step), reach[j] / 2)
            if step:
                weight[j] += step
                margin[at] += step
                largest = max(largest, abs(step))
        p = 1 / (1 + np.exp(-margin))
        step = max(-1.0, min(1.0, -(p - labels).sum() / max((p * (1 - p)).sum(), 1e-3)))
        bias, margin = bias + step, margin + step
        if max(largest, abs(step)) < 1e-3:
            break
    return weight, float(bias)


def learn(
    docs: DataFrame, labels: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, most: int = FEATURES,
) -> Scorer:
    """Fit the scorer on at most ``sample_rows`` labelled documents, chosen by a hash of their ids.

    Features are the ``most`` that tell the labels of the sample apart best (likelihood ratio); documents with the same text
    count once. Ids only choose and join rows. NULL ids, labels and texts teach nothing. Without both
    labels in the sample the score is the share of label 1.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max(F.col(label).cast("int")).alias("_label")
    )
    chosen = stage(chosen.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows), "labelled-sample")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    rows = rows.join(small(chosen), F.col("_id") == F.col("_key"))
    rows = rows.groupBy(F.xxhash64("_text").alias("_row")).agg(F.max("_label").alias("_label"), F.first("_text").alias("_text"))
    rows = stage(rows, "labelled-texts")
    size = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Scorer({}, 0.0 if pos == neg else math.copysign(4.0, pos - neg))
    seen = stage(rows.mapInArrow(_spread(model), "_row long, _label int, feature string"), "label-features")
    by = seen.groupBy("feature").agg(F.sum("_label").alias("p"), F.sum(1 - F.col("_label")).alias("n"))
    p, n = F.col("p") + 0.5, F.col("n") + 0.5
    a, b = F.lit(float(pos)), F.lit(float(neg))
    gain = F.abs(p * F.log((p / (p + n)) / (a / (a + b))) + n * F.log((n / (p + n)) / (b / (a + b))))
    best = by.where(F.col("p") + F.col("n") >= 3).orderBy(gain.desc(), "feature").limit(most).select("feature")
    best = stage(best, "best-features")
    found = seen.join(small(best), "feature", "left_semi").groupBy(F.col("_row").alias("_r")).agg(F.collect_list("feature").alias("_found"))
    held = rows.select("_row", "_label").join(found, F.col("_row") == F.col("_r"), "left").orderBy("_row").collect()
    names = sorted(r["feature"] for r in best.collect())
    number = {f: i for i, f in enumerate(names)}
    rows_ = [np.array(sorted(number[f] for f in r["_found"] or ()), dtype=np.int64) for r in held]
    weight, bias = fit_logistic(rows_, np.array([r["_label"] for r in held], dtype=np.float64), len(names))
    return Scorer({f: float(w) for f, w in zip(names, weight) if w}, bias)


def _score(model: np.ndarray, scorer: Scorer):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in slices(batches, "_text"):
            restored = [restorer.restore(t) for t in batch.column("_text").to_pylist()]
            scores = [scorer.score(t) for t in restored]
            kept = [batch.column(c) for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(restored, pa.string()), pa.array(scores, pa.float64())],
                names=[*[c for c in batch.schema.names if c != "_text"], "restored", "score"],
            )

    return score


def _pass_clean(model: np.ndarray, scorer: Scorer, column: str, limit: float):
    def pass_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in slices(batches, column):
            texts = batch.column(column).to_pylist()
            yield batch.filter(pa.array([scorer.score(restorer.restore(t)) < limit for t in texts], pa.bool_()))

    return pass_clean


def drop_toxic(docs: DataFrame, model: np.ndarray, scorer: Scorer, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows with a score below ``limit``, all columns; the rest as for ``toxicity``."""
    return docs.mapInArrow(_pass_clean(model, scorer, text, limit), docs.schema)


def toxicity(
    docs: DataFrame, model: np.ndarray, scorer: Scorer, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per input row: ``key, restored, score``.

    Obfuscated tokens of the whole text (symbols for letters, letters repeated or spaced out) are decoded under the
    character language model; the restored text is scored. NULL and empty texts get the score of no
    evidence. Repeated rows get the same score each; an empty table gives an empty result; other columns
    play no part.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    scored = rows.mapInArrow(_score(model, scorer), f"_id {kind}, restored string, score double")
    return scored.withColumnRenamed("_id", key)
