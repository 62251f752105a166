"""Personal data: candidate spans from high-recall generators, selected by boosted trees with calibrated thresholds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.boosting import TREES, Trees, fit, matrix, placed, quantile_cuts
from capledger.llm.shingles import slices
from capledger.operators.ordered import running
from capledger.session import stage

# Kinds in the order of listing, and the shapes of the base spans.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# No shape crosses a line, and each holds one of these.
DIGIT, SIGN, SPELLED = re.compile(r"[0-9]"), re.compile(r"@|[(\[]at"), re.compile(r" dot ")
# Wider shapes, which may overlap.
WIDE = (
    (0, SIGN, re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+")),
    (0, SPELLED, re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+")),
    (1, DIGIT, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ ]?(?:\[\.\]|\(\.\)|[.,])[ ]?[0-9]{1,3}){3}(?![0-9.])")),
    (2, DIGIT, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{0,2}[0-9]{2,6}){2,4}(?![0-9])")),
    (3, DIGIT, re.compile(r"(?<![0-9])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[ ./-]{1,2}[(]?[0-9]{2,4}[)]?){1,4}(?![0-9])")),
)

# A kind's threshold is the least one with this precision on the texts that were held out.
PRECISION = 0.98

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes(kind: int, text: str) -> bool:
    """The check that goes with a shape."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = _digits(text) if kind > 1 else ""
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 8 <= len(digits) <= 15


def lines_with(mark: re.Pattern, text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines that hold a mark."""
    found, at = [], 0
    while match := mark.search(text, at):
        at = text.find("\n", match.end())
        at = len(text) if at < 0 else at
        found.append((text.rfind("\n", 0, match.start()) + 1, at))
    return found


def shaped(text: str) -> Iterator[Span]:
    """(kind, start, end) of every leftmost match of a base shape, whether it passes its check or not."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))
    lines = lines_with(DIGIT, text)
    for kind, shape in ((1, IP), (2, CARD), (3, PHONE)):
        for first, last in lines:
            for match in shape.finditer(text, first, last):
                yield kind, match.start(), match.end()


def base_spans(text: str) -> list[Span]:
    """Base spans, by kind and start."""
    return [s for s in shaped(text) if passes(s[0], text[s[1] : s[2]])]


def candidates(text: str) -> list[Span]:
    """Spans proposed by all generators, each once; they may overlap."""
    found = set(shaped(text))
    lines = {mark: lines_with(mark, text) for mark in (DIGIT, SIGN, SPELLED)}
    for kind, mark, shape in WIDE:
        for first, last in lines[mark]:
            found.update((kind, m.start(), m.end()) for m in shape.finditer(text, first, last))
    return sorted(found)


def _side(c: str) -> float:
    if not c:
        return 0.0
    return 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate; what the base shapes insist on is not among it."""
    kind, start, end = span
    body = text[start:end]
    groups = re.findall(r"[0-9]+", body)
    sizes = [len(g) for g in groups] or [0]
    letters = sum(c.isalpha() for c in body)
    digits = sum(sizes)
    before, after = text[max(0, start - 12) : start], text[end : end + 12]
    return [
        float(kind),
        float(len(body)),
        float(digits),
        float(letters),
        float(len(groups)),
        float(max(sizes)),
        float(min(sizes)),
        float(sizes[-1]),
        float(len(set(body) - set("0123456789") - {c for c in body if c.isalpha()})),
        float(bool(digits) and luhn("".join(groups))),
        float(sum(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(max((len(x) for x in re.split(r"[^A-Za-z]+", body)), default=0)),
        _side(before[-1:]),
        _side(after[:1]),
        float(sum(c.isdigit() for c in before)),
        float(sum(c.isdigit() for c in after)),
        float(sum(c in "=:\"'" for c in before)),
    ]


@dataclass(frozen=True)
class Selector:
    """Trees and a threshold per kind."""

    trees: Trees
    thresholds: tuple[float, ...]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates at or above their kind's threshold that overlap no base span, likeliest first wins."""
        open_ = [s for s in candidates(text) if not any(s[1] < b[2] and b[1] < s[2] for b in base)] if text else []
        if not open_:
            return []
        p = self.trees.probability(np.array([describe(text, s) for s in open_]))
        taken: list[Span] = []
        for i in sorted(range(len(open_)), key=lambda i: (-p[i], open_[i])):
            s = open_[i]
            if p[i] >= self.thresholds[s[0]] and not any(s[1] < t[2] and t[1] < s[2] for t in taken):
                taken.append(s)
        return taken


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with a known answer: base spans, and shapes or wide spans that fail their kind's check."""
    for batch in slices(batches, "_text"):
        place, label, rows = [], [], []
        for order, text in zip(batch.column("_order").to_pylist(), batch.column("_text").to_pylist()):
            base = set(base_spans(text))
            for nth, span in enumerate(candidates(text)):
                good = span in base
                if good or not passes(span[0], text[span[1] : span[2]]):
                    if good or not any(span[1] < b[2] and b[1] < span[2] for b in base):
                        place.append((order, nth))
                        label.append(int(good))
                        rows.append(describe(text, span))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in place], pa.binary()), pa.array([p[1] for p in place], pa.int32()), pa.array(label, pa.int32()),
                pa.array(rows, pa.list_(pa.float64())),
            ],
            names=["_order", "nth", "label", "x"],
        )


def _probability(trees: Trees, width: int):
    def probability(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = trees.probability(matrix(batch.column("x"), width))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("label"), batch.column("n"), pa.array(p)], names=["kind", "label", "n", "p"])

    return probability


def _thresholds(held: DataFrame, trees: Trees, width: int) -> tuple[float, ...]:
    """Per kind the least probability, 0.5 at least, from which on upwards so many held-out candidates are good as ``PRECISION`` asks."""
    scored = held.select("kind", "label", "n", "x").mapInArrow(_probability(trees, width), "kind int, label int, n long, p double")
    levels = scored.groupBy("kind", (-F.col("p")).alias("down")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good"))
    above = running(levels, ["kind"], ["down"], {"all_above": ("sum", F.col("n")), "good_above": ("sum", F.col("good"))})
    enough = above.where(F.col("good_above") / F.col("all_above") >= PRECISION)
    least = {r["kind"]: -r["down"] for r in enough.groupBy("kind").agg(F.max("down").alias("down")).collect()}
    return tuple(max(least[k], 0.5) if k in least else float("inf") for k in range(len(KINDS)))


def learn(docs: DataFrame, text: str = "text", trees: int = TREES) -> Selector:
    """Fit trees and thresholds on the candidates of all distinct texts.

    Base spans are the positive examples, candidates that fail their kind's check the negative ones;
    candidates of other forms have no known answer and are what the trees decide. A fifth of the texts, by their
    digest, is held out to set each kind's threshold; a kind without positive examples there adds nothing. Examples stay
    tables: equal ones are counted, and what comes to the driver are cuts, sums by node, feature and bin, and thresholds.
    """
    rows = docs.select(F.col(text).alias("_text"), F.unhex(F.md5(F.col(text))).alias("_order")).where("_text IS NOT NULL")
    made = rows.mapInArrow(_examples, "_order binary, nth int, label int, x array<double>")
    once = made.groupBy("_order", "nth").agg(F.first("label").alias("label"), F.first("x").alias("x"))
    held = (F.pmod(F.xxhash64("_order"), F.lit(5)) == 0).alias("held")
    counted = once.select("x", "label", held).groupBy("x", "label", "held").agg(F.count("*").alias("n"))
    examples = stage(counted.withColumn("kind", F.col("x")[0].cast("int")), "pii-examples")
    width = len(describe("", (0, 0, 0)))
    cuts = quantile_cuts(examples.where("NOT held"), width)
    vectors = stage(placed(examples, cuts), "pii-vectors")
    real, binned = fit(vectors.where("NOT held"), cuts, trees)
    return Selector(real, _thresholds(vectors.where("held"), binned, width))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _find(selector: Selector):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            base = [base_spans(t) if t else [] for t in batch.column("_text").to_pylist()]
            every = [b + selector.added(t or "", b) for t, b in zip(batch.column("_text").to_pylist(), base)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *counts, pa.array(map(listed, base), pa.string()), pa.array(map(listed, every), pa.string())],
                names=["_id", *[f"n_{k}" for k in KINDS], "base_spans", "spans"],
            )

    return find


def find_pii(docs: DataFrame, selector: Selector, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: ``key, n_email, n_ip, n_card, n_phone, base_spans, spans``.

    Counts are of base spans. ``spans`` has them and what the trees add, as ``kind:start:end`` by kind and start
    in code points, the end exclusive. NULL and empty texts have none. Repeated rows get the same answer
    each; an empty table gives an empty result; other columns play no part.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"_id {dict(rows.dtypes)['_id']}, {counts}, base_spans string, spans string"
    return rows.mapInArrow(_find(selector), schema).withColumnRenamed("_id", key)


def redact(text: str, spans: str) -> str:
    """Text with each listed span replaced by its kind in brackets; of overlapping spans the first by start, then the longest."""
    out, end = [], 0
    cut = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    for start, stop, kind in cut:
        if start >= end:
            out += [text[end:start], f"[{kind}]"]
            end = -stop
    return "".join([*out, text[end:]])
