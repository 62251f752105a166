"""Small gradient-boosted trees on numeric features of a table: logistic loss, complete trees, quantile cuts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.operators.ordered import running

TREES, DEPTH, RATE, CUTS = 40, 3, 0.3, 16
# Least sum of curvatures in a leaf, and its shrinkage.
LEAST, SHRINK = 1.0, 1.0
# Slopes and curvatures are whole multiples of this, so sums are exact in any order, up to 2^39 rows.
UNIT = 2.0**-24


@dataclass(frozen=True)
class Trees:
    """Per tree and inner node a feature and cut, per leaf a value; node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def quantile_cuts(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Per feature the distinct values at ``CUTS`` equal steps of rank, over all rows ``x array<double>, n long``, ``n`` equal ones each."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    values = rows.select(F.posexplode("x").alias("feature", "value"), "n").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    ranks = F.array(*[F.lit(i * max(total - 1, 0) // CUTS).cast("long") for i in range(CUTS)])
    upto = running(values, ["feature"], ["value"], {"upto": ("sum", F.col("n"))})
    at = upto.where(F.exists(ranks, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
    found = at.select("feature", "value").collect()
    return [np.array(sorted(r["value"] for r in found if r["feature"] == f), dtype=np.float64) for f in range(width)]


def _place(cuts: list[np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.int32)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(cuts))
            kept = [c for c in batch.schema.names if c != "x"]
            lists = pa.ListArray.from_arrays(ends, pa.array(bins.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, *map(batch.column, kept)], names=["x", *kept])

    return place


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of so many numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def placed(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``rows`` with the number of cuts below each value in place of ``x``; equal rows are added up in ``n``."""
    others = [c for c in rows.columns if c not in ("x", "n")]
    kinds = dict(rows.dtypes)
    schema = ", ".join(["x array<int>", *[f"{c} {kinds[c]}" for c in others], "n long"])
    return rows.select("x", *others, "n").mapInArrow(_place(cuts), schema).groupBy("x", *others).agg(F.sum("n").alias("n"))


def _sums(trees: Trees, feature: np.ndarray, place: np.ndarray, level: int, width: int):
    """Slopes and curvatures by node of a level, feature and bin, one row per cell and task."""
    first = 2**level - 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, bend = (np.zeros((first + 1) * width * (CUTS + 1), dtype=np.int64) for _ in range(2))
        for batch in batches:
            x, n = matrix(batch.column("x"), width), batch.column("n").to_numpy()
            p = trees.probability(x)
            node, row = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
            for _ in range(level):
                node = 2 * node + 1 + (x[row, feature[node]] > place[node])
            cell = ((node - first)[:, None] * width + np.arange(width)) * (CUTS + 1) + x
            for total, value in ((slope, p - batch.column("label").to_numpy()), (bend, np.maximum(p * (1 - p), 1e-6))):
                np.add.at(total, cell, (np.rint(value / UNIT).astype(np.int64) * n)[:, None])
        some = np.flatnonzero(bend)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(slope[some]), pa.array(bend[some])], names=["cell", "slope", "bend"])

    return sums


def _split(g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float, tuple[float, ...]]:
    """(feature, bin, slope and curvature left and right) of the best cut of a node; all go left where none gains."""
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    whole_g, whole_h = g[0].sum(), h[0].sum()
    right_g, right_h = whole_g - left_g, whole_h - left_h
    gain = left_g**2 / (left_h + SHRINK) + right_g**2 / (right_h + SHRINK) - whole_g**2 / (whole_h + SHRINK)
    real = np.arange(CUTS) < np.array([len(c) for c in cuts])[:, None]
    gain[(left_h < LEAST) | (right_h < LEAST) | ~real] = 0
    f, k = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, k] <= 1e-9:
        return 0, np.inf, (whole_g, whole_h, 0.0, 0.0)
    return int(f), float(k), (left_g[f, k], left_h[f, k], right_g[f, k], right_h[f, k])


def fit(rows: DataFrame, cuts: list[np.ndarray], trees: int = TREES) -> tuple[Trees, Trees]:
    """Boosted trees for labels 0 and 1 from a written table ``x, label, n`` of ``placed`` rows, all of them: the trees for values
    and the same ones for bins. With no rows, or one label only, the constant share.

    Each level of a tree is a pass over the table, whose tasks hand on one row per node, feature and bin, a number
    that does not grow with the table.
    """
    width, inner, leaves = len(cuts), 2**DEPTH - 1, 2**DEPTH
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    n, good = sum(size.values()), size.get(1, 0)
    share = (good + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    features, places, values = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
    binned = Trees(base, features, places, values)
    for _ in range(trees if 0 < good < n else 0):
        feature, place, sides = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), []
        for level in range(DEPTH):
            if level and not np.isfinite(place[2 ** (level - 1) - 1 : 2**level - 1]).any():
                # No node above was split: all rows of each go left again.
                sides = [x for side in sides for x in (side, (0.0, 0.0))]
                continue
            made = rows.select("x", "label", "n").mapInArrow(_sums(binned, feature, place, level, width), "cell long, slope long, bend long")
            # So few rows need one task.
            found = made.repartition(1).groupBy("cell").agg(F.sum("slope").alias("slope"), F.sum("bend").alias("bend")).collect()
            g, h = np.zeros((2, 2**level, width, CUTS + 1))
            for r in found:
                g.flat[r["cell"]], h.flat[r["cell"]] = r["slope"] * UNIT, r["bend"] * UNIT
            sides = []
            for node in range(2**level):
                i = 2**level - 1 + node
                feature[i], place[i], side = _split(g[node], h[node], cuts)
                sides += [side[:2], side[2:]]
        value = np.array([-RATE * a / (b + SHRINK) for a, b in sides])
        binned = Trees(base, np.vstack((binned.feature, feature)), np.vstack((binned.cut, place)), np.vstack((binned.value, value)))
    real = np.array([[cuts[f][int(k)] if np.isfinite(k) else np.inf for f, k in zip(*tree)] for tree in zip(binned.feature, binned.cut)])
    return Trees(base, binned.feature, real.reshape(-1, inner), binned.value), binned
