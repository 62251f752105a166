"""Capital ratios, headroom, bands and buffers over a total RWA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Measure, default capital ($M), regulatory floor (%).
MEASURES = (("CET1", 5.0, 4.5), ("Tier 1", 6.5, 6.0), ("Total", 8.0, 8.0))
FALLBACK_RWA_M = 22.0


def _measures(capital: dict[str, float] | None) -> Column:
    given = capital or {}
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("measure"),
                F.lit(float(given.get(name, default))).alias("capital_m"),
                F.lit(floor).alias("floor"),
            )
            for name, default, floor in MEASURES
        ]
    )


def _expanded(
    total_rwa: DataFrame, keys: list[str], capital: dict[str, float] | None, fallback_rwa_m: float
) -> DataFrame:
    """One row per measure. ``total_rwa`` holds ``rwa_amount``, one row per key."""
    rwa_m = F.when(F.col("rwa_amount") > 0, F.col("rwa_amount") / 1e6).otherwise(F.lit(fallback_rwa_m))
    rows = total_rwa.select(*keys, rwa_m.alias("rwa_m"), F.inline(_measures(capital)))
    ratio = F.when(F.col("rwa_m") > 0, F.col("capital_m") / F.col("rwa_m") * 100).otherwise(F.lit(0.0))
    return rows.withColumn("ratio", ratio).withColumn("headroom", F.col("ratio") - F.col("floor"))


def capital_ratios(
    total_rwa: DataFrame,
    keys: list[str] | None = None,
    capital: dict[str, float] | None = None,
    fallback_rwa_m: float = FALLBACK_RWA_M,
) -> DataFrame:
    band = (
        F.when(F.col("ratio") < F.col("floor"), "red")
        .when(F.col("ratio") <= F.col("floor") * 1.5, "amber")
        .otherwise("green")
    )
    return _expanded(total_rwa, keys or [], capital, fallback_rwa_m).select(
        *(keys or []), "measure", "capital_m", "rwa_m", "ratio", "floor", "headroom", band.alias("band")
    )


def capital_buffers(
    total_rwa: DataFrame,
    keys: list[str] | None = None,
    capital: dict[str, float] | None = None,
    fallback_rwa_m: float = FALLBACK_RWA_M,
) -> DataFrame:
    buffer = F.col("capital_m") - F.col("rwa_m") * (F.col("floor") / 100)
    return _expanded(total_rwa, keys or [], capital, fallback_rwa_m).select(
        *(keys or []), "measure", buffer.alias("buffer_m"), "headroom"
    )
