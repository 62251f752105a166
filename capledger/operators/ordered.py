"""Running totals over ordered groups of any size.

Rows are range-partitioned by key and order, so that a key with a third of the table
spans many tasks. They accumulate inside their partition; what a key holds in earlier
partitions is one row per partition it crosses into, and is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.session import stage


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum`` / ``max`` columns per key in ``order``.

    A ``max`` over a struct that starts with the order columns is "the latest row where
    the value is set". NULL is a key like any other; NULL orders come first. With
    ``inclusive=False`` a row does not see itself. The ordered rows are written once,
    so that partition numbers hold for every reader.
    """
    apply = {"sum": F.sum, "max": F.max}
    placed = stage(
        df.select(*df.columns, *[expr.alias(f"_in_{n}") for n, (_, expr) in totals.items()])
        .repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id()),
        "ordered",
    )
    inside = (
        Window.partitionBy("_part", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    rows = placed.select(
        *df.columns,
        "_part",
        *[apply[kind](f"_in_{n}").over(inside).alias(f"_local_{n}") for n, (kind, _) in totals.items()],
    )

    along = Window.partitionBy(*keys).orderBy("_part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        placed.groupBy("_part", *keys)
        .agg(*[apply[kind](f"_in_{n}").alias(f"_in_{n}") for n, (kind, _) in totals.items()])
        .select(
            F.col("_part").alias("_in_part"),
            *[F.col(k).alias(f"_in_key_{i}") for i, k in enumerate(keys)],
            F.row_number().over(along).alias("_nth"),
            *[apply[kind](f"_in_{n}").over(before).alias(f"_carry_{n}") for n, (kind, _) in totals.items()],
        )
        .where("_nth > 1")
    )
    same = F.col("_part") == F.col("_in_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_in_key_{i}"))

    def combined(name: str, kind: str) -> Column:
        local, carry = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return F.greatest(local, carry)

    return rows.join(crossing, same, "left").select(
        *df.columns, *[combined(n, kind).alias(n) for n, (kind, _) in totals.items()]
    )


def latest(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per key: the values of its last row by ``order`` (NULL orders lose)."""
    ordering = F.struct(*order)
    return df.groupBy(key).agg(*[F.max_by(v, ordering).alias(v) for v in values])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
