"""Run-to-run comparison, waterfall, stress and analyst questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.functions.scalars import MIN_CAPITAL_RATIO, dbl, money_text, pct_change
from capledger.operators.ordered import running

# Lineage keys of a context bundle.
LINEAGE_KEYS = (
    "policy_id", "policy_version_id", "sql_version_id", "run_id", "run_status", "approved_by", "validation_status",
)

# Sums are held here so that one more subtraction or product stays exact in decimal(38).
EXACT = "decimal(34,8)"
PAIR = ["run_a", "run_b"]
# Rows that a task makes of its run pairs, about.
ROWS_A_TASK = 500_000
CELL = ["portfolio", "risk_bucket"]


def _sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and updated sums per cell from rows tagged ``side`` a / b.

    The outcome of a full outer join of both sides' sums in one aggregation. Like
    that join's ``=``, a NULL portfolio or bucket matches nothing, so such cells
    keep their side in the grouping key.
    """
    null_cell = F.col("portfolio").isNull() | F.col("risk_bucket").isNull()
    total = lambda side: F.coalesce(
        F.sum(F.when(F.col("side") == side, F.col("rwa_exact"))), F.lit(0)
    ).cast(EXACT)
    return (
        rows.withColumn("apart", F.when(null_cell, F.col("side")))
        .groupBy(*keys, *CELL, "apart")
        .agg(total("a").alias("baseline"), total("b").alias("updated"))
        .drop("apart")
        .withColumn("delta", F.col("updated") - F.col("baseline"))
    )


def compare_pair(outputs: DataFrame, run_a: str, run_b: str, run_column: str = "run_id") -> DataFrame:
    """Exact comparison cells of two runs; the run filter reaches the scan."""
    rows = outputs.where(F.col(run_column).isin(run_a, run_b))
    sides = F.when(F.lit(run_a) == F.lit(run_b), F.array(F.lit("a"), F.lit("b"))).otherwise(
        F.array(F.when(F.col(run_column) == run_a, "a").otherwise("b"))
    )
    tagged = rows.select(
        F.lit(run_a).alias("run_a"), F.lit(run_b).alias("run_b"), *CELL, "rwa_exact", F.explode(sides).alias("side")
    )
    return _sides(tagged, PAIR)


def run_pairs(runs: DataFrame, carry: Column | None = None) -> DataFrame:
    """Consecutive runs of each policy: baseline = the earlier run, updated = the next.

    ``carry`` is a value of a run that its pairs keep, as ``carry_a`` and ``carry_b``.
    """
    rows = runs.select("policy_id", "run_id", "started_at", *([] if carry is None else [carry.alias("carry")]))
    start = F.struct("started_at", "run_id", *rows.columns[3:])
    previous = running(
        rows,
        ["policy_id"],
        ["started_at", "run_id"],
        {"previous": ("max", start)},
        inclusive=False,
    )
    kept = [] if carry is None else [F.col("previous.carry").alias("carry_a"), F.col("carry").alias("carry_b")]
    return previous.where(F.col("previous").isNotNull()).select(
        "policy_id", F.col("previous.run_id").alias("run_a"), F.col("run_id").alias("run_b"), *kept
    )


def compare_versions(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Comparison cells of every distinct pair of rule versions in ``pairs`` (``carry_a``, ``carry_b``;
    NULL: a run without outputs). The versions stand in the run columns."""
    wanted = pairs.select(F.col("carry_a").alias("run_a"), F.col("carry_b").alias("run_b")).distinct()
    sides = "array(struct(run_a AS policy_version, 'a' AS side), struct(run_b AS policy_version, 'b' AS side))"
    tagged = wanted.select(*PAIR, F.inline(F.expr(sides))).join(cells, "policy_version")
    return _sides(tagged, PAIR)


def for_runs(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Results of version pairs for every run pair that ran those versions. ``results`` should be a
    written table: it is small, and its exact size lets Catalyst broadcast it.

    A few version pairs have many results each, so the few MB of ``pairs``, a written table too, are dealt out by the
    rows that come of them, to ``spark.sql.shuffle.partitions`` tasks at most."""
    named = results.withColumnsRenamed({"run_a": "_version_a", "run_b": "_version_b"})
    same = F.col("carry_a").eqNullSafe(F.col("_version_a")) & F.col("carry_b").eqNullSafe(F.col("_version_b"))
    rest = [c for c in results.columns if c not in PAIR]
    most = results.groupBy(*PAIR).count().agg(F.max("count")).first()[0] or 0
    tasks = min(pairs.count() * most // ROWS_A_TASK + 1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartition(tasks, *PAIR) if tasks > 1 else pairs
    return dealt.join(named, same).select("policy_id", *PAIR, *rest)


def pair_members(pairs: DataFrame) -> DataFrame:
    """Each run with every pair it is in and its side there: two pairs at most."""
    return pairs.select(
        *PAIR,
        F.inline(F.expr("array(struct(run_a AS run_id, 'a' AS side), struct(run_b AS run_id, 'b' AS side))")),
    )


def compare_tagged(rows: DataFrame) -> DataFrame:
    """Comparison cells of every pair from output rows that carry ``policy_id``, their pair
    and their side. Tag runs before stamping outputs where both are possible: runs are
    fewer by the number of cells."""
    return _sides(rows, ["policy_id", *PAIR])


def compare_consecutive(outputs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Comparison cells of every pair from stored outputs."""
    return compare_tagged(outputs.join(pair_members(pairs), "run_id"))


def published(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(
        *keys,
        *CELL,
        dbl("baseline").alias("rwa_baseline"),
        dbl("updated").alias("rwa_updated"),
        dbl("delta").alias("rwa_delta"),
    )


def rwa_comparison(cells: DataFrame) -> DataFrame:
    return published(cells, []).orderBy(*CELL)


def totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*PAIR).agg(
        *[F.sum(c).cast(EXACT).alias(c) for c in ("baseline", "updated", "delta")]
    )


def comparison_summary(cells: DataFrame) -> DataFrame:
    return totals(cells).select(
        *PAIR,
        dbl("baseline").alias("total_baseline"),
        dbl("updated").alias("total_updated"),
        dbl("delta").alias("total_delta"),
        pct_change(dbl("baseline"), dbl("delta")).alias("pct_change"),
        money_text(dbl("updated")).alias("total_updated_text"),
    )


def delta_waterfall(cells: DataFrame) -> DataFrame:
    """Relative steps in cell order with their running total, then the total bar.

    The window holds one pair's cells (portfolios x buckets, already summed).
    """
    upto = Window.partitionBy(*PAIR).orderBy(*CELL).rowsBetween(Window.unboundedPreceding, 0)
    steps = cells.select(
        *PAIR,
        F.concat_ws(" / ", *CELL).alias("label"),
        dbl("delta").alias("rwa_delta"),
        dbl(F.sum("delta").over(upto)).alias("running_total"),
        F.lit("relative").alias("measure"),
    )
    total = totals(cells).select(
        *PAIR,
        F.lit("Total").alias("label"),
        dbl("delta").alias("rwa_delta"),
        dbl("delta").alias("running_total"),
        F.lit("total").alias("measure"),
    )
    return steps.unionByName(total)


def _multipliers() -> Column:
    """1.1 to 3.0 by 0.1 as decimals; 1.0 means no stress and is not emitted."""
    return F.transform(F.sequence(F.lit(11), F.lit(30)), lambda n: (n / F.lit(10)).cast("decimal(3,1)"))


def stress_grid(cells: DataFrame) -> DataFrame:
    grid = totals(cells).withColumn("multiplier", F.explode(_multipliers()))
    stressed = F.col("updated") * F.col("multiplier")
    added = F.col("updated") * (F.col("multiplier") - F.lit(1).cast("decimal(3,1)"))
    return grid.select(
        *PAIR,
        dbl("multiplier").alias("multiplier"),
        dbl(stressed).alias("stressed_rwa"),
        (dbl(added) * MIN_CAPITAL_RATIO).alias("incremental_capital"),
    )


def stress_by_bucket(cells: DataFrame) -> DataFrame:
    return cells.withColumn("multiplier", F.explode(_multipliers())).select(
        *PAIR,
        *CELL,
        dbl("multiplier").alias("multiplier"),
        dbl("baseline").alias("rwa_baseline"),
        dbl("updated").alias("rwa_updated"),
        dbl(F.col("updated") * F.col("multiplier")).alias("rwa_stressed"),
    )


def top_portfolios(weighted: DataFrame) -> DataFrame:
    by_portfolio = weighted.groupBy("policy_version", "portfolio").agg(F.sum("rwa_exact").alias("rwa"))
    order = Window.partitionBy("policy_version").orderBy(F.desc("rwa"))
    return by_portfolio.select(
        "policy_version", "portfolio", dbl("rwa").alias("rwa_amount"), F.rank().over(order).cast("bigint").alias("rnk")
    )


def delta_drivers(cells: DataFrame) -> DataFrame:
    """Cells ranked by the size of their change, with their share of the net change."""
    pair = Window.partitionBy(*PAIR)
    net = F.sum("delta").over(pair)
    return cells.select(
        *PAIR,
        *CELL,
        dbl("delta").alias("rwa_delta"),
        F.when(net == 0, F.lit(0.0)).otherwise(dbl("delta") / dbl(net)).alias("share_of_total"),
        F.rank().over(pair.orderBy(F.desc(F.abs("delta")))).cast("bigint").alias("rnk"),
    )


def top_drivers(cells: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` cells of each pair that change most, ties by portfolio and bucket; each task hands on no more than
    so many of a pair."""
    order = Window.partitionBy(*PAIR).orderBy(F.desc(F.abs("delta")), *CELL)
    ranked = cells.select(*PAIR, *CELL, "delta", F.row_number().over(order).alias("nth")).where(F.col("nth") <= most)
    return ranked.select(*PAIR, *CELL, dbl("delta").alias("rwa_delta"), "nth")


def bucket_sensitivity(cells: DataFrame) -> DataFrame:
    by_bucket = cells.groupBy(*PAIR, "risk_bucket").agg(
        *[F.sum(c).cast(EXACT).alias(c) for c in ("baseline", "updated", "delta")]
    )
    return by_bucket.select(
        *PAIR,
        "risk_bucket",
        dbl("baseline").alias("rwa_baseline"),
        dbl("updated").alias("rwa_updated"),
        pct_change(dbl("baseline"), dbl("delta")).alias("pct_change"),
    )


def context_bundle(cells: DataFrame, chain: DataFrame, metrics: DataFrame) -> DataFrame:
    """One JSON document per run pair: comparison cells, seven lineage keys of the
    updated run, and the dashboard metrics; amounts as plain numbers with four decimals.

    A list holds one pair's cells; the metrics come as one scalar.
    """
    amount = lambda c: F.col(c).cast("decimal(38,4)")
    cell = F.struct(*CELL, *[amount(c).alias(f"rwa_{c}") for c in ("baseline", "updated", "delta")])
    per_pair = cells.groupBy("policy_id", *PAIR).agg(F.sort_array(F.collect_list(cell)).alias("rwa_comparison"))
    lineage = chain.select(F.col("run_id").alias("run_b"), F.struct(*LINEAGE_KEYS).alias("lineage"))
    plain = [amount(c).alias(c) if kind == "double" else F.col(c) for c, kind in metrics.dtypes]
    return per_pair.join(lineage, "run_b", "left").select(
        "policy_id",
        *PAIR,
        F.to_json(
            F.struct("rwa_comparison", "lineage", metrics.select(F.struct(*plain)).scalar().alias("dashboard_metrics"))
        ).alias("context_json"),
    )
