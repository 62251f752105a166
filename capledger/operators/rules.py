"""Rules as data: overlay of versions, and risk-weighted amounts from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.session import stage

# Blocks that the thresholds of a class are cut into.
BLOCKS = 128

# A mapping or an exclusion answers how a class is treated; exclusion wins a tie, then the larger weight.
_TREATMENT = (
    "IF(kind IN ('mapping', 'exclusion'),"
    " named_struct('p', precedence, 'x', kind = 'exclusion', 'w', risk_weight, 'b', risk_bucket), NULL)"
)


def effective_rules(rules: DataFrame) -> DataFrame:
    """One row per (policy_version, asset_class) from rule rows with a ``precedence``.

    The higher precedence wins per kind; a class the update does not mention keeps
    its baseline rule. Mapping and exclusion answer the same question, so the later
    one wins, and an exclusion beats a mapping of the same version. Of two rows with one
    question and layer (see ``duplicate_rules``) the larger value wins, whatever their
    order. ``definition`` rows label a class and change nothing.
    """
    return (
        rules.groupBy("policy_version", "asset_class")
        .agg(
            F.expr(f"max_by(kind, {_TREATMENT}) AS treatment"),
            F.expr(f"max_by(risk_bucket, {_TREATMENT}) AS risk_bucket"),
            F.expr(f"max_by(risk_weight, {_TREATMENT}) AS base_weight"),
            F.expr(f"max_by(origin, {_TREATMENT}) AS origin"),
            F.expr("max_by(min_amount, IF(kind = 'threshold', named_struct('p', precedence, 'v', min_amount), NULL)) AS min_amount"),
            F.expr("max_by(multiplier, IF(kind = 'calculation', named_struct('p', precedence, 'v', multiplier), NULL)) AS multiplier"),
        )
        .where("treatment IS NOT NULL")
        .selectExpr(
            "policy_version",
            "asset_class",
            "risk_bucket",
            "CAST(base_weight * coalesce(multiplier, CAST(1 AS DECIMAL(7,4))) AS DECIMAL(9,6)) AS risk_weight",
            "min_amount",
            "treatment = 'exclusion' AS excluded",
            "origin",
        )
    )


def layered(stored: DataFrame, baselines: DataFrame, delta: DataFrame) -> DataFrame:
    """Rule rows of new versions: the rows of the baseline each supersedes, if it has an
    approved one, with the new version's own rows as one more layer on top.

    ``stored`` has rule rows by ``sql_version_id`` with their ``precedence``;
    ``baselines`` maps ``policy_version_id`` to ``baseline_sql_version_id``; ``delta``
    has rule rows by ``policy_version``.
    """
    wanted = baselines.select(
        F.col("policy_version_id").alias("policy_version"), F.col("baseline_sql_version_id").alias("sql_version_id")
    ).join(delta.select("policy_version").distinct(), "policy_version", "left_semi")
    columns = ["policy_version", "kind", "asset_class", "risk_bucket", "risk_weight", "min_amount", "multiplier"]
    base = stored.drop("policy_version").join(wanted, "sql_version_id").select(
        *columns, "precedence", F.lit("V1").alias("origin")
    )
    top = base.groupBy("policy_version").agg((F.max("precedence") + 1).alias("top"))
    update = delta.join(top, "policy_version", "left").select(
        *columns, F.coalesce("top", F.lit(0)).alias("precedence"),
        F.when(F.col("top").isNull(), "V1").otherwise("V2").alias("origin"),
    )
    return base.unionByName(update)


def overlay(base: DataFrame, delta: DataFrame, policy_version: str) -> DataFrame:
    """Composite rules: the delta over the base, complete on its own."""
    layers = base.withColumns({"precedence": F.lit(0), "origin": F.lit("V1")}).unionByName(
        delta.withColumns({"precedence": F.lit(1), "origin": F.lit("V2")})
    )
    return effective_rules(layers.withColumn("policy_version", F.lit(policy_version)))


def alone(rules: DataFrame, policy_version: str) -> DataFrame:
    return effective_rules(
        rules.withColumns(
            {"precedence": F.lit(0), "origin": F.lit("V1"), "policy_version": F.lit(policy_version)}
        )
    )


def rule_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed per asset class between two effective rule sets."""
    side = lambda df, p: df.where(~F.col("excluded")).select(
        "asset_class",
        F.col("risk_bucket").alias(f"{p}_bucket"),
        F.col("risk_weight").alias(f"{p}_weight"),
        F.lit(True).alias(f"in_{p}"),
    )
    changed = ~(F.col("old_bucket").eqNullSafe(F.col("new_bucket")) & F.col("old_weight").eqNullSafe(F.col("new_weight")))
    return (
        side(old, "old")
        .join(side(new, "new"), "asset_class", "full_outer")
        .select(
            "asset_class",
            F.when(F.col("in_old").isNull(), "added")
            .when(F.col("in_new").isNull(), "removed")
            .when(changed, "changed")
            .otherwise("same")
            .alias("change"),
            "old_bucket",
            "new_bucket",
            F.col("old_weight").cast("double").alias("old_weight"),
            F.col("new_weight").cast("double").alias("new_weight"),
        )
    )


def reached(cuts: Column, amount: Column) -> Column:
    """How many of the sorted ``cuts`` an amount reaches, by binary search; 0 for a NULL amount."""
    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))

    def halve(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = F.shiftright(low + high, 1)
        up = F.struct((middle + 1).alias("low"), high.alias("high"))
        down = F.struct(low.alias("low"), middle.alias("high"))
        return F.when(low >= high, range_).when(F.coalesce(F.get(cuts, middle) <= amount, F.lit(False)), up).otherwise(down)

    return F.aggregate(steps, start, halve, lambda range_: range_["low"])


def banded(exposures: DataFrame, rules: DataFrame) -> DataFrame:
    """Exposures with ``band``: the highest threshold of their class that the amount reaches.

    The thresholds of a class are cut into at most ``BLOCKS`` + 1 blocks at approximate quantiles. An exposure carries the
    borders of its class, finds its block among them and the band among the block's thresholds, both by binary
    search; so it never meets all thresholds of its class, however many there are and wherever they lie. A block that
    holds none below the amount takes the highest one before it.
    """
    cuts = rules.where(F.col("min_amount").isNotNull() & F.col("asset_class").isNotNull()).select("asset_class", "min_amount").distinct()
    quantiles = F.percentile_approx("min_amount", [i / BLOCKS for i in range(1, BLOCKS)], 100 * BLOCKS)
    borders = cuts.groupBy("asset_class").agg(F.array_sort(F.array_distinct(quantiles)).alias("borders"))
    borders = stage(borders, "threshold-borders")
    placed = cuts.join(borders, "asset_class").withColumn("block", reached(F.col("borders"), F.col("min_amount")))
    held = placed.groupBy("asset_class", "block").agg(F.array_sort(F.collect_list("min_amount")).alias("cuts"))
    every = borders.select("asset_class", F.explode(F.sequence(F.lit(0), F.size("borders"))).alias("block"))
    before = Window.partitionBy("asset_class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = every.join(held, ["asset_class", "block"], "left").withColumn("below", F.max(F.array_max("cuts")).over(before))
    blocks = stage(blocks, "threshold-blocks")
    amount = F.col("exposure_amount")
    found = exposures.join(borders, "asset_class", "left").withColumn("block", F.when(F.col("borders").isNotNull(), reached(F.col("borders"), amount)))
    found = found.drop("borders").join(blocks, ["asset_class", "block"], "left")
    highest = F.get("cuts", reached(F.col("cuts"), amount) - 1)
    return found.withColumn("band", F.when(amount.isNotNull(), F.coalesce(highest, "below"))).drop("block", "cuts", "below")


def position_cube(exposures: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Exposures summed to (portfolio, asset_class, band).

    A weight is constant per class, so sum(amount * weight) = sum(amount) * weight
    exactly in decimals: the facts are read and reduced once, and any number of
    rule versions joins the small cube. Where ``rules`` have thresholds, ``band``
    keeps amounts on both sides of every threshold of the class apart.
    """
    if rules is None:
        rows = exposures.withColumn("band", F.lit(None).cast("decimal(18,2)"))
    else:
        rows = banded(exposures, rules)
    return rows.groupBy("portfolio", "asset_class", "band").agg(F.sum("exposure_amount").alias("amount"))


def weighted_cells(cube: DataFrame, rules: DataFrame) -> DataFrame:
    """RWA per (policy_version, portfolio, risk_bucket), still in exact decimals."""
    reaches = F.col("min_amount").isNull() | (F.col("band") >= F.col("min_amount"))
    return (
        cube.join(rules.where(~F.col("excluded")), "asset_class")
        .where(reaches)
        .groupBy("policy_version", "portfolio", "risk_bucket")
        .agg(F.sum(F.col("amount") * F.col("risk_weight")).alias("rwa_exact"))
    )


def rwa_by_policy_version(exposures: DataFrame, rules: DataFrame, thresholds: bool = False) -> DataFrame:
    cube = position_cube(exposures, rules if thresholds else None)
    return weighted_cells(cube, rules).select(
        "policy_version", "portfolio", "risk_bucket", F.col("rwa_exact").cast("double").alias("rwa_amount")
    )


def reconciliation(exposures: DataFrame, rules: DataFrame) -> DataFrame:
    """Per policy version: exposure total = mapped + below threshold + unmapped + excluded.

    Mapped is what ``rwa_by_policy_version`` with thresholds puts a weight on.
    ``without_portfolio`` is the part of the total that no order or customer claims,
    whatever its class. The total is taken once, and classes meet only their own rules.
    """
    by_class = (
        position_cube(exposures, rules)
        .groupBy("asset_class", "band")
        .agg(F.sum("amount").alias("amount"), F.sum(F.when(F.col("portfolio").isNull(), F.col("amount"))).alias("lost"))
    )
    by_class = stage(by_class, "class_amounts")  # read by the scalars as well
    all_amounts = by_class.agg(F.sum("amount").alias("total"), F.sum("lost").alias("lost"))
    reaches = F.col("min_amount").isNull() | F.coalesce(F.col("band") >= F.col("min_amount"), F.lit(False))
    status = F.when(F.col("excluded"), "excluded").when(reaches, "mapped").otherwise("below_threshold")
    zero = F.lit(0).cast("decimal(38,2)")
    ruled = (
        rules.select("policy_version", "asset_class", "min_amount", "excluded")
        .join(by_class, "asset_class", "left")
        .groupBy("policy_version")
        .agg(
            *[
                F.coalesce(F.sum(F.when(status == name, F.col("amount"))), zero).alias(name)
                for name in ("mapped", "below_threshold", "excluded")
            ]
        )
    )
    total = F.coalesce(all_amounts.select("total").scalar(), zero)
    lost = F.coalesce(all_amounts.select("lost").scalar(), zero)
    known = F.col("mapped") + F.col("below_threshold") + F.col("excluded")
    return ruled.select(
        "policy_version",
        total.cast("double").alias("exposure_total"),
        F.col("mapped").cast("double").alias("mapped"),
        F.col("below_threshold").cast("double").alias("below_threshold"),
        (total - known).cast("double").alias("unmapped"),
        F.col("excluded").cast("double").alias("excluded"),
        lost.cast("double").alias("without_portfolio"),
    )


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """Rule rows that answer one question of a class twice in the same layer of a version."""
    question = F.when(F.col("kind").isin("mapping", "exclusion"), "treatment").otherwise(F.col("kind"))
    return (
        rules.groupBy("policy_version", "asset_class", "precedence", question.alias("question"))
        .agg(F.count("*").alias("rules"))
        .where("rules > 1")
    )


def unmapped_classes(exposures: DataFrame, rules: DataFrame) -> DataFrame:
    return exposures.join(rules, "asset_class", "left_anti").select("asset_class").distinct()
