import datetime as dt
import random
from decimal import Decimal

import pytest
from row_lists import rows
from pyspark.sql import functions as F

from capledger.operators import capital, compare, registry, rules
from capledger.sources import adapters
from capledger.sources.tables import literal_rows


@pytest.fixture(scope="module")
def seed(spark):
    """The seeded demo rows."""
    exposures = literal_rows(
        spark, "exposures",
        [
            ("Treasury_Book", "Sovereign", Decimal(20000000)),
            ("Treasury_Book", "Bank", Decimal(12000000)),
            ("Markets_Book", "Corporate", Decimal(15000000)),
        ],
    )
    mapping = adapters.rule_rows(
        spark,
        [
            "('mapping', 'Sovereign', 'Low', 0.20, NULL, NULL)",
            "('mapping', 'Bank', 'Medium', 0.50, NULL, NULL)",
            "('mapping', 'Corporate', 'High', 1.00, NULL, NULL)",
        ],
    )
    return exposures, mapping


def test_seed_amounts(seed):
    exposures, mapping = seed
    got = rows(rules.rwa_by_policy_version(exposures, rules.alone(mapping, "V1")))
    assert got == [
        ("V1", "Markets_Book", "High", 15e6),
        ("V1", "Treasury_Book", "Low", 4e6),
        ("V1", "Treasury_Book", "Medium", 6e6),
    ]


def _cells(seed):
    exposures, mapping = seed
    return rules.weighted_cells(rules.position_cube(exposures), rules.alone(mapping, "V1"))


def test_seed_capital(spark, seed):
    total = _cells(seed).agg(F.sum("rwa_exact").cast("double").alias("rwa_amount"))
    got = {r.measure: (r.ratio, r.headroom, r.band) for r in capital.capital_ratios(total).collect()}
    assert got == {"CET1": (20.0, 15.5, "green"), "Tier 1": (26.0, 20.0, "green"), "Total": (32.0, 24.0, "green")}
    buffers = {r.measure: r.buffer_m for r in capital.capital_buffers(total).collect()}
    assert buffers == pytest.approx({"CET1": 5 - 25 * 0.045, "Tier 1": 6.5 - 25 * 0.06, "Total": 8 - 25 * 0.08})


def test_capital_bands_and_fallback(spark):
    def bands(rwa, **capital_m):
        df = spark.createDataFrame([(rwa,)], "rwa_amount double")
        return {r.measure: (round(r.ratio, 6), r.band) for r in capital.capital_ratios(df, capital=capital_m or None).collect()}

    at_floor = bands(100e6, CET1=4.5)
    assert at_floor["CET1"] == (4.5, "amber")
    assert bands(100e6, CET1=6.75)["CET1"] == (6.75, "amber")  # exactly 1.5 x floor
    assert bands(100e6, CET1=6.8)["CET1"][1] == "green"
    assert bands(100e6, CET1=4.4)["CET1"][1] == "red"
    assert bands(0.0)["CET1"] == (round(5 / 22 * 100, 6), "green")  # no RWA: 22 $M stand in
    zero = spark.createDataFrame([(0.0,)], "rwa_amount double")
    assert {r.ratio for r in capital.capital_ratios(zero, fallback_rwa_m=0.0).collect()} == {0.0}


def test_seed_stress(seed):
    cells = _cells(seed).withColumn("run_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))))
    grid = {r.multiplier: (r.stressed_rwa, r.incremental_capital) for r in compare.stress_grid(compare.compare_pair(cells, "r1", "r2")).collect()}
    assert grid[1.5] == (37.5e6, 1e6)
    assert sorted(grid) == [round(1.1 + i / 10, 1) for i in range(20)]


def test_two_identical_runs_count_twice_only_in_parity_total(spark, seed):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [(f"r{i}", "p", "p-V1", "s", "succeeded", t + dt.timedelta(hours=i)) for i in (1, 2)],
        "run_id string, policy_id string, policy_version_id string, sql_version_id string, run_status string, started_at timestamp_ntz",
    )
    outputs = registry.stamp_outputs(runs, _cells(seed), F.lit("V1"), F.col("started_at"))
    empty = spark.createDataFrame([], "validation_status string")
    kpi = registry.dashboard_kpis(empty, empty, runs, registry.stored_amounts(outputs, runs)).first()
    assert (kpi.total_rwa, kpi.total_rwa_latest_run, kpi.successful_runs) == (50e6, 25e6, 2)
    assert (kpi.total_policies, kpi.approved_sql) == (0, 0)


def test_kpis_of_nothing_are_zero(spark):
    status = spark.createDataFrame([], "validation_status string")
    runs = spark.createDataFrame([], "run_id string, run_status string, started_at timestamp_ntz")
    outputs = spark.createDataFrame([], "run_id string, rwa_exact decimal(38,8)")
    assert tuple(registry.dashboard_kpis(status, status, runs, registry.stored_amounts(outputs, runs)).first()) == (0, 0, 0, 0.0, 0.0)


def _outputs(spark, data):
    return spark.createDataFrame(
        [(r, p, b, Decimal(v)) for r, p, b, v in data],
        "run_id string, portfolio string, risk_bucket string, rwa_exact decimal(34,8)",
    )


def test_comparison_like_a_full_outer_join(spark):
    df = _outputs(
        spark,
        [
            ("a", "P", "Low", 10), ("a", "P", "Low", 5), ("a", "P", "High", 7), ("a", "P", None, 1), ("a", None, "Low", 2),
            ("b", "P", "Low", 20), ("b", "Q", "Low", 3), ("b", "P", None, 4), ("c", "P", "Low", 100),
        ],
    )
    got = rows(compare.rwa_comparison(compare.compare_pair(df, "a", "b")))
    assert got == sorted(
        [
            ("P", "Low", 15.0, 20.0, 5.0), ("P", "High", 7.0, 0.0, -7.0), ("Q", "Low", 0.0, 3.0, 3.0),
            ("P", None, 1.0, 0.0, -1.0), ("P", None, 0.0, 4.0, 4.0), (None, "Low", 2.0, 0.0, -2.0),
        ],
        key=repr,
    )
    same = compare.compare_pair(df, "c", "c")
    assert rows(compare.published(same, [])) == [("P", "Low", 100.0, 100.0, 0.0)]


def test_consecutive_runs(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("p", "r1", t), ("p", "r3", t + dt.timedelta(days=2)), ("p", "r2", t + dt.timedelta(days=1)), ("q", "s1", t)],
        "policy_id string, run_id string, started_at timestamp_ntz",
    )
    pairs = compare.run_pairs(runs)
    assert rows(pairs) == [("p", "r1", "r2"), ("p", "r2", "r3")]
    outputs = _outputs(spark, [("r1", "P", "Low", 1), ("r2", "P", "Low", 4), ("r3", "P", "High", 9), ("s1", "P", "Low", 5)])
    outputs = outputs.join(runs.select("run_id", "policy_id"), "run_id")
    cells = compare.published(compare.compare_consecutive(outputs, pairs), ["policy_id", *compare.PAIR])
    assert rows(cells) == sorted(
        [
            ("p", "r1", "r2", "P", "Low", 1.0, 4.0, 3.0), ("p", "r2", "r3", "P", "Low", 4.0, 0.0, -4.0),
            ("p", "r2", "r3", "P", "High", 0.0, 9.0, 9.0),
        ],
        key=repr,
    )


def test_comparison_sums_and_waterfall_agree(spark, sf):
    from capledger.plans import catalogue

    cells = catalogue._comparison(spark, sf).cache()
    total = compare.comparison_summary(cells).first()
    wf = compare.delta_waterfall(cells)
    last = wf.where("measure = 'relative'").orderBy(F.desc("label")).first()
    bar = wf.where("measure = 'total'").first()
    assert total.total_delta == pytest.approx(total.total_updated - total.total_baseline)
    assert last.running_total == bar.rwa_delta == bar.running_total == total.total_delta


def test_summary_without_baseline(spark):
    cells = compare.compare_pair(_outputs(spark, [("b", "P", "Low", 1234)]), "a", "b")
    assert tuple(compare.comparison_summary(cells).first()) == ("a", "b", 0.0, 1234.0, 1234.0, 0.0, "$1,234")
    assert compare.bucket_sensitivity(cells).first().pct_change == 0.0
    assert compare.delta_drivers(compare.compare_pair(_outputs(spark, [("a", "P", "L", 1), ("b", "P", "L", 1)]), "a", "b")).first().share_of_total == 0.0


def test_overlay(spark):
    base = adapters.rule_rows(spark, [
        "('mapping', 'A', 'Low', 0.2, NULL, NULL)", "('mapping', 'B', 'Low', 0.2, NULL, NULL)",
        "('mapping', 'C', 'Low', 0.2, NULL, NULL)", "('exclusion', 'D', NULL, NULL, NULL, NULL)",
    ])
    delta = adapters.rule_rows(spark, [
        "('mapping', 'B', 'High', 1.0, NULL, NULL)", "('exclusion', 'C', NULL, NULL, NULL, NULL)",
        "('mapping', 'D', 'Medium', 0.5, NULL, NULL)", "('mapping', 'E', 'Low', 0.1, NULL, NULL)",
        "('definition', 'F', NULL, NULL, NULL, NULL)",
    ])
    got = {r.asset_class: (r.risk_bucket, r.excluded, r.origin) for r in rules.overlay(base, delta, "V2").collect()}
    assert got == {
        "A": ("Low", False, "V1"), "B": ("High", False, "V2"), "C": (None, True, "V2"),
        "D": ("Medium", False, "V2"), "E": ("Low", False, "V2"),
    }
    keep = lambda df: rows(df.select("asset_class", "risk_bucket", "risk_weight", "excluded"))
    assert keep(rules.overlay(base, base.limit(0), "V2")) == keep(rules.alone(base, "V1"))
    once = keep(rules.overlay(base, delta, "V2"))
    assert keep(rules.overlay(base.unionByName(delta.where("asset_class <> 'D'")).where("asset_class not in ('B', 'C') or risk_bucket = 'High' or kind = 'exclusion'"), delta, "V2")) == once


def test_layers_stack_over_three_versions(spark):
    def rows_of(version, *values):
        return adapters.rule_rows(spark, list(values)).withColumn("policy_version", F.lit(version))

    columns = ["sql_version_id", "policy_version", "kind", "asset_class", "risk_bucket", "risk_weight", "min_amount", "multiplier", "precedence", "origin"]
    v1 = rows_of("p1", "('mapping', 'A', 'Low', 0.2, NULL, NULL)", "('mapping', 'B', 'Low', 0.2, NULL, NULL)")
    stored = v1.withColumns({"sql_version_id": F.lit("s1"), "precedence": F.lit(0), "origin": F.lit("V1")}).select(columns)
    link = lambda version, sql: spark.createDataFrame([(version, sql)], "policy_version_id string, baseline_sql_version_id string")
    v2 = rules.layered(stored, link("p2", "s1"), rows_of("p2", "('mapping', 'B', 'High', 1.0, NULL, NULL)"))
    stored = stored.unionByName(v2.withColumn("sql_version_id", F.lit("s2")).select(columns))
    v3 = rules.layered(stored, link("p3", "s2"), rows_of("p3", "('exclusion', 'A', NULL, NULL, NULL, NULL)"))
    got = {r.asset_class: (r.risk_bucket, r.excluded) for r in rules.effective_rules(v3).collect()}
    assert got == {"A": (None, True), "B": ("High", False)}
    alone = rules.layered(stored, link("p9", "s2"), rows_of("p4", "('mapping', 'Z', 'Low', 0.2, NULL, NULL)"))
    assert [r.asset_class for r in alone.collect()] == ["Z"]


def test_rule_kinds_on_amounts(spark):
    exposures = literal_rows(spark, "exposures", [
        ("P", "A", Decimal("100.00")), ("P", "A", Decimal("99.99")), ("P", "B", Decimal("10.00")), ("P", "C", Decimal("7.00")),
        ("P", "X", Decimal("1.00")),
    ])
    rule_rows = adapters.rule_rows(spark, [
        "('mapping', 'A', 'Low', 0.5, NULL, NULL)", "('threshold', 'A', NULL, NULL, 100, NULL)",
        "('mapping', 'B', 'Low', 0.5, NULL, NULL)", "('calculation', 'B', NULL, NULL, NULL, 2.5)",
        "('mapping', 'C', 'Low', 0.5, NULL, NULL)", "('exclusion', 'C', NULL, NULL, NULL, NULL)",
    ])
    effective = rules.alone(rule_rows, "V")
    assert rows(rules.rwa_by_policy_version(exposures, effective, thresholds=True)) == [("V", "P", "Low", 62.5)]
    other = rules.alone(adapters.rule_rows(spark, ["('mapping', 'A', 'Low', 1, NULL, NULL)", "('threshold', 'A', NULL, NULL, 50, NULL)"]), "W")
    both = rows(rules.rwa_by_policy_version(exposures, effective.unionByName(other), thresholds=True))
    assert both == [("V", "P", "Low", 62.5), ("W", "P", "Low", 199.99)]
    recon = rules.reconciliation(exposures, effective).first()
    assert (recon.exposure_total, recon.mapped, recon.unmapped, recon.excluded) == (217.99, 110.0, 1.0, 7.0)
    assert (recon.below_threshold, recon.without_portfolio) == (99.99, 0.0)
    lost = exposures.unionByName(literal_rows(spark, "exposures", [(None, None, Decimal("5.00"))]))
    recon = rules.reconciliation(lost, effective).first()
    assert (recon.exposure_total, recon.unmapped, recon.without_portfolio) == (222.99, 6.0, 5.0)
    assert rules.reconciliation(exposures.limit(0), effective).first().exposure_total == 0.0
    assert rows(rules.unmapped_classes(exposures, effective)) == [("X",)]


def test_bands_of_thousands_of_thresholds(spark):
    """Clustered, equal and far-off thresholds; amounts on, between, below and above them; NULLs."""
    from bisect import bisect_right

    rng = random.Random(6)
    cents = sorted({rng.randrange(10**4) for _ in range(1500)} | {rng.randrange(10**15) for _ in range(1500)} | {10**7 + i for i in range(900)})
    cuts = {"A": cents, "B": [500], "C": []}
    rule_rows = [(c, Decimal(x) / 100) for c, xs in cuts.items() for x in xs for _ in range(2)] + [("C", None), (None, Decimal(1))]
    thresholds = spark.createDataFrame(rule_rows, "asset_class string, min_amount decimal(18,2)")
    amounts = [x + d for x in rng.sample(cents, 300) for d in (-1, 0, 1)] + [0, -5, 10**16, 499, 500, 501]
    facts = [(c, Decimal(x) / 100) for x in amounts for c in ("A", "B", "C", None)] + [("A", None)]
    exposures = spark.createDataFrame([("P", c, x) for c, x in facts], "portfolio string, asset_class string, exposure_amount decimal(18,2)")
    got = {(r.asset_class, r.exposure_amount): r.band for r in rules.banded(exposures, thresholds).collect()}
    assert len(got) == len(set(facts)) and rules.banded(exposures, thresholds).count() == len(facts)
    for (c, x), band in got.items():
        at = bisect_right(cuts.get(c, []), x * 100) if x is not None else 0
        assert band == (Decimal(cuts[c][at - 1]) / 100 if at else None), (c, x)
    plan = rules.position_cube(exposures, thresholds)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "cuts" in plan


def test_bands_without_thresholds(spark):
    none = spark.createDataFrame([], "asset_class string, min_amount decimal(18,2)")
    exposures = spark.createDataFrame([("P", "A", Decimal("1.00"))], "portfolio string, asset_class string, exposure_amount decimal(18,2)")
    assert [r.band for r in rules.banded(exposures, none).collect()] == [None]
