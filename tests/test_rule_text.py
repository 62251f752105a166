"""Rule texts: what is refused, what runs, and that text and rule rows agree."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from row_lists import rows

from capledger.operators import rule_text, rules
from capledger.sources import adapters, tables
from capledger.workflow import Registry

GOOD = (
    "WITH w AS (SELECT asset_class, risk_bucket, risk_weight FROM IDENTIFIER(:risk_weight_mapping)), v AS (SELECT * FROM w)\n"
    "SELECT e.portfolio, v.risk_bucket, SUM(e.exposure_amount * v.risk_weight) AS rwa_amount\n"
    "FROM IDENTIFIER(:exposures) e JOIN v ON e.asset_class = v.asset_class\n"
    "WHERE e.exposure_amount > (SELECT min(risk_weight) FROM w) AND :sql_version_id <> '; DROP TABLE x -- secret('\n"
    "GROUP BY ALL"
)


def test_good_texts(spark):
    assert rule_text.refusal(spark, GOOD) is None
    assert rule_text.refusal(spark, "SELECT 1 AS portfolio, 'a' AS risk_bucket, 2 AS rwa_amount") is None


@pytest.mark.parametrize(
    "text, reason",
    [
        (None, "no text"), ("  ", "no text"), ("DROP TABLE x", "DROP"), ("SELECT 1; SELECT 2", ";"), ("INSERT INTO t SELECT 1", "INSERT"),
        ("SELECT * FROM secret", "reads secret"), ("SELECT * FROM parquet.`/etc`", "reads parquet"), ("TABLE secret", "reads secret"),
        ("SELECT * FROM IDENTIFIER(:exposures) WHERE 1 IN (SELECT a FROM secret)", "reads secret"),
        ("SELECT * FROM IDENTIFIER('sec' || 'ret')", "computed name"), ("SELECT * FROM IDENTIFIER(:policy_id)", "computed name"),
        ("SELECT IDENTIFIER('reflect')('java.lang.System', 'exit', 1)", "no part"), ("SELECT reflect('java.lang.System', 'exit', 1)", "calls reflect"),
        ("SELECT TRANSFORM(portfolio) USING 'cat' AS (b) FROM IDENTIFIER(:exposures)", "ScriptTransformation"), ("SELECT :run_id AS x", "names :run_id"),
        ("SELECT * FROM (WITH secret AS (SELECT 1) SELECT * FROM secret) JOIN secret", "no part"),
        ("WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "reads b"),
        ("WITH RECURSIVE a AS (SELECT 1 UNION ALL SELECT * FROM a) SELECT * FROM a", "recursive"), ("SELECT * FROM range(9)", "no part"),
        ("SELECT explode(array(1))", "calls explode"), ("FROM x INSERT INTO t SELECT 1", "INSERT"), ("not sql", "not"),
        ("SELECT 1 FROM IDENTIFIER(:exposures) LATERAL VIEW explode(array(1)) z", "no part"),
    ],
)
def test_refused_texts(spark, text, reason):
    assert reason in rule_text.refusal(spark, text)


def test_bound_reads_its_relations_only(spark):
    exposures = tables.literal_rows(spark, "exposures", [("P", "A", Decimal("10.00")), ("Q", "B", Decimal("4.00"))])
    mapping = tables.literal_rows(spark, "risk_weight_mapping", [("A", "Low", Decimal("0.5"))])
    got = rule_text.bound(spark, GOOD, {"exposures": exposures, "risk_weight_mapping": mapping}, {"sql_version_id": "S'; --"})
    assert rows(got) == [("P", "Low", Decimal("5.000000"))]
    with pytest.raises(ValueError, match="reads secret"):
        rule_text.bound(spark, "SELECT * FROM secret", {}, {})
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("exposures", "risk_weight"))]


def test_texts_fail_alone(spark):
    exposures = tables.literal_rows(spark, "exposures", [("P", "A", Decimal("10.00")), ("P", None, Decimal("1.00")), (None, "A", Decimal("2.00"))])
    texts = {
        "a": "SELECT portfolio, 'x' AS risk_bucket, SUM(exposure_amount) AS rwa_amount FROM IDENTIFIER(:exposures) GROUP BY 1",
        "b": "SELECT 1 AS portfolio", "c": "SELECT nothing AS portfolio, 1 AS risk_bucket, 2 AS rwa_amount FROM IDENTIFIER(:exposures)",
        "d": "SELECT portfolio, 'x' AS risk_bucket, exposure_amount / 0 AS rwa_amount FROM IDENTIFIER(:exposures)", "e": None,
        "f": "SELECT :sql_version_id AS portfolio, :policy_id AS risk_bucket, 7 AS rwa_amount",
    }
    frame = spark.createDataFrame([(k, "pol", k, t) for k, t in texts.items()], "sql_version_id string, policy_id string, policy_version_id string, generated_sql string")
    cells, failures = rule_text.run_texts(frame, {"exposures": exposures, "risk_weight_mapping": exposures})
    assert rows(cells) == sorted([("a", "P", "x", Decimal("11.00000000")), ("a", None, "x", Decimal("2.00000000")), ("f", "f", "pol", Decimal("7.00000000"))], key=repr)
    got = {r.sql_version_id: (r.reason, r.raised) for r in failures.collect()}
    assert set(got) == {"b", "c", "d", "e"} and {k for k, v in got.items() if v[1]} == {"d"}
    assert "returns portfolio" in got["b"][0] and "nothing" in got["c"][0] and "DIVIDE_BY_ZERO" in got["d"][0] and got["e"][0] == "no text"


def test_rendered_text_equals_the_rules(spark):
    rng = random.Random(4)
    classes = ["A", "it's", "back\\slash", "new\nline", "ü", "C6", "C7"]
    layers = []
    for version in ("x", "y", "none"):
        for c in classes:
            kind = "exclusion" if version == "none" else rng.choice(["mapping", "mapping", "exclusion"])
            layers.append((version, kind, c, rng.choice(["Low", "O'Hi", None]) if kind == "mapping" else None, Decimal(rng.randint(0, 30000)) / 10000, None, None, 0, "V1"))
            if rng.random() < 0.5:
                layers.append((version, "threshold", c, None, None, Decimal(rng.randint(1, 900)), None, 0, "V1"))
            if rng.random() < 0.5:
                layers.append((version, "calculation", c, None, None, None, Decimal("1.25"), 0, "V1"))
    schema = "policy_version string, kind string, asset_class string, risk_bucket string, risk_weight decimal(7,4), min_amount decimal(18,2), multiplier decimal(7,4), precedence int, origin string"
    effective = rules.effective_rules(spark.createDataFrame(layers, schema))
    facts = tables.literal_rows(spark, "exposures", [(rng.choice(["P", None]), rng.choice([*classes, "unmapped", None]), Decimal(rng.randint(0, 100000)) / 100) for _ in range(300)])
    texts = rule_text.rendered(effective)
    versions = texts.selectExpr("policy_version AS sql_version_id", "'p' AS policy_id", "'v' AS policy_version_id", "generated_sql")
    cells, failures = rule_text.run_texts(versions, {"exposures": facts, "risk_weight_mapping": facts})
    assert failures.isEmpty() and {r.policy_version for r in texts.collect()} == {"x", "y", "none"}
    beside = rule_text.against_rules(cells, rules.weighted_cells(rules.position_cube(facts, effective), effective)).collect()
    assert len(beside) > 6 and all(r.difference == 0 and r.rwa_text == r.rwa_rules for r in beside)


def test_workflow_runs_the_approved_text(spark, folder):
    registry = Registry(spark, folder)
    registry.initialise()
    day = lambda n: dt.datetime(2024, 5, n)
    exposures = tables.literal_rows(spark, "exposures", [("Book", "A", Decimal("20.00"))])
    mapping = tables.literal_rows(spark, "risk_weight_mapping", [("A", "Low", Decimal("0.5"))])
    files = [(None, f"{i}.pdf", "ann", None) for i in range(3)]
    uploaded = registry.upload(spark.createDataFrame(files, "policy_id string, filename string, actor string, supersedes string"), day(1))
    versions = {r.filename[0]: r for r in uploaded.collect()}
    body = {"0": GOOD.replace("*", "* -1 *", 0), "1": "SELECT * FROM IDENTIFIER(:exposures) JOIN secret", "2": GOOD.replace("'; DROP", "'x")}
    drafts = spark.createDataFrame(
        [(versions[k].policy_version_id, "s", t, "{}", None) for k, t in body.items()],
        "policy_version_id string, summary string, generated_sql string, agent_trace string, schema_snapshot string",
    )
    rule = adapters.rule_rows(spark, ["('mapping', 'A', 'Other', 9, NULL, NULL)"])
    delta = rule.crossJoin(drafts.selectExpr("policy_version_id AS policy_version"))
    drafted = registry.draft(delta, drafts, day(2)).select("sql_version_id", "policy_version_id", "policy_id")
    registry.approve(drafted.selectExpr("sql_version_id", "'bob' AS actor"), day(3))

    def run(at):
        runs = registry.execute(drafted, exposures, at, mapping)
        done = {r.run_id: r.run_status for r in registry.runs().collect()}
        kept = {r.run_id: (r.risk_bucket, r.rwa_amount) for r in registry.outputs().collect()}
        names = {v.policy_version_id: k for k, v in versions.items()}
        return {names[r.policy_version_id]: (done[r.run_id], kept.get(r.run_id)) for r in runs.collect()}

    assert run(day(4)) == {"0": ("succeeded", ("Low", 10.0)), "1": ("failed", None), "2": ("succeeded", ("Low", 10.0))}
    reasons = registry.events().where("event_type = 'run_ended' AND payload LIKE '%reads secret%'")
    assert reasons.count() == 1
    # A new text without new rules is what runs, once it is approved.
    again = drafted.where(drafted.policy_version_id == versions["1"].policy_version_id)
    flat = "SELECT portfolio, 'Flat' AS risk_bucket, SUM(exposure_amount) AS rwa_amount FROM IDENTIFIER(:exposures) GROUP BY portfolio"
    registry.regenerate(again.selectExpr("sql_version_id", f'"{flat}" AS generated_sql', "'{}' AS agent_trace", "CAST(NULL AS STRING) AS schema_snapshot"), day(5))
    assert run(day(6))["1"] == ("failed", None)
    registry.approve(again.selectExpr("sql_version_id", "'bob' AS actor"), day(7))
    assert run(day(8))["1"] == ("succeeded", ("Flat", 20.0))
