import json
import random

import pytest
from row_lists import rows
from pyspark.sql import functions as F

from capledger.functions import scalars
from capledger.operators import text
from capledger.sources import tables


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "value", ["", "\n", "a", "a\n", "a\n\n", "\na", "a\r\nb\rc", "a\r\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ", "\r\n\r\n", "a\n\r", "  x "]
)
def test_lines_like_splitlines(spark, value):
    assert list(one(spark, value, scalars.lines)) == value.splitlines()


def _texts(spark, versions):
    return spark.createDataFrame(versions, "policy_id string, version_no long, text string")


def test_line_diff_counts_comment_lines(spark):
    versions = [("p", 1, "-- [C1] rule\nSELECT 1\n++x"), ("p", 2, "SELECT 1\n-- [C2] rule"), ("p", 5, ""), ("p", 9, ""), ("q", 3, "only")]
    assert rows(text.line_diff(_texts(spark, versions))) == [
        ("p", 1, 2, 1, 2, -1), ("p", 2, 5, 0, 2, -2), ("p", 5, 9, 0, 0, 0),
    ]


def test_diffs_against_brute_force(spark):
    from collections import Counter

    rng = random.Random(3)
    versions = [
        ("hot" if n % 3 else f"p{n % 4}", n, "\n".join(rng.choice("abcde--+") for _ in range(rng.randrange(30)))) for n in range(60)
    ]
    by_policy = {}
    for policy, number, body in versions:
        by_policy.setdefault(policy, []).append((number, body.splitlines()))
    multiset = []
    for policy, items in by_policy.items():
        for (a, old), (b, new) in zip(items, items[1:]):
            up, down = Counter(new) - Counter(old), Counter(old) - Counter(new)
            multiset.append((policy, a, b, sum(up.values()), sum(down.values()), len(new) - len(old)))
    texts = _texts(spark, versions)
    assert rows(text.line_diff(texts)) == sorted(multiset, key=repr)


def test_equal_texts_have_no_diff(spark):
    texts = _texts(spark, [("p", 1, "a\nb"), ("p", 2, "a\nb")])
    assert rows(text.line_diff(texts)) == [("p", 1, 2, 0, 0, 0)]


def _sqls(spark, *values):
    return spark.createDataFrame(
        [(f"S{i}", *v) for i, v in enumerate(values)],
        "sql_version_id string, generated_sql string, agent_trace string, schema_snapshot string",
    )


def test_clauses(spark):
    trace = json.dumps(
        {
            "summary": "s",
            "clause_citations": [
                {"clause_id": "V1-C1", "clause_text": "t", "clause_type": "threshold", "sql_section": "w"},
                {"clause_type": "mapping"},
                {"clause_id": "V2-C2"},
                {"clause_id": "C3", "clause_type": "exclusion"},
            ],
        }
    )
    sqls = _sqls(spark, ("-- [C3] x\nSELECT 1 --[V2-C2] y\n-- [C8]", trace, None), ("-- [C1]", "{broken", None), (None, None, None))
    assert rows(text.clause_table(sqls)) == sorted(
        [
            ("S0", "V1-C1", "Threshold", "Initial", "t", "w"), ("S0", "?", "Mapping", "Unversioned", "N/A", "N/A"),
            ("S0", "V2-C2", "Definition", "Update", "N/A", "N/A"), ("S0", "C3", "Exclusion", "Unversioned", "N/A", "N/A"),
        ],
        key=repr,
    )
    assert rows(text.clause_traceability(sqls)) == sorted(
        [("S0", "V1-C1", "cited_only"), ("S0", "V2-C2", "matched"), ("S0", "C3", "matched"), ("S0", "C8", "commented_only"), ("S1", "C1", "commented_only")],
        key=repr,
    )
    assert rows(text.clause_type_counts(text.clause_table(sqls)))[0][2] == 1


def test_schema_drift(spark):
    live = tables.frame_columns(spark, {"t": spark.createDataFrame([], "a int, b string"), "u": spark.createDataFrame([], "c int")})
    snap = lambda **t: json.dumps({"project": "p", "dataset": "d", "tables": {k: [{"column_name": c, "data_type": d} for c, d in v] for k, v in t.items()}})
    now = tables.schema_snapshot(live, "p", "d").first()
    assert now.table_count == 2
    assert json.loads(now.schema_snapshot)["tables"]["t"] == [{"column_name": "a", "data_type": "int"}, {"column_name": "b", "data_type": "string"}]
    sqls = _sqls(
        spark,
        (None, None, now.schema_snapshot),
        (None, None, None),
        (None, None, snap(t=[("a", "int"), ("z", "int")])),
        (None, None, snap(t=[("a", "bigint"), ("b", "string")])),
    )
    got = rows(text.schema_drift(sqls, live))
    assert got == sorted(
        [
            ("S0", None, None, "compatible"), ("S1", None, None, "no_snapshot"),
            ("S2", "t.b", "added", "removed_columns"), ("S2", "u.c", "added", "removed_columns"), ("S2", "t.z", "removed", "removed_columns"),
            ("S3", "u.c", "added", "new_columns"), ("S3", "t.a", "retyped", "new_columns"),
        ],
        key=repr,
    )
    counts = {r.verdict: (r.versions, r.added, r.removed) for r in text.drift_counts(text.schema_drift(sqls, live)).collect()}
    assert counts == {"compatible": (1, 0, 0), "no_snapshot": (1, 0, 0), "removed_columns": (1, 2, 1), "new_columns": (1, 1, 0)}


def test_scalars(spark):
    assert one(spark, 1234567.0, scalars.money_text, "double") == "$1.2M"
    assert one(spark, 999999.0, scalars.money_text, "double") == "$999,999"
    assert one(spark, None, lambda x: scalars.pct_change(F.lit(0.0), F.lit(5.0))) == 0.0
    a = one(spark, "key", lambda x: scalars.mint_id("SQL-", x))
    assert a == one(spark, "key", lambda x: scalars.mint_id("SQL-", x)) and len(a) == 28 and a[4:].upper() == a[4:]
    assert one(spark, "POL-1", lambda x: scalars.version_id(x, F.lit("f"))).startswith("POL-1-V")
    assert one(spark, "v", lambda x: scalars.object_path(x, F.lit("f.pdf"))) == "policies/v/f.pdf"
    assert one(spark, "x" * 200, lambda x: scalars.progress_text("done ", x)) == "done " + "x" * 120
    assert one(spark, '{"summary": "a\\nb"}', lambda x: scalars.json_scalar(x, "$.summary")) == "a\nb"
    assert one(spark, '{"summary": [1]}', lambda x: scalars.json_scalar(x, "$.summary")) is None
    assert one(spark, "{bad", lambda x: scalars.json_scalar(x, "$.summary")) is None
    assert one(spark, "{bad", scalars.json_or_raw) == "{bad"
    assert one(spark, 0.5, scalars.alert_label, "double") == "Standard Transaction"
    assert one(spark, 0.51, scalars.alert_label, "double") == "High Risk (ML)"
    stamp = lambda t: spark.sql(f"SELECT timestamp_ntz'{t}' x").select(scalars.iso_text(F.col("x"))).first()[0]
    assert stamp("2024-01-02 03:04:05") == "2024-01-02T03:04:05+00:00"
    assert stamp("2024-01-02 03:04:05.0012") == "2024-01-02T03:04:05.001200+00:00"
