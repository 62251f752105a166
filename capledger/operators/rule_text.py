"""Rule versions as SQL text: rendered from rule rows, checked by Spark's parser, bound to their relations and run."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.session import scratch_path

# What a text may name: its relations as IDENTIFIER(:name), ids as :name. It returns these columns.
RELATIONS = ("exposures", "risk_weight_mapping")
IDS = ("sql_version_id", "policy_id", "policy_version_id")
OUTPUT = ("portfolio", "risk_bucket", "rwa_amount")
CELLS = "policy_version string, portfolio string, risk_bucket string, rwa_exact decimal(38,8)"
FAILURES = "sql_version_id string, reason string, raised boolean"
# Rules that a rendered text spells out at most, and texts the driver holds at once.
MOST_RULES, TEXTS = 1000, 100

# Parts of a query that only read and compute; everything else is refused.
PLANS = frozenset(
    "SubqueryAlias Project Filter Aggregate Join Union Distinct Intersect Except Sort LocalRelation OneRowRelation"
    " WithWindowDefinition".split()
)
UNRESOLVED = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedOrdinal UnresolvedHaving UnresolvedInlineTable"
    " UnresolvedSubqueryColumnAliases UnresolvedFunction UnresolvedRelation NamedParameter PlanWithUnresolvedIdentifier".split()
)
FUNCTIONS = frozenset(
    "sum count avg min max coalesce ifnull nvl nullif if round bround floor ceil ceiling abs sign greatest least power sqrt"
    " upper lower trim ltrim rtrim concat substring substr replace length decimal double string date year month quarter"
    " row_number rank dense_rank lag lead first last first_value last_value any_value max_by min_by".split()
)


# Rendering


def _literal(value: Column) -> Column:
    """A text as an SQL string literal."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def rendered(effective: DataFrame) -> DataFrame:
    """``policy_version, generated_sql``: a runnable text per version of effective rules.

    Excluded classes and classes without a weight take no part. A version with more than ``MOST_RULES`` classes has a
    NULL text: such rules belong into a relation.
    """
    typed = lambda c, kind: F.coalesce(F.concat(F.col(c).cast("string"), F.lit("BD")), F.lit(f"CAST(NULL AS {kind})"))
    bucket = F.coalesce(_literal(F.col("risk_bucket")), F.lit("CAST(NULL AS STRING)"))
    row = F.concat_ws(", ", _literal(F.col("asset_class")), bucket, typed("risk_weight", "DECIMAL(9,6)"), typed("min_amount", "DECIMAL(18,2)"))
    counts = ~F.col("excluded") & F.col("asset_class").isNotNull() & F.col("risk_weight").isNotNull()
    ranked = effective.withColumn("_row", F.when(counts, F.concat(F.lit("    ("), row, F.lit(")"))))
    lists = ranked.groupBy("policy_version").agg(F.count("_row").alias("_n"), F.array_sort(F.collect_list("_row")).alias("_rows"))
    body = F.concat(
        F.lit("WITH rules AS (SELECT * FROM VALUES\n"),
        F.array_join("_rows", ",\n"),
        F.lit(
            "\n  AS r(asset_class, risk_bucket, risk_weight, min_amount))\n"
            "SELECT e.portfolio, r.risk_bucket, SUM(e.exposure_amount * r.risk_weight) AS rwa_amount\n"
            "FROM IDENTIFIER(:exposures) AS e JOIN rules AS r ON e.asset_class = r.asset_class\n"
            "WHERE r.min_amount IS NULL OR e.exposure_amount >= r.min_amount\n"
            "GROUP BY e.portfolio, r.risk_bucket"
        ),
    )
    nothing = F.lit("SELECT portfolio, asset_class AS risk_bucket, exposure_amount AS rwa_amount\nFROM IDENTIFIER(:exposures) WHERE false")
    return lists.select("policy_version", F.when(F.col("_n") == 0, nothing).when(F.col("_n") <= MOST_RULES, body).alias("generated_sql"))


# Checking


def _nodes(tree: object) -> Iterator[dict]:
    """All plan and expression nodes below a part of a parsed query."""
    if isinstance(tree, dict):
        if "class" in tree:
            yield tree
        tree = list(tree.values())
    if isinstance(tree, list):
        for part in tree:
            yield from _nodes(part)


def _refused(tree: object, names: set[str]) -> str | None:
    """Why a part of a parsed query must not run; ``names`` are the common table expressions it may read."""
    parameters = set(RELATIONS) | set(IDS)
    for node in _nodes(tree):
        *_, package, kind = node["class"].split(".")
        if package == "logical" and kind not in PLANS:
            return f"{kind} is no part of a rule text"
        if package == "analysis" and kind not in UNRESOLVED:
            return f"{kind} is no part of a rule text"
        if kind == "UnresolvedRelation" and node["multipartIdentifier"][1:-1].lower() not in names:
            return f"reads {node['multipartIdentifier'][1:-1]}"
        if kind == "UnresolvedFunction" and node["nameParts"][1:-1].lower() not in FUNCTIONS:
            return f"calls {node['nameParts'][1:-1]}"
        if kind == "NamedParameter" and node["name"] not in parameters:
            return f"names :{node['name']}"
        if kind == "PlanWithUnresolvedIdentifier":
            by = [n.get("name") for n in _nodes(node["identifierExpr"])]
            if len(by) != 1 or by[0] not in RELATIONS:
                return "reads a computed name"
    return None


def refusal(spark: SparkSession, text: str | None) -> str | None:
    """Why a text must not run; None if it may.

    Spark's parser takes it as one query, so commands, several statements and scripts are no texts. In the parsed
    plan only reading and computing parts are let through, relations only as ``IDENTIFIER(:name)`` of ``RELATIONS`` or as
    a common table expression that stands before, functions only from a list.
    """
    if not text or not text.strip():
        return "no text"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parseQuery(text).toJSON()
    except (ParseException, AnalysisException) as e:
        return str(e).strip().split("\n")[0]
    tree, names = json.loads(plan), set()
    if tree[0]["class"].endswith(".UnresolvedWith"):
        if tree[0]["allowRecursion"]:
            return "recursive query"
        for relation in tree[0]["cteRelations"]:
            if reason := _refused(relation["_2"], names):
                return reason
            names.add(relation["_1"].lower())
        tree = tree[1:]
    return _refused(tree, names)


# Running


def bound(spark: SparkSession, text: str, relations: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    """A checked text as a frame: relations become views of names nobody else has, ids become literals."""
    if reason := refusal(spark, text):
        raise ValueError(reason)
    views = {name: scratch_path(spark, name).rsplit("/", 1)[1].replace("-", "_") for name in relations}
    try:
        for name, view in views.items():
            relations[name].createOrReplaceTempView(view)
        return spark.sql(text, args={**ids, **views})
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def _cells(df: DataFrame, version: str) -> DataFrame:
    if sorted(c.lower() for c in df.columns) != sorted(OUTPUT):
        raise ValueError(f"returns {', '.join(df.columns)}")
    return df.select(
        F.lit(version).alias("policy_version"), F.col("portfolio").cast("string").alias("portfolio"),
        F.col("risk_bucket").cast("string").alias("risk_bucket"), F.col("rwa_amount").cast("decimal(38,8)").alias("rwa_exact"),
    )


def run_texts(versions: DataFrame, relations: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Run the texts of rule versions (``sql_version_id, policy_id, policy_version_id, generated_sql``, a row each).

    Returns the cells (``policy_version`` is the rule version, ``rwa_exact`` an exact decimal) and the versions that
    failed, with the reason: a refused text, another relation or column than there is, or an error of its job
    (``raised``). Each text is a job of its own that appends to one written table, so a failed one leaves nothing; the
    driver holds ``TEXTS`` texts at once, however many there are.
    """
    spark = versions.sparkSession
    cells, failures = scratch_path(spark, "text-cells"), scratch_path(spark, "text-failures")
    spark.createDataFrame([], CELLS).write.parquet(cells)
    spark.createDataFrame([], FAILURES).write.parquet(failures)
    last = ""
    while rows := versions.where(F.col("sql_version_id") > last).orderBy("sql_version_id").limit(TEXTS).collect():
        failed = []
        for row in rows:
            try:
                ids = {name: row[name] or "" for name in IDS}
                _cells(bound(spark, row["generated_sql"], relations, ids), row["sql_version_id"]).write.mode("append").parquet(cells)
            except (ValueError, AnalysisException, ParseException) as e:
                failed.append((row["sql_version_id"], str(e).strip().split("\n")[0][:500], False))
            except PySparkException as e:
                failed.append((row["sql_version_id"], str(e)[:500], True))
        if failed:
            spark.createDataFrame(failed, FAILURES).write.mode("append").parquet(failures)
        last = rows[-1]["sql_version_id"]
    return spark.read.schema(CELLS).parquet(cells), spark.read.schema(FAILURES).parquet(failures)


def against_rules(cells: DataFrame, by_rules: DataFrame) -> DataFrame:
    """Cells of texts beside those of rule rows (``rwa_exact`` each); a cell that one side lacks counts as zero there."""
    side = lambda df, name: df.select(
        "policy_version", "portfolio", "risk_bucket", F.lit(name).alias("side"), F.col("rwa_exact").cast("decimal(38,8)").alias("amount")
    )
    both = side(cells, "text").unionByName(side(by_rules, "rules"))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("amount"))), F.lit(0).cast("decimal(38,8)"))
    summed = both.groupBy("policy_version", "portfolio", "risk_bucket").agg(total("text").alias("text"), total("rules").alias("rules"))
    return summed.select(
        "policy_version", "portfolio", "risk_bucket", F.col("text").cast("double").alias("rwa_text"),
        F.col("rules").cast("double").alias("rwa_rules"), (F.col("text") - F.col("rules")).cast("double").alias("difference"),
    )
