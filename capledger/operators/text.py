"""Clause citations, schema drift and rule-text diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.functions.scalars import clause_origin, lines
from capledger.operators.ordered import running
from capledger.schemas import SNAPSHOT, TRACE

CLAUSE_COMMENT = r"--\s*\[((?:V\d+-)?C\d+)\]"


def _citations(trace: Column) -> Column:
    """Citations of a trace; an empty list when the trace does not parse."""
    parsed = F.from_json(trace, TRACE)["clause_citations"]
    return F.coalesce(parsed, F.array().cast(TRACE["clause_citations"].dataType))


def clause_table(sql_versions: DataFrame) -> DataFrame:
    """One row per citation, missing fields defaulted."""
    clause = F.col("clause")
    clause_id = F.coalesce(clause["clause_id"], F.lit("?"))
    return sql_versions.select("sql_version_id", F.explode(_citations(F.col("agent_trace"))).alias("clause")).select(
        "sql_version_id",
        clause_id.alias("clause_id"),
        F.initcap(F.coalesce(clause["clause_type"], F.lit("definition"))).alias("clause_type"),
        F.coalesce(clause_origin(clause_id), F.lit("Unversioned")).alias("origin"),
        F.coalesce(clause["clause_text"], F.lit("N/A")).alias("clause_text"),
        F.coalesce(clause["sql_section"], F.lit("N/A")).alias("sql_section"),
    )


def clause_type_counts(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("clause_type", "origin").agg(F.count("*").alias("n"))


def clause_traceability(sql_versions: DataFrame) -> DataFrame:
    """Cited clauses against the clause comments in the rule text, inside each row."""
    cited = F.array_compact(F.transform(_citations(F.col("agent_trace")), lambda c: c["clause_id"]))
    commented = F.coalesce(
        F.regexp_extract_all("generated_sql", F.lit(CLAUSE_COMMENT), F.lit(1)), F.array().cast("array<string>")
    )
    rows = sql_versions.select("sql_version_id", cited.alias("cited"), commented.alias("commented"))
    exploded = rows.select("*", F.explode(F.array_union("cited", "commented")).alias("clause_id"))
    in_cited, in_text = F.array_contains("cited", F.col("clause_id")), F.array_contains("commented", F.col("clause_id"))
    return exploded.select(
        "sql_version_id",
        "clause_id",
        F.when(in_cited & in_text, "matched").when(in_cited, "cited_only").otherwise("commented_only").alias("link_status"),
    )


def _paths(tables: Column, with_type: bool = False) -> Column:
    """``table.column`` names (optionally ``table.column:type``) of a snapshot's tables."""
    def of_table(entry: Column) -> Column:
        def path(c: Column) -> Column:
            name = F.concat_ws(".", entry["key"], c["column_name"])
            return F.concat_ws(":", name, c["data_type"]) if with_type else name

        return F.transform(entry["value"], path)

    return F.flatten(F.transform(F.map_entries(tables), of_table))


def schema_drift(sql_versions: DataFrame, live_columns: DataFrame) -> DataFrame:
    """What the live schema has more, less or otherwise than each rule version's snapshot.

    ``live_columns`` (``table_name, column_name, data_type``) has a row per type that any file has a column in, and may say
    whether a column is ``in_all_files``. Kinds: ``added`` and ``removed`` columns, ``retyped`` ones (some file has another
    type than the snapshot), ``missing`` ones (some file lacks them). The live schema is one array (as wide as the
    schema), so the differences are taken inside the row and nothing is shuffled. Versions without a drifted
    column keep one row; ``column_path`` and ``kind`` are then NULL.
    """
    name = F.concat_ws(".", "table_name", "column_name")
    everywhere = F.col("in_all_files") if "in_all_files" in live_columns.columns else F.lit(True)
    live = live_columns.agg(F.collect_set(name)).scalar()
    live_typed = live_columns.agg(F.collect_set(F.concat_ws(":", name, F.col("data_type")))).scalar()
    partial = live_columns.agg(F.collect_set(F.when(~everywhere, name))).scalar()
    tables = F.from_json("schema_snapshot", SNAPSHOT)["tables"]
    rows = sql_versions.select("sql_version_id", tables.alias("tables")).withColumns(
        {"stored": _paths(F.col("tables")), "live": live, "live_typed": live_typed, "partial": partial}
    )
    tagged = lambda paths, kind: F.transform(
        F.array_sort(paths), lambda p: F.struct(p.alias("column_path"), F.lit(kind).alias("kind"))
    )
    added, removed = F.array_except("live", "stored"), F.array_except("stored", "live")
    # A type is what follows the last part of the name; names hold no colon.
    strip = lambda paths: F.transform(paths, lambda p: F.substring_index(p, ":", 1))
    retyped = F.array_intersect(strip(F.array_except("live_typed", _paths(F.col("tables"), True))), "stored")
    missing = F.array_intersect("partial", "stored")
    verdict = (
        F.when(F.col("tables").isNull(), "no_snapshot")
        .when(F.size(removed) > 0, "removed_columns")
        .when(F.size(added) > 0, "new_columns")
        .when(F.size(retyped) + F.size(missing) > 0, "unlike_files")
        .otherwise("compatible")
    )
    kinds = {"added": added, "removed": removed, "retyped": retyped, "missing": missing}
    drift = F.when(F.col("tables").isNotNull(), F.concat(*[tagged(paths, kind) for kind, paths in kinds.items()]))
    return rows.select("sql_version_id", verdict.alias("verdict"), F.inline_outer(drift)).select(
        "sql_version_id", "column_path", "kind", "verdict"
    )


def drift_counts(drift: DataFrame) -> DataFrame:
    return drift.groupBy("verdict").agg(
        F.countDistinct("sql_version_id").alias("versions"),
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in ("added", "removed", "retyped", "missing")],
    )


def version_pairs(texts: DataFrame) -> DataFrame:
    """Consecutive versions of each policy from (policy_id, version_no) rows."""
    previous = running(
        texts.select("policy_id", "version_no"),
        ["policy_id"],
        ["version_no"],
        {"version_a": ("max", F.col("version_no"))},
        inclusive=False,
    )
    return previous.where(F.col("version_a").isNotNull()).select(
        "policy_id", "version_a", F.col("version_no").alias("version_b")
    )


def line_diff(texts: DataFrame) -> DataFrame:
    """Added, removed and net lines of consecutive versions, as line multisets.

    Each version's lines count +1 in the pair it completes and -1 in the pair it
    opens; a pair's surplus per line is then what was added or removed. Lines travel as
    128-bit digests. Comment
    lines count like any other. ``version_no`` must be unique in ``texts``.
    """
    pairs = version_pairs(texts)
    # One row per version with the pairs it is in: two, or one at either end.
    membership = (
        pairs.select(
            F.col("version_b").alias("pair"),
            F.inline(F.expr("array(struct(version_a AS version_no, -1 AS sign), struct(version_b AS version_no, 1 AS sign))")),
        )
        .groupBy("version_no")
        .agg(F.collect_list(F.struct("pair", "sign")).alias("pairs"))
    )
    signed = (
        texts.select("version_no", F.transform(lines(F.col("text")), lambda x: F.unhex(F.md5(x))).alias("lines"))
        .join(membership, "version_no")
        .select("pairs", F.explode("lines").alias("line"))
        .select("line", F.inline("pairs"))
    )
    per_pair = (
        signed.groupBy("pair", "line")
        .agg(F.sum("sign").alias("n"))
        .groupBy(F.col("pair").alias("version_b"))
        .agg(
            F.sum(F.greatest("n", F.lit(0))).alias("lines_added"),
            F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("lines_removed"),
            F.sum("n").alias("net"),
        )
    )
    return pairs.join(per_pair, "version_b", "left").select(
        "policy_id", "version_a", "version_b",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lines_added", "lines_removed", "net")],
    )
