"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every boundary str.splitlines() recognises.
LINE_BREAKS = r"\R|[\x1c-\x1e]"
# Minimum capital ratio; labels and threshold of the fraud alert.
MIN_CAPITAL_RATIO = 0.08
ALERT_ABOVE = 0.5
ALERT_LABELS = ("High Risk (ML)", "Standard Transaction")


def dbl(column: Column | str) -> Column:
    """Publish an exact decimal as DOUBLE."""
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def pct_change(baseline: Column, delta: Column) -> Column:
    """delta / baseline * 100, and 0 when there is no baseline."""
    return F.when(baseline == 0, F.lit(0.0)).otherwise(delta / baseline * 100)


def money_text(amount: Column, decimals: int = 1) -> Column:
    """``$12.3M`` from one million up, ``$12,345`` below."""
    millions = F.format_number(amount / 1_000_000, decimals)
    return F.when(amount >= 1_000_000, F.concat(F.lit("$"), millions, F.lit("M"))).otherwise(
        F.concat(F.lit("$"), F.format_number(amount, 0))
    )


def iso_text(ts: Column) -> Column:
    """ISO text of a UTC instant; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def mint_id(prefix: str, *key: Column, length: int = 24) -> Column:
    """Prefix plus upper-case hex taken from the key, so a retry mints the same id."""
    digest = F.sha2(F.concat_ws("\u0000", *key), 256)
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, length)))


def version_id(policy_id: Column, *key: Column) -> Column:
    return F.concat(policy_id, mint_id("-V", policy_id, *key, length=16))


def object_path(policy_version_id: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("policies"), policy_version_id, filename)


def json_or_raw(text: Column) -> Column:
    """Normalised JSON text, or the raw value when it does not parse."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def json_scalar(text: Column, path: str) -> Column:
    """Scalar at a JSON path as text; NULL for bad JSON, objects and arrays."""
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(found)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(~nested, F.try_variant_get(F.try_parse_json(text), path, "string"))


def summary_text(summary: Column, default: Column) -> Column:
    return F.coalesce(F.trim(summary), default)


def progress_text(prefix: str, summary: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(summary, 1, 120))


def lines(text: Column) -> Column:
    """Lines as ``str.splitlines()`` gives them: a closing line break opens no new line."""
    closed = F.substring(text, -1, 1).rlike(LINE_BREAKS)
    body = F.when(closed, F.regexp_replace(text, rf"({LINE_BREAKS})\z", "")).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAKS))


def clause_origin(clause_id: Column) -> Column:
    return F.when(clause_id.startswith("V1-"), "Initial").when(clause_id.startswith("V2-"), "Update")


def run_label(run_id: Column, status: Column, policy_version_id: Column) -> Column:
    return F.concat(run_id, F.lit(" ("), status, F.lit(") — "), F.coalesce(policy_version_id, F.lit("")))


def alert_label(score: Column) -> Column:
    return F.when(score > ALERT_ABOVE, ALERT_LABELS[0]).otherwise(ALERT_LABELS[1])
