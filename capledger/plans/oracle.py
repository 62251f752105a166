"""The registered queries once more, as plain SQL over the same tables.

Written from the definitions, not from the DataFrame plans: joins where the plans
aggregate, whole-key windows where the plans cut keys into chunks, rule numbers
where the plans parse JSON.
"""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}


def _dbl(expr: str) -> str:
    """Correctly rounded decimal to double (through its text)."""
    return f"CAST(CAST({expr} AS VARCHAR) AS DOUBLE)"


def _iso(ts: str) -> str:
    whole = f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"
    micros = f"strftime({ts}, '%f')"
    return f"{whole} || CASE WHEN {micros} = '000000' THEN '' ELSE '.' || {micros} END || '+00:00'"


# --- risk-weighted assets ----------------------------------------------------

EXPO = """expo AS (
  SELECT c.c_mktsegment AS portfolio, p.p_type AS asset_class,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""

V1 = """v1(asset_class, risk_bucket, risk_weight) AS (VALUES
  ('ECONOMY', 'Low', CAST(0.20 AS DECIMAL(7,4))), ('SMALL', 'Low', 0.20), ('STANDARD', 'Medium', 0.50),
  ('MEDIUM', 'Medium', 0.50), ('LARGE', 'High', 1.00))"""

MAPS = V1 + """,
maps AS (
  SELECT 'V1' AS policy_version, * FROM v1
  UNION ALL SELECT 'V2', * FROM v1 WHERE asset_class NOT IN ('SMALL', 'PROMO', 'MEDIUM')
  UNION ALL SELECT 'V2', 'SMALL', 'Medium', 0.50
  UNION ALL SELECT 'V2', 'PROMO', 'VeryHigh', 1.50)"""

CELLS = f"""{EXPO},
{MAPS},
cells AS (
  SELECT policy_version, portfolio, risk_bucket, SUM(amount * risk_weight) AS rwa
  FROM expo JOIN maps USING (asset_class) GROUP BY 1, 2, 3)"""

CMP = f"""{CELLS},
sided AS (
  SELECT portfolio, risk_bucket, rwa AS before, rwa * 0 AS after FROM cells WHERE policy_version = 'V1'
  UNION ALL SELECT portfolio, risk_bucket, rwa * 0, rwa FROM cells WHERE policy_version = 'V2'),
cmp AS (
  SELECT portfolio, risk_bucket, SUM(before) AS base, SUM(after) AS upd, SUM(after - before) AS delta
  FROM sided GROUP BY portfolio, risk_bucket),
tot AS (SELECT SUM(base) AS base, SUM(upd) AS upd, SUM(delta) AS delta FROM cmp)"""

ORACLE_SQL["rwa_by_policy_version"] = f"""WITH {CELLS}
SELECT policy_version, portfolio, risk_bucket, {_dbl('rwa')} AS rwa_amount FROM cells"""

KINDS = """
  SELECT 'V2K' AS policy_version, portfolio, risk_bucket, SUM(amount * w) AS rwa
FROM (
  SELECT portfolio, amount,
    CASE asset_class WHEN 'PROMO' THEN 'VeryHigh' WHEN 'LARGE' THEN 'High' WHEN 'STANDARD' THEN 'Medium' ELSE 'Low' END AS risk_bucket,
    CASE asset_class WHEN 'PROMO' THEN CAST(1.5 AS DECIMAL(9,6)) WHEN 'LARGE' THEN 1 WHEN 'STANDARD' THEN 0.5
      WHEN 'ECONOMY' THEN 0.25 ELSE 0.2 END AS w
  FROM expo
  WHERE asset_class <> 'MEDIUM' AND (asset_class <> 'LARGE' OR amount >= 50000))
GROUP BY portfolio, risk_bucket"""

ORACLE_SQL["rwa_all_rule_kinds"] = f"""WITH {EXPO}
SELECT policy_version, portfolio, risk_bucket, {_dbl('rwa')} AS rwa_amount FROM ({KINDS})"""

ORACLE_SQL["rule_text_execution"] = f"""WITH {CELLS},
every AS (SELECT policy_version, portfolio, risk_bucket, {_dbl('rwa')} AS rwa FROM cells
  UNION ALL SELECT policy_version, portfolio, risk_bucket, {_dbl('rwa')} FROM ({KINDS}))
SELECT policy_version, portfolio, risk_bucket, rwa AS rwa_text, rwa AS rwa_rules, CAST(0 AS DOUBLE) AS difference FROM every"""

INSTRUMENTS = f"""{V1},
inst AS (
  SELECT 'PART-' || p_partkey AS asset_class, v1.risk_bucket AS old_bucket, v1.risk_weight AS old_weight,
         p_size % 5 = 0 AS moved, p_size % 7 = 3 AS excluded
  FROM part LEFT JOIN v1 ON part.p_type = v1.asset_class),
ruled AS (
  SELECT *, CASE WHEN excluded THEN NULL WHEN moved THEN 'VeryHigh' ELSE old_bucket END AS new_bucket,
         CASE WHEN excluded THEN NULL WHEN moved THEN 1.5 ELSE old_weight END AS new_weight
  FROM inst)"""

ORACLE_SQL["rule_overlay"] = f"""WITH {INSTRUMENTS}
SELECT asset_class, new_bucket AS risk_bucket, CAST(new_weight AS DOUBLE) AS risk_weight,
       CASE WHEN moved THEN 'V2' ELSE 'V1' END AS origin
FROM ruled WHERE new_bucket IS NOT NULL"""

ORACLE_SQL["rule_delta"] = f"""WITH {INSTRUMENTS}
SELECT asset_class,
       CASE WHEN old_bucket IS NULL THEN 'added' WHEN new_bucket IS NULL THEN 'removed'
            WHEN old_bucket <> new_bucket OR old_weight <> new_weight THEN 'changed' ELSE 'same' END AS change,
       old_bucket, new_bucket, CAST(old_weight AS DOUBLE) AS old_weight, CAST(new_weight AS DOUBLE) AS new_weight
FROM ruled WHERE old_bucket IS NOT NULL OR new_bucket IS NOT NULL"""

ORACLE_SQL["feedback_adjusted_rwa"] = f"""WITH {EXPO}, {V1}
SELECT portfolio, risk_bucket, {_dbl('SUM(amount * risk_weight)')} AS rwa_before,
       {_dbl("SUM(amount * risk_weight * CASE WHEN asset_class = 'LARGE' THEN 2.5 ELSE 1.0 END)")} AS rwa_after
FROM expo JOIN v1 USING (asset_class) GROUP BY portfolio, risk_bucket"""

ORACLE_SQL["reconciliation"] = f"""WITH {EXPO}, {MAPS},
ruled(policy_version, asset_class, excluded, floor) AS (
  SELECT policy_version, asset_class, FALSE, CAST(0 AS DECIMAL(18,2)) FROM maps
  UNION ALL SELECT 'V2', 'MEDIUM', TRUE, 0
  UNION ALL SELECT * FROM (VALUES ('V2K', 'PROMO', FALSE, 0), ('V2K', 'ECONOMY', FALSE, 0), ('V2K', 'SMALL', FALSE, 0),
    ('V2K', 'STANDARD', FALSE, 0), ('V2K', 'LARGE', FALSE, 50000), ('V2K', 'MEDIUM', TRUE, 0))),
judged AS (
  SELECT v.policy_version, e.amount, e.portfolio, CASE WHEN r.asset_class IS NULL THEN 'unmapped' WHEN r.excluded THEN 'excluded'
    WHEN e.amount >= r.floor THEN 'mapped' ELSE 'below' END AS fate
  FROM (SELECT DISTINCT policy_version FROM ruled) v CROSS JOIN expo e
  LEFT JOIN ruled r ON r.policy_version = v.policy_version AND r.asset_class = e.asset_class)
SELECT policy_version, {_dbl('SUM(amount)')} AS exposure_total,
  {_dbl("SUM(CASE WHEN fate = 'mapped' THEN amount ELSE 0 END)")} AS mapped,
  {_dbl("SUM(CASE WHEN fate = 'below' THEN amount ELSE 0 END)")} AS below_threshold,
  {_dbl("SUM(CASE WHEN fate = 'unmapped' THEN amount ELSE 0 END)")} AS unmapped,
  {_dbl("SUM(CASE WHEN fate = 'excluded' THEN amount ELSE 0 END)")} AS excluded,
  {_dbl("SUM(CASE WHEN portfolio IS NULL THEN amount ELSE 0 END)")} AS without_portfolio
FROM judged GROUP BY policy_version"""

# --- comparison, stress, capital ---------------------------------------------

CMP_COLUMNS = f"{_dbl('base')} AS rwa_baseline, {_dbl('upd')} AS rwa_updated, {_dbl('delta')} AS rwa_delta"

ORACLE_SQL["rwa_comparison"] = f"WITH {CMP} SELECT portfolio, risk_bucket, {CMP_COLUMNS} FROM cmp"

ORACLE_SQL["comparison_summary"] = f"""WITH {CMP}
SELECT {_dbl('base')} AS total_baseline, {_dbl('upd')} AS total_updated, {_dbl('delta')} AS total_delta,
  CASE WHEN base = 0 THEN 0 ELSE {_dbl('delta')} / {_dbl('base')} * 100 END AS pct_change,
  CASE WHEN upd >= 1000000 THEN '$' || format('{{:,.1f}}', {_dbl('upd')} / 1000000) || 'M'
       ELSE '$' || format('{{:,.0f}}', {_dbl('upd')}) END AS total_updated_text
FROM tot"""

ORACLE_SQL["delta_waterfall"] = f"""WITH {CMP}
SELECT portfolio || ' / ' || risk_bucket AS label, {_dbl('delta')} AS rwa_delta,
  {_dbl('SUM(delta) OVER (ORDER BY portfolio, risk_bucket ROWS UNBOUNDED PRECEDING)')} AS running_total,
  'relative' AS measure FROM cmp
UNION ALL SELECT 'Total', {_dbl('delta')}, {_dbl('delta')}, 'total' FROM tot"""

MULT = "mult AS (SELECT CAST(n / 10.0 AS DECIMAL(3,1)) AS m FROM range(11, 31) r(n))"

ORACLE_SQL["stress_grid"] = f"""WITH {CMP}, {MULT}
SELECT CAST(m AS DOUBLE) AS multiplier, {_dbl('upd * m')} AS stressed_rwa,
  {_dbl('upd * m - upd')} * CAST(0.08 AS DOUBLE) AS incremental_capital
FROM tot CROSS JOIN mult"""

ORACLE_SQL["stress_by_bucket"] = f"""WITH {CMP}, {MULT}
SELECT portfolio, risk_bucket, CAST(m AS DOUBLE) AS multiplier, {_dbl('base')} AS rwa_baseline,
  {_dbl('upd')} AS rwa_updated, {_dbl('upd * m')} AS rwa_stressed
FROM cmp CROSS JOIN mult"""

CAPITAL = f"""{CELLS},
t AS (SELECT policy_version, {_dbl('SUM(rwa)')} AS amount FROM cells GROUP BY 1),
m(measure, capital_m, floor) AS (VALUES
  ('CET1', CAST(5.0 AS DOUBLE), CAST(4.5 AS DOUBLE)), ('Tier 1', 6.5, 6.0), ('Total', 8.0, 8.0)),
r AS (
  SELECT policy_version, measure, capital_m, floor,
         CASE WHEN amount > 0 THEN amount / CAST(1000000 AS DOUBLE) ELSE 22.0 END AS rwa_m
  FROM t CROSS JOIN m),
k AS (SELECT *, capital_m / rwa_m * 100 AS ratio FROM r)"""

ORACLE_SQL["capital_ratios"] = f"""WITH {CAPITAL}
SELECT policy_version, measure, capital_m, rwa_m, ratio, floor, ratio - floor AS headroom,
  CASE WHEN ratio < floor THEN 'red' WHEN ratio <= floor * 1.5 THEN 'amber' ELSE 'green' END AS band
FROM k"""

ORACLE_SQL["capital_buffers"] = f"""WITH {CAPITAL}
SELECT policy_version, measure, capital_m - rwa_m * (floor / 100) AS buffer_m, ratio - floor AS headroom FROM k"""

ORACLE_SQL["top_portfolios"] = f"""WITH {CELLS},
p AS (SELECT policy_version, portfolio, SUM(rwa) AS rwa FROM cells GROUP BY 1, 2)
SELECT policy_version, portfolio, {_dbl('rwa')} AS rwa_amount,
  RANK() OVER (PARTITION BY policy_version ORDER BY rwa DESC) AS rnk FROM p"""

ORACLE_SQL["delta_drivers"] = f"""WITH {CMP}
SELECT portfolio, risk_bucket, {_dbl('cmp.delta')} AS rwa_delta,
  CASE WHEN tot.delta = 0 THEN 0 ELSE {_dbl('cmp.delta')} / {_dbl('tot.delta')} END AS share_of_total,
  RANK() OVER (ORDER BY ABS(cmp.delta) DESC) AS rnk
FROM cmp CROSS JOIN tot"""

ORACLE_SQL["bucket_sensitivity"] = f"""WITH {CMP},
b AS (SELECT risk_bucket, SUM(base) AS base, SUM(upd) AS upd, SUM(delta) AS delta FROM cmp GROUP BY 1)
SELECT risk_bucket, {_dbl('base')} AS rwa_baseline, {_dbl('upd')} AS rwa_updated,
  CASE WHEN base = 0 THEN 0 ELSE {_dbl('delta')} / {_dbl('base')} * 100 END AS pct_change
FROM b"""

# --- registry ----------------------------------------------------------------

REG = """ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
    COUNT(*) FILTER (WHERE event_type = 'signup')
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v
  FROM events),
reg AS (
  SELECT event_id, ts, event_type, k, v, event_type = 'click' AND event_id % 4 <> 0 AS generates,
    'POL-' || user_id AS policy_id, CASE WHEN v > 0 THEN 'POL-' || user_id || '-V' || v END AS pvid,
    CASE WHEN v > 0 THEN 'SQL-' || LAST_VALUE(CASE WHEN event_type = 'click' AND event_id % 4 <> 0 THEN event_id END IGNORE NULLS)
      OVER (PARTITION BY user_id, v ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS sqlid,
    'analyst-' || (event_id % 5) AS actor
  FROM ev),
docs AS (
  SELECT policy_id, pvid AS policy_version_id, ts AS uploaded_at, actor AS uploaded_by,
    'policies/' || pvid || '/policy.pdf' AS gcs_uri,
    CASE WHEN LEAD(v) OVER (PARTITION BY policy_id ORDER BY v) IS NOT NULL THEN 'superseded'
         WHEN pvid IN (SELECT pvid FROM reg WHERE event_type = 'view' AND sqlid IS NOT NULL) THEN 'approved'
         WHEN pvid IN (SELECT pvid FROM reg WHERE generates) THEN 'extracted' ELSE 'draft' END AS status,
    CASE WHEN v > 1 THEN policy_id || '-V' || (v - 1) END AS supersedes_policy_version_id
  FROM reg WHERE event_type = 'signup'),
drafts AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sqlid ORDER BY ts DESC, event_id DESC) AS rn
  FROM reg WHERE event_type = 'click' AND sqlid IS NOT NULL),
signs AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sqlid ORDER BY ts DESC, event_id DESC) AS rn
  FROM reg WHERE event_type = 'view' AND sqlid IS NOT NULL),
sqls AS (
  SELECT d.sqlid AS sql_version_id, d.pvid AS policy_version_id, d.k,
    CASE WHEN s.sqlid IS NULL THEN 'pending' ELSE 'approved' END AS validation_status,
    s.actor AS approved_by, s.ts AS approved_at
  FROM drafts d
  LEFT JOIN signs s ON s.sqlid = d.sqlid AND s.rn = 1
    AND s.ts >= d.ts
  WHERE d.rn = 1),
runs AS (
  SELECT 'RUN-' || event_id AS run_id, policy_id, pvid AS policy_version_id, sqlid AS sql_version_id,
    CASE event_type WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS run_status,
    ts AS started_at, ts AS ended_at, v
  FROM reg WHERE event_type IN ('purchase', 'error')),
gate AS (
  SELECT run_id, sqlid, approved FROM (
    SELECT 'RUN-' || event_id AS run_id, sqlid, event_type,
      LAST_VALUE(CASE event_type WHEN 'view' THEN TRUE WHEN 'click' THEN FALSE END IGNORE NULLS)
        OVER (PARTITION BY sqlid ORDER BY ts, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, event_id
          ROWS UNBOUNDED PRECEDING) AS approved
    FROM reg WHERE sqlid IS NOT NULL)
  WHERE event_type IN ('purchase', 'error')),
ext AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY pvid ORDER BY ts DESC, event_id DESC) AS rn FROM reg
  WHERE generates AND pvid IS NOT NULL)"""

_TYPES = "['threshold', 'mapping', 'calculation', 'exclusion', 'definition']"


def _citation(clause: str, kind: str) -> str:
    """JSON of a citation; a NULL id or type is left out."""
    return f"""'{{' || COALESCE('"clause_id":"' || {clause} || '",', '') || '"clause_text":"weight rule ' || k || '",' ||
      COALESCE('"clause_type":"' || {kind} || '",', '') || '"sql_section":"weights"}}'"""


FIRST, SECOND = "CASE WHEN k % 3 = 0 THEN 'V1-C' ELSE 'C' END || (k % 10)", "CASE WHEN k % 11 <> 0 THEN 'V2-C' || (k % 13) END"
SUMMARY = """'"rules \\"' || k || '\\"\\nrevised"'"""
GENERATED_SQL = f"""concat_ws(chr(10), CASE WHEN k % 4 <> 1 THEN '-- [' || {FIRST} || '] weights' END,
    'SELECT portfolio, risk_bucket, SUM(exposure_amount * risk_weight)',
    CASE WHEN k % 6 = 0 THEN '-- [C77] carried over' END,
    CASE WHEN k % 2 = 0 AND k % 11 <> 0 THEN '-- [' || {SECOND} || '] update' END, 'GROUP BY portfolio, risk_bucket')"""
AGENT_TRACE = f"""CASE WHEN k % 25 = 24 THEN '{{unreadable' ELSE
    '{{"clause_citations":[' || {_citation(FIRST, f"CASE WHEN k % 7 <> 0 THEN {_TYPES}[k % 5 + 1] END")} ||
    CASE WHEN k % 2 = 0 THEN ',' || {_citation(SECOND, f"{_TYPES}[(k + 1) % 5 + 1]")} ELSE '' END ||
    '],"model":"rules","policy_gcs_uri":"policies/source-' || k || '.pdf","summary":' || {SUMMARY} || '}}' END"""

OUTPUTS = f"""{CELLS},
{REG},
outputs AS (
  SELECT r.run_id, r.policy_id, r.policy_version_id, r.sql_version_id, c.portfolio, c.risk_bucket, c.rwa,
    CAST(r.started_at AS DATE) AS as_of_date
  FROM runs r JOIN cells c ON c.policy_version = CASE WHEN r.v > 0 AND r.v % 2 = 0 THEN 'V2' ELSE 'V1' END
  WHERE r.run_status = 'succeeded')"""

ORACLE_SQL["document_state"] = f"""WITH {REG}
SELECT * FROM docs"""

ORACLE_SQL["sql_version_state"] = f"""WITH {REG}
SELECT sql_version_id, policy_version_id, validation_status, approved_by, approved_at FROM sqls"""

ORACLE_SQL["run_state"] = f"""WITH {REG}
SELECT run_id, policy_id, policy_version_id, sql_version_id, run_status, started_at, ended_at FROM runs"""

ORACLE_SQL["latest_approved_sql"] = f"""WITH {REG}
SELECT policy_version_id, sql_version_id, approved_at, {GENERATED_SQL} AS generated_sql, {AGENT_TRACE} AS agent_trace
FROM sqls WHERE validation_status = 'approved'
QUALIFY ROW_NUMBER() OVER (PARTITION BY policy_version_id ORDER BY approved_at DESC, sql_version_id DESC) = 1"""

ORACLE_SQL["latest_policy_version"] = f"""WITH {REG}
SELECT policy_id, policy_version_id,
  ROW_NUMBER() OVER (PARTITION BY policy_id ORDER BY uploaded_at, policy_version_id) AS version_no
FROM docs
QUALIFY ROW_NUMBER() OVER (PARTITION BY policy_id ORDER BY uploaded_at DESC, policy_version_id DESC) = 1"""

ORACLE_SQL["superseded_baseline"] = f"""WITH {REG}, top AS (
  SELECT policy_version_id, sql_version_id FROM sqls WHERE validation_status = 'approved'
  QUALIFY ROW_NUMBER() OVER (PARTITION BY policy_version_id ORDER BY approved_at DESC, sql_version_id DESC) = 1)
SELECT d.policy_version_id, d.supersedes_policy_version_id, o.gcs_uri AS supersedes_gcs_uri,
  t.sql_version_id AS baseline_sql_version_id
FROM docs d LEFT JOIN docs o ON o.policy_version_id = d.supersedes_policy_version_id LEFT JOIN top t ON t.policy_version_id = d.supersedes_policy_version_id
WHERE d.supersedes_policy_version_id IS NOT NULL"""

ORACLE_SQL["gated_report_outputs"] = f"""WITH {OUTPUTS}
SELECT run_id, policy_id, policy_version_id, sql_version_id, portfolio, risk_bucket, {_dbl('rwa')} AS rwa_amount, as_of_date
FROM outputs WHERE run_id IN (SELECT run_id FROM gate WHERE approved)"""

ORACLE_SQL["gate_violations"] = f"""WITH {REG}
SELECT r.run_id, r.sql_version_id, r.run_status,
  CASE WHEN r.sql_version_id IS NULL THEN 'no_sql_version' ELSE 'not_approved_at_start' END AS reason
FROM runs r LEFT JOIN gate g ON g.run_id = r.run_id
WHERE r.sql_version_id IS NULL OR NOT g.approved"""

ORACLE_SQL["orphan_events"] = f"""WITH {REG}
SELECT event_id, CASE WHEN event_type = 'view' THEN 'approved' WHEN generates THEN 'generated' ELSE 'regenerated' END AS event_type,
  pvid AS policy_version_id, sqlid AS sql_version_id
FROM reg WHERE event_type IN ('view', 'click') AND sqlid IS NULL"""

PAIRS = f"""{OUTPUTS},
pairs AS (
  SELECT policy_id, LAG(run_id) OVER (PARTITION BY policy_id ORDER BY started_at, run_id) AS run_a, run_id AS run_b
  FROM runs),
a AS (SELECT p.*, o.portfolio, o.risk_bucket, o.rwa FROM pairs p JOIN outputs o ON o.run_id = p.run_a),
b AS (SELECT p.*, o.portfolio, o.risk_bucket, o.rwa FROM pairs p JOIN outputs o ON o.run_id = p.run_b WHERE p.run_a IS NOT NULL),
paired AS (
  SELECT COALESCE(a.policy_id, b.policy_id) AS policy_id, COALESCE(a.run_a, b.run_a) AS run_a,
    COALESCE(a.run_b, b.run_b) AS run_b, COALESCE(a.portfolio, b.portfolio) AS portfolio,
    COALESCE(a.risk_bucket, b.risk_bucket) AS risk_bucket, COALESCE(a.rwa, 0) AS base, COALESCE(b.rwa, 0) AS upd,
    COALESCE(b.rwa, 0) - COALESCE(a.rwa, 0) AS delta
  FROM a FULL OUTER JOIN b ON a.run_a = b.run_a AND a.run_b = b.run_b
    AND a.portfolio = b.portfolio AND a.risk_bucket = b.risk_bucket)"""

ORACLE_SQL["run_pair_comparison"] = f"""WITH {PAIRS}
SELECT policy_id, run_a, run_b, portfolio, risk_bucket, {CMP_COLUMNS} FROM paired"""

BY_PAIR = f"""{PAIRS},
pair_total AS (
  SELECT policy_id, run_a, run_b, SUM(base) AS base, SUM(upd) AS upd, SUM(delta) AS delta FROM paired GROUP BY ALL)"""

ORACLE_SQL["run_pair_summary"] = f"""WITH {BY_PAIR}
SELECT policy_id, run_a, run_b, {_dbl('base')} AS total_baseline, {_dbl('upd')} AS total_updated, {_dbl('delta')} AS total_delta,
  CASE WHEN base = 0 THEN 0 ELSE {_dbl('delta')} / {_dbl('base')} * 100 END AS pct_change,
  CASE WHEN upd >= 1000000 THEN '$' || format('{{:,.1f}}', {_dbl('upd')} / 1000000) || 'M'
       ELSE '$' || format('{{:,.0f}}', {_dbl('upd')}) END AS total_updated_text
FROM pair_total"""

ORACLE_SQL["run_pair_waterfall"] = f"""WITH {BY_PAIR}
SELECT policy_id, run_a, run_b, portfolio || ' / ' || risk_bucket AS label, {_dbl('delta')} AS rwa_delta,
  {_dbl('SUM(delta) OVER (PARTITION BY run_a, run_b ORDER BY portfolio, risk_bucket ROWS UNBOUNDED PRECEDING)')} AS running_total,
  'relative' AS measure FROM paired
UNION ALL SELECT policy_id, run_a, run_b, 'Total', {_dbl('delta')}, {_dbl('delta')}, 'total' FROM pair_total"""

ORACLE_SQL["run_pair_stress"] = f"""WITH {BY_PAIR}, {MULT}
SELECT policy_id, run_a, run_b, CAST(m AS DOUBLE) AS multiplier, {_dbl('upd * m')} AS stressed_rwa,
  {_dbl('upd * m - upd')} * CAST(0.08 AS DOUBLE) AS incremental_capital
FROM pair_total CROSS JOIN mult"""

ORACLE_SQL["run_pair_stress_by_bucket"] = f"""WITH {BY_PAIR}, {MULT}
SELECT policy_id, run_a, run_b, portfolio, risk_bucket, CAST(m AS DOUBLE) AS multiplier, {_dbl('base')} AS rwa_baseline,
  {_dbl('upd')} AS rwa_updated, {_dbl('upd * m')} AS rwa_stressed
FROM paired CROSS JOIN mult"""

ORACLE_SQL["run_pair_drivers"] = f"""WITH {BY_PAIR}
SELECT p.policy_id, p.run_a, p.run_b, p.portfolio, p.risk_bucket, {_dbl('p.delta')} AS rwa_delta,
  CASE WHEN t.delta = 0 THEN 0 ELSE {_dbl('p.delta')} / {_dbl('t.delta')} END AS share_of_total,
  RANK() OVER (PARTITION BY p.run_a, p.run_b ORDER BY ABS(p.delta) DESC) AS rnk
FROM paired p JOIN pair_total t ON t.run_a = p.run_a AND t.run_b = p.run_b"""

ORACLE_SQL["run_pair_top_drivers"] = f"""WITH {BY_PAIR}
SELECT policy_id, run_a, run_b, portfolio, risk_bucket, {_dbl('delta')} AS rwa_delta,
  CAST(row_number() OVER (PARTITION BY run_a, run_b ORDER BY abs(delta) DESC, portfolio, risk_bucket) AS INTEGER) AS nth
FROM paired QUALIFY nth <= 3"""

ORACLE_SQL["run_pair_sensitivity"] = f"""WITH {BY_PAIR},
bucket AS (
  SELECT policy_id, run_a, run_b, risk_bucket, SUM(base) AS base, SUM(upd) AS upd, SUM(delta) AS delta FROM paired GROUP BY ALL)
SELECT policy_id, run_a, run_b, risk_bucket, {_dbl('base')} AS rwa_baseline, {_dbl('upd')} AS rwa_updated,
  CASE WHEN base = 0 THEN 0 ELSE {_dbl('delta')} / {_dbl('base')} * 100 END AS pct_change
FROM bucket"""

KPIS = f"""SELECT CAST(SUM(d) AS BIGINT) AS total_policies, CAST(SUM(s) AS BIGINT) AS approved_sql, CAST(SUM(r) AS BIGINT) AS successful_runs,
  {_dbl('COALESCE(SUM(a), 0)')} AS total_rwa, {_dbl('COALESCE(SUM(l), 0)')} AS total_rwa_latest_run
FROM (
  SELECT CAST(COUNT(*) AS BIGINT) AS d, 0 AS s, 0 AS r, NULL AS a, NULL AS l FROM docs
  UNION ALL SELECT 0, COUNT(approved_at), 0, NULL, NULL FROM sqls
  UNION ALL SELECT 0, 0, COUNT(*) FILTER (WHERE run_status = 'succeeded'), NULL, NULL FROM runs
  UNION ALL SELECT 0, 0, 0, SUM(rwa), SUM(rwa) FILTER (WHERE run_id = newest) FROM outputs,
    (SELECT max_by(run_id, (started_at, run_id)) AS newest FROM runs WHERE run_status = 'succeeded'))"""

ORACLE_SQL["dashboard_kpis"] = f"WITH {OUTPUTS} {KPIS}"

ORACLE_SQL["lineage_coverage"] = f"""WITH {OUTPUTS},
f AS (
  SELECT o.run_id IN (SELECT run_id FROM runs)
     AND EXISTS (SELECT 1 FROM sqls s WHERE s.sql_version_id = o.sql_version_id AND s.policy_version_id = o.policy_version_id)
     AND EXISTS (SELECT 1 FROM docs d WHERE d.policy_id = o.policy_id AND d.policy_version_id = o.policy_version_id) AS linked
  FROM outputs o)
SELECT COUNT(*) AS total_outputs, COUNT(*) FILTER (WHERE linked) AS linked_outputs,
  COUNT(*) FILTER (WHERE linked) / COUNT(*) AS linked_share FROM f"""

CHAIN = f"""{REG},
chain AS (
  SELECT r.run_id, r.policy_id, r.policy_version_id, r.sql_version_id, d.gcs_uri, d.uploaded_by,
    {_iso('d.uploaded_at')} AS uploaded_at, d.status AS policy_status, 'template-v' || (e.k % 3) AS model_version,
    {_iso('e.ts')} AS extraction_at, 'rules "' || e.k || '"' || chr(10) || 'revised' AS extraction_summary,
    s.validation_status, s.approved_by, {_iso('s.approved_at')} AS approved_at, r.run_status,
    {_iso('r.started_at')} AS run_started, {_iso('r.ended_at')} AS run_ended
  FROM docs d
  JOIN sqls s USING (policy_version_id)
  LEFT JOIN ext e ON e.pvid = d.policy_version_id AND e.rn = 1
  JOIN runs r ON (r.policy_id, r.policy_version_id, r.sql_version_id) = (d.policy_id, d.policy_version_id, s.sql_version_id))"""

ORACLE_SQL["lineage_chain"] = f"WITH {CHAIN} SELECT * FROM chain"

def _json(name: str, column: str, comma: str = ",") -> str:
    return f"""COALESCE('{comma}"{name}":"' || {column} || '"', '')"""


LINEAGE_JSON = " || ".join(
    _json(c, f"h.{c}", "" if i == 0 else ",")
    for i, c in enumerate(
        ["policy_id", "policy_version_id", "sql_version_id", "run_id", "run_status", "approved_by", "validation_status"]
    )
)
KPI_JSON = """'"total_policies":' || total_policies || ',"approved_sql":' || approved_sql || ',"successful_runs":' ||
  successful_runs || ',"total_rwa":' || CAST(CAST(total_rwa AS VARCHAR) AS DECIMAL(38,4)) ||
  ',"total_rwa_latest_run":' || CAST(CAST(total_rwa_latest_run AS VARCHAR) AS DECIMAL(38,4))"""

ORACLE_SQL["context_bundle"] = f"""WITH {PAIRS},
{CHAIN.removeprefix(REG + ",").strip()},
kpi AS ({KPIS}),
docs_json AS (
  SELECT policy_id, run_a, run_b, string_agg(
    '{{"portfolio":"' || portfolio || '","risk_bucket":"' || risk_bucket || '","rwa_baseline":' || CAST(base AS DECIMAL(38,4))
    || ',"rwa_updated":' || CAST(upd AS DECIMAL(38,4)) || ',"rwa_delta":' || CAST(delta AS DECIMAL(38,4)) || '}}',
    ',' ORDER BY portfolio, risk_bucket) AS cells
  FROM paired GROUP BY policy_id, run_a, run_b)
SELECT d.policy_id, d.run_a, d.run_b,
  '{{"rwa_comparison":[' || cells || ']' ||
  CASE WHEN h.run_id IS NULL THEN '' ELSE ',"lineage":{{' || {LINEAGE_JSON} || '}}' END ||
  ',"dashboard_metrics":{{' || (SELECT {KPI_JSON} FROM kpi) || '}}}}' AS context_json
FROM docs_json d LEFT JOIN chain h ON h.run_id = d.run_b"""

ORACLE_SQL["lineage_edges"] = f"""WITH {CHAIN},
nodes AS (
  SELECT run_id, 1 AS n, 'PDF ' || policy_id AS label FROM chain
  UNION ALL SELECT run_id, 2, 'Version ' || policy_version_id FROM chain
  UNION ALL SELECT run_id, 3, 'Extraction ' || COALESCE(model_version, 'N/A') FROM chain
  UNION ALL SELECT run_id, 4, 'SQL ' || sql_version_id FROM chain
  UNION ALL SELECT run_id, 5, 'Approved by ' || COALESCE(approved_by, 'N/A') FROM chain
  UNION ALL SELECT run_id, 6, 'Run ' || run_id FROM chain
  UNION ALL SELECT run_id, 7, 'RWA Outputs' FROM chain)
SELECT a.run_id, CAST(a.n AS BIGINT) AS seq, a.label AS src, b.label AS dst
FROM nodes a JOIN nodes b ON a.run_id = b.run_id AND b.n = a.n + 1"""

ORACLE_SQL["policy_timeline"] = f"""WITH {REG},
act AS (
  SELECT COALESCE(s.policy_version_id, r.policy_version_id) AS pv, COALESCE(s.sql_version_id, r.sql_version_id) AS sv,
    r.run_id, s.approved_at, s.approved_by, s.validation_status, r.run_status, r.started_at, r.ended_at
  FROM sqls s FULL OUTER JOIN runs r
    ON s.policy_version_id = r.policy_version_id AND s.sql_version_id = r.sql_version_id)
SELECT d.policy_id, d.policy_version_id, d.uploaded_at, d.uploaded_by, d.status AS policy_status,
  d.supersedes_policy_version_id, a.sv AS sql_version_id, a.validation_status, a.approved_at, a.approved_by, a.run_id,
  a.run_status, a.started_at, a.ended_at
FROM docs d LEFT JOIN act a ON a.pv = d.policy_version_id"""

ORACLE_SQL["policy_event_timeline"] = f"""WITH {REG}
SELECT policy_id, uploaded_at AS event_ts, 'Upload' AS event_kind, policy_version_id || ' by ' || uploaded_by AS text FROM docs
UNION ALL
SELECT d.policy_id, s.approved_at, 'SQL Approval', s.sql_version_id || ' by ' || s.approved_by
FROM sqls s JOIN docs d USING (policy_version_id) WHERE s.approved_at IS NOT NULL
UNION ALL
SELECT policy_id, started_at, 'Run', run_id || ' ' || run_status FROM runs"""

ORACLE_SQL["sql_versions_by_policy"] = f"""WITH {REG}
SELECT d.policy_id, s.sql_version_id, s.policy_version_id, s.validation_status, s.approved_at, s.approved_by,
  {GENERATED_SQL} AS generated_sql
FROM sqls s JOIN docs d USING (policy_version_id)"""

ORACLE_SQL["extraction_details"] = f"""WITH {REG}, top AS (
  SELECT policy_version_id, sql_version_id, {GENERATED_SQL} AS generated_sql, {AGENT_TRACE} AS agent_trace FROM sqls
  QUALIFY ROW_NUMBER() OVER (PARTITION BY policy_version_id ORDER BY approved_at DESC NULLS LAST, sql_version_id DESC) = 1)
SELECT t.generated_sql, t.agent_trace, '{{"summary":' || {SUMMARY} || '}}' AS clause_citations, e.pvid AS policy_version_id, t.sql_version_id, 'template-v' || (e.k % 3) AS model_version,
  d.supersedes_policy_version_id,
  '{{"policy_gcs_uri":"policies/source-' || e.k || '.pdf","summary":"rules \\"' || e.k || '\\"\\nrevised"}}' AS extraction_json
FROM ext e LEFT JOIN top t ON t.policy_version_id = e.pvid LEFT JOIN docs d ON d.policy_version_id = e.pvid
WHERE e.rn = 1"""

ORACLE_SQL["sql_version_details"] = f"""WITH {REG}
SELECT s.sql_version_id, s.policy_version_id, s.validation_status, d.supersedes_policy_version_id,
  {GENERATED_SQL} AS generated_sql, {AGENT_TRACE} AS agent_trace
FROM sqls s JOIN docs d USING (policy_version_id)"""

ORACLE_SQL["recent_runs"] = f"""WITH {REG}
SELECT run_id, run_status, started_at, run_id || ' (' || run_status || ') — ' || COALESCE(policy_version_id, '') AS label,
  policy_id, policy_version_id, sql_version_id
FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 50"""

ORACLE_SQL["table_browse"] = "SELECT * FROM documents ORDER BY doc_id DESC LIMIT 200"

ORACLE_SQL["policy_objects"] = """SELECT 'policies/doc-' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') || '.txt' AS uri,
  'text/plain' AS content_type, d.n_chars AS size, d.doc_id AS updated, md5(d.text) AS md5_hash,
  'POL-' || l.doc_id AS policy_id, CAST(NULL AS VARCHAR) AS uploaded_by, CASE WHEN l.doc_id IS NOT NULL THEN 'draft' END AS status,
  CASE WHEN l.doc_id IS NOT NULL THEN 'POL-' || l.doc_id || '-V1' END AS policy_version_id,
  l.doc_id IS NOT NULL AS registered
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
ORDER BY d.doc_id DESC LIMIT 100"""

# --- rule text ---------------------------------------------------------------

DRIFT = f"""{REG},
live(tab, i, col) AS (VALUES
  ('events', 0, 'event_id'), ('events', 1, 'ts'), ('events', 2, 'user_id'), ('events', 3, 'event_type'),
  ('events', 4, 'value'), ('events', 5, 'props'), ('documents', 0, 'doc_id'), ('documents', 1, 'text'),
  ('documents', 2, 'lang'), ('documents', 3, 'source'), ('documents', 4, 'n_chars')),
snap AS (
  SELECT sql_version_id, k, CASE WHEN k % 10 = 9 THEN 'no_snapshot' WHEN k % 4 = 1 THEN 'removed_columns'
    WHEN k % 3 = 0 OR k % 5 = 0 THEN 'new_columns' ELSE 'compatible' END AS verdict
  FROM sqls),
drift AS (
  SELECT sql_version_id, tab || '.' || col AS column_path, 'added' AS kind, verdict
  FROM snap JOIN live ON (tab = 'events' AND k % 3 = 0 AND i = k % 6) OR (tab = 'documents' AND k % 5 = 0)
  WHERE verdict <> 'no_snapshot'
  UNION ALL SELECT sql_version_id, 'events.legacy_k', 'removed', verdict FROM snap WHERE verdict = 'removed_columns'
  UNION ALL SELECT sql_version_id, NULL, NULL, verdict FROM snap WHERE verdict IN ('no_snapshot', 'compatible'))"""

ORACLE_SQL["schema_drift"] = f"WITH {DRIFT} SELECT sql_version_id, column_path, kind, verdict FROM drift"

ORACLE_SQL["schema_drift_counts"] = f"""WITH {DRIFT}
SELECT verdict, COUNT(DISTINCT sql_version_id) AS versions, COUNT(*) FILTER (WHERE kind = 'added') AS added,
  COUNT(*) FILTER (WHERE kind = 'removed') AS removed, COUNT(*) FILTER (WHERE kind = 'retyped') AS retyped,
  COUNT(*) FILTER (WHERE kind = 'missing') AS missing
FROM drift GROUP BY verdict"""

ORACLE_SQL["sql_version_diff"] = r"""WITH raw AS (
  SELECT source AS policy_id, doc_id, LAG(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev,
    LEAD(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt,
    string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS ls
  FROM documents),
ln AS (
  SELECT policy_id, doc_id, prev, nxt,
    unnest(CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END) AS line FROM raw),
signed AS (
  SELECT doc_id AS b, line, 1 AS n FROM ln WHERE prev IS NOT NULL
  UNION ALL SELECT nxt, line, -1 FROM ln WHERE nxt IS NOT NULL),
net AS (SELECT b, line, SUM(n) AS n FROM signed GROUP BY b, line),
per AS (SELECT b, SUM(GREATEST(n, 0)) AS up, SUM(GREATEST(-n, 0)) AS down FROM net GROUP BY b)
SELECT r.policy_id, r.prev AS version_a, r.doc_id AS version_b, CAST(COALESCE(up, 0) AS BIGINT) AS lines_added,
  CAST(COALESCE(down, 0) AS BIGINT) AS lines_removed, CAST(COALESCE(up - down, 0) AS BIGINT) AS net
FROM raw r LEFT JOIN per ON per.b = r.doc_id WHERE r.prev IS NOT NULL"""

ORACLE_SQL["sql_version_hunks"] = r"""WITH RECURSIVE raw AS (
  SELECT source AS policy_id, doc_id, LAG(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev,
    LEAD(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt,
    string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS parts
  FROM documents),
whole AS (SELECT *, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS ls FROM raw),
flat AS (SELECT doc_id, prev, nxt, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM whole),
ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM flat),
old AS (SELECT nxt AS pair, pos, line, nth FROM ln WHERE nxt IS NOT NULL),
new AS (SELECT doc_id AS pair, pos, line, nth FROM ln WHERE prev IS NOT NULL),
anchor AS (SELECT pair, o.pos AS a, n.pos AS b FROM old o JOIN new n USING (pair, line, nth)),
reach AS (
  SELECT pair, a, b, 1 AS level FROM anchor
  UNION
  SELECT y.pair, y.a, y.b, x.level + 1 FROM reach x JOIN anchor y ON x.pair = y.pair AND x.a < y.a AND x.b < y.b),
leveled AS (SELECT pair, a, b, max(level) AS level FROM reach GROUP BY ALL),
linked AS (
  SELECT y.pair, y.a, y.b, y.level, max(x.a) AS back
  FROM leveled y LEFT JOIN leveled x ON x.pair = y.pair AND x.level = y.level - 1 AND x.a < y.a GROUP BY ALL),
chain AS (
  SELECT pair, a, b, back, level FROM linked QUALIFY row_number() OVER (PARTITION BY pair ORDER BY level DESC, b) = 1
  UNION ALL
  SELECT l.pair, l.a, l.b, l.back, l.level FROM chain c JOIN linked l ON l.pair = c.pair AND l.a = c.back AND l.level = c.level - 1),
matches AS (SELECT pair, a, b, row_number() OVER (PARTITION BY pair ORDER BY a) AS k FROM chain),
rows AS (
  SELECT pair, k, 0 AS step, a AS line_a, b AS line_b, line, a AS pos FROM matches JOIN old USING (pair) WHERE old.pos = a
  UNION ALL
  SELECT o.pair, (SELECT count(*) FROM matches m WHERE m.pair = o.pair AND m.a < o.pos), 1, o.pos, NULL, o.line, o.pos
  FROM old o ANTI JOIN matches m ON m.pair = o.pair AND m.a = o.pos
  UNION ALL
  SELECT n.pair, (SELECT count(*) FROM matches m WHERE m.pair = n.pair AND m.b < n.pos), 2, NULL, n.pos, n.line, n.pos
  FROM new n ANTI JOIN matches m ON m.pair = n.pair AND m.b = n.pos),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY k, step, pos) AS place FROM rows),
near AS (
  SELECT * FROM placed p WHERE EXISTS (
    SELECT 1 FROM placed c WHERE c.pair = p.pair AND c.step > 0 AND abs(c.place - p.place) <= 3)),
islands AS (SELECT *, place - row_number() OVER (PARTITION BY pair ORDER BY place) AS island FROM near)
SELECT policy_id, prev AS version_a, doc_id AS version_b,
  CAST(dense_rank() OVER (PARTITION BY pair ORDER BY island) AS INTEGER) AS hunk,
  CAST(row_number() OVER (PARTITION BY pair ORDER BY place) AS INTEGER) AS row,
  ['context', 'removed', 'added'][step + 1] AS kind, CAST(line_a AS INTEGER) AS line_a, CAST(line_b AS INTEGER) AS line_b, line
FROM islands JOIN raw ON raw.doc_id = pair"""

CLAUSES = f"""{REG},
c AS (
  SELECT sql_version_id, k, CASE WHEN k % 3 = 0 THEN 'V1-C' ELSE 'C' END || (k % 10) AS id1,
    CASE WHEN k % 11 <> 0 THEN 'V2-C' || (k % 13) END AS id2
  FROM sqls),
cited AS (
  SELECT sql_version_id, k, id1 AS cid, CASE WHEN k % 7 <> 0 THEN k % 5 ELSE 4 END AS t FROM c WHERE k % 25 <> 24
  UNION ALL SELECT sql_version_id, k, id2, (k + 1) % 5 FROM c WHERE k % 25 <> 24 AND k % 2 = 0),
clauses AS (
  SELECT sql_version_id, COALESCE(cid, '?') AS clause_id,
    CASE t WHEN 0 THEN 'Threshold' WHEN 1 THEN 'Mapping' WHEN 2 THEN 'Calculation' WHEN 3 THEN 'Exclusion'
      ELSE 'Definition' END AS clause_type,
    CASE WHEN cid LIKE 'V1-%' THEN 'Initial' WHEN cid LIKE 'V2-%' THEN 'Update' ELSE 'Unversioned' END AS origin,
    'weight rule ' || k AS clause_text, 'weights' AS sql_section
  FROM cited),
commented AS (
  SELECT sql_version_id, id1 AS cid FROM c WHERE k % 4 <> 1
  UNION ALL SELECT sql_version_id, 'C77' FROM c WHERE k % 6 = 0
  UNION ALL SELECT sql_version_id, id2 FROM c WHERE k % 2 = 0 AND k % 11 <> 0)"""

ORACLE_SQL["clause_table"] = f"WITH {CLAUSES} SELECT * FROM clauses"

ORACLE_SQL["clause_type_counts"] = f"""WITH {CLAUSES}
SELECT clause_type, origin, COUNT(*) AS n FROM clauses GROUP BY clause_type, origin"""

ORACLE_SQL["clause_traceability"] = f"""WITH {CLAUSES},
a AS (SELECT DISTINCT sql_version_id, cid FROM cited WHERE cid IS NOT NULL),
b AS (SELECT DISTINCT sql_version_id, cid FROM commented)
SELECT COALESCE(a.sql_version_id, b.sql_version_id) AS sql_version_id, COALESCE(a.cid, b.cid) AS clause_id,
  CASE WHEN b.cid IS NULL THEN 'cited_only' WHEN a.cid IS NULL THEN 'commented_only' ELSE 'matched' END AS link_status
FROM a FULL OUTER JOIN b ON a.sql_version_id = b.sql_version_id AND a.cid = b.cid"""

# --- transactions ------------------------------------------------------------

TX = """tx AS (
  SELECT 'TX-' || event_id AS transaction_id, 'CH-' || (1001 + user_id % 4) AS cardholder_id,
    CAST(value AS DECIMAL(18,2)) AS amt,
    CAST(CASE user_id % 4 WHEN 0 THEN 250 WHEN 1 THEN 100 WHEN 2 THEN 500 ELSE 75 END AS DECIMAL(18,2)) AS lim, ts
  FROM events)"""
MONEY = f"{_dbl('amt')} AS transaction_amount, {_dbl('lim')} AS credit_limit"

ORACLE_SQL["breach_events"] = f"""WITH {TX}
SELECT transaction_id, cardholder_id, {MONEY}, ts AS breached_at FROM tx WHERE amt > lim"""

ORACLE_SQL["breach_by_cardholder"] = f"""WITH {TX}
SELECT cardholder_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE amt > lim) AS breaches FROM tx GROUP BY cardholder_id"""

ORACLE_SQL["breach_stream"] = f"WITH {TX} SELECT transaction_id, cardholder_id, {MONEY} FROM tx WHERE amt > lim"

ORACLE_SQL["feed_metrics_stream"] = f"""WITH {TX}
SELECT COUNT(*) AS total_count, {_dbl('SUM(amt)')} / COUNT(amt) AS avg_amount,
  COUNT(*) FILTER (WHERE amt > lim) AS breach_count FROM tx"""

ORACLE_SQL["transaction_feed"] = f"""WITH {TX}
SELECT transaction_id, cardholder_id, {MONEY}, ts AS transaction_time FROM tx
ORDER BY ts DESC, transaction_id DESC LIMIT 30"""


# Logistic regression by Newton steps over counted rows; amounts in hundreds.
FIT = f"""{TX},
swipes AS (
  SELECT tx.*, amt / 100.0 AS x, lim / 100.0 AS z,
    CAST((amt > lim) <> (CAST(substr(transaction_id, 4) AS BIGINT) % 50 = 0) AS INTEGER) AS y FROM tx),
counted AS (
  SELECT CAST(x AS DOUBLE) AS x, CAST(z AS DOUBLE) AS z, y, COUNT(*) AS w FROM swipes
  WHERE x IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
steps AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c
  UNION ALL
  SELECT i + 1,
    a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
    b + (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
    c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (
    SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
    FROM (
      SELECT i, a, b, c, SUM(w * (y - p)) AS g0, SUM(w * (y - p) * x) AS g1, SUM(w * (y - p) * z) AS g2,
        SUM(w * p * (1 - p)) AS h00, SUM(w * p * (1 - p) * x) AS h01, SUM(w * p * (1 - p) * z) AS h02,
        SUM(w * p * (1 - p) * x * x) AS h11, SUM(w * p * (1 - p) * x * z) AS h12, SUM(w * p * (1 - p) * z * z) AS h22
      FROM (SELECT s.*, d.*, 1 / (1 + exp(-(a + b * x + c * z))) AS p FROM steps s, counted d WHERE i < 25)
      GROUP BY i, a, b, c))),
scored AS (
  SELECT s.*, 1 / (1 + exp(-(a + b * CAST(x AS DOUBLE) + c * CAST(z AS DOUBLE)))) AS p
  FROM swipes s, (SELECT * FROM steps ORDER BY i DESC LIMIT 1)),
marked AS (
  SELECT transaction_id, cardholder_id, amt, lim, ts, CAST(p > 0.5 AS INTEGER) AS predicted_label,
    CASE WHEN p IS NULL THEN NULL WHEN p > 0.5 THEN round(p, 2) ELSE 0.0 END AS fraud_score,
    CASE WHEN p > 0.5 THEN 'High Risk (ML)' ELSE 'Standard Transaction' END AS alert
  FROM scored)"""

ORACLE_SQL["fraud_scores"] = f"""WITH RECURSIVE {FIT}
SELECT transaction_id, {MONEY}, predicted_label, CAST(fraud_score AS DOUBLE) AS fraud_score, alert FROM marked"""

ORACLE_SQL["class_probabilities"] = f"""WITH RECURSIVE {FIT}
SELECT transaction_id, round(1 - p, 2) AS ordinary, round(p, 2) AS fraud FROM scored"""

ORACLE_SQL["scored_feed"] = f"""WITH RECURSIVE {FIT}
SELECT transaction_id, cardholder_id, {MONEY}, ts AS transaction_time, predicted_label,
  CAST(fraud_score AS DOUBLE) AS fraud_score, alert
FROM marked ORDER BY ts DESC, transaction_id DESC LIMIT 30"""

ORACLE_SQL["fraud_feed_metrics"] = f"""WITH RECURSIVE {FIT}
SELECT COUNT(*) AS total_count, {_dbl('SUM(amt)')} / COUNT(amt) AS avg_amount,
  COUNT(*) FILTER (WHERE predicted_label = 1) AS fraud_count FROM marked"""

ORACLE_SQL["scored_stream"] = f"""WITH RECURSIVE {FIT}
SELECT transaction_id, predicted_label, CAST(fraud_score AS DOUBLE) AS fraud_score, alert FROM marked"""

# A snapshot and its tail give what the full fold gives.
ORACLE_SQL |= {f"{name}_from_snapshot": ORACLE_SQL[name] for name in ("document_state", "sql_version_state", "run_state")}

# --- sources and sinks -------------------------------------------------------

NEWEST = f"""WITH {TX}
SELECT transaction_id, cardholder_id, {MONEY}, ts AS {{time}} FROM tx {{where}} ORDER BY ts DESC, transaction_id DESC LIMIT 10"""
ORACLE_SQL["fallback_feed"] = NEWEST.format(time="transaction_time", where="")
ORACLE_SQL["raw_breaches"] = NEWEST.format(time="breached_at", where="WHERE amt > lim")
ORACLE_SQL["breach_stamps"] = f"WITH {TX} SELECT transaction_id, TRUE AS stamped_now FROM tx WHERE amt > lim"


def _minted(prefix: str, key: str, length: int) -> str:
    return f"'{prefix}' || upper(left(sha256({key}), {length}))"


ORACLE_SQL["document_intake"] = f"""WITH named AS (
  SELECT doc_id, text, doc_id || '.pdf' AS filename,
    {_minted('POL-', "concat_ws(chr(0), source, CAST(doc_id AS VARCHAR))", 24)} AS policy_id
  FROM documents),
versioned AS (SELECT *, policy_id || {_minted('-V', "concat_ws(chr(0), policy_id, filename)", 16)} AS policy_version_id FROM named),
told AS (SELECT *, coalesce(trim(text, ' '), 'Policy ' || policy_version_id || ' parsed.') AS summary FROM versioned)
SELECT doc_id, policy_id, policy_version_id, 'policies/' || policy_version_id || '/' || filename AS gcs_uri, summary,
  'Extraction complete: ' || left(summary, 120) AS progress
FROM told"""

ORACLE_SQL["unlabelled_documents"] = "SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)"


def _column_json(columns: str) -> str:
    rows = [c.split() for c in columns.split(", ")]
    return "[" + ",".join(f'{{"column_name":"{c}","data_type":"{t}"}}' for c, t in rows) + "]"


_LIVE = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
ORACLE_SQL["live_schema_snapshot"] = (
    """SELECT '{"project":"demo","dataset":"capital","tables":{"""
    + ",".join(f'"{t}":{_column_json(c)}' for t, c in _LIVE.items())
    + """}}' AS schema_snapshot, CAST(count(*) AS INTEGER) AS table_count
FROM (SELECT DISTINCT table_name FROM duckdb_columns() WHERE table_name IN ('events', 'documents'))"""
)
ORACLE_SQL["table_listing"] = "SELECT count(*) > 0 AS listed, 'application/octet-stream' AS content_type FROM documents"

ORACLE_SQL["rewritten_breaches"] = f"""WITH {TX}
SELECT transaction_id, CASE WHEN amt > 2 * lim THEN cardholder_id END AS cardholder_id, {MONEY}, ts AS breached_at FROM tx WHERE amt > lim"""

ORACLE_SQL["reset_tables"] = f"""WITH {OUTPUTS}
SELECT table_name, n AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM (
  SELECT 'policy_documents' AS table_name, count(*) AS n FROM docs
  UNION ALL SELECT 'policy_extractions', count(*) FROM ext
  UNION ALL SELECT 'policy_sql_versions', count(*) FROM sqls
  UNION ALL SELECT 'report_runs', count(*) FROM runs
  UNION ALL SELECT 'rwa_report_outputs', count(*) FROM outputs WHERE run_id IN (SELECT run_id FROM gate WHERE approved))"""

ORACLE_SQL["derived_rwa_table"] = ORACLE_SQL["rwa_by_policy_version"]
ORACLE_SQL["rerun_report_outputs"] = ORACLE_SQL["gated_report_outputs"]
ORACLE_SQL["exported_lineage"] = ORACLE_SQL["lineage_chain"]
ORACLE_SQL["exported_comparison"] = f"""WITH {CMP}
SELECT coalesce(portfolio, 'None') AS portfolio, coalesce(risk_bucket, 'None') AS risk_bucket, {CMP_COLUMNS} FROM cmp"""

ORACLE_SQL["exported_graph_lines"] = f"""WITH {CHAIN},
one AS (SELECT * FROM chain ORDER BY run_id DESC LIMIT 1)
SELECT unnest(['graph LR', '    PDF[Policy PDF ' || policy_id || '] --> VER[Version ' || policy_version_id || ']',
  '    VER --> EXT[Extraction model: ' || coalesce(model_version, 'N/A') || ']', '    EXT --> SQL[SQL ' || sql_version_id || ']',
  '    SQL --> APPROVE[Approved by ' || coalesce(approved_by, 'N/A') || ']', '    APPROVE --> RUN[Run ' || run_id || ']',
  '    RUN --> OUT[RWA Outputs]']) AS value
FROM one"""
