"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(expression: str) -> str:
    return f"translate({expression}, '{UPPER}', '{LOWER}')"


OP1 = rf"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
  ('com/fr/', 'allow'), ('com/de/', 'block')),
split AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
judged AS (
  SELECT page_id, host, path, (
      SELECT max({{'n': length(rule), 'rule': rule, 'verdict': verdict}}) FROM split
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM parts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""

WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS.format(lower("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(lower("coalesce(text, '')"))} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS phrase FROM (
    SELECT item_id, list_slice(w, i, i + 12) AS x FROM (
      SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM phrases),
grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (
  SELECT doc_id, i, g.n, item_id FROM grams g JOIN phrases p ON g.n = p.n AND g.phrase = p.phrase),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos, {lower("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id
"""


def _draw(name: str) -> str:
    bits = f"CAST(CAST('0x' || substr(md5('{name}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE)"
    return f"(-ln(({bits} + 0.5) / 4503599627370496.0))"


def _descend(region_weights: list[float]) -> str:
    """Shard by region, rack and shard draws; the third region has one shard, number 16."""

    def level(names: list[str], weights: list[float], below: list[str]) -> str:
        draws = [f"{_draw(n)} / {w}" for n, w in zip(names, weights)]
        first = f"list_position([{', '.join(draws)}], least({', '.join(draws)}))"
        whens = " ".join(f"WHEN {i + 1} THEN {b}" for i, b in enumerate(below))
        return f"CASE {first} {whens} END"

    regions = []
    for r in range(2):
        racks = []
        for k in range(2):
            start = 8 * r + 4 * k
            names = [f"/region{r}/rack{r}{k}/{start + s}" for s in range(4)]
            racks.append(level(names, [1.0] * 4, [str(start + s) for s in range(4)]))
        regions.append(level([f"/region{r}/rack{r}{k}" for k in range(2)], [4.0] * 2, racks))
    regions.append("16")
    n = len(region_weights)
    return level([f"/region{r}" for r in range(n)], region_weights, regions[:n])


def _crc_table() -> list[int]:
    """CRC-32 of each byte value, from the reflected polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


BYTES = "list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda p: CAST('0x' || p AS BIGINT))"
CRC32 = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {BYTES}),
    lambda a, b: xor(a >> 8, CAST({_crc_table()} AS BIGINT[])[(xor(a, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"""

OP7 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, CAST({_descend([8.0, 8.0])} AS INTEGER) AS shard,
    CAST({_descend([8.0, 8.0, 1.0])} AS INTEGER) AS grown_shard
  FROM documents)
SELECT doc_id, shard, grown_shard, 'key' AS law, octet_length(encode(body)) + 1 AS size, {CRC32} AS text_crc32,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot
FROM d
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {lower("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body)
"""

def _share(count: str, total: str, kept: str) -> str:
    return f"CAST(1 + (CAST(1000000000 AS HUGEINT) * ({count} + 2)) // ({total} + 2 * {kept}) AS BIGINT)"


GAP = "((p - q) * (p - q)) // (p + q)"

OP12 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({lower("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
places AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM places GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, l.n AS lang_n, coalesce((
      SELECT sum(c.n) FROM counts c JOIN kept k ON c.lang = k.lang AND c.term = k.term WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l ON g.lang = l.lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_share("coalesce(c.n, 0)", "g.n", "g.v")} AS p,
    {_share("k.n", "g.lang_n", "g.v")} AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum({GAP.replace("p", "a.p").replace("q", "b.p")}) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST({GAP} AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1,
    "op3_decontamination": OP3,
    "op5_line_dedup": OP5,
    "op7_sharding": OP7,
    "op10_exact_dedup": OP10,
    "op12_divergence": OP12,
}
