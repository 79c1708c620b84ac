"""DuckDB table expressions the oracle queries are built from.

The data (fragments, curated lists, token patterns) is shared with the library; the logic is
written again here, mostly as plain joins over token positions.
"""

from riskweave.functions import lexing
from riskweave.plans import corpus
from riskweave.sources import dims


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def members(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def _pattern(spark_pattern: str) -> str:
    """The engine here has no possessive quantifiers; a comment ends with its line instead."""
    for mark in ("#", "//"):
        spark_pattern = spark_pattern.replace(mark + r"[^\n]*+", mark + r"[^\n]*\n")
    return quoted("(?s)" + spark_pattern.replace("*+", "*").replace("++", "+").replace("?+", "?"))


def _pick(fragments, slots: str) -> str:
    size = len(fragments)
    return (
        f"array_to_string(list_transform({slots}, lambda s: {listed(fragments)}"
        f"[CAST((n * (s * 2 + 7) + s * 13) % {size} + 1 AS INTEGER)]), chr(10))"
    )


def _fault(fragments) -> str:
    return (
        f"CASE WHEN n % 40 = 0 THEN {listed(fragments)}[CAST((n // 40) % {len(fragments)} + 1 AS INTEGER)] "
        "|| chr(10) ELSE '' END"
    )


def _told(mark: str) -> str:
    return f"'{mark}' || replace(text, chr(10), chr(10) || '{mark}') || chr(10)"


FILES = f"""
corpus_code AS (
  SELECT doc_id AS id,
    replace(CASE WHEN doc_id % 2 = 1 THEN
      {_pick(corpus.JAVA_IMPORTS, 'range(0, n % 3 + 1)')} || chr(10) || chr(10) || 'public class Doc@N@ {{' || chr(10)
      || {_pick(corpus.JAVA_BODY, 'range(1, n % 4 + 4)')} || chr(10) || {_fault(corpus.JAVA_BROKEN)} || '}}' || chr(10) || {_told('// ')}
    ELSE
      {_pick(corpus.PY_IMPORTS, 'range(0, n % 3 + 1)')} || chr(10) || chr(10)
      || {_pick(corpus.PY_BODY, 'range(1, n % 4 + 4)')} || chr(10) || {_fault(corpus.PY_BROKEN)} || {_told('# ')}
    END, '@N@', CAST(n AS VARCHAR)) AS code
  FROM (SELECT doc_id, text, n_chars AS n FROM documents)
),
files AS (
  SELECT CASE kind WHEN 0 THEN id WHEN 1 THEN -1 - id END AS file_id,
    CASE WHEN id % 70 = 0 THEN NULL
         WHEN id % 50 = 0 OR id % 30 = 15 THEN 'doc_' || id || '.txt'
         WHEN id % 2 = 1 AND id % 14 = 1 THEN 'doc_' || id || '.JAVA'
         WHEN id % 2 = 1 THEN 'doc_' || id || '.java'
         ELSE 'doc_' || id || '.py' END AS filename,
    CASE WHEN id % 30 = 0 THEN 'python' WHEN id % 30 = 15 THEN 'java' WHEN id % 30 = 7 THEN 'Java' END AS language_override,
    CASE WHEN kind = 0 THEN code WHEN id % 90 = 4 THEN '' WHEN id % 90 = 8 THEN ' ' || chr(10) || chr(9) || ' '
         WHEN id % 90 = 16 THEN 'pass' || chr(10) END AS code
  FROM (SELECT *, unnest(CASE WHEN id % 90 IN (4, 8, 12) THEN [0, 1] WHEN id % 90 = 16 THEN [0, 2] ELSE [0] END) AS kind FROM corpus_code)
),
good AS (
  SELECT file_id, coalesce(filename, 'pasted_snippet.py') AS filename,
    CASE WHEN language_override IN ('python', 'java') THEN language_override
         WHEN lower(coalesce(filename, '')) LIKE '%.java' THEN 'java' ELSE 'python' END AS language, code
  FROM files WHERE code IS NOT NULL AND regexp_matches(code, '\\S') AND file_id IS NOT NULL
)"""

# chr(1) ends a file here; the count of matches up to a token is its position
TOKENS = f"""
matches AS (
  SELECT file_id, language, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos FROM (
    SELECT file_id, language, CASE WHEN language = 'java'
      THEN regexp_extract_all(code || chr(10) || chr(1), {_pattern(lexing.java_token(2))}, 0)
      ELSE regexp_extract_all(code || chr(10) || chr(1), {_pattern(lexing.PY_TOKEN)}, 0) END AS ms
    FROM good)
),
split_matches AS (
  SELECT file_id, language, pos, m,
    CASE WHEN language = 'java' THEN regexp_replace(m, '^' || {_pattern(lexing.JAVA_TRIVIA)}, '')
         ELSE regexp_replace(m, '^' || {_pattern(lexing.PY_TRIVIA)}, '') END AS raw
  FROM matches
),
measured AS (
  SELECT *, left(m, length(m) - length(raw)) AS lead,
    length(m) - length(replace(m, chr(10), '')) AS nl_all,
    length(raw) - length(replace(raw, chr(10), '')) AS nl_tok
  FROM split_matches
),
toks AS (
  SELECT file_id, language, pos,
    CASE WHEN regexp_matches(raw, '^[A-Za-z_]') AND raw NOT LIKE 'catch%' AND raw NOT LIKE '%"' AND raw NOT LIKE '%'''
         THEN regexp_replace(raw, '\\s+', '', 'g') ELSE raw END AS tok,
    CAST(1 + sum(nl_all) OVER (PARTITION BY file_id ORDER BY pos) - nl_tok AS INTEGER) AS line,
    language = 'python' AND (pos = 0 OR contains(regexp_replace(regexp_replace(lead, '#[^\\n]*', '', 'g'), '\\\\\\n', '', 'g'), chr(10))) AS brk,
    length(regexp_extract(lead, '[^\\n]*$')) AS margin
  FROM measured
),
t0 AS (
  SELECT *, CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END AS delta,
    CASE WHEN (tok LIKE '%"' OR tok LIKE '%''') AND length(tok) > 1 THEN 's'
         WHEN language = 'java' AND (split_part(tok, '.', 1) IN {members(lexing.JAVA_KEYWORDS)} OR tok LIKE 'catch (%') THEN 'k'
         WHEN language = 'python' AND split_part(tok, '.', 1) IN {members(lexing.PY_KEYWORDS)} THEN 'k'
         WHEN regexp_matches(tok, '^[A-Za-z_\\x{{80}}-\\x{{10FFFF}}]') THEN 'n'
         WHEN regexp_matches(tok, '^[0-9]') THEN 'd'
         WHEN tok LIKE '<%>' THEN 'g' ELSE 'o' END AS kind
  FROM toks
),
t1 AS (
  SELECT *, sum(delta) OVER w AS depth,
    lag(tok, 1, '') OVER w AS p1, lag(tok, 2, '') OVER w AS p2, lag(tok, 3, '') OVER w AS p3,
    lead(tok, 1, '') OVER w AS n1, lead(tok, 2, '') OVER w AS n2, lead(tok, 3, '') OVER w AS n3, lead(tok, 4, '') OVER w AS n4,
    lag(kind, 1, '') OVER w AS pk1, lag(kind, 2, '') OVER w AS pk2, lag(line) OVER w AS p1_line,
    lead(line, 2) OVER w AS n2_line, lead(brk, 1, false) OVER w AS n_brk
  FROM t0 WINDOW w AS (PARTITION BY file_id ORDER BY pos)
),
t2 AS (
  SELECT *, CASE WHEN delta < 0 THEN depth + 1 ELSE depth END AS level, depth - delta AS outer_depth,
    brk AND depth - delta = 0 AS line_start,
    language = 'python' AND depth - delta = 0 AND (brk OR p1 IN (';', ':')) AS begins
  FROM t1
),
t AS MATERIALIZED (
  SELECT *,
    max(CASE WHEN begins THEN pos END) OVER (PARTITION BY file_id ORDER BY pos) AS stmt_pos,
    max(CASE WHEN line_start THEN pos END) OVER (PARTITION BY file_id ORDER BY pos) AS line_pos,
    max(CASE WHEN delta > 0 THEN pos END) OVER (PARTITION BY file_id, level ORDER BY pos) AS open_pos
  FROM t2
),
head AS (SELECT file_id, pos, tok, line FROM t WHERE begins),
opener AS MATERIALIZED (
  SELECT file_id, pos, level, tok, p1, p2, p3, pk1, pk2, p1_line, line_start, close_pos
  FROM (SELECT *, min(CASE WHEN delta < 0 THEN pos END) OVER (
    PARTITION BY file_id, level ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close_pos FROM t) WHERE delta > 0
),
shape AS (SELECT o.*, c.n1 AS after, c.p1 AS last_in FROM opener o LEFT JOIN t c ON c.file_id = o.file_id AND c.pos = o.close_pos)"""
