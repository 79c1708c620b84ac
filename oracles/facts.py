"""Fact and rule table expressions in DuckDB SQL."""

from oracles.base import FILES, TOKENS, listed, members, quoted
from riskweave.operators import rules
from riskweave.sources import dims

_PRIMITIVES = members(["void", "int", "long", "double", "float", "boolean", "char", "byte", "short"])
_MODIFIERS = members(["public", "protected", "private", ";", "{", "}"])
_TIGHT = members(["+", "-", "*", "/", "//", "%", "**", "@", "|", "&", "^", "<<", ">>", "~", ".", "await"])
_COMPARE = members(["==", "!=", "<", ">", "<=", ">=", "is", "in"])
_TYPED = (
    f"(s.pk2 IN ('n', 'g') OR s.p2 IN {_PRIMITIVES} OR s.p2 = ']') AND s.p2 <> 'record' AND s.p3 NOT IN ('.', '@') "
    f"AND NOT (s.pk2 = 'g' AND s.p3 IN {_MODIFIERS})"
)

IMPORTS = """
first_import AS (SELECT file_id, stmt_pos, min(pos) AS import_pos FROM t WHERE tok = 'import' AND language = 'python' GROUP BY ALL),
py_import AS (
  SELECT i.file_id, i.pos, h.line, CASE WHEN h.tok = 'from' THEN m.tok ELSE i.tok END AS path,
    CASE WHEN i.n1 = 'as' THEN i.n2 WHEN h.tok = 'from' THEN i.tok ELSE split_part(i.tok, '.', 1) END AS bound_name,
    i.tok = '*' AS wildcard, h.tok = 'from' AS is_from, k.import_pos
  FROM t i JOIN head h ON h.file_id = i.file_id AND h.pos = i.stmt_pos AND h.tok IN ('import', 'from')
  JOIN first_import k ON k.file_id = i.file_id AND k.stmt_pos = i.stmt_pos
  LEFT JOIN t m ON m.file_id = i.file_id AND m.pos = k.import_pos - 1 AND m.kind = 'n' AND h.tok = 'from'
  WHERE i.language = 'python' AND i.pos > k.import_pos AND (i.kind = 'n' OR i.tok = '*') AND i.p1 IN ('import', ',', '(')
),
java_import AS (
  SELECT file_id, pos, line, CASE WHEN n1 = 'static' THEN n2 ELSE n1 END AS path,
    CASE WHEN n1 = 'static' THEN n3 ELSE n2 END = '.' AS wildcard
  FROM t WHERE language = 'java' AND tok = 'import' AND level = 0
)"""

DEFS = f"""
py_line AS MATERIALIZED (SELECT * FROM t WHERE line_start),
py_def AS (
  SELECT d.file_id, d.pos, d.n1 AS name, d.line, min(e.pos) AS end_pos
  FROM py_line d JOIN py_line e ON e.file_id = d.file_id AND e.pos > d.pos AND e.margin <= d.margin
  WHERE d.tok = 'def' GROUP BY ALL
),
py_start AS (
  SELECT d.file_id, d.pos, (SELECT min(l.pos) FROM py_line l WHERE l.file_id = d.file_id AND l.pos > coalesce(
      (SELECT max(x.pos) FROM py_line x WHERE x.file_id = d.file_id AND x.pos < d.pos AND x.tok <> '@'), -1)) AS start_pos
  FROM py_def d
),
method AS MATERIALIZED (
  SELECT s.file_id, s.pos, s.p1 AS name, s.p1_line AS line, s.close_pos, min(b.pos) AS body_pos, min_by(b.close_pos, b.pos) AS end_pos
  FROM shape s JOIN good g ON g.file_id = s.file_id AND g.language = 'java'
  JOIN opener b ON b.file_id = s.file_id AND b.level = s.level AND b.tok = '{{' AND b.pos > s.close_pos
  WHERE s.tok = '(' AND s.after IN ('{{', 'throws') AND s.pk1 = 'n' AND NOT contains(s.p1, '.') AND {_TYPED}
  GROUP BY s.file_id, s.pos, s.p1, s.p1_line, s.close_pos
),
type_body AS (
  SELECT file_id, pos FROM (SELECT *, last_value(CASE WHEN tok IN ('class', 'interface', 'enum', ';', '{{', '}}') THEN tok END IGNORE NULLS) OVER (
    PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_word FROM t WHERE language = 'java')
  WHERE tok = '{{' AND last_word IN ('class', 'interface', 'enum')
),
declared AS (
  SELECT file_id, 'python' AS language, pos, n1 AS name, line FROM t WHERE language = 'python' AND tok = 'def' AND p1 <> 'async'
  UNION SELECT file_id, 'java', pos - 1, name, line FROM method
  UNION SELECT t.file_id, 'java', t.pos, t.tok, t.line FROM t JOIN type_body b ON b.file_id = t.file_id AND b.pos = t.open_pos
  WHERE t.language = 'java' AND t.kind = 'n' AND t.p1 <> '.' AND NOT contains(t.tok, '.') AND t.n1 = '(' AND t.p2 <> '.'
    AND (t.pk1 IN ('n', 'g') OR t.p1 IN {_PRIMITIVES} OR t.p1 = ']')
)"""

DECISIONS = """
bounded AS (
  SELECT file_id, pos, level, tok, sum(CASE WHEN delta > 0 OR line_start OR tok IN (',', ':', '=', ':=', 'if', 'else', 'lambda', 'for')
    THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, level ORDER BY pos) AS seg
  FROM t WHERE language = 'python'
),
parts AS (
  SELECT *, sum(CASE WHEN tok = 'or' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, level, seg ORDER BY pos) AS part
  FROM bounded WHERE tok IN ('and', 'or')
),
decision AS (
  SELECT file_id, min(pos) AS pos, count(*) + max(CASE WHEN tok = 'or' THEN 1 ELSE 0 END)
    + count(DISTINCT CASE WHEN tok = 'and' THEN part END) AS w
  FROM parts GROUP BY file_id, level, seg
  UNION ALL SELECT file_id, pos, 1 FROM t WHERE language = 'python' AND (
    (line_start AND tok IN ('if', 'elif', 'for', 'while', 'try', 'except', 'with')) OR (tok = 'else' AND NOT line_start))
  UNION ALL SELECT file_id, pos, 1 FROM t WHERE language = 'java' AND (
    tok IN ('if', 'for', 'while', '&&', '||') OR tok LIKE 'catch (%' OR (tok = '?' AND p1 NOT IN ('<', ','))
    OR ((tok = 'case' OR (tok = 'default' AND n1 = ':')) AND p1 <> ':'))
),
complexity AS (
  SELECT d.file_id, 'python' AS language, d.name, d.line, s.start_pos, d.end_pos,
    1 + coalesce((SELECT sum(w) FROM decision x WHERE x.file_id = d.file_id AND x.pos >= s.start_pos AND x.pos < d.end_pos), 0) AS value
  FROM py_def d JOIN py_start s ON s.file_id = d.file_id AND s.pos = d.pos
  UNION ALL
  SELECT m.file_id, 'java', m.name, m.line, m.pos, m.end_pos,
    1 + coalesce((SELECT sum(w) FROM decision x WHERE x.file_id = m.file_id AND x.pos > m.body_pos AND x.pos < m.end_pos), 0)
  FROM method m
)"""

NAMES = """
marked AS (
  SELECT *,
    last_value(CASE WHEN tok IN ('lambda', 'for') THEN 1 WHEN delta > 0 OR line_start OR tok IN (':', 'in') THEN 0 END IGNORE NULLS)
      OVER before AS in_header,
    last_value(CASE WHEN tok = 'lambda' THEN 1 WHEN delta > 0 OR line_start OR tok = ':' THEN 0 END IGNORE NULLS) OVER before AS in_lambda
  FROM t WINDOW before AS (PARTITION BY file_id, level ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
py_name AS MATERIALIZED (
  SELECT m.*, h.tok AS stmt_tok FROM marked m LEFT JOIN head h ON h.file_id = m.file_id AND h.pos = m.stmt_pos
  LEFT JOIN opener o ON o.file_id = m.file_id AND o.pos = m.open_pos AND m.level > 0
  WHERE m.language = 'python' AND m.kind = 'n' AND m.p1 NOT IN ('.', 'def', 'class')
    AND coalesce(h.tok, '') NOT IN ('import', 'from', 'global', 'nonlocal')
    AND NOT (m.p1 = 'as' AND coalesce(h.tok, '') = 'except')
    AND NOT (m.level > 0 AND m.n1 = '=' AND m.p1 IN ('(', ','))
    AND NOT (coalesce(o.p2, '') = 'def' AND o.tok = '(' AND m.p1 IN ('(', ',', '*', '**'))
    AND NOT (m.p1 = 'lambda' OR (coalesce(m.in_lambda, 0) = 1 AND m.p1 IN (',', '*', '**')))
),
used_name AS (
  SELECT file_id, split_part(tok, '.', 1) AS name FROM py_name
  UNION SELECT file_id, unnest(regexp_extract_all(regexp_replace(array_to_string(regexp_extract_all(
      regexp_replace(tok, '\\{\\{|\\}\\}|![rsa]', '', 'g'), '\\{([^}]*)', 1), chr(10)), '''[^'']*''|"[^"]*"', '', 'g'), '(^|[^\\w.])([A-Za-z_]\\w*)', 2))
  FROM t WHERE language = 'python' AND kind = 's' AND regexp_matches(tok, '^[rR]?[fF]')
),
attribute AS (
  SELECT m.file_id, m.pos, m.line, split_part(m.tok, '.', 1) AS qualifier, split_part(m.tok, '.', 2) AS member
  FROM t m LEFT JOIN head h ON h.file_id = m.file_id AND h.pos = m.stmt_pos
  WHERE m.language = 'python' AND m.kind = 'n' AND contains(m.tok, '.') AND m.p1 NOT IN ('.', 'def', 'class')
    AND coalesce(h.tok, '') NOT IN ('import', 'from')
)"""

CALLS = r"""
counted AS (
  SELECT file_id, open_pos,
    count(*) FILTER (tok = ',' AND (language = 'java' OR coalesce(in_header, 0) = 0)) AS commas,
    count(*) FILTER (language = 'python' AND coalesce(in_header, 0) = 0 AND (tok = '=' OR (tok = '**' AND p1 IN ('(', ',')))) AS named
  FROM marked WHERE level > 0 GROUP BY ALL
),
call AS (
  SELECT s.file_id, g.language, s.pos - 1 AS pos, s.p1_line AS line,
    regexp_replace(s.p1, '\.[^.]*$', '') AS qualifier, regexp_extract(s.p1, '[^.]*$') AS member,
    CAST(CASE WHEN s.last_in = '(' THEN 0 ELSE c.commas + CASE WHEN s.last_in = ',' THEN 0 ELSE 1 END END - c.named AS INTEGER) AS n_args
  FROM shape s JOIN good g ON g.file_id = s.file_id JOIN counted c ON c.file_id = s.file_id AND c.open_pos = s.pos
  WHERE s.tok = '(' AND s.close_pos IS NOT NULL AND s.pk1 = 'n' AND contains(s.p1, '.') AND s.p2 <> '.' AND NOT s.line_start AND (
    (g.language = 'python' AND length(s.p1) - length(replace(s.p1, '.', '')) = 1)
    OR (g.language = 'java' AND s.p2 NOT IN ('new', '@')
        AND len(list_intersect(string_split(s.p1, '.'), ['class', 'this', 'super', 'new'])) = 0))
)"""

PARAMS = f"""
py_param AS (
  SELECT v.file_id, d.pos AS def_pos, d.name AS function, d.line,
    (SELECT max_by(a.tok, a.pos) FROM t a WHERE a.file_id = v.file_id AND a.level = v.level AND a.pos <= v.pos
       AND a.kind = 'n' AND a.p1 IN ('(', ',', '*', '**')) AS parameter
  FROM t v JOIN opener o ON o.file_id = v.file_id AND o.pos = v.open_pos AND o.tok = '(' AND o.p2 = 'def'
  JOIN py_def d ON d.file_id = v.file_id AND d.pos = o.pos - 2
  WHERE v.language = 'python' AND v.tok = 'None' AND v.p1 = '=' AND v.n1 IN (',', ')') AND NOT EXISTS (
    SELECT 1 FROM t x WHERE x.file_id = v.file_id AND x.open_pos = o.pos AND x.level = v.level AND x.pos < v.pos
      AND x.tok IN ('*', '**') AND x.p1 IN ('(', ','))
),
java_param AS (
  SELECT v.file_id, m.pos AS def_pos, m.name AS function, m.line, v.tok AS parameter
  FROM t v JOIN method m ON m.file_id = v.file_id AND m.pos = v.open_pos
  WHERE v.kind = 'n' AND NOT contains(v.tok, '.') AND v.n1 IN (',', ')')
    AND (v.pk1 IN ('n', 'g') OR v.p1 IN {_PRIMITIVES} OR (v.p1 = '.' AND v.p2 = '.'))
),
py_guard AS (
  SELECT file_id, pos, line, tok AS name FROM py_name WHERE NOT contains(tok, '.') AND (
    (((n1 = 'is' AND (n2 = 'None' OR (n2 = 'not' AND n3 = 'None'))) OR (n1 IN ('==', '!=', '<', '>', '<=', '>=', 'in') AND n2 = 'None'))
      AND p1 NOT IN {_TIGHT} AND p1 NOT IN {_COMPARE})
    OR (p1 = '(' AND n1 = ')' AND pk2 NOT IN ('n', 's') AND p2 NOT IN (')', ']', '}}') AND p2 NOT IN {_TIGHT} AND p2 NOT IN {_COMPARE}
      AND ((n2 = 'is' AND (n3 = 'None' OR (n3 = 'not' AND n4 = 'None'))) OR (n2 IN ('==', '!=', '<', '>', '<=', '>=', 'in') AND n3 = 'None')))
    OR (stmt_tok IN ('if', 'elif') AND p1 = '(' AND p2 = 'not' AND p3 IN ('if', 'elif') AND n1 = ')' AND n2 = ':')
    OR (stmt_tok IN ('if', 'elif') AND (
      (n1 = ':' AND level = 0 AND (p1 IN ('if', 'elif') OR (p1 IN ('not', '-', '+', '~') AND p2 IN ('if', 'elif'))))
      OR (p1 = '(' AND p2 IN ('if', 'elif') AND n1 = ')' AND n2 = ':'))))
),
java_guard AS (
  SELECT file_id, pos, line, regexp_extract(tok, '[^.]*$') AS name FROM t WHERE language = 'java' AND kind = 'n' AND (
    (n1 IN ('==', '!=') AND p1 NOT IN ('+', '-', '*', '/', '%', '.'))
    OR (p1 IN ('==', '!=') AND n1 NOT IN ('+', '-', '*', '/', '%', '(', '[', '.'))
    OR (p1 = '(' AND n1 = ')' AND pk2 NOT IN ('n', 's', 'g') AND p2 NOT IN (')', ']', '}}') AND (
      (n2 IN ('==', '!=') AND p2 NOT IN ('+', '-', '*', '/', '%', '.'))
      OR (p2 IN ('==', '!=') AND n2 NOT IN ('+', '-', '*', '/', '%', '(', '[', '.')))))
),
py_deref AS (
  SELECT file_id, pos, line, qualifier AS name FROM attribute
  UNION ALL SELECT p.file_id, p.pos, p.line, p.tok FROM py_name p
  WHERE NOT contains(p.tok, '.') AND p.n1 = '[' AND NOT (p.n_brk AND p.depth = 0)
),
java_deref AS (
  SELECT file_id, pos, line, split_part(tok, '.', 1) AS name FROM t
  WHERE language = 'java' AND kind = 'n' AND length(tok) - length(replace(tok, '.', '')) = 1 AND n1 = '(' AND p1 NOT IN ('.', 'new', '@')
),
weak AS (
  SELECT p.file_id, 'python' AS language, p.function, p.parameter, (SELECT min_by(r.line, r.pos) FROM py_deref r
      WHERE r.file_id = p.file_id AND r.name = p.parameter AND r.pos >= s.start_pos AND r.pos < d.end_pos) AS line
  FROM py_param p JOIN py_def d ON d.file_id = p.file_id AND d.pos = p.def_pos
  JOIN py_start s ON s.file_id = p.file_id AND s.pos = p.def_pos
  WHERE NOT EXISTS (SELECT 1 FROM py_guard g WHERE g.file_id = p.file_id AND g.name = p.parameter AND g.pos >= s.start_pos AND g.pos < d.end_pos)
  UNION ALL
  SELECT p.file_id, 'java', p.function, p.parameter, (SELECT min_by(r.line, r.pos) FROM java_deref r
      WHERE r.file_id = p.file_id AND r.name = p.parameter AND r.pos > m.pos AND r.pos < m.end_pos)
  FROM java_param p JOIN method m ON m.file_id = p.file_id AND m.pos = p.def_pos
  WHERE NOT EXISTS (SELECT 1 FROM java_guard g WHERE g.file_id = p.file_id AND g.name = p.parameter AND g.pos > m.pos AND g.pos < m.end_pos)
)"""

HANDLERS = r"""
line_no AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS k FROM t WHERE line_start),
handler AS (
  SELECT file_id, 'python' AS language, line, '' AS types, 'bare' AS body FROM t WHERE line_start AND tok = 'except' AND n1 = ':'
  UNION ALL
  SELECT e.file_id, 'python', e.line, '', 'pass' FROM line_no e
  JOIN line_no a ON a.file_id = e.file_id AND a.k = e.k + 1 LEFT JOIN line_no b ON b.file_id = e.file_id AND b.k = e.k + 2
  WHERE e.tok = 'except' AND e.n1 <> ':' AND (
    (a.p1 = 'pass' AND a.p2 = ':' AND a.margin <= e.margin)
    OR (a.tok = 'pass' AND a.p1 = ':' AND b.pos = a.pos + 1 AND b.margin <= e.margin))
  UNION ALL
  SELECT c.file_id, 'java', CASE WHEN c.n2 = '}' THEN (SELECT max_by(x.line, x.pos) FROM t x
        WHERE x.file_id = c.file_id AND x.level = c.level AND x.tok = 'try' AND x.pos < c.pos) ELSE c.n2_line END,
    array_to_string(list_transform(string_split(regexp_replace(regexp_extract(c.tok, '\((.*)\)', 1), '^\s*final\s+|\s+\w+\s*$', '', 'g'), '|'), lambda x: trim(x)), ', '),
    CASE WHEN c.n2 = '}' THEN 'empty' ELSE 'filled' END
  FROM t c WHERE c.language = 'java' AND c.tok LIKE 'catch (%' AND c.n1 = '{'
)"""

MALFORMED = """
odd_line AS (SELECT *, lag(margin, 1, 0) OVER w AS prev_margin, lag(tok, 1, '') OVER w AS prev_tok, lag(pos, 1, 0) OVER w AS prev_pos
  FROM t WHERE line_start WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
fault AS (
  SELECT file_id, language, pos, line, 1 AS prec, 'unterminated string' AS reason FROM t WHERE tok IN ('"', '''')
  UNION ALL SELECT file_id, language, pos, line, 2, 'unbalanced bracket' FROM t WHERE depth < 0 OR (n1 = '' AND depth <> 0)
  UNION ALL SELECT file_id, language, pos, line, 3, 'invalid character' FROM t WHERE language = 'python' AND tok IN ('?', '$', '!', '`')
  UNION ALL SELECT file_id, language, pos, line, 4, 'unexpected indent' FROM odd_line WHERE margin > prev_margin AND p1 <> ':'
  UNION ALL SELECT file_id, language, pos, line, 5, 'expected an indented block' FROM odd_line WHERE margin <= prev_margin AND p1 = ':'
  UNION ALL SELECT l.file_id, l.language, l.pos, l.line, 6, 'expected '':''' FROM odd_line l WHERE l.prev_tok IN
    ('if', 'elif', 'else', 'for', 'while', 'try', 'except', 'finally', 'with', 'def', 'class') AND NOT EXISTS (
      SELECT 1 FROM t c WHERE c.file_id = l.file_id AND c.pos > l.prev_pos AND c.pos < l.pos AND c.tok = ':' AND c.depth = 0)
  UNION ALL SELECT file_id, language, pos, line, 7, 'invalid syntax' FROM t WHERE language = 'python' AND kind IN ('n', 'd', 's') AND NOT begins
    AND (pk1 IN ('n', 'd', 's') OR p1 IN (')', ']', '}')) AND NOT (kind = 's' AND pk1 = 's') AND p1 NOT IN ('match', 'case', 'type', '_')
  UNION ALL SELECT file_id, language, pos, line, 7, 'invalid syntax' FROM t WHERE language = 'python' AND (
    (regexp_matches(tok, '^([-+*/%|^&@<>=!:]?=|[-+*/%|^&@<>~]|//|//=|\\*\\*|\\*\\*=|<<|>>|<<=|>>=|->|and|or|not|in|is|import)$')
      AND n_brk AND depth = 0 AND NOT (tok = '*' AND p1 = 'import'))
    OR (tok = ',' AND p1 IN ('(', '[', '{', ','))
    OR (regexp_matches(tok, '^([-+*/%|^&@<>=!:]?=|[/%|^&<>]|//|//=|\\*\\*=|<<|>>|<<=|>>=)$')
      AND regexp_matches(p1, '^([-+*/%|^&@<>=!:]?=|[-+*/%|^&@<>~]|//|//=|\\*\\*|\\*\\*=|<<|>>|<<=|>>=|->|and|or|not|in|is|import)$'))
    OR (tok IN ('return', 'raise', 'pass', 'break', 'continue', 'del', 'global', 'nonlocal', 'assert', 'while', 'try', 'elif', 'except',
      'finally', 'class') AND NOT begins)
    OR (tok = 'import' AND NOT begins AND (SELECT h.tok FROM head h WHERE h.file_id = t.file_id AND h.pos = t.stmt_pos) IS DISTINCT FROM 'from')
    OR (tok = 'in' AND p1 = 'for'))
  UNION ALL SELECT file_id, language, pos, line, 11, 'illegal start of expression' FROM t WHERE language = 'java' AND (
    (tok IN ('=', '==', '!=', '+', '-', '*', '/', '%', '&&', '||', '&', '|', '^', ',') AND n1 IN (';', ')', ']')
      AND NOT (tok = '*' AND p1 = '.') AND NOT (tok IN ('+', '-') AND p1 = tok))
    OR (pk1 IN ('d', 's') AND (kind IN ('n', 'd', 's') OR tok IN ('int', 'long', 'double', 'float', 'boolean', 'char', 'byte', 'short')))
    OR (kind = 'n' AND pk1 = 'n' AND pk2 = 'n' AND p3 <> '@' AND len(list_filter([tok, p1, p2], lambda x: x IN ('record', 'sealed',
      'permits', 'yield', 'var', 'when', 'module', 'open', 'exports', 'opens', 'requires', 'to', 'uses', 'provides', 'non'))) = 0))
  UNION ALL SELECT file_id, language, max(pos), max_by(line, pos), 10, 'class, interface, enum, or record expected' FROM t WHERE language = 'java'
    GROUP BY file_id, language HAVING count(*) FILTER (tok IN ('class', 'interface', 'enum', 'record', 'module')) = 0
      AND count(*) FILTER (tok IN ('{', ';')) > count(*) FILTER (tok IN ('import', 'package'))
  UNION ALL SELECT file_id, language, pos, line, 8, 'reached end of file' FROM t WHERE language = 'java' AND n1 = '' AND p1 NOT IN (';', '}', '')
  UNION ALL SELECT c.file_id, c.language, c.pos, c.line, 9, 'unbalanced bracket' FROM t c
    LEFT JOIN opener o ON o.file_id = c.file_id AND o.pos = c.open_pos
    WHERE c.delta < 0 AND coalesce(o.tok, '') || c.tok NOT IN ('()', '[]', '{}')
  UNION ALL SELECT l.file_id, l.language, l.pos, l.line, 10, 'unindent does not match any outer indentation level' FROM odd_line l
    WHERE l.margin < l.prev_margin AND (SELECT max_by(x.margin, x.pos) FROM odd_line x
      WHERE x.file_id = l.file_id AND x.pos < l.pos AND x.margin <= l.margin) IS DISTINCT FROM l.margin
),
malformed AS (SELECT * FROM fault QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY pos, prec) = 1)"""

_LINES = r"string_split_regex(code, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
LINES = rf"""
raw_line AS (
  SELECT file_id, language, unnest(parts) AS text, generate_subscripts(parts, 1) AS line, len(parts) AS n
  FROM (SELECT file_id, language, {_LINES} AS parts FROM good)
),
line AS (SELECT * FROM raw_line WHERE NOT (line = n AND text = '')),
secret AS (
  SELECT file_id, language, line FROM line WHERE (language = 'python' AND ({" OR ".join(
      f"regexp_matches(text, {quoted(p)})" for p in dims.PYTHON_SECRET_PATTERNS)}))
    OR (language = 'java' AND contains(text, '=') AND contains(text, '"')
      AND len(list_filter({listed(dims.JAVA_SECRET_WORDS)}, lambda k: contains(lower(text), k))) > 0
      AND len(list_filter(string_split(text, '"'), lambda part, i: i % 2 = 0 AND length(trim(trim(part, chr(32) || chr(9)), '";')) >= 6)) > 0)
)"""


def _text(rule: str, *args: str) -> str:
    return f"printf({quoted(rules.TEXTS[rule])}{''.join(', ' + a for a in args)})"


def _arity(rows, language):
    return ", ".join(
        f"({quoted(language)}, {quoted(q)}, {quoted(m)}, {lo}, {'NULL' if hi is None else hi})" for q, m, lo, hi in rows)


_FAKES = ", ".join(
    f"({quoted(lang)}, {quoted(q)}, {quoted(m)})"
    for lang, rows in (("python", dims.PYTHON_FAKE_MEMBERS), ("java", dims.JAVA_FAKE_MEMBERS)) for q, m in rows)
_META = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)}, {d}, {quoted(e)}, {rules.ORDER[(a, b)]})" for a, b, c, d, e in dims.RULES)

DIMS = f"""
arity(language, qualifier, member, lo, hi) AS (VALUES {_arity(dims.PYTHON_ARITY, 'python')}, {_arity(dims.JAVA_ARITY, 'java')}),
fake(language, qualifier, member) AS (VALUES {_FAKES}),
meta(language, rule_id, severity, weight, category, rule_order) AS (VALUES {_META})"""

RAW = f"""
raw_finding AS (
  SELECT file_id, language, 'PARSE_ERROR' AS rule_id, CASE WHEN language = 'java'
      THEN {_text('PARSE_ERROR_JAVA', 'reason', 'CAST(line AS BIGINT)')} ELSE {_text('PARSE_ERROR', 'reason', 'CAST(line AS BIGINT)')} END AS message,
    0 AS line, 0 AS pos FROM malformed
  UNION ALL SELECT i.file_id, 'python', 'UNUSED_IMPORT', {_text('UNUSED_IMPORT', 'i.bound_name')}, i.line, i.pos FROM py_import i
    WHERE NOT i.wildcard AND NOT EXISTS (SELECT 1 FROM used_name u WHERE u.file_id = i.file_id AND u.name = i.bound_name)
  UNION ALL SELECT i.file_id, 'java', 'UNUSED_IMPORT', {_text('UNUSED_IMPORT', 'i.path')}, i.line, i.pos FROM java_import i
    WHERE NOT i.wildcard AND NOT EXISTS (SELECT 1 FROM line l WHERE l.file_id = i.file_id
      AND NOT starts_with(ltrim(l.text, ' ' || chr(9)), 'import ') AND contains(l.text, regexp_extract(i.path, '[^.]*$')))
  UNION ALL SELECT file_id, language, 'BARE_EXCEPT', {_text('BARE_EXCEPT')}, line, 0 FROM handler WHERE body = 'bare'
  UNION ALL SELECT file_id, language, 'SWALLOWED_EXCEPTION', {_text('SWALLOWED_EXCEPTION')}, line, 0 FROM handler WHERE body = 'pass'
  UNION ALL SELECT file_id, language, 'SWALLOWED_EXCEPTION', {_text('SWALLOWED_EXCEPTION_JAVA', 'types')}, line, 0 FROM handler WHERE body = 'empty'
  UNION ALL SELECT file_id, language, 'BROAD_CATCH', {_text('BROAD_CATCH', 'types')}, line, 0 FROM handler
    WHERE body = 'filled' AND types IN ('Exception', 'Throwable')
  UNION ALL SELECT file_id, language, 'HARDCODED_SECRET', {_text('HARDCODED_SECRET')}, line, 0 FROM secret
  UNION ALL SELECT file_id, language, 'HIGH_COMPLEXITY', {_text('HIGH_COMPLEXITY', 'name', 'CAST(value AS BIGINT)', '7')}, line, 0
    FROM complexity WHERE language = 'python' AND value > 7
  UNION ALL SELECT file_id, language, 'HIGH_COMPLEXITY', {_text('HIGH_COMPLEXITY_JAVA', 'name', 'CAST(value AS BIGINT)', '6')}, line, 0
    FROM complexity WHERE language = 'java' AND value > 6
  UNION ALL SELECT file_id, language, 'MISSING_NONE_CHECK', {_text('MISSING_NONE_CHECK', 'parameter', 'function')}, line, 0
    FROM weak WHERE line IS NOT NULL AND language = 'python'
  UNION ALL SELECT file_id, language, 'MISSING_NULL_CHECK', {_text('MISSING_NULL_CHECK', 'parameter', 'function')}, line, 0
    FROM weak WHERE line IS NOT NULL AND language = 'java'
  UNION ALL SELECT file_id, 'python', 'HALLUCINATED_IMPORT', {_text('HALLUCINATED_IMPORT', "split_part(path, '.', 1)")}, line, at_pos FROM (
      SELECT DISTINCT file_id, path, line, CASE WHEN is_from THEN import_pos ELSE pos END AS at_pos FROM py_import)
    WHERE split_part(path, '.', 1) IN {members(dims.PYTHON_FAKE_MODULES)}
  UNION ALL SELECT file_id, 'java', 'HALLUCINATED_IMPORT', {_text('HALLUCINATED_IMPORT_JAVA', 'path')}, line, pos FROM java_import
    WHERE len(list_filter({listed(dims.JAVA_PACKAGE_PREFIXES)}, lambda p: starts_with(path, p))) = 0
      AND len(string_split(path, '.')) <= 2 AND NOT starts_with(path, 'java')
  UNION ALL SELECT a.file_id, 'python', 'HALLUCINATED_ATTRIBUTE', {_text('HALLUCINATED_ATTRIBUTE', 'a.qualifier', 'a.member')}, a.line, a.pos
    FROM attribute a JOIN fake f ON f.language = 'python' AND f.qualifier = a.qualifier AND f.member = a.member
  UNION ALL SELECT c.file_id, 'java', 'HALLUCINATED_METHOD', {_text('HALLUCINATED_METHOD', 'c.qualifier', 'c.member')}, c.line, c.pos
    FROM call c JOIN fake f ON f.language = 'java' AND c.language = 'java' AND f.qualifier = c.qualifier AND f.member = c.member
  UNION ALL SELECT c.file_id, c.language, 'ARGUMENT_MISMATCH', {_text('ARGUMENT_MISMATCH', 'c.qualifier', 'c.member', 'CAST(c.n_args AS BIGINT)',
      "CASE WHEN a.lo = a.hi THEN '' || a.lo WHEN a.hi IS NULL THEN 'at least ' || a.lo ELSE a.lo || '-' || a.hi END")}, c.line, c.pos
    FROM call c JOIN arity a ON a.language = c.language AND a.qualifier = c.qualifier AND a.member = c.member
    WHERE c.n_args < a.lo OR c.n_args > a.hi
  UNION ALL SELECT file_id, 'java', 'HALLUCINATED_CLASS_NAME', {_text('HALLUCINATED_CLASS_NAME', 'root', 'real')}, line, pos FROM (
      SELECT file_id, line, min(pos) AS pos, min_by(root, pos) AS root, min_by(real, pos) AS real FROM (
        SELECT file_id, line, pos, split_part(qualifier, '.', 1) AS root,
          list_filter({listed(dims.JAVA_CORE_CLASSES)}, lambda k: levenshtein(k, split_part(qualifier, '.', 1)) BETWEEN 1 AND 2)[1] AS real
        FROM call WHERE language = 'java' AND length(split_part(qualifier, '.', 1)) >= 4 AND regexp_matches(qualifier, '^[A-Z]')
          AND split_part(qualifier, '.', 1) NOT IN {members(dims.JAVA_CORE_CLASSES)})
      WHERE real IS NOT NULL GROUP BY file_id, line)
),
finding AS (
  SELECT r.file_id, r.language, r.rule_id, r.message, m.severity, m.weight, r.line, m.category, m.rule_order, r.pos
  FROM raw_finding r JOIN meta m ON m.language = r.language AND m.rule_id = r.rule_id
  WHERE r.rule_id = 'PARSE_ERROR' OR r.file_id NOT IN (SELECT file_id FROM malformed)
),
scored AS (
  SELECT g.file_id, g.filename, g.language, CAST(coalesce(sum(f.weight), 0) AS INTEGER) AS total_weight,
    CAST(count(f.rule_id) AS INTEGER) AS num_findings
  FROM good g LEFT JOIN finding f ON f.file_id = g.file_id GROUP BY ALL
),
report AS (
  SELECT *, CAST(least(100, round_even(total_weight / 40.0::DOUBLE * 100, 0)) AS INTEGER) AS risk_score,
    CASE WHEN total_weight >= 8 THEN 'High' WHEN total_weight >= 3 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM scored
)"""

_NEEDS = {  # in order; a block may use all blocks before it
    "files": FILES, "tokens": TOKENS, "imports": IMPORTS, "defs": DEFS, "decisions": DECISIONS, "names": NAMES, "calls": CALLS,
    "params": PARAMS, "handlers": HANDLERS, "malformed": MALFORMED, "lines": LINES, "dims": DIMS, "findings": RAW,
}


def sql(query: str, *blocks: str) -> str:
    """A query over the named blocks; no name means all of them."""
    chosen = [text for name, text in _NEEDS.items() if not blocks or name in blocks]
    return "WITH " + ",\n".join(b.strip("\n") for b in chosen) + "\n" + query
