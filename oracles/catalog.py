"""Oracle SQL per query key."""

from oracles.base import members, quoted
from oracles.facts import sql
from riskweave.plans.catalog import RULE_KEYS, TOP_K, TUNED_THRESHOLDS, TUNED_WEIGHTS
from riskweave.sources import dims

_SPLIT = r"string_split_regex(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]')"


def _split(table: str, keys: str) -> str:
    return (
        f"SELECT {keys}, line, text FROM (SELECT {keys}, unnest(parts) AS text, generate_subscripts(parts, 1) AS line, "
        f"len(parts) AS n FROM (SELECT {keys}, {_SPLIT} AS parts FROM {table})) WHERE NOT (line = n AND text = '')"
    )


_PY_SECRET = " OR ".join(f"regexp_matches(text, {quoted(p)})" for p in dims.PYTHON_SECRET_PATTERNS)
_JAVA_SECRET = (
    "contains(text, '=') AND contains(text, '\"') AND (" + " OR ".join(
        f"contains(lower(text), {quoted(w)})" for w in dims.JAVA_SECRET_WORDS)
    + ") AND len(list_filter(string_split(text, '\"'), lambda part, i: i % 2 = 0 AND "
      "length(trim(trim(part, chr(32) || chr(9)), '\";')) >= 6)) > 0"
)
_TUNED = " ".join(f"WHEN language = {quoted(a)} AND rule_id = {quoted(b)} THEN {w}" for (a, b), w in TUNED_WEIGHTS.items())
_LEVEL = "CASE WHEN w >= 8 THEN 'High' WHEN w >= 3 THEN 'Medium' ELSE 'Low' END"
_IMPORT_FACT = """(
  SELECT file_id, string_agg(path, '|' ORDER BY pos) AS imports, count(*) AS n FROM (
    SELECT file_id, path, CASE WHEN is_from THEN import_pos ELSE pos END AS pos FROM py_import WHERE path IS NOT NULL GROUP BY ALL
    UNION ALL SELECT file_id, path, pos FROM java_import) WHERE file_id NOT IN (SELECT file_id FROM malformed) GROUP BY file_id)"""
_FUNCTION_FACT = """(SELECT file_id, string_agg(name, '|' ORDER BY pos) AS functions, count(*) AS n FROM declared
  WHERE file_id NOT IN (SELECT file_id FROM malformed) GROUP BY file_id)"""
_LINE_FACT = """(SELECT g.file_id, CASE WHEN g.file_id IN (SELECT file_id FROM malformed) THEN 0 ELSE count(l.line) END AS n
  FROM good g LEFT JOIN line l ON l.file_id = g.file_id GROUP BY g.file_id)"""
_STORED = "SELECT file_id AS report_id, filename, language, risk_level, risk_score, num_findings FROM report"
_MOMENT = "strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(r.file_id), '%Y-%m-%dT%H:%M:%S.000000+00:00')"


def oracle_sql() -> dict[str, str]:
    out = {
        "a1_submissions": sql("SELECT file_id, filename, language_override, code FROM files", "files"),
        "a2_document_lines": _split("documents", "doc_id"),
        "a2_conversation_lines": "SELECT conv_id, turn, line, text AS line_text FROM (" + _split("conversations", "conv_id, turn") + ")",
        "a3_rule_catalog": sql(
            "SELECT m.*, (SELECT count(*) FROM finding f WHERE f.language = m.language AND f.rule_id = m.rule_id) AS n_findings FROM meta m"),
        "a4_stored_reports": sql(_STORED),
        "a5_report_json": sql(f"""SELECT r.file_id AS report_id, CAST(to_json({{
            'language': r.language, 'risk_level': r.risk_level, 'risk_score': r.risk_score, 'total_weight': r.total_weight,
            'num_findings': r.num_findings, 'facts': {{
              'imports': coalesce(string_split(i.imports, '|'), []), 'functions': coalesce(string_split(f.functions, '|'), []), 'num_lines': l.n}},
            'findings': coalesce((SELECT list({{'rule_id': x.rule_id, 'message': x.message, 'severity': x.severity, 'weight': x.weight,
               'line': x.line, 'category': x.category}} ORDER BY x.rule_order, x.line, x.pos, x.message) FROM finding x WHERE x.file_id = r.file_id), []),
            'filename': r.filename, 'analyzed_at': {_MOMENT}}}) AS VARCHAR) AS report_json
          FROM report r LEFT JOIN {_IMPORT_FACT} i ON i.file_id = r.file_id LEFT JOIN {_FUNCTION_FACT} f ON f.file_id = r.file_id
          LEFT JOIN {_LINE_FACT} l ON l.file_id = r.file_id"""),
        "a6_report_decoded": sql(f"""SELECT r.file_id AS report_id, r.filename, r.language, r.risk_score, {_MOMENT} AS analyzed_at,
            coalesce(i.imports, '') AS imports,
            coalesce((SELECT sum(x.line) FROM finding x WHERE x.file_id = r.file_id), 0) AS line_sum
          FROM report r LEFT JOIN {_IMPORT_FACT} i ON i.file_id = r.file_id"""),
        "b1_b2_b4_routing": sql("""SELECT file_id, coalesce(filename, 'pasted_snippet.py') AS filename,
            CASE WHEN language_override = 'python' OR language_override = 'java' THEN language_override
              WHEN ends_with(lower(filename), '.java') THEN 'java' ELSE 'python' END AS language FROM files""", "files"),
        "b3_rejected": sql("""SELECT file_id, filename, 'No code provided.' AS reason FROM files
            WHERE code IS NULL OR trim(replace(replace(code, chr(9), ''), chr(10), '')) = ''
            UNION ALL SELECT file_id, filename, 'No file id.' FROM files WHERE file_id IS NULL AND length(code) > 3""", "files"),
        "b6_line_counts": sql("""SELECT language, count(DISTINCT file_id) AS n_files, count(*) AS n_lines FROM line GROUP BY language""", "files", "lines"),
        "c1_tokens": sql("SELECT file_id, pos, line, tok FROM t WHERE n1 <> ''", "files", "tokens"),
        "c2_structure": sql("""SELECT file_id, pos, level, line_start, CASE WHEN line_start THEN margin END AS margin, stmt_pos
            FROM t WHERE n1 <> ''""", "files", "tokens"),
        "c3_malformed": sql("SELECT file_id, language, line, reason AS fault FROM malformed", "files", "tokens", "malformed"),
        "c4_imports_python": sql("SELECT file_id, line, path, split_part(path, '.', 1) AS top, bound_name, wildcard FROM py_import",
                                 "files", "tokens", "imports"),
        "c4_imports_java": sql("""SELECT file_id, line, path, split_part(path, '.', 1) AS top, regexp_extract(path, '[^.]*$') AS bound_name, wildcard
            FROM java_import""", "files", "tokens", "imports"),
        "c5_functions_python": sql("SELECT file_id, pos, name, line FROM declared WHERE language = 'python'", "files", "tokens", "defs"),
        "c5_methods_java": sql("SELECT file_id, pos, name, line FROM declared WHERE language = 'java'", "files", "tokens", "defs"),
        "c6_name_refs": sql("SELECT DISTINCT file_id, name FROM used_name", "files", "tokens", "names"),
        "c7_attributes": sql("SELECT file_id, pos, line, qualifier, member FROM attribute", "files", "tokens", "names"),
        "d4_document_secrets": f"SELECT doc_id, line FROM ({_split('documents', 'doc_id')}) WHERE {_PY_SECRET}",
        "e4_conversation_secrets": f"SELECT conv_id, turn, line FROM ({_split('conversations', 'conv_id, turn')}) WHERE {_JAVA_SECRET}",
        "g1_g4_scores": sql("SELECT file_id, filename, language, total_weight, num_findings, risk_score, risk_level FROM report"),
        "g6_facts": sql(f"""SELECT g.file_id, coalesce(i.imports, '') AS imports, coalesce(f.functions, '') AS functions, l.n AS num_lines
          FROM good g LEFT JOIN {_IMPORT_FACT} i ON i.file_id = g.file_id LEFT JOIN {_FUNCTION_FACT} f ON f.file_id = g.file_id
          LEFT JOIN {_LINE_FACT} l ON l.file_id = g.file_id"""),
        "g7_ordered_findings": sql("""SELECT r.file_id, coalesce(string_agg(f.rule_id || '@' || f.line, ' ' ORDER BY f.rule_order, f.line, f.pos), '') AS findings
          FROM report r LEFT JOIN finding f ON f.file_id = r.file_id GROUP BY r.file_id"""),
        "g8_display_counts": sql(f"""SELECT r.file_id, coalesce(f.n, 0) AS n_functions, coalesce(i.n, 0) AS n_imports, l.n AS num_lines, r.num_findings
          FROM report r LEFT JOIN {_IMPORT_FACT} i ON i.file_id = r.file_id LEFT JOIN {_FUNCTION_FACT} f ON f.file_id = r.file_id
          LEFT JOIN {_LINE_FACT} l ON l.file_id = r.file_id"""),
        "h3_history": sql("""SELECT file_id AS id, filename, language, TIMESTAMP '2023-11-14 22:13:20' + to_seconds(file_id) AS created_at,
            risk_level, risk_score, num_findings FROM report ORDER BY file_id DESC LIMIT 50"""),
        "h4_findings": sql("SELECT file_id, language, rule_id, message, severity, weight, line, category FROM finding"),
        "j1_streamed_reports": sql(_STORED),
        "k1_finding_rollup": sql("""SELECT language, rule_id, severity, count(*) AS n_findings, sum(weight) AS total_weight
            FROM finding GROUP BY ROLLUP (language, rule_id, severity)"""),
        "k2_riskiest_files": sql(f"""SELECT file_id, filename, total_weight, risk_score, risk_level FROM report
            ORDER BY total_weight DESC, file_id LIMIT {TOP_K}"""),
        "k3_once_per_content": sql("""SELECT r.file_id, r.filename, (SELECT min(o.file_id) FROM good o WHERE o.language = g.language AND o.code = g.code)
            AS analysed_id, r.total_weight, r.risk_level FROM report r JOIN good g ON g.file_id = r.file_id"""),
        "k4_tuned_scores": sql(f"""SELECT file_id, w AS total_weight, n AS num_findings,
            CAST(least(100, round_even(w / 40.0::DOUBLE * 100, 0)) AS INTEGER) AS risk_score, {_LEVEL} AS risk_level FROM (
          SELECT g.file_id, CAST(coalesce(sum(x.weight), 0) AS INTEGER) AS w, CAST(count(x.weight) AS INTEGER) AS n FROM good g LEFT JOIN (
            SELECT file_id, CASE {_TUNED} ELSE weight END AS weight FROM finding WHERE rule_id <> 'HIGH_COMPLEXITY'
            UNION ALL SELECT file_id, 4 FROM complexity WHERE file_id NOT IN (SELECT file_id FROM malformed)
              AND value > CASE WHEN language = 'python' THEN {TUNED_THRESHOLDS['python']} ELSE {TUNED_THRESHOLDS['java']} END
          ) x ON x.file_id = g.file_id GROUP BY g.file_id)"""),
        "k5_changed_line_findings": sql("""SELECT f.file_id, f.line, f.rule_id, f.message FROM finding f
          JOIN line l ON l.file_id = f.file_id AND l.line = f.line
          WHERE NOT EXISTS (SELECT 1 FROM line o WHERE o.file_id = f.file_id - 2 AND o.text = l.text)"""),
    }
    per_language = {
        "c8_calls_{}": ("SELECT file_id, pos, line, qualifier, member, n_args FROM call WHERE language = '{}'", ("names", "calls")),
        "c12_handlers_{}": ("SELECT file_id, line, types, body FROM handler WHERE language = '{}'", ("handlers",)),
    }
    for key, (query, blocks) in per_language.items():
        for language in ("python", "java"):
            out[key.format(language)] = sql(query.format(language), "files", "tokens", *blocks)
    for language, short in (("python", "py"), ("java", "java")):
        needs = ("files", "tokens", "defs", "names", "params")
        out[f"c9_parameters_{language}"] = sql(f"SELECT file_id, function, line, parameter FROM {short}_param", *needs)
        out[f"c10_guards_{language}"] = sql(f"SELECT file_id, pos, line, name FROM {short}_guard", *needs)
        out[f"c11_dereferences_{language}"] = sql(f"SELECT file_id, pos, line, name FROM {short}_deref", *needs)
        key = "c13_c14_complexity_python" if language == "python" else "c13_complexity_java"
        out[key] = sql(
            f"SELECT file_id, name, line, start_pos AS start, end_pos AS \"end\", CAST(value AS BIGINT) AS complexity FROM complexity "
            f"WHERE language = '{language}'", "files", "tokens", "defs", "decisions")
    for key, (language, rule_id) in RULE_KEYS.items():
        out[key] = sql(
            "SELECT file_id, language, rule_id, message, severity, weight, line, category FROM finding "
            f"WHERE language = {quoted(language)} AND rule_id IN {members([rule_id])}")
    return out
