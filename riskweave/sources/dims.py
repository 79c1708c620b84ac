"""Curated dimension tables.

All of them are literals of a few dozen rows, so the broadcasts that use them
have a size fixed by this file and not by the data.
"""

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values -----------------------------------------------------------
# Positional-argument bounds (qualifier, member, min, max); None = unbounded.
PYTHON_ARITY = [
    ("os", "getenv", 1, 2), ("os", "listdir", 0, 1), ("os", "remove", 1, 1),
    ("os", "rename", 2, 2), ("os", "mkdir", 1, 2),
    ("json", "loads", 1, 1), ("json", "dumps", 1, None),
    ("json", "load", 1, None), ("json", "dump", 2, None),
    ("math", "sqrt", 1, 1), ("math", "floor", 1, 1), ("math", "ceil", 1, 1),
    ("math", "pow", 2, 2), ("math", "gcd", 1, None),
    ("re", "match", 2, 3), ("re", "search", 2, 3), ("re", "sub", 3, 5),
    ("re", "compile", 1, 2), ("re", "findall", 2, 3),
    ("random", "randint", 2, 2), ("random", "choice", 1, 1),
    ("random", "shuffle", 1, 2), ("random", "random", 0, 0),
]
JAVA_ARITY = [
    ("String", "valueOf", 1, 1), ("String", "format", 1, None), ("String", "join", 2, None),
    ("Integer", "parseInt", 1, 2), ("Integer", "valueOf", 1, 2),
    ("Math", "sqrt", 1, 1), ("Math", "pow", 2, 2), ("Math", "max", 2, 2),
    ("Math", "min", 2, 2), ("Math", "abs", 1, 1),
    ("Arrays", "asList", 0, None), ("Arrays", "sort", 1, 3),
    ("Objects", "isNull", 1, 1), ("Objects", "nonNull", 1, 1), ("Objects", "equals", 2, 2),
]
# Members that sound plausible but do not exist.
PYTHON_FAKE_MEMBERS = [
    ("os", "path_exists"), ("os", "read_file"), ("json", "parse"), ("json", "stringify"),
    ("math", "squareroot"), ("re", "matchAll"), ("list", "push"), ("str", "format_map_safe"),
]
JAVA_FAKE_MEMBERS = [
    ("String", "valueof"), ("Math", "squareroot"), ("Math", "power"), ("Integer", "parse"),
    ("Arrays", "toList"), ("System", "print"), ("List", "push"), ("List", "pop"),
    ("String", "format_map"), ("Objects", "isNull_safe"),
]
PYTHON_FAKE_MODULES = [
    "os_utils", "stringutils", "collections_extra", "jsonutils",
    "systools", "fileutils", "mathutils", "textutils",
]
JAVA_PACKAGE_PREFIXES = [
    "java.", "javax.", "org.springframework", "org.junit", "com.google", "org.apache",
    "org.slf4j", "com.fasterxml", "org.hibernate", "io.jsonwebtoken", "org.mockito",
    "org.assertj", "com.amazonaws", "org.json", "com.squareup",
]
# Order matters: the first close name wins, not the closest.
JAVA_CORE_CLASSES = [
    "System", "Math", "String", "Integer", "Long", "Double", "Float", "Boolean",
    "Character", "Object", "Arrays", "Objects", "List", "Map", "Set", "Collections",
    "Scanner", "StringBuilder", "ArrayList", "HashMap", "HashSet", "Thread",
    "Exception", "Runnable", "Optional",
]
JAVA_SECRET_WORDS = ["apikey", "api_key", "secret", "token", "password", "passwd", "pwd"]
PYTHON_SECRET_PATTERNS = [
    r"(?i)(api[_-]?key|secret|token|password|passwd|pwd)\s*=\s*['\"][^'\"]{6,}['\"]",
    r"(?i)AKIA[0-9A-Z]{16}",
    r"(?i)-----BEGIN (RSA|EC|DSA|OPENSSH) PRIVATE KEY-----",
]
# (language, rule_id, severity, weight, category), in reporting order per language.
RULES = [
    ("python", "PARSE_ERROR", "high", 10, "static"),
    ("python", "UNUSED_IMPORT", "low", 1, "static"),
    ("python", "BARE_EXCEPT", "medium", 3, "static"),
    ("python", "SWALLOWED_EXCEPTION", "medium", 3, "static"),
    ("python", "HARDCODED_SECRET", "high", 8, "static"),
    ("python", "HIGH_COMPLEXITY", "medium", 4, "static"),
    ("python", "MISSING_NONE_CHECK", "medium", 3, "static"),
    ("python", "HALLUCINATED_IMPORT", "high", 6, "hallucination"),
    ("python", "HALLUCINATED_ATTRIBUTE", "high", 6, "hallucination"),
    ("python", "ARGUMENT_MISMATCH", "high", 5, "hallucination"),
    ("java", "PARSE_ERROR", "high", 10, "static"),
    ("java", "UNUSED_IMPORT", "low", 1, "static"),
    ("java", "SWALLOWED_EXCEPTION", "medium", 3, "static"),
    ("java", "BROAD_CATCH", "medium", 3, "static"),
    ("java", "HARDCODED_SECRET", "high", 8, "static"),
    ("java", "HIGH_COMPLEXITY", "medium", 4, "static"),
    ("java", "MISSING_NULL_CHECK", "medium", 3, "static"),
    ("java", "HALLUCINATED_IMPORT", "high", 6, "hallucination"),
    ("java", "HALLUCINATED_METHOD", "high", 6, "hallucination"),
    ("java", "ARGUMENT_MISMATCH", "high", 5, "hallucination"),
    ("java", "HALLUCINATED_CLASS_NAME", "high", 6, "hallucination"),
]
COMPLEXITY_THRESHOLD = {"python": 7, "java": 6}
FULL_SCORE_WEIGHT = 40
HIGH_WEIGHT = 8
MEDIUM_WEIGHT = 3
# --- End of fixed values ----------------------------------------------------


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """An inline table; it is part of the plan, so using it starts no job."""
    def cell(value):
        if value is None:
            return "CAST(NULL AS INT)"
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, int) else f"'{value}'"

    text = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")


def ref_member(spark: SparkSession) -> DataFrame:
    """One row per curated (language, qualifier, member): a known arity or a known fake."""
    rows = [("python", q, m, False, lo, hi) for q, m, lo, hi in PYTHON_ARITY]
    rows += [("java", q, m, False, lo, hi) for q, m, lo, hi in JAVA_ARITY]
    rows += [("python", q, m, True, None, None) for q, m in PYTHON_FAKE_MEMBERS]
    rows += [("java", q, m, True, None, None) for q, m in JAVA_FAKE_MEMBERS]
    return _values(spark, rows, "language, qualifier, member, is_fake, min_args, max_args")


def ref_rule(spark: SparkSession) -> DataFrame:
    """Rule metadata with its reporting order inside the language."""
    rows, seen = [], {}
    for language, rule_id, severity, weight, category in RULES:
        order = seen.setdefault(language, 0)
        seen[language] = order + 1
        rows.append((language, rule_id, severity, weight, category, order))
    return _values(spark, rows, "language, rule_id, severity, weight, category, rule_order")
