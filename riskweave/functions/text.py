"""Column expressions over whole texts, file names and weights."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.sources import dims

# Line ends of Python's str.splitlines.
_ENDS = r"\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}-\x{2029}"
LINE_END = rf"\r\n|[{_ENDS}]"
_END_SIGNS = ["\n", "\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
_IMPORT_LINE = r"(?md)^[ \t]*+import [^\n]*+"
# Imports of a text that are looked for one by one; more of them are found by hashing.
FEW_NAMES = 16
DEFAULT_FILENAME = "pasted_snippet.py"


def has_other_end(code: Column) -> Column:
    """There is a line end besides ``\\n``. A class of characters below 256 is one table look-up each; with more it is several calls."""
    return code.rlike(r"[\r\x0B\f\x1C\x1D\x1E\x{85}]") | F.contains(code, F.lit("\u2028")) | F.contains(code, F.lit("\u2029"))


def split_lines(code: Column) -> Column:
    """Lines as an array, without the empty piece after a final line end (A2)."""
    # one element, so that the text is split once however often the lines are named
    return F.transform(F.array(F.split(code, LINE_END, -1)), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts))[0]


def count_lines(code: Column) -> Column:
    """Number of lines without building them; where ``\\n`` is the only line end, bytes are counted and no pattern is run per character."""
    plain = F.octet_length(code) - F.octet_length(F.replace(code, F.lit("\n"), F.lit("")))
    ends = F.when(has_other_end(code), F.regexp_count(code, F.lit(LINE_END))).otherwise(plain)
    closed = reduce(or_, [code.endswith(sign) for sign in _END_SIGNS])  # looks at the last bytes only
    open_end = (F.octet_length(code) > 0) & ~closed
    return (ends + open_end.cast("int")).cast("int")


def detect_language(filename: Column) -> Column:
    """java for a .java name in any case, python for all else (B1)."""
    return F.when(
        F.lower(F.coalesce(filename, F.lit(""))).endswith(".java"), F.lit("java")
    ).otherwise(F.lit("python"))


def resolve_language(filename: Column, override: Column) -> Column:
    """An exact override wins over the file name (B2)."""
    return F.when(override.isin("python", "java"), override).otherwise(detect_language(filename))


def has_code(code: Column) -> Column:
    """True when there is any character that is not white space (B3); never null."""
    return F.coalesce(F.regexp_like(code, F.lit(r"(?U)[^\s\x1C-\x1F]")), F.lit(False))


_SECRET_STARTS = "".join(sorted({word[0] for word in dims.JAVA_SECRET_WORDS}))


def python_secret(text: Column) -> Column:
    # one pass for all patterns; a first look at the letter they begin with spares trying each of them at every character
    patterns = "|".join(pattern.replace(r"\s", r"[\s\x1C-\x1F]").removeprefix("(?i)") for pattern in dims.PYTHON_SECRET_PATTERNS)
    return text.rlike(f"(?U)(?i)(?=[{_SECRET_STARTS}-])(?:{patterns})")


def java_secret(line: Column) -> Column:
    lowered = F.lower(line)
    word = F.lit(False)
    for secret_word in dims.JAVA_SECRET_WORDS:
        word = word | lowered.contains(secret_word)
    quoted = F.filter(F.split(line, '"', -1), lambda _, i: i % 2 == 1)
    long_part = F.exists(
        quoted,
        lambda part: F.length(F.btrim(F.btrim(part, F.lit(" \t\n\r\f\x0b")), F.lit('";'))) >= 6,
    )
    return line.contains("=") & line.contains('"') & word & long_part


def secret_lines(code: Column, language: Column) -> Column:
    """1-based numbers of the lines that look like a hard-coded secret.

    The first test reads the whole text once and leaves most files unsplit: a line can
    only match when its text as a whole does.
    """
    numbered = F.transform(
        split_lines(code), lambda text, i: F.struct((i + 1).cast("int").alias("line"), text.alias("text"))
    )
    py = F.filter(numbered, lambda x: python_secret(x["text"]))
    java = F.filter(numbered, lambda x: java_secret(x["text"]))
    any_word = F.lit(f"(?i)(?=[{_SECRET_STARTS}])(?:{'|'.join(dims.JAVA_SECRET_WORDS)})")
    hits = F.when((language == "java") & F.regexp_like(code, any_word), java).when(
        (language != "java") & python_secret(code), py
    )
    return F.coalesce(F.transform(hits, lambda x: x["line"]), F.array().cast("array<int>"))


def java_unreferenced(code: Column, names: Column) -> Column:
    """Those of ``names`` that occur in no line but import lines.

    Import lines are blanked out and up to ``FEW_NAMES`` names are looked for in the rest. For more of them the text is reduced to its distinct
    runs of word characters: a name is made of these, so an occurrence lies inside one run, and names that are a run of their own
    are found by hashing. So a generated file with thousands of used imports takes linear time.
    """
    rest = F.when(has_other_end(code), F.regexp_replace(
        F.regexp_replace(code, LINE_END, "\n"), _IMPORT_LINE, "")).otherwise(F.regexp_replace(code, _IMPORT_LINE, ""))

    def by_name(asked):
        return F.transform(F.array(rest), lambda text: F.filter(
            asked, lambda name: ~F.contains(text, name)))[0]

    def by_hash(asked):
        runs = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[\w$\x{80}-\x{10FFFF}]+"), F.lit(0)))
        return F.transform(
            F.transform(F.array(runs), lambda x: F.struct(F.array_join(x, " ").alias("rest"), F.array_except(asked, x).alias("names"))),
            lambda x: F.filter(x["names"], lambda name: ~F.contains(x["rest"], name)),
        )[0]

    # one element, so that the names are gathered once
    return F.transform(F.array(names), lambda asked: F.when(F.size(asked) == 0, asked).when(
        F.size(asked) <= FEW_NAMES, by_name(asked)).otherwise(by_hash(asked)))[0]


def risk_score(total_weight: Column) -> Column:
    """min(100, weight / 40 * 100) with half-even rounding on doubles."""
    share = total_weight.cast("double") / F.lit(float(dims.FULL_SCORE_WEIGHT)) * F.lit(100.0)
    return F.least(F.lit(100), F.bround(share).cast("int"))


def risk_level(total_weight: Column) -> Column:
    """Level by weight, not by score."""
    return (
        F.when(total_weight >= dims.HIGH_WEIGHT, F.lit("High"))
        .when(total_weight >= dims.MEDIUM_WEIGHT, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def expected_text(low: Column, high: Column) -> Column:
    """Text of an arity: n, n-m or at least n."""
    return (
        F.when(high.isNull(), F.concat(F.lit("at least "), low.cast("string")))
        .when(low == high, low.cast("string"))
        .otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))
    )
