"""The Python and Java rules as one emission over fully annotated rows.

``row_hits`` and ``span_hits`` give candidate findings per rule; a row states at most one of
the rules in ``SECOND`` and one of the others (an import can be unused and unknown, a call broken and its class
mistyped).  All lookups against curated
lists are one broadcast join with a table whose size is fixed in ``sources.dims``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import text
from riskweave.operators.scopes import unguarded
from riskweave.operators.tokens import is_java, is_py
from riskweave.session import held
from riskweave.sources import dims

# Message texts, per rule and language where they differ.
TEXTS = {
    "UNUSED_IMPORT": "Import '%s' is never used.",
    "BARE_EXCEPT": "Bare 'except:' catches all exceptions, including KeyboardInterrupt/SystemExit. "
                   "Specify an exception type.",
    "SWALLOWED_EXCEPTION": "Exception is caught but silently ignored (pass only).",
    "SWALLOWED_EXCEPTION_JAVA": "Catch block for %s is empty; the exception is silently swallowed.",
    "BROAD_CATCH": "Catch block catches overly broad type '%s'. Prefer a specific exception type.",
    "HARDCODED_SECRET": "Line appears to contain a hardcoded secret/credential.",
    "HIGH_COMPLEXITY": "Function '%s' has cyclomatic complexity %d (threshold %d). "
                       "Consider splitting into smaller functions.",
    "HIGH_COMPLEXITY_JAVA": "Method '%s' has cyclomatic complexity %d (threshold %d). "
                            "Consider splitting into smaller methods.",
    "MISSING_NONE_CHECK": "Parameter '%s' in function '%s' defaults to None but is accessed without "
                          "a None check, risking AttributeError/TypeError.",
    "MISSING_NULL_CHECK": "Parameter '%s' in method '%s' is dereferenced without a null check, "
                          "risking a NullPointerException.",
    "HALLUCINATED_IMPORT": "Module '%s' does not appear to be a real standard-library or common "
                           "package — looks like a hallucinated import.",
    "HALLUCINATED_IMPORT_JAVA": "Import '%s' does not match any known JDK or common third-party "
                                "package pattern — looks like a hallucinated import.",
    "HALLUCINATED_ATTRIBUTE": "'%s.%s' does not exist. This looks like an LLM-hallucinated API call.",
    "HALLUCINATED_METHOD": "'%s.%s()' does not exist. This looks like an LLM-hallucinated API call.",
    "ARGUMENT_MISMATCH": "'%s.%s()' called with %d argument(s); expected %s.",
    "HALLUCINATED_CLASS_NAME": "'%s' looks like a typo of the real JDK class '%s' — this call "
                               "will not compile.",
    "PARSE_ERROR": "SyntaxError: %s at line %d",
    "PARSE_ERROR_JAVA": "JavaSyntaxError: %s at line %d",
}
RAW_FINDING = "struct<rule_order:int,line:int,pos:bigint,rule_id:string,message:string>"
ORDER = {}
for _language, _rule, *_ in dims.RULES:
    ORDER[(_language, _rule)] = sum(1 for lang, *_x in dims.RULES if lang == _language and (lang, _x[0]) in ORDER)
SECOND = ["HALLUCINATED_IMPORT", "HALLUCINATED_CLASS_NAME"]
ALL_RULES = sorted({rule for _, rule, *_ in dims.RULES})


def hit(condition: Column, language: str, rule_id: str, line: Column, message: Column, pos: Column | None = None) -> Column:
    """One candidate finding: a struct when the condition holds, else null."""
    return F.when(condition, F.struct(
        F.lit(ORDER[(language, rule_id)]).alias("rule_order"),
        line.cast("int").alias("line"),
        (F.col("pos") if pos is None else pos).cast("bigint").alias("pos"),
        F.lit(rule_id).alias("rule_id"),
        message.alias("message"),
    ))


def unknown_package(path: Column) -> Column:
    """A Java import of at most two segments below no known package."""
    known = F.lit(False)
    for prefix in dims.JAVA_PACKAGE_PREFIXES:
        known = known | path.startswith(prefix)
    return ~known & (F.size(F.split(path, "[.]")) <= 2) & ~path.startswith("java")


def core_class_typo(root: Column) -> Column:
    """The first core class within two edits of a capitalised name, else null."""
    # written out: a function over an array would leave generated code
    close = F.coalesce(*[F.when(F.levenshtein(root, F.lit(c), 2).between(1, 2), F.lit(c)) for c in dims.JAVA_CORE_CLASSES])
    candidate = (F.length(root) >= 4) & root.rlike(r"^\p{Lu}") & ~root.isin(dims.JAVA_CORE_CLASSES)
    return F.when(candidate, close)


def with_reference(rows: DataFrame) -> DataFrame:
    """Adds ``ref``: the curated entry of a call or attribute, by broadcast."""
    table = dims.ref_member(rows.sparkSession).select(
        (F.col("language") == "java").alias("ref_java"), F.col("qualifier").alias("ref_qualifier"),
        F.col("member").alias("ref_member"), F.struct("is_fake", "min_args", "max_args").alias("ref"),
    )
    asked = F.coalesce(F.col("call.qualifier"), F.col("attr.qualifier"))
    asked_member = F.coalesce(F.col("call.member"), F.col("attr.member"))
    return rows.join(
        F.broadcast(table),
        (F.col("ref_java") == F.col("java")) & (F.col("ref_qualifier") == asked)
        & (F.col("ref_member") == asked_member),
        "left",
    ).drop("ref_java", "ref_qualifier", "ref_member")


def span_hits(thresholds: dict[str, int] | None = None) -> dict[str, list[Column]]:
    """Candidate findings per rule id that need the span of a function."""
    limits = {**dims.COMPLEXITY_THRESHOLD, **(thresholds or {})}
    name, span, weak_spot, fmt = F.col("name"), F.col("span"), unguarded(), F.format_string
    return {
        "HIGH_COMPLEXITY": [
            hit(F.col("is_def") & (span["complexity"] > limits["python"]), "python", "HIGH_COMPLEXITY", span["line"],
                fmt(TEXTS["HIGH_COMPLEXITY"], span["name"], span["complexity"], F.lit(limits["python"]))),
            hit(F.col("is_body") & (span["complexity"] > limits["java"]), "java", "HIGH_COMPLEXITY", span["line"],
                fmt(TEXTS["HIGH_COMPLEXITY_JAVA"], span["name"], span["complexity"], F.lit(limits["java"])))],
        "MISSING_NONE_CHECK": [hit(
            is_py() & weak_spot, "python", "MISSING_NONE_CHECK", F.col("next_deref.line"),
            fmt(TEXTS["MISSING_NONE_CHECK"], name, span["name"]), F.col("next_deref.pos"))],
        "MISSING_NULL_CHECK": [hit(
            is_java() & weak_spot, "java", "MISSING_NULL_CHECK", F.col("next_deref.line"),
            fmt(TEXTS["MISSING_NULL_CHECK"], name, span["name"]), F.col("next_deref.pos"))],
    }


@held
def row_hits() -> dict[str, list[Column]]:
    """Candidate findings per rule id, over rows of ``name_uses`` with the ``ref`` column."""
    name, imp, call, attr = F.col("name"), F.col("import"), F.col("call"), F.col("attr")
    handler, ref, fmt = F.col("handler"), F.col("ref"), F.format_string
    arity_broken = call.isNotNull() & ~ref["is_fake"] & (
        (call["n_args"] < ref["min_args"]) | F.coalesce(call["n_args"] > ref["max_args"], F.lit(False))
    )
    root = F.substring_index(call["qualifier"], ".", 1)
    typo = F.when(is_java() & call.isNotNull(), core_class_typo(root))
    top = F.substring_index(F.col("module"), ".", 1)
    broad = F.array_join(handler["types"], ", ")
    return {
        "UNUSED_IMPORT": [hit(
            is_py() & imp.isNotNull() & ~imp["wildcard"] & ~F.coalesce(F.col("used"), F.lit(False)),
            "python", "UNUSED_IMPORT", imp["line"], fmt(TEXTS["UNUSED_IMPORT"], name))],
        "BARE_EXCEPT": [hit(handler["body"] == "bare", "python", "BARE_EXCEPT", handler["line"], F.lit(TEXTS["BARE_EXCEPT"]))],
        "SWALLOWED_EXCEPTION": [
            hit(handler["body"] == "pass", "python", "SWALLOWED_EXCEPTION", handler["line"], F.lit(TEXTS["SWALLOWED_EXCEPTION"])),
            hit(handler["body"] == "empty", "java", "SWALLOWED_EXCEPTION", handler["line"],
                fmt(TEXTS["SWALLOWED_EXCEPTION_JAVA"], broad))],
        "BROAD_CATCH": [hit(
            (handler["body"] == "filled") & broad.isin("Exception", "Throwable"),
            "java", "BROAD_CATCH", handler["line"], fmt(TEXTS["BROAD_CATCH"], broad))],
        "HALLUCINATED_IMPORT": [
            hit(is_py() & top.isin(dims.PYTHON_FAKE_MODULES), "python", "HALLUCINATED_IMPORT", F.col("stmt_line"),
                fmt(TEXTS["HALLUCINATED_IMPORT"], top)),
            hit(is_java() & imp.isNotNull() & unknown_package(imp["path"]), "java", "HALLUCINATED_IMPORT", imp["line"],
                fmt(TEXTS["HALLUCINATED_IMPORT_JAVA"], imp["path"]))],
        "HALLUCINATED_ATTRIBUTE": [hit(
            attr.isNotNull() & ref["is_fake"], "python", "HALLUCINATED_ATTRIBUTE", F.col("line"),
            fmt(TEXTS["HALLUCINATED_ATTRIBUTE"], attr["qualifier"], attr["member"]))],
        "HALLUCINATED_METHOD": [hit(
            is_java() & call.isNotNull() & ref["is_fake"], "java", "HALLUCINATED_METHOD", call["line"],
            fmt(TEXTS["HALLUCINATED_METHOD"], call["qualifier"], call["member"]), call["pos"])],
        "ARGUMENT_MISMATCH": [
            hit(language_is & arity_broken, language, "ARGUMENT_MISMATCH", call["line"],
                fmt(TEXTS["ARGUMENT_MISMATCH"], call["qualifier"], call["member"], call["n_args"],
                    text.expected_text(ref["min_args"], ref["max_args"])), call["pos"])
            for language, language_is in (("python", is_py()), ("java", is_java()))],
        "HALLUCINATED_CLASS_NAME": [hit(
            typo.isNotNull(), "java", "HALLUCINATED_CLASS_NAME", call["line"],
            fmt(TEXTS["HALLUCINATED_CLASS_NAME"], root, typo), call["pos"])],
    }
