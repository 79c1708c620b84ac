"""The analysis plan: submissions in, one report per file out.

One exchange of the raw texts by ``file_id`` (none on a table bucketed by it), then local sorts
and windows only.  Nothing is materialised on the way and no file is read twice.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import text
from riskweave.operators import facts, rules, scopes
from riskweave.operators.tokens import is_java, language
from riskweave.sources import dims

_JAVA_IMPORT = r"(?=i)\bimport\s+(?:static\s+)?((?:[\w$\x{80}-\x{10FFFF}]+\s*\.\s*)*[\w$\x{80}-\x{10FFFF}]+)"


def _file_head() -> Column:
    """Per-file values that need the raw text; they ride on the first token of the file."""
    code, named = F.col("code"), F.col("language")
    imported = F.array_distinct(F.transform(
        F.regexp_extract_all(code, F.lit(_JAVA_IMPORT), F.lit(1)),
        lambda path: F.regexp_extract(path, r"([^\s.]+)$", 1),
    ))
    return F.struct(
        "filename", text.count_lines(code).alias("num_lines"),
        text.secret_lines(code, named).alias("secret_lines"),
        F.when((named == "java") & code.contains("import"), text.java_unreferenced(code, imported)).alias("unreferenced"),
    )


def _rule_struct(language: str, found: Column, weights) -> Column:
    """Adds severity, weight and category to a raw finding."""
    meta = {rule: (severity, weight, category) for lang, rule, severity, weight, category in dims.RULES if lang == language}

    def looked_up(index, cast):
        chain = None
        for rule, values in meta.items():
            value = weights.get((language, rule), values[1]) if index == 1 else values[index]
            chain = (F if chain is None else chain).when(found["rule_id"] == rule, F.lit(value).cast(cast))
        return chain

    return F.struct(
        found["rule_id"].alias("rule_id"), found["message"].alias("message"),
        looked_up(0, "string").alias("severity"), looked_up(1, "int").alias("weight"),
        found["line"].alias("line"), looked_up(2, "string").alias("category"),
    )


def _any_of(*columns: str) -> Column:
    return reduce(or_, [F.col(c).isNotNull() for c in columns])


def reports(
    files: DataFrame, rule_ids=None, thresholds: dict[str, int] | None = None,
    weights: dict[tuple[str, str], int] | None = None,
) -> DataFrame:
    """One row per accepted file: score, level, facts and findings (D, E, G1-G8, H4).

    ``rule_ids`` limits the work to some rules; ``thresholds`` and ``weights`` override the
    curated values (K4).
    """
    wanted = list(rules.ALL_RULES if rule_ids is None else rule_ids)
    # rows without names share nothing with others, so those that state nothing either go before names are sorted, and the
    # others of that sort go once their names are
    telling = ["call", "attr", "handler", "import", "module", "declared", "head"]
    rows = facts.annotated(files, _file_head()).filter(scopes.scoping() | _any_of("names", *telling)).drop("language")
    rows = scopes.name_uses(rows).filter(scopes.scoping() | _any_of(*telling))

    def chosen(hits, second=False):
        columns = [
            column for rule, candidates in hits.items() if rule in wanted and (rule in rules.SECOND) == second
            for column in candidates
        ]
        return F.coalesce(*columns) if columns else F.lit(None).cast(rules.RAW_FINDING)

    # only calls and attributes of the curated tables, or of a name that may be a mistyped class
    known = F.col("ref").isNotNull() | (is_java() & F.col("call.qualifier").rlike(r"^\p{Lu}"))
    stating = (
        F.coalesce(known, F.lit(False)) | F.col("handler").isNotNull() | F.col("import").isNotNull()
        | F.col("module").isNotNull()
    )
    rows = rules.with_reference(rows).filter(
        scopes.scoping() | stating | F.col("head").isNotNull() | F.col("declared").isNotNull()
    )
    # what a row says on its own is said here, so that the spans carry little
    rows = rows.select(
        "file_id", "java", "pos", "line", "head", "name", "import", "module", "declared", "is_param", "next_guard",
        "next_deref", "decision", "line_start", "is_at", "below_at", "is_def", "def_name", "indent", "margin_above",
        "body", "closes_body", "fkey", "fault", "begins_with", F.when(stating, chosen(rules.row_hits())).alias("said"),
        F.when(stating, chosen(rules.row_hits(), second=True)).alias("also_said"),
    )
    rows = scopes.spanned(rows)
    tested = F.col("is_def") | F.col("is_body") | F.col("is_param")
    rows = rows.select(
        "file_id", "java", "pos", "head", "fault", "line", "import", "module", "declared", "said",
        "also_said", F.when(tested, chosen(rules.span_hits(thresholds))).alias("span_said"),
    )
    return _assembled(rows, wanted, weights or {})


def _assembled(rows: DataFrame, wanted, weights) -> DataFrame:
    per_file = rows.groupBy("file_id").agg(
        F.first("java").alias("java"),
        F.first("head", ignorenulls=True).alias("head"),
        F.min(F.when(F.col("fault").isNotNull(), F.struct("pos", "line", "fault"))).alias("fault"),
        F.collect_list(F.when(F.col("module").isNotNull(), F.struct("pos", F.col("module").alias("name")))).alias("modules"),
        F.collect_set(F.col("declared")).alias("declared"),
        F.collect_list(F.when(is_java() & F.col("import").isNotNull(), F.struct("pos", "import"))).alias("imports"),
        F.collect_list("said").alias("said"), F.collect_list("also_said").alias("also_said"),
        F.collect_list("span_said").alias("span_said"),
    )
    no_findings = F.array().cast(f"array<{rules.RAW_FINDING}>")
    secrets = F.transform("head.secret_lines", lambda line: F.struct(
        F.when(is_java(), rules.ORDER[("java", "HARDCODED_SECRET")]).otherwise(rules.ORDER[("python", "HARDCODED_SECRET")]).alias("rule_order"),
        line.alias("line"), F.lit(0).cast("bigint").alias("pos"), F.lit("HARDCODED_SECRET").alias("rule_id"),
        F.lit(rules.TEXTS["HARDCODED_SECRET"]).alias("message"),
    ))
    unused = F.transform(
        F.filter("imports", lambda x: ~x["import"]["wildcard"] & F.array_contains(F.col("head.unreferenced"), x["import"]["name"])),
        lambda x: F.struct(
            F.lit(rules.ORDER[("java", "UNUSED_IMPORT")]).alias("rule_order"), x["import"]["line"].alias("line"),
            x["pos"].cast("bigint").alias("pos"), F.lit("UNUSED_IMPORT").alias("rule_id"),
            F.format_string(rules.TEXTS["UNUSED_IMPORT"], x["import"]["path"]).alias("message"),
        ),
    )
    parse_error = F.array(F.struct(
        F.lit(0).alias("rule_order"), F.lit(0).alias("line"), F.lit(0).cast("bigint").alias("pos"),
        F.lit("PARSE_ERROR").alias("rule_id"),
        F.when(is_java(), F.format_string(rules.TEXTS["PARSE_ERROR_JAVA"], F.col("fault.fault"), F.col("fault.line")))
        .otherwise(F.format_string(rules.TEXTS["PARSE_ERROR"], F.col("fault.fault"), F.col("fault.line"))).alias("message"),
    )) if "PARSE_ERROR" in wanted else no_findings
    broken = F.col("fault").isNotNull()
    parts = [F.col("said"), F.col("also_said"), F.col("span_said")]
    if "HARDCODED_SECRET" in wanted:
        parts.append(F.coalesce(secrets, no_findings))
    if "UNUSED_IMPORT" in wanted:
        parts.append(F.when(is_java() & F.col("head.unreferenced").isNotNull(), unused).otherwise(no_findings))
    per_file = per_file.withColumn("ordered", F.when(broken, parse_error).otherwise(F.array_sort(F.concat(*parts))))
    # a mistyped class is told once per line; equal lines are neighbours in the sorted array
    typo = "HALLUCINATED_CLASS_NAME"
    told_once = F.filter("ordered", lambda x, i: ~(
        (x["rule_id"] == typo) & (i > 0)
        & F.coalesce(
            (F.get("ordered", i - 1)["rule_id"] == typo) & (F.get("ordered", i - 1)["line"] == x["line"]), F.lit(False)
        )
    ))
    found = F.transform(told_once, lambda x: F.when(
        is_java(), _rule_struct("java", x, weights)).otherwise(_rule_struct("python", x, weights)))
    empty = F.array().cast("array<string>")
    names = lambda column: F.when(broken, empty).otherwise(F.transform(F.array_sort(column), lambda x: x["name"]))
    declared = F.transform("declared", lambda x: F.struct(x["pos"].alias("pos"), x["name"].alias("name")))
    per_file = per_file.select(
        "file_id", "head.filename", language().alias("language"),
        F.struct(
            names(F.col("modules")).alias("imports"), names(declared).alias("functions"),
            F.when(broken, 0).otherwise(F.col("head.num_lines")).alias("num_lines"),
        ).alias("facts"),
        found.alias("findings"),
    )
    per_file = per_file.withColumn(
        "total_weight", F.aggregate("findings", F.lit(0), lambda total, x: total + x["weight"])
    )
    weight = F.col("total_weight")
    return per_file.select(
        "file_id", "filename", "language", text.risk_level(weight).alias("risk_level"),
        text.risk_score(weight).alias("risk_score"), "total_weight", F.size("findings").alias("num_findings"),
        "facts", "findings",
    )


def findings(report_rows: DataFrame) -> DataFrame:
    """Flat findings of reports."""
    return report_rows.select("file_id", "language", F.explode("findings").alias("x")).select(
        "file_id", "language", "x.*"
    )
