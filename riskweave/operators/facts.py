"""Fact tables: one view per operator over the annotated token rows.

Columns that a view does not use are pruned together with the windows that compute them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import groups, scopes, tokens

KEY = ["file_id", "language"]


def annotated(files: DataFrame, head=None) -> DataFrame:
    return groups.grouped(groups.local_roles(tokens.structured(files, head)))


def faults(files: DataFrame) -> DataFrame:
    """First fault per malformed file."""
    rows = scopes.spanned(annotated(files).filter(scopes.scoping())).filter(F.col("fault").isNotNull())
    return rows.groupBy(*KEY).agg(F.min_by(F.struct("line", "fault"), "pos").alias("first")).select(
        *KEY, "first.line", "first.fault"
    )


def imports(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("import").isNotNull()).select(
        *KEY, "import.line", "import.path", F.substring_index("import.path", ".", 1).alias("top"),
        F.col("import.name").alias("bound_name"), "import.wildcard",
    )


def functions(rows: DataFrame) -> DataFrame:
    """Declared functions and methods; a method with a body states itself twice, hence distinct."""
    return rows.filter(F.col("declared").isNotNull()).select(
        *KEY, "declared.pos", "declared.name", "declared.line"
    ).distinct()


def spans(rows: DataFrame) -> DataFrame:
    """Functions that end: span and complexity (C5, C13, C14, D5, E5 before the threshold)."""
    return scopes.spanned(rows.filter(scopes.scoping())).filter(
        (F.col("is_def") | F.col("is_body")) & F.col("span.end").isNotNull()
    ).select(
        *KEY, "span.name", "span.line", "span.start", "span.end", "span.complexity"
    )


def name_refs(rows: DataFrame) -> DataFrame:
    """Distinct names a Python file uses."""
    return rows.filter(F.col("is_use") & F.col("names").isNotNull()).select(
        *KEY, F.explode("names").alias("name")
    ).withColumn("name", F.substring_index("name", ".", 1)).distinct()


def attributes(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("attr").isNotNull()).select(*KEY, "pos", "line", "attr.qualifier", "attr.member")


def calls(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("call").isNotNull()).select(
        *KEY, "call.pos", "call.line", "call.qualifier", "call.member", "call.n_args"
    )


def parameters(rows: DataFrame) -> DataFrame:
    """Checked parameters with the function that owns them."""
    return scopes.spanned(rows.filter(scopes.scoping())).filter(F.col("is_param") & F.col("span.name").isNotNull()).select(
        *KEY, F.col("span.name").alias("function"), F.col("span.line").alias("line"),
        F.col("names")[0].alias("parameter"),
    )


def guards(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_guard")).select(*KEY, "pos", "line", F.col("names")[0].alias("name"))


def dereferences(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_deref")).select(*KEY, "pos", "line", F.col("names")[0].alias("name"))


def handlers(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("handler").isNotNull()).select(
        *KEY, "handler.line", F.array_join("handler.types", ", ").alias("types"), "handler.body"
    )
