"""Function spans, complexity and the first use of a name in a span.

Interval containment is never a join.  A span's complexity is a difference of running sums at
its two ends; "is there a guard inside the span" is "does the next guard of that name, read
backwards through the file, lie before the end".
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.operators import groups
from riskweave.operators.tokens import before, folded, is_, is_py, last_where, one_of, so_far, unfolded


def name_uses(rows: DataFrame) -> DataFrame:
    """Explodes ``names`` and adds per name: used anywhere, next guard, next dereference.

    Parameters are placed at the start of their function, so that all rows after them and
    before its end are inside it.
    """
    rows = rows.select("*", F.posexplode_outer("names").alias("nth", "element")).drop("names")
    element, field = F.col("element"), F.col("field_indexed").isNotNull()
    name, dotted = F.substring_index(element, ".", 1), F.contains(element, F.lit("."))
    first, field_attr = F.coalesce(F.col("nth") == 0, F.lit(True)), F.when(
        field & dotted, F.struct(name.alias("qualifier"), F.substring_index(element, ".", -1).alias("member")))
    rows = rows.withColumns({
        "name": name, "first_name": first, "at": F.coalesce("param_start", "pos"),
        "attr": F.coalesce("attr", field_attr),
        "is_deref": F.col("is_deref") | (field & (dotted | F.array_contains("field_indexed", name))),
        "is_guard": F.col("is_guard") | (field & F.array_contains("field_guarded", name)),
        # the names of one f-string share its row; only the first of them speaks for the row
        "line_start": F.col("line_start") & first, "decision": F.when(first, F.col("decision")).otherwise(0),
        "fault": F.when(first, F.col("fault")),
        **({"head": F.when(first, F.col("head"))} if "head" in rows.columns else {}),
    }).drop("nth", "element", "param_start", "field_indexed", "field_guarded")
    named, own_use = F.col("name").isNotNull(), F.col("is_use") & F.col("import").isNull()
    backwards = W.partitionBy("file_id", "name").orderBy(F.desc("at"), F.desc("pos"))
    later = backwards.rowsBetween(W.unboundedPreceding, -1)
    everywhere = backwards.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # rows without a name have nothing to share: what a row says is said to itself only
    rows = folded(rows, ["file_id", "name", "at", "pos", "line", "is_use", "import", "is_guard", "is_deref"], "rest").withColumns({
        "used": F.when(named, F.max(own_use).over(everywhere)).otherwise(own_use),
        "next_guard": last_where(F.col("is_guard") & named, F.col("pos"), later),
        "next_deref": last_where(F.col("is_deref") & named, F.struct("pos", "line"), later),
    })
    rows = unfolded(rows, "rest")
    return rows.filter(F.col("first_name") | F.col("attr").isNotNull()).drop("first_name", "at", "is_use", "is_guard", "is_deref")


def spanned(rows: DataFrame) -> DataFrame:
    """Adds ``span`` (name, line, start, end, complexity) to every row that has a ``fkey``.

    Python: a statement closes every function whose margin lies between its own margin and that
    of the statement above it.  One row per such margin is emitted, so the next row of the same
    margin closes the function; their number is bounded by the blanks the file itself holds.
    Java: the closing brace carries the key of the body it closes.
    """
    used_here = [
        "decision", "line_start", "is_at", "below_at", "is_def", "def_name", "indent", "margin_above", "body", "closes_body",
        "fkey", "fault", "begins_with",
    ]
    passed = ["file_id", "java", "pos", "line"]
    rows = folded(rows, [*passed, *used_here], "passed")
    passed += ["passed"] if "passed" in rows.columns else []
    rows = rows.withColumn("upto", F.sum("decision").over(so_far()))
    # decorators belong to the function below them
    start = F.struct("pos", (F.col("upto") - F.col("decision")).alias("upto"))
    rows = rows.withColumn("run", last_where(F.col("line_start") & F.col("is_at") & ~F.col("below_at"), start, before()))
    rows = rows.withColumn("start", F.when(F.col("is_def"), F.when(F.col("below_at"), F.col("run")).otherwise(start)))

    rows = rows.withColumn("margin", F.explode(F.when(
        is_py() & F.col("line_start"),
        F.sequence(F.col("indent"), F.greatest("indent", "margin_above")),
    ).otherwise(F.array(F.lit(-1)))))
    same_margin = W.partitionBy("file_id", "margin").orderBy("pos")
    own = F.col("margin") == F.col("indent")
    rows = rows.withColumns({
        "next": F.lead(F.struct("pos", (F.col("upto") - F.col("decision")).alias("upto"))).over(same_margin),
        "prior_own": F.lag(own).over(same_margin),
        # how the statements above and below begin that are in the same block
        "prior_begins": F.lag(F.when(own, F.col("begins_with"))).over(same_margin),
        "next_begins": F.lead(F.when(own, F.col("begins_with"))).over(same_margin),
    })
    alone = F.lit(False)
    for word, after in groups.CONTINUES.items():
        alone = alone | (is_("begins_with", word) & ~one_of("prior_begins", *after))
    unhandled = is_("begins_with", "try") & ~one_of("next_begins", "except", "finally")
    dedent = F.col("line_start") & (F.col("indent") < F.col("margin_above")) & ~F.coalesce("prior_own", F.lit(False))
    opens_body, closes = F.col("body").isNotNull(), F.col("closes_body")
    rows = rows.filter((F.col("margin") == -1) | own).select(
        *passed, "fkey", "is_def", opens_body.alias("is_body"),
        F.coalesce(
            "fault", F.when(dedent, F.lit("unindent does not match any outer indentation level")),
            F.when(own & alone, F.lit("invalid syntax")), F.when(own & unhandled, F.lit("expected 'except' or 'finally' block")),
        ).alias("fault"),
        F.when(F.col("is_def"), F.struct(
            F.col("def_name").alias("name"), "line", F.col("start.pos").alias("start"), F.col("next.pos").alias("end"),
            F.col("start.upto").alias("from_upto"), F.col("next.upto").alias("to_upto"),
        )).when(opens_body, F.struct(
            F.col("body.name").alias("name"), F.col("body.line").alias("line"), F.col("fkey").alias("start"),
            F.lit(None).cast("bigint").alias("end"), F.col("upto").alias("from_upto"),
            F.lit(None).cast("bigint").alias("to_upto"),
        )).alias("opened"),
        F.when(closes, F.struct(F.col("pos").alias("end"), F.col("upto").alias("to_upto"))).alias("closed"),
    )
    # the rows of one function carry its key; the rows without a key open and close nothing
    by_function = W.partitionBy("file_id", "fkey")
    rows = rows.withColumns({
        "opened": F.first("opened", ignorenulls=True).over(by_function),
        "closed": F.first("closed", ignorenulls=True).over(by_function),
    })
    span = F.struct(
        F.col("opened.name").alias("name"), F.col("opened.line").alias("line"), F.col("opened.start").alias("start"),
        F.coalesce("opened.end", "closed.end").alias("end"),
        (1 + F.coalesce("opened.to_upto", "closed.to_upto") - F.col("opened.from_upto")).alias("complexity"),
    )
    rows = rows.withColumn(
        "span", F.when(F.col("fkey").isNotNull() & F.col("opened").isNotNull(), span)
    ).drop("opened", "closed", "fkey")
    return unfolded(rows, "passed")


def scoping() -> Column:
    """Rows that spans are made of, or that spans say something about."""
    return F.col("line_start") | F.col("fault").isNotNull() | (F.col("decision") > 0) | F.col("fkey").isNotNull()


def unguarded() -> Column:
    """The row is a parameter that is dereferenced in its span and never guarded there."""
    inside = F.col("next_deref.pos") < F.col("span.end")
    guarded = F.coalesce(F.col("next_guard") < F.col("span.end"), F.lit(False))
    return F.col("is_param") & F.coalesce(inside, F.lit(False)) & ~guarded
