"""Facts of single tokens, then facts that need the enclosing bracket group.

``local_roles`` looks at a token and its neighbours only and drops the neighbours again, so the
rows that are sorted by bracket level are narrow.  ``grouped`` adds the enclosing group: its
windows run over ``(file_id, level)`` in token order.  Rows of one level follow each other group
by group, so "last opening bracket so far" is the enclosing one, and counts inside a group are
differences of running sums.  Nothing pairs rows with rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import lexing
from riskweave.operators.tokens import (
    Symbols, folded, in_context, is_, is_java, is_py, language, last_where, level_before, level_order, level_so_far, one_of, unfolded,
)
from riskweave.session import held

# Tokens that end an and/or chain, types without a name, operators that bind
# tighter than a comparison, comparisons, and what stands before a constructor.
_CHAIN_ENDS = [",", ":", "=", ":=", "if", "else", "lambda", "for"]
_PRIMITIVES = ["void", "int", "long", "double", "float", "boolean", "char", "byte", "short"]
_TIGHTER = ["+", "-", "*", "/", "//", "%", "**", "@", "|", "&", "^", "<<", ">>", "~", ".", "await"]
_COMPARISONS = ["==", "!=", "<", ">", "<=", ">=", "is", "in"]
_BEFORE_CONSTRUCTOR = ["public", "protected", "private", ";", "{", "}"]
_STARS = ["*", "**"]
# What stands before a Java brace that holds statements, what may stand before its end, and words that may follow a
# call although they look like names.
_BEFORE_CODE = [")", "else", "try", "do", "finally", "->", ";", ":", "static"]
_BEFORE_END = [";", "}", "{", ":"]
_AFTER_CALL = ["when", "throws", "permits"]
# Words and signs that have a role of their own; no other ones are passed on, unless they begin a line or show a fault.
_PY_ROLES = [
    *lexing.OPENERS, *lexing.CLOSERS, lexing.END, *_CHAIN_ENDS, *_STARS, "@", "elif", "while", "try", "except", "with", "and", "or", "in",
    "import", "def", "pass", "None",
]
_JAVA_ROLES = [
    *lexing.OPENERS, *lexing.CLOSERS, lexing.END, ",", "&&", "||", "?", "if", "else", "for", "while", "case", "default", "try", "import",
]
_COMPARED = ["==", "!="]
# Columns that the windows of ``grouped`` read.
_GROUPS_NEED = ["file_id", "java", "pos", "line", "tok", "sym", "kind", "level", "line_start", "opening", "after_open", "after_comma",
                "after_star", "ends_header"]
# Python words that go on with the statement above them, and how that one may begin.
CONTINUES = {"else": ["if", "elif", "for", "while", "except"], "elif": ["if", "elif"], "except": ["try", "except"],
              "finally": ["try", "except", "else"]}


def _type_like(token: str, kind: str) -> Column:
    """The token can end a Java type."""
    return one_of(kind, "n", "g") | one_of(token, *_PRIMITIVES, "]")


def _f_string() -> Column:
    return is_py() & is_("kind", "s") & F.col("tok").rlike("^[rR]?[fF]")


@held
def _relevant() -> Column:
    """Rows that can matter from here on: those with a role that ``_roles`` or ``grouped`` sees. Names are used in Python; in Java they
    matter as what is called, declared, passed or compared. Both sides of each bracket stay."""
    tok, kind = Symbols("sym"), Symbols("kind")
    java_name = one_of("t1", "(", ",", ")", *_COMPARED) | one_of("p1", *_COMPARED)
    java = tok.isin(_JAVA_ROLES) | F.when(kind == "n", java_name).otherwise((kind == "k") & F.col("tok").startswith("catch"))
    python = tok.isin(_PY_ROLES) | (kind == "n") | _f_string()
    # faults come last: the filter is moved below the column, which is then made once a row, here or for the rows that stay
    return F.col("line_start") | (F.col("pos") == 0) | F.when(is_java(), java).otherwise(python) | F.col("fault").isNotNull()


def _py_import_item() -> Column:
    return is_py() & one_of("stmt.tok", "import", "from") & is_("import_ctx.stmt_pos", F.col("stmt.pos")) & (
        (is_("kind", "n") & one_of("p1", "import", ",", "(")) | (is_("sym", "*") & is_("p1", "import"))
    )


def _imports() -> dict[str, Column]:
    """Imported names and modules (C4)."""
    tok, text, from_line, item = Symbols("sym"), F.col("tok"), is_("stmt.tok", "from"), _py_import_item()
    bound = F.when(is_("t1", "as"), F.col("t2_text")).when(from_line, text).otherwise(F.substring_index("tok", ".", 1))
    py_import = F.when(item, F.struct(
        F.when(from_line, F.col("import_ctx.module")).otherwise(text).alias("path"),
        bound.alias("name"), (tok == "*").alias("wildcard"), F.col("stmt.line").alias("line"),
    ))
    static = is_("t1", "static")
    path = F.when(static, F.col("t2_text")).otherwise(F.col("t1_text"))
    after_path = F.when(static, F.col("t3")).otherwise(F.col("t2"))
    java_import = F.when(is_java() & (tok == "import") & (F.col("level") == 0), F.struct(
        path.alias("path"), F.substring_index(path, ".", -1).alias("name"),
        after_path.eqNullSafe(lexing.code(".")).alias("wildcard"), F.col("line").alias("line"),
    ))
    module = F.when(is_py(), F.when((tok == "import") & from_line, F.col("import_ctx.module")).when(item & ~from_line, text))
    return {"import": F.coalesce(py_import, java_import), "module": F.coalesce(module, java_import["path"])}


def _name_facts() -> dict[str, Column]:
    """Names, attributes, guards and dereferences as far as the token alone decides."""
    text, kind = F.col("tok"), Symbols("kind")
    first, dotted = F.substring_index("tok", ".", 1), F.contains(F.col("tok"), F.lit("."))
    name = (kind == "n") & ~is_("p1", ".")
    in_import = one_of("stmt.tok", "import", "from")
    no_use = (
        in_import | one_of("stmt.tok", "global", "nonlocal") | one_of("p1", "def", "class", "lambda")
        | (is_("p1", "as") & is_("stmt.tok", "except"))
        | ((F.col("level") > 0) & is_("t1", "=") & one_of("p1", "(", ","))
    )
    py_name = is_py() & name & ~no_use
    fields = F.regexp_replace(F.array_join(F.regexp_extract_all(
        F.regexp_replace(text, r"\{\{|\}\}|![rsa]", ""), F.lit(r"\{([^}]*)"), F.lit(1)), "\n"), r"'[^']*'|\"[^\"]*\"", "")

    def in_fields(pattern):
        return F.when(_f_string(), F.regexp_extract_all(fields, F.lit(r"(^|[^\w.])" + pattern), F.lit(2)))

    attr = F.when(
        is_py() & name & dotted & ~in_import & ~one_of("p1", "def", "class"),
        F.struct(first.alias("qualifier"), F.split("tok", "[.]")[1].alias("member")),
    )
    against_none = (
        (is_("t1", "is") & (is_("t2", "None") | (is_("t2", "not") & is_("t3", "None"))))
        | (one_of("t1", *[c for c in _COMPARISONS if c != "is"]) & is_("t2", "None"))
    )
    leading = ~one_of("p1", *_TIGHTER, *_COMPARISONS)
    # the name stands in brackets of its own, which are not those of a call
    alone = is_("p1", "(") & is_("t1", ")") & ~one_of("pk2", "n", "s", "g") & ~one_of("p2", *lexing.CLOSERS)
    alone_against_none = alone & ~one_of("p2", *_TIGHTER, *_COMPARISONS) & (
        (is_("t2", "is") & (is_("t3", "None") | (is_("t3", "not") & is_("t4", "None"))))
        | (one_of("t2", *[c for c in _COMPARISONS if c != "is"]) & is_("t3", "None"))
    )
    tested = one_of("stmt.tok", "if", "elif") & (
        (is_("t1", ":") & (F.col("level") == 0) & (
            one_of("p1", "if", "elif") | (one_of("p1", "not", "-", "+", "~") & one_of("p2", "if", "elif"))))
        | (is_("p1", "(") & one_of("p2", "if", "elif") & is_("t1", ")") & is_("t2", ":"))
        | (alone & is_("p2", "not") & one_of("p3", "if", "elif") & is_("t2", ":"))
    )
    compared = (one_of("t1", "==", "!=") & ~one_of("p1", "+", "-", "*", "/", "%", ".")) | (
        one_of("p1", "==", "!=") & ~one_of("t1", "+", "-", "*", "/", "%", "(", "[", ".")) | (
        alone & ((one_of("t2", "==", "!=") & ~one_of("p2", "+", "-", "*", "/", "%", ".")) | (
            one_of("p2", "==", "!=") & ~one_of("t2", "+", "-", "*", "/", "%", "(", "[", "."))))
    java_guard = is_java() & (kind == "n") & compared
    java_deref = is_java() & name & is_("t1", "(") & ~one_of("p1", "new", "@") & text.rlike(r"^[^.]+\.[^.]+$")
    indexed = is_("t1", "[") & ~F.col("next_starts")
    return {
        "py_name": py_name,
        "attr": attr,
        # names of an f-string, with the attribute if there is one
        "field_names": in_fields(r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)"),
        "field_indexed": in_fields(r"([A-Za-z_]\w*)\s*\["),
        "field_guarded": in_fields(r"([A-Za-z_]\w*)\s+(?:is|is\s+not|==|!=)\s+None\b"),
        "own_name": F.when(is_py() & (py_name | attr.isNotNull()), first)
        .when(java_guard, F.substring_index("tok", ".", -1)).when(java_deref, first),
        # true for guards that hold only where the name is a use
        "guard": java_guard | (py_name & ~dotted & ((against_none & leading) | alone_against_none | tested)),
        "deref": java_deref | attr.isNotNull(),
        "indexed": py_name & ~dotted & indexed,
    }


def _decision() -> Column:
    """Weight of a decision point; and / or are completed once the chain is known."""
    tok, is_catch = Symbols("sym"), is_("kind", "k") & F.col("tok").startswith("catch")
    return F.when(is_py(), (
        F.when(F.col("line_start") & tok.isin("if", "elif", "for", "while", "try", "except", "with"), 1)
        .when((tok == "else") & ~F.col("line_start"), 1)
        .when(tok.isin("and", "or"), 1)
        .otherwise(0)
    )).otherwise(
        F.when(tok.isin("if", "for", "while", "&&", "||") | (is_catch & (tok != "catch")), 1)
        .when((tok == "?") & ~one_of("p1", "<", ","), 1)
        .when(((tok == "case") | ((tok == "default") & is_("t1", ":"))) & ~is_("p1", ":"), 1)
        .otherwise(0)
    )


def _handler() -> Column:
    """Exception handlers; the line of an empty Java one is that of its try, filled in later."""
    tok, text = Symbols("sym"), F.col("tok")
    none = F.array().cast("array<string>")

    def told(body, types, line):
        return F.struct(body.alias("body"), types.alias("types"), line.alias("line"))

    swallowed = (
        (tok == "pass") & is_("p1", ":") & is_("above.tok", "except") & ~is_("above.t1", ":")
        & F.col("next_starts") & (F.col("next_indent") <= F.col("above.indent"))
    )
    caught = F.split(F.regexp_replace(
        text, r"^catch[^(]*\(\s*(?:final\s+|@[\w$.]+\s*(?:\([^()]*\)\s*)?)*|\s*[\w$\x{80}-\x{10FFFF}]+\s*\)$", ""), r"\s*\|\s*")
    return (
        F.when(is_py() & F.col("line_start") & (tok == "except") & is_("t1", ":"), told(F.lit("bare"), none, F.col("line")))
        .when(is_py() & swallowed, told(F.lit("pass"), none, F.col("above.line")))
        .when(is_java() & is_("kind", "k") & is_("t1", "{") & text.startswith("catch"), told(
            F.when(is_("t2", "}"), "empty").otherwise("filled"), caught, F.when(~is_("t2", "}"), F.col("t2_line"))))
    )


def _opening() -> Column:
    """What an opening bracket says about its group."""
    tok, callee = Symbols("sym"), F.col("p1_text")
    dotted = F.contains(callee, F.lit("."))
    named = (tok == "(") & is_("pk1", "n")
    py_call = is_py() & named & callee.rlike(r"^[^.]+\.[^.]+$") & ~is_("p2", ".") & ~F.col("line_start")
    java_call = (
        is_java() & named & dotted & ~one_of("p2", ".", "new", "@")
        & ~callee.rlike(r"(^|\.)(class|this|super|new)(\.|$)")
    )
    # a name after a type declares a method; after an annotation or a modifier, a constructor
    typed = (
        _type_like("p2", "pk2") & ~one_of("p2", "record") & ~one_of("p3", ".", "@")
        & ~(is_("pk2", "g") & one_of("p3", *_BEFORE_CONSTRUCTOR))
    )
    plain_def = is_py() & (tok == "(") & is_("p2", "def")
    # def name[T](...): in a header a bracket on the outermost level follows another one only there
    generic_def = (
        is_py() & (tok == "(") & is_("p1", "]") & (F.col("level") == 1) & is_("stmt.tok", "def") & ~is_("above.tok", "@")
    )
    def_pos = F.when(plain_def, F.col("pos") - 2).when(generic_def, F.col("stmt.pos"))
    below_at = F.when(plain_def, F.col("def_below_at")).otherwise(F.col("line_below_at"))
    return F.when(tok.isin(lexing.OPENERS), F.struct(
        tok.column.alias("tok"), F.col("pos").alias("pos"), callee.alias("callee"), F.col("p1_line").alias("line"),
        F.coalesce(py_call | java_call, F.lit(False)).alias("calls"),
        def_pos.alias("def_pos"), F.when(def_pos.isNotNull() & below_at, F.col("run_pos")).otherwise(def_pos).alias("def_start"),
        (is_java() & (tok == "{") & one_of("p1", *_BEFORE_CODE)).alias("code"),
        F.coalesce(is_java() & named & ~one_of("p2", "@", "record"), F.lit(False)).alias("named"),
        F.coalesce(is_java() & named & ~dotted & typed, F.lit(False)).alias("declares"),
        F.col("opens_type").alias("opens_type"),
    ))


@held
def _roles() -> dict[str, Column]:
    tok, kind = Symbols("sym"), Symbols("kind")
    return {
        **_imports(), **_name_facts(),
        "decision": _decision(), "handler": _handler(), "opening": _opening(),
        "stmt_line": F.col("stmt.line"),
        "margin_above": F.coalesce(F.col("above.indent"), F.lit(0)),
        "below_at": is_("above.tok", "@"),
        "is_def": is_py() & F.col("line_start") & (tok == "def"),
        "def_name": F.when(is_py() & (tok == "def"), F.col("t1_text")),
        "is_declaring": is_py() & (tok == "def") & ~is_("p1", "async"),
        "may_declare": is_java() & (kind == "n") & ~F.contains("tok", F.lit(".")) & is_("t1", "(")
        & _type_like("p1", "pk1") & ~one_of("p2", "."),
        # neighbours in brackets
        "after_open": is_("p1", "("), "after_comma": is_("p1", ","), "after_star": one_of("p1", *_STARS),
        "ends_header": (tok == ")") & one_of("t1", "{", "throws"),
        # how the statement of a line begins, and Java tokens that end or continue one
        "begins_with": F.when(is_py() & F.col("line_start"), F.when(tok == "async", F.col("t1")).otherwise(tok.column)),
        "ends_open": is_java() & (tok == "}") & ~one_of("p1", *_BEFORE_END),
        "ends_try": is_java() & (tok == "}") & ~(F.coalesce(F.col("t1_text").startswith("catch"), F.lit(False)) | is_("t1", "finally")),
        "runs_on": is_java() & (tok == ")") & one_of("k1", "n", "d", "s") & ~one_of("t1", *_AFTER_CALL),
        "is_default_none": is_py() & (tok == "None") & is_("p1", "=") & one_of("t1", ",", ")"),
        "may_be_param": is_java() & (kind == "n") & ~F.contains("tok", F.lit(".")) & one_of("t1", ",", ")")
        & ((_type_like("p1", "pk1") & ~is_("p1", "]")) | (is_("p1", ".") & is_("p2", "."))),
    }


def local_roles(rows: DataFrame) -> DataFrame:
    """Everything a token and its neighbours say; the neighbours are dropped."""
    kept = ["file_id", "java", "pos", "line", "tok", "sym", "kind", "level", "line_start", "indent", "fault"]
    kept += ["head"] if "head" in rows.columns else []
    return in_context(rows.filter(_relevant())).select(*kept, *[c.alias(n) for n, c in _roles().items()])


@held
def _group_columns() -> tuple[list[dict[str, Column]], list[Column]]:
    """What is added step by step, and what is kept in the end."""
    tok, text = Symbols("sym"), F.col("tok")
    opener, closer = F.col("opening").isNotNull(), tok.isin(lexing.CLOSERS)
    slot = F.col("after_open") | F.col("after_comma") | F.col("after_star")
    word = F.when(tok.isin("and", "or"), tok.column).otherwise(0)
    ends_chain = opener | F.col("line_start") | tok.isin(_CHAIN_ENDS)
    header = F.when(is_py(), (
        F.when(tok.isin("lambda", "for"), F.lit(True))
        .when(opener | F.col("line_start") | tok.isin(":", "in"), F.lit(False))
    ))
    enclosing = {
        # between lambda and its colon, or for and its in: commas there separate no arguments
        "in_header": F.coalesce(last_where(header.isNotNull(), header, level_before()), F.lit(False)),
        "in_lambda": F.coalesce(last_where(
            opener | F.col("line_start") | tok.isin("lambda", ":"), tok == "lambda", level_before()), F.lit(False)),
        "chain_part": last_where(ends_chain | tok.isin("and", "or"), word, level_before()),
        "chain_or": last_where(ends_chain | (tok == "or"), word, level_before()),
        "try_line": last_where(tok == "try", F.col("line"), level_before()),
        "arg_name": last_where(is_("kind", "n") & slot, text, level_so_far()),
        "star_pos": last_where(tok.isin(_STARS) & (F.col("after_open") | F.col("after_comma")), F.col("pos"), level_so_far()),
        "grp": last_where(opener, F.col("opening"), level_so_far()),
    }
    plain = ~F.col("in_header")
    sums = {
        "commas": F.sum(F.when((tok == ",") & plain, 1).otherwise(0)).over(level_so_far()),
        "named": F.sum(F.when(is_py() & plain & (
            (tok == "=") | ((tok == "**") & (F.col("after_open") | F.col("after_comma")))
        ), 1).otherwise(0)).over(level_so_far()),
        # each else of a Java block goes with an if of the same block
        "ifs": F.sum(F.when(is_java() & (tok == "if"), 1).when(is_java() & (tok == "else"), -1).otherwise(0)).over(level_so_far()),
        # the parameter list of a method, where the row before ends it
        "header": F.lag(F.when(F.col("ends_header") & F.col("grp.declares"), F.struct(
            F.col("grp.callee").alias("name"), F.col("grp.pos").alias("fkey"), F.col("grp.line").alias("line"))), 1).over(level_order()),
    }
    # a brace that follows the parameter list of a method on the same level opens its body
    method = F.when(is_java() & (tok == "{"), F.col("header"))
    counts = F.struct("commas", "named", "ifs", F.col("body.fkey").alias("fkey"))
    at_open = last_where(opener, counts, level_so_far())

    opened_by = F.lit(False)
    for closing, opening in zip(lexing.CLOSERS, lexing.OPENERS):
        opened_by = opened_by | ((tok == closing) & is_("grp.tok", opening))
    mismatch = closer & ~opened_by
    in_code = F.col("grp.code")
    java_fault = (
        F.when(F.col("ends_open") & in_code, F.lit("';' expected"))
        .when(F.col("ends_try") & in_code & F.col("grp.callee").eqNullSafe("try"), F.lit("'try' without 'catch', 'finally' or resource declarations"))
        .when(F.col("runs_on") & is_("grp.tok", "(") & F.col("grp.named"), F.lit("';' expected"))
        .when(is_java() & (tok == "else") & (F.col("ifs") < F.coalesce("at_open.ifs", F.lit(0))), F.lit("illegal start of type"))
    )
    in_signature = F.col("grp.def_start").isNotNull()
    in_declared = F.coalesce(F.col("grp.declares"), F.lit(False))
    use = F.col("py_name") & ~(in_signature & slot) & ~(F.col("in_lambda") & (F.col("after_comma") | F.col("after_star")))
    py_param = F.col("is_default_none") & in_signature & ~F.coalesce(F.col("star_pos") > F.col("grp.pos"), F.lit(False))
    java_param = F.col("may_be_param") & in_declared
    args = F.when(F.col("after_open"), 0).otherwise(
        F.col("commas") - F.col("at_open.commas") + F.when(F.col("after_comma"), 0).otherwise(1))
    callee = F.col("grp.callee")
    member = F.substring_index(callee, ".", -1)
    call = F.when((tok == ")") & F.coalesce(F.col("grp.calls"), F.lit(False)), F.struct(
        F.substring(callee, F.lit(1), F.length(callee) - F.length(member) - 1).alias("qualifier"),
        member.alias("member"), (args - F.col("named") + F.col("at_open.named")).cast("int").alias("n_args"),
        (F.col("grp.pos") - 1).alias("pos"), F.col("grp.line").alias("line"),
    ))
    closes_body = F.when(is_java() & closer, F.col("at_open.fkey"))
    declared = (
        F.when(F.col("is_declaring"), F.struct(F.col("def_name").alias("name"), F.col("pos").alias("pos"), F.col("line").alias("line")))
        .when(F.col("body").isNotNull(), F.struct(
            F.col("body.name").alias("name"), (F.col("body.fkey") - 1).alias("pos"), F.col("body.line").alias("line")))
        .when(F.col("may_declare") & is_("grp.tok", "{") & is_("grp.opens_type", True),
              F.struct(text.alias("name"), F.col("pos").alias("pos"), F.col("line").alias("line")))
    )
    handler = F.col("handler")
    plain_names = ("file_id", "java", "pos", "line", "line_start", "indent", "margin_above", "below_at")
    out = [
        *map(F.col, plain_names),
        language().alias("language"), (tok == "@").alias("is_at"),
        F.coalesce("fault", F.when(mismatch, F.lit("unbalanced bracket")), java_fault).alias("fault"), F.col("begins_with"),
        F.col("import"), F.col("module"), F.col("stmt_line"), F.col("attr"), call.alias("call"),
        F.when(handler["body"] == "empty", F.struct(
            handler["body"].alias("body"), handler["types"].alias("types"), F.col("try_line").alias("line")))
        .otherwise(handler).alias("handler"),
        # of a chain of and / or, the first operator also counts the chain
        F.when(is_py() & (((tok == "and") & ~is_("chain_part", "and")) | ((tok == "or") & ~is_("chain_or", "or"))), 2)
        .otherwise(F.col("decision")).alias("decision"),
        (use | F.col("field_names").isNotNull()).alias("is_use"),
        F.when(py_param, F.array("arg_name")).when(java_param, F.array(text))
        .when(F.col("import").isNotNull() & is_py(), F.array(F.col("import.name")))
        .when(F.col("field_names").isNotNull(), F.col("field_names"))
        .when(F.col("own_name").isNotNull() & (use | ~F.col("py_name") | F.col("attr").isNotNull()), F.array("own_name")).alias("names"),
        F.col("field_indexed"), F.col("field_guarded"),
        (py_param | java_param).alias("is_param"),
        (F.col("guard") & (is_java() | use)).alias("is_guard"),
        (F.col("deref") | (F.col("indexed") & use)).alias("is_deref"),
        F.when(F.col("is_def"), F.col("pos")).when(py_param, F.col("grp.def_pos")).when(java_param, F.col("grp.pos"))
        .when(F.col("body").isNotNull(), F.col("body.fkey")).when(closes_body.isNotNull(), closes_body).alias("fkey"),
        # where the names of a function begin: its decorators, or the parameter list in Java
        F.when(py_param, F.col("grp.def_start")).when(java_param, F.col("grp.pos")).alias("param_start"),
        declared.alias("declared"), F.col("is_def"), F.col("def_name"), F.col("body"), closes_body.isNotNull().alias("closes_body"),
    ]
    return [enclosing, sums, {"body": method}, {"at_open": at_open}], out


def grouped(rows: DataFrame) -> DataFrame:
    """Completes the roles with the enclosing group of each token."""
    has_head = "head" in rows.columns
    steps, out = _group_columns()
    rows = folded(rows, _GROUPS_NEED, "rest")
    for columns in steps:
        rows = rows.withColumns(columns)
    rows = unfolded(rows, "rest")
    return rows.select(*out, *(["head"] if has_head else []))
