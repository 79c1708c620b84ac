"""Token rows and the structure around them.

``tokens`` explodes files into token rows after clustering the *files* by ``file_id``;
text is several times smaller than its token rows, and everything later is partitioned
by ``file_id`` plus more, so no further exchange is needed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from riskweave.functions import lexing
from riskweave.session import held
from riskweave.sources import submissions


def file_order() -> WindowSpec:
    return W.partitionBy("file_id").orderBy("pos")


def so_far() -> WindowSpec:
    return file_order().rowsBetween(W.unboundedPreceding, 0)


def before() -> WindowSpec:
    return file_order().rowsBetween(W.unboundedPreceding, -1)


def level_order() -> WindowSpec:
    return W.partitionBy("file_id", "level").orderBy("pos")


def level_so_far() -> WindowSpec:
    return level_order().rowsBetween(W.unboundedPreceding, 0)


def level_before() -> WindowSpec:
    return level_order().rowsBetween(W.unboundedPreceding, -1)


def is_py() -> Column:
    return ~F.col("java")


def is_java() -> Column:
    return F.col("java")


def language() -> Column:
    return F.when(is_java(), F.lit("java")).otherwise(F.lit("python"))


class Symbols:
    """A column of symbols or kinds, compared with words as if it held them."""

    def __init__(self, column: str):
        self.column = F.col(column)

    def __eq__(self, word: str) -> Column:
        return self.column == lexing.code(word)

    def __ne__(self, word: str) -> Column:
        return self.column != lexing.code(word)

    __hash__ = None

    def isin(self, *words) -> Column:
        return self.column.isin([lexing.code(word) for word in (words[0] if isinstance(words[0], list) else words)])


def one_of(column: str, *words: str) -> Column:
    """Null-safe membership test on a column of symbols."""
    return F.coalesce(Symbols(column).isin(*words), F.lit(False))


def is_(column: str, value) -> Column:
    """Null-safe equality; a word stands for its symbol."""
    return F.col(column).eqNullSafe(lexing.code(value) if isinstance(value, str) else value)


def last_where(condition: Column, value: Column, window) -> Column:
    return F.last(F.when(condition, value), ignorenulls=True).over(window)


def folded(rows: DataFrame, kept: list[str], name: str) -> DataFrame:
    """All columns but ``kept`` as one struct: a window copies its rows column by column, and a struct is one of them."""
    rest = [c for c in rows.columns if c not in kept]
    return rows.select(*[c for c in rows.columns if c in kept], F.struct(*rest).alias(name)) if rest else rows


def unfolded(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != name], f"{name}.*") if name in rows.columns else rows


def tokens(
    files: DataFrame, head: Column | None = None, large: int = lexing.LARGE_TEXT
) -> DataFrame:
    """``(file_id, java, pos, tok, sym, kind, nl, nl_tok, brk, indent[, head])``.

    ``sym`` is the number of ``tok`` among the words that operators compare with. ``nl`` counts newlines before the token and ``nl_tok`` those inside it, ``brk`` says that
    a Python statement can begin here, ``indent`` is its column.  ``head`` is a per-file
    value that rides on the first token only.  Files that share an id are left out (they are rejected); on a table
    bucketed by ``file_id`` this needs no exchange.
    """
    carried = [] if head is None else [head.alias("head")]
    keep = ["file_id", "java"] + (["head"] if carried else [])
    texts = submissions.unique(files).select(
        "file_id", F.coalesce(F.col("language") == "java", F.lit(False)).alias("java"), lexing.normalized(F.col("code")).alias("code"), *carried
    )
    runs = texts.select(
        *keep, F.posexplode(lexing.text_chunks(F.col("code"), is_java(), large)).alias("run", "run_text")
    )
    matches = runs.select(
        *keep, "run",
        F.posexplode(lexing.token_matches(F.col("run_text"), is_java())).alias("i", "match"),
    )
    # columns that are never null are not tested for it again and again
    match = F.coalesce("match", F.lit(""))
    raw = matches.select(
        "file_id", "java",
        (F.col("run").cast("bigint") * lexing.CHUNK_TOKENS + F.col("i")).alias("pos"),
        match.alias("match"), lexing.unindented(match).alias("shorter"),
        *([F.when((F.col("run") == 0) & (F.col("i") == 0), F.col("head")).alias("head")] if carried else []),
    )
    match = F.col("match")
    raw = raw.withColumns({
        "raw": lexing.without_trivia(match, F.col("shorter"), is_java()), "multi": F.contains(match, F.lit("\n")),
    }).drop("shorter")
    lead = lexing.leading(match, F.col("raw"))
    multi = F.col("multi")
    nl_tok = F.when(multi, lexing.newline_count(F.col("raw"))).otherwise(0)
    raw = raw.withColumns({
        "sym": lexing.symbol(F.col("raw")),
        "lead": F.when(multi | (F.col("pos") == 0), lead).otherwise(""),
        "nl_tok": nl_tok,
        "nl": F.when(multi, lexing.newline_count(match) - nl_tok).otherwise(0),
    })
    # a backslash before a line end joins lines, unless it ends a comment
    broken = F.when(
        F.contains("lead", F.lit("\\\n")),
        F.contains(F.regexp_replace("lead", r"#[^\n]*|\\\n", ""), F.lit("\n")),
    ).otherwise(F.col("nl") > 0)
    margin = F.substring_index("lead", "\n", -1)
    width = F.length(F.when(
        F.contains(margin, F.lit("\t")), F.regexp_replace(margin, r" {8}| {0,7}\t", " " * 8)
    ).otherwise(margin))
    # only a name with a dot can hold trivia
    kind = lexing.kind_of(F.col("raw"), F.col("sym"), is_java())
    in_name = (
        F.contains("raw", F.lit(".")) & kind.isin(lexing.code("n"), lexing.code("k")) & F.col("raw").rlike(r"[\s#/\\]")
        & ~F.col("raw").startswith("catch")
    )
    joined = F.when(is_java(), F.regexp_replace("raw", "(?s)" + lexing.JAVA_TRIVIA, "")).otherwise(
        F.regexp_replace("raw", lexing.PY_TRIVIA, "")
    )
    return raw.select(
        "file_id", "java", "pos",
        F.when(in_name, joined).otherwise(F.col("raw")).alias("tok"),
        "sym", kind.alias("kind"), "nl", "nl_tok",
        (is_py() & ((F.col("pos") == 0) | broken)).alias("brk"),
        F.when(is_py() & ((F.col("pos") == 0) | broken), width).otherwise(0).alias("indent"),
        *(["head"] if carried else []),
    )


@held
def _placing() -> list[dict[str, Column]]:
    """The columns of ``placed``, step by step."""
    tok = Symbols("sym")
    delta = {"delta": F.when(tok.isin(lexing.OPENERS), 1).when(tok.isin(lexing.CLOSERS), -1).otherwise(0)}
    around = {
        "line": (1 + F.coalesce(F.sum(F.col("nl") + F.col("nl_tok")).over(so_far()), F.lit(0)) - F.col("nl_tok")).cast("int"),
        "depth": F.coalesce(F.sum("delta").over(so_far()), F.lit(0)).cast("int"),
        "p1": F.lag("sym", 1, lexing.NONE).over(file_order()), "p2": F.lag("sym", 2, lexing.NONE).over(file_order()),
        "p3": F.lag("sym", 3, lexing.NONE).over(file_order()),
        "t1": F.lead("sym", 1, lexing.NONE).over(file_order()), "t2": F.lead("sym", 2, lexing.NONE).over(file_order()),
        "t3": F.lead("sym", 3, lexing.NONE).over(file_order()), "t4": F.lead("sym", 4, lexing.NONE).over(file_order()),
        "p1_text": F.lag("tok", 1).over(file_order()),
        "t1_text": F.lead("tok", 1).over(file_order()), "t2_text": F.lead("tok", 2).over(file_order()),
        "n_types": F.sum(F.when(tok.isin(_TYPE_WORDS), 1).otherwise(0)).over(so_far()),
        "n_stray": F.sum(F.when(tok.isin("{", ";"), 1).when(tok.isin("import", "package"), -1).otherwise(0)).over(so_far()),
        "k1": F.lead("kind", 1, lexing.NONE).over(file_order()),
        "pk1": F.lag("kind", 1, lexing.NONE).over(file_order()), "pk2": F.lag("kind", 2, lexing.NONE).over(file_order()),
        "next_brk": F.lead("brk", 1).over(file_order()),
        "next_indent": F.lead("indent", 1).over(file_order()),
    }
    outside = (F.col("depth") - F.col("delta")) == 0
    starts = {
        "level": F.col("depth") + F.when(F.col("delta") < 0, 1).otherwise(0),
        "line_start": F.col("brk") & outside,
        "next_starts": F.coalesce(F.col("next_brk"), F.lit(False)) & (F.col("depth") == 0),
        "begins": is_py() & outside & (F.col("brk") | one_of("p1", ";", ":")),
    }
    line_head = F.struct(F.col("sym").alias("tok"), "indent", "t1", "pos", "line")
    type_words = ["class", "interface", "enum"]
    above = {
        "above": last_where(F.col("line_start"), line_head, before()),
        "stmt": last_where(F.col("begins"), F.struct(F.col("sym").alias("tok"), "line", "pos"), so_far()),
        "p1_line": F.lag("line", 1).over(file_order()),
        "t2_line": F.lead("line", 2).over(file_order()),
        "colon_pos": last_where((tok == ":") & (F.col("depth") == 0), F.col("pos"), before()),
        "opens_type": is_java() & (tok == "{") & F.coalesce(last_where(
            tok.isin(*type_words, "{", "}", ";"), tok.isin(type_words), before()), F.lit(False)),
    }
    return [delta, around, starts, above, {"fault": _fault()}]


@held
def _contexts() -> dict[str, Column]:
    tok, module = Symbols("sym"), F.when(is_("stmt.tok", "from") & is_("pk1", "n"), F.col("p1_text"))
    below_at = is_("above.tok", "@")
    return {
        "import_ctx": last_where(
            is_py() & (tok == "import"),
            F.struct(F.col("stmt.pos").alias("stmt_pos"), module.alias("module")), so_far()),
        # where the latest run of decorators starts, and whether the latest line and def are below one
        "run_pos": last_where(F.col("line_start") & (tok == "@") & ~below_at, F.col("pos"), so_far()),
        "line_below_at": F.coalesce(last_where(F.col("line_start"), below_at, so_far()), F.lit(False)),
        "def_below_at": F.coalesce(last_where(tok == "def", below_at & F.col("line_start"), so_far()), F.lit(False)),
    }


def placed(token_rows: DataFrame) -> DataFrame:
    """Adds line, bracket level, neighbours, statement starts and faults.

    Costly columns are made below a window and filtered on above it: a filter right above them
    would be pushed down together with a copy of them.

    ``level`` is the number of open brackets; an opening and a closing bracket carry the level
    of what they enclose, so a bracket group is a run of rows of one level.
    """
    delta, around, starts, above, fault = _placing()
    # what is left over would have the optimizer take the struct below apart again
    rows = token_rows.withColumns(delta).withColumns(around).withColumns(starts).drop(*_STARTED)
    return unfolded(folded(rows, _ABOVE_NEEDS, "rest").withColumns(above), "rest").withColumns(fault).drop(*_TOLD)


def in_context(rows: DataFrame) -> DataFrame:
    """Adds what the imports and decorators above say; needs those rows only, so that others may be gone."""
    return unfolded(folded(rows, _CONTEXTS_NEED, "rest").withColumns(_contexts()), "rest")


# Columns that the last window of ``placed`` and that of ``in_context`` read.
_ABOVE_NEEDS = ["file_id", "java", "pos", "line", "sym", "indent", "t1", "depth", "line_start", "begins"]
_CONTEXTS_NEED = ["file_id", "java", "pos", "sym", "p1_text", "pk1", "line_start", "above", "stmt"]
# Columns that are not needed once starts are known, and once faults are told.
_STARTED = ["nl", "nl_tok", "brk", "delta", "next_brk"]
_TOLD = ["n_types", "n_stray", "colon_pos", "depth", "begins"]
# Words that open a block in Python, and words that are names in most places.
_BLOCK_WORDS = ["if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class"]
_SOFT_WORDS = ["match", "case", "type", "_"]
# Python words that only begin a statement, and operators of both languages.
_STATEMENT_WORDS = [
    "return", "raise", "pass", "break", "continue", "del", "global", "nonlocal", "assert", "while", "try", "elif", "except",
    "finally", "class",
]
_PY_BINARY = [
    "=", "==", "!=", "<", ">", "<=", ">=", "/", "//", "%", "|", "^", "&", "+=", "-=", "*=", "/=", "//=", "%=", "|=", "^=",
    "&=", "@=", ":=", "<<", ">>", "<<=", ">>=", "**=",
]
_PY_OPEN_ENDED = [*_PY_BINARY, "+", "-", "*", "**", "~", "@", "->", "and", "or", "not", "in", "is", "import"]
_PY_WORD_BINARY = ["and", "or", "is", "in"]
_PY_BEFORE_OPERAND = [
    *lexing.OPENERS, "if", "elif", "while", "return", "for", "with", "assert", "raise", "del", "class", "def", "yield", "await", "lambda",
]
_PY_CONDITIONS = ["if", "elif", "while", "return", "assert", "raise", "del"]
_JAVA_OPEN_ENDED = ["=", "==", "!=", "+", "-", "*", "/", "%", "&&", "||", "&", "|", "^", ","]
_JAVA_PRIMITIVES = ["int", "long", "double", "float", "boolean", "char", "byte", "short"]
_JAVA_SOFT_WORDS = [
    "record", "sealed", "permits", "yield", "var", "when", "module", "open", "exports", "opens", "requires", "to", "uses", "provides",
    "non",
]
_TYPE_WORDS = ["class", "interface", "enum", "record", "module"]


def _fault() -> Column:
    """``fault``: why a file cannot be parsed, on the row that shows it (C3, first part)."""
    tok, kind, text, above = Symbols("sym"), Symbols("kind"), F.col("tok"), F.col("above")
    at_end = (tok == lexing.END) & (F.col("t1") == lexing.NONE)
    operand = ["n", "d", "s"]
    after_operand = Symbols("pk1").isin(operand) | one_of("p1", *lexing.CLOSERS)
    side_by_side = (
        kind.isin(operand) & F.coalesce(after_operand, F.lit(False)) & ~F.col("begins")
        & ~((kind == "s") & is_("pk1", "s")) & ~one_of("p1", *_SOFT_WORDS)
    )
    # an operator without its right side, an empty item, two operators in a row, a statement inside another one
    stray = (
        (tok.isin(_PY_OPEN_ENDED) & F.col("next_starts") & ~((tok == "*") & is_("p1", "import")))
        | ((tok == ",") & one_of("p1", *lexing.OPENERS, ","))
        | (tok.isin(_PY_BINARY) & one_of("p1", *_PY_OPEN_ENDED))
        | (tok.isin(_STATEMENT_WORDS) & (kind == "k") & ~F.col("begins"))
        | ((tok == "import") & ~F.col("begins") & ~is_("stmt.tok", "from"))
        | ((tok == "in") & is_("p1", "for"))
        # an operator before the end of its brackets or item (not those that a parameter list may hold alone), or with nothing before it
        | (tok.isin([x for x in _PY_OPEN_ENDED if x not in ("*", "**", "/", "import")]) & one_of("t1", *lexing.CLOSERS, ":", ","))
        | (tok.isin(_PY_BINARY) & (one_of("p1", *_PY_BEFORE_OPERAND) | (is_("p1", ",") & (tok != "/") & ((F.col("depth") > 0) | (tok != "=")))))
        | (tok.isin(_PY_WORD_BINARY) & (one_of("p1", *_PY_BEFORE_OPERAND, ",", *_PY_BINARY, "and", "or", "is")
                                        | (is_("p1", "not") & (tok != "in"))))
        | ((tok == "not") & F.coalesce(after_operand, F.lit(False)) & ~is_("t1", "in") & ~F.col("begins"))
        | ((tok == "not") & is_("t1", "in") & ~F.coalesce(after_operand, F.lit(False)))
        | ((kind == "k") & F.contains(text, F.lit(".")) & ~text.rlike(r"^(None|True|False)\."))
        # a dot between something and a name; three of them are a value, and relative imports have some
        | ((tok == ".") & ~is_("t1", ".") & ~is_("p1", ".") & ~is_("stmt.tok", "from") & (
            ~one_of("k1", "n", "k", "d") | ~(F.coalesce(after_operand, F.lit(False)) | is_("k1", "d"))))
        | (tok.isin("class", "def") & (kind == "k") & ~is_("k1", "n"))
        | ((tok == "=") & one_of("stmt.tok", *_PY_CONDITIONS) & (F.col("depth") == 0))
    )
    no_colon = Symbols("above.tok").isin(_BLOCK_WORDS) & ~F.coalesce(F.col("colon_pos") > above["pos"], F.lit(False))
    over = F.col("indent") > F.coalesce(above["indent"], F.lit(0))
    opens = is_("p1", ":")
    shared = (
        F.when(tok.isin('"', "'"), F.lit("unterminated string"))
        .when((F.col("depth") < 0) | (at_end & (F.col("depth") != 0)), F.lit("unbalanced bracket"))
        .when((tok == lexing.END) & ~at_end, F.lit("invalid character"))
    )
    py = (
        F.when(tok.isin("?", "$", "!", "`"), F.lit("invalid character"))
        .when(F.col("line_start") & over & ~opens, F.lit("unexpected indent"))
        .when(F.col("line_start") & ~over & opens, F.lit("expected an indented block"))
        .when(F.col("line_start") & F.coalesce(no_colon, F.lit(False)), F.lit("expected ':'"))
        .when(side_by_side | stray, F.lit("invalid syntax"))
    )
    literals = ["d", "s"]
    java = (
        F.when(at_end & (F.col("p1") != lexing.NONE) & ~one_of("p1", ";", "}"), F.lit("reached end of file"))
        .when(at_end & (F.col("n_types") == 0) & (F.col("n_stray") > 0), F.lit("class, interface, enum, or record expected"))
        .when((tok == "else") & ~one_of("p1", ";", "}"), F.lit("illegal start of type"))
        .when((tok == "finally") & ~one_of("p1", "}"), F.lit("'finally' without 'try'"))
        .when((kind == "k") & text.startswith("catch") & ~one_of("p1", "}"), F.lit("'catch' without 'try'"))
        .when(
            (tok.isin(_JAVA_OPEN_ENDED) & one_of("t1", ";", ")", "]") & ~((tok == "*") & is_("p1", "."))
             & ~(tok.isin("+", "-") & F.coalesce(F.col("p1") == tok.column, F.lit(False))))
            | (one_of("pk1", *literals) & (kind.isin("n", *literals) | tok.isin(_JAVA_PRIMITIVES)))
            | ((kind == "n") & is_("pk1", "n") & is_("pk2", "n") & ~is_("p3", "@")
               & ~tok.isin(_JAVA_SOFT_WORDS) & ~one_of("p1", *_JAVA_SOFT_WORDS) & ~one_of("p2", *_JAVA_SOFT_WORDS)),
            F.lit("illegal start of expression"))
    )
    return F.coalesce(shared, F.when(is_java(), java).otherwise(py))


def structured(files: DataFrame, head: Column | None = None) -> DataFrame:
    return placed(tokens(files, head))
