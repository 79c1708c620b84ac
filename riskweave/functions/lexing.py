"""Lexical patterns for Python and Java and the column expressions that use them.

One match of a language pattern is *leading trivia* (blanks, comments, newlines)
followed by one token, so blanks and comments never become rows.  Dotted names
(``a.b.c``) are one token.  Every repeated group is possessive: a plain group loop
recurses in ``java.util.regex`` and overflows the stack on long strings.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks the end of a file, so that every file has a last token.
END = "\x00"
# Texts above this many characters are cut into runs of CHUNK_TOKENS tokens first,
# which keeps the token array of one row small however large the file is.
LARGE_TEXT = 1 << 20
CHUNK_TOKENS = 4096

BLANKS = " \t\n\r\f\x0b"
PY_TRIVIA = r"(?:[ \t\f\x0B\r]++|#[^\n]*+|\\\n|\n)*+"
JAVA_TRIVIA = r"(?:[ \t\f\x0B\r\n]++|//[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)*+"

_PREFIX = r"(?:[rRbBuUfFtT]{1,2})?"
_F_PREFIX = r"(?:[fF][rR]?|[rR][fF])"
# A replacement field may hold the quote of its own f-string.
_FIELD = r"\{\{|\{[^{}\n]*+(?:\{[^{}\n]*+\}[^{}\n]*+)*+\}"
_PY_STRINGS = [
    _PREFIX + r'"""[^"\\]*+(?:(?:\\.|"[^"\\]|"\\.|""[^"\\]|""\\.)[^"\\]*+)*+"""',
    _PREFIX + r"'''[^'\\]*+(?:(?:\\.|'[^'\\]|'\\.|''[^'\\]|''\\.)[^'\\]*+)*+'''",
    _F_PREFIX + rf'"[^"\\\n{{]*+(?:(?:\\.|{_FIELD})[^"\\\n{{]*+)*+"',
    _F_PREFIX + rf"'[^'\\\n{{]*+(?:(?:\\.|{_FIELD})[^'\\\n{{]*+)*+'",
    _PREFIX + r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"',
    _PREFIX + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'",
]
_JAVA_STRINGS = [
    r'"""[^"\\]*+(?:(?:\\.|"[^"\\]|"\\.|""[^"\\]|""\\.)[^"\\]*+)*+"""',
    r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"',
    r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'",
]
_NUMBER = r"[0-9][0-9A-Za-z_.]*+"
_PY_NAME = r"[A-Za-z_\x{80}-\x{10FFFF}][\w\x{80}-\x{10FFFF}]*+"
_JAVA_NAME = r"[A-Za-z_$\x{80}-\x{10FFFF}][\w$\x{80}-\x{10FFFF}]*+"


def _dotted(name: str, trivia: str) -> str:
    return f"{name}(?:{trivia}\\.{trivia}{name})*+"


# Type arguments such as <String, List<? extends T>> are one token, so that their
# commas and question marks are not taken for arguments and conditionals.  Each begins like a type
# (a capital after package names, an array of a primitive, a wildcard), so comparisons are none.
TYPE_DEPTH = 12


def _type_args(depth: int, once: bool = False) -> str:
    """``once`` writes an item once, behind the opening sign or a comma. The length of the pattern then grows with the depth; written twice, as
    engines without a look behind need it, it doubles with each level and makes 2 MB at ``TYPE_DEPTH``.
    """
    soup = r"[\w$.\[\]\s&?]" if depth == 0 else rf"(?:[\w$.\[\]\s&?]|{_type_args(depth - 1, once)})"
    item = rf"\s*+(?:\?|(?:[a-z_$][\w$]*+\.)*+[A-Z]|(?:byte|short|int|long|float|double|boolean|char)\s*+\[){soup}*+"
    if once:
        return rf"<(?:\s*+|(?:(?:(?<=<)|(?<!<),){item})++)>"
    return f"<(?:\\s*+|{item}(?:,{item})*+)>"


PY_TOKEN = PY_TRIVIA + "(?:" + "|".join([
    *_PY_STRINGS,
    _NUMBER,
    r"from\b",
    _dotted(_PY_NAME, PY_TRIVIA),
    r"\*\*=?|//=?|<<=?|>>=?|->|[=!<>:+*/%&|^@-]=",
    r"[^\s]",
]) + ")"


def java_token(type_depth: int, once: bool = False) -> str:
    return JAVA_TRIVIA + "(?:" + "|".join([
        *_JAVA_STRINGS,
        _NUMBER,
        rf"catch{JAVA_TRIVIA}\((?:[^()]++|\([^()]*+\))*+\)",
        _dotted(_JAVA_NAME, JAVA_TRIVIA),
        _type_args(type_depth, once),
        r"&&|\|\||->|::|[=!<>]=",
        r"[^\s]",
    ]) + ")"


JAVA_TOKEN = java_token(TYPE_DEPTH, once=True)

# Reserved words of both languages.
PY_KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
    "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return",
    "try", "while", "with", "yield",
]
JAVA_KEYWORDS = [
    "abstract", "assert", "break", "case", "catch", "class", "const", "continue", "default",
    "do", "else", "enum", "extends", "final", "finally", "for", "goto", "if", "implements",
    "import", "instanceof", "interface", "native", "new", "package", "private", "protected",
    "public", "return", "static", "strictfp", "super", "switch", "synchronized", "this",
    "throw", "throws", "transient", "try", "volatile", "while", "true", "false", "null",
]
OPENERS = ["(", "[", "{"]
CLOSERS = [")", "]", "}"]
# Kinds of tokens, and all other tokens that an operator compares with.
KINDS = ["n", "k", "s", "d", "g", "o"]
_MORE_WORDS = [
    *OPENERS, *CLOSERS, END, '"', "'", "?", "$", "!", "`", ",", ";", ":", ".", "@", "=", "==", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/",
    "//", "%", "|", "&", "^", "~", "&&", "||", "<<", ">>", "**", "->", ":=", "+=", "-=", "*=", "/=", "//=", "%=", "|=", "&=", "^=", "@=", "<<=",
    ">>=", "**=", "match", "type", "_", "record", "module", "sealed", "permits", "yield", "var", "when", "open", "exports", "opens",
    "requires", "to", "uses", "provides", "non", "void", "int", "long", "double", "float", "boolean", "char", "byte", "short",
]
WORDS = list(dict.fromkeys([*PY_KEYWORDS, *JAVA_KEYWORDS, *_MORE_WORDS]))


def _murmur(text: str) -> int:
    """What Spark's ``hash`` gives for a text."""
    def mixed(h, k):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
        return (h << 13 | h >> 19) * 5 + 0xE6546B64 & 0xFFFFFFFF

    data, h = text.encode(), 42
    whole = len(data) - len(data) % 4
    for at in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[at:at + 4], "little"))
    for byte in data[whole:]:
        h = mixed(h, (byte - 256 if byte > 127 else byte) & 0xFFFFFFFF)
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


# Stands for the neighbour of the first or last token.
NONE = -1
_CODES = {word: _murmur(word) for word in [*WORDS, *KINDS]}
if len({0, NONE, *_CODES.values()}) <= len(_CODES) + 1:
    raise ValueError("two words share a code")


def code(word: str) -> int:
    """The number of a word or kind; only listed ones have one."""
    return _CODES[word]


def symbol(token: Column) -> Column:
    """The token as a number: that of its word, 0 for all tokens that no operator compares with. Numbers are compared, copied and
    sorted many times faster than texts, and ``WORDS`` is looked up once a token."""
    return F.when(token.isin(WORDS), F.hash(token)).otherwise(F.lit(0))


def normalized(code: Column) -> Column:
    """Code with ``\\n`` line ends and the end mark."""
    unix = F.when(F.contains(code, F.lit("\r")), F.regexp_replace(code, "\r\n?", "\n")).otherwise(code)
    return F.concat(unix, F.lit("\n" + END))


def _extract(text: Column, is_java: Column, py: str, java: str) -> Column:
    return F.when(
        is_java, F.regexp_extract_all(text, F.lit("(?s)" + java), F.lit(0))
    ).otherwise(F.regexp_extract_all(text, F.lit("(?s)" + py), F.lit(0)))


def text_chunks(text: Column, is_java: Column, large: int = LARGE_TEXT) -> Column:
    """The text as a whole, or cut at token borders into runs of CHUNK_TOKENS tokens."""
    run = "(?:%s){1," + str(CHUNK_TOKENS) + "}+"
    # a text of few bytes has few characters, which need not be counted then
    return F.when((F.octet_length(text) <= large) | (F.length(text) <= large), F.array(text)).otherwise(
        _extract(text, is_java, run % PY_TOKEN, run % JAVA_TOKEN)
    )


def token_matches(text: Column, is_java: Column) -> Column:
    return _extract(text, is_java, PY_TOKEN, JAVA_TOKEN)


def _bytes(text: Column, first: int, count: Column) -> Column:
    """A part of a text that begins and ends between characters; ``substring`` counts characters, bytes are copied at once."""
    return F.substring(text.cast("binary"), F.lit(first), count).cast("string")


def unindented(match: Column) -> Column:
    """The match without one line end and the blanks after it, which are all the trivia that most tokens have."""
    return F.ltrim(F.when(match.startswith("\n"), _bytes(match, 2, F.octet_length(match) - 1)).otherwise(match))


def leading(match: Column, token: Column) -> Column:
    """What stands in a match before its token."""
    return _bytes(match, 1, F.octet_length(match) - F.octet_length(token))


def without_trivia(match: Column, shorter: Column, is_java: Column) -> Column:
    """The token of a match, its leading trivia removed; ``shorter`` is the match ``unindented``."""
    bare = F.ltrim(match, F.lit(BLANKS))
    return (
        # nothing that is blank, or begins a comment or a joined line, is left before the token
        F.when((shorter > F.lit(" ")) & ~(shorter.startswith("#") | shorter.startswith("/") | shorter.startswith("\\")), shorter)
        .when(
            is_java & (bare.startswith("//") | bare.startswith("/*")),
            F.regexp_replace(match, "^(?s)" + JAVA_TRIVIA, ""),
        )
        .when(
            ~is_java & (bare.startswith("#") | bare.startswith("\\")),
            F.regexp_replace(match, "^" + PY_TRIVIA, ""),
        )
        .otherwise(bare)
    )


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def _begins_within(token: Column, first: str, after: str) -> Column:
    """The token begins with a character from ``first`` to before ``after``; texts are compared byte by byte."""
    return (token >= F.lit(first)) & (token < F.lit(after))


def kind_of(token: Column, number: Column, is_java: Column) -> Column:
    """The code of n name, k reserved word, s string, d number, g type arguments, o everything else; ``number`` is that of
    ``symbol``, which settles the kind of a listed word."""
    kind = {name: F.lit(code(name)) for name in KINDS}
    signs = [code(word) for word in WORDS if not word[0].isalpha() and word not in ("_", "$")]
    py, java = ([code(word) for word in words] for words in (PY_KEYWORDS, JAVA_KEYWORDS))
    reserved = F.when(is_java, number.isin(java)).otherwise(number.isin(py))
    # "$" is a name in Java
    listed = F.when(number.isin(signs) | ((number == code("$")) & ~is_java), kind["o"]).when(reserved, kind["k"]).otherwise(kind["n"])
    letter = (
        _begins_within(token, "a", "{") | _begins_within(token, "A", "[") | token.startswith("_") | (token >= F.lit("\x80"))
        | (token.startswith("$") & is_java)
    )
    quoted = (token.endswith('"') | token.endswith("'")) & (F.length(token) > 1)
    root = F.substring_index(token, ".", 1)
    dotted = F.contains(token, F.lit(".")) & F.when(is_java, root.isin(JAVA_KEYWORDS)).otherwise(root.isin(PY_KEYWORDS))
    return (
        F.when(number != 0, listed)
        .when(quoted, kind["s"])
        .when(letter, F.when(dotted | token.startswith("catch ("), kind["k"]).otherwise(kind["n"]))
        .when(_begins_within(token, "0", ":"), kind["d"])
        .when(token.startswith("<") & token.endswith(">"), kind["g"])
        .otherwise(kind["o"])
    )
