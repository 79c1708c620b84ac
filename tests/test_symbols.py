"""Tokens as numbers, and rows that are dropped early."""

import pytest
from pyspark.sql import functions as F

from riskweave.functions import lexing, text
from riskweave.operators import groups, tokens
from riskweave.plans import analysis


def test_numbers_are_those_of_spark(spark):
    words = spark.createDataFrame([(word,) for word in lexing.WORDS + ["", "ü", "abcdefgh", "no word"]], "word string")
    rows = words.select("word", F.hash("word").alias("hash"), lexing.symbol(F.col("word")).alias("symbol")).collect()
    for row in rows:
        assert lexing._murmur(row.word) == row.hash
        assert row.symbol == (lexing.code(row.word) if row.word in lexing.WORDS else 0)
    with pytest.raises(KeyError):
        lexing.code("no word")


def test_windows_copy_few_texts(sources):
    """Most neighbours are numbers; as texts there were up to 13 of them in a window."""
    widths, nodes = [], [analysis.reports(sources([("python", "import os\n")]))._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Window":
            kinds = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
            widths.append(kinds.count("string"))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert len(widths) > 8 and max(widths) <= 5


def test_words_without_a_role_are_dropped(sources):
    code = "class A {\n  public static String shout(String river) {\n    String upper = river.toUpperCase();\n    return upper + upper;\n  }\n}\n"
    rows = groups.local_roles(tokens.structured(sources([("java", code)]))).orderBy("pos").collect()
    kept = [row.tok for row in rows]
    assert kept == ["class", "{", "shout", "(", "river", ")", "{", "river.toUpperCase", "(", ")", "}", "}", lexing.END]
    code = "def shout(river, upper=None):\n    return not river.upper() + 'a'\n"
    rows = groups.local_roles(tokens.structured(sources([("python", code)]))).orderBy("pos").collect()
    assert [row.tok for row in rows] == [
        "def", "shout", "(", "river", ",", "upper", "=", "None", ")", ":", "return", "river.upper", "(", ")", lexing.END]


def test_kinds_and_margins(spark, sources):
    pairs = [
        ("java", "int $ = $a + _; catchment(b); x = a<Q>b; catch (E e) { } this.x;"),
        ("python", "$ x\n\n\t  y = ü + '\"' ; None.z; _ /2 # ' é\n  f'{a}' if \"\" else 3.5"),
    ]
    rows = tokens.tokens(sources(pairs)).orderBy("file_id", "pos").collect()
    name = {lexing.code(kind): kind for kind in lexing.KINDS}
    told = [" ".join(f"{row.tok}:{name[row.kind]}" for row in rows if row.file_id == i and row.tok != lexing.END) for i in range(2)]
    assert told == [
        "int:n $:n =:o $a:n +:o _:n ;:o catchment:n (:o b:n ):o ;:o x:n =:o a:n <Q>:g b:n ;:o catch (E e):k {:o }:o this.x:k ;:o",
        "$:o x:n y:n =:o ü:n +:o '\"':s ;:o None.z:k ;:o _:n /:o 2:d f'{a}':s if:k \"\":s else:k 3.5:d",
    ]
    assert [(row.tok, row.indent, row.nl) for row in rows if row.brk] == [("$", 0, 0), ("y", 10, 2), ("f'{a}'", 2, 1), (lexing.END, 0, 1)]


def test_line_counts_by_the_last_bytes(spark):
    codes = ["", "a", "a\n", "a\r\n", "a ", "a\x85b", "\n", "ü\x1c", "a\n\nü"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string").select(text.count_lines(F.col("code")).alias("n")).collect()
    assert [row.n for row in rows] == [len(c.splitlines()) for c in codes]


def test_rows_go_before_the_windows_that_need_few(sources):
    """Of the windows in token order only those that look at neighbours and statements see all tokens; uses of names go before the join."""
    node, seen = analysis.reports(sources([("python", "import os\n")]))._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        seen.append(node.nodeName())
        node = node.children().apply(0)
    windows = [i for i, name in enumerate(seen) if name == "Window"]
    # from the top: four for spans, names, three by level, contexts; two over all tokens and that of the files are left
    between = seen[windows[8]:windows[9]]
    assert len(windows) == 12 and "Filter" in between and seen[seen.index("Join") + 1:].index("Filter") < seen[seen.index("Join") + 1:].index("Window")


def test_decorated_functions_after_dropped_tokens(told):
    code = "@dec(3, 'a' 'b')\n@more\ndef f(a=None):\n    return a.b\n\ndef g(a=None):\n    return 3 + a.b\n"
    assert told([("python", code)]) == [["MISSING_NONE_CHECK@4", "MISSING_NONE_CHECK@7"]]
