"""Patterns that run over every text: their size, and texts for which a shorter way was taken."""

import random
import re

from pyspark.sql import functions as F

from riskweave.functions import lexing, text


def test_the_java_pattern_is_small_and_means_the_same():
    """Written twice per level it had 2 million characters, which every task compiled and every file compared."""
    assert len(lexing.JAVA_TOKEN) < 10_000
    draw = random.Random(7)
    pieces = ["<", "<", ">", ">", ",", " ", "A", "Map", "a.b.C", "int[", "]", "?", "&", "x", ".", "List<", "String>", "(", "="]
    short, long = (re.compile(lexing._type_args(3, once)) for once in (True, False))
    matched = 0
    for _ in range(30_000):
        some = "<" + "".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) + draw.choice(["", ">", ">>"])
        one, other = short.match(some), long.match(some)
        assert (one and one.group()) == (other and other.group()), some
        matched += one is not None
    assert matched > 1_000
    deep = "<A" * (lexing.TYPE_DEPTH + 1) + ">" * (lexing.TYPE_DEPTH + 1)
    assert re.match(lexing._type_args(lexing.TYPE_DEPTH, True), deep).group() == deep


def _kept(code, names):
    """The plain meaning of ``java_unreferenced``."""
    lines = [x for x in re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", code) if not x.lstrip(" \t").startswith("import ")]
    return [name for name in names if name not in "\n".join(lines)]


def test_unreferenced_names_by_search_and_by_hash(spark):
    many = [f"Name{i}" for i in range(text.FEW_NAMES + 5)]
    rows = []
    for names in (["Deque", "Ma", "a\x85b", "Gone"], [], many + ["a\x85b"]):
        for end in ("\n", "\r\n", "\r", "\x85", "\u2028", "\x0b"):
            code = end.join(["import java.util.Deque;", " \timport Gone;", "x import Deque2 Name3;", "Map m; a", "b Name1x", "important Name2"])
            rows.append((code, names))
    frame = spark.createDataFrame(rows, "code string, names array<string>")
    told = frame.select("code", "names", text.java_unreferenced(F.col("code"), F.col("names")).alias("told"), text.count_lines(F.col("code")).alias("n"))
    for row in told.collect():
        assert row.told == _kept(row.code, row.names)
        assert row.n == len(row.code.splitlines())


def test_secrets_are_found_by_one_pattern(spark):
    rows = ["api-key = 'abcdefg'", "x = 1", "AKIA" + "B2" * 8, "-----begin rsa private key-----", "to\u212aen = 'abcdef'", "\u017fecret='abcdef'",
            "PWD\x1c=\x1c\"123456\"", "pwd = '12345'", "akia", "passwd  =\u2003'abcdef'"]
    told = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").where(text.python_secret(F.col("t"))).select("i").collect()
    assert sorted(r.i for r in told) == [0, 2, 3, 4, 5, 6, 9]
