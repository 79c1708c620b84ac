"""Golden rows: one snippet per case, all analysed in one run."""

JAVA = "public class Case {{\n{}\n}}\n".format

CASES = {
    # whole reports
    "station python": ("python", 'from json import load\nimport textutils\n\nclass Station:\n    secret = "harbour wall 7"\n\n    def read(self, probe=None):\n        while self.open:\n            try:\n                return probe.level\n            except (OSError, ValueError):\n                pass\n        try:\n            self.open = probe.close()\n        except:\n            raise\n',
                       ["UNUSED_IMPORT@1", "UNUSED_IMPORT@2", "BARE_EXCEPT@15", "SWALLOWED_EXCEPTION@11", "HARDCODED_SECRET@5",
                        "MISSING_NONE_CHECK@10", "HALLUCINATED_IMPORT@2"]),
    "tally python": ("python", "import os, re\n\ndef tally(rows):\n    return {re.matchAll(r): os.remove(r, 1) for r in rows}\n",
                     ["HALLUCINATED_ATTRIBUTE@4", "ARGUMENT_MISMATCH@4"]),
    "harbour java": ("java", 'import java.util.Deque;\nimport nowhere.Gauge;\n\npublic class Harbour {\n    static final String PWD = "tide-gate-77";\n\n    boolean shut(Gate gate, int n) {\n        for (int i = 0; i < n; i++) {\n            try { gate.close(); } catch (Throwable t) { log(t); }\n        }\n        return Math.abs(n, 1) > 0;\n    }\n}\n',
                     ["UNUSED_IMPORT@1", "UNUSED_IMPORT@2", "BROAD_CATCH@9", "HARDCODED_SECRET@5", "MISSING_NULL_CHECK@9",
                      "HALLUCINATED_IMPORT@2", "ARGUMENT_MISMATCH@11"]),
    "clean python": ("python", "def add(a, b):\n    return a + b\n", []),
    "clean java": ("java", JAVA("    int add(int a, int b) {\n        return a + b;\n    }"), []),
    # python, one rule each
    "guarded": ("python", "def f(u=None):\n    if u is None:\n        return\n    return u.x\n", []),
    "guard by not": ("python", "def f(u=None):\n    if not u:\n        return\n    return u.x\n", []),
    "guard by equality": ("python", "def f(u=None):\n    if u == None: return\n    return u[0]\n", []),
    "while is no guard": ("python", "def f(u=None):\n    while u:\n        u.x()\n", ["MISSING_NONE_CHECK@3"]),
    "and is no guard": ("python", "def f(u=None):\n    if u and u.x:\n        pass\n", ["MISSING_NONE_CHECK@2"]),
    "keyword-only": ("python", "def f(*, u=None):\n    return u.x\n", []),
    "async def unchecked": ("python", "async def f(u=None):\n    return u.x\n", []),
    "nested function": ("python", "def f(u=None):\n    def g():\n        return u.x\n    return g\n", ["MISSING_NONE_CHECK@3"]),
    "use after the function": ("python", "def f(u=None):\n    return 1\nu = 2\nu.x\n", []),
    "decorator counts": ("python", "@u.wrap\ndef f(u=None):\n    return 1\n", ["MISSING_NONE_CHECK@1"]),
    "typed pass": ("python", "try:\n    a = 1\nexcept KeyError:\n    pass\n", ["SWALLOWED_EXCEPTION@3"]),
    "one-line pass": ("python", "try:\n    a = 1\nexcept KeyError: pass\nb = 2\n", ["SWALLOWED_EXCEPTION@3"]),
    "pass and more": ("python", "try:\n    a = 1\nexcept KeyError:\n    pass\n    b = 1\n", []),
    "two passes": ("python", "try:\n    a = 1\nexcept KeyError:\n    pass; pass\n", []),
    "import as": ("python", "import a.b as c\nimport d.e\nprint(d.e.x)\n", ["UNUSED_IMPORT@1"]),
    "relative": ("python", "from . import sib\n", ["UNUSED_IMPORT@1"]),
    "wildcard": ("python", "from os import *\n", []),
    "parentheses": ("python", "from os import (path,\n    sep as s)\nprint(path)\n", ["UNUSED_IMPORT@1"]),
    "f-string use": ("python", "import os\nprint(f'{os.sep} {{x}}')\n", []),
    "f-string dereference": ("python", "def f(u=None, v=None, w=None):\n    if v is None:\n        return 1\n    return f'{u.x} {v.x} {w[0]}'\n", ["MISSING_NONE_CHECK@4", "MISSING_NONE_CHECK@4"]),
    "f-string attributes": ("python", "import os, json\nf\"{os.path_exists(a)} {json.parse(b)} {d['re.matchAll']}\"\n", ["HALLUCINATED_ATTRIBUTE@2", "HALLUCINATED_ATTRIBUTE@2"]),
    "f-string alone in a block": ("python", "def f(a):\n    f'{a.b} {a.c} {a}'\n", []),
    "keyword argument name": ("python", "import size\nf(size=1)\n", ["UNUSED_IMPORT@1"]),
    "parameter name": ("python", "import size\ndef f(size, *size2): return 1\n", ["UNUSED_IMPORT@1"]),
    "lambda parameter": ("python", "import b\nk = lambda a, b: 1\n", ["UNUSED_IMPORT@1"]),
    "secret with a blank of another kind": ("python", "# token\u00a0=\u2003'long enough value'\n", ["HARDCODED_SECRET@1"]),
    "secret in comment": ("python", "# token = 'long enough value'\n", ["HARDCODED_SECRET@1"]),
    "two secrets in a line": ("python", "pwd = 'abcdefgh'; secret = 'abcdefgh'\n", ["HARDCODED_SECRET@1"]),
    "short secret": ("python", "pwd = 'abc'\n", []),
    "lines by all line ends": ("python", "a = 1\r\n# \u2028token = 'long enough value'\n", ["HARDCODED_SECRET@3"]),
    "fake from": ("python", "from mathutils.core import a, b\nprint(a, b)\n", ["HALLUCINATED_IMPORT@1"]),
    "too few": ("python", "import math\nmath.pow(2)\n", ["ARGUMENT_MISMATCH@2"]),
    "star and keywords": ("python", "import math\nmath.pow(*p, 2, **k)\nmath.sqrt(x=1)\n", ["ARGUMENT_MISMATCH@3"]),
    "lambda and comprehension commas": ("python", "import math\nmath.sqrt(lambda a, b: a)\nmath.sqrt(x for x, y in z)\n", []),
    "trailing comma": ("python", "import math\nmath.sqrt(\n    1,\n)\n", []),
    "complexity 8": ("python", "def f(a):\n    if a and a or a:\n        pass\n    elif a:\n        return 1 if a else 2\n", ["HIGH_COMPLEXITY@1"]),
    "complexity 7": ("python", "def f(a):\n    if a and a:\n        pass\n    elif a:\n        return 1 if a else [b for b in a if b]\n    while a: a = 0\n", []),
    # python, not parseable
    "bracket": ("python", "def f(:\n    pass", ["PARSE_ERROR@0"]),
    "colon": ("python", "if a\n    b = 1\n", ["PARSE_ERROR@0"]),
    "indent": ("python", "a = 1\n  b = 2\n", ["PARSE_ERROR@0"]),
    "unindent": ("python", "if a:\n        b = 1\n    c = 1\n", ["PARSE_ERROR@0"]),
    "no block": ("python", "def f():\nreturn 1\n", ["PARSE_ERROR@0"]),
    "open string": ("python", "a = 'x\nimport os\n", ["PARSE_ERROR@0"]),
    "prose": ("python", "this is no code\n", ["PARSE_ERROR@0"]),
    **{f"syntax {code!r}": ("python", code + "\n", ["PARSE_ERROR@0"]) for code in (
        "x = ", "f(a,,b)", "x = = 3", "return return", "for in x:\n    pass", "import", "x = a +", "f(, a)", "x = y import z", "a = not")},
    **{f"no syntax error {code!r}": ("python", code + "\n", []) for code in (
        "x = [\n    a + b,\n]", "def f(a, /, *, b): return a", "x = not a", "x[1, ...] = -a", "y = a if b else -c", "f(*a, **b)", "x = (a +\n     b)",
        "@f\ndef g(): pass", "x = a \\\n    + b", "if a: pass\nelse: pass", "def f() -> int: return 1", "lambda *a: a", "a = b = c", "x @ y", "print(a, end='')")},
    **{f"statement of its own {code!r}": ("python", code + "\n", ["PARSE_ERROR@0"]) for code in (
        "else:\n    pass", "if a:\n    pass\nx = 1\nelse:\n    pass", "elif a:\n    pass", "for x in y:\n    pass\nelif a:\n    pass", "finally:\n    pass",
        "except:\n    pass", "try:\n    pass\nx = 1", "def f():\n    try:\n        pass\n", "try:\n    pass\nelse:\n    pass", "with a:\n    pass\nelse:\n    pass",
        "if a:\n    if b:\n        pass\n    x = 1\n    else:\n        pass", "if a:\n    pass\nfinally:\n    pass", "def f():\n    if a:\n        pass\nelse:\n    pass")},
    **{f"statements that go together {code!r}": ("python", code + "\n", []) for code in (
        "if a:\n    pass\nelif b:\n    pass\nelse:\n    pass", "x, = y", "for x in y:\n    pass\nelse:\n    pass", "while a:\n    if b: pass\n    else: pass\nelse:\n    pass",
        "async def f():\n    async for x in y:\n        pass\n    else:\n        pass",
        "try:\n    a()\nexcept B:\n    c()\nexcept D:\n    e()\nelse:\n    pass\nfinally:\n    pass", "try: a()\nfinally: b()",
        "if a:\n    if b:\n        pass\n    # told\n\n    else:\n        pass\nelse:\n    pass", "x = (1 if a\nelse 2)", "if a:\n\tpass\nelse:\n\tpass")},
    "parameters of a function with type parameters": ("python", "def f[T](u=None):\n    return u.x\n\n@d\ndef g[K: (int, str), V](a, w=None):\n    return w.x\n",
        ["MISSING_NONE_CHECK@2", "MISSING_NONE_CHECK@6"]),
    "a subscripted call is no signature": ("python", "def f(a):\n    return a[0](u=None)\nx = f[1](2)\n", []),
    "guard in brackets": ("python", "def f(u=None, v=None, w=None):\n    if not (u):\n        return\n    if (v) is None or (w) is not None:\n        return\n    return u.x + v.x + w.x\n", []),
    "call is no guard": ("python", "def f(u=None):\n    if g(u) is None:\n        return\n    return u.x\n", ["MISSING_NONE_CHECK@4"]),
    "crlf and tabs": ("python", "if a:\r\n\tb = 1\r\n\tif b:\r\n\t\tc = 1\r\nd = 1\r\n", []),
    "comment ends with backslash": ("python", "a = 1 # x \\\nb = 2\n", []),
    # java
    "import in a comment": ("java", "import java.util.List;\n// List is told\n" + JAVA(""), []),
    "name inside a name": ("java", "import java.util.List;\n" + JAVA("    ArrayList a;"), []),
    "wildcard import": ("java", "import java.util.*;\n" + JAVA(""), []),
    "unknown import": ("java", "import madeup.Thing;\n" + JAVA("    Thing t;"), ["HALLUCINATED_IMPORT@1"]),
    "unknown but long": ("java", "import com.acme.Thing;\n" + JAVA("    Thing t;"), []),
    "comment-only catch": ("java", JAVA("  void f() {\n    try { a(); } catch (A | B e) { /* x */ }\n  }"), ["SWALLOWED_EXCEPTION@3"]),
    "broad catch": ("java", JAVA("  void f() {\n    try { a(); }\n    catch (final Throwable t) {\n      log(t);\n    }\n  }"), ["BROAD_CATCH@5"]),
    "multi catch": ("java", JAVA("  void f() {\n    try { a(); } catch (Exception | B e) { log(e); } finally { }\n  }"), []),
    "null check": ("java", JAVA("  void f(Node p, Node[] q, int n) {\n    p.run(); p.run();\n    q.length();\n  }"), ["MISSING_NULL_CHECK@3"]),
    "any comparison guards": ("java", JAVA("  void f(Node p) {\n    if (p == other) p.run();\n  }"), []),
    "field guards": ("java", JAVA("  void f(Node user) {\n    if (x.user == null) user.run();\n  }"), []),
    "field access": ("java", JAVA("  int f(Node p) {\n    return p.size;\n  }"), []),
    "constructor": ("java", JAVA("  public Case(Node p) {\n    p.run();\n  }"), []),
    "varargs": ("java", JAVA("  void f(Node... ps) {\n    ps.run();\n  }"), ["MISSING_NULL_CHECK@3"]),
    "fake method": ("java", JAVA("  double a = Math.squareroot(4);"), ["HALLUCINATED_METHOD@2"]),
    "arity": ("java", JAVA("  double a = Math.sqrt(4, 5) + Math.max(1, f(2, 3));"), ["ARGUMENT_MISMATCH@2"]),
    "generic commas": ("java", JAVA("  boolean a = Objects.isNull(new HashMap<String, List<Integer>>());"), []),
    "class typo once a line": ("java", JAVA("  void f() {\n    Systems.out.println(1); Maths.abs(1);\n    mList.add(1);\n  }"), ["HALLUCINATED_CLASS_NAME@3"]),
    "secret with escaped quotes": ("java", JAVA('  String password = "ab";\n  String token = "abcdef";'), ["HARDCODED_SECRET@3"]),
    "switch groups": ("java", JAVA("  int f(int a) {\n    switch (a) {\n      case 1: case 2: return 1;\n      case 3: return a > 1 && a < 5 ? 1 : 2;\n      default: return 3;\n    }\n  }"), []),
    "do while": ("java", JAVA("  void f(int a) {\n    do { if (a > 1 || a < 0) { a--; } } while (a > 2);\n    for (int b : c) { while (b > 1) { b--; } if (b < 1) { return; } }\n  }"), ["HIGH_COMPLEXITY@2"]),
    "null check in brackets": ("java", JAVA("  void f(Node p, Node q) {\n    if ((p) == null || null != (q)) return;\n    p.run(); q.run();\n  }"), []),
    "deep generics": ("java", JAVA("  boolean a = Objects.isNull(new HashMap<A, Map<B, Map<C, Map<D, Map<E, List<F>>>>>>());\n  void f(Map<A, Map<B, Map<C, Map<D, E>>>> p) { p.go(); }"), ["MISSING_NULL_CHECK@3"]),
    "comparisons are no generics": ("java", JAVA("  int a = Math.max(a < b, 1, c > d);\n  double b = Math.sqrt(a < b, c > d);"), ["ARGUMENT_MISMATCH@2", "ARGUMENT_MISMATCH@3"]),
    "annotated catch": ("java", JAVA('  void f() {\n    try { a(); } catch (@Ann("x") Exception e) { }\n  }'), ["SWALLOWED_EXCEPTION@3"]),
    **{f"java syntax {code!r}": ("java", code, ["PARSE_ERROR@0"]) for code in (
        JAVA("  int x = 5 int y = 6;"), JAVA("  int x = ;"), "int x = 5;", "This text says something;", "def f(a):\n    return a\n", JAVA("  int x = f(1,);"),
        JAVA("  void f() { int x = 5 }"), JAVA("  void f() {\n    if (a) { g() }\n  }"), JAVA("  void f() { g() h(); }"), JAVA("  void f() { else { g(); } }"),
        JAVA("  void f() { if (a) g(); else h(); else i(); }"), JAVA("  void f() { try { g(); } h(); }"), JAVA("  void f() { g(); finally { h(); } }"),
        JAVA("  void f() { catch (E e) { } }"), JAVA("  void f() { for (;;) { return x } }"), JAVA("  Runnable r = () -> { g() };"), JAVA("  int f() { int y = g(1)\n int z = 2; }"))},
    **{f"no java syntax error {code!r}": ("java", code, []) for code in (
        "package a.b;\nimport java.util.*;\n" + JAVA("  int x = i++; @Ann Foo y; @A(\"b\") List<int[]> z; int w = (int) 3;"), "record Point(int x, int y) { }", "package a.b;",
        JAVA("  int[] a = {1, 2}; int[][] b = {{1}, {2, 3}}; int[] c = new int[] {4, 5}; @A({1, 2}) int d; enum E { A, B } enum F { A(1), B(2) { void g() { } }; }"),
        JAVA("  void f() { if (a) b(); else if (c) d(); else { e(); } do { x(); } while (y); l: { z(); } switch (k) { case 1: break; default: } }"),
        JAVA("  void f() { try { g(); } catch (A e) { i(); } finally { h(); } try (R r = s()) { g(); } Runnable q = () -> { }; h(() -> { g(); return; }); }"),
        JAVA("  void f() throws E { int y = (int) x; Object o = (Object) g(); if (a) g(); for (;;) h(); @B(1) int z = 3; static int w; }"),
        JAVA("  void f() { if (a) { if (b) c(); else d(); } else e(); int r = switch (k) { case 1 -> 2; default -> { yield 3; } }; new T() { void g() { } }; }"),
        JAVA("  @Deprecated(since = \"1\") public int f() { return 1; } static { g(); } int x() { return a ? b : c; } { h(); }"),
        JAVA("  Map<String, ? extends Number> m = new HashMap<>(); boolean b = c < d && e > f; String s = \"a\" + 'b';"))},
    "java bracket": ("java", "public class A { public void f( { } }", ["PARSE_ERROR@0"]),
    "java open string": ("java", JAVA('  String s = "abc;'), ["PARSE_ERROR@0"]),
}


# (weight, score, level, findings) of the first three cases
WHOLE = [(25, 62, "High", 7), (11, 28, "High", 2), (27, 68, "High", 7)]


def test_cases(told):
    got = told([(language, code) for language, code, _ in CASES.values()])
    wrong = {name: (mine, case[2]) for (name, case), mine in zip(CASES.items(), got) if mine != case[2]}
    assert not wrong


def test_report_fields(sources):
    from riskweave.plans import analysis
    rows = analysis.reports(sources([(l, c) for l, c, _ in list(CASES.values())[:3]])).orderBy("file_id").collect()
    assert [(r.total_weight, r.risk_score, r.risk_level, r.num_findings) for r in rows] == WHOLE
    assert rows[0].facts.asDict() == {"imports": ["json", "textutils"], "functions": ["read"], "num_lines": 16}
    assert rows[2].findings[2].message.startswith("Catch block")
    assert rows[0].findings[5].message.startswith("Parameter 'probe' in function 'read' defaults to None")


def test_scores_round_half_even(spark):
    from pyspark.sql import functions as F

    from riskweave.functions import text
    got = [r[0] for r in spark.range(60).orderBy("id").select(text.risk_score(F.col("id"))).collect()]
    assert got == [min(100, round(w / 40 * 100)) for w in range(60)]


def test_many_imports_take_linear_time(spark):
    """Used names are found by hashing; the others are still looked for inside longer names."""
    import time

    from pyspark.sql import functions as F

    from riskweave.functions import text

    def seconds(n):
        names = [f"Name{i}x" for i in range(n)]
        body = "\n".join(f"import a.b.{x};" for x in names) + "\n" + "\n".join(f"  {x} f{i}; Other{x}Thing g;" if i % 50 else "" for i, x in enumerate(names))
        frame = spark.createDataFrame([(body, [*names, "Gone", "hing"])], "code string, names array<string>").select(
            text.java_unreferenced(F.col("code"), F.col("names")).alias("found"))
        begin = time.time()
        found = frame.first().found
        assert found == [x for i, x in enumerate(names) if i % 50 == 0] + ["Gone"]
        return time.time() - begin

    seconds(100)
    assert seconds(10_000) < 5 + 20 * seconds(1_000)
