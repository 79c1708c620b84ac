import numpy as np
from conftest import SMALL
from llm.conftest import LONG
from oracle_check import compare, oracle
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import containment as cm
from riskweave.llm import line_templates as lt
from riskweave.llm import oracles
from riskweave.llm.common import salted_join, split_join


@pytest.mark.parametrize("key", sorted(oracles.oracle_sql()))
def test_query_equals_oracle(spark, key):
    equal, _, difference = compare(spark, oracle(SMALL), SMALL, key)
    assert equal, difference


def cleaned(documents, rows, **options):
    return {r.doc_id: (r.text, r.n_dropped) for r in lt.deduplicated(documents(rows), **options).collect()}


def test_line_cases(documents, prose):
    notice = "Copyright 2019 by the people of the lake and all of their friends"
    rows = [(i, f"{prose(i)}\n{notice.replace('2019', str(2000 + i))}\n\n{prose(100 + i)}") for i in range(4)]
    rows += [(10, None), (11, ""), (12, "\n\n"), (13, prose(13) + "\nTo."), (14, prose(14) + "\nTo."), (15, "To."), (None, prose(16) + "\nTo."),
             (17, LONG), (18, prose(18)), (18, prose(18))]
    got = cleaned(documents, rows)
    assert got[0] == (rows[0][1], 0)  # the first that has it keeps it
    for i in (1, 2, 3):
        assert got[i] == (f"{prose(i)}\n\n{prose(100 + i)}", 1)
    assert got[10] == (None, 0) and got[11] == ("", 0) and got[12] == ("\n\n", 0)
    assert got[13][1] == 0 and got[14] == (prose(14), 1) and got[15] == ("", 1) and got[None] == (prose(16), 1)
    assert got[17] == (LONG, 0) and got[18] == (prose(18), 0)
    assert lt.deduplicated(documents(rows)).count() == len(rows)
    assert lt.deduplicated(documents([])).count() == 0
    assert lt.deduplicated(documents(rows)).columns == [*documents([]).columns, "n_lines", "n_dropped"]


def test_a_stretch_may_vary_but_not_more(documents):
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvw"]
    def line(changes):
        return " ".join(x if i not in changes else f"v{'abcdefgh'[k]}" for i, x in enumerate(words))
    k = 0
    rows = [(0, line(()))]
    for k in (1, 2):
        rows.append((k, line((5, 6))))  # within one stretch
    assert [d for _, (_, d) in sorted(cleaned(documents, rows).items())] == [0, 1, 1]
    rows = [(0, line(()))]
    for k in (1, 2):
        rows.append((k, line((4, 9, 14, 19))))
    assert [d for _, (_, d) in sorted(cleaned(documents, rows).items())] == [0, 0, 0]
    rows = [(0, line(())), (1, line(()).replace("wa ", "xx ")), (2, line(()).replace("wa ", "yy "))]  # another leading token
    assert [d for _, (_, d) in sorted(cleaned(documents, rows).items())] == [0, 0, 0]


def test_equal_lines_of_eight_words_recur_from_two_documents_on(documents, prose):
    for words, gone in ((7, 0), (8, 1), (12, 1)):
        line = prose(50, words)
        assert [n for _, (_, n) in sorted(cleaned(documents, [(1, line), (2, line)]).items())] == [0, gone]
        assert cleaned(documents, [(1, line), (2, line)], min_docs=2)[2] == ("", 1)
    other = prose(50, 12).split()
    other[6] = "zz"
    assert cleaned(documents, [(1, prose(50, 12)), (2, " ".join(other))])[2][1] == 0  # not equal, and too short for two
    assert cleaned(documents, [(1, "1 2 3 4 5 6 7 8 9 a b"), (2, "1 2 3 4 5 6 7 8 9 a b")])[2][1] == 0  # hardly a word
    assert cleaned(documents, [(1, prose(50, 8) + " 7"), (2, "  " + prose(50, 8) + " 7 ")])[2] == ("", 1)


def test_hot_templates_and_others_give_the_same(documents, prose):
    rows = [(i, "\n".join([prose(1, 12), prose(100 + i % 5, 9), prose(i, 9), "To."])) for i in range(40)]
    want = cleaned(documents, rows)
    assert want[0][1] == 0 and want[39][1] == 3
    for hot in (1, 3, 1 << 40):
        gone = {r.doc_id: sorted(r.dropped) for r in lt.repeated_lines(documents(rows), hot=hot).collect()}
        assert {d: len(x) for d, x in gone.items()} == {d: n for d, (_, n) in want.items() if n}


def test_lines_without_ids(documents, prose):
    rows = [(None, prose(1, 12)), (None, prose(1, 12) + " "), (None, prose(1, 12) + "\n" + prose(2, 12)), (7, prose(2, 12))]
    got = [(r.doc_id, r.text) for r in lt.deduplicated(documents(rows)).collect()]
    assert sum(prose(1, 12) in t for _, t in got) == 1 and (7, prose(2, 12)) in got
    assert sum(prose(2, 12) in t for _, t in got) == 1  # the row with an id comes first


def test_items_shorter_than_a_shingle_are_found_inside(spark, documents):
    rows = [(1, "far off the Quick, fox ran on and on"), (2, "the quick fox"), (3, "the fox quick one two three"), (4, "quick fox"), (5, "fox"),
            (6, "some quick fox went by here"), (None, "is it the quick fox or not")]
    items = spark.createDataFrame([(7, "The quick fox"), (8, "quick fox"), (9, "fox")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in cm.contaminated(documents(rows), items).collect()}
    assert got == {(1, 7, 1), (2, 7, 1), (None, 7, 1), (4, 8, 1), (5, 9, 1)}


def test_recall_where_four_fifths_of_an_item_are_left(spark, documents, prose):
    """Items with a word changed near the end, or cut: every pair that brute force finds must be found."""
    draw = np.random.default_rng(8)
    items = [(i, prose(5000 + i, int(draw.integers(9, 300)))) for i in range(120)]
    rows = []
    for i, item in items:
        words = item.split()
        total = len(words) - 4
        lost = int(total * 0.2)
        cut = words[lost // 2:len(words) - (lost - lost // 2)]
        rows.append((i, " ".join([prose(6000 + i, int(draw.integers(0, 200))), *cut, prose(7000 + i, int(draw.integers(0, 200)))])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in cm.contaminated(documents(rows), benchmark).collect()}
    want = pairs(rows, items)
    assert len(want) == 120 and got == want


def test_a_passage_that_many_documents_hold(spark, documents, prose):
    """A hot signature is dealt over parts; each pair comes once, and no row carries a list that grows with them."""
    passage = prose(1, 30)
    rows = [(i, f"{prose(10 + i, 20)} {passage}" if i % 3 else prose(10 + i, 20)) for i in range(90)]
    items = spark.createDataFrame([(i, passage) for i in range(4)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in cm.contaminated(documents(rows), items).collect())
    assert got == [(i, k) for i in range(90) if i % 3 for k in range(4)]
    values = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "key int, v string")
    many = spark.range(1000).selectExpr("id", "cast(if(id < 900, 1, id % 4) as int) AS key")
    joined = salted_join(many, values, "key", many["id"], chunk=50)
    assert joined.count() == many.join(values, "key").count()
    numbered = values.groupBy("key").count().join(many.groupBy("key").count().select("key", F.col("count").alias("n")), "key")
    for hot in (1, 2, 1000):
        assert sorted(split_join(many, numbered, "key", "n", hot).select("id", "count").collect()) == sorted(
            many.join(numbered, "key").select("id", "count").collect())


CLASHING = ["row", "row_id", "row_text", "row_hash", "keys", "key", "at", "of", "dropped", "new", "lines", "n_lines", "n_dropped", "n_docs",
            "first_id", "_id", "_hash", "_row_hash", "_none", "fp", "root", "k", "item_id", "signature", "part", "n_chars_", "Key", "a.b"]


def with_clashes(spark, rows):
    names = CLASHING[:-2] + ["a.b"]
    frame = spark.createDataFrame([(i, t, *[f"{i}-{n}" for n in names]) for i, t in rows],
                                  ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    return frame, lambda r: all(r[n] == f"{r['doc_id']}-{n}" for n in names)


def test_columns_of_any_name_stay(spark, prose):
    rows = [(i, f"{prose(i)}\n{prose(100, 12)}") for i in range(6)] + [(9, None), (10, "")]
    frame, kept = with_clashes(spark, rows)
    got = lt.deduplicated(frame)
    assert got.columns == [*frame.columns, "n_lines_", "n_dropped_"]
    assert all(kept(r) and r.n_dropped_ == int(0 < r.doc_id < 9) for r in got.collect())
    stage = corpus_pipeline.line_dedup(spark, frame, "")
    assert stage.columns == frame.columns and all(map(kept, stage.collect()))
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.language_id):
        found = stage(spark, frame.withColumn("lang", F.lit("en")), SMALL)
        assert found.columns == [*frame.columns, "lang"] and all(map(kept, found.collect()))
    leak = spark.createDataFrame([(1, prose(3))], "item_id long, text string")
    clean = cm.decontaminated(frame, leak)
    assert clean.columns == frame.columns and all(map(kept, clean.collect())) and clean.count() == len(rows) - 1
    packed = corpus_pipeline.packing(spark, frame, "")
    assert packed.count() >= len(rows)


def test_lines_of_numbers_and_separators_recur_only_as_they_are(documents):
    def told(*lines):
        return [d for _, (_, d) in sorted(cleaned(documents, enumerate(lines)).items())]

    for line in ("{0}", "{0}.", "12.{0} 3 4{0}", "| {0} | 8 | {0} |", "- {0}", "Total {0} {0} 4 | {0}", "a {0} b 1 c 2 d {0} 5 6 7",
                 "| {0} | 2 | 3 | 4 | {0} | 6 | 7 | 8 | {0} |", "{0} 1 2 3 4 5 6 7 one two three"):
        assert told(*[line.format(i) for i in (31, 52, 73, 94)]) == [0, 0, 0, 0], line
        assert told(*[line.format(31)] * 3) == [0, 1, 1], line
    assert told(*[f"| | | | - - - | | {x} |" for x in "abcd"]) == [0, 0, 0, 0]  # a stretch may not vary either
    assert told("***", "***", "***") == [0, 1, 1]
    assert told(*[f"Posted on {2000 + i} by the people" for i in range(4)]) == [0, 1, 1, 1]


def test_the_pipeline_drops_long_lines_shared_by_two_documents(spark, documents, prose):
    passage = prose(50, lt.LONG_LINE)
    near = passage.split()
    near[5] = "other"
    short = prose(51, 7)
    rows = [(1, f"{prose(1)}\n{passage}\n{short}"), (2, f"{prose(2)}\n{passage}\n{short}"), (3, prose(3)),
            (4, f"{prose(4)}\n{' '.join(near)}")]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, documents(rows), "").collect()}
    assert got == {1: rows[0][1], 2: f"{prose(2)}\n{short}", 3: rows[2][1], 4: prose(4)}
    rows = [(1, f"{prose(1)}\n{passage}"), (2, f"{prose(2)}\n{' '.join(near)}")]  # the template, not only the exact line
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, documents(rows), "").collect()}
    assert got == {1: rows[0][1], 2: prose(2)}


def pairs(documents, items):
    out = set()
    for d, text in documents:
        for i, item in items:
            if text and item and i is not None:
                have, want = cm.shingles(text), cm.shingles(item)
                words, own = cm.words_of(text), cm.words_of(item)
                inside = len(own) in (3, 4) and any(words[k:k + len(own)] == own for k in range(len(words)))
                if want and (inside or len(want & have) >= 0.8 * len(want)):
                    out.add((d, i))
    return out


def test_containment_by_brute_force(spark, documents, prose):
    draw = np.random.default_rng(4)
    sizes = [1, 3, 5, 6, 9, 12, 13, 19, 20, 36, 70, 150, 400]
    items = [(i, prose(1000 + i, n)) for i, n in enumerate(sizes)] + [(90, None), (91, ""), (None, prose(5)), (92, prose(1000, 1))]
    rows = []
    for i, (_, item) in enumerate(items[:13]):
        words = item.split()
        for copy in range(3):
            before, after = prose(2000 + 10 * i + copy, int(draw.integers(1, 900))), prose(3000 + 10 * i + copy, int(draw.integers(1, 900)))
            rows.append((len(rows), f"{before}\n{', '.join(words).upper()}. {after}"))
        rows.append((len(rows), before + " " + " ".join(words[: int(len(words) * 0.85) + 1]) + " " + after))
        rows.append((len(rows), before + " " + " ".join(words[: len(words) // 2]) + " " + after))
        rows.append((len(rows), item))
    rows += [(900, None), (901, ""), (902, "..."), (None, items[9][1]), (903, LONG + items[9][1] + LONG), (903, LONG + items[9][1] + LONG)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, containment string")
    got = [(r.doc_id, r.item_id) for r in cm.contaminated(documents(rows), benchmark).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs(rows, items)
    clean = cm.decontaminated(documents(rows), benchmark)
    assert clean.columns == documents([]).columns
    bad = {d for d, _ in got}
    assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted([d for d, _ in rows if d not in bad], key=str)
    assert cm.contaminated(documents([]), benchmark).count() == 0
    assert cm.contaminated(documents(rows), benchmark.limit(0)).count() == 0
    assert cm.decontaminated(documents(rows), benchmark.limit(0)).count() == len(rows)
