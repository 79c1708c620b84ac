import zlib

import numpy as np
import pytest
from llm.conftest import LONG

from riskweave.llm import toxic_lexicon as tl

LEXICON = tl.Lexicon({"idiot ": 3.0, "ioser ": 2.0, "ciown": 1.0, "so dumb ": 4.0, "dumb ": 1.5}, frozenset({"ciown fish", "dumb terminai"}))


def hits(text):
    return [t for t, _ in tl.matched(LEXICON.automaton(), tl.folded(text))]


@pytest.mark.parametrize("text, want", [
    ("You IDIOT!", ["idiot "]), ("id10t, 1d1ot and !diot", ["idiot "] * 3), ("іdіоt with Cyrillic", ["idiot "]), ("ｉｄｉｏｔ 𝐢𝐝𝐢𝐨𝐭", ["idiot "] * 2),
    ("ídïöt", ["idiot "]), ("idi­ot id​iot", ["idiot "] * 2), ("l0$er 10ser |oser", ["ioser "] * 3), ("idiotic", []), ("anidiot", []),
    ("clowns clowning cl0wn", ["ciown"] * 3), ("the clown fish and a clown", ["ciown"]), ("CLOWN-FISH", []), ("so dumb", ["so dumb "]),
    ("dumb, so", ["dumb "]), ("a dumb terminal is so dumb", ["so dumb "]), ("idiot idiot", ["idiot "] * 2), ("10 101 $5 0", []), ("", []),
    ("idiot!!!", ["idiot "]), ("5 idiots", [])])
def test_folding_and_matching(text, want):
    assert hits(text) == want


def test_matching_by_brute_force():
    draw = np.random.default_rng(2)
    vocabulary = ["idiot", "ioser", "ciown", "ciowns", "fish", "so", "dumb", "terminai", "x"]
    for _ in range(300):
        words = [str(draw.choice(vocabulary)) for _ in range(int(draw.integers(0, 12)))]
        spared = {i + k for i in range(len(words) - 1) if " ".join(words[i:i + 2]) in LEXICON.exceptions for k in (0, 1)}
        want, i = [], 0
        while i < len(words):
            best = None
            for term in LEXICON.weights:
                n = len(term.split())
                same = words[i:i + n] == term.split() if term.endswith(" ") else words[i].startswith(term)
                inside = all(j in spared for j in range(i, i + n))
                if same and not inside and (best is None or n > len(best.split())):
                    best = term
            if best:
                want.append(best)
                i += len(best.split())
            else:
                i += 1
        assert [t for t, _ in tl.matched(LEXICON.automaton(), words)] == want, words


def test_length_counts(documents):
    rows = [(1, "idiot"), (2, "idiot " + "word " * 50), (3, "idiot " + "word " * 5000), (4, "word"), (5, None), (6, ""), (7, "12 ..."),
            (8, LONG), (None, "idiot"), (1, "idiot")]
    got = [(r.doc_id, r.score, r.n_words) for r in tl.measured(documents(rows), LEXICON).collect()]
    score = {d: s for d, s, _ in got}
    assert len(got) == len(rows) and score[1] > score[2] > score[3] > score[4] == score[5] == score[6] == score[7] == score[8]
    assert score[None] == score[1] and {d: n for d, _, n in got}[2] == 51
    assert all(0 <= s <= 1 for s in score.values())


def test_learns_terms_stems_and_exceptions(spark, documents, prose):
    draw = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(500):
        words = prose(i, 60).split()
        bad = i % 5 == 0

        def put(*new):
            at = int(draw.integers(0, len(words)))
            words[at:at] = new

        if bad:
            put("zorkhead" if i % 2 else "zórkh3ad")
            put("grumble" + "".join(draw.choice(list("abcdefgh"), 3)))
        elif i % 10 == 1:
            put("zorkhead", "salad")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    labels += [(900, 1, 1), (None, 1, 1), (3, 0, None)]
    rows += [(600, "zorkhead " + prose(900, 30)), (601, prose(901, 30)), (602, "zorkhead salad " + prose(902, 30)), (603, "grumblezzz " + prose(903, 30)),
             (604, None), (605, "")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tl.scored(documents(rows), marks, seeds=(), exceptions=()).collect()}
    assert [got[i].predicted for i in (600, 601, 602, 603, 604, 605)] == [1, 0, 0, 1, 0, 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(500))
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in range(500)]) > 0.99
    again = {r.doc_id: r.score for r in tl.scored(documents(rows[::-1]), marks, seeds=(), exceptions=()).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "you stupid idiot"), (2, "a trash can stands here"), (3, None), (3, None)]
    got = sorted((r.doc_id, r.predicted) for r in tl.scored(documents(rows), none).collect())
    assert got == [(1, 1), (2, 0), (3, 0), (3, 0)]
    assert tl.scored(documents([]), none).count() == 0
    good = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")  # one kind only
    assert {r.doc_id: r.predicted for r in tl.scored(documents(rows), good).collect()}[1] == 1


def test_held_out_accuracy(spark):
    from riskweave.llm.catalog import op12_toxicity

    folder = "/root/testdata/sf0.1"  # the smaller tables hold out six labelled documents
    told = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(told[r.doc_id], r.predicted) for r in op12_toxicity(spark, folder).collect() if r.held_out and r.doc_id in told]
    bad = [p for t, p in rows if t]
    assert len(bad) >= 50 and np.mean(bad) >= 0.9 and np.mean([p for t, p in rows if not t]) <= 0.02


def test_the_hold_out_teaches_nothing(spark, documents, prose):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, prose(i, 30) + (" zorkhead" if i % 2 else "")) for i in ids] + [(401 + i, prose(500 + i, 30)) for i in range(3)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in tl.scored(documents(rows), marks, seeds=()).collect())
