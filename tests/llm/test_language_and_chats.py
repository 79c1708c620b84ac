import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import LONG
from pyspark.sql import functions as F

from riskweave.llm import chat_tree as ct
from riskweave.llm import language_pieces as lp

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, rows, place):
    """Sum over all segmentations, by their definition."""
    if not word:
        return np.ones(rows.shape[1])
    total = np.zeros(rows.shape[1])
    if word[0] not in place:
        total += lp.UNSEEN * brute(word[1:], rows, place)
    for j in range(1, len(word) + 1):
        if word[:j] in place:
            total += rows[place[word[:j]]] * brute(word[j:], rows, place)
    return total


def test_forward_sums_all_segmentations():
    pieces = lp.vocabulary(PATH)
    rows = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    place = {p: i for i, p in enumerate(pieces)}
    words = ["▁theand", "▁", "▁日本x", "▁aaaa", "ation", "▁straße"]
    got = lp.Pieces(pieces, rows).logs(words)
    assert np.allclose(got, [np.log(brute(w, rows, place)) for w in words])
    long = "▁" + "ab" * 200  # the same with and without rescaling
    unscaled = lp.sums(lp.Lattice(pieces).edges([long[:25]]), 1, 25, np.vstack([rows, np.full((1, 2), lp.UNSEEN)]))[0, 25]
    assert np.allclose(lp.Pieces(pieces, rows).long(long[:25]), np.log(unscaled))
    assert np.isfinite(lp.Pieces(pieces, rows).logs(["x" * 20000])).all()


def test_a_small_cache_changes_nothing(monkeypatch):
    pieces = lp.vocabulary(PATH)
    rows = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    texts = ["the and of", "of the of this", "", "der die das the and", "and " * 9 + "und nicht"]
    want = lp.Model(PATH, ["a", "b"], rows).predict(texts)
    for limit in (1, 3, 5):
        monkeypatch.setattr(lp, "HELD_WORDS", limit)
        assert [x for x, _ in lp.Model(PATH, ["a", "b"], rows).predict(texts)] == [x for x, _ in want]
        assert np.allclose([y for _, y in lp.Model(PATH, ["a", "b"], rows).predict(texts)], [y for _, y in want])


def test_em_raises_the_likelihood():
    counts = {("a", "theth"): 5, ("a", "thand"): 3, ("b", "dieund"): 4, ("b", "und"): 9}
    pieces = lp.vocabulary(PATH)

    def likelihood(rounds):
        logs = lp.Pieces(pieces, lp.learned(counts, ["a", "b"], PATH, rounds, 1e-6)).logs(["▁" + w for _, w in counts])
        return sum(n * x["ab".index(k)] for ((k, _), n), x in zip(counts.items(), logs, strict=True))

    found = [likelihood(r) for r in (1, 2, 3)]
    assert found == sorted(found)


def test_all_words_of_the_sample_are_counted(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(700)), "de", 1, "x") for i in range(100)]
    rows += [(1000 + i, f"le mot{i}", "fr", 1, "x") for i in range(100)]
    counts, languages = lp.sampled_words(labelled(spark, rows), 10_000)
    assert languages == ["de", "fr"] and sum(lang == "de" for lang, _ in counts) == 70_000
    assert {w: n for (lang, w), n in counts.items() if lang == "fr"} == {"le": 100} | {f"mot{i}": 1 for i in range(100)}


def test_long_words_are_learned_from(monkeypatch):
    counts = {("a", "ab" * 40): 5, ("b", "xy" * 40): 5}
    assert "".join(lp.stretches("ab" * 40)) == "▁" + "ab" * 40 and max(map(len, lp.stretches("ab" * 40))) == lp.LONG_WORD
    rows = lp.learned(counts, ["a", "b"], PATH)
    model = lp.Model(PATH, ["a", "b"], rows)
    assert [x for x, _ in model.predict(["ab" * 50, "xy" * 50, "abab", "xyxy"])] == ["a", "b", "a", "b"]
    monkeypatch.setattr(lp, "LEARNED_SUMS", 2)  # word by word
    assert np.allclose(lp.learned(counts, ["a", "b"], PATH), rows)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lp.predictions(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert len(rows) == documents.count()
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int, held_out string")


def test_language_cases(spark):
    base = [(i, "the and of this that with " * 3, "en", 1, "x") for i in range(40)]
    base += [(i + 100, "der die und nicht mit eine " * 3, "de", 1, "x") for i in range(40)]
    odd = [(900, None, "en", 1, "x"), (901, "", "en", 1, "x"), (902, "12 $% 3.4", None, 1, "x"), (None, "und nicht der", None, 1, "x"),
           (903, LONG, None, 1, "x"), (903, LONG, None, 1, "x"), (904, "und" * 5000, None, 1, "x")]
    table = labelled(spark, base + odd)
    model = lp.fit(table)
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in lp.predictions(table, model).where("doc_id > 890 or doc_id is null").collect()}
    assert {(i, p) for i, p, _ in got} == {(900, "und"), (901, "und"), (902, "und"), (None, "de"), (903, "en"), (904, "de")}
    assert all(0 <= r.score <= 1 for r in lp.predictions(table, model).collect())
    kept = lp.identified(table, model=model)
    assert kept.columns == table.columns and kept.count() == table.count() - 3
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lp.predictions(unlabelled).collect()} == {"und"}
    assert lp.identified(unlabelled).count() == table.count() - 3
    assert lp.predictions(table.limit(0)).count() == lp.identified(table.limit(0)).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, "the and of this that", "en", 1, "x") for i in range(60)] + [(i + 60, "der die und nicht", "de", 1, "x") for i in range(60)]
    table = labelled(spark, rows)
    wrong = table.withColumn("lang", F.when(lp.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert lp.fit(wrong).languages == ["de", "en"]


# --- chats --------------------------------------------------------------------------------------------------------------


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("x"))


def test_chat_cases(spark):
    control = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\| \\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None),
            (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, None, control), (4, 1, "assistant", control), (5, 1, "assistant", ""),
            (6, None, "user\nx\\n", "t\nu"), (6, 2, "assistant", "two"), (6, 2, "assistant", "two"), (None, 0, "user", "no id"),
            (7, 0, "user", LONG), (7, 1, "assistant", "é日" * 50)] + [(100 + i, t, "user", f"same {t}") for i in range(50) for t in range(3)]
    want = {}
    for i, n, role, text in rows:
        want.setdefault(i, []).append((n if n is not None else -math.inf, role or "", text or ""))
    for options in ({}, {"tokens": 40, "members": 4}, {"tokens": 1, "members": 1}):
        forest = ct.trees(conversations(spark, rows), **options)
        got = {r.conv_id: r for r in ct.read_back(forest, ordered=True).collect()}
        assert sorted(ct.read_back(forest.repartition(3)).collect(), key=str) == sorted(got.values(), key=str)
        assert set(got) == set(want)
        for i, turns in want.items():
            turns = [x[1:] for x in sorted(turns)]
            loss = "".join(t for r, t in turns if r == "assistant")
            assert (got[i].n_turns, got[i].turns_sha256) == (len(turns), digest(turns))
            assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[i].formatted_chars == sum(len(ct.START + ct.header(r) + ct.escaped(t) + ct.END) + 1 for r, t in turns)
    assert ct.trees(conversations(spark, [])).count() == 0


def test_shared_turns_stand_once_and_positions_count_the_path(spark):
    rows = [(i, 0, "user", "common") for i in range(3)] + [(i, 1, "assistant", f"answer {i}") for i in range(3)]
    (tree,) = ct.trees(conversations(spark, rows).coalesce(1), tokens=10_000).collect()
    first = tree.segments[0]
    assert [s.parent for s in tree.segments] == [-1, 0, 0, 0] and len(tree.tokens) == tree.segments[-1].stop
    for s in tree.segments[1:]:
        assert [(a.start, a.stop) for a in s.attends] == [(0, first.stop)]
        assert tree.position_ids[s.start:s.stop] == list(range(first.stop, first.stop + s.stop - s.start))
    many = spark.createDataFrame([(i, 0, "user", "common") for i in range(500)], "conv_id long, turn long, role string, text string")
    assert ct.trees(many, members=100).agg(F.max(F.size("conversations"))).first()[0] == 100


def test_a_long_common_beginning_is_stored_once(spark):
    """Nine thousand common tokens, more than a row may hold: each turn stands once, and every path is still complete."""
    beginning = [(n, "user" if n % 2 == 0 else "assistant", f"turn {n} " + "of the story " * 300) for n in range(12)]
    rows = [(i, *t) for i in range(40) for t in beginning] + [(i, 12, "user", f"question {i}") for i in range(40)]
    forest = ct.trees(conversations(spark, rows).coalesce(1), members=7).where("task >= 0")
    found = forest.collect()
    per_task = {}
    for r in found:
        per_task.setdefault(r.task, []).append(r)
    use = ct.codec(ct.public_tokenizers.path("byte_bpe_50k.json"))
    alone = sum(len(x[0]) for x in use.encode([t[1:] for t in beginning]))
    assert alone > 9000 and len(found) > len(per_task) * 2
    for own in per_task.values():
        answers = sum(len(r.conversations) for r in own)
        assert sum(len(r.segments) for r in own) == 12 + answers
        assert alone < sum(len(r.tokens) for r in own) < alone + 20 * answers
        assert all(len(r.tokens) <= 8192 for r in own)
        where = {r.tree: r for r in own}
        for r in own:
            for s in r.segments:  # the intervals are the tokens of the parents, in order
                way, at = [], (s.parent_tree, s.parent)
                while at[1] >= 0:
                    above = where[at[0]].segments[at[1]]
                    way[:0] = where[at[0]].tokens[above.start:above.stop]
                    at = (above.parent_tree, above.parent)
                assert way == [x for a in s.attends for x in where[a.tree].tokens[a.start:a.stop]]
                assert r.position_ids[s.start:s.stop] == list(range(len(way), len(way) + s.stop - s.start))
    assert {r.turns_sha256 for r in ct.read_back(forest).collect()} == {digest([t[1:] for t in beginning] + [("user", f"question {i}")]) for i in range(40)}


def test_rows_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, 0, "user", f"word {i}") for i in range(30)] + [(1, 0, "user", "x")]
    got = ct.read_back(ct.trees(conversations(spark, rows))).collect()
    assert len(got) == 31 and all(r.n_turns == 1 for r in got) and len({r.turns_sha256 for r in got}) == 31


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("<|\\>a\nim"))))
def test_escapes_are_reversible(value):
    assert ct.unescaped(ct.escaped(value)) == value
    assert "<|" not in ct.escaped(value)
    assert ct.role_of(ct.header(value)) == value and ct.header(value).count("\n") == 1


def test_a_batch_is_scored_in_parts_and_its_text_is_sent_once(spark):
    texts = ["a" * 400_000, None, "7", "b" * 700_000, "", "c" * 900_000, "d"]
    batch = pa.RecordBatch.from_pydict({"row": [{"n": i, "text": t} for i, t in enumerate(texts)]}).slice(1)

    class Known:
        languages, asked = ["aa"], []

        def predict(self, part):
            self.asked.append(sum(map(len, part)))
            return [("aa", 1.0) if t.isalpha() else (lp.UNDETERMINED, 0.0) for t in part]

    parts = list(lp.accepted(Known(), batch, batch.column("row").field(1), 0.5))
    assert [x["n"] for p in parts for x in p.column("row").to_pylist()] == [3, 5, 6]
    assert Known.asked == [700_001, 900_001]
    documents = spark.createDataFrame([(1, "ein Text", "x")], "doc_id long, text string, Row string")
    model = lp.Model("", [], np.empty((0, 0)))
    kept = lp.identified(documents, model=model)
    assert [tuple(r) for r in kept.collect()] == [(1, "ein Text", "x")]
    nodes, inputs = [kept._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        inputs += [c.output().size() for c in children if node.nodeName() == "MapInArrow"]
        nodes += children
    assert inputs == [1]


def test_a_worker_remembers_for_one_operator_at_a_time():
    from riskweave.llm import common, histogram_packing

    common.takes_over("language", lp.Model._held.clear)
    lp.Model._held["model"] = None, {"word": b""}
    common.takes_over("language", lp.Model._held.clear)
    assert lp.Model._held
    common.takes_over("packing", histogram_packing.encoder.cache_clear)
    assert not lp.Model._held
