import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from llm.conftest import LONG

from riskweave.llm import permuterm


def vocabulary(rows, every=31):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows):
    words = vocabulary(rows)
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in near}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def test_variants_by_brute_force(documents):
    draw = np.random.default_rng(11)
    stems = ["abcdefgh", "aabbccdd", "aaaaaaaa", "Éabcdefg", "straßenö", "aaaaaaaaaaaa"]
    rows = []
    for i in range(60):
        words = []
        for stem in stems:
            for _ in range(int(draw.integers(1, 30))):
                word = list(stem)
                for _ in range(int(draw.choice([0, 0, 0, 0, 1, 2]))):
                    at, kind = int(draw.integers(0, len(word))), int(draw.integers(0, 3))
                    word[at:at + (kind != 0)] = [] if kind == 1 else [str(draw.choice(list("abcé")))]
                words.append("".join(word))
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "-".join(words)))
    rows += [(70, None), (71, ""), (72, "1 2 $ 3"), (None, "abcdefgh abcdefgx"), (5, rows[5][1]), (5, rows[5][1]), (74, LONG), (75, "x" * 9000)]
    got = permuterm.variants(documents(rows)).collect()
    want = brute(rows)
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_chains_of_forms(documents):
    chain = ["abcdefgh", "abcdefgx", "abcdefxx", "abcdexxx"]
    rows = [(1, " ".join(" ".join([w] * (2 * 10 ** i)) for i, w in enumerate(chain)))]
    got = {r.word: (r.form, r.root, r.n) for r in permuterm.variants(documents(rows), every=None).collect()}
    assert got == {w: (chain[i + 1] if i < 3 else None, chain[3], 2 * 10 ** i) for i, w in enumerate(chain)}


def test_no_words(documents):
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    for rows in ([], [(1, None), (2, "short words")]):
        got = permuterm.variants(documents(rows))
        assert got.columns == names and got.count() == 0


def test_groups_stay_small(spark):
    """A prefix has no more rows than letters, whatever the vocabulary."""
    words = [f"abc{chr(97 + i)}efgh" for i in range(26)] + ["abcefgh"]
    frame = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(words)], "word string, n long")
    sizes = permuterm.rotations(frame).groupBy("prefix").count().agg({"count": "max"}).first()[0]
    assert sizes == 27
    got = {r.word: r for r in permuterm.neighbours(frame).collect()}
    assert all(got[w].n_near == 26 for w in words) and got["abcefgh"].best == words[25] and got[words[25]].best == "abcefgh"
