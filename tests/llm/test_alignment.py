import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm.conftest import LONG
from tokenizers import Tokenizer

from riskweave.llm import cross_alignment as ca

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ca.byte_alphabet()
TEXTS = [
    "Plain words, 12.5 of them!", "straße über Ñandú – naïve café", "日本語のテキスト 漢字", "🙂🙃 family 👨‍👩‍👧", "<|endoftext|></s><s><unk><0x0A>",
    "a\nb\t c   d ", "  two blanks first", "▁ marks▁", "x" * 700, " " * 700, "\n" * 600 + "end", "ａｂｃ ﬁ ½", "  x", "\x00\x01", "-" * 90, "é" * 3000,
]


def ends(parts):
    out, at = [], 0
    for part in parts:
        out.append((at, at + len(part)))
        at += len(part)
    return out


def encoded(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    bytes_a = [bytes(ALPHABET[x] for x in A.id_to_token(i)) for i in a]
    bytes_b = []
    for i in b:
        piece = B.id_to_piece(i)
        hexed = re.fullmatch("<0x(..)>", piece) if B.is_byte(i) else None
        bytes_b.append(bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode())
    if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    return a, b, ends(bytes_a), ends(bytes_b)


def brute(rows):
    linked, held = [], Counter()
    for _, text in rows:
        a, b, ea, eb = encoded(text or "")
        links = []
        for i, (s, e) in zip(a, ea, strict=True):
            links += [(i, j) for j, (t, f) in zip(b, eb, strict=True) if t < e and s < f]
        common = sorted({e for _, e in ea} & {e for _, e in eb})
        groups = ";".join(
            ",".join(str(i) for i, (_, e) in zip(a, ea, strict=True) if low < e <= high) + "|" +
            ",".join(str(i) for i, (_, e) in zip(b, eb, strict=True) if low < e <= high)
            for low, high in zip([0, *common], common, strict=False))
        linked.append((links, len(a), len(b), len(common), groups))
        held.update(set(links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return sorted(((doc, na, nb, ng, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links),
                    hashlib.sha256(groups.encode()).hexdigest() if na else "")
                   for (doc, _), (links, na, nb, ng, groups) in zip(rows, linked, strict=True)), key=repr)


@pytest.mark.parametrize("hot, work", [(20_000, 1 << 16), (3, 7), (1, 1)])
def test_alignment_by_brute_force(documents, prose, hot, work):
    rows = [(i, prose(i % 9, 5 + i)) for i in range(25)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(200, None), (201, ""), (None, TEXTS[0]), (100, TEXTS[0]), (100, TEXTS[0]), (203, " "), (204, "the " * 800)]
    got = ca.aligned(documents(rows), hot=hot, work=work)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_long_text_and_empty_tables(documents):
    rows = [(1, LONG), (2, None)]
    got = {r.doc_id: r for r in ca.aligned(documents(rows)).collect()}
    assert got[1].n_a == len(A.encode(" " + LONG, add_special_tokens=False).ids) and got[1].n_b == len(B.encode(LONG))
    assert got[1].n_links == got[1].n_a + got[1].n_b - got[1].n_groups and got[2].n_links == 0
    for empty in ([], [(1, None)]):
        assert ca.aligned(documents(empty)).count() == len(empty)


def test_groups_cover_the_text(documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)]
    found = defaultdict(list)
    for r in ca.groups(documents(rows), work=5).collect():
        found[r.doc_id].append(r)
    for doc, text in rows:
        a, b, ea, eb = encoded(text or "")
        parts = sorted(found.get(doc, []), key=lambda r: r.nth)
        assert [i for r in parts for i in r.a_ids] == a and [i for r in parts for i in r.b_ids] == b
        if a:
            assert [r.nth for r in parts] == list(range(len(parts))) and parts[-1].stop == len((" " + text).encode())
            assert [r.start for r in parts] == [0] + [r.stop for r in parts[:-1]]
            assert {r.stop for r in parts} == {e for _, e in ea} & {e for _, e in eb}


def test_both_libraries_give_the_same_ids():
    """Which characters are letters, digits or blanks decides where texts are cut; it must not depend on the library."""
    use = ca.Encoders(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), RANKS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0)]
    texts = [f" a{chr(c)}b1{chr(c)}1!{chr(c)}!  {chr(c)} {chr(c)}" for c in points]
    assert use.encode_a(texts) == [e.ids for e in A.encode_batch(texts, add_special_tokens=False)]


def test_cuts_divide_the_work_evenly():
    draw = np.random.default_rng(3)
    for n, m in ((0, 0), (1, 0), (0, 5), (40, 3), (100, 100)):
        a, b = (np.cumsum(draw.integers(1, 5, k)) for k in (n, m))
        i, j = ca.cuts(a, b, 8)
        order = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            assert sorted([(x, 0) for x in a[:p].tolist()] + [(x, 1) for x in b[:q].tolist()]) == order[:p + q]
        assert (np.diff(i + j) <= 8).all() and i[-1] == n and j[-1] == m
