import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import LONG
from tokenizers import Tokenizer

from riskweave.llm import histogram_packing as hp
from riskweave.llm import token_counts as tc
from riskweave.llm.common import Held

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b\n\n c", "I've don't 'S", "İstanbul ΣΑΣ", "<|endoftext|> x<|startoftext|>y", "café\xa0b\x85c", "１２ ½ 日本語 テスト 😀👍🏽",
       "\x00\x07", "<s>▁▁ </s>\r\n\t", "_a_ a_b 12-3"]
text = st.text(st.sampled_from(list("ab é'ß,.!<|>\n\t▁İΣ日½ \x85\xa01S")), max_size=60)


def test_counts_equal_the_library(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((r.doc_id, len(r.text.encode()), len(model.encode(r.text)), len(model.encode(r.text)) > 4096)
                  for r in documents.collect())
    assert sorted(map(tuple, tc.token_counts(documents, segment_chars=200).collect())) == want
    assert sorted(map(tuple, tc.token_counts(documents).collect())) == want


def test_count_cases(documents):
    rows = [(1, None), (1, None), (None, "abc"), (3, LONG)] + [(10 + i, t) for i, t in enumerate(ODD)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    got = tc.token_counts(documents(rows), segment_chars=50).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=str) == sorted(want, key=str)
    assert [r.over_limit for r in got if r.doc_id == 3] == [True]
    assert tc.token_counts(documents([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(text)
def test_cuts_are_safe(value):
    model, pairs = tc._model(MODEL)
    assert tc._splittable(MODEL)
    parts = tc.segments(value, 3, pairs)
    assert " ".join(parts) == value
    assert sum(len(model.encode(p)) for p in parts) == len(model.encode(value))


LIBRARY = Tokenizer.from_file(WORDS)


@settings(max_examples=200, deadline=None)
@given(text)
def test_ids_equal_the_library(value):
    got = np.frombuffer(hp.encoder(WORDS).ids(value), "<u4").tolist()
    assert got == LIBRARY.encode(value, add_special_tokens=False).ids


def test_a_small_cache_changes_nothing():
    small = hp.Encoder(WORDS)
    small.runs, small.parts = Held(small._run, 3), Held(small._part, 2)
    for value in ODD + ["a b c d e f a b c d"]:
        assert small.ids(value) == hp.encoder(WORDS).ids(value)


def checked(documents, size):
    """Holds a packing against the library and the rules of places; returns the number of sequences."""
    rows = hp.pack(documents, size=size, with_ids=True).collect()
    of, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= size and r.start == r.piece * size
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        of[r.doc_id, r.row_hash].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return of, places


def test_packing_of_the_table(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    of, places = checked(documents, 256)
    texts = {r.doc_id: r.text for r in documents.collect()}
    total = 0
    for (doc, _), parts in of.items():
        ids = [x for p in sorted(parts, key=lambda p: p.piece) for x in p.ids]
        assert ids == LIBRARY.encode(texts[doc], add_special_tokens=False).ids + [0]
        total += len(ids)
    assert len(of) == len(texts)
    assert len(places) <= 1.02 * total / 256 + 1


def test_packing_cases(documents):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, LONG)] + [(10, "same text")] * 30
    of, places = checked(documents(rows), 64)
    assert sum(len(p) for p in places.values()) == sum(len(p) for p in of.values())
    assert sum(len(p) for (doc, _), p in of.items() if doc == 10) == 30
    assert [p[0].ids for (doc, _), p in of.items() if doc in (1, 2)] == [[0], [0]]
    assert hp.pack(documents([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50), min_size=1))
def test_plan_is_best_fit(histogram):
    """The plan over counts uses as many sequences as best fit, longest first, over single pieces."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fitting = [i for i, room in enumerate(rooms) if room >= length]
            if fitting:
                at = min(fitting, key=lambda i: rooms[i])
                rooms[at] -= length
            else:
                rooms.append(20 - length)
    used = set()
    for length, runs in hp.plan(histogram, 20).items():
        assert sum(r[4] for r in runs) == histogram[length]
        rank = 0
        for first, sequence, each, _, many in runs:
            assert first == rank
            rank += many
            used.update(sequence + i // each for i in range(many))
    assert len(used) == len(rooms)
