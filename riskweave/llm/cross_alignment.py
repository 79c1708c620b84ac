"""Cross-tokenizer alignment: the byte ends of two encodings are merged along equal-work pieces of their merge path."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm.common import HOT_KEYS, map_batches, split_join, texts_of, written
from riskweave.llm.token_counts import segments, sentence_model

#: Ends that one piece merges.
WORK = 1 << 16
#: Characters of texts that are encoded and merged together.
GROUP_CHARS = 1 << 20
#: Characters from which on a long text is encoded in segments.
SEGMENT_CHARS = 1 << 14
#: The rank encoder's time grows with the square of a run; texts with longer ones go to the other library.
LONG_RUN = 512
BLANK_RUN = re.compile(r"\s{%d}" % LONG_RUN)
FIRST_SPACE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_COUNTS = "n_a long, n_b long, n_groups long, n_links long"
ENCODED = f"row long, doc_id long, {_COUNTS}, groups_sha256 string, pairs array<int>, times array<int>"
GROUPS = "row long, doc_id long, nth long, start long, stop long, a_ids array<int>, b_ids array<int>"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoders:
    """Both tokenizers, and the bytes of each of their tokens.

    ``ranks``: the byte-level vocabulary as a rank file, which gives the same ids in a quarter of the time.
    """

    def __init__(self, a_path: str, b_path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(alphabet[x] for x in token) if all(x in alphabet for x in token) else token.encode()
        self.ranked = None
        if ranks:
            with open(ranks, "rb") as file:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.b, self.pairs_of, self.splittable = sentence_model(b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = BYTE_PIECE.fullmatch(piece) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(FIRST_SPACE, " ").encode())
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << 31:
            raise ValueError("the vocabularies have too many pairs of ids")
        self.names = [f"{i}{end}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n)
                      for end in (",", last)]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.ranked is None or max(map(len, text.split()), default=0) >= LONG_RUN or BLANK_RUN.search(text):
                slow.append(i)
            else:
                out[i] = self.ranked.encode_ordinary(text)
        if slow:
            for i, found in zip(slow, self.a.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = found.ids
        return out

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        size = SEGMENT_CHARS if self.splittable else 1 << 62
        parts, owners = [], []
        for i, text in enumerate(texts):
            cut = segments(text, size, self.pairs_of)
            parts += cut
            owners += [i] * len(cut)
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in zip(owners, self.b.encode(parts, num_threads=1) if parts else [], strict=True):
            out[i] += ids
        return out


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str, ranks: str | None) -> Encoders:
    return Encoders(a_path, b_path, ranks)


def cuts(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where every ``work``-th diagonal crosses the merge path of two sorted arrays: how many of each lie before it.

    Equal values of ``a`` come before those of ``b``. All diagonals are searched at once, each by bisection.
    """
    diagonal = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(diagonal), bool)
        first[open_] = a[middle[open_]] <= b[diagonal[open_] - middle[open_] - 1]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, diagonal - low


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of two rows of tokens that cover the same bytes, given by their increasing ends.

    Returns the links as (token of ``a``, token of ``b``), and which ends of ``a`` and of ``b`` are common. Each distinct end closes
    one overlap, so there are as many links as distinct ends. A piece needs only its own stretch of both rows, but for an
    end of ``b`` that is also the last end of ``a`` in the piece before: there the border is stitched.
    """
    i, j = cuts(a, b, work)
    left, right, common = [], [], []
    for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:], strict=False):
        own_a, own_b = a[i0:i1], b[j0:j1]
        left.append(np.arange(i0, i1))
        right.append(j0 + np.searchsorted(own_b, own_a, "left"))
        over = i0 + np.searchsorted(own_a, own_b, "right")
        same = (over > 0) & (a[over - 1] == own_b)
        common.append(same)
        left.append(over[~same])
        right.append(np.arange(j0, j1)[~same])
    if not left:
        none = np.empty(0, np.int64)
        return none, none, none.astype(bool), none.astype(bool)
    shared = np.concatenate(common)
    ends = np.zeros(len(a), bool)
    ends[np.searchsorted(a, b[shared])] = True
    return np.concatenate(left), np.concatenate(right), ends, shared


class Aligned:
    """The alignment of the texts of one call, as arrays over all of their tokens; ``which[i]`` is the text of the i-th kept one."""

    def __init__(self, use: Encoders, texts: list[str], work: int):
        wanted = [i for i, t in enumerate(texts) if t]
        shown = [" " + texts[i] for i in wanted]
        raw = [t.encode() for t in shown]
        self.which, a, b = [], [], []
        for i, ids_a, ids_b, want in zip(wanted, use.encode_a(shown), use.encode_b([texts[i] for i in wanted]), raw, strict=True):
            if b"".join([use.a_bytes[x] for x in ids_a]) == want == b"".join([use.b_bytes[x] for x in ids_b]):
                self.which.append(i)
                a.append(ids_a)
                b.append(ids_b)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate(ids) if ids else np.empty(0, np.int64) for ids in
                          ([np.array(x, np.int64) for x in a], [np.array(x, np.int64) for x in b]))
        self.a_ends, self.b_ends = np.cumsum(use.a_lengths[self.a]), np.cumsum(use.b_lengths[self.b])
        self.left, self.right, self.a_common, self.b_common = merged(self.a_ends, self.b_ends, work)
        self.a_group = np.cumsum(self.a_common) - self.a_common
        self.b_group = np.cumsum(self.b_common) - self.b_common
        self.groups = int(self.a_common.sum())
        self.text_of_a = np.repeat(np.arange(len(self.which)), self.n_a)  # an end of a text is a common one, so no group or link leaves it
        self.n_groups = np.bincount(self.text_of_a[self.a_common], minlength=len(self.which))

    def digests(self, use: Encoders) -> list[str]:
        in_a, in_b = np.bincount(self.a_group, minlength=self.groups), np.bincount(self.b_group, minlength=self.groups)
        names = np.empty(len(self.a) + len(self.b), np.int64)
        names[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.a_group]] = self.a * 2 + self.a_common
        names[np.arange(len(self.b)) + np.cumsum(in_a)[self.b_group]] = (len(use.a_bytes) + self.b) * 2 + self.b_common
        out, begin = [], 0
        for end in np.cumsum(self.n_a + self.n_b).tolist():
            written_out = "".join([use.names[x] for x in names[begin:end].tolist()])
            out.append(hashlib.sha256(written_out[:-1].encode()).hexdigest())
            begin = end
        return out

    def pairs(self, use: Encoders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids, links) for the distinct pairs of each text, in order."""
        total = len(use.a_bytes) * len(use.b_bytes)
        key = self.text_of_a[self.left] * total + self.a[self.left] * len(use.b_bytes) + self.b[self.right]
        key, times = np.unique(key, return_counts=True)
        return key // total, key % total, times


def _paths(a_path: str | None, b_path: str | None, ranks: str | None) -> tuple[str, str, str | None]:
    if a_path is None:
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"), ranks


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows whose texts have about ``GROUP_CHARS`` characters together."""
    for batch in batches:
        texts, begin = texts_of(batch.column("text")), 0
        while begin < len(texts):
            end, weight = begin, 0
            while end < len(texts) and weight < GROUP_CHARS:
                weight += len(texts[end])
                end += 1
            yield batch.slice(begin, end - begin), texts[begin:end]
            begin = end


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def groups(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, ranks: str | None = None,
           work: int = WORK) -> DataFrame:
    """The alignment itself: a row per group of tokens between two byte offsets at which tokens of both encodings end.

    ``row`` tells rows of one doc_id apart, ``nth`` counts the groups of a text from 0, ``start`` and ``stop`` are bytes of one space
    and the text. Texts without tokens (see ``aligned``) have no groups.
    """
    paths = _paths(a_path, b_path, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoders(*paths)
        for batch, texts in _calls(batches):
            x = Aligned(use, texts, work)
            if not x.groups:
                continue
            text = x.text_of_a[x.a_common]
            first = np.cumsum(x.n_groups) - x.n_groups
            stops = x.a_ends[x.a_common]
            starts = np.r_[0, stops[:-1]]
            base = starts[first][text]
            at = pa.array(np.array(x.which)[text])
            in_a, in_b = np.bincount(x.a_group, minlength=x.groups), np.bincount(x.b_group, minlength=x.groups)
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                     for n, ids in ((in_a, x.a), (in_b, x.b))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(np.arange(x.groups) - first[text]),
                 pa.array(starts - base), pa.array(stops - base), *lists],
                names=["row", "doc_id", "nth", "start", "stop", "a_ids", "b_ids"])

    return map_batches(_rows(documents), run, GROUPS)


def encoded(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, ranks: str | None = None,
            work: int = WORK) -> DataFrame:
    """Per row: counts, the digest of its groups, and its distinct linked id pairs with the number of their links."""
    paths = _paths(a_path, b_path, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoders(*paths)
        for batch, texts in _calls(batches):
            x = Aligned(use, texts, work)

            def spread(values: np.ndarray) -> np.ndarray:
                out = np.zeros(len(texts), np.int64)  # noqa: B023
                out[x.which] = values  # noqa: B023
                return out

            digests = [""] * len(texts)
            for i, digest in zip(x.which, x.digests(use), strict=True):
                digests[i] = digest
            text, pair, times = x.pairs(use)
            sizes = spread(np.bincount(text, minlength=len(x.which)))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            n_links = spread(np.bincount(x.text_of_a[x.left], minlength=len(x.which)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *[pa.array(v) for v in (
                    spread(x.n_a), spread(x.n_b), spread(x.n_groups), n_links)], pa.array(digests),
                 pa.ListArray.from_arrays(offsets, pa.array(pair.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return map_batches(_rows(documents), run, ENCODED)


def aligned(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, ranks: str | None = None,
            hot: int = HOT_KEYS, work: int = WORK) -> DataFrame:
    """One row per row of ``documents``: how its tokens in two vocabularies line up, and how common its linked id pairs are.

    ``doc_id``; ``n_a``, ``n_b`` tokens; ``n_groups`` between common byte ends; ``n_links`` pairs of tokens that overlap; ``n_best`` links whose
    id pair is, corpus-wide, the most frequent of its A id (ties included); ``count_sum`` over links of the number of documents that
    hold the pair; ``groups_sha256`` of the groups written out. Null and empty texts, and those whose tokens don't give the bytes of
    one space and the text, have no tokens: zeros and an empty digest. Repeated rows are documents of their own; null ids
    stay; other columns are ignored; an empty table gives an empty result.

    Texts are encoded once and written with their distinct pairs. Pair counts are summed before the shuffle. Those that make up
    one in ``hot`` of all rows (so at most ``hot``) are broadcast, so that the others can be joined without a hot key.
    """
    table, _ = written(encoded(documents, a_path, b_path, ranks, work), "alignments")
    a_of = F.floor(F.col("pair") / encoders(*_paths(a_path, b_path, ranks)).b.get_piece_size()).cast("int")
    counts, _ = written(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    most = counts.groupBy(a_of.alias("a")).agg(F.max("n").alias("most"))  # one row per id of the vocabulary
    valued = counts.withColumn("a", a_of).join(F.broadcast(most), "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    rows = table.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    told = split_join(rows, valued, "pair", "n", hot).groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("s"), F.sum(F.when(F.col("best"), F.col("times"))).alias("b"))
    return table.drop("pairs", "times").join(told, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("b", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("s", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
