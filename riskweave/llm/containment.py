"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Held, map_batches, row_column, salted_join, text_hash, texts_of, whole_row, written

WORDS = re.compile(r"\w+").findall
#: Runs between blanks held by a worker, twice over at most (bounds memory, never changes a result).
HELD_WORDS = 250_000
#: Bits of the filter that says which signatures the items have: 4 MB, whatever the number of items.
FILTER_BITS = 25
#: Characters of texts that are searched together.
GROUP_CHARS = 1 << 20
#: Items of fewer shingles are looked for by all of their shingles.
DIRECT = 8
_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 1 << 63, 96, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(0, 1 << 63, 96, dtype=np.uint64)


def words_of(text: str) -> list[str]:
    return WORDS(text.lower())


def shingles(text: str, shingle: int = 5) -> set[tuple[str, ...]]:
    """Distinct word shingles; the whole sequence if it is shorter; none without a word."""
    words = words_of(text)
    return {tuple(words[i:i + shingle]) for i in range(max(len(words) - shingle, 0) + 1)} if words else set()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """64-bit hashes of the words and shingles of a text, in order."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.runs = Held(lambda run: b"".join([xxhash.xxh3_64_digest(w.encode()) for w in words_of(run)]), HELD_WORDS)

    def words(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.runs.__getitem__, text.split())), ">u8").astype(np.uint64)

    def grams(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, filled up to a shingle."""
        total = max(len(words) - size + 1, 0)
        out = np.zeros(total, np.uint64)
        for i in range(self.shingle):
            out = out * np.uint64(0xD6E8FEB86659FD93)
            if i < size:
                out += words[i:i + total]
        return _mixed(out)

    def __call__(self, text: str) -> np.ndarray:
        words = self.words(text)
        return self.grams(words, min(len(words), self.shingle))


def signature(kind: int, which: int | np.ndarray, values: np.ndarray) -> np.ndarray:
    """One number for (size class, permutation, minimum)."""
    return _mixed(values ^ (np.uint64(kind) << np.uint64(56)) ^ (np.asarray(which, np.uint64) << np.uint64(48)))


def size_class(total: int) -> int:
    """Items of 2**e up to 2**(e+1) - 1 shingles are class e; class 0 holds all below ``DIRECT``."""
    return 0 if total < DIRECT else total.bit_length() - 1


def item_signatures(hashes: np.ndarray, permutations: int) -> tuple[int, np.ndarray]:
    kind = size_class(len(hashes))
    if kind == 0:
        return kind, np.unique(signature(0, 0, hashes))
    least = [(hashes * _FACTORS[i] + _ADDENDS[i]).min() for i in range(permutations)]
    return kind, signature(kind, np.arange(permutations), np.array(least, np.uint64))


def window_signatures(texts: list[np.ndarray], short: list[list[np.ndarray]], kinds: list[int], permutations: int,
                      known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) for the signatures of the texts' shingle hashes that the filter ``known`` lets through.

    ``short``: for each length of an item shorter than a shingle, the hashes of the texts' runs of so many words.

    For class e a text is cut into blocks of 2**e shingles, and each three neighbouring blocks are a window: an occurrence
    of an item of the class lies inside one of them, and makes up a third of it or more. Blocks of a class are pairs of
    those of the class below, so only the smallest class reads the shingles. All texts of a call are one array, each filled
    up to whole blocks; a window over a border counts for the texts on both sides (it is only a proposal).
    """
    rows: list[np.ndarray] = []
    found: list[np.ndarray] = []

    def passed(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        place = values >> np.uint64(64 - FILTER_BITS)
        hit = np.flatnonzero(known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
        begin, many = first[hit], last[hit] - first[hit] + 1
        while len(hit):
            rows.append(begin)
            found.append(values[hit])
            more = many > 1
            hit, begin, many = hit[more], begin[more] + 1, many[more] - 1

    for runs in short:
        each = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
        passed(signature(0, 0, np.concatenate(runs)), each, each)
    sized = sorted(k for k in kinds if k)
    low = sized[0] if sized else 0
    own = [i for i, x in enumerate(texts) if len(x)]
    if own:
        sizes = np.array([len(texts[i]) for i in own])
        blocks_of = -(-sizes >> low) if low else sizes
        full = blocks_of << low
        ends = np.cumsum(full)
        text = np.repeat(own, blocks_of)
        hashes = np.concatenate([texts[i] for i in own])
        if 0 in kinds:
            each = np.repeat(own, sizes)
            passed(signature(0, 0, hashes), each, each)
        if sized:  # the last shingle of a text is repeated up to the end of its last block
            place = np.minimum(np.arange(ends[-1]) - np.repeat(ends - full, full), np.repeat(sizes - 1, full))
            hashes = hashes[place + np.repeat(np.cumsum(sizes) - sizes, full)].reshape(-1, 1 << low)
            for i in range(permutations):
                blocks, first, last = (hashes * _FACTORS[i] + _ADDENDS[i]).min(axis=1), text, text
                for kind in range(low, sized[-1] + 1):
                    if kind in sized:
                        padded = np.r_[blocks, blocks[-1:], blocks[-1:]]
                        windows = np.minimum(np.minimum(padded[:-2], padded[1:-1]), padded[2:])
                        passed(signature(kind, i, windows), first, np.r_[last[2:], last[-1:], last[-1:]][:len(first)])
                    if len(blocks) % 2:
                        blocks, first, last = np.r_[blocks, blocks[-1:]], np.r_[first, first[-1:]], np.r_[last, last[-1:]]
                    blocks, first, last = np.minimum(blocks[::2], blocks[1::2]), first[::2], last[1::2]
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(found)], axis=1), axis=0)
    return pairs[:, 0].astype(np.int64), pairs[:, 1]


def contaminated(documents: DataFrame, items: DataFrame, shingle: int = 5, least: float = 0.8,
                 permutations: int = 32, least_words: int = 3) -> DataFrame:
    """(document, item) pairs with at least ``least`` of the item's distinct shingles in the whole document.

    Columns ``doc_id``, ``row_hash``, ``item_id``, ``n_shared``, ``n_shingles``, ``containment``. The MinHash windows only
    propose pairs; all of their shingles are then compared as words. An item that stands in a document in one stretch is
    missed with a chance of at most (2/3)**permutations as a whole, (3/4)**permutations (1e-4) at four fifths of its shingles; items of
    fewer than ``DIRECT`` shingles never. An item of fewer words than a shingle is one shingle, itself: from ``least_words`` on it
    is found inside any text, below that only as a whole text, for one or two words are no passage. Null texts, texts and
    items without a word and items without an id take no part; repeated rows give equal rows once; an empty table on
    either side gives an empty result.
    """
    spark = documents.sparkSession
    listed = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                if len(hashes := hasher(text)):
                    kind, values = item_signatures(hashes, permutations)
                    n = min(len(hasher.words(text)), shingle)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(values), pa.int64()), pa.array([kind] * len(values), pa.int32()),
                         pa.array([n] * len(values), pa.int32()), pa.array(values.view(np.int64))],
                        names=["item_id", "kind", "n_words", "signature"])

    wanted, _ = written(map_batches(listed, signed, "item_id long, kind int, n_words int, signature long"), "item-signatures")
    kinds = sorted(r["kind"] for r in wanted.select("kind").distinct().collect())  # 64 at most
    lengths = sorted(r["n_words"] for r in wanted.select("n_words").where(
        F.col("n_words").between(least_words, shingle - 1)).distinct().collect())
    place = F.shiftrightunsigned("signature", 64 - FILTER_BITS)
    bits = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(signature, {64 - FILTER_BITS}) & 63 as int)))").alias("bits")).collect()
    known = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in bits:  # at most 2**19 words
        known[row["word"]] = row["bits"]
    sent = spark.sparkContext.broadcast(known.view(np.uint64))  # 4 MB

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lookup = Hasher(shingle), sent.value
        for batch in batches:
            texts, begin = texts_of(batch.column("text")), 0
            while begin < len(texts):  # texts of about a million characters together
                end, weight = begin, 0
                while end < len(texts) and weight < GROUP_CHARS:
                    weight += len(texts[end])
                    end += 1
                words = [hasher.words(t) for t in texts[begin:end]]
                rows, values = window_signatures(
                    [hasher.grams(w, min(len(w), shingle)) for w in words],
                    [[hasher.grams(w, n) for w in words] for n in lengths], kinds, permutations, lookup)
                at = pa.array(rows + begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("row_hash").take(at), pa.array(values.view(np.int64))],
                    names=["doc_id", "row_hash", "signature"])
                begin = end

    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", text_hash().alias("row_hash"))
    hits, _ = written(map_batches(texts, searched, "doc_id long, row_hash long, signature long"), "hits")
    here = F.struct("doc_id", "row_hash")  # a passage may stand in a third of all documents
    proposed, _ = written(salted_join(hits, wanted.select("signature", "item_id"), "signature", here).select(
        "doc_id", "row_hash", "item_id").distinct(), "proposed")
    asked = salted_join(proposed, listed.withColumnRenamed("text", "item_text"), "item_id", here)
    of = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row_hash").alias("of")
    once = texts.select(of, "doc_id", "row_hash", "text").dropDuplicates(["of"]).join(proposed.select(of).distinct(), "of", "left_semi")
    none = F.lit(None)
    both = once.select("of", "doc_id", "row_hash", "text", none.cast("long").alias("item_id"), none.cast("string").alias("item_text")).unionAll(
        asked.select(of, "doc_id", "row_hash", none.cast("string").alias("text"), "item_id", "item_text"))
    # a document comes first, then its items one by one
    sorted_ = both.repartition("of").sortWithinPartitions("of", F.col("item_id").asc_nulls_first())

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: set[tuple[str, ...]] = set()
        words: list[str] = []
        for batch in batches:
            found = []
            for doc, row_hash, text, item, item_text in zip(*(batch.column(c).to_pylist() for c in (
                    "doc_id", "row_hash", "text", "item_id", "item_text")), strict=True):
                if item is None:
                    words, have = words_of(text), shingles(text, shingle)
                    continue
                want = shingles(item_text, shingle)
                shared = len(want & have)
                if not shared and len(want) == 1 and least_words <= (n := len(next(iter(want)))) < shingle:
                    shared = int(next(iter(want)) in zip(*(words[i:] for i in range(n)), strict=False))
                if shared and shared >= least * len(want) - 1e-9:
                    found.append((doc, row_hash, item, shared, len(want), shared / len(want)))
            names = ["doc_id", "row_hash", "item_id", "n_shared", "n_shingles", "containment"]
            kinds_of = [pa.int64()] * 5 + [pa.float64()]
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)], names=names)

    return map_batches(sorted_.select("doc_id", "row_hash", "text", "item_id", "item_text"), verified,
                       "doc_id long, row_hash long, item_id long, n_shared long, n_shingles long, containment double").distinct()


def decontaminated(documents: DataFrame, items: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of ``documents`` that hold no item; all columns stay as they are."""
    bad = contaminated(documents, items, shingle, least).select("doc_id", "row_hash").distinct()
    rows = documents.select(whole_row(documents).alias("row"), F.col("doc_id").alias("row_id"), text_hash().alias("row_text"))
    return rows.join(bad, rows["row_id"].eqNullSafe(bad["doc_id"]) & (rows["row_text"] == bad["row_hash"]), "left_anti").select(
        *[row_column(c).alias(c) for c in documents.columns])
