"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick in folded texts and normalised by length."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_batches, texts_of, written

# Letters of other scripts that look like a Latin one.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁԛԝһӏαβεηικνορτυχωϲ", "abekmhopctyxijsdqwhlabenikvoptuxwc", strict=True))
# Signs written for letters, inside words only.
SUBSTITUTES = dict(zip("0134578@$!|+", "oieastbasiit", strict=True))
# Terms assumed where labels say nothing of them, and phrases in which terms are meant otherwise.
SEEDS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "scum", "trash", "loser", "worthless", "pathetic",
         "disgusting", "clown", "jerk", "bastard", "dummkopf", "vollidiot", "arschloch", "imbécile", "connard", "crétin",
         "estúpido", "imbécil", "gilipollas")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum", "dumb terminal", "jerk chicken")
#: Weight of a seed that the labels neither bear out nor refute.
SEED_WEIGHT = 3.0
#: Chance that any term is taken by luck.
LUCK = 0.01
#: Letters of the word beginnings that are tried as terms beside whole words.
STEMS = range(4, 13)
#: A term that continues another must weigh so much more.
FINER = 0.7
#: Documents that must hold a term or an exception.
LEAST_DOCS = 3
#: Labels come from texts without a model; these say what a match is worth then.
DEFAULT_FIT = (-3.0, 1.0, 2.0)

LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[0134578@$!|+]")
MIXED = re.compile(r"[\w@$!|+]*[0134578@$!|+][\w@$!|+]*")
LETTER = re.compile(r"[^\W\d_]")
TRAILING = re.compile(r"[!|+@$]+$")


def _fold_table() -> dict[int, str | None]:
    """One character each: accents off, styled forms and homoglyphs to Latin letters, l to i (one look), marks that don't show removed."""
    table: dict[int, str | None] = {}
    for point in range(0x80, sys.maxunicode + 1):
        x = chr(point)
        kind = unicodedata.category(x)
        if kind in ("Mn", "Cf"):
            table[point] = None
            continue
        if kind[0] in "LNS" and kind != "Lo":  # letters, and signs that show a letter
            base = [c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn"]
            if len(base) == 1:
                low = base[0].lower()
                low = HOMOGLYPHS.get(low, low)
                if low != x and len(low) == 1:
                    table[point] = "i" if low == "l" else low
    table |= {ord(x): "i" if y == "l" else y for x, y in HOMOGLYPHS.items()}
    return table | {ord("l"): "i"}


FOLDED = str.maketrans(_fold_table())
_SIGN_TABLE = str.maketrans(SUBSTITUTES)


def _spelled(match: re.Match) -> str:
    run = match[0]
    if not LETTER.search(run):
        return run
    end = TRAILING.search(run)  # punctuation behind a word
    cut = end.start() if end and LETTER.search(run[:end.start()]) else len(run)
    return run[:cut].translate(_SIGN_TABLE) + run[cut:]


def folded(text: str) -> list[str]:
    """The words of a text as the lexicon spells them."""
    plain = text.lower().translate(FOLDED)
    if SIGNS.search(plain):
        plain = MIXED.sub(_spelled, plain)
    return LETTERS.findall(plain)


@dataclass(frozen=True)
class Lexicon:
    """Folded terms with weights (whole words or phrases end in a blank, other terms are word beginnings), folded exception
    phrases, and the fit from weight and length to a probability."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    fit: tuple[float, float, float] = DEFAULT_FIT

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, ""))
        for term, weight in self.weights.items():
            if term.rstrip() not in self.exceptions:
                found.add_word(f" {term}", (len(term) + 1, weight, term))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matched(automaton: ahocorasick.Automaton | None, words: list[str]) -> list[tuple[str, float]]:
    """Terms in a text with their weights, from the left, the longest first; none inside an exception phrase."""
    if automaton is None or not words:
        return []
    hits = []
    for end, (size, weight, term) in automaton.iter(f" {' '.join(words)} "):
        begin = end - size + 2
        hits.append((begin, begin + len(term.rstrip()) if term else end, weight, term))
    spared = [(begin, end) for begin, end, _, term in hits if not term]
    out, last = [], 0
    for begin, end, weight, term in sorted(hits, key=lambda x: (x[0], -x[1], -len(x[3]))):
        if term and begin >= last and not any(b <= begin and end <= e for b, e in spared):
            out.append((term, weight))
            last = end
    return out


def features(total: float, words: int | np.ndarray) -> np.ndarray:
    """A text's matched weight as it is and by length, both damped."""
    return np.stack([np.ones_like(total, np.float64), np.log1p(total), np.log1p(100 * total / (words + 20.0))], axis=-1)


def fitted(total: np.ndarray, words: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge; more matched weight never lowers a score."""
    if not len(labels) or labels.min() == labels.max():
        return DEFAULT_FIT
    x = features(total, words)
    used = np.array([True, True, True])
    beta = np.zeros(3)
    for _ in range(3):
        z = x[:, used]
        beta = np.zeros(used.sum())
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            ridge = np.full(len(beta), 0.05)
            slope = z.T @ (weights * (labels - p)) - ridge * beta
            bend = (z * (weights * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(bend, slope)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        full = np.zeros(3)
        full[used] = beta
        if (full[1:] >= 0).all():
            return tuple(full.tolist())
        used[1:] &= full[1:] > 0
    return (float(full[0]), max(float(full[1]), 0.0), max(float(full[2]), 0.0))


def entries(word: str) -> list[str]:
    """The terms that a word may be taken by: its beginnings and itself."""
    return [*(word[:k] for k in STEMS if k <= len(word)), f"{word} "]


def _around(words: list[str], i: int) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words[max(i - 2, 0):i + 3])) >> 1


def _candidates(words: list[str]) -> Iterator[tuple[str, int, int]]:
    """Each term of a text with the hash of what is around its first occurrence and the number of occurrences."""
    first: dict[str, int] = {}
    times: Counter = Counter()
    for word, n in Counter(words).items():
        for entry in entries(word):
            times[entry] += n
    for i, word in enumerate(words):
        if f"{word} " not in first:
            around = _around(words, i)
            for entry in entries(word):
                first.setdefault(entry, around)
    return ((entry, first[entry], n) for entry, n in times.items())


def _phrases(words: list[str], terms: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """Phrases of two words, one of them taken by a term, in the same form."""
    first: dict[str, int] = {}
    times: Counter = Counter()
    for i, word in enumerate(words):
        if not terms.isdisjoint(entries(word)):
            for pair in (words[i - 1:i + 1] if i else [], words[i:i + 2]):
                if len(pair) == 2:
                    phrase = " ".join(pair)
                    times[phrase] += 1
                    if phrase not in first:
                        first[phrase] = _around(words, i)
    return ((phrase, first[phrase], n) for phrase, n in times.items())


def chosen_terms(rows: list[tuple[str, int, int, float]], most: int) -> dict[str, float]:
    """Terms with weights from (term, labelled and other contexts, weight).

    Of terms in the same contexts the longest stays, and a term that continues another only if it weighs ``FINER`` more.
    """
    out: dict[str, float] = {}
    longest: dict[tuple[str, int, int], str] = {}
    by_length = sorted(rows, key=lambda r: len(r[0]))
    for term, bad, good, _ in by_length:
        for k in STEMS:  # whoever begins this term in the same contexts is not needed
            if k < len(term):
                longest[term[:k], bad, good] = term
    for term, bad, good, weight in by_length:
        if (term, bad, good) in longest:
            continue
        above = max((k for k in STEMS if k < len(term) and term[:k] in out), default=None)
        if above is None or weight > out[term[:above]] + FINER:
            out[term] = weight
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:most])


def sample(documents: DataFrame, labels: DataFrame, label: str, learnable: Column, rows: int) -> DataFrame:
    """``doc_id``, ``text``, ``label``, ``weight``: per label at most ``rows`` learnable documents with a text, those of the smallest
    hashes of their ids; ``weight`` brings back the labels' shares. Ids with several labels count as the greatest."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        (F.max(label) > 0).cast("int").alias("label")).where(learnable)
    totals = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    parts = [told.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(
        "doc_id", "label", F.lit(max(totals.get(x, 0) / rows, 1.0)).alias("weight")) for x in (0, 1)]
    chosen = parts[0].unionAll(parts[1])  # at most 2 * rows ids
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id")


def learned(documents: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", rows: int = 2000,
            most_terms: int = 20_000, seeds: tuple[str, ...] = SEEDS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled documents of either label.

    A word or a word beginning becomes a term if more of the documents that hold it are labelled than chance allows over all that
    were tried; its weight is the log of the ratio of its shares of all words. Documents that say the same around it (copies) count
    once. A phrase of a term and a neighbour becomes an exception if it is no more frequent in labelled documents than in others.
    """
    chosen, _ = written(sample(documents, labels, label, learnable, rows), "labelled")
    texts = chosen.select("text", "label")

    def emitted(told_of) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, is_bad in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                    found = list(told_of(folded(text)))
                    if found:
                        terms, around, times = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(terms, pa.string()), pa.array(around, pa.int64()), pa.array(times, pa.int64()),
                             pa.array([is_bad] * len(found), pa.int32())], names=["term", "around", "times", "label"])

        each = map_batches(texts, run, "term string, around long, times long, label int")
        contexts = each.groupBy("term", "label", "around").agg(F.sum("times").alias("times"))

        def of(value: Column, kind: int) -> Column:
            return F.sum(F.when(F.col("label") == kind, value).otherwise(0))

        return contexts.groupBy("term").agg(
            of(F.lit(1), 1).alias("bad"), of(F.lit(1), 0).alias("good"), of(F.col("times"), 1).alias("bad_times"),
            of(F.col("times"), 0).alias("good_times")).where(F.col("bad") + F.col("good") >= LEAST_DOCS)

    sizes = measured(chosen.select("doc_id", "text", "label"), Lexicon({}, frozenset()), ["label"]).where("n_words > 0").groupBy(
        "label").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).collect()
    n_bad, words_bad, n_good, words_good = (
        next((r[c] for r in sizes if r["label"] == kind), 0) for kind in (1, 0) for c in ("n", "words"))

    def weight(row) -> float:
        return math.log((row["bad_times"] + 0.5) / (words_bad + 1) / ((row["good_times"] + 0.5) / (words_good + 1)))

    weights: dict[str, float] = {}
    refuted: set[str] = set()
    wanted = {" ".join(folded(x)) + " " for x in seeds}
    if n_bad and n_good:
        share = n_bad / (n_bad + n_good)
        known, _ = written(emitted(_candidates), "terms")
        tried = max(known.count(), 1)
        part = F.col("bad") + F.col("good")
        odds = F.col("bad") / part
        chance = part * (F.when(odds > 0, odds * F.log(odds / share)).otherwise(0.0)
                         + F.when(odds < 1, (1 - odds) * F.log((1 - odds) / (1 - share))).otherwise(0.0))
        sure = known.where((odds > share) & (F.col("bad") >= LEAST_DOCS) & (chance >= math.log(tried / LUCK)))
        taken = sure.orderBy(F.desc(chance), "term").limit(8 * most_terms).collect()
        weights = chosen_terms([(r["term"], r["bad"], r["good"], weight(r)) for r in taken if weight(r) >= 1], most_terms)
        refuted = {r["term"] for r in known.where(F.col("term").isin(sorted(wanted))).collect() if weight(r) <= 0}
    for term in wanted - refuted:
        if weights.keys().isdisjoint(entries(term[:-1])):
            weights[term] = SEED_WEIGHT
    spared = {" ".join(folded(x)) for x in exceptions}
    if n_bad and n_good:
        terms = frozenset(weights)
        spared |= {r["term"] for r in emitted(lambda words: _phrases(words, terms)).where(F.col("good") >= LEAST_DOCS).collect()
                   if weight(r) <= 0}
    found = Lexicon(weights, frozenset(spared))
    rated = measured(chosen, found, ["label", "weight"]).select("total", "n_words", "label", "weight").collect()  # 2 * rows, and repeats
    columns = np.array([tuple(r) for r in rated], np.float64).reshape(-1, 4).T
    return Lexicon(weights, found.exceptions, fitted(*columns))


def measured(documents: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """``total`` matched weight, ``n_words``, ``score`` and ``terms`` (with their numbers) of each whole text, beside doc_id and ``keep``."""
    keep = keep or []
    sent = documents.sparkSession.sparkContext.broadcast(lexicon)  # bounded by ``most_terms``, seeds and exceptions
    names = ["doc_id", *keep]
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, beta = sent.value.automaton(), np.array(sent.value.fit)
        for batch in batches:
            total, size, terms = [], [], []
            for text in texts_of(batch.column("text")):
                words = folded(text)
                hits = matched(automaton, words)
                total.append(sum(w for _, w in hits))
                size.append(len(words))
                terms.append(sorted(Counter(t for t, _ in hits).items()))
            totals, sizes = np.array(total, np.float64), np.array(size, np.int64)
            score = 1 / (1 + np.exp(-np.clip(features(totals, sizes) @ beta, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(totals), pa.array(sizes), pa.array(score),
                 pa.array(terms, pa.map_(pa.string(), pa.int64()))], names=[*names, "total", "n_words", "score", "terms"])

    return map_batches(documents.select(*names, "text"), run,
                       f"{kinds}, total double, n_words long, score double, terms map<string,bigint>")


def scored(documents: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, rows: int = 2000,
           seeds: tuple[str, ...] = SEEDS, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``held_out``, ``score`` (probability of the label), ``predicted``, ``terms``.

    Held out are ids whose crc32 is a multiple of ``fold``; nothing is learned from them or from rows without an id (held out, too).
    Null, empty and wordless texts get the score of a text without a match; repeated rows stay; other columns are ignored; an empty
    table gives an empty result. Without labels of both kinds the seeds and a default fit are used.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold
    lexicon = learned(documents, labels, remainder != 0, label, rows, seeds=seeds, exceptions=exceptions)
    return measured(documents, lexicon).select(
        "doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "terms")
