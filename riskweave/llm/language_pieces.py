"""Language ID by segmentation-marginalised unigrams over the pieces of a fixed public vocabulary."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_batches, row_column, takes_over, text_parts, whole_row

UNDETERMINED = "und"
#: Probability of a character that no piece of the vocabulary holds, in every language.
UNSEEN = 1e-9
#: Words held by a worker (bounds memory, never changes a result).
HELD_WORDS = 400_000
#: Characters of texts whose words are looked up together.
GROUP_CHARS = 1 << 20
#: Above this many characters the forward sums are rescaled as they go.
LONG_WORD = 30
#: Words times languages that are learned from together.
LEARNED_SUMS = 80_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[str, ...]:
    """The normal pieces of a sentencepiece model, lower-cased and once each."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(dict.fromkeys(
        model.id_to_piece(i).lower() for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))))


class Lattice:
    """Finds the pieces of the vocabulary in words: a prefix tree in arrays, walked from all characters at once."""

    def __init__(self, pieces: tuple[str, ...]):
        node = {"": 0}
        for piece in pieces:
            for i in range(1, len(piece) + 1):
                node.setdefault(piece[:i], len(node))
        self.unseen = len(pieces)
        self.piece = np.full(len(node), -1)
        self.piece[[node[p] for p in pieces]] = np.arange(len(pieces))
        keys = np.array([node[x[:-1]] * 0x110000 + ord(x[-1]) for x in node if x], np.uint64)
        self.mask = np.uint64((1 << (4 * len(keys)).bit_length()) - 1)
        self.keys = np.full(int(self.mask) + 1, ~np.uint64(0))
        self.values = np.zeros(int(self.mask) + 1, np.int64)
        left, at, self.probes = np.arange(len(keys)), self._slots(keys), 0
        while len(left):  # open addressing: who finds its slot taken tries the next
            slot = at[left]
            free = self.keys[slot] == ~np.uint64(0)
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], left[put] + 1
            left = left[~put]
            at[left] = (at[left] + 1) & int(self.mask)
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) & self.mask).astype(np.int64)

    def children(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The child of each node by its character, 0 where there is none."""
        keys = nodes.astype(np.uint64) * np.uint64(0x110000) + characters.astype(np.uint64)
        slot = self._slots(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], 0)
        open_ = np.flatnonzero((out == 0) & (self.keys[slot] != ~np.uint64(0)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            found = self.keys[slot[open_]]
            out[open_] = np.where(found == keys[open_], self.values[slot[open_]], 0)
            open_ = open_[(found != keys[open_]) & (found != ~np.uint64(0))]
        return out

    def edges(self, words: list[str]) -> np.ndarray:
        """Rows (word, begin, end, piece) of all pieces in all words; a character in no piece gets an edge of its own."""
        characters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(characters)) - (ends - sizes)[word]
        found = []
        alive, node, step = np.arange(len(characters)), np.zeros(len(characters), np.int64), 0
        while len(alive):
            node = self.children(node, characters[alive + step])
            piece = self.piece[node]
            if step == 0:
                piece = np.where(piece < 0, self.unseen, piece)
            hit = piece >= 0
            at = alive[hit]
            found.append(np.stack([word[at], place[at], place[at] + step + 1, piece[hit]], axis=1))
            step += 1
            on = (node > 0) & (place[alive] + step < sizes[word[alive]])
            alive, node = alive[on], node[on]
        return np.concatenate(found) if found else np.empty((0, 4), np.int64)


def sums(edges: np.ndarray, words: int, longest: int, rows: np.ndarray) -> np.ndarray:
    """Forward sums over all segmentations: word x place x language. Places are filled in order, all words at once."""
    out = np.zeros((words, longest + 1, rows.shape[1]))
    out[:, 0] = 1.0
    edges = edges[np.argsort(edges[:, 2] * words + edges[:, 0], kind="stable")]
    places = edges[:, 2]
    cuts = np.r_[np.flatnonzero(np.r_[True, places[1:] != places[:-1]]), len(places)]
    for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        word, place = edges[at:to, 0], int(places[at])
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        parts = out[word, edges[at:to, 1]] * rows[edges[at:to, 3]]
        out[word[first], place] = np.add.reduceat(parts, first, axis=0)
    return out


class Pieces:
    """Piece probabilities by language, with the sums over all segmentations of words."""

    def __init__(self, pieces: tuple[str, ...], rows: np.ndarray):
        """``rows``: probabilities, one row per piece and one column per language."""
        self.lattice = Lattice(pieces)
        self.rows = np.vstack([rows, np.full((1, rows.shape[1]), UNSEEN)])

    def logs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (marked with its leading blank) in each language."""
        out = np.empty((len(words), self.rows.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for at in range(0, len(short), 20_000):
            part = short[at:at + 20_000]
            of = [words[i] for i in part]
            ends = np.array([len(w) for w in of])
            ahead = sums(self.lattice.edges(of), len(of), int(ends.max()), self.rows)
            out[part] = np.log(ahead[np.arange(len(of)), ends])
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[i] = self.long(word)
        return out

    def long(self, word: str) -> np.ndarray:
        """As ``logs``, place by place and rescaled, in memory that grows with the word only."""
        ahead = np.zeros((len(word) + 1, self.rows.shape[1]))
        ahead[0] = 1.0
        taken = 0.0
        for size in range(0, len(word), 4096):  # the edges of one stretch at a time; pieces may reach past its end
            near = self.lattice.edges([word[size:size + 4096 + 64]])
            for _, i, j, piece in sorted(near[near[:, 1] < 4096].tolist()):
                i, j = i + size, j + size
                if (top := ahead[i].max()) < 1e-100:
                    ahead[i:i + 64] /= top
                    taken += math.log(top)
                ahead[j] += ahead[i] * self.rows[piece]
        return np.log(np.maximum(ahead[-1], 1e-300)) + taken


def words_of(text: str) -> list[str]:
    return text.lower().split()


def stretches(word: str) -> list[str]:
    """The marked word in stretches of at most ``LONG_WORD`` characters, whose sums need no rescaling."""
    marked = "▁" + word
    return [marked[i:i + LONG_WORD] for i in range(0, len(marked), LONG_WORD)]


def learned(counts: dict[tuple[str, str], int], languages: list[str], path: str, rounds: int = 3,
            smoothing: float = 0.05) -> np.ndarray:
    """Piece probabilities (pieces x languages) by EM: expected counts of pieces over all segmentations of the words.

    Words of ``LONG_WORD`` characters or more are learned from in stretches; they are scored whole, like others.
    """
    pieces = vocabulary(path)
    column = {x: i for i, x in enumerate(languages)}
    words = sorted({x for _, w in counts for x in stretches(w)})
    place = {w: i for i, w in enumerate(words)}
    many = np.zeros((len(words), len(languages)))
    for (language, word), n in counts.items():
        for x in stretches(word):
            many[place[x], column[language]] += n
    rows = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    rows[-1] = UNSEEN
    lattice = Lattice(pieces)
    block = max(1, LEARNED_SUMS // len(languages))
    for _ in range(rounds):
        expected = np.full(rows.shape, smoothing)
        for at in range(0, len(words), block):  # edges are found anew, so that memory does not grow with the words
            of = words[at:at + block]
            ends, edges = np.array([len(w) for w in of]), lattice.edges(of)
            own = np.arange(len(ends))
            ahead = sums(edges, len(ends), int(ends.max()), rows)
            turned = edges.copy()  # places counted from each word's end, so that all ends are place 0
            turned[:, 1], turned[:, 2] = ends[edges[:, 0]] - edges[:, 2], ends[edges[:, 0]] - edges[:, 1]
            behind = sums(turned, len(ends), int(ends.max()), rows)
            weight = many[at:at + len(ends)] / ahead[own, ends]
            w = edges[:, 0]
            share = ahead[w, edges[:, 1]] * rows[edges[:, 3]] * behind[w, turned[:, 1]] * weight[w]
            np.add.at(expected, edges[:, 3], share)
        rows[:-1] = expected[:-1] / expected[:-1].sum(axis=0)
    return rows[:-1]


def held_out(column: str = "doc_id") -> Column:
    """Documents that are kept from learning: crc32 of the id as text leaves 2 on division by 4. Not those without id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled_words(labelled: DataFrame, sample: int) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Word counts by language of about ``sample`` rows per language; all words of these rows."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}, []
    part = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30))
    below = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample / n) * (1 << 30))))])
    chosen = labelled.where(part < below[F.col("lang")])
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word != ''")
    rows = words.groupBy("lang", "word").count().collect()
    return {(r["lang"], r["word"]): r["count"] for r in rows}, sorted(sizes)


class Model:
    """What the tasks need; each worker keeps the scores of words it has met."""

    _held: dict[str, tuple[Pieces, dict[str, bytes]]] = {}

    def __init__(self, path: str, languages: list[str], rows: np.ndarray):
        self.path, self.languages, self.rows, self.name = path, languages, rows, uuid.uuid4().hex

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Log probability of each text (a list of words) in each language."""
        if self.name not in Model._held:
            Model._held.clear()
            Model._held[self.name] = Pieces(vocabulary(self.path), self.rows), {}
        pieces, held = Model._held[self.name]
        out = np.zeros((len(texts), len(self.languages)))
        words = [w for text in texts for w in text]
        owner = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
        for at in range(0, len(words), HELD_WORDS):
            part = words[at:at + HELD_WORDS]
            missing = [w for w in dict.fromkeys(part) if w not in held]
            if len(held) + len(missing) > HELD_WORDS and held:
                held.clear()
                missing = list(dict.fromkeys(part))
            if missing:
                found = pieces.logs(["▁" + w for w in missing])
                held.update(zip(missing, map(np.ndarray.tobytes, found), strict=True))
            both = np.frombuffer(b"".join(map(held.__getitem__, part))).reshape(-1, len(self.languages))
            rows, first = np.unique(owner[at:at + HELD_WORDS], return_index=True)
            out[rows] += np.add.reduceat(both, first, axis=0)
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and posterior of each text; texts are scored in groups of about a million characters."""
        found: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if self.languages and any(c.isalpha() for c in t)]
        groups, weight = [[]], 0
        for i in asked:
            if weight > GROUP_CHARS:
                groups.append([])
                weight = 0
            groups[-1].append(i)
            weight += len(texts[i])
        for group in groups:
            for i, total in zip(group, self.scores([words_of(texts[i]) for i in group]), strict=True):
                best = int(total.argmax())
                found[i] = self.languages[best], float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum())
        return found


def fit(documents: DataFrame, path: str | None = None, sample: int = 200) -> Model:
    """Learns from the text and non-null lang of rows that ``held_out`` leaves. Bound: ``sample`` rows per language (about,
    chosen by a hash of the id), with all of their words."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    labelled = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                               & ~held_out()).select("doc_id", "lang", "text")
    counts, languages = sampled_words(labelled, sample)
    return Model(path, languages, learned(counts, languages, path) if languages else np.empty((0, 0)))


def predictions(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (posterior of the language with equal priors).

    Every word of the whole text counts. ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.
    Ties go to the first language by name; repeated rows and null ids stay; an empty table gives an empty result.
    """
    model = model or fit(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded: vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("language", Model._held.clear)
        for batch in batches:
            for part, texts in text_parts(batch, batch.column("text"), GROUP_CHARS):
                found = sent.value.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([x[0] for x in found], pa.string()),
                     pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(documents.select("doc_id", held_out().alias("held_out"), "text"), run,
                       "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(known: Model, batch: pa.RecordBatch, column: pa.Array, least: float) -> Iterator[pa.RecordBatch]:
    """The rows of a batch whose text (of ``column``) has a language, about a million bytes of texts at a time."""
    for part, texts in text_parts(batch, column, GROUP_CHARS):
        if known.languages:
            keep = [found[0] != UNDETERMINED and found[1] >= least for found in known.predict(texts)]
        else:
            keep = [any(c.isalpha() for c in t) for t in texts]
        yield part.filter(pa.array(keep, pa.bool_()))


def identified(documents: DataFrame, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """Rows of ``documents`` with a language: rejects texts that are null or hold no letter, and scores below ``least``.

    If no row has a label, only texts without a letter go. All columns stay as they are.
    """
    model = model or fit(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    # the text goes to the worker and back once, inside its row
    names = documents.columns
    place = names.index("text") if "text" in names else [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("language", Model._held.clear)
        known = sent.value
        for batch in batches:
            yield from accepted(known, batch, batch.column("row").field(place), least)

    rows = documents.select(whole_row(documents).alias("row"))
    return map_batches(rows, run, rows.schema).select(*[row_column(c).alias(c) for c in names])
