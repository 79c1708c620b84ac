"""Best-fit packing planned over the histogram of lengths; documents take the planned slots by rank within their length."""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from riskweave.llm.common import Held, map_batches, takes_over, text_hash, texts_of, written

#: Words held by a worker, twice over at most (bounds memory, never changes a result).
HELD_WORDS = 250_000
#: The pre-tokenizer's pattern, as in the vocabulary file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: In these characters lower-casing and composing depend on no neighbour.
PLAIN = regex.compile("[\x21-\x7e\xa1-\xff]*")


class Encoder:
    """Ids (little-endian 32-bit) of whole texts by a tokenizer that drops white space: each run of other characters is
    encoded once and remembered.

    The file drops white space before it merges and no merge crosses it, so the ids of a text are those of its runs in
    turn. Within a run of plain characters, the parts that the file's own pattern separates are looked up on their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.separate = regex.compile(PRETOKEN).findall
        self.parts = Held(self._part, HELD_WORDS)
        self.runs = Held(self._run, HELD_WORDS)

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(part if part.isascii() else part.translate(self.shown))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        if "<|" in run or not PLAIN.fullmatch(run):  # special strings, other scripts
            ids = self.tokenizer.encode(run, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        run = run.lower()
        if run.isalpha():
            return self.parts[run]
        return b"".join([self.parts[p] for p in self.separate(run)])

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(documents: DataFrame, path: str | None = None, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (then id 0): ``doc_id``, ``row_hash``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    Documents of more than ``size`` ids are cut into pieces of ``size``, the last may be shorter. ``with_ids`` adds ``ids``.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("packing", encoder.cache_clear)
        encode = encoder(path).ids
        for batch in batches:
            owner, piece, length, crc, kept = [], [], [], [], []
            for row, text in enumerate(texts_of(batch.column("text"))):
                ids = encode(text) + bytes(4)
                for n, begin in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[begin:begin + 4 * size]
                    owner.append(row)
                    piece.append(n)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<i4"))
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())),
                       batch.column("row_hash").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(np.array(piece, np.int64) * size), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "row_hash", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, row_hash long, piece int, start long, length long, ids_crc32 long"
    return map_batches(documents.select("doc_id", "text", text_hash().alias("row_hash")), run,
                       schema + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Best fit, longest first, over counts: runs (first rank, first sequence, places per sequence, offset, count) by length.

    All open sequences with the same room left and successive numbers are one run, so the work grows with the number of
    lengths and runs, not with the number of documents. The fullest sequence that a length fits takes as many as it holds.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, number of sequences)
    rooms: list[int] = []
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequences = 0

    def add(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank, runs = histogram[length], 0, []
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            else:
                room, first, many = size, sequences, -(-left // (size // length))
                sequences += many
            each = room // length
            full = min(many, left // each)
            if full:
                runs.append((rank, first, each, size - room, full * each))
                add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = many - full
            if left and rest:  # fewer than one sequence's worth
                runs.append((rank, first + full, left, size - room, left))
                add(room - left * length, first + full, 1)
                rank, left, rest, full = rank + left, 0, rest - 1, full + 1
            add(room, first + full, rest)
        slots[length] = runs
    return slots


def packed(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a *written* table of pieces with a ``length`` column of 1 to ``size``.

    Ranks are dealt in shares of each length (by hash, as many as there are shuffle partitions), so a length that most rows
    have is ranked by all tasks; the driver sees the histogram (``size`` counts at most), the shares' counts stay in Spark.
    """
    shares = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("doc_id", "row_hash", "piece"), F.lit(shares)).cast("int")
    rows = cut.withColumn("_share", share)
    counted = rows.groupBy("length", "_share").count()
    before = counted.select("length", "_share", (F.sum("count").over(
        Window.partitionBy("length").orderBy("_share")) - F.col("count")).alias("_before"))
    order = Window.partitionBy("length", "_share").orderBy("doc_id", "row_hash", "piece")
    ranked = rows.withColumn("_own", F.row_number().over(order) - 1).join(before, ["length", "_share"]).withColumn(
        "_rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_share")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = {length: np.array(runs, np.int64) for length, runs in plan(histogram, size).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                runs = planned[length]
                at = runs[np.searchsorted(runs[:, 0], ranks[own], side="right") - 1]
                nth = ranks[own] - at[:, 0]
                sequence[own] = at[:, 1] + nth // at[:, 2]
                offset[own] = at[:, 3] + nth % at[:, 2] * length
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return map_batches(ranked.select(*cut.columns, "_rank"), run, schema)


def pack(documents: DataFrame, path: str | None = None, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens; one row per piece, gapless offsets from 0.

    Columns of ``pieces`` and ``sequence_id``, ``offset``. A null or empty text is the one id 0; repeated rows and null ids are
    packed like others; other columns are ignored; an empty table gives an empty result.
    """
    cut, _ = written(pieces(documents, path, size, with_ids), "pieces")
    return packed(cut, size)
