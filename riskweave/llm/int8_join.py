"""Nearest neighbours by cosine: int8 product tiles with error bounds, survivors recomputed, heaps merged."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_batches

CODES = 127
#: Covers the rounding of the bounds themselves, which are computed in double precision.
SLACK = 1e-9


def usable(column: str) -> Column:
    """Vectors that take part: not null, not empty, all components finite, some component not zero."""
    value = F.col(column)
    return value.isNotNull() & (F.size(value) > 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)


class Coded:
    """Unit vectors as int8 codes times a scale, with the length of what the codes leave out."""

    def __init__(self, vectors: np.ndarray):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / norms[:, None]
        self.scale = np.abs(unit).max(axis=1) / CODES
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        shown = self.codes * self.scale[:, None]
        self.shown = np.sqrt((shown * shown).sum(axis=1))
        self.left = np.sqrt(((unit - shown) ** 2).sum(axis=1))


def tile(a: Coded, b: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of all rows of a against all of b, and a bound of each estimate's error.

    The products are whole numbers below 2**53, so the float units compute them exactly; with
    x = x' + e and y = y' + f the error |x'f + ey'+ ef| is at most |x'||f| + |e|(|y'| + |f|).
    """
    kind = np.float32 if a.codes.shape[1] * CODES * CODES < 1 << 24 else np.float64
    products = a.codes.astype(kind) @ b.codes.astype(kind).T
    value = products.astype(np.float64) * a.scale[:, None] * b.scale[None, :]
    error = a.shown[:, None] * b.left[None, :] + a.left[:, None] * (b.shown + b.left)[None, :] + SLACK
    return value, error


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that their largest component is about one and no square overflows or vanishes.

    A cosine does not change by it, not even in its last bit: only components below 10**-300 of the largest are lost.
    """
    _, powers = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -powers[:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair, in double precision, summed component by component so equal vectors score equally."""
    dot, of_a, of_b = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        dot += x * y
        of_a += x * x
        of_b += y * y
    return np.clip(dot / np.sqrt(of_a * of_b), -1.0, 1.0)


def nearest_in_tile(q_ids: np.ndarray, q: np.ndarray, q_coded: Coded, c_ids: np.ndarray, c: np.ndarray, k: int,
                    heaps: dict[int, list], chunk: int = 1 << 16) -> None:
    """Pushes into each query's heap of (score, -vec_id) those of the tile that can be among its k nearest."""
    value, error = tile(q_coded, Coded(c))
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, value - error)
    floor = np.full(len(q_ids), -np.inf)
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    held = np.array([heaps[i][0][0] if len(heaps.setdefault(i, [])) == k else -np.inf for i in range(len(q_ids))])
    rows, cols = np.nonzero((value + error >= np.maximum(floor, held)[:, None]) & ~own)
    for begin in range(0, len(rows), chunk):
        r, s = rows[begin:begin + chunk], cols[begin:begin + chunk]
        for i, entry in zip(r.tolist(), zip(cosines(q[r], c[s]).tolist(), (-c_ids[s]).tolist(), strict=True), strict=True):
            heap = heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tile_rows: int = 4096, query_rows: int = 512,
            shards: int | None = None, block_bytes: int = 1 << 26) -> DataFrame:
    """The ``k`` nearest other rows of each query row by cosine: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    ``vectors`` has ``vec_id`` and ``embedding``; rows with a null id or a vector that is null, empty, zero or holds null or
    non-finite components take no part; vectors are compared with those of their own length only. Ties go to the smaller
    ``vec_id``; of rows that repeat an id with equal vectors one counts, with other vectors each counts; "own row" means equal
    id. Queries are dealt into blocks of about ``block_bytes``, candidates into ``shards``; each block meets each shard once,
    in tiles of ``query_rows`` by ``tile_rows``, and leaves k rows per query. A task so holds one block of queries, one tile
    and their heaps, and a candidate is sent once per block: with 64 components, once per 131,072 queries. Exact: the error bounds keep every row that may be among the k nearest.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & usable("embedding")).withColumn("dim", F.size("embedding"))
    shards = shards or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    queries = rows.where(is_query).dropDuplicates(["vec_id", "embedding"])
    size = queries.agg(F.coalesce(F.sum("dim"), F.lit(0)).alias("n")).first()["n"] * 8
    blocks_of = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64(F.lit(7), F.col("vec_id")), F.lit(blocks_of)).cast("int")
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    offered = rows.dropDuplicates(["vec_id", "embedding"]).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks_of - 1))).alias("block"), shard.alias("shard"), "dim",
        F.lit(1).alias("side"), "vec_id", "embedding")
    asked = queries.select(
        block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim",
        F.lit(0).alias("side"), "vec_id", "embedding")
    dealt = offered.union(asked).repartition("block", "shard").sortWithinPartitions("block", "shard", "dim", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
            """Runs of one (block, shard, dim, side), ``tile_rows`` rows at most."""
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("block", "shard", "dim", "side")], axis=1)
                ids = batch.column("vec_id").to_numpy()
                flat, offsets = batch.column("embedding").flatten().to_numpy(), np.r_[0, np.cumsum(keys[:, 2])]
                ends = np.r_[np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(ids)]
                begin = 0
                for end in ends.tolist():
                    for at in range(begin, end, tile_rows):
                        to = min(end, at + tile_rows)
                        yield tuple(keys[at]), ids[at:to], scaled(flat[offsets[at]:offsets[to]].reshape(to - at, -1))
                    begin = end

        def out(asks: list, heaps: list) -> Iterator[pa.RecordBatch]:
            for (ids, _, _), heap in zip(asks, heaps, strict=True):
                found = [(int(ids[i]), -v, s) for i, entries in heap.items() for s, v in entries]
                if found:
                    query, vec, score = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
                        names=["query_id", "vec_id", "score"])

        at, asks, heaps = None, [], []
        for key, ids, values in blocks():
            if key[:3] != at:
                yield from out(asks, heaps)
                at, asks, heaps = key[:3], [], []
            if key[3] == 0:
                for begin in range(0, len(ids), query_rows):
                    part = values[begin:begin + query_rows]
                    asks.append((ids[begin:begin + query_rows], part, Coded(part)))
                    heaps.append({})
            else:
                for (q_ids, q, coded), heap in zip(asks, heaps, strict=True):
                    nearest_in_tile(q_ids, q, coded, ids, values, k, heap)
        yield from out(asks, heaps)

    found = map_batches(dealt, run, "query_id long, vec_id long, score double")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []  # the best so far of the last query, whose rows may go on in the next batch

        def told(rows: list) -> Iterator[tuple]:
            for rank, (score, vec) in enumerate(sorted(rows, reverse=True), 1):
                yield query, rank, -vec, score

        for batch in batches:
            done: list[tuple] = []
            for q, vec, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != query:
                    done.extend(told(heap))
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
            yield _ranked(done)
        yield _ranked(list(told(heap)))

    dealt_back = found.repartition("query_id").sortWithinPartitions("query_id")
    return map_batches(dealt_back, merged, "query_id long, rank int, vec_id long, score double")


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                                      names=["query_id", "rank", "vec_id", "score"])
