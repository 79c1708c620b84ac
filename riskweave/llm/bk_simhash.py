"""SimHash near-duplicates: fingerprints, BK-trees over shards of equal 16-bit blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_batches, removed, row_column, split_join, text_hash, texts_of, whole_row, written

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 if it has no word."""
    words = text.encode().lower().split()  # bytes: ASCII only, and exactly x20 and x09-x0D split words
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        total = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for begin in range(0, total, CHUNK):
        size = min(CHUNK, total - begin)
        hashes = np.fromiter((digest(next(grams), SEED) for _ in range(size)), np.uint64, size)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``row_hash`` (tells texts of one id apart), ``fp`` (the fingerprint's 64 bits as a long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in texts_of(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(values.view(np.int64))],
                names=["doc_id", "row_hash", "fp"])

    rows = documents.select("doc_id", "text", text_hash().alias("row_hash"))
    return map_batches(rows, run, "doc_id long, row_hash long, fp long")


class Forest:
    """BK-trees of several shards at once: a child's key is its integer Hamming distance to its parent.

    ``values`` are distinct within a shard; ``shards`` is sorted. Built and searched level by level, all trees together.
    """

    def __init__(self, values: np.ndarray, shards: np.ndarray):
        self.values = values
        n = len(values)
        first = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if n else np.empty(0, np.int64)
        self.shard_ids, self.roots = shards[first], first
        node = np.repeat(first, np.diff(np.r_[first, n]))
        pending = np.setdiff1d(np.arange(n), first, assume_unique=True)
        node = node[pending]
        edges, children = [], []
        while len(pending):
            edge = node * 65 + np.bitwise_count(values[pending] ^ values[node])
            key, at, which = np.unique(edge, return_index=True, return_inverse=True)
            child = pending[at]  # the first row of each new edge becomes its node; the others go down
            edges.append(key)
            children.append(child)
            node = child[which]
            rest = pending != node
            pending, node = pending[rest], node[rest]
        edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        order = np.argsort(edge)
        self.edges = edge[order]
        self.children = np.concatenate(children)[order] if edges else edge

    def root_of(self, shards: np.ndarray) -> np.ndarray:
        """Each shard's root, -1 without a tree."""
        if not len(self.roots):
            return np.full(len(shards), -1)
        at = np.minimum(np.searchsorted(self.shard_ids, shards), len(self.roots) - 1)
        return np.where(self.shard_ids[at] == shards, self.roots[at], -1)

    def search(self, queries: np.ndarray, shards: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) for all values within ``radius``; follows only edges whose key is within it of the distance."""
        node = self.root_of(shards)
        query = np.flatnonzero(node >= 0)
        node = node[query]
        found_q, found_n = [], []
        while len(query):
            far = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            hit = far <= radius
            found_q.append(query[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.edges, node * 65 + np.maximum(far - radius, 0))
            many = np.searchsorted(self.edges, node * 65 + np.minimum(far + radius, 64), side="right") - low
            query = np.repeat(query, many)
            node = self.children[np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
        if not found_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_n)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the links a-b."""
    names, ends = np.unique(np.r_[a, b], return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            break
    apart = label != np.arange(len(names))
    return names[apart], names[label[apart]]


def _searched(radius: int, work: int):
    """Links inside each (route, low, high) group: a tree of side 0, asked by side 1, or by itself if low = high."""
    def links(group: np.ndarray, side: np.ndarray, value: np.ndarray, same: np.ndarray):
        order = np.lexsort((side, group))
        group, side, value, same = group[order], side[order], value[order], same[order]
        planted = side == 0
        forest = Forest(value[planted], group[planted])
        asks = ~planted | same
        queries, shards = value[asks], group[asks]
        sizes = np.diff(np.r_[forest.roots, planted.sum()])
        root = forest.root_of(shards)
        load = np.zeros(len(shards), np.int64)
        load[root >= 0] = sizes[np.searchsorted(forest.roots, root[root >= 0])]
        cuts = np.flatnonzero(np.diff(np.cumsum(load) // work, prepend=0))
        for q, s in zip(np.split(queries, cuts), np.split(shards, cuts), strict=True):
            if len(q):
                ask, node = forest.search(q, s, radius)
                a, b = q[ask], forest.values[node]
                apart = a != b
                if apart.any():
                    yield spanning(a[apart], b[apart])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            names = [rows.column(c).to_numpy() for c in ("route", "low", "high", "side", "fp")]
            route, low, high, side, fp = names
            _, group = np.unique(np.stack([route, low, high], axis=1), axis=0, return_inverse=True)
            for a, b in links(group.reshape(-1), side, fp.view(np.uint64), low == high):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:  # sorted by group: whole groups are handed on, the last one waits for its rest
            held.append(pa.Table.from_batches([batch]))
            rows = pa.concat_tables(held)
            if len(rows) < work // 16:
                continue
            keys = np.stack([rows.column(c).to_numpy() for c in ("route", "low", "high")], axis=1)
            border = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(border):
                yield from out(rows.slice(0, border[-1] + 1))
                rows = rows.slice(border[-1] + 1)
            held = [rows]
        if held and sum(map(len, held)):
            yield from out(pa.concat_tables(held))

    return run


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of ``radius + 1`` stretches of the 64 bits: values within the radius agree on one of them."""
    ends = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return [(low, high - low) for low, high in zip(ends, ends[1:], strict=False)]


def links(values: DataFrame, radius: int = 3, shard: int = 8192, work: int = 1 << 22) -> DataFrame:
    """Links (a, b) whose components are those of all distinct fingerprints ``fp`` within ``radius`` bits.

    Fingerprints within the radius agree on one block, so each block value is a shard of its own. A shard of more than
    ``shard`` values is dealt into chunks by hash; every pair of chunks meets once, a tree of one asked by the other, so
    no task holds more than two chunks, whatever the size of the group. ``work`` bounds query times tree size of a call.
    """
    at = blocks(radius)
    routed = values.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1).alias("part"))
        for i, (low, width) in enumerate(at)])).alias("r")).select(
        "fp", (F.col("r.part") * len(at) + F.col("r.block")).alias("route"))
    sizes = routed.groupBy("route").count().where(F.col("count") > 1).select(
        "route", F.ceil(F.col("count") / shard).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = routed.join(sizes, "route").select("route", "fp", chunk.alias("own"), F.explode(
        F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "route", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") != F.least("own", "other")).cast("int").alias("side"), "fp")
    dealt = pairs.repartition("route", "low", "high").sortWithinPartitions("route", "low", "high")
    return map_batches(dealt, _searched(radius, work), "a long, b long")


def components(pairs: DataFrame, rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, root) stars of the components of links (a, b): alternating large and small stars, each round written.

    Sides with many links are only ever aggregated (min), never gathered.
    """
    spark = pairs.sparkSession
    edges, path = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before: tuple | None = None

    def with_least(links: DataFrame) -> DataFrame:  # a node may have a third of all links
        low, _ = written(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        return split_join(links, low, "a")

    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        large, between = written(with_least(both).where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "large-stars")
        small = with_least(large).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select(
            "e.a", "e.b").where(F.col("a") != F.col("b")).distinct()
        edges, newer = written(small, "stars")
        removed(spark, path)
        removed(spark, between)
        path = newer
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")), path
        before = now
    raise RuntimeError("the links did not settle")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def grouped(documents: DataFrame, shingle: int = 3, radius: int = 3, shard: int = 8192) -> DataFrame:
    """``doc_id``, ``row_hash``, ``fp``, the group's ``root`` (a fingerprint) and its smallest doc_id, per row."""
    prints, _ = written(fingerprints(documents, shingle), "fingerprints")
    values, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "values")
    stars, _ = components(links(values.select("fp"), radius, shard))
    of = values.join(stars, values.fp == stars.node, "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    of, _ = written(of, "roots")
    named, _ = written(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "groups")
    told, _ = written(split_join(of.drop("n"), named, "root").drop("n").join(values.select("fp", "n"), "fp").select(
        "fp", "n", "root", "component_id"), "told")
    return split_join(prints, told, "fp").drop("n")  # all empty texts, or all copies of one, share a fingerprint


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = 3, shard: int = 8192) -> DataFrame:
    """Per row of ``documents``: ``doc_id``, ``fingerprint`` (hex), ``component_id``, ``row_hash``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing bits, the row itself
    included. Null and empty texts have fingerprint zero and link like any other; rows without an id join groups but name
    none; repeated rows stay and share a group; an empty table gives an empty result; other columns are ignored.
    """
    return grouped(documents, shingle, radius, shard).select(
        "doc_id", hex_digits("fp").alias("fingerprint"), "component_id", "row_hash")


def one_of_each(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Rows of ``documents`` without near-duplicates: of each group the row with the smallest doc_id stays.

    Of rows that repeat this id, the one with the smallest text hash stays, once; a group in which no row has an id keeps one.
    """
    key = ["none", "id", "text_hash"]
    parts = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    groups = grouped(documents, shingle, radius).select("root", *parts, F.col("row_hash").alias("text_hash"))
    keep = groups.groupBy("root").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    rows = documents.select(whole_row(documents).alias("row"), *parts, text_hash().alias("text_hash"))
    once = rows.dropDuplicates(key)  # before the join: repeated rows of one key are summed where they are read
    return once.join(keep, key, "left_semi").select(*[row_column(c).alias(c) for c in documents.columns])
