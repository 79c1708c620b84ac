"""Spelling variants by permuterm rotations: words one edit apart share a prefix that skips the edited character."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_batches, removed, written

#: Ends a word; no word holds it.
MARK = "$"
LETTERS = r"a-z\x{C0}-\x{FF}"
NEAR = "word string, n_near long, best_n long, best string"


def words(documents: DataFrame, least_length: int = 7, least: int = 2, every: int | None = 31) -> DataFrame:
    """``word``, ``n``: maximal letter runs of whole texts, A-Z lower-cased, of ``least_length`` code points and ``least`` occurrences.

    With ``every``, a run loses a code point where that number divides the checksum of id and run, which gives a corpus known
    typos. A null id counts as an empty one there. Null texts have no words; repeated rows count each. Runs that are too short
    are not even extracted, and occurrences are summed before the shuffle, so a frequent word is one row per task.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    owner = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    # the checksum is told once, inside the array: behind the explode it would be told again at each use
    each = F.transform(runs, lambda run: F.struct(run.alias("run"), F.crc32(F.concat(owner, run)).alias("told")))
    rows = documents.where(F.col("text").isNotNull()).select(F.explode(each).alias("r")).select("r.run", "r.told")
    at = (F.col("told") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.col("run") if every is None else F.when(F.col("told") % every == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= least)


def rotations(vocabulary: DataFrame) -> DataFrame:
    """All rotations of the marked words, cut before the character that an edit would touch: ``prefix``, ``edited``, ``opens``, ``n``.

    A rotation ``xyz$vw`` gives the prefix ``xyz$v`` with the edited character ``w`` (it is replaced, or left out of the longer
    word) and, whole, the prefix ``xyz$vw`` with an empty one (the shorter word, to which a character is added). ``opens``
    tells the first of a run of equal characters: leaving out any of them gives one word, which counts once.
    """
    word, size = F.col("word"), F.length("word")
    turned = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    tail = F.concat(F.substring(word, F.col("i") + 1, size), F.lit(MARK))
    before = F.substring(word, F.col("i"), F.lit(1))  # the character in front of the place, none at 0
    whole = F.struct(F.concat(tail, F.substring(word, F.lit(1), F.col("i"))).alias("prefix"), F.lit("").alias("edited"),
                     F.lit(False).alias("opens"))
    cut = F.struct(F.concat(tail, F.substring(word, F.lit(1), F.col("i") - 1)).alias("prefix"), before.alias("edited"),
                   ((F.col("i") == 1) | (before != F.substring(word, F.col("i") - 1, F.lit(1)))).alias("opens"))
    both = F.when(F.col("i") == 0, F.array(whole)).otherwise(F.array(whole, cut))
    return turned.select(F.explode(both).alias("r"), "n").select("r.*", "n")


def word_of(rotation: str) -> str:
    tail, head = rotation.split(MARK)
    return head + tail


def summed(rows: list[tuple[str, str, bool, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the best of them, the best) for each member of one prefix's rows that has a near word here.

    Members with an edited character are near one another; the whole rotation is near those of them that open a run.
    The best has the largest n, then comes first by code points. A prefix has at most one row for each letter, and one.
    """
    ranked = sorted((-n, word_of(prefix + edited), edited, opens) for prefix, edited, opens, n in rows)
    whole = next((r for r in ranked if not r[2]), None)
    others = [r for r in ranked if r[2]]
    opening = [r for r in others if r[3]]
    if whole and opening:
        yield whole[1], len(opening), -opening[0][0], opening[0][1]
    for r in others:
        near = len(others) - 1
        best = [x for x in others[:2] if x is not r][:1]
        if whole and r[3]:
            near += 1
            best.append(whole)
        if near:
            top = min(best)
            yield r[1], near, -top[0], top[1]


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """For each word (of distinct ``word``, ``n``) with words exactly one edit apart: how many, and the best of them.

    Columns ``word``, ``n_near``, ``best_n``, ``best``. Rotations are sorted by prefix, and each prefix is a range of neighbouring
    rows, at most one for each letter of the alphabet and one more, so no group grows with the data. A replacement meets
    under one prefix only, a left-out character under that of the first of its run, so no near word counts twice.
    """
    dealt = rotations(vocabulary).repartition("prefix").sortWithinPartitions("prefix")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the last prefix, which may go on in the next batch

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              names=["word", "n_near", "best_n", "best"])

        for batch in batches:
            found: list[tuple] = []
            prefixes = batch.column("prefix")
            equal = pc.equal(prefixes[1:], prefixes[:-1]).to_numpy(zero_copy_only=False)
            shared = np.r_[True, equal] | np.r_[equal, True]  # rows alone under their prefix go, but for the two at the ends
            batch = batch.filter(pa.array(shared))
            rows = zip(*(batch.column(c).to_pylist() for c in ("prefix", "edited", "opens", "n")), strict=True)
            for prefix, group in groupby(rows, lambda r: r[0]):
                if held and held[0][0] == prefix:
                    held.extend(group)
                    continue
                if len(held) > 1:
                    found.extend(summed(held))
                held = list(group)
            if found:
                yield out(found)
        if len(held) > 1:
            yield out(list(summed(held)))

    parts = map_batches(dealt.select("prefix", "edited", "opens", "n"), scanned, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(``word``, ``root``): where following the links (``word``, ``form``) ends. Each round doubles the steps and is written."""
    spark = links.sparkSession
    now, path = written(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        hop = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(hop, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step, newer = written(moved, "forms")
        removed(spark, path)
        path, now = newer, step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(documents: DataFrame, ratio: int = 10, least_length: int = 7, least: int = 2, every: int | None = 31) -> DataFrame:
    """The words of all texts with the spelling that each is a variant of.

    ``word``, ``n``, ``n_near`` (words exactly one inserted, deleted or replaced code point away), ``form`` (the near word of largest
    n, ties by code points, if its n is ``ratio`` times the word's or more, else null), ``form_n``, ``root`` (the last of the chain
    of forms; the word itself without one). Chains end, for n grows at each step. Null, empty and wordless texts give nothing;
    repeated rows count each; other columns are ignored; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("a form must occur more often than its variants")
    vocabulary, _ = written(words(documents, least_length, least, every), "words")
    joined = vocabulary.join(neighbours(vocabulary), "word", "left")
    near = F.col("best_n") >= ratio * F.col("n")
    told, _ = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(near, F.col("best")).alias("form"),
        F.when(near, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(told.where(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
