"""Chat formatting as prefix trees: shared first turns once, depth first, with position ids and ancestor attention."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm.common import map_batches

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
#: Places are (tree, start, stop) or (tree, segment): a row goes on where the one before it stopped, so both may lie in an earlier row.
TREES = ("task int, tree long, tokens array<int>, position_ids array<int>, "
         "segments array<struct<start:int,stop:int,parent_tree:long,parent:int,loss_start:int,loss_stop:int,"
         "attends:array<struct<tree:long,start:int,stop:int>>>>, "
         "conversations array<struct<conv_id:long,tree:long,segment:int>>")
_SPAN = pa.struct([("tree", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_KINDS = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([
    ("start", pa.int32()), ("stop", pa.int32()), ("parent_tree", pa.int64()), ("parent", pa.int32()), ("loss_start", pa.int32()),
    ("loss_stop", pa.int32()), ("attends", pa.list_(_SPAN))])),
    pa.list_(pa.struct([("conv_id", pa.int64()), ("tree", pa.int64()), ("segment", pa.int32())]))]
_NAMES = ["task", "tree", "tokens", "position_ids", "segments", "conversations"]


def escaped(text: str) -> str:
    """Takes the meaning from control strings: each ``<|`` gets a backslash inside, as do those that have some already."""
    return CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def header(role: str) -> str:
    """A role on one line."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(line.removesuffix("\n")))


class Codec:
    """Turns to ids and back; the marks have ids of their own behind the vocabulary, which no text can give."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.start = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end = self.start + 1
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def encode(self, turns: list[tuple[str, str]]) -> list[tuple[list[int], int, int]]:
        """Per turn: ids, and where those of its text begin and end."""
        parts = [x for role, text in turns for x in (header(role), escaped(text))]
        ids = [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
        out = []
        for head, body in zip(ids[::2], ids[1::2], strict=True):
            begin = 1 + len(head)
            out.append(([self.start, *head, *body, self.end, *self.newline], begin, begin + len(body)))
        return out

    def decode(self, ids: list[int]) -> str:
        """Formatted text of any ids."""
        out, begin = [], 0
        for at in [i for i, x in enumerate(ids) if x >= self.start] + [len(ids)]:
            out.append(self.tokenizer.decode(ids[begin:at], skip_special_tokens=False))
            if at < len(ids):
                out.append(START if ids[at] == self.start else END)
            begin = at + 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


class Node:
    """A turn on the path to the last conversation: where its tokens are, and those that it attends to."""

    __slots__ = ("turn", "tree", "segment", "attends", "depth")

    def __init__(self, turn: tuple[str, str], tree: int, segment: int, attends: list[dict], depth: int):
        self.turn, self.tree, self.segment, self.attends, self.depth = turn, tree, segment, attends, depth


class Forest:
    """The turns of a task's conversations as prefix trees in depth-first order, cut into rows.

    A new row goes on below the path of the one before, whose turns it names but does not repeat.
    """

    def __init__(self, task: int):
        self.task, self.tree = task, -1
        self.path: list[Node] = []
        self.begin()

    def begin(self) -> None:
        self.tree += 1
        self.tokens, self.positions, self.segments, self.conversations = [], [], [], []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n].turn == turns[n]:
            n += 1
        return n

    def grow(self, turn: tuple[str, str], encoded: tuple[list[int], int, int]) -> None:
        """Adds a turn below the path."""
        ids, begin, end = encoded
        above = self.path[-1] if self.path else None
        start, depth = len(self.tokens), above.depth if above else 0
        own = turn[0] == "assistant"
        self.tokens.extend(ids)
        self.positions.extend(range(depth, depth + len(ids)))
        self.segments.append({
            "start": start, "stop": start + len(ids), "parent_tree": above.tree if above else -1, "parent": above.segment if above else -1,
            "loss_start": start + (begin if own else 0), "loss_stop": start + (end if own else 0), "attends": above.attends if above else []})
        attends = list(above.attends) if above else []
        if attends and attends[-1]["tree"] == self.tree and attends[-1]["stop"] == start:  # intervals that touch are one
            attends[-1] = {"tree": self.tree, "start": attends[-1]["start"], "stop": start + len(ids)}
        else:
            attends.append({"tree": self.tree, "start": start, "stop": start + len(ids)})
        self.path.append(Node(turn, self.tree, len(self.segments) - 1, attends, depth + len(ids)))

    def row(self) -> pa.RecordBatch:
        values = [self.task, self.tree, self.tokens, self.positions, self.segments, self.conversations]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], names=_NAMES)


def trees(conversations: DataFrame, path: str | None = None, tokens: int = 8192, members: int = 1024) -> DataFrame:
    """Rows (``conv_id``, ``turn``, ``role``, ``text``) as prefix trees in depth-first order, cut into rows ``tree`` of a ``task``.

    ``tokens`` and ``position_ids`` run depth first, every turn that conversations of a task begin with alike once; a token of a
    segment sees the intervals that it ``attends`` (of its own row or earlier ones) and its own segment up to itself, and nothing else;
    ``loss_start`` to ``loss_stop`` are the tokens of an assistant's text; ``conversations`` names the last segment of each.

    Turns are ordered by turn, role and text (nulls first); null roles and texts are empty; repeated rows are turns of their
    own; of rows without conv_id nothing tells which belong together, so each is a conversation; other columns are ignored; an
    empty table gives an empty result. Conversations are sorted by the hashes of their turns, so those with common beginnings are
    neighbours, and dealt by range with the id as the last key: a first turn that most conversations share is spread over
    tasks and stored once in each. A row ends at ``tokens`` ids or ``members`` conversations, between turns; the next one goes on
    below the same path without repeating it, so rows stay small however long or alike conversations are.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns")).unionAll(
        conversations.where(F.col("conv_id").isNull()).select("conv_id", F.array(turn).alias("turns")))
    keyed = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"), F.transform(
        "turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("way"))
    dealt = keyed.repartitionByRange("way", "conv_id").sortWithinPartitions("way", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, forest = codec(path), Forest(TaskContext.get().partitionId())
        for batch in batches:
            for conv_id, rows in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                turns = [(x["role"], x["text"]) for x in rows]
                known = forest.shared(turns)
                del forest.path[known:]
                if len(forest.conversations) >= members:
                    yield forest.row()
                    forest.begin()
                for one, encoded in zip(turns[known:], use.encode(turns[known:]), strict=True):
                    if forest.tokens and len(forest.tokens) + len(encoded[0]) > tokens:
                        yield forest.row()
                        forest.begin()
                    forest.grow(one, encoded)
                last = forest.path[-1]
                forest.conversations.append({"conv_id": conv_id, "tree": last.tree, "segment": last.segment})
        if forest.conversations or forest.segments:
            yield forest.row()

    renamed = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return map_batches(dealt.select("conv_id", renamed.alias("turns")), run, TREES)


class Reader:
    """Reads the rows of a task in order; of rows read it holds the path to the last segment alone."""

    def __init__(self, use: Codec):
        self.use, self.last = use, (-1, -1)
        self.known: dict[tuple[int, int], tuple[list[int], list[int], tuple[int, int]]] = {}  # place -> ids, those learned, parent

    def way(self, at: tuple[int, int]) -> list[tuple[int, int]]:
        out = []
        while at[1] >= 0:
            out.append(at)
            at = self.known[at][2]
        return out[::-1]

    def read(self, row: dict) -> list[tuple]:
        ids, tree = row["tokens"], row["tree"]
        self.known = {at: self.known[at] for at in self.way(self.last)}
        for i, x in enumerate(row["segments"]):
            self.known[tree, i] = ids[x["start"]:x["stop"]], ids[x["loss_start"]:x["loss_stop"]], (x["parent_tree"], x["parent"])
        told: dict[tuple[int, int], tuple] = {}  # equal conversations end in one segment
        found = []
        for x in row["conversations"]:
            at = (x["tree"], x["segment"])
            if at not in told:
                told[at] = self.conversation(at)
            found.append((x["conv_id"], *told[at]))
        if row["segments"]:
            self.last = (tree, len(row["segments"]) - 1)
        return found

    def conversation(self, at: tuple[int, int]) -> tuple:
        parts = [self.known[x] for x in self.way(at)]
        formatted = self.use.decode([i for ids, _, _ in parts for i in ids])
        turns = [x.removesuffix(END + "\n").split("\n", 1) for x in formatted.split(START)[1:]]
        learned = "".join(unescaped(self.use.decode(loss)) for _, loss, _ in parts)
        digest = hashlib.sha256()
        for line, text in turns:
            digest.update(f"{role_of(line)}\n{unescaped(text)}\n".encode())
        return len(turns), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)


def read_back(forest: DataFrame, path: str | None = None, ordered: bool = False) -> DataFrame:
    """Conversations as the trees hold them: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``,
    ``formatted_chars``. Everything is decoded from the ids: turns along the parents, the loss by its mask. The rows of a task are
    read in order; ``ordered`` says that ``forest`` comes straight from ``trees``, whose rows need not be brought together again."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, task, reader = codec(path), None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                if one["task"] != task:
                    task, reader = one["task"], Reader(use)
                found = reader.read(one)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    rows = forest.select("task", "tree", "tokens", "segments", "conversations")
    return map_batches(rows if ordered else rows.repartition("task").sortWithinPartitions("task", "tree"), run, schema)
