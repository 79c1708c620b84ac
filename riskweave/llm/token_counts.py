"""Token counts by a sentencepiece model, in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from riskweave.llm.common import map_batches, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, frozenset[str]]:
    """The model, and each pair of neighbouring characters that some piece holds."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pairs = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i).replace("▁", " ")
            pairs.update(map("".join, zip(piece, piece[1:], strict=False)))
    return model, frozenset(pairs)


@lru_cache(maxsize=2)
def _splittable(path: str) -> bool:
    """Whether the model puts one blank before each text and keeps all others; then ``segments`` is exact."""
    model, _ = _model(path)

    def shown(text: str) -> str:
        return "".join(map(model.id_to_piece, model.encode(text)))

    return shown("  ab  cd ") == "▁▁▁ab▁▁cd▁" and shown("ab") == "▁ab"


def sentence_model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, frozenset[str], bool]:
    """The model, the pairs of characters within its pieces, and whether ``segments`` is exact for it."""
    return *_model(path), _splittable(path)


def segments(text: str, size: int, pairs: frozenset[str]) -> list[str]:
    """Cuts a text at blanks, after every ``size`` characters or more, where no piece holds the blank and what is before it.

    No merge can cross such a place. The blank itself is left out, for the library puts one before each text; so the parts
    have as many tokens as the whole. A text without such a place is not cut.
    """
    parts, begin, n = [], 0, len(text)
    while n - begin > size:
        cut = text.find(" ", begin + size)
        while 0 <= cut < n - 1 and text[cut - 1:cut + 1].replace("▁", " ") in pairs:
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < n - 1:
            break
        parts.append(text[begin:cut])
        begin = cut + 1
    parts.append(text[begin:])
    return parts


def token_counts(documents: DataFrame, path: str | None = None, limit: int = 4096, segment_chars: int = 16384,
                 batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, UTF-8 bytes and tokens of the whole text, ``n_tokens > limit``.

    Null texts count as empty (0, 0, false); repeated rows and null ids stay; other columns are ignored; an empty table
    gives an empty result. Segments of all texts of an Arrow batch are encoded in groups of about ``batch_bytes``, so one
    very long text and many short ones make calls of like size. ``path``: a sentencepiece model readable on every executor.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs = _model(path)
        size = segment_chars if _splittable(path) else 1 << 62
        for batch in batches:
            texts = texts_of(batch.column("text"))
            tokens = np.zeros(len(texts), np.int64)
            n_bytes = np.zeros(len(texts), np.int64)
            held, owners, weight = [], [], 0

            def flush() -> None:
                np.add.at(tokens, owners, [len(x) for x in model.encode(held, num_threads=1)])  # noqa: B023

            for row, text in enumerate(texts):
                n_bytes[row] = len(text.encode())
                for part in segments(text, size, pairs):
                    held.append(part)
                    owners.append(row)
                    weight += len(part)
                    if weight >= batch_bytes:
                        flush()
                        held, owners, weight = [], [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(documents.select("doc_id", "text"), run, SCHEMA)
