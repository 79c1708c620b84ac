"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from riskweave.llm.common import map_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, and between the beginnings of neighbouring windows.
WINDOW, STRIDE = 256, 224
#: The same for learning.
LEARN_WINDOW, LEARN_STRIDE = 128, 96
#: Windows that are decoded together, and characters of the texts whose windows are held together.
BATCH, GROUP_CHARS = 2048, 440_000
ANCHOR = re.compile(r"[0-9@]")
#: Addresses with their signs written out, as in ``jane.doe (at) example dot org``.
WRITTEN_OUT = re.compile(
    r"[A-Za-z0-9._%+-]++\s*+(?:[\[({<]\s*+(?:at|AT|@)\s*+[\])}>]|(?<=\s)(?:at|AT)(?=\s))\s*+"
    r"[A-Za-z0-9-]++(?:\s*+(?:\.|[\[({<]\s*+(?:dot|DOT|\.)\s*+[\])}>]|(?<=\s)(?:dot|DOT)(?=\s))\s*+[A-Za-z0-9-]++)++")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, text: str) -> bool:
    """What a match of a kind must also fulfil."""
    if kind == 0:
        return "@" in text or WRITTEN_OUT.fullmatch(text) is not None
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) == 4 and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start: leftmost matches that don't overlap, less those that fail their check.

    Written so that no text takes more than linear time: an address is looked for around each at sign, and a number that
    cannot be an ip is not tried again from its second digit on (a match from there would also begin at its first).
    """
    spans, after, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        match = _DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            after = match.end()
            spans.append((0, begin, after))
        at = text.find("@", max(at + 1, after))
    if ANCHOR.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            spans.extend((kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0]))
    return spans


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# --- labelled spans ---------------------------------------------------------------------------------------------------


def examples(count: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts: running words with personal data in several notations, and numbers that are none."""
    draw = np.random.default_rng(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ü ñ ß".split()

    def word() -> str:
        out = "".join(draw.choice(syllables) for _ in range(draw.integers(1, 5)))
        return (out.capitalize() if draw.random() < 0.15 else out) + (draw.choice([",", ".", "!", "###"]) if draw.random() < 0.12 else "")

    def plain() -> str:
        return "".join(draw.choice(syllables[:-4]) for _ in range(draw.integers(1, 4)))

    def number(n: int) -> str:
        return "".join(map(str, draw.integers(0, 10, n)))

    def email() -> str:
        name = plain() + draw.choice(["", ".", "_", "-"]) + draw.choice([plain(), number(2), ""])
        host = draw.choice([plain(), "mail" + number(1)]) + "." + draw.choice(["example.com", "org", "net", "co.uk"])
        if draw.random() < 0.35:
            at, dot = draw.choice([[" at ", " dot "], [" (at) ", " (dot) "], [" [at] ", " [dot] "], ["(at)", "."], [" AT ", " DOT "], [" at ", "."]])
            return name.strip("._-") + at + host.replace(".", dot)
        return name.strip("._-") + draw.choice(["@", "@", "@", "@", " @ ", " [@] ", "(@)"]) + host

    def ip() -> str:
        return draw.choice([".", ".", ".", ".", " . "]).join(str(x) for x in draw.integers(0, 256, 4))

    def card() -> str:
        digits = number(15)
        digits += next(str(x) for x in range(10) if luhn(digits + str(x)))
        return draw.choice(["", "", " ", "-", "."]).join(digits[i:i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        area, a, b = number(3), number(3), number(4)
        return draw.choice([f"+1 ({area}) {a}-{b}", f"+{number(2)} {area} {a}{b}", f"+1-{area}-{a}-{b}", f"({area}) {a}-{b}",
                            f"+1 ({area}) {a}-{b}"])

    def none() -> str:
        return draw.choice([f"{number(1)}.{number(1)}", number(4), f"20{number(2)}-0{number(1)}-1{number(1)}", f"v{number(1)}.{number(1)}.{number(1)}",
                            "token = \"" + "".join(draw.choice(list("0123456789abcdef"), 40)) + "\"", f"${number(3)}.{number(2)}", number(6),
                            f"{number(2)}:{number(2)}", "@" + plain(), f"at {plain()} of {plain()}", f"{plain()} at {plain()}", f"the dot {plain()}"])

    makers = (email, ip, card, phone)
    made = []
    for _ in range(count):
        parts, spans, size = [], [], 0
        for _ in range(draw.integers(2, 5)):
            for _ in range(draw.integers(1, 5)):
                parts.append(word() + " ")
                size += len(parts[-1])
            kind = int(draw.integers(0, 7))
            found = makers[kind]() if kind < 4 else none()
            if kind < 4:
                spans.append((kind, size, size + len(found)))
            parts.append(found + draw.choice([" ", " ", " ", ". ", ", ", "\n"]))
            size += len(parts[-1])
        made.append(("".join(parts), spans))
    return made


def symbols(text: str) -> np.ndarray:
    """Characters as small numbers: ASCII, other letters, anything else."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x2000, 128, 129)).astype(np.int64)


PAD = 130
SYMBOLS = 131


def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for kind, start, end in spans:
        tags[start] = 1 + 2 * kind
        tags[start + 1:end] = 2 + 2 * kind
    return tags


# --- the network ------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def allowed() -> np.ndarray:
    """Penalty of each transition (row to column; the last row begins a text): inside follows only its own kind."""
    penalty = np.zeros((TAGS + 1, TAGS), np.float32)
    for to in range(2, TAGS, 2):
        penalty[:, to] = -1e4
        penalty[to - 1, to] = penalty[to, to] = 0
    return penalty


class Tagger:
    """Bidirectional LSTM over characters; a linear layer gives tag scores, a CRF their transitions."""

    def __init__(self, hidden: int = 8, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.hidden, self.name = hidden, uuid.uuid4().hex

        def weights(*shape: int) -> np.ndarray:
            return (draw.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)

        self.p = {}
        for side in "fb":  # the embedding of a character and its part of the gates are one table
            self.p["x" + side] = weights(SYMBOLS, 4 * hidden) * 3
            self.p["h" + side] = weights(hidden, 4 * hidden)
            self.p["o" + side] = weights(hidden, TAGS)
        self.p["bias"] = np.zeros(TAGS, np.float32)
        self.p["move"] = np.zeros((TAGS + 1, TAGS), np.float32)

    def _run(self, chars: np.ndarray, side: str, kept: list | None = None) -> np.ndarray:
        """Hidden states (time, window, unit) of one direction; ``kept`` takes what learning needs."""
        n, steps = chars.shape
        k = self.hidden
        table, back = self.p["x" + side], self.p["h" + side]
        state, cell = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.empty((steps, n, k), np.float32)
        for t in (range(steps) if side == "f" else reversed(range(steps))):
            z = table[chars[:, t]] + state @ back
            gates, new = _sigmoid(z[:, :3 * k]), np.tanh(z[:, 3 * k:])
            before, old = state, cell
            cell = gates[:, k:2 * k] * cell + gates[:, :k] * new
            lit = np.tanh(cell)
            state = gates[:, 2 * k:] * lit
            out[t] = state
            if kept is not None:
                kept.append((t, before, old, gates, new, lit))
        return out

    def _read(self, chars: np.ndarray, side: str) -> np.ndarray:
        """Tag scores (time, tag, window) of one direction: ``_run`` without what learning needs, and in place."""
        n, steps = chars.shape
        k = self.hidden
        # with x negated, 1 / (1 + exp(x)) is its sigmoid, and twice that of 2 x less one its tangent: exp is quicker than tanh
        turned = np.r_[np.full(3 * k, -1, np.float32), np.full(k, -2, np.float32)]
        # units in rows, windows in columns: the gates are then whole blocks of memory
        table, back = ((self.p[x + side] * turned).T.copy() for x in "xh")
        out = self.p["o" + side].T.copy()
        state, cell = np.zeros((k, n), np.float32), np.zeros((k, n), np.float32)
        z, fed, lit = (np.empty((m, n), np.float32) for m in (4 * k, 4 * k, k))
        scores = np.empty((steps, TAGS, n), np.float32)
        columns = chars.T.astype(np.intp)
        enter, keep, show, new = z[:k], z[k:2 * k], z[2 * k:3 * k], z[3 * k:]
        for t in (range(steps) if side == "f" else reversed(range(steps))):
            np.take(table, columns[t], axis=1, out=z, mode="clip")
            np.matmul(back, state, out=fed)
            z += fed
            np.minimum(z, 80.0, out=z)  # exp stays finite
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            new *= 2
            new -= 1
            cell *= keep
            np.multiply(enter, new, out=lit)
            cell += lit
            np.multiply(cell, -2, out=lit)
            np.minimum(lit, 80.0, out=lit)
            np.exp(lit, out=lit)
            lit += 1
            np.reciprocal(lit, out=lit)
            lit *= 2
            lit -= 1
            np.multiply(show, lit, out=state)
            np.matmul(out, state, out=scores[t])
        return scores

    def scores(self, chars: np.ndarray) -> np.ndarray:
        """(time, tag, window)."""
        found = self._read(chars, "f")
        found += self._read(chars, "b")
        found += self.p["bias"][:, None]
        return found

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best tags of each window by Viterbi: (window, time).

        The way back is asked for only where the best way is better than "outside" throughout; it is found by asking again
        where each best value came from.
        """
        scores, move = self.scores(chars), self.p["move"] + allowed()
        best = self._forward(scores, move)
        outside = scores[:, 0].sum(axis=0) + (move[TAGS, 0] + (len(scores) - 1) * move[0, 0])
        found = np.flatnonzero(best[-1].max(axis=0) > outside - 1e-3)
        tags = np.zeros(chars.shape, np.int8)
        if len(found):
            tags[found] = self._back(best[:, :, found], move)
        return tags

    def _forward(self, scores: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Value of the best way to each (time, tag, window)."""
        best = np.empty_like(scores)
        best[0] = scores[0] + move[TAGS][:, None]
        begins, inside = [0, *range(1, TAGS, 2)], np.arange(2, TAGS, 2)
        anywhere = move[:TAGS, begins, None]
        of_begin, of_inside = move[inside - 1, inside][:, None], move[inside, inside][:, None]
        for t in range(1, len(scores)):
            before, now = best[t - 1], best[t]
            now[begins] = (before[:, None] + anywhere).max(axis=0)
            now[2::2] = np.maximum(before[1::2] + of_begin, before[2::2] + of_inside)  # an inside follows its own kind alone
            now += scores[t]
        return best

    def _back(self, best: np.ndarray, move: np.ndarray) -> np.ndarray:
        steps, _, n = best.shape
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = last = best[-1].argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = last = (best[t - 1] + move[:TAGS, last]).argmax(axis=0)
        return tags

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients."""
        n, steps = chars.shape
        kept = {side: [] for side in "fb"}
        states = {side: self._run(chars, side, kept[side]) for side in "fb"}
        scores = states["f"] @ self.p["of"] + states["b"] @ self.p["ob"] + self.p["bias"]
        move = self.p["move"] + allowed()
        inner, first = move[None, :TAGS], move[TAGS]

        def logsum(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + first
        for t in range(1, steps):
            ahead[t] = logsum(ahead[t - 1][:, :, None] + inner, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = logsum(inner + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        total = logsum(ahead[-1], 1)
        d_scores = np.exp(ahead + behind - total[None, :, None])
        d_move = np.zeros_like(self.p["move"])
        d_move[TAGS] = d_scores[0].sum(axis=0)
        for t in range(1, steps):
            pair = ahead[t - 1][:, :, None] + inner + (scores[t] + behind[t])[:, None, :] - total[:, None, None]
            d_move[:TAGS] += np.exp(pair).sum(axis=0)
        own, at = np.arange(n), tags.T
        reached = sum(scores[t][own, at[t]] for t in range(steps)) + first[at[0]] + sum(
            inner[0][at[t - 1], at[t]] for t in range(1, steps))
        np.add.at(d_move, (np.full(n, TAGS), at[0]), -1)
        for t in range(1, steps):
            np.add.at(d_move, (at[t - 1], at[t]), -1)
        for t in range(steps):
            d_scores[t][own, at[t]] -= 1
        found = {"bias": d_scores.sum(axis=(0, 1)), "move": d_move}
        k = self.hidden
        for side in "fb":
            found["o" + side] = np.einsum("tnk,tnj->kj", states[side], d_scores, optimize=True)
            d_states = d_scores @ self.p["o" + side].T
            d_table, d_back = np.zeros_like(self.p["x" + side]), np.zeros_like(self.p["h" + side])
            d_state, d_cell = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            for t, before, old, gates, new, lit in reversed(kept[side]):
                d_state = d_state + d_states[t]
                d_cell = d_cell + d_state * gates[:, 2 * k:] * (1 - lit * lit)
                d_z = np.concatenate([d_cell * new, d_cell * old, d_state * lit], axis=1) * gates * (1 - gates)
                d_z = np.concatenate([d_z, d_cell * gates[:, :k] * (1 - new * new)], axis=1)
                np.add.at(d_table, chars[:, t], d_z)
                d_back += before.T @ d_z
                d_cell = d_cell * gates[:, k:2 * k]
                d_state = d_z @ self.p["h" + side].T
            found["x" + side], found["h" + side] = d_table, d_back
        return float((total - reached).mean()), {name: x / n for name, x in found.items()}

    def train(self, texts: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 3, batch: int = 64,
              rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam over windows of the labelled texts; returns the losses."""
        chars, tags = [], []
        for text, spans in texts:
            x, y = symbols(text), tags_of(len(text), spans)
            for at in range(0, max(len(x) - (LEARN_WINDOW - LEARN_STRIDE), 1), LEARN_STRIDE):
                part = x[at:at + LEARN_WINDOW]
                mark = y[at:at + LEARN_WINDOW].copy()
                inside = 0
                while inside < len(mark) and at and mark[inside] and mark[inside] % 2 == 0:
                    inside += 1  # a span that began before the window begins here
                if inside:
                    mark[0] -= 1
                chars.append(np.pad(part, (0, LEARN_WINDOW - len(part)), constant_values=PAD))
                tags.append(np.pad(mark, (0, LEARN_WINDOW - len(mark))))
        chars, tags = np.array(chars), np.array(tags)
        draw = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step = [], 0
        steps = rounds * -(-len(chars) // batch)
        for _ in range(rounds):
            order = draw.permutation(len(chars))
            for at in range(0, len(order), batch):
                loss, found = self.gradients(chars[order[at:at + batch]], tags[order[at:at + batch]])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
                for k, g in found.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    fresh = mean[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * (1 - 0.9 * step / steps) * fresh).astype(np.float32)
        return losses


def windows(text: str) -> np.ndarray:
    """Symbols of the overlapping windows of a whole text, one row each, the last one filled up."""
    count = max(1, -(-(len(text) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.full((count - 1) * STRIDE + WINDOW, PAD, np.uint8)
    padded[:len(text)] = symbols(text)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def reconciled(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a text from the tags of its windows: each character takes the tag of the window that it is deepest in."""
    count, half = len(tags), (WINDOW - STRIDE) // 2
    core = tags.copy()
    core[1:, :half] = 0  # the window before is deeper there
    core[:-1, WINDOW - half:] = 0
    row, column = np.nonzero(core)
    spans: list[list[int]] = []
    for i, tag in sorted(zip((row * STRIDE + column).tolist(), core[row, column].tolist(), strict=True)) if count else []:
        kind = (tag - 1) // 2
        if spans and spans[-1][2] == i and spans[-1][0] == kind and tag % 2 == 0:
            spans[-1][2] = i + 1
        else:
            spans.append([kind, i, i + 1])
    trimmed = []
    for kind, start, end in spans:
        end = min(end, len(text))
        while start < end and text[start].isspace():
            start += 1
        while end > start and (text[end - 1].isspace() or text[end - 1] in ".,;:!?"):
            end -= 1
        if start < end and valid(kind, text[start:end]):
            trimmed.append((kind, start, end))
    return trimmed


def united(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of the model that touch no base span of any kind."""
    free = [s for s in more if all(s[2] <= b[1] or s[1] >= b[2] for b in base)] if len(base) * len(more) < 1 << 16 else []
    if not free and more and base:
        starts = np.array(sorted((b[1], b[2]) for b in base))
        reach = np.maximum.accumulate(starts[:, 1])
        for s in more:
            i = int(np.searchsorted(starts[:, 0], s[2])) - 1  # base spans that begin before this one ends
            if i < 0 or reach[i] <= s[1]:
                free.append(s)
    return sorted(set(base) | set(free))


@lru_cache(maxsize=2)
def trained(texts: int = 2500, rounds: int = 8) -> Tagger:
    """The tagger, trained here on ``texts`` labelled texts."""
    tagger = Tagger()
    tagger.train(examples(texts), rounds)
    return tagger


#: Spans of texts read lately by a worker, by model and 128-bit hash: copies of a text are read once. Bounds memory, never changes a result.
_TOLD: list[dict[tuple[str, bytes], list[tuple[int, int, int]]]] = [{}, {}]
TOLD = 50_000


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The model's spans of whole texts; all windows of texts not read lately are decoded, in batches over the texts."""
    keys = [(model.name, xxhash.xxh3_128_digest(text.encode())) for text in texts]
    told = {key: old[key] for old in _TOLD for key in keys if key in old}
    fresh = {key: text for key, text in zip(keys, texts, strict=True) if key not in told}
    parts = [windows(text) if text else np.empty((0, WINDOW), np.uint8) for text in fresh.values()]
    chars = np.concatenate(parts) if parts else np.empty((0, WINDOW), np.uint8)
    tags = [model.decode(chars[at:at + BATCH]) for at in range(0, len(chars), BATCH)]
    every = np.concatenate(tags) if tags else np.empty((0, WINDOW), np.int8)
    ends = np.cumsum([len(x) for x in parts])
    for (key, text), part, end in zip(fresh.items(), parts, ends, strict=True):
        told[key] = reconciled(text, every[end - len(part):end])
    if len(_TOLD[0]) >= TOLD:
        _TOLD[1], _TOLD[0] = _TOLD[0], {}
    _TOLD[0].update(told)
    return [told[key] for key in keys]


def personal_data(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per row: ``doc_id``; ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans); ``base_sha256``; ``spans`` (all of them,
    ``kind:start:end``, code points, by kind and start); ``n_added`` (spans of the model alone).

    The model reads every character of every text. Null and empty texts have no spans; repeated rows and null ids stay; other
    columns are ignored; an empty table gives an empty result. Base spans always stay; a span of the model must pass the checks of
    its kind and touch no base span.
    """
    tagger = tagger or trained()
    sent = documents.sparkSession.sparkContext.broadcast(tagger)  # some 100 KB
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts, begin = texts_of(batch.column("text")), 0
            while begin < len(texts):
                end, weight = begin, 0
                while end < len(texts) and weight < GROUP_CHARS:
                    weight += len(texts[end])
                    end += 1
                counts, hashes, spans, added = [[], [], [], []], [], [], []
                for text, more in zip(texts[begin:end], tagged(model, texts[begin:end]), strict=True):
                    base = base_spans(text)
                    every = united(base, more)
                    for kind in range(len(KINDS)):
                        counts[kind].append(sum(s[0] == kind for s in base))
                    hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                    spans.append(listed(every))
                    added.append(len(every) - len(base))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), *[pa.array(c, pa.int64()) for c in counts],
                     pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
                begin = end

    return map_batches(documents.select("doc_id", "text"), run, schema)
