"""Main text of web pages: a linear-chain CRF over DOM leaf blocks, trained on labelled pages, decoded by Viterbi."""

from __future__ import annotations

import html as entities
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm.common import map_batches, texts_of

#: A tag whole, by the tokenizer states of HTML: its name, then attributes, whose values may be quoted (any character but the quote)
#: or not (up to a blank or >). Nothing is tried twice, so a tag costs its length; without a match the page ends inside the tag.
TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)|(?!\s*+=)))*+[\s/]*+)>")
#: Their contents are not text of the page.
SILENT = frozenset("script style noscript template iframe svg math object select textarea head title noembed noframes".split())
#: Up to their own end tag there is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?+", re.I) for name in RAW}
#: What may stand in a head; any other tag, or text, ends it.
HEAD_PARTS = frozenset("head html base basefont bgsound link meta title script style noscript template noframes".split())
#: Only inside these a slash ends an element that it opens.
FOREIGN = frozenset(("svg", "math"))
#: Elements that don't begin a block.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt
ruby s samp small source span strike strong sub sup time tt u var wbr br input""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag of the first kind ends an open one of the second, as far up as the nearest of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
#: Tags that end a drawing, a formula or a list of choices which is still open.
BREAKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul""".split())
COMMENT_END = re.compile("--!?>")
BLANKS = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


#: Elements that make up the parts of a page.
PARTS = frozenset("article main section aside nav header footer form".split())


class Open:
    """An open element, with what it and its ancestors say: sets are shared with the parent where nothing is added."""

    __slots__ = ("name", "names", "hints", "near", "part", "depth")

    def __init__(self, name: str, hints: frozenset[str], above: Open | None):
        self.name = name
        before = above.names if above else frozenset()
        self.names: frozenset[str] = before if name in before else before | {name}
        said = above.hints if above else frozenset()
        self.hints: frozenset[str] = said if hints <= said else said | hints
        self.near: frozenset[str] = hints or (above.near if above else frozenset())
        self.part: str = name if name in PARTS else above.part if above else "none"
        self.depth: int = above.depth + 1 if above else 1


#: What a block outside of any element is in.
NOWHERE = Open("none", frozenset(), None)
NOWHERE.names, NOWHERE.depth = frozenset(), 0


class Block:
    """Text of one leaf block with the element that it is in."""

    __slots__ = ("text", "leaf", "linked")

    def __init__(self, text: str, leaf: Open, linked: int):
        self.text, self.leaf, self.linked = text, leaf, linked


class Stack:
    """The open elements; finds the nearest of a name without a walk, so that a tag costs the same at any depth."""

    def __init__(self):
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.silent = 0

    def top(self) -> Open | None:
        return self.open[-1] if self.open else None

    def nearest(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, -1 without one."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def push(self, name: str, hints: frozenset[str]) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(Open(name, hints, self.top()))
        self.silent += name in SILENT

    def cut(self, place: int) -> None:
        """Closes the elements from a place on."""
        while len(self.open) > place:
            name = self.open.pop().name
            self.places[name].pop()
            self.silent -= name in SILENT


def hints_of(attributes: str) -> frozenset[str]:
    """Words of an element's class, id, role and the like, lower-cased, camel case taken apart, a plural s cut off."""
    if "=" not in attributes:
        return frozenset()
    found = set()
    for _, *values in ATTRIBUTE.findall(attributes):
        spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values))
        found.update(x.removesuffix("s") for x in NAME.findall(spaced.lower()))
    return frozenset(found)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; text of silent elements is left out, character references are decoded once.

    Block tags begin and end blocks, inline tags do not. A block tag also ends a paragraph that is still open, a head ends
    with the first tag or text that cannot stand in it, and a block tag inside a drawing, a formula or a list of choices that is
    still open ends these. A tag, comment or raw element that never ends takes the rest of the page, as in a browser. The time
    is proportional to the length of the page.
    """
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = BLANKS.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, stack.top() or NOWHERE, linked))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if not text:
            return
        if stack.silent:
            if stack.open[-1].name != "head" or not text.strip():
                return
            stack.cut(len(stack.open) - 1)
            if stack.silent:
                return
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        if anchors:
            linked += len(text)

    at, size = 0, len(page)
    while at < size:
        found = page.find("<", at)
        if found < 0:
            take(page[at:])
            break
        following = page[found + 1:found + 2]
        if following == "/":
            after = page[found + 2:found + 3]
            is_tag = after.isascii() and after.isalpha()
            is_note = bool(after) and not is_tag
        else:
            is_tag, is_note = following.isascii() and following.isalpha(), following in ("!", "?")
        if not (is_tag or is_note):
            take(page[at:found + 1])
            at = found + 1
            continue
        take(page[at:found])
        if is_note:  # a comment, or what counts as one
            end = _comment_end(page, found) if page.startswith("<!--", found) else page.find(">", found) + 1
            if not end:
                break
            at = end
            continue
        match = TAG.match(page, found)
        if not match:
            break
        at = match.end()
        closing, name, attributes = bool(match[1]), match[2].lower(), match[3]
        if stack.open and stack.open[-1].name == "head" and not closing and name not in HEAD_PARTS:
            stack.cut(len(stack.open) - 1)
        if not closing:
            foreign = stack.nearest(FOREIGN)
            if name in RAW and foreign < 0:
                if name == "textarea" or name not in INLINE:
                    flush()
                end = RAW_END[name].search(page, at)
                at = end.end() if end else size
                continue
            if name in INLINE:
                if name == "a":
                    anchors += 1
                elif name == "br":
                    take(" ")
                continue
            flush()
            if name in BREAKS:
                if foreign >= 0 and stack.nearest(("foreignobject",)) < foreign:
                    stack.cut(stack.places[stack.open[foreign].name][0])
                if (place := stack.nearest(("select",))) >= 0:
                    stack.cut(place)
            while stack.open and stack.open[-1].name == "p":
                stack.cut(len(stack.open) - 1)
            if name in ENDS:
                ended, until = ENDS[name]
                place = stack.nearest(ended)
                if place > stack.nearest(until):
                    stack.cut(place)
            ended_here = attributes.endswith("/") and (foreign >= 0 or name in FOREIGN)
            if name not in VOID and not ended_here:
                stack.push(name, hints_of(attributes))
        elif name in INLINE:
            if name == "a" and anchors:
                anchors -= 1
        else:
            flush()
            if (place := stack.nearest((name,))) >= 0:
                stack.cut(place)
            anchors = 0
    flush()
    return out


def _comment_end(page: str, start: int) -> int:
    """Behind the comment that begins at a place; 0 if it never ends."""
    for short in ("<!-->", "<!--->"):
        if page.startswith(short, start):
            return start + len(short)
    end = COMMENT_END.search(page, start + 4)
    return end.end() if end else 0


# --- features ---------------------------------------------------------------------------------------------------------


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of each block: its ancestors' tags, words of their attributes, its own text and place."""
    found = []
    for i, block in enumerate(page):
        text, n = block.text, len(block.text)
        words = text.count(" ") + 1
        own = ["bias", "leaf=" + block.leaf.name, f"words={min(words.bit_length(), 6)}",
               f"linked={min(4, 5 * block.linked // max(n, 1))}", f"depth={min(block.leaf.depth, 8)}"]
        own += ["in=" + t for t in sorted(block.leaf.names) if t not in ("html", "body")]
        own += ["hint=" + h for h in sorted(block.leaf.hints)]
        own += ["near=" + h for h in sorted(block.leaf.near)]
        own.append("part=" + block.leaf.part)
        if text[-1] in ".!?…":
            own.append("sentence")
        if "©" in text or "copyright" in text.lower():
            own.append("copyright")
        stops = sum(text.count(c) for c in ",.;")
        own.append(f"stops={min(3, 30 * stops // n)}")
        if i == 0:
            own.append("first")
        if i == len(page) - 1:
            own.append("last")
        found.append(own)
    return found


# --- the model --------------------------------------------------------------------------------------------------------


class Model:
    """Linear-chain CRF with two labels, 1 for main text. Features that training did not meet have no weight."""

    def __init__(self, names: list[str]):
        self.place = {x: i for i, x in enumerate(names)}
        self.weights = np.zeros((len(names), 2))
        self.moves = np.zeros((2, 2))
        self.name = uuid.uuid4().hex

    def rows(self, own: list[list[str]]) -> list[list[int]]:
        return [[self.place[x] for x in names if x in self.place] for names in own]

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.array([i for r in rows for i in r], np.int64)
        ends = np.cumsum([len(r) for r in rows])
        sums = np.vstack([np.zeros(2), np.cumsum(self.weights[flat], axis=0)])
        return sums[ends] - sums[np.r_[0, ends[:-1]]]

    def decode(self, own: list[list[str]]) -> list[int]:
        """Viterbi; ties go to main text."""
        if not own:
            return []
        scores = self.scores(self.rows(own)).tolist()
        (a, b), (c, d) = self.moves.tolist()
        low, high = scores[0]
        came = []
        for x, y in scores[1:]:
            came.append((int(high + c >= low + a), int(high + d >= low + b)))
            low, high = max(low + a, high + c) + x, max(low + b, high + d) + y
        labels = [int(high >= low)]
        for before in reversed(came):
            labels.append(before[labels[-1]])
        return labels[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 30, rate: float = 0.1,
              decay: float = 1e-4) -> None:
        """Adam on the mean log likelihood of all pages at once, by forward and backward sums, pages side by side."""
        longest = max(len(y) for _, y in pages)
        own = [self.rows(x) for x, _ in pages]
        flat = np.array([i for rows in own for r in rows for i in r], np.int64)
        block = np.array([b for b, r in enumerate(r for rows in own for r in rows) for _ in r], np.int64)
        page = np.repeat(np.arange(len(own)), [len(r) for r in own])
        place = np.concatenate([np.arange(len(r)) for r in own])
        gold = np.concatenate([np.array(y) for _, y in pages])
        mask = np.zeros((longest, len(own)), bool)
        mask[place, page] = True
        ends = np.array([len(r) for r in own]) - 1
        truth = np.zeros((longest, len(own)), np.int64)
        truth[place, page] = gold
        total = len(gold)
        params = {"weights": self.weights, "moves": self.moves}
        mean = {k: np.zeros_like(v) for k, v in params.items()}
        square = {k: np.zeros_like(v) for k, v in params.items()}
        for step in range(1, rounds + 1):
            scores = np.zeros((longest, len(own), 2))
            scores[place, page] = np.stack([np.bincount(block, self.weights[flat, y], total) for y in (0, 1)], axis=1)
            ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
            ahead[0] = scores[0]
            for t in range(1, longest):
                ahead[t] = np.logaddexp(ahead[t - 1][:, :1] + self.moves[0], ahead[t - 1][:, 1:] + self.moves[1]) + scores[t]
            for t in range(longest - 2, -1, -1):
                onward = scores[t + 1] + behind[t + 1]
                to = np.logaddexp(self.moves[:, 0] + onward[:, :1], self.moves[:, 1] + onward[:, 1:])
                behind[t] = np.where((mask[t + 1])[:, None], to, 0.0)
            whole = np.logaddexp(*ahead[ends, np.arange(len(own))].T)
            chance = np.exp(ahead + behind - whole[None, :, None])
            chance[place, page, gold] -= 1
            off = chance[place, page]
            found = {"weights": np.stack([np.bincount(flat, off[block, y], len(self.place)) for y in (0, 1)], axis=1),
                     "moves": np.zeros((2, 2))}
            for t in range(1, longest):
                on = mask[t]
                pair = (ahead[t - 1][on][:, :, None] + self.moves + (scores[t] + behind[t])[on][:, None, :]
                        - whole[on][:, None, None])
                found["moves"] += np.exp(pair).sum(axis=0)
                np.add.at(found["moves"], (truth[t - 1][on], truth[t][on]), -1)
            for k, value in params.items():
                g = found[k] / total + decay * value / max(1, len(self.place)) ** 0.5
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                value -= rate * mean[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-9)


# --- labelled pages ---------------------------------------------------------------------------------------------------

#: Names that sites give to parts of a page; beside the main text each line is one part.
MAIN_NAMES = "article content main post entry story body text page single blog news".split()
WRAPPERS = "wrapper container wrap site page area app root outer layout".split()
SIDE_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar tabs pagination pager toc skip".split(),
    "head": "header masthead banner logo site brand hero search".split(),
    "foot": "footer copyright legal colophon bottom imprint credits".split(),
    "side": "sidebar aside widget related recommended popular tags archive categories trending more rail".split(),
    "notice": "cookie consent notice notification alert popup modal gdpr newsletter subscribe signup paywall toast overlay".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp teaser".split(),
    "form": "form login comment-form respond feedback contact share social sharing".split(),
    "comment": "comments comment replies discussion disqus reader responses thread reviews".split(),
}


def labelled_pages(count: int, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Pages in many layouts with the blocks of their main text, made by a generator with a fixed seed."""
    draw = np.random.default_rng(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ü ñ ß".split()

    def pick(values: list[str]) -> str:
        return values[int(draw.integers(len(values)))]

    def words(low: int, high: int) -> str:
        text = " ".join("".join(draw.choice(syllables, draw.integers(1, 5))) for _ in range(draw.integers(low, high)))
        return text[:1].upper() + text[1:]

    def prose() -> str:
        size = pick(["short", "long", "long", "tiny"])
        low, high = {"tiny": (1, 5), "short": (4, 15), "long": (15, 70)}[size]
        return words(low, high) + pick([".", ".", ".", ".", "", "!", "?", "###"])

    def named(names: list[str]) -> str:
        name = pick(names)
        return pick([name, name, "site-" + name, name + "-wrap", name + "s", "the_" + name, name + " " + pick(["box", "row", "col", "inner"])])

    def attribute(names: list[str]) -> str:
        return f'{pick(["class", "class", "id"])}="{named(names)}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(n)) + "</ul>"

    def paragraph(text: str) -> str:
        return pick([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>",
                     f"<p>{text.replace(' ', ' <em>', 1)}</em></p>", f"<blockquote>{text}</blockquote>"])

    def side(kind: str) -> str:
        names = SIDE_NAMES[kind]
        if kind == "menu":
            inner = pick([links(int(draw.integers(3, 9))), f'<a href="/">{words(1, 3)}</a> &gt; <a href="/x">{words(1, 3)}</a>'])
            return pick([f"<nav>{inner}</nav>", f"<nav {attribute(names)}>{inner}</nav>", f"<div {attribute(names)}>{inner}</div>"])
        if kind == "head":
            inner = pick([f"<h1>{words(1, 5)}</h1>", f"<p>{words(3, 10)}</p>", f'<a href="/">{words(1, 3)}</a>', links(4)])
            return pick([f"<header>{inner}</header>", f"<header {attribute(names)}>{inner}</header>", f"<div {attribute(names)}>{inner}</div>"])
        if kind == "foot":
            inner = pick([f"&copy; {words(1, 4)} &middot; {prose()}", f"<p>&copy; 20{draw.integers(10, 30)} {words(1, 5)}</p>",
                          prose(), links(4), f"<p>{prose()}</p><p>{prose()}</p>"])
            return pick([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<footer {attribute(names)}>{inner}</footer>", f"<div {attribute(names)}>{inner}</div>"])
        if kind == "side":
            inner = pick([f"<h3>{words(1, 4)}</h3>{links(4)}", f"<p>{prose()}</p>", f"<h4>{words(1, 4)}</h4><p>{prose()}</p>"])
            return pick([f"<aside>{inner}</aside>", f"<aside {attribute(names)}>{inner}</aside>", f"<div {attribute(names)}>{inner}</div>",
                         f"<section {attribute(names)}>{inner}</section>"])
        if kind == "form":
            inner = f'<label>{words(1, 4)}</label><input name="q"><button>{words(1, 3)}</button>'
            return pick([f"<form>{inner}</form>", f"<form {attribute(names)}><p>{prose()}</p>{inner}</form>",
                         f"<div {attribute(names)}>{inner}</div>"])
        if kind == "comment":
            inner = "".join(pick([f'<li {attribute(names)}><p>{prose()}</p></li>', f'<div {attribute(names)}><p>{prose()}</p></div>',
                                  f"<p>{prose()}</p>"]) for _ in range(draw.integers(1, 5)))
            return pick([f'<section {attribute(names)}><h3>{words(1, 4)}</h3>{inner}</section>', f"<div {attribute(names)}>{inner}</div>",
                         f'<ol {attribute(names)}>{inner}</ol>'])
        inner = pick([prose(), f"<p>{prose()}</p>", f'<p>{prose()}</p><a href="/go">{words(1, 3)}</a>'])
        return pick([f"<div {attribute(names)}>{inner}</div>", f"<div {attribute(names)}>{inner}</div>", f"<section {attribute(names)}>{inner}</section>"])

    kinds = list(SIDE_NAMES)
    made = []
    for _ in range(count):
        wanted, inner = [], ""
        title = words(2, 9)
        if draw.random() < 0.85:
            heading = pick(["h1", "h1", "h2"])
            wanted.append(title)
            inner += pick([f"<{heading}>{title}</{heading}>", f"<header><{heading}>{title}</{heading}></header>"] if draw.random() < 0.3
                          else [f"<{heading}>{title}</{heading}>"])
        body = []
        for _ in range(draw.integers(1, 14)):
            kind = draw.random()
            if kind < 0.82:
                text = prose()
                wanted.append(text)
                body.append(paragraph(text))
            elif kind < 0.9:
                items = [prose() for _ in range(draw.integers(2, 5))]
                wanted += items
                body.append(f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>")
            else:
                text = words(1, 6)
                wanted.append(text)
                body.append(f"<h3>{text}</h3>")
            if draw.random() < 0.06:
                body.append(side(pick(["advert", "notice", "form", "side"])))
        inner += "".join(body)
        if draw.random() < 0.25:
            inner += side(pick(["comment", "comment", "form", "side", "foot", "foot"]))
        below = side(pick(["comment", "comment", "comment", "form", "side", "advert"])) if draw.random() < 0.5 else ""
        main = pick([f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article {attribute(MAIN_NAMES)}>{inner}</article>",
                     f"<main>{inner}{below}</main>", f"<main><article>{inner}</article>{below}</main>", f"<div {attribute(MAIN_NAMES)}>{inner}</div>",
                     f"<main {attribute(MAIN_NAMES)}><article {attribute(MAIN_NAMES)}>{inner}</article>{below}</main>",
                     pick([inner, f"<section>{inner}</section>", f"<div>{inner}</div>"])])
        alone = draw.random() < 0.1
        before = "".join(side(pick(kinds[:6])) for _ in range(0 if alone else draw.integers(0, 5)))
        after = "".join(side(pick(kinds)) for _ in range(0 if alone else draw.integers(0, 6)))
        whole = before + main + after
        for _ in range(int(draw.integers(0, 4)) if draw.random() < 0.5 else 0):  # wrappers say nothing about a part
            whole = f"<div {attribute(MAIN_NAMES + WRAPPERS)}>{whole}</div>"
        made.append((f"<html><head><title>{title}</title><script>var x = '<p>';</script></head><body>{whole}</body></html>", wanted))
    return made


@lru_cache(maxsize=2)
def trained(pages: int = 1000, seed: int = 3) -> Model:
    """The model, trained here on ``pages`` labelled pages."""
    learned = []
    for page, wanted in labelled_pages(pages, seed):
        found = blocks(page)
        labels, left = [], [BLANKS.sub(" ", re.sub(r"</?em>", "", x)).strip() for x in wanted]
        for block in found:
            hit = bool(left) and block.text == left[0]
            labels.append(int(hit))
            if hit:
                left.pop(0)
        if found and not left:
            learned.append((features(found), labels))
    names: dict[str, int] = {}
    for own, _ in learned:
        for row in own:
            for x in row:
                names[x] = names.get(x, 0) + 1
    model = Model(sorted(x for x, n in names.items() if n > 1))
    model.train(learned, rounds=200)
    return model


def main_text(model: Model, page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, model.decode(features(found)), strict=True) if keep)


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``text`` (blocks of the main text in order, one newline between), ``n_chars``.

    The whole html is read. Null or empty html, and pages without main text, give an empty text; malformed markup is read
    as far as it goes; repeated rows, null ids and null urls stay; other columns are ignored; an empty table gives an empty
    result.
    """
    model = model or trained()
    sent = pages.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = [main_text(known, x) for x in texts_of(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
