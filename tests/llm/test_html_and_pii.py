import hashlib
import html
import re
import time

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import LONG

from riskweave.llm import html_crf as hc
from riskweave.llm import pii_tagger as pt


@pytest.fixture(scope="module")
def reader():
    return hc.trained()


def test_given_pages_are_read_exactly(spark, reader):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in hc.extracted(pages, reader).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:h1|p)>|<br>", inside)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_unseen_layouts(reader):
    """Held-out pages of the generator: nearly every block is labelled right."""
    right = total = 0
    for page, wanted in hc.labelled_pages(120, seed=99):
        left = [re.sub(r"</?em>", "", x).strip() for x in wanted]
        found = hc.blocks(page)
        for block, label in zip(found, reader.decode(hc.features(found)), strict=True):
            hit = bool(left) and block.text == left[0]
            if hit:
                left.pop(0)
            right += hit == label
            total += 1
    assert right / total > 0.97


def test_parts_that_are_not_main_text(reader):
    page = """<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site.</p></div><main><article><h1>The  title &amp; more</h1>
    <p>First paragraph of the story, with&nbsp;<a href="x">a link</a> inside.<p>Second one &lt;b&gt; is
    longer and ends here.</p><ul><li>One item of the story.</li><li>Another item of it.</li></ul><script>var a = "<p>no</p>";</script>
    </article></main><aside class="sidebar"><p>Read this as well, it is related.</p></aside>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this story a lot, thank you.</p></div></section>
    <form><p>Sign up now</p><input name=a></form><footer>&copy; 2020 Site</footer></body>"""
    assert hc.main_text(reader, page) == "\n".join([
        "The title & more", "First paragraph of the story, with a link inside.", "Second one <b> is longer and ends here.",
        "One item of the story.", "Another item of it."])


def test_page_cases(spark, reader):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<p>unclosed <b>text"), (3, "w", "<article><p>" + LONG + "</p></article>"),
            (4, "x", "<" * 500), (5, "y", "<!-- never ends <p>a</p>"), (6, "z", "<script>never ends"), (7, "q", "&amp;amp; &#65; &nosuch; <p>&#0;")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = hc.extracted(pages, reader).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id in (1, 2, 5, 6)} == {""}
    assert [r.text for r in got if r.page_id == 3] == [LONG.strip()]
    assert hc.extracted(pages.limit(0), reader).count() == 0


STORY = "".join(f"<p>{x} of the story, which goes on and on for a while.</p>" for x in ("The first part", "The second part", "The third part"))


@pytest.mark.parametrize("before", [
    "<html><head><title>T</title><body>", "<head><title>T</title>", "<head><meta charset=x><link rel=y>\n", "<html><head><title>T</title></head><body>",
    "<head><script src='x'/>var a=1;</script><body>", "<body><svg><path d='M0'/><g>", "<body><select><option>One", "<body><svg/><math/>",
    "<body><template><template><p>no</p></template><p>no</p></template>", "<body data-x='a > b' title=\"c>d\">", "<!DOCTYPE html><?xml?></>",
    "<body><!--> <!---> <!-- a > b --!>"])
def test_open_heads_and_odd_markup_lose_no_text(reader, before):
    assert hc.main_text(reader, f"{before}<article>{STORY}</article>") == "\n".join(re.findall("<p>(.*?)</p>", STORY))


@pytest.mark.parametrize("page, want", [
    ("<p title=don't>one</p>", ["one"]), ("<p title='a>b' x=\"'>'\" y=/z/>one</p>", ["one"]), ("a < b <p>1 <2</p>", ["a < b", "1 <2"]),
    ("<p>x</p><p title='", ["x"]), ("<p>a<b>b</b>c</p>", ["abc"]), ("<p>&am<b>p;</b></p>", ["&amp;"]), ("<p>&amp;lt;</p>", ["&lt;"]),
    ("<script>a</scripty>b</script >c", ["c"]), ("<p>a</p/ x=y>b", ["a", "b"]), ("<div a=1 a=2 =x ==y / / b>t</div>", ["t"]), ("x</ y>z</>", ["xz"]),
    ("<title>a<p>b</title>c", ["c"]), ("<p =\"x\">t", ["t"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"])])
def test_markup_by_the_states_of_html(page, want):
    assert [b.text for b in hc.blocks(page)] == want


@pytest.mark.parametrize("piece", [
    "<a ", "</x", "<p title='", "<", "<!", "<!--", "</", "<p a=\"", "<div>a", "</div>", "<li>", "<td>", "<td></td>", "</script ", "<script>", "=", "&",
    "<p a=b ", "<svg>", "<svg><g>", "<select>", "<head>", "<ul><li>", "<b", "<p>a</b>", "<p =", "<p a  ", "<table><tr><td>", "<a href=x>b", "<!-", "a&b;"])
def test_any_markup_takes_linear_time(piece):
    """Eight times the length may take no more than about eight times as long."""
    def seconds(times):
        page = "<div>" * 2000 + piece * times
        begin = time.process_time()
        hc.blocks(page)
        return time.process_time() - begin

    assert seconds(160_000) < 24 * max(seconds(20_000), 0.02)


def test_viterbi_is_the_best_labelling(reader):
    draw = np.random.default_rng(0)
    names = sorted(reader.place)
    own = [[names[i] for i in draw.integers(0, len(names), 4)] for _ in range(7)]
    scores = reader.scores(reader.rows(own))

    def value(labels):
        return sum(scores[i][y] for i, y in enumerate(labels)) + sum(reader.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))

    best = max(value([n >> i & 1 for i in range(7)]) for n in range(128))
    assert abs(value(reader.decode(own)) - best) < 1e-9


# --- personal data -------------------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checksum = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10
            if [True, all(int(x) <= 255 for x in m[0].split(".") if kind == 1), 13 <= len(digits) <= 19 and not checksum,
                    9 <= len(digits) <= 15][kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("a@.1204+-() %é\n"))) | st.text(st.sampled_from(list("4111 -")), min_size=12, max_size=45))
def test_base_spans_are_those_of_the_patterns(text):
    assert pt.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def tagger():
    return pt.trained()


def test_gradients():
    small = pt.Tagger(hidden=4)
    small.p = {k: v.astype(float) for k, v in small.p.items()}
    draw = np.random.default_rng(0)
    chars, tags = draw.integers(0, pt.SYMBOLS, (2, 6)), np.array([[0, 1, 2, 2, 0, 3], [7, 8, 0, 5, 6, 6]])
    _, found = small.gradients(chars, tags)
    for k, value in small.p.items():
        at = (int(chars[1, 3]), 3) if k[0] == "x" else tuple(int(draw.integers(0, n)) for n in value.shape)
        ends = []
        for step in (1e-4, -2e-4):
            value[at] += step
            ends.append(small.gradients(chars, tags)[0])
        value[at] += 1e-4
        assert abs((ends[0] - ends[1]) / 2e-4 - found[k][at]) < 1e-4


def model_spans(tagger, text):
    return pt.tagged(tagger, [text])[0]


def test_held_out_spans(tagger):
    hit = told = true = 0
    for text, spans in pt.examples(150, seed=77):
        got = set(model_spans(tagger, text))
        hit, told, true = hit + len(got & set(spans)), told + len(got), true + len(spans)
    assert hit / told > 0.95 and hit / true > 0.95


def test_the_model_adds_spans(tagger):
    text = "ndes of the an (394) 555-4006 theand of 4539.5787.6362.1486 and of"
    assert pt.base_spans(text) == []
    assert [(k, text[a:b]) for k, a, b in model_spans(tagger, text)] == [(3, "(394) 555-4006"), (2, "4539.5787.6362.1486")]


def test_windows_cover_every_character():
    window, stride = pt.WINDOW, pt.STRIDE
    half = (window - stride) // 2
    for n in (1, stride - 1, window - 1, window, window + 1, 2 * stride + 2 * half, 2 * stride + 2 * half + 1, 1000):
        text = "4" * n
        found = pt.windows(text)
        whole = np.r_[pt.symbols(text), np.full(window, pt.PAD)]
        for k, row in enumerate(found):
            assert (row == whole[k * stride:k * stride + window]).all()
        assert len(found) == 1 or len(found) * stride + 2 * half >= n > (len(found) - 1) * stride + 2 * half
        for i in range(n):  # the tag of the window that a character is deepest in is the one that counts
            tags = np.zeros(found.shape, np.int8)
            holding = [k for k in range(len(found)) if k * stride <= i < k * stride + window]
            best = max(holding, key=lambda k: min(i - k * stride if k else n, k * stride + window - 1 - i if k < len(found) - 1 else n))
            if i >= 8 and i % 5 == 0:
                for k in holding:
                    for j in range(max(i - 8, 0), i + 1):
                        if 0 <= j - k * stride < window:
                            tags[k, j - k * stride] = 8
                spans = pt.reconciled(text, tags)
                assert spans == [(3, i - 8, i + 1)] and best in holding


def test_written_out_addresses_are_added(tagger):
    """Without a digit or an at sign nearby, and across the borders of windows."""
    hit = 0
    for at in range(60, 260, 10):
        before = ("the of and reth " * 20)[:at].rstrip() + " "
        text = before + "nanden.erest at reha dot org and of the reheat tion"
        hit += [(k, text[a:b]) for k, a, b in model_spans(tagger, text)] == [(0, "nanden.erest at reha dot org")]
    assert hit >= 15
    assert pt.valid(0, "a.b (at) c (dot) de") and pt.valid(0, "a at b.de") and not pt.valid(0, "look at that") and not pt.valid(0, "abatcdotde")


def test_left_out_windows_hold_no_span(tagger):
    """The shortcut of ``decode`` never changes its result."""
    draw = np.random.default_rng(4)
    texts = [t for t, _ in pt.examples(20, seed=8)] + ["".join(draw.choice(list("abcdefgh .,1@"), 300)) for _ in range(20)]
    chars = np.concatenate([pt.windows(t) for t in texts])
    scores = tagger.scores(chars)
    move = tagger.p["move"] + pt.allowed()
    best = scores[0] + move[pt.TAGS][:, None]
    came = []
    for row in scores[1:]:
        both = best[:, None] + move[:pt.TAGS, :, None]
        came.append(both.argmax(axis=0))
        best = both.max(axis=0) + row
    whole = [best.argmax(axis=0)]
    for step in reversed(came):
        whole.insert(0, step[whole[0], np.arange(len(chars))])
    whole = np.array(whole).T
    assert (tagger.decode(chars) == whole).all()
    run = tagger._run(chars.astype(int), "f") @ tagger.p["of"] + tagger._run(chars.astype(int), "b") @ tagger.p["ob"] + tagger.p["bias"]
    assert np.abs(run.transpose(0, 2, 1) - scores).max() < 1e-3


def test_pii_cases(documents, tagger):
    rows = [(1, None), (1, None), (2, ""), (None, "a.b@c.de and 10.0.0.255, +1 (394) 555-4006"), (3, LONG + " x@y.zz " + LONG),
            (4, "1" * 20000), (5, "a" * 20000 + "@" + "b" * 20000), (6, "@" * 5000), (7, "é" * 10 + "4111 1111-11111111"), (8, "256.1.1.1 x@y")]
    got = pt.personal_data(documents(rows), tagger).collect()
    assert len(got) == len(rows)
    for (_, text), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, dict((str(i), t) for i, t in rows)[str(r.doc_id)]))), strict=True):
        base = brute(text) if text and len(text) < 1000 else pt.base_spans(text or "")
        listed = ",".join(f"{pt.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)
    assert pt.personal_data(documents([]), tagger).count() == 0
