"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.shared import map_arrow, need, table

#: Labelled training pages (synthetic, seeded) and steps of gradient ascent.
TRAIN_PAGES, STEPS = 320, 150
SCHEMA = "page_id long, title string, text string, n_blocks int, n_content int"

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var wbr img input label".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset(("script", "style", "noscript", "template", "svg", "textarea", "iframe"))
#: An opening tag closes these open ones, up to the nearest of the second set.
_CLOSES = {
    "p": ({"p"}, frozenset()), "li": ({"li", "p"}, frozenset(("ul", "ol"))), "dt": ({"dt", "dd", "p"}, frozenset(("dl",))), "dd": ({"dt", "dd", "p"}, frozenset(("dl",))),
    "tr": ({"tr", "td", "th", "p"}, frozenset(("table",))), "td": ({"td", "th", "p"}, frozenset(("tr", "table"))), "th": ({"td", "th", "p"}, frozenset(("tr", "table"))), "option": ({"option"}, frozenset(("select",))),
} | {t: ({"p"}, frozenset()) for t in "div article section main nav aside header footer ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre form figure body".split()}
_WITHIN = tuple("article main section nav aside header footer form table ul ol li p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption td th title head button select dl".split())
_HINTS = {
    "hint_bad": re.compile(r"(?i)(?:^|[^a-z])(?:ads?|advert\w*|banner|nav\w*|menu|side-?bar|footer|header|share|social|related|comments?|cookie\w*|promo|sponsor\w*|breadcrumbs?|widget|popup|subscribe|newsletter|pager|pagination|tags?|meta)(?:$|[^a-z])"),
    "hint_good": re.compile(r"(?i)(?:^|[^a-z])(?:article|content|post|entry|story|main|body|text|page-?body|blog)(?:$|[^a-z])"),
}
_FEATURES = ("bias", *(f"in_{t}" for t in _WITHIN), *(f"leaf_{t}" for t in _WITHIN), *_HINTS, "words_1_3", "words_4_9", "words_10_24", "words_25", "links_none", "links_some", "links_most", "ends_sentence", "commas", "many_capitals", "many_digits", "copyright", "bar", "first", "last", "same_leaf_as_before")
_AT = {f: i for i, f in enumerate(_FEATURES)}
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGN = re.compile(r"(?i)©|\(c\)|copyright|all rights reserved|privacy|terms of")


class Block:
    """A leaf block: its text, the kinds of its ancestors, the nearest of them, and what their classes hint at."""

    __slots__ = ("text", "tags", "leaf", "hints", "link", "size")

    def __init__(self, text: str, tags: tuple[str, ...], leaf: str | None, hints: tuple[bool, ...], link: int, size: int):
        self.text, self.tags, self.leaf, self.hints, self.link, self.size = text, tags, leaf, hints, link, size


def _markup(page: str):
    """(text before, closing, name, attributes) of each tag in order, and the text after the last one.

    Comments and declarations have no name.  A quote that is never closed ends with its tag, at the next >;
    a < without any > after it is text.  No part of the page is looked at more often than a few times.
    """
    at = begin = 0
    last = {c: page.rfind(c) for c in "><\"'"}
    while (i := page.find("<", begin)) >= 0:
        begin = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            yield page[at:i], "", None, ""
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        if i > last[">"]:
            break
        if page[i + 1 : i + 2] in ("!", "?"):
            yield page[at:i], "", None, ""
            at = begin = page.find(">", i) + 1
            continue
        m = _TAG.match(page, i)
        if not m:
            continue
        k = m.end()
        while True:
            c = _MARK.search(page, k)
            if not c or c[0] == ">":
                break
            # the value ends with the same quote, if there is one
            k = page.find(c[0], c.end()) + 1 if last[c[0]] >= c.end() else c.end()
        end = c.start() if c else page.find(">", m.end())
        if end < 0:
            continue
        yield page[at:i], m[1], m[2].lower(), page[m.end() : end]
        at = begin = end + 1
        if m[2].lower() in _RAW and not m[1]:
            shut = re.compile(rf"</{m[2]}\s*>", re.I).search(page, at)
            at = begin = shut.end() if shut else len(page)
    yield page[at:], "", None, ""


class _Stack:
    """Open elements, with what a block needs of them kept up to date."""

    def __init__(self):
        self.names: list[str] = []
        self.marks: list[tuple[bool, ...]] = []
        self.at: dict[str, list[int]] = {}  # places of each name
        self.outer: list[int] = []  # places of elements that aren't inline
        self.hints = [0] * len(_HINTS)

    def push(self, name: str, hint: str) -> None:
        mark = tuple(bool(hint) and bool(r.search(hint)) for r in _HINTS.values())
        self.at.setdefault(name, []).append(len(self.names))
        if name not in _INLINE:
            self.outer.append(len(self.names))
        self.names.append(name)
        self.marks.append(mark)
        self.hints = [n + m for n, m in zip(self.hints, mark)]

    def cut(self, depth: int) -> None:
        for name, mark in zip(reversed(self.names[depth:]), reversed(self.marks[depth:])):
            self.at[name].pop()
            if name not in _INLINE:
                self.outer.pop()
            if any(mark):
                self.hints = [n - m for n, m in zip(self.hints, mark)]
        del self.names[depth:], self.marks[depth:]

    def close(self, name: str) -> None:
        """A closing tag; an inline one closes no block, and one without its opening nothing."""
        if self.at.get(name):
            depth = self.at[name][-1]
            if name not in _INLINE or not self.outer or self.outer[-1] < depth:
                self.cut(depth)

    def implied(self, name: str) -> None:
        """What the opening tag of a block closes."""
        shut, stop = _CLOSES[name]
        if name == "li":
            floor = max((self.at[t][-1] for t in stop if self.at.get(t)), default=-1)
            over = [p[i] for t in shut if (p := self.at.get(t)) and (i := bisect_right(p, floor)) < len(p)]
            if over:
                self.cut(min(over))
            return
        while self.outer and self.names[self.outer[-1]] in shut and self.names[self.outer[-1]] not in stop:
            self.cut(self.outer[-1])

    def tags(self) -> tuple[tuple[str, ...], str | None]:
        have = [(p[-1], t) for t in _WITHIN if (p := self.at.get(t))]
        return tuple(t for _, t in have), max(have)[1] if have else None


def leaf_blocks(page: str) -> list[Block]:
    """Text between block-level tags, in order, with its ancestors; the content of scripts, styles and comments is no text.

    Open elements are closed as HTML implies (a paragraph by the next block, a list item by the next), and
    a closing tag without its opening is passed over, so any input gives a list, in time in proportion to its length.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    state = [0, 0]  # characters of the block, those of them in links

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, *stack.tags(), tuple(n > 0 for n in stack.hints), state[1], state[0]))
            parts.clear()
        state[0] = state[1] = 0

    for raw, closing, name, attributes in _markup(page):
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            ink = len(text) - text.count(" ") - text.count("\n")
            state[0] += ink
            if stack.at.get("a"):
                state[1] += ink
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if closing:
            stack.close(name)
            continue
        if name in _RAW:
            continue
        if name in _CLOSES:
            stack.implied(name)
        if name in _VOID or attributes.endswith("/"):
            if name in ("br", "hr"):
                parts.append(" ")
            continue
        stack.push(name, " ".join(filter(None, (x for c in _CLASS.findall(attributes) for x in c))) if attributes else "")
    flush()
    return out


def features(blocks: list[Block]) -> list[list[int]]:
    """Indices of the features of each block."""
    out, before = [], None
    for i, b in enumerate(blocks):
        leaf = b.leaf
        f = [0, *(_AT[f"in_{t}"] for t in b.tags)]
        if leaf:
            f.append(_AT[f"leaf_{leaf}"])
        f += [_AT[k] for k, yes in zip(_HINTS, b.hints) if yes]
        words = b.text.count(" ") + 1
        f.append(_AT["words_1_3" if words < 4 else "words_4_9" if words < 10 else "words_10_24" if words < 25 else "words_25"])
        share = b.link / max(1, b.size)
        f.append(_AT["links_none" if share == 0 else "links_some" if share < 0.5 else "links_most"])
        end = b.text.rstrip("\"')]*#&$%!»”")[-1:] or b.text[-1:]
        raw = b.text.encode()
        tests = (
            ("ends_sentence", end in ".?!…:;" or b.text[-1:] in "!?"), ("commas", b.text.count(",") > 1), ("many_capitals", len(raw) - len(raw.translate(None, _CAPITALS)) > 0.3 * b.size), ("many_digits", len(raw) - len(raw.translate(None, b"0123456789")) > 0.2 * b.size),
            ("copyright", bool(_SIGN.search(b.text))), ("bar", "|" in b.text or "·" in b.text or "»" in b.text), ("first", i == 0), ("last", i == len(blocks) - 1), ("same_leaf_as_before", leaf is not None and leaf == before),
        )
        f += [_AT[k] for k, yes in tests if yes]
        before = leaf
        out.append(f)
    return out


def training_pages(n: int = TRAIN_PAGES, seed: int = 11) -> list[tuple[str, dict[str, int]]]:
    """Synthetic pages and the label (1: content) of each of their blocks by its text.

    Layouts differ in semantic tags, classes, nesting, order, and in closing tags left out.
    """
    r = random.Random(seed)
    serial = iter(range(10**9))
    word = lambda: "".join(r.choice("aeioulnrstdm") for _ in range(r.randint(1, 9)))
    text = lambda k, end="": " ".join([word().title(), *(word() + ("," if r.random() < 0.1 else "") for _ in range(k))]) + f" q{next(serial)}z" + end
    pages = []
    for _ in range(n):
        y: dict[str, int] = {}

        def put(label: int, t: str, y=y) -> str:
            y[t] = label
            return t

        shut = lambda t: f"</{t}>" if r.random() < 0.7 else ""
        link = lambda: f'<a href="/{word()}">{put(0, text(r.randint(0, 2)))}</a>'
        menu = lambda: "<ul>" + "".join(f"<li>{link()}{shut('li')}" for _ in range(r.randint(2, 8))) + "</ul>" if r.random() < 0.7 else "".join(f"<div>{link()}</div>" for _ in range(r.randint(2, 6)))
        paragraph = lambda: f"<p>{put(1, text(r.choice([1, 3, 6, 12, 30, 60]), r.choice(['.', '.', '.', '?', '!', '.***', ''])))}{shut('p')}"
        semantic = r.random() < 0.65
        head = put(1, text(r.randint(1, 9), r.choice(["", "."])))
        body = f"<h1>{head}</h1>" if r.random() < 0.85 else f'<div class="headline">{head}</div>'
        for _ in range(r.choice([0, 1, 2, 4, 8, 15])):
            k = r.random()
            if k < 0.75:
                body += paragraph()
            elif k < 0.82:
                body += "<ul>" + "".join(f"<li>{put(1, text(r.randint(3, 15), '.'))}{shut('li')}" for _ in range(r.randint(2, 4))) + "</ul>"
            elif k < 0.88:
                body += f"<h2>{put(1, text(r.randint(1, 5)))}</h2>"
            elif k < 0.93:
                body += f"<blockquote>{put(1, text(r.randint(8, 30), '.'))}</blockquote>"
            elif k < 0.97:
                body += f'<div class="ad">{put(0, text(r.randint(2, 10), "."))}</div>'
            else:
                body += f"<table><tr><td>{put(1, text(2))}<td>{put(1, text(3))}</table>"
        main = f"<article>{body}</article>" if semantic else f'<div class="{r.choice(["content", "post-body", "entry", "story", "main-text"])}">{body}</div>'
        if r.random() < 0.2:
            main = f"<main>{main}</main>"
        nav = f"<nav>{menu()}</nav>" if semantic else f'<div class="{r.choice(["nav", "menu", "top-nav", "header"])}">{menu()}</div>'
        ad = f'<div class="{r.choice(["ad", "banner", "promo", "sponsored"])}">{put(0, text(r.randint(2, 14), r.choice([".", ""])))}</div>'
        side = f'<{"aside" if semantic else "div"} class="{r.choice(["sidebar", "related", "widget"])}">{put(0, text(2))}{menu()}</{"aside" if semantic else "div"}>'
        foot = f"{put(0, r.choice(['© ', 'Copyright ', '']) + text(r.randint(2, 12), r.choice(['.', ''])))}"
        foot = f"<footer>{foot}</footer>" if semantic else f'<div id="footer">{foot}</div>'
        order = [nav] + [x for x in (ad, side) if r.random() < 0.6] + [main] + [x for x in (ad.replace("q", "q"), side) if r.random() < 0.15] + [foot]
        title = put(0, text(r.randint(1, 9)))
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(order)}" + "</body></html>" * (r.random() < 0.8), y))
    return pages


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels, and steps between labels) of greatest regularised likelihood, by exact
    forward-backward over all training pages at once."""
    docs, labels = [], []
    for page, y in training_pages():
        blocks = leaf_blocks(page)
        docs.append(features(blocks))
        labels.append([y.get(b.text, 0) for b in blocks])
    n, longest = len(docs), max(map(len, docs))
    size = np.array(list(map(len, docs)))
    rows = np.array([(d, t, f) for d, doc in enumerate(docs) for t, fs in enumerate(doc) for f in fs])
    gold = np.zeros((n, longest), np.int64)
    for d, y in enumerate(labels):
        gold[d, : len(y)] = y
    on = np.arange(longest) < size[:, None]
    w, step_w = np.zeros((len(_FEATURES), 2)), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(step_w)]
    v = [np.zeros_like(w), np.zeros_like(step_w)]
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for step in range(1, STEPS + 1):
        u = np.zeros((n, longest, 2))
        np.add.at(u, (rows[:, 0], rows[:, 1]), w[rows[:, 2]])
        fwd, bwd = u.copy(), np.zeros_like(u)
        for t in range(1, longest):
            fwd[:, t] = np.where(on[:, t, None], u[:, t] + lse(fwd[:, t - 1, :, None] + step_w, 1), fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(on[:, t + 1, None], lse(step_w + (u[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
        z = lse(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - z[:, None, None]) * on[:, :, None]
        diff = np.eye(2)[gold] * on[:, :, None] - node
        grad = np.zeros_like(w)
        np.add.at(grad, rows[:, 2], diff[rows[:, 0], rows[:, 1]])
        pair = np.exp(fwd[:, :-1, :, None] + step_w + (u[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        step_grad = -pair.sum((0, 1))
        np.add.at(step_grad, (gold[:, :-1][on[:, 1:]], gold[:, 1:][on[:, 1:]]), 1.0)
        for i, (x, g) in enumerate(((w, grad), (step_w, step_grad))):
            g = g / on.sum() - 2e-4 * x
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x += 0.2 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return w, step_w


def viterbi(unary: np.ndarray, step: np.ndarray) -> list[int]:
    """The best labels of a chain of blocks."""
    if not len(unary):
        return []
    (s00, s01), (s10, s11) = step.tolist()
    u = unary.tolist()
    a, b = u[0]
    back = []
    for x, y in u[1:]:
        p, q, r, s = a + s00, b + s10, a + s01, b + s11
        back.append((q > p, s > r))
        a, b = max(p, q) + x, max(r, s) + y
    out = [int(b > a)]
    for k in reversed(back):
        out.append(int(k[out[-1]]))
    return out[::-1]


def extract_page(page: str | None, weights: tuple[np.ndarray, np.ndarray]) -> tuple[str | None, str | None, int, int]:
    """Title, content, number of blocks and of content blocks of a page."""
    if page is None:
        return None, None, 0, 0
    blocks = leaf_blocks(page)
    w, step = weights
    unary = np.array([w[f].sum(0) for f in features(blocks)]).reshape(len(blocks), 2)
    label = viterbi(unary, step)
    kept = [b.text for b, y in zip(blocks, label) if y]
    return next((b.text for b in blocks if "title" in b.tags), None), "\n".join(kept), len(blocks), len(kept)


def extract_content(pages: DataFrame, page: str = "html", key: str = "page_id") -> DataFrame:
    """The content of each page: (page_id, title, text, n_blocks, n_content).

    Leaf blocks of the document tree are labelled content or not by the field, whose features are the
    ancestors' tags and classes and the block's text, and decoded by Viterbi; content blocks are joined by
    line feeds.  One pass without a shuffle; the model is trained on the driver from labelled pages.

    A null page has a null title and text; an empty page, or one without text, has an empty text; what
    isn't HTML is one block; null keys are kept; repeated rows are extracted each; an empty table gives an
    empty result; other columns are ignored.
    """
    weights = trained()

    def work(it):
        for batch in it:
            rows = [extract_page(x, weights) for x in batch.column(1).to_pylist()]
            if rows:
                title, text, n, k = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(k, pa.int32())], names=["page_id", "title", "text", "n_blocks", "n_content"])

    return map_arrow(need(pages, key, page), work, SCHEMA)


def op4_html_crf(spark, sf_dir: str) -> DataFrame:
    return extract_content(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_crf": op4_html_crf}
ORACLE_SQL: dict[str, str] = {}
