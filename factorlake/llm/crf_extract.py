"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
                   + "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())  # no markup inside
SILENT = RAW | {"template", "select", "datalist"}  # never text of the page
CONTENT = frozenset(("body", "main", "article"))
PARAGRAPH, NOTHING = frozenset({"p"}), frozenset()
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS = {tag: ends | PARAGRAPH for tag, ends in CLOSES_ITSELF.items()}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


@dataclass
class Block:
    """Text between two block tags with what stands above it."""
    text: str
    last: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: int  # characters inside links
    hidden: bool
    label: int | None = None


@dataclass
class _Open:
    """An open element with what holds for it and everything above it."""
    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    hidden: bool
    silent: bool
    label: int | None


_ROOT = _Open("", frozenset(), frozenset(), False, False, None)


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order: inline tags and line breaks do not end a block, every other tag does.

    Character references are decoded, white space becomes single spaces, blocks without text are left
    out. Contents of scripts, styles, titles, templates, selections and other silent elements never count; other
    embedded elements (svg, math, object, noscript and the like) are elements like any. Unclosed and stray tags are
    tolerated: an end tag closes up to its start tag if there is one, a silent element without an end tag
    ends with its parent or where the page's content starts. The work is linear in the page.
    """
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack
    endless: set[str] = set()  # raw elements that have no end tag from here on
    found: list[Block] = []
    parts: list[str] = []
    linked = links = at = 0
    end = len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1] if stack else _ROOT
                found.append(Block(text, top.tag, top.tags, top.names, min(linked, len(text)), top.hidden, top.label))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1].silent):
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close(k: int) -> None:
        nonlocal links
        flush()
        for e in stack[k:]:
            places[e.tag].pop()
        del stack[k:]
        links = 0

    def deepest(tags: Iterable[str]) -> int:
        return max([places[t][-1] for t in tags if places.get(t)], default=-1)

    def raw_end(tag: str) -> int:
        """Behind the end tag of a raw element that starts here; -1 if there is none."""
        if tag in endless:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
        if m is None:
            endless.add(tag)
        return m.end() if m else -1

    last = html.rfind(">")
    while at < end:
        m = MARKUP.search(html, at) if at <= last else None
        if m is None:
            add(html[at:].split("<!--", 1)[0])
            break
        add(html[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
        elif tag in RAW and not closing and (attributes.endswith("/") or (stop := raw_end(tag)) >= 0):
            at = at if attributes.endswith("/") else stop
            if tag not in ("script", "style"):
                flush()
        elif closing:
            k = deepest((tag,))
            flush() if k < 0 else close(k)
        elif tag in VOID:
            flush()
        else:
            if tag in CONTENT and stack and stack[-1].silent:
                close(next(i for i, e in enumerate(stack) if e.silent))
            ends, stop_at = ENDS.get(tag, PARAGRAPH), deepest(STOPS.get(tag, NOTHING))
            while (i := deepest(ends)) > stop_at:
                close(i)
                if tag not in CLOSES_ITSELF:
                    break
            flush()
            links = 0
            names = frozenset(w for v in NAMES.findall(attributes) for w in WORDS.findall("".join(v).lower())) if "=" in attributes else frozenset()
            label = re.search(r'data-label="(\d)"', attributes) if "data-label" in attributes else None
            above = stack[-1] if stack else _ROOT
            places.setdefault(tag, []).append(len(stack))
            stack.append(_Open(tag, above.tags if tag in above.tags else above.tags | {tag}, above.names if names <= above.names else above.names | names,
                               above.hidden or bool(attributes and HIDDEN.search(attributes)), above.silent or tag in SILENT, int(label[1]) if label else above.label))
    flush()
    return found


def _size(n: int) -> int:
    return n.bit_length()


def block_features(b: Block) -> list[str]:
    """Names of the features that hold: ancestor tags, words of their classes and ids, and the shape of the text."""
    words = b.text.count(" ") + 1
    share = b.linked * 4 // max(1, len(b.text))
    out = ["always", f"words:{min(_size(words), 7)}", f"links:{share}", "ends:" + ("stop" if b.text[-1] in ".?!…。\"”" else "other"), f"commas:{min(2, b.text.count(','))}"]
    out += {f"in:{t}" for t in b.tags}
    out += {f"name:{n}" for n in b.names}
    if b.last:
        out.append(f"last:{b.last}")
    if "©" in b.text:
        out.append("copyright")
    if b.hidden:
        out.append("hidden")
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    stay: tuple[float, float] = (0.0, 0.0)  # other to other, main to main
    move: tuple[float, float] = (0.0, 0.0)  # other to main, main to other
    start: float = 0.0

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi: is each block main text? Ties go to no."""
        weights, other, main, back = self.weights, 0.0, self.start, []
        for i, b in enumerate(found):
            e = sum(weights.get(f, 0.0) for f in block_features(b))
            if i:
                to_other, to_main = (other + self.stay[0], main + self.move[1]), (other + self.move[0], main + self.stay[1])
                back.append((to_other[1] > to_other[0], to_main[1] > to_main[0]))
                other, main = max(to_other), max(to_main)
            main += e
        if not found:
            return []
        out = [main > other]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]


def fit(pages: list[list[Block]], rounds: int = 200, rate: float = 0.15, ridge: float = 0.02) -> Model:
    """Maximum likelihood of the labels of whole pages by gradient steps (forward-backward over all pages at once)."""
    pages = [p for p in pages if p]
    if not pages:
        return Model()
    named = [[block_features(b) for b in p] for p in pages]
    index = {f: i for i, f in enumerate(sorted({f for p in named for fs in p for f in fs}))}
    n, length = len(pages), max(map(len, pages))
    rows = np.concatenate([[i * length + k] * len(fs) for i, p in enumerate(named) for k, fs in enumerate(p)]).astype(np.int64)
    cols = np.array([index[f] for p in named for fs in p for f in fs])
    on = np.zeros((n, length), bool)
    y = np.zeros((n, length))
    for i, p in enumerate(pages):
        on[i, :len(p)] = True
        y[i, :len(p)] = [b.label for b in p]
    w, trans, start = np.zeros(len(index)), np.zeros((2, 2)), 0.0
    flat = np.concatenate([w, trans.ravel(), [start]])
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    pair_seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair_seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & on[:, 1:]).sum()
    for step in range(1, rounds + 1):
        w, trans, start = flat[:len(index)], flat[len(index):-1].reshape(2, 2), flat[-1]
        emit = np.zeros((n, length, 2))
        emit[:, :, 1] = np.bincount(rows, weights=w[cols], minlength=n * length).reshape(n, length)
        fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fwd[:, 0] = emit[:, 0] + [0.0, start]
        for t in range(1, length):
            new = np.logaddexp(fwd[:, t - 1, :1] + trans[0], fwd[:, t - 1, 1:] + trans[1]) + emit[:, t]
            fwd[:, t] = np.where(on[:, t, None], new, fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = emit[:, t + 1] + bwd[:, t + 1]
            new = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
            bwd[:, t] = np.where(on[:, t + 1, None], new, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * on
        pairs = np.exp(fwd[:, :-1, :, None] + trans + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        gradient = np.concatenate([np.bincount(cols, weights=(y * on - p1).ravel()[rows], minlength=len(index)), (pair_seen - pairs.sum(axis=(0, 1))).ravel(), [(y[:, 0] - p1[:, 0]).sum()]]) / n - ridge * flat / 20
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
        flat = flat + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    trans = flat[len(index):-1].reshape(2, 2)
    return Model({f: float(flat[i]) for f, i in index.items()}, (float(trans[0, 0]), float(trans[1, 1])), (float(trans[0, 1]), float(trans[1, 0])), float(flat[-1]))


# Usual names of page parts: fixed values. Tag and attributes of containers.
MAIN_PARTS = ("article", "main", 'article class="post"', 'div class="content"', 'div class="post content"', 'div id="main content"', 'div class="entry content"', 'section class="article body"', 'div class="story text"',
              'div itemprop="articleBody"', 'div role="main"', "div", "section", 'div class="page body"')
OTHER_PARTS = ("nav", "header", "footer", "aside", "form", 'div class="nav menu"', 'div class="navbar navigation"', 'div class="breadcrumb breadcrumbs"', 'div id="header"', 'div class="site header masthead"', 'div id="footer"', 'div class="site footer copyright"',
               'div class="sidebar"', 'div id="side bar widget"', 'div class="ad"', 'div class="ads advert advertisement"', 'div class="sponsored promo promotion"', 'div class="banner"', 'div class="cookie notice consent"', 'div class="notice alert"',
               'section class="notice message warning"', 'div class="popup modal overlay"', 'div class="newsletter subscribe signup"', 'div class="login register"', 'div class="search form"', 'div class="share social"', 'div class="related recommended more links"',
               'div class="toolbar menu"', 'div class="tags meta"', 'div class="pagination pager"', 'div role="navigation"', 'div role="banner"', 'div role="contentinfo"', 'div role="complementary"', 'div class="legal disclaimer privacy terms"')
COMMENT_PARTS = ('section class="comments"', 'div id="comments"', 'div class="comment list"', 'ol class="comment replies"', 'div class="reader responses reply"', 'div id="disqus discussion thread"', 'section class="user reviews feedback"')


def _page(rng: random.Random, main: list[str], other: list[str]) -> str:
    """A page of known labels: article paragraphs and other texts of real pages in usual containers."""
    def esc(t: str) -> str:
        return t.replace("&", "&amp;").replace("<", "&lt;")

    def part(kind: str, label: int, body: str) -> str:
        return f'<{kind} data-label="{label}">{body}</{kind.split()[0]}>'

    def box(kind: str, texts: list[str]) -> str:
        shape = rng.random()
        if shape < 0.35:
            return part(kind, 0, "<ul>" + "".join(f'<li><a href="#">{esc(t)}</a></li>' for t in texts for t in t.split()[:6]) + "</ul>")
        tag = rng.choice(("p", "div", "li", "h3"))
        return part(kind, 0, "".join(f"<{tag}>{esc(t)}</{tag}>" for t in texts) if shape < 0.8 else esc(texts[0]))

    def some(k: int) -> list[str]:
        return [rng.choice(other) if rng.random() < 0.6 else rng.choice(main) for _ in range(k)]

    top = "".join(box(rng.choice(OTHER_PARTS), some(rng.randint(1, 2))) for _ in range(rng.randint(1, 3)))
    head = rng.choice(("h1", "h2"))
    inner = [f'<{head} data-label="1">{esc(main[0][:60])}</{head}>'] if rng.random() < 0.8 else []
    for t in main:
        shape = rng.random()
        inner.append(f"<p>{esc(t)}</p>" if shape < 0.8 else f"<div>{esc(t)}</div>" if shape < 0.85 else f"<ul><li>{esc(t)}</li></ul>" if shape < 0.9 else f"<blockquote>{esc(t)}</blockquote>" if shape < 0.95 else f'<p>{esc(t[:20])}<a href="#">{esc(t[20:40])}</a>{esc(t[40:])}</p>')
        if rng.random() < 0.06:
            inner.append(box(rng.choice(OTHER_PARTS), some(1)))
    nested, comments = rng.random() < 0.25, ""
    if rng.random() < 0.5:
        comments = part(rng.choice(COMMENT_PARTS), 0, "".join(f"<{k}>{esc(t)}</{k}>" for t in some(rng.randint(1, 4)) for k in (rng.choice(("p", "div", "li")),)))
    body = part(rng.choice(MAIN_PARTS), 1, "".join(inner) + comments * nested)
    tail = comments * (not nested) + "".join(box(rng.choice(OTHER_PARTS), some(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
    wrap = rng.choice(("", "", "div", 'div class="wrapper container"', 'div id="page"', "table><tr><td"))
    whole = top + body + tail
    return f"<html><body>{f'<{wrap}>' if wrap else ''}{whole}</body></html>"


MARKED = frozenset(("article", "main"))
APART = frozenset(("nav", "header", "footer", "aside", "form"))


def training_pages(htmls: list[str], copies: int = 3) -> list[list[Block]]:
    """Labelled pages: those whose own markup names the article, and pages laid out anew from their texts."""
    labelled, mains, others = [], [], []
    for html in htmls:
        found = blocks(html or "")
        if not any(MARKED & b.tags for b in found):
            continue
        for b in found:
            b.label = int(bool(MARKED & b.tags) and not APART & b.tags)
        labelled.append(found)
        mains.append([b.text for b in found if b.label])
        others += [b.text for b in found if not b.label]
    out = list(labelled)
    for k, main in enumerate(mains):
        for c in range(copies if main else 0):
            rng = random.Random(1000 * k + c)
            page = blocks(_page(rng, main[:12], others or main))
            for b in page:
                b.label = b.label or 0
            out.append(page)
    return out


def learn(pages: DataFrame, max_pages: int = 300, max_chars: int = 200_000) -> Model:
    """Trains on at most ``max_pages`` rows of ``pages(page_id, html)`` of at most ``max_chars`` characters, those whose
    page_id has the smallest hash.

    Only this bounded sample reaches the driver; its pages take part whole, and extraction reads every page
    whole. Without any page that marks its article the model calls nothing main.
    """
    able = pages.where(F.col("page_id").isNotNull() & (F.char_length("html") <= max_chars))
    chosen = able.select(F.col("page_id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(max_pages)
    rows = able.join(F.broadcast(chosen), F.col("page_id") == F.col("id")).select("page_id", "html").toPandas().sort_values(["page_id", "html"])
    return fit(training_pages(rows["html"].head(max_pages).tolist()))


def main_text(html: str | None, model: Model) -> str:
    found = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(found, model.decode(found)) if keep)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Adds ``text``, the main blocks of the whole page in order joined by newlines, and ``n_chars``, its code points.

    One pass without a shuffle. Null and empty pages, and pages without a main block, have an empty text;
    repeated rows get equal texts; other columns stay as they are.
    """
    @F.pandas_udf(T.StringType())
    def text(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, model) for h in htmls], dtype=object)

    return pages.withColumn("text", text(F.col(html))).withColumn("n_chars", F.char_length("text").cast("long"))
