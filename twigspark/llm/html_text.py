"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks in order: a stretch of text between block-level tags, with the path of open elements (tags and words of
class and id). Each block becomes a vector of hashed path parts, hashed words and a few measures (length, share of link text, punctuation, place).
A bidirectional LSTM in numpy reads the whole sequence, so that every block is labelled with both what comes before it and what comes after,
and blocks labelled as article are joined. The network is trained here, on the driver, with a fixed seed, on pages that
`training_page` makes up: layouts of random structure and class names whose labels are known.

Defined cases: null and empty html have an empty text; unclosed, misnested and cut-off markup is read as far as it goes; scripts, styles, comments,
templates, drawings and the head are never text, but of an element such as a drawing that is never closed only the tag is skipped; a "<" whose tag never ends is text, the
last one of a page excepted; elements nested deeper than DEPTH don't count as containers; pages are read whole, with any number of blocks, in time proportional to their
length: a page of more than CELLS blocks is read in pieces that hand on the network's state; rows that repeat a page_id are read row by row; an
empty table gives an empty table; other columns aren't touched.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing
from .common import small_batches

TAGS, NAMES, WORDS = 96, 128, 48
MEASURES = 12
WIDTH = TAGS + NAMES + WORDS + MEASURES
HIDDEN = 24
#: Blocks of padded pages that the network reads together.
CELLS = 1 << 15
#: Elements that end the text before them and begin a block.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul label iframe ins".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page: such as hold plain characters up to their end tag, and such as hold elements.
RAW, UNSEEN = frozenset("script style title".split()), frozenset("template noscript svg math object canvas audio video".split())
#: Open elements that are known at once.
DEPTH = 512
CLOSED_BY = {"p": BLOCK_TAGS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}}
#: An implied end doesn't reach past these.
BARRIERS = frozenset("ul ol dl table div section article main aside header footer nav body html form td th blockquote".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,63})")
HEAD_END = re.compile(r"</head\s*>|(?=<body\b)", re.I)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    path: str
    linked: int


@lru_cache(1 << 14)
def _label(tag: str, attributes: str) -> str:
    """tag and the sorted words of its class, id and role."""
    words = sorted({w.lower() for m in ATTRIBUTE.finditer(attributes) for w in NAME_PART.findall(m[1] or m[2] or m[3] or "")})
    return ".".join([tag, *words])


class Page:
    """A page's text, and where its tags and hidden elements end; each table is made once, by one pass, when it is first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.marks: list[int] | None = None
        self.ends: list[int] = []
        self.pairs: dict[str, dict[int, int]] = {}
        self.headless = False

    def tag_end(self, at: int) -> int:
        """Where the > stands that ends a tag whose attributes begin at `at`, or -1. One in quotes doesn't end it, nor does an unpaired quote let it end."""
        if self.marks is None:
            self.marks = [m.start() for m in re.finditer("[>\"']", self.text)]
            self.ends = [-1] * (len(self.marks) + 1)
            later: dict[str, int] = {}
            for k in range(len(self.marks) - 1, -1, -1):
                c = self.text[self.marks[k]]
                if c == ">":
                    self.ends[k] = self.marks[k]
                else:
                    self.ends[k] = self.ends[later[c] + 1] if c in later else -1
                    later[c] = k
        return self.ends[bisect_left(self.marks, at)]

    def element_end(self, tag: str, start: int) -> int | None:
        """Where the element ends that the tag at start opens; None if it is never closed."""
        if tag not in self.pairs:
            found, open_at = {}, []
            begins, at = re.compile(rf"<(/?){tag}(?=[\s/>])", re.I), 0
            # Each tag is looked for behind the end of the one before, and none once no > is left: every character is read once.
            while (m := begins.search(self.text, at)) and (end := self.text.find(">", m.end())) >= 0:
                at = end + 1
                if not m[1]:
                    if self.text[m.end() : at][-2:] != "/>":
                        open_at.append(m.start())
                elif open_at:
                    found[open_at.pop()] = at
            self.pairs[tag] = found
        return self.pairs[tag].get(start)

    def head_end(self, at: int) -> int:
        """After </head>, else before <body, else at."""
        end = None if self.headless else HEAD_END.search(self.text, at)
        self.headless = end is None
        return end.end() if end else at


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    whole = Page(page)
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    state = {"linked": 0, "links": 0, "path": None}

    def flush() -> None:
        if text:
            found = " ".join(html.unescape("".join(text)).split())
            if found:
                out.append(Block(found, state["path"], min(state["linked"], len(found))))
        text.clear()
        state["linked"], state["path"] = 0, None

    def add(raw: str) -> None:
        if raw:
            if state["path"] is None and not raw.isspace():
                state["path"] = "/".join(x for _, x in stack)
            text.append(raw)
            if state["links"]:
                state["linked"] += len(raw)

    def pop(to: int) -> None:
        while len(stack) > to:
            tag, _ = stack.pop()
            state["links"] -= tag == "a"

    at = look = 0  # what is before `at` is read; a tag is looked for from `look` on
    while (lt := page.find("<", look)) >= 0:
        look = lt + 1
        m = TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt) + 1
                if not end:
                    break  # nor does any tag end after it
            else:
                continue
            add(page[at:lt])
            at = look = end
            continue
        end = whole.tag_end(m.end())
        if end < 0:
            continue
        add(page[at:lt])
        at = look = end + 1
        closed = page[end - 1] == "/"
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in BLOCK_TAGS and stack[k][0] in BARRIERS:
                    break
            continue
        if tag == "head" and not closed:
            at = look = whole.head_end(at)
            continue
        if tag in RAW and not closed:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = look = found.end() if found else len(page)
            continue
        if tag in UNSEEN:
            at = look = whole.element_end(tag, lt) or at
            continue
        if tag in BLOCK_TAGS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[k][0], ()):
                    pop(k)
                    break
                if stack[k][0] in BARRIERS:
                    break
        elif tag == "br":
            add(" ")
        if tag not in VOID and not closed and len(stack) < DEPTH:
            stack.append((tag, _label(tag, page[m.end() : end])))
            state["links"] += tag == "a"
    # an unfinished tag at the end of a page that was cut off isn't text
    rest = page[at:]
    k = rest.rfind("<")
    add(rest[:k] if k >= 0 and re.match(r"<[/!a-zA-Z]", rest[k:]) else rest)
    flush()
    return out


_PATHS: dict[str, tuple[np.ndarray, int, bool]] = {}


def _path(path: str) -> tuple[np.ndarray, int, bool]:
    """Buckets of a path: its tags with their distance from the block, pairs of tags, and all name words; depth; whether it ends in a heading."""
    found = _PATHS.get(path)
    if found is None:
        parts = [p.split(".") for p in path.split("/")] if path else [[""]]
        tags = [p[0] for p in parts]
        ids = [crc32(f"{t}@{min(3, len(tags) - 1 - k)}".encode()) % TAGS for k, t in enumerate(tags)]
        ids += [crc32(f"in {t}".encode()) % TAGS for t in set(tags)]
        ids += [TAGS + crc32(f"{w}".encode()) % NAMES for p in parts for w in p[1:]]
        found = (np.array(ids, "i8"), len(tags), bool(re.fullmatch("h[1-6]", tags[-1])))
        if len(_PATHS) >= 1 << 15:
            _PATHS.clear()
        _PATHS[path] = found
    return found


def vectors(pages: list[list[Block]], part: tuple[int, int] | None = None) -> np.ndarray:
    """(blocks, WIDTH) of all blocks of the pages, in order. part: of a single page, given are the blocks from the first number on, of so many."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), WIDTH), "f4")
    if not flat:
        return x
    paths = [_path(b.path) for b in flat]
    owner = np.repeat(np.arange(len(flat)), [len(p[0]) for p in paths])
    x[owner, np.concatenate([p[0] for p in paths])] = 1
    row = 0
    for first, data, offsets in hashing.groups(pa.array([b.text for b in flat], pa.large_string())):
        starts, ends, before = hashing.words(data, offsets)
        h = hashing.word_hashes(data, starts, ends, lower=True)
        n = np.diff(before)
        owner = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(owner * WORDS + (h % np.uint64(WORDS)).astype("i8"), minlength=len(n) * WORDS).reshape(-1, WORDS)
        size = np.maximum(1, n)
        x[first : first + len(n), TAGS + NAMES : TAGS + NAMES + WORDS] = counts / np.sqrt(size)[:, None]
        row = first
        x[row : row + len(n), -MEASURES] = np.log1p(n) / 3
        x[row : row + len(n), -MEASURES + 1] = np.diff(offsets) / size / 10
    k = np.arange(len(flat))
    of = [len(p) for p in pages]
    place = (part[0] + k) / max(1, part[1] - 1) if part else np.concatenate([np.arange(n) / max(1, n - 1) for n in of]) if of else k
    x[:, -MEASURES + 2] = [b.linked / len(b.text) for b in flat]
    x[:, -MEASURES + 3] = [b.text.count(",") / (1 + len(b.text) / 50) for b in flat]
    x[:, -MEASURES + 4] = [b.text[-1] in ".!?:\"”" for b in flat]
    x[:, -MEASURES + 5] = place
    x[:, -MEASURES + 6] = [p[1] / 10 for p in paths]
    x[:, -MEASURES + 7] = [p[2] for p in paths]
    x[:, -MEASURES + 8] = [b.text[:1].isupper() for b in flat]
    x[:, -MEASURES + 9] = [any(c in b.text for c in "©|»›·") for b in flat]
    x[:, -MEASURES + 10] = [len(b.text) < 25 for b in flat]
    x[:, -MEASURES + 11] = 1
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scan(xw: np.ndarray, u: np.ndarray, keep: bool, state: list | None = None) -> tuple[np.ndarray, list]:
    """One direction of the LSTM over (steps, pages, 4 * HIDDEN) of projected inputs. state: what the network holds before and, afterwards, after them."""
    steps, n, _ = xw.shape
    h, c = state or (np.zeros((n, HIDDEN), "f4"), np.zeros((n, HIDDEN), "f4"))
    out, tape = np.empty((steps, n, HIDDEN), "f4"), []
    for t in range(steps):
        z = xw[t] + h @ u
        s = sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            tape.append((i, f, o, g, tc, *before))
    if state is not None:
        state[:] = h, c
    return out, tape


def _unscan(dout: np.ndarray, tape: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    steps, n, _ = dout.shape
    dz, du = np.empty((steps, n, 4 * HIDDEN), "f4"), np.zeros_like(u)
    dh, dc = np.zeros((n, HIDDEN), "f4"), np.zeros((n, HIDDEN), "f4")
    for t in range(steps - 1, -1, -1):
        i, f, o, g, tc, h0, c0 = tape[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        du += h0.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    return dz, du


def _padded(x: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages) rows of x forwards and backwards (-1: none), and the mask."""
    steps, n = max(lengths), len(lengths)
    ahead, back = np.full((steps, n), -1), np.full((steps, n), -1)
    start = 0
    for p, k in enumerate(lengths):
        ahead[:k, p] = np.arange(start, start + k)
        back[:k, p] = np.arange(start + k - 1, start - 1, -1)
        start += k
    return ahead, back, ahead >= 0


def forward(w: dict, x: np.ndarray, lengths: list[int], keep: bool = False):
    """Probability of article for each block of pages whose blocks are the rows of x."""
    ahead, back, mask = _padded(x, lengths)
    sides, tapes = [], []
    for side, rows in (("f", ahead), ("b", back)):
        xw = np.zeros((*rows.shape, 4 * HIDDEN), "f4")
        xw[mask] = (x @ w["W" + side] + w["z" + side])[rows[mask]]
        out, tape = _scan(xw, w["U" + side], keep)
        h = np.empty((len(x), HIDDEN), "f4")
        h[rows[mask]] = out[mask]
        sides.append(h), tapes.append(tape)
    both = np.concatenate([*sides, x], axis=1)
    p = sigmoid(both @ w["v"] + w["d"])
    return (p, both, tapes, (ahead, back, mask)) if keep else p


def forward_in_pieces(w: dict, page: list[Block], size: int) -> np.ndarray:
    """The same for one long page. Of its blocks only what the first direction says is held; their vectors are made anew for the second."""
    n, out, ahead = len(page), np.empty(len(page), "f4"), np.empty((len(page), HIDDEN), "f4")
    zero = lambda: [np.zeros((1, HIDDEN), "f4"), np.zeros((1, HIDDEN), "f4")]
    state = zero()
    for k in range(0, n, size):
        x = vectors([page[k : k + size]], (k, n))
        ahead[k : k + size] = _scan((x @ w["Wf"] + w["zf"])[:, None], w["Uf"], False, state)[0][:, 0]
    state = zero()
    for k in range((n - 1) // size * size, -1, -size):
        x = vectors([page[k : k + size]], (k, n))
        back = _scan((x @ w["Wb"] + w["zb"])[::-1, None], w["Ub"], False, state)[0][::-1, 0]
        out[k : k + size] = sigmoid(np.concatenate([ahead[k : k + size], back, x], axis=1) @ w["v"] + w["d"])
    return out


def gradients(w: dict, x: np.ndarray, lengths: list[int], y: np.ndarray) -> tuple[float, dict]:
    p, both, tapes, (ahead, back, mask) = forward(w, x, lengths, keep=True)
    loss = -(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean()
    ds = ((p - y) / len(y)).astype("f4")
    g = {"v": both.T @ ds, "d": ds.sum(keepdims=True)}
    for k, (side, rows) in enumerate((("f", ahead), ("b", back))):
        dh = ds[:, None] * w["v"][k * HIDDEN : (k + 1) * HIDDEN]
        dout = np.zeros((*rows.shape, HIDDEN), "f4")
        dout[mask] = dh[rows[mask]]
        dz, g["U" + side] = _unscan(dout, tapes[k], w["U" + side])
        flat = np.zeros((len(x), 4 * HIDDEN), "f4")
        flat[rows[mask]] = dz[mask]
        g["W" + side], g["z" + side] = x.T @ flat, flat.sum(axis=0)
    return float(loss), g


class Maker:
    """Random pages with labelled blocks."""

    CHROME = {
        "header": ["header", "masthead", "top", "site header", "branding", "logo", "page head", "topbar"],
        "nav": ["nav", "menu", "navbar", "main nav", "navigation", "links", "breadcrumb", "breadcrumbs", "pagination", "toc"],
        "aside": ["sidebar", "side", "widget", "rail", "secondary", "related", "recommended", "more stories", "popular", "tags", "author bio", "share", "social", "promo", "newsletter", "subscribe"],
        "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "ad slot", "ad unit", "adsbygoogle", "promoted"],
        "notice": ["cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "cookie banner", "privacy notice", "paywall", "message"],
        "form": ["search", "login", "signup", "contact form", "newsletter form", "search box", "comment form"],
        "comments": ["comments", "comment", "comment list", "discussion", "replies", "disqus", "responses", "reader comments", "respond"],
        "footer": ["footer", "site footer", "bottom", "colophon", "copyright", "legal", "page foot"],
    }
    TAGS_OF = {"header": ["header", "div", "div"], "nav": ["nav", "div", "ul", "nav"], "aside": ["aside", "div", "section"], "ad": ["div", "ins", "aside", "section", "p"], "notice": ["div", "section", "dialog", "p"], "form": ["form"], "comments": ["section", "div", "ol", "ul"], "footer": ["footer", "div", "footer"]}
    BODY = ["content", "post", "entry", "article", "story", "entry content", "post content", "article body", "main content", "text", "body", "page content", "single", "post body", "story body"]
    STOCK = {"header": "Daily Home of The Welcome Official site News Blog since tagline", "nav": "Home About Contact News Sports Archive Products Services Login Next Previous Page Top Index Menu Blog", "aside": "Related Popular Latest Share Tweet Follow us on Facebook Tags Categories Archives Recent posts Subscribe Read more About the author", "ad": "Advertisement Sponsored Buy now Sale Click here Special offer Save Shop Deal Free trial", "notice": "We use cookies to improve Accept all Learn more privacy policy This site consent OK Please enable Update", "form": "Search Email Name Password Submit Subscribe Send Your message Sign up Log in", "comments": "Reply said says great post thanks for sharing Leave a comment I agree Report Like permalink ago", "footer": "Copyright All rights reserved Terms Privacy Contact Imprint Sitemap Powered by ©"}

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.stems = ["".join(self.r.choice(["th", "an", "er", "on", "ti", "re", "ou", "en", "ble", "sh", "é", "ü", "qu", "la", "do", "ar", "ing", "es", "ch", "ge"], self.r.integers(1, 5))) for _ in range(3000)]

    def pick(self, x):
        return x[int(self.r.integers(len(x)))]

    def prose(self, low: int, high: int) -> str:
        n, out = int(self.r.integers(low, high + 1)), []
        while n > 0:
            k = min(n, int(self.r.integers(3, 16)))
            words = [self.pick(self.stems) for _ in range(k)]
            if k > 6 and self.r.random() < 0.5:
                words[k // 2] += ","
            out.append(" ".join(words).capitalize() + self.pick(".....!?;"))
            n -= k
        kind = self.r.random()
        text = " ".join(out)
        if kind < 0.06:
            return text.upper()
        if kind < 0.12:
            return re.sub(" ", lambda _: self.pick(["*** ", "### ", "&amp;&amp;&amp; ", " | ", "%%% "]), text)
        return text

    def short(self, kind: str) -> str:
        """Chrome text: stock phrases or prose like any other."""
        if self.r.random() < 0.5:
            words = self.STOCK[kind].split()
            return " ".join(self.pick(words) for _ in range(int(self.r.integers(1, 8))))
        return self.prose(1, self.pick([3, 8, 14, 30, 60]))

    def names(self, kinds: list[str], share: float) -> str:
        if self.r.random() > share:
            return ""
        words = self.pick(kinds).split()
        name = self.pick(["-", "_", " ", ""]).join(words)
        name = self.pick(["", "", "", "site-", "js-", "c-", "main-", "the_"]) + name + self.pick(["", "", "", "-wrap", "-inner", "s", "-2", "__item", " clearfix", "-container", " box"])
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def chrome(self, kind: str) -> list[tuple[str, str, int]]:
        """(before, text, after...) as pieces: strings of markup, and texts labelled 0."""
        tag = self.pick(self.TAGS_OF[kind])
        plain = tag in ("header", "nav", "aside", "form", "footer", "ins")
        out: list = [f"<{tag}{self.names(self.CHROME[kind], 0.55 if plain else 0.97)}>"]
        inside = {"nav": "li", "aside": self.pick(["li", "p", "div", "a"]), "header": self.pick(["p", "div", "h1", "h2", "a", ""]), "ad": self.pick(["p", "a", "", "", "div"]), "notice": self.pick(["p", "", "button", "div"]), "form": self.pick(["label", "button", "p", "option", "legend"]), "comments": self.pick(["p", "li", "div", "article"]), "footer": self.pick(["p", "li", "", "", "small", "div"])}[kind]
        lines = {"nav": (2, 8), "aside": (1, 7), "header": (1, 3), "ad": (1, 2), "notice": (1, 3), "form": (1, 4), "comments": (1, 8), "footer": (1, 4)}[kind]
        if kind in ("aside", "comments", "form") and self.r.random() < 0.5:
            out += [f"<{self.pick(['h2', 'h3', 'h4', 'p'])}>", (self.short(kind), 0), "</h3>"]
        if inside == "li" and tag not in ("ul", "ol"):
            out.append("<ul>")
        for _ in range(int(self.r.integers(lines[0], lines[1] + 1))):
            link = self.r.random() < (0.9 if kind == "nav" else 0.35)
            text = self.prose(4, 60) if kind == "comments" else self.short(kind)
            if kind == "footer" and self.r.random() < 0.3:
                text = f"&copy; {text} &middot; {self.short(kind)}"
            name = self.names(["comment body", "comment text", "reply", "item"], 0.4) if kind == "comments" and inside else ""
            out += [f"<{inside}{name}>" if inside else "", '<a href="/x">' if link else "", (text, 0), "</a>" if link else "", f"</{inside}>" if inside else " "]
        if inside == "li" and tag not in ("ul", "ol"):
            out.append("</ul>")
        return [*out, f"</{tag}>"]

    def article(self) -> list:
        tag = self.pick(["article", "article", "main", "div", "div", "section"])
        out: list = [f"<{tag}{self.names(self.BODY, 0.4 if tag in ('article', 'main') else 0.97)}>"]
        wrap = self.r.random() < 0.25
        if self.r.random() < 0.85:
            head = self.r.random() < 0.15
            out += ["<header>" if head else "", f"<{self.pick(['h1', 'h1', 'h2'])}>", (self.prose(1, 12), 1), "</h1>", "</header>" if head else ""]
        if wrap:
            out.append(f"<div{self.names(self.BODY, 0.9)}>")
        for _ in range(int(self.r.integers(1, 14))):
            kind = self.r.random()
            low, high = self.pick([(1, 4), (5, 20), (20, 90), (40, 160)])
            text = self.prose(low, high)
            if kind < 0.66:
                open_b = self.r.random() < 0.15
                out += ["<p>", "<b>" if open_b else "", (text, 1), "<br>" if open_b else "", "</p>" if not open_b else ""]
            elif kind < 0.74:
                out += [f"<{self.pick(['h2', 'h3', 'h4'])}>", (self.prose(1, 8), 1), "</h2>"]
            elif kind < 0.82:
                out += [self.pick(["<ul>", "<ol>"]), *[x for _ in range(int(self.r.integers(1, 5))) for x in ("<li>", (self.prose(2, 20), 1), "</li>")], "</ul>"]
            elif kind < 0.88:
                q = self.pick(["blockquote", "pre", "figcaption", "td", "div"])
                out += ["<table><tr>" if q == "td" else "", f"<{q}>", (text, 1), f"</{q}>", "</tr></table>" if q == "td" else ""]
            else:
                out += self.chrome(self.pick(["ad", "aside", "ad", "notice", "form"]))
        if self.r.random() < 0.1:
            out += self.chrome("comments")
        return [*out, "</div>" if wrap else "", f"</{tag}>"]

    def page(self) -> list:
        out: list = ["<html><head><title>x</title></head><body>"]
        wraps = [f"<div{self.names(['page', 'wrapper', 'container', 'site', 'layout', 'root', 'row'], 0.8)}>" for _ in range(int(self.r.integers(0, 3)))]
        out += wraps
        before = ["header", "nav", "ad", "notice", "nav", "form", "aside"]
        after = ["comments", "aside", "footer", "ad", "notice", "footer", "form", "nav"]
        for k in before:
            if self.r.random() < 0.4:
                out += self.chrome(k)
        if self.r.random() < 0.96:
            out += self.article()
        for k in after:
            if self.r.random() < 0.4:
                out += self.chrome(k)
        return [*out, *["</div>"] * len(wraps), "</body></html>"]


def training_page(maker: Maker) -> tuple[list[Block], np.ndarray]:
    """The blocks of a made-up page, with 1 where all text is the article's. Labels travel as marks in the text."""
    pieces = maker.page()
    marked = "".join(x if isinstance(x, str) else ("\ue001" if x[1] else "\ue000") + x[0] for x in pieces)
    found = blocks(marked)
    y = np.array(["\ue000" not in b.text for b in found], "f4")
    for b in found:
        b.text = b.text.replace("\ue000", "").replace("\ue001", "").strip() or "."
    return found, y


@lru_cache(1)
def train(pages: int = 2400, epochs: int = 5, batch: int = 32, rate: float = 4e-3, seed: int = 3) -> dict:
    """The network's weights: Adam over batches of made-up pages. The same numbers each time; takes some seconds."""
    maker, r = Maker(seed), np.random.default_rng(seed)
    made = [p for p in (training_page(maker) for _ in range(pages)) if p[0]]
    xs = [vectors([b]) for b, _ in made]
    normal = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype("f4")
    w = {k + s: v for s in "fb" for k, v in (("W", normal(WIDTH, 4 * HIDDEN)), ("U", normal(HIDDEN, 4 * HIDDEN)), ("z", np.zeros(4 * HIDDEN, "f4")))}
    w |= {"v": normal(2 * HIDDEN + WIDTH) * 0.1, "d": np.zeros(1, "f4")}
    for s in "fb":
        w["z" + s][HIDDEN : 2 * HIDDEN] = 1
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(made))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            _, g = gradients(w, np.concatenate([xs[i] for i in at]), [len(xs[i]) for i in at], np.concatenate([made[i][1] for i in at]))
            step += 1
            lr = rate * (1 - epoch / epochs)
            for n in w:
                grad = np.clip(g[n], -1, 1) + 1e-5 * w[n]
                m[n] = 0.9 * m[n] + 0.1 * grad
                v[n] = 0.999 * v[n] + 0.001 * grad * grad
                w[n] = (w[n] - lr * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return w


def labelled(w: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which blocks are article. Pages of similar length are read together."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    k = 0
    while k < len(order):
        e = k + 1
        while e < len(order) and (e + 1 - k) * len(pages[order[e]]) <= CELLS:
            e += 1
        at = order[k:e]
        lengths = [len(pages[i]) for i in at]
        p = (forward_in_pieces(w, pages[at[0]], CELLS) if lengths[0] > CELLS else forward(w, vectors([pages[i] for i in at]), lengths)) >= 0.5
        for i, part in zip(at, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
            out[i] = part
        k = e
    return out


def texts_of(w: dict, pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, y in zip(p, keep, strict=True) if y) for p, keep in zip(found, labelled(w, found), strict=True)]


#: Characters of html that a worker holds parsed at once.
HELD = 4 << 20


def _extracted(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = shared.value
    for b in batches:
        k = 0
        while k < b.num_rows:
            pages, size, a = [], 0, k
            while k < b.num_rows and (not pages or size < HELD):
                pages.append(b["html"][k].as_py())
                size += len(pages[-1] or "")
                k += 1
            texts = texts_of(w, pages)
            part = b.slice(a, k - a)
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """Per page: page_id, url, text (the main text), n_chars. No shuffle; the network's weights (about 350 KB) are broadcast."""
    shared = small_batches(pages).sparkSession.sparkContext.broadcast(weights or train())
    return pages.select("page_id", "url", "html").mapInArrow(partial(_extracted, shared), "page_id long, url string, text string, n_chars long")
