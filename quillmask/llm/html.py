"""HTML extraction: a recurrent labeller decides for every block of a page whether it is main text.

A page is cut into leaf blocks: runs of text between block-level tags. Each block becomes a vector of its hashed tag path
(tags, and the words of their class and id by the part these play in a name), its hashed words and a few measures such as length and share of link text. A
bidirectional LSTM, written in numpy, reads the blocks of a page in order, so that every decision sees the whole page. It
is trained on pages that a generator writes with known labels: articles in many layouts among menus, headers, sidebars,
notices, adverts, forms and comments. Scripts, styles, comments in the markup and the head are never blocks. Of an element
that is left out but never closed only the tag is; scripts and styles then run to the end of the page.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .stream import tidy
from .words import Words, as_strings

_ATTRS = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
#: Comments; scripts and styles, up to the end of the page if they are never closed; elements whose content is no markup, if
#: they are closed before one of the same name opens; tags of the elements left out; all other tags; other markup.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(title|textarea|iframe)(?=[\s/>])(?:(?!<\2[\s/>]).)*?</\2(?=[\s/>])[^>]*>"
    rf"|<(?P<shut>/?)(?P<skipped>noscript|template|svg|head|title|textarea|select|iframe|object)(?=[\s/>]|\Z)(?P<own>{_ATTRS}>|[^>]*(?:>|\Z))"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>{_ATTRS}|[^<>]*)/?>|<[!?][^>]*>",
    re.S | re.I,
)
#: The end of a tag that closes itself: the slash is no part of a value without quotes.
_CLOSED = re.compile(r"(?<![^\s\"'])(?:[^\s\"'=]*)/>\Z")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Tags inside a line of text: they end no block and are no part of a path.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is open.
CLOSES = {"p": "p", "li": "li", "tr": "tr", "td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd", "option": "option", **{f"h{i}": "p" for i in range(1, 7)},
          **dict.fromkeys("div ul ol dl table section article aside nav header footer form blockquote pre figure main hr".split(), "p")}
PATH, WORDS, MEASURES = 128, 32, 8
HIDDEN = 16


def _left_out(tokens: list[re.Match]) -> dict[int, int]:
    """The tokens that open an element left out, and the one that closes each. Those never closed are missing: of them the
    tag alone is left out. A head is closed before the body begins, or not at all."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        name = (m["skipped"] or "").lower()
        if not name:
            if (m["name"] or "").lower() == "body":
                opened.pop("head", None)
        elif m["shut"]:
            if opened.get(name):
                found[opened[name].pop()] = i
        elif name != "svg" or not _CLOSED.search(m["own"]):
            opened.setdefault(name, []).append(i)
    return found


def blocks(html: str) -> tuple[list[str], list[tuple[str, ...]], list[float]]:
    """Texts (references decoded, white space made one space), paths and shares of link text of the leaf blocks."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts, paths, links = [], [], []
    held: list[str] = []
    linked, in_link, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            if text:
                texts.append(text)
                paths.append(stack[-1][1] if stack else ())
                links.append(min(1.0, linked / len(text)))
        held.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        held.append(piece)
        if in_link:
            linked += len(piece)

    tokens = list(_TOKEN.finditer(html))
    left_out = _left_out(tokens)
    for i, m in enumerate(tokens):
        if m.start() < at:  # within an element left out
            continue
        if m.start() > at:
            take(html[at : m.start()])
        at = tokens[left_out.get(i, i)].end()
        name, end = (m["name"], m["end"]) if m["name"] else (m["skipped"], m["shut"])
        if name is None or m["skipped"] and not end:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = 0 if end else 1
            elif name in ("br", "wbr", "img"):
                held.append(" ")
            continue
        end_block()
        if end:
            in_link = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in VOID or name in ("html", "body"):
            continue
        shut = CLOSES.get(name, "").split()
        if shut and stack and stack[-1][0] in shut:
            stack.pop()
        before = stack[-1][1] if stack else ()
        own = [name]
        if m["attrs"]:
            own += _marks(" ".join(a or b or c for _, a, b, c in _NAMED.findall(m["attrs"])).lower())
        stack.append((name, before + tuple(own)))
    if at < len(html):
        take(html[at:])
    end_block()
    return texts, paths, links


@cache
def _marks(names: str) -> tuple[str, ...]:
    """The words of an element's names, told apart by the part they play. The last word of a name says what the element is (a
    post-footer is a footer): after + in an element that is called main text by any of its names, else after a dot. The other words
    say what kind, or in what state (comments-open, has-sidebar): after a hyphen."""
    last, rest = [], []
    for name in names.split():
        words = _WORD.findall(name)
        last += words[-1:]
        rest += words[:-1]
    sign = "+" if any(w in MAIN_NAMES for w in last) else "."
    return (*(sign + w for w in last), *(f"-{w}" for w in rest), *([".!"] if sign == "." and not _SIDE.isdisjoint(last) else []))


def _mix32(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h ^ h >> 15


@cache
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Each name counts once, the last two tags again in places of their own."""
    out = np.zeros(PATH, np.float32)
    for x in set(path):
        out[_mix32(x) % PATH] = 1
    for x in [p for p in path if p[0] not in ".+-"][-2:]:
        out[_mix32("last " + x) % PATH] += 1
    return out


def vectors(texts: list[str], paths: list[tuple[str, ...]], links: list[float], place: np.ndarray) -> np.ndarray:
    """Features of blocks; place is how far down its page each block stands, 0 to 1."""
    w = Words(as_strings(pa.array(texts, pa.string())), lower=True)
    n = np.diff(w.first)
    size = np.diff(w.off)
    word = np.bincount(w.doc * WORDS + (w.hashes() % np.uint64(WORDS)).astype(np.int64), minlength=len(texts) * WORDS).reshape(-1, WORDS)
    word = word / np.sqrt(np.maximum((word**2).sum(axis=1, keepdims=True), 1))
    ends = np.array([t[-1] in ".!?:;…。" for t in texts], float)
    stops = np.array([t.count(".") + t.count(",") for t in texts], float)
    measures = np.stack([np.log1p(n) / 3, np.log1p(size) / 5, links, ends, stops / np.maximum(n, 1), (n < 8).astype(float), (n > 25).astype(float), place], axis=1)
    return np.concatenate([np.stack([_path_vector(p) for p in paths]), word, measures], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one sigmoid output a block; trained by backpropagation through time with Adam."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        n = PATH + WORDS + MEASURES
        self.p = {}
        for d in ("f", "b"):
            self.p[f"w{d}"] = (rng.standard_normal((n, 4 * hidden)) * 0.15).astype(np.float32)
            self.p[f"u{d}"] = (rng.standard_normal((hidden, 4 * hidden)) * 0.2).astype(np.float32)
            self.p[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.p["o"] = (rng.standard_normal((2 * hidden, 1)) * 0.3).astype(np.float32)
        self.p["s"] = (rng.standard_normal((n, 1)) * 0.05).astype(np.float32)
        self.p["k"] = np.zeros(1, np.float32)
        self.hidden = hidden

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of one direction over (pages, blocks, features); past a page's end they stay as they are. What training
        needs of each step is kept on demand."""
        n = self.hidden
        z = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((len(x), n), np.float32)
        out, kept = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a = z[:, t] + h @ self.p[f"u{d}"]
            i, f, o, g = _sigmoid(a[:, :n]), _sigmoid(a[:, n : 2 * n]), _sigmoid(a[:, 2 * n : 3 * n]), np.tanh(a[:, 3 * n :])
            m = mask[:, t : t + 1]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep:
                kept.append((t, i, f, o, g, tc, c, h, m))
            c, h = m * c2 + (1 - m) * c, m * h2 + (1 - m) * h
            out[:, t] = h
        return out, kept

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d)[0] for d in "fb"], axis=2)
        return _sigmoid((both @ self.p["o"] + x @ self.p["s"])[..., 0] + self.p["k"])

    def _grads(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid((both @ self.p["o"] + x @ self.p["s"])[..., 0] + self.p["k"])
        e = ((p - y) * mask / mask.sum())[..., None].astype(np.float32)
        grad = {"o": np.einsum("btk,bto->ko", both, e), "s": np.einsum("btk,bto->ko", x, e), "k": e.sum(axis=(0, 1))}
        n = self.hidden
        for at, d in enumerate("fb"):
            dz = np.zeros((*x.shape[:2], 4 * n), np.float32)
            dh_out = e * self.p["o"][at * n : (at + 1) * n, 0]
            dh = dc = np.zeros((len(x), n), np.float32)
            du = np.zeros_like(self.p[f"u{d}"])
            for t, i, f, o, g, tc, c, h, m in reversed(runs[d][1]):
                dh = dh + dh_out[:, t]
                a, rest = dh * m, dh * (1 - m)
                k = dc * m + a * o * (1 - tc * tc)
                s = np.concatenate([k * g * i * (1 - i), k * c * f * (1 - f), a * tc * o * (1 - o), k * i * (1 - g * g)], axis=1)
                dz[:, t] = s
                du += h.T @ s
                dh = s @ self.p[f"u{d}"].T + rest
                dc = k * f + dc * (1 - m)
            grad[f"u{d}"] = du
            grad[f"w{d}"] = np.einsum("btk,btn->kn", x, dz)
            grad[f"c{d}"] = dz.sum(axis=(0, 1))
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        first, second, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        first, second = first
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                x, mask, y = pad([pages[i] for i in groups[g]])
                step += 1
                for k, v in self._grads(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] = self.p[k] - rate * 0.7**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self


def pad(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(len(y) for _, y in pages)
    x, mask, y = np.zeros((len(pages), n, PATH + WORDS + MEASURES), np.float32), np.zeros((len(pages), n), np.float32), np.zeros((len(pages), n), np.float32)
    for i, (a, b) in enumerate(pages):
        x[i, : len(b)], mask[i, : len(b)], y[i, : len(b)] = a, 1, b
    return x, mask, y


#: Class words that sites use, by what they mark; the generator combines them.
MAIN_NAMES = "article content post entry story body text main single page copy prose markdown blog".split()
SIDE_NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar links tabs pagination pager toc".split(),
    "header": "header masthead top logo brand site hero bar".split(),
    "footer": "footer bottom copyright legal colophon foot".split(),
    "side": "sidebar side aside related widget recommended popular tags promo trending rail more".split(),
    "notice": "cookie cookies notice consent banner gdpr alert popup modal message privacy newsletter".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promotion adsense dfp teaser".split(),
    "form": "form search login signup subscribe contact newsletter".split(),
    "comments": "comments comment reply replies discussion respond disqus thread feedback".split(),
    "share": "share social sharing buttons follow meta byline author".split(),
}
_SIDE = frozenset(w for names in SIDE_NAMES.values() for w in names)
#: Those that stand in the names of main containers too, for a state or a neighbour of theirs.
_STATES = [*SIDE_NAMES.values(), "comments sidebar header social banner message".split()]


class PageWriter:
    """Writes pages with a label for each block, of invented words, in layouts drawn at random."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("an er in on ti es st en at re th ha le de la ou ch ung mar vel qui ção и на の".split()) for _ in range(r.randint(1, 4))) for _ in range(n))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        return self.words(self.r.randint(low, high)).capitalize() + self.r.choice(".....?!")

    def paragraph(self) -> str:
        r = self.r
        text = " ".join(self.sentence(1, 22) for _ in range(r.choice((1, 1, 2, 3, 5, 8))))
        if r.random() < 0.15:
            text = re.sub(r"(\w+)", r"<a href='/x'>\1</a>", text, count=1)
        if r.random() < 0.06:
            text = " ".join(w + r.choice(("***", "###", "%%%", "$$$", "&amp;&amp;", " |")) for w in text.split())
        return text.upper() if r.random() < 0.04 else text

    def main(self) -> list[tuple[str, int]]:
        r = self.r
        out = [(f"<h1>{self.words(r.randint(1, 12))}</h1>", 1)] if r.random() < 0.85 else []
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 13, 30))):
            kind = r.random()
            if kind < 0.08:
                out.append((f"<h{r.randint(2, 4)}>{self.words(r.randint(1, 8))}</h2>", 1))
            elif kind < 0.14:
                out += [("<ul>", -1), *((f"<li>{self.sentence(2, 14)}</li>", 1) for _ in range(r.randint(2, 5))), ("</ul>", -1)]
            elif kind < 0.18:
                out.append((f"<blockquote>{self.paragraph()}</blockquote>", 1))
            elif kind < 0.2:
                out.append((f"<pre>{self.sentence()}</pre>", 1))
            else:
                out.append((r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>")).format(self.paragraph()), 1))
        return out

    def side(self, kind: str) -> list[tuple[str, int]]:
        r = self.r
        tag = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol")}.get(kind, ("div", "section", "aside"))
        tag = r.choice(tag)
        name = self.named(SIDE_NAMES[kind]) if tag == "div" or tag == "section" or r.random() < 0.5 else ""
        body: list[str]
        if kind in ("menu", "share") or kind in ("footer", "side", "header") and r.random() < 0.5:
            items = [f"<a href='/{i}'>{self.words(r.randint(1, 3))}</a>" for i in range(r.randint(1, 8))]
            body = ["<ul>", *(f"<li>{x}</li>" for x in items), "</ul>"] if r.random() < 0.7 else ["<div>" + " ".join(items) + "</div>"]
        elif kind == "form":
            body = [f"<label>{self.words(2)}</label><input name=q>", f"<button>{self.words(1)}</button>"]
        elif kind == "comments":
            body = [f"<h3>{r.choice(('Comments', 'Replies', self.words(1)))}</h3>"]
            for _ in range(r.randint(1, 6)):
                body += [f"<div class='{r.choice(('comment', 'comment-body', 'reply'))}'>", f"<p>{self.paragraph()}</p>", "</div>"]
        elif kind == "footer":
            body = [f"<p>&copy; {r.choice(('2019', ''))} {self.words(2)} &middot; {self.sentence()}</p>"] if r.random() < 0.5 else [f"&copy; {self.words(1)}.example &middot; {self.sentence()}"]
        elif kind == "notice":
            body = [f"<p>{r.choice(('We use cookies', 'Subscribe', ''))} {self.sentence()}</p>", f"<button>{r.choice(('Accept', 'OK', self.words(1)))}</button>"]
        else:
            body = [r.choice(("<p>{}</p>", "{}", "<div>{}</div>", "<h3>{}</h3>")).format(self.sentence()) for _ in range(r.randint(1, 3))]
        return [(f"<{tag}{name}>", -1), *((b, 0) for b in body), (f"</{tag}>", -1)]

    def named(self, names: list[str]) -> str:
        r = self.r
        parts = r.sample(names, min(len(names), r.randint(1, 2)))
        if r.random() < 0.15:  # an entry-footer, a post-share
            return f" class=\"{r.choice(MAIN_NAMES)}-{parts[0]}\""
        if r.random() < 0.3:
            parts.append(r.choice(("wrap", "box", "inner", "area", "block", "item", "list", "container", "c", "x")))
        return f" {r.choice(('class', 'class', 'id'))}=\"{r.choice((' ', '-', '_')).join(parts)}\""

    def main_named(self) -> str:
        """Names of a container of main text: words for it, and often states and words that elsewhere mark side matter."""
        r = self.r
        side = lambda: r.choice(r.choice(_STATES))
        name = "-".join(r.sample(MAIN_NAMES, r.randint(1, 2)))
        if r.random() < 0.15:
            name = f"{side()}-{name}" if r.random() < 0.5 else f"{r.choice(MAIN_NAMES)}-{side()}-{r.choice(MAIN_NAMES)}"
        parts = [name]
        if r.random() < 0.55:
            kinds = (lambda: f"{side()}-{r.choice(('open', 'closed', 'on', 'off', 'enabled', self.words(1)))}", lambda: f"{r.choice(('has', 'with', 'no', 'is'))}-{side()}", side,
                     lambda: f"{side()}-{side()}", lambda: f"{r.choice(('type', 'status', 'format', 'category', 'tag'))}-{r.choice(('post', 'publish', 'standard', 'news', self.words(1)))}")
            parts += [r.choice(kinds)() for _ in range(r.choice((1, 1, 2, 4, 6)))]
            r.shuffle(parts)
        return f" {r.choice(('class', 'class', 'id'))}=\"{' '.join(parts)}\""

    def page(self) -> list[tuple[str, int]]:
        r = self.r
        main = self.main()
        for kind in r.sample(("advert", "share", "side", "form", "notice", "advert"), r.choice((0, 0, 1, 2))):
            at = r.randint(0, len(main))
            if not any("<ul>" in h for h, _ in main[:at]) or any("</ul>" in h for h, _ in main[at - 1 : at]):
                main[at:at] = self.side(kind)
        if r.random() < 0.25:
            main += self.side("comments")
        style = r.random()
        if style < 0.45:
            main = [(f"<article{self.main_named() if r.random() < 0.4 else ''}>", -1), *main, ("</article>", -1)]
        elif style < 0.6:
            main = [("<main>", -1), *main, ("</main>", -1)]
        elif style < 0.9:
            main = [(f"<div{self.main_named()}>", -1), *main, ("</div>", -1)]
        if r.random() < 0.3:
            main = [(r.choice(("<div class='container'>", "<div id='wrapper'>", "<main>")), -1), *main, ("</div></main>", -1)]
        before, after = [], []
        for kind in ("notice", "header", "menu", "advert", "form", "menu"):
            if r.random() < (0.8 if kind == "menu" else 0.35):
                before += self.side(kind)
        for kind in ("advert", "share", "side", "comments", "form", "notice", "footer"):
            if r.random() < (0.75 if kind == "footer" else 0.25):
                after += self.side(kind)
        return [*before, *main, *after]

    def labelled(self) -> tuple[str, list[int]]:
        """A page's markup and the labels of its blocks."""
        parts = self.page()
        # a mark in each part's text tells which part a block comes from
        html = "".join(h if y < 0 else re.sub(r">([^<]+)", lambda m, y=y: f">{chr(0xE000 + y)}{m[1]}", h) if h.startswith("<") else chr(0xE000 + y) + h for h, y in parts)
        texts, _, _ = blocks(html)
        return re.sub("[]", "", html), [int("" in t) for t in texts]


@cache
def trained(pages: int = 1200, seed: int = 3) -> Labeller:
    """The labeller, trained once in a process on generated pages; the same for the same arguments."""
    writer = PageWriter(seed)
    data = []
    for _ in range(pages):
        html, y = writer.labelled()
        texts, paths, links = blocks(html)
        if len(y) == len(texts) and y:
            data.append((vectors(texts, paths, links, np.arange(len(y)) / len(y)), np.array(y)))
    return Labeller().fit(data)


def extract_pages(htmls: list[str | None], model: Labeller, group: int = 64, cells: int = 200_000) -> list[str]:
    """The main text of each page."""
    found = [blocks(h or "") for h in htmls]
    out = [""] * len(htmls)
    order = sorted((i for i in range(len(htmls)) if found[i][0]), key=lambda i: len(found[i][0]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < group and (b - a + 1) * len(found[order[b]][0]) * (PATH + WORDS + MEASURES) <= cells * 16:
            b += 1
        some = order[a:b]
        texts, paths, links = ([x for i in some for x in found[i][k]] for k in range(3))
        size = [len(found[i][0]) for i in some]
        place = np.concatenate([np.arange(n) / n for n in size])
        x = np.split(vectors(texts, paths, links, place), np.cumsum(size)[:-1])
        x, mask, _ = pad([(v, np.zeros(n)) for v, n in zip(x, size, strict=True)])
        keep = model.score(x, mask) >= 0.5
        for row, i in enumerate(some):
            out[i] = "\n".join(t for t, k in zip(found[i][0], keep[row], strict=False) if k)
        a = b
    return out


def _extract(batches: Iterator[pa.RecordBatch], model, html_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = extract_pages(part.column(html_at).to_pylist(), model.value)
            rest = [c for i, c in enumerate(part.columns) if i != html_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)


def extract_main_text(pages: DataFrame, html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """pages, the markup left out, with text (the blocks labelled main text, joined by newlines) and n_chars (its code
    points). Null and empty markup, and pages without blocks or without main text, give "" and 0. Pages are independent, so
    repeats come out alike and an empty table gives an empty one. A column that has the name of a result is refused with a
    ValueError."""
    clash = {"text", "n_chars"} & set(pages.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    schema = T.StructType([f for f in pages.schema.fields if f.name != html_col] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    model = pages.sparkSession.sparkContext.broadcast(model or trained())
    return pages.mapInArrow(tidy(_extract, model=model, html_at=pages.columns.index(html_col), names=schema.names), schema)
