"""Operator 9: main text of web pages by boosted trees over DOM nodes.

A page is parsed into a tree of block elements; inline elements belong to the block
around them. Each node gets features of its subtree (text, link and tag density,
punctuation, form controls), of its tag and attribute tokens and those of its
ancestors, of its depth and of its siblings. Gradient-boosted trees give the probability
that the node holds article text. Decoding is hierarchical: the most probable labelling
in which a node below a dropped node is dropped, found by one pass up and one down.

The trees are trained here, on pages made by ``training_pages`` whose nodes carry their
labels by construction; their number is a parameter. Whole pages are scored.

Defined results: a null, empty or text-less page has the empty text; markup that ends in
the middle of a tag is text; unclosed elements close with their parents; what stands
inside scripts, forms' lists, graphics, media and embedded objects isn't text, but only
scripts, styles, titles and text areas run on to the end of the page if nothing closes
them; formulas are text of the block around them; lists of links and rows of tags inside
the article are its text; repeated rows and null ids are kept each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, texts_of
from .features import sigmoid

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|data-component)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: The element kinds of HTML.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "audio", "video", "select", "datalist", "annotation", "annotation-xml"}
#: Those of them that run to the end of the page if nothing closes them.
_RUNS_ON = {"script", "style", "title", "textarea"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var button math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mtd semantics".split()
)
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "aside", "nav", "form"}
_GROUPS = [
    {"article", "main"}, {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"nav", "menu"}, {"header"}, {"footer", "address"},
    {"aside"}, {"form", "fieldset", "dialog"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tbody", "tr", "td", "th", "thead"},
    {"section"}, {"div"}, {"figure", "figcaption"}, {"html", "body"},
]
_CUES = [
    re.compile(p, re.I)
    for p in (
        r"(?:^|[\s_-])(?:article|content|entry|post|story|main|body|text)(?:$|[\s_-])",
        r"nav|menu|breadcrumb|toc|pagination|pager|skip",
        r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|adsense)(?:$|[\s_-]|\d)",
        r"comment|discussion|disqus|repl(?:y|ies)|review",
        r"footer|copyright|colophon|legal|masthead|header|topbar|site-?(?:head|foot)",
        r"side-?bar|related|recommend|widget|popular|trending",
        r"share|social|tags?(?:$|[\s_-])|author|byline|meta",
        r"cookie|consent|notice|alert|popup|modal|newsletter|subscribe|signup|gdpr|overlay|login|search|form",
    )
]
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """Block nodes in page order and their text runs."""

    __slots__ = ("tags", "parents", "depths", "cues", "own", "runs")

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.cues = ["html"], [0], [0], [0]
        # characters, characters in links, words, punctuation, inline tags, controls, runs
        self.own: list[list[int]] = [[0] * 7]
        self.runs: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements; an inline one has its block's node
        places: dict[str, list[int]] = {"html": [], "p": []}  # where in the stack each name is open
        scopes: list[int] = []  # where in the stack the elements are that end a search
        pending: list[str] = []
        links, at, size = 0, 0, len(source)
        unclosed: set[str] = set()

        def push(name: str, node: int) -> None:
            places.setdefault(name, []).append(len(stack))
            if name in _SCOPE:
                scopes.append(len(stack))
            stack.append((name, node))

        def flush() -> None:
            if pending:
                text = " ".join(html_lib.unescape("".join(pending)).split())
                pending.clear()
                if text:
                    node = stack[-1][1]
                    own = self.own[node]
                    own[0] += len(text)
                    own[2] += text.count(" ") + 1
                    own[3] += len(_PUNCTUATION.findall(text))
                    own[6] += 1
                    self.runs.append((node, text))

        def close(k: int) -> None:
            nonlocal links
            while len(stack) > k:
                name = stack[-1][0]
                if name not in _INLINE:
                    flush()
                links -= name == "a"
                places[name].pop()
                if name in _SCOPE:
                    scopes.pop()
                stack.pop()

        def add(text: str) -> None:
            pending.append(text)
            if links:
                self.own[stack[-1][1]][1] += len(text)

        push("html", 0)
        while at < size:
            m = _TOKEN.search(source, at)
            if not m:
                add(source[at:])
                break
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, ends, attributes = name.lower(), m[1] or m[4], (m[3] or m[6] or "")
            if ends:
                k = places[name][-1] if places.get(name) else 0
                if k and (name not in _INLINE or not scopes or k > scopes[-1]):
                    close(k)
                continue
            if name == "br" or name == "wbr":
                pending.append(" ")
                continue
            node = stack[-1][1]
            if name in _RAW:
                self.own[node][5] += name in ("textarea", "select")
                if name == "svg" and attributes.rstrip().endswith("/"):
                    continue
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(source, at)
                if end or name in _RUNS_ON:
                    at = end.end() if end else size
                    continue
                unclosed.add(name)
            if name in _VOID:
                self.own[node][5] += name == "input"
                self.own[node][4] += 1
                if name == "hr":
                    flush()
                continue
            if name == "html":
                continue
            if name in _INLINE:
                self.own[node][4] += 1
                self.own[node][5] += name == "button"
                if not attributes.rstrip().endswith("/"):
                    push(name, node)
                    links += name == "a"
                continue
            flush()
            k = max((places[x][-1] for x in ("p", *_ENDED_BY.get(name, ())) if places.get(x)), default=0)
            if k > (scopes[-1] if scopes else 0):
                close(k)
            parent = stack[-1][1]
            cue = 0
            if attributes:
                words = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes))
                if words:
                    cue = sum(1 << i for i, pattern in enumerate(_CUES) if pattern.search(words))
            push(name, len(self.tags))
            self.tags.append(name)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.cues.append(cue)
            self.own.append([0] * 7)
        close(1)
        flush()


_GROUP_OF = {t: i for i, g in enumerate(_GROUPS) for t in g}


class Forest:
    """Nodes of several pages in arrays; a page's first node is its own parent."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tags) for p in pages], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(pages)), sizes)
        join = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
        self.parent = join("parents") + self.starts[self.page]
        self.depth, self.cues = join("depths"), join("cues")
        self.group = np.array([_GROUP_OF.get(t, len(_GROUPS)) for p in pages for t in p.tags], np.int64)
        self.own = np.array([x for p in pages for x in p.own], np.float64).reshape(-1, 7)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))[1:]

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.copy()
        for level in reversed(self.levels):
            np.add.at(out, self.parent[level], out[level])
        return out

    def features(self) -> np.ndarray:
        n = len(self.parent)
        inside = self.up(np.column_stack([self.own, np.ones(n)]))
        chars, links, words, marks, inline, controls, runs, nodes = inside.T
        child = self.parent != np.arange(n)
        siblings = np.bincount(self.parent[child], minlength=n)
        order = np.zeros(n)
        place = np.flatnonzero(child)
        place = place[np.argsort(self.parent[place], kind="stable")]
        heads = np.concatenate([[True], self.parent[place][1:] != self.parent[place][:-1]]) if len(place) else np.empty(0, bool)
        order[place] = np.arange(len(place)) - np.maximum.accumulate(np.where(heads, np.arange(len(place)), 0))
        count = siblings[self.parent].astype(float)
        same = np.bincount(self.parent * 32 + self.group, child, minlength=32 * n)[self.parent * 32 + self.group]
        around = chars[self.parent] - chars
        total = np.maximum(1, chars[self.starts])[self.page]
        before = np.cumsum(self.own[:, 0]) - self.own[:, 0]
        before -= before[self.starts][self.page]
        bits = (self.cues[:, None] >> np.arange(len(_CUES))) & 1
        tag = self.group[:, None] == np.arange(len(_GROUPS))
        flags = np.column_stack([bits, tag[:, [0, 4, 5, 6, 7, 8]]]).astype(float)
        above = np.zeros_like(flags)
        for level in self.levels:
            up = self.parent[level]
            above[level] = np.maximum(above[up], flags[up])
        return np.column_stack([
            tag, bits, above,
            np.log1p(chars), links / np.maximum(1, chars), np.log1p(words), marks / np.maximum(1, words), chars / (nodes + inline),
            words / np.maximum(1, runs), controls, np.log1p(nodes), inline / nodes, np.log1p(self.own[:, 0]), self.own[:, 1] / np.maximum(1, self.own[:, 0]),
            self.depth, count, order, (count - order - 1).clip(0), same / np.maximum(1, count), np.log1p(around), chars / np.maximum(1, chars[self.parent]),
            chars / total, before / total, siblings,
        ])

    def decode(self, probability: np.ndarray) -> np.ndarray:
        """Most probable labels in which a node is kept only if its parent is."""
        p = probability.clip(1e-6, 1 - 1e-6)
        drop = self.up(np.log(1 - p))
        keep = np.log(p)
        for level in reversed(self.levels):
            np.add.at(keep, self.parent[level], np.maximum(keep[level], drop[level]))
        kept = np.ones(len(p), bool)
        for level in self.levels:
            kept[level] = kept[self.parent[level]] & (keep[level] >= drop[level])
        return kept


@dataclass
class Trees:
    """Boosted complete binary trees: ``feature`` and ``cut`` by (tree, inner node), ``leaf`` by (tree, leaf)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            z += leaf[at - inner]
        return sigmoid(z)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Gradient boosting of the log-loss with second-order leaf values and histogram splits."""
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    cells = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    n_features, inner = x.shape[1], 2**depth - 1
    share = y.mean().clip(1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    z = np.full(len(x), base)
    feature, cut, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    offsets = np.arange(n_features) * bins
    for t in range(trees):
        p = sigmoid(z)
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((at - first)[:, None] * n_features * bins + offsets + cells).ravel()
            size = width * n_features * bins
            sums = [np.bincount(key, np.repeat(v, n_features), size).reshape(width, n_features, bins).cumsum(2) for v in (g, h)]
            (gl, gt), (hl, ht) = ((s[:, :, :-1], s[:, :, -1:]) for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-6:
                    feature[t, first + k], cut[t, first + k] = f, edges[f, b]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[t][at]] > cut[t][at])
        at -= inner
        leaves[t] = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        z += leaves[t][at]
    return Trees(feature, cut, leaves, base)


#: Attribute values of the made pages: for each region, what sites commonly write.
_NAMES = {
    "article": ["content", "article-body", "post", "entry-content", "story", "main-text", ""],
    "nav": ["menu", "main-nav", "navbar", "breadcrumb", ""],
    "ad": ["ad", "ads", "advert", "banner-ad", "sponsored", "promo", "ad-slot"],
    "comments": ["comments", "comment-list", "discussion", "replies"],
    "footer": ["footer", "site-footer", "copyright", ""],
    "header": ["header", "masthead", "topbar", ""],
    "sidebar": ["sidebar", "side-bar", "related", "widget", "recommended", ""],
    "notice": ["cookie-notice", "consent", "notice", "newsletter", "alert"],
    "form": ["search", "login-form", "subscribe", ""],
    "share": ["share", "social", "tags", "byline", "author", "post-meta"],
    "references": ["references", "sources", "footnotes", "links", "further-reading", ""],
}
_SYLLABLES = "an er in on th re st de la mo ri ta ne ko lu sa pe vi do ga el or um ki sch eau ción ñ ß é".split()


class _Maker:
    """Writes one page, with every block element's label in an attribute that parsing doesn't read."""

    def __init__(self, rng: random.Random):
        self.rng, self.bare = rng, rng.random() < 0.3

    def words(self, low: int, high: int) -> str:
        rng, out = self.rng, []
        noise = rng.choice(["", "", "", "!!", "***", " |"])
        for _ in range(rng.randint(low, high)):
            out.append("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) + (rng.choice(",.") if rng.random() < 0.15 else "") + noise)
        return " ".join(out).capitalize() + rng.choice([".", ".", ""])

    def el(self, tag: str, inside: str, label: int, names: str | None = None, close: bool = True) -> str:
        name = self.rng.choice(_NAMES[names]) if names else ""
        if self.bare and names != "ad":
            name = ""
        attribute = f' {self.rng.choice(["class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute} y{label}>{inside}" + (f"</{tag}>" if close else "")

    def links(self, low: int, high: int) -> str:
        items = [self.el("li", f'<a href="#">{self.words(1, 4)}</a>', 0) for _ in range(self.rng.randint(low, high))]
        return self.el("ul", "".join(items), 0)

    def paragraphs(self) -> str:
        rng, out = self.rng, []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            text = self.words(1, rng.choice([3, 20, 60, 150]))
            if rng.random() < 0.2:
                text = f"<b>{text}" + ("</b>" if rng.random() < 0.5 else "<br>")
            if rng.random() < 0.2:
                text += f' <a href="#">{self.words(1, 3)}</a> {self.words(2, 20)}'
            if kind < 0.75:
                out.append(self.el("p", text, 1, close=rng.random() < 0.8))
            elif kind < 0.8:
                out.append(self.el(rng.choice(["h2", "h3"]), self.words(2, 7), 1))
            elif kind < 0.86:
                out.append(self.el("ul", "".join(self.el("li", self.words(3, 20), 1) for _ in range(rng.randint(2, 5))), 1))
            elif kind < 0.9:
                out.append(self.el("blockquote", self.el("p", text, 1), 1))
            elif kind < 0.93:
                rows = "".join(self.el("tr", "".join(self.el("td", self.words(1, 4), 1) for _ in range(3)), 1) for _ in range(rng.randint(2, 5)))
                out.append(self.el("table", rows, 1))
            elif kind < 0.96:
                out.append(self.el("div", self.words(2, 8), 0, "ad"))
            else:
                out.append(self.el("pre", text, 1))
        return "".join(out)

    def references(self) -> str:
        """A list of links that is part of the article."""
        rng = self.rng
        link = lambda: f'<a href="#">{self.words(1, 9)}</a>' + (f" {self.words(1, 8)}" if rng.random() < 0.3 else "")
        items = "".join(self.el("li", link(), 1, close=rng.random() < 0.8) for _ in range(rng.randint(1, 8)))
        found = (self.el(rng.choice(["h2", "h3"]), self.words(1, 3), 1) if rng.random() < 0.6 else "") + self.el(rng.choice(["ul", "ol"]), items, 1)
        return self.el(rng.choice(["div", "section"]), found, 1, "references") if rng.random() < 0.4 else found

    def article(self) -> str:
        rng = self.rng
        title = self.el("h1", self.words(2, 12), 1)
        if rng.random() < 0.15:
            title = self.el("header", title, 1)
        inside = (title if rng.random() < 0.9 else "") + self.paragraphs()
        if rng.random() < 0.25:
            inside += self.references()
            if rng.random() < 0.3:
                inside += self.paragraphs()
        links = lambda: " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(4))
        if rng.random() < 0.4:
            row = self.el("div", links() if rng.random() < 0.6 else self.words(1, 6), 1, "share")
            inside = row + inside if rng.random() < 0.3 else inside + row
        if rng.random() < 0.1:
            inside += self.el("footer", links(), 0, "footer")
        for kind in ("ad", "comments", "sidebar", "nav", "form", "notice"):
            if rng.random() < 0.08:
                inside += self.extra(kind)
        if rng.random() < 0.15:
            return inside
        if rng.random() < 0.5:
            return self.el("article", inside, 1)
        if rng.random() < 0.4:
            return self.el("main", self.el("div", inside, 1, "article") if rng.random() < 0.5 else inside, 1)
        return self.el(rng.choice(["div", "section"]), inside, 1, "article")

    def extra(self, kind: str) -> str:
        rng = self.rng
        if kind == "nav":
            return self.el(rng.choice(["nav", "nav", "div"]), self.links(2, 9), 0, "nav")
        if kind == "header":
            return self.el(rng.choice(["header", "div"]), self.el("div", self.words(1, 5), 0) + (self.links(2, 6) if rng.random() < 0.5 else ""), 0, "header")
        if kind == "ad":
            return self.el(rng.choice(["div", "aside", "section"]), self.words(2, 25) if rng.random() < 0.6 else self.el("p", self.words(2, 25), 0), 0, "ad")
        if kind == "sidebar":
            return self.el(rng.choice(["aside", "aside", "div"]), self.el("h3", self.words(1, 3), 0) + (self.links(2, 6) if rng.random() < 0.6 else self.el("p", self.words(3, 30), 0)), 0, "sidebar")
        if kind == "notice":
            return self.el(rng.choice(["div", "section", "dialog"]), self.el("p", self.words(4, 30), 0) + "<button>Ok</button>", 0, "notice")
        if kind == "form":
            return self.el("form", f"<label>{self.words(1, 3)}</label><input><button>Go</button>", 0, "form")
        if kind == "comments":
            one = lambda: self.el(rng.choice(["div", "li", "article"]), self.el("p", self.words(3, 40), 0), 0)
            title = self.words(1, 2) if rng.random() < 0.5 else f"{rng.randint(0, 40)} {self.words(1, 1)}"
            heading = self.el(rng.choice(["h2", "h3", "h4", "p", "div"]), title, 0) if rng.random() < 0.85 else ""
            return self.el(rng.choice(["div", "section"]), heading + "".join(one() for _ in range(rng.randint(0, 6))), 0, "comments")
        return self.el(rng.choice(["footer", "footer", "div"]), f"&copy; {self.words(1, 3)} &middot; {self.words(1, 20)}" if rng.random() < 0.5 else self.el("p", self.words(2, 20), 0), 0, "footer")

    def page(self) -> str:
        rng = self.rng
        more = rng.choice([0.0, 0.5, 1.0, 1.0, 1.0])
        above = [k for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5 * more]
        below = [k for k in ("sidebar", "comments", "ad", "form", "nav", "notice") if rng.random() < 0.4 * more]
        rng.shuffle(above)
        rng.shuffle(below)
        top, tail = "".join(map(self.extra, above)), "".join(map(self.extra, below))
        middle = self.article() if rng.random() < 0.96 else ""
        foot = self.extra("footer") if rng.random() < 0.8 else ""
        body = top + (self.el("div", middle + tail, int(bool(middle))) if rng.random() < 0.5 else middle + tail) + foot
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{}}</style></head>{self.el('body', body, 1)}</html>"


def training_pages(n: int, seed: int = 11) -> tuple[list[Page], np.ndarray]:
    """``n`` made pages and the labels of their nodes."""
    rng, pages, labels = random.Random(seed), [], []
    for _ in range(n):
        source = _Maker(rng).page()
        page = Page(source)
        marks = [int(x) for x in re.findall(r"<(?!html)[a-z0-9]+(?: (?:class|id)=\"[^\"]*\")? y([01])>", source)]
        if len(marks) == len(page.tags) - 1 - page.tags.count("head"):
            at = iter(marks)
            labels += [0 if t == "head" else 1 if i == 0 else next(at) for i, t in enumerate(page.tags)]
            pages.append(page)
    return pages, np.array(labels, np.float64)


@lru_cache
def fit(pages: int = 1000) -> Trees:
    """The trees, trained once per process."""
    made, y = training_pages(pages)
    return boost(Forest(made).features(), y)


def extract(sources: list[str], trees: Trees) -> list[str]:
    """The main texts of whole pages."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    kept = forest.decode(trees(forest.features()))
    return ["\n".join(text for node, text in page.runs if kept[start + node]) for page, start in zip(pages, forest.starts)]


def main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    held = pages.sparkSession.sparkContext.broadcast(trees)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract(texts_of(part, "html"), held.value)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    return map_slices(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", "html")
