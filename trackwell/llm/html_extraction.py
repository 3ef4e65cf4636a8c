"""Main text of web pages: boosted trees over DOM-node features, then a choice that no ancestor contradicts."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import free_name

#: Fixed lists of element names.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript title head svg annotation annotation-xml iframe object audio video canvas select datalist textarea".split())
KINDS = (
    ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("nav",), ("aside",), ("header",), ("footer",),
    ("form", "fieldset", "button", "dialog"), ("section",), ("article", "main"), ("div", "center", "details", "summary"), ("table", "tbody", "thead", "tr", "td", "th"),
    ("blockquote", "pre", "figure", "figcaption"), ("body", "html"),
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What stands in a head, and what ends an svg element that was left open.
IN_HEAD = frozenset("title base basefont bgsound link meta script style template noscript noframes".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
#: Groups of words in class, id and role attributes. Fixed lists.
TOKENS = (
    "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted adsense banner".split(),
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc skip topbar".split(),
    "sidebar side aside widget widgets rail related recommended popular trending more tags tagcloud".split(),
    "footer foot colophon copyright legal".split(),
    "header masthead head top logo branding site".split(),
    "comment comments respond reply replies discussion disqus feedback thread".split(),
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall message".split(),
    "form login signup search subscribe subscription newsletter share sharing social contact".split(),
    "article content main post entry story body text prose page blog".split(),
)
_TOKEN_GROUP = {w: n for n, group in enumerate(TOKENS) for w in group}
_KIND = {t: n for n, group in enumerate(KINDS) for t in group}
_SPACE = re.compile(r"\s+")
N_FEATURES = len(KINDS) + 2 * len(TOKENS) + 22
SEED = 5


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    marks: int = 0
    links: int = 0  # characters inside links, in the node itself
    inputs: int = 0


class _Hidden(list):
    """The tags of hidden elements, outermost first, with their counts, so that no tag of a page walks over all of them."""

    def __init__(self):
        super().__init__()
        self.counts: Counter = Counter()

    def append(self, tag: str) -> None:
        super().append(tag)
        self.counts[tag] += 1

    def cut(self, at: int) -> None:
        """Leaves the outermost `at` elements."""
        while len(self) > at:
            self.counts[self.pop()] -= 1

    def innermost(self, tag: str) -> int:
        return next(n for n in range(len(self) - 1, -1, -1) if self[n] == tag) if self.counts[tag] else -1

    @property
    def has_blocks(self) -> bool:
        return any(n for t, n in self.counts.items() if t not in INLINE and t not in UNSEEN)


class _Tree(HTMLParser):
    """Block-level nodes in page order, and runs of text that each belong to one of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0)]
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.runs: list[tuple[int, list[str]]] = []
        self.link = self.nodes_then = 0
        self.hidden_by = _Hidden()

    @property
    def here(self) -> int:
        return self.open[-1][1]

    def _close(self, upto: int) -> None:
        for tag, _ in self.open[upto:]:
            self.link -= tag == "a"
        del self.open[upto:]

    def _ends_hidden(self, tag: str) -> bool:
        """Whether a start tag ends what is hidden, whose own end tag was left out; hidden elements inside it that the tag ends are closed."""
        hidden = self.hidden_by
        if hidden[0] == "head" and (tag == "body" or len(hidden) == 1 and tag not in IN_HEAD and tag != "head"):
            hidden.cut(0)
        elif hidden[0] == "svg" and tag in BREAKOUT and not any(hidden.counts[t] for t in ("foreignobject", "desc", "title", "annotation-xml")):
            hidden.cut(0)
        elif tag not in INLINE and tag not in UNSEEN and (tag not in VOID or tag == "hr"):  # as visible elements end each other
            for n in range(len(self.open) + len(hidden) - 1, 0, -1):
                other = hidden[n - len(self.open)] if n >= len(self.open) else self.open[n][0]
                if other in CLOSES.get(tag, ()) or other == "p":
                    hidden.cut(max(0, n - len(self.open)))
                    if tag not in CLOSES:
                        break
                elif other in UNSEEN or other not in INLINE and (tag not in CLOSES or other in ("ul", "ol", "dl", "table", "div", "section")):
                    break
        return not hidden

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a malformed declaration is a comment up to the next >
            return self.rawdata.find(">", i + 2) + 1 or -1

    def handle_starttag(self, tag, attrs):
        if self.hidden_by and not self._ends_hidden(tag):
            if tag not in VOID:
                self.hidden_by.append(tag)
            return
        if tag in UNSEEN:
            self.hidden_by.append(tag)
            if tag != "title":
                self.nodes[self.here].inputs += tag in ("select", "textarea")
            return
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.runs.append((self.here, []))
            elif tag == "input":
                self.nodes[self.here].inputs += 1
            return
        unseen = any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)
        if tag in INLINE:
            if unseen:
                self.hidden_by.append(tag)
                return
            self.link += tag == "a"
            self.open.append((tag, self.here))
            return
        if tag in ("html", "body") and any(t == tag for t, _ in self.open):
            return
        for n in range(len(self.open) - 1, 0, -1):  # what this element ends
            other = self.open[n][0]
            if other in CLOSES.get(tag, ()) or other == "p":
                self._close(n)
                break
            if other not in INLINE and other not in ("p",) and (tag not in CLOSES or other in ("ul", "ol", "dl", "table", "div", "section")):
                break
        while self.open[-1][0] in INLINE and len(self.open) > 1:
            self._close(len(self.open) - 1)
        words = [w for k, v in attrs if k in ("class", "id", "role", "aria-label") and v for w in re.split(r"[^a-z]+", v.lower())]
        marks = 0
        for w in words:
            if w in _TOKEN_GROUP:
                marks |= 1 << _TOKEN_GROUP[w]
        if unseen:
            self.hidden_by.append(tag)
            return
        self.nodes.append(Node(tag, self.here, self.nodes[self.here].depth + 1, marks))
        self.open.append((tag, len(self.nodes) - 1))

    def handle_endtag(self, tag):
        if self.hidden_by:
            if (at := self.hidden_by.innermost(tag)) >= 0:
                self.hidden_by.cut(at)
                return
            blocked = tag in INLINE and self.hidden_by.has_blocks
            if blocked or tag not in ("html", "body") and all(t != tag for t, _ in self.open):
                return
            self.hidden_by.cut(0)  # an ancestor ends, and what is hidden with it
        if tag in ("html", "body"):
            return
        for n in range(len(self.open) - 1, 0, -1):
            if self.open[n][0] == tag:
                self._close(n)
                return
            if tag in INLINE and self.open[n][0] not in INLINE:
                return

    def handle_data(self, data):
        if self.hidden_by == ["head"] and data.strip():
            self.hidden_by.cut(0)
        if self.hidden_by or not data:
            return
        if not self.runs or self.runs[-1][0] != self.here or self.nodes_then != len(self.nodes):
            self.runs.append((self.here, []))
            self.nodes_then = len(self.nodes)
        self.runs[-1][1].append(data)
        if self.link:
            self.nodes[self.here].links += len(data.strip())


def parse(html: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (parents first) and the non-blank text blocks: (node, text with single spaces)."""
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except AssertionError:  # what it has read counts
        pass
    blocks = [(n, _SPACE.sub(" ", "".join(parts)).strip()) for n, parts in tree.runs]
    return tree.nodes, [(n, t) for n, t in blocks if t]


def features(nodes: list[Node], blocks: list[tuple[int, str]]) -> np.ndarray:
    """Numbers for each node: kind, attribute tokens of its own and of ancestors, subtree and link density, depth, siblings."""
    n = len(nodes)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    chars, words, marks, links, ends, count, inputs, kids, seen = (np.zeros(n) for _ in range(9))
    parent = np.array([x.parent for x in nodes])
    for at, text in blocks:
        chars[at] += len(text)
        words[at] += text.count(" ") + 1
        marks[at] += sum(map(text.count, ",;:()"))
        ends[at] += sum(map(text.count, ".!?"))
        seen[at] += 1
    own = chars.copy()
    links += [x.links for x in nodes]
    inputs += [x.inputs for x in nodes]
    count += 1
    order = np.zeros(n)
    same = np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        order[i] = kids[p]
        kids[p] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, words, marks, links, ends, count, inputs, seen):
            a[p] += a[i]
    alike: dict[tuple[int, str], int] = {}
    for x in nodes:
        alike[x.parent, x.tag] = alike.get((x.parent, x.tag), 0) + 1
    above = np.zeros(n, dtype=np.int64)
    bad_above = np.zeros(n)
    good_above = np.zeros(n)
    before = np.zeros(n)
    total, running = max(1.0, chars[0]), 0.0
    for i, x in enumerate(nodes):
        if i:
            p = x.parent
            above[i] = above[p] | nodes[p].marks
            bad_above[i] = max(bad_above[p], nodes[p].tag in ("nav", "aside", "footer", "form", "fieldset", "dialog"))
            good_above[i] = max(good_above[p], nodes[p].tag in ("article", "main"))
        same[i] = alike[x.parent, x.tag]
        before[i] = running
        running += own[i]
        kind = _KIND.get(x.tag, -1)
        if kind >= 0:
            out[i, kind] = 1
        for g in range(len(TOKENS)):
            out[i, len(KINDS) + g] = x.marks >> g & 1
            out[i, len(KINDS) + len(TOKENS) + g] = above[i] >> g & 1
    up = np.maximum(parent, 0)
    siblings = np.maximum(1, kids[up])
    full = np.maximum(1.0, chars)
    base = len(KINDS) + 2 * len(TOKENS)
    columns = [
        np.log1p(chars), chars / total, links / full, np.log1p(words), words / np.maximum(1, seen), marks / full * 100, ends / np.maximum(1, words),
        np.log1p(count), full / count / 100, [x.depth for x in nodes], order / siblings, siblings, same / siblings, np.log1p(kids), inputs,
        bad_above, good_above, before / total, chars / np.maximum(1, chars[up]), own / full, links[up] / full[up], np.log1p(chars[up]),
    ]
    for k, c in enumerate(columns):
        out[:, base + k] = c
    return out


class BoostedTrees:
    """Gradient boosting for log loss: depth-limited trees on binned features, found level by level from histograms."""

    def __init__(self, trees: int = 70, depth: int = 4, rate: float = 0.2, bins: int = 32, leaf: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
        flat = binned + np.arange(m) * self.bins
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        logit = np.full(n, self.base)
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-logit))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                slot = ((at - first)[:, None] * (m * self.bins) + flat).ravel()
                hist = [
                    np.bincount(slot, np.repeat(v, m), width * m * self.bins).reshape(width, m, self.bins).cumsum(axis=2) for v in (g, h)
                ]
                gl, hl = hist
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.leaf) + (gt - gl) ** 2 / (ht - hl + self.leaf) - gt**2 / (ht + self.leaf)
                gain[:, :, -1] = -1
                best = gain.reshape(width, -1).argmax(axis=1)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.bins)
                    if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                        feature[first + k], cut[first + k] = j, cuts[j][b]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
            leaf = at - inner
            value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.leaf) * self.rate
            self.forest.append((feature, cut, value))
            logit += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.forest:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def decode(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """Keeps or drops nodes so that nothing below a dropped node is kept, with the greatest likelihood of all nodes' choices.

    Bottom up: a dropped node drops its whole subtree, a kept one lets each child choose. The
    root is always kept. Top down: the choices are read off.
    """
    keep_gain = -np.logaddexp(0, -logit)
    drop_gain = -np.logaddexp(0, logit)
    keep, drop = keep_gain.copy(), drop_gain.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(len(nodes), dtype=bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


# Training pages: made up from a seed, so that what is wanted of every node is known.

def _words(rng: random.Random, lo: int, hi: int) -> str:
    syllables = "ka lo mi tu ren sal ver don pi qua ne stra ble ion ty er ü é ñ the an de la und of".split()
    n = rng.randint(lo, hi)
    words = ["".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(n)]
    if rng.random() < 0.15:
        words = [w + rng.choice(("###", "&amp;&amp;", "%%%", " |", "!!")) for w in words]
    for i in range(rng.randint(5, 14), n, 11):
        words[i] += rng.choice((".", ".", ","))
    return (" ".join(words).capitalize()) + rng.choice((".", ".", ".", "", "?"))


def _junk(rng: random.Random) -> str:
    link = lambda: f'<a href="/{rng.randint(0, 999)}">{_words(rng, 1, 4).rstrip(".?")}</a>'
    items = lambda lo, hi: "".join(f"<li>{link()}</li>" for _ in range(rng.randint(lo, hi)))
    paragraph = lambda lo=3, hi=40: f"<p>{_words(rng, lo, hi)}</p>"
    name = lambda group: rng.choice(TOKENS[group])
    div = lambda group, body: (f'<{rng.choice(("div", "section", "div", "aside"))} {rng.choice(("class", "id"))}="{rng.choice(("", "site-", "box ", "block-"))}{name(group)}">{body}</X>')
    kinds = [
        lambda: f"<nav><ul>{items(2, 9)}</ul></nav>", lambda: div(1, f"<ul>{items(2, 9)}</ul>"), lambda: div(1, link() * rng.randint(2, 6)),
        lambda: div(0, _words(rng, 1, 40)), lambda: div(0, paragraph()), lambda: f"<aside>{paragraph() * rng.randint(1, 3)}</aside>",
        lambda: div(2, f"<h3>{_words(rng, 1, 3)}</h3><ul>{items(2, 8)}</ul>"), lambda: div(2, paragraph(5, 60)),
        lambda: f"<aside><h3>{_words(rng, 1, 3)}</h3><ul>{items(2, 8)}</ul></aside>",
        lambda: div(5, f"<h3>{_words(rng, 1, 3)}</h3>" + "".join(f'<div class="{name(5)}">{paragraph(4, 60)}</div>' for _ in range(rng.randint(1, 6)))),
        lambda: f'<section id="comments"><h2>{_words(rng, 1, 2)}</h2><ol>' + "".join(f"<li>{paragraph(4, 60)}</li>" for _ in range(rng.randint(1, 6))) + "</ol></section>",
        lambda: div(6, paragraph(5, 40) + "<button>Ok</button>"), lambda: div(6, _words(rng, 4, 30)),
        lambda: f'<form><label>{_words(rng, 1, 4)}</label><input name="q"><button>{_words(rng, 1, 2)}</button></form>',
        lambda: div(7, f'<form><p>{_words(rng, 2, 20)}</p><input type="email"></form>'), lambda: div(7, link() * rng.randint(2, 5)),
        lambda: div(3, paragraph(2, 30)), lambda: div(4, f"<h2>{_words(rng, 1, 3)}</h2>{paragraph(2, 10)}"),
    ]
    out = rng.choice(kinds)()
    return out.replace("</X>", f"</{re.match(r'<(\w+)', out)[1]}>")


def _block(rng: random.Random) -> str:
    """A block of an article."""
    text = _words(rng, 1, 90)
    if rng.random() < 0.3:
        text = text.replace(" ", f' <a href="#">{_words(rng, 1, 3)}</a> ', rng.randint(1, 3))
    kind = rng.random()
    if kind < 0.66:
        return rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<p><em>{text}</em></p>"))
    if kind < 0.76:
        return f"<h2>{_words(rng, 1, 8)}</h2>"
    if kind < 0.84:
        return "<ul>" + "".join(f"<li>{_words(rng, 2, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
    if kind < 0.89:
        return f"<blockquote><p>{text}</p></blockquote>"
    if kind < 0.92:
        return "<table>" + "".join(f"<tr><td>{_words(rng, 1, 5)}</td><td>{_words(rng, 1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
    if kind < 0.95:
        return f'<figure><img src="x.png"><figcaption>{_words(rng, 2, 15)}</figcaption></figure>'
    if kind < 0.97:
        return f"<details><summary>{_words(rng, 1, 6)}</summary><p>{text}</p></details>"
    return f"<div>{text}</div>"


def training_page(rng: random.Random) -> str:
    """A made-up page; wanted text stands in elements with data-want, and only there."""
    title = _words(rng, 1, 12)
    heading = f"<h1>{title}</h1>"
    if rng.random() < 0.3:
        heading = f"<header>{heading}" + (f"<p>{_words(rng, 2, 12)}</p>" if rng.random() < 0.5 else "") + "</header>"
    blocks = [_block(rng) for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14)))]
    article = heading * (rng.random() < 0.9) + "".join(blocks)
    inner = [_junk(rng) for _ in range(rng.choice((0, 0, 0, 1, 2)))]  # junk inside the article
    cut = rng.randint(0, len(blocks))
    if inner:
        article = heading + "".join(blocks[:cut]) + f"<z>{inner[0]}</z>" + "".join(blocks[cut:]) + "".join(f"<z>{x}</z>" for x in inner[1:])
    shell = rng.choice(("article", "article", "article", "main", "div class='content'", "div id='main-content'", "div class='post-body'", "section class='entry'", "main><article"))
    close = "".join(f"</{t.split()[0].strip('>')}>" for t in reversed(shell.split("><")))
    page = f"<{shell} data-want>{article}{close}" if "><" not in shell else f"<main><article data-want>{article}{close}"
    before = "".join(_junk(rng) for _ in range(rng.choice((0, 1, 2, 2, 3))))
    after = "".join(_junk(rng) for _ in range(rng.choice((0, 1, 1, 2, 3))))
    top = rng.choice(("", f"<header><h2>{_words(rng, 1, 3)}</h2><a href='/'>{_words(rng, 1, 2)}</a></header>", f"<header><p>{_words(rng, 1, 8)}</p></header>"))
    foot = rng.choice(("", f"<footer>&copy; {_words(rng, 2, 25)}</footer>", f"<footer><p>{_words(rng, 2, 25)}</p></footer>"))
    if rng.random() < 0.25:
        page = f"<div class='{rng.choice(('wrapper', 'container', 'page', 'row'))}'>{before}{page}{after}</div>"
        before = after = ""
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><script>var a='</p>';</script>{top}{before}{page}{after}{foot}</body></html>"


def _bare_page(rng: random.Random) -> str:
    """A made-up page whose article has no element of its own: its blocks, one to hundreds, stand in the body beside what isn't wanted. <w> marks them."""
    size = rng.choice((1, 2, 3, 3, 4, 6, 10, 18, 30, 60, 120, 250))
    plain = rng.random() < 0.5
    blocks = [f"<p>{_words(rng, 6, 90)}</p>" if plain else _block(rng) for _ in range(size)]
    if rng.random() < 0.7:
        blocks.insert(0, f"<h1>{_words(rng, 1, 12)}</h1>")
    junk = rng.random() < 0.65
    some = lambda most: "".join(_junk(rng) for _ in range(rng.randint(0, most))) if junk else ""
    cut = rng.randint(0, len(blocks))
    middle = some(1) if rng.random() < 0.3 else ""
    top = f"<header><a href='/'>{_words(rng, 1, 3)}</a></header>" if junk and rng.random() < 0.4 else ""
    foot = rng.choice((f"<footer>&copy; {_words(rng, 2, 25)}</footer>", f"<footer><p>{_words(rng, 2, 25)}</p></footer>", f"<hr><p><small>&copy; {_words(rng, 1, 6)}</small></p>")) if junk and rng.random() < 0.6 else ""
    article = f"<w>{''.join(blocks[:cut])}</w>{middle}<w>{''.join(blocks[cut:])}</w>"
    return f"<html><head><title>x</title></head><body>{top}{some(2)}{article}{some(3)}{foot}</body></html>"


def _plain_page(rng: random.Random) -> str:
    """A made-up page of bare divs with generated class names, as site builders make them: only density, links, place and kin tell parts apart."""
    def name() -> str:
        return rng.choice(("", "", f' class="{rng.choice("abcdefg")}{rng.randrange(16**4):04x}"', f' class="css-{rng.randrange(36**3)} r{rng.randrange(99)}"', f' id="n{rng.randrange(999)}"'))

    def say(lo: int, hi: int) -> str:
        return _words(rng, lo, hi).replace("###", "").replace("%%%", "").replace("!!", "")

    link = lambda lo=1, hi=4: f'<a href="/{rng.randrange(999)}">{say(lo, hi).rstrip(".?")}</a>'
    box = lambda body, tag="div": f"<{tag}{name()}>{body}</{tag}>"
    many = lambda make, lo, hi: "".join(make() for _ in range(rng.randint(lo, hi)))
    unit = rng.choice(("p", "p", "div", "div", "section"))
    menu = lambda: box(rng.choice((many(lambda: box(link()), 3, 9), many(lambda: link() + " ", 3, 9), "<ul>" + many(lambda: f"<li>{link()}</li>", 3, 9) + "</ul>")))
    teaser = lambda: box(box(link(2, 8)) + (box(say(3, 14)) if rng.random() < 0.6 else ""))
    person = lambda: box(box(f"{link(1, 2)} {rng.randint(1, 28)} {rng.choice(('h', 'days', 'May'))}") + box(say(3, 40), "p") + rng.choice(("", box(link(1, 1) + link(1, 1)))))
    paragraph = lambda: box(say(18, 110).replace(" ", f" {link(1, 3)} ", int(rng.random() < 0.25)), unit)
    other = lambda: rng.choice((
        lambda: f"<h2>{say(1, 7)}</h2>",
        lambda: "<ul>" + many(lambda: f"<li>{say(3, 22)}</li>", 2, 6) + "</ul>", lambda: box(say(6, 40), "blockquote"),
        lambda: "<figure><img src='a.jpg'><figcaption>" + say(2, 14) + "</figcaption></figure>", lambda: box(f"<span>{say(12, 60)}</span>", unit),
    ))()
    body = "".join(paragraph() if rng.random() < 0.8 else other() for _ in range(rng.randint(2, 16)))
    head = f"<h1>{say(2, 12)}</h1>" + (box(f"{say(1, 2)} {link(1, 2)} · {rng.randint(1, 28)} {say(1, 1)}", rng.choice(("div", "p", "span"))) if rng.random() < 0.6 else "")
    if rng.random() < 0.3:
        head = box(head)
    inner = body if rng.random() < 0.4 else box(body)
    if rng.random() < 0.35:
        cut = inner.find(f"</{unit}>") + len(unit) + 3
        inner = inner[:cut] + "<z>" + rng.choice((teaser, lambda: box("<form><input><button>" + say(1, 2) + "</button></form>" + say(2, 10)), menu))() + "</z>" + inner[cut:]
    article = f"<div{name()} data-want>{head}{inner}</div>"
    for _ in range(rng.choice((0, 0, 1, 2))):
        article = box(article)
    top = rng.choice(("", box(box(link()) + menu()), menu(), box(say(1, 4)) + menu()))
    side = rng.choice(("", "", box(f"<h3>{say(1, 3)}</h3>" + many(teaser, 2, 8)), box(many(teaser, 2, 8)), menu()))
    after = rng.choice(("", box(f"<h3>{say(1, 3)}</h3>" + many(teaser, 2, 6)), box(f"<h3>{say(1, 2)}</h3>" + many(person, 1, 14)), box(many(person, 2, 25))))
    note = rng.choice(("", "", box(say(5, 30) + f"<button>{say(1, 2)}</button>"), box(box(say(4, 20), "p") + link(1, 2) + f"<button>{say(1, 1)}</button>")))
    foot = rng.choice(("", box(menu() + box("&copy; " + say(2, 12))), box("&copy; " + say(2, 20) + " " + many(lambda: link() + " ", 2, 6)), box(say(2, 10), "p") + menu()))
    middle = box(side + article) if rng.random() < 0.3 else box(article + side) if rng.random() < 0.5 else article + side
    return f"<html><head><meta charset=utf-8><title>x</title></head><body{name()}>{note if rng.random() < 0.5 else ''}{top}{middle}{after}{foot}{note if rng.random() < 0.3 else ''}</body></html>"


class _Wanted(_Tree):
    """Also tells which nodes stand in wanted parts; <z> marks junk inside them, <w> wanted parts that no element holds."""

    def __init__(self):
        super().__init__()
        self.wanted: dict[int, bool] = {0: False}

    def handle_starttag(self, tag, attrs):
        if tag in ("z", "w"):
            self.open.append((tag, self.here))
            return
        n = len(self.nodes)
        super().handle_starttag(tag, attrs)
        if len(self.nodes) > n:
            inside = self.wanted[self.nodes[n].parent] or any(k == "data-want" for k, _ in attrs) or any(t == "w" for t, _ in self.open)
            self.wanted[n] = inside and not any(t == "z" for t, _ in self.open)


@lru_cache(maxsize=2)
def trained(pages: int = 700, plain: int = 450, bare: int = 250, seed: int = SEED) -> BoostedTrees:
    """The model, fitted on made-up pages, besides `plain` of bare divs and `bare` of bare bodies: a node is kept if it lies in the article or holds it."""
    rng = random.Random(seed)
    xs, ys = [], []
    for make in [training_page] * pages + [_plain_page] * plain + [_bare_page] * bare:
        tree = _Wanted()
        tree.feed(make(rng))
        tree.close()
        blocks = [(n, _SPACE.sub(" ", "".join(t)).strip()) for n, t in tree.runs]
        keep = np.array([tree.wanted[i] for i in range(len(tree.nodes))])
        for i in range(len(keep) - 1, 0, -1):
            keep[tree.nodes[i].parent] |= keep[i]
        xs.append(features(tree.nodes, [b for b in blocks if b[1]]))
        ys.append(keep)
    return BoostedTrees().fit(np.vstack(xs).astype(np.float64), np.concatenate(ys).astype(np.float64))


def main_blocks(pages: list[str | None], model: BoostedTrees) -> list[list[str]]:
    """The kept text blocks of each page, in page order."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    logit = model.predict(np.vstack([features(*p) for p in parsed]).astype(np.float64))
    out, at = [], 0
    for nodes, blocks in parsed:
        kept = decode(nodes, logit[at : at + len(nodes)])
        at += len(nodes)
        out.append([t for n, t in blocks if kept[n]])
    return out


def extract(pages: DataFrame, model: BoostedTrees | None = None, batch: int = 64) -> DataFrame:
    """pages with an array column `blocks`: the main text's blocks in page order, character references decoded, white space single.

    Null and empty pages give no blocks; pages of any length are read whole, `batch` at a
    time. Markup may be malformed. Repeated rows are treated each by itself; an empty table
    gives an empty result. Nothing is shuffled; the model, some kilobytes, goes with the tasks.
    """
    model = model or trained()

    @F.arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            html = column.to_pylist()
            yield pa.array([b for i in range(0, len(html), batch) for b in main_blocks(html[i : i + batch], model)], pa.list_(pa.string()))

    return pages.withColumn(free_name(pages, "blocks"), find("html"))
