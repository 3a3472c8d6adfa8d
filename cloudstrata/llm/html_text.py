"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read by a tolerant tokenizer into leaf blocks: runs of text between
block-level tags, each with the stack of elements around it. Features are the
ancestors' tags, words of their class, id and role attributes, and properties of
the text and its links. The field labels each block main or other; Viterbi
decodes the page; main blocks are joined in page order.

The field is trained on labelled pages. They are made by rule here, in many
layouts, languages and degrees of bad markup, because no table has labels; the
seed and the number are parameters, and the same call gives the same field.

Scripts, styles, comments of the markup and hidden elements have no text, nor
have drawings, embedded objects, form fields and what is there for browsers without scripts
(RAW below): a browser doesn't show these. It does show what is hidden from readers-aloud only (aria-hidden), and takes
no slash for the end of a script. Formulas have text. Character references
are decoded, white space within a block is one space. A null or empty page, and a
page without main blocks, has the empty text. Text outside any element counts as a
block, too.

Rows are treated one by one: repeated rows and null ids stay, other columns aren't
read, an empty table gives an empty result. Reading takes time in proportion to the
page, whatever its length and nesting: open elements are a linked stack whose nodes
know what is above them, and places of open elements are kept by tag. Of equally
probable labellings the one with fewer main blocks at the first difference is taken.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.llm.bpe import calm_gc
from cloudstrata.llm.crf import LinearChainCrf

PAGES, SEED = 900, 11

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)""", re.S)
#: A whole name, and its value if there is one.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A last slash that belongs to a value without quotes.
UNQUOTED_SLASH = re.compile(r"""=\s*[^\s"'>]*/\Z""")
#: Elements whose content isn't shown as text.
RAW = frozenset("script style noscript template textarea title iframe svg object select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav
    ol optgroup p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: What an opening tag closes, and what stops the search for it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "table", "figure", "blockquote", "pre", "dialog"]
LEAVES = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt", "div", "span", "button", "label", "figcaption", "blockquote", "pre", "caption", "summary", "legend", "address"]
#: Groups of attribute words; a group is a feature.
WORDS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar pagination pager skip toc tabs",
    "head": "header masthead branding logo site-header banner-top hero",
    "foot": "footer foot colophon copyright legal bottom site-footer imprint",
    "side": "sidebar side aside widget widgets rail related recommended recommendations more popular trending tags tag categories archive",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner affiliate outbrain taboola dfp",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay paywall newsletter subscribe subscription signup message toast",
    "talk": "comment comments commentlist reply replies respond disqus discussion thread reviews responses",
    "share": "share sharing social follow facebook twitter like likes buttons print email",
    "meta": "meta byline author date posted published timestamp dateline info credit bio",
    "form": "form search login register contact poll survey",
    "main": "content article post entry story body text main page maincontent articlebody post-content entry-content prose blog news hentry single",
}
GROUP_OF = {w: k for k, words in enumerate(WORDS.values()) for w in words.split()}
#: Words that notices, footers and comments say: their share among the words of a block is a feature.
TALK = frozenset("© copyright rights reserved cookie cookies subscribe newsletter sign login log advert advertisement sponsored comment comments reply share privacy terms read click skip".split())
SAID = re.compile(r"©|[^\W\d_]+").findall

_STACK = 1 + 2 * len(TAGS) + len(LEAVES) + 2 * len(WORDS)
_N_TEXT = 20
FEATURES = _STACK + _N_TEXT
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_LEAF_AT = {t: k for k, t in enumerate(LEAVES)}


class Node:
    """An open block element: what it is, and what all elements down to it say. Equal paths are one node as long as they are remembered."""

    __slots__ = ("anywhere", "depth", "groups", "inside", "last", "near", "parent", "row", "tag")

    def __init__(self, tag: str, groups: tuple[int, ...], parent: Node | None):
        self.tag, self.groups, self.parent, self.row = tag, groups, parent, None
        at = _TAG_AT.get(tag)
        bits = 0
        for g in groups:
            bits |= 1 << g
        self.depth = parent.depth + 1 if parent else 0
        self.inside = (parent.inside if parent else 0) | (0 if at is None else 1 << at)
        self.near = at if at is not None else parent.near if parent else None
        self.anywhere = (parent.anywhere if parent else 0) | bits
        self.last = groups or (parent.last if parent else ())

    def features(self) -> np.ndarray:
        """Tags and attribute groups anywhere above, and of the innermost that says anything."""
        if self.row is None:
            x = np.zeros(_STACK)
            x[0] = 1
            at = 1
            for k in range(len(TAGS)):
                x[at + k] = self.inside >> k & 1
            at += len(TAGS)
            if self.near is not None:
                x[at + self.near] = 1
            at += len(TAGS)
            if self.tag in _LEAF_AT:
                x[at + _LEAF_AT[self.tag]] = 1
            at += len(LEAVES)
            for k in range(len(WORDS)):
                x[at + k] = self.anywhere >> k & 1
            at += len(WORDS)
            for g in self.last:
                x[at + g] = 1
            self.row = x
        return self.row


class Paths:
    """Nodes by parent, tag and groups; forgotten between pages when there are many."""

    def __init__(self, most: int = 20_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.root = Node("", (), None)
        self.nodes: dict[tuple, Node] = {}

    def child(self, parent: Node, tag: str, groups: tuple[int, ...]) -> Node:
        key = (id(parent), tag, groups)
        found = self.nodes.get(key)
        if found is None:
            found = self.nodes[key] = Node(tag, groups, parent)
        return found

    def tidy(self) -> None:
        if len(self.nodes) > self.most:
            self.clear()


class _Open:
    """An open element of any kind: the path of block elements down to it, and what holds within it."""

    __slots__ = ("block", "hidden", "labelled", "links", "path", "tag")

    def __init__(self, tag: str, block: bool, path: Node, links: int, hidden: bool, labelled: bool):
        self.tag, self.block, self.path, self.links, self.hidden, self.labelled = tag, block, path, links, hidden, labelled


class _Stack:
    """The open elements, with the places of each tag and of the block elements."""

    def __init__(self, paths: Paths):
        self.paths = paths
        self.open = [_Open("", True, paths.root, 0, False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    @property
    def top(self) -> _Open:
        return self.open[-1]

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, 0 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def push(self, tag: str, groups: tuple[int, ...], hidden: bool, labelled: bool) -> None:
        above, block = self.open[-1], tag in BLOCK
        path = self.paths.child(above.path, tag, groups) if block else above.path
        self.places.setdefault(tag, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        self.open.append(_Open(tag, block, path, above.links + (tag == "a"), above.hidden or hidden, above.labelled or labelled))

    def drop(self, n: int) -> None:
        """Closes all elements from a place on."""
        while len(self.open) > n:
            gone = self.open.pop()
            self.places[gone.tag].pop()
            if gone.block:
                self.blocks.pop()

    def close(self, tag: str) -> bool:
        """The end tag: an inline one doesn't reach through a block. Whether it closed anything."""
        at = self.last(tag)
        if not at or tag not in BLOCK and at < self.blocks[-1]:
            return False
        self.drop(at)
        return True

    def make_room(self, tag: str) -> None:
        """What the opening tag of a block ends: cells and items of the same list or table, or else a paragraph right around it."""
        if tag not in CLOSES:
            if self.open[self.blocks[-1]].tag == "p":
                self.drop(self.blocks[-1])
            return
        those, stops = CLOSES[tag]
        stop = max(map(self.last, stops))
        first = [p[bisect_right(p, stop)] for t in those if (p := self.places.get(t)) and p[-1] > stop]
        if first:
            self.drop(min(first))


def _attributes(rest: str, label: str | None) -> tuple[tuple[int, ...], bool, bool]:
    """Groups of the attribute words, whether the element is hidden, and whether it has the labelling attribute."""
    groups: set[int] = set()
    hidden = labelled = False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for word in re.findall(r"[a-z]+", value):
                if (g := GROUP_OF.get(word)) is not None:
                    groups.add(g)
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name == label:
            labelled = True
    return tuple(sorted(groups)), hidden, labelled


def blocks_of(page: str, label: str | None = None, paths: Paths | None = None) -> list[tuple[str, float, Node, int]]:
    """Text, share of link characters, path of block elements and label of each leaf block. label: an attribute whose presence marks main text, for training."""
    out: list[tuple[str, float, Node, int]] = []
    stack = _Stack(paths or Paths())
    parts: list[str] = []
    linked = 0
    ends: dict[str, tuple[int, int] | None] = {}  # of raw elements the next end tag, None if there is no more

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((text, min(1.0, linked / max(len(raw.strip()), 1)), stack.top.path, int(stack.top.labelled)))
            parts.clear()
            linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s and not stack.top.hidden:
            parts.append(s)
            if stack.top.links:
                linked += len(s.strip())

    def end_of(tag: str, at: int) -> tuple[int, int] | None:
        found = ends.get(tag, (-1, -1))
        if found is not None and found[0] < at:
            m = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            found = ends[tag] = (m.start(), m.end()) if m else None
        return found

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                flush()
            if not stack.close(tag) and tag in ("p", "br"):
                text(" ")
            continue
        if tag in VOID:
            text(" ")
            if tag == "hr":
                flush()
            continue
        closed = rest.endswith("/") and not UNQUOTED_SLASH.search(rest)
        if tag in RAW and not (closed and tag == "svg"):  # in HTML a slash closes no raw element
            end = end_of(tag, at)
            if end or tag in ("script", "style", "svg", "textarea", "title"):
                at = end[1] if end else size
                continue
        if tag in BLOCK:
            flush()
            stack.make_room(tag)
        if not closed:
            stack.push(tag, *(_attributes(rest, label) if rest else ((), False, False)))
    flush()
    return out


def features(blocks: list[tuple[str, float, Node, int]]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, FEATURES))
    before: Node | None = None
    for k, (text, linked, path, _) in enumerate(blocks):
        chars = len(text)
        words = text.count(" ") + 1
        talk = sum(map(TALK.__contains__, SAID(text.lower()))) / words
        stop = text[-1] in ".!?…\"'”»:;"
        commas = text.count(",")
        x[k, :_STACK] = path.features()
        x[k, _STACK:] = (
            min(np.log1p(chars) / 6, 1.5), words < 4, words < 10, words > 25, words > 60, linked, linked > 0.5, linked > 0.9, stop, stop and words > 6, min(3 * talk, 1.5), talk > 0.06, talk > 0 and words < 25,
            min(commas / words, 0.3), text[:1].isupper(), "|" in text or "·" in text or "»" in text, min(path.depth, 12) / 12, k / max(n - 1, 1), before is path,
            before is not None and before.parent is path.parent,
        )
        before = path
    return x


def _some_words(r: random.Random) -> list[str]:
    """A vocabulary of invented words, with the sounds of one of several languages."""
    sounds = r.choice(
        [
            ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"],
            ["en", "er", "ch", "ei", "ie", "sch", "un", "ge", "be", "zu", "lich", "keit", "ung", "ä", "ö", "ß"],
            ["ou", "eau", "é", "è", "tion", "le", "que", "ai", "en", "ment", "oi", "re", "ç"],
            ["ción", "os", "as", "ado", "ie", "ue", "ar", "ll", "rr", "ñ", "mente", "es", "í"],
            ["ka", "to", "mi", "ra", "ne", "shi", "su", "yo", "no", "wa", "д", "ж", "中", "文"],
        ]
    )
    return ["".join(r.choice(sounds) for _ in range(r.randint(1, 4))) for _ in range(300)]


class PageMaker:
    """Labelled pages by rule: what carries the attribute data-main is main text."""

    def __init__(self, r: random.Random):
        self.r, self.words = r, _some_words(r)

    def some(self, least: int, most: int, stop: bool = True) -> str:
        r = self.r
        out = []
        for k in range(r.randint(least, most)):
            w = r.choice(self.words)
            out.append((w.capitalize() if not k or r.random() < 0.04 else w) + ("," if r.random() < 0.08 else ". " + r.choice(self.words).capitalize() if r.random() < 0.06 else ""))
        if r.random() < 0.15:
            sign = r.choice(["&amp;", "***", "%%%", "###", "$$$", "!!", " |", "&quot;", "&nbsp;"])
            out = [w + (sign if r.random() < 0.7 else "") for w in out]
        text = " ".join(out) + ("." if stop else "")
        return text.upper() if r.random() < 0.04 else text

    def link(self, least: int = 1, most: int = 3) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{self.some(least, most, False)}</a>'

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.3:
            tag = r.choice(["b", "i", "em", "strong", "span", "a href='#'", "code", "u"])
            w = text.split(" ")
            k = r.randrange(len(w))
            w[k] = f"<{tag}>{w[k]}</{tag.split()[0]}>" if r.random() < 0.85 else f"<{tag}>{w[k]}"
            text = " ".join(w)
        return text.replace(" ", "<br>", 1) if r.random() < 0.08 else text

    def links(self) -> str:
        r = self.r
        items = [self.link() for _ in range(r.randint(2, 9))]
        return r.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items), " ".join(items)])

    def wrap(self, kind: str, inner: str) -> str:
        """A part of the page that isn't main text, by a tag or by attributes."""
        r = self.r
        tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
        if tag and r.random() < 0.6:
            return f"<{tag}{r.choice(['', ' class=' + chr(34) + r.choice(WORDS[kind].split()) + chr(34)])}>{inner}</{tag}>"
        word = r.choice(WORDS[kind].split())
        return f'<{r.choice(["div", "div", "section", "aside" if kind in ("side", "ad", "notice") else "div"])} {r.choice(["class", "id"])}="{r.choice([word, word, word + "-" + r.choice(self.words), r.choice(["box ", "row "]) + word])}">{inner}</div>'

    def sentence_box(self) -> str:
        r = self.r
        tag = r.choice(["", "p", "p", "div", "span"])
        text = self.some(3, r.choice([10, 30, 60]))
        return f"<{tag}>{text}</{tag}>" if tag else text

    def other(self) -> str:
        r = self.r
        kind = r.choice(["nav", "side", "ad", "ad", "notice", "share", "form", "side"])
        if kind in ("nav", "share"):
            return self.wrap(kind, self.links())
        if kind == "side":
            return self.wrap("side", f"<h3>{self.some(1, 4, False)}</h3>" + (self.links() if r.random() < 0.6 else self.sentence_box()))
        if kind == "form":
            return self.wrap("form", f"<label>{self.some(1, 3, False)}</label><input><button>{self.some(1, 2, False)}</button>" + (self.sentence_box() if r.random() < 0.4 else ""))
        return self.wrap(kind, self.sentence_box() + (f"<button>{self.some(1, 2, False)}</button>" if kind == "notice" and r.random() < 0.5 else ""))

    def comments(self) -> str:
        r = self.r
        each = [f'<{r.choice(["div", "li", "article"])} class="{r.choice(["comment", "reply", "comment-body"])}"><{r.choice(["b", "h4", "span"])}>{self.some(1, 2, False)}</b><p>{self.some(4, 40)}</p></div>' for _ in range(r.randint(1, 6))]
        return self.wrap("talk", f"<h{r.choice('23')}>{self.some(1, 3, False)}</h3>" + "".join(each))

    def main(self) -> str:
        r = self.r
        out = []
        if r.random() < 0.9:
            out.append(f"<h1 data-main>{self.some(1, 14, r.random() < 0.4)}</h1>")
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            k = r.random()
            text = self.inline(self.some(1 if r.random() < 0.15 else 6, r.choice([15, 40, 90])))
            if k < 0.66:
                out.append(f"<p data-main>{text}" + ("</p>" if r.random() < 0.85 else ""))
            elif k < 0.74:
                out.append(f"<p data-main><b>{text}<br>")
            elif k < 0.80:
                out.append(f"<h{(n := r.choice('234'))} data-main>{self.some(1, 7, False)}</h{n}>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li data-main>{self.some(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.90:
                out.append(f"<blockquote data-main><p>{text}</p></blockquote>")
            elif k < 0.94:
                out.append(f"<div data-main>{text}</div>")
            elif k < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td data-main>{self.some(1, 4, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(f"<pre data-main>{text}</pre>")
            if r.random() < 0.08:
                out.append(self.other())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        main = self.main()
        shell = r.random()
        if shell < 0.45:
            main = f"<article>{main}" + (self.comments() if r.random() < 0.15 else "") + (self.wrap("share", self.links()) if r.random() < 0.1 else "") + "</article>"
        elif shell < 0.6:
            main = f"<main>{main}</main>"
        elif shell < 0.9:
            word = r.choice(WORDS["main"].split())
            main = f'<div {r.choice(["class", "id"])}="{r.choice([word, word + " " + r.choice(self.words), "post-" + word])}">{main}</div>'
        elif shell < 0.95:
            main = f'<div role="main">{main}</div>'
        before = [self.wrap("nav", self.links())] if r.random() < 0.9 else []
        if r.random() < 0.4:
            before.insert(0, self.wrap("head", self.link() + (f"<p>{self.some(2, 8, False)}</p>" if r.random() < 0.5 else "")))
        before += [self.other() for _ in range(r.choice([0, 1, 1, 2]))]
        after = [self.other() for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.35:
            after.append(self.comments())
        if r.random() < 0.9:
            after.append(self.wrap("foot", r.choice(["&copy; 2021 ", "", "Copyright "]) + self.some(1, 12) + (" &middot; " + self.links() if r.random() < 0.5 else "")))
        gap = r.choice(["", "\n", "\n  "])
        end = "" if r.random() < 0.15 else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.some(1, 8, False)}</title><script>var t='</p>';</script></head><body>" + gap.join([*before, main, *after]) + end


def fit_field(pages: int = PAGES, seed: int = SEED) -> LinearChainCrf:
    """The field for pages made with a seed."""
    r = random.Random(seed)
    xs, ys, lengths, paths = [], [], [], Paths()
    for _ in range(pages):
        paths.tidy()
        blocks = blocks_of(PageMaker(r).page(), "data-main", paths)
        if blocks:
            xs.append(features(blocks))
            ys += [b[3] for b in blocks]
            lengths.append(len(blocks))
    return LinearChainCrf(2, FEATURES).fit(np.concatenate(xs), np.array(ys), np.array(lengths), rounds=220, l2=3e-4)


_fields: dict[tuple[int, int], LinearChainCrf] = {}


def field(pages: int = PAGES, seed: int = SEED) -> LinearChainCrf:
    """fit_field, once in a process."""
    if (pages, seed) not in _fields:
        _fields[pages, seed] = fit_field(pages, seed)
    return _fields[pages, seed]


def label_pages(pages: list[str | None], model: LinearChainCrf, paths: Paths) -> list[list[str]]:
    """The main blocks of each page."""
    paths.tidy()
    blocks = [blocks_of(p, None, paths) if p else [] for p in pages]
    lengths = np.array([len(b) for b in blocks], np.int64)
    if not lengths.sum():
        return [[] for _ in pages]
    states = model.viterbi(np.concatenate([features(b) for b in blocks if b]), lengths)
    out, at = [], 0
    for b in blocks:
        out.append([x[0] for x, s in zip(b, states[at : at + len(b)].tolist(), strict=True) if s])
        at += len(b)
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: LinearChainCrf | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    model = model or field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calm_gc():
            paths = Paths()
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    text = [" ".join(b) for b in label_pages(part.column(2).to_pylist(), model, paths)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)[id_col]}, url string, text string, n_chars long")
