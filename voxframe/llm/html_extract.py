"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element is a node that is content or not. Potentials of a node come from its tag, its class and id words, its text
and links; potentials of an edge say how labels of parent and child go together. Sum-product messages pass up to the root and
down again, which gives each node's exact marginal; text of nodes with a marginal of one half or more is kept. The weights are
trained on the driver by the gradient of the likelihood (expected counts by the same messages) over labelled pages: a bounded
sample of the table's own pages whose main text an ``article`` element marks (``sample_articles``), and generated pages of many
other layouts whose blocks' labels are known (``labelled_pages``), as most pages elsewhere have no such element.

Scoring is one pass over the table without a shuffle; the weights (some 100 kB) travel with the tasks.

Edge cases: a null or empty page gives an empty text; a page without mark-up is one block and kept or not like any other;
unclosed, wrongly nested and cut-off mark-up is read as far as it goes, and a hidden element that is never closed ends where
the next block starts; repeated rows get equal texts; pages of any length are
read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._np import out_batch
from ._shared import small_batches

#: Elements without text of the page, elements that stand in a line of text, elements without an end tag.
HIDDEN = set("script style noscript template head title svg math iframe object canvas audio video select datalist".split())
RAW = set("script style textarea title noscript iframe".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements the start of an element ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that may stand in a head; any other element and text ends it.
HEAD = set("base basefont bgsound html link meta noframes noscript script style template title".split())
#: Elements beyond which ENDS doesn't reach.
SCOPE = set("ul ol dl table body html article section div nav aside".split())
#: Hidden elements beyond which it doesn't reach if they are closed later.
FENCES = set("object template select".split())
#: Elements that say what all below them is.
REGIONS = set("article main nav header footer aside form dialog".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z])|<[!?/]")
_BREAK, _NAME_END, _CLOSE = re.compile(r"""[>"']"""), re.compile(r"[\s/>]"), re.compile(">")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
SCHEMA = "page_id long, url string, text string, n_chars long"
SLOTS = 4096


class Tags:
    """The tags of a page, in one pass: a tag ends with the first > that no quotes hold; a < without one is text.

    Where a scan from one place has ended, or that none ends, is remembered, so unclosed tags don't read on to the end again.
    """

    def __init__(self, source: str):
        self.source = source
        self._seen: dict[re.Pattern, tuple[int, int]] = {}
        self._ends: dict[int, int] = {}

    def _next(self, what: re.Pattern, at: int) -> int:
        """Where ``what`` is found from ``at`` on, or -1."""
        low, found = self._seen.get(what, (1, 0))
        if not low <= at <= (found if found >= 0 else len(self.source)):
            m = what.search(self.source, at)
            found = m.start() if m else -1
            self._seen[what] = (at, found)
        return found

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag whose rest begins at ``at``, or -1."""
        way = []
        while True:
            place = self._next(_BREAK, at)
            if place < 0 or self.source[place] == ">":
                break
            if place in self._ends:
                place = self._ends[place]
                break
            way.append(place)
            at = self.source.find(self.source[place], place + 1) + 1
            if not at:
                place = -1
                break
        for quote in way:
            self._ends[quote] = place
        return place

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name (empty for comments and declarations) and attributes of the next tag."""
        source = self.source
        while True:
            m = _OPEN.search(source, at)
            if m is None:
                return None
            start = m.start()
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(source), "", "", ""
            if m[2]:
                name_end = self._next(_NAME_END, m.start(2) + 1)
                end = self._end(name_end) if name_end >= 0 else -1
                if end >= 0:
                    return start, end + 1, m[1], source[m.start(2) : name_end], source[name_end:end]
            if source[start + 1] in "!?/":
                end = self._next(_CLOSE, start + 2)
                if end >= 0:
                    return start, end + 1, "", "", ""
            at = start + 1


class Page:
    """Nodes of block elements in page order (parents first) and the runs of text between their borders."""

    def __init__(self, source: str):
        self.tag, self.names, self.parent = ["#page"], [""], [-1]
        self.chars, self.linked = [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._own: list[str] = []
        stack: list[tuple[str, int]] = [("#page", 0)]
        open_at = defaultdict(list, {"#page": [0]})  # the places of each tag's elements on the stack
        hidden = links = 0
        at, end = 0, len(source)
        last: dict[str, int] = {}
        tags = Tags(source)

        def closed(tag: str) -> bool:
            if tag not in last:
                last[tag] = max((x.start() for x in re.finditer(rf"</{tag}[\s>]", source, re.I)), default=-1)
            return last[tag] >= at

        def cut(deep: int) -> None:
            """Takes the elements from ``deep`` on off the stack, and off the counts of hidden elements and links."""
            nonlocal hidden, links
            for t, _ in stack[deep:]:
                open_at[t].pop()
                hidden -= t in HIDDEN
                links -= t == "a"
            del stack[deep:]

        def innermost(some: Iterable[str]) -> int:
            return max((open_at[t][-1] for t in some if open_at[t]), default=0)

        while at < end:
            m = tags.find(at)
            between = source[at : m[0] if m else end]
            if between:
                if stack[-1][0] == "head" and not between.isspace():
                    cut(len(stack) - 1)
                self._text(between, stack, hidden, links)
            if m is None:
                break
            _, at, slash, name, attributes = m
            if not name:
                continue
            tag = name.lower()
            if slash:
                deep = innermost([tag])
                if not deep:
                    continue
                if tag not in INLINE:
                    self._border(stack)
                cut(deep)
                continue
            head = (innermost(["head"]) if tag == "body" else 0) or len(stack) - 1
            if stack[head][0] == "head" and tag not in HEAD:
                cut(head)
            if tag == "br":
                self._own.append(" ")
            if tag in VOID:
                if tag not in INLINE:
                    self._border(stack)
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if tag not in INLINE:
                self._border(stack)
                if hidden and (tag in CLOSES_P or tag in LEAVES):
                    open_ = min((open_at[t][0] for t in HIDDEN - {"head"} if open_at[t] and not closed(t)), default=0)
                    if open_:
                        cut(open_)
                ended = ENDS.get(tag) or ({"p"} if tag in CLOSES_P else ())
                while deep := innermost(ended):
                    if deep < innermost(SCOPE - ended) or deep < innermost(t for t in FENCES if open_at[t] and closed(t)):
                        break
                    cut(deep)
                names = " ".join(next(x for x in g if x) for g in _NAMES.findall(attributes) if any(g)).lower() if attributes else ""
                self.tag.append(tag)
                self.names.append(names)
                self.parent.append(stack[-1][1])
                self.chars.append(0)
                self.linked.append(0)
                node = len(self.tag) - 1
            else:
                node = stack[-1][1]
            hidden += tag in HIDDEN
            links += tag == "a"
            open_at[tag].append(len(stack))
            stack.append((tag, node))
        self._border(stack)

    def _text(self, raw: str, stack: list, hidden: int, links: int) -> None:
        if hidden <= 0:
            text = html.unescape(raw) if "&" in raw else raw
            self._own.append(text)
            node = stack[-1][1]
            self.chars[node] += len(text)
            if links > 0:
                self.linked[node] += len(text)

    def _border(self, stack: list) -> None:
        if self._own:
            text = " ".join("".join(self._own).split())
            if text:
                self.runs.append((stack[-1][1], text))
            self._own = []


def _bucket(x: float) -> int:
    return min(5, int(math.log2(1 + x)))


def features(page: Page) -> list[list[int]]:
    """Slots of each node's features."""
    n = len(page.tag)
    deep_chars, deep_links, children = page.chars[:], page.linked[:], [0] * n
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        deep_chars[up] += deep_chars[k]
        deep_links[up] += deep_links[k]
        children[up] += 1
    stops = [0] * n
    for node, text in page.runs:
        stops[node] += text[-1] in ".!?…:;\"'»”"
    out, region = [], [""] * n
    for k in range(n):
        tag = page.tag[k]
        region[k] = tag if tag in REGIONS else region[page.parent[k]] if k else ""
        share = int(4 * deep_links[k] / max(deep_chars[k], 1))
        names = ["bias", f"tag {tag}", f"own {_bucket(page.chars[k] / 8)}", f"links {share}", f"{tag} links {share}", f"deep {_bucket(deep_chars[k] / 64)}", f"stops {min(stops[k], 2)}", f"children {min(children[k], 3)}", f"in {page.tag[page.parent[k]]}", f"{tag} in {page.tag[page.parent[k]]}", f"under {region[k]}"]
        names += [f"name {w}" for w in dict.fromkeys(_WORD.findall(page.names[k]))]
        out.append([crc32(x.encode()) % SLOTS for x in names])
    return out


class TreeModel:
    """Weights of a node's features for the label 1, and two 2 x 2 tables of edges: to leaves and to other elements."""

    def __init__(self):
        self.weights = [0.0] * SLOTS
        self.edges = [[0.0] * 4, [0.0] * 4]

    def _edge(self, page: Page, k: int) -> list[float]:
        return self._tables[page.tag[k] in LEAVES]

    def messages(self, page: Page, slots: list[list[int]]) -> tuple[list[float], list[tuple]]:
        """Each node's marginal of label 1, and of each edge the joint probabilities (of node 1 on)."""
        self._tables = [[math.exp(x) for x in e] for e in self.edges]
        n, w = len(slots), self.weights
        one = [math.exp(max(-30.0, min(30.0, sum([w[s] for s in own])))) for own in slots]
        up0, up1 = [1.0] * n, one[:]  # potentials times what the children say
        to0, to1 = [1.0] * n, [1.0] * n
        for k in range(n - 1, 0, -1):
            e, p = self._edge(page, k), page.parent[k]
            a, b = up0[k], up1[k]
            m0, m1 = e[0] * a + e[1] * b, e[2] * a + e[3] * b
            s = m0 + m1
            to0[k], to1[k] = m0 / s, m1 / s
            x, y = up0[p] * m0 / s, up1[p] * m1 / s
            s = x + y
            up0[p], up1[p] = x / s, y / s
        down0, down1 = [1.0] * n, [1.0] * n
        marginal, joint = [0.0] * n, [()] * n
        marginal[0] = up1[0] / (up0[0] + up1[0])
        for k in range(1, n):
            e, p = self._edge(page, k), page.parent[k]
            x, y = up0[p] * down0[p] / to0[k], up1[p] * down1[p] / to1[k]  # the parent without this child
            a, b = up0[k], up1[k]
            j = (x * e[0] * a, x * e[1] * b, y * e[2] * a, y * e[3] * b)
            s = sum(j)
            joint[k] = (j[0] / s, j[1] / s, j[2] / s, j[3] / s)
            d0, d1 = x * e[0] + y * e[2], x * e[1] + y * e[3]
            s = d0 + d1
            down0[k], down1[k] = d0 / s, d1 / s
            marginal[k] = joint[k][1] + joint[k][3]
        return marginal, joint

    def fit(self, pages: list[tuple[str, set[str] | None]], rounds: int = 8, rate: float = 1.0) -> TreeModel:
        """``pages``: the source and the marks in its main text's blocks, or None where an article element marks it; ascends
        the likelihood by AdaGrad and takes the mean of the weights after the later rounds."""
        known = []
        for source, marks in pages:
            page = Page(source)
            own = [0] * len(page.tag)
            inside = in_article(page) if marks is None else own
            for node, text in page.runs:
                if inside[node] or (marks and marks & set(text.split())):
                    own[node] = 1
            chars = [c * o for c, o in zip(page.chars, own)]
            every = page.chars[:]
            for k in range(len(own) - 1, 0, -1):  # an element most of whose text is content is content
                if page.tag[k] not in ("body", "html") and 2 * chars[k] > every[k]:
                    own[k] = 1
                chars[page.parent[k]] += chars[k]
                every[page.parent[k]] += every[k]
            known.append((page, features(page), own))
        squares: dict = {}

        def step(table: list[float], slot: int, g: float, name) -> None:
            squares[name, slot] = squares.get((name, slot), 1e-6) + g * g
            table[slot] += rate * g / math.sqrt(squares[name, slot]) - 1e-4 * rate * table[slot]

        late: list[list[list[float]]] = []
        for turn in range(rounds):
            for page, slots, own in known:
                marginal, joint = self.messages(page, slots)
                change: dict[int, float] = {}
                for k, mine in enumerate(slots):
                    for s in mine:
                        change[s] = change.get(s, 0.0) + own[k] - marginal[k]
                for s, g in change.items():
                    step(self.weights, s, g, "w")
                for kind in (0, 1):
                    g = [0.0] * 4
                    for k in range(1, len(own)):
                        if (page.tag[k] in LEAVES) == kind:
                            g[2 * own[page.parent[k]] + own[k]] += 1
                            g = [a - b for a, b in zip(g, joint[k])]
                    for s in range(4):
                        step(self.edges[kind], s, g[s], kind)
            if 2 * turn >= rounds:
                late.append([self.weights[:], *(e[:] for e in self.edges)])
        self.weights, *self.edges = [[sum(x) / len(late) for x in zip(*part)] for part in zip(*late)]
        return self

    def main_text(self, source: str) -> str:
        page = Page(source)
        if not page.runs:
            return ""
        marginal, _ = self.messages(page, features(page))
        return "\n".join(text for node, text in page.runs if marginal[node] >= 0.5)


#: Words in names of elements that hold main text, and of those that don't, by the latter's kind.
CONTENT_NAMES = ["article", "content", "post", "entry", "story", "body", "text", "main", "article-body", "post-content", "entry-content"]
OTHER_NAMES = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "navigation", "topbar", "links", "pagination"],
    "header": ["header", "masthead", "site-header", "top", "logo", "branding"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "popup", "modal", "alert", "gdpr"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "contact", "form"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "share", "social", "tags", "author-box", "teaser"],
    "comments": ["comments", "comment", "comment-list", "replies", "reply", "discussion", "respond"],
    "footer": ["footer", "copyright", "legal", "site-footer", "bottom", "imprint"],
}


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Pages of random layouts, each with the marks (words no other block has) of the blocks of its main text."""
    rng = random.Random(seed)
    parts = ["the", "and", "on", "re", "ti", "er", "en", "ou", "ing", "ach", "que", "ción", "heit", "st", "le", "ed", "%", "|"]
    out = []
    for _ in range(n):
        marks: set[str] = set()

        def words(k: int) -> str:
            return " ".join("".join(rng.choices(parts[:16], k=rng.randint(1, 4))) + ("." if rng.random() < 0.08 else "") + rng.choice(["", "", "", "", "", ",", "%%%", "!!", " |"]) for _ in range(max(k, 1)))

        def sentence(low: int, high: int) -> str:
            return words(rng.randint(low, high)).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

        def text(low: int, high: int) -> str:
            mark = f"q{len(marks)}x{rng.randint(0, 9999)}"
            marks.add(mark)
            return sentence(low, high) + " " + mark + rng.choice(["", "", " " + sentence(1, 30), " " + sentence(1, 30) * rng.randint(1, 9)])

        def named(names: list[str], chance: float = 0.75) -> str:
            return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "", " wide", "-1"])}"' if rng.random() < chance else ""

        def link() -> str:
            return f'<a href="/x">{words(rng.randint(1, 3))}</a>'

        def other(kind: str) -> str:
            names = OTHER_NAMES[kind]
            if kind == "nav":
                items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
                return rng.choice([f"<nav{named(names, 0.4)}><ul>{items}</ul></nav>", f"<div{named(names, 1)}><ul>{items}</ul></div>", f"<ul{named(names, 1)}>{items}</ul>"])
            if kind == "header":
                return f"<header{named(names, 0.5)}>{rng.choice(['<h1>', '<p>', '<div>'])}{words(2)}{rng.choice(['', link()])}</header>" if rng.random() < 0.6 else f"<div{named(names, 1)}><p>{words(3)}</p>{link()}</div>"
            if kind == "footer":
                inner = rng.choice([f"&copy; {words(2)} &middot; {sentence(2, 20)}", f"<p>&copy; {sentence(2, 14)}</p>", f"<p>{link()} | {link()}</p>"])
                return f"<footer{named(names, 0.4)}>{inner}</footer>" if rng.random() < 0.7 else f"<div{named(names, 1)}>{inner}</div>"
            if kind == "ad":
                return f"<div{named(names, 1)}>{rng.choice([sentence(2, 25), '<p>' + sentence(2, 25) + '</p>', link()])}</div>"
            if kind == "notice":
                return f"<{(t := rng.choice(['div', 'aside', 'section', 'dialog']))}{named(names, 1)}>{rng.choice([sentence(3, 25), '<p>' + sentence(3, 25) + '</p>'])}<button>{words(1)}</button></{t}>"
            if kind == "form":
                return f"<form{named(names, 0.5)}>{rng.choice(['', '<h3>' + words(3) + '</h3>', '<p>' + sentence(3, 15) + '</p>'])}<label>{words(2)}</label><input><button>{words(1)}</button></form>"
            if kind == "side":
                inner = f"<h3>{words(2)}</h3>" * rng.randint(0, 1) + rng.choice([f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>", f"<p>{sentence(3, 25)}</p>", f"<p>{sentence(3, 25)}</p><p>{link()}</p>"])
                return f"<aside{named(names, 0.6)}>{inner}</aside>" if rng.random() < 0.5 else f"<div{named(names, 1)}>{inner}</div>"
            said = "".join(rng.choice([f'<div class="comment"><p>{sentence(3, 40)}</p></div>', f"<li{named(names)}><p>{sentence(3, 40)}</p></li>", f"<p>{sentence(3, 40)}</p>"]) for _ in range(rng.randint(1, 5)))
            return f"<{(t := rng.choice(['section', 'div', 'ol', 'aside']))}{named(names, 1)}>{'<h3>' + words(1) + '</h3>' if rng.random() < 0.5 else ''}{said}</{t}>"

        def main() -> str:
            inner = ""
            if rng.random() < 0.8:
                inner += f"<h1>{text(2, 10)}</h1>"
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 8, 14, 30])):
                inner += rng.choices(
                    [
                        lambda: f"<p>{text(1, 80)}</p>",
                        lambda: f"<p>{text(1, 5)}</p>",
                        lambda: f"<p>{text(5, 80)}",
                        lambda: f"<p><b>{text(1, 20)}<br><p>{text(2, 60)}</p>",
                        lambda: f"<h2>{text(1, 6)}</h2>",
                        lambda: f"<ul><li>{text(2, 12)}</li><li>{text(2, 12)}</ul>",
                        lambda: f"<blockquote><p>{text(5, 30)}</p></blockquote>",
                        lambda: f"<pre>{text(5, 30)}</pre>",
                        lambda: f"<table><tr><td>{text(1, 3)}<td>{text(1, 3)}</table>",
                        lambda: f"<p>{text(5, 20)} {link()} {words(6)}</p>",
                        lambda: f"<div>{text(8, 60)}</div>",
                    ],
                    weights=[8, 4, 3, 3, 1, 1, 1, 0.5, 0.5, 2, 1],
                )[0]()
                if rng.random() < 0.08:
                    inner += other(rng.choice(["ad", "side", "form", "notice"]))
            if rng.random() < 0.1:
                inner += other("comments")
            t = rng.choice(["article", "article", "main", "main", "div", "div", "div", "section"])
            return f"<{t}{named(CONTENT_NAMES, 0.4 if t in ('article', 'main') else 1)}>{inner}</{t}>"

        above = "".join(other(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5)
        below = "".join(other(k) for k in ("comments", "side", "ad", "notice", "form", "nav") if rng.random() < 0.35) + (other("footer") if rng.random() < 0.9 else "")
        middle = main() + (other("side") if rng.random() < 0.3 else "")
        if rng.random() < 0.3:
            middle = f"<main>{middle}</main>"
        for _ in range(rng.randint(0, 2)):
            middle = f"<div{named(['wrapper', 'container', 'page', 'layout', 'row', 'site'])}>{middle}</div>"
        page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{above}<!-- ad -->{middle}{below}"
        if rng.random() < 0.1:
            page = page[page.index("<body>") + 6 :]
        out.append((page + rng.choice(["</body></html>", ""]), marks))
    return out


def in_article(page: Page) -> list[int]:
    """1 for the nodes in an article element, but for other regions in it."""
    out = [0] * len(page.tag)
    for k in range(1, len(out)):
        out[k] = int(page.tag[k] == "article" or (out[page.parent[k]] == 1 and page.tag[k] not in REGIONS))
    return out


def sample_articles(pages: DataFrame, most: int = 300, longest: int = 200_000) -> list[str]:
    """The sources of at most ``most`` pages with one article element, chosen by a hash of their id, of ``longest`` characters
    at most each, so that the driver takes a bounded part."""
    source = F.col("html")
    one = pages.where((F.length(source) <= longest) & (F.size(F.regexp_extract_all(source, F.lit(r"(?i)<article[\s>]"), 0)) == 1))
    chosen = one.orderBy(F.xxhash64("page_id"), "page_id", "url").limit(most).select("html")
    return [r.html for r in chosen.collect()]


def train(articles: list[str] = (), pages: int = 800, rounds: int = 8) -> TreeModel:
    return TreeModel().fit([*labelled_pages(pages), *((source, None) for source in articles)], rounds)


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [model.main_text(source or "") for source in part.column(2).to_pylist()]
                yield out_batch(schema, {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": [len(t) for t in texts]})

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
