"""Main-text extraction from HTML by minimum-cut labelling.

A page is cut into text blocks in page order. A logistic classifier over a block's
features (length, links, sentences, element, place, depth, what its ancestors are and how
many of the words in their names speak of page furniture) gives log-odds of content; it is
fitted in numpy on pages made by rule (:func:`practice_pages`), whose labels are known.
The odds are the capacities from the source and to the sink. Blocks that follow each
other, and blocks that follow each other inside the same container, are joined by
smoothness edges, the weaker the more DOM steps lie between them. The minimum cut, found
by maximum flow, is the labelling of least total cost; blocks on the source's side are
the article. No name alone decides: each is one feature of several.

Markup is read by a scanner that goes forward only, so its time is in proportion to the
page; as in browsers, elements nested deeper than ``DEPTH`` count as siblings.

Defined results: null and empty html give an empty text; markup that never closes is
closed where HTML says; a page whose blocks are all boilerplate gives an empty text;
repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftlake.llm.common import bound_batches

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
GAP = re.compile(r"[\s/]*")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
# Fixed values of HTML: elements whose content is not markup, void elements, and those that stay inside a line.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "canvas", "audio", "video"}
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
# Words in names and elements that speak of the part of a page they stand for; the
# classifier learns what they weigh.
BAD_TAG = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "datalist", "fieldset"}
BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
BAD_NAME = set("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay alert sidebar sidebars sidenav aside widget widgets menu menus nav navbar navigation topnav breadcrumb breadcrumbs footer foot colophon copyright comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login signin search pagination pager toc tags tagcloud skip toolbar outbrain taboola paywall disclaimer rail".split())
HEAD_NAME = {"header", "masthead", "topbar", "site"}
GOOD_NAME = set("article content post entry story main body text prose page".split())
COMMENT_NAME = set("comment comments commentlist disqus reply replies respond discussion".split())
KEYS = {"class", "id", "role", "hidden", "aria-hidden", "style"}
DEPTH = 512
FEATURES = 19


class Node:
    """An open element, with what it and its ancestors say of the blocks inside."""

    __slots__ = ("tag", "up", "depth", "article", "furniture", "header", "hidden", "named", "inner", "leaf", "good", "talk", "paragraph")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up = tag, up
        if up is None:
            self.depth, self.article, self.furniture, self.header, self.hidden, self.paragraph = 0, False, False, False, False, False
            self.named = self.inner = self.leaf = self.good = self.talk = 0.0
        else:
            self.depth, self.article, self.furniture, self.header, self.hidden = up.depth + 1, up.article, up.furniture, up.header, up.hidden
            self.named, self.inner, self.leaf, self.good, self.talk = up.named, up.inner, up.leaf, up.good, up.talk
            self.paragraph = tag == "p" or up.paragraph and tag not in ("button", "table", "td", "th")  # one is open here


class Block:
    __slots__ = ("parts", "node", "linked", "size")

    def __init__(self, node: Node):
        self.parts: list[str] = []
        self.node, self.linked, self.size = node, 0, 0


LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "figure", "td", "dd", "span"}


def _element(tag: str, attrs: list[tuple[str, str]], up: Node) -> Node:
    """What an element adds: shares of furniture words among the words of its names (outside
    an article, in a container of one, in a paragraph of one), and kinds of elements. An
    article begins anew, but for what is hidden or page furniture by element."""
    node = Node(tag, up)
    words: list[str] = []
    role = ""
    for key, value in attrs:
        if key in ("class", "id"):
            words += [t.lower() for t in TOKEN.findall(value)]
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            node.hidden = True
    if tag in ("article", "main") or role in ("main", "article"):
        talk = sum(w in COMMENT_NAME for w in words) / len(words) if words else 0.0
        if up.talk or up.furniture and up.tag not in ("form", "fieldset") or up.hidden or talk > 0.6:
            node.talk = max(up.talk, talk if talk > 0.6 else 0.0)  # a comment may be an article of its own
            return node
        node.article, node.furniture, node.header = True, False, False
        node.named = node.inner = node.leaf = 0.0
        return node
    if tag in BAD_TAG or role in BAD_ROLE:
        node.furniture = True
    if tag == "header" and not up.article:
        node.header = True
    if words and tag not in ("body", "html"):
        bad = sum(w in BAD_NAME or w in HEAD_NAME and not up.article for w in words) / len(words)
        good = sum(w in GOOD_NAME for w in words) / len(words)
        talk = sum(w in COMMENT_NAME for w in words) / len(words)
        if good and tag not in INLINE:
            node.good = max(node.good, good)
            if not bad:
                node.named *= 0.5
        if not up.article:
            node.named = max(node.named, bad)
        elif tag in LEAF:
            node.leaf = max(node.leaf, bad)
        else:
            node.inner = max(node.inner, bad)
        if tag not in LEAF:
            node.talk = max(node.talk, talk)
    return node


def scan(html: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(kind, name or text, attributes) of the page's texts, start and end tags, front to
    back. What is no tag is text; a tag that the page's end cuts off is dropped, and so is
    the content of elements that hold no markup."""
    pos, n = 0, len(html)
    while pos < n:
        i = html.find("<", pos)
        if i < 0:
            yield "text", html[pos:], []
            return
        if i > pos:
            yield "text", html[pos:i], []
        mark = html[i + 1 : i + 2]
        if mark == "!" or mark == "?" or mark == "/" and not NAME.match(html, i + 2):
            if html.startswith("<!--", i):
                end = html.find("-->", i + 2)
                pos = n if end < 0 else max(end + 3, i + 4)
            else:
                end = html.find(">", i + 2)
                pos = n if end < 0 else end + 1
            continue
        name = NAME.match(html, i + (2 if mark == "/" else 1))
        if not name:
            yield "text", "<", []
            pos = i + 1
            continue
        attrs: list[tuple[str, str]] = []
        pos = GAP.match(html, name.end()).end()
        while pos < n and html[pos] != ">":
            m = ATTR.match(html, pos)
            key = m[1].lower()
            if key in KEYS and mark != "/":
                attrs.append((key, m[2] or m[3] or m[4] or ""))
            pos = GAP.match(html, m.end()).end()
        if pos >= n:
            return
        pos += 1
        tag = name[0].lower()
        yield "end" if mark == "/" else "start", tag, attrs
        if mark != "/" and tag in RAW:
            end = RAW_END[tag].search(html, pos)
            pos = end.end() if end else n


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in order; references are decoded, white space is not yet folded."""
    at, links = Node("#page", None), 0
    out: list[Block] = []
    block: Block | None = None

    def leave(names: tuple, stop: tuple) -> None:
        nonlocal at
        node = at
        while node.up is not None and node.tag not in stop:
            if node.tag in names:
                at = node.up
                return
            node = node.up

    for kind, tag, attrs in scan(html):
        if kind == "text":
            s = entities.unescape(tag) if "&" in tag else tag
            if block is None:
                if not s.strip():
                    continue
                block = Block(at)
                out.append(block)
            block.parts.append(s)
            size = len(s.strip())
            block.size += size
            block.linked += size if links else 0
        elif kind == "end":
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                before = at
                leave((tag,), ("td", "th", "table"))
                if at is not before and before.tag == tag and before.up is at:
                    block = None  # a span of its own is over
                continue
            block = None
            leave((tag,), ("table",) if tag in ("p", "li", "div") else ())
        elif tag in RAW:
            if tag not in ("svg", "math", "canvas"):
                block = None
        elif tag in INLINE:
            if tag == "a":
                links += 1
            if tag not in VOID and attrs:
                inner = _element(tag, attrs, at)
                if inner.hidden != at.hidden or inner.furniture != at.furniture or max(inner.named, inner.leaf) > max(at.named, at.leaf, 0.6):
                    block, at = None, inner  # a span that is an advert: a block of its own
        elif tag == "br":
            if block is not None:
                block.parts.append(" ")
        else:
            block = None
            if tag in VOID:
                continue
            if tag in CLOSED_BY:
                names, stop = CLOSED_BY[tag]
                leave(tuple(names.split()), stop)
            if at.paragraph:
                leave(("p",), ("button", "table", "td", "th"))
            if tag in ("article", "main", "section", "footer", "nav", "aside", "header"):
                links = 0
            at = _element(tag, attrs, at if at.depth < DEPTH else at.up)
    return [b for b in out if b.size]


STOPS = re.compile(r"[.!?。！？](?:\s|\Z)")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block."""
    x = np.zeros((len(found), FEATURES))
    for i, b in enumerate(found):
        n, tag = b.node, b.node.tag
        text = "".join(b.parts)
        x[i] = (
            1.0, math.log1p(b.size / 40), b.linked / b.size, min(3, len(STOPS.findall(text))) / 3, tag in LEAF and tag[0] != "h", tag in HEADINGS, tag in ("li", "td", "th", "label", "option", "dt"),
            n.article, n.furniture, n.header, n.hidden, n.named, n.inner, n.leaf * 0.5, n.good, n.talk, i / max(1, len(found) - 1), min(n.depth, 20) / 10, n.article and not n.inner and not n.furniture,
        )
    return x


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def practice_pages(count: int = 240, seed: int = 3) -> Iterator[tuple[str, list[bool]]]:
    """Pages made by rule from the usual parts, and whether each text block is content."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(2, 9)))
    line = lambda lo, hi: " ".join(word() for _ in range(r.randrange(lo, hi)))
    prose = lambda lo, hi: ". ".join(line(4, 14).capitalize() for _ in range(r.randrange(lo, hi))) + "."
    for _ in range(count):
        out: list[str] = []
        labels: list[bool] = []

        def put(html: str, *kept: bool) -> None:
            out.append(html)
            labels.extend(kept)

        def links(k: int) -> None:
            put("<ul>" + "".join(f"<li><a href=x>{line(1, 4)}</a></li>" for _ in range(k)) + "</ul>", *[False] * k)

        def furniture(name: str, tags: tuple[str, ...]) -> None:
            tag = r.choice(tags)
            put(f'<{tag} {r.choice(["class", "id"])}="{name}">' if r.random() < 0.8 or tag == "div" else f"<{tag}>")
            kind = r.randrange(4)
            if kind == 0:
                links(r.randrange(2, 8))
            elif kind == 1:
                put(f"<p>{prose(1, 8)}</p>", False)
            elif kind == 2:
                put(f"<h3>{line(1, 4)}</h3><div>{line(2, 20)} <a href=x>{line(1, 3)}</a></div>", False, False)
            else:
                put(line(3, 25), False)
            put(f"</{tag}>")

        if r.random() < 0.6:
            put(f"<header><h1>{line(1, 4)}</h1></header>" if r.random() < 0.7 else f'<div class="masthead">{line(1, 5)}</div>', False)
        if r.random() < 0.8:
            put("<nav>" if (nav := r.random() < 0.6) else f'<div class="{r.choice(["menu", "main-nav", "navbar top"])}">')
            links(r.randrange(3, 9))
            put("</nav>" if nav else "</div>")
        if r.random() < 0.5:
            furniture(r.choice(["cookie-notice", "consent banner", "ad", "advert", "promo-box", "notice"]), ("div", "section"))
        wrapper = r.random() < 0.3
        if wrapper:
            put(f'<div class="{r.choice(["layout has-sidebar", "page with-ads", "wrap no-comments", "container"])}">')
        if r.random() < 0.3:
            put(f'<div {r.choice(["hidden", "style=display:none", 'aria-hidden="true"'])}><p>{prose(1, 6)}</p></div>', False)
        box = r.choice(["article", "main", "article", "div content", "div entry-content", "div post", "section story", "div x1"])
        tag, _, name = box.partition(" ")
        own = f' class="{r.choice(["post comments-open", "entry", "has-sidebar post"])}"' if tag in ("article", "main") and r.random() < 0.4 else f' class="{name}"' if name else ""
        put(f"<{tag}{own}>")
        put(f"<h1>{line(3, 12)}</h1>", True)
        for _ in range(r.randrange(2, 9)):
            kind = r.random()
            if kind < 0.62:
                named = f' class="{r.choice(["related-work", "lead", "share-price", "first", "comment-style text"])}"' if r.random() < 0.25 else ""
                put(f"<p{named}>{prose(1, 9) if r.random() < 0.85 else line(1, 4)}</p>", True)
            elif kind < 0.72:
                put(f"<h2>{line(2, 7)}</h2>", True)
            elif kind < 0.8:
                k = r.randrange(2, 5)
                put("<ul>" + "".join(f"<li>{line(3, 15)}</li>" for _ in range(k)) + "</ul>", *[True] * k)
            elif kind < 0.86:
                put(f"<blockquote>{prose(1, 4)}</blockquote>", True)
            elif kind < 0.9:
                put(f"<table><tr><td>{line(1, 4)}</td><td>{line(1, 4)}</td></tr></table>", True, True)
            else:
                furniture(r.choice(["ad", "share-buttons", "related", "newsletter signup", "advert", "social", "promo", "sponsored"]), ("div", "aside", "div"))
        if r.random() < 0.2:
            furniture(r.choice(["comments", "comment-list"]), ("div", "section"))
        put(f"</{tag}>")
        if r.random() < 0.6:
            put(f'<section id="{r.choice(["comments", "disqus", "replies", "comment-list"])}">')
            for _ in range(r.randrange(1, 5)):
                put(f'<{(t := r.choice(["div", "p", "article"]))} class="comment">{prose(1, 7)}</{t}>', False)
            put("</section>")
        if r.random() < 0.6:
            furniture(r.choice(["sidebar", "widget", "related-posts", "sidebar-right", "recommended"]), ("aside", "div"))
        if wrapper:
            put("</div>")
        if r.random() < 0.3:
            put(f"<form><label>{line(1, 3)}</label><p>{prose(1, 3)}</p></form>", False, False)
        if r.random() < 0.8:
            furniture("footer", ("footer", "div", "footer"))
        yield "<body>" + "".join(out) + "</body>", labels


@lru_cache(maxsize=1)
def fitted(rounds: int = 1500, rate: float = 0.5, decay: float = 2e-4) -> tuple[float, ...]:
    """The classifier's weights, by gradient descent on the practice pages."""
    rows, labels = [], []
    for html, kept in practice_pages():
        found = blocks_of(html)
        if len(found) != len(kept):
            raise ValueError("a practice page's blocks and labels differ")
        rows.append(features(found))
        labels += kept
    x, y = np.concatenate(rows), np.array(labels, float)
    w, speed = np.zeros(FEATURES), np.zeros(FEATURES)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x * w).sum(1))) - y
        speed = 0.9 * speed - rate * 0.1 * ((x * error[:, None]).mean(0) + decay * w)
        w = w + 10 * speed
    return tuple(w.tolist())


def costs(found: list[Block], weights: tuple[float, ...]) -> list[tuple[float, float]]:
    """Capacities from the source and to the sink: what it costs to call a block
    boilerplate, and content."""
    odds = np.clip((features(found) * np.array(weights)).sum(1), -8, 8)
    return [(max(z, 0.0), max(-z, 0.0)) for z in odds.tolist()]


def _between(a: Node, b: Node) -> int:
    """DOM steps from one node to another."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def min_cut(from_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (Dinic's maximum flow
    over the nodes' excesses; only smoothness edges carry flow between nodes)."""
    n = len(from_source)
    excess = [s - t for s, t in zip(from_source, to_sink)]
    adj: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, w in edges:
        adj[a].append(len(to))
        to.append(b)
        cap.append(w)
        adj[b].append(len(to))
        to.append(a)
        cap.append(w)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            if excess[i] < -tiny:
                reached = True
                continue
            for e in adj[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for start in range(n):
            while excess[start] > tiny and level[start] == 0:
                path, i = [], start
                while excess[i] >= -tiny or i == start:
                    while nxt[i] < len(adj[i]):
                        e = adj[i][nxt[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        nxt[i] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        i = to[e ^ 1]
                        nxt[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if not path:
                    break
                flow = min(excess[start], -excess[i], min(cap[e] for e in path))
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                excess[start] -= flow
                excess[i] += flow


def main_text(html: str | None, weights: tuple[float, ...] | None = None) -> str:
    found = blocks_of(html or "")
    if not found:
        return ""
    both = costs(found, weights or fitted())
    edges, seen = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, 0.6 / (1 + _between(found[i - 1].node, b.node))))
        box = b.node.up or b.node
        if (j := seen.get(id(box))) is not None:
            edges.append((j, i, 0.3))
        seen[id(box)] = i
    side = min_cut([x for x, _ in both], [y for _, y in both], edges)
    return " ".join(" ".join("".join(b.parts).split()) for b, keep in zip(found, side) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    bound_batches(pages.sparkSession)
    weights = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
