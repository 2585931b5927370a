"""A document tree after the HTML standard's tree construction, and its serialisation.

Covered: implied html, head and body; raw text and references; void elements;
paragraphs, list items, headings, options and table parts that close themselves;
reconstruction of open formatting elements and the adoption agency; table parts that
are implied, and content that tables push out. Not covered: framesets, quirks mode,
and templates' separate content.
"""

from __future__ import annotations

import html as entities
import re

TAG = re.compile(r"<!--(.*?)(?:-->|--!>|\Z)|<!(doctype[^>]*)>|<[!?]([^>]*)>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S | re.I)
ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
RCDATA = {"title", "textarea"}
HEAD_ONLY = set("base basefont bgsound link meta title script style noframes template".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
BLOCK = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr xmp plaintext".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
IMPLIED_END = set("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = set("applet caption html table td th marquee object template".split())
SPECIAL = set("address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split())
TABLE_PARTS = {"caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"}


class Node:
    __slots__ = ("up",)

    def __init__(self):
        self.up: Element | None = None

    def remove(self) -> None:
        if self.up is not None:
            self.up.kids.remove(self)
            self.up = None


class Text(Node):
    __slots__ = ("data",)

    def __init__(self, data: str):
        super().__init__()
        self.data = data


class Comment(Text):
    pass


class Doctype(Text):
    pass


class Element(Node):
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        super().__init__()
        self.tag, self.attrs, self.kids = tag, attrs or {}, []

    def add(self, node: Node, before: Node | None = None) -> Node:
        node.remove()
        node.up = self
        if before is None:
            self.kids.append(node)
        else:
            self.kids.insert(next(i for i, k in enumerate(self.kids) if k is before), node)
        return node

    def walk(self):
        """All nodes below, in document order."""
        todo = list(reversed(self.kids))
        while todo:
            n = todo.pop()
            yield n
            if isinstance(n, Element):
                todo.extend(reversed(n.kids))

    def elements(self):
        return (n for n in self.walk() if isinstance(n, Element))

    def find(self, *tags: str):
        return (n for n in self.elements() if n.tag in tags)

    def first(self, *tags: str):
        return next(self.find(*tags), None)

    def text(self) -> str:
        return "".join(n.data for n in self.walk() if type(n) is Text)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Builder:
    def __init__(self):
        self.doc = Element("#document")
        self.stack: list[Element] = []
        self.active: list[Element | None] = []  # None: a marker
        self.html = self.head = self.body = None
        self.head_closed = False

    # -- where things go --

    def need_html(self) -> None:
        if self.html is None:
            self.html = self.doc.add(Element("html"))
            self.stack = [self.html]

    def need_head(self) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.html.add(Element("head"))

    def need_body(self) -> None:
        self.need_head()
        self.head_closed = True
        if self.body is None:
            self.body = self.html.add(Element("body"))
            self.stack = [self.html, self.body]

    @property
    def top(self) -> Element:
        return self.stack[-1]

    def place(self, node: Node, foster: bool = False) -> None:
        if foster and self.top.tag in ("table", "tbody", "thead", "tfoot", "tr"):
            table = next(e for e in reversed(self.stack) if e.tag == "table")
            (table.up or self.body).add(node, table if table.up else None)
        else:
            self.top.add(node)

    def text(self, data: str) -> None:
        if not data:
            return
        if self.body is None:
            rest = data.lstrip(" \t\n\r\f")
            if self.head is not None and data[: len(data) - len(rest)]:
                (self.html if self.head_closed else self.head).add(Text(data[: len(data) - len(rest)]))
            if not rest:
                return
            self.need_body()
            data = rest
        in_table = self.top.tag in ("table", "tbody", "thead", "tfoot", "tr")
        foster = in_table and data.strip() != ""
        self.reconstruct() if not in_table or foster else None
        self._put_text(data, foster)

    def _put_text(self, data: str, foster: bool) -> None:
        if not foster and self.top.kids and type(self.top.kids[-1]) is Text:
            self.top.kids[-1].data += data
        else:
            self.place(Text(data), foster)

    # -- scopes and implied ends --

    def in_scope(self, tag: str | set, extra: tuple = ()) -> bool:
        tags = {tag} if isinstance(tag, str) else tag
        for e in reversed(self.stack):
            if e.tag in tags:
                return True
            if e.tag in SCOPE or e.tag in extra:
                return False
        return False

    def imply_ends(self, but: str = "") -> None:
        while self.top.tag in IMPLIED_END and self.top.tag != but:
            self.stack.pop()

    def pop_to(self, tags: set) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in tags:
                return

    def close_p(self) -> None:
        if self.in_scope("p", ("button",)):
            self.imply_ends("p")
            self.pop_to({"p"})

    # -- formatting elements --

    def reconstruct(self) -> None:
        at = len(self.active)
        while at and self.active[at - 1] is not None and self.active[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(self.active)):
            old = self.active[i]
            new = Element(old.tag, dict(old.attrs))
            self.place(new, True)
            self.stack.append(new)
            self.active[i] = new

    def remember(self, e: Element) -> None:
        same = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.tag == e.tag and x.attrs == e.attrs:
                same.append(x)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(e)

    def adopt(self, tag: str) -> None:
        if self.top.tag == tag and self.top not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.tag == tag:
                    fmt = x
                    break
            if fmt is None:
                self.other_end(tag)
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            at = self.stack.index(fmt)
            if any(e.tag in SCOPE for e in self.stack[at + 1 :]):
                return
            block = next((e for e in self.stack[at + 1 :] if e.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(fmt)
                return
            above, mark = self.stack[at - 1], self.active.index(fmt)
            node, last, index, count = block, block, self.stack.index(block), 0
            while True:
                count += 1
                index -= 1
                node = self.stack[index]
                if node is fmt:
                    break
                if count > 3 and node in self.active:
                    mark -= self.active.index(node) < mark
                    self.active.remove(node)
                if node not in self.active:
                    del self.stack[index]
                    continue
                new = Element(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = new
                self.stack[index] = new
                if last is block:
                    mark = self.active.index(new) + 1
                new.add(last)
                last = new
            if above.tag in ("table", "tbody", "thead", "tfoot", "tr"):
                table = next(e for e in reversed(self.stack) if e.tag == "table")
                (table.up or above).add(last, table if table.up else None)
            else:
                above.add(last)
            new = Element(fmt.tag, dict(fmt.attrs))
            for k in list(block.kids):
                new.add(k)
            block.add(new)
            where = self.active.index(fmt)
            self.active.remove(fmt)
            self.active.insert(mark - (where < mark), new)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(block) + 1, new)

    def other_end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag == tag:
                self.imply_ends(tag)
                del self.stack[i:]
                return
            if self.stack[i].tag in SPECIAL:
                return

    def clear_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # -- tags --

    def insert(self, tag: str, attrs: dict, foster: bool = True) -> Element:
        e = Element(tag, attrs)
        self.place(e, foster)
        if tag not in VOID:
            self.stack.append(e)
        return e

    def start(self, tag: str, attrs: dict, closed: bool) -> Element | None:
        """Returns the element if its content is raw text."""
        if tag == "html":
            self.need_html()
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return None
        if tag == "head":
            if self.head is None:
                self.need_head()
                self.head.attrs.update(attrs)
            return None
        if tag == "body":
            self.need_body()
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return None
        if self.body is None and (tag in HEAD_ONLY or tag == "noscript" and not self.head_closed):
            self.need_head()
            e = self.head.add(Element(tag, attrs))
            if tag in RAW or tag in RCDATA:
                return e
            if tag in ("noscript", "template"):
                self.stack = [self.html, self.head, e]
            return None
        if len(self.stack) > 1 and self.stack[1] is self.head:
            if tag in HEAD_ONLY:
                e = self.top.add(Element(tag, attrs))
                return e if tag in RAW or tag in RCDATA else None
            self.stack = [self.html]
        self.need_body()
        if tag in TABLE_PARTS and self.table_part(tag, attrs):
            return None
        if tag in RAW | RCDATA:
            if tag == "xmp":
                self.close_p()
            e = Element(tag, attrs)
            self.place(e, tag not in ("script", "style"))
            return e
        if tag in HEAD_ONLY:
            self.place(Element(tag, attrs), True)
            return None
        if tag in BLOCK:
            self.close_p()
            if tag in HEADING and self.top.tag in HEADING:
                self.stack.pop()
            self.insert(tag, attrs)
            return None
        if tag in ("li", "dd", "dt"):
            mine = {"li"} if tag == "li" else {"dd", "dt"}
            for e in reversed(self.stack):
                if e.tag in mine:
                    self.imply_ends(e.tag)
                    self.pop_to({e.tag})
                    break
                if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
            return None
        if tag in ("option", "optgroup"):
            if self.top.tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.top.tag == "optgroup":
                self.stack.pop()
        if tag == "button" and self.in_scope("button"):
            self.imply_ends()
            self.pop_to({"button"})
        if tag == "a" and any(x is not None and x.tag == "a" for x in self._since_marker()):
            old = next(x for x in self._since_marker() if x.tag == "a")
            self.adopt("a")
            if old in self.active:
                self.active.remove(old)
            if old in self.stack:
                self.stack.remove(old)
        if tag in ("param", "source", "track"):
            self.place(Element(tag, attrs), True)
            return None
        if self.top.tag not in ("svg", "math"):
            self.reconstruct()
        e = self.insert(tag, attrs)
        if tag in FORMATTING:
            self.remember(e)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)
        if closed and tag not in VOID and (tag in ("svg", "math") or any(x.tag in ("svg", "math") for x in self.stack[:-1])):
            self.stack.pop()
        return None

    def _since_marker(self) -> list[Element]:
        out = []
        for x in reversed(self.active):
            if x is None:
                break
            out.append(x)
        return out

    def table_part(self, tag: str, attrs: dict) -> bool:
        if not self.in_scope_table():
            return True  # a table part outside of a table is dropped
        if self.top.tag in ("td", "th", "caption") or any(e.tag in ("td", "th", "caption") for e in self._inside_table()):
            self.imply_ends()
            self.pop_to({"td", "th", "caption"})
            self.clear_marker()
        body = {"tbody", "thead", "tfoot"}
        keep = {"table"} | (body if tag in ("tr", "td", "th") else set()) | ({"tr"} if tag in ("td", "th") else set()) | ({"colgroup"} if tag == "col" else set())
        while self.top.tag not in keep and len(self.stack) > 2:
            self.stack.pop()
        if tag in ("tr", "td", "th") and self.top.tag == "table":
            self.insert("tbody", {}, False)
        if tag in ("td", "th") and self.top.tag in body:
            self.insert("tr", {}, False)
        if tag == "col" and self.top.tag == "table":
            self.insert("colgroup", {}, False)
        self.insert(tag, attrs, False)
        if tag in ("td", "th", "caption"):
            self.active.append(None)
        return True

    def in_scope_table(self) -> bool:
        return any(e.tag == "table" for e in self.stack)

    def _inside_table(self) -> list[Element]:
        at = max(i for i, e in enumerate(self.stack) if e.tag == "table")
        return self.stack[at + 1 :]

    def end(self, tag: str) -> None:
        if tag == "head":
            self.need_head()
            self.head_closed = True
            return
        if self.body is None:
            if self.stack and self.top.tag == tag and tag in ("noscript", "template"):
                self.stack = [self.html]
                return
            if tag not in ("body", "html", "br", "p"):
                return
        self.need_body()
        if tag in ("body", "html"):
            return
        if tag == "p":
            if not self.in_scope("p", ("button",)):
                self.insert("p", {})
            self.close_p()
        elif tag == "br":
            self.reconstruct()
            self.insert("br", {})
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in HEADING:
            if self.in_scope(HEADING):
                self.imply_ends()
                self.pop_to(HEADING)
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            if any(e.tag == tag for e in (self._inside_table() if tag != "table" and self.in_scope_table() else self.stack)):
                self.imply_ends()
                if tag in ("td", "th", "caption"):
                    self.pop_to({tag})
                    self.clear_marker()
                else:
                    self.pop_to({tag})
        elif tag in BLOCK or tag in ("button", "li", "dd", "dt", "applet", "marquee", "object"):
            if self.in_scope(tag, ("ol", "ul") if tag == "li" else ()):
                self.imply_ends(tag if tag in IMPLIED_END else "")
                self.pop_to({tag})
                if tag in ("applet", "marquee", "object"):
                    self.clear_marker()
        else:
            self.other_end(tag)


def parse(html: str) -> Element:
    """The document of a page; it always holds html, head and body."""
    b, pos = Builder(), 0
    while m := TAG.search(html, pos):
        if m.start() > pos:
            b.text(entities.unescape(html[pos : m.start()]))
        pos = m.end()
        if m[5] is None:
            if m[2] is not None:
                if b.html is None:
                    b.doc.add(Doctype(m[2][7:].strip()))
                continue
            node = Comment(m[1] if m[1] is not None else m[3] or "")
            if b.html is None:
                b.doc.add(node)
            elif b.body is not None:
                b.top.add(node)
            else:
                (b.html if b.head is None or b.head_closed else b.head).add(node)
            continue
        tag = m[5].lower()
        if m[4]:
            b.end(tag)
            continue
        attrs: dict[str, str] = {}
        for k, x, y, z in ATTR.findall(m[6]):
            attrs.setdefault(k.lower(), entities.unescape(x or y or z))
        raw = b.start(tag, attrs, bool(m[7]))
        if raw is not None:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, pos)
            data = html[pos : end.start() if end else len(html)]
            if data:
                raw.add(Text(entities.unescape(data) if tag in RCDATA else data))
            pos = end.end() if end else len(html)
    if pos < len(html):
        b.text(entities.unescape(html[pos:]))
    b.need_body()
    return b.doc


def _escape(s: str, attribute: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return s.replace('"', "&quot;") if attribute else s.replace("<", "&lt;").replace(">", "&gt;")


def serialize(node: Node) -> str:
    """Markup of a node after the standard's algorithm; of a document, of all in it."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, Doctype):
            out.append(f"<!DOCTYPE {n.data}>")
        elif isinstance(n, Comment):
            out.append(f"<!--{n.data}-->")
        elif isinstance(n, Text):
            out.append(n.data if n.up is not None and n.up.tag in RAW | {"plaintext"} else _escape(n.data))
        else:
            if n.tag != "#document":
                out.append("<" + n.tag + "".join(f' {k}="{_escape(v, True)}"' for k, v in n.attrs.items()) + ">")
                if n.tag in VOID:
                    continue
                todo.append(f"</{n.tag}>")
            todo.extend(reversed(n.kids))
    return "".join(out)


def inner_html(e: Element) -> str:
    return "".join(serialize(k) for k in e.kids)


def skeleton(html: str, classes=lambda c: c) -> str:
    """``depth:tag.class.class`` of the elements in document order, joined by bars.
    Scripts and styles are left out; classes go through ``classes``, once each, sorted."""
    out: list[str] = []
    todo = [(k, 0) for k in reversed(parse(html).kids) if isinstance(k, Element)]
    while todo:
        e, depth = todo.pop()
        if e.tag in ("script", "style"):
            continue
        names = sorted(set(classes(e.classes())))
        out.append(f"{depth}:{e.tag}" + "".join("." + c for c in names))
        todo.extend((k, depth + 1) for k in reversed(e.kids) if isinstance(k, Element))
    return "|".join(out)
