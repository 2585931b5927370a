"""Functions from a page to a page (or to what is found in it), over the document tree.

Each takes and returns plain Python values; ``weftlake.operators.pages`` runs them over
Arrow batches. A page that a function has nothing to do with comes back byte for byte.
"""

from __future__ import annotations

import re

from weftlake.functions import urls
from weftlake.functions.dom import RAW, Comment, Element, Text, inner_html, parse, serialize
from weftlake.functions.select import BadSelector, select, select_one, split_groups

CSS_URL = re.compile(r"url\(\s*(?:\"([^\"]*)\"|'([^']*)'|([^'\")\s][^'\")]*?))\s*\)")
SLOT = re.compile(r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}")
JS_TYPES = {"", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript", "application/x-javascript", "module"}


def kind_of(url: str | None) -> str | None:
    if not url:
        return None
    ext = re.search(r"\.([^./?#]+)(?:[?#]|\Z)", re.sub(r"^[a-z]+://[^/]*", "", url.split("?")[0].split("#")[0]))
    e = ext[1].lower() if ext else ""
    return "css" if e == "css" else "js" if e in ("js", "mjs") else "fonts" if e in urls.FONT_EXT else "img" if e in urls.IMAGE_EXT else None


def candidates(srcset: str) -> list[tuple[str, str]]:
    """(address, descriptors) of a srcset's candidates."""
    found = [p.split(None, 1) for p in srcset.split(",") if p.strip()]
    return [(p[0], p[1].strip() if len(p) > 1 else "") for p in found]


def largest(srcset: str) -> str | None:
    """The candidate with the most pixels; widths before densities, the first of equals."""
    found = candidates(srcset)
    if not found:
        return None
    w = [int(float(x[-1])) if (x := re.findall(r"(?<!\S)(\d+(?:\.\d+)?)w(?!\S)", d, re.I)) else None for _, d in found]
    x = [float(x[-1]) if (x := re.findall(r"(?<!\S)(\d+(?:\.\d+)?)x(?!\S)", d, re.I)) else None for _, d in found]
    score = [-1 if v is None else v for v in w] if any(v is not None for v in w) else [1.0 if v is None else v for v in x]
    return found[score.index(max(score))][0]


def preload_pick(srcset: str) -> str | None:
    found = candidates(srcset)
    score = []
    for _, d in found:
        m = re.fullmatch(r"(\d+(?:\.\d+)?)([wx])", d.split()[0] if d else "")
        score.append(0.0 if not m else float(m[1]) * (1000 if m[2] == "x" else 1))
    return found[score.index(max(score))][0] if found else None


def asset_refs(html: str, base: str) -> list[tuple[str, str]]:
    """Distinct (address, type) a page refers to, by kinds of reference: stylesheets,
    icons and preloads, scripts, images, sources, srcsets, inline styles."""
    doc, out = parse(html), {}

    def put(ref: str | None, kind: str | None) -> None:
        url = urls.absolute(ref, base) if ref else None
        if url and kind:
            out.setdefault(url, kind)

    links = list(doc.find("link"))
    rel = lambda e: e.attrs.get("rel", "").lower().split()
    for e in links:
        if "stylesheet" in rel(e):
            put(e.attrs.get("href"), "css")
    for e in links:
        href = e.attrs.get("href")
        if any("icon" in r for r in rel(e)):
            put(href, kind_of(href) or "img")
        elif "preload" in rel(e):
            named = {"style": "css", "script": "js", "font": "fonts", "image": "img"}.get(e.attrs.get("as", "").lower())
            put(href, named or kind_of(urls.absolute(href, base)))
    for tag, kind in (("script", "js"), ("img", "img")):
        for e in doc.find(tag):
            put(e.attrs.get("src"), kind)
    for e in doc.find("source"):
        put(e.attrs.get("src"), kind_of(e.attrs.get("src")) or "img")
    for tag in ("img", "source"):
        for e in doc.find(tag):
            if e.attrs.get("srcset"):
                put(largest(e.attrs["srcset"]), "img")
    for e in doc.find("style"):
        for m in CSS_URL.finditer(e.text()):
            ref = m[1] or m[2] or m[3]
            put(ref, kind_of(urls.absolute(ref, base)) or "fonts")
    return list(out.items())


def rewrite_assets(html: str, url: str, manifest: dict[str, str], page: str | None = None) -> tuple[str, list[str]]:
    """The page with references found in the manifest made local, relative to the page's
    own path if given, else from the root; and those that weren't found."""
    doc, missing = parse(html), []
    up = "/" if page is None else "../" * (len(page.split("/")) - 1) or "./"

    def local(ref: str | None) -> str | None:
        absolute = urls.absolute(ref, url) if ref else None
        if absolute is None:
            return None
        if absolute in manifest:
            return up + manifest[absolute]
        missing.append(absolute)
        return None

    wanted = ("stylesheet", "icon", "preload", "canonical", "alternate")
    for e in doc.elements():
        names = {"link": ("href",), "script": ("src",), "img": ("src", "srcset"), "source": ("src", "srcset"), "video": ("src", "poster"), "audio": ("src",)}.get(e.tag, ())
        if e.tag == "link" and not any(w in e.attrs.get("rel", "").lower() for w in wanted):
            continue
        for name in names:
            if name not in e.attrs:
                continue
            if name == "srcset":
                found = [(local(a) or a, a, d) for a, d in candidates(e.attrs[name])]
                if any(x != a for x, a, _ in found):
                    e.attrs[name] = ", ".join(f"{x} {d}".strip() for x, _, d in found)
            elif new := local(e.attrs[name]):
                e.attrs[name] = new
    return serialize(doc), missing


def rewrite_css(css: str, url: str, manifest: dict[str, str], up: str = "/") -> tuple[str, list[str]]:
    """A stylesheet with its addresses made local, quotes kept; and those not found."""
    missing = []

    def swap(m: re.Match) -> str:
        ref = next(g for g in m.groups() if g is not None)
        absolute = urls.absolute(ref, url)
        if absolute is None:
            return m[0]
        if absolute not in manifest:
            missing.append(absolute)
            return m[0]
        quote = '"' if m[1] is not None else "'" if m[2] is not None else ""
        return f"url({quote}{up}{manifest[absolute]}{quote})"

    return CSS_URL.sub(swap, css), missing


def rewrite_alternates(html: str, base: str, local: str | None = None) -> str:
    if not re.search("hreflang", html, re.I):
        return html
    doc, changed = parse(html), False
    root = urls.absolute("/", base)
    root = root[:-1] if root else None
    target = urls.absolute("/", local) if local else None
    target = None if not local else target[:-1] if target else local.rstrip("/")
    if root is None:
        return html
    for e in doc.find("link"):
        if e.attrs.get("rel", "").lower() != "alternate" or "hreflang" not in e.attrs:
            continue
        whole = urls.absolute(e.attrs.get("href"), base)
        if whole and (whole == root or whole.startswith(root + "/")):
            path = whole[len(root) :] or "/"
            new = path if target in (None, root) else target + path
            if new != e.attrs["href"]:
                e.attrs["href"], changed = new, True
    return serialize(doc) if changed else html


# ---- cleaning ----


def clean(html: str, fold_space: bool = True) -> str:
    """Without comments (conditional ones stay), script and style types of the default
    kind, and blank class, id and style attributes; white space is folded in text, but
    not in pre, code, textarea, script and style. Doing it twice changes nothing more."""
    doc = parse(html)
    for n in list(doc.walk()):
        if type(n) is Comment and not n.data.strip().startswith(("[if", "<![endif]")):
            n.remove()
    for e in doc.elements():
        if e.tag == "script" and e.attrs.get("type", "-").lower() in JS_TYPES - {"module", ""} or e.tag == "style" and e.attrs.get("type", "").lower() == "text/css":
            del e.attrs["type"]
        for name in ("class", "id", "style"):
            if name in e.attrs and not e.attrs[name].strip():
                del e.attrs[name]
    if fold_space:
        kept = {"pre", "code", "textarea"} | RAW
        todo = [(doc, False)]
        while todo:
            e, inside = todo.pop()
            last = None
            for k in list(e.kids):
                if isinstance(k, Element):
                    todo.append((k, inside or k.tag in kept))
                    last = None
                elif type(k) is Text:
                    if last is not None:  # neighbours that a removed comment parted
                        last.data += k.data
                        k.remove()
                        k = last
                    last = k
                    if not inside:
                        k.data = re.sub(r"\s+", " ", k.data)
    return serialize(doc)


def drop_meta(html: str, blocklist: tuple[str, ...] = ("generator", "powered-by", "build-info", "cms-version")) -> str:
    doc, changed = parse(html), False
    for e in list(doc.find("meta")):
        name, prop, equiv = (e.attrs.get(k, "").strip().lower() for k in ("name", "property", "http-equiv"))
        if "charset" in e.attrs or name in ("description", "viewport") or equiv in ("content-type", "content-language") or name.startswith(("og:", "twitter:")) or prop.startswith(("og:", "twitter:")):
            continue
        if any(b and b.lower() in f"{name} {prop} {equiv}" for b in blocklist):
            e.remove()
            changed = True
    return serialize(doc) if changed else html


# ---- preload hints ----


def lcp_href(html: str) -> str | None:
    """The image most likely to be the largest: the first image or picture of the first
    main, else of the first article, else of the body."""
    doc = parse(html)
    for scope in (doc.first("main"), doc.first("article"), doc.first("body")):
        e = scope.first("picture", "img") if scope is not None else None
        if e is None:
            continue
        if e.tag == "picture":
            for s in e.find("source"):
                if s.attrs.get("srcset"):
                    return preload_pick(s.attrs["srcset"])
            e = e.first("img")
            if e is None:
                return None
            return (preload_pick(e.attrs["srcset"]) if e.attrs.get("srcset") else None) or e.attrs.get("src") or None
        return e.attrs.get("src") or (preload_pick(e.attrs["srcset"]) if e.attrs.get("srcset") else None)
    return None


def _preloads(doc: Element) -> set[str]:
    return {e.attrs["href"] for e in doc.find("link") if e.attrs.get("rel", "").lower() == "preload" and e.attrs.get("href")}


def add_lcp_preload(html: str) -> str:
    href = lcp_href(html)
    doc = parse(html)
    if not href or href in _preloads(doc):
        return html
    doc.first("head").add(Element("link", {"rel": "preload", "as": "image", "href": href}))
    return serialize(doc)


def add_font_preloads(html: str) -> str:
    doc = parse(html)
    head, known, added = doc.first("head"), _preloads(doc), False
    for style in list(head.find("style")):
        for face in re.findall(r"@font-face\s*\{([^{}]*)\}", style.text(), re.I):
            for m in CSS_URL.finditer(face):
                href = (m[1] or m[2] or m[3] or "").split("?")[0].split("#")[0]
                if href.lower().endswith(".woff2") and href not in known:
                    known.add(href)
                    head.add(Element("link", {"rel": "preload", "as": "font", "type": "font/woff2", "href": href, "crossorigin": "anonymous"}))
                    added = True
    return serialize(doc) if added else html


# ---- styles ----


def css_rules(css: str) -> list[tuple[str, str]]:
    """Top-level (selector or at-rule, whole text) pairs; comments don't count."""
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.S)
    out, depth, start, quote = [], 0, 0, ""
    head_end = 0
    for i, c in enumerate(css):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "{":
            if depth == 0:
                head_end = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append((css[start:head_end].strip(), css[start : i + 1].strip()))
                start = i + 1
        elif c == ";" and depth == 0:
            if rule := css[start : i + 1].strip():
                out.append((rule, rule))
            start = i + 1
    return out


PSEUDO = re.compile(r"::?(?!not\b|nth-|first-|last-|only-|root\b|empty\b)[a-zA-Z-]+(?:\([^()]*\))?|::[a-zA-Z-]+(?:\([^()]*\))?")


def selector_hits(doc: Element, selector: str) -> bool:
    """Whether one part of a selector list finds an element. States and pseudo-elements are
    left out; what is then empty, or not understood, counts as found."""
    for part in split_groups(selector):
        bare = PSEUDO.sub("", part).strip()
        bare = re.sub(r"([>+~])\s*\Z", r"\1 *", bare)
        if not bare:
            return True
        try:
            if select_one(doc, bare) is not None:
                return True
        except BadSelector:
            return True
    return False


def purge_css(css: str, html: str | Element) -> str:
    """Rules a page uses, one a line; at-rules stay as they are."""
    doc = parse(html) if isinstance(html, str) else html
    return "\n".join(rule for head, rule in css_rules(css) if head.startswith("@") or selector_hits(doc, head))


def flatten_css(css: str) -> str:
    """Without comments, nested style rules written out with their parents' selectors."""
    out: list[str] = []

    def walk(parent: str | None, body: str) -> None:
        own: list[str] = []
        for head, rule in css_rules(body + (";" if body.strip() and not body.strip().endswith((";", "}")) else "")):
            if "{" not in rule:
                own.append(rule.rstrip(";").strip())
            elif head.startswith("@") or parent is None and "{" not in rule[len(head) :].split("{", 1)[1]:
                out.append(re.sub(r"\s+", " ", rule if parent is None or not head.startswith("@") else f"{head} {{ {parent} {{ {rule.split('{', 1)[1].rsplit('}', 1)[0]} }} }}"))
            else:
                inner = rule.split("{", 1)[1].rsplit("}", 1)[0]
                parents = split_groups(parent) if parent else [""]
                full = ", ".join(h.replace("&", p) if "&" in h else f"{p} {h}".strip() for p in parents for h in split_groups(head))
                walk(full, inner)
        if own and parent is not None:
            out.append(f"{parent} {{ {'; '.join(own)}; }}")
        elif own:
            out.extend(o + ";" for o in own)

    if css.count("{") != css.count("}"):
        return css
    walk(None, css)
    return "\n".join(out)


def defer_styles(html: str) -> str:
    """Stylesheets load without blocking: print media until they are there."""
    doc = parse(html)
    links = [e for e in doc.find("link") if e.attrs.get("rel", "").lower() == "stylesheet" and e.attrs.get("media") != "print"]
    if not links:
        return html
    for e in links:
        again = dict(e.attrs)
        e.attrs["onload"] = f"this.media='{again.get('media', 'all')}'"
        e.attrs["media"] = "print"
        noscript = Element("noscript")
        noscript.add(Element("link", again))
        at = e.up.kids.index(e)
        e.up.add(noscript, e.up.kids[at + 1] if at + 1 < len(e.up.kids) else None)
    return serialize(doc)


def inline_critical(html: str, sheets: dict[str, str]) -> str:
    """The rules a page uses of its local stylesheets put in its head, the sheets deferred."""
    doc = parse(html)
    used = [purge_css(sheets[e.attrs["href"]], doc) for e in doc.find("link") if e.attrs.get("rel", "").lower() == "stylesheet" and e.attrs.get("href") in sheets]
    if any(used):
        style = Element("style")
        style.add(Text("\n".join(u for u in used if u)))
        doc.first("head").add(style)
        html = serialize(doc)
    return defer_styles(html)


def swap_fonts(css: str) -> str:
    """``font-display: swap`` in every font face; from an unclosed one on, nothing changes."""
    out, pos = [], 0
    for m in re.finditer(r"@font-face\s*\{", css, re.I):
        if m.start() < pos:
            continue
        end = css.find("}", m.end())
        if end < 0:
            break
        body = css[m.end() : end]
        if re.search(r"font-display\s*:", body, re.I):
            body = re.sub(r"(font-display\s*:\s*)[^;]*", r"\1swap", body, count=1, flags=re.I)
        else:
            body = body.rstrip()
            body += ("" if not body or body.endswith(";") else ";") + " font-display: swap; "
        out += [css[pos : m.end()], body]
        pos = end
    return "".join([*out, css[pos:]])


def swap_inline_fonts(html: str) -> str:
    if not re.search("@font-face", html, re.I):
        return html
    doc, changed = parse(html), False
    for e in doc.find("style"):
        old = e.text()
        if (new := swap_fonts(old)) != old:
            e.kids[:] = []
            e.add(Text(new))
            changed = True
    return serialize(doc) if changed else html


# ---- scripts ----


def minify_js(code: str) -> str:
    """Comments, indentation and blank lines go; strings, templates and line ends stay, so
    that the meaning can't change. An unclosed string or comment is an error."""
    out, i, n, before = [], 0, len(code), ""
    while i < n:
        c = code[i]
        if c in "\"'`":
            j = i + 1
            while j < n and code[j] != c:
                if code[j] == "\n" and c != "`":
                    raise ValueError("unclosed string")
                j += 2 if code[j] == "\\" else 1
            if j >= n:
                raise ValueError("unclosed string")
            out.append(code[i : j + 1])
            i, before = j + 1, c
        elif code.startswith("//", i):
            i = n if (e := code.find("\n", i)) < 0 else e
        elif code.startswith("/*", i):
            e = code.find("*/", i + 2)
            if e < 0:
                raise ValueError("unclosed comment")
            out.append("\n" if "\n" in code[i:e] else " ")
            i = e + 2
        elif c == "/" and (not before or before in "(,=:[!&|?{};+-*%~^<>\n"):
            j, inside = i + 1, False
            while j < n and (code[j] != "/" or inside):
                if code[j] == "\n":
                    raise ValueError("unclosed pattern")
                inside = code[j] == "[" or inside and code[j] != "]"
                j += 2 if code[j] == "\\" else 1
            if j >= n:
                raise ValueError("unclosed pattern")
            out.append(code[i : j + 1])
            i, before = j + 1, "/"
        else:
            out.append(c)
            if not c.isspace():
                before = c
            i += 1
    text = "".join(out)
    if "`" in text:
        return text.strip()
    return "\n".join(line for raw in text.split("\n") if (line := re.sub(r"[ \t]+", " ", raw).strip() if not re.search("[\"'/]", raw) else raw.strip()))


def defer_scripts(html: str, blocklist: tuple[str, ...], strategy: str = "defer", minify=minify_js) -> str:
    """Third-party scripts of the list are deferred or removed; inline scripts minified,
    data blocks left alone. A body that fails to minify stays."""
    doc = parse(html)
    for e in list(doc.find("script")):
        src = e.attrs.get("src")
        if src is not None:
            if any(b in src for b in blocklist):
                if strategy == "remove":
                    e.remove()
                else:
                    e.attrs.setdefault("defer", "")
        elif e.attrs.get("type", "").strip().lower() in JS_TYPES and (body := e.text()).strip():
            try:
                new = minify(body)
            except Exception:  # whatever the injected minifier raises
                continue
            e.kids[:] = []
            e.add(Text(new))
    return serialize(doc)


# ---- images ----


def to_picture(html: str, manifest: dict[str, list[tuple[int, str, str]]]) -> str:
    """Images of the manifest (source -> width, format, file) become pictures with AVIF
    and WebP sources; the image itself keeps its other attributes."""
    doc, changed = parse(html), False
    for img in list(doc.find("img")):
        src = img.attrs.get("src", "")
        if img.up.tag == "picture":
            continue
        variants = manifest.get(src) or manifest.get(re.sub(r"^(?:\./|/+)", "", src))
        if not variants:
            continue
        picture = Element("picture")
        img.up.add(picture, img)
        for fmt in ("avif", "webp"):
            own = sorted((w, f) for w, x, f in variants if x == fmt)
            if own:
                picture.add(Element("source", {"type": "image/" + fmt, "srcset": ", ".join(f"/{f} {w}w" for w, f in own)}))
        plain = [v for v in variants if v[1] not in ("avif", "webp")] or variants
        attrs = {k: v for k, v in img.attrs.items() if k not in ("src", "srcset")}
        img.attrs = {"src": "/" + max(plain)[2]} | attrs
        picture.add(img)
        changed = True
    return serialize(doc) if changed else html


# ---- templates ----


def _structural(e: Element) -> str:
    parts = []
    while e.up is not None and e.tag not in ("body", "html", "#document"):
        same = [k for k in e.up.kids if isinstance(k, Element) and k.tag == e.tag]
        parts.append(f"{e.tag}:nth-of-type({next(i for i, k in enumerate(same, 1) if k is e)})")
        e = e.up
    return " > ".join(["body" if e.tag == "body" else "html", *reversed(parts)])


def _by_names(e: Element) -> str:
    parts = []
    while e.up is not None and e.tag not in ("body", "html", "#document"):
        parts.append(e.tag + "".join("." + re.sub(r"([^\w-])", r"\\\1", c) for c in e.classes()))
        e = e.up
    return " > ".join(reversed(parts))


def slot_selectors(original: str, template: str, slots: list[str]) -> dict[str, str]:
    """A selector for each slot: of the first element whose own text holds it, by names
    if these find something in the original, else by place; '' where there is none."""
    doc, made = parse(original), parse(template)
    out = dict.fromkeys(slots, "")
    for e in made.elements():
        if e.tag in ("script", "style"):
            continue
        own = "".join(k.data for k in e.kids if type(k) is Text)
        for name in SLOT.findall(own):
            if name in out and not out[name]:
                by_names = _by_names(e)
                try:
                    found = bool(by_names) and select_one(doc, by_names) is not None
                except BadSelector:
                    found = False
                out[name] = by_names if found else _structural(e)
    return out


def slot_values(original: str, selectors: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Inner markup of each selector's first match; '' and a warning without one."""
    doc, out, warnings = parse(original), {}, []
    for name, sel in selectors.items():
        try:
            e = select_one(doc, sel) if sel else None
        except BadSelector:
            e = None
        out[name] = inner_html(e) if e is not None else ""
        if e is None:
            warnings.append(name)
    return out, warnings


# ---- refinement ----


def segments(html: str) -> list[str]:
    """Visible text pieces of the body in order, without blank ones."""
    return [t.data for t in _visible(parse(html))]


def _visible(doc: Element) -> list[Text]:
    body = doc.first("body")
    out = []
    for n in body.walk():
        if type(n) is Text and n.data.strip():
            up = n.up
            while up is not body and up.tag not in ("script", "style", "noscript"):
                up = up.up
            if up is body:
                out.append(n)
    return out


def refine(html: str, new: list[str]) -> str:
    """The page with its segments replaced one by one; its head byte for byte as it was."""
    doc = parse(html)
    found = _visible(doc)
    if len(found) != len(new):
        raise ValueError(f"{len(new)} segments for {len(found)}")
    if all(t.data == x for t, x in zip(found, new)):
        return html
    for t, x in zip(found, new):
        t.data = x
    m = re.search(r"<body\b[^>]*>", html, re.I)
    whole = serialize(doc)
    if not m:
        return whole
    at = re.search(r"<body\b[^>]*>", whole, re.I)
    return html[: m.end()] + whole[at.end() :]


def dom_text(html: str) -> str:
    """Title and body text without scripts, styles and noscript."""
    doc = parse(html)
    title = doc.first("title")
    return (title.text() if title is not None else "") + "".join(t.data for t in _visible(doc))


def query_all(html: str, selector: str) -> list[str]:
    return [serialize(e) for e in select(parse(html), selector)]
