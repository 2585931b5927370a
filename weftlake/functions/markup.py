"""Functions over HTML, CSS and XML text as Columns, without a document tree.

Patterns avoid ``$``, word boundaries and back-references, which differ between
engines; page text is never used as a replacement string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlake.functions import urls

C = Column | str


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- sitemaps ----

LOC, LASTMOD = r"(?s)<loc>\s*(.*?)\s*</loc>", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>"


def is_sitemap_index(xml: C) -> Column:
    return _col(xml).rlike(r"(?i)<sitemapindex[\s>]")


def sitemap_locs(xml: C) -> Column:
    return F.regexp_extract_all(_col(xml), F.lit(LOC), F.lit(1))


def sitemap_entries(xml: C) -> Column:
    """``array<struct<loc, lastmod>>``: a block a ``</url>``; blocks without loc don't count."""
    blocks = F.split(_col(xml), "(?i)</url>")
    entry = lambda b: F.struct(F.regexp_extract(b, LOC, 1).alias("loc"), F.nullif(F.regexp_extract(b, LASTMOD, 1), F.lit("")).alias("lastmod"))
    return F.filter(F.transform(blocks, entry), lambda e: e["loc"] != "")


# ---- structure without a tree ----


def tag_sequence(html: C) -> Column:
    """Names of the start tags in order, in small letters."""
    return F.transform(F.regexp_extract_all(_col(html), F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), lambda t: F.lower(t))


def bigrams(items: C) -> Column:
    """Distinct neighbouring pairs of an array."""
    a = _col(items)
    rest = F.greatest(F.size(a) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(a, F.lit(1), rest), F.slice(a, F.lit(2), rest), lambda x, y: F.concat_ws(">", x, y)))


def jaccard(a: C, b: C, equal: Column | None = None) -> Column:
    """Similarity of two arrays as sets. Two empty ones: 1 if ``equal``, else 0; one empty: 0."""
    x, y = _col(a), _col(b)
    both = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    same = F.lit(1.0) if equal is None else F.when(equal, 1.0).otherwise(0.0)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), same).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both)


# Class names that vary from page to page and carry no structure.
NOISE_CLASS = r"^(?:(?:vc_|wpb_|nd_options_).*|(?:post|postid|page-id|category)-[0-9]+)\z"


def denoise_classes(classes: C) -> Column:
    return F.filter(_col(classes), lambda c: ~c.rlike("(?s)" + NOISE_CLASS))


# ---- srcset ----


def _candidates(srcset: C) -> Column:
    parts = F.transform(F.split(_col(srcset), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _best(srcset: C, score) -> Column:
    """The URL of the candidate with the highest score; of equals the first."""
    ranked = F.transform(_candidates(srcset), lambda p, i: F.struct(score(p).alias("score"), (-i).alias("ord"), F.regexp_extract(p, r"^(\S+)", 1).alias("url")))
    return F.array_max(ranked)["url"]


def _number(p: Column, unit: str, digits: str) -> Column:
    """The last descriptor of a unit behind the URL."""
    found = F.regexp_extract_all(F.regexp_replace(p, r"^\S+", ""), F.lit(r"\s(" + digits + r")(?i:" + unit + r")(?=\s|\z)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).cast("double")


def largest_candidate(srcset: C) -> Column:
    """Most pixels: the greatest width if there is any, else the greatest density, else the first."""
    w = lambda p: F.floor(_number(p, "w", r"[0-9]+(?:[.][0-9]+)?")).cast("double")
    x = lambda p: _number(p, "x", r"[0-9]+(?:[.][0-9]+)?")
    c = _candidates(srcset)
    by_w, by_x = F.exists(c, lambda p: w(p).isNotNull()), F.exists(c, lambda p: x(p).isNotNull())
    first = F.regexp_extract(F.try_element_at(c, F.lit(1)), r"^(\S+)", 1)
    return F.when(F.trim(_col(srcset)) == "", F.lit(None)).when(by_w, _best(srcset, lambda p: F.coalesce(w(p), F.lit(-1.0)))).when(by_x, _best(srcset, lambda p: F.coalesce(x(p), F.lit(1.0)))).otherwise(first)


def preload_candidate(srcset: C) -> Column:
    """What to preload: the second word decides, a density counts 1000 a unit, else 0."""

    def score(p: Column) -> Column:
        second = F.coalesce(F.try_element_at(F.split(p, r"\s+"), F.lit(2)), F.lit(""))
        w, x = (F.regexp_extract(second, r"^([0-9]+(?:[.][0-9]+)?)" + u + r"\z", 1) for u in "wx")
        return F.when(w != "", w.cast("double")).when(x != "", x.cast("double") * 1000).otherwise(F.lit(0.0))

    return _best(srcset, score)


# ---- search metadata ----

_Q, _NQ = "[\"']", "[^\"']"
_ATTR = r"(?=[^A-Za-z0-9_])[^>]*[^A-Za-z0-9_]"
SEO_NODE = "(?is)" + "|".join([
    r"<title(?=[^A-Za-z0-9_])[^>]*>.*?</title>",
    rf"<meta{_ATTR}name\s*=\s*{_Q}description{_Q}[^>]*>",
    rf"<meta{_ATTR}property\s*=\s*{_Q}(?:og|twitter):{_NQ}+{_Q}[^>]*>",
    rf"<link{_ATTR}rel\s*=\s*{_Q}canonical{_Q}[^>]*>",
    rf"<link{_ATTR}rel\s*=\s*{_Q}alternate{_Q}[^>]*[^A-Za-z0-9_]hreflang\s*=\s*{_Q}{_NQ}+{_Q}[^>]*>",
    rf"<link{_ATTR}hreflang\s*=\s*{_Q}{_NQ}+{_Q}[^>]*[^A-Za-z0-9_]rel\s*=\s*{_Q}alternate{_Q}[^>]*>",
    rf"<script{_ATTR}type\s*=\s*{_Q}application/ld[+]json{_Q}[^>]*>.*?</script>",
])
STRICT_SEO_NODE = SEO_NODE + rf"|<meta{_ATTR}name\s*=\s*{_Q}twitter:{_NQ}+{_Q}[^>]*>"
HEAD = r"(?is)^(.*?)<head((?:[^A-Za-z0-9_>][^>]*)?)>(.*?)</head>(.*)\z"


def head_of(html: C) -> Column:
    """What stands inside ``<head>``; the whole text without one."""
    h = _col(html)
    return F.when(h.rlike(HEAD), F.regexp_extract(h, HEAD, 3)).otherwise(h)


def seo_nodes(html: C, strict: bool = False) -> Column:
    """Raw title, description, sharing, canonical, alternate and JSON-LD elements of the
    head in document order, byte for byte."""
    return F.regexp_extract_all(head_of(html), F.lit(STRICT_SEO_NODE if strict else SEO_NODE), F.lit(0))


def inject_seo(filled: C, nodes: C, strict: bool = False) -> Column:
    """``filled`` with its own such elements replaced by ``nodes``, put first in its head."""
    f, n = _col(filled), _col(nodes)
    inner = F.regexp_replace(F.regexp_replace(F.regexp_extract(f, HEAD, 3), STRICT_SEO_NODE if strict else SEO_NODE, ""), r"^\s*\n", "")
    new = F.concat(F.regexp_extract(f, HEAD, 1), F.lit("<head"), F.regexp_extract(f, HEAD, 2), F.lit(">\n"), F.array_join(n, "\n"), F.lit("\n"), inner, F.lit("</head>"), F.regexp_extract(f, HEAD, 4))
    return F.when((F.size(n) > 0) & f.rlike(HEAD), new).otherwise(f)


HTML_OPEN = r"(?is)^(.*?)<html((?:[^A-Za-z0-9_>][^>]*)?)>(.*)\z"
LANG = r"(?is)^(.*?[^A-Za-z0-9_])lang\s*=\s*[\"']([^\"']+)[\"'](.*)\z"


def keep_html_lang(original: C, filled: C) -> Column:
    """``filled`` with the original's ``<html lang>``; unchanged where there is none to copy."""
    o, f = _col(original), _col(filled)
    lang = F.regexp_extract(F.regexp_extract(o, HTML_OPEN, 2), LANG, 2)
    attrs = F.regexp_extract(f, HTML_OPEN, 2)
    old = F.regexp_extract(attrs, LANG, 2)
    attr = F.concat(F.lit('lang="'), lang, F.lit('"'))
    new = F.when(old == "", F.concat(F.regexp_replace(attrs, r"\s+\z", ""), F.lit(" "), attr)).otherwise(F.concat(F.regexp_extract(attrs, LANG, 1), attr, F.regexp_extract(attrs, LANG, 3)))
    whole = F.concat(F.regexp_extract(f, HTML_OPEN, 1), F.lit("<html"), new, F.lit(">"), F.regexp_extract(f, HTML_OPEN, 3))
    return F.when((lang == "") | ~f.rlike(HTML_OPEN) | (old == lang), f).otherwise(whole)


CANONICAL = r"(?is)^(.*?<link(?=[^A-Za-z0-9_])(?=[^>]*[^A-Za-z0-9_]rel\s*=\s*[\"']?canonical)[^>]*[^A-Za-z0-9_]href\s*=\s*)(\"[^\"]*\"|'[^']*')(.*)\z"


def rewrite_canonical(html: C, base: C) -> Column:
    """The page with its canonical link's same-origin href as a path; the quotes and all
    else stay."""
    h = _col(html)
    quoted = F.regexp_extract(h, CANONICAL, 2)
    ref = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    whole = urls.resolve_simple(ref, base)
    local = whole.isNotNull() & (urls.origin(whole) == urls.origin(base))
    q = F.left(quoted, F.lit(1))
    new = F.concat(F.regexp_extract(h, CANONICAL, 1), q, urls.path_only(whole), q, F.regexp_extract(h, CANONICAL, 3))
    return F.when(h.rlike(CANONICAL) & F.coalesce(local, F.lit(False)), new).otherwise(h)


# ---- templates ----

SLOT = r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}"


def template_slots(template: C) -> Column:
    """Distinct slot names, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(template), F.lit(SLOT), F.lit(1))))


def fill_template(template: C, values: C) -> Column:
    """Slots replaced in one pass by the map's values, missing ones by ''. Values are
    never looked at again, whatever they hold."""
    t, v = _col(template), _col(values)
    texts, names = F.split(t, SLOT), F.regexp_extract_all(t, F.lit(SLOT), F.lit(1))
    filled = F.transform(names, lambda n: F.coalesce(F.try_element_at(v, n), F.lit("")))
    return F.array_join(F.flatten(F.zip_with(texts, filled, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")


def missing_slots(template: C, values: C) -> Column:
    return F.filter(template_slots(template), lambda n: ~F.map_contains_key(_col(values), n))


def strip_fences(raw: C) -> Column:
    """Without one outer Markdown fence."""
    t = F.regexp_replace(_col(raw), r"\A\s+|\s+\z", "")
    inner = F.regexp_extract(t, r"(?is)\A```(?:html|htm)?[ \t]*\r?\n(.*?)\r?\n?```\z", 1)
    return F.when(inner != "", F.regexp_replace(inner, r"\A\s+|\s+\z", "")).otherwise(t)


# ---- cleaning, on well-formed tags ----


def strip_comments(html: C) -> Column:
    """Without comments, but for conditional ones."""
    return F.regexp_replace(_col(html), r"(?s)<!--(?!\s*(?:\[if|<!\[endif\])).*?-->", "")


def strip_script_types(html: C) -> Column:
    h = F.regexp_replace(_col(html), r"(?i)(<script(?:[^A-Za-z0-9_>][^>]*)?)\stype=[\"'](?:text|application)/(?:javascript|ecmascript|x-javascript)[\"']", "$1")
    return F.regexp_replace(h, r"(?i)(<style(?:[^A-Za-z0-9_>][^>]*)?)\stype=[\"']text/css[\"']", "$1")


def strip_empty_attributes(html: C) -> Column:
    return F.regexp_replace(_col(html), r"(?i)(<[a-z][^>]*?)\s(?:class|id|style)=(?:\"\s*\"|'\s*')", "$1")


META_BLOCKLIST = ["generator", "powered-by", "build-info", "cms-version"]


def drop_meta(html: C, blocklist: list[str] = META_BLOCKLIST) -> Column:
    """Without ``<meta>`` whose name, property or http-equiv holds a blocked word, but for
    protected ones (description, sharing, charset, viewport, content type and language)."""
    names = "|".join("\\Q" + b + "\\E" for b in blocklist)
    keep = r"(?![^>]*\scharset\s*=)(?![^>]*\s(?:name|property|http-equiv)\s*=\s*[\"'](?:description[\"']|viewport[\"']|og:|twitter:|content-type[\"']|content-language[\"']))"
    return F.regexp_replace(_col(html), r"(?i)<meta" + keep + r"(?=\s)(?=[^>]*\s(?:name|property|http-equiv)\s*=\s*[\"'][^\"']*(?:" + names + r"))[^>]*>", "") if blocklist else _col(html)


# ---- styles, scripts, preload hints ----

FACE = r"(?is)(@font-face\s*\{)([^{}]*)(\})"


def font_display_swap(css: C) -> Column:
    """``font-display: swap`` in every font face whose body has no braces."""
    c = F.regexp_replace(_col(css), r"(?is)(@font-face\s*\{[^{}]*?font-display\s*:\s*)[^;{}]*?(\s*[;}])", "$1swap$2")
    # bodies without the property get it: close an open last declaration first
    c = F.regexp_replace(c, r"(?is)(@font-face\s*\{(?:(?!font-display)[^{}])*?[^;{}\s])(\s*\})", "$1;$2")
    return F.regexp_replace(c, r"(?is)(@font-face\s*\{(?:(?!font-display)[^{}])*?)(\s*\})", "$1 font-display: swap;$2")


def existing_preloads(html: C) -> Column:
    tags = F.regexp_extract_all(_col(html), F.lit(r"(?i)<link(?=[^>]*\srel=[\"']preload[\"'])[^>]*>"), F.lit(0))
    hrefs = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\shref=[\"']([^\"']*)[\"']", 1))
    return F.array_distinct(F.filter(hrefs, lambda h: h != ""))


def font_preload_hrefs(html: C) -> Column:
    """Distinct WOFF2 files of font faces in the head's inline styles, without query
    strings and without those already preloaded."""
    styles = F.regexp_extract_all(head_of(html), F.lit(r"(?is)<style(?:[^A-Za-z0-9_>][^>]*)?>(.*?)</style>"), F.lit(1))
    faces = F.regexp_extract_all(F.array_join(styles, "\n"), F.lit(FACE), F.lit(2))
    found = F.regexp_extract_all(F.array_join(faces, "\n"), F.lit(r"(?i)url\(\s*[\"']?([^\"')?#\s]+[.]woff2)[^\"')]*[\"']?\s*\)"), F.lit(1))
    return F.array_except(F.array_distinct(found), existing_preloads(html))


def inject_font_preloads(html: C) -> Column:
    h = _col(html)
    links = F.transform(font_preload_hrefs(h), lambda x: F.concat(F.lit('<link rel="preload" as="font" type="font/woff2" href="'), urls.escape_attribute(x), F.lit('" crossorigin>')))
    new = F.concat(F.regexp_extract(h, HEAD, 1), F.lit("<head"), F.regexp_extract(h, HEAD, 2), F.lit(">"), F.regexp_extract(h, HEAD, 3), F.array_join(links, ""), F.lit("</head>"), F.regexp_extract(h, HEAD, 4))
    return F.when((F.size(links) > 0) & h.rlike(HEAD), new).otherwise(h)


# Parts of addresses of third-party scripts that a page doesn't need to render.
SCRIPT_BLOCKLIST = ["google-analytics", "gtag/js", "googletagmanager", "fbevents", "facebook.net", "hotjar", "intercom", "segment.io", "mixpanel", "doubleclick"]


def is_blocked_script(src: C, blocklist: list[str] = SCRIPT_BLOCKLIST) -> Column:
    return F.exists(F.array(*[F.lit(b) for b in blocklist]), lambda b: F.contains(_col(src), b)) if blocklist else F.lit(False)


# ---- visible text ----


def visible_text(html: C) -> Column:
    """Title and body text with scripts, styles and markup taken out."""
    h = F.regexp_replace(_col(html), r"(?is)<(script|style|noscript)(?:[^A-Za-z0-9_>][^>]*)?>.*?</(script|style|noscript)>", "")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(h, r"(?s)<[^>]*>", "")
