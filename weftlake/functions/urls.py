"""URL functions as Columns: parts, local paths, languages, file names, types.

A URL is split by one pattern; scheme, host, path, query and fragment are derived
from it without Python. ``absolute_url`` (an Arrow function) resolves any reference;
``resolve_simple`` covers absolute and root-relative ones as a Column.
"""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?\z"
# File extensions by asset type, media types by extension.
FONT_EXT = ["woff", "woff2", "ttf", "otf", "eot"]
IMAGE_EXT = ["png", "jpg", "jpeg", "gif", "webp", "avif", "svg", "ico", "bmp"]
MIME = {
    "html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "application/javascript; charset=utf-8",
    "json": "application/json; charset=utf-8", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "webp": "image/webp", "avif": "image/avif", "woff2": "font/woff2", "xml": "application/xml; charset=utf-8",
}
SKIPPED_REF = r"^(data:|javascript:|mailto:|#)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(url: Column | str, n: int) -> Column:
    return F.regexp_extract(_col(url), PARTS, n)


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, 1))


def host(url: Column | str) -> Column:
    return F.lower(part(url, 2))


def path(url: Column | str) -> Column:
    p = part(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column | str) -> Column:
    return part(url, 4)


def fragment(url: Column | str) -> Column:
    return part(url, 5)


def origin(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def path_only(url: Column | str) -> Column:
    """Path, query and fragment."""
    return F.concat(path(url), query(url), fragment(url))


def local_path(url: Column | str) -> Column:
    """Where a page is kept: below ``pages/``, with ``index.html`` for directory-like paths."""
    p = path(url)
    full = F.when(p.endswith("/"), F.concat(p, F.lit("index.html"))).when(~p.rlike(r"[.][A-Za-z0-9]+\z"), F.concat(p, F.lit("/index.html"))).otherwise(p)
    return F.concat(F.lit("pages/"), F.regexp_replace(full, "^/+", ""))


def page_url_path(local: Column | str) -> Column:
    """The inverse for listings: ``pages/a/index.html`` -> ``/a/``."""
    rest = F.regexp_replace(_col(local), "^pages/", "/")
    return F.regexp_replace(rest, r"index[.]html\z", "")


def language_prefix(html: Column | str, page_path: Column | str) -> Column:
    """First path segment below ``pages/`` if it is two or three small letters, else the
    primary part of ``<html lang>``, else ''."""
    rest = F.regexp_replace(F.regexp_replace(F.replace(_col(page_path), F.lit("\\"), F.lit("/")), r"(?s)^.*/pages/", ""), "^/+", "")
    segment = F.substring_index(rest, "/", 1)
    lang = F.lower(F.regexp_extract(_col(html), r"(?i)<html(?=[^A-Za-z0-9_])[^>]*[^A-Za-z0-9_]lang\s*=\s*[\"']([^\"'_-]*)[^\"']*[\"']", 1))
    ok = r"^[a-z]{2,3}\z"
    return F.when(segment.rlike(ok), segment).when(lang.rlike(ok), lang).otherwise(F.lit(""))


def relative_prefix(page_path: Column | str) -> Column:
    """``../`` for each directory of a page's path below ``pages/``, ``./`` at depth 0."""
    depth = F.size(F.split(_col(page_path), "/")) - 1
    return F.when(depth > 0, F.repeat(F.lit("../"), depth)).otherwise(F.lit("./"))


def extension(url: Column | str) -> Column:
    """Lower-case extension of the last path segment, without the dot; '' if none."""
    last = F.element_at(F.split(path(url), "/"), -1)
    return F.lower(F.regexp_extract(last, r"^.+[.]([^.]+)\z", 1))


def asset_type(url: Column | str) -> Column:
    e = extension(url)
    return F.when(e == "css", F.lit("css")).when(e.isin("js", "mjs"), F.lit("js")).when(e.isin(FONT_EXT), F.lit("fonts")).when(e.isin(IMAGE_EXT), F.lit("img"))


def hashed_name(url: Column | str, kind: Column | str, body: Column | str) -> Column:
    """``<stem>-<8 hex digits of the body's SHA-256><ext>``; the extension falls back on the type."""
    last = F.coalesce(F.try_element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(-1)), F.lit("asset"))
    ext = F.regexp_extract(last, r"^.+([.][^.]*)\z", 1)
    stem = F.when(ext == "", last).otherwise(F.left(last, F.length(last) - F.length(ext)))
    k = _col(kind)
    fallback = F.when(k == "css", F.lit(".css")).when(k == "js", F.lit(".js")).when(k == "fonts", F.lit(".woff2")).otherwise(F.lit(".bin"))
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(_col(body).cast("binary"), 256), 1, 8), F.when(ext == "", fallback).otherwise(ext))


def mime_type(file: Column | str) -> Column:
    """Media type by extension, the general binary one by default."""
    e = F.lower(F.regexp_extract(_col(file), r"[.]([^./]+)\z", 1))
    out = F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(e == k, F.lit(v)).otherwise(out)
    return out


def provider(model: Column | str) -> Column:
    """What stands before the first slash of ``provider/model``; an error without one."""
    c = _col(model)
    return F.when(F.instr(c, "/") > 1, F.substring_index(c, "/", 1)).otherwise(F.raise_error(F.concat(F.lit("no provider in model name: "), c)))


def strip_provider(model: Column | str) -> Column:
    """What stands after the first slash; the name itself without one."""
    return F.regexp_replace(_col(model), r"^[^/]*/", "")


def normal_format(raw: Column | str, ext: Column | str) -> Column:
    """Image format: the given one, else the extension; ``jpg`` is ``jpeg``, so is nothing."""
    f = F.lower(F.coalesce(F.nullif(_col(raw), F.lit("")), _col(ext)))
    return F.when(f.isNull() | f.isin("", "jpg"), F.lit("jpeg")).otherwise(f)


def escape_attribute(s: Column | str) -> Column:
    return F.replace(F.replace(_col(s), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def escape_xml(s: Column | str) -> Column:
    out = _col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ``**`` spans slashes, ``*`` and ``?`` don't;
    a trailing ``/**`` also takes the directory itself."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("/**/", i):
            out, i = out + "/(?:.*/)?", i + 4
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_pattern(x)[1:-2] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_-%~" else "\\" + glob[i]), i + 1
    return "^" + out + r"\z"


def matches_any(url: Column | str, globs: list[str]) -> Column:
    """Whether the URL's path matches one of the globs; no globs let all pass."""
    out = F.lit(not globs)
    for g in globs:
        out = out | path(url).rlike(glob_pattern(g))
    return out


def resolve_simple(ref: Column | str, base: Column | str) -> Column:
    """Absolute, scheme-relative and root-relative references; null for what is to be
    skipped and for what only :data:`absolute_url` resolves."""
    r = F.trim(_col(ref))
    return F.when((r == "") | r.rlike(SKIPPED_REF), F.lit(None)).when(r.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), r).when(r.startswith("//"), F.concat(scheme(base), F.lit(":"), r)).when(r.startswith("/"), F.concat(origin(base), r))


def absolute(ref: str | None, base: str | None) -> str | None:
    """Resolve a reference as browsers do: scheme and host in small letters, default port
    dropped, dot segments resolved, unsafe characters escaped; None if to be skipped or not valid."""
    ref = (ref or "").strip()
    if not ref or ref.startswith(("data:", "javascript:", "mailto:", "#")) or base is None:
        return None
    try:
        joined = urlsplit(urljoin(base, ref))
        port = joined.port
    except ValueError:
        return None
    if joined.scheme in ("http", "https"):
        if not joined.hostname:
            return None
        net = joined.hostname.encode("idna").decode() if not joined.hostname.isascii() else joined.hostname
        if port and port != {"http": 80, "https": 443}[joined.scheme]:
            net = f"{net}:{port}"
        if joined.username:
            net = f"{joined.username}{':' + joined.password if joined.password else ''}@{net}"
        kept: list[str] = []
        segments = joined.path.split("/")[1:] or [""]
        for s in segments:
            if s == "..":
                kept = kept[:-1]
            elif s != ".":
                kept.append(s)
        if segments[-1] in (".", ".."):
            kept.append("")
        safe = "!$&'()*+,;=:@%/~-._|^[]"
        return urlunsplit((joined.scheme, net, quote("/" + "/".join(kept), safe=safe), quote(joined.query, safe=safe + "?{}`"), quote(joined.fragment, safe=safe + "?{}")))
    return joined.geturl() if joined.scheme else None


def _absolute_batch(ref: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([absolute(r, b) for r, b in zip(ref, base)], dtype=object)


def absolute_url(ref: Column | str, base: Column | str) -> Column:
    """:func:`absolute` as a Column, over Arrow batches."""
    return F.pandas_udf(_absolute_batch, "string")(ref, base)
