"""Sitemaps, serving tables, totals, verdicts and glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.functions import markup, urls
from weftlake.staging import number

URLSET = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'


def sitemap_rows(files: DataFrame, path: str, mtime: str, base: str) -> DataFrame:
    """``loc, lastmod`` of every page file, the base without its trailing slashes."""
    loc = F.concat(F.regexp_replace(F.lit(base), r"/+\z", ""), urls.page_url_path(path))
    return files.select(loc.alias("loc"), F.date_format(mtime, "yyyy-MM-dd").alias("lastmod"))


PER_FILE = 50_000  # addresses of one sitemap, the format's own limit


def sitemap_xml(files: DataFrame, path: str, mtime: str, base: str, per_file: int | None = PER_FILE) -> DataFrame:
    """``part, n_urls, xml``: a urlset for each ``per_file`` addresses in order, so that no
    string grows with the site; all files but the last are full. Addresses are numbered by
    ranges. With None there is one urlset, put together from the entries of 50,000 addresses
    each. No file, one empty urlset."""
    rows = number(sitemap_rows(files, path, mtime, base), ["loc", "lastmod"], "rank")
    rows = rows.withColumn("part", F.floor(F.col("rank") / (per_file or PER_FILE)).cast("bigint"))
    entry = F.concat(F.lit("  <url>\n    <loc>"), urls.escape_xml("loc"), F.lit("</loc>\n    <lastmod>"), "lastmod", F.lit("</lastmod>\n  </url>\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "")
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([(0, 0, URLSET + "</urlset>\n")], "part bigint, n_urls bigint, xml string")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_urls"), body.alias("body"))
    if per_file is None:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda x: x["body"])
        parts = parts.agg(F.lit(0).cast("bigint").alias("part"), F.sum("n_urls").alias("n_urls"), F.array_join(ordered, "").alias("body"))
    return parts.select("part", "n_urls", F.concat(F.lit(URLSET), "body", F.lit("</urlset>\n")).alias("xml"))


def routes(requests: DataFrame, files: DataFrame, request: str, path: str) -> DataFrame:
    """``request, status, file, content_type, cache_control``: the sitemap, assets (cached
    for a year) and pages (for five minutes; a directory's index first), else 404."""
    r = F.col(request)
    rest = F.regexp_replace(r, "^/+", "")
    page = F.array(F.concat(F.lit("pages/"), F.regexp_replace(rest, r"/+\z", ""), F.when(rest == "", F.lit("")).otherwise(F.lit("/")), F.lit("index.html")), F.concat(F.lit("pages/"), rest))
    keys = F.when(r == "/sitemap.xml", F.array(F.lit("sitemap.xml"))).when(r.startswith("/assets/"), F.array(rest)).otherwise(page)
    asked = requests.select(r.alias("request")).distinct().select("request", F.posexplode(F.transform(keys, lambda k: F.regexp_replace(k, "/+", "/"))).alias("pos", "file"))
    hit = asked.join(files.select(F.col(path).alias("file")).distinct(), "file").groupBy("request").agg(F.min_by("file", "pos").alias("file"))
    out = asked.select("request").distinct().join(hit, "request", "left")
    cache = F.when(F.col("file").isNull() | (F.col("request") == "/sitemap.xml"), F.lit(None)).when(F.col("request").startswith("/assets/"), F.lit("public, max-age=31536000, immutable")).otherwise(F.lit("public, max-age=300"))
    return out.select("request", F.when(F.col("file").isNull(), 404).otherwise(200).alias("status"), "file", F.when(F.col("file").isNotNull(), urls.mime_type("file")).alias("content_type"), cache.alias("cache_control"))


def savings(before_after: DataFrame, before: str, after: str) -> DataFrame:
    """``pages, changed, bytes_before, bytes_after`` in one pass; UTF-8 bytes."""
    b, a = F.octet_length(before), F.octet_length(after)
    return before_after.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("changed"), F.coalesce(F.sum(b), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum(a), F.lit(0)).alias("bytes_after"))


BLOCK = 32_768  # code points of one bitmap


def glyph_maps(pages: DataFrame, html: str, by: list[str] | None = None) -> DataFrame:
    """``block, bits``, by group: which characters the visible text has, a bitmap for each
    block of code points. A group has 34 of them at most, whatever its texts hold, and
    tasks send bitmaps, not characters."""
    chars = F.explode(F.array_distinct(F.split(markup.visible_text(html), "")))
    seen = pages.select(*(by or []), chars.alias("glyph")).where("glyph <> ''")
    code = F.conv(F.hex(F.encode("glyph", "UTF-32")), 16, 10).cast("bigint")
    points = seen.select(*(by or []), F.floor(code / BLOCK).cast("int").alias("block"), (code % BLOCK).alias("bit"))
    return points.groupBy(*(by or []), "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def glyphs(pages: DataFrame, html: str, by: list[str] | None = None) -> DataFrame:
    """Distinct characters of the visible text (by group), read from its bitmaps."""
    maps = glyph_maps(pages, html, by)
    byte = lambda i: F.conv(F.hex(F.substring("bits", i + 1, 1)), 16, 10).cast("int")
    rows = maps.select(*(by or []), "block", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 8 - 1)), byte)).alias("i", "byte")).where("byte <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("byte").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0)
    codes = rows.select(*(by or []), "block", "i", F.explode(bits).alias("k")).withColumn("code", F.col("block") * BLOCK + F.col("i") * 8 + F.col("k"))
    return codes.select(*(by or []), F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32").alias("glyph"))


def verdict(entries: DataFrame, ratio: str, threshold: float = 0.02) -> DataFrame:
    """Whether all pages differ by the threshold at most; true without pages."""
    ok = F.col(ratio) <= threshold
    return entries.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~ok).alias("failed"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("passed"))
