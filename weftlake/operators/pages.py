"""Document-tree functions as Columns and DataFrame operators, over Arrow batches.

Functions of one page are pandas UDFs; those that need a page's references or
stylesheets get them as an array column that was joined before, so nothing that grows
with the site is sent to every executor.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions import dom, markup, pagefix, urls
from weftlake.functions.markup import NOISE_CLASS
from weftlake.staging import bound_batches

C = Column | str


def _each(f: Callable, kind: str, fields: tuple[str, ...] = ()) -> Callable[..., Column]:
    """A function of plain values, run null-safe over small batches: a null page gives null.
    ``fields`` names those of a struct, which the function returns as a dict."""

    def make(*cols: C) -> Column:
        def batch(*series: pd.Series) -> pd.Series | pd.DataFrame:
            rows = [None if row[0] is None else f(*row) for row in zip(*series)]
            return pd.DataFrame([r or {} for r in rows], columns=list(fields)) if fields else pd.Series(rows, dtype=object)

        if spark := SparkSession.getActiveSession():
            bound_batches(spark)
        # pandas_udf reads the arguments' number from the signature
        if len(cols) == 1:
            return F.pandas_udf(lambda a: batch(a), kind, F.PandasUDFType.SCALAR)(*cols)
        if len(cols) == 2:
            return F.pandas_udf(lambda a, b: batch(a, b), kind, F.PandasUDFType.SCALAR)(*cols)
        return F.pandas_udf(lambda a, b, c: batch(a, b, c), kind, F.PandasUDFType.SCALAR)(*cols)

    return make


def _denoised(classes: list[str]) -> list[str]:
    import re

    return [c for c in classes if not re.match(NOISE_CLASS.replace(r"\z", r"\Z"), c, re.S)]


skeleton = _each(lambda h: dom.skeleton(h, _denoised), "string")
clean = _each(pagefix.clean, "string")
clean_all = _each(lambda h: pagefix.drop_meta(pagefix.clean(h)), "string")
drop_meta = _each(pagefix.drop_meta, "string")
lcp_href = _each(pagefix.lcp_href, "string")
add_preloads = _each(lambda h: pagefix.add_font_preloads(pagefix.add_lcp_preload(h)), "string")
segments = _each(pagefix.segments, "array<string>")
dom_text = _each(pagefix.dom_text, "string")
purge_css = _each(lambda css, html: pagefix.purge_css(css, html or ""), "string")
flatten_css = _each(pagefix.flatten_css, "string")
swap_inline_fonts = _each(pagefix.swap_inline_fonts, "string")
rewrite_alternates = _each(lambda h, base, local: pagefix.rewrite_alternates(h, base, local), "string")
asset_refs = _each(lambda h, base: [{"url": u, "type": t} for u, t in pagefix.asset_refs(h, base)], "array<struct<url:string,type:string>>")


def defer_scripts(html: C, blocklist: list[str] = markup.SCRIPT_BLOCKLIST, strategy: str = "defer", minify=pagefix.minify_js) -> Column:
    return _each(lambda h: pagefix.defer_scripts(h, tuple(blocklist), strategy, minify), "string")(html)


def discover(pages: DataFrame, url: str = "url", html: str = "html", order: str = "page_id") -> DataFrame:
    """``page_id, ord, url, type`` of every distinct reference of every page."""
    refs = pages.select(F.col(order).alias("page_id"), F.posexplode(asset_refs(html, url)).alias("ord", "r"))
    return refs.select("page_id", "ord", "r.url", "r.type")


def with_manifest(pages: DataFrame, refs: DataFrame, manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages with ``files``: the manifest entries of their own references, as JSON."""
    found = refs.join(manifest.select("url", "local_path"), "url").groupBy(key).agg(F.to_json(F.map_from_entries(F.collect_set(F.struct("url", "local_path")))).alias("files"))
    return pages.join(found, key, "left").withColumn("files", F.coalesce("files", F.lit("{}")))


def rewrite_pages(pages: DataFrame, refs: DataFrame, manifest: DataFrame, url: str = "url", html: str = "html", relative: bool = True) -> DataFrame:
    """Pages with local references, and ``unmatched``: those the manifest doesn't have."""
    rows = with_manifest(pages, refs, manifest)
    local = F.regexp_replace(urls.local_path(url), "^pages/", "")

    def swap(h: str, base: str, rest: str) -> dict:
        files, page = rest.split("\x00", 1)
        new, missing = pagefix.rewrite_assets(h, base, json.loads(files), page if relative else None)
        return {"html": new, "unmatched": missing}

    done = _each(swap, "struct<html:string,unmatched:array<string>>", ("html", "unmatched"))(html, url, F.concat("files", F.lit("\x00"), local))
    return rows.withColumn("_r", done).withColumn(html, F.col("_r.html")).withColumn("unmatched", F.col("_r.unmatched")).drop("_r", "files")


def rewrite_sheets(sheets: DataFrame, manifest: DataFrame, url: str = "url", css: str = "css") -> DataFrame:
    """Stylesheets with local references; their addresses are found, joined and put back."""
    found = F.regexp_extract_all(css, F.lit(r"url\(\s*[\"']?([^\"')]+)[\"']?\s*\)"), F.lit(1))
    refs = sheets.select(url, css, F.explode(F.array_distinct(found)).alias("ref"))
    refs = refs.select(F.col(url).alias("sheet"), urls.absolute_url("ref", url).alias("url"))
    rows = with_manifest(sheets.withColumn("sheet", F.col(url)), refs, manifest, "sheet")
    new = _each(lambda text, base, files: pagefix.rewrite_css(text, base, json.loads(files))[0], "string")(css, url, "files")
    return rows.withColumn(css, new).drop("files", "sheet")


def page_sheets(pages: DataFrame, sheets: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Pages with ``sheets``: the text of the stylesheets they link, as JSON by href."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link(?=[^>]*\srel=[\"']?stylesheet)[^>]*>"), F.lit(0))
    hrefs = F.array_distinct(F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\shref=[\"']?([^\"'\s>]*)", 1)))
    refs = pages.select(key, url, F.explode(hrefs).alias("href")).select(key, "href", urls.absolute_url("href", url).alias("sheet"))
    found = refs.join(sheets.select(F.col("url").alias("sheet"), "css"), "sheet").groupBy(key).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("href", "css")))).alias("sheets"))
    return pages.join(found, key, "left").withColumn("sheets", F.coalesce("sheets", F.lit("{}")))


inline_critical = _each(lambda h, sheets: pagefix.inline_critical(h, json.loads(sheets)), "string")


def purge_shared(pages: DataFrame, links: DataFrame, sheets: DataFrame) -> DataFrame:
    """``sheet, css``: stylesheets with the rules any linking page uses, in their order.
    ``links(page_id, sheet)`` says who uses which; a rule is kept once a page has it."""
    rules = _each(lambda css: [{"head": h, "rule": r} for h, r in pagefix.css_rules(css)], "array<struct<head:string,rule:string>>")
    every = sheets.select("sheet", F.posexplode(rules("css")).alias("pos", "r")).select("sheet", "pos", "r.head", "r.rule")
    lists = every.where(~F.col("head").startswith("@")).groupBy("sheet").agg(F.to_json(F.collect_set("head")).alias("heads"))
    hits = _each(lambda html, heads: [h for d in [dom.parse(html)] for h in json.loads(heads) if pagefix.selector_hits(d, h)], "array<string>")
    used = links.join(lists, "sheet").join(pages.select("page_id", "html"), "page_id").select("sheet", F.explode(hits("html", "heads")).alias("head")).distinct()
    kept = every.join(used, ["sheet", "head"], "left_semi").unionByName(every.where(F.col("head").startswith("@")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule"))), lambda x: x["rule"]), "\n")
    return sheets.select("sheet").join(kept.groupBy("sheet").agg(text.alias("css")), "sheet", "left").withColumn("css", F.coalesce("css", F.lit("")))


def to_pictures(pages: DataFrame, variants: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages whose images became pictures; ``variants(path, width, format, file)``."""
    srcs = pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<img(?=\s)[^>]*\ssrc=[\"']([^\"']*)[\"']"), F.lit(1)))).alias("src"))
    keys = srcs.select(key, F.explode(F.array_distinct(F.array("src", F.regexp_replace("src", r"^(?:[.]/|/+)", "")))).alias("path"))
    by_path = variants.groupBy("path").agg(F.collect_list(F.struct("width", "format", "file")).alias("v"))
    found = keys.join(by_path, "path").groupBy(key).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "v")))).alias("m"))
    new = _each(lambda h, m: pagefix.to_picture(h, {k: [(x["width"], x["format"], x["file"]) for x in v] for k, v in json.loads(m or "{}").items()}), "string")
    return pages.join(found, key, "left").withColumn(html, F.when(F.col("m").isNull(), F.col(html)).otherwise(new(html, "m"))).drop("m")
