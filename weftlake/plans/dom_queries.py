"""Queries over the document tree. SQL has no tree, so most are checked by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlake.functions import urls
from weftlake.operators import clusters, effects, pages as on_pages, templates
from weftlake.plans.markup_queries import mod
from weftlake.plans.registry import pages, query
from weftlake.staging import stage

_ASSETS = ['<link rel="stylesheet" href="/a.css">', '<script src="../js/x.js"></script>', '<img src="i.png" srcset="i.png 1x, /big.png 2x">', '<style>@font-face{src:url(f.woff2)}</style>']


def _with_assets(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", F.concat(F.lit('<link rel="stylesheet" href="/all.css">'), mod(4, *_ASSETS), "html").alias("html"))


@query()
def dom_skeleton(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", on_pages.skeleton("html").alias("skeleton"))
    return rows.select("page_id", "skeleton", clusters.fingerprint("skeleton").alias("fingerprint"))


@query()
def dom_clusters(spark, sf_dir):
    lang = urls.language_prefix("html", urls.local_path("url"))
    rows = pages(spark, sf_dir).select("page_id", "url", lang.alias("lang"), on_pages.skeleton("html").alias("skeleton"))
    return clusters.cluster_pages(rows, "page_id", "url", "lang", "skeleton").drop("skeleton")


@query("""select page_id, 'https://e.test/all.css' as url, 'css' as type from pages union all
select page_id, case page_id % 4 when 0 then 'https://e.test/a.css' when 1 then 'https://e.test/js/x.js' when 2 then 'https://e.test/d/e/i.png' else 'https://e.test/d/e/f.woff2' end,
 case page_id % 4 when 0 then 'css' when 1 then 'js' when 2 then 'img' else 'fonts' end from pages where page_id % 4 <> 1 union all
select page_id, 'https://e.test/d/js/x.js', 'js' from pages where page_id % 4 = 1 union all select page_id, 'https://e.test/big.png', 'img' from pages where page_id % 4 = 2""")
def asset_discovery(spark, sf_dir):
    return on_pages.discover(_with_assets(spark, sf_dir).withColumn("url", F.lit("https://e.test/d/e/p"))).select("page_id", "url", "type")


@query()
def rewrite_references(spark, sf_dir):
    rows = _with_assets(spark, sf_dir)
    refs = on_pages.discover(rows)
    manifest = refs.where("type <> 'img'").select("url", F.concat(F.lit("assets/"), F.substring(F.sha2("url", 256), 1, 8)).alias("local_path")).distinct()
    return on_pages.rewrite_pages(rows, refs, manifest).select("page_id", "html", "unmatched")


@query()
def rewrite_stylesheets(spark, sf_dir):
    rows = pages(spark, sf_dir).select("url", F.concat(F.lit('@font-face{src:url("/f.woff2")}b{background:url(i.png)}/*'), F.col("page_id").cast("string"), F.lit("*/")).alias("css"))
    manifest = rows.select(F.concat(urls.origin("url"), F.lit("/f.woff2")).alias("url"), F.lit("assets/f.woff2").alias("local_path")).distinct()
    return on_pages.rewrite_sheets(rows, manifest)


@query()
def clean_html(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", on_pages.clean_all(F.concat(F.lit('<meta name="generator" content="x">'), "html")).alias("html"))


@query()
def hreflang_pages(spark, sf_dir):
    page = F.concat(F.lit('<link rel="alternate" hreflang="x" href="'), "url", F.lit('">'), "html")
    return pages(spark, sf_dir).select("page_id", on_pages.rewrite_alternates(page, "url", F.lit("https://local.test")).alias("html"))


_LCP = ["<main><img src=a.png></main>", '<article><picture><source srcset="b.png 1x, c.png 2x"><img src=d.png></picture></article>', '<p><img srcset="e.png 100w, f.png 900w"></p>', "<p>none</p>"]


@query("select page_id, case page_id % 4 when 0 then 'a.png' when 1 then 'c.png' when 2 then 'f.png' end as href from pages")
def lcp_href(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", on_pages.lcp_href(mod(4, *_LCP)).alias("href"))


@query()
def preload_hints(spark, sf_dir):
    page = F.concat(F.lit("<head><style>@font-face{src:url(x.woff2)}</style></head>"), mod(4, *_LCP), F.col("page_id").cast("string"))
    return pages(spark, sf_dir).select("page_id", on_pages.add_preloads(page).alias("html"))


_CSS = "article p{a:b}\n.none{c:d}\nnav > ul li:hover{e:f}\n@media print{p{g:h}}\nfooter ~ div, h1{i:j}"


@query("""select page_id, 'article p{a:b}' || chr(10) || 'nav > ul li:hover{e:f}' || chr(10) || '@media print{p{g:h}}' || chr(10) || 'footer ~ div, h1{i:j}' as css from pages""")
def css_purge(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", on_pages.purge_css(F.lit(_CSS), "html").alias("css"))


@query()
def css_purge_shared(spark, sf_dir):
    rows = pages(spark, sf_dir)
    sheets = spark.createDataFrame([("a.css", _CSS), ("b.css", ".x{a:b}")], "sheet string, css string")
    links = rows.select("page_id", F.when(F.col("page_id") % 2 == 0, F.lit("a.css")).otherwise(F.lit("b.css")).alias("sheet"))
    return on_pages.purge_shared(rows, links, sheets)


@query()
def critical_css(spark, sf_dir):
    rows = _with_assets(spark, sf_dir)
    sheets = rows.select(F.concat(urls.origin("url"), F.lit("/all.css")).alias("url")).distinct().withColumn("css", F.lit(_CSS))
    found = on_pages.page_sheets(rows, sheets)
    return found.select("page_id", on_pages.inline_critical("html", "sheets").alias("html"))


@query()
def css_flatten(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", on_pages.flatten_css(F.concat(F.lit(".a{x:y; & b{c:d}}/*"), F.col("page_id").cast("string"), F.lit("*/"))).alias("css"))


@query()
def defer_scripts(spark, sf_dir):
    page = F.concat(mod(3, '<script src="https://x.test/gtag/js?i"></script>', "<script>// c\nvar  a = 1;\n</script>", '<script type="application/ld+json">{ "a" : 1 }</script>'), "html")
    return pages(spark, sf_dir).select("page_id", on_pages.defer_scripts(page).alias("html"))


@query()
def inline_font_swap(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", on_pages.swap_inline_fonts(F.concat(F.lit("<style>@font-face{src:url(a)}</style>"), "html")).alias("html"))


@query()
def picture_rewrite(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.concat(F.lit('<p><img alt="q" src="/i'), (F.col("page_id") % 5).cast("string"), F.lit('.jpg"></p>')).alias("html"))
    v = spark.createDataFrame([(f"i{i}.jpg", w, f, f"i{i}-{w}.{f}") for i in range(4) for w in (480, 768) for f in ("avif", "webp", "jpeg")], "path string, width int, format string, file string")
    return on_pages.to_pictures(rows, v)


@query("select page_id, len(list_filter(regexp_extract_all(html, '<p>([^<&]+)</p>', 1), lambda t: trim(t) <> ''))::int as plain_paragraphs, true as all_seen from pages")
def refine_segments_seen(spark, sf_dir):
    """Paragraphs of text alone (no character references), and whether each of them is among the page's segments."""
    plain = F.filter(F.regexp_extract_all("html", F.lit("<p>([^<&]+)</p>"), F.lit(1)), lambda t: F.trim(t) != "")
    told = F.transform(on_pages.segments("html"), lambda t: F.trim(t))
    rows = pages(spark, sf_dir).select("page_id", plain.alias("plain"), told.alias("told"))
    return rows.select("page_id", F.size("plain").alias("plain_paragraphs"), F.forall("plain", lambda t: F.array_contains("told", F.trim(t))).alias("all_seen"))


@query()
def refine_segments(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.posexplode(on_pages.segments("html")).alias("pos", "segment"))


@query()
def refine_pages(spark, sf_dir):
    rows = pages(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit("/index.html")).alias("page"), "html")
    return templates.refine(rows, rows.where("length(html) % 3 = 0").select("page"), lambda segments: [s.upper() for s in segments], force=["/7/"])


@query("with s as (select case when length(html) % 3 = 0 and page_id <> 7 then 'skipped' else 'refined' end as status from pages) select status, count(*) as pages from s group by status")
def refine_counts(spark, sf_dir):
    return refine_pages(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


@query()
def template_pages(spark, sf_dir):
    """Clusters, one synthesised template each, and every page filled into its own."""
    rows = pages(spark, sf_dir)
    keyed = stage(rows.select("page_id", "url", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), on_pages.skeleton("html").alias("skeleton")), "structure")
    found = stage(clusters.cluster_pages(keyed, "page_id", "url", "lang", "skeleton"), "clusters")
    made = templates.synthesize(found, rows, lambda prompt: "```html\n<html><head></head><body><article><h1>{{title}}</h1></article><footer>{{foot}}</footer></body></html>\n```")
    placed = templates.slot_selectors(made, found, rows)
    return templates.fill(rows, clusters.cluster_members(keyed, found, "url", "lang", "skeleton"), placed)


@query("select count(*) as processed, 0::bigint as failed, sum(strlen(html))::bigint as bytes_before, sum(strlen(html))::bigint as bytes_after from pages")
def file_totals(spark, sf_dir):
    files = pages(spark, sf_dir).select("url", F.col("html").cast("binary").alias("bytes"))
    return effects.totals(effects.transform_files(files, lambda raw: raw[::-1], "url"))


@query("select url as path, case when page_id % 3 = 0 then 0.0 when page_id % 3 = 1 then 1.0 else 0.5 end::double as ratio, page_id % 3 = 0 as passed from pages")
def visual_diff(spark, sf_dir):
    rows = pages(spark, sf_dir)
    black, half = bytes([0, 0, 0, 255] * 4), bytes([0, 0, 0, 255] * 2 + [255] * 8)
    one = rows.select("page_id", F.col("url").alias("path"), F.lit(2).alias("width"), F.lit(2).alias("height"), F.lit(black).alias("rgba"))
    k = F.col("page_id") % 3
    two = rows.where("page_id % 3 <> 1").select("page_id", F.col("url").alias("path"), F.lit(2).alias("width"), F.lit(2).alias("height"), F.when(k == 0, F.lit(black)).otherwise(F.lit(half)).alias("rgba"))
    return effects.visual_diff(one, two, key=["page_id", "path"])
