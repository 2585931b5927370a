"""Queries over structure and assets: clusters, fits, references, image plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlake.functions import markup, urls
from weftlake.operators import assets, clusters
from weftlake.plans.markup_queries import mod, sql_mod
from weftlake.plans.registry import pages, query
from weftlake.plans.url_queries import _U
from weftlake.staging import stage

_TAGS = "list_transform(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda t: lower(t))"
_LANG = """regexp_extract(html, '<html lang="([^"]*)"', 1)"""


def _sequences(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.array_join(markup.tag_sequence("html"), "|").alias("seq"))


_CLUSTERS = f"""with s as (select page_id, url, {_LANG} as lang, array_to_string({_TAGS}, '|') as seq from pages),
g as (select lang as language_prefix, left(sha256(seq), 12) as fingerprint, min(page_id) as o, arg_min(url, page_id) as first_page, count(*) as page_count, any_value(seq) as skeleton from s group by lang, seq)
select 'cluster-' || (row_number() over (order by o) - 1) as cluster_id, language_prefix, fingerprint, first_page, page_count"""


@query(_CLUSTERS + " from g")
def tag_sequence_clusters(spark, sf_dir):
    """Which pages share a structure, per language?"""
    return clusters.cluster_pages(_sequences(spark, sf_dir), "page_id", "url", "lang", "seq").select("cluster_id", "language_prefix", "fingerprint", "first_page", "page_count")


@query(f"with c as ({_CLUSTERS} from g) select language_prefix, count(*) as clusters, sum(page_count)::bigint as pages, max(page_count) as largest, count(*) filter (where page_count = 1) as single from c group by language_prefix")
def cluster_sizes(spark, sf_dir):
    return tag_sequence_clusters(spark, sf_dir).groupBy("language_prefix").agg(F.count(F.lit(1)).alias("clusters"), F.sum("page_count").alias("pages"), F.max("page_count").alias("largest"), F.count_if(F.col("page_count") == 1).alias("single"))


@query(f"with c as ({_CLUSTERS} from g), p as (select url as page, {_LANG} as lang, left(sha256(array_to_string({_TAGS}, '|')), 12) as fp from pages) select cluster_id, page from p join c on lang = language_prefix and fp = fingerprint")
def cluster_ids(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    return clusters.cluster_members(rows, clusters.cluster_pages(rows, "page_id", "url", "lang", "seq"), "url", "lang", "seq")


# Pages of one kind hardly differ, so whole structures are turned, extended, sorted or renamed by page_id.
_VARIED = f"""(case page_id % 7 when 0 then [] when 1 then list_reverse({_TAGS}) when 2 then {_TAGS} || ['x','y'] when 3 then {_TAGS} || ['aside','form','x'] when 4 then list_sort({_TAGS}) when 5 then list_transform({_TAGS}, lambda t: t || page_id) else {_TAGS} end)"""
_GRAMS = "list_sort(list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || '>' || v[i + 1])))"


def _varied(spark, sf_dir):
    t = markup.tag_sequence("html")
    arr = lambda *x: F.array(*map(F.lit, x))
    k = F.col("page_id") % 7
    renamed = F.transform(t, lambda x: F.concat(x, F.col("page_id").cast("string")))
    v = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.reverse(t)).when(k == 2, F.concat(t, arr("x", "y"))).when(k == 3, F.concat(t, arr("aside", "form", "x"))).when(k == 4, F.array_sort(t)).when(k == 5, renamed).otherwise(t)
    return pages(spark, sf_dir).select("page_id", v.alias("v")).select("page_id", F.array_join("v", "|").alias("seq"), markup.bigrams("v").alias("grams"))


@query(f"""with r as (select page_id, {_VARIED} as v from pages), g as (select page_id, array_to_string(v, '|') as seq, {_GRAMS} as grams from r),
p as (select a.page_id as a, b.page_id as b, a.seq as sa, b.seq as sb, a.grams as x, b.grams as y from g a join g b on b.page_id = a.page_id + 1)
select a, b, case when len(x) = 0 and len(y) = 0 then case when sa = sb then 1.0 else 0.0 end when len(x) = 0 or len(y) = 0 then 0.0
 else len(list_intersect(x, y))::double / len(list_distinct(x || y)) end::double as similarity from p""")
def jaccard_pairs(spark, sf_dir):
    g = _varied(spark, sf_dir)
    one, two = g.select(F.col("page_id").alias("a"), F.col("seq").alias("sa"), F.col("grams").alias("x")), g.select(F.col("page_id").alias("b"), F.col("seq").alias("sb"), F.col("grams").alias("y"))
    return one.join(two, F.col("b") == F.col("a") + 1).select("a", "b", markup.jaccard("x", "y", F.col("sa") == F.col("sb")).alias("similarity"))


_FIT = f"""with r as (select page_id, {_VARIED} as v from pages), g as (select page_id, array_to_string(v, '|') as seq, {_GRAMS} as grams from r),
lib as (select seq, any_value(grams) as grams, min(page_id) as page_id from g group by seq having count(*) > 1),
s as (select p.page_id, c.page_id as cluster, case when len(p.grams) = 0 and len(c.grams) = 0 then case when p.seq = c.seq then 1.0 else 0.0 end when len(p.grams) = 0 or len(c.grams) = 0 then 0.0
 else len(list_intersect(p.grams, c.grams))::double / len(list_distinct(p.grams || c.grams)) end::double as score from g p, lib c),
b as (select page_id, cluster, score, row_number() over (partition by page_id order by score desc, cluster) as rn from s)"""


@query(_FIT + " select page_id, cluster, score, score >= 0.7 as fitted from b where rn = 1")
def best_cluster_fit(spark, sf_dir):
    """Every page against the structures that several pages share, named by their first page."""
    g = stage(_varied(spark, sf_dir), "varied")
    lib = g.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("cid"), F.first("grams").alias("grams")).where("n > 1").withColumn("ord", F.col("cid"))
    return clusters.best_fit(g, lib, "page_id", "cid", "ord", "grams", "seq")


@query(_FIT + " select page_id, score from b where rn = 1 and score < 0.7")
def divergent_pages(spark, sf_dir):
    return best_cluster_fit(spark, sf_dir).where(~F.col("fitted")).select("page_id", "score")


_CLASSES = ["vc_row post-12 post-title main", "wpb_x nd_options_a", "b a b page-id-7 page-id-x", "category-3 category postid-9"]


@query("select page_id, " + sql_mod(4, "main post-title", "", "a b page-id-x", "category") + " as classes from pages")
def class_denoise(spark, sf_dir):
    c = F.array_sort(F.array_distinct(markup.denoise_classes(F.split(mod(4, *_CLASSES), r"\s+"))))
    return pages(spark, sf_dir).select("page_id", F.array_join(c, " ").alias("classes"))


# ---- assets ----


@query("select page_id, ord - 1 as ord, ref from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as ref, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) as ord from pages)")
def asset_refs(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "ref")).select("page_id", F.col("ord").cast("bigint").alias("ord"), "ref")


_REFS = "(select page_id, k, 'asset_' || (page_id * (k + 1) % 37) as url, case (page_id + k) % 3 when 0 then 'css' when 1 then 'js' else 'img' end as type from pages, range(0, 4) t(k) where k <= page_id % 4)"


def _uses(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int"))).alias("k"))
    kind = F.element_at(F.array(*map(F.lit, ("css", "js", "img"))), ((F.col("page_id") + F.col("k")) % 3 + 1).cast("int"))
    return rows.select("page_id", "k", F.concat(F.lit("asset_"), (F.col("page_id") * (F.col("k") + 1) % 37).cast("string")).alias("url"), kind.alias("type"))


@query(f"select url, arg_min(type, page_id * 10 + k) as type, min(page_id * 10 + k) as first_use, count(*) as uses from {_REFS} group by url")
def asset_first_wins(spark, sf_dir):
    return assets.first_types(_uses(spark, sf_dir).withColumn("o", F.col("page_id") * 10 + F.col("k")), "url", "o", "type")




@query(f"with r as {_REFS}, m as (select 'asset_' || i as url, 'assets/f' || i as local_path from range(0, 37) t(i) where i % 3 <> 0) select page_id, k::bigint as k, url, local_path from r left join m using (url)")
def manifest_join(spark, sf_dir):
    return assets.lookup(_uses(spark, sf_dir), _manifest(spark)).select("page_id", F.col("k").cast("bigint").alias("k"), "url", "local_path")


def _manifest(spark):
    return spark.range(37).where("id % 3 <> 0").select(F.concat(F.lit("asset_"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("assets/f"), F.col("id").cast("string")).alias("local_path"))


@query(f"with r as {_REFS} select url, count(*) as uses from r where substr(url, 7)::int % 3 = 0 group by url")
def unmatched_refs(spark, sf_dir):
    return _uses(spark, sf_dir).join(_manifest(spark), "url", "left_anti").groupBy("url").agg(F.count(F.lit(1)).alias("uses"))


_IMG = "(select '/img/p' || page_id || case page_id % 4 when 0 then '.jpg' when 1 then '.png' when 2 then '.svg' else '.webp' end as path, case when page_id % 11 = 0 then null else 200 + (page_id * 137) % 2400 end as width, sha256(url) as digest from pages)"


def _images(spark, sf_dir):
    width = F.when(F.col("page_id") % 11 != 0, 200 + (F.col("page_id") * 137) % 2400)
    return pages(spark, sf_dir).select(F.concat(F.lit("/img/p"), F.col("page_id").cast("string"), mod(4, ".jpg", ".png", ".svg", ".webp")).alias("path"), width.alias("width"), F.sha2(F.col("url").cast("binary"), 256).alias("digest"))


_PLAN = f"""with i as {_IMG}, r as (select *, regexp_extract(path, '[.]([a-z]+)$', 1) as e from i where path not like '%.svg'),
w as (select *, list_filter([480, 768, 1024, 1440, 1920], lambda x: width is null or x <= width) as f from r),
v as (select path, e, digest, unnest(case when len(f) = 0 then [width] else f end) as width, list_distinct(['avif', 'webp', case when e = 'jpg' then 'jpeg' else e end]) as k from w),
x as (select path, width, digest, unnest(k) as format from v),
plan as (select path, format, width::int as width, regexp_replace(path, '[.][a-z]+$', '') || '-' || width || 'w-' || left(digest, 8) || '.' || format as file from x)"""


@query(_PLAN + " select path, format, width, file from plan")
def image_variant_plan(spark, sf_dir):
    return assets.variant_plan(_images(spark, sf_dir), "path", "width", "digest")


@query(_PLAN + " select path, format, string_agg('/' || file || ' ' || width || 'w', ', ' order by width) as srcset from plan group by path, format")
def picture_sources(spark, sf_dir):
    return assets.srcsets(image_variant_plan(spark, sf_dir))


@query(_PLAN + ", o as (select path, file, row_number() over (partition by path order by (format = 'jpeg')::int desc, width desc, format desc) as rn from plan) select path, file from o where rn = 1")
def picture_fallback(spark, sf_dir):
    return assets.fallbacks(image_variant_plan(spark, sf_dir))


@query("with i as (select page_id, case page_id % 3 when 0 then './a' when 1 then '//a' else 'a' end || page_id % 50 || '.png' as src from pages) select page_id, src, case when page_id % 50 < 30 then 'a' || page_id % 50 || '.png' end as match from i")
def image_manifest_match(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.concat(mod(3, "./a", "//a", "a"), (F.col("page_id") % 50).cast("string"), F.lit(".png")).alias("src"))
    manifest = spark.range(30).select(F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    hits = assets.match_images(rows.select("src").distinct(), manifest, "src", "path")
    return rows.join(hits, "src", "left").select("page_id", "src", "match")


@query(f"select lower(regexp_extract(url, {_U}, 2)) as host, count(*) as pages, sum(length(html))::bigint as chars from pages group by 1")
def pages_by_host(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(urls.host("url").alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars"))
