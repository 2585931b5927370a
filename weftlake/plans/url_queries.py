"""Queries over URLs: parts, paths, languages, selection, increments, robots."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlake.functions import urls
from weftlake.operators import crawl
from weftlake.plans.registry import pages, query

_U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$'"
_PATH = f"(case when regexp_extract(url, {_U}, 3) = '' then '/' else regexp_extract(url, {_U}, 3) end)"
_HOST = f"lower(regexp_extract(url, {_U}, 2))"
_LOCAL = f"""('pages/' || regexp_replace(case when {_PATH} like '%/' then {_PATH} || 'index.html'
  when not regexp_matches({_PATH}, '[.][A-Za-z0-9]+$') then {_PATH} || '/index.html' else {_PATH} end, '^/+', ''))"""


@query(f"""select page_id, lower(regexp_extract(url, {_U}, 1)) as scheme, {_HOST} as host, {_PATH} as path,
  regexp_extract(url, {_U}, 4) as query, regexp_extract(url, {_U}, 5) as fragment from pages""")
def url_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.scheme("url").alias("scheme"), urls.host("url").alias("host"), urls.path("url").alias("path"), urls.query("url").alias("query"), urls.fragment("url").alias("fragment"))


@query(f"select page_id, {_LOCAL} as local_path from pages")
def local_path(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.local_path("url").alias("local_path"))


@query(f"""with p as (select page_id, html, case when page_id % 4 = 0 then 'x' || {_LOCAL} else {_LOCAL} end as pp from pages),
q as (select page_id, regexp_extract(regexp_replace(regexp_replace(pp, '^.*/pages/', ''), '^/+', ''), '^[^/]*') as seg,
  lower(regexp_extract(html, '<html[^>]* lang="([^"_-]*)[^"]*"', 1)) as lang from p)
select page_id, case when regexp_matches(seg, '^[a-z]{{2,3}}$') then seg when regexp_matches(lang, '^[a-z]{{2,3}}$') then lang else '' end as language_prefix from q""")
def lang_prefix(spark, sf_dir):
    local = urls.local_path("url")
    page_path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("x"), local)).otherwise(local)
    return pages(spark, sf_dir).select("page_id", urls.language_prefix("html", page_path).alias("language_prefix"))


@query(f"""with p as (select page_id, regexp_replace({_LOCAL}, '^pages/', '') as pp from pages)
select page_id, case when len(string_split(pp, '/')) > 1 then repeat('../', len(string_split(pp, '/')) - 1) else './' end || 'assets/x.css' as reference from p""")
def relative_prefix(spark, sf_dir):
    page = F.regexp_replace(urls.local_path("url"), "^pages/", "")
    return pages(spark, sf_dir).select("page_id", F.concat(urls.relative_prefix(page), F.lit("assets/x.css")).alias("reference"))


_REFS = """case page_id % 10 when 0 then '/css/Main.CSS?v=1' when 1 then '/js/app.mjs' when 2 then '/f/a.woff2#x' when 3 then '/i/p.JPeG'
 when 4 then '/doc/readme' when 5 then '/a.b/c' when 6 then '/img/x.svg' when 7 then '/.htaccess' when 8 then '/v.mp4' else '/' end"""


def _refs():
    out = F.lit("/")
    for k, v in enumerate(["/css/Main.CSS?v=1", "/js/app.mjs", "/f/a.woff2#x", "/i/p.JPeG", "/doc/readme", "/a.b/c", "/img/x.svg", "/.htaccess", "/v.mp4"]):
        out = F.when(F.col("page_id") % 10 == k, F.lit(v)).otherwise(out)
    return out


@query(f"""with r as (select page_id, {_REFS} as ref from pages), e as (select page_id, ref, lower(regexp_extract(regexp_extract(ref, '^[^?#]*'), '[^/]+[.]([^./]+)$', 1)) as x from r)
select page_id, ref, case when x = 'css' then 'css' when x in ('js','mjs') then 'js' when x in ('woff','woff2','ttf','otf','eot') then 'fonts'
 when x in ('png','jpg','jpeg','gif','webp','avif','svg','ico','bmp') then 'img' end as type from e""")
def asset_type(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", _refs().alias("ref"), F.concat(urls.origin("url"), _refs()).alias("u"))
    return rows.select("page_id", "ref", urls.asset_type("u").alias("type"))


@query(f"""with r as (select page_id, html, regexp_extract({_REFS}, '^[^?#]*') as p, case page_id % 4 when 0 then 'css' when 1 then 'js' when 2 then 'fonts' else 'img' end as type from pages),
l as (select *, case when p = '/' then 'asset' else regexp_extract(p, '([^/]*)$', 1) end as last from r), e as (select *, regexp_extract(last, '^.+([.][^.]*)$', 1) as ext from l)
select page_id, case when ext = '' then last else left(last, length(last) - length(ext)) end || '-' || left(sha256(html), 8) ||
 case when ext <> '' then ext when type = 'css' then '.css' when type = 'js' then '.js' when type = 'fonts' then '.woff2' else '.bin' end as name from e""")
def hashed_name(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("css", "js", "fonts", "img"))), (F.col("page_id") % 4 + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", urls.hashed_name(F.concat(urls.origin("url"), _refs()), kind, "html").alias("name"))


@query("""with m as (select page_id, case page_id % 3 when 0 then 'local/model' when 1 then 'a/b/c' else 'x/' end as model from pages)
select page_id, model, regexp_extract(model, '^[^/]*') as provider, regexp_replace(model, '^[^/]*/', '') as name from m""")
def model_provider(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, ("local/model", "a/b/c", "x/"))), (F.col("page_id") % 3 + 1).cast("int"))
    rows = pages(spark, sf_dir).select("page_id", model.alias("model"))
    return rows.select("page_id", "model", urls.provider("model").alias("provider"), urls.strip_provider("model").alias("name"))


@query("""with t as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as t from pages)
select page_id, replace(replace(t, '&', '&amp;'), '"', '&quot;') as attr, replace(replace(replace(replace(replace(t || '<''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as xml from t""")
def escapes(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    return rows.select("page_id", urls.escape_attribute("t").alias("attr"), urls.escape_xml(F.concat("t", F.lit("<'>"))).alias("xml"))


@query("""select page_id, case when f in ('', 'jpg') then 'jpeg' else f end as format from
 (select page_id, lower(case page_id % 4 when 0 then 'jpg' when 1 then 'PNG' when 2 then '' else 'webp' end) as f from pages)""")
def image_format(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("jpg"), F.lit("PNG"), F.lit(None).cast("string"), F.lit("webp")), (F.col("page_id") % 4 + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", urls.normal_format(raw, F.lit("")).alias("format"))


@query(f"""select page_id, url from pages where regexp_matches({_PATH}, '^/en(/.*)?$') or regexp_matches({_PATH}, '^/[^/]*/1[^/]*$') order by page_id limit 40""")
def only_glob_limit(spark, sf_dir):
    return crawl.select_urls(pages(spark, sf_dir), "url", "page_id", ["/en/**", "/*/1*"], 40).select("page_id", "url")


@query(f"""with p as (select page_id, {_LOCAL} as local_path from pages), b as (select distinct local_path from p where page_id % 3 = 0)
select page_id, local_path from p where local_path not in (select local_path from b)""")
def incremental_skip(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.local_path("url").alias("local_path"))
    return crawl.skip_built(rows, rows.where("page_id % 3 = 0"), "local_path").select("page_id", "local_path")


@query(f"""with p as (select page_id, {_LOCAL} as local_path from pages), b as (select distinct local_path from p where page_id % 3 = 0)
select page_id, local_path from p where page_id % 9 = 0 or local_path not in (select local_path from b)""")
def incremental_force(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.local_path("url").alias("local_path"))
    return crawl.skip_built(rows, rows.where("page_id % 3 = 0"), "local_path", F.col("page_id") % 9 == 0).select("page_id", "local_path")


@query(f"""with p as (select page_id, url, {_PATH} as path from pages)
select page_id, url from p where not (path like '/de%') or path like '/de/1%'""")
def robots_filter(spark, sf_dir):
    rows = pages(spark, sf_dir)
    files = rows.select(urls.host("url").alias("host")).distinct().withColumn("txt", F.lit("# rules\nUser-agent: *\nDisallow: /de\nAllow: /de/1\nDisallow:\n\nUser-agent: other\nDisallow: /"))
    return crawl.allowed(rows, crawl.parse_robots(files, "host", "txt"), "url").select("page_id", "url")


@query(f"""with p as (select page_id, url, {_HOST} as host, {_PATH} || regexp_extract(url, {_U}, 4) as t from pages)
select page_id, url from p where case when length(host) % 2 = 0 then true
 when regexp_matches(t, '^/[^/]*/.*5.*[.]html$') then true when regexp_matches(t, '^/.*[.]html$') then false when t like '/fr/2%' then true when t like '/fr/%' then false else true end""")
def robots_longest_match(spark, sf_dir):
    rows = pages(spark, sf_dir)
    txt = "User-agent: bot\nUser-agent: own\nDisallow: /fr/\nAllow: /fr/2\nDisallow: /*.html$\nAllow: /*/*5*.html$\n\nUser-agent: *\nDisallow: /"
    files = rows.select(urls.host("url").alias("host")).distinct().where("length(host) % 2 = 1").withColumn("txt", F.lit(txt))
    return crawl.allowed(rows, crawl.parse_robots(files, "host", "txt", "own/1.0"), "url").select("page_id", "url")


@query(f"select distinct {_LOCAL} as local_path, regexp_replace(regexp_replace({_LOCAL}, '^pages/', '/'), 'index[.]html$', '') as page_path from pages where {_LOCAL} like '%index.html'")
def output_listing(spark, sf_dir):
    rows = pages(spark, sf_dir).select(urls.local_path("url").alias("local_path")).where(F.col("local_path").endswith("index.html")).distinct()
    return rows.select("local_path", urls.page_url_path("local_path").alias("page_path"))


@query(f"""with a as (select distinct {_LOCAL} as p from pages where page_id % 2 = 0), b as (select distinct {_LOCAL} as p from pages where page_id % 3 = 0)
select p as page, p in (select p from a) as existing from (select p from a union select p from b)""")
def page_path_union(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.local_path("url").alias("page"))
    both = rows.where("page_id % 2 = 0").select("page", F.lit(True).alias("e")).unionByName(rows.where("page_id % 3 = 0").select("page", F.lit(False).alias("e")))
    return both.groupBy("page").agg(F.bool_or("e").alias("existing"))


@query()
def absolute_urls(spark, sf_dir):
    """All kinds of references against the page's own address."""
    refs = F.explode(F.array(*map(F.lit, ("a/../b.css", "?q=1", "//cdn.example.org/x.js", "/r", "#top", "mailto:a@b", "tel:1", "HTTP://Ex.COM:80/%7Ea b"))))
    return pages(spark, sf_dir).select("page_id", "url", refs.alias("ref")).select("page_id", "ref", urls.absolute_url("ref", "url").alias("absolute"))


@query("""select page_id, 3 as samples from pages where false""")
def no_sample_of_nothing(spark, sf_dir):
    rows = pages(spark, sf_dir).where("false")
    return crawl.sample_pages(rows, "page_id", 3).select("page_id", F.lit(3).alias("samples"))


@query()
def sample_paths(spark, sf_dir):
    rows = pages(spark, sf_dir).select(urls.local_path("url").alias("page"))
    return crawl.sample_pages(rows, "page", 20, seed=7)
