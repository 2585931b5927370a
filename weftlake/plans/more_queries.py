"""Smaller joins and totals: reverse lookups, unions, counts by cluster, hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftlake.functions import markup, urls
from weftlake.operators import clusters
from weftlake.plans.cluster_queries import _CLUSTERS, _FIT, _manifest, _sequences, _varied, best_cluster_fit
from weftlake.plans.markup_queries import mod
from weftlake.plans.registry import pages, query


@query("with m as (select 'asset_' || i as url, 'assets/f' || i as local_path from range(0, 37) t(i) where i % 3 <> 0), f as (select 'assets/f' || (page_id % 50) as local_path, count(*) as uses from pages group by 1) select local_path, url, uses from f left join m using (local_path)")
def file_origins(spark, sf_dir):
    """Local files back to the addresses they came from."""
    files = pages(spark, sf_dir).groupBy(F.concat(F.lit("assets/f"), (F.col("page_id") % 50).cast("string")).alias("local_path")).agg(F.count(F.lit(1)).alias("uses"))
    return files.join(_manifest(spark), "local_path", "left").select("local_path", "url", "uses")


@query(_FIT + " select page_id, score, left(sha256(g.seq), 12) as fingerprint from b join g using (page_id) where rn = 1 and score < 0.7")
def divergent_structure(spark, sf_dir):
    """Divergent pages with their own structure, as clusters to be."""
    own = _varied(spark, sf_dir).select("page_id", clusters.fingerprint("seq").alias("fingerprint"))
    return best_cluster_fit(spark, sf_dir).where(~F.col("fitted")).join(own, "page_id").select("page_id", "score", "fingerprint")


@query(f"select cluster_id, page_count from ({_CLUSTERS} from g) union all select 'divergent-' || page_id, 1 from ({_FIT} select page_id from b where rn = 1 and score < 0.7)")
def cluster_union(spark, sf_dir):
    """Clusters, and a cluster of its own for each page that fits none."""
    found = clusters.cluster_pages(_sequences(spark, sf_dir), "page_id", "url", "lang", "seq").select("cluster_id", "page_count")
    extra = best_cluster_fit(spark, sf_dir).where(~F.col("fitted")).select(F.concat(F.lit("divergent-"), F.col("page_id").cast("string")).alias("cluster_id"), F.lit(1).cast("bigint").alias("page_count"))
    return found.unionByName(extra)


@query("select page_id % 4 as cluster, count(*) as pages, count(*) filter (where page_id % 3 = 0) as incomplete, (count(*) * 4)::bigint as slots from pages group by 1")
def fill_counts(spark, sf_dir):
    """Filled pages, incomplete ones and slots by cluster."""
    values = F.when(F.col("page_id") % 3 == 0, F.create_map(F.lit("a"), F.lit("1"))).otherwise(F.create_map(*[F.lit(x) for k in "abcd" for x in (k, "1")]))
    template = F.lit("{{a}}{{b}}{{ c }}{{d}}{{a}}")
    rows = pages(spark, sf_dir).select((F.col("page_id") % 4).alias("cluster"), F.size(markup.template_slots(template)).alias("slots"), F.size(markup.missing_slots(template, values)).alias("missing"))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("missing") > 0).alias("incomplete"), F.sum("slots").alias("slots"))


@query("select page_id, case page_id % 3 when 0 then 'a.woff2' when 1 then 'b.png,c.js' else '' end as hrefs from pages")
def existing_preloads(spark, sf_dir):
    links = mod(3, '<link rel="preload" href="a.woff2"><link href="a.woff2" rel="preload">', "<link as=image rel='preload' href='b.png'><link rel=\"preload\" href=\"c.js\">", '<link rel="stylesheet" href="x.css">')
    return pages(spark, sf_dir).select("page_id", F.array_join(markup.existing_preloads(F.concat(links, "html")), ",").alias("hrefs"))


@query("select page_id, case page_id % 3 when 0 then '<link rel=\"preload\" as=\"font\" type=\"font/woff2\" href=\"f.woff2\" crossorigin>' else '' end as added from pages")
def inject_font_preloads(spark, sf_dir):
    style = mod(3, "<style>@font-face{src:url(f.woff2)}</style>", "<style>@font-face{src:url(f.ttf)}</style>", '<link rel="preload" href="f.woff2"><style>@font-face{src:url(f.woff2)}</style>')
    page = F.concat(F.lit("<head>"), style, F.lit("</head>"))
    new = markup.inject_font_preloads(page)
    return pages(spark, sf_dir).select("page_id", F.replace(F.replace(new, F.concat(F.lit("<head>"), style), F.lit("")), F.lit("</head>"), F.lit("")).alias("added"))


@query("select page_id, case page_id % 4 when 0 then 'text/html; charset=utf-8' when 1 then 'image/svg+xml' when 2 then 'font/woff2' else 'application/octet-stream' end as mime from pages")
def media_types(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.mime_type(mod(4, "a/b.HTML", "x.svg", "f.woff2", "no.ext/README")).alias("mime"))
