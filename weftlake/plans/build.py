"""The whole run over a corpus: select, rewrite, cluster, fill, optimise, report.

``build`` is cut where a later step has to see stable rows: rewritten pages, their
structures and clusters, templates with their slots' places, and filled pages are tables
of their own, so no output repeats another's work or calls. Fetching, generating,
encoding and subsetting are injected.

Pages are fitted to the structures that earlier builds have put into a library; those that
fit none get clusters and templates of their own, which a new version of the library keeps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.functions import markup, urls
from weftlake.operators import assets, clusters, crawl, effects, library, reports, templates
from weftlake.operators import pages as on_pages
from weftlake.staging import stage


MEMBERS = 10_000  # pages in a row of the manifest


@dataclass
class Options:
    only: list[str] = field(default_factory=list)
    limit: int | None = None
    force: list[str] = field(default_factory=list)
    force_all: bool = False
    reprocess: bool = False  # run the later steps over pages built before as well
    same_language: bool = True  # fit pages to clusters of their own language only
    threshold: float = clusters.THRESHOLD  # least similarity of a page to a cluster it fits
    answers: str | None = None  # folder of the generator's answers; else they serve one build
    library: str | None = None  # folder of the structures of earlier builds
    script_blocklist: list[str] = field(default_factory=lambda: list(markup.SCRIPT_BLOCKLIST))
    script_strategy: str = "defer"
    base_url: str = "https://example.com"


def todo(pages: DataFrame, built: DataFrame | None, options: Options) -> DataFrame:
    """The pages to build: selected, limited, not built yet or forced."""
    rows = crawl.select_urls(pages.withColumn("local_path", urls.local_path("url")), "url", "page_id", options.only, options.limit)
    if built is None or options.force_all:
        return rows
    wanted = F.exists(F.array(*[F.lit("/" + x.strip("/")) for x in options.force]), lambda x: F.regexp_replace(urls.path("url"), r"(?<=.)/+\z", "") == x) if options.force else F.lit(False)
    return crawl.skip_built(rows, built, "local_path", wanted)


def structure(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", urls.language_prefix("html", "local_path").alias("lang"), on_pages.skeleton("html").alias("skeleton"))


def reuse_templates(keyed: DataFrame, library: DataFrame, threshold: float = clusters.THRESHOLD, same_language: bool = True) -> DataFrame:
    """``page_id, cluster, score, fitted``: new pages against the library of clusters
    (cluster_id, language_prefix, skeleton, ord) built before."""
    grams = lambda c: markup.bigrams(F.transform(F.split(c, r"\|"), lambda t: F.regexp_replace(t, "^[0-9]+:", "")))
    tag = (lambda c, lang: F.transform(grams(c), lambda g: F.concat(lang, F.lit(" "), g))) if same_language else (lambda c, lang: grams(c))
    new = keyed.select("page_id", "skeleton", tag(F.col("skeleton"), F.col("lang")).alias("g"))
    old = library.select("cluster_id", "ord", "skeleton", tag(F.col("skeleton"), F.col("language_prefix")).alias("g"))
    return clusters.best_fit(new, old, "page_id", "cluster_id", "ord", "g", "skeleton", threshold)


@dataclass
class Placed:
    """Which cluster each page belongs to, and the templates of those clusters."""

    clusters: DataFrame  # as of cluster_pages, page_count being that of this build
    members: DataFrame  # cluster_id, page
    divergent: DataFrame  # cluster_id, page, score of pages that fit no earlier structure
    templates: DataFrame  # cluster_id, fingerprint, template, slots, error, selectors
    version: int | None  # of the library, if this build has added to it


def place(local: DataFrame, generate: Callable[[str], str], options: Options) -> Placed:
    """Cluster pages, by the library's structures first, and see to their templates.

    In a first build every structure is a cluster. Later, a page whose best structure of
    the library is similar enough belongs to that cluster; the others are clustered by
    their own structures, numbered on from the diverging ones before. The generator is
    asked about new clusters and about earlier ones that have no template yet."""
    spark = local.sparkSession
    keyed = stage(structure(local), "build-structure")
    known = stage(library.read(spark, options.library), "build-library")
    if known.isEmpty():
        new = stage(clusters.cluster_pages(keyed, "page_id", "url", "lang", "skeleton"), "build-clusters")
        members = clusters.cluster_members(keyed, new, "url", "lang", "skeleton")
        divergent = spark.createDataFrame([], "cluster_id string, page string, score double")
    else:
        fit = stage(reuse_templates(keyed, known, options.threshold, options.same_language), "build-fit")
        odd = keyed.join(fit.where(~F.col("fitted")).select("page_id", "score"), "page_id")
        new = stage(clusters.cluster_pages(odd, "page_id", "url", "lang", "skeleton", library.DIVERGENT, library.next_number(known)), "build-clusters")
        own = clusters.cluster_members(odd, new, "url", "lang", "skeleton")
        fitted = keyed.join(fit.where("fitted"), "page_id").select(F.col("cluster").alias("cluster_id"), F.col("url").alias("page"))
        members = fitted.unionByName(own)
        divergent = own.join(odd.select(F.col("url").alias("page"), "score"), "page")
    members = stage(members, "build-members")
    # an earlier cluster is shown to the generator by the first of the pages that fit it now
    used = members.join(keyed.select(F.col("url").alias("page"), "page_id"), "page").groupBy("cluster_id").agg(F.min_by("page", "page_id").alias("first_page"), F.count(F.lit(1)).alias("page_count"))
    old = known.drop("first_page", "page_count").join(used, "cluster_id")
    names = ["cluster_id", "language_prefix", "fingerprint", "skeleton", "first_page", "page_count"]
    found = stage(new.select(*names).unionByName(old.select(*names)), "build-found")
    asked = new.select(*names).unionByName(old.where("template is null").select(*names))
    made = templates.synthesize(asked, local, generate, options.answers)
    selected = templates.slot_selectors(made, asked, local).select("cluster_id", "selectors")
    fresh = stage(made.join(selected, "cluster_id", "left"), "build-templates")
    kept = old.where("template is not null").select("cluster_id", "fingerprint", "template", "slots", F.lit(None).cast("string").alias("error"), "selectors")
    version = None
    if options.library:
        entries = asked.join(fresh.select("cluster_id", "template", "slots", "selectors"), "cluster_id")
        # what had no template and still has none is in the library already
        version = library.add(entries.join(known.select("cluster_id", F.lit(True).alias("known")), "cluster_id", "left").where("known is null or template is not null"), options.library)
    return Placed(found, members, divergent, fresh.unionByName(kept.select(*fresh.columns)), version)


def build(pages: DataFrame, manifest: DataFrame, generate: Callable[[str], str], built: DataFrame | None = None, sheets: DataFrame | None = None, variants: DataFrame | None = None, options: Options | None = None) -> dict[str, DataFrame]:
    """``pages``, ``clusters``, ``divergent``, ``templates``, ``manifest``, ``assets``,
    ``sitemap`` and ``savings``."""
    options = options or Options()
    rows = todo(pages, None if options.reprocess else built, options)
    refs = stage(on_pages.discover(rows), "build-refs")
    used = assets.first_types(refs.withColumn("o", F.col("page_id") * F.lit(1 << 20) + F.col("ord")), "url", "o", "type")
    rewritten = on_pages.rewrite_pages(rows, refs, manifest)
    local = stage(rewritten.withColumn("html", markup.rewrite_canonical(on_pages.rewrite_alternates("html", "url", F.lit(options.base_url)), "url")), "build-local")
    placed = place(local, generate, options)
    found, made, members = placed.clusters, placed.templates.drop("selectors"), placed.members
    filled = stage(templates.fill(local, members, placed.templates), "build-filled")
    if variants is not None:
        filled = on_pages.to_pictures(filled, variants)
    cleaned = filled.withColumn("before", F.col("html")).withColumn("html", on_pages.clean_all("html"))
    if sheets is not None:
        cleaned = on_pages.page_sheets(cleaned, sheets).withColumn("html", on_pages.inline_critical("html", "sheets")).drop("sheets")
    done = cleaned.withColumn("html", on_pages.add_preloads("html"))
    done = done.withColumn("html", on_pages.swap_inline_fonts(on_pages.defer_scripts("html", options.script_blocklist, options.script_strategy)))
    done = stage(done.withColumn("local_path", urls.local_path("url")), "build-pages")
    files = done.select(F.col("local_path").alias("path"), F.current_timestamp().alias("mtime"))
    return {"pages": done.drop("before"), "clusters": found, "divergent": placed.divergent, "templates": made, "manifest": manifest_json(found, made, members), "assets": used, "sitemap": reports.sitemap_xml(files, "path", "mtime", options.base_url), "savings": reports.savings(done, "before", "html")}


def preview(pages: DataFrame, generate: Callable[[str], str], chars: int = 4000) -> str:
    """A dry run over the first page: what the generator answers to its first characters."""
    row = pages.orderBy("page_id").select(F.substring("html", 1, chars).alias("h")).first()
    return generate(row["h"]) if row else ""


def diff(originals: DataFrame, local: DataFrame, samples: int = 20, threshold: float = 0.02, seed: int = 0, compare: Callable = effects.pixel_ratio) -> tuple[DataFrame, DataFrame]:
    """Entries and verdict over a sample of pages."""
    some = crawl.sample_pages(originals, "path", samples, seed)
    entries = effects.visual_diff(originals.join(some, "path", "left_semi"), local.join(some, "path", "left_semi"), threshold, compare)
    return entries, reports.verdict(entries, "ratio", threshold)


def manifest_json(found: DataFrame, made: DataFrame, members: DataFrame, per_row: int = MEMBERS) -> DataFrame:
    """``cluster_id, part, json``: the manifest as JSON documents. Part 0 of a cluster holds
    what is known of it and its template; its pages follow in parts of about ``per_row``,
    dealt by a hash and sorted inside, so that no cluster has to fit one row."""
    rows = found.join(made.select("cluster_id", "template", "slots", "error"), "cluster_id", "left")
    heads = rows.select("cluster_id", F.lit(0).cast("bigint").alias("part"), F.to_json(F.struct("cluster_id", "fingerprint", "language_prefix", "first_page", "page_count", "template", "slots", "error", F.current_timestamp().alias("generated_at"))).alias("json"))
    dealt = members.join(found.select("cluster_id", "page_count"), "cluster_id")
    parts = F.ceil(F.col("page_count") / F.lit(per_row)).cast("bigint")
    pages = dealt.groupBy("cluster_id", (F.pmod(F.xxhash64("page"), parts) + 1).alias("part")).agg(F.array_sort(F.collect_list("page")).alias("pages"))
    return heads.unionByName(pages.select("cluster_id", "part", F.to_json(F.struct("cluster_id", "part", "pages")).alias("json")))
