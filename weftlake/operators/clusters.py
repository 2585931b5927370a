"""Clustering of pages by structure, and fitting of pages to known clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.staging import number, stage

THRESHOLD = 0.7
_SLACK = 1e-9  # against rounding in size bounds; what is kept too much is verified


def fingerprint(skeleton: Column | str) -> Column:
    """First 12 hex digits of the skeleton's SHA-256."""
    return F.substring(F.sha2((F.col(skeleton) if isinstance(skeleton, str) else skeleton).cast("binary"), 256), 1, 12)


def cluster_pages(pages: DataFrame, order: str, path: str, language: str, skeleton: str, prefix: str = "cluster-", start: int = 0) -> DataFrame:
    """One row a (language, structure): ``cluster_id, language_prefix, fingerprint,
    skeleton, first_page, page_count``. Ids count clusters in the order of their first
    page, from ``start`` on; a fingerprint, unlike an id, stays the same when pages are
    added. Clusters can be nearly as many as pages, so they are numbered by ranges."""
    rows = pages.select(F.col(order).alias("ord"), F.col(path).alias("page"), F.col(language).alias("language_prefix"), fingerprint(skeleton).alias("fingerprint"), F.col(skeleton).alias("skeleton"))
    groups = rows.groupBy("language_prefix", "fingerprint").agg(F.min("ord").alias("first_ord"), F.min_by("page", "ord").alias("first_page"), F.min_by("skeleton", "ord").alias("skeleton"), F.count(F.lit(1)).alias("page_count"))
    numbered = number(groups, ["first_ord", "language_prefix", "fingerprint"], "n")
    return numbered.withColumn("cluster_id", F.concat(F.lit(prefix), F.col("n") + start)).drop("first_ord", "n")


def cluster_members(pages: DataFrame, clusters: DataFrame, path: str, language: str, skeleton: str) -> DataFrame:
    """``cluster_id, page`` for every page; pages are not gathered into arrays."""
    keyed = pages.select(F.col(path).alias("page"), F.col(language).alias("language_prefix"), fingerprint(skeleton).alias("fingerprint"))
    return keyed.join(clusters.select("language_prefix", "fingerprint", "cluster_id"), ["language_prefix", "fingerprint"]).select("cluster_id", "page")


def in_order(sets: DataFrame, key: list[str], frequency: DataFrame) -> DataFrame:
    """``key, n, s`` of ``sets(key, g)``: the grams of each set, rarest of the library
    first (those that it doesn't have, before all), as ``struct<f, x>``."""
    grams = sets.select(*key, F.explode("g").alias("x")).join(frequency, "x", "left")
    return grams.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "x"))).alias("s")).select(*key, F.size("s").alias("n"), "s")


def _prefix(sets: DataFrame, least: float) -> DataFrame:
    """The first grams of each set, with their places: a set that is similar enough shares
    one of them."""
    size = F.col("n") - F.ceil(least * F.col("n") - _SLACK).cast("int") + 1
    return sets.select(*[c for c in sets.columns if c != "s"], F.posexplode(F.slice("s", F.lit(1), size)).alias("i", "e"))


def candidates(sets: DataFrame, library: DataFrame, least: float) -> DataFrame:
    """``sid, hid`` of the pairs of sets that can have a Jaccard similarity of ``least`` or
    more: ``sets(sid, n, s)`` and ``library(hid, n, s)`` are ordered by :func:`in_order`.
    Pairs meet in the rare grams at their heads only, and must agree in size and in what
    can still follow the places where they meet."""
    mine = _prefix(sets, least).where("e.f > 0").select("sid", "n", "i", F.col("e.x").alias("x"))
    theirs = _prefix(library, least).select("hid", F.col("n").alias("m"), F.col("i").alias("j"), F.col("e.x").alias("x"))
    n, m = F.col("n"), F.col("m")
    sizes = (n >= least * m - _SLACK) & (m >= least * n - _SLACK)
    shared = F.ceil(least / (1 + least) * (n + m) - _SLACK)
    places = 1 + F.least(n - F.col("i") - 1, m - F.col("j") - 1) >= shared
    return mine.join(theirs, "x").where(sizes & places).select("sid", "hid").distinct()


def similar(sets: DataFrame, library: DataFrame, least: float) -> DataFrame:
    """``sid, hid, score`` of all pairs with a Jaccard similarity of ``least`` or more; for
    0, of all pairs that share a gram."""
    if least > 0:
        both = candidates(sets, library, least).join(sets.select("sid", "n", F.col("s").alias("a")), "sid").join(library.select("hid", F.col("n").alias("m"), F.col("s").alias("b")), "hid")
        found = both.select("sid", "hid", "n", "m", F.size(F.array_intersect("a", "b")).alias("k"))
    else:
        mine = sets.select("sid", "n", F.explode("s").alias("e")).where("e.f > 0").select("sid", "n", "e.x")
        found = mine.join(library.select("hid", F.col("n").alias("m"), F.explode("s.x").alias("x")), "x").groupBy("sid", "hid", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    return found.select("sid", "hid", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("score")).where(F.col("score") >= least)


def best_fit(pages: DataFrame, clusters: DataFrame, key: str, cluster: str, order: str, grams: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """The most similar cluster of each page by Jaccard similarity of gram sets, the
    first of equals: ``key, cluster, score, fitted``; cluster is null, score 0 without clusters.

    Exact and without a cross join. Pages and clusters are reduced to their distinct gram
    sets, written once. Sets that equal a cluster's are found by their hash, others by a
    prefix-filtered join for the threshold; what finds no cluster is tried with half of it,
    and what is left is compared with every set that it shares a gram with. Sets that share
    nothing score 0 (or 1, if both are empty and the texts equal) and matter only where no
    other cluster is found.
    """
    rows = stage(pages.select(F.col(key).alias("k"), F.array_sort(grams).alias("g"), F.col(text).alias("t")), "fit-pages")
    lib = stage(clusters.select(F.col(cluster).alias("c"), F.col(order).alias("o"), F.array_sort(grams).alias("g"), F.col(text).alias("t")), "fit-library")
    hashed = F.xxhash64("g")
    # equal sets score alike and the first wins: one cluster a set is enough
    heads = stage(lib.where(F.size("g") > 0).groupBy(hashed.alias("hid")).agg(F.min_by("c", "o").alias("c"), F.min("o").alias("o"), F.first("g").alias("g")), "fit-heads")
    sets = rows.where(F.size("g") > 0).groupBy(hashed.alias("sid")).agg(F.first("g").alias("g"))
    known = heads.select(F.col("hid").alias("sid"))
    best = [sets.join(known, "sid", "left_semi").select("sid", F.col("sid").alias("hid"), F.lit(1.0).alias("score"))]
    frequency = stage(heads.select(F.explode("g").alias("x")).groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("f")), "fit-frequency")
    library = stage(in_order(heads, ["hid"], frequency), "fit-ordered")
    left = stage(in_order(sets.join(known, "sid", "left_anti"), ["sid"], frequency), "fit-left")
    ranks = heads.select("hid", "o")
    for least in sorted({max(0.0, threshold), max(0.0, threshold) / 2, 0.0}, reverse=True):
        if left.isEmpty():
            break
        top = similar(left, library, least).join(ranks, "hid").groupBy("sid").agg(F.max(F.struct("score", (-F.col("o")).alias("o"), "hid")).alias("b"))
        found = stage(top.select("sid", "b.hid", "b.score"), "fit-found")
        best.append(found)
        if least:
            left = left.join(found, "sid", "left_anti")
    scored = best[0]
    for more in best[1:]:
        scored = scored.unionByName(more)
    named = scored.join(heads.select("hid", "c"), "hid").select("sid", "c", "score")
    # where nothing is shared the first cluster stands, with score 0
    first = lib.agg(F.min_by("c", "o").alias("c")).first()["c"]
    empty = lib.where(F.size("g") == 0).groupBy("t").agg(F.min_by("c", "o").alias("same_c"))
    out = rows.select("k", "t", F.size("g").alias("n"), hashed.alias("sid")).join(named, "sid", "left").join(empty.withColumnRenamed("t", "t2"), (F.col("n") == 0) & (F.col("t") == F.col("t2")), "left")
    score = F.when(F.col("same_c").isNotNull(), F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    chosen = F.coalesce("same_c", "c", F.lit(first).cast(lib.schema["c"].dataType))
    return out.select(F.col("k").alias(key), chosen.alias("cluster"), score.alias("score")).withColumn("fitted", F.col("cluster").isNotNull() & (F.col("score") >= threshold))
