"""Clusters and fits at length: numbering by ranges, the prefix-filtered join, sitemap cuts."""

import random

import pytest
from pyspark.sql import functions as F

from weftlake.operators import clusters, reports
from weftlake.staging import number


@pytest.fixture
def many_ranges(spark):
    """Shuffles into several partitions, none put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_are_places(spark, many_ranges):
    values = random.Random(1).sample(range(10_000), 700)
    rows = spark.createDataFrame([(v, v % 3) for v in values], "v int, w int").repartition(5)
    found = number(rows, ["w", "v"], "n")
    assert [(r["n"], r["w"], r["v"]) for r in found.orderBy("n").collect()] == [(i, v % 3, v) for i, v in enumerate(sorted(values, key=lambda v: (v % 3, v)))]
    assert number(rows.limit(0), ["v"], "n").count() == 0


def test_clusters_are_numbered_by_many_tasks(spark, many_ranges):
    rows = spark.range(500).select(F.col("id").alias("p"), F.concat(F.lit("u"), "id").alias("u"), F.lit("en").alias("l"), F.concat(F.lit("s"), F.col("id") % 400).alias("s"))
    found = clusters.cluster_pages(rows.repartition(6), "p", "u", "l", "s")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    assert {r["cluster_id"]: r["first_page"] for r in found.collect()} == {f"cluster-{i}": f"u{i}" for i in range(400)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("threshold", [0.7, 0.5, 0.95, 1.0])
def test_best_fit_against_all_pairs(spark, threshold):
    """Sets that all share two grams, near ones, equal ones and ones that share nothing."""
    rng = random.Random(int(threshold * 100))
    words = [f"g{i}" for i in range(60)]
    base = [set(rng.sample(words, rng.randrange(3, 14))) | {"all", "most"} for _ in range(25)]
    library = {i: s for i, s in enumerate(base)}
    pages = {}
    for i in range(150):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(4)):
            s.symmetric_difference_update({rng.choice(words)})
        pages[i] = s if i % 10 else {f"z{i}", "z"} if i % 20 else set(rng.sample(words, 2)) | {"most"}
    lib = spark.createDataFrame([(f"c{i}", i, sorted(s), "") for i, s in library.items()], "c string, o int, g array<string>, t string")
    rows = spark.createDataFrame([(i, sorted(s), "") for i, s in pages.items()], "k int, g array<string>, t string")
    got = {r["k"]: (r["cluster"], r["score"], r["fitted"]) for r in clusters.best_fit(rows, lib, "k", "c", "o", "g", "t", threshold).collect()}
    want = {}
    for k, s in pages.items():
        score, o = max((jaccard(s, x), -i) for i, x in library.items())
        want[k] = (f"c{-o}", score, score >= threshold)
    assert got == want


def test_a_gram_of_all_pages_makes_no_candidates(spark):
    """Every set holds ten common grams; only those with a rare one in common are compared."""
    common = [f"all{i}" for i in range(10)]
    library = spark.createDataFrame([(i, sorted([*common, f"a{i}", f"b{i}"])) for i in range(300)], "hid long, g array<string>")
    pages = spark.createDataFrame([(i, sorted([*common, f"a{i % 300}", f"c{i}"])) for i in range(900)], "sid long, g array<string>")
    frequency = library.select(F.explode("g").alias("x")).groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("f"))
    sets, heads = clusters.in_order(pages, ["sid"], frequency), clusters.in_order(library, ["hid"], frequency)
    found = clusters.candidates(sets, heads, 0.8)
    # 11 of 13 grams are shared at best: 0.846; other pairs share 10 of 14: 0.714
    assert found.count() == 900
    assert {(r["sid"] % 300, r["hid"]) for r in found.collect()} == {(i, i) for i in range(300)}
    assert clusters.similar(sets, heads, 0.8).count() == 900


def test_sitemaps_are_cut_exactly(spark, many_ranges):
    files = spark.range(5_003).select(F.concat(F.lit("pages/"), F.sha2(F.col("id").cast("string"), 256), F.lit("/index.html")).alias("p"), F.lit("2024-01-02").cast("timestamp").alias("m"))
    parts = {r["part"]: (r["n_urls"], r["xml"]) for r in reports.sitemap_xml(files.repartition(9), "p", "m", "https://e.org", per_file=500).collect()}
    assert [parts[i][0] for i in range(11)] == [500] * 10 + [3]
    locs = [x for i in range(11) for x in __import__("re").findall("<loc>(.*?)</loc>", parts[i][1])]
    assert locs == sorted(locs) and len(set(locs)) == 5_003
