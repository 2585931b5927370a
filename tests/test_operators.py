import random

import pytest
from pyspark.sql import functions as F

from weftlake.config import Settings
from weftlake.functions import markup, urls
from weftlake.operators import assets, clusters, crawl, effects, reports, templates
from weftlake.plans import build as plan
from weftlake.sources import readers, sitemaps


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_settings():
    assert Settings.from_env({}).crawler.delay_ms == 200
    assert not Settings.from_env({"WEFTLAKE_RESPECT_ROBOTS": "false"}).crawler.respect_robots
    with pytest.raises(ValueError):
        Settings(mode="x")


@pytest.mark.parametrize("url,path", [("https://e.org", "pages/index.html"), ("https://e.org/", "pages/index.html"), ("https://e.org/a/", "pages/a/index.html"), ("https://e.org/a", "pages/a/index.html"), ("https://e.org/a.html?x#y", "pages/a.html"), ("https://e.org//a//b", "pages/a//b/index.html")])
def test_local_path(spark, url, path):
    assert one(spark, urls.local_path(F.lit(url))) == path


def test_fill_is_one_pass(spark):
    values = F.create_map(F.lit("a"), F.lit("$1 {{b}}"), F.lit("b"), F.lit("no"))
    assert one(spark, markup.fill_template(F.lit("{{a}}-{{ c }}-{{b}}"), values)) == "$1 {{b}}--no"
    assert one(spark, markup.fill_template(F.lit("plain"), values)) == "plain"


def test_fences(spark):
    for raw, out in (("```html\n<p>\n```", "<p>"), ("  <p> ", "<p>"), ("```\n<p>```", "<p>"), ("a ```b``` c", "a ```b``` c")):
        assert one(spark, markup.strip_fences(F.lit(raw))) == out


def test_seo(spark):
    head = "<head><TITLE>a &amp; b</TITLE><meta content='x' name='description' /><link hreflang=\"fr\" rel=\"alternate\" href=/fr><meta property='og:x'></head><title>no</title>"
    nodes = one(spark, markup.seo_nodes(F.lit(head)))
    assert nodes == ["<TITLE>a &amp; b</TITLE>", "<meta content='x' name='description' />", '<link hreflang="fr" rel="alternate" href=/fr>', "<meta property='og:x'>"]
    assert one(spark, markup.inject_seo(F.lit("no head"), F.array(F.lit("x")))) == "no head"


def test_clusters_do_not_depend_on_partitions(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", F.lit("x").alias("lang"), F.array_join(markup.tag_sequence("html"), "|").alias("seq"))
    first = clusters.cluster_pages(rows.repartition(7), "page_id", "url", "lang", "seq").toPandas().sort_values("cluster_id").to_csv()
    assert first == clusters.cluster_pages(rows.coalesce(1), "page_id", "url", "lang", "seq").toPandas().sort_values("cluster_id").to_csv()


def test_best_fit_edges(spark):
    pages = spark.createDataFrame([(1, ["a>b", "b>c"], "p"), (2, [], "e"), (3, [], "f"), (4, ["z>z"], "q"), (5, ["a>b"], "r")], "k int, g array<string>, t string")
    lib = spark.createDataFrame([(20, 1, ["a>b", "b>c"], "x"), (10, 0, ["b>c", "a>b"], "y"), (30, 2, [], "e")], "c int, o int, g array<string>, t string")
    found = {r["k"]: (r["cluster"], r["score"], r["fitted"]) for r in clusters.best_fit(pages, lib, "k", "c", "o", "g", "t").collect()}
    assert found == {1: (10, 1.0, True), 2: (30, 1.0, True), 3: (10, 0.0, False), 4: (10, 0.0, False), 5: (10, 0.5, False)}
    none = clusters.best_fit(pages, lib.limit(0), "k", "c", "o", "g", "t").collect()
    assert all(r["cluster"] is None and not r["fitted"] for r in none) and len(none) == 5


def test_robots(spark):
    files = spark.createDataFrame([("e.org", "User-agent: *\nDisallow: /private/\nDisallow: /admin\nAllow: /admin/ok$"), ("f.org", "")], "host string, txt string")
    pages = spark.createDataFrame([("https://e.org/private/x",), ("https://e.org/admin",), ("https://e.org/admin/ok",), ("https://e.org/a",), ("https://f.org/admin",), ("https://g.org/admin",), ("not a url",)], "url string")
    kept = {r["url"] for r in crawl.allowed(pages, crawl.parse_robots(files, "host", "txt"), "url").collect()}
    assert kept == {"https://e.org/admin/ok", "https://e.org/a", "https://f.org/admin", "https://g.org/admin", "not a url"}


def test_partial_shuffle():
    seq = iter([0.5, 0.99, 0.0] * 5)
    assert crawl.partial_shuffle([1, 2, 3, 4], 2, lambda: next(seq)) == [3, 4]
    assert crawl.partial_shuffle([1, 2], 5, random.random) == [1, 2]


def test_sitemap_cycle(spark):
    index = "<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>"
    with pytest.raises(ValueError):
        sitemaps.expand(spark.createDataFrame([("a", index)], "url string, xml string"), "a", 3)


def test_sitemap_parts(spark):
    files = spark.createDataFrame([(f"pages/{i:03}/index.html", "2024-01-02") for i in range(10)], "path string, d string").withColumn("m", F.to_timestamp("d"))
    parts = reports.sitemap_xml(files, "path", "m", "https://e.org/", per_file=4).collect()
    assert sum(r["n_urls"] for r in parts) == 10 and len(parts) == 3
    empty = reports.sitemap_xml(files.limit(0), "path", "m", "https://e.org/").collect()
    assert len(empty) == 1 and "<urlset" in empty[0]["xml"] and empty[0]["n_urls"] == 0


def test_fetch(spark):
    def get(url):
        if url.endswith("bad"):
            raise OSError("down")
        return (404, b"") if url.endswith("none") else (200, url.encode())

    asked = spark.createDataFrame([("https://e.org/a",), ("https://e.org/a",), ("https://e.org/bad",), ("https://f.org/none",)], "url string")
    got = {r["url"]: (r["status"], r["error"]) for r in readers.fetch(asked, get, hosts=2, delay=0.0).collect()}
    assert got == {"https://e.org/a": (200, None), "https://e.org/bad": (None, "down"), "https://f.org/none": (404, "HTTP 404")}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.js").write_text("// c\nvar a;\n")
    (tmp_path / "a" / "bad.js").write_text("var a = 'x")
    (tmp_path / "b.css").write_text("x")
    files = readers.read_files(spark, str(tmp_path), "*.js")
    total = effects.totals(effects.minify_scripts(files)).first()
    assert (total["processed"], total["failed"]) == (1, 1) and total["bytes_after"] < total["bytes_before"]
    assert readers.read_files(spark, str(tmp_path / "no"), "*").count() == 0


def test_pixels():
    white, black = bytes([255] * 16), bytes([0, 0, 0, 255] * 4)
    assert effects.pixel_ratio((2, 2, white), (2, 2, white)) == 0
    assert effects.pixel_ratio((2, 2, white), (2, 2, black)) == 1
    assert effects.pixel_ratio((2, 2, white), (1, 4, white)) == 1 and effects.pixel_ratio((0, 0, b""), (0, 0, b"")) == 0 and effects.pixel_ratio(None, None) == 1


def test_refine_states(spark):
    pages = spark.createDataFrame([("a/index.html", "<p>x"), ("b/index.html", "<p>y"), ("c/index.html", "<p>boom"), ("d/index.html", "<p>same")], "page string, html string")
    done = spark.createDataFrame([("a/index.html",), ("b/index.html",)], "page string")

    def call(segments):
        if "boom" in segments:
            raise RuntimeError("no")
        return segments if "same" in segments else [s.upper() for s in segments]

    got = {r["page"][0]: r["status"] for r in templates.refine(pages, done, call, force=["/b/"]).collect()}
    assert got == {"a": "skipped", "b": "refined", "c": "error", "d": "unchanged"}
    assert {r["status"] for r in templates.refine(pages, done, call, force_all=True).collect()} == {"refined", "error", "unchanged"}


def test_synthesis_errors(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>a"), (2, "u2", "<p>b")], "page_id long, url string, html string")
    found = spark.createDataFrame([("cluster-0", "f", "u1"), ("cluster-1", "g", "u2")], "cluster_id string, fingerprint string, first_page string")

    def call(prompt):
        if "<p>b" in prompt:
            raise RuntimeError("down")
        return "<p>no slot"

    got = {r["cluster_id"]: r["error"] for r in templates.synthesize(found, pages, call).collect()}
    assert got == {"cluster-0": "no slots in the template", "cluster-1": "down"}


def test_variant_plan(spark):
    images = spark.createDataFrame([("a.jpg", 100, "abcdef0123"), ("b.png", 800, "abcdef0123"), ("c.svg", 900, "x"), ("d.webp", None, "abcdef0123")], "p string, w int, d string")
    got = assets.variant_plan(images, "p", "w", "d").toPandas()
    assert set(got[got.path == "a.jpg"].file) == {"a-100w-abcdef01.avif", "a-100w-abcdef01.webp", "a-100w-abcdef01.jpeg"}
    assert len(got[got.path == "b.png"]) == 6 and len(got[got.path == "c.svg"]) == 0 and len(got[got.path == "d.webp"]) == 10


def test_build(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(12)
    built = pages.limit(3).select(urls.local_path("url").alias("local_path"))
    made = plan.build(pages, spark.createDataFrame([], "url string, local_path string"), lambda p: "<html><head></head><body><h1>{{t}}</h1></body></html>", built)
    out = made["pages"].collect()
    assert 0 < len(out) <= 9 and all("<title>" in r["html"] and "<h1>" in r["html"] for r in out)
    assert made["sitemap"].first()["n_urls"] == len(out)
    again = plan.build(pages, spark.createDataFrame([], "url string, local_path string"), lambda p: "{{t}}", built, options=plan.Options(force_all=True))
    assert again["pages"].count() == 12
    assert plan.preview(pages, lambda t: t[:9]) == "<!DOCTYPE"


def test_reuse(spark):
    keyed = spark.createDataFrame([(1, "fr", "0:a|1:b|1:c"), (2, "en", "0:a|1:b|1:c")], "page_id long, lang string, skeleton string")
    library = spark.createDataFrame([("k0", "en", "0:a|1:b|1:c", 0)], "cluster_id string, language_prefix string, skeleton string, ord long")
    got = {r["page_id"]: r["fitted"] for r in plan.reuse_templates(keyed, library).collect()}
    assert got == {1: False, 2: True}
    assert all(r["fitted"] for r in plan.reuse_templates(keyed, library, same_language=False).collect())


def test_stream(spark, sf, tmp_path):
    from weftlake.streaming import incremental

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    src = str(tmp_path / "in")
    args = (src, pages.schema, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df)
    pages.where("page_id < 20").coalesce(1).write.parquet(src)
    incremental.start(spark, *args, once=True).awaitTermination()
    pages.where("page_id < 30").coalesce(1).write.mode("append").parquet(src)
    incremental.start(spark, *args, once=True).awaitTermination()
    state = incremental.read_state(spark, str(tmp_path / "state"))
    paths = pages.where("page_id < 30").select(urls.local_path("url").alias("p")).distinct().count()
    assert state.count() == state.select("local_path").distinct().count() == paths


def test_transport():
    from weftlake.operators import transport

    calls = []
    own = lambda system, user, model: calls.append((user, model)) or "text"
    assert transport.generate("hi", Settings(), transport=own) == "text" and calls == [("hi", "local/default")]
    assert transport.transport_for(Settings("remote", "acme/m"), {"acme": own}) is own
    for settings in (Settings("remote", "none/m"), Settings("remote", "m"), Settings()):
        with pytest.raises(ValueError):
            transport.transport_for(settings, {})


def test_export(spark, tmp_path):
    from weftlake.sources import sinks

    files = spark.createDataFrame([("pages/a/index.html", "<p>é"), ("../out.html", "x")], "local_path string, html string")
    got = {r["path"]: (r["bytes"], r["error"] is None) for r in sinks.export_files(files, str(tmp_path / "site")).collect()}
    assert got == {"pages/a/index.html": (5, True), "../out.html": (0, False)}
    assert (tmp_path / "site" / "pages" / "a" / "index.html").read_text() == "<p>é" and not (tmp_path / "out.html").exists()
    sinks.write_sitemap(reports.sitemap_xml(files.withColumn("m", F.current_timestamp()), "local_path", "m", "https://e.org"), str(tmp_path / "map"))
    assert len(list((tmp_path / "map").glob("part=0/*.txt"))) >= 1


def test_fetch_assets(spark):
    refs = spark.createDataFrame([("https://e.org/a.css", "css", 0), ("https://e.org/a.css", "img", 1), ("https://e.org/none", "js", 2)], "url string, type string, ord int")
    got = {r["url"]: (r["type"], r["local_path"]) for r in readers.fetch_assets(refs, lambda u: (200, b"x") if "css" in u else (500, b""), hosts=1, delay=0.0).collect()}
    assert got["https://e.org/none"] == ("js", None) and got["https://e.org/a.css"][0] == "css" and got["https://e.org/a.css"][1].startswith("assets/css/a-2d711642")


def test_robots_are_asked_first(spark):
    def get(url):
        return (200, b"User-agent: *\nDisallow: /no") if url == "https://e.org/robots.txt" else (404, b"") if url.endswith("robots.txt") else (200, b"x")

    asked = spark.createDataFrame([("https://e.org/no/a", "css"), ("https://e.org/a", "css"), ("https://f.org/no/a", "css"), ("no url", "css")], "url string, type string")
    kept = {"https://e.org/a", "https://f.org/no/a", "no url"}
    assert {r["url"] for r in readers.fetch_pages(asked, get, hosts=2, delay=0.0).collect()} == kept
    assert {r["url"] for r in readers.fetch_assets(asked, get, hosts=2, delay=0.0).collect()} == kept
    assert readers.fetch_pages(asked, get, robots=False, hosts=2, delay=0.0).count() == 4


def test_output_listing(spark, tmp_path):
    for name in ("pages/index.html", "pages/b/index.html", "pages/a b/index.html", "pages/b/x.html", "assets/index.html"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r["path"] for r in readers.read_output(spark, str(tmp_path)).collect()] == ["/", "/a b/", "/b/"]
    assert readers.read_output(spark, str(tmp_path / "none")).count() == 0
    assert [tuple(r) for r in readers.listed(spark, ["u", "v", "u"]).collect()] == [(0, "u"), (1, "v")]
    assert readers.listed(spark, []).count() == 0


def test_manifest(spark):
    import json

    keyed = spark.createDataFrame([(i, f"u{i}", "en", "x" if i % 5 else "y") for i in range(50)], "page_id int, url string, lang string, skeleton string")
    found = clusters.cluster_pages(keyed, "page_id", "url", "lang", "skeleton")
    made = spark.createDataFrame([("cluster-0", "<p>{{a}}", ["a"], None)], "cluster_id string, template string, slots array<string>, error string")
    members = clusters.cluster_members(keyed, found, "url", "lang", "skeleton")
    rows = [(r["part"], json.loads(r["json"])) for r in plan.manifest_json(found, made, members, per_row=10).collect()]
    heads = {j["cluster_id"]: j for part, j in rows if part == 0}
    assert heads["cluster-0"]["template"] == "<p>{{a}}" and heads["cluster-0"]["page_count"] == 10 and "template" not in heads["cluster-1"]
    pages = [(j["cluster_id"], u) for part, j in rows if part for u in j["pages"]]
    assert sorted(pages) == sorted((f"cluster-{int(i % 5 > 0)}", f"u{i}") for i in range(50))
    assert len([1 for part, j in rows if part and j["cluster_id"] == "cluster-1"]) > 1


def test_commands(spark, tmp_path, capsys):
    from weftlake.plans import commands

    env = str(tmp_path / "env")
    index = b"<sitemapindex><sitemap><loc>https://e.org/gone.xml</loc></sitemap><sitemap><loc>https://e.org/pages.xml</loc></sitemap></sitemapindex>"
    site = {"https://e.org/sitemap.xml": (200, index), "https://e.org/pages.xml": (200, b"<urlset><url><loc>https://e.org/a</loc></url></urlset>"), "https://e.org/a": (200, b"<p>a")}
    get = lambda u: site.get(u, (404, b""))
    assert commands.probe("https://e.org/", get) == "https://e.org/sitemap.xml"
    assert commands.init(spark, "https://e.org", get, lambda t: t, {"WEFTLAKE_MODE": "local"}, env) == 0 and (tmp_path / "env").read_text() == "WEFTLAKE_MODE=local\n"
    assert commands.first_page(spark, "https://e.org/sitemap.xml", get) == "https://e.org/a"
    asked = []
    assert commands.init(spark, "https://e.org", get, lambda t: asked.append(t) or t, {"WEFTLAKE_MODE": "remote"}, env) == 0
    assert (tmp_path / "env").read_text() == "WEFTLAKE_MODE=local\n" and asked == ["<p>a"] and "kept:" in capsys.readouterr().out
    assert commands.init(spark, "https://f.org", get, lambda t: t, {}, env) == 1 and "no sitemap" in capsys.readouterr().err
    site["https://e.org/pages.xml"] = (200, b"<urlset/>")
    assert commands.init(spark, "https://e.org", get, lambda t: t, {}, env) == 1 and "lists no page" in capsys.readouterr().err

    pages = spark.createDataFrame([("a/index.html", "<p>x"), ("b/index.html", "<p>boom")], "page string, html string")
    none, kept = spark.createDataFrame([], "page string"), []

    def call(segments):
        if "boom" in segments:
            raise RuntimeError("no")
        return [s.upper() for s in segments]

    assert commands.refine(pages, none, call, lambda df: kept.append(df.count())) == 1 and kept == [2]
    assert commands.refine(pages.limit(1), none, call, lambda df: None) == 0
    shot = lambda n: spark.createDataFrame([("/", 1, 1, bytearray([n, n, n, 255]))], "path string, width int, height int, rgba binary")
    assert commands.diff(shot(0), shot(0)) == 0 and commands.diff(shot(0), shot(255)) == 1
