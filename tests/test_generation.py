"""Calls of the generator are counted in files, as they are made by other processes."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from weftlake.functions import markup
from weftlake.operators import answers, library, templates
from weftlake.plans import build as plan

TEMPLATE = "<html><head></head><body><h1>{{t}}</h1></body></html>"


def Counted(folder, answer=TEMPLATE, bad=None):
    """A generator that leaves a file for each call and fails on texts that hold a word. A
    class of its own each time, so that workers get it by value."""

    class Generator:
        def __init__(self):
            self.folder = str(folder)
            os.makedirs(self.folder, exist_ok=True)

        def __call__(self, text):
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w", encoding="utf-8") as f:
                f.write(text)
            if bad and bad in text:
                raise RuntimeError("down")
            return answer

        @property
        def calls(self):
            return len(os.listdir(self.folder))

    return Generator()


@pytest.fixture
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").limit(12).cache()


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "url string, local_path string")


def questions(spark, n=30):
    rows = spark.createDataFrame([(f"q{i % n}",) for i in range(3 * n)], "text string")
    return rows.withColumn("k", answers.question_key(F.col("text")))


def test_one_call_a_question_and_none_after(spark, tmp_path):
    call, folder = Counted(tmp_path / "calls"), str(tmp_path / "answers")
    got = answers.ask(questions(spark), "k", "text", call, folder, wave=7)
    assert got.count() == 30 and call.calls == 30
    assert got.where("error is null and answer is not null").count() == 30 and got.select(F.max("answer")).first()[0] == TEMPLATE
    assert call.calls == 30  # reading again asks nothing
    answers.ask(questions(spark, 33), "k", "text", call, folder).collect()
    assert call.calls == 33
    answers.compact(spark, folder)
    assert answers.ask(questions(spark, 33), "k", "text", call, folder).where("answer is null").count() == 0 and call.calls == 33
    assert len(os.listdir(folder)) == 1


def test_errors_are_asked_again(spark, tmp_path):
    folder = str(tmp_path / "answers")
    down = Counted(tmp_path / "down", bad="q3")
    got = {r["k"]: (r["answer"], r["error"]) for r in answers.ask(questions(spark, 5), "k", "text", down, folder).collect()}
    assert sorted(x[1] or "" for x in got.values()) == ["", "", "", "", "down"] and down.calls == 5
    odd = Counted(tmp_path / "odd", answer="no slots")
    usable = lambda a: a.contains("{{")
    assert [r["error"] for r in answers.ask(questions(spark, 5), "k", "text", odd, folder, usable).where("answer is null").collect()] == ["not a usable answer"]
    up = Counted(tmp_path / "up")
    assert answers.ask(questions(spark, 5), "k", "text", up, folder).where("answer is null").count() == 0
    assert (odd.calls, up.calls) == (1, 1)


def test_a_crash_loses_one_wave(spark, tmp_path):
    """A batch without its commit mark (its job died) is not read; committed ones are."""
    folder = str(tmp_path / "answers")
    call = Counted(tmp_path / "calls")
    answers.ask(questions(spark, 12), "k", "text", call, folder, wave=4)
    names = sorted(os.listdir(folder))
    assert call.calls == 12 and len(names) > 2
    os.remove(os.path.join(folder, names[0], "_SUCCESS"))
    lost = 12 - answers.read_answers(spark, folder).count()
    assert 0 < lost < 12
    answers.ask(questions(spark, 12), "k", "text", call, folder, wave=4)
    assert call.calls == 12 + lost


def test_no_question(spark, tmp_path):
    assert answers.ask(questions(spark).limit(0), "k", "text", Counted(tmp_path / "c"), str(tmp_path / "a")).collect() == []


def test_a_build_calls_once_a_cluster_over_all_outputs(spark, pages, nothing, tmp_path):
    call = Counted(tmp_path / "calls")
    options = plan.Options(answers=str(tmp_path / "answers"))
    made = plan.build(pages, nothing, call, options=options)
    n = made["clusters"].count()
    for name in ("templates", "manifest", "pages", "savings", "sitemap"):
        assert made[name].count() > 0
    assert call.calls == n > 1
    plan.build(pages, nothing, call, options=options)["pages"].count()  # after a restart
    assert call.calls == n
    single = Counted(tmp_path / "more")
    out = plan.build(pages, nothing, single)  # no folder: once in this build
    assert out["templates"].count() == out["clusters"].count() == single.calls and out["manifest"].count() > 0 and single.calls == n


def odd_page(spark, page_id=900, tags="section dl dt dd dl dt dd figure figcaption table tr td"):
    body = "".join(f"<{t}>{t}" for t in tags.split())
    return spark.createDataFrame([(page_id, f"https://odd.test/p{page_id}", f'<!DOCTYPE html><html lang="en"><head><title>Odd {page_id}</title></head><body><h1>One of its kind</h1>{body}</body></html>')], "page_id long, url string, html string")


def test_an_odd_page_gets_its_own_template(spark, pages, nothing, tmp_path):
    call, folder = Counted(tmp_path / "calls"), str(tmp_path / "library")
    options = plan.Options(library=folder, answers=str(tmp_path / "answers"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    first = plan.build(pages, nothing, call, options=options)
    n = first["clusters"].count()
    assert first["divergent"].count() == 0 and library.versions(spark, folder) == [1] and call.calls == n

    # a page of a known structure with other words, and one like no other
    known = pages.orderBy("page_id").limit(1).select(F.lit(800).cast("long").alias("page_id"), F.lit("https://e.org/again").alias("url"), F.regexp_replace("html", "<title>[^<]*", "<title>Again").alias("html"))
    both = known.unionByName(odd_page(spark))
    second = plan.build(both, nothing, call, options=options)
    assert [(r["cluster_id"], r["page"]) for r in second["divergent"].collect()] == [("cluster-divergent-0", "https://odd.test/p900")]
    assert call.calls == n + 1 and library.versions(spark, folder) == [1, 2]
    found = {r["cluster_id"]: r["page_count"] for r in second["clusters"].collect()}
    assert found["cluster-divergent-0"] == 1 and len(found) == 2
    html = {r["page_id"]: r["html"] for r in second["pages"].collect()}
    assert "<title>Again" in html[800] and "<title>Odd 900" in html[900] and "<h1>" in html[900]
    assert second["manifest"].where("cluster_id = 'cluster-divergent-0'").count() == 2

    # the odd one is known by now; another odd one counts on
    more = odd_page(spark, 901).unionByName(odd_page(spark, 902, "ul li ol li form input select option textarea button label legend"))
    third = plan.build(more, nothing, call, options=options)
    assert {r["cluster_id"]: r["page_count"] for r in third["clusters"].collect()} == {"cluster-divergent-0": 1, "cluster-divergent-1": 1}
    assert call.calls == n + 2 and library.versions(spark, folder) == [1, 2, 3]
    again = plan.build(more, nothing, call, options=options)
    assert again["divergent"].count() == 0 and call.calls == n + 2 and library.versions(spark, folder) == [1, 2, 3]


def test_a_cluster_without_a_template_is_asked_about_again(spark, nothing, tmp_path):
    folder = str(tmp_path / "library")
    options = plan.Options(library=folder, answers=str(tmp_path / "answers"))
    down = Counted(tmp_path / "down", bad="Page:")
    first = plan.build(odd_page(spark), nothing, down, options=options)
    assert [r["error"] for r in first["templates"].collect()] == ["down"] and "One of its kind" in first["pages"].first()["html"]
    assert plan.build(odd_page(spark), nothing, down, options=options)["templates"].count() == 1 and library.versions(spark, folder) == [1]
    up = Counted(tmp_path / "up")
    later = plan.build(odd_page(spark, 901), nothing, up, options=options)
    assert [r["error"] for r in later["templates"].collect()] == [None] and up.calls == 1
    entry = library.read(spark, folder).first()
    assert (entry["cluster_id"], entry["version"]) == ("cluster-0", 2) and entry["template"] == TEMPLATE and entry["slots"] == ["t"]


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "library")
    row = ("cluster-0", "en", "f", "0:a|1:b", "u", 1, None, None, None)
    one = spark.createDataFrame([row], library.ENTRIES)
    assert library.read(spark, folder).count() == 0 and library.add(one, folder) == 1
    assert library.add(one.limit(0), folder) is None
    with pytest.raises(Exception, match="(?i)already exists"):
        one.write.mode("errorifexists").parquet(f"{folder}/version=1")  # another build of the same number
    new = spark.createDataFrame([(*row[:6], "{{a}}", ["a"], {"a": "h1"}), ("cluster-divergent-3", *row[1:])], library.ENTRIES)
    assert library.add(new, folder) == 2
    os.remove(f"{folder}/version=2/_SUCCESS")
    assert library.read(spark, folder).first()["template"] is None
    open(f"{folder}/version=2/_SUCCESS", "w").close()
    found = {r["cluster_id"]: (r["version"], r["template"]) for r in library.read(spark, folder).collect()}
    assert found == {"cluster-0": (2, "{{a}}"), "cluster-divergent-3": (2, None)}
    assert [r["cluster_id"] for r in library.read(spark, folder).orderBy("ord").collect()] == ["cluster-0", "cluster-divergent-3"]
    assert library.next_number(library.read(spark, folder)) == 1


def test_generate_is_still_there(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    assert {r["t"]: r["answer"] for r in templates.answers.generate(rows, "t", str.upper).collect()} == {"a": "A", "b": "B"}
    assert markup.template_slots is not None
