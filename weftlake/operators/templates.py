"""Templates for clusters: synthesis by an injected generator, slot values, filling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.functions import markup, pagefix
from weftlake.operators import answers
from weftlake.operators.answers import Generate
from weftlake.operators.pages import _each
from weftlake.staging import bound_batches, stage

SYSTEM = "You are given a page that stands for all pages of one structure. Return its HTML with the parts that vary from page to page replaced by {{slot_name}} placeholders, and nothing else."


def prompt(html: Column | str, fingerprint: Column | str) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Structure: "), fingerprint), F.lit("Page:"), html)


def synthesize(clusters: DataFrame, pages: DataFrame, call: Generate, folder: str | None = None) -> DataFrame:
    """``cluster_id, fingerprint, template, slots, error``: one call a cluster, for its
    first page, and none for what ``folder`` has an answer to; the result is a table, so
    reading it again makes no call. A template without a slot is an error, and a cluster
    with one passes its pages through unchanged when filled."""
    first = clusters.join(pages.select(F.col("url").alias("first_page"), "html"), "first_page")
    asked = stage(first.select("cluster_id", "fingerprint", prompt("html", "fingerprint").alias("prompt")), "asked")
    keyed = asked.withColumn("key", answers.question_key(F.col("fingerprint"), F.lit(SYSTEM), F.col("prompt")))
    has_slots = lambda a: F.size(markup.template_slots(markup.strip_fences(a))) > 0
    said = answers.ask(keyed, "key", "prompt", call, folder, has_slots)
    rows = keyed.select("cluster_id", "fingerprint", "key").join(said, "key")
    template = markup.strip_fences("answer")
    error = F.when(F.col("error") == "not a usable answer", F.lit("no slots in the template")).otherwise(F.col("error"))
    return rows.select("cluster_id", "fingerprint", template.alias("template"), markup.template_slots(template).alias("slots"), error.alias("error"))


selectors = _each(lambda original, template, slots: pagefix.slot_selectors(original, template, list(slots)), "map<string,string>")
_values = _each(lambda html, sel: (lambda v: {"values": v[0], "missing": v[1]})(pagefix.slot_values(html, dict(sel))), "struct<values:map<string,string>,missing:array<string>>", ("values", "missing"))


def slot_selectors(templates: DataFrame, clusters: DataFrame, pages: DataFrame) -> DataFrame:
    """Templates with ``selectors``: where their slots are in the cluster's first page."""
    first = clusters.select("cluster_id", "first_page").join(pages.select(F.col("url").alias("first_page"), F.col("html").alias("_html")), "first_page")
    rows = templates.where("template is not null").join(first.select("cluster_id", "_html"), "cluster_id")
    return rows.withColumn("selectors", selectors("_html", "template", "slots")).drop("_html")


def fill(pages: DataFrame, members: DataFrame, templates: DataFrame) -> DataFrame:
    """``page_id, url, html, missing``: pages filled into their cluster's template, with
    their own search metadata and language; pages without a template as they are. Metadata
    is read from the raw page, so that it stays byte for byte."""
    keyed = pages.join(members.select(F.col("page").alias("url"), "cluster_id"), "url", "left").join(templates.select("cluster_id", "template", "selectors"), "cluster_id", "left")
    found = keyed.withColumn("_v", F.when(F.col("selectors").isNotNull(), _values("html", F.coalesce("selectors", F.create_map().cast("map<string,string>")))))
    filled = markup.fill_template("template", F.coalesce("_v.values", F.create_map().cast("map<string,string>")))
    done = markup.keep_html_lang("html", markup.inject_seo(filled, markup.seo_nodes("html")))
    return found.select("page_id", "url", F.when(F.col("template").isNull(), F.col("html")).otherwise(done).alias("html"), F.coalesce("_v.missing", F.array().cast("array<string>")).alias("missing"))


def refine(pages: DataFrame, done: DataFrame, call: Callable[[list[str]], list[str]], force: list[str] | None = None, force_all: bool = False) -> DataFrame:
    """``page, html, status, reason``: text segments replaced by the injected generator's.
    Pages in ``done(page)`` are skipped unless forced (by path, or all); a failure or a
    wrong number of segments leaves the page as it was."""
    forced = F.lit(force_all) | F.exists(F.array(*[F.lit(x.strip("/")) for x in force or ["\x00"]]), lambda x: F.col("page") == F.concat(x, F.when(x == "", F.lit("")).otherwise(F.lit("/")), F.lit("index.html")))
    seen = pages.join(done.select("page", F.lit(True).alias("_seen")).distinct(), "page", "left")
    skipped = seen.where(F.col("_seen").isNotNull() & ~forced).select("page", "html", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("reason"))
    todo = seen.where(F.col("_seen").isNull() | forced).select("page", "html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, html in zip(b["page"], b["html"]):
                try:
                    new = pagefix.refine(html, call(pagefix.segments(html)))
                    out.append((page, new, "unchanged" if new == html else "refined", None))
                except Exception as e:  # whatever the generator raises
                    out.append((page, html, "error", str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["page", "html", "status", "reason"])

    bound_batches(todo.sparkSession)
    return todo.mapInPandas(run, "page string, html string, status string, reason string").unionByName(skipped)
