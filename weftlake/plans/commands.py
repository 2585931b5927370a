"""Entry functions: each does one job, prints what came of it and returns an exit status
(0, or 1 on failure). What reaches outside (fetching, generating, captures) is injected."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions import markup
from weftlake.operators import effects, templates
from weftlake.plans import build as plan
from weftlake.sources import readers
from weftlake.staging import stage

SITEMAPS = ("sitemap_index.xml", "sitemap.xml")  # addresses probed, in this order


def guarded(job: Callable[[], int]) -> int:
    """The job's status; an error is printed and gives 1."""
    try:
        return job()
    except Exception as e:  # the last place to report whatever went wrong
        print(f"error: {e}", file=sys.stderr)
        return 1


def probe(base: str, get: readers.Fetch) -> str | None:
    """The first sitemap address of a site that answers; None if none does."""
    for name in SITEMAPS:
        address = f"{base.rstrip('/')}/{name}"
        try:
            status, body = get(address)
        except Exception:  # not reachable is an answer here
            continue
        if 200 <= status < 300 and body:
            return address
    return None


def settings_file(path: str, settings: dict[str, str]) -> bool:
    """Write the settings unless there is a file already, which is never touched."""
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.writelines(f"{k}={v}\n" for k, v in settings.items())
    except FileExistsError:
        return False
    return True


def first_page(spark: SparkSession, sitemap: str, get: readers.Fetch) -> str | None:
    """The first address that a sitemap lists, the files of an index asked in their order."""
    todo, seen = [sitemap], set()
    while todo:
        address = todo.pop(0)
        if address in seen:
            continue
        seen.add(address)
        status, body = get(address)
        if not 200 <= status < 300:
            continue
        told = spark.createDataFrame([(body.decode("utf-8", "replace"),)], "xml string").select(markup.is_sitemap_index("xml").alias("index"), markup.sitemap_locs("xml").alias("locs")).first()
        if not told["index"] and told["locs"]:
            return told["locs"][0]
        todo = [*told["locs"], *todo] if told["index"] else todo
    return None


def init(spark: SparkSession, base: str, get: readers.Fetch, generate: Callable[[str], str], settings: dict[str, str], env_file: str) -> int:
    """Writes the settings to ``env_file`` if there is none, looks for a sitemap and has the
    generator answer to the first page that it lists."""

    def job() -> int:
        print(("written: " if settings_file(env_file, settings) else "kept: ") + env_file)
        found = probe(base, get)
        if found is None:
            raise ValueError(f"no sitemap at {base}")
        address = first_page(spark, found, get)
        if address is None:
            raise ValueError(f"{found} lists no page")
        status, body = get(address)
        if not 200 <= status < 300:
            raise ValueError(f"{address}: HTTP {status}")
        page = readers.listed(spark, [address]).withColumn("html", F.lit(body.decode("utf-8", "replace")))
        if not plan.preview(page, generate):
            raise ValueError("the generator gave no answer")
        print(f"ready: {found}")
        return 0

    return guarded(job)


def refine(pages: DataFrame, done: DataFrame, call: Callable[[list[str]], list[str]], save: Callable[[DataFrame], None], force: list[str] | None = None, force_all: bool = False) -> int:
    """Refines pages, hands the result to ``save`` and counts it; 1 if a page failed."""

    def job() -> int:
        rows = templates.refine(pages, done, call, force, force_all)
        # the generator's answers are kept once; the counts are read from them
        rows = stage(rows, "refined")
        save(rows)
        counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}  # four at most
        print(", ".join(f"{k}: {n}" for k, n in sorted(counts.items())))
        return 1 if counts.get("error") else 0

    return guarded(job)


def diff(originals: DataFrame, local: DataFrame, samples: int = 20, threshold: float = 0.02, seed: int = 0, compare: Callable = effects.pixel_ratio) -> int:
    """Compares a sample of captures; 1 if a page differs by more than the threshold."""

    def job() -> int:
        _, verdict = plan.diff(originals, local, samples, threshold, seed, compare)
        row = verdict.first()
        print(f"{row['pages']} pages, {row['failed']} over {threshold}")
        return 0 if row["passed"] else 1

    return guarded(job)
