"""Reading sitemaps: recursive expansion of index files, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.functions import markup


def expand(sitemaps: DataFrame, root: str, max_depth: int = 8) -> DataFrame:
    """``sitemap, branch, ord, loc, lastmod`` of all entries below ``root``, from a table
    ``sitemaps(url, xml)``; (branch, ord) sorts them depth-first as they are listed.

    Each level is one join, so there are as many as index files are nested, not as
    many as there are files. A file listed twice is expanded twice; one that lists
    itself ends at ``max_depth`` with an error instead of never.
    """
    spark = sitemaps.sparkSession
    level = spark.createDataFrame([(root, "")], "url string, branch string")
    leaves = None
    for depth in range(max_depth + 1):
        found = level.join(sitemaps, "url")
        entries = found.where(~markup.is_sitemap_index("xml")).select(F.col("url").alias("sitemap"), "branch", F.posexplode(markup.sitemap_entries("xml")).alias("ord", "e")).select("sitemap", "branch", "ord", "e.loc", "e.lastmod")
        leaves = entries if leaves is None else leaves.unionByName(entries)
        below = found.where(markup.is_sitemap_index("xml")).select("branch", F.posexplode(markup.sitemap_locs("xml")).alias("pos", "url"))
        level = below.select("url", F.concat("branch", F.lit("/"), F.lpad(F.col("pos").cast("string"), 8, "0")).alias("branch"))
        if level.isEmpty():
            return leaves
        if depth == max_depth:
            raise ValueError(f"sitemaps are nested deeper than {max_depth}, or list each other")
    return leaves


def first_origin(sitemaps: DataFrame) -> str | None:
    """The origin of the first address of a generated sitemap; None without one."""
    row = sitemaps.select(F.regexp_extract("xml", r"<loc>\s*(https?://[^/<\s]+)", 1).alias("o")).where("o <> ''").first()
    return row["o"] if row else None
