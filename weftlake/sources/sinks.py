"""Writing results: tables, single page files, manifests, sitemaps."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.staging import bound_batches


def write_pages(pages: DataFrame, folder: str, by_language: str | None = None) -> None:
    """Pages as a Parquet table, the form to keep; partitioned by a language column if given."""
    writer = pages.write.mode("overwrite")
    (writer.partitionBy(by_language) if by_language else writer).parquet(folder)


def export_files(files: DataFrame, folder: str, path: str = "local_path", body: str = "html") -> DataFrame:
    """``path, bytes, error``: one file a row below a folder that all executors share. A
    path that leads out of the folder is an error; of rows with one path the last wins."""
    root = os.path.realpath(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, x in zip(b[path], b[body]):
                full = os.path.realpath(os.path.join(root, p))
                try:
                    if not full.startswith(root + os.sep):
                        raise ValueError("outside of the folder")
                    raw = x.encode() if isinstance(x, str) else bytes(x)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    with open(full + ".part", "wb") as f:
                        f.write(raw)
                    os.replace(full + ".part", full)
                    out.append((p, len(raw), None))
                except (OSError, ValueError) as e:
                    out.append((p, 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "bytes", "error"])

    bound_batches(files.sparkSession)
    return files.select(path, body).mapInPandas(run, "path string, bytes bigint, error string")


def write_manifest(rows: DataFrame, folder: str) -> None:
    """A manifest as JSON lines, many tasks at once; its size grows with the site."""
    rows.write.mode("overwrite").json(folder)


def write_sitemap(parts: DataFrame, folder: str) -> None:
    """The sitemap's files as a text table, one row a file."""
    parts.select(F.col("part").cast("string").alias("part"), F.col("xml").alias("value")).write.mode("overwrite").partitionBy("part").option("lineSep", "\x00").text(folder)
