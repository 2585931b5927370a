"""Operators around injected functions: encoders, subsetters, minifiers, comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.functions import pagefix
from weftlake.staging import bound_batches


def transform_files(files: DataFrame, change: Callable[[bytes], bytes], path: str = "path", body: str = "bytes") -> DataFrame:
    """``path, bytes, before, after, error``: each file through the injected function; a
    failure keeps the file and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, x in zip(b[path], b[body]):
                try:
                    y = change(x) if x.strip() else x
                    out.append((p, y, len(x), len(y), None))
                except Exception as e:  # whatever the injected function raises
                    out.append((p, x, len(x), len(x), str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "bytes", "before", "after", "error"])

    bound_batches(files.sparkSession)
    return files.select(path, body).mapInPandas(run, "path string, bytes binary, before bigint, after bigint, error string")


def minify_scripts(files: DataFrame, minify: Callable[[str], str] = pagefix.minify_js) -> DataFrame:
    return transform_files(files, lambda raw: minify(raw.decode()).encode())


def subset_fonts(fonts: DataFrame, glyphs: DataFrame, subset: Callable[[bytes, str], bytes]) -> DataFrame:
    """Fonts cut down to the glyphs used. The characters of all languages are a bounded set
    (Unicode has 1.1 million), so their string may go to every executor."""
    text = "".join(sorted(r["glyph"] for r in glyphs.select("glyph").distinct().collect())) or "".join(map(chr, range(32, 127)))
    done = transform_files(fonts, lambda raw: subset(raw, text))
    return done.withColumn("new_path", F.when(F.col("error").isNull(), F.regexp_replace("path", r"[.][A-Za-z0-9]+\z", ".woff2")).otherwise(F.col("path")))


def totals(done: DataFrame) -> DataFrame:
    """One row of counters: ``processed, failed, bytes_before, bytes_after``."""
    return done.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("before"), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("after"), F.lit(0)).alias("bytes_after"))


def encode_variants(plan: DataFrame, images: DataFrame, encode: Callable[[bytes, int, str], bytes]) -> DataFrame:
    """``file, bytes, error``: the plan's variants by an injected encoder."""
    rows = plan.join(images.select("path", "bytes"), "path").select("file", "width", "format", "bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, w, f, raw in zip(b["file"], b["width"], b["format"], b["bytes"]):
                try:
                    out.append((file, encode(raw, int(w), f), None))
                except Exception as e:  # whatever the encoder raises
                    out.append((file, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["file", "bytes", "error"])

    bound_batches(plan.sparkSession)
    return rows.mapInPandas(run, "file string, bytes binary, error string")


def pixel_ratio(a: tuple[int, int, bytes] | None, b: tuple[int, int, bytes] | None, threshold: float = 0.1) -> float:
    """Share of pixels that differ: 1 for other sizes or a missing image, 0 for no area.
    Colours differ beyond the threshold as a share of the largest luma/chroma distance."""
    if a is None or b is None or a[:2] != b[:2]:
        return 1.0
    if not a[0] * a[1]:
        return 0.0
    x, y = (np.frombuffer(i[2], np.uint8).reshape(-1, 4).astype("f8") for i in (a, b))
    x, y = (255 + (i[:, :3] - 255) * (i[:, 3:] / 255) for i in (x, y))  # over white
    d = x - y
    to_yiq = np.array([[0.29889531, 0.58662247, 0.11448223], [0.59597799, -0.27417610, -0.32180189], [0.21147017, -0.52261711, 0.31114694]])
    yiq = d @ to_yiq.T
    delta = yiq**2 @ np.array([0.5053, 0.299, 0.1957])
    return float((delta > 35215 * threshold**2).mean())


def visual_diff(originals: DataFrame, local: DataFrame, threshold: float = 0.02, compare: Callable = pixel_ratio, key: list[str] | None = None) -> DataFrame:
    """``path, ratio, passed`` of two tables of captures (path, width, height, rgba); a
    capture that is missing on one side counts as different. Captures are paired by ``key``
    (the path if none is given; nulls are equal); the n-th capture of a key, in the
    order of what it shows, goes with the n-th of the other side, so none is compared twice."""
    key = key or ["path"]
    by = Window.partitionBy(*key).orderBy("path", "width", "height", "rgba")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*key, F.row_number().over(by).alias("_n")).alias(f"k{name}"), F.col("path").alias(f"path{name}"), *[F.col(c).alias(f"{c}{name}") for c in ("width", "height", "rgba")])

    rows = side(originals, "").join(side(local, "2"), F.col("k") == F.col("k2"), "full")
    pair = rows.select(F.coalesce("path", "path2").alias("path"), "width", "height", "rgba", "width2", "height2", "rgba2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for p, w, h, x, w2, h2, y in t.itertuples(index=False):
                one = None if x is None or w != w else (int(w), int(h), x)
                two = None if y is None or w2 != w2 else (int(w2), int(h2), y)
                out.append((p, compare(one, two)))
            yield pd.DataFrame(out, columns=["path", "ratio"])

    bound_batches(originals.sparkSession)
    return pair.mapInPandas(run, "path string, ratio double").withColumn("passed", F.col("ratio") <= threshold)
