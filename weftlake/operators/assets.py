"""Asset references: union, first use, manifest lookup, image plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.functions import urls

WIDTHS = [480, 768, 1024, 1440, 1920]
FORMATS = ["avif", "webp"]


def first_wins(refs: DataFrame, url: str, order: list[str]) -> DataFrame:
    """One row an address, that of its first use; later uses may have another type."""
    by = Window.partitionBy(url).orderBy(*order)
    return refs.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def first_types(refs: DataFrame, url: str, order: str, kind: str) -> DataFrame:
    """``url, type, first_use, uses`` by partial aggregation; no window over a hot address."""
    return refs.groupBy(url).agg(F.min_by(kind, order).alias("type"), F.min(order).alias("first_use"), F.count(F.lit(1)).alias("uses"))


def lookup(refs: DataFrame, manifest: DataFrame, url: str = "url") -> DataFrame:
    """References with their ``local_path``, null where the manifest has none."""
    return refs.join(manifest.select(F.col("url").alias("_url"), "local_path"), refs[url] == F.col("_url"), "left").drop("_url")


def image_candidates(src):
    """Keys an ``<img src>`` may have in the image manifest: as written, and without one
    leading ``./`` or leading slashes."""
    return F.array(src, F.regexp_replace(src, r"^(?:[.]/|/+)", ""))


def match_images(images: DataFrame, manifest: DataFrame, src: str, path: str) -> DataFrame:
    """Images with the manifest path of their first matching key."""
    keys = images.select("*", F.posexplode(image_candidates(F.col(src))).alias("_pos", "_key"))
    hit = keys.join(manifest.select(F.col(path).alias("_key")), "_key")
    found = hit.groupBy(*images.columns).agg(F.min_by("_key", "_pos").alias("match"))
    return images.join(found.select(src, "match").distinct(), src, "left")


def variant_plan(images: DataFrame, path: str, width: str, digest: str, widths: list[int] = WIDTHS, formats: list[str] = FORMATS) -> DataFrame:
    """``path, format, width, file`` of the variants to encode: all widths up to the
    source's (its own if none is; all if unknown) in each format and its own one."""
    w, p = F.col(width), F.col(path)
    fits = F.filter(F.array(*[F.lit(x) for x in widths]), lambda x: w.isNull() | (x <= w))
    chosen = F.when(F.size(fits) == 0, F.array(w.cast("int"))).otherwise(fits)
    ext = F.lower(F.regexp_extract(p, r"[.]([A-Za-z0-9]+)\z", 1))
    own = urls.normal_format(F.lit(None).cast("string"), ext)
    kinds = F.array_distinct(F.concat(F.array(*[F.lit(x) for x in formats]), F.array(own)))
    stem = F.regexp_replace(p, r"[.][A-Za-z0-9]+\z", "")
    rows = images.where(ext.isin("png", "jpg", "jpeg", "gif", "webp", "avif", "bmp"))  # no vector images, no icons
    rows = rows.select(p.alias("path"), stem.alias("stem"), F.col(digest).alias("d"), F.explode(chosen).alias("width"), kinds.alias("k")).select("path", "stem", "d", "width", F.explode("k").alias("format"))
    file = F.concat("stem", F.lit("-"), F.col("width").cast("string"), F.lit("w-"), F.substring("d", 1, 8), F.lit("."), "format")
    return rows.select("path", "format", F.col("width").cast("int").alias("width"), file.alias("file"))


def srcsets(variants: DataFrame) -> DataFrame:
    """``path, format, srcset``: the variants of a format by width."""
    ordered = F.array_sort(F.collect_list(F.struct("width", "file")))
    return variants.groupBy("path", "format").agg(F.array_join(F.transform(ordered, lambda v: F.concat(F.lit("/"), v["file"], F.lit(" "), v["width"].cast("string"), F.lit("w"))), ", ").alias("srcset"))


def fallbacks(variants: DataFrame, own_format: str = "jpeg") -> DataFrame:
    """``path, file``: the widest variant of the fallback format, else the widest of all."""
    mine = F.when(F.col("format") == own_format, F.lit(1)).otherwise(F.lit(0))
    return variants.groupBy("path").agg(F.max_by("file", F.struct(mine, F.col("width"), F.col("format"))).alias("file"))
