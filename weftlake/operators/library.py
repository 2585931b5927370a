"""The library of structures: what earlier builds have clustered and made templates for.

A folder of versions. Each build adds one, holding the clusters that are new or have a
template since; a version is written whole and never changed, and two builds that add the
same number can't both succeed. The newest row of a cluster counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlake import staging

ENTRIES = "cluster_id string, language_prefix string, fingerprint string, skeleton string, first_page string, page_count bigint, template string, slots array<string>, selectors map<string,string>"
DIVERGENT = "cluster-divergent-"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions that were committed."""
    names = [x for x in staging.children(spark, folder) if x.startswith("version=")]
    return [int(x[8:]) for x in names if staging.exists(spark, f"{folder}/{x}/_SUCCESS")]


def read(spark: SparkSession, folder: str | None) -> DataFrame:
    """The entries of all versions and ``version, ord``: the version a cluster's row is of,
    and its place among all clusters (those of earlier builds first)."""
    there = versions(spark, folder) if folder else []
    if not there:
        return spark.createDataFrame([], ENTRIES + ", version int, ord bigint")
    rows = spark.read.schema(ENTRIES).option("basePath", folder).parquet(*[f"{folder}/version={v}" for v in there])
    rows = rows.withColumn("version", F.col("version").cast("int"))
    newest = Window.partitionBy("cluster_id")
    rows = rows.withColumn("_last", F.max("version").over(newest)).withColumn("_first", F.min("version").over(newest)).where("version = _last")
    place = F.regexp_extract("cluster_id", "([0-9]+)$", 1).cast("bigint")
    return rows.select(*[c for c in rows.columns if c[0] != "_"], (F.col("_first") * F.lit(1 << 40) + place).alias("ord"))


def add(entries: DataFrame, folder: str) -> int | None:
    """Write a version of ``entries``; its number, or None where there are none."""
    spark = entries.sparkSession
    if entries.isEmpty():
        return None
    version = max(versions(spark, folder), default=0) + 1
    names = [f.strip().split(" ")[0] for f in ENTRIES.split(", ")]
    entries.select(*names).write.mode("errorifexists").parquet(f"{folder}/version={version}")
    return version


def next_number(known: DataFrame) -> int:
    """How many clusters of diverging pages there are so far."""
    return known.where(F.col("cluster_id").startswith(DIVERGENT)).select("cluster_id").distinct().count()
