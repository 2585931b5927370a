"""Helpers shared by the training-data operators: reading tables, cutting
lineage through the shared checkpoint folder, global ranks without a single
task, and connected components by star contraction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound_batches(spark: SparkSession, rows: int = 512, mb: int = 16) -> None:
    """Bound what one Arrow batch holds, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.
    Only where it is unset in local mode (tests on one machine) a temporary one is made."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends
    there, and a lost executor costs no recomputation beyond that table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


#: Tables written by the current application; a result may still read them.
_staged: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stage(df: DataFrame) -> None:
    """Delete what :func:`stage` wrote once nothing reads it any more."""
    if path := getattr(df, "_weft_path", None):
        _delete(df.sparkSession, path)


def clear_stages(spark: SparkSession) -> None:
    """Delete all that operators have staged, once their results have been written."""
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def parts_for(rows: int, per: int = 20_000) -> int:
    return max(1, -(-rows // per))


def global_rank(df: DataFrame, keys: list[str], spread: list[Column | str], order: list[Column | str], out: str, buckets: int | Column) -> DataFrame:
    """Add ``out``: the 0-based gapless rank of each row within its ``keys``.

    Rows are dealt into ``buckets`` by the hash of ``spread``; ranks are taken
    within (keys, bucket), and offsets are running sums of the bucket counts, so a
    key with a third of all rows is still ranked by many tasks. ``buckets`` may be a
    column that depends on the keys, so that rare keys have few. ``keys`` may be empty
    (rank over all rows).
    """
    b, k = "_wl_bucket", "_wl_key"
    df = df.withColumn(b, F.pmod(F.xxhash64(*spread), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int"))
    df = df.withColumn(k, F.struct(*keys) if keys else F.lit(0))
    by = Window.partitionBy(k, b).orderBy(*order)
    ranked = df.withColumn("_wl_rn", F.row_number().over(by) - 1)
    counts = df.groupBy(k, b).agg(F.count(F.lit(1)).alias("_wl_n"))
    before = Window.partitionBy(k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(k).alias("_wl_k2"), F.col(b).alias("_wl_b2"), F.coalesce(F.sum("_wl_n").over(before), F.lit(0)).alias("_wl_off"))
    joined = ranked.join(offsets, F.col(k).eqNullSafe(F.col("_wl_k2")) & (F.col(b) == F.col("_wl_b2")))
    return joined.withColumn(out, F.col("_wl_rn") + F.col("_wl_off")).drop(b, k, "_wl_rn", "_wl_k2", "_wl_b2", "_wl_off")


def components(edges: DataFrame, label: str = "cc", max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` (bigint): rows ``(node, root)``, the
    root being the smallest node reachable. Alternates large-star and small-star
    contraction; a round's tables are written to the shared folder, and rounds end
    when the edge set no longer changes. What is joined on a node is a table of its own
    on both sides, so that Spark may split a node with very many edges over tasks."""
    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), label)
    seen = None
    for _ in range(max_rounds):
        sign = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == seen or not sign[0]:
            break
        seen = sign
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{label}-least")
        large = stage(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct(), f"{label}-large")
        up = stage(large.groupBy("b").agg(F.min("a").alias("m")), f"{label}-up")
        small = large.join(up, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(up.select(F.col("m").alias("a"), "b")).distinct()
        old, e = e, stage(small, label)
        for df in (old, least, large, up):
            drop_stage(df)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionAll(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
