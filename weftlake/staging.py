"""Tables written once: where lineage is cut, and exact numbering without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Only in
    local mode, where it is unset, one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 128, mb: int = 4) -> None:
    """Bound what one Arrow batch holds, so that a Python worker's memory follows neither
    the table nor how long its pages are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, sorted; none if it is missing."""
    if not exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def number(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``, the 0-based place of each row in the given order (a total one).

    Two levels: rows are dealt into ranges of the order and written, then numbered inside
    their range by many tasks; what stands before a range is the sum of the counts of the
    ranges before it, as many numbers as there were tasks."""
    part = "_range"
    dealt = stage(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before, total = {}, 0
    for p, n in sorted((r[part], r["count"]) for r in dealt.groupBy(part).count().collect()):
        before[p], total = total, total + n
    ahead = F.split(F.lit(",".join(str(before.get(p, 0)) for p in range(max(before, default=0) + 1))), ",").cast("array<bigint>")
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(out, F.get(ahead, F.col(part)) + own).drop(part)
