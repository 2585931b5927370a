"""Incremental building as a stream: new page files are built once, forced ones again.

State is a table of (local_path, fingerprint, built_at, batch) in runs, Parquet folders
named by the batches that they hold. A batch adds a run of its own; as soon as ``MERGE``
runs of about one size follow each other, they are merged into one that keeps a row for
each path. So a batch reads a few runs of each size, however many batches there were, and
a row is written again only as often as its run grows by that factor. Runs are dealt by
the hash of the path.

A batch is anti-joined with what the runs before it hold, so a page that was built before
is skipped whatever order files arrive in; a batch that is run again after a failure
overwrites its own run and changes nothing else. A merged run replaces the runs inside of
its range once it is whole; what a crash leaves behind of them is not read any more.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftlake import staging
from weftlake.functions import urls
from weftlake.operators import crawl

STATE = "local_path string, fingerprint string, built_at timestamp, batch bigint"


MERGE, DEALT = 8, 4  # runs that become one; files of a run


def runs(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """First and last batch of the runs that count, in order: those that are whole and not
    inside of a larger one."""
    found = []
    for name in staging.children(spark, folder):
        if name.startswith("run-") and staging.exists(spark, f"{folder}/{name}/_SUCCESS"):
            lo, hi = name[4:].split("-")
            found.append((int(lo), int(hi)))
    return sorted(r for r in found if not any(x != r and x[0] <= r[0] and r[1] <= x[1] for x in found))


def _place(folder: str, run: tuple[int, int]) -> str:
    return f"{folder}/run-{run[0]:012d}-{run[1]:012d}"


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """What earlier batches have built; empty at first."""
    there = [r for r in runs(spark, folder) if before is None or r[0] < before]
    rows = spark.read.schema(STATE).parquet(*[_place(folder, r) for r in there]) if there else spark.createDataFrame([], STATE)
    return rows if before is None else rows.where(F.col("batch") < before)


def add_state(rows: DataFrame, number: int, folder: str) -> None:
    """Write a batch's run, then merge what has become enough."""
    spark = rows.sparkSession
    rows.repartition(DEALT, "local_path").write.mode("overwrite").parquet(_place(folder, (number, number)))
    while merge_runs(spark, folder):
        pass


def merge_runs(spark: SparkSession, folder: str) -> bool:
    """Merge the last ``MERGE`` runs if they are of one size; whether there was something to
    merge. A run's size is the power of ``MERGE`` that its number of batches comes to."""
    there = runs(spark, folder)
    level = lambda r: int(math.log(r[1] - r[0] + 1, MERGE) + 1e-9)
    last = there[-MERGE:]
    if len(last) < MERGE or len({level(r) for r in last}) > 1:
        return False
    rows = spark.read.schema(STATE).parquet(*[_place(folder, r) for r in last])
    newest = rows.groupBy("local_path").agg(F.max_by(F.struct("fingerprint", "built_at", "batch"), "batch").alias("x")).select("local_path", "x.*")
    newest.repartition(DEALT, "local_path").write.mode("overwrite").parquet(_place(folder, (last[0][0], last[-1][1])))
    for r in last:
        staging.remove(spark, _place(folder, r))
    return True


def build_batch(batch: DataFrame, number: int, folder: str, process: Callable[[DataFrame], DataFrame], sink: str, force: list[str] | None = None) -> None:
    """One micro-batch: skip what is built, process the rest, write pages and state."""
    spark = batch.sparkSession
    rows = batch.withColumn("local_path", urls.local_path("url"))
    forced = urls.matches_any("url", force) if force else F.lit(False)
    todo = crawl.skip_built(rows, read_state(spark, folder, number), "local_path", forced)
    # of several rows for one path in a batch the last page_id counts
    last = todo.groupBy("local_path").agg(F.max("page_id").alias("page_id"))
    done = process(todo.join(last, ["local_path", "page_id"], "left_semi"))
    done.write.mode("overwrite").parquet(f"{sink}/batch={number}")
    written = spark.read.parquet(f"{sink}/batch={number}")
    state = written.select("local_path", F.substring(F.sha2("html", 256), 1, 12).alias("fingerprint"), F.current_timestamp().alias("built_at"), F.lit(number).cast("bigint").alias("batch"))
    add_state(state, number, folder)


def start(spark: SparkSession, source: str, schema: StructType | str, folder: str, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], force: list[str] | None = None, files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Watch a folder of page tables and build what is new."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, n: build_batch(b, n, folder, process, sink, force))
    return (writer.trigger(availableNow=True) if once else writer).start()
