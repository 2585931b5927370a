"""Answers of a text generator, remembered.

A call costs more than all else in a run, so an answer is written once, under a key of
what was asked, and never asked for again: not by another output of the same run, not
after a restart, not by a later run. The folder is a Parquet table of batches; a batch
appears whole or not at all, so what a crash can lose is the wave of calls under way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake import staging

Generate = Callable[[str], str]
ANSWERS = "key string, answer string, error string, run string, at timestamp"
WAVE, TASKS = 1_000, 16  # calls between two commits; calls at a time


def question_key(*parts: Column) -> Column:
    """What an answer is remembered by: a hash of everything that was asked."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])).cast("binary"), 256)


def generate(rows: DataFrame, text: str, call: Generate, out: str = "answer") -> DataFrame:
    """``rows`` with what the injected function returns for each text, and ``error``."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for t in b[text]:
                try:
                    answers.append(call(t))
                    errors.append(None)
                except Exception as e:  # a failed call is a row, whatever went wrong
                    answers.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield b[names].assign(**{out: pd.Series(answers, b.index, dtype=object), "error": pd.Series(errors, b.index, dtype=object)})

    from pyspark.sql.types import StringType, StructType

    return rows.mapInPandas(run, StructType(list(rows.schema.fields)).add(out, StringType()).add("error", StringType()))


def _batches(spark: SparkSession, folder: str) -> list[str]:
    """Batches that were committed."""
    found = [f"{folder}/{x}" for x in staging.children(spark, folder) if x.startswith("batch=")]
    return [x for x in found if staging.exists(spark, f"{x}/_SUCCESS")]


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """``key, answer`` of all answers in a folder; of several to one question (two runs at
    once) the earliest. Errors are no answers."""
    there = _batches(spark, folder)
    rows = spark.read.schema(ANSWERS).parquet(*there) if there else spark.createDataFrame([], ANSWERS)
    return rows.where("error is null").groupBy("key").agg(F.min_by("answer", F.struct("at", "run")).alias("answer"))


def compact(spark: SparkSession, folder: str) -> None:
    """Put all batches of a folder together; for times when no run uses it. The old ones go
    once the new one is there, and a crash between leaves answers twice, which is no harm."""
    old = _batches(spark, folder)
    if len(old) > 1:
        rows = spark.read.schema(ANSWERS).parquet(*old).where("error is null")
        rows.groupBy("key").agg(F.min_by(F.struct("answer", "error", "run", "at"), F.struct("at", "run")).alias("x")).select("key", "x.*").write.parquet(f"{folder}/batch={uuid.uuid4().hex}")
        for x in old:
            staging.remove(spark, x)


def ask(questions: DataFrame, key: str, text: str, call: Generate, folder: str | None = None, accept: Callable[[Column], Column] | None = None, wave: int = WAVE) -> DataFrame:
    """``key, answer, error`` for each distinct key of ``questions``, one call for a key that
    the folder has no answer to. ``accept`` names answers that are good; others are
    errors, and errors are asked for again by the next run. Without a folder the answers
    are remembered for this run alone.

    The result is a table: reading it any number of times makes no calls."""
    spark = questions.sparkSession
    folder = (folder or f"{staging.shared_dir(spark)}/answers-{uuid.uuid4().hex}").rstrip("/")
    asked = staging.stage(questions.groupBy(key).agg(F.first(text).alias("text")).withColumnRenamed(key, "key"), "questions")
    new = staging.stage(asked.join(read_answers(spark, folder), "key", "left_anti"), "questions-new")
    waves, run = -(-new.count() // wave), uuid.uuid4().hex
    good = accept(F.col("answer")) if accept else F.lit(True)
    for w in range(waves):
        part = new.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == w).repartition(TASKS, "key")
        said = generate(part, "text", call)
        bad = F.when(F.col("error").isNull() & ~F.coalesce(good, F.lit(False)), F.lit("not a usable answer")).otherwise(F.col("error"))
        said.select("key", "answer", bad.alias("error"), F.lit(run).alias("run"), F.current_timestamp().alias("at")).write.parquet(f"{folder}/batch={uuid.uuid4().hex}")
    there = _batches(spark, folder)
    known = read_answers(spark, folder)
    if there:
        failed = spark.read.schema(ANSWERS).parquet(*there).where((F.col("run") == run) & F.col("error").isNotNull()).select("key", "error")
    else:
        failed = spark.createDataFrame([], "key string, error string")
    out = asked.select("key").join(known, "key", "left").join(failed, "key", "left")
    return staging.stage(out.select(F.col("key").alias(key), "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error")), "answers")
