"""How quality filters interact: what each of them removes by itself, after others,
and on average over all orders.

A relational word pipeline. Texts are dealt by document and exploded into words;
(document, word) gives each word's occurrences and the document its totals and distinct
words, both without a second shuffle, as the words of a document stand together. The
other filters' flags are outer-joined by document, labels as well, and each part of the
corpus is summed up in 32 conditional counts, one for each set of failed filters. All
orders of the filters follow from these 32 numbers.

Filters of a whole text (words: maximal runs without ASCII white space):

* A: fewer than ``MIN_WORDS`` words
* B: 100 * distinct words < ``DISTINCT`` * words
* C: 100 * characters A-Z > ``CAPITALS`` * characters
* D: holds any of ``#$%&*|``
* E: the same text stands under a smaller doc_id

Defined results: null and empty texts are equal to each other and have no words (A
fails); rows that repeat id and text are counted one by one and are no copies of each
other; a null id is no copy of anything, nor is anything a copy of it unless all ids of
that text are null; a null source is the part ''; several labels of one id count as good
or toxic if any of them is; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import stage

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS = 50, 65, 5
ODD_SIGNS = r"[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
SETS = 1 << len(FILTERS)
COUNTS = [f"n{i:02d}" for i in range(SETS)]


def word_totals(texts: DataFrame) -> DataFrame:
    """``k, n_words, n_distinct`` for each ``k`` of ``texts(k, text)``. Rows that repeat a
    ``k`` have the same text; each of them adds a null word, by whose number the totals of
    all of them are divided."""
    dealt = texts.select("k", F.coalesce("text", F.lit("")).alias("text")).repartition("k")
    none = F.array(F.lit(None).cast("string"))
    words = dealt.select("k", F.explode(F.concat(none, F.split("text", SPACES))).alias("word")).where("word is null or word <> ''")
    each = words.groupBy("k", "word").agg(F.count(F.lit(1)).alias("n"))
    rows, total = F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.sum(F.when(F.col("word").isNotNull(), F.col("n")))
    found = each.groupBy("k").agg(rows.alias("rows"), total.alias("total"), F.count("word").alias("n_distinct"))
    return found.select("k", F.expr("coalesce(total, 0) div rows").alias("n_words"), "n_distinct")


def text_flags(docs: DataFrame) -> DataFrame:
    """``k, doc_id, part, digest, c, d`` of every row: what needs no words."""
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    rows = docs.select(F.struct("doc_id", F.xxhash64(text).alias("h")).alias("k"), "doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    return rows.select("k", "doc_id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), (100 * capitals > CAPITALS * F.length("t")).alias("c"), F.col("t").rlike(ODD_SIGNS).alias("d"))


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, failed`` of every row; bit i of ``failed`` is set if filter i fails."""
    rows = stage(text_flags(docs), "filters-flags")
    # the first row of each text passes E; it is found by its own key, so no text is a hot key
    heads = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("k.h").alias("h")).select(F.struct("doc_id", "h").alias("k"), F.lit(True).alias("head"))
    keyed = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    words = word_totals(docs.select(keyed.alias("k"), "text"))
    flags = rows.join(words, "k", "left").join(heads, "k", "left")
    fails = {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < DISTINCT * F.col("n_words"),
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.col("head").isNull() & F.col("doc_id").isNotNull(),
    }
    failed = sum((F.when(fails[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))
    return flags.select("doc_id", "part", failed.alias("failed"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a (part, good, toxic) with the numbers of documents that fail exactly each
    of the 32 sets of filters."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures(docs).join(marks, "doc_id", "left").select("part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "failed")
    return rows.groupBy("part", "good", "toxic").agg(*[F.count_if(F.col("failed") == i).alias(c) for i, c in enumerate(COUNTS)])


def _over(counts: Column, share) -> Column:
    """The sum over all sets of failed filters of their count times ``share(set)``."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("bigint"), lambda s, m: s + F.get(counts, m) * share(m))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``: a row for each part, order of the filters and step."""
    counts = stage(failure_counts(docs, labels), "filters-counts")
    orders = ",".join("".join(p) for p in itertools.permutations(FILTERS))
    rows = counts.select("part", "good", "toxic", F.array(*COUNTS).alias("c"), F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    letters = F.split("filter_order", "")
    rows = rows.select("*", bit(F.expr("substring(filter_order, step, 1)")).alias("own"), F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda s, x: s + bit(x)).alias("before"))
    number = lambda *all_of: F.when(all_of[0] if len(all_of) == 1 else all_of[0] & all_of[1], F.lit(1)).otherwise(F.lit(0))
    has = lambda m: m.bitwiseAND(F.col("own")) != 0
    late = lambda m: m.bitwiseAND(F.col("before")) != 0
    total = 120  # orders; of those in which a document's failed filters stand, each is first as often
    rows = rows.select(
        "part", "filter_order", "step", "good", "toxic",
        _over(F.col("c"), lambda m: number(m.bitwiseAND(F.col("own").bitwiseOR(F.col("before"))) == 0)).alias("kept"),
        _over(F.col("c"), lambda m: number(has(m), ~late(m))).alias("removed"),
        _over(F.col("c"), lambda m: number(has(m), late(m))).alias("redundant"),
        _over(F.col("c"), lambda m: number(m == F.col("own"))).alias("unique_fails"),
        _over(F.col("c"), lambda m: F.when(has(m), (F.lit(total) / F.bit_count(m)).cast("bigint")).otherwise(F.lit(0))).alias("shapley"),
    )
    whole = [F.sum(c).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")]
    lost = [F.sum(F.col("removed") * F.col(mark)).alias(f"{mark}_lost") for mark in ("good", "toxic")]
    out = rows.groupBy("part", "filter_order", "step").agg(*whole, *lost, F.sum("shapley").alias("shapley"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return out.select(*names)
