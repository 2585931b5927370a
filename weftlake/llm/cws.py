"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are white-space words, weighted by their number in the text. For sample j and
term x, uniform numbers derived from hashes of (x, j) give r, c ~ Gamma(2, 1) and
b ~ U(0, 1); with weight w, t = floor(ln w / r + b), ln y = r (t - b) and
ln a = ln c - ln y - r. The sample's value is (x, t) of the least a: two texts
agree on it with a probability equal to their generalised Jaccard similarity
sum(min) / sum(max) of the weights (Ioffe's scheme). A fingerprint holds a 32-bit
code of each sample's (x, t).

Every text is paired with the next document's in descending id order. Rows are cut
into ranges of about equal size over (id, hash of the text), so neither an outlying id
nor a repeated or null one makes a large range; each range also gets the first row of
the next, and the pairing is a window inside the range.

Defined results: a null text counts as empty; a text without words has the
fingerprint of zeros and is like another such text by 1; rows that repeat an id are
ordered by the hash of their text (rows that repeat both stay in one range); a null id
comes last; the only row of a table
follows itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlake.llm.common import parts_for, stage

SAMPLES, BLOCK_ROWS, BLOCKS = 32, 1_000, 16_384  # at 100 TB a block holds some million rows, which the window spills
MASK21, MASK32 = (1 << 21) - 1, (1 << 32) - 1


def _uniform(h: Column, shift: int) -> Column:
    """A number inside (0, 1) from 21 bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(MASK21)) + F.lit(0.5)) / F.lit(float(1 << 21))


def sample_key(term: Column, log_w: Column, j: int) -> Column:
    """The order of ln a in the upper bits, the code of (term, t) in the lower 32."""
    h1, h2 = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    r = -F.ln(_uniform(h1, 0) * _uniform(h1, 21))
    log_c = F.ln(-F.ln(_uniform(h2, 0) * _uniform(h2, 21)))
    b = _uniform(h1, 42)
    t = F.floor(log_w / r + b)
    log_a = log_c - r * (t - b) - r
    code = h2.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(MASK32))
    order = F.floor((F.least(F.greatest(log_a, F.lit(-63.9)), F.lit(63.9)) + 64) * F.lit(float(1 << 24)))
    return F.shiftleft(order, 32).bitwiseOR(code)


def term_hashes(text: Column) -> Column:
    """The sorted hashes of a text's words; equal words stand together."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _runs(hashes: str) -> Column:
    """Where each distinct word starts in the sorted hashes."""
    s = F.col(hashes)
    heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    return F.when(F.size(s) > 0, heads).otherwise(F.array().cast("array<int>"))


def signatures(rows: DataFrame, key: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``key, sig array<bigint>`` of every row, sig null for a text without words.
    ``key`` has to name a row. A row's terms are made where its text is, so the sums
    over them are complete before anything is shuffled."""
    rows = rows.select(*key, term_hashes(F.col(text)).alias("_s"))
    rows = rows.select(*key, "_s", _runs("_s").alias("_p"))
    entries = F.transform("_p", lambda p, j: F.struct(F.get("_s", p).alias("term"), F.ln((F.coalesce(F.get("_p", j + 1), F.size("_s")) - p).cast("double")).alias("lw")))
    rows = rows.select(*key, F.explode_outer(entries).alias("e")).select(*key, F.col("e.term").alias("term"), F.col("e.lw").alias("lw"))
    least = [F.min(F.when(F.col("lw").isNotNull(), sample_key(F.col("term"), F.col("lw"), j))).alias(f"m{j}") for j in range(samples)]
    found = rows.groupBy(*key).agg(*least)
    sig = F.when(F.col("m0").isNotNull(), F.array(*[F.col(f"m{j}").bitwiseAND(F.lit(MASK32)).cast("bigint") for j in range(samples)]))
    return found.select(*key, sig.alias("sig"))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal samples; texts without words (null signatures) are like each other only."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def as_text(sig: Column, samples: int) -> Column:
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit("0" * 8 * samples))


def block_bounds(rows: DataFrame, per_block: int) -> list[tuple]:
    """Least and greatest (k, th) of ranges of about equal size, in order; rows of one k
    and th are never cut. At most ``BLOCKS`` come to the driver, whatever the table's size."""
    total = rows.count()
    count = min(BLOCKS, parts_for(total, per_block))
    ends = rows.select("k", "th").repartitionByRange(count, "k", "th").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "th")).alias("lo"), F.max(F.struct("k", "th")).alias("hi"))
    return sorted((tuple(r["lo"]), tuple(r["hi"])) for r in ends.collect())


def _block_of(bounds: list[tuple]) -> Column:
    """The number of the range that (k, th) falls into, by halving over a constant array."""
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    lows = [lo for lo, _ in bounds]
    ks, hs = constant([k for k, _ in lows]), constant([h for _, h in lows])
    steps = [1 << i for i in reversed(range(max(1, (len(lows) - 1).bit_length())))]

    def ahead(at: Column, step: Column) -> Column:
        there = at + step
        k, h = F.get(ks, there), F.get(hs, there)
        return F.when((there < len(lows)) & ((k < F.col("k")) | ((k == F.col("k")) & (h <= F.col("th")))), there).otherwise(at)

    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), ahead)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``block, rn`` (a row's name), and the next row's
    ``next_text, nb, nrn`` in descending id order, the last being followed by the first."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("th"))
    bounds = block_bounds(rows, BLOCK_ROWS) or [((0, 0), (0, 0))]
    rows = rows.withColumn("block", _block_of(bounds))
    # the greatest row of each block is also given to the block above, whose last row it follows
    tops = [(hi[0], hi[1], i, (i + 1) % len(bounds)) for i, (_, hi) in enumerate(bounds)]
    first = spark.createDataFrame(tops, "k bigint, th bigint, home int, to int")
    extra = rows.drop("block").join(F.broadcast(first), ["k", "th"]).dropDuplicates(["home"])  # at most BLOCKS rows
    cols = ["doc_id", "text", "k", "th"]
    both = rows.select(*cols, "block", F.col("block").alias("home"), F.lit(0).alias("late")).unionByName(extra.select(*cols, F.col("to").alias("block"), "home", F.lit(1).alias("late")))
    order = Window.partitionBy("block").orderBy("late", F.desc("k"), F.desc("th"))
    rn = F.row_number().over(order)
    both = both.withColumn("rn", F.when(F.col("late") == 1, F.lit(1)).otherwise(rn))
    ahead = lambda c: F.lead(c).over(order)
    return both.select("doc_id", "text", "block", "rn", "late", ahead("text").alias("next_text"), ahead("home").alias("nb"), ahead("rn").alias("nrn")).where("late = 0").drop("late")


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` of every row; the edited text has its last
    floor(n / 2) characters replaced by the first as many of the next document's."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs.select("doc_id", "text"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "block", "rn", "nb", "nrn", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    facts = ["doc_id", "block", "rn", "nb", "nrn", "n_chars"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t"))))
    rows = rows.select(*facts, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sides.alias("v")).select(*facts, "edited_sha256", "v.side", "v.t")
    key = [*facts, "edited_sha256", "side"]
    found = stage(signatures(rows, key, "t", samples), "cws-signatures")
    own, changed = found.where("side = 0"), found.where("side = 1").select("block", "rn", F.col("sig").alias("sig1"))
    nxt = found.where("side = 0").select(F.col("block").alias("nb"), F.col("rn").alias("nrn"), F.col("sig").alias("sig2"))
    out = own.join(changed, ["block", "rn"]).join(nxt, ["nb", "nrn"])
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig"), samples).alias("fingerprint"), as_text(F.col("sig1"), samples).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("sig1"), samples).alias("near_edited"), likeness(F.col("sig"), F.col("sig2"), samples).alias("near_next"))
