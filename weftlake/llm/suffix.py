"""Repeated passages by a sparse suffix array.

A passage is ``L`` = ``min_words`` or more consecutive words (ASCII white space
separates them, A-Z counts as a-z) that occur again elsewhere. Every window of L
words has one anchor: among its first ``SPAN`` word positions the one whose next
``GRAM`` words have the least hash (leftmost of equals). Equal windows have equal
anchors, so only suffixes at anchors are retained, and those of equal windows share
their first L - SPAN + 1 words, the suffix key.

1. The retained suffixes are sorted over the cluster by (key, reach), reach being a
   hash of the words the anchor's windows span, L words or more to both sides.
   Neighbours with equal reach are copies of each other in all their windows.
2. Neighbours with equal keys but different reach match in part: the first suffix of
   each reach is extended left and right, one window at a time, and these windows
   are sorted and compared with their neighbours in the same way.
3. Windows add up to maximal spans by document.

The result is exact up to 64-bit hash collisions: a word is in a span just if it is
in a window of L words that occurs twice. Sorting goes by ranges that split a key
held by any number of rows, and a task compares rows with their neighbours only.

Defined results: null, empty and short texts have no passage; rows that repeat id
and text count as one document; a null id is an id of its own, ordered first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import bound_batches, drop_stage, fresh, stage

MIN_WORDS, SPAN, GRAM = 50, 30, 6
BLOCK_BITS = 20  # positions inside one block of a very long text
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The odd factor's and its inverse's powers modulo 2**64, n of them at least."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(raw: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, raw.lower().split())), ">u8").astype(np.uint64)


class Words:
    """Hashes of runs of words, from prefix sums of the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        up, self.down = _power(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * up[: self.n], out=self.sums[1:])

    def run(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of words first .. last - 1, for arrays of both."""
        return _mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def anchors(words: Words, length: int = MIN_WORDS, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors and the first and last start of their windows."""
    if words.n < length:
        return (np.empty(0, np.int64),) * 3
    at = np.arange(words.n - gram + 1)
    grams = words.run(at, at + gram)
    total = words.n - length + 1  # windows
    found, mask = [], np.uint64((1 << BLOCK_BITS) - 1)
    for lo in range(0, total, (1 << BLOCK_BITS) - span):
        hi = min(total, lo + (1 << BLOCK_BITS) - span)
        v = grams[lo : hi + span - 1] & ~mask | np.arange(hi + span - 1 - lo, dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            v = np.minimum(v[:-step], v[step:])
            width += step
        found.append((v & mask).astype(np.int64) + lo)
    p = np.concatenate(found)
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return p[first], first, np.r_[first[1:], total] - 1


def suffixes(docs: DataFrame, length: int = MIN_WORDS) -> DataFrame:
    """``key, reach, doc_id, rid, pos, lo, hi`` of the retained suffixes; rid names the
    (id, text) pair, lo and hi the starts of the anchor's windows."""
    bound_batches(docs.sparkSession)
    names = ["key", "reach", "doc_id", "rid", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple] = []
            owner: list[int] = []
            for i, text in enumerate(b.column(2).to_pylist()):
                words = Words(word_hashes((text or "").encode()))
                p, lo, hi = anchors(words, length)
                if len(p):
                    reach = _mix(words.run(lo, hi + length) + ((p - lo) * 4096 + hi - lo).astype(np.uint64))
                    parts.append((words.run(p, p + length - SPAN + 1).view(np.int64), reach.view(np.int64), lo, hi))
                    owner += [i] * len(p)
            if parts:
                key, reach, lo, hi = (np.concatenate(x) for x in zip(*parts))
                own = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(reach), b.column(0).take(own), b.column(1).take(own), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=names)

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")
    return rows.mapInArrow(run, "key bigint, reach bigint, doc_id bigint, rid bigint, lo int, hi int")


def _sorted(df: DataFrame, cols: list[Column | str]) -> DataFrame:
    """One order over the whole table; ranges take all columns, so equal keys are split."""
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols)


def compare_suffixes(found: DataFrame) -> DataFrame:
    """Neighbours in suffix order: ``doc_id, rid, lo, hi, what``; what is ``copy`` (all
    windows occur before, in the same reach), ``first`` (they occur again) or
    ``extend`` (other suffixes share the key, the windows have to be compared). Runs
    at the ends of a range may go on in the next one and are extended in any case."""
    cols = ["key", "reach", "doc_id", "rid", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev: tuple | None = None  # last row of the batch before
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            nonlocal out
            doc, rid, lo, hi, what = zip(*out)
            batch = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(rid, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(what, pa.string())], names=["doc_id", "rid", "lo", "hi", "what"])
            out = []
            return batch

        pending: tuple | None = None  # first suffix of the current run's only reach so far
        pending_known = False  # whether it has a copy
        mixed, edge = False, True  # the first run of a range may have begun before it
        for b in batches:
            key, reach = b.column(0).to_numpy(), b.column(1).to_numpy()
            doc, rid = b.column(2).to_pylist(), b.column(3).to_numpy()
            lo, hi = b.column(4).to_numpy(), b.column(5).to_numpy()
            same_key = np.r_[prev is not None and prev[0] == key[0], key[1:] == key[:-1]]
            # rows of keys that stand alone inside the batch need no look; the ends do
            look = same_key.copy()
            look[:-1] |= same_key[1:]
            look[0] = look[-1] = True
            for i in np.flatnonzero(look).tolist():
                row = (doc[i], int(rid[i]), int(lo[i]), int(hi[i]))
                k, r = key[i], reach[i]
                if prev is not None and k == prev[0]:
                    if r == prev[1]:
                        if row != prev[2]:
                            if pending is not None and not pending_known:
                                out.append((*pending, "first"))
                                pending_known = True
                            out.append((*row, "copy"))
                    else:
                        if not mixed and pending is not None and not edge:
                            out.append((*pending, "extend"))
                        mixed, pending, pending_known = True, row, False
                        out.append((*row, "extend"))
                else:
                    edge = prev is None
                    mixed, pending, pending_known = edge, row, False
                    if edge:
                        out.append((*row, "extend"))
                prev = (k, r, row)
            if len(out) >= 20_000:
                yield emit()
        if prev is not None and pending is not None and not mixed:  # the last run may go on in the next range
            out.append((*pending, "extend"))
        if out:
            yield emit()

    return _sorted(found.select(*cols), cols).mapInArrow(run, "doc_id bigint, rid bigint, lo int, hi int, what string")


def extend(docs: DataFrame, partial: DataFrame, length: int = MIN_WORDS) -> DataFrame:
    """``hash, doc_id, rid, start`` of the windows of suffixes to be extended."""
    spark = docs.sparkSession
    bound_batches(spark)
    wanted = partial.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text").join(wanted, "rid").select("doc_id", "rid", "text", F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, owner = [], []
            for i, (text, lo, hi) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                words = Words(word_hashes((text or "").encode()))
                starts = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi)]))
                parts.append((words.run(starts, starts + length).view(np.int64), starts))
                owner += [i] * len(starts)
            if parts:
                h, s = (np.concatenate(x) for x in zip(*parts))
                own = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(own), b.column(1).take(own), pa.array(s, pa.int32())], names=["hash", "doc_id", "rid", "start"])

    return rows.mapInArrow(run, "hash bigint, doc_id bigint, rid bigint, start int")


def compare_windows(found: DataFrame) -> DataFrame:
    """``doc_id, rid, lo, hi, what`` (copy or first) of windows with an equal
    neighbour in the order (hash, doc_id, rid, start). The first and the last row of
    each range are compared with those of the other ranges afterwards."""
    cols = ["hash", "doc_id", "rid", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev: tuple | None = None
        out = []  # hash, doc, rid, start, copy, again, edge

        def batch(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*cols, "copy", "again", "edge"])

        last: list | None = None  # undecided row
        for b in batches:
            h, rid, start = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            doc = b.column(1)
            same = np.r_[False, h[1:] == h[:-1]]
            look = same.copy()
            look[:-1] |= same[1:]
            look[0] = look[-1] = True
            at = np.flatnonzero(look)
            for i, d in zip(at.tolist(), doc.take(pa.array(at)).to_pylist()):
                row = [int(h[i]), d, int(rid[i]), int(start[i]), False, False, last is None]
                if last is not None:
                    if row[:4] == last[:4]:
                        continue
                    if row[0] == last[0]:
                        row[4] = row[5] = last[5] = True
                    if last[5] or last[6]:
                        out.append(last)
                last = row
            if len(out) >= 20_000:
                yield batch(out)
                out = []
        if last is not None:
            last[6] = True
            out.append(last)
        if out:
            yield batch(out)

    seen = stage(_sorted(found, cols).mapInArrow(run, "hash bigint, doc_id bigint, rid bigint, start int, copy boolean, again boolean, edge boolean"), "suffix-windows")
    place = F.struct("doc_id", "rid", "start")
    ends = seen.where("edge")  # two rows a range at most
    meet = ends.groupBy("hash").agg(F.min(place).alias("least"), F.count_distinct(F.coalesce("doc_id", F.lit(-1)), "rid", "start").alias("n")).where("n > 1").drop("n")
    ends = ends.join(meet, "hash", "left")
    ends = ends.withColumn("copy", F.col("copy") | (F.col("least").isNotNull() & ~place.eqNullSafe(F.col("least")))).withColumn("again", F.col("again") | F.col("least").isNotNull())
    every = seen.where("not edge").unionByName(ends.drop("least")).where("again")
    return every.select("doc_id", "rid", F.col("start").alias("lo"), F.col("start").alias("hi"), F.when(F.col("copy"), F.lit("copy")).otherwise(F.lit("first")).alias("what"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed word ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def repeats(docs: DataFrame, length: int = MIN_WORDS) -> DataFrame:
    """Documents with a repeated passage only: ``doc_id, rid, n_repeated, n_later,
    spans, later`` - numbers of words, and closed word ranges of all repeated passages
    and of those that occur before (in a smaller id, or further up)."""
    found = stage(suffixes(docs, length), "suffix-array")
    near = stage(compare_suffixes(found), "suffix-neighbours")
    drop_stage(found)
    windows = compare_windows(extend(docs, near.where("what = 'extend'"), length))
    every = near.where("what <> 'extend'").unionByName(windows)
    by_doc = every.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("lo", "hi", "what")).alias("w"))
    kind = "array<struct<first_word:bigint,last_word:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for w in b.column(2).to_pylist():
                both = merge([(x["lo"], x["hi"] + length - 1) for x in w])
                later = merge([(x["lo"], x["hi"] + length - 1) for x in w if x["what"] == "copy"])
                for c, v in zip(cols, (sum(y - x + 1 for x, y in both), sum(y - x + 1 for x, y in later), both, later)):
                    c.append(v)
            as_spans = lambda c: pa.array([[{"first_word": x, "last_word": y} for x, y in v] for v in c], t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), as_spans(cols[2]), as_spans(cols[3])], names=["doc_id", "rid", "n_repeated", "n_later", "spans", "later"])

    return by_doc.mapInArrow(run, f"doc_id bigint, rid bigint, n_repeated bigint, n_later bigint, spans {kind}, later {kind}")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word ranges and the white space after them."""
    raw = text.encode()
    word = ~SPACE[np.frombuffer(raw, np.uint8)]
    starts = np.r_[np.flatnonzero(word & np.r_[True, ~word[:-1]]), len(raw)]
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : starts[first]])
        at = int(starts[last + 1])
    return b"".join([*out, raw[at:]]).decode()


def drop_repeats(docs: DataFrame, length: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later copies of repeated passages; a document of which no
    word is left goes. Its other columns stay as they are, n_chars follows the text."""
    spark: SparkSession = docs.sparkSession
    cut = stage(repeats(docs, length).where("n_later > 0").select("rid", "later"), "suffix-cuts")
    bound_batches(spark)
    names = docs.columns
    at = names.index("text")
    rid, spans = fresh(docs, "_wl_rid"), fresh(docs, "_wl_cut")
    rows = docs.withColumn(rid, F.xxhash64("doc_id", "text")).join(cut.select(F.col("rid").alias(rid), F.col("later").alias(spans)), rid, "left")
    rows = rows.select(*names, F.col(f"{spans}.first_word").alias(rid), F.col(f"{spans}.last_word").alias(spans))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b.column(at).to_pylist(), []
            for i, (first, last) in enumerate(zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())):
                if first:
                    texts[i] = cut_words(texts[i], list(zip(first, last)))
                if not first or texts[i].strip():
                    keep.append(i)
            cols = [pa.array(texts, b.column(at).type) if j == at else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in cols], names=names)

    out = rows.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
