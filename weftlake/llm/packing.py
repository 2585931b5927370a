"""Packing token sequences by the linear grouping scheme and best fit.

Every document is encoded, closed with an end id and, only if longer than the
capacity, cut into pieces (the first takes the remainder). Lengths are integers up
to the capacity, so the whole problem is a histogram of at most ``capacity``
counts; the plan is made from it on the driver and grows with the capacity, not
with the data:

1. large lengths are sorted and put in groups of equal cardinality, each rounded
   up to its largest length;
2. a linear programme over the configurations of these few sizes is solved by
   column generation (a knapsack over the capacity names the one to enter);
3. configurations, rounded down, are filled with the actual lengths in order;
4. what is left over and all small lengths go, longest first, to the open sequence
   with the least room that takes them.

What counts as large is tried at three bounds, and the plan with the fewest sequences is
taken.

The plan is a table of runs (length, first rank, count, first sequence, offset);
pieces are ranked within their length by many tasks and look up their run.

Defined results: null and empty texts are one piece with the end id alone;
repeated rows are packed as separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import bound_batches, global_rank, parts_for, stage
from weftlake.llm.wordids import byte_signs

RANKED = 1_000  # rows of one length that one task ranks, about
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def plain_encoder(path: str):
    """Text -> list of ids by tiktoken, built from that very file, where it is a plain
    byte-level vocabulary; special tokens' strings are plain text. None otherwise."""
    import json

    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    byte_of = byte_signs()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    # the byte-level splitting rule of the library, a fixed value
    rule = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("same-vocabulary", pat_str=rule, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text -> unsigned 32-bit ids. The tokenizers library decides; where its file is
    a plain byte-level vocabulary, the same merges are run by tiktoken, several times as
    fast. Texts that hold a special token's string go to the tokenizers library itself."""
    import json

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    slow = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4")
    quick = plain_encoder(path)
    if not quick:
        return slow
    with open(path) as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    def fast(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        return np.array(quick(text), "<u4")

    return fast


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole unless longer than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece; ``with_ids`` adds the ids themselves."""
    bound_batches(docs.sparkSession, 256, 8)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.array([end_id], "<u4")).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row = [doc, k, s, n, zlib.crc32(part := ids[s : s + n].tobytes())] + [np.frombuffer(part, "<u4").astype("i4")] * with_ids
                    for c, v in zip(cols, row):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


# ---- the plan, from the histogram of lengths ----


def _groups(hist: dict[int, int], large: list[int], count: int) -> list[list[tuple[int, int, int]]]:
    """Equal-cardinality groups of the large items, longest first: each a list of runs
    (length, first rank, items)."""
    total = sum(hist[x] for x in large)
    size = -(-total // count)
    groups: list[list[tuple[int, int, int]]] = [[]]
    room = size
    for x in sorted(large, reverse=True):
        rank, left = 0, hist[x]
        while left:
            take = min(left, room)
            groups[-1].append((x, rank, take))
            rank, left, room = rank + take, left - take, room - take
            if not room:
                groups.append([])
                room = size
    return [g for g in groups if g]


def _best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``sizes`` that fits and is worth most, by a knapsack over the
    capacity: a round adds one more item, so there are ``capacity / min(sizes)`` at most.
    Memory is rounds times capacity."""
    rooms = np.arange(capacity + 1)
    left = rooms[:, None] - sizes + capacity  # places before the first stand for no room
    worth, chosen = np.zeros(capacity + 1), []
    low = np.full(capacity, -np.inf)
    for _ in range(capacity // int(sizes.min())):
        with_one = np.concatenate([low, worth])[left] + price
        pick = with_one.argmax(1)
        most = with_one[rooms, pick]
        better = most > worth + 1e-12
        if not better.any():
            break
        chosen.append(np.where(better, pick, -1))
        worth = np.where(better, most, worth)
    used, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            used[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(worth[capacity]), used


def _inverse(m: np.ndarray) -> np.ndarray:
    """By elimination, row by row: the driver's threaded matrix library can lock up
    beside a running JVM, so none of it is used here."""
    n = len(m)
    both = np.hstack([m.astype(float), np.eye(n)])
    for i in range(n):
        k = i + int(np.abs(both[i:, i]).argmax())
        if k != i:
            both[[i, k]] = both[[k, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def _solve(sizes: np.ndarray, need: np.ndarray, capacity: int, slack: float = 5e-4) -> list[tuple[np.ndarray, float]]:
    """min sum x over configurations that use each size as often as needed, by the revised
    simplex method with column generation: the basis starts with one size to a
    configuration, the configuration of best reduced cost enters. It ends when the sum is
    within ``slack`` of its lower bound (sum / best worth)."""
    n = len(need)
    basis = np.diag(capacity // sizes).astype(float)
    inv = np.diag(1.0 / np.diag(basis))
    x = need / np.diag(basis)
    for step in range(1, 40 * n + 1):
        worth, used = _best_configuration(sizes, inv.sum(0), capacity)
        if worth <= 1 + slack:
            break
        column = used.astype(float)
        d = (inv * column).sum(1)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        amount = ratio[out]
        x = np.maximum(x - amount * d, 0)
        x[out] = amount
        basis[:, out] = column
        row = inv[out] / d[out]
        inv = inv - d[:, None] * row
        inv[out] = row
        if step % 100 == 0:  # rounding does not pile up
            inv = _inverse(basis)
            x = np.maximum((inv * need).sum(1), 0)
    return [(basis[:, i].astype(int), float(x[i])) for i in range(n)]


def make_plan(hist: dict[int, int], capacity: int = 1024, groups: int = 128, large_over: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) for every item of the
    histogram, and the number of sequences."""
    plan: list[tuple[int, int, int, int, int]] = []
    seqs = 0
    large_over = capacity // 5 if large_over is None else large_over
    hist = {k: v for k, v in hist.items() if v}
    if n := hist.get(capacity, 0):
        plan.append((capacity, 0, n, 0, 0))
        seqs = n
    large = [x for x in hist if large_over < x < capacity]
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length -> [(first rank, items)]
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, sequences)]
    if large:
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for g in _groups(hist, large, groups):
            by_size.setdefault(g[0][0], []).extend(g)  # groups rounded to one size are one
        runs = list(by_size.values())
        for used, x in sorted(_solve(np.array(list(by_size)), np.array([float(sum(r[2] for r in g)) for g in runs]), capacity), key=lambda c: -c[1]):
            slots, m = [i for i, k in enumerate(used) for _ in range(k)], int(x + 1e-6)
            m = min([m, *(sum(r[2] for r in runs[i]) // used[i] for i in set(slots))])
            if not m:
                continue
            taken = []
            for i in slots:
                own, left = [], m
                while left:
                    length, rank, n = runs[i][0]
                    k = min(n, left)
                    own.append((length, rank, k))
                    left -= k
                    runs[i][0:1] = [(length, rank + k, n - k)] if n > k else []
                taken.append(own)
            at = 0
            ends = sorted({e for own in taken for e in np.cumsum([r[2] for r in own]).tolist()})
            heads = [[0, 0] for _ in taken]  # run, items used of it
            for e in ends:
                n, offset = e - at, 0
                for own, head in zip(taken, heads):
                    length, rank, k = own[head[0]]
                    plan.append((length, rank + head[1], n, seqs, offset))
                    offset += length
                    head[1] += n
                    if head[1] == k:
                        head[0], head[1] = head[0] + 1, 0
                if offset < capacity:
                    room[capacity - offset].append((seqs, n))
                seqs, at = seqs + n, e
        for g in runs:
            for length, rank, n in g:
                rest[length].append((rank, n))
    for x, n in hist.items():
        if x <= large_over and x < capacity:
            rest[x].append((0, n))
    for length in sorted(rest, reverse=True):
        for rank, n in rest[length]:
            while n:
                fits = min((r for r, v in room.items() if r >= length and v), default=None)
                if fits is None:
                    opened = -(-n // (capacity // length))
                    room[capacity].append((seqs, opened))
                    seqs += opened
                    continue
                first, bins = room[fits].pop()
                k = min(n, bins)
                plan.append((length, rank, k, first, capacity - fits))
                if k < bins:
                    room[fits].append((first + k, bins - k))
                if fits > length:
                    room[fits - length].append((first, k))
                rank, n = rank + k, n - k
    return plan, seqs


def best_plan(hist: dict[int, int], capacity: int = 1024, groups: int = 128) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan with the fewest sequences over three bounds of what is large: over a fifth,
    a third and half of the capacity. Over half, a configuration holds one length and
    rounding costs nothing, so a plan is never worse than best fit, longest first."""
    return min((make_plan(hist, capacity, groups, capacity // k) for k in (5, 3, 2)), key=lambda p: p[1])


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, groups: int = 128, with_ids: bool = False) -> DataFrame:
    """Pieces with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` and, with ``with_ids``, the ids."""
    spark = docs.sparkSession
    items = stage(pieces(docs, path, capacity, end_id, with_ids).withColumn("_wl_uid", F.monotonically_increasing_id()), "pack-pieces")
    hist = {r[0]: r[1] for r in items.groupBy("length").count().collect()}
    plan, _ = best_plan(hist, capacity, groups)
    runs = np.array(sorted(plan) or [(0, 0, 0, 0, 0)], np.int64)
    shared = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs))  # bounded by the capacity, see above
    # a common length is ranked by as many tasks as its rows need, at most a bucket for each length besides
    deal = F.element_at(F.split(F.lit(",".join(str(parts_for(hist.get(n, 0), RANKED)) for n in range(1, capacity + 1))), ",").cast("array<int>"), F.col("length").cast("int"))
    ranked = global_rank(items, ["length"], ["_wl_uid"], ["doc_id", "piece", "ids_crc32"], "_wl_rank", deal)
    names = [c for c in items.columns if c != "_wl_uid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for b in batches:
            length, rank = b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy()
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            place = [pa.array(row[:, 3] + rank - row[:, 1], pa.int64()), pa.array(row[:, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *place], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema if f.name in names) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, F.col("_wl_rank").cast("bigint")).mapInArrow(run, kinds)
