"""Token ids in files compressed by a grammar, readable at any place.

Re-Pair: within a block of ids the most frequent neighbouring pairs are replaced by new
symbols (nonterminals), again and again; the rules and the length each of them expands to
are stored beside the remaining symbols. Pairs do not cross documents, so a document is a
run of symbols, and the lengths lead to any place inside of it without expanding what
stands before.

Each round replaces up to ``WIDTH`` pairs at once. Where chosen pairs overlap, the more
frequent one goes first, among equals the leftmost; what is left over has its turn in the
next round. Rounds end after ``ROUNDS`` or when no pair is left ``LEAST`` times.

A file is a list of blocks of up to ``BLOCK`` ids and a footer that says where each starts::

    RPR1
    block   n_docs, base, n_rules, n_symbols, width    5 * u32
            id i64 * n_docs, flags u8 * n_docs (1: null id, 2: goes on in the next block),
            tokens u32 * n_docs, symbols u32 * n_docs
            rules 2 * width * n_rules, lengths u32 * n_rules, symbols width * n_symbols
    footer  place of each block u64 * n_blocks, n_blocks u64, n_docs u64, n_tokens u64, RPR1

All numbers are little-endian; width is 2 bytes where all symbols fit, else 4. A document
longer than a block goes on in the next one of its file, so memory is bounded by a block
and the longest text.

:func:`write` deals the documents by ranges of doc_id, writes files from the tasks (under
another name until they are whole, and the same bytes whenever a task is repeated) and
returns their list; :func:`read` reads them back. Defined results: null and empty texts
have the end id alone; null ids come first; rows that repeat an id follow each other in
the order of their texts' hash, equal rows in the order they were read; an empty table
gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlake.llm.common import bound_batches, shared_dir, stage
from weftlake.llm.wordids import words

MAGIC = b"RPR1"
WIDTH, ROUNDS, LEAST = 2_600, 6, 16
BLOCK, FILE = 1 << 20, 1 << 22  # ids
SLOTS = 16  # bits of the table of chosen pairs
VOCABULARY = 49_408  # ids of the usual vocabulary; with all rules, symbols take two bytes
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- grammar ----


def _chosen(code: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs and their numbers, most frequent first; of pairs that meet
    in a slot of the table only the first (the other one's turn comes later)."""
    ordered = np.sort(code)
    ends = np.flatnonzero(np.r_[ordered[1:] != ordered[:-1], True])
    n = np.diff(ends, prepend=-1)
    often = np.flatnonzero((n >= least) & (ordered[ends] >= 0))
    often = often[np.lexsort((ordered[ends[often]], -n[often]))[:width]]
    pairs, n = ordered[ends[often]], n[often]
    _, first = np.unique(_slot(pairs), return_index=True)
    first.sort()
    return pairs[first], n[first]


def _slot(code: np.ndarray) -> np.ndarray:
    return (code.view(np.uint64) * _ODD) >> np.uint64(64 - SLOTS)


def _places(code: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs to replace, no two next to each other, and which pair it is."""
    table = np.full(1 << SLOTS, -1, np.int32)
    table[_slot(pairs)] = np.arange(len(pairs), dtype=np.int32)
    which = table[_slot(code)]
    at = np.flatnonzero(which >= 0)
    at = at[pairs[which[at]] == code[at]]
    which = which[at]
    weight, beside = n[which], at[1:] == at[:-1] + 1
    beaten = np.zeros(len(at), bool)
    beaten[1:] |= beside & (weight[1:] < weight[:-1])
    beaten[:-1] |= beside & (weight[:-1] < weight[1:])
    at, which = at[~beaten], which[~beaten]
    # what still overlaps is equally frequent: every other one from the left
    head = np.r_[True, at[1:] != at[:-1] + 1] if len(at) else np.empty(0, bool)
    run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0)) if len(at) else at
    return at[run % 2 == 0], which[run % 2 == 0]


def compress(ids: np.ndarray, starts: np.ndarray, base: int, rounds: int = ROUNDS, width: int = WIDTH, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n, 2), the remaining symbols and where each document starts among them.
    ``starts`` are the documents' first places, the first 0; nonterminal i is ``base + i``."""
    seq, rules = ids.astype(np.int64), [np.empty((0, 2), np.int64)]
    top = base
    for _ in range(rounds):
        if len(seq) < 2:
            break
        code = seq[:-1] << 32 | seq[1:]
        inner = starts[(starts > 0) & (starts < len(seq))]
        code[inner - 1] = -1
        pairs, n = _chosen(code, width, least)
        if not len(pairs):
            break
        at, which = _places(code, pairs, n)
        used = np.bincount(which, minlength=len(pairs)) >= 2  # a rule used once saves nothing
        at, which = at[used[which]], which[used[which]]
        if not len(at):
            break
        number = np.cumsum(used) - 1
        rules.append(np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1))
        seq[at] = top + number[which]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        starts = starts - np.searchsorted(at + 1, starts)  # a document's start is never the second of a pair
        seq = seq[keep]
        top += int(used.sum())
    return np.concatenate(rules), seq, starts


class Grammar:
    """Expansions of all symbols, one after the other in one array."""

    def __init__(self, base: int, rules: np.ndarray):
        self.length = np.concatenate([np.ones(base, np.int64), np.zeros(len(rules), np.int64)])
        self.at = np.concatenate([np.arange(base), np.zeros(len(rules), np.int64)])
        self.flat = np.arange(base, dtype=np.uint32)
        done = 0
        while done < len(rules):  # rules over symbols that are known go together
            later = np.flatnonzero(rules[done:].max(1) >= base + done)
            stop = done + int(later[0]) if len(later) else len(rules)
            part = rules[done:stop].astype(np.int64)
            size = self.length[part].sum(1)
            self.length[base + done : base + stop] = size
            self.at[base + done : base + stop] = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, self.expand(part.ravel())])
            done = stop

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        shift = self.at[symbols] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))]


# ---- files ----


@dataclass
class Block:
    """One block of a file, as it is stored."""

    doc: np.ndarray
    flags: np.ndarray
    tokens: np.ndarray
    symbols_of: np.ndarray
    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def pack(self) -> bytes:
        width = 2 if self.base + len(self.rules) <= 1 << 16 else 4
        kind = f"<u{width}"
        head = struct.pack("<5I", len(self.doc), self.base, len(self.rules), len(self.symbols), width)
        return b"".join([head, self.doc.astype("<i8").tobytes(), self.flags.astype("u1").tobytes(), self.tokens.astype("<u4").tobytes(), self.symbols_of.astype("<u4").tobytes(), self.rules.astype(kind).tobytes(), self.lengths.astype("<u4").tobytes(), self.symbols.astype(kind).tobytes()])

    @classmethod
    def unpack(cls, raw: bytes, at: int) -> Block:
        n, base, r, s, width = struct.unpack_from("<5I", raw, at)
        at += 20
        out = []
        for kind, count in (("<i8", n), ("u1", n), ("<u4", n), ("<u4", n), (f"<u{width}", 2 * r), ("<u4", r), (f"<u{width}", s)):
            out.append(np.frombuffer(raw, kind, count, at))
            at += out[-1].nbytes
        doc, flags, tokens, symbols_of, rules, lengths, symbols = out
        return cls(doc, flags, tokens, symbols_of, base, rules.reshape(-1, 2), lengths, symbols)

    def ids(self) -> np.ndarray:
        return Grammar(self.base, self.rules).expand(self.symbols.astype(np.int64))

    def slice(self, k: int, first: int, last: int) -> np.ndarray:
        """Ids ``first`` .. ``last`` - 1 of the block's k-th document; only the symbols that
        cover them are expanded."""
        ends = np.cumsum(self.symbols_of.astype(np.int64))
        own = self.symbols[ends[k] - self.symbols_of[k] : ends[k]].astype(np.int64)
        size = np.where(own < self.base, 1, self.lengths[np.maximum(own - self.base, 0)] if len(self.lengths) else 1).astype(np.int64)
        stop = np.cumsum(size)
        lo, hi = np.searchsorted(stop, first, "right"), np.searchsorted(stop, last, "left") + 1
        skipped = int(stop[lo - 1]) if lo else 0
        out: list[int] = []
        todo = own[lo:hi][::-1].tolist()
        while todo:  # depth is bounded by the rounds, output by what was asked for
            x = todo.pop()
            if x < self.base:
                out.append(x)
            else:
                todo += self.rules[x - self.base][::-1].tolist()
        return np.array(out[first - skipped : last - skipped], "<u4")


class File:
    """A whole file's bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or raw[-4:] != MAGIC:
            raise ValueError("not a whole file of this format")
        self.raw = raw
        n_blocks, self.n_docs, self.n_tokens = struct.unpack_from("<3Q", raw, len(raw) - 28)
        self.places = np.frombuffer(raw, "<u8", n_blocks, len(raw) - 28 - 8 * n_blocks).tolist()

    def blocks(self) -> Iterator[Block]:
        return (Block.unpack(self.raw, at) for at in self.places)

    def document(self, number: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` .. ``last`` - 1 of the file's document of that number."""
        out, passed = [], 0
        for b in self.blocks():
            whole = int((b.flags & 2 == 0).sum())
            if number >= whole + (b.flags[-1] & 2 != 0):
                number -= whole
                continue
            n = int(b.tokens[number])
            lo, hi = max(0, first - passed), n if last is None else min(n, last - passed)
            if hi > lo:
                out.append(b.slice(number, lo, hi))
            passed += n
            if not b.flags[number] & 2 or last is not None and passed >= last:
                return np.concatenate(out) if out else np.empty(0, "<u4")
            number = 0
        raise IndexError("no such document")


class Writer:
    """Gathers documents to blocks and blocks to a file's bytes."""

    def __init__(self, base: int, block: int = BLOCK):
        self.base, self.size = base, block
        self.out, self.places, self.at = [MAGIC], [], 4
        self.n_docs = self.n_tokens = 0
        self.held: list[tuple[int | None, int, np.ndarray]] = []
        self.room = block

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.n_docs += 1
        self.n_tokens += len(ids)
        while len(ids) > self.room:
            self.held.append((doc, 2, ids[: self.room]))
            ids = ids[self.room :]
            self.flush()
        self.held.append((doc, 0, ids))
        self.room -= len(ids)
        if not self.room:
            self.flush()

    def flush(self) -> None:
        if self.held:
            tokens = np.array([len(x) for _, _, x in self.held])
            ids = np.concatenate([x for _, _, x in self.held])
            base = max(self.base, int(ids.max()) + 1)
            rules, symbols, starts = compress(ids, np.cumsum(tokens) - tokens, base)
            doc = np.array([0 if d is None else d for d, _, _ in self.held], np.int64)
            flags = np.array([f | (d is None) for d, f, _ in self.held])
            packed = Block(doc, flags, tokens, np.diff(starts, append=len(symbols)), base, rules, Grammar(base, rules).length[base:], symbols).pack()
            self.places.append(self.at)
            self.out.append(packed)
            self.at += len(packed)
        self.held, self.room = [], self.size

    def finish(self) -> bytes:
        self.flush()
        self.out.append(np.array(self.places, "<u8").tobytes() + struct.pack("<3Q", len(self.places), self.n_docs, self.n_tokens) + MAGIC)
        return b"".join(self.out)


# ---- Spark ----


def _put(folder: str, name: str, raw: bytes) -> None:
    """Write a file whole or not at all."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(raw)
    system.move(part, f"{path}/{name}")


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, base: int = VOCABULARY) -> DataFrame:
    """The ids of all documents go to files below ``folder``, once the returned list is written:
    ``name, part, seq, n_docs, n_tokens``. ``base`` is at least the number of ids of the
    vocabulary; a block with a larger id counts from that one on."""
    bound_batches(docs.sparkSession, 256, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        ids_of, w = words(tokenizer).ids, Writer(base)

        def done() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}.rpr"
            _put(folder, name, w.finish())
            return pa.RecordBatch.from_pylist([{"name": name, "part": part, "seq": seq, "n_docs": w.n_docs, "n_tokens": w.n_tokens}], LISTED)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w.add(doc, np.frombuffer(ids_of(text or "") + end, "<u4"))
                if w.n_tokens >= FILE:
                    yield done()
                    seq, w = seq + 1, Writer(base)
        if w.n_docs:
            yield done()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"))
    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("i")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return dealt.mapInArrow(run, "name string, part int, seq int, n_docs bigint, n_tokens bigint")


LISTED = pa.schema([("name", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("name", pa.string()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _decoded(name: str, raw: bytes) -> pa.RecordBatch:
    """A row for each document of a file, from its expanded ids."""
    doc, n, crc, open_ = [], [], [], False
    for b in File(raw).blocks():
        ids = b.ids().astype("<u4")
        ends = np.cumsum(b.tokens.astype(np.int64)).tolist()
        for k, (flag, stop) in enumerate(zip(b.flags.tolist(), ends)):
            own = ids[ends[k - 1] if k else 0 : stop]
            if open_:
                n[-1] += len(own)
                crc[-1] = zlib.crc32(own, crc[-1])
            else:
                doc.append(None if flag & 1 else int(b.doc[k]))
                n.append(len(own))
                crc.append(zlib.crc32(own))
            open_ = bool(flag & 2)
    first = np.cumsum(n) - n if n else n
    return pa.RecordBatch.from_arrays([pa.array([name] * len(doc)), pa.array(range(len(doc)), pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=READ)


def file_starts(files: DataFrame) -> DataFrame:
    """``name, before``: ids in all files before each. Files are summed up within their
    part; of the parts, as many as tasks have written, the sums are gathered."""
    parts = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for part, n in parts:
        before[part], total = total, total + n
    listed = F.split(F.lit(",".join(str(before.get(p, 0)) for p in range(max(before, default=0) + 1))), ",").cast("array<bigint>")
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return files.select("name", (F.get(listed, F.col("part")) + own).alias("before"))


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, file, nth`` of every document in the listed
    files, ``nth`` being its number in the file."""
    bound_batches(spark, 64, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                yield _decoded(name, raw.as_py())

    if not files.take(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string, nth bigint")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.rpr").load(folder)
    rows = there.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "name string, nth bigint, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(file_starts(files), "name").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("file"), "nth")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents below the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = stage(write(docs, tokenizer, folder, end_id), "ids-files")
    return read(spark, folder, files)
