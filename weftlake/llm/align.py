"""How the tokens of two tokenizers over the same text correspond.

Both encode a text to tokens that cover the same bytes. A merge over the cumulative ends
of both sides, as it would go with two pointers, cuts the text into groups where both end
a token, and links the tokens whose byte ranges overlap. It runs over arrays inside of
Arrow functions, for many texts at once.

How many documents of the corpus hold a pair of ids linked, and which pair is an id's most
frequent, takes the whole corpus. Documents come in blocks (a row each: its documents'
pairs as numbers into the block's own list of distinct pairs), so what is grouped, joined
and shuffled is the blocks' distinct pairs instead of a row for each pair of each document:

1. blocks with their distinct pairs and the number of documents that hold each;
2. a sum over blocks gives the pairs' counts, two maxima those of each side;
3. counts are joined back to the blocks' pairs, gathered by block and summed up for each
   document over its links.

A pair has as many rows as there are blocks, whatever texts repeat, so no key is hot. Long
texts are encoded in parts, cut at single spaces between signs, where either side ends a
token; a document's groups are hashed as they come. Memory is bounded by a block's bytes
(``BLOCK_BYTES``, or one text's).

Defined results: null and empty texts, and those whose tokens of either side don't join
to space + text, have no tokens, zeros and no hash; rows that repeat an id or a text are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import bound_batches, stage
from weftlake.llm.tokencount import safe_parts
from weftlake.llm.wordids import byte_signs

BLOCK_ROWS, BLOCK_BYTES, CHUNK_BYTES = 1_024, 8 << 20, 1 << 21
SIDE = 1 << 32  # a pair is a * SIDE + b


class Side:
    """A vocabulary: ids of texts, each id's bytes and its number in digits."""

    def __init__(self, path: str, spaced: bool):
        self.encode, pieces = _piece_model(path) if path.endswith(".model") else _byte_level(path)
        self.before = " " if spaced else ""
        self.bytes = pieces
        self.length = np.array([len(x) for x in pieces], np.int64)
        # digits of each id and a place for the sign that follows
        wide = len(str(len(pieces) - 1)) + 1
        self.digits = np.zeros((len(pieces), wide), np.uint8)
        self.last = np.array([len(str(i)) for i in range(len(pieces))])
        for i in range(len(pieces)):
            self.digits[i, : self.last[i]] = np.frombuffer(str(i).encode(), np.uint8)


def _byte_level(path: str):
    """Special tokens' strings are plain text. The library's merges are run by tiktoken
    where the file is a plain byte-level one."""
    import json

    from tokenizers import Tokenizer

    from weftlake.llm.packing import plain_encoder

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    with open(path) as f:
        spec = json.load(f)
    signs = byte_signs()
    vocab = tok.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    added = {t["content"] for t in spec.get("added_tokens", [])}
    for word, i in vocab.items():
        pieces[i] = word.encode() if word in added else bytes(signs[c] for c in word)
    quick = plain_encoder(path)
    if quick:
        return (lambda texts: [quick(x) for x in texts]), pieces
    return (lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]), pieces


def _piece_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.vocab_size()):
        p = model.id_to_piece(i)
        pieces.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
    return (lambda texts: model.encode(texts, num_threads=1)), pieces


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    return Side(path_a, True), Side(path_b, False)


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.empty(0, np.int64), n


def merge(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two id sequences over the same bytes: the group of each token
    of either side, and for all links the places of both tokens."""
    ends_a, ends_b = np.cumsum(length_a), np.cumsum(length_b)
    total = int(ends_a[-1]) if len(a) else 0
    at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    at_a[ends_a], at_b[ends_b] = True, True
    shared_a, shared_b = at_b[ends_a], at_a[ends_b]
    group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
    holder = np.repeat(np.arange(len(b), dtype=np.int32), length_b)  # of each byte
    first = holder[ends_a - length_a]
    n = holder[ends_a - 1] - first + 1
    stop = np.cumsum(n)
    left = np.repeat(np.arange(len(a)), n)
    right = np.arange(int(stop[-1]) if len(a) else 0) - np.repeat(stop - n - first, n)
    return group_a, group_b, left, right


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, one: Side, two: Side) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups as bytes, and where each group ends in them."""
    n = int(group_a[-1]) + 1
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    ahead_a, ahead_b = np.cumsum(in_a), np.cumsum(in_b)
    place_a = np.arange(len(a)) + (ahead_b - in_b)[group_a]
    place_b = np.arange(len(b)) + ahead_a[group_b]
    wide = max(one.digits.shape[1], two.digits.shape[1])
    rows = np.zeros((len(a) + len(b), wide), np.uint8)
    for ids, place, group, side, end in ((a, place_a, group_a, one, b"|"), (b, place_b, group_b, two, b";")):
        part = side.digits[ids]
        closes = np.r_[group[1:] != group[:-1], True]
        part[np.arange(len(ids)), side.last[ids]] = np.where(closes, end[0], ord(","))
        rows[place, : part.shape[1]] = part
    size = np.empty(len(rows), np.int64)
    size[place_a], size[place_b] = one.last[a] + 1, two.last[b] + 1
    stops = np.cumsum(size)[ahead_a + ahead_b - 1]
    return rows[rows != 0], stops


class Block:
    """Documents that share a list of distinct pairs."""

    def __init__(self, one: Side, two: Side):
        self.one, self.two = one, two
        self.doc: list[int | None] = []
        self.n = []  # n_a, n_b, n_groups, n_links of each document
        self.hash: list = []
        self.bad: set[int] = set()
        self.pairs: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.bytes = 0
        self.parts: list[tuple[int, str]] = []
        self.waiting = 0

    def add(self, doc: int | None, text: str | None, model: str) -> None:
        k = len(self.doc)
        self.doc.append(doc)
        self.n.append([0, 0, 0, 0])
        self.hash.append(None)
        for part in safe_parts(text, model) if text else ():
            self.parts.append((k, part))
            size = len(part.encode(errors="surrogatepass"))
            self.waiting += size
            self.bytes += size
            if self.waiting >= CHUNK_BYTES:
                self.work()

    def work(self) -> None:
        """Align the parts that wait."""
        parts, self.parts, self.waiting = self.parts, [], 0
        if not parts:
            return
        one, two = self.one, self.two
        texts = [p for _, p in parts]
        found_a, found_b = one.encode([one.before + x for x in texts]), two.encode([two.before + x for x in texts])
        kept = []
        for j, ((k, text), x, y) in enumerate(zip(parts, found_a, found_b)):
            raw = (" " + text).encode()
            if b"".join([one.bytes[i] for i in x]) == raw and b"".join([two.bytes[i] for i in y]) == raw:
                kept.append(j)
            else:
                self.bad.add(k)
        kept = [j for j in kept if parts[j][0] not in self.bad]
        if not kept:
            return
        a, len_a = _flat([found_a[j] for j in kept])
        b, len_b = _flat([found_b[j] for j in kept])
        own = np.array([parts[j][0] for j in kept])
        group_a, group_b, left, right = merge(a, b, one.length[a], two.length[b])
        text, stops = _written(a, b, group_a, group_b, one, two)
        at_a = np.cumsum(len_a)
        last = group_a[at_a - 1]  # of each part; a part's end is a group's end
        owner_a = np.repeat(own, len_a)
        owner = owner_a[left]
        n_links = np.bincount(owner, minlength=len(self.doc))
        ends = stops[last].tolist()
        groups = np.diff(last, prepend=-1).tolist()
        for j, (k, x, y, g, lo, hi) in enumerate(zip(own.tolist(), len_a.tolist(), len_b.tolist(), groups, [0, *ends], ends)):
            n = self.n[k]
            n[0] += x
            n[1] += y
            n[2] += g
            if self.hash[k] is None:
                self.hash[k] = hashlib.sha256()
            else:
                self.hash[k].update(b";")
            self.hash[k].update(text[lo : hi - 1])
        for k in set(own.tolist()):
            self.n[k][3] += int(n_links[k])
        self.pairs.append(a[left] * SIDE + b[right])
        self.owner.append(owner)

    def row(self, number: int) -> dict:
        self.work()
        pair = np.concatenate([np.empty(0, np.int64), *self.pairs])
        owner = np.concatenate([np.empty(0, np.int64), *self.owner]).astype(np.int64)
        if self.bad:  # found in a part after others were taken
            good = ~np.isin(owner, list(self.bad))
            pair, owner = pair[good], owner[good]
        for k in self.bad:
            self.n[k], self.hash[k] = [0, 0, 0, 0], None
        distinct, which = np.unique(pair, return_inverse=True)
        key = np.sort(owner * len(distinct) + which) if len(distinct) else owner
        ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) if len(key) else np.empty(0, np.int64)
        times = np.diff(ends, prepend=-1)
        key = key[ends]
        of, which = (key // len(distinct), key % len(distinct)) if len(distinct) else (key, key)
        held = np.bincount(which, minlength=len(distinct))
        n = np.array(self.n, np.int64).reshape(-1, 4)
        # within a document the numbers of its pairs rise: their steps compress well
        step = np.diff(which, prepend=0)
        heads = np.r_[True, of[1:] != of[:-1]] if len(of) else np.empty(0, bool)
        step[heads] = which[heads]
        squeeze = lambda x: pa.compress(np.ascontiguousarray(x, "<u4").tobytes(), codec="zstd", asbytes=True)
        return {
            "block": number, "doc_id": self.doc, "n_a": n[:, 0], "n_b": n[:, 1], "n_groups": n[:, 2], "n_links": n[:, 3],
            "sha": ["" if h is None else h.hexdigest() for h in self.hash], "n_pairs": np.bincount(of, minlength=len(self.doc)),
            "steps": squeeze(step), "times": squeeze(times), "pair": distinct, "held": held,
        }


_long = pa.list_(pa.int64())
BLOCKS = pa.schema([("block", pa.int64()), *[(c, _long) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("sha", pa.list_(pa.string())), ("n_pairs", _long), ("steps", pa.binary()), ("times", pa.binary()), ("pair", _long), ("held", _long)])
BLOCKS_SQL = "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, n_pairs array<bigint>, steps binary, times binary, pair array<bigint>, held array<bigint>"


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligned documents in blocks; each is numbered by its task and place in it."""
    bound_batches(docs.sparkSession, 256, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, (one, two) = TaskContext.get().partitionId() << 32, sides(path_a, path_b)
        now = Block(one, two)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now.add(doc, text, path_b)
                if len(now.doc) >= BLOCK_ROWS or now.bytes >= BLOCK_BYTES:
                    yield _one_row(now.row(number))
                    number, now = number + 1, Block(one, two)
        if now.doc:
            yield _one_row(now.row(number))

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS_SQL)


def _one_row(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in BLOCKS], schema=BLOCKS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a, b, n, best_a, best_b`` of every linked pair of ids: the number of
    documents that hold it, and whether no other pair of its ids has more."""
    each = aligned.select(F.explode(F.arrays_zip("pair", "held")).alias("x")).select("x.pair", "x.held")
    ids = [F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(SIDE - 1)).cast("int").alias("b")]
    counts = stage(each.groupBy("pair").agg(F.sum("held").alias("n")).select("pair", *ids, "n"), "align-counts")
    most_a = counts.groupBy("a").agg(F.max("n").alias("most_a"))
    most_b = counts.groupBy("b").agg(F.max("n").alias("most_b"))
    joined = counts.join(most_a, "a").join(most_b, "b")
    return joined.select("pair", "a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_best_b")], ("groups_sha256", pa.string())])


def _totals(x: dict) -> pa.RecordBatch:
    """The documents of a block with what the pairs' counts add up to."""
    known = x["known"] or []
    n = np.array([k["n"] for k in known], np.int64)
    best_a, best_b = (np.array([k[c] for k in known], np.int64) for c in ("best_a", "best_b"))
    of = np.repeat(np.arange(len(x["doc_id"])), x["n_pairs"])
    spread = lambda c: np.frombuffer(pa.decompress(x[c], decompressed_size=4 * len(of), codec="zstd", asbytes=True), "<u4").astype(np.int64) if len(of) else np.empty(0, np.int64)
    step, times = spread("steps"), spread("times")
    total = np.cumsum(step)
    heads = np.r_[True, of[1:] != of[:-1]] if len(of) else np.empty(0, bool)
    before = (total - step)[heads]
    which = total - np.repeat(before, np.diff(np.flatnonzero(np.r_[heads, True]))) if len(of) else total

    def add(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x["doc_id"]), np.int64)
        if len(of):
            out[of[heads]] = np.add.reduceat(v[which] * times, np.flatnonzero(heads))
        return out

    cols = [x["doc_id"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], add(best_a), add(n), add(best_b), x["sha"]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RESULT)], schema=RESULT)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b``
    of every row."""
    aligned = stage(blocks(docs, path_a, path_b), "align-blocks")
    known = stage(pair_counts(aligned), "align-known").select("pair", F.struct("pair", "n", "best_a", "best_b").alias("k"))
    own = aligned.select("block", F.explode("pair").alias("pair")).join(known, "pair")
    back = stage(own.groupBy("block").agg(F.sort_array(F.collect_list("k")).alias("known")), "align-back")  # as many as the block has pairs
    whole = aligned.drop("pair", "held").join(back, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield _totals(b.slice(i, 1).to_pylist()[0])

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b"]
    kinds = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, n_best_b bigint, groups_sha256 string"
    return whole.mapInArrow(run, kinds).select(*names)
