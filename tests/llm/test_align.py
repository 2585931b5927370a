"""Alignment of two tokenizers against two pointers and loops over the whole corpus."""

import collections
import hashlib
import random

import pytest

from weftlake.llm import align
from weftlake.llm.queries import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in kept]
    value = {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(other)}

    def first(text):
        ids = tok.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(value[c] for c in tok.id_to_token(i))) for i in ids]

    def second(text):
        out = []
        for i in model.encode(text):
            p = model.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    return first, second


def brute(rows, encoders):
    found = []
    for doc, text in rows:
        a, b = (e(text) if text else [] for e in encoders)
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != raw for side in (a, b)):
            found.append((doc, 0, 0, [], []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        groups, links, i, j = [], [], 0, 0
        one, two = [], []
        while i < len(spans[0]) or j < len(spans[1]):
            end_a = spans[0][i - 1][2] if i else 0
            end_b = spans[1][j - 1][2] if j else 0
            if end_a <= end_b:
                one.append(spans[0][i][0])
                i += 1
            else:
                two.append(spans[1][j][0])
                j += 1
            if i and j and spans[0][i - 1][2] == spans[1][j - 1][2]:
                groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
                one, two = [], []
        at = 0
        for x, lo, hi in spans[0]:
            while spans[1][at][2] <= lo:
                at += 1
            k = at
            while k < len(spans[1]) and spans[1][k][1] < hi:
                links.append((x, spans[1][k][0]))
                k += 1
        found.append((doc, len(a), len(b), groups, links))
    n = collections.Counter(p for *_, links in found for p in set(links))
    most_a, most_b = collections.Counter(), collections.Counter()
    for (x, y), c in n.items():
        most_a[x], most_b[y] = max(most_a[x], c), max(most_b[y], c)
    out = []
    for doc, n_a, n_b, groups, links in found:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(n[p] == most_a[p[0]] for p in links), sum(n[p] for p in links), sha, sum(n[p] == most_b[p[1]] for p in links)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def aligned(docs):
    return sorted((tuple(r) for r in align.alignments(docs, A, B).collect()), key=key)


def test_table(spark, sf, encoders):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert aligned(docs.repartition(5)) == sorted(brute(rows, encoders), key=key)


def hostile(seed, n):
    rng = random.Random(seed)
    signs = "etaoinshrdluETAOIN'sé ñÑçµªº²½ßÅÀÿŀİıſǅ0129.,-!?<|>endoftext­ \x85\x1c\x0b\x0c\r\n\t́Σσς中文日本☃😀한글 ẞﬁ▁\x00\x01   "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    texts += ["".join(rng.choice("etaoinshrdlu   ,.\n") for _ in range(rng.randrange(1, 90))) for _ in range(n)]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


def test_hostile_texts_in_parts(spark, encoders, monkeypatch):
    """Small blocks and parts: hashes run on over parts, counts over blocks."""
    rows = hostile(2, 300) + [(1, None), (2, ""), (2, " "), (3, "<|endoftext|> <s> </s>"), (3, "a▁b and more"), (4, "word " * 900 + "▁" + " word" * 900)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, pair int, block int")
    want = sorted(brute(rows, encoders), key=key)
    assert aligned(docs) == want
    # the whole path inside one process, with blocks and parts of a few texts
    monkeypatch.setattr(align, "CHUNK_BYTES", 300)
    monkeypatch.setattr(align, "safe_parts", lambda t, p: safe(t, p, 20))
    one, two = align.sides(A, B)
    block = align.Block(one, two)
    for d, t in rows:
        block.add(d, t, B)
    row = block.row(0)
    got = sorted(zip(row["doc_id"], row["n_a"].tolist(), row["n_b"].tolist(), row["n_groups"].tolist(), row["n_links"].tolist(), row["sha"]), key=key)
    assert got == sorted([(*r[:5], r[7]) for r in brute(rows, encoders)], key=key)


def safe(text, path, size):
    from weftlake.llm.tokencount import safe_parts

    return safe_parts(text, path, size)


def test_special_strings_are_plain_text(encoders):
    one, _ = align.sides(A, B)
    assert list(one.encode([" <|endoftext|>"])[0]) == [i for i, _ in encoders[0]("<|endoftext|>")]


def test_long_text_and_empty_table(spark, encoders):
    rng = random.Random(7)
    long = " ".join(rng.choice(["alignment", "of", "tokenizers,", "ünïcode", "12345", "x.\ny"]) for _ in range(120_000))
    rows = [(1, long), (2, "alignment of x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert aligned(docs) == sorted(brute(rows, encoders), key=key)
    empty = align.alignments(docs.limit(0), A, B)
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


def test_merge_of_made_lengths():
    import numpy as np

    a, b = np.array([1, 2, 3]), np.array([7, 8])
    group_a, group_b, left, right = align.merge(a, b, np.array([2, 2, 1]), np.array([3, 2]))
    assert group_a.tolist() == [0, 0, 0] and group_b.tolist() == [0, 0]
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1)]
