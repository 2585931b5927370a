"""Grammar-compressed token files: round trips, random access and the ids themselves."""

import random
import zlib

import numpy as np
import pytest

from weftlake.llm import repair, wordids
from weftlake.llm.queries import tokenizer_file

WORDS = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    rng = random.Random(5)
    signs = "etaoinshrdluETAOIN'sé ñÑçµªº²½ßÅÀÿŀİıſǅ0129.,-!?<|>endoftext­ \x85\x1c\x0b\x0c\r\n\t́Σσς中文日本☃😀한글 ẞﬁ\x00\x01"
    found = wordids.words(WORDS)
    for i in range(6_000):
        text = "".join(rng.choice(signs if i % 2 else "etaoinshrdlucmfgyp  E") for _ in range(rng.randrange(60)))
        text += "<|endoftext|>" * (i % 40 == 0) + text
        assert np.frombuffer(found.ids(text), "<u4").tolist() == library(text), text


def test_other_files_go_to_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    text = "Some  text,\n\nwith 12 <|endoftext|> lines"
    assert np.frombuffer(wordids.words(path).ids(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def expanded(rules, symbols, base):
    out, todo = [], symbols.tolist()[::-1]
    while todo:
        x = todo.pop()
        if x < base:
            out.append(x)
        else:
            todo += rules[x - base].tolist()[::-1]
    return out


@pytest.mark.parametrize("kind", ["random", "one id", "phrases", "two ids", "single"])
def test_grammar(kind):
    rng = np.random.default_rng(3)
    phrase = [rng.integers(0, 90, rng.integers(2, 9)) for _ in range(40)]
    ids = {
        "random": rng.integers(0, 9, 5_000),
        "one id": np.full(4_099, 7),
        "phrases": np.concatenate([phrase[i] for i in rng.integers(0, 40, 900)]),
        "two ids": np.tile([1, 2], 2_000),
        "single": np.array([5]),
    }[kind]
    starts = np.unique(np.r_[0, rng.integers(0, len(ids), 30)])
    rules, symbols, at = repair.compress(ids, starts, 100, rounds=20, least=4)
    assert expanded(rules, symbols, 100) == ids.tolist()
    grammar = repair.Grammar(100, rules)
    assert grammar.expand(symbols).tolist() == ids.tolist()
    ends = np.r_[at[1:], len(symbols)]
    assert [grammar.length[symbols[a:b]].sum() for a, b in zip(at, ends)] == np.diff(np.r_[starts, len(ids)]).tolist()
    if kind in ("one id", "phrases", "two ids"):
        assert len(symbols) + 2 * len(rules) < len(ids) / 2


def test_most_frequent_pairs_first():
    ids = np.array([1, 2, 3] * 5 + [2, 3] * 20)
    rules, _, _ = repair.compress(ids, np.array([0]), 10, rounds=1, least=2)
    assert rules[0].tolist() == [2, 3]  # 25 times; (1, 2) and (3, 2) overlap with it
    assert [1, 2] not in rules.tolist()


def test_blocks_and_random_access():
    rng = random.Random(4)
    docs = [(None if k % 17 == 0 else k, np.array([rng.randrange(50) for _ in range(rng.choice([1, 2, 30, 700]))], "<u4")) for k in range(120)]
    w = repair.Writer(60, block=500)
    for doc, ids in docs:
        w.add(doc, ids)
    raw = w.finish()
    f = repair.File(raw)
    assert (f.n_docs, f.n_tokens) == (120, sum(len(x) for _, x in docs))
    for k, (_, ids) in enumerate(docs):
        assert f.document(k).tolist() == ids.tolist()
        a = rng.randrange(len(ids))
        b = rng.randrange(a, len(ids) + 1)
        assert f.document(k, a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        f.document(120)
    got = repair._decoded("x", raw)
    assert got.column("doc_id").to_pylist() == [d for d, _ in docs]
    assert got.column("ids_crc32").to_pylist() == [zlib.crc32(x.tobytes()) for _, x in docs]
    with pytest.raises(ValueError):
        repair.File(raw[:-1])


def test_ids_beyond_the_vocabulary():
    w = repair.Writer(10)
    w.add(1, np.array([70_000, 3] * 200, "<u4"))
    f = repair.File(w.finish())
    assert f.document(0).tolist() == [70_000, 3] * 200


def brute(rows, library, end=2):
    out, at = [], 0
    for doc, text in rows:
        ids = np.array([*library(text or ""), end], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_table(spark, sf, library, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    found = repair.round_trip(docs.repartition(7), WORDS).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == brute(rows, library)


def test_odd_rows(spark, library):
    long = "word " * 300_000
    rows = [(None, "a"), (1, None), (2, ""), (3, long), (4, "<|endoftext|> x"), (4, "b"), (4, "b"), (-5, "早 é")]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id bigint, text string, start int, name string")
    found = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in repair.round_trip(docs, WORDS).collect()]
    same = sorted(x[2:] for x in brute(rows, library))
    assert sorted(x[2:] for x in found) == same
    found.sort(key=lambda x: x[1])
    assert [x[0] for x in found] == [None, -5, 1, 2, 3, 4, 4, 4]
    assert [x[1] for x in found] == [sum(y[2] for y in found[:i]) for i in range(len(found))]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    out = repair.round_trip(docs, WORDS)
    assert out.collect() == [] and out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
