"""Plans against best fit, longest first, and what is no letter."""

import bisect
import collections
import random

import duckdb
import pytest

from weftlake.llm import langid, packing
from weftlake.llm.queries import tokenizer_file


def best_fit(lengths, capacity=1024):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i == len(rooms):
            n += 1
            r = capacity
        else:
            r = rooms.pop(i)
        bisect.insort(rooms, r - x)
    return n


def table_lengths(sf):
    encode = packing._encoder(tokenizer_file("byte_bpe_50k.json"))
    rows = duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()
    return [n for (t,) in rows for _, n in packing.cut(len(encode(t or "")) + 1, 1024)]


CASES = {
    "uniform": lambda r: [r.randrange(1, 1025) for _ in range(4_000)],
    "all lengths": lambda r: [x for x in range(1, 1025) for _ in range(20)],
    "narrow": lambda r: [r.randrange(300, 420) for _ in range(3_000)],
    "short": lambda r: [min(1024, int(r.expovariate(1 / 60)) + 1) for _ in range(9_000)],
    "long": lambda r: [min(1024, int(r.gauss(700, 200)) % 1024 + 1) for _ in range(3_000)],
}


@pytest.mark.parametrize("name", [*CASES, "sf0.01"])
def test_never_worse_than_best_fit(name):
    lengths = table_lengths("/root/testdata/sf0.01") if name == "sf0.01" else CASES[name](random.Random(5))
    hist = dict(collections.Counter(lengths))
    plan, n = packing.best_plan(hist)
    assert n <= best_fit(lengths)
    used = collections.Counter()
    for length, _, count, first, _ in plan:
        for s in range(first, first + count):
            used[s] += length
    assert max(used.values()) <= 1024 and sum(used.values()) == sum(lengths) and len(used) == n


@pytest.mark.parametrize("text,letter", [("½", False), ("²", False), ("①", False), ("½ ³ ²", False), ("_ 12 ٣ ५", False), ("½ x", True), ("é", True), ("中", True), ("ª", True), ("", False)])
def test_number_signs_are_no_letters(text, letter):
    assert langid.has_letter(text) == letter


def test_labels_are_bounded(spark):
    rows = [(i, f"some text {i}", f"l{i % 700}") for i in range(2_100)] + [(9_000 + i, f"word {i}", "big") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.training_sample(docs, per_lang=2, labels=10)
    assert len(found) == 10 and "big" in found and all(len(x) <= 2 for x in found.values())
