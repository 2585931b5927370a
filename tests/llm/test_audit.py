"""The filter audit against a plain loop over all orders and documents."""

import collections
import itertools
import random
import re

import pytest

from weftlake.llm import filters

DOCS, LABELS = "doc_id bigint, text string, lang string, source string, n_chars bigint", "doc_id bigint, quality int, toxic int"


def brute(rows, labels):
    first = {}
    for d, t, _, _, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    out = collections.defaultdict(lambda: [0] * 6)
    sums = collections.Counter()
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for d, t, _, s, _ in rows:
        t, s = t or "", s or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        for order in orders:
            gone = False
            for step, f in enumerate(order, 1):
                r = out[s, order, step]
                if fails[f] and not gone:
                    r[1] += 1
                    r[4] += d in good
                    r[5] += d in toxic
                    sums[s, f] += 1
                elif fails[f]:
                    r[2] += 1
                r[3] += fails[f] and sum(fails.values()) == 1
                gone |= fails[f]
                r[0] += not gone
    return sorted((s, o, k, *r, sums[s, o[k - 1]]) for (s, o, k), r in out.items())


def audited(spark, rows, labels):
    found = filters.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    return sorted(tuple(r) for r in found.collect())


def made(seed, n=120):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.3:
            texts.append(rng.choice(texts))
            continue
        words = [rng.choice("a b c d e f g h Big Ä été \U0001d51e x y".split(" ")) + str(rng.randrange(rng.choice([2, 400]))) for _ in range(rng.choice([0, 3, 49, 50, 51, 120]))]
        if words and rng.random() < 0.2:
            words[0] = rng.choice("#$%&*|")
        texts.append(rng.choice(["", " ", "\x0b"]) + rng.choice([" ", "\n\t", "\x0c \r"]).join(words))
    return [(i * 3, rng.choice([t, t, t]), "en", rng.choice(["hot", "hot", "s1", None, ""]), len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_orders(spark, seed):
    rows = made(seed)
    labels = [(r[0], i % 2, i % 3 == 0) for i, r in enumerate(rows) if i % 4]
    labels = [(d, q, int(x)) for d, q, x in labels] + [(0, 1, 1), (0, 0, 0), (10**6, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 90_000}" for i in range(200_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words", "en", "a", 10), (3, "same words", "en", "a", 10), (3, "other words", "en", "b", 11), (4, "same words", "en", "b", 10), (None, "same words", "en", "a", 10), (None, "alone", "en", "a", 5), (5, long, "en", "a", len(long)), (6, long, "en", None, len(long))]
    labels = [(3, 1, None), (4, None, 1), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, [x for x in labels if x[0] is not None])


def test_empty_tables_and_clashing_columns(spark):
    assert audited(spark, [], []) == []
    docs = spark.createDataFrame([(1, "A b", "x", 7, 8, "y")], "doc_id bigint, text string, source string, k int, failed int, part string")
    labels = spark.createDataFrame([(1, 1, 0, "z")], "doc_id bigint, quality int, toxic int, part string")
    found = filters.audit(docs, labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.removed, r.redundant, r.good_lost, r.shapley) for r in found] == [(1, 0, 1, 60), (0, 0, 0, 0), (0, 1, 0, 60), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert {r.part for r in found} == {"x"}
