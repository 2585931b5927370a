"""Sharding: groups that pass a quota, and cut edges."""

import random

import pytest

from weftlake.llm import sharding


def cut_edges(sizes):
    """Pairs of a group on different shards, from its counts by shard."""
    n = sum(sizes)
    return (n * n - sum(c * c for c in sizes)) // 2


def run(spark, texts):
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).toPandas()
    sizes = got.groupby("shard").size().reindex(range(8), fill_value=0)
    assert sorted(got.doc_id) == list(range(len(texts))) and sizes.max() - sizes.min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    got["text"] = [texts[d] for d in got.doc_id]
    return {t: sorted(x, reverse=True) for t, x in got.groupby("text").shard.agg(lambda s: list(s.value_counts())).items()}


def test_whole_shards():
    assert sharding.whole_shards([(5, 500), (6, 124)], [125] * 8) == {5: [0, 1, 2, 3]}
    assert sharding.whole_shards([(5, 251), (6, 126)], [126, 125, 125]) == {5: [0, 1], 6: [2]}
    assert sharding.whole_shards([], [0, 0]) == {}


@pytest.mark.parametrize("same, most", [(500, 4), (520, 5), (1000, 8), (125, 1), (126, 2)])
def test_a_group_takes_as_few_shards_as_the_quota_allows(spark, monkeypatch, same, most):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    got = run(spark, ["same"] * same + [f"one {i}" for i in range(1000 - same)])
    assert len(got["same"]) == most


def test_cut_edges_against_the_best(spark, monkeypatch):
    """Groups of 90 in shards of 125, and groups of 4: the best cuts no edge."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    texts = [f"g{k}" for k in range(8) for _ in range(90)] + [f"h{k}" for k in range(40) for _ in range(4)] + [f"one {i}" for i in range(120)]
    random.Random(1).shuffle(texts)
    got = run(spark, texts)
    linked = {t: x for t, x in got.items() if t[0] in "gh"}
    edges = sum(cut_edges([1] * sum(x)) for x in linked.values())
    cut = sum(cut_edges(x) for x in linked.values())
    assert cut <= 0.25 * edges  # dealt by row 7 of 8 are cut
    assert sum(len(x) > 1 for x in linked.values()) <= 15  # one at each shard's end, and at each end of the pool's ranges


def test_few_rows(spark):
    for n in (1, 3, 9):
        run(spark, ["same"] * n)
