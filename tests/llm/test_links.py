"""SimHash links at any number of texts: how many near pairs meet, and what dense groups cost."""

import random

import numpy as np
import pytest

from weftlake.llm import simhash


def pairs_of(similarity, n, seed):
    """Texts and copies of them whose five-word shingles have about that similarity."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        words = [f"w{rng.randrange(50_000)}" for _ in range(300)]
        copy = list(words)
        changed = 0
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        while len(grams(words) & grams(copy)) / len(grams(words) | grams(copy)) > similarity:
            copy[rng.randrange(300)] = f"x{seed}.{len(out)}.{changed}"
            changed += 1
        out.append((" ".join(words), " ".join(copy)))
    return out


@pytest.fixture(scope="module")
def near():
    """Fingerprints of pairs of similarity 0.8 to 0.84 within the linking distance."""
    prints = lambda t: np.frombuffer(simhash.wide_fingerprint(t), "<u8")
    found = [(prints(a), prints(b)) for a, b in pairs_of(0.82, 300, 1)]
    most = int(64 * simhash.WIDE * simhash.WIDE_SHARE)
    kept = [(a, b) for a, b in found if int(np.bitwise_count(a ^ b).sum()) <= most]
    assert len(kept) > 200
    return np.array([a for a, _ in kept]), np.array([b for _, b in kept])


@pytest.mark.parametrize("count", [1_000, 65_536, 10**6, 10**7, 10**9, 10**11])
def test_near_pairs_meet_at_any_number_of_texts(near, count):
    bits, tables = simhash.wide_scheme(count)
    assert count <= 65_536 or 2**bits >= count  # a bucket holds about one text by chance
    places = simhash.wide_places(bits, tables)
    one, two = (simhash.wide_keys(x, places) for x in near)
    assert (one == two).any(axis=1).mean() >= 0.9


def test_forced_number_finds_the_same_links(spark, monkeypatch):
    """Links with the segments of a million texts, against all pairs."""
    texts = [t for pair in pairs_of(0.85, 60, 2) for t in pair]
    rows = [(i, [int(x) for x in np.frombuffer(simhash.wide_fingerprint(t), "<i8")]) for i, t in enumerate(texts)]
    fps = spark.createDataFrame(rows, "id bigint, fp array<bigint>")
    scheme = simhash.wide_scheme(10**6)
    monkeypatch.setattr(simhash, "wide_scheme", lambda n: scheme)
    roots = {r["id"]: r["root"] for r in simhash.link_wide(fps).collect()}
    raw = np.array([x for _, x in rows], np.int64).view(np.uint64)
    most = int(64 * simhash.WIDE * simhash.WIDE_SHARE)
    linked = [(i, j) for i in range(len(raw)) for j in range(i + 1, len(raw)) if int(np.bitwise_count(raw[i] ^ raw[j]).sum()) <= most]
    assert len(linked) >= 50
    assert sum(roots[i] == roots[j] for i, j in linked) >= 0.9 * len(linked)
    together = {(i, j) for i in roots for j in roots if i < j and roots[i] == roots[j]}
    assert together <= set(linked)


def test_a_dense_group_makes_few_candidates(spark):
    """3,000 fingerprints near each other, of one component after the first round, and
    others; the links are those of all pairs."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    dense = {base}
    while len(dense) < 3_000:
        dense.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
    others = {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in dense | others)
    named = spark.createDataFrame([(x, min(fps) if x % (1 << 64) in dense else x) for x in fps], "fp bigint, root bigint")
    for scheme in simhash.SCHEMES[:2]:
        assert simhash.between(named, scheme).count() < 20 * len(fps)
    roots = {r["fp"]: r["root"] for r in simhash.link(named.select("fp")).collect()}
    raw = np.array(fps, np.int64).view(np.uint64)
    top = list(range(len(raw)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(len(raw)):
        for j in np.flatnonzero(np.bitwise_count(raw[i + 1 :] ^ raw[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            top[max(a, b)] = min(a, b)
    assert roots == {fps[i]: fps[find(i)] for i in range(len(fps))}


@pytest.mark.parametrize("count", [1_000, 10**6, 10**9])
def test_no_near_link_is_lost(count):
    """Whatever differs in fewer bits than an order of the bits has segments meets, even
    where the differing bits are chosen to lie in as many segments as possible."""
    bits, tables = simhash.wide_scheme(count)
    places = simhash.wide_places(bits, tables)
    assert len({tuple(sorted(p)) for p in places.tolist()}) == tables and all(len(set(p)) == bits for p in places.tolist())
    rng = np.random.default_rng(5)
    one = rng.integers(0, 2**63, simhash.WIDE).astype(np.uint64)
    left, two = set(range(tables)), one.copy()
    for _ in range(64 * simhash.WIDE // bits - 1):
        most = np.bincount(places[sorted(left)].ravel() if left else places.ravel(), minlength=64 * simhash.WIDE)
        bit = int(most.argmax())
        two[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        left = {t for t in left if bit not in places[t]}
    assert (simhash.wide_keys(one[None], places) == simhash.wide_keys(two[None], places)).any()


def test_large_buckets_give_the_links_of_all_pairs(spark, monkeypatch):
    """Groups of near copies that don't all link with each other, with buckets of many rows."""
    rng = np.random.default_rng(9)
    most = int(64 * simhash.WIDE * simhash.WIDE_SHARE)
    rows = []
    for flips in (30, 42, 46):
        base = rng.integers(0, 2, 64 * simhash.WIDE, dtype=np.uint8)
        for _ in range(150):
            x = base.copy()
            x[rng.choice(len(x), flips, replace=False)] ^= 1
            rows.append(np.packbits(x, bitorder="little").view("<i8"))
    fps = spark.createDataFrame([(i, [int(y) for y in x]) for i, x in enumerate(rows)], "id bigint, fp array<bigint>")
    monkeypatch.setattr(simhash, "wide_scheme", lambda n: (4, 60))  # all pairs meet somewhere
    raw = np.array(rows).view(np.uint64)
    top = list(range(len(raw)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(raw)):
        for j in np.flatnonzero(np.bitwise_count(raw[i + 1 :] ^ raw[i]).sum(1) <= most) + i + 1:
            a, b = find(i), find(int(j))
            top[max(a, b)] = min(a, b)
    assert {r["id"]: r["root"] for r in simhash.link_wide(fps).collect()} == {i: find(i) for i in range(len(raw))}


def test_rounds_rename_only_what_is_outside_a_bucket_s_main_component(spark, monkeypatch):
    """A group of near copies, and texts that share buckets with it: some are near it by one
    of its members only, some not at all. Its rows are named once, not in each round."""
    rng = np.random.default_rng(4)
    most = int(64 * simhash.WIDE * simhash.WIDE_SHARE)
    base = rng.integers(0, 2, 64 * simhash.WIDE, dtype=np.uint8)
    bits = []
    for flips, n in ((10, 400), (most - 8, 40), (most + 4, 40), (200, 40)):
        for _ in range(n):
            bits.append(base.copy())
            bits[-1][rng.choice(len(base), flips, replace=False)] ^= 1
    raw = np.packbits(np.array(bits), axis=1, bitorder="little").view(np.uint64)
    fps = spark.createDataFrame([(i, [int(y) for y in x]) for i, x in enumerate(raw.view(np.int64))], "id bigint, fp array<bigint>")
    monkeypatch.setattr(simhash, "wide_scheme", lambda n: (4, 60))
    real, named = simhash.stage, []

    def counted(df, label):
        out = real(df, label)
        if label in ("simhash-dense", "simhash-others"):
            named.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stage", counted)
    roots = {r["id"]: r["root"] for r in simhash.link_wide(fps).collect()}
    top = list(range(len(raw)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(raw)):
        for j in np.flatnonzero(np.bitwise_count(raw[i + 1 :] ^ raw[i]).sum(1) <= most) + i + 1:
            a, b = find(i), find(int(j))
            top[max(a, b)] = min(a, b)
    assert roots == {i: find(i) for i in range(len(raw))}
    assert len(named) > 2 and max(named[1:]) < named[0] / 2
