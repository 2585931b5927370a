"""SimHash near-duplicates by multi-index hashing.

Fingerprint: over the word shingles of the ASCII-lower-cased text, bit i is 1 if
it is set in over half of the shingles' XXH64 (seed 42). Two fingerprints link at
``radius`` or fewer differing bits.

The 64 bits are cut into segments, each with a radius, so that radii plus one sum to
more than the linking radius: of two fingerprints that near, one segment pair must agree
up to its radius. Every distinct fingerprint is stored under its segment values and
fetched through the small Hamming balls around them; the join condition verifies the
complete distance. Four narrow, three middle or two wide segments are taken, whichever
costs least for the number of distinct fingerprints (probes plus expected chance matches);
the result is the same. Links to a bucket's smallest member are made first. Then a
bucket's commonest component is not joined with itself: its members meet only probes of
other components, and only the other members meet all probes, so a dense group does not
emit its pairs.

:func:`keep_first` works on wider fingerprints, several words of 64 bits over five-word
shingles: the distance of 512 bits tells a Jaccard similarity of 0.8 from 0.7, which that
of 64 bits can't. Their segments are about log2 of the number of fingerprints wide and
are looked up as they are (balls of radius 0), the rest is the same. The segments of one
order of the bits have none in common, so no link of fewer differing bits than there are
segments in an order is lost (32 of 16 bits, 17 of 30); links of more bits, up to the linking
distance, are found at the recall for which the number of segments is chosen.

Defined results: null, empty and word-free texts have fingerprint zero and link
like any other; repeated rows share a component; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlake.llm.common import bound_batches, components, drop_stage, fresh, stage
from weftlake.llm.suffix import Words, _mix, word_hashes

SEED, PIECE = 42, 65_536
#: First bit, bits, radius of the ball.
SCHEMES = (((0, 16, 1), (16, 16, 0), (32, 16, 0), (48, 16, 0)), ((0, 21, 1), (21, 21, 1), (42, 22, 0)), ((0, 32, 2), (32, 32, 1)))
#: Words of a wide fingerprint, and the share of differing bits up to which two link: a
#: similarity of 0.8 has 0.151 on average, with a deviation of 0.016 over 512 bits.
WIDE, WIDE_SHARE, WIDE_WORDS = 8, 0.17, 5
#: The share of bits in which texts of similarity 0.8 differ, and how likely they are to meet.
WIDE_DIFFER, WIDE_RECALL = 0.155, 0.94
#: Up to so many rows of a bucket are compared by pairs at once; rounds of stars in larger ones before pairs, which end
#: when one has made fewer links than this share of the buckets of several components.
FEW, STARS, WORTH = 6, 3, 0.05
WIDE_SEEDS = _mix(np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with ``radius`` or fewer ones."""
    return [sum(1 << i for i in ones) for k in range(radius + 1) for ones in itertools.combinations(range(bits), k)]


def scheme_for(count: int) -> tuple[tuple[int, int, int], ...]:
    """The cheapest scheme for so many fingerprints."""
    cost = lambda s: sum(len(ball(n, r)) * (1 + count / 2**n) for _, n, r in s)
    return min(SCHEMES, key=cost)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    if text is None:
        return 0
    w = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) < words:
        return h(joined, SEED)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    starts = [0, *ends[:-1]]
    n, counts = len(w) - words + 1, np.zeros(64, np.int64)
    for lo in range(0, n, PIECE):
        hashes = np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts[lo : min(n, lo + PIECE)], ends[lo + words - 1 :])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed bigint) of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _segment(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _stored(fps: DataFrame, scheme: tuple) -> DataFrame:
    """Each fingerprint under its segment values."""
    return fps.select("fp", "root", F.posexplode(F.array(*[_segment(F.col("fp"), a, n) for a, n, _ in scheme])).alias("seg", "key"))


def _probes(fps: DataFrame, scheme: tuple) -> DataFrame:
    """The small Hamming ball around each segment value."""
    masks = lambda n, r: F.split(F.lit(",".join(map(str, ball(n, r)))), ",").cast("array<bigint>")
    sides = [fps.select(F.col("fp").alias("fp2"), F.col("root").alias("root2"), F.lit(j).alias("seg"), F.explode(masks(n, r)).alias("m"), _segment(F.col("fp"), a, n).alias("v")).select("fp2", "root2", "seg", F.col("v").bitwiseXOR(F.col("m")).alias("key")) for j, (a, n, r) in enumerate(scheme)]
    return reduce(DataFrame.unionAll, sides)


def link(fps: DataFrame, radius: int = 4, scheme: tuple | None = None) -> DataFrame:
    """Components of the distinct fingerprints ``fps(fp)``: ``(fp, root)``, any
    fingerprint that links with none being its own root."""
    if not 0 <= radius <= 4:
        raise ValueError("the segment balls cover up to 4 differing bits")
    scheme = scheme or scheme_for(fps.count())
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    own = fps.select("fp", F.col("fp").alias("root"))
    table = _stored(own, scheme)
    heads = table.groupBy("seg", "key").agg(F.min("fp").alias("fp2"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = table.join(heads, ["seg", "key"]).where(near & (F.col("fp") != F.col("fp2"))).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    first = stage(components(stars, "simhash-star"), "simhash-first")
    named = stage(fps.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-named")
    pairs = between(named, scheme).where(near).select(F.col("root").alias("a"), F.col("root2").alias("b"))
    roots = components(pairs, "simhash-all")
    return named.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def between(named: DataFrame, scheme: tuple) -> DataFrame:
    """Stored and probing fingerprints of ``named(fp, root)`` that meet in a bucket and are
    of different components: ``fp, root, fp2, root2``. The commonest component of a bucket
    does not meet itself."""
    stored, probes = _stored(named, scheme), _probes(named, scheme)
    main = stage(stored.groupBy("seg", "key").agg(F.mode("root", True).alias("main")), "simhash-main")
    stored = stored.join(main, ["seg", "key"])
    few = stored.where("root <> main").drop("main").join(probes, ["seg", "key"])
    most = stored.where("root = main").drop("main").join(probes.join(main, ["seg", "key"]).where("root2 <> main").drop("main"), ["seg", "key"])
    return few.unionByName(most).where("root <> root2").select("fp", "root", "fp2", "root2")


# ---- wide fingerprints ----


def wide_scheme(count: int) -> tuple[int, int]:
    """Bits of a segment and the number of segments for so many fingerprints."""
    bits = min(40, max(16, (max(1, count) - 1).bit_length()))
    agree = (1 - WIDE_DIFFER) ** bits
    return bits, math.ceil(math.log(1 - WIDE_RECALL) / math.log1p(-agree))


def wide_places(bits: int, tables: int) -> np.ndarray:
    """Which bits each segment consists of. Segments are cut one after the other from orders
    of all bits that a hash decides, and those of one order have no bit in common: whatever
    differs in fewer bits than an order has segments agrees in one of them."""
    each = 64 * WIDE // bits
    rounds = -(-tables // each)
    order = _mix(np.arange(rounds * 64 * WIDE, dtype=np.uint64) + np.uint64(1)).reshape(rounds, -1)
    return np.argsort(order, axis=1, kind="stable")[:, : each * bits].reshape(-1, bits)[:tables]


def wide_keys(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The segments of fingerprints (rows of 64-bit words), a number each."""
    ones = np.unpackbits(np.ascontiguousarray(raw, "<u8").view(np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")
    weights = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)
    return ones[:, places] @ weights


def wide_fingerprint(text: str | None, words: int = WIDE_WORDS) -> bytes:
    """The WIDE little-endian words of 64 bits of a whole text; zeros without a word."""
    hashed = word_hashes((text or "").encode())
    if not len(hashed):
        return bytes(8 * WIDE)
    w = Words(hashed)
    n, counts = max(1, w.n - words + 1), np.zeros(64 * WIDE, np.int64)
    for lo in range(0, n, PIECE // WIDE):
        at = np.arange(lo, min(n, lo + PIECE // WIDE))
        h = _mix(w.run(at, np.minimum(at + words, w.n))[:, None] ^ WIDE_SEEDS)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(at), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, id, fp`` of every row: the fingerprint's words and a number that names it."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [wide_fingerprint(x) for x in b.column(1).to_pylist()]
            words = pa.array([np.frombuffer(x, "<i8") for x in raw], pa.list_(pa.int64()))
            ids = pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, words], names=["doc_id", "id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, id bigint, fp array<bigint>")


def link_wide(fps: DataFrame, share: float = WIDE_SHARE) -> DataFrame:
    """Components of the distinct fingerprints ``fps(id, fp)``: ``(id, root)``."""
    bits, tables = wide_scheme(fps.count())
    most = int(64 * WIDE * share)
    places = wide_places(bits, tables)
    bound_batches(fps.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).flatten().to_numpy().reshape(b.num_rows, WIDE) if b.num_rows else np.empty((0, WIDE), np.int64)
            keys = wide_keys(raw, places).astype(np.uint64) ^ (np.arange(tables, dtype=np.uint64) << np.uint64(bits))
            # one word of the fingerprint travels with its segments; the others are fetched for likely pairs only
            rows = [_mix(keys.ravel()).view(np.int64), np.repeat(b.column(0).to_numpy(), tables), np.repeat(raw[:, 0], tables)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "id", "w"])

    near_word = int(64 * share) + 12
    likely = F.bit_count(F.col("w").bitwiseXOR(F.col("w2"))) <= near_word
    near = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(WIDE)), F.lit(0)) <= most

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-likely")
        one, two = fps.select(F.col("id").alias("a"), F.col("fp").alias("x")), fps.select(F.col("id").alias("b"), F.col("fp").alias("y"))
        return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")

    def rooted(links: DataFrame) -> DataFrame:
        """``node, root`` of the fingerprints that have a link."""
        return stage(components(links, "simhash-star"), "simhash-first")

    def hubs(others: DataFrame, mains: DataFrame) -> DataFrame:
        """A row outside the bucket's main component: ``key, main, root2, y``."""
        outside = others.join(mains, "key").where("root <> main")
        least = outside.groupBy("key", "main").agg(F.min(F.struct("root", "id", "x")).alias("o"))
        return stage(least.select("key", "main", F.col("o.root").alias("root2"), F.col("o.x").alias("y")), "simhash-hubs")

    def renamed(rows: DataFrame, node: str, name: str, roots: DataFrame) -> DataFrame:
        """``name``: the root that the component of ``node`` has now."""
        now = roots.select(F.col("node").alias(node), F.col("root").alias("now"))
        return rows.join(now, node, "left").withColumn(name, F.coalesce("now", name)).drop("now")

    # segments are cut anew where they are needed: that takes less than writing and reading them
    stored = fps.select("id", "fp").mapInArrow(cut, "key bigint, id bigint, w bigint")
    heads = stage(stored.groupBy("key").agg(F.min_by("id", "w").alias("b"), F.min("w").alias("w2"), F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-heads")
    # a bucket of two is done with its star
    met = stage(stored.join(heads, "key").where((likely & (F.col("id") != F.col("b"))) | (F.col("n") > 2)), "simhash-met")
    drop_stage(heads)
    two = met.where("n = 2").select(F.col("id").alias("a"), "b")
    # all pairs of a bucket of a few
    few = met.where(F.col("n").between(3, FEW)).groupBy("key").agg(F.collect_list(F.struct("id", "w")).alias("m"))
    close = lambda x, y: F.bit_count(x["w"].bitwiseXOR(y["w"])) <= near_word
    after = lambda x: F.filter("m", lambda y: (y["id"] > x["id"]) & close(x, y))
    few = few.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(after(x), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))).alias("p")).select("p.a", "p.b")
    # rows of larger buckets meet the least head that they have first; their fingerprints then travel with them
    large = met.where(F.col("n") > FEW)
    least = large.where(likely & (F.col("id") != F.col("b"))).groupBy("id").agg(F.min_by("b", "w2").alias("b")).select(F.col("id").alias("a"), "b")
    links = stage(linked(two.unionAll(few).unionAll(least)), "simhash-stars")
    roots = rooted(links)
    named = fps.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("fp").alias("x"), F.coalesce("root", "id").alias("root"))
    rows = stage(large.select("key", "id").join(named, "id"), "simhash-dense")
    drop_stage(met)
    # a bucket's commonest component is its main one, also where it has joined another since: the rows in it then are
    # named by the bucket, so only the others get new roots
    main = rows.groupBy("key").agg(F.mode("root", True).alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mains = stage(main.where("lo <> hi").select("key", "main"), "simhash-main")
    wide, rows = rows, stage(rows.join(mains, "key"), "simhash-rows")
    drop_stage(wide)
    bulk = rows.where("root = main").select("key", "x")
    others = stage(rows.where("root <> main").select("key", "id", "x", "root"), "simhash-others")
    hub = hubs(others, mains)
    for _ in range(STARS):
        # a star around a row outside the main component: what it joins needs no pairs
        one = bulk.join(hub, "key").where(near).select(F.col("main").alias("a"), F.col("root2").alias("b"))
        two = others.join(hub, "key").where((F.col("root") != F.col("root2")) & near).select(F.col("root").alias("a"), F.col("root2").alias("b"))
        more = stage(one.unionAll(two).distinct(), "simhash-more")
        # few links don't repay another round: the last comparison makes them as well
        n = more.count()
        old = links, roots, others, mains, hub
        links = stage(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more), "simhash-stars")
        roots = rooted(links)
        others = stage(renamed(others, "id", "root", roots).select("key", "id", "x", "root"), "simhash-others")
        mains = stage(renamed(mains, "main", "main", roots).select("key", "main"), "simhash-main")
        hub = hubs(others, mains)
        for df in (*old, more):
            drop_stage(df)
        if n < WORTH * hub.count():
            break
    # of the rows that were not in the main component, those still outside it are compared with those in it, and with
    # each other unless both are of their own commonest component; two that are not meet once
    outside = others.select("key", F.col("id").alias("b"), F.col("root").alias("root2"), F.col("x").alias("y"))
    one = bulk.join(outside.join(mains, "key").where("root2 <> main"), "key").where(near).select(F.col("main").alias("a"), F.col("root2").alias("b"))
    second = stage(others.groupBy("key").agg(F.mode("root", True).alias("second")), "simhash-second")
    rest = outside.join(second, "key").where("root2 <> second")
    once = (F.col("root") == F.col("second")) | (F.col("id") < F.col("b"))
    two = others.join(rest, "key").where(once & (F.col("root") != F.col("root2")) & near).select(F.col("root").alias("a"), F.col("root2").alias("b"))
    top = one.unionAll(two).unionAll(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    last = stage(components(top, "simhash-all"), "simhash-last")
    for df in (rows, links, roots, others, mains, hub, second):
        drop_stage(df)
    return fps.select("id").join(last.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def wide_near_duplicates(docs: DataFrame, share: float = WIDE_SHARE) -> DataFrame:
    """``doc_id, component_id`` of every row, by wide fingerprints."""
    rows = stage(wide_fingerprints(docs), "simhash-rows")
    fps = stage(rows.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("first_id")), "simhash-fps")
    ids = stage(rows.select("doc_id", "id"), "simhash-ids")
    drop_stage(rows)
    roots = stage(link_wide(fps.select("id", "fp"), share), "simhash-roots")
    lowest = stage(roots.join(fps, "id").groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-lowest")
    named = stage(roots.join(lowest, "root").select("id", "component_id"), "simhash-named")
    for df in (fps, roots, lowest):
        drop_stage(df)
    return ids.join(named, "id").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; the component is named by the
    smallest doc_id in it."""
    rows = stage(fingerprints(docs), "simhash-rows")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    roots = stage(link(fps.select("fp"), radius), "simhash-roots")
    # tables of their own on both sides of a join may be split where a key is common
    lowest = stage(roots.join(fps, "fp").groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-lowest")
    named = stage(roots.join(lowest, "root").select("fp", "component_id"), "simhash-found")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, share: float = WIDE_SHARE) -> DataFrame:
    """One document of each component of wide fingerprints: that with the component's
    smallest id. Of rows that repeat an id one is kept; rows with a null id are kept."""
    found = wide_near_duplicates(docs.select("doc_id", "text"), share)
    key, rank = fresh(docs, "_wl_id"), fresh(docs, "_wl_rank")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    named = docs.join(kept, docs["doc_id"] == kept[key])
    by = Window.partitionBy(key).orderBy("text")
    one = named.withColumn(rank, F.row_number().over(by)).where(F.col(rank) == 1).select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))
