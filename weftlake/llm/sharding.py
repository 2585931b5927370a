"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start in a shard given by
a hash, those of large groups (over 1/64 of a quota, so fewer than 64 times the shards)
together in the shard that they fill best, and, round by round, move to the shard where most of their neighbours are,
as far as the shard's quota has room; what neighbours are where is a histogram by
(text, shard), never a list of pairs. A group that fills shards by itself (there are fewer
of those than shards) is given them before, and what is left of it moves like any other.
Unlinked documents cut no edge wherever they go, so they fill the shards up to exactly even
row counts at the end, after groups that passed a quota: those stand together, so that
at most one group is cut at each shard's end.

The law is ``rows``: the shards' row counts differ by one at most. Defined results:
a null text counts as an empty one (size 1, crc 0); repeated rows are separate
members of their group; a group over a shard's quota is spread over as few shards
as the quota allows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.llm.common import drop_stage, global_rank, parts_for, stage


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def admitted(wish: dict[tuple[int, int], int], held: list[int], quota: list[int]) -> dict[tuple[int, int], float]:
    """The share of each (from, to) wish to admit: what leaves a shard makes room for
    what enters it, and no shard passes its quota. Starts from all wishes and cuts
    back the inflow of overfull shards until none is left."""
    share = {k: 1.0 for k in wish}
    for _ in range(60):
        over = False
        for t in range(len(held)):
            into = sum(n * share[k] for k, n in wish.items() if k[1] == t)
            out = sum(n * share[k] for k, n in wish.items() if k[0] == t)
            room = max(0.0, quota[t] - held[t] + out)
            if into > room + 0.5:
                over = True
                for k in wish:
                    if k[1] == t:
                        share[k] *= room / into
        if not over:
            break
    return share


def whole_shards(groups: list[tuple[int, int]], quota: list[int]) -> dict[int, list[int]]:
    """The shards that each group of ``(g, n)`` fills by itself, largest groups first."""
    free, out = [s for s in range(len(quota)) if quota[s]], {}
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        while fits := [s for s in free if quota[s] <= n]:
            s = max(fits, key=lambda s: (quota[s], -s))
            free.remove(s)
            out.setdefault(g, []).append(s)
            n -= quota[s]
    return out


def starts(groups: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int]]:
    """``(g, shard)`` where large groups start: best fit, longest first; what fits nowhere
    goes where most room is."""
    left, out = list(room), []
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        fits = [s for s in range(len(left)) if left[s] >= n]
        s = min(fits, key=lambda s: (left[s], s)) if fits else max(range(len(left)), key=lambda s: (left[s], -s))
        left[s] -= n
        out.append((g, s))
    return out


def propagate(linked: DataFrame, quota: list[int], rounds: int = 8) -> DataFrame:
    """``linked(g, n, shard, ...)`` with shards after the moves. A round joins each
    document with its text's most common shard that has room."""
    shards = len(quota)
    for step in range(rounds):
        hist = stage(linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")), "shard-hist")
        held = [0] * shards
        for r in hist.groupBy("shard").agg(F.sum("c")).collect():
            held[r[0]] = r[1]
        # a shard that is full, or nearly, takes nobody in, but keeps those it has
        full = [s for s in range(shards) if held[s] >= 0.98 * quota[s]]
        strength = F.struct(F.when(F.col("shard").isin(full), F.lit(0)).otherwise(F.col("c")).alias("c"), F.pmod(F.xxhash64("g", "shard"), F.lit(1024)).alias("h"), F.col("shard").alias("to"))
        best = hist.groupBy("g").agg(F.max(strength).alias("b")).select("g", F.col("b.to").alias("to"), F.col("b.c").alias("most"))
        # move only where at least as many neighbours are; on equal counts the hash has named one shard for all
        moves = stage(hist.join(best, "g").where("shard <> to and most >= c").select("g", "shard", "to", "c"), "shard-moves")
        wish = {(r[0], r[1]): r[2] for r in moves.groupBy("shard", "to").agg(F.sum("c")).collect()}
        if not wish:
            drop_stage(hist)
            drop_stage(moves)
            break
        share = admitted(wish, held, quota)
        part = F.lit(0.0)
        for (a, b), p in share.items():
            part = F.when((F.col("shard") == a) & (F.col("to") == b), F.lit(p)).otherwise(part)
        # small groups move whole, large ones (over 1/64 of a quota) document by document
        coin = F.pmod(F.when(F.col("n") * 64 > max(quota), F.xxhash64("doc_id", F.lit(step))).otherwise(F.xxhash64("g", "to", F.lit(step))), F.lit(1_000_003)) / F.lit(1_000_003.0)
        target = moves.select(F.col("g").alias("_g"), F.col("shard").alias("_s"), "to")
        moved = linked.join(target, (F.col("g") == F.col("_g")) & (F.col("shard") == F.col("_s")), "left")
        new = F.when(F.col("to").isNotNull() & (coin < part), F.col("to")).otherwise(F.col("shard"))
        old, linked = linked, stage(moved.withColumn("_new", new).select(*[F.col("_new").alias("shard") if c == "shard" else c for c in linked.columns]), "shard-round")
        for df in (old, hist, moves):
            drop_stage(df)
        if sum(n * share[k] for k, n in wish.items()) < 0.5:
            break
    return linked


CELL_ROWS = 1_000


def in_groups(linked: DataFrame, buckets: int) -> DataFrame:
    """``linked`` with ``slot``, the gapless rank within its shard: members of a group stand
    together, large groups first in their bucket. A group is dealt into cells of about
    CELL_ROWS rows; the order is made over cells and their counts, so no task holds the
    rows of a large group."""
    cell = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / CELL_ROWS)).cast("int")
    linked = linked.withColumn("cell", cell)
    cells = linked.groupBy("shard", "g", "n", "cell").agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard", "bucket").orderBy(F.desc("n"), "g", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("inside", F.coalesce(F.sum("c").over(before), F.lit(0)))
    above = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("shard", "bucket").agg(F.sum("c").alias("t")).select("shard", "bucket", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("outside"))
    cells = cells.join(starts, ["shard", "bucket"]).select("shard", "g", "cell", (F.col("inside") + F.col("outside")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "g", "cell").orderBy("doc_id", "uid")) - 1
    return linked.withColumn("rank", rank).join(cells, ["shard", "g", "cell"]).withColumn("slot", F.col("rank") + F.col("start")).drop("cell", "rank", "start")


def shard(docs: DataFrame, shards: int = 8, rounds: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.octet_length(text), F.crc32(text.cast("binary"))).alias("g"))
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    quota, buckets = quotas(total, shards), parts_for(total)
    # written first, so that Spark may split a large group's rows over many join tasks
    sizes = stage(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-sizes")
    rows = stage(rows.join(sizes, "g", "left").withColumn("n", F.coalesce("n", F.lit(1))), "shard-grouped")
    large = [(r[0], r[1]) for r in sizes.where(F.col("n") >= max(1, min(quota))).collect()]  # fewer than 2 * shards
    own = whole_shards(large, quota)
    taken = {s for found in own.values() for s in found}
    cols = ["doc_id", "size", "text_crc32", "g", "n", "uid"]
    alone = None
    if own:
        mine = global_rank(rows.where(F.col("g").isin(list(own))), ["g"], ["uid"], ["doc_id", "uid"], "_wl_rank", buckets)
        to, start, used = F.lit(None).cast("int"), F.lit(None).cast("bigint"), F.lit(0)
        for g, found in own.items():
            first = 0
            for s in found:
                inside = (F.col("g") == g) & (F.col("_wl_rank") >= first) & (F.col("_wl_rank") < first + quota[s])
                to, start = F.when(inside, F.lit(s)).otherwise(to), F.when(inside, F.lit(first)).otherwise(start)
                first += quota[s]
            used = F.when(F.col("g") == g, F.lit(first)).otherwise(used)
        mine = stage(mine.select(*cols, to.alias("shard"), (F.col("_wl_rank") - start).alias("slot"), used.alias("used")), "shard-own")
        alone = mine.where("shard is not null").select(*cols, "shard", F.col("slot").cast("bigint").alias("slot"))
        left = mine.where("shard is null").withColumn("n", F.col("n") - F.col("used"))
        rows = rows.where(~F.col("g").isin(list(own))).select(*cols).unionByName(left.select(*cols))
    room = [0 if s in taken else q for s, q in enumerate(quota)]
    open_ = [s for s in range(shards) if s not in taken] or [0]
    start = F.get(F.array(*[F.lit(s) for s in open_]), F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(len(open_))).cast("int"))
    linked = rows.where("n > 1").withColumn("shard", start)
    big = [(r[0], r[1]) for r in linked.where(F.col("n") * 64 > max(room)).select("g", "n").distinct().collect()]  # fewer than 64 * shards
    if big:
        first = rows.sparkSession.createDataFrame(starts(big, room), "g bigint, first int")
        linked = linked.join(F.broadcast(first), "g", "left").withColumn("shard", F.coalesce("first", "shard")).drop("first")
    linked = propagate(stage(linked, "shard-start"), room, rounds)
    # groups stand together, so that a quota cuts as few of them as can be
    placed = stage(in_groups(linked, buckets), "shard-placed")
    limit = F.element_at(F.array(*[F.lit(q) for q in room]), F.col("shard") + 1)
    kept = placed.where(F.col("slot") < limit)
    held = [0] * shards
    for r in kept.groupBy("shard").count().collect():
        held[r[0]] = r[1]
    # what passes a quota comes first, group by group, and single documents after it
    over = stage(placed.where(F.col("slot") >= limit).select(*cols), "shard-over")
    ahead = over.count()
    over = in_groups(over.withColumn("shard", F.lit(0)), buckets).select(*cols, F.col("slot").alias("_wl_pool"))
    single = global_rank(rows.where("n = 1").select(*cols), [], ["uid"], ["g", "doc_id"], "_wl_pool", buckets)
    pool = over.unionByName(single.withColumn("_wl_pool", F.col("_wl_pool") + ahead))
    to, start, first = F.lit(None).cast("int"), F.lit(None).cast("bigint"), 0
    for s in range(shards):
        free = room[s] - held[s]
        inside = (F.col("_wl_pool") >= first) & (F.col("_wl_pool") < first + free)
        to, start = F.when(inside, F.lit(s)).otherwise(to), F.when(inside, F.lit(held[s] - first)).otherwise(start)
        first += free
    filled = pool.select(*cols, to.alias("shard"), (F.col("_wl_pool") + start).alias("slot"))
    both = kept.select(*cols, "shard", F.col("slot").cast("bigint").alias("slot")).unionByName(filled)
    both = both.unionByName(alone) if alone is not None else both
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
