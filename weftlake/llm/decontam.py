"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts and benchmark items are cut at white space; a token that holds digits becomes
``<num>`` (with a unit glued to it, too), and so does an English number word; a unit after a number
becomes ``<unit>``, a capitalised word inside a sentence ``<name>``, and so does a word in
capitals after one that ends in a small letter, a digit or a comma, and a sentence's first
word before a capitalised one or with a possessive ending; other tokens are lower-cased
and lose their outer punctuation. Any other first word of a sentence stands for itself,
which costs a question with another name there one word of its coverage. Windows of ``window`` such tokens are hashed and
hash-joined with those of the items. Matched windows are gathered by occurrence: those
with the same offset (place in the document minus place in the item), those whose
offsets differ by up to a quarter of the item, and, for items that are spread out,
those of the whole document. In one of them they must cover enough of the item's
tokens, and its slots must be consistent: equal slot values of the item have to stand
for equal values there, and the other way round. Slot values are only looked up for
occurrences that cover their item. The best occurrence of each document and item is returned. A
question with other numbers or names is caught so, with kind ``template``; equal
values give ``verbatim``. A window with fewer than two plain tokens matches its own
words only.

Before places are gathered, documents and items whose matched windows can't cover enough
of the item are left out by a bound taken from a bit for each place, so that a window that
many items share costs one aggregated row for each document and item.

Defined results: null and empty texts and items match nothing; an item of fewer
tokens than a window is matched by one window of its own length; one of one or two words
(below ``LEAST_WORDS``) only matches a text that consists of it; items that repeat id
and text are one item, document rows that do so give one hit; rows that share an id
but not a text are judged, and dropped, one by one; a null id is an id of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import drop_stage, fresh, stage

WINDOW, COVERAGE, CONSISTENCY = 5, 0.8, 0.8
#: Largest number of item windows that is sent to every executor; beyond it the join shuffles.
BROADCAST_WINDOWS = 400_000
# Common units of measure.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs day days week weeks month months year years kb mb gb tb hz khz mhz ghz w kw kwh v a c f k % percent usd eur gbp dollars dollar euros euro cents cent km/h mph m/s meters metres meter metre miles mile hours hour minutes minute seconds second grams gram kilograms kilometers liters litres".split()
PUNCT = ".,;:!?\"'()[]{}«»“”‘’…*#&$@~^_|\\/+=`´·–—-¡¿%"
SLOTS = ("<num>", "<name>", "<unit>")
#: Items of fewer words are held against whole texts: as a passage they say nothing.
LEAST_WORDS = 3
# English number words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, longest first, by first letter: most places of a text are left after one look."""
    by = {c: sorted((w[1:] for w in words if w[0] == c), key=lambda u: (-len(u), u)) for c in sorted({w[0] for w in words})}
    return f"(?=[{''.join(by)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


_number = _any_of(NUMBER_WORDS)
_numbers = _number + "(?:-" + _number + r")*(?=[\s.,;:!?)\"'”]|\z)"
# what stands at few places of a text is asked first: a capital, and no small letter
NAMES = r"(?=\p{Lu})(?:(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+|(?<=[\p{Ll}\p{Nd},] )\p{Lu}{2,}(?!\p{L})|(?<=\A|[.!?]\s)\p{Lu}\p{Ll}+(?= \p{Lu}\p{Ll}|['’]s\s))"
NUMBERS = r"(?![a-z])(?:[^\s\p{L}\p{N}]?\d[^\s]*|([\s(\"'“])" + _numbers + r")|\A" + _numbers


def canonical(text: Column) -> Column:
    """The text with typed placeholders, lower-cased; tokens keep their places."""
    x = F.lower(F.regexp_replace(text, NAMES, "<name>"))
    x = F.regexp_replace(x, NUMBERS, "$1<num>")
    return F.regexp_replace(x, r"<num>(\s)(?:" + "|".join(u.replace("/", "\\/") for u in sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?=[\s.,;:!?)]|\z)", "<num>$1<unit>")


_strip = lambda t: F.btrim(t, F.lit(PUNCT))
_is_slot = lambda t: F.regexp_like(t, F.lit("<(?:num|name|unit)>"))


def tokens(rows: DataFrame, key: str) -> DataFrame:
    """``key, raw, can``: a text's words and their canonical forms, place by place."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+|\s+\z", ""))
    rows = rows.select(key, text.alias("t")).where("t <> ''")
    return rows.select(key, F.split("t", r"\s+").alias("raw"), F.split(canonical(F.col("t")), r"\s+").alias("can"))


def windows(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """``key, n, hash, pos, len`` for every window of ``rows(key, text)``. Several lengths
    serve items shorter than a window."""
    rows = tokens(rows, key)
    rows = rows.select(key, "raw", "can", F.transform("can", lambda t: F.xxhash64(_strip(t))).alias("h"), F.exists("can", lambda t: t.contains("<")).alias("has"))
    # a window of placeholders says nothing of its template: with fewer than two plain tokens it stands for its own words
    rows = rows.withColumn("s", F.when(F.col("has"), F.transform("can", lambda t: _is_slot(t).cast("int"))))

    def of_length(w: int) -> Column:
        n = F.size("h") - (w - 1)
        bare = lambda i: F.col("has") & (sum((F.get("s", i + d) for d in range(w)), F.lit(0)) > max(0, w - 2))
        own = lambda i: F.xxhash64(F.transform(F.slice("raw", i + 1, w), lambda t: F.xxhash64(_strip(F.lower(t)), F.lit(1))))
        code = lambda i: F.when(bare(i), own(i)).otherwise(F.xxhash64(F.slice("h", i + 1, w)))
        body = lambda i: F.struct(i.alias("pos"), code(i).alias("hash"), F.lit(w).alias("len"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), body))

    each = [of_length(w) for w in lengths]
    every = each[0] if len(each) == 1 else F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return rows.select(key, F.size("h").alias("n"), F.explode(every).alias("w")).select(key, "n", "w.hash", "w.pos", "w.len")


def slots(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``key, at, value`` of the words that stand at placeholders."""
    place = F.posexplode(F.arrays_zip("raw", "can"))
    found = tokens(rows, key).select(key, place.alias(at, "z")).where(_is_slot(F.col("z.can")))
    return found.select(key, at, _strip(F.lower("z.raw")).alias(value))


def _row(df: DataFrame, *cols: str) -> Column:
    """A name for a row by its id and text; nulls have a place in it."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def found_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """As :func:`leaks`, with ``rid``, the document row's name."""
    items = items.select("item_id", "text", _row(items, "item_id", "text").alias("iid")).dropDuplicates(["iid"])
    docs = docs.select("doc_id", "text", _row(docs, "doc_id", "text").alias("rid"))
    words = F.size(F.split(F.regexp_replace("text", r"\A\s+|\s+\z", ""), r"\s+"))
    short = [r[0] for r in items.where(F.trim("text") != "").select(words.alias("n")).where(f"n < {window}").distinct().collect()]  # at most window - 1 values
    # an item keeps the windows of its own length (short ones) or of the usual one
    bench = windows(items, "iid", sorted({*short, window})).where(F.col("len") == F.least("n", F.lit(window)))
    bench = bench.select("iid", F.col("n").alias("n_item"), F.col("hash").alias("h2"), F.col("pos").alias("at"), F.col("len").alias("len2"))
    if bench.count() <= BROADCAST_WINDOWS:
        bench = F.broadcast(bench)
    found = windows(docs, "rid", sorted({*short, window}))
    hits = found.join(bench, (F.col("hash") == F.col("h2")) & (F.col("len") == F.col("len2")))
    hits = hits.where((F.col("n_item") >= LEAST_WORDS) | (F.col("n") == F.col("n_item")))
    # written, so that documents are cut into windows once
    met = stage(hits.select("rid", "iid", "n_item", "pos", "at", "len"), "leaks-met")
    # matched places of an item, modulo 64: so many times ceil(n_item / 64) times a window is the most they can cover
    seen = met.groupBy("rid", "iid", "n_item").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at") % 64)).alias("m"), F.max("len").alias("len"))
    enough = seen.where(F.bit_count("m") * F.ceil(F.col("n_item") / 64) * F.col("len") >= F.col("n_item") * coverage).select("rid", "iid")
    hits = met.join(enough, ["rid", "iid"], "left_semi")
    # words of the document that stand for words of the item; overlapping windows name them once
    place = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1))
    hits = hits.select("rid", "iid", "n_item", (F.col("pos") - F.col("at")).alias("offset"), place.alias("p")).distinct()
    # occurrences: all of the document (0), overlapping ranges of offsets (1), one offset (2)
    step = F.greatest(F.lit(1), F.floor(F.col("n_item") / 4)).cast("int")
    at = lambda level, where: F.struct(F.lit(level).alias("level"), where.cast("bigint").alias("place"))
    near = F.floor(F.col("offset") / step)
    hits = hits.withColumn("occ", F.explode(F.array(at(0, F.lit(0)), at(1, near), at(1, near - 1), at(2, F.col("offset")))))
    hits = hits.withColumn("d", F.col("p") + F.col("offset"))
    key = ["rid", "iid", "occ"]
    covered = hits.groupBy(*key, "n_item").agg(F.count_distinct("p").alias("covered"), F.min("d").alias("first_word"), F.max("d").alias("last_word")).where(F.col("covered") / F.col("n_item") >= coverage)
    covered = stage(covered, "leaks-covered")
    # slots are only looked up for occurrences that cover their item
    asked = slots(items, "iid", "p", "a")
    given = slots(docs.join(covered.select("rid").distinct(), "rid", "left_semi").dropDuplicates(["rid"]), "rid", "d", "s")
    pairs = hits.join(covered.select(*key), key, "left_semi").join(asked, ["iid", "p"]).join(given, ["rid", "d"])
    votes = stage(pairs.groupBy(*key, "a", "s").agg(F.count(F.lit(1)).alias("n")), "leaks-votes")
    drop_stage(met)
    # both ways: a value of the item has one value there, and the other way round
    ways = [votes.groupBy(*key, x).agg(F.max("n").alias("top"), F.sum("n").alias("all")).groupBy(*key).agg((F.sum("top") / F.sum("all")).alias(f"by_{x}")) for x in ("a", "s")]
    same = votes.groupBy(*key).agg(F.bool_and(F.col("a") == F.col("s")).alias("same"))
    agreed = ways[0].join(ways[1], key).join(same, key)
    each = covered.join(agreed, key, "left").withColumn("consistency", F.coalesce(F.least("by_a", "by_s"), F.lit(1.0))).withColumn("same", F.coalesce("same", F.lit(True))).where(F.col("consistency") >= consistency)
    # the best: verbatim, consistent, covered, close together, early
    best = F.max(F.struct("same", "consistency", "covered", F.col("occ.level").alias("level"), (-F.col("first_word")).alias("early"), "last_word")).alias("o")
    out = each.groupBy("rid", "iid", "n_item").agg(best)
    named = docs.select("rid", "doc_id").join(out.select("rid").distinct(), "rid", "left_semi").distinct()
    out = out.join(named, "rid").join(items.select("iid", "item_id"), "iid")
    return out.select("rid", "doc_id", "item_id", F.col("n_item").cast("bigint").alias("n_item"), F.col("o.covered").cast("bigint").alias("covered"), (F.col("o.covered") / F.col("n_item")).alias("coverage"), F.col("o.consistency").alias("consistency"), F.when(F.col("o.same"), F.lit("verbatim")).otherwise(F.lit("template")).alias("kind"), (-F.col("o.early")).cast("bigint").alias("first_word"), F.col("o.last_word").cast("bigint").alias("last_word"))


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Hits only: ``doc_id, item_id, n_item, covered, coverage, consistency, kind,
    first_word, last_word`` (the matched region in the document's words)."""
    return found_leaks(docs, items, **options).drop("rid")


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The document rows without a hit; all their columns."""
    key = fresh(docs, "_wl_id")
    dirty = found_leaks(docs, items, **options).select(F.col("rid").alias(key)).distinct()
    return docs.withColumn(f"{key}_", _row(docs, "doc_id", "text")).join(dirty, F.col(f"{key}_") == F.col(key), "left_anti").drop(f"{key}_")
