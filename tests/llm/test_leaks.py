"""Decontamination: what is typed, and items of few words."""

import pytest

from weftlake.llm import decontam

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = decontam.leaks(docs, spark.createDataFrame(list(enumerate(items)), ITEMS)).collect()
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in rows}


@pytest.mark.parametrize(
    "text, canonical",
    [
        ("he has seven apples", "he has <num> apples"),
        ("he has twenty-five apples, not Seven.", "he has <num> apples, not <name>."),
        ("it took seven hours (eight hours)", "it took <num> <unit> (<num> <unit>)"),
        ("someone often weighs a phone", "someone often weighs a phone"),
        ("we saw that ANNA left", "we saw that <name> left"),
        ("ALL IN CAPITALS HERE", "all in capitals here"),
        ("Anna Smith sold it. Bob's car went", "<name> <name> sold it. <name>'s car went"),
        ("The car went. If so", "the car went. if so"),
        ("for 3 kg", "for <num> <unit>"),
    ],
)
def test_canonical(spark, text, canonical):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(decontam.canonical(F.col("t")).alias("c")).first()
    assert row["c"] == canonical


def test_number_words_and_names_are_slots(spark):
    q = "{} sells {} apples at the market and buys {} pears with it so how many dollars will {} have left today"
    item = q.format("Anna", "seven", "seven", "Anna")
    texts = [
        q.format("Maria", "nine", "nine", "Maria"),
        "Before it. " + q.format("Tom", "12", "12", "TOM") + " And after.",
        q.format("Maria", "nine", "four", "Maria"),  # one value of the item has two there
        item,
        item.lower(),
        "Nobody sells seven of anything at the market .",
    ]
    got = found(spark, texts, [item])
    assert {d: k for (d, _), k in got.items() if d != 4} == {0: "template", 1: "template", 3: "verbatim"}
    assert (4, 0) in got  # small letters throughout: coverage holds


def test_items_of_one_or_two_words_are_whole_texts(spark):
    texts = ["the cat sat on the mat", "The.", "in fact so", "In fact", "one of them", "one", "a short item here", None, ""]
    got = found(spark, texts, ["the", "in fact", "one", "short item here"])
    assert got == {(1, 0): "verbatim", (3, 1): "verbatim", (5, 2): "verbatim", (6, 3): "verbatim"}
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    kept = decontam.keep_clean(docs, spark.createDataFrame([(0, "the"), (1, "in fact")], ITEMS))
    assert {r["doc_id"] for r in kept.collect()} == set(range(9)) - {1, 3}


def test_a_window_that_all_items_share(spark):
    """A common phrase in every item and document makes no hit; long items are found whatever their length."""
    phrase = "which of the following is true"
    items = [f"{phrase} " + " ".join(f"i{k}w{j}" for j in range(20 + 30 * k)) for k in range(6)]
    texts = [f"{phrase} about d{i} and so on " * 4 for i in range(20)] + [f"x y z {items[5]} z"]
    assert found(spark, texts, items) == {(20, 5): "verbatim"}


def test_canonical_against_plain_rules(spark):
    """The factored patterns against the rules said one by one, over made texts."""
    import random

    import regex
    from pyspark.sql import functions as F

    word = "(?:" + "|".join(sorted(decontam.NUMBER_WORDS, key=len, reverse=True)) + ")"
    unit = "(?:" + "|".join(regex.escape(u) for u in sorted(decontam.UNITS, key=len, reverse=True)) + ")"

    def plain(t):
        t = regex.sub(r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+|(?<=[\p{Ll}\p{Nd},] )\p{Lu}{2,}(?!\p{L})|(?<=\A|[.!?][ \n\t])\p{Lu}\p{Ll}+(?= \p{Lu}\p{Ll}|['’]s[ \n\t])", "<name>", t).lower()
        t = regex.sub(rf"[^ \n\t\p{{L}}\p{{N}}]?[0-9][^ \n\t]*|(?<![^ \n\t(\"'“]){word}(?:-{word})*(?=[ \n\t.,;:!?)\"'”]|\Z)", "<num>", t)
        return regex.sub(rf"<num>([ \n\t]){unit}(?=[ \n\t.,;:!?)]|\Z)", r"<num>\1<unit>", t)

    random.seed(11)
    bits = [*decontam.NUMBER_WORDS[:14], "Seven", "SIX", "twenty-five", "Anna", "BOB", "Émile", "ÄÖ", "x", "3", "3kg", "$5", "kg", "hours", "’s ", "'s ", *".,()\"“”'-!²½<>", "𝐀bc", "😀", "\n", "\t", *" " * 8]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 25))) for _ in range(20_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS).select("doc_id", decontam.canonical(F.col("text")).alias("c")).collect()
    assert [(texts[r["doc_id"]], r["c"]) for r in rows if r["c"] != plain(texts[r["doc_id"]])] == []
