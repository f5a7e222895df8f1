import re

import pytest
from pyspark.sql import functions as F

from duskwatch.llm import decontaminate
from duskwatch.llm.decontaminate import find_leaks, without_leaks

ITEMS = [
    (1, "Yesterday Alice bought 12 apples for 3 dollars each, and then Bob gave her 12 more apples; how many apples are there in the end?"),
    (2, "What is the capital of France?"), (3, ""), (4, None), (None, "nothing to see here at all in this place"), (5, "7 8 9"),
    (6, "the quick brown fox jumps over the lazy dog while the other dogs sleep under a tree"),
]
PAD = "some other words that stand before and have no part in it "
TEXTS = [
    (10, PAD + ITEMS[0][1] + " and more after", {(1, "copy")}),
    (11, PAD + "Yesterday Carol Smith bought 40 apples for 5 dollars each, and then Dave gave her 40 more apples; how many apples are there in the end?", {(1, "reparameterised")}),
    (12, "Yesterday Carol bought 40 apples for 5 dollars each, and then Dave gave her 41 more apples; how many apples are there in the end?", set()),
    (13, "yesterday they bought apples for each other and nothing else happened in the end", set()),
    (14, "He asked: what is the capital of France? Paris.", {(2, "copy")}),
    (15, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG WHILE THE OTHER DOGS SLEEP UNDER A TREE", {(6, "copy")}),
    (16, "the quick brown fox jumps over the lazy dog", set()), (17, "", set()), (18, None, set()), (None, PAD + ITEMS[5 + 1][1], {(6, "copy")}),
    (19, "7 8 9", set()), (20, "the 5kg quick brown fox jumps", set()), (21, "word " * 30_000 + ITEMS[6][1], {(6, "copy")}),
]


@pytest.mark.parametrize("listed", [2_000_000, 0])
def test_leaks(spark, monkeypatch, listed):
    monkeypatch.setattr(decontaminate, "LISTED_WINDOWS", listed)
    docs = spark.createDataFrame([t[:2] for t in TEXTS] * 2, "doc_id long, text string").withColumn("window", F.lit(1)).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {}
    for r in find_leaks(docs, items).collect():
        found.setdefault(r.doc_id, []).append((r.item_id, r.kind))
    for doc_id, _, want in TEXTS:
        got = found.get(doc_id, [])
        assert len(got) == len(set(got)) and set(got) == want, doc_id
    left = without_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(t[0]) for t in TEXTS if not t[2] for _ in range(2))


def test_units_and_numbers(spark):
    items = spark.createDataFrame([(1, "a train travels 300 km in 4 hours at a steady speed, how fast is it moving on average")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a train travels 120 miles in 2 days at a steady speed, how fast is it moving on average"), (2, "a train travels 120mi in 2h at a steady speed, how fast is it moving on average")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kind) for r in find_leaks(docs, items).collect()) == [(1, "reparameterised"), (2, "reparameterised")]


def test_odd_and_empty_tables(odd, none, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_leaks(odd, items).collect() == []
    assert without_leaks(odd, items).count() == odd.count()
    assert find_leaks(none, items).collect() == []
    assert without_leaks(odd, items.limit(0)).count() == odd.count()
    own = odd.where("text IS NOT NULL").select(F.col("doc_id").alias("item_id"), "text").where("item_id IN (1, 103, 111)")
    assert {1, 103}.issubset({r.doc_id for r in find_leaks(odd, own).collect()})


SPARSE = [
    (1, "77 88 99"), (2, "12 + 30 = 42 , 8 + 9 = 17 , 5 + 6 = 11"), (3, "when Alice 12 Bob 14 Carol 15 Dave 16 Erin 17 Frank 18"),
    (4, "we read the following list of numbers aloud 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"),
]


@pytest.mark.parametrize("listed", [2_000_000, 0])
def test_items_of_numbers_and_names(spark, tmp_path, monkeypatch, listed):
    import corpus_pipeline
    from duskwatch.llm.queries import op5_decontaminate

    monkeypatch.setattr(decontaminate, "LISTED_WINDOWS", listed)
    other = "we read the following list of numbers aloud 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48 49 50"
    texts = [(i, "before all that " + t + " and after") for i, t in SPARSE] + [
        (5, "77 88 100"), (6, "12 + 31 = 43 , 8 + 7 = 15 , 5 + 9 = 14"), (7, "when Alice 13 Bob 15 Carol 16 Dave 17 Erin 18 Frank 19"), (8, other),
        (9, "when Bob Alice 12 Alice Bob 14 Bob Carol 15 Erin Dave 16 Dave Erin 17 Carol Frank 18"),
    ]
    spark.createDataFrame(SPARSE, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.item_id): r for r in op5_decontaminate(spark, str(tmp_path)).collect()}
    assert set(found) == {(i, i) for i in range(1, 5)}
    assert {r.kind for r in found.values()} == {"copy"} and found[4, 4].windows == 21
    assert sorted(r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()) == [5, 6, 7, 8, 9]


def test_one_deviating_value_voids_only_its_windows(spark):
    middle = " and then we walked along the river until the sun went down behind the hills"
    item = "Yesterday they paid 12 dollars to Alice" + middle + " and at last they paid 12 dollars more to Alice before the long way back home began"
    texts = [
        (1, item), (2, item.replace("12 dollars more", "13 dollars more")), (3, item.replace("more to Alice", "more to Bob")),
        (4, item.replace("12", "40").replace("Alice", "Bob")),
    ]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r for r in find_leaks(docs, items).collect()}
    assert set(found) == {1, 2, 3, 4} and found[1].kind == "copy" and found[1].matched == found[1].windows
    assert {found[i].kind for i in (2, 3, 4)} == {"reparameterised"} and found[4].matched == found[4].windows
    # the windows over the value that differs, and no others
    assert found[2].windows - found[2].matched == 8 and found[3].windows - found[3].matched == 8


def leaks(spark, items, texts, **options):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return sorted(((r.doc_id, r.item_id, r.kind) for r in found), key=str)


NAMED = "Alice has 5 apples and Bob has 7 apples. How many apples do Alice and Bob have together?"


def test_items_are_known_by_their_text(spark):
    other = "the quick brown fox jumps over the lazy dog while all the others sleep under a very old tree by the river"
    items = [(1, NAMED), (1, other), (None, "to be or not to be that is the question that we ask every single day"), (2, other), (2, other)]
    texts = [(10, "first " + NAMED + " last"), (11, other), (12, "well to be or not to be that is the question that we ask every single day indeed"), (13, "nothing")]
    want = [(10, 1, "copy"), (11, 1, "copy"), (11, 2, "copy"), (12, None, "copy")]
    assert leaks(spark, items, texts) == want
    assert leaks(spark, items, texts, verbatim=True, sparse=True) == want


def test_copies_in_other_capitals(spark):
    texts = [(1, NAMED), (2, NAMED.lower()), (3, NAMED.upper()), (4, "so " + NAMED.title() + " ok"), (5, NAMED.replace("apples", "pears").lower())]
    assert [r[0] for r in leaks(spark, [(1, NAMED)], texts, verbatim=True)] == [1, 2, 3, 4]
    assert leaks(spark, [(1, "7 8 9")], [(1, "1 7 8 9"), (2, "7 8 10")], verbatim=True) == [(1, 1, "copy")]


QUESTIONS = [
    ("Ein Zug fährt mit zwei Wagen und braucht drei Stunden für die ganze lange Strecke, wie schnell ist er im Mittel?", [("zwei", "drei"), ("drei Stunden", "vier Tage")]),
    ("Un train roule pendant deux heures et parcourt trois cents kilomètres, quelle est donc sa vitesse moyenne ?", [("deux heures", "sept jours"), ("trois", "quatre")]),
    ("Un tren recorre cinco kilómetros en dos horas y luego se para, ¿cuál es entonces su velocidad media?", [("cinco", "ocho"), ("dos horas", "tres minutos")]),
    ("A train travels 300 km in four hours at a steady speed and then it stops for a while, how fast was it?", [("300 km", "120 miles"), ("four", "nine")]),
]


def test_other_numbers_in_four_languages(spark):
    texts = []
    for i, (text, swaps) in enumerate(QUESTIONS):
        # from the last to the first, so that no swap meets another's outcome
        for old, new in reversed(swaps):
            text = text.replace(old, new, 1)
        texts.append((i, "Davor steht etwas. " + text))
    found = leaks(spark, [(i, q[0]) for i, q in enumerate(QUESTIONS)], texts, sparse=True, verbatim=True)
    assert found == [(i, i, "reparameterised") for i in range(4)]


def test_windows_that_all_items_share(spark):
    frame = "please answer the following question in one short sentence and give your reason as well"
    items = [(i, f"{frame} word{'abcdefghij'[i]} is the {'klmnopqrst'[i]}th thing that was asked here today by them all") for i in range(10)]
    texts = [(i, "x " + t) for i, t in items] + [(50, frame), (51, "no " + frame + " at all")]
    assert leaks(spark, items, texts) == [(i, i, "copy") for i in range(10)]


def brute_tokens(text):
    """Template tokens of a text by single steps: (kind or lower-cased word, value)."""
    import re

    from duskwatch.llm.decontaminate import BEFORE_NOUNS, NUMBER_WORDS, PER, UNITS

    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    out, before, raw_before, gap = [], None, "", ""
    for m in re.finditer(r"([\x20\x09-\x0D]*)([^\x20\x09-\x0D]+)", re.sub(r"(\d)(?=[^\W\d_])", r"\1 ", text)):
        raw = m.group(2)
        word = re.sub(r"^[^A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff]+$", "", raw)
        gap += m.group(1)
        if not word:
            gap += raw
            continue
        value = low(word)
        number = bool(re.fullmatch(r"[0-9.,:/-]*[0-9][0-9.,:/-]*", word)) or value in NUMBER_WORDS
        unit = before is not None and (before == "number" or last in PER) and value in UNITS
        capital = word[0].isascii() and word[0].isupper() or 0xC0 <= ord(word[0]) <= 0xDE
        inside = before is not None and raw_before[-1] not in ".!?:;\"'()|" and "\n" not in gap and last not in BEFORE_NOUNS
        name = capital and len(word) > 1 and not ("A" <= word[1] <= "Z") and inside and not number and not unit
        kind = "number" if number else "unit" if unit else "name" if name else "word"
        if kind == "name" and before == "name":
            out[-1] = ("name", value)
        else:
            out.append((kind if kind != "word" else value, value))
        before, raw_before, gap, last = kind, raw, "", value
    return out


def test_template_tokens_equal_brute_force():
    import random

    import numpy as np
    import pyarrow as pa

    from duskwatch.llm.decontaminate import NAME, NUMBER, UNIT, Template
    from duskwatch.llm.tokens import Words

    rng = random.Random(4)
    parts = ["Alice", "Bob", "der", "Hund", "12", "3.5", "km", "hours", "zwei", "5kg", "apples,", "ran.", "(and)", "\n", "Zoë", "Élan", "USA", "--", "how?", "A", "1/2", "B2b", "x", "per", "hour"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "  ", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [NAMED, "", "?!"]
    t = Template(pa.array(texts))
    code = {"number": NUMBER, "unit": UNIT, "name": NAME}
    hashed = lambda words: Words(pa.array([" ".join(words)])).hashes() if words else np.zeros(0, np.uint64)
    for i, text in enumerate(texts):
        want = brute_tokens(text)
        got = slice(t.first[i], t.first[i + 1])
        assert (t.value[got] == hashed([v for _, v in want])).all() if want else t.first[i] == t.first[i + 1], text
        kinds = [code.get(k) for k, _ in want]
        literal = hashed([k for k, _ in want])
        assert [int(x) for x in t.token[got]] == [int(k if k is not None else h) for k, h in zip(kinds, literal)], text


FRAMES = [
    "{a} bought {n} apples at the market on the way home and then gave {m} of them to {b}. How many apples does {a} have left?",
    "A train leaves the station at noon and travels {n} km in {m} hours without a single stop. What is its average speed?",
    "There are {n} students in the class of {a}, and {m} of them play football after school. How many do not play?",
    "The water tank holds {n} liters, and {a} fills it at {m} liters per minute until it is full. How long does it take?",
    "{a} reads {n} pages every day and {b} reads {m} pages every day. How many pages do both of them read in a week?",
    "If {n} workers build a wall in {m} days, how many days do they need for a wall of twice the size with the same speed?",
    "{a} is {n} years old and {b} is {m} years older than that. How old will {b} be in ten years from now?",
    "A farmer sells {n} eggs for {m} dollars each and pays the rent with half of it; how much money is left in the end?",
    "What is {n} + {m} ?", "{a} has {n} cats.", "Compute {n} x {m} .", "{n} , {m} , {n} , {m}",
]


def test_recall_of_items_with_other_names_and_numbers(spark):
    """Every name, number and unit changed, one to one: all items of ten tokens and more are found; short ones are not, and nothing else is."""
    items = [(i, f.format(a="Alice", b="Bob", n=12 + i, m=5)) for i, f in enumerate(FRAMES)]
    units = {"km": "miles", "hours": "days", "liters": "gallons", "dollars": "euros", "minute": "hour"}
    texts = []
    for i, f in enumerate(FRAMES):
        text = f.format(a="Carol", b="Dave", n=70 + i, m=31)
        texts.append((i, "As we said before. " + re.sub(r"\w+", lambda w: units.get(w.group(), w.group()), text)))
    found = {(d, i): kind for d, i, kind in leaks(spark, items, texts, sparse=True, verbatim=True)}
    assert set(found.values()) == {"reparameterised"} and set(found) == {(i, i) for i in range(8)}
