import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, _row string, component_id long"


def make_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, clashing extra columns."""
    rng = random.Random(5)
    words = [a + b for a in ("an", "the", "ti", "ou", "re", "É") for b in ("er", "ing", "Sh", "ble", "q", "ßt")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 12, 40, 90]))) for _ in range(40)]
    long_ = " ".join(rng.choice(words) for _ in range(9000))
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]
    for k in range(60, 72):
        near = texts[39].split() if k % 2 else texts[3].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            near[rng.randrange(len(near))] = "changed"
        rows.append((k, " ".join(near), "en", "hot"))
    rows += [(80 + i, texts[4].upper() if i % 2 else texts[4], "de", "hot") for i in range(8)]
    rows += [(100, None, None, None), (101, "", "en", "s1"), (102, " \t\n ", "en", "s1"), (103, long_, "fr", "s2"), (104, long_ + " x", "fr", "s2")]
    rows += [(105, "### ||| 12 34", "en", "s1"), (None, texts[5], None, "s3"), (None, None, None, None), (7, texts[7], "en", "s3"), (7, texts[7], "en", "s3"), (7, texts[8], "en", "s3")]
    rows += [(110, "a\n\nb c d\nb c d\n  \na\n", "en", "s1"), (111, "x" * 300_000, "en", "s1")]
    return [(*r, None, 3, None, "extra", -1) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
