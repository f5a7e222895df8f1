import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duskwatch.llm import language
from duskwatch.llm.language import BYTE_FLOOR, VOCABULARY, Pieces, count_words, expected, identify_language, learn, learn_words, word_scores
from duskwatch.llm.tokens import LETTER, Words

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pieces():
    return Pieces()


def brute(pieces, p, word):
    """Sum over all segmentations by recursion, through the vocabulary itself."""
    data = word.encode()
    w = Words(pa.array([word]), ~LETTER)
    find = lambda tables, a, b: int(pieces.rows(tables, w.span_hashes(np.array([a]), np.array([b])))[0])

    def rest(i):
        if i == len(data):
            return np.ones(p.shape[1])
        total = np.zeros(p.shape[1])
        for j in range(i + 1, min(len(data), i + pieces.longest) + 1):
            row = find(pieces.inner, i, j)
            chance = p[row] if row else np.full(p.shape[1], BYTE_FLOOR if j == i + 1 else 0)
            if chance.any():
                total = total + chance * rest(j)
        return total

    total = p[1] * rest(0)
    for j in range(1, min(len(data), pieces.longest) + 1):
        row = find(pieces.start, 0, j)
        if row:
            total = total + p[row] * rest(j)
    return np.log(total)


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(0)
    p = rng.random((pieces.size, 3))
    p[0] = 0
    p /= p.sum(0)
    words = ["a", "the", "schön", "Étation", "zzqx", "internationally"]
    w = Words(pa.array([" ".join(words)]), ~LETTER)
    got = word_scores(pieces, p, w, np.arange(len(words)))
    for i, x in enumerate(words):
        assert got[i] == pytest.approx(brute(pieces, p, x), rel=1e-9), x


def test_every_piece_is_found(pieces):
    assert len({int(r) for t in pieces.start + pieces.inner for r in t[2][t[2] > 0]}) == pieces.size - 2


def test_long_words_stay_finite(pieces):
    p = np.full((pieces.size, 2), 1 / pieces.size)
    w = Words(pa.array(["q" * 3000]), ~LETTER)
    assert np.isfinite(word_scores(pieces, p, w, np.array([0]))).all()


def test_learned_probabilities_sum_to_one(pieces):
    p = learn(pieces, pa.array(["the cat", "le chat"]), np.array([0, 1]), 2)
    assert p.sum(0) == pytest.approx([1, 1])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_odd_rows(odd, none):
    rows = identify_language(odd.withColumn("letter", F.lit(1))).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[100] == by[101] == by[102] == by[105] == "und"
    assert identify_language(none).collect() == []
    assert {r.lang_pred for r in identify_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_no_letter_piece_is_left_out(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    raw = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    long_ = sorted(x for x in raw if len(x.encode()) > 15 and LETTER[np.frombuffer(x.encode(), np.uint8)].all())
    assert len(long_) > 50
    for x in long_:
        begins = x.startswith("▁")
        w = Words(pa.array([x.removeprefix("▁")]), ~LETTER)
        assert pieces.rows(pieces.start if begins else pieces.inner, w.span_hashes(w.start, w.end))[0] > 0, x


WORDS = ["a", "chat", "straße", "communication", "x" * 70, "internationally" * 4, "é" * 33]


def test_expected_counts_are_derivatives(pieces):
    """A piece's expected count is its probability times the derivative of the word's log probability, also in words over 40 bytes."""
    rng = np.random.default_rng(1)
    p = rng.random((pieces.size, 2))
    p[0] = 0
    p /= p.sum(0)
    for word in WORDS:
        w = Words(pa.array([word]), ~LETTER)
        got = expected(pieces, p, w, np.array([1]), np.array([3]))
        assert not got[:, 0].any()
        for row in np.argsort(got[:, 1])[-3:]:
            assert got[row, 1] > 0
            up, down = p.copy(), p.copy()
            up[row, 1] *= 1 + 1e-5
            down[row, 1] *= 1 - 1e-5
            slope = (word_scores(pieces, up, w, np.array([0])) - word_scores(pieces, down, w, np.array([0])))[0, 1] / 2e-5
            assert got[row, 1] == pytest.approx(3 * slope, rel=1e-4), (word, row)


def test_stretches_of_a_long_word_join(pieces, monkeypatch):
    p = learn(pieces, pa.array([" ".join(WORDS), "die der das"]), np.array([0, 1]), 2)
    w = Words(pa.array([" ".join(WORDS)]), ~LETTER)
    lang, n = np.array([0, 1, 0, 1, 0, 1, 0]), np.arange(1, 8)
    scores, counts = word_scores(pieces, p, w, np.arange(len(w))), expected(pieces, p, w, lang, n)
    whole = language._blocks
    monkeypatch.setattr(language, "_blocks", lambda a, b, c, size=0: whole(a, b, c, 50))
    assert word_scores(pieces, p, w, np.arange(len(w))) == pytest.approx(scores, rel=1e-12)
    assert expected(pieces, p, w, lang, n) == pytest.approx(counts, rel=1e-9, abs=1e-12)


def test_tasks_learn_as_one_process_does(spark, pieces):
    texts = pa.array([" ".join(WORDS), "Der Hund, der Hund", "", "the dog THE Dog", "12 34"])
    lang = np.array([0, 1, 1, 0, 1])
    rows = [r for b in count_words(texts, lang, 2) for r in b.to_pylist()]
    assert sorted((r["word"], r["n"]) for r in rows if r["word"] in ("der", "dog", "the")) == [("der", 2), ("dog", 2), ("the", 2)]
    words = spark.createDataFrame([(r["word"], r["lang"], r["n"]) for r in rows], "word string, lang int, n long").repartition(3)
    assert learn_words(words, pieces, 2) == pytest.approx(learn(pieces, texts, lang, 2), rel=1e-6)


SCHEMA = "doc_id long, text string, lang string"
FREE = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 4 != 2]


def test_words_over_40_bytes_are_learned(spark):
    words = {"en": "zqxj" * 15, "fr": "vkwy" * 15}
    docs = spark.createDataFrame([(FREE[i], words[lang], lang) for i, lang in enumerate(["en", "fr"] * 10)], SCHEMA)
    assert all(r.lang == r.lang_pred for r in identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect())


def test_texts_over_50000_characters_are_learned(spark):
    docs = spark.createDataFrame([(FREE[0], "the cat and the dog", "en"), (FREE[1], "der Hund und die Katze " * 3000, "de"), (FREE[2], "der Hund", None)], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in identify_language(docs).collect()} == {FREE[0]: "en", FREE[1]: "de", FREE[2]: "de"}


def test_every_row_of_a_language_is_learned(spark):
    rng = random.Random(3)
    marks = [("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)), "fr" if k % 2 else "en") for k in range(12)]
    rows = [(FREE[k], "la la", "en" if k % 2 else "fr") for k in range(3000)]
    rows += [(FREE[3000 + k], f"{mark} " * 40, lang) for k, (mark, lang) in enumerate(marks)]
    ask = [(FREE[4000 + k], mark, None) for k, (mark, _) in enumerate(marks)]
    found = {r.doc_id: r.lang_pred for r in identify_language(spark.createDataFrame(rows + ask, SCHEMA)).collect()}
    assert [found[i] for i, _, _ in ask] == [lang for _, lang in marks]
