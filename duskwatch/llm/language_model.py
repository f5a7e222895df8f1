"""Log-bilinear language model in two levels, trained with noise-contrastive estimation.

The most frequent words are classes of their own; all others share classes by their last letters. The first
level predicts the class of a token from those of the two before it: the context vector is a sum of
linear maps of their embeddings, its product with the class vectors gives the scores. The second level predicts the
word within a shared class from the word before it: some two thousand frequent words have vectors of their own, as
context and as target; the others of a class are one outcome, inside which a word has its add-one share.
Both levels are trained in numpy, in one task, on the counts of class trigrams and word pairs over all training rows (their number
is bounded by classes and vectors, not by the corpus), then normalised for every context by batched matrix
products. Probabilities of all words and one unseen word per class sum to one.

Word counts cover all training rows. Counts of frequent words go to the tasks; rare words are joined
with the count table by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.tokens import BYTE_CODE, U64, Words, list_column, mix, slices

OWN, TAIL = 96, 32
CLASSES = OWN + TAIL
#: Frequent words that have vectors of their own; the outcomes of the second level are these and the rest of each shared class.
VECTORS = 2048
OUTCOMES = VECTORS + TAIL
#: Words whose counts are given to the tasks; a threshold on the count keeps their number below.
DICTIONARY = 250_000
END = mix(BYTE_CODE[250:251])
CHUNK = 1 << 21


def held_out(rest: int = 7) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % rest == 2, F.lit(False))


def _tokens(column: pa.Array):
    """Words of the texts with an end after each: (rows, document, hash, tail class), in order."""
    w = Words(column)
    n = w.count + 1
    total = int(n.sum())
    key, tail = np.empty(total, U64), np.zeros(total, np.int64)
    at = np.arange(len(w)) + w.doc
    key[at] = w.hashes()
    tail[at] = w.span_hashes(w.end - np.minimum(w.end - w.start, 2), w.end) % U64(TAIL)
    key[np.cumsum(n) - 1] = END[0]
    return w.rows, np.repeat(np.arange(w.rows), n), key, tail


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").fill_null("")
        for low, high in slices(text, CHUNK):
            _, _, key, tail = _tokens(text.slice(low, high - low))
            key, at, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tail[at].astype(np.int32)), pa.array(n)], ["word", "tail", "c"])


class Dictionary:
    """Counts and classes of frequent words, sorted by hash."""

    def __init__(self, word: np.ndarray, tail: np.ndarray, count: np.ndarray):
        own = np.lexsort((word, -count, word != END[0]))[:OWN]
        klass = OWN + tail.astype(np.int64)
        klass[own] = np.arange(len(own))
        outcome = VECTORS + tail.astype(np.int64)
        frequent = np.lexsort((word, -count, word != END[0]))[:VECTORS]
        outcome[frequent] = np.arange(len(frequent))
        order = np.argsort(word)
        self.word, self.klass, self.count, self.outcome = word[order], klass[order], count[order], outcome[order]
        #: shared class of each outcome, -1 for words that are classes of their own and for unused numbers
        self.shared = np.full(OUTCOMES, -1)
        self.shared[VECTORS:] = np.arange(TAIL)
        late = frequent[len(own) :]
        self.shared[np.arange(len(own), len(frequent))] = tail[late]

    def find(self, key: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count, outcome) of each token; count -1 where the word is not in the dictionary."""
        if not len(self.word):
            return OWN + tail, np.full(len(key), -1), VECTORS + tail
        at = np.minimum(np.searchsorted(self.word, key), len(self.word) - 1)
        here = self.word[at] == key
        return np.where(here, self.klass[at], OWN + tail), np.where(here, self.count[at], -1), np.where(here, self.outcome[at], VECTORS + tail)


def _contexts(doc: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """Number of the context (two classes before; CLASSES where the text has not begun) of each token."""
    back = np.full((2, len(klass)), CLASSES)
    for k in (1, 2):
        back[k - 1, k:] = np.where(doc[k:] == doc[:-k], klass[:-k], CLASSES)
    return back[1] * (CLASSES + 1) + back[0]


def train(code: np.ndarray, count: np.ndarray, width: int = 24, steps: int = 1500, batch: int = 2048, noise: int = 16, rate: float = 0.15, seed: int = 0) -> dict:
    """Parameters from trigram counts; ``code`` = context number x CLASSES + class."""
    rng = np.random.default_rng(seed)
    unigram = np.bincount(code % CLASSES, count, CLASSES) + 1.0 if len(code) else np.ones(CLASSES)
    unigram /= unigram.sum()
    m = {
        "r": rng.normal(0, 0.1, (CLASSES + 1, width)), "q": rng.normal(0, 0.1, (CLASSES, width)),
        "c1": np.eye(width) * 0.5, "c2": np.eye(width) * 0.25, "b": np.log(unigram),
    }
    if not len(code):
        return m
    square = {k: np.full(v.shape, 0.1) for k, v in m.items()}
    draw, draw_noise = np.cumsum(count) / count.sum(), np.cumsum(unigram)
    log_noise = np.log(noise * unigram)
    for _ in range(steps):
        pick = code[np.minimum(np.searchsorted(draw, rng.random(batch)), len(code) - 1)]
        context, target = pick // CLASSES, pick % CLASSES
        far, near = context // (CLASSES + 1), context % (CLASSES + 1)
        v1, v2 = m["r"][near], m["r"][far]
        predicted = v1 @ m["c1"] + v2 @ m["c2"]
        words = np.concatenate([target[:, None], np.minimum(np.searchsorted(draw_noise, rng.random((batch, noise))), CLASSES - 1)], axis=1)
        vectors = m["q"][words]
        delta = np.einsum("bd,bkd->bk", predicted, vectors) + m["b"][words] - log_noise[words]
        miss = -1 / (1 + np.exp(-np.clip(delta, -30, 30)))
        miss[:, 0] += 1
        miss /= batch
        one_hot = np.zeros((batch, CLASSES))
        np.add.at(one_hot, (np.arange(batch)[:, None], words), miss)
        g_pred = one_hot @ m["q"]
        g = {"q": one_hot.T @ predicted, "b": one_hot.sum(0), "c1": v1.T @ g_pred, "c2": v2.T @ g_pred, "r": np.zeros_like(m["r"])}
        np.add.at(g["r"], near, g_pred @ m["c1"].T)
        np.add.at(g["r"], far, g_pred @ m["c2"].T)
        for k, x in g.items():
            x *= 100
            square[k] += x * x
            m[k] += rate * x / np.sqrt(square[k])
    return m


def _before(doc: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    """Outcome of the token before each, OUTCOMES where the text begins."""
    out = np.full(len(outcome), OUTCOMES)
    out[1:] = np.where(doc[1:] == doc[:-1], outcome[:-1], OUTCOMES)
    return out


def train_words(
    shared: np.ndarray, pair: np.ndarray, count: np.ndarray, width: int = 24, steps: int = 1500, batch: int = 4096, noise: int = 8, rate: float = 0.15, seed: int = 1
) -> dict:
    """Vectors of words as context (``r``) and as target within their class (``q``, ``b``) from pair counts; ``pair`` = context x OUTCOMES + outcome.

    Noise for a target is drawn from the unigram counts of its own class, so the estimate is that of the distribution in the class.
    """
    rng = np.random.default_rng(seed)
    context, target = pair // OUTCOMES, pair % OUTCOMES
    inside = shared[target] >= 0
    context, target, count = context[inside], target[inside], count[inside]
    unigram = np.bincount(target, count, OUTCOMES) + 1.0
    order = np.argsort(shared, kind="stable")
    order = order[shared[order] >= 0]
    first = np.searchsorted(shared[order], np.arange(TAIL + 1))
    mass = np.concatenate([[0.0], np.cumsum(unigram[order])])
    total = mass[first[1:]] - mass[first[:-1]]
    log_share = np.zeros(OUTCOMES)
    log_share[order] = np.log(unigram[order] / total[shared[order]])
    m = {"r": rng.normal(0, 0.1, (OUTCOMES + 1, width)), "q": rng.normal(0, 0.1, (OUTCOMES, width)), "b": log_share.copy()}
    if not len(count):
        return m
    square = {k: np.full(v.shape, 0.1) for k, v in m.items()}
    draw = np.cumsum(count) / count.sum()
    rows = np.arange(batch)
    for _ in range(steps):
        pick = np.minimum(np.searchsorted(draw, rng.random(batch)), len(count) - 1)
        c, t = context[pick], target[pick]
        k = shared[t]
        spot = mass[first[k]][:, None] + rng.random((batch, noise)) * total[k][:, None]
        drawn = order[np.clip(np.searchsorted(mass, spot, "right") - 1, first[k][:, None], first[k + 1][:, None] - 1)]
        words = np.concatenate([t[:, None], drawn], axis=1)
        v, q = m["r"][c], m["q"][words]
        delta = np.einsum("bd,bkd->bk", v, q) + m["b"][words] - log_share[words] - np.log(noise)
        miss = -1 / (1 + np.exp(-np.clip(delta, -30, 30)))
        miss[:, 0] += 1
        miss *= 100 / batch
        g = {name: np.zeros_like(x) for name, x in m.items()}
        np.add.at(g["r"], c, np.einsum("bk,bkd->bd", miss, q))
        np.add.at(g["q"], words.ravel(), (miss[:, :, None] * v[rows][:, None, :]).reshape(-1, width))
        np.add.at(g["b"], words.ravel(), miss.ravel())
        for name, x in g.items():
            square[name] += x * x
            m[name] += rate * x / np.sqrt(square[name])
    return m


def log10_words(m: dict, shared: np.ndarray) -> np.ndarray:
    """log10 probability of each outcome within its shared class in each context, normalised over the class; 0 for words that are classes of their own."""
    out = np.zeros((OUTCOMES + 1, OUTCOMES), np.float32)
    for k in range(TAIL):
        at = np.flatnonzero(shared == k)
        z = m["r"] @ m["q"][at].T + m["b"][at]
        z -= z.max(1, keepdims=True)
        out[:, at] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / np.log(10)
    return out


def log10_table(m: dict) -> np.ndarray:
    """log10 probability of each class in each context, normalised over the classes."""
    near, far = m["r"] @ m["c1"], m["r"] @ m["c2"]
    out = np.empty(((CLASSES + 1) ** 2, CLASSES), np.float32)
    for i in range(CLASSES + 1):
        z = (far[i] + near) @ m["q"].T + m["b"]
        z -= z.max(1, keepdims=True)
        out[i * (CLASSES + 1) : (i + 1) * (CLASSES + 1)] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / np.log(10)
    return out


def _grams(shared):
    """Counts of class trigrams (kind 0) and of word pairs (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            text = batch.column("text").fill_null("")
            for low, high in slices(text, CHUNK):
                _, doc, key, tail = _tokens(text.slice(low, high - low))
                klass, _, outcome = words.find(key, tail)
                for kind, code in ((0, _contexts(doc, klass) * CLASSES + klass), (1, _before(doc, outcome) * OUTCOMES + outcome)):
                    code, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(code.astype(np.int64)), pa.array(n)], ["kind", "code", "n"])

    return run


def _learn(shared, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        kind, code, n = (np.concatenate([b.column(i).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        first = kind == 0
        classes = log10_table(train(code[first], n[first].astype(float), steps=steps))
        words = log10_words(train_words(shared.value.shared, code[~first], n[~first].astype(float), steps=steps), shared.value.shared)
        yield pa.RecordBatch.from_arrays([pa.array([classes.tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary())], ["classes", "words"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table, within, inside = shared.value
        for batch in batches:
            text = batch.column("text").fill_null("")
            for low, high in slices(text):
                rows, doc, key, tail = _tokens(text.slice(low, high - low))
                klass, count, outcome = words.find(key, tail)
                add = lambda x, doc=doc, rows=rows: np.bincount(doc, x, rows)
                rest = outcome >= VECTORS
                log_c = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0)
                model = table[_contexts(doc, klass), klass].astype(float) + within[_before(doc, outcome), outcome]
                model += np.where(rest, log_c - inside[np.maximum(outcome - VECTORS, 0)], 0)
                rare = count < 0
                pair, n = np.unique(np.stack([doc[rare].astype(U64), key[rare]]), axis=1, return_counts=True)
                cut = np.concatenate([[0], np.cumsum(np.bincount(pair[0].astype(np.int64), minlength=rows))])
                part = lambda c: batch.column(c).slice(low, high - low)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        part("doc_id"), part("held_out"), pa.array(np.bincount(doc, minlength=rows)), pa.array(add(count > 0).astype(np.int64)),
                        pa.array(add(log_c)), pa.array(add(model)), list_column(pair[1].copy(), cut), list_column(n, cut),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "log_c", "model", "rare", "times"],
                )

    return run


def score_texts(docs: DataFrame, steps: int = 1500) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text is its words and one end; null and empty texts are the end alone. Both scores are log10
    probabilities: ``base_score`` of the add-one unigram, ``score`` of the model. Held-out rows
    are scored and never learned from; rows without an id are learned from. If nothing can be learned, the
    classes are equally likely. ``steps`` is the length of training.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    taught = rows.where("NOT held_out").select("text")
    counts = settle(taught.mapInArrow(_count_words, "word long, tail int, c long").groupBy("word", "tail").agg(F.sum("c").alias("c")))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # frequent words: as many powers of two down as fit the dictionary
    floor, held = 1 << 62, 0
    for power, n in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).agg(F.count("*")).orderBy(F.desc("power")).collect():
        if held + n > DICTIONARY:
            break
        floor, held = 1 << power, held + n
    top = counts.where(F.col("c") >= floor).toArrow()
    words = Dictionary(*(top.column(c).to_numpy() if c != "word" else top.column(c).to_numpy().view(U64) for c in ("word", "tail", "c")))
    shared_words = sc.broadcast(words)
    grams = taught.mapInArrow(_grams(shared_words), "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    # their number is bounded by the classes and vectors, so they fit one task
    learned = grams.repartition(1).sortWithinPartitions("kind", "code").mapInArrow(_learn(shared_words, steps), "classes binary, words binary").first()
    if learned is None:
        none = np.zeros(0, np.int64)
        table, within = log10_table(train(none, none)), log10_words(train_words(words.shared, none, none), words.shared)
    else:
        table = np.frombuffer(learned["classes"], np.float32).reshape(-1, CLASSES)
        within = np.frombuffer(learned["words"], np.float32).reshape(-1, OUTCOMES)

    # words and tokens of the rest of each shared class: those without vectors
    mass = np.ones(TAIL)
    for tail, total, kinds in counts.groupBy("tail").agg(F.sum("c"), F.count("*")).collect():
        mass[tail] += total + kinds
    own = words.outcome < VECTORS
    tails = dict(zip(top.column("word").to_numpy().view(U64).tolist(), top.column("tail").to_pylist(), strict=True))
    for word, c in zip(words.word[own].tolist(), words.count[own].tolist(), strict=True):
        mass[tails[word]] -= c + 1
    scored = rows.mapInArrow(
        _score(sc.broadcast((words, table, within, np.log10(mass)))),
        "doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, model double, rare array<long>, times array<long>",
    )
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    found = rare.join(counts.where(F.col("c") < floor).select("word", "c"), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_c"), F.sum("times").alias("rare_known")
    )
    extra = F.coalesce("rare_c", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") + extra - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"), (F.col("model") + extra).alias("score"),
    )
