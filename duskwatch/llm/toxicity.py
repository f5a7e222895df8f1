"""Toxicity by a linear-chain conditional random field over the words of a text.

Labels belong to documents, so token labels are derived: a word of a toxic document counts as toxic if
the word or one of its prefixes is far more frequent in toxic than in clean documents of the sample.
The field has two states and hashed features (word, prefixes, suffix); it is trained in numpy by
gradient steps on forward-backward marginals. A document's score is a logistic function of its
marginals, fitted on a part of the sample the field has not seen; spans are runs of
words with a marginal of at least one half.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.rows import drop_rows, hash_sample
from duskwatch.llm.tokens import BYTE_CODE, LETTER, U64, Words, mix, slices

TABLE_BITS = 18
WIDTH = 32
THRESHOLD = 0.3
#: Bytes of text scored together; a longer text stands alone.
SCORED_BYTES = 1 << 18
PREFIXES = (3, 4, 5)


def token_keys(w: Words) -> np.ndarray:
    """Hash of each feature of each word, one row per kind of feature."""
    reach = w.end - w.start
    kinds = [w.hashes(), *[w.span_hashes(w.start, w.start + np.minimum(reach, k)) for k in PREFIXES]]
    kinds.append(w.span_hashes(w.end - np.minimum(reach, 3), w.end))
    return np.stack([mix(h + BYTE_CODE[20 + i]) for i, h in enumerate(kinds)])


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(64 - TABLE_BITS)).astype(np.int32)


class Chain:
    """Two-state chain over the words of many texts at once. The word before the first counts as clean.

    Words lie in rows of ``WIDTH``; products of step matrices give each row's effect, rows of a text are
    joined in order, then all rows are filled in parallel. The result is the exact marginal.
    """

    def __init__(self, count: np.ndarray):
        rows = -(-count // WIDTH)
        self.base = np.concatenate([[0], np.cumsum(rows)])
        total = int(count.sum())
        doc = np.repeat(np.arange(len(count)), count)
        place = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        self.row, self.col = self.base[doc] + place // WIDTH, place % WIDTH
        self.rows, self.chunks = int(self.base[-1]), rows

    def marginals(self, emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the toxic state per word, expected moves from state to state)."""
        grid = np.ones((self.rows, WIDTH))
        real = np.zeros((self.rows, WIDTH), bool)
        grid[self.row, self.col] = np.exp(np.clip(emission, -30, 30))
        real[self.row, self.col] = True
        a = np.exp(move)
        step = np.zeros((self.rows, 2, 2))
        step[:, 0, 0] = step[:, 1, 1] = 1
        for c in range(WIDTH):
            ok = real[:, c, None, None]
            nxt = step @ a
            nxt[:, :, 1] *= grid[:, c, None]
            nxt /= nxt.sum((1, 2), keepdims=True)
            step = np.where(ok, nxt, step)
        into = np.zeros((self.rows, 2))
        out = np.ones((self.rows, 2))
        some = np.flatnonzero(self.chunks > 0)
        into[self.base[some], 0] = 1
        for k in range(1, int(self.chunks.max(initial=0))):
            at = self.base[np.flatnonzero(self.chunks > k)] + k
            v = np.einsum("ri,rij->rj", into[at - 1], step[at - 1])
            into[at] = v / v.sum(1, keepdims=True)
        for k in range(int(self.chunks.max(initial=0)) - 1, 0, -1):
            at = self.base[np.flatnonzero(self.chunks > k)] + k
            v = np.einsum("rij,rj->ri", step[at], out[at])
            out[at - 1] = v / v.sum(1, keepdims=True)
        before = np.empty((WIDTH, self.rows, 2))
        v = into
        for c in range(WIDTH):
            before[c] = v
            nxt = v @ a
            nxt[:, 1] *= grid[:, c]
            v = np.where(real[:, c, None], nxt / nxt.sum(1, keepdims=True), v)
        p = np.zeros((self.rows, WIDTH))
        moves = np.zeros((2, 2))
        v = out
        for c in range(WIDTH - 1, -1, -1):
            right = v.copy()
            right[:, 1] *= grid[:, c]
            joint = before[c][:, :, None] * a[None] * right[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            joint *= real[:, c, None, None]
            moves += joint.sum(0)
            p[:, c] = joint[:, :, 1].sum(1)
            nxt = right @ a.T
            v = np.where(real[:, c, None], nxt / nxt.sum(1, keepdims=True), v)
        return p[self.row, self.col], moves


def _batches(texts: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    for low, high in slices(texts, 1 << 17):
        w = Words(texts.slice(low, high - low), ~LETTER)
        yield low, high, w, token_keys(w)


def _token_labels(batches: list, toxic: np.ndarray, odds: float = 3.0, cover: int = 3, least: int = 3, share: float = 0.01) -> list[np.ndarray]:
    """Words that mark toxic documents.

    Candidates are words and prefixes with a document rate in toxic texts of exp(odds) times that in
    clean ones. Of those, the one that most texts still lack is taken until toxic texts hold ``cover``
    such words or no candidate helps ``share`` of them: so words that a family of copies shares by
    chance are passed over.
    """
    rows = (0, 2, 3)
    pairs = [np.unique(np.stack([k[r], (w.doc + low).astype(U64)]), axis=1) for low, _, w, k in batches for r in rows]
    key, at = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
    flag = toxic[np.concatenate([p[1] for p in pairs]).astype(np.int64)]
    hit, miss = np.bincount(at, flag, len(key)), np.bincount(at, 1 - flag, len(key))
    gain = np.log((hit + 0.5) / (toxic.sum() + 1)) - np.log((miss + 0.5) / ((1 - toxic).sum() + 1))
    most = max(least, share * toxic.sum())
    good = key[(gain >= odds) & (hit >= most)]
    labels = [np.zeros(len(w), bool) for _, _, w, _ in batches]
    if not len(good):
        return labels
    shift = np.concatenate([[0], np.cumsum([len(y) for y in labels])])
    found = []  # (word, candidate, document)
    for (low, _, w, k), first in zip(batches, shift, strict=False):
        for r in rows:
            spot = np.minimum(np.searchsorted(good, k[r]), len(good) - 1)
            ok = np.flatnonzero((good[spot] == k[r]) & (toxic[w.doc + low] > 0))
            found.append(np.stack([ok + first, spot[ok], w.doc[ok] + low]))
    word, cand, doc = np.concatenate(found, axis=1)
    have = np.zeros(len(toxic), int)
    chosen = np.zeros(shift[-1], bool)
    while len(word):
        open_ = have[doc] < cover
        left = np.bincount(np.unique(np.stack([cand[open_], doc[open_]]), axis=1)[0], minlength=len(good))
        best = int(left.argmax())
        if left[best] < most:
            break
        mine = cand == best
        chosen[word[mine]] = True
        have[np.unique(doc[mine])] += 1
        rest = ~chosen[word]
        word, cand, doc = word[rest], cand[rest], doc[rest]
    return [chosen[a:b] for a, b in zip(shift[:-1], shift[1:], strict=True)]


def train(texts: pa.Array, toxic: np.ndarray, epochs: int = 4, rate: float = 0.3) -> dict:
    """Weights of the field and of the logistic function over its marginals."""
    model = {"table": np.zeros(1 << TABLE_BITS), "bias": -6.0, "move": np.zeros((2, 2)), "scale": np.array([-3.0, 0.0, 0.0])}
    if not len(texts) or not 0 < toxic.sum() < len(toxic):
        return model
    part = np.arange(len(texts)) % 3 < 2
    chosen = list(_batches(texts.filter(pa.array(part))))
    labels = _token_labels(chosen, toxic[part])
    squares = np.full(1 << TABLE_BITS, 1e-2)
    move_squares, bias_square = np.full((2, 2), 1.0), 1.0
    for _ in range(epochs):
        for (_, _, w, keys), y in zip(chosen, labels, strict=True):
            if not len(w):
                continue
            slots = _slots(keys)
            chain = Chain(w.count)
            p, moves = chain.marginals(model["table"][slots].sum(0) + model["bias"], model["move"])
            miss = y - p
            g = np.bincount(slots.ravel(), np.tile(miss, len(slots)), 1 << TABLE_BITS) - 1e-3 * model["table"]
            squares += g * g
            model["table"] += rate * g / np.sqrt(squares)
            first = np.zeros(len(w), bool)
            first[w.first[:-1][w.count > 0]] = True
            prior = np.where(first, 0, np.concatenate([[0], y[:-1]]))
            seen = np.zeros((2, 2))
            np.add.at(seen, (prior.astype(int), y.astype(int)), 1)
            g = seen - moves
            move_squares += g * g
            model["move"] += 0.1 * g / np.sqrt(move_squares)
            bias_square += miss.sum() ** 2
            model["bias"] += 0.3 * miss.sum() / np.sqrt(bias_square)
    rest = texts.filter(pa.array(~part))
    x = np.concatenate([_evidence(model, w, keys)[0] for _, _, w, keys in _batches(rest)]) if len(rest) else np.zeros((0, 2))
    model["scale"] = _logistic(x, toxic[~part])
    return model


def _evidence(model: dict, w: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the logarithm of the summed squared marginals and the largest marginal; the marginals."""
    p, _ = Chain(w.count).marginals(model["table"][_slots(keys)].sum(0) + model["bias"], model["move"])
    most = np.zeros(w.rows)
    np.maximum.at(most, w.doc, p)
    return np.stack([np.log(1e-3 + np.bincount(w.doc, p * p, w.rows)), most], axis=1), p


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x1 = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x1.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        h = (x1 * (q * (1 - q))[:, None]).T @ x1 + ridge * np.eye(len(beta))
        beta += np.linalg.solve(h, x1.T @ (y - q) - ridge * beta)
    return beta


def held_out(rest: int = 4) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % rest == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_chars: int) -> dict:
    """The model, trained in one task on at most ``fit_rows`` labelled texts of each kind, by hash of the id, none over ``fit_chars``."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = settle(marked)
    some = [hash_sample(marked.where(F.col("toxic") == t), fit_rows, "doc_id") for t in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select("doc_id", "text").where(F.length("text") <= fit_chars).join(ids, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows])
        model = train(pa.concat_arrays(table.column("text").chunks), table.column("toxic").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    # the sample's size is bounded, so it fits one task
    sample = rows.select("text", "toxic", F.xxhash64("doc_id").alias("h"), "doc_id").repartition(1).sortWithinPartitions("h", "doc_id").select("text", "toxic")
    if sample.isEmpty():
        return train(pa.array([], pa.string()), np.zeros(0))
    return pickle.loads(sample.mapInArrow(learn, "model binary").first()[0])


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 1500, fit_chars: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, spans.

    ``spans`` lists (begin, end, probability) of offending runs of words, in code points. Null and empty
    texts have no span and the score of a text without evidence. ``fit_rows`` and ``fit_chars`` bound
    the labelled sample; all rows are scored whole. Without labels of both kinds all scores
    are alike and low. A doc_id with several labels counts as toxic if one of them says so.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows, fit_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.column("text").fill_null("")
            for low, high in slices(text, SCORED_BYTES):
                w = Words(text.slice(low, high - low), ~LETTER)
                x, p = _evidence(m, w, token_keys(w))
                z = m["scale"][0] + x @ m["scale"][1:]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low), batch.column("held_out").slice(low, high - low),
                        pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), _spans(w, p),
                    ],
                    ["doc_id", "held_out", "score", "spans"],
                )

    spans = "array<struct<begin: int, end: int, probability: double>>"
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id long, held_out boolean, score double, spans {spans}")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def _spans(w: Words, p: np.ndarray) -> pa.Array:
    """Runs of neighbouring words with a marginal of a half or more."""
    hot = p >= 0.5
    back = np.zeros(len(p), bool)
    back[1:] = hot[1:] & hot[:-1] & (w.doc[1:] == w.doc[:-1])
    start = np.flatnonzero(hot & ~back)
    run = np.cumsum(hot & ~back)[hot] - 1
    last = np.zeros(len(start), np.int64)
    last[run] = np.flatnonzero(hot)
    most = np.zeros(len(start))
    np.maximum.at(most, run, p[hot])
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    doc = w.doc[start]
    origin = points[w.offsets[doc]]
    items = pa.StructArray.from_arrays(
        [pa.array((points[w.start[start]] - origin).astype(np.int32)), pa.array((points[w.end[last]] - origin).astype(np.int32)), pa.array(most)],
        ["begin", "end", "probability"],
    )
    cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), items)


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = 1500, fit_chars: int = 100_000) -> DataFrame:
    """Rows of ``docs``, all columns, whose text is not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows, fit_chars))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            column = batch.column("text").fill_null("")
            for low, high in slices(column, SCORED_BYTES):
                w = Words(column.slice(low, high - low), ~LETTER)
                z = m["scale"][0] + _evidence(m, w, token_keys(w))[0] @ m["scale"][1:]
                hit = pa.array(np.flatnonzero(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= THRESHOLD) + low)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(hit) for c in ("doc_id", "text_hash")], ["doc_id", "text_hash"])

    toxic = settle(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(marks, "doc_id long, text_hash long").distinct())
    model.destroy()
    return drop_rows(docs, toxic)
