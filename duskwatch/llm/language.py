"""Language of a text by unigrams over vocabulary pieces, summed over all segmentations of each word.

The pieces are a fixed public vocabulary; only their probabilities in each language are learned, by
expectation maximisation over all segmentations of the distinct words of all training rows, each counted by
language. Tasks take the words' expected piece counts; their sums are as many as pieces and languages. A forward pass then gives the
exact sum over segmentations. A word's probability depends on the word alone, so each task computes
it once per distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.tokens import LETTER, LOWER_BYTE, U64, Words, slices
from duskwatch.llm.toxicity import held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁".encode()
SLOT_BITS = 20
#: Probability of a byte that no piece covers, alike in all languages.
BYTE_FLOOR = 1e-7
CACHE_WORDS = 1_000_000
#: Places of words that are worked on together; a longer word is walked in stretches.
BLOCK = 1 << 17
TEXT_BYTES = 1 << 21
#: Rounds of expectation maximisation, and what is added to each expected count.
ROUNDS, PRIOR = 3, 0.02


class Pieces:
    """Vocabulary pieces of letters, found by hash: row numbers for pieces at the start of a word and inside it."""

    def __init__(self, path: str = VOCABULARY, longest: int | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        starts = {p[3:].lower() for p in raw if p.startswith(WORD_START)}
        inner = {p.lower() for p in raw if not p.startswith(WORD_START)}
        letters = lambda p: LETTER[np.frombuffer(p, np.uint8)].all()
        # None takes all pieces of letters
        self.longest = longest or max((len(p) for p in starts | inner if p and letters(p)), default=1)
        fit = lambda ps: sorted(p for p in ps if 0 < len(p) <= self.longest and LETTER[np.frombuffer(p, np.uint8)].all())
        starts, inner = fit(starts), fit(inner)
        # row 0: no piece; row 1: the word start alone
        self.size = 2 + len(starts) + len(inner)
        self.start = self._index(self._hashes(starts)[0], 2)
        whole, ends = self._hashes(inner)
        self.inner = self._index(whole, 2 + len(starts))
        #: proper endings of inner pieces: where none ends, no longer piece does
        self.ends = self._index(ends, 1)

    @staticmethod
    def _hashes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each piece, and the distinct hashes of their proper endings."""
        w = Words(pa.array([p.decode("utf-8", "surrogateescape") for p in pieces], pa.string()))
        low, high = w.offsets[:-1], w.offsets[1:]
        cut = [w.span_hashes(high[some] - k, high[some]) for k in range(1, int((high - low).max(initial=0))) for some in [high - low > k]]
        return w.span_hashes(low, high), np.unique(np.concatenate(cut)) if cut else np.zeros(0, U64)

    @staticmethod
    def _index(hashes: np.ndarray, first: int):
        left = np.stack([hashes, np.arange(first, first + len(hashes), dtype=U64)], axis=1)
        tables = []
        for shift in (44, 34, 24, 14, 4):
            size = 1 << min(SLOT_BITS, (32 * len(left)).bit_length())
            slot = ((left[:, 0] >> U64(shift)) & U64(size - 1)).astype(np.int64)
            key, row = np.zeros(size, U64), np.zeros(size, np.int32)
            _, at = np.unique(slot, return_index=True)
            key[slot[at]], row[slot[at]] = left[at, 0], left[at, 1]
            tables.append((shift, key, row))
            left = np.delete(left, at, axis=0)
            if not len(left):
                return tables
        raise ValueError(f"{len(left)} pieces find no free slot")

    @staticmethod
    def rows(tables, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        left = np.arange(len(h))
        for shift, key, row in tables:
            slot = ((h[left] >> U64(shift)) & U64(len(key) - 1)).astype(np.int64)
            there = key[slot]
            same = there == h[left]
            out[left[same]] = row[slot[same]]
            # what met an empty slot is in no later table either
            left = left[~same & (there != 0)]
            if not len(left):
                break
        return out


class Spans:
    """All spans of a block's words that are pieces, or single bytes (row ``pieces.size`` if no piece), with an end in one stretch.

    Sorted by end, then word. Buffers are flat, one entry for each place and word: row 0 is the place before the word
    start, place k is in row ``back + k - low``.
    """

    def __init__(self, pieces: Pieces, w: Words, block: Block, low: int):
        place, at = np.nonzero(np.arange(low + 1, low + block.stretch + 1)[:, None] <= block.n)
        #: first end of each place; ends are pairs of place and word
        self.cut = np.searchsorted(place, np.arange(block.stretch + 1))
        place += low + 1
        end = block.start[at] + place
        live, found = np.arange(len(at)), []
        for length in range(1, block.back + 1):
            live = live[place[live] >= length]
            h = w.span_hashes(end[live] - length, end[live])
            row = pieces.rows(pieces.inner, h)
            if length == 1:
                row[row == 0] = pieces.size
            hit = np.flatnonzero(row)
            found.append((live[hit], block.back - low + place[live[hit]] - length, row[hit]))
            live = live[pieces.rows(pieces.ends, h) > 0]
            if not len(live):
                break
        early = np.flatnonzero(place <= block.back)
        row = pieces.rows(pieces.start, w.span_hashes(block.start[at[early]], end[early]))
        hit = np.flatnonzero(row)
        found.append((early[hit], np.zeros(len(hit), np.int64), row[hit]))
        pair, begin, row = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, self.row = pair[order], row[order]
        self.word = at[pair]
        self.begin = begin[order] * len(block.n) + self.word
        self.end = (block.back - low + place[pair]) * len(block.n) + self.word
        #: first span of each end
        self.first = np.searchsorted(pair, np.arange(len(at) + 1))


class Block:
    """Words sorted by length, walked in stretches of places, mostly one. Logarithms keep words of any length in range."""

    def __init__(self, w: Words, word: np.ndarray, pieces: Pieces, size: int):
        self.w, self.pieces = w, pieces
        self.start, self.n = w.start[word], (w.end - w.start)[word]
        reach = int(self.n[-1])
        self.back = min(pieces.longest, reach)
        self.stretch = min(reach, max(self.back, size // len(word)))
        self.lows = range(0, reach, self.stretch)

    def forward(self, table: np.ndarray, lang: np.ndarray | None = None) -> Iterator[tuple[int, Spans, np.ndarray, np.ndarray, np.ndarray]]:
        """(stretch, its spans, their logarithms, buffer of sums over segmentations up to each place, buffer before it was filled).

        ``table``: logarithms by piece and language; with ``lang``, each word is summed in its own language only.
        """
        width = len(self.n)
        sums = np.full(((self.back + self.stretch + 1) * width, 1 if lang is not None else table.shape[1]), -np.inf)
        sums[:width] = 0
        sums[self.back * width : (self.back + 1) * width] = table[1] if lang is None else table[1, lang][:, None]
        for low in self.lows:
            if low:
                sums[width : (self.back + 1) * width] = sums[(self.stretch + 1) * width :].copy()
            before = sums[: (self.back + 1) * width].copy()
            spans, step = self.fill(low, table, lang, sums)
            yield low, spans, step, sums, before

    def fill(self, low: int, table: np.ndarray, lang: np.ndarray | None, sums: np.ndarray) -> tuple[Spans, np.ndarray]:
        width = len(self.n)
        spans = Spans(self.pieces, self.w, self, low)
        step = table[spans.row] if lang is None else table[spans.row, lang[spans.word]][:, None]
        cut, first, begin = spans.cut.tolist(), spans.first, spans.begin
        for k in range(self.stretch):
            a, b = cut[k], cut[k + 1]
            if a == b:
                break
            x, y = first[a], first[b]
            # words are sorted by length: those that reach this place are the last
            to = (self.back + k + 2) * width
            sums[to - (b - a) : to] = np.logaddexp.reduceat(step[x:y] + sums[begin[x:y]], first[a:b] - x, axis=0)
        return spans, step

    def ends(self, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that end in the stretch, and their places in its buffer."""
        word = np.flatnonzero((self.n > low) & (self.n <= low + self.stretch))
        return word, (self.back - low + self.n[word]) * len(self.n) + word


def _blocks(pieces: Pieces, w: Words, word: np.ndarray, size: int = BLOCK) -> Iterator[tuple[np.ndarray, Block]]:
    reach = (w.end - w.start)[word]
    order = np.argsort(reach, kind="stable")
    at = 0
    while at < len(order):
        some = order[at : at + size]
        some = some[: max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * reach[some], size, "right")))]
        at += len(some)
        yield some, Block(w, word[some], pieces, size)


def _logarithms(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.vstack([p, np.full((1, p.shape[1]), BYTE_FLOOR)]))


def word_scores(pieces: Pieces, p: np.ndarray, w: Words, word: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability in each language, summed over segmentations."""
    out = np.zeros((len(word), p.shape[1]))
    table = _logarithms(p)
    for part, block in _blocks(pieces, w, word, max(1, 4 * BLOCK // max(4, p.shape[1]))):
        for low, _, _, sums, _ in block.forward(table):
            done, at = block.ends(low)
            out[part[done]] = sums[at]
    return out


def expected(pieces: Pieces, p: np.ndarray, w: Words, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected piece counts by language over all segmentations of the words, each counted ``n`` times in language ``lang``."""
    languages = p.shape[1]
    total = np.zeros((pieces.size + 1) * languages)
    table = _logarithms(p)
    for part, block in _blocks(pieces, w, np.arange(len(w))):
        own, weight, width, back = lang[part], n[part].astype(float), len(part), block.back
        whole, kept = np.zeros(width), []
        for low, spans, step, sums, before in block.forward(table, own):
            done, at = block.ends(low)
            whole[done] = sums[at, 0]
            kept.append(before)
        rest = np.full(len(sums), -np.inf)
        for low in reversed(block.lows):
            before = kept.pop()
            if low != block.lows[-1]:
                # the stretch before: its sums again, and what later stretches have added to its last places
                sums[: len(before)] = before
                spans, step = block.fill(low, table, own, sums)
                late = rest[width : (back + 1) * width].copy()
                rest[:] = -np.inf
                rest[(block.stretch + 1) * width :] = late
            rest[block.ends(low)[1]] = 0
            cut = spans.first[spans.cut].tolist()
            for k in reversed(range(block.stretch)):
                x, y = cut[k], cut[k + 1]
                if x < y:
                    # spans with one end differ in word or begin
                    begin = spans.begin[x:y]
                    rest[begin] = np.logaddexp(rest[begin], step[x:y, 0] + rest[spans.end[x:y]])
            share = np.exp(step[:, 0] + sums[spans.begin, 0] + rest[spans.end] - whole[spans.word]) * weight[spans.word]
            total += np.bincount(spans.row * languages + own[spans.word], share, len(total))
        alone = slice(back * width, (back + 1) * width)
        total[languages : 2 * languages] += np.bincount(own, np.exp(sums[alone, 0] + rest[alone] - whole) * weight, languages)
    return total.reshape(-1, languages)[:-1]


def _uniform(pieces: Pieces, languages: int) -> np.ndarray:
    p = np.full((pieces.size, languages), 1.0 / pieces.size)
    p[0] = 0
    return p


def _normal(total: np.ndarray, prior: float) -> np.ndarray:
    p = total + prior
    p[0] = 0
    return p / p.sum(0)


def count_words(texts: pa.Array, lang: np.ndarray, n_lang: int) -> Iterator[pa.RecordBatch]:
    """(word, lang, n): words with A-Z lower-cased, counted by language number within each slice of texts."""
    for low, high in slices(texts, TEXT_BYTES):
        w = Words(texts.slice(low, high - low), ~LETTER)
        if not len(w):
            continue
        _, word, at = np.unique(w.hashes(), return_index=True, return_inverse=True)
        code, n = np.unique(at * n_lang + lang[low:high][w.doc], return_counts=True)
        word = word[code // n_lang]
        size = w.end[word] - w.start[word]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = LOWER_BYTE[w.data[np.arange(offsets[-1]) + np.repeat(w.start[word] - offsets[:-1], size)]]
        words = pa.Array.from_buffers(pa.large_string(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([words, pa.array((code % n_lang).astype(np.int32)), pa.array(n)], ["word", "lang", "n"])


def learn(pieces: Pieces, texts: pa.Array, lang: np.ndarray, n_lang: int, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Piece probabilities, one column per language, from texts whose language number is given, in this process."""
    p = _uniform(pieces, n_lang)
    counted = list(count_words(texts, lang, n_lang))
    for _ in range(rounds if counted else 0):
        p = _normal(sum(_expected_of(pieces, p, b) for b in counted), prior)
    return p


def _expected_of(pieces: Pieces, p: np.ndarray, counted: pa.RecordBatch) -> np.ndarray:
    lang, n = (counted.column(k).to_numpy() for k in ("lang", "n"))
    return expected(pieces, p, Words(counted.column("word"), ~LETTER), lang, n)


def learn_words(words: DataFrame, pieces: Pieces, n_lang: int, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """``learn`` from counted words (word, lang, n): each round's expected counts are taken in tasks and summed by piece and language.

    Words are counted by language, so a word's row is worked on in one task. Sums are decimals, their order does not matter.
    """
    context = words.sparkSession.sparkContext
    given, p = context.broadcast(pieces), _uniform(pieces, n_lang)
    for _ in range(rounds):
        now = context.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now.value)
            for batch in batches:
                if batch.num_rows:
                    total += _expected_of(given.value, now.value, batch)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "amount"])

        amounts = words.mapInArrow(expect, "piece int, lang int, amount double")
        sums = amounts.groupBy("piece", "lang").agg(F.sum(F.col("amount").cast("decimal(38,12)")).cast("double").alias("amount")).toArrow()
        total = np.zeros_like(p)
        total[sums.column("piece").to_numpy(), sums.column("lang").to_numpy()] = sums.column("amount").to_numpy()
        p = _normal(total, prior)
        now.destroy()
    given.destroy()
    return p


def identify_language(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from all words of all rows with text and language that are not held out. Texts that are null or without a letter are ``und`` with
    score 0, as is every text if nothing can be learned. The score is the posterior of the language, its prior the share of
    training rows. Null ids are not held out; repeated rows give a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("lang", "text")
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(rows)
    pieces = Pieces(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = pc.index_in(batch.column("lang"), value_set=pa.array(names, batch.column("lang").type)).to_numpy()
            yield from count_words(batch.column("text"), lang.astype(np.int64), len(names))

    p, prior = np.zeros((pieces.size, 0)), np.zeros(0)
    if names:
        counted = known.mapInArrow(count, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
        p = learn_words(settle(counted.sortWithinPartitions("word", "lang")), pieces, len(names))
        prior = np.log(np.array([rows[x] for x in names]) + 1.0)
    shared = spark.sparkContext.broadcast((pieces, p, prior, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, p, prior, names = shared.value
        seen, score = np.zeros(0, U64), np.zeros((0, len(names)), np.float32)
        for batch in batches:
            column = batch.column("text").fill_null("")
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            for low, high in slices(column, TEXT_BYTES):
                w = Words(column.slice(low, high - low), ~LETTER)
                log_p = np.tile(prior, (w.rows, 1))
                if len(w) and names:
                    key, word, at = np.unique(w.hashes(), return_index=True, return_inverse=True)
                    spot = np.minimum(np.searchsorted(seen, key), max(len(seen) - 1, 0))
                    fresh = seen[spot] != key if len(seen) else np.ones(len(key), bool)
                    values = np.empty((len(key), len(names)), np.float32)
                    values[~fresh] = score[spot[~fresh]] if len(seen) else 0
                    values[fresh] = word_scores(pieces, p, w, word[fresh])
                    for k in range(len(names)):
                        log_p[:, k] += np.bincount(w.doc, values[at, k], w.rows)
                    if len(seen) + fresh.sum() > CACHE_WORDS:
                        seen, score = key, values
                    else:
                        seen, score = np.concatenate([seen, key[fresh]]), np.concatenate([score, values[fresh]])
                        order = np.argsort(seen)
                        seen, score = seen[order], score[order]
                ok = letter[low:high] & (len(names) > 0)
                if names:
                    best = log_p.argmax(1)
                    sure = 1 / np.exp(log_p - log_p.max(1, keepdims=True)).sum(1)
                else:
                    best, sure = np.zeros(w.rows, int), np.zeros(w.rows)
                label = np.array([*names, "und"], object)[np.where(ok, best, len(names))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low), batch.column("held_out").slice(low, high - low),
                        pa.array(label, pa.string()), pa.array(np.where(ok, sure, 0.0)),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select("doc_id", held_out().alias("held_out"), has_letter, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
