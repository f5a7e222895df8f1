"""Quality rules: word and line statistics, and an isolation forest over them.

The forest is trained in numpy on a bounded sample of rows that pass the base rules. Path lengths over its random
splits give an anomaly score. Its trees see few rows each, so that a crowd of like junk does not hide itself. The limit
above which a document goes is calibrated by a histogram of scores, so that at most ``clean_loss`` of the rows labelled
good lie above it; labelled rows that are held out do not set it, and tell what it is worth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.components import settle
from duskwatch.llm.rows import hash_sample
from duskwatch.llm.tokens import BYTE_CODE, LETTER, Words, slices

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_upper = np.zeros(256, bool)
_upper[65:91] = True
NOT_NEWLINE = np.zeros(256, bool)
NOT_NEWLINE[10] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")
#: Further counts that only the forest looks at: bytes of letters, bytes outside white space, words of one or two bytes, words without
#: a letter, words with two or more bytes that are no letters.
MORE = ("n_letters", "n_solid", "n_short", "n_letterless", "n_mixed")
FEATURES = ("mean_chars", "symbols", "dup_lines", "repeated", "upper", "variety", "line_words", "not_letters", "short", "letterless", "mixed", "entropy")


def _same_as_earlier(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags per item: an earlier item of the document is equal; any other item of the document is equal."""
    order = np.lexsort((np.arange(len(doc)), value, doc))
    d, v = doc[order], value[order]
    equal = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    later, any_ = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    later[order[1:]] = equal
    any_[order[1:]] |= equal
    any_[order[:-1]] |= equal
    return later, any_


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, see ``rule_statistics``; null counts as empty."""
    w = Words(column)
    data, rows = w.data, w.rows
    owner = np.repeat(np.arange(rows), np.diff(w.offsets))

    def per_row(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flag], minlength=rows)

    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[w.end] - points[w.start]
    plain = w.hashes(BYTE_CODE)
    lines = Words(column, NOT_NEWLINE)
    word_at = np.concatenate([[0], np.cumsum(np.bincount(w.start, minlength=len(data)))]) if len(data) else np.zeros(1, int)
    worded = word_at[lines.end] > word_at[lines.start]
    line_doc = lines.doc[worded]
    dup, _ = _same_as_earlier(line_doc, lines.span_hashes(lines.start[worded], lines.end[worded], BYTE_CODE))
    doc, at, h = w.windows(plain, 5, whole_if_short=False)
    _, again = _same_as_earlier(doc, h)
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 5, -1)
    covered = np.cumsum(cover)[:-1] > 0
    later, _ = _same_as_earlier(w.doc, plain)
    sums = lambda d, x=None: np.bincount(d, x, minlength=rows).astype(np.int64)
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    size = w.end - w.start
    other = size - (letters[w.end] - letters[w.start])
    return {
        "n_words": w.count.astype(np.int64), "word_chars": sums(w.doc, chars), "n_symbols": per_row(SYMBOLS[data]).astype(np.int64),
        "n_dup_lines": sums(line_doc[dup]), "n_repeat_words": sums(w.doc[covered]), "n_lines": sums(line_doc),
        "n_upper": per_row(_upper[data]).astype(np.int64), "n_distinct": sums(w.doc[~later]),
        "n_letters": per_row(LETTER[data]).astype(np.int64), "n_solid": sums(w.doc, size), "n_short": sums(w.doc[size < 3]), "n_letterless": sums(w.doc[other == size]),
        "n_mixed": sums(w.doc[other > 1]), "entropy": _entropy(owner, data, rows),
    }


def _entropy(owner: np.ndarray, data: np.ndarray, rows: int) -> np.ndarray:
    """Bits a byte of each text, by its own byte counts; 0 for an empty one."""
    pair, n = np.unique(owner * 256 + data, return_counts=True)
    row = pair // 256
    share = n / np.bincount(row, n, rows)[row]
    return np.bincount(row, -share * np.log2(share), rows)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the counts, one row per text, finite for any input."""
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    lines, solid = np.maximum(counts["n_lines"], 1), np.maximum(counts["n_solid"], 1)
    return np.stack(
        [
            np.log1p(counts["word_chars"] / words), counts["n_symbols"] / chars, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words,
            counts["n_upper"] / chars, np.log1p(counts["n_distinct"]) / np.log1p(words), np.log1p(words / lines),
            1 - counts["n_letters"] / solid, counts["n_short"] / words, counts["n_letterless"] / words, counts["n_mixed"] / words, counts["entropy"],
        ],
        axis=1,
    )


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation forest: arrays of split column, split value, children and leaf depth per tree."""

    def __init__(self, x: np.ndarray, trees: int = 200, sample: int = 64, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(trees)] if len(x) else []
        self.depth = depth

    @staticmethod
    def _grow(x: np.ndarray, depth: int, rng: np.random.Generator):
        column, value, child, leaf = [], [], [], []
        todo = [(np.arange(len(x)), 0)]
        while todo:
            rows, d = todo.pop(0)
            low, high = x[rows].min(0), x[rows].max(0)
            open_ = np.flatnonzero(high > low)
            if d >= depth or len(rows) <= 1 or not len(open_):
                column.append(-1), value.append(0.0), child.append(0), leaf.append(d + float(_average_path(len(rows))))
                continue
            c = int(rng.choice(open_))
            v = rng.uniform(low[c], high[c])
            column.append(c), value.append(v), leaf.append(0.0), child.append(len(column) + len(todo))
            todo += [(rows[x[rows, c] < v], d + 1), (rows[x[rows, c] >= v], d + 1)]
        return np.array(column), np.array(value), np.array(child), np.array(leaf)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher is more anomalous. Without training rows every score is 0.5."""
        if not self.trees or self.size < 2:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for column, value, child, leaf in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                c = column[at]
                go = child[at] + (x[every, np.maximum(c, 0)] >= value[at])
                at = np.where(c < 0, at, go)
            total += leaf[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_average_path(self.size)), 1e-9))


def rule_statistics(docs: DataFrame, more: bool = False) -> DataFrame:
    """doc_id and counts per row: words, code points in words, symbols, repeated lines, words in repeated
    five-word windows, lines with a word, A-Z, distinct words; with ``more`` also those only the forest uses. Null and empty texts
    count 0, repeated rows and null ids give a row each."""
    names = (*COUNTS, *MORE) if more else COUNTS
    shape = ", ".join(f"{c} long" for c in names) + (", entropy double" if more else "")
    names = (*names, "entropy") if more else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").fill_null("")
            for low, high in slices(text):
                counts = text_counts(text.slice(low, high - low))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), *[pa.array(counts[c]) for c in names]], ["doc_id", *names]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {shape}")


#: What the base rules reject.
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, clean_loss: float = 0.005) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, anomaly, anomaly_limit, kept.

    ``fit_rows`` bounds the rows the forest is grown on, picked by hash of id and counts. Without labels
    of both kinds nothing but the base rules rejects. Several labels of one id count as
    the worst. Null ids have no label; repeated rows give a row each; null, empty and very long texts are counted whole; an
    empty table gives no rows; other columns are ignored.
    """
    scored, worst = _scored(docs, labels, fit_rows)
    limit = _limit(scored, worst, clean_loss)
    return scored.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("anomaly_limit", F.lit(limit)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < F.col("anomaly_limit"))
    ).drop(*MORE, "entropy")


def _scored(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[DataFrame, DataFrame]:
    stats = settle(rule_statistics(docs, more=True))
    names = (*COUNTS, *MORE, "entropy")
    fit = hash_sample(stats.where(f"NOT ({BASE_FAILED})"), fit_rows, "doc_id", *COUNTS).select(*names).toPandas()
    forest = Forest(features({c: fit[c].to_numpy() for c in names}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in names}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(features(counts)))], [*batch.schema.names, "anomaly"])

    shape = ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
    scored = settle(stats.mapInArrow(run, f"doc_id long, {shape}, entropy double, anomaly double"))
    worst = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return scored, worst


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _limit(scored: DataFrame, worst: DataFrame, clean_loss: float) -> float:
    """From the labelled rows that pass the base rules and are not held out."""
    rows = scored.where(f"NOT ({BASE_FAILED})").join(worst.where(~_held_out()), "doc_id")
    bins = rows.groupBy(F.floor(F.col("anomaly") * 2000).cast("int").alias("bin")).agg(
        F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")
    )
    return calibrate([tuple(r) for r in bins.collect()], clean_loss)


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row: what the rules do to labelled rows that did not set the limit. Counts of bad and good rows, and of those that the base rules and the forest reject."""
    rows = quality_rules(docs, labels, **options)
    worst = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = rows.join(worst.where(_held_out()), "doc_id")
    bad, forest = F.col("quality") == 0, ~F.col("base_failed") & ~F.col("kept")
    return seen.agg(
        *[
            F.count_if(kind & test).alias(f"{name}_{what}")
            for name, kind in (("bad", bad), ("good", ~bad)) for what, test in (("rows", F.lit(True)), ("base", F.col("base_failed")), ("forest", forest))
        ]
    )


def calibrate(bins: list[tuple[int, int, int]], clean_loss: float, width: int = 2000) -> float:
    """The lowest limit above which at most ``clean_loss`` of the good rows lie; above 1 if a kind of label is missing."""
    good, bad = sum(b[2] for b in bins), sum(b[1] for b in bins)
    limit, lost = 1.1, 0
    if not good or not bad:
        return limit
    for at, _, kept in sorted(bins, reverse=True):
        lost += kept
        if lost > clean_loss * good:
            break
        limit = at / width
    return limit
