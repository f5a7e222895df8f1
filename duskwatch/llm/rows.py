"""Picking rows: bounded samples by hash, and removal of marked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks up to which they are broadcast; beyond it the rows are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def unit_hash(*cols: Column | str) -> Column:
    """Number in [0, 1) from the hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / (1 << 30)


def hash_sample(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes; a threshold from the row count leaves few to order."""
    total = df.count()
    if total > rows:
        df = df.where(unit_hash(*cols) < 1.1 * rows / total + 5 * rows**0.5 / total)
    return df.orderBy(F.xxhash64(*cols), *cols).limit(rows)


def drop_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose (doc_id, xxhash64 of text) is not in ``marks`` (doc_id, text_hash). Null ids are compared as equal."""
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    packed = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return packed.join(marks, packed["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_anti").select("_row.*")
