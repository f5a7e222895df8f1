"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row numbers follow (doc_id, text hash), whatever the files or partitions. The permutation maps 0..N-1
onto itself; permuted number modulo shards is the shard, the quotient is the slot. So shard
sizes differ by at most one row, slots have no gaps, and both directions can be computed
from N, the seed and the number alone, without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.numbering import number_rows

ROUNDS = 6


def _half_bits(n: int) -> int:
    k = 1
    while 1 << (2 * k) < n:
        k += 1
    return k


def _round(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    h = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & mask


def _keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + r * 7_919 + 1) % (1 << 61) for r in range(ROUNDS)]


def permute(number: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The permuted numbers, or with ``inverse`` the originals. Values that leave 0..n-1 walk on along their cycle."""
    k = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(k)) - 1)
    out = np.asarray(number).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> k, out[walk] & mask
        for key in reversed(_keys(seed)) if inverse else _keys(seed):
            if inverse:
                left, right = right ^ _round(left, key, mask), left
            else:
                left, right = right, left ^ _round(right, key, mask)
        out[walk] = (left << k) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that lies in this slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length of the text plus one, 1 for null; the checksum of null is null. Null ids
    come first. Equal rows get different slots, whichever way round; no row is lost for any input.
    ``keep`` names further columns to carry along; they must not have a name of the result.
    """
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_text"), *(keep or []),
    )
    numbered, n = number_rows(rows, [F.col("doc_id"), F.col("_text"), F.col("text_crc32")], "_number")

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    at = numbered.withColumn("_at", place("_number"))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_at", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_at") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(keep or []),
    )
