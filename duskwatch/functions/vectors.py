"""Vector similarity over ``ARRAY`` columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return dot(a, b) / F.when(size > 0, size)


def query_literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of every row of ``a`` with ``b`` (a vector, or as many rows), summed in order of the dimensions as ``dot`` does."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[..., d]
    return total


def cosine_to(column: Column, query: Sequence[float]) -> Column:
    """Cosine with one known vector, a batch of rows at a time; null where a row has no length, another number of entries or null ones."""
    given = np.array([float(x) for x in query])
    size = sum(float(x) ** 2 for x in query) ** 0.5

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        usable = vectors.is_valid().to_numpy(zero_copy_only=False) & (vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == len(given))
        rows = np.flatnonzero(usable)
        out, none = np.zeros(len(vectors)), np.ones(len(vectors), bool)
        if len(given) and len(rows):
            flat = vectors.take(pa.array(rows)).flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), len(given))
            whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape).all(1)
            x = np.asfortranarray(x)
            own = np.sqrt(_ordered_dot(x, x)) * size
            ok = whole & ~(own <= 0)
            out[rows[ok]], none[rows[ok]] = _ordered_dot(x, given)[ok] / own[ok], False
        return pa.array(out, mask=none)

    # a filter on the score would be pushed below it as a second computation
    return score.asNondeterministic()(column.cast("array<double>"))


def similar_vectors(
    vectors: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.0, tenant: str | None = None,
    column: str = "embedding", exclude: Column | None = None,
) -> DataFrame:
    """Top ``k`` by cosine: one scan that knows the query, each task keeps only its best k."""
    rows = vectors if tenant is None else vectors.where(F.col("tenant_id") == tenant)
    if exclude is not None:
        rows = rows.where(~exclude)
    scored = rows.withColumn("score", cosine_to(F.col(column), query))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), *_tie(vectors)).limit(k)


def _tie(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("vec_id", "event_id", "id") if c in df.columns][:1]


def approx_similar(vectors: DataFrame, query: Sequence[float], k: int = 10, column: str = "embedding") -> DataFrame:
    """Approximate nearest rows by random-projection buckets on unit vectors, with their cosine.

    On unit vectors the squared distance is 2 - 2·cosine, so nearest means most similar.
    """
    from pyspark.ml.linalg import Vectors

    size = sum(float(x) ** 2 for x in query) ** 0.5
    unit = F.transform(F.col(column), lambda x: x.cast("double") / norm(F.col(column)))
    ready = vectors.withColumn("_n", norm(F.col(column))).where("_n > 0").drop("_n").withColumn("unit", array_to_vector(unit))
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=0.5, numHashTables=4, seed=42)
    found = lsh.fit(ready).approxNearestNeighbors(ready, Vectors.dense([x / size for x in query]), k)
    return found.withColumn("score", 1 - F.col("distCol") * F.col("distCol") / 2).drop("unit", "hashes", "distCol")


def hash_vector(text: Column, width: int = 384) -> Column:
    """Text fingerprint: 48 bytes of SHA-512, mapped to [-1, 1], scaled by the largest and tiled."""
    copies = width // 48

    @F.arrow_udf("array<double>")
    def spread(digest: pa.Array) -> pa.Array:
        given = digest.is_valid().to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(digest.drop_null().to_pylist()), np.uint8).reshape(-1, 64)[:, :48] / 127.5 - 1.0
        values = np.zeros((len(digest), 48))
        values[given] = raw / np.abs(raw).max(axis=1, keepdims=True, initial=0)
        flat = pa.array(np.tile(values, (1, copies)).ravel(), mask=None if given.all() else np.repeat(~given, 48 * copies))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(digest) + 1, dtype=np.int32) * 48 * copies), flat)

    return spread(F.unhex(F.sha2(text, 512)))


#: Rows worked on at once where each holds a list of vectors; bounds what a Python worker holds beside its batch.
BLOCK = 256


def _blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from (batch.slice(at, BLOCK) for at in range(0, len(batch), BLOCK))


def _matrix(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Consecutive stretches of ``values`` as rows, each cut or padded with zeros to ``width``."""
    out = np.zeros((len(lengths), width), values.dtype)
    if len(lengths) and (lengths == lengths[0]).all():
        out[:, : lengths[0]] = values.reshape(len(lengths), lengths[0])[:, :width]
    else:
        within = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.arange(width) < lengths[:, None]] = values[within < width]
    return out


def _lists(rows: pa.Array, values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Lists of consecutive ``values``, null where ``rows`` is."""
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=rows.is_null() if rows.null_count else None)


def padded_vectors(column: Column, width: int) -> Column:
    """Each vector of a list of vectors cut or padded with zeros to ``width``; null vectors and entries stay null."""

    @F.arrow_udf("array<array<double>>")
    def pad(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in _blocks(batches):
            vectors = rows.flatten()
            given = vectors.flatten()
            lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = _matrix(given.fill_null(0.0).to_numpy(zero_copy_only=False), lengths, width).ravel()
            missing = _matrix(given.is_null().to_numpy(zero_copy_only=False), lengths, width).ravel() if given.null_count else None
            whole = _lists(vectors, pa.array(values, mask=missing), np.full(len(vectors), width))
            yield _lists(rows, whole, rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

    return pad(column.cast("array<array<double>>"))


def measured_vectors(column: Column) -> Column:
    """Of a list of vectors: their number, the width of the first and the sum of all entries (null if one is null).

    Beside ``padded_vectors`` it runs in the same Python worker, so the lists never travel.
    """

    @F.arrow_udf("struct<vectors: bigint, width: int, total: double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in _blocks(batches):
            vectors = rows.flatten()
            given = vectors.flatten()
            count, width = rows.value_lengths(), vectors.value_lengths()
            number = count.fill_null(0).to_numpy(zero_copy_only=False)
            of_row = np.repeat(np.arange(len(rows)), number)
            entries = np.bincount(of_row, width.fill_null(0).to_numpy(zero_copy_only=False), len(rows)).astype(np.int64)
            # null counts as 0 here and takes its row's total away below
            total = _matrix(given.fill_null(0.0).to_numpy(zero_copy_only=False), entries, entries.max(initial=0)).sum(axis=1)
            unknown = rows.is_null().to_numpy(zero_copy_only=False).copy()
            unknown[of_row[vectors.is_null().to_numpy(zero_copy_only=False)]] = True
            if given.null_count:
                unknown[np.repeat(np.arange(len(rows)), entries)[given.is_null().to_numpy(zero_copy_only=False)]] = True
            first = pa.array(np.cumsum(number) - number, mask=number == 0)
            yield pa.StructArray.from_arrays([count.cast(pa.int64()), width.take(first), pa.array(total, mask=unknown)], ["vectors", "width", "total"])

    return measure(column)
