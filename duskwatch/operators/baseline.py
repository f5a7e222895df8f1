"""Out-of-distribution score against a fitted multivariate baseline."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Baseline:
    """Mean and inverse covariance (pseudo-inverse where it is singular) of ``n`` vectors."""

    mean: np.ndarray
    precision: np.ndarray
    n: int

    @property
    def dim(self) -> int:
        return len(self.mean)


def _block(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors cut or padded with zeros to ``dim``; null entries count as 0."""
    flat = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
    sizes = np.array(column.value_lengths().fill_null(0))
    first = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(first, sizes)
    keep = place < dim
    out[row[keep], place[keep]] = flat[keep]
    return out


def _sums(df: DataFrame, dim: int, centre: np.ndarray | None) -> np.ndarray:
    """Sums over all rows: 1 and x, or with a ``centre`` the outer products of x - centre. Each task adds up its rows; positions are summed by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1 if centre is None else dim * dim)
        for batch in batches:
            x = _block(batch.column("v"), dim)
            if centre is None:
                total += np.r_[len(x), x.sum(axis=0)]
            else:
                total += ((x - centre).T @ (x - centre)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "s"])

    rows = df.mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    return np.array([r["s"] for r in rows])


def fit_baseline(df: DataFrame, features: str = "features", dim: int | None = None) -> Baseline:
    """Mean and sample covariance in two passes of partial sums, centred before they are multiplied.

    ``dim`` defaults to the longest vector. The driver holds dim × dim numbers. Null vectors are left out; with
    fewer than two rows the covariance is the identity.
    """
    rows = df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("v"))
    if dim is None:
        dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    first = _sums(rows, dim, None)
    n = int(first[0]) if len(first) else 0
    if n < 2:
        return Baseline(first[1:] if n else np.zeros(dim), np.eye(dim), n)
    mean = first[1:] / n
    cov = _sums(rows, dim, mean).reshape(dim, dim) / (n - 1)
    full = np.linalg.matrix_rank(cov, hermitian=True) == dim
    return Baseline(mean, np.linalg.inv(cov) if full else np.linalg.pinv(cov, hermitian=True), n)


def ood_score(features: Column, baseline: Baseline) -> Column:
    """Mahalanobis distance from the baseline: 0 up to 1.5 √dim, then growing to 1. Null vectors score 0."""
    mean, precision, dim = baseline.mean, baseline.precision, baseline.dim

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        x = _block(pa.array(column, type=pa.list_(pa.float64()), from_pandas=True), dim) - mean
        distance = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, precision, x), 0.0))
        root = np.sqrt(dim)
        return pd.Series(np.clip((distance - 1.5 * root) / root, 0.0, 1.0) if dim else np.zeros(len(x)))

    return F.when(features.isNull(), 0.0).otherwise(score(features.cast("array<double>")))
