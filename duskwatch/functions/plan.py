"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, name: str, col: Column) -> DataFrame:
    """Add ``col`` so that it is computed exactly once per row.

    A filter on a projected column is pushed below the projection by copying the expression, once
    per mention. For a parsed document or two dozen regex rules that multiplies the work. A
    one-element explode is a boundary no filter on its output crosses, while filters on other
    columns and column pruning still do.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(col)).alias(name))
