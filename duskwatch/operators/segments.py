"""Ordered per-key computation that survives hot keys.

A window over ``PARTITION BY entity`` puts a whole entity into one task, which is fatal for one that
owns a third of the table. ``segmented`` range-partitions rows on (key, order), so that a hot key
covers as many partitions as it needs; the partition number is the segment. Windows run inside
a segment, and a small checkpointed table (one row per key and segment) carries values over segment
borders; the last values of a key are carried by one small row per segment. There is one path at all sizes. Keys are compared as structs, so null keys are keys like
any other.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from duskwatch.session import ensure_checkpoint_dir, num_partitions

#: Rows of a segment aimed at; more rows make more segments.
MAX_ROWS_PER_KEY = 2_000_000
#: Rows worked on at once where each gets an array of other rows' values.
BLOCK = 1024
SEG, KEY = "_seg", "_key"


@dataclass
class Segments:
    """Rows with a segment number; every (key, segment) group is bounded. ``laid``: a partition holds one segment, in order."""

    df: DataFrame
    order: list[str]
    laid: bool = False

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(SEG, KEY)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(KEY, SEG).orderBy(*self.order)

    def running(
        self, lag: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None, maxs: Mapping[str, Column] | None = None,
        last: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None,
    ) -> "Segments":
        """Per key: previous row's values, inclusive running sums and maxima (nulls ignored), latest
        non-null values, sums over all rows. All of a call share one aggregate, one carry table and one join."""
        lag, sums, maxs, last, totals = lag or {}, sums or {}, maxs or {}, last or {}, totals or {}
        order = F.struct(*self.order)
        inputs = {f"_i_{n}": c for n, c in {**sums, **maxs, **last, **totals}.items()}
        if lag:
            inputs["_row"] = F.struct(*[c.alias(n) for n, c in lag.items()])
        base = self.df.withColumns(inputs)
        tails = [F.sum(f"_i_{n}").alias(f"_c_{n}") for n in [*sums, *totals]] + [F.max(f"_i_{n}").alias(f"_c_{n}") for n in maxs]
        tails += [F.max_by(f"_i_{n}", F.when(F.col(f"_i_{n}").isNotNull(), order)).alias(f"_c_{n}") for n in last]
        earlier = Window.partitionBy(KEY).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        across = [F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in sums] + [F.max(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in maxs]
        across += [F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last]
        across += [F.sum(f"_c_{n}").over(Window.partitionBy(KEY)).alias(f"_c_{n}") for n in totals]
        if lag:
            tails.append(F.max_by("_row", order).alias("_c"))
            across.append(F.last("_c").over(earlier).alias("_c"))
        carried = base.groupBy(KEY, SEG).agg(*tails).select(KEY, SEG, *across).checkpoint()
        df = base.join(carried, [KEY, SEG], "left")
        inside = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = {n: F.coalesce(F.sum(f"_i_{n}").over(inside), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
        out |= {n: F.greatest(F.max(f"_i_{n}").over(inside), F.col(f"_c_{n}")) for n in maxs}
        out |= {n: F.coalesce(F.last(f"_i_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")) for n in last}
        out |= {n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in totals}
        if lag:
            out["_p"] = F.coalesce(F.lag("_row").over(self.window), F.col("_c"))
        df = df.withColumns(out)
        df = df.withColumns({n: F.col(f"_p.{n}") for n in lag}) if lag else df
        return Segments(df.drop(*inputs, *[f"_c_{n}" for n in {**sums, **maxs, **last, **totals}], "_c", "_p"), self.order)

    def last_n(self, name: str, col: Column, n: int) -> "Segments":
        """``col`` of the last ``n`` rows (this row included, oldest first) as an array, nulls left out.

        One walk over the rows for the segments' ends, ``n - 1`` values each, and one for the arrays; nothing is shuffled.
        """
        keys = self.df.schema[KEY].dataType.names
        rows = self.df if self.laid else self.df.repartition(SEG).sortWithinPartitions(SEG, KEY, *self.order)
        rows = rows.drop(KEY).withColumn("_v", col)
        value = rows.schema["_v"].dataType
        ends = T.StructType([T.StructField(SEG, T.IntegerType()), T.StructField("lo", T.BinaryType()), T.StructField("hi", T.BinaryType()), T.StructField("tail", T.ArrayType(value))])
        kept = [f for f in rows.schema.fields if f.name not in ("_v", name)]
        schema = T.StructType([*kept, T.StructField(name, T.ArrayType(value))])
        ends_arrow, arrow = to_arrow_schema(ends), to_arrow_schema(schema)

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for seg, of_seg in groupby(_blocks(batches, keys), lambda b: b[0]):
                lo = tail = None
                for _, batch, new, hi in of_seg:
                    lo = lo or _key(batch, keys, 0)
                    own = batch.column("_v")
                    tail = own.slice(int(np.flatnonzero(new)[-1])) if new.any() else own if tail is None else pa.concat_arrays([tail, own])
                    tail = tail.slice(max(len(tail) - n + 1, 0))
                row = [pa.array([seg], pa.int32()), pa.array([lo], pa.binary()), pa.array([hi], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(tail)], pa.int32()), tail)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(row, ends_arrow, strict=True)], schema=ends_arrow)

        entries, carried, key = {}, None, None
        found = rows.select(*keys, SEG, "_v").mapInArrow(last, ends).toArrow().sort_by(SEG)
        for seg, lo, hi, tail in zip(found[SEG].to_pylist(), found["lo"].to_pylist(), found["hi"].to_pylist(), found["tail"], strict=True):
            if key == lo:
                entries[seg] = carried
            carried = pa.concat_arrays([carried, tail.values]) if key == lo == hi else tail.values
            # taken, not sliced: a slice is sent to the tasks with all it was cut from
            carried, key = carried.take(pa.array(np.arange(max(len(carried) - n + 1, 0), len(carried)))), hi

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for seg, of_seg in groupby(_blocks(batches, keys), lambda b: b[0]):
                tail = entries.get(seg)
                for _, batch, new, _ in of_seg:
                    own = batch.column("_v")
                    before = 0 if tail is None else len(tail)
                    seen = pa.concat_arrays([tail.cast(own.type), own]) if before else own
                    at = np.arange(before, len(seen))
                    first = np.maximum(np.maximum.accumulate(np.where(new, at, 0)), at - n + 1)
                    # a row's array is a stretch of the values seen
                    length = at - first + 1
                    index = np.arange(length.sum()) + np.repeat(first - np.cumsum(length) + length, length)
                    if seen.null_count:
                        given = seen.is_valid().to_numpy(zero_copy_only=False)[index]
                        length = np.bincount(np.repeat(np.arange(len(at)), length)[given], minlength=len(at))
                        index = index[given]
                    made = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), seen.take(pa.array(index)))
                    tail = seen.slice(max(int(first[-1]), len(seen) - n + 1)) if n > 1 else None
                    columns = [*[batch.column(f.name) for f in kept], made]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        df = rows.mapInArrow(arrays, schema).withColumn(KEY, F.struct(*keys))
        return Segments(df, self.order, self.laid)


def _key(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> bytes:
    return pickle.dumps(tuple(batch.column(k)[row].as_py() for k in keys))


def _blocks(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, bytes]]:
    """Segment, its next rows, which of them begin a key, and the key they end with; ``BLOCK`` rows at most."""
    at = ended = None
    for whole in batches:
        seg = whole.column(SEG).to_numpy()
        cuts = sorted({*range(0, len(whole), BLOCK), *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(whole)})
        for start, end in zip(cuts, cuts[1:]):
            batch = whole.slice(start, end - start)
            new = np.zeros(len(batch), bool)
            for k in keys:
                code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            new[0] = at == seg[start] and ended != _key(batch, keys, 0)
            at, ended = int(seg[start]), _key(batch, keys, len(batch) - 1)
            yield at, batch, new, ended


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS_PER_KEY) -> Segments:
    """Give every row a segment of about ``max_rows`` rows or fewer. ``order`` must be unique per key (end it with the event id)."""
    return Segments(range_segments(df, keys, order, max_rows).withColumn(KEY, F.struct(*keys)), list(order), True)


def range_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Range-partition on (keys, order) and pin the result.

    The bounds of a range exchange are sampled, so a recomputed plan could cut elsewhere. The
    checkpoint makes one cut the only one, also after an executor is lost.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = max(num_partitions(spark), math.ceil(df.count() / max_rows))
    return (
        df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn(SEG, F.spark_partition_id()).checkpoint()
    )
