"""Tables that hold the last row per key, merged batch by batch and safe to replay.

Rows lie in buckets by the hash of their key. A merge rewrites the buckets it touches under its batch
number and then writes a manifest that names the current folder of every bucket. A reader follows the newest manifest,
so a merge that fails leaves the table as it was, and one that is repeated starts again from the
manifest before it and gives the same rows. Folders that no manifest needs any more may be deleted by the owner of the path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators.graph import upsert_latest


@dataclass
class CurrentTable:
    """Rows of ``schema`` (DDL) under ``path``, unique in ``keys``; of several the one last by ``order`` stays, and a later batch beats an earlier one on ties."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    order: list[str]
    buckets: int = 32

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifest(self, before: int | None) -> list[tuple[int, int]]:
        """(bucket, batch that wrote its current rows), from the newest manifest, or the newest of a batch earlier than ``before``."""
        try:
            found = self.spark.read.schema("bucket int, written bigint, batch bigint").parquet(f"{self.path}/manifest")
        except AnalysisException as gone:
            if gone.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if before is not None:
            found = found.where(F.col("batch") < before)
        last = found.agg(F.max("batch")).first()[0]
        return [] if last is None else [(r.bucket, r.written) for r in found.where(F.col("batch") == last).collect()]

    def _rows(self, manifest: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/data/batch={w}/bucket={b}" for b, w in manifest]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        return self._rows(self._manifest(before))

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Take in the rows of batch number ``batch``; batches are numbered upwards, and a repeated one replaces itself."""
        manifest = self._manifest(batch)
        names = self.read(before=0).columns
        new = rows.select(*names).withColumn("_bucket", self._bucket()).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]
            old = self._rows([m for m in manifest if m[0] in set(touched)])
            both = old.withColumns({"_bucket": self._bucket(), "_at": F.lit(0)}).unionByName(new.withColumn("_at", F.lit(1)))
            latest = upsert_latest(both, self.keys, F.struct(*self.order, "_at", F.xxhash64(*names)))
            if touched:
                latest.select(*names, F.col("_bucket").alias("bucket")).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
                    f"{self.path}/data/batch={batch}"
                )
            entries = [m for m in manifest if m[0] not in set(touched)] + [(b, batch) for b in touched]
            self.spark.createDataFrame(entries, "bucket int, written bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        finally:
            new.unpersist()
