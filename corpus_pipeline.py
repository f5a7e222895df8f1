"""The corpus pipeline: five operators in a row, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duskwatch.llm.components import settle
from duskwatch.llm.decontaminate import without_leaks
from duskwatch.llm.mixing import mixed_rows
from duskwatch.llm.ngram_join import keep_one
from duskwatch.llm.sharding import shuffle_into_shards
from duskwatch.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; one document of each group stays."""
    return keep_one(docs, size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), sparse=True, verbatim=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all columns, with their shard and slot; a column named like one of the result's own gives way to it."""
    own = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    return shuffle_into_shards(docs, shards=8, keep=[c for c in docs.columns if c not in own])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first stage is a trained model, which SQL cannot express; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
