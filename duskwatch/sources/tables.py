"""Reading and writing the event table and its by-products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.session import num_partitions


def month_of(col: str = "timestamp") -> Column:
    return F.date_format(col, "yyyyMM")


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append to month partitions, clustered inside each file.

    Rows are range-partitioned on (month, tenant, time): a busy month or tenant spreads over several
    tasks, and each task writes few months. File footers then prune on tenant and time.
    """
    cols = ["month", "tenant_id", "timestamp", "source_type"]
    out = events.withColumn("month", month_of())
    n = num_partitions(events.sparkSession)
    (
        out.repartitionByRange(n, *cols, "event_id").sortWithinPartitions(*cols)
        .write.mode(mode).partitionBy("month").parquet(path)
    )


def read_events(
    spark: SparkSession, path: str, tenant: str | None = None, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Tenant- and time-bounded scan. The bound on time is repeated on ``month`` so partitions prune."""
    df = spark.read.parquet(path)
    if tenant is not None:
        df = df.where(F.col("tenant_id") == tenant)
    for bound, op in ((since, "ge"), (until, "lt")):
        if bound is None:
            continue
        t = F.lit(bound).cast("timestamp")
        df = df.where(F.col("timestamp") >= t if op == "ge" else F.col("timestamp") < t)
        if "month" in df.columns:
            m = F.col("month").cast("int")
            edge = F.date_format(t, "yyyyMM").cast("int")
            df = df.where(m >= edge if op == "ge" else m <= edge)
    return df


def apply_retention(events: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return events.where(F.col("timestamp") >= now - F.make_interval(days=F.lit(days)))


def purge_audit(audit: DataFrame, now: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(kept rows plus the row that records the purge, one-row count of purged rows)."""
    cutoff = now - F.make_interval(days=F.lit(days))
    old = (F.col("timestamp") < cutoff) & (F.col("category") != "retention")
    marks = {
        "timestamp": now, "category": F.lit("retention"), "action": F.lit("retention_purge_initiated"), "actor": F.lit("system"),
        "tenant_id": F.lit("system"),
    }
    one = audit.sparkSession.range(1).select(
        *[marks.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in audit.schema.fields]
    )
    kept = audit.where(~F.coalesce(old, F.lit(False))).unionByName(one)
    return kept, audit.agg(F.count_if(old).alias("purged"))


# Header of the event report.
REPORT_COLUMNS = ["timestamp", "event_id", "source_type", "severity", "action", "src_ip", "dst_ip", "meta_score", "message"]


def report_rows(events: DataFrame, n: int) -> DataFrame:
    return events.select(*REPORT_COLUMNS).orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n)


#: Rows of a report that one file may hold.
REPORT_LIMIT = 1_000_000


def write_report_csv(events: DataFrame, path: str, n: int) -> None:
    """Newest ``n`` rows, at most ``REPORT_LIMIT``, with a fixed header, in one file."""
    if not 0 <= n <= REPORT_LIMIT:
        raise ValueError(f"a report holds at most {REPORT_LIMIT} rows")
    report_rows(events, n).coalesce(1).sortWithinPartitions(F.desc("timestamp"), F.desc("event_id")).write.mode("overwrite").csv(
        path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
