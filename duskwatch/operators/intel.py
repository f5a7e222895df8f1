"""Indicator matching and enrichment joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.functions.text import norm_hostname, norm_ip, norm_username
from duskwatch.operators.segments import segmented

# Embedded indicators (indicator, threat type, threat name, confidence).
IOC_IPS = [
    ("198.51.100.22", "c2", "CobaltStrike C2", 0.95),
    ("203.0.113.50", "c2", "Metasploit Handler", 0.9),
    ("192.0.2.100", "c2", "Empire C2", 0.9),
    ("198.51.100.44", "c2", "Sliver C2", 0.85),
    ("203.0.113.99", "c2", "Custom RAT C2", 0.8),
    ("192.0.2.200", "malware", "Emotet Distribution", 0.95),
    ("198.51.100.150", "malware", "TrickBot Payload Server", 0.9),
    ("203.0.113.175", "malware", "QakBot Delivery", 0.85),
    ("192.0.2.50", "phishing", "Credential Harvester", 0.9),
    ("198.51.100.75", "phishing", "Office365 Phishing", 0.85),
    ("203.0.113.25", "phishing", "Banking Phishing Kit", 0.9),
    ("192.0.2.15", "scanning", "Shodan Scanner", 0.6),
    ("198.51.100.33", "scanning", "Masscan Source", 0.7),
    ("203.0.113.111", "scanning", "ZMap Scanner", 0.6),
    ("192.0.2.250", "crypto_mining", "Monero Mining Pool", 0.85),
    ("198.51.100.222", "crypto_mining", "XMRig Pool Proxy", 0.8),
    ("203.0.113.200", "botnet", "Mirai C2", 0.9),
    ("192.0.2.180", "botnet", "IoT Botnet Controller", 0.85),
]
IOC_DOMAINS = [
    ("evil-c2.example.com", "c2", "CobaltStrike Domain Front", 0.95),
    ("phish-bank.example.com", "phishing", "Banking Phishing", 0.9),
    ("malware-cdn.example.net", "malware", "Malware CDN", 0.9),
    ("crypto-pool.example.org", "crypto_mining", "Mining Pool", 0.8),
    ("exfil-data.example.com", "c2", "Data Exfiltration Endpoint", 0.85),
    ("botnet-cmd.example.net", "botnet", "Botnet C2 Domain", 0.9),
    ("dga-domain1.example.com", "c2", "DGA Domain", 0.7),
    ("dga-domain2.example.com", "c2", "DGA Domain", 0.7),
    ("ransomware-pay.example.org", "malware", "Ransomware Payment Portal", 0.95),
    ("exploit-kit.example.net", "malware", "Exploit Kit Landing", 0.9),
]
IOC_HASHES = [
    ("d41d8cd98f00b204e9800998ecf8427e", "malware", "Known Malware Sample", 0.95),
    ("e99a18c428cb38d5f260853678922e03", "malware", "Emotet Dropper", 0.9),
    ("5d41402abc4b2a76b9719d911017c592", "malware", "Cobalt Strike Beacon", 0.95),
    ("098f6bcd4621d373cade4e832627b4f6", "malware", "TrickBot Binary", 0.9),
    ("ad0234829205b9033196ba818f7a872b", "malware", "Ransomware Payload", 0.95),
]
IOC_SCHEMA = "indicator string, itype string, threat_type string, threat_name string, confidence double"

#: substring dimensions up to this many rows are folded into the plan as literals
LITERAL_LIMIT = 1_000
#: bytes of a needle that are looked up; with its length they fit one number
GRAM = 6
#: grams of needles up to which tasks get their list; 8 bytes each
LISTED_GRAMS = 4_000_000


def embedded_iocs(spark: SparkSession) -> DataFrame:
    rows = [
        (i, kind, t, n, c)
        for kind, values in (("ip", IOC_IPS), ("domain", IOC_DOMAINS), ("hash", IOC_HASHES))
        for i, t, n, c in values
    ]
    return spark.createDataFrame(rows, IOC_SCHEMA)


def match_ioc_ip(events: DataFrame, iocs: DataFrame) -> DataFrame:
    """One row per (event, matching end); the planner broadcasts the indicators if they are small."""
    ends = events.withColumn(
        "_end",
        F.explode(
            F.array(
                F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip")),
                F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip")),
            )
        ),
    ).where("_end.ip IS NOT NULL")
    dim = iocs.where("itype = 'ip'").drop("itype")
    return ends.join(dim, F.col("_end.ip") == F.col("indicator")).withColumn("side", F.col("_end.side")).drop("_end")


def contains_join(events: DataFrame, text: Column, dim: DataFrame, needle: str = "indicator") -> DataFrame:
    """Rows of ``events`` × ``dim`` where ``needle`` is a substring of ``text``, without a nested loop.

    Empty and null needles match nothing, at any size. A small dimension (size checked) becomes
    literals tested in one pass. A larger one is found by grams: a needle of GRAM or more bytes can
    only occur where its first GRAM bytes occur, and a shorter one where all of it does. Up to ``LISTED_GRAMS`` of these are
    broadcast, and tasks pass on only rows that hold one, once per gram; with more, the distinct texts are joined by their
    grams. What is passed on is verified. All ways give the same rows.
    """
    dim = dim.where(F.length(needle) > 0)
    rows = dim.limit(LITERAL_LIMIT + 1).collect()
    if len(rows) <= LITERAL_LIMIT:
        names = dim.columns
        if not rows:
            return events.where(F.lit(False)).select("*", *[F.lit(None).cast(dim.schema[c].dataType).alias(c) for c in names])
        values = F.array(
            *[F.struct(*[F.lit(r[c]).cast(dim.schema[c].dataType).alias(c) for c in names]) for r in rows]
        )
        hits = F.filter(values, lambda d: F.contains(text, d[needle]))
        return events.withColumn("_d", F.explode(hits)).select(*events.columns, *[f"_d.{c}" for c in names])
    head = F.substring(F.col(needle).cast("binary"), 1, GRAM)
    keyed = dim.withColumn("_gram", _gram_code(head))
    grams = keyed.select("_gram").distinct()
    listed = grams.limit(LISTED_GRAMS + 1).toArrow().column("_gram").to_numpy()
    hay = events.withColumn("_text", text)
    kept = events.columns
    if len(listed) <= LISTED_GRAMS:
        shared = events.sparkSession.sparkContext.broadcast(np.sort(listed))
        schema = T.StructType([*hay.schema.fields, T.StructField("_gram", T.LongType())])
        probes = hay.where(F.col("_text").isNotNull()).mapInArrow(_gram_rows(shared, None), schema)
    else:
        texts = hay.where(F.col("_text").isNotNull()).select("_text").distinct()
        schema = T.StructType([T.StructField("_text", T.StringType()), T.StructField("_gram", T.LongType())])
        lengths = [r[0] for r in keyed.select(F.least(F.octet_length(needle), F.lit(GRAM))).distinct().collect()]
        found = texts.mapInArrow(_gram_rows(None, lengths), schema).join(keyed, "_gram").where(F.contains(F.col("_text"), F.col(needle)))
        return hay.join(found.drop("_gram"), "_text").select(*kept, *dim.columns)
    return probes.join(keyed, "_gram").where(F.contains(F.col("_text"), F.col(needle))).select(*kept, *dim.columns)


def _gram_code(head: Column) -> Column:
    """The first bytes of a needle as one number: their length, then the bytes."""
    return F.conv(F.concat(F.hex(F.octet_length(head)), F.rpad(F.hex(head), 2 * GRAM, "0")), 16, 10).cast("long")


def _gram_rows(shared, lengths):
    """Rows of a batch once per distinct gram of ``_text``: those in the broadcast list, or all of the given lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else shared.value
        sizes = lengths if wanted is None else sorted(set((wanted >> (8 * GRAM)).tolist()))
        for batch in batches:
            for low in range(0, len(batch), 2_000):
                part = batch.slice(low, 2_000)
                row, gram = _grams_of(part.column("_text"), sizes, wanted)
                # few texts hold a listed gram; with all grams the output is cut
                for at in range(0, len(row), 100_000):
                    picked = part.take(pa.array(row[at : at + 100_000]))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(gram[at : at + 100_000])], [*part.schema.names, "_gram"])

    return run


def _grams_of(column: pa.Array, sizes: list[int], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct grams of each text."""
    texts = [x.as_py().encode() for x in column]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(GRAM), np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    left = ends[owner] - np.arange(len(owner))
    rows, codes = [], []
    for size in sizes:
        code = np.full(len(owner), size, np.int64)
        for k in range(GRAM):
            code = (code << 8) | (data[k : k + len(owner)] if k < size else 0)
        keep = left >= size
        if wanted is not None and len(wanted):
            keep &= wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
        pair = np.unique(np.stack([owner[keep], code[keep]]), axis=1)
        rows.append(pair[0])
        codes.append(pair[1])
    return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def match_ioc_domain(events: DataFrame, iocs: DataFrame) -> DataFrame:
    dim = iocs.where("itype = 'domain'").drop("itype")
    return contains_join(events, F.lower("message"), dim)


def match_ioc_hash(events: DataFrame, iocs: DataFrame) -> DataFrame:
    """Hash in the message, and again in the signature id: up to two rows per event and hash."""
    fields = events.withColumn("_f", F.explode(F.array("message", "signature_id"))).where("_f IS NOT NULL")
    dim = iocs.where("itype = 'hash'").drop("itype")
    return contains_join(fields, F.lower("_f"), dim).drop("_f")


def match_ioc_feeds(events: DataFrame, embedded: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feed indicators for ends whose address no embedded indicator matched in the same event."""
    ident = [c for c in ("tenant_id", "event_id") if c in events.columns and c in embedded.columns]
    ends = events.select(*ident, F.explode(F.array("src_ip", "dst_ip")).alias("indicator")).where("indicator IS NOT NULL")
    seen = embedded.select(*ident, "indicator").distinct()
    feed = feeds.where("itype = 'ip'").select(
        "indicator",
        F.coalesce("threat_type", F.lit("unknown")).alias("threat_type"),
        F.coalesce("threat_name", F.lit("Feed IOC")).alias("threat_name"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )
    return ends.join(feed, "indicator").join(seen, [*ident, "indicator"], "left_anti")


def ioc_match_array() -> Column:
    """Embedded indicator hits as an array Column, source end first, then destination, domain, hash."""

    def hits(values: list[tuple], test) -> Column:
        structs = F.array(
            *[
                F.struct(F.lit(i).alias("indicator"), F.lit(t).alias("threat_type"),
                         F.lit(n).alias("threat_name"), F.lit(c).alias("confidence"))
                for i, t, n, c in values
            ]
        )
        return F.filter(structs, lambda d: F.coalesce(test(d["indicator"]), F.lit(False)))

    return F.concat(
        hits(IOC_IPS, lambda i: i == F.col("src_ip")),
        hits(IOC_IPS, lambda i: i == F.col("dst_ip")),
        hits(IOC_DOMAINS, lambda i: F.contains(F.lower("message"), i)),
        hits(IOC_HASHES, lambda i: F.contains(F.lower("message"), i)),
        hits(IOC_HASHES, lambda i: F.contains(F.lower("signature_id"), i)),
    )


def lookup_indicator(iocs: DataFrame, itype: str, value: str) -> DataFrame:
    wanted = value.lower() if itype in ("domain", "hash") else value
    return iocs.where((F.col("itype") == itype) & (F.col("indicator") == wanted))


def expire_iocs(iocs: DataFrame, now: Column) -> DataFrame:
    """Indicators still alive: 7 days for shared collections, 24 hours for the other feeds."""
    age = F.unix_micros(now) - F.unix_micros("ingest_ts")
    ttl = F.when(F.col("source").isin("misp", "taxii"), 7 * 86400).otherwise(86400)
    return iocs.where(age < ttl.cast("long") * 1_000_000)


def reputation_score(malicious: Column, abuse: Column) -> Column:
    return F.struct(
        F.least(0.3 + 0.05 * malicious, F.lit(0.99)).alias("vendor_score"),
        (abuse / 100).alias("abuse_score"),
    )


# ---- enrichment ------------------------------------------------------------------------------


def resolve_dhcp(events: DataFrame, leases: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Fill a missing hostname from the last lease of the address at or before the event.

    As-of join: events and leases are laid on one time line per (tenant, address) and the last lease
    is carried forward, over segment borders when one address is hot.
    """
    need = events.where("hostname IS NULL AND src_ip IS NOT NULL")
    have = events.where("hostname IS NOT NULL OR src_ip IS NULL")
    line = need.select(
        "tenant_id", norm_ip(F.col("src_ip")).alias("ip"), F.unix_micros("timestamp").alias("us"),
        F.lit(1).alias("kind"), F.col("event_id").cast("string").alias("tie"), F.col("event_id"),
        F.lit(None).cast("string").alias("host"),
    ).unionByName(
        leases.select(
            "tenant_id", norm_ip(F.col("ip")).alias("ip"), F.unix_micros("ts").alias("us"),
            F.lit(0).alias("kind"), norm_hostname(F.col("host")).alias("tie"),
            F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"),
            norm_hostname(F.col("host")).alias("host"),
        )
    )
    args = {} if max_rows is None else {"max_rows": max_rows}
    seg = segmented(line, ["tenant_id", "ip"], ["us", "kind", "tie"], **args).running(last={"_host": F.col("host")})
    # equal (tenant, address, time) means an equal answer, so repeated event ids cannot multiply rows
    found = seg.rows.where("kind = 1").groupBy(F.struct("tenant_id", "ip", "us").alias("_at")).agg(F.first("_host").alias("_host"))
    at = F.struct("tenant_id", norm_ip(F.col("src_ip")).alias("ip"), F.unix_micros("timestamp").alias("us"))
    filled = need.withColumn("_at", at).join(found, "_at", "left").withColumn("hostname", F.col("_host")).drop("_host", "_at")
    return have.unionByName(filled.select(*have.columns))


def resolve_user_alias(events: DataFrame, aliases: DataFrame, user: str) -> DataFrame:
    key = norm_username(F.col(user))
    dim = aliases.select(
        "tenant_id", norm_username(F.col("alias")).alias("_alias"),
        norm_username(F.col("canonical")).alias("_canonical"),
    ).groupBy("tenant_id", "_alias").agg(F.min("_canonical").alias("_canonical"))
    out = events.withColumn("_alias", key).join(dim, ["tenant_id", "_alias"], "left")
    return out.withColumn("canonical_user", F.coalesce("_canonical", "_alias")).drop("_alias", "_canonical")


def enrich_asset_criticality(
    events: DataFrame, registry: DataFrame, cmdb: DataFrame, asset: str
) -> DataFrame:
    code = F.expr("try_cast(business_criticality AS INT)")
    cmdb_score = F.when(code == 1, 0.9).when(code == 2, 0.7).when(code == 3, 0.5).when(code.isNotNull(), 0.3)
    # one row per key, the highest score of several, so that rows are kept as they are
    dim = cmdb.groupBy(F.col("name").alias(asset)).agg(F.max(cmdb_score).alias("_cmdb"))
    reg = registry.groupBy("tenant_id", F.col("asset_name").alias(asset)).agg(F.max("criticality_score").alias("_reg"))
    return (
        events.join(dim, asset, "left")
        .join(reg, ["tenant_id", asset], "left")
        .withColumn("asset_criticality", F.coalesce("_cmdb", "_reg", F.lit(0.5)))
        .drop("_cmdb", "_reg")
    )


CVE_RX = r"CVE-\d{4}-\d{4,7}"


def cve_ids(limit: int | None = None) -> Column:
    """Distinct CVE ids of message and raw_log in sorted order, all of them or the first ``limit``."""
    found = F.concat(
        F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit(CVE_RX), F.lit(0)),
        F.regexp_extract_all(F.coalesce("raw_log", F.lit("")), F.lit(CVE_RX), F.lit(0)),
    )
    ids = F.array_sort(F.array_distinct(found))
    return ids if limit is None else F.slice(ids, 1, limit)


def _one_per_key(dim: DataFrame, key: str) -> DataFrame:
    """One row per key: of several the smallest by its JSON text, so that reruns agree."""
    rest = [c for c in dim.columns if c != key]
    return dim.groupBy(key).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_r")).select(key, "_r.*")


def enrich_cve(events: DataFrame, cves: DataFrame, limit: int | None = None) -> DataFrame:
    """CVE context array per event, of all ids it names or the first ``limit``.

    Contexts are built once per distinct list of ids, so only events that name one are joined and
    repeated event ids cannot multiply rows.
    """
    tagged = events.withColumn("_ids", cve_ids(limit))
    ids = tagged.where(F.size("_ids") > 0).select("_ids").distinct().select("_ids", F.explode("_ids").alias("cve_id"))
    ctx = (
        ids.join(_one_per_key(cves, "cve_id"), "cve_id")
        .groupBy("_ids")
        .agg(F.array_sort(F.collect_list(F.struct("cve_id", *[c for c in cves.columns if c != "cve_id"])))
             .alias("cve_context"))
    )
    none = tagged.where(F.size("_ids") == 0).drop("_ids").withColumn("cve_context", F.lit(None).cast(ctx.schema["cve_context"].dataType))
    return tagged.where(F.size("_ids") > 0).join(ctx, "_ids", "left").drop("_ids").unionByName(none)


# Address prefixes the exposure lookup treats as private.
PRIVATE_PREFIXES = [
    "10.", "192.168.", "127.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.30.", "172.31.",
]


def enrich_exposure(events: DataFrame, exposures: DataFrame) -> DataFrame:
    """Internet exposure of the source address, else the destination; private addresses are skipped."""
    ip = F.coalesce(F.when(F.col("src_ip") != "", F.col("src_ip")), F.when(F.col("dst_ip") != "", F.col("dst_ip")))
    private = reduce(lambda a, b: a | b, [ip.startswith(p) for p in PRIVATE_PREFIXES])
    keyed = events.withColumn("_ip", F.when(~private, ip))
    dim = _one_per_key(exposures, "ip").withColumnRenamed("ip", "_ip").withColumn("_known", F.lit(True))
    out = keyed.join(dim, "_ip", "left")
    return out.withColumn("exposed_ip", F.col("_ip")).withColumn(
        "is_exposed", F.when(F.col("_ip").isNotNull(), F.coalesce("_known", F.lit(False)))
    ).drop("_ip", "_known")


def merge_notes(by_note: DataFrame, by_entity: DataFrame, limit: int) -> DataFrame:
    """Both note lists, one row per id with the first list winning, cut to the report limit."""
    both = by_note.withColumn("_src", F.lit(0)).unionByName(by_entity.withColumn("_src", F.lit(1)))
    rest = [c for c in by_note.columns if c != "id"]
    picked = both.groupBy("id").agg(
        F.min_by(F.struct("_src", "rank", *[c for c in rest if c != "rank"]), F.struct("_src", "rank")).alias("r")
    )
    return picked.select("id", "r.*").orderBy("_src", "rank", "id").limit(limit).drop("_src")
