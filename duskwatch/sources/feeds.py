"""Indicator, vulnerability and flow tables built from downloaded files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.sources.normalize import DEAD_LETTER_CHARS, Parsed, lookup, parse_json, reject

# Indicator type maps and confidences of the feeds.
OTX_TYPES = {
    "IPv4": "ip", "IPv6": "ip", "domain": "domain", "hostname": "domain", "URL": "url", "URI": "url", "FileHash-MD5": "hash",
    "FileHash-SHA1": "hash", "FileHash-SHA256": "hash",
}
MISP_TYPES = {"ip-dst": "ip", "ip-src": "ip", "domain": "domain", "md5": "hash", "sha256": "hash"}
STIX_TYPES = {"ipv4-addr": "ip", "domain-name": "domain", "file": "hash", "url": "url"}
STIX_RX = r"([^\s\[]+):value\s*=\s*'(.+?)'"
# CIC flow labels → attack classes, and flow columns → feature slots.
FLOW_LABELS = {
    "BENIGN": "benign", "Bot": "botnet", "DDoS": "ddos", "DoS GoldenEye": "dos", "DoS Hulk": "dos", "DoS Slowhttptest": "dos",
    "DoS slowloris": "dos", "FTP-Patator": "brute_force", "SSH-Patator": "brute_force", "Heartbleed": "exploits",
    "Infiltration": "infiltration", "PortScan": "port_scan", "Web Attack – Brute Force": "web_attack",
    "Web Attack – Sql Injection": "sql_injection", "Web Attack – XSS": "web_attack", "Web Attack \\x96 Brute Force": "web_attack",
    "Web Attack \\x96 Sql Injection": "sql_injection", "Web Attack \\x96 XSS": "web_attack", "Brute Force -Web": "web_attack",
    "Brute Force -XSS": "web_attack", "SQL Injection": "sql_injection", "DDOS attack-HOIC": "ddos", "DDOS attack-LOIC-UDP": "ddos",
    "DDoS attacks-LOIC-HTTP": "ddos", "DoS attacks-Hulk": "dos", "DoS attacks-SlowHTTPTest": "dos", "DoS attacks-Slowloris": "dos",
    "DoS attacks-GoldenEye": "dos", "FTP-BruteForce": "brute_force", "SSH-Bruteforce": "brute_force", "Infilteration": "infiltration",
}
FLOW_SLOTS = {
    "Source Port": 0, "Destination Port": 1, "Total Length of Fwd Packets": 2, "Total Length of Bwd Packets": 3, "Total Fwd Packets": 4,
    "Total Backward Packets": 5, "Flow Duration": 6, "Flow Bytes/s": 8, "Flow Packets/s": 9, "Fwd IAT Mean": 23, "Flow IAT Mean": 35,
    "Flow IAT Std": 36, "Flow IAT Max": 37, "Flow IAT Min": 38, "Fwd Header Length": 51, "Bwd Header Length": 52,
    "Average Packet Size": 53,
}
FLOW_ALIASES = {"src port": "Source Port", "dst port": "Destination Port", "total bwd packets": "Total Backward Packets"}


def _ioc(indicator: Column, itype: Column, kind: str, name: Column, confidence: float, source: str) -> list[Column]:
    return [
        indicator.alias("indicator"), itype.alias("itype"), F.lit(kind).alias("threat_type"), name.alias("threat_name"),
        F.lit(confidence).alias("confidence"), F.lit(source).alias("source"),
    ]


def iocs_from_feodo(rows: DataFrame) -> DataFrame:
    """Rows of a command-and-control blocklist: ip_address, malware."""
    ok = rows.where("ip_address IS NOT NULL AND ip_address <> ''")
    return ok.select(*_ioc(F.col("ip_address"), F.lit("ip"), "c2", F.coalesce("malware", F.lit("Feodo C2")), 0.85, "feodo"))


def iocs_from_urlhaus(rows: DataFrame) -> DataFrame:
    ok = rows.where("url IS NOT NULL AND url <> ''")
    return ok.select(*_ioc(F.col("url"), F.lit("url"), "malware", F.coalesce("threat", F.lit("URLhaus")), 0.80, "urlhaus"))


def iocs_from_otx(pages: DataFrame) -> DataFrame:
    """Pulse pages as JSON text → one row per usable indicator."""
    df = parse_json(pages, "results array<struct<name:string,indicators:array<struct<type:string,indicator:string>>>>").where("NOT bad")
    rows = df.select(F.explode("j.results").alias("p")).select("p.name", F.explode("p.indicators").alias("i"))
    kind = lookup(F.col("i.type"), OTX_TYPES, None)
    ok = rows.where(kind.isNotNull() & (F.col("i.indicator") != ""))
    return ok.select(*_ioc(F.col("i.indicator"), kind, "threat_intel", F.coalesce("name", F.lit("OTX Pulse")), 0.75, "otx"))


def otx_live_confidence(pulses: Column) -> Column:
    return F.when(pulses > 0, F.least(0.5 + pulses * 0.1, F.lit(0.95)))


def iocs_from_misp(pages: DataFrame) -> DataFrame:
    df = parse_json(pages, "response struct<Attribute:array<struct<type:string,value:string>>>").where("NOT bad")
    rows = df.select(F.explode("j.response.Attribute").alias("a"))
    kind = lookup(F.col("a.type"), MISP_TYPES, None)
    return rows.where(kind.isNotNull()).select(*_ioc(F.col("a.value"), kind, "threat_intel", F.lit("MISP Attribute"), 0.85, "misp"))


#: JSON feeds by name, and the field without which a page holds nothing to read.
FEED_FIELDS = {"otx": "results array<string>", "misp": "response struct<Attribute:array<string>>", "nvd": "vulnerabilities array<string>"}


def feed_dead_letters(pages: DataFrame, feed: str, chars: int | None = DEAD_LETTER_CHARS) -> DataFrame:
    """Pages of a JSON feed that could not be read: malformed, or without the list the feed is made of."""
    ddl = FEED_FIELDS[feed]
    df = parse_json(pages, ddl)
    field = F.col("j." + ddl.split()[0]) if feed != "misp" else F.col("j.response.Attribute")
    reason = F.when(F.col("bad"), "invalid_json").when(field.isNull(), "missing_list")
    lost = reject(df.withColumn("_reason", reason).where("_reason IS NOT NULL"), feed, F.col("_reason"))
    return Parsed(pages.limit(0), lost).letters(chars)


def iocs_from_stix(objects: DataFrame, collection: str) -> DataFrame:
    """Indicator patterns like [ipv4-addr:value = '1.2.3.4']; the bracket is not part of the type."""
    kind = lookup(F.regexp_extract("pattern", STIX_RX, 1), STIX_TYPES, None)
    ok = objects.where((F.col("type") == "indicator") & kind.isNotNull())
    value = F.regexp_extract("pattern", STIX_RX, 2)
    return ok.select(*_ioc(value, kind, "threat_intel", F.lit(f"TAXII Collection: {collection}"), 0.8, "taxii"))


_METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>"


def cve_dim_from_nvd(pages: DataFrame, limits: tuple[int, int, int, int] | None = None, text_chars: int | None = None) -> DataFrame:
    """Vulnerability records as JSON text (one answer per row, any number of records) → the CVE dimension.

    ``limits`` cuts configurations, nodes, matches and products; ``text_chars`` cuts the description.
    Without them all are kept.
    """

    def cut(items: Column, i: int) -> Column:
        return items if limits is None else F.slice(items, 1, limits[i])
    cve = (
        f"struct<id:string,published:string,metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
        "descriptions:array<struct<lang:string,value:string>>,"
        "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>>"
    )
    df = parse_json(pages, f"vulnerabilities array<struct<cve:{cve}>>").where("NOT bad")
    df = df.select(F.explode("j.vulnerabilities").alias("v")).select(F.col("v.cve").alias("c")).where("c IS NOT NULL")
    c = F.col("c")

    def metric(v: str) -> Column:
        return F.get(c["metrics"][v], F.lit(0))["cvssData"]

    best = F.coalesce(metric("cvssMetricV31"), metric("cvssMetricV30"), metric("cvssMetricV2"))
    english = F.get(F.filter(c["descriptions"], lambda d: d["lang"] == "en"), F.lit(0))["value"]
    nodes = F.flatten(F.transform(cut(c["configurations"], 0), lambda x: cut(x["nodes"], 1)))
    names = F.flatten(F.transform(nodes, lambda n: cut(F.transform(n["cpeMatch"], lambda m: m["criteria"]), 2)))
    parts = F.filter(F.transform(names, lambda s: F.split(s, ":")), lambda p: F.size(p) >= 5)
    products = cut(F.transform(parts, lambda p: F.concat(p[3], F.lit("/"), p[4])), 3)
    return df.select(
        c["id"].alias("cve_id"), best["baseScore"].alias("cvss_score"), best["baseSeverity"].alias("cvss_severity"),
        F.when(F.size(products) > 0, products).alias("affected_products"), F.substring(c["published"], 1, 10).alias("published_date"),
        (english if text_chars is None else F.substring(english, 1, text_chars)).alias("description"),
    )


# ---- flow files ------------------------------------------------------------------------------


def _canonical_header(name: str) -> str:
    known = {n.lower(): n for n in [*FLOW_SLOTS, "Label"]} | FLOW_ALIASES
    return known.get(name.strip().lower(), name.strip())


def clean_flows(df: DataFrame) -> DataFrame:
    """Canonical headers; non-numbers and infinities become 0, rows without any feature value go."""
    for old in df.columns:
        df = df.withColumnRenamed(old, _canonical_header(old))
    present = [c for c in FLOW_SLOTS if c in df.columns]

    def finite(c: str) -> Column:
        v = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    raw_null = [F.col(f"`{c}`").isNull() | F.lower(F.col(f"`{c}`").cast("string")).isin("", "nan", "inf", "-inf", "infinity", "-infinity") for c in present]
    df = df.where(~reduce(lambda a, b: a & b, raw_null))
    return df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in present})


def flow_class(label: Column) -> Column:
    return lookup(label, FLOW_LABELS, "benign")


def flow_features76(df: DataFrame) -> Column:
    """The flow columns at their fixed slots of the 76-value vector; absent ones are 0."""
    at = {slot: name for name, slot in FLOW_SLOTS.items() if name in df.columns}
    return F.array(*[F.col(f"`{at[i]}`").cast("double") if i in at else F.lit(0.0) for i in range(76)])


def read_flow_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Day files with differing headers, merged by name, with class and feature vector.

    Each file is read with its own header, so the driver loops over file names, never over rows.
    """
    frames = []
    for path in paths:
        one = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=False)
        frames.append(clean_flows(one))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    label = F.col("Label") if "Label" in merged.columns else F.lit("BENIGN")
    filled = merged.fillna(0.0, [c for c in FLOW_SLOTS if c in merged.columns])
    return filled.select("*", flow_class(label).alias("attack_class"), flow_features76(filled).alias("features"))
