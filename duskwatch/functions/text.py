"""String rules as Column -> Column helpers: entity names, masking, severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IPV4 = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
SEVERITIES = ["info", "low", "medium", "high", "critical"]

#: RFC 1918 ranges and loopback
INTERNAL_RX = r"^(10\.|192\.168\.|127\.|172\.(1[6-9]|2[0-9]|3[01])\.)"

# Personal-data patterns in the order they are applied.
PII_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CC", r"\b(?:\d[ -]*?){13,16}\b"),
    ("EMAIL", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"),
]
# Field names whose whole value is hashed.
PII_FIELDS = {
    "EMAIL": ["email", "e-mail", "user_email", "sender_email", "recipient_email"],
    "PHONE": ["phone", "phone_number", "mobile", "telephone"],
    "SSN": ["ssn", "social_security", "social_security_number"],
    "CC": ["credit_card", "cc_number", "card_number"],
    "USER": ["pii_username", "full_name", "patient_name"],
}


def is_internal(ip: Column) -> Column:
    return ip.rlike(INTERNAL_RX)


def severity_rank(col: Column) -> Column:
    out = F.when(col == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(col == s, i)
    return out.otherwise(0)


def norm_ip(col: Column) -> Column:
    """Trim, unwrap IPv4-mapped IPv6, drop leading zeros when every octet is a number."""
    ip = F.regexp_replace(F.trim(col), r"^::ffff:", "")
    dotted = ip.rlike(r"^\d+(\.\d+)+$")
    return F.when(dotted, F.regexp_replace(ip, r"(^|\.)0+(?=\d)", "$1")).otherwise(ip)


def norm_hostname(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"\.$", "")


norm_domain = norm_hostname


def norm_username(col: Column) -> Column:
    """``DOMAIN\\user`` becomes ``user@domain``; the rest is lower-cased."""
    name = F.lower(F.trim(col))
    at = F.instr(name, "\\")
    return F.when(
        at > 0, F.concat(F.substring(name, at + 1, F.length(name)), F.lit("@"), F.substring(name, F.lit(1), at - 1))
    ).otherwise(name)


def canonical_identifier(identifier: Column, entity_type: Column) -> Column:
    return (
        F.when(entity_type == "ip", norm_ip(identifier))
        .when(entity_type.isin("host", "domain"), norm_hostname(identifier))
        .when(entity_type == "user", norm_username(identifier))
        .otherwise(F.lower(F.trim(identifier)))
    )


def _token(kind: str, value: Column) -> Column:
    digest = F.substring(F.sha2(F.lower(F.trim(value)), 256), 1, 12)
    return F.concat(F.lit(f"[{kind}:"), digest, F.lit("]"))


def _mask_one(text: Column, kind: str, rx: str) -> Column:
    """Replace each match by a hash of itself: gaps and hashed matches interleaved."""
    gaps = F.split(text, rx, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda m: _token(kind, m))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    # a cheap test first: most texts hold no address sign, many no digit
    may = text.contains("@") if kind == "EMAIL" else text.rlike("[0-9]")
    return F.when(may & text.rlike(rx), F.array_join(pairs, "")).otherwise(text)


def mask_pii(col: Column) -> Column:
    """Hash personal data inside a text.

    Each step reads the text as a lambda variable. Nested Column trees would repeat the previous
    step's whole expression several times over.
    """

    def step(text: Column, kind: str, rx: str) -> Column:
        return F.transform(F.array(text), lambda t: _mask_one(t, kind, rx))[0]

    for kind, rx in PII_PATTERNS:
        col = step(col, kind, rx)
    return col


def mask_field(name: str, col: Column, dtype: T.DataType, skip: frozenset[str]) -> Column:
    """Mask one field by name, else walk its whole type; the tree is built once, at plan time."""
    for kind, names in PII_FIELDS.items():
        if name.lower() in names:
            text = col.cast("string")
            hashed = F.when(text.isNull() | (text == ""), text).otherwise(_token(kind, text))
            return hashed.cast("string")
    if name in skip:
        return col
    if isinstance(dtype, T.StringType):
        return mask_pii(col)
    if isinstance(dtype, T.StructType):
        fields = [
            mask_field(f.name, col[f.name], f.dataType, skip).alias(f.name) for f in dtype.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StringType, T.StructType, T.ArrayType, T.MapType)):
        return F.transform(col, lambda e: mask_field("", e, dtype.elementType, skip))
    if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, (T.StringType, T.StructType, T.ArrayType, T.MapType)):
        return F.transform_values(col, lambda _, v: mask_field("", v, dtype.valueType, skip))
    return col


def mask_event(df, skip: tuple[str, ...] = ("event_id",)):
    """Mask every string of a frame; named id columns can be left alone."""
    keep = frozenset(skip)
    return df.select(*[mask_field(f.name, F.col(f.name), f.dataType, keep).alias(f.name) for f in df.schema.fields])


def first_ip(text: Column, n: int) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(IPV4), F.lit(1)), F.lit(n))
