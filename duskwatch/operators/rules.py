"""Detection rules: embedded rule list, detection-block rules, tags and response levels.

Every rule becomes one boolean Column, so all rules are tested in a single pass over the scan.
"""

from __future__ import annotations

import re
from typing import Any, Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.plan import pin
from duskwatch.functions.scoring import bind

# Rule ids, names, technique references, conditions and confidences.
# (id, name, technique id, technique name, tactic, conditions, confidence)
RULES: list[tuple[str, str, str, str, str, dict[str, Any], float]] = [
    ("sigma-001", "CobaltStrike Beacon Activity", "T1071.001",
     "Application Layer Protocol: Web Protocols", "command-and-control",
     {"message": r"(?i)cobalt\s*strike|beacon"}, 0.95),
    ("sigma-002", "Brute Force Login Attempt", "T1110", "Brute Force", "credential-access",
     {"action": "authenticate", "outcome_failure": True}, 0.7),
    ("sigma-003", "Port Scan Detected", "T1046", "Network Service Discovery", "discovery",
     {"message": r"(?i)port\s*scan|nmap|masscan"}, 0.8),
    ("sigma-004", "SQL Injection Attempt", "T1190", "Exploit Public-Facing Application",
     "initial-access",
     {"message": r"(?i)sql\s*injection|union\s+select|drop\s+table|1\s*=\s*1"}, 0.85),
    ("sigma-005", "Lateral Movement via SMB", "T1021.002",
     "Remote Services: SMB/Windows Admin Shares", "lateral-movement",
     {"dst_port": 445, "action": "connect"}, 0.6),
    ("sigma-006", "DNS Tunneling Activity", "T1071.004", "Application Layer Protocol: DNS",
     "command-and-control", {"message": r"(?i)dns\s*tunnel|iodine|dnscat"}, 0.9),
    ("sigma-007", "PowerShell Empire Activity", "T1059.001",
     "Command and Scripting Interpreter: PowerShell", "execution",
     {"message": r"(?i)powershell.*empire|invoke-empire|stager"}, 0.9),
    ("sigma-008", "Data Exfiltration via HTTP", "T1048.002",
     "Exfiltration Over Alternative Protocol: Exfiltration Over Asymmetric Encrypted Non-C2 Protocol",
     "exfiltration", {"high_bytes_out": True}, 0.5),
    ("sigma-009", "Ransomware Indicators", "T1486", "Data Encrypted for Impact", "impact",
     {"message": r"(?i)ransomware|encrypt.*files|\.locked|ransom\s*note"}, 0.95),
    ("sigma-010", "Suspicious RDP Connection", "T1021.001",
     "Remote Services: Remote Desktop Protocol", "lateral-movement", {"dst_port": 3389}, 0.5),
    ("sigma-011", "Credential Dumping Attempt", "T1003", "OS Credential Dumping",
     "credential-access", {"message": r"(?i)mimikatz|lsass|credential\s*dump|sekurlsa"}, 0.95),
    ("sigma-012", "Suspicious Process Execution", "T1059", "Command and Scripting Interpreter",
     "execution", {"action": "execute", "severity_high": True}, 0.65),
    ("sigma-013", "Malware C2 Communication", "T1071", "Application Layer Protocol",
     "command-and-control", {"message": r"(?i)malware|c2|command.and.control|trojan|rat"}, 0.85),
    ("sigma-014", "Privilege Escalation Attempt", "T1068",
     "Exploitation for Privilege Escalation", "privilege-escalation",
     {"message": r"(?i)privilege\s*escalat|sudo|su\s+root|uac\s*bypass"}, 0.8),
    ("sigma-015", "Phishing Link Click", "T1566.002", "Phishing: Spearphishing Link",
     "initial-access",
     {"message": r"(?i)phishing|suspicious.*link|credential.*harvest"}, 0.75),
    ("sigma-016", "DDoS Flood Detected", "T1498", "Network Denial of Service", "impact",
     {"message": r"(?i)ddos|flood|syn\s*flood|amplification"}, 0.85),
    ("sigma-017", "Web Shell Upload", "T1505.003", "Server Software Component: Web Shell",
     "persistence", {"message": r"(?i)web\s*shell|china\s*chopper|c99|r57"}, 0.9),
    ("sigma-018", "Suspicious DNS Query", "T1071.004", "Application Layer Protocol: DNS",
     "command-and-control", {"message": r"(?i)suspicious.*dns|dga|domain\s*generation"}, 0.7),
    ("sigma-custom-001", "Kerberoasting Activity", "T1558.003", "Kerberoasting",
     "credential-access", {"message": r"(?i)kerberoast|ticket.*request.*rc4"}, 0.85),
    ("sigma-custom-002", "Log4Shell Exploitation Attempt", "T1190",
     "Exploit Public-Facing Application", "initial-access",
     {"message": r"(?i)log4(j|shell)|jndi.*ldap|\$\{jndi:"}, 0.95),
    ("sigma-custom-003", "Golden Ticket Attack", "T1558.001", "Golden Ticket",
     "credential-access", {"message": r"(?i)golden.*ticket|krbtgt|forged.*tgt"}, 0.90),
    ("sigma-custom-004", "DCSync Attack", "T1003.006", "OS Credential Dumping: DCSync",
     "credential-access", {"message": r"(?i)dcsync|replicat.*directory|drsuapi|getncchanges"}, 0.92),
    ("sigma-custom-005", "Scheduled Task Persistence", "T1053.005",
     "Scheduled Task/Job: Scheduled Task", "persistence",
     {"message": r"(?i)schtasks|scheduled.*task.*creat|at\s+\d+:\d+|task\s*scheduler"}, 0.75),
]

# Compliance tags by rule id, by word in the rule name, and by behaviour.
COMPLIANCE_BY_RULE = {
    "susp_powershell_encoded": ["SOC2:CC6.1", "ISO27001:A.12.2.1", "PCI-DSS:6.3.2", "NIST-CSF:DE.CM-4"],
    "recon_port_scan": ["SOC2:CC6.6", "HIPAA:164.312(b)", "GDPR:Art.32", "PCI-DSS:11.4", "NIST-CSF:DE.CM-1"],
    "susp_lateral_movement_wmi": ["SOC2:CC6.1", "ISO27001:A.13.1.2", "PCI-DSS:10.6.1", "NIST-CSF:DE.CM-7"],
    "malware_cobaltstrike": ["SOC2:CC6.8", "HIPAA:164.308(a)(5)(ii)(B)", "PCI-DSS:5.2", "NIST-CSF:DE.CM-4",
                             "GDPR:Art.33"],
    "susp_failed_logins": ["SOC2:CC6.1", "HIPAA:164.312(a)(1)", "GDPR:Art.32", "PCI-DSS:8.3.4",
                           "NIST-CSF:PR.AC-7"],
    "data_access_bulk_download": ["GDPR:Art.5(1)(f)", "GDPR:Art.32", "PCI-DSS:10.2.1", "NIST-CSF:PR.DS-5"],
    "priv_escalation": ["SOC2:CC6.1", "PCI-DSS:7.1", "NIST-CSF:PR.AC-4", "GDPR:Art.32"],
    "account_manipulation": ["SOC2:CC6.2", "PCI-DSS:8.1.4", "NIST-CSF:PR.AC-1"],
}
COMPLIANCE_BY_NAME = [
    ("malware|ransomware", ["SOC2:CC6.8", "ISO27001:A.12.2.1", "NIST-CSF:DE.CM-4"]),
    ("login|brute", ["SOC2:CC6.1", "HIPAA:164.312(a)(1)", "PCI-DSS:8.3.4"]),
    ("exfil|data_leak", ["GDPR:Art.33", "PCI-DSS:12.10", "NIST-CSF:RS.AN-1"]),
]
COMPLIANCE_TEMPORAL = ["SOC2:CC6.1", "NIST-CSF:DE.AE-1", "PCI-DSS:10.6"]
COMPLIANCE_EXFIL = ["SOC2:CC6.6", "HIPAA:164.312(e)(1)", "GDPR:Art.33", "GDPR:Art.34", "PCI-DSS:12.10",
                    "NIST-CSF:RS.AN-1"]

# Response ladder (level, action, urgency, description, may run unattended).
LADDER = [
    (5, "ISOLATE", "immediate", "Isolate host from network — active threat confirmed", True),
    (4, "BLOCK", "immediate", "Block source IP/domain at firewall", True),
    (3, "INVESTIGATE", "high",
     "Assign to analyst for investigation — suspicious activity requires human review", False),
    (2, "MONITOR", "medium", "Add entity to watchlist — escalate if pattern continues", False),
    (1, "LOG", "low", "Log for baseline analysis — no immediate action required", False),
]

# ATT&CK tactic slugs, ids and names; size of the enterprise matrix.
TACTIC_IDS = [
    ("initial_access", "TA0001", "Initial Access"), ("execution", "TA0002", "Execution"),
    ("persistence", "TA0003", "Persistence"),
    ("privilege_escalation", "TA0004", "Privilege Escalation"),
    ("defense_evasion", "TA0005", "Defense Evasion"),
    ("credential_access", "TA0006", "Credential Access"), ("discovery", "TA0007", "Discovery"),
    ("lateral_movement", "TA0008", "Lateral Movement"), ("collection", "TA0009", "Collection"),
    ("exfiltration", "TA0010", "Exfiltration"),
    ("command_and_control", "TA0011", "Command and Control"), ("impact", "TA0040", "Impact"),
    ("resource_development", "TA0042", "Resource Development"),
    ("reconnaissance", "TA0043", "Reconnaissance"),
]
TECHNIQUES_IN_MATRIX = 196


def _literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pattern(rx: str) -> str:
    """The text is lower-cased already; a lower-case pattern does not need the slower (?i)."""
    body = rx.removeprefix("(?i)")
    return body if body == body.lower() else f"(?i){body}"


def rule_predicate(conditions: dict[str, Any]) -> Column:
    """AND of the known conditions over ``_text`` (lower-cased message) and event columns; unknown keys are ignored."""
    tests = {
        "message": lambda p: F.col("_text").rlike(_pattern(p)),
        "action": lambda p: F.coalesce(F.col("action") == p, F.lit(False)),
        "dst_port": lambda p: F.coalesce(F.col("dst_port") == p, F.lit(False)),
        "outcome_failure": lambda p: F.coalesce(F.col("outcome") == "failure", F.lit(False)),
        "severity_high": lambda p: F.coalesce(F.col("severity").isin("high", "critical"), F.lit(False)),
        "high_bytes_out": lambda p: F.coalesce(F.col("bytes_out"), F.lit(0)) >= 1_000_000,
    }
    out = F.lit(True)
    for field, pattern in conditions.items():
        if field in tests and not (field == "message" and not isinstance(pattern, str)):
            out = out & tests[field](pattern)
    return out


MASK_BITS = 62


def _rule_masks(rules: Sequence[tuple]) -> Column:
    """array<bigint> with one bit per rule. Plain conditions and sums, so it compiles to one loop-free block."""
    masks = []
    for at in range(0, len(rules), MASK_BITS):
        bits = [F.when(rule_predicate(r[5]), F.lit(1 << i).cast("bigint")).otherwise(0) for i, r in enumerate(rules[at : at + MASK_BITS])]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        masks.append(total)
    return F.array(*masks)


def _matches_of(masks: Column, rules: Sequence[tuple]) -> Column:
    table = F.array(
        *[
            F.struct(
                F.lit(rid).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(tid).alias("mitre_technique_id"),
                F.lit(tname).alias("mitre_technique_name"), F.lit(tactic).alias("mitre_tactic"), F.lit(float(conf)).alias("confidence"),
            )
            for rid, name, tid, tname, tactic, _, conf in rules
        ]
    )
    def hit(_: Column, i: Column) -> Column:
        word = F.get(masks, F.floor(i / MASK_BITS).cast("int")) if len(rules) > MASK_BITS else F.get(masks, F.lit(0))
        return F.call_function("shiftright", word, i % MASK_BITS).bitwiseAND(F.lit(1)) != 0

    return F.filter(table, hit)


def match_rules(events: DataFrame, rules: Sequence[tuple] = tuple(RULES), mask: str | None = None) -> DataFrame:
    """Add ``rule_matches``: array<struct> of matching rules in rule order.

    All rules are tested in one pass into bit masks, and only the set bits are turned into structs. ``mask`` names a
    column that keeps the masks: tags and response levels are then bit tests against constants.
    """
    out = pin(events, "_text", F.lower(F.coalesce("message", F.lit(""))))
    out = pin(out, "_masks", _rule_masks(rules)).drop("_text")
    out = out.withColumn("rule_matches", _matches_of(F.col("_masks"), rules))
    return out.drop("_masks") if mask is None else out.withColumnRenamed("_masks", mask)


def _words_of(rules: Sequence[tuple], wanted: Callable[[tuple], bool]) -> list[tuple[int, int]]:
    """(word of the mask, bits in it) of the rules that are wanted; known when the plan is built."""
    words: dict[int, int] = {}
    for i, r in enumerate(rules):
        if wanted(r):
            words[i // MASK_BITS] = words.get(i // MASK_BITS, 0) | 1 << i % MASK_BITS
    return sorted(words.items())


def _any_of(mask: Column, rules: Sequence[tuple], wanted: Callable[[tuple], bool]) -> Column:
    out = F.lit(False)
    for word, bits in _words_of(rules, wanted):
        out = out | (F.get(mask, F.lit(word)).bitwiseAND(F.lit(bits)) != 0)
    return out


def _count_of(mask: Column, rules: Sequence[tuple], wanted: Callable[[tuple], bool]) -> Column:
    out = F.lit(0)
    for word, bits in _words_of(rules, wanted):
        out = out + F.bit_count(F.get(mask, F.lit(word)).bitwiseAND(F.lit(bits)))
    return out


def to_mitre(matches: str = "rule_matches") -> Column:
    return F.transform(
        F.col(matches),
        lambda m: F.struct(
            m["mitre_technique_id"].alias("technique_id"),
            m["mitre_technique_name"].alias("technique_name"),
            m["mitre_tactic"].alias("tactic"),
            m["confidence"].alias("confidence"),
        ),
    )


def _tags_of(rule: tuple) -> set[str]:
    rid, name = rule[0].lower(), rule[1].lower()
    found = {t for k, tags in COMPLIANCE_BY_RULE.items() if k == rid for t in tags}
    return found | {t for words, tags in COMPLIANCE_BY_NAME if re.search(words, name) for t in tags}


def compliance_tags(matches: str = "rule_matches", mask: str | None = None, rules: Sequence[tuple] = tuple(RULES)) -> Column:
    """Sorted distinct tags; needs temporal_score and bytes_out beside the matches.

    With the ``mask`` that ``match_rules`` kept, a tag is one bit test: which rules carry it is worked out when the plan is built.
    """
    if mask is not None:
        carried = {t for r in rules for t in _tags_of(r)}
        late, exfil = F.coalesce(F.col("temporal_score") > 0.8, F.lit(False)), F.coalesce(F.col("bytes_out") > 50_000_000, F.lit(False))
        tests = []
        for tag in sorted(carried | set(COMPLIANCE_TEMPORAL) | set(COMPLIANCE_EXFIL)):
            test = _any_of(F.col(mask), rules, lambda r, tag=tag: tag in _tags_of(r)) if tag in carried else F.lit(False)
            test = test | late if tag in COMPLIANCE_TEMPORAL else test
            test = test | exfil if tag in COMPLIANCE_EXFIL else test
            tests.append(F.when(test, F.lit(tag)))
        return F.array_compact(F.array(*tests))
    empty = F.array().cast("array<string>")

    def tags(ids: Column, names: Column) -> Column:
        parts = [F.when(F.array_contains(ids, k), _literal_array(t)).otherwise(empty) for k, t in COMPLIANCE_BY_RULE.items()]
        parts += [F.when(names.rlike(words), _literal_array(t)).otherwise(empty) for words, t in COMPLIANCE_BY_NAME]
        parts.append(F.when(F.col("temporal_score") > 0.8, _literal_array(COMPLIANCE_TEMPORAL)).otherwise(empty))
        parts.append(F.when(F.col("bytes_out") > 50_000_000, _literal_array(COMPLIANCE_EXFIL)).otherwise(empty))
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    hits = F.transform(matches, lambda r: F.struct(F.lower(r["rule_id"]).alias("i"), F.lower(r["rule_name"]).alias("n")))
    return bind(hits, lambda h: tags(h["i"], F.array_join(h["n"], "\n")))


def percent(score: Column, digits: int) -> Column:
    """Percent text; format_number rounds the exact binary value, format_string would not."""
    return F.concat(F.format_number(score * 100, digits), F.lit("%"))


def recommend_response(
    events: DataFrame, matches: str = "rule_matches", iocs: str = "ioc_matches", mask: str | None = None, rules: Sequence[tuple] = tuple(RULES)
) -> DataFrame:
    """Response level from score, indicator confidence, strong rules and campaign membership; ``mask`` as in ``compliance_tags``."""
    score = F.col("meta_score")
    base = (
        F.when(score >= 0.85, 5).when(score >= 0.70, 4).when(score >= 0.50, 3)
        .when(score >= 0.30, 2).otherwise(1)
    )
    ioc_max = F.array_max(F.transform(iocs, lambda i: i["confidence"]))
    by_ioc = F.when(ioc_max >= 0.9, 4).when(ioc_max >= 0.7, 3).otherwise(1)
    strong = F.size(F.filter(matches, lambda m: m["confidence"] >= 0.85)) if mask is None else _count_of(F.col(mask), rules, lambda r: r[6] >= 0.85)
    by_rule = F.when(strong >= 2, 4).when(strong == 1, 3).otherwise(1)
    in_campaign = F.coalesce(F.col("campaign_id"), F.lit("")) != ""
    level = F.greatest(base, by_ioc, by_rule, F.when(in_campaign, 3).otherwise(1))

    def names(col: str, field: str, n: int) -> Column:
        return F.array_join(F.slice(F.transform(col, lambda m: m[field]), 1, n), ", ")

    reasoning = F.concat_ws(
        " | ",
        F.concat(F.lit("ML composite score: "), percent(score, 2)),
        F.when(F.size(matches) > 0,
               F.concat(F.lit("Sigma rule matches: "), names(matches, "rule_name", 3))),
        F.when(F.size(iocs) > 0, F.concat(F.lit("IOC matches: "), names(iocs, "threat_name", 2))),
        F.when(in_campaign, F.concat(F.lit("Part of active campaign: "), F.col("campaign_id"))),
    )
    rungs = F.array(
        *[
            F.struct(F.lit(a).alias("action"), F.lit(u).alias("urgency"), F.lit(d).alias("description"),
                     F.lit(auto).alias("auto_applicable"))
            for _, a, u, d, auto in sorted(LADDER)
        ]
    )
    rung = F.element_at(rungs, level.cast("int"))
    return events.withColumn("recommendation", rung.withField("reasoning", reasoning).withField("confidence", score))


def alert_candidates(events: DataFrame) -> DataFrame:
    """Rows worth an outgoing alert, coloured by score. Delivery is left to the caller."""
    score = F.col("meta_score")
    keep = ~F.col("is_synthetic") & ((score >= 0.85) | F.col("severity").isin("high", "critical"))
    return events.where(keep).withColumn("colour", F.when(score > 0.9, "red").otherwise("orange"))


def triage_candidates(events: DataFrame, threshold: float = 0.7) -> DataFrame:
    return events.where(~F.col("is_synthetic") & (F.col("meta_score") >= threshold))


# ---- detection-block rules -------------------------------------------------------------------


def _field_test(key: str, values: Any, fields: dict[str, Column], strict: bool) -> Column:
    negate = key.startswith("not ")
    parts = (key[4:] if negate else key).strip().split("|")
    name, mods = parts[0], parts[1:]
    if name not in fields:
        return F.lit(False)
    want_all = strict and "all" in mods
    mod = next((m for m in mods if m != "all"), "equals")
    if negate and not strict:
        mod = "equals"
    col = fields[name].cast("string")
    values = values if isinstance(values, list) else [values]
    texts = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    make = {
        "equals": lambda v: col == v,
        "not": lambda v: col == v,
        "contains": lambda v: F.lower(col).contains(v.lower()),
        "startswith": lambda v: col.startswith(v),
        "endswith": lambda v: col.endswith(v),
        "re": lambda v: col.rlike(v),
    }.get(mod, lambda v: F.lit(True))
    out = F.lit(want_all)
    for v in texts:
        out = (out & make(v)) if want_all else (out | make(v))
    if negate or mod == "not":
        out = ~out
    return F.coalesce(out, F.lit(False)) & col.isNotNull()


def _selection_test(selection: Any, fields: dict[str, Column], strict: bool) -> Column:
    if isinstance(selection, list):
        out = F.lit(False)
        for item in selection:
            if isinstance(item, dict):
                out = out | _selection_test(item, fields, strict)
        return out
    out = F.lit(True)
    for key, values in selection.items():
        out = out & _field_test(str(key), values, fields, strict)
    return out


def detection_predicate(
    detection: dict[str, Any], fields: dict[str, Column], strict: bool = True
) -> Column:
    """One detection block as a Column.

    Condition forms, tried in this order: ``a and not b``, ``a or b``, ``a and b``, ``not a``, ``a``.
    ``strict`` honours ``|all`` and ``not field|modifier``; without it the second modifier is dropped.
    """
    results = {
        name: _selection_test(block, fields, strict)
        for name, block in detection.items()
        if name != "condition"
    }
    cond = detection.get("condition", "selection").strip()

    def value(name: str) -> Column:
        return results.get(name.strip(), F.lit(False))

    if " and not " in cond:
        keep, drop = cond.split(" and not ")[:2]
        return value(keep) & ~value(drop)
    if " or " in cond:
        return _fold([value(p) for p in cond.split(" or ")], any_of=True)
    if " and " in cond:
        return _fold([value(p) for p in cond.split(" and ")], any_of=False)
    if cond.startswith("not "):
        return ~value(cond[4:])
    return value(cond)


def _fold(cols: list[Column], any_of: bool) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = (out | c) if any_of else (out & c)
    return out


def match_detection_rules(
    events: DataFrame,
    rules: Sequence[dict[str, Any]],
    fields: dict[str, Column] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Ids of matching enabled rules per event, in rule order."""
    fields = fields or {c: F.col(c) for c in events.columns}
    hits = [
        F.when(detection_predicate(r["detection"], fields, strict), F.lit(r["id"]))
        for r in rules
        if r.get("enabled", True)
    ]
    return events.withColumn(
        "matched_rule_ids", F.filter(F.array(*hits), lambda x: x.isNotNull())
    )


def rule_hit_stats(matched: DataFrame, ids: str = "matched_rule_ids") -> DataFrame:
    return (
        matched.select(F.explode(ids).alias("rule_id"), "timestamp")
        .groupBy("rule_id")
        .agg(F.count("*").alias("match_count"), F.max("timestamp").alias("last_matched"))
    )


def rule_techniques(rules: DataFrame) -> DataFrame:
    """rule_id, technique, base technique and tactic slug parsed from ``tags``."""
    tags = rules.select(F.col("id").alias("rule_id"), F.explode_outer("tags").alias("tag"))
    tag = F.lower("tag")
    technique = F.upper(F.regexp_extract(tag, r"^attack\.(t\d{4}(?:\.\d{3})?)$", 1))
    slug = F.regexp_extract(tag, r"^attack\.([a-su-z].*)$", 1)
    known = [s for s, _, _ in TACTIC_IDS]
    return tags.select(
        "rule_id",
        F.when(technique != "", technique).alias("technique"),
        F.when(slug.isin(known), slug).alias("tactic_slug"),
    )


def rule_coverage(rules: DataFrame) -> DataFrame:
    """Techniques covered per tactic with rule counts, base technique level."""
    parsed = rule_techniques(rules)
    techniques = parsed.where("technique IS NOT NULL").select("rule_id", "technique").distinct()
    tactics = parsed.where("tactic_slug IS NOT NULL").select("rule_id", "tactic_slug").distinct()
    # rules covering the technique anywhere, as in a lookup by technique id
    pairs = techniques.join(tactics, "rule_id").select("tactic_slug", "technique").distinct()
    return (
        pairs.join(techniques, "technique")
        .withColumn("base_technique", F.split("technique", r"\.")[0])
        .groupBy("tactic_slug", "base_technique")
        .agg(
            F.count_distinct(F.when(F.col("technique").contains("."), F.col("technique"))).alias("sub_techniques"),
            F.count_distinct("rule_id").alias("rules"),
        )
    )


def rule_coverage_summary(rules: DataFrame) -> DataFrame:
    parsed = rule_techniques(rules)
    base = F.split("technique", r"\.")[0]
    with_tech = parsed.groupBy("rule_id").agg(
        F.max(F.col("technique").isNotNull()).alias("has_technique")
    )
    covered = (
        parsed.join(with_tech, "rule_id")
        .agg(
            F.count_distinct(base).alias("covered_techniques"),
            F.count_distinct(F.when(F.col("has_technique"), F.col("tactic_slug"))).alias("covered_tactics"),
            F.count_distinct("rule_id").alias("total_rules"),
        )
    )
    return covered.withColumns(
        {
            "total_techniques": F.lit(TECHNIQUES_IN_MATRIX),
            "total_tactics": F.lit(len(TACTIC_IDS)),
            "coverage_pct": F.round(F.col("covered_techniques") / TECHNIQUES_IN_MATRIX * 100, 1),
        }
    )
