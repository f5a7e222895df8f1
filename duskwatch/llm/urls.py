"""URL rules over redirect equivalence: aliases share a decision, explicit allows come first.

A URL's node is its address without scheme, default port, fragment, trailing slash, index page and
tracking parameters. Edges are the canonical links and refresh redirects found in pages. Connected
components over nodes carry decisions from URLs that a rule fits to aliases that no rule fits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from duskwatch.llm.components import components

#: (verdict, rule): host, then the start of the path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
# Query parameters that only track.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)"
#: Rules up to which the rule table is broadcast.
BROADCAST_ROWS = 10_000


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Address that equivalent spellings of a URL share; null for what is not a URL."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when((F.instr(url, "://") > 0) & (host != ""), F.concat(host, path, tail))


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(F.concat(path_of(base), F.lit("")), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(root, folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and refresh redirects of pages, absolute."""
    attr = lambda name: rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = lambda tag, name: F.concat(*[F.regexp_extract(tag, attr(name), i) for i in (1, 2, 3)])
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(tags).alias("tag"))
    is_canonical = F.array_contains(F.split(F.lower(value(F.col("tag"), "rel")), r"\s+"), "canonical")
    is_refresh = F.lower(value(F.col("tag"), "http-equiv")) == "refresh"
    refresh = F.regexp_extract(value(F.col("tag"), "content"), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    link = F.trim(F.when(is_canonical, value(F.col("tag"), "href")).when(is_refresh, refresh))
    return tag.withColumn("link", F.replace(link, F.lit("&amp;"), F.lit("&"))).where("link <> ''").select("url", resolve(F.col("url"), F.col("link")).alias("target"))


def fit_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of each place that a rule fits; the longest rule, of equal ones the first by name."""
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = places.distinct().withColumn("rule_host", F.explode(suffix))
    split = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"))
    small = rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = wide.join(F.broadcast(split) if small else split, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "rule"))
    return hit.groupBy("host", "path").agg(best.alias("_b")).select("host", "path", "_b.rule", "_b.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, host, path, rule, verdict, component.

    A URL that a rule fits has that rule's verdict. Others take allow if any URL of their component
    is allowed by a rule, else block if any is blocked, else allow. Null or unparsable urls have
    empty host and path and are allowed; links to them are ignored.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(node_of(F.col("url"))).alias("node"), node_of(F.col("url")).isNotNull().alias("is_url"))
    links = page_links(pages)
    ends = links.select(F.explode(F.array("url", "target")).alias("url"))
    address = lambda u: F.when(node_of(u).isNotNull(), F.xxhash64(node_of(u)))
    edges = links.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b"))
    places = rows.where("is_url").select("host", "path", "node").unionByName(
        ends.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node")).where("node IS NOT NULL")
    ).distinct()
    fitted = fit_rules(places.select("host", "path"), rules)
    comps = components(edges)
    node = places.join(fitted, ["host", "path"]).groupBy("node").agg(F.bool_or(F.col("verdict") == "allow").alias("allow"), F.bool_or(F.col("verdict") == "block").alias("block"))
    known = places.select("node").distinct().join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = known.join(node, "node").groupBy("component").agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block"))
    passed = known.join(spread, "component", "left").select("node", "component", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("spread"))
    out = rows.join(fitted, ["host", "path"], "left").join(passed.withColumn("is_url", F.lit(True)), ["node", "is_url"], "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"), "component")


def rule_table(spark, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([Row(verdict=v, rule=r) for v, r in rules], "verdict string, rule string")
