"""Registered queries of this package, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.decontaminate import find_leaks
from duskwatch.llm.language import identify_language
from duskwatch.llm.language_model import score_texts
from duskwatch.llm.licenses import full_texts, scan_licenses
from duskwatch.llm.mixing import mix_sources
from duskwatch.llm.neighbours import nearest
from duskwatch.llm.ngram_join import ngram_jaccard_join
from duskwatch.llm.quality import quality_rules
from duskwatch.llm.runs import periodic_runs
from duskwatch.llm.sharding import shuffle_into_shards
from duskwatch.llm.toxicity import score_toxicity
from duskwatch.llm.urls import RULES, judge_urls, rule_table
from duskwatch.llm.whitening import whiten


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(_read(spark, sf_dir, "documents"), shards=8)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op4_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), sparse=True, verbatim=True)
    return found.select("doc_id", "item_id", "matched", "windows", "coverage", "kind")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_read(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source's directory holds one for each language, and files in it inherit its licence."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return scan_licenses(files, every_term=True, texts=full_texts()).withColumnRenamed("id", "doc_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_read(spark, sf_dir, "pages"), rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract wants ``deviation`` as a long; where the exact sum needs more than 63 bits it is null here."""
    return whiten(_read(spark, sf_dir, "embeddings"), components=16).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), asks="vec_id % 50 = 0", k=5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_read(spark, sf_dir, "documents"), planted=True, texts=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_feistel_sharding": op2_feistel_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_log_bilinear_lm": op4_log_bilinear_lm,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": op7_mix_sources,
    "op8_license_scan": op8_license_scan,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_kmeans_tree_search": op12_kmeans_tree_search,
    "op13_periodic_runs": op13_periodic_runs,
}
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORD}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)),
        r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        m AS (SELECT x, min(y) AS y FROM r GROUP BY x), k AS (SELECT x, count(*) AS k FROM l GROUP BY x)
        SELECT doc_id, len(g) AS n_shingles, least(doc_id, coalesce(m.y, doc_id)) AS component_id, coalesce(k.k, 0) AS n_links
        FROM s LEFT JOIN m ON m.x = doc_id LEFT JOIN k ON k.x = doc_id""",
    "op7_mix_sources": f"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'none') || '|' || coalesce(md5(text), 'none')), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
        w AS (SELECT *, 2.0::DOUBLE * ss AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
        o AS (SELECT *, 1.5::DOUBLE * sum(ss) OVER () AS total,
            coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
            sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
        l AS (SELECT (total - fixed) / free AS level FROM o WHERE (total - fixed) / free * w <= cap ORDER BY cap / w, source LIMIT 1),
        t AS (SELECT source, ss, round(least(cap, level * w), 6) AS target FROM o, l),
        g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY ALL),
        c AS (SELECT g.source, h, words, ss, target, sum(words) OVER (PARTITION BY g.source ORDER BY h) AS upto FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
        b AS (SELECT *, unnest([least(target, ss), least(greatest(target - ss, 0), ss)]) AS budget FROM c),
        f AS (SELECT source, h, sum(CASE WHEN budget <= 0 THEN 0 WHEN budget >= ss OR upto < budget THEN 1
            WHEN upto - words < budget AND upto - budget <= budget - upto + words THEN 1 ELSE 0 END) AS times FROM b GROUP BY ALL)
        SELECT doc_id, size, ss AS source_size, target, (size * times)::BIGINT AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.h = f.h""",
    # pages hold no canonical link and no redirect, so spelling alone makes aliases here
    "op9_url_filter": rf"""
        WITH r(verdict, rule) AS (VALUES {', '.join(str(x) for x in RULES)}),
        q AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM r),
        u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LOWER}), '') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1) AS query FROM pages),
        n AS (SELECT *, regexp_replace(host, ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/index\.html?$', ''), '/+$', '') || '?' || array_to_string(list_sort(
            list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)'))), '&') AS node FROM u),
        f AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS v FROM (SELECT DISTINCT host, path FROM n) x
            JOIN q ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
        c AS (SELECT node, bool_or(v = 'allow') AS a, bool_or(v = 'block') AS b FROM n JOIN f USING (host, path) WHERE host <> '' GROUP BY node)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN a THEN 'allow' WHEN b THEN 'block' END, 'allow') AS verdict
        FROM n LEFT JOIN f USING (host, path) LEFT JOIN c USING (node)""",
}
