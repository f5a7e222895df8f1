from pyspark.sql import functions as F

from duskwatch.llm.urls import judge_urls, rule_table

PAGES = [
    (1, "http://a.example.com/en/1", ""), (2, "https://a.example.com:443/en/1/#top", ""), (3, "http://x.org/p", '<link rel="canonical" href="http://a.example.com/en/9">'),
    (4, "http://y.org/p?utm_source=f", "<META content='0; URL=http://x.org/p' http-equiv=refresh>"), (5, "http://www.EXAMPLE.com/en/2", ""),
    (6, "http://z.org/q", '<link href="http://b.com/" rel="x canonical">'), (7, "http://b.net/es/1", '<link rel=canonical href=//z.org/q>'),
    (8, "http://b.net/de/1", ""), (9, "nothing", ""), (10, None, None), (None, "http://com/", ""), (11, "http://y.org/p", None), (11, "http://y.org/p", None),
    (12, "http://q.org/a/b", '<link rel="canonical" href="c">'), (13, "http://q.org/a/c", '<link rel="canonical" href="/d"><link rel="canonical" href="http://b.net/fr/">'),
    (14, "http://com?x", ""), (15, "http://example.com", ""), (16, "http://q.org/a/c?ref=1&b=2", ""), (17, "HTTP://Q.ORG/d", ""),
]
WANT = {
    1: ("example.com/en/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "block"), 5: ("www.example.com/en/", "allow"), 6: (None, "allow"),
    7: ("net/es/", "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), None: ("com/", "allow"), 11: (None, "block"), 12: (None, "block"),
    13: (None, "block"), 14: (None, "allow"), 15: (None, "allow"), 16: (None, "allow"), 17: (None, "block"),
}


def test_rules_and_aliases(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("node", F.lit(1))
    rows = judge_urls(pages, rule_table(spark)).collect()
    assert len(rows) == len(PAGES)
    assert {r.page_id: (r.rule, r.verdict) for r in rows} == WANT
    by = {r.page_id: r for r in rows}
    assert (by[2].host, by[2].path) == ("a.example.com:443", "/en/1/") and (by[14].host, by[14].path) == ("com", "") and (by[9].host, by[10].path) == ("", "")


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), rule_table(spark)).collect() == []
