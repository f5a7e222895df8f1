import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duskwatch.llm import licenses
from duskwatch.llm.licenses import TEMPLATES, scan_licenses
from duskwatch.llm.queries import op8_license_scan

APACHE = "Licensed under the Apache License, Version 2.0."
FILES = [
    (1, "a/LICENSE", "This work is licensed under the GNU General Public License, version 3.\n"), (2, "a/x.py", "code here"), (3, "a/b/c/y.py", "more code"),
    (4, "a/b/z.py", "# " + APACHE + "\n" + "much code follows in this file " * 9), (5, "other/x.py", "code"), (6, "a/b/COPYING.txt", "some lines first\nReleased under the MIT License.\nand more lines after that one"),
    (7, "a/b/c/d/w.py", None), (8, None, APACHE), (9, None, None), (10, "ab/x.py", ""), (11, "a/late.py", "word " * 30_000 + "\n" + APACHE), (12, "a/x.py", "code here"),
    (13, "lic/text", "Licensed under CC BY-NC 4.0."), (14, "lic/q.py", "x"), (15, "lic/LICENSE-NOTES", "nothing that is known zzz"),
]
WANT = {
    1: ("GPL-3.0", "file"), 2: ("GPL-3.0", "inherited"), 3: ("MIT", "inherited"), 4: ("Apache-2.0", "header"), 5: (None, None), 6: ("MIT", "file"), 7: ("MIT", "inherited"),
    8: ("Apache-2.0", "file"), 9: (None, None), 10: (None, None), 11: ("Apache-2.0", "header"), 12: ("GPL-3.0", "inherited"), 13: ("CC-BY-NC-4.0", "file"), 14: ("CC-BY-NC-4.0", "inherited"),
}


def test_headers_files_and_inheritance(spark):
    files = spark.createDataFrame(FILES, "id long, path string, text string").withColumn("own", F.lit(1)).repartition(3)
    rows = {r.id: r for r in scan_licenses(files).collect()}
    assert len(rows) == len(FILES)
    assert {k: (rows[k].license, rows[k].origin) for k in WANT} == WANT
    assert rows[11].line == 1 and rows[4].line == 0


def test_cosine_equals_brute_force(spark):
    texts = [t for _, _, t in FILES if t] + [t[1] + " and a few more words" for t in TEMPLATES]
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    got = {r.id: r.cosine for r in scan_licenses(files, threshold=0.0).collect()}
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    terms = lambda t: Counter(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.translate(low)))
    lines = [x for t in texts for x in t.split("\n") if x]
    df = Counter(w for x in lines for w in terms(x))
    vocab = {w for _, t in TEMPLATES for w in terms(t)}
    idf = lambda w: math.log((1 + len(lines)) / (1 + (df[w] if w in vocab else 0))) + 1

    def cosine(a, b):
        va, vb = ({w: n * idf(w) for w, n in terms(x).items()} for x in (a, b))
        return sum(va[w] * vb.get(w, 0) for w in va) / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))

    for i, t in enumerate(texts):
        assert abs(got[i] - max(cosine(x, y) for x in (*filter(None, t.split("\n")), t) for _, y in TEMPLATES)) < 1e-9


def test_odd_and_empty_tables(odd, none):
    shape = lambda df: df.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("path"), "text")
    rows = scan_licenses(shape(odd)).collect()
    assert len(rows) == odd.count() and all(r.license is None for r in rows)
    assert scan_licenses(shape(none)).collect() == []


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_every_term_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(licenses, "BROADCAST_TERMS", broadcast)
    texts = [t for _, _, t in FILES if t] + [t[1] + " and a few more words" for t in TEMPLATES] + ["a few more words\n" * 30]
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string").repartition(3)
    got = {r.id: r.cosine for r in scan_licenses(files, threshold=0.0, every_term=True).collect()}
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    terms = lambda t: Counter(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.translate(low)))
    lines = [x for t in texts for x in t.split("\n") if x]
    df = Counter(w for x in lines for w in terms(x))
    idf = lambda w: math.log((1 + len(lines)) / (1 + df[w])) + 1

    def cosine(a, b):
        va, vb = ({w: n * idf(w) for w, n in terms(x).items()} for x in (a, b))
        return sum(va[w] * vb.get(w, 0) for w in va) / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))

    for i, t in enumerate(texts):
        assert abs(got[i] - max(cosine(x, y) for x in (*filter(None, t.split("\n")), t) for _, y in TEMPLATES)) < 1e-9


def test_every_term_keeps_headers_files_and_inheritance(spark):
    files = spark.createDataFrame(FILES, "id long, path string, text string").repartition(3)
    rows = {r.id: r for r in scan_licenses(files, every_term=True).collect()}
    assert len(rows) == len(FILES)
    assert {k: (rows[k].license, rows[k].origin) for k in WANT} == WANT
    assert rows[11].line == 1 and rows[4].line == 0


def test_header_among_common_words_on_many_lines(spark, tmp_path):
    plain = "\n".join(["this package and its parts are in daily use"] * 10)
    header = "this package and its parts are licensed under the Apache License, Version 2.0."
    docs = spark.range(2200).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 200, header + "\n" + plain).otherwise(plain).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_license_scan(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows if r.license == "Apache-2.0" and r.origin == "header" and r.line == 0} == set(range(200))
    assert all(r.license is None for r in rows if r.doc_id >= 200)


def test_every_term_odd_and_empty_tables(odd, none):
    shape = lambda df: df.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("path"), "text")
    rows = scan_licenses(shape(odd), every_term=True).collect()
    assert len(rows) == odd.count() and all(r.license is None for r in rows)
    assert scan_licenses(shape(none), every_term=True).collect() == []


CODE = "\n".join(f"x{i} = compute(value_{i}, other_{i % 7})  # line {i} of the module" for i in range(80))
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following\n# conditions are met\n"
NC = "/* This work is licensed under a Creative Commons\n * Attribution-NonCommercial 4.0 International License */\n"


@pytest.mark.parametrize("every_term", [False, True])
def test_named_files_wrapped_headers_and_full_texts(spark, every_term):
    texts = dict(licenses.full_texts())
    agpl = texts["GPL-3.0"].replace("GNU General Public", "GNU Affero General Public").replace("GENERAL PUBLIC LICENSE", "AFFERO GENERAL PUBLIC LICENSE", 1).replace("Version 3, 29 June 2007", "Version 3, 19 November 2007", 1)
    files = [
        ("mpl/LICENSE", texts["MPL-2.0"], ("MPL-2.0", "file")), ("mpl/a.py", CODE, ("MPL-2.0", "inherited")),
        ("int/LICENSE", "Internal use only. Ask the legal department before you copy this software.", ("unknown", "file")), ("int/a.py", CODE, ("unknown", "inherited")),
        ("mit/LICENSE", "Copyright 2020 Someone\n\n" + texts["MIT"], ("MIT", "file")), ("mit/int/LICENSE.txt", "ask us", ("unknown", "file")), ("mit/int/b.py", CODE, ("unknown", "inherited")),
        ("mit/c.py", CODE, ("MIT", "inherited")), ("mit/e/LICENSE", "", ("MIT", "inherited")), ("mit/e/c.py", CODE, ("MIT", "inherited")), ("mit/n/NOTICE", "Thanks to all who helped.", ("MIT", "inherited")),
        ("h/bsd.py", BSD + CODE, ("BSD-3-Clause", "header")), ("h/nc.py", CODE + "\n" + NC + CODE, ("CC-BY-NC-4.0", "header")), ("h/none.py", CODE, (None, None)),
        ("gpl/COPYING", texts["GPL-3.0"], ("GPL-3.0", "file")), ("gpl2/COPYING", texts["GPL-2.0"], ("GPL-2.0", "file")), ("agpl/COPYING", agpl, ("AGPL-3.0", "file")),
        ("lgpl/COPYING", texts["LGPL-2.1"], ("LGPL-2.1", "file")), ("two/bsd", texts["BSD-2-Clause"], ("BSD-2-Clause", "file")), ("three/bsd", texts["BSD-3-Clause"], ("BSD-3-Clause", "file")),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "id long, path string, text string").repartition(3)
    rows = {r.id: r for r in scan_licenses(df, every_term=every_term, texts=licenses.full_texts()).collect()}
    # full texts hold notices and titles of several licences; the file's own must win
    got = {files[i][0]: (rows[i].license, rows[i].origin) for i in rows}
    want = {p: w for p, _, w in files}
    assert got == want
    assert rows[12].line == 80 and rows[11].line == 0


def test_documents_do_not_inherit_from_strangers(spark):
    rows = op8_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert not [r for r in rows if r.origin == "inherited"] and any(r.origin == "header" for r in rows)


def test_a_licence_in_a_directory_reaches_its_other_texts(spark, tmp_path):
    """The query's directories hold many documents, so inheritance acts on them."""
    from duskwatch.llm.licenses import full_texts
    from duskwatch.llm.queries import op8_license_scan

    name, text = full_texts()[0]
    rows = [(1, text, "en", "a"), (2, "plain words of a story", "en", "a"), (3, "plain words of a story", "de", "a"), (4, "plain words of a story", "en", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.origin, r.license is None) for r in op8_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("file", False), 2: ("inherited", False), 3: (None, True), 4: (None, True)}
