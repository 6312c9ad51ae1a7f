"""Exact dedup against a plain grouping."""

import hashlib
import re

from signalloom.llm import contentsort

SCHEMA = "doc_id long, text string, lang string, cells string, mark long"


def plain(rows):
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", row[1] or ""), []).append((row[0] is None, row[0] or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)
        for none, key, i in sorted(members):
            out.append((None if none else key, None if keep[0] else keep[1], len(members), i == min(m[2] for m in members if m[:2] == keep[:2]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "clash", 7) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, contentsort.exact_duplicates(df).collect()), key=repr) == plain(rows)


def test_nulls_blanks_and_repeated_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " "), (4, "\t\n"), (5, "a b"), (6, "a\n\x0b b"), (6, "a b"), (6, "a b"), (None, "a b"), (None, "c"), (None, "c"), (9, "a  b "), (10, "a b"), (11, "a b"), (12, "a\x1cb")])


def test_hot_texts_are_dealt_and_merged(spark):
    rows = [(i, "the same  text " + "x" * 50) for i in range(900, 300, -1)] + [(i, "another hot text") for i in range(2000, 2300)] + [(None, "another hot text")] + [(i, f"own {i}") for i in range(3000, 3200)]
    assert contentsort.hot_contents(spark.createDataFrame(rows, "doc_id long, content string")).count() == 2
    check(spark, rows)


def test_long_texts_that_differ_at_the_end(spark):
    body = "word " * 400_000
    check(spark, [(3, body + "a"), (2, body + "b"), (1, body.replace(" ", "\n") + "a")])


def test_empty_table_and_kept_rows(spark):
    assert contentsort.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(2, "a", "de", "c", 1), (1, "a ", "de", "c", 1), (3, "a", "fr", "c", 1)], SCHEMA)
    assert [r.doc_id for r in contentsort.distinct_documents(df).orderBy("doc_id").collect()] == [1, 2]
