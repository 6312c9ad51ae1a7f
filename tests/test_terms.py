"""Dictionary match with places against regular expressions."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from signalloom.operators import terms as M
from signalloom.operators.extraction import mention_terms

DICTIONARY = {"Net": [".net", "net core"], "C": ["c", "c++", "C#"], "Node": ["node.js", "node"], "Marks": ["&&"], "Long": ["net core runtime", "a b c"], "Accent": ["é x"]}
CASED = {"Spark": ["Spark", "Go"]}


def plain(text, name, forms, cased):
    body = "|".join(sorted(map(re.escape, forms), key=len, reverse=True))
    found = re.finditer(f"(?<![A-Za-z0-9])(?=({body})(?![A-Za-z0-9]))", text, 0 if cased else re.I | re.A)
    return {(name, m.start(), len(m.group(1))) for m in found}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["net", ".NET", "Core", "runtime", "c", "C++", "c#", "Node", ".js", "&&", "&", "a", "B", "spark", "Spark", "Go", "go", "é", "x", "İ", "1", ",", "\n", " ", " ", " ", " "]), max_size=25).map("".join))
def test_places_equal_regular_expressions(text):
    want = set()
    for name, forms in DICTIONARY.items():
        want |= plain(text, name, forms, False)
    for name, forms in CASED.items():
        want |= plain(text, name, forms, True)
    assert set(M.TermIndex(M.listed(DICTIONARY, CASED)).places(text)) == want


def test_first_place_and_excerpt(spark):
    rows = [(1, "none", "x " * 50 + "Uses node.js and C++ here" + " y" * 50), (2, None, None), (3, "C", "c++"), (4, "", "nothing")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r.id: r.e for r in df.select("id", M.term_excerpts(M.F.array(M.F.lit("Node"), M.F.lit("C"), M.F.lit("Zig")), ["a", "b"], M.listed(DICTIONARY), 8).alias("e")).collect()}
    assert got == {1: ["x Uses node.js and C++", ".js and C++ here y", None], 2: [None] * 3, 3: [None, "C", None], 4: [None] * 3}


@pytest.mark.parametrize("literal", [True, False])
def test_ten_thousand_forms_by_both_ways(spark, monkeypatch, literal):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    forms = [(f"n{i % 4000}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(10_000)] + [("clash", "w1"), (None, "w2"), ("none", None), ("empty", "")]
    texts = [(i, " ".join(rng.choice(words + [forms[i][1]]) for _ in range(60)), None if i % 9 else "W1, w2", "x") for i in range(80)]
    df = spark.createDataFrame(texts, "id long, text string, more string, name string").repartition(3)
    dictionary = spark.createDataFrame(forms, "name string, form string")
    near = M.find_terms(df, ["id"], ["text", "more"], dictionary, literal)
    want = {tuple(r) for r in near.collect()}
    index = M.TermIndex([(n, f, False) for n, f in forms if n and f], literal)
    plain_ = {(i, n, c, s, k, M.around(t, s, k)) for i, *columns, _ in texts for c, t in enumerate(columns) if t for n, s, k in index.places(t)}
    assert want == plain_ and len(want) > 1000
    monkeypatch.setattr(M, "MAX_FORMS", 10)
    assert {tuple(r) for r in M.find_terms(df, ["id"], ["text", "more"], dictionary, literal).collect()} == want
    assert M.find_terms(df.limit(0), ["id"], ["text"], dictionary, literal).count() == 0


def test_mentions_at_word_edges(spark):
    df = spark.createDataFrame([("Ästhetik AG und ACME",), ("acme_x",), ("the acme.",), (None,)], "t string")
    got = [r[0] for r in df.select(mention_terms("t", {"A": ["acme"], "B": ["ästhetik ag"]})).collect()]
    assert got == [["A", "B"], [], ["A"], []]
