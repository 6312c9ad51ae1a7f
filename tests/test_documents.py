"""Nodes of nested documents against a recursive walk."""

import json

from hypothesis import given, settings, strategies as st

from signalloom.operators import documents as D

values = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8)),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.one_of(st.sampled_from(["Evidence", "sources", "title", "summary", "x"]), st.text(max_size=4)), inner, max_size=4)),
    max_leaves=25,
)


def plain(value, key=None, inside=None, path="", out=None):
    out = [] if out is None else out
    members = enumerate(value.items()) if isinstance(value, dict) else ((i, (None, v)) for i, v in enumerate(value)) if isinstance(value, list) else ()
    for i, (name, child) in members:
        here = name if name is not None else inside
        out.append((f"{path}/{i:08d}", name, here, child))
        plain(child, name, here, f"{path}/{i:08d}", out)
    return out


def records(value, in_collection=False, out=None):
    out = [] if out is None else out
    if isinstance(value, dict):
        if in_collection and any(k in value for k in D.STATEMENT_KEYS):
            out.append(value)
        else:
            for name, child in value.items():
                records(child, name.casefold() in D.COLLECTIONS, out)
    elif isinstance(value, list):
        for child in value:
            records(child, in_collection, out)
    return out


@settings(max_examples=300, deadline=None)
@given(values, st.sampled_from([None, 2]))
def test_nodes_equal_a_recursive_walk(value, indent):
    text = json.dumps(value, indent=indent, ensure_ascii=indent is None)
    found = [(n.path, n.key, n.inside, json.loads(text[n.start : n.end])) for n in D.nodes_of(text, D.Find())]
    assert repr(found) == repr(plain(value))
    find = D.Find(kinds=("OBJECT",), inside=D.COLLECTIONS, any_member=D.STATEMENT_KEYS, folded=True, closed=True)
    assert repr([json.loads(text[n.start : n.end]) for n in D.nodes_of(text, find)]) == repr(records(value))


def test_texts_without_nodes():
    for text in ("", "{", "[1,]", '{"a": NaN}', '{"a":1,"a":2}', '"text"', "7", "{} {}", "nul"):
        assert D.nodes_of(text, D.Find()) == []


def deep(levels):
    inner = {"evidence": [{"title": "lowest", "confidence": 0.75}]}
    for k in range(levels):
        inner = [inner] if k % 2 else {f"level{k}": inner, "note": "[{\\\"evidence\\\"}]"}
    return json.dumps(inner)


def test_depth_200_and_long_documents(spark):
    many = json.dumps({"findings": [{"statement": f"found {i}", "id": str(i)} for i in range(20_000)]})
    docs = spark.createDataFrame([(1, "hiring", deep(200)), (2, "strategy", many), (3, "hiring", None), (4, "hiring", "{broken"), (5, "hiring", deep(3))], "doc long, agent string, body string").repartition(2)
    found = D.extract_evidence(docs, ["doc"], "body")
    assert {(r.doc, r.n) for r in found.groupBy("doc").count().withColumnRenamed("count", "n").collect()} == {(1, 1), (2, 20_000), (5, 1)}
    assert [(r.statement, r.confidence) for r in found.filter("doc = 1").collect()] == [("lowest", 0.75)]
    assert [r.evidence_id for r in found.filter("doc = 2").orderBy("path").limit(3).collect()] == ["0", "1", "2"]
    plan = found._jdf.queryExecution().toString()
    assert "Union" not in plan and "Generate" not in plan
