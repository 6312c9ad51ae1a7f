"""Merged suffix orders and passage removal against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from signalloom.llm import suffixes as S


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", max_size=20)), min_size=1, max_size=40), st.integers(1, 5))
def test_merged_order_equals_one_sort(rows, parts):
    width = 20
    matrix = np.array([list(t.encode().ljust(width, b"\0")) for _, t in rows], np.uint8).reshape(len(rows), width)
    keys = np.array([[k, 7] for k, _ in rows], np.uint64)
    columns = np.column_stack([keys, S._symbols(matrix)])
    shards = [np.arange(len(rows))[p::parts] for p in range(parts)]
    order = S.merged_order(columns, [s for s in shards if len(s)])
    listed = [(rows[i][0], matrix[i].tobytes()) for i in order.rows]
    assert listed == sorted(listed)
    for (k, a), (m, b), shared in zip(listed, listed[1:], order.prefix[1:]):
        want = -1 if k != m else next((n for n in range(width) if a[n] != b[n]), 24)
        assert shared == want


def brute(texts, length=S.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_removal_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, other = word(420), word(230)
    texts = [
        None, "", "short", word(3000), passage, passage, word(150) + passage[:250] + word(90), passage[37:260] + word(400), word(20) + passage[100:301],
        "a" * 900, "ab" * 400, word(99) + other + word(50) + other, passage[:199], passage[:200], word(5000) + passage + word(10) + passage[5:300], "\U0001d400" * 120,
    ]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, passage, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, at int").repartition(5)
    found = {r.doc_id: tuple(r)[1:] for r in S.digests(docs).collect()}
    want = brute([t for _, t, *_ in rows])
    assert [found[i] for i in range(len(texts))] + [found[None]] == want


def test_rows_that_share_an_identifier(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, alone = word(260), word(700)
    texts = [passage + word(90), alone, word(80) + passage, word(300), word(240), passage[:230] + word(20)]
    rows = [(k, t, "x") for k, t in zip([1, 1, 2, None, None, None], texts)] + [(7, word(400), "y")] * 2
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, _text string, _spans int, _cut int, row int, mark int").repartition(4)
    assert sorted(map(repr, (tuple(r) for r in S.digests(docs).collect()))) == sorted(repr((k[0], *w)) for k, w in zip(rows, brute([r[1] for r in rows])))
    out = S.without_repeats(docs)
    assert out.columns == docs.columns and {r.text for r in out.collect() if r.doc_id == 7} == {""} and alone in {r.text for r in out.collect()}


def test_keys_above_the_bound_are_counted(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(260)
    texts = [word(80) + passage + word(60) for _ in range(40)] + [word(5) + passage + word(9), passage[30:240], "a" * 500, "ab" * 300]
    texts += [texts[0][40:380], "c" + texts[1][10:300], texts[2][3:] + "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes = []
    pieces = [pa.record_batch([pa.array(c) for c in zip(*[(g, i, 1, "R", 5, b"", b"") for i, g in enumerate(grams)])], list("abcdefg")) for grams in ([1, 1, 1, 2], [2, 2, 3], [3, 3, 4, 4, 5])]
    for held in S._whole_keys(iter(pieces), 4):
        sizes.append([g for p in held for g in p[0]])
    assert sum(sizes, []) == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5] and all(a[-1] != b[0] for a, b in zip(sizes, sizes[1:])) and max(map(len, sizes)) <= 8
    for bound in (1, 10, 20_000):
        monkeypatch.setattr(S, "BOUND", bound)
        assert [tuple(r)[1:] for r in S.digests(docs).orderBy("doc_id").collect()] == brute(texts), bound


def test_without_repeats_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x" * 300 + "é", "en", "s", 301), (2, None, "en", "s", 0), (3, "plain", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in S.without_repeats(docs).collect()}
    assert S.without_repeats(docs).columns == docs.columns
    assert (out[1].text, out[1].n_chars) == ("é", 1) and out[2].text is None and out[3].text == "plain"
    assert S.digests(docs.limit(0)).count() == 0
