"""Near-duplicate components against all-pairs comparison."""

import random

import numpy as np

from signalloom.llm import hyperminhash as H
from signalloom.llm.graph import components


def brute(rows):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


def corpus():
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " \t", "one two", "ONE two", "one  two\nthree", "É a b c d e", "é a b c d e"]
    for size in (12, 40, 150, 600):
        base = words(size)
        for k in range(24):  # edits that drift: chains of links, some pairs just under the threshold
            other = list(base)
            for _ in range(1 + k * size // 500):
                other[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
            if k % 6 == 0:
                base = other
        texts += [" ".join(base)] * 5
    passage = words(60)
    texts += [" ".join(passage + words(30)) for _ in range(40)] + [" ".join(words(80)) for _ in range(40)]
    texts.append(" ".join(words(20_000)))
    return list(enumerate(texts))


def test_components_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in rows] + [(None, "one two", "a", 1)], "doc_id long, text string, node string, n int").repartition(6)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(docs).collect()}
    assert found.pop(None) == (1, None, True)
    assert found == brute(rows)
    assert H.one_per_group(docs).columns == docs.columns
    assert H.near_duplicates(docs.limit(0)).count() == 0


def test_prefix_of_exactly_three_quarters_is_linked(spark):
    rows = [t for n, m, base in ((8, 7, 0), (44, 34, 10), (404, 304, 20)) for t in ((base, " ".join(f"{base}w{k}" for k in range(n))), (base + 1, " ".join(f"{base}w{k}" for k in range(m))))]
    rows += [(base + 2, text.replace("w", "v")) for base, text in rows[:5:2]] + [(base + 1, text.replace("w", "v")) for base, text in rows[1::2]]  # the shorter or the longer one first
    rows = [(k, text) for k, (_, text) in enumerate(rows)]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows) and sum(r[2] for r in found.values()) == 6


def test_hot_buckets_are_dealt_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP", 50)
    rng = random.Random(4)
    sizes = {k: rng.choice((3, 4, 30, 40, 41, 53, 54)) for k in range(1, 901)}
    buckets = spark.createDataFrame([(7, k, n, 901, 0) for k, n in sizes.items()], "key long, node long, n long, size long, u long")
    cells = {}
    for r in H._dealt(buckets, spark.createDataFrame([], "node long, component long")).collect():
        cells.setdefault((r.key, r.cell), ([], []))[r.lone].append(r.node)
    assert max(len(side) for cell in cells.values() for side in cell) <= 2 * H.GROUP
    met = {(a, b) for others, lone in cells.values() for a in lone for b in others}
    close = {(a, b) for a in sizes for b in sizes if a != 900 and 100 * min(sizes[a], sizes[b]) >= H.PERCENT * max(sizes[a], sizes[b])}
    assert close <= met and not any(max(sizes[a], sizes[b]) > 5 * min(sizes[a], sizes[b]) for a, b in met)


def test_components_with_dealt_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP", 6)
    rows = corpus()
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows)


def test_one_row_of_each_group(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (1, "a b c", "x"), (2, "a b c", "y"), (3, "d e f", "x"), (3, "d e f", "x"), (4, None, "x"), (4, None, "y"), (5, "g", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = sorted((r.doc_id or 0, r.text or "") for r in H.one_per_group(docs).collect())
    assert found == [(0, "a b c"), (0, "a b c"), (1, "a b c"), (3, "d e f"), (4, ""), (5, "g")]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.9):
        estimates = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2))
            both = int(len(pool) * share)
            rest = (len(pool) - both) // 2
            a, b = np.sort(pool[np.r_[0:both, both : both + rest]]), np.sort(pool[np.r_[0:both, both + rest : len(pool)]])
            pool = rng.permutation(pool)
            a, b = np.sort(np.concatenate([pool[:both], pool[both : both + rest]])), np.sort(np.concatenate([pool[:both], pool[both + rest :]]))
            e, _ = H.similarity(H.registers(a)[None], H.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
            estimates.append(e[0])
        assert abs(np.mean(estimates) - share) < 0.03


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (299, 250), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 160)} == {100} and found[300] == 250


def test_smallest_hashes_keep_every_pair_at_the_threshold():
    rng = np.random.default_rng(8)
    for size in (1, 4, 8, 100, 200, 256, 300, 5000):
        for share in (0.3, 0.75, 0.8, 1.0):
            for _ in range(20):
                pool = rng.permutation(np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)))
                both = -(-int(len(pool) * share * 100) // 100)
                cut = both + (len(pool) - both) // 2
                a, b = np.sort(pool[:cut]), np.sort(np.concatenate([pool[:both], pool[cut:]]))
                if not len(a) or not len(b):
                    continue
                left, right = ((x[: H.LEAST] >> np.uint64(32)).astype(np.uint32) for x in (a, b))
                exact = 100 * both >= H.PERCENT * len(pool)
                table = np.zeros((2, max(len(left), len(right))), np.uint32)
                table[0, : len(right)], table[1, : len(left)] = right, left
                other, same = H._possible(left, len(a), table, np.array([len(right), len(left)]), np.array([len(b), len(a)]))
                assert same and (other or not exact)
                assert not other or share != 0.3 or size < 100
