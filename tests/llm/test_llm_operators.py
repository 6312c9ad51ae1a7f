"""Token files, packing, archives, quality rules, search, sampled pieces, licences and toxicity on small tables."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import tokenizers
from hypothesis import given, settings, strategies as st

from signalloom.llm import huffman, lattice, licenses, packing, pivots, quality, tokens, toxicity, warc
from signalloom.llm.queries import vocabulary

TEXTS = [None, "", " ", "a", "Hello  world, it's  fine.\n\nNew line\ttab", "é ü ñ 漢字 🙂 <|endoftext|>", "word " * 3000, "x" * 5000, "a b", "a b", "tail space ", "   nbsp", "▁literal ▁ mark"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "s", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int, n long").repartition(4)


@functools.cache
def fresh(name):
    """The library's own tokenizer, as it loads."""
    return tokenizers.Tokenizer.from_file(vocabulary(name))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>"]), st.text(alphabet="aZé .,'!?\n\t  #9漢", max_size=12)), max_size=8).map("".join))
def test_chunked_ids_equal_whole_texts(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = tokens.encoder(vocabulary(name))
        ids, starts = enc.encode([text, text], 7)
        want = fresh(name).encode(text, add_special_tokens=False).ids + [7]
        assert ids.tolist() == want * 2 and starts.tolist() == [0, len(want), 2 * len(want)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(4, 12))
def test_code_is_prefix_free_and_round_trips(ids, limit):
    ids = np.array(ids, np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=301), limit)
    used = lengths[lengths > 0].astype(float)
    assert (2.0**-used).sum() <= 1 and used.max(initial=0) <= max(limit, (len(used) - 1).bit_length() if len(used) else 0)
    packed, bits = huffman.pack_bits(ids, huffman.canonical_codes(lengths), lengths)
    starts = np.concatenate([[0], np.cumsum(bits)])[: len(ids) : 5]
    counts = np.array([len(ids[a : a + 5]) for a in range(0, len(ids), 5)], np.int64)
    assert huffman.unpack_lanes(packed, starts, counts, huffman.decoding_table(lengths)).tolist() == ids.tolist()


def test_token_files_equal_plain_encoding(spark, docs):
    enc = fresh("byte_bpe_50k.json")
    found = {r.doc_id: tuple(r)[1:] for r in huffman.token_file_round_trip(docs, vocabulary("byte_bpe_50k.json"), 0).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = np.array(enc.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert found[3 * i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert huffman.token_file_round_trip(docs.limit(0), vocabulary("byte_bpe_50k.json"), 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_fill_is_the_closest_reachable_sum(counts, room):
    chosen = packing.best_fill(room, {k: n for k, n in counts.items() if k <= room})
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1)}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[k] for k, n in chosen.items())


def test_packing_places_every_id_once(spark, docs):
    enc = fresh("word_bpe_49k.json")
    rows = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 2, capacity=64).collect()
    want = {3 * i: enc.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(TEXTS)}
    covered, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length <= 64 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        covered[r.doc_id] += range(r.start, r.start + r.length)
        filled[r.sequence_id] += range(r.offset, r.offset + r.length)
    assert {k: sorted(v) for k, v in covered.items()} == {k: list(range(len(v))) for k, v in want.items()}
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 64 for v in filled.values())
    lists = spark.createDataFrame(list(want.items()), "doc_id long, ids array<int>")
    whole = packing.sequences(spark.createDataFrame(rows), lists).collect()
    assert sum(len(r.ids) for r in whole) == sum(map(len, want.values()))


def test_packing_pads_little(spark):
    """Padding of short pieces is a sequence or two; where nothing fits beside a piece, the window stays bounded."""
    rng = random.Random(3)
    pieces = [(i, 0, rng.randint(1, 3000), 0, 9) for i in range(9_000)]
    frame = spark.createDataFrame(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").coalesce(1)
    used = packing.pack_pieces(frame).groupBy("sequence_id").agg({"length": "sum"}).collect()
    total = sum(p[2] for p in pieces)
    assert len(used) <= total / 4096 * 1.01 + 2 and max(r[1] for r in used) <= 4096
    packer = packing._Packer(4096, 0, False)
    for i in range(3 * packing.WINDOW):
        packer.add((i, 0, 3000, 0, 3000))
    assert len(packer.waiting) <= packing.WINDOW and len(packer.out) >= 2 * packing.WINDOW - packing.WINDOW // 2
    packer.pack(last=True)
    assert sorted(p[0] for p in packer.out) == list(range(3 * packing.WINDOW)) and len({p[5] for p in packer.out}) == len(packer.out)


def test_archives_keep_rows_that_share_an_identifier(spark):
    a, b, c = "a" * 1200, "b" * 1500, "c" * 1100
    rows = [(1, a), (1, b), (1, "tiny"), (9, a), (9, a), (None, a), (None, c), (None, c), (None, None), (4, c)]
    pages = spark.createDataFrame([(k, "u", h, 0, "x") for k, h in rows], "page_id long, url string, html string, size int, _page string").repartition(3)
    found = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    assert found == Counter({(1, 1200, "revisit", 9): 1, (1, 1500, "response", None): 1, (1, 4, "response", None): 1, (9, 1200, "response", None): 2, (None, 1200, "revisit", 9): 1, (None, 1100, "revisit", 4): 2, (None, 0, "response", None): 1, (4, 1100, "response", None): 1})


def test_archives_round_trip(spark):
    big, other = "<p>é</p>" * 300, "y" * 1000
    rows = [(1, "http://a b/", big), (2, None, big), (9, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", other), (8, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    found = {r.page_id: tuple(r)[1:] for r in warc.archive_round_trip(pages).collect()}
    assert len(found) == 10 and found[None][2:] == ("revisit", 9)
    for page, _, html in rows[:-1]:
        raw = (html or "").encode()
        revisit = page in (1, 2)
        assert found[page] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_one_record_by_its_index(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 9000) for k in range(12)], "page_id long, url string, html string").coalesce(2)
    index = warc.write_archives(pages, str(tmp_path)).collect()
    row = next(r for r in index if r.page_id == 7)
    headers, payload = warc.read_record(row)
    assert headers["WARC-Record-ID"] == "<urn:page:7>" and payload.decode() == "page 7 " * 9000 and max(r.frame for r in index) > 0


def test_quality_counts(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(400))
    texts = [None, "", "one two", "a b c d e f " * 30, prose, prose + "\n" + "same line\n" * 3, "# $ % & | < >" * 3, "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJK+/") + " " * (rng.random() < 0.1) for _ in range(6000)), " nb sp \x1c x" * 5]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ratio int")
    for r in quality.quality(docs).collect():
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = Counter(windows)
        cover = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r.kept or not r.base_failed)
        assert r.kept == (r.doc_id in (4, 5))
    assert quality.keep_good(docs).columns == docs.columns


@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_long_clean_texts_lie_inside_the_bands(lang):
    import zstandard

    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    good = {r["doc_id"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["quality"] == 1}
    words = [w for r in rows if r["lang"] == lang and r["doc_id"] in good for w in (r["text"] or "").split()]
    packer, rng = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(7)
    for size in (20_000, 70_000, 140_000, 262_000, 300_000, 1_000_000, 2_500_000, 5_000_000):
        text = " ".join(rng.choices(words, k=size // 4)).encode()[:size]
        assert quality.band_verdict(text, packer)[2] == "inside", size
        copied = text[: size * 6 // 10] + text[: size - size * 6 // 10]
        assert size > 2_000_000 or quality.band_verdict(copied, packer)[2] == "repetitive", size


def test_short_texts_get_a_verdict():
    import zstandard

    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    for text in ("12 years in Rome, 3 years in Oslo, 4 years in Turin", "to be or not to be that is the question whether tis nobler", "it was the best of times, it was the worst of times, it was the age of wisdom", "You can fool all the people some of the time, and some of the people all the time, but you cannot fool all the people all the time."):
        assert quality.band_verdict(text.encode(), packer)[2] == "inside"
    assert all(quality.band_verdict(b"ab " * n, packer)[2] == "repetitive" for n in (12, 20, 40, 80))
    assert quality.band_verdict(random.Random(1).randbytes(200), packer)[2] == "incompressible" and quality.band_verdict(b"", packer) == (None, None, "empty")


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(90, 8)).astype(float)
    vectors = [base[i % 90].tolist() for i in range(260)] + [None, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, rank int").repartition(5)
    found = defaultdict(list)
    for r in pivots.top_k(frame, 5, 50).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in enumerate(vectors[:260])}
    for q in range(0, 260, 50):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert found[q] == [(i, -s) for s, i in scored]
    assert set(found) == set(range(0, 260, 50)) and pivots.top_k(frame.limit(0)).count() == 0


def test_search_keeps_lengths_apart(spark):
    rng = np.random.default_rng(4)
    vectors = [[], [1.0]] + [rng.normal(size=6).tolist() for _ in range(60)] + [rng.normal(size=3).tolist() for _ in range(50)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(50, vectors[20]), (100, vectors[7][:3]), (3, vectors[3])]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], "vec_id long, embedding array<double>, width int, chunk int").repartition(4)
    found = defaultdict(list)
    for r in pivots.top_k(frame, 5, 50).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    whole = [(i, np.floor(256 * np.array(v)).astype(int).tolist()) for i, v in rows if v]
    for q in (50, 100):
        _, own = min((len(v), v) for i, v in whole if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q and len(v) == len(own))[:5]
        assert found[q] == [(i, -s) for s, i in scored]
    assert set(found) == {50, 100}


def test_sampled_pieces(spark, docs):
    model = vocabulary("piece_bpe_32k.model")
    encoded = lattice.sample_encode(docs, model, seed=4)
    rows = {r.doc_id: r for r in lattice.decode(encoded, model).collect()}
    assert all(rows[3 * i].decoded == t for i, t in enumerate(TEXTS))
    again = {r.doc_id: r.ids for r in lattice.sample_encode(docs.repartition(2), model, seed=4).collect()}
    assert all(rows[k].ids == again[k] for k in rows)
    assert any(rows[k].ids != r for k, r in ((r.doc_id, r.ids) for r in lattice.sample_encode(docs, model, seed=5).collect()))


def test_sampling_follows_the_weights():
    own = lattice.Lattice(vocabulary("piece_bpe_32k.model"))
    ids, starts = own.sample(["the"] * 20_000, np.arange(20_000), 1)
    drawn = Counter(tuple(ids[a:b].tolist()) for a, b in zip(starts, starts[1:]))
    weight, chunk = own.pieces.weight, " the"

    def every(at):
        if at == len(chunk):
            yield (), 0.0
        for end in range(at + 1, len(chunk) + 1):
            if chunk[at:end] in weight:
                piece, w = weight[chunk[at:end]]
                for rest, more in every(end):
                    yield (piece, *rest), w + more

    paths = dict(every(0))
    total = sum(np.exp(w) for w in paths.values())
    for path, w in paths.items():
        assert abs(drawn[path] / 20_000 - np.exp(w) / total) < 0.02


def test_licence_blocks(spark):
    texts = ["text\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "We have a license to thrill nobody in this plain sentence about cats and dogs.", None, "", "nothing", "Licensed under CC BY-NC 4.0."]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(found) == {0, 1, 2, 6}
    assert (found[0].license, found[0].confirmed, found[0].block_start) == ("MIT", True, 5)
    assert (found[1].license, found[1].confirmed) == ("Apache-2.0", True) and not found[2].confirmed and found[6].license == "CC-BY-NC-4.0"


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    vocabulary_ = [word() for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = [rng.choice(vocabulary_) for _ in range(40)] + ([rng.choice(["grobian", "lump"]) for _ in range(3)] if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en" if i % 2 else "de", 1.0))
        if i < 500:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(None, None, None, 1.0), (9999, "", "en", 1.0)], "doc_id long, text string, lang string, toxic double")
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r.kept for r in toxicity.toxicity(docs, labelled).collect()}
    assert sum(found[i] == (i % 5 != 0) for i in range(500, 900)) >= 0.97 * 400 and found[None] and found[9999]
    assert toxicity.keep_clean(docs, labelled).columns == docs.columns
    assert toxicity.toxicity(docs, labelled.limit(0)).filter("NOT kept").count() == 0
