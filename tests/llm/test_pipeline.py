"""The chained pipeline against plain versions of its stages on a small corpus with planted cases."""

import random
import re
from collections import defaultdict

import tokenizers

import corpus_pipeline
from signalloom.llm import suffixes
from signalloom.llm.queries import vocabulary

LENGTH = suffixes.LENGTH


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def without_repeats(texts):
    """Each text without the bytes of 200-byte strings that also start elsewhere; what is left of a cut character goes too."""
    raw, seen = [t.encode() for t in texts], defaultdict(int)
    for b in raw:
        for s in range(len(b) - LENGTH + 1):
            seen[b[s : s + LENGTH]] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - LENGTH + 1):
            if seen[b[s : s + LENGTH]] > 1:
                gone[s : s + LENGTH] = b"\1" * LENGTH
        out.append(bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(11)
    names = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(names) for _ in range(n))
    passage = prose(60)
    clean = {i: prose(450) for i in range(160)}
    clean[5] += " é " + passage
    clean[6] = passage + " " + clean[6]
    clean[None] = " ".join(rng.sample(clean[9].split(), 450))  # the words of a labelled text
    toxic = {200 + i: prose(220) + " grobian lump " + prose(220) + " lump grobian" for i in range(90)}
    poor = {300: "too few words", 301: None, 302: "", 303: "the same five words again " * 40}
    near = {400: clean[1] + " " + " ".join(rng.choice(names) for _ in range(30)), 401: clean[2], 402: clean[2].upper()}
    rows = [(k, t, "en" if (k or 0) % 2 else "de", "s", len(t or "")) for part in (clean, toxic, poor, near) for k, t in part.items()] + [(7, clean[7], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(160)] + [(k, 0, 1) for k in range(200, 290)]  # held-out rows are the business of the toxicity test
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # 1 and 400, 2 and 401 and 402 are near duplicates by the plain measure, 5 and 6 are not; the repeated row 7 is one document
    share = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert share(clean[1], near[400]) >= 0.75 and share(clean[2], near[402]) == 1 and share(clean[5], clean[6]) < 0.75
    keys = list(clean)
    want = dict(zip(keys, without_repeats([clean[k] for k in keys])))
    assert passage not in want[5] and len(want[8]) == len(clean[8])

    own = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for k, parts in pieces.items():
        tokens = len(own.encode(want[k], add_special_tokens=False).ids) + 1
        at = 0
        for start, length, total in sorted(parts):
            assert start == at and total == tokens
            at += length
        assert at == tokens
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
