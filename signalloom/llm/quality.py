"""Quality rules: word and line rules first, then compression bands.

A text that repeats itself compresses too well, random or encoded text too badly. The whole text and its
fixed chunks are compressed with zstandard; each length class has its own lowest and highest ratio of
plain to compressed bytes. Only empty texts carry no verdict of the bands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"  # fixed values of the symbol rule
LEVEL = 3
CHUNK = 4096
#: (from this many bytes on, lowest ratio, highest ratio) of a whole text. The highest ratios lie 2 % above
#: the largest seen among documents labelled good that pass the word rules, the lowest about a sixth under
#: their smallest. From 64 KiB on both come from clean prose of such lengths in each language: good documents
#: strung together and words drawn from them at random. The ratio jumps at 256 KiB, where the compressor changes
#: its tables, and stops growing with its window of 2 MiB, so the last class holds for any length. Below 256
#: bytes the highest lie 5 % and more above, since a frame costs some nine bytes and natural sentences vary;
#: below 128 bytes prose cannot be told from noise, and only repetition counts.
BANDS = (
    (1, 0.0, 1.0), (32, 0.0, 1.1), (64, 0.0, 1.4), (128, 0.98, 1.55), (192, 1.02, 1.65),
    (256, 1.1, 1.78), (512, 1.2, 2.02), (1024, 1.35, 2.15), (2048, 1.5, 2.27), (4096, 1.65, 2.45), (16384, 1.9, 2.58),
    (1 << 16, 1.9, 2.64), (1 << 18, 2.0, 2.75), (1 << 20, 2.0, 2.77),
)
#: Of a full chunk, and the share of a text's full chunks that must lie inside.
CHUNK_BAND = (1.6, 2.33)
MIN_CHUNKS_INSIDE = 0.5



def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    key = codes[:n].copy()
    for k in range(1, width):
        if int(key.max()) > (1 << 62) // (len(known) + 1):  # make room: the keys become ranks
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * (len(known) + 1) + codes[k : k + n]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words are runs without ASCII white space."""
    data = text.encode()
    words = data.split()  # on bytes this splits at space and U+0009-U+000D alone
    lines = [x for x in data.split(b"\n") if x.strip()]
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def chunk_ratios(data: bytes, packer, chunk: int = CHUNK) -> list[float]:
    """Ratios of the full chunks; the rest behind the last of them only counts in the whole text."""
    return [chunk / len(packer.compress(data[a : a + chunk])) for a in range(0, len(data) - chunk + 1, chunk)]


def band_verdict(data: bytes, packer) -> tuple[float | None, float | None, str]:
    """Ratio of the whole text, share of full chunks inside the chunk band, and the verdict."""
    if not data:
        return None, None, "empty"
    low, high = next((lo, hi) for least, lo, hi in reversed(BANDS) if len(data) >= least)
    ratio = len(data) / len(packer.compress(data))
    chunks = chunk_ratios(data, packer)
    inside = sum(CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks) / len(chunks) if chunks else None
    if ratio > high:
        return ratio, inside, "repetitive"
    if ratio < low:
        return ratio, inside, "incompressible"
    if inside is not None and inside < MIN_CHUNKS_INSIDE:
        return ratio, inside, "chunks"
    return ratio, inside, "inside"


_FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "ratio": pa.float64(), "chunks_inside": pa.float64(), "band": pa.string()}


def quality(docs: DataFrame) -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` per row.

    Null or empty text has no words and fails the base rules. Null ``doc_id`` and repeated rows are judged
    like any other. An empty table gives no rows. Other columns are ignored.
    """

    def work(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                rows.append((*base_counts(text), *band_verdict(text.encode(), packer)))
            columns = zip(*rows) if rows else [[] for _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _FIELDS.values()))], ["doc_id", *_FIELDS])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunks_inside double, band string"
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
    out = out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    return out.withColumn("kept", F.expr("NOT base_failed AND band = 'inside'"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with their columns; texts do not move between tasks."""

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)

        def passes(one: str | None) -> bool:
            words, _, _, _, repeats = base_counts(one or "")
            return words >= MIN_WORDS and 100 * repeats <= MAX_REPEAT_PERCENT * words and band_verdict((one or "").encode(), packer)[2] == "inside"

        return text.map(passes)

    return docs.filter(good(F.col("text").cast("string")))
