"""Token ids of whole texts by the tokenizers library, with a bounded per-worker cache of text chunks.

The two byte-pair vocabularies never let a token reach over a single space between two visible
characters of the range ``!``-``~`` or U+00A1-U+024F, nor from a letter to punctuation other than the
apostrophe, so a text may be cut there and every chunk encoded on its own.
Chunks recur; a worker keeps the ids of up to ``CACHE_CHUNKS`` of them and starts anew beyond that.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from signalloom.llm.common import claim_cache

CACHE_CHUNKS = 600_000
_VISIBLE = "[!-~¡-ɏ]"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_MARK = "[.,;:!?#$%&*]"
_CUT = f"(?= {_VISIBLE}|\\Z)"
_CHUNK = re.compile(f" ?{_LETTER}+(?= {_VISIBLE}|{_MARK}|\\Z)| ?{_MARK}+{_CUT}| ?{_VISIBLE}+{_CUT}|.+?{_VISIBLE}(?= {_VISIBLE})|.+", re.S)
_ENCODERS: dict[str, "ChunkEncoder"] = {}


def chunks_of(text: str) -> list[str]:
    """The text cut where no token can reach over; joined they give the text again."""
    return _CHUNK.findall(text)


class _Codes(dict):
    """Numbers chunks as they are met and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self)
        self.new.append(chunk)
        return code


class ChunkEncoder:
    """Ids of texts; equal to encoding each text whole with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[c] is where the ids of code c - 1 end

    def _learn(self, new: list[str], first: int) -> None:
        fresh = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        ends = self.ends[first] + np.cumsum([len(x) for x in fresh])
        while len(self.ends) <= first + len(new):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.ends[first] : ends[-1]] = np.fromiter(chain.from_iterable(fresh), np.uint32, int(ends[-1] - self.ends[first]))
        self.ends[first + 1 : first + 1 + len(new)] = ends

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and where each text's ids start (one more entry than texts)."""
        if len(self.codes) > CACHE_CHUNKS:
            self._reset()
        codes, seq, counts = self.codes, [], []
        known = len(codes)
        for text in texts:
            chunks = chunks_of(text)
            seq += map(codes.__getitem__, chunks)
            counts.append(len(chunks))
        if codes.new:
            self._learn(codes.new, known)
            codes.new = []
        order = np.array(seq, np.int64)
        starts = self.ends[order]
        lengths = self.ends[order + 1] - starts
        tail = 0 if end_id is None else 1
        stops = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        offsets = stops[bounds] + tail * np.arange(len(texts) + 1)
        total = int(stops[-1])
        ids = self.flat[np.repeat(starts - stops[:-1], lengths) + np.arange(total)]
        if tail:
            out = np.full(int(offsets[-1]), end_id, np.uint32)
            keep = np.ones(len(out), bool)
            keep[offsets[1:] - 1] = False
            out[keep] = ids
            ids = out
        return ids, offsets


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; the file must lie on every executor."""
    claim_cache(path, _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def slices(texts: list[str], limit: int = 4_000_000):
    """Runs of the list with about ``limit`` characters each, so that memory does not follow the batch."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
