"""Sampled segmentations over the piece lattice of a SentencePiece vocabulary, and their decoding.

Forward filtering sums the weights of all segmentations up to every position; backward sampling then
draws pieces from the end. No piece reaches from a visible character over a following space, over a
line break or from a letter to a punctuation mark, so the lattice falls apart into chunks, which are filtered once per worker and text form and
sampled independently; that is the same distribution as over the whole text. The vocabulary ranks its
pieces; a piece weighs 1 / (rank + ``SHIFT``) ** ``SHARPNESS``. Characters without a piece become bytes.

Random numbers are a hash of the seed, the row key, the chunk's place and the position, so a row has the
same segmentation in any partitioning, on any retry.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalloom.llm.common import claim_cache, crc_of
from signalloom.llm.tokens import slices

SHIFT = 10.0
SHARPNESS = 1.0
CACHE_CHUNKS = 200_000
FILTERED = 16_000  # chunks whose edges are held side by side
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHUNK = re.compile(rf" *[{_LETTER}]+(?=[.,;:!?])| *[^ \n]+| +|\n")
_LATTICES: dict[tuple, "Lattice"] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The vocabulary: text and log weight of every ordinary piece, ids of the byte pieces, bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weight: dict[str, tuple[int, float]] = {}
        self.byte_ids, self.bytes_of = [0] * 256, []
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i).replace("▁", " ")
            raw = b""
            if model.is_byte(i):
                raw = bytes([int(text[3:5], 16)])
                self.byte_ids[raw[0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = text.encode()
                self.weight[text] = i, -SHARPNESS * math.log(SHIFT + abs(model.get_score(i)))
            self.bytes_of.append(raw)
        self.longest = max(map(len, self.weight))
        if any(re.search(rf"[^ ] |\n|[{_LETTER}][.,;:!?]", t) for t in self.weight):
            raise ValueError("a piece reaches over a chunk's end")
        self.byte_weight = -SHARPNESS * math.log(SHIFT + len(self.bytes_of))


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.size = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        while len(self.held) < self.size + len(values):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.size]


class _Codes(dict):
    """Numbers chunks as they are met and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self)
        self.new.append(chunk)
        return code


class Lattice:
    """Filtered chunks of one worker. A node is a position in a chunk; its edges are the pieces that end there.

    New chunks are filtered together, position by position: an automaton finds all their pieces in one scan, and
    the sums over the pieces that end at a position are taken for all chunks that reach it at once.
    """

    def __init__(self, path: str):
        import ahocorasick

        self.pieces = Pieces(path)
        self.automaton = ahocorasick.Automaton()
        for text, (i, _) in self.pieces.weight.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        count = len(self.pieces.bytes_of)
        self.piece_size, self.piece_weight = np.zeros(count, np.int32), np.zeros(count)
        self.own_piece = np.zeros(0x110000, bool)  # characters that are pieces themselves
        for text, (i, weight) in self.pieces.weight.items():
            self.piece_size[i], self.piece_weight[i] = len(text), weight
            if len(text) == 1:
                self.own_piece[ord(text)] = True
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.last_node, self.size = Grown(np.int64), Grown(np.int32)  # by chunk
        self.first_edge = Grown(np.int64)  # by node; the edges of a node lie together
        self.draw, self.back, self.unit = Grown(np.float64), Grown(np.int32), Grown(np.int32)  # by edge: chance so far, length, unit
        self.units: list[list[int]] = []  # characters spelled in bytes, numbered after the pieces
        self.fallback: dict[int, int] = {}

    def _unit(self, char: int) -> int:
        if char not in self.fallback:
            self.fallback[char] = len(self.pieces.bytes_of) + len(self.units)
            self.units.append([self.pieces.byte_ids[b] for b in chr(char).encode()])
        return self.fallback[char]

    def _filter(self, chunks: list[str]) -> None:
        """Forward sums of new chunks; every node keeps the cumulated chances of its incoming pieces."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        line = "".join(chunks)
        chunk_start = np.cumsum(sizes) - sizes
        chars = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(chunks)), sizes)
        end, unit = np.fromiter(chain.from_iterable(self.automaton.iter(line)), np.int64).reshape(-1, 2).T
        back, weight = self.piece_size[unit].astype(np.int64), self.piece_weight[unit]
        inside = end - back + 1 >= chunk_start[owner[end]]  # the rest reaches over from the chunk before
        spelled = np.flatnonzero(~self.own_piece[chars])
        own = np.fromiter((self._unit(c) for c in chars[spelled].tolist()), np.int64, len(spelled))
        width = np.array([len(u) for u in self.units], np.int64)[own - len(self.pieces.bytes_of)] if len(own) else own
        end = np.concatenate([end[inside], spelled])
        back = np.concatenate([back[inside], np.ones(len(spelled), np.int64)])
        unit = np.concatenate([unit[inside], own])
        weight = np.concatenate([weight[inside], self.pieces.byte_weight * width])
        order = np.lexsort((back, end))
        end, back, unit, weight = end[order], back[order], unit[order], weight[order]
        total = np.zeros(len(line) + 1)  # by character; a chunk's begin counts 0
        level = end - chunk_start[owner[end]]
        draw = np.zeros(len(end))
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2))
        for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
            edges = by_level[low:high]
            at = end[edges]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            before = np.where(back[edges] > k, 0.0, total[at - back[edges]])
            value = before + weight[edges]
            node = np.cumsum(np.concatenate([[False], at[1:] != at[:-1]]))
            top = np.maximum.reduceat(value, starts)
            share = np.exp(value - top[node])
            whole = np.add.reduceat(share, starts)
            total[at[starts]] = top + np.log(whole)
            running = np.cumsum(share)
            running -= np.concatenate([[0.0], running[starts[1:] - 1]])[node]
            draw[edges] = running / whole[node]
        draw[np.concatenate([end[1:] != end[:-1], [True]])] = 1.0
        nodes, edges = self.first_edge.size, self.draw.size
        self.first_edge.extend(edges + np.searchsorted(end, np.arange(len(line))))
        self.draw.extend(draw)
        self.back.extend(back.astype(np.int32))
        self.unit.extend(unit.astype(np.int32))
        self.last_node.extend(nodes + chunk_start + sizes - 1)
        self.size.extend(sizes.astype(np.int32))

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids start."""
        if len(self.codes) > CACHE_CHUNKS:
            self._reset()
        codes, seq, counts = self.codes, [], []
        for text in texts:
            chunks = _CHUNK.findall(" " + text)
            seq += map(codes.__getitem__, chunks)
            counts.append(len(chunks))
        for a in range(0, len(codes.new), FILTERED):
            self._filter(codes.new[a : a + FILTERED])
        codes.new = []
        if not seq:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        first_edge, draw, back, unit = self.first_edge.all, self.draw.all, self.back.all, self.unit.all
        order = np.array(seq, np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        node, left = self.last_node.all[order], self.size.all[order]
        stream = np.repeat(_mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 2 + 1)), counts)
        place = np.arange(len(order)) - np.repeat(bounds[:-1], counts)
        stream = _mix(stream + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live, steps, drawn = np.arange(len(order)), [], []
        while len(live):
            chance = (_mix(stream + left.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)) * 2.0**-53
            edge = first_edge[node]
            over = np.flatnonzero(draw[edge] <= chance)
            while len(over):
                edge[over] += 1
                over = over[draw[edge[over]] <= chance[over]]
            steps.append(live)
            drawn.append(unit[edge])
            node, left = node - back[edge], left - back[edge]
            on = left > 0
            live, node, left, stream = live[on], node[on], left[on], stream[on]
        chunk_of, units = np.concatenate(steps)[::-1], np.concatenate(drawn)[::-1]
        by = np.argsort(chunk_of, kind="stable")  # within a chunk the last drawn piece comes first
        units, chunk_of = units[by], chunk_of[by]
        pieces = len(self.pieces.bytes_of)
        spelled = np.array([len(u) for u in self.units], np.int64)
        lengths = np.concatenate([np.ones(pieces, np.int64), spelled])
        first = np.concatenate([np.arange(pieces), pieces + np.cumsum(spelled) - spelled])
        table = np.concatenate([np.arange(pieces, dtype=np.uint32), *(np.array(u, np.uint32) for u in self.units)])
        size = lengths[units]
        ends = np.cumsum(size)
        ids = table[np.repeat(first[units] - (ends - size), size) + np.arange(int(ends[-1]))]
        per_chunk = np.bincount(chunk_of, size, len(order)).astype(np.int64)
        stops = np.concatenate([[0], np.cumsum(per_chunk)])
        return ids, stops[bounds]


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of a segmentation, without the space put before it."""
    return b"".join(map(pieces.bytes_of.__getitem__, ids.tolist())).decode()[1:]


def lattice(path: str) -> Lattice:
    key = (path, SHIFT, SHARPNESS)
    claim_cache(key, _LATTICES.clear)
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(path)
    return _LATTICES[key]


def sample_encode(docs: DataFrame, model: str, seed: int = 0) -> DataFrame:
    """``doc_id, text, ids``: a sampled segmentation of the whole text as little-endian 32-bit ids.

    Null text gives null ids; an empty one gives the piece of the leading space. A null ``doc_id`` counts
    as key 0; rows with equal key and text get equal segmentations. An empty table gives no rows. Other
    columns are ignored.
    """

    def work(batches):
        own = lattice(model)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            numbers = np.array([k or 0 for k in keys.to_pylist()], np.int64)
            for a, b in slices([t or "" for t in texts], 1_000_000):
                ids, starts = own.sample([t or "" for t in texts[a:b]], numbers[a:b], seed)
                raw = ids.astype("<u4").tobytes()
                out = [None if t is None else raw[4 * i : 4 * j] for t, i, j in zip(texts[a:b], starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.binary())], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``decoded``, the text the ids stand for, and the digest of the ids."""

    def work(batches):
        pieces = Pieces(model)
        for batch in batches:
            found = [None if raw is None else np.frombuffer(raw, "<u4") for raw in batch.column(2).to_pylist()]
            decoded = [None if ids is None else decode_ids(ids, pieces) for ids in found]
            sizes, crcs = [None if i is None else len(i) for i in found], [None if i is None else crc_of(i) for i in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "text", "ids", "decoded", "n_pieces", "ids_crc32"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(work, "doc_id long, text string, ids binary, decoded string, n_pieces long, ids_crc32 long")
