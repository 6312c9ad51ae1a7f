"""Packing of token sequences by minimum bin slack.

A document's full windows of ``capacity`` ids are sequences of their own; only its remainder is packed.
Each task gathers the remainders of up to ``WINDOW`` documents as counts per length; when it is full, at most
half of it, the pieces of the sequences with most slack, waits for the next ones. For every sequence
it takes the longest remainder and asks a bitset of reachable sums for the multiset of the other lengths
that leaves the least slack; the bitsets are walked back to counts, and the multiset is used as often as
the counts allow. Nothing is shuffled. Sequences that end with slack give their pieces to a second round
over ``FAN_IN`` times fewer tasks, so that the padding left is a few sequences per ``FAN_IN`` tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from signalloom.llm.common import crc_of, stage
from signalloom.llm.tokens import encoder, slices

CAPACITY = 4096
WINDOW = 20_000
FAN_IN = 64
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def best_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of the available lengths whose sum comes closest to ``room`` from below.

    Bit s of a bitset says that sum s can be reached; a length with count c enters in powers of two of
    copies. The search ends as soon as the room is filled exactly.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + copies
            at -= length * copies
    return chosen


def fill_windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Patterns (length to count) and how many sequences each fills, until no length is left."""
    counts = dict(counts)
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        rest = {k: n for k, n in counts.items() if n and k <= capacity - seed}
        counts[seed] += 1
        pattern = best_fill(capacity - seed, rest)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield pattern, times


class _Packer:
    """Places pieces of one task; ``sequence_id`` starts from a number no other task uses."""

    def __init__(self, capacity: int, first_id: int, keep_open: bool):
        self.capacity, self.next, self.keep_open = capacity, first_id, keep_open
        self.waiting: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, piece: tuple) -> None:
        if piece[2] == self.capacity:
            self.out.append((*piece, self.next, 0))
            self.next += 1
        else:
            self.waiting.append(piece)
            if len(self.waiting) >= WINDOW:
                self.pack(last=False)

    def pack(self, last: bool) -> None:
        by_length: dict[int, list] = defaultdict(list)
        for piece in sorted(self.waiting, key=lambda p: (p[0] is None, p[0], p[1]), reverse=True):
            by_length[piece[2]].append(piece)
        self.waiting = []
        inexact = []
        for pattern, times in fill_windows({k: len(v) for k, v in by_length.items()}, self.capacity):
            slack = self.capacity - sum(k * n for k, n in pattern.items())
            for _ in range(times):
                pieces = [by_length[k].pop() for k in sorted(pattern, reverse=True) for _ in range(pattern[k])]
                if slack:
                    inexact.append((slack, len(inexact), pieces))
                else:
                    self._place(pieces)
        room = 0 if last else WINDOW // 2
        for _, _, pieces in sorted(inexact, reverse=True):  # most slack first: it waits for more pieces
            if len(self.waiting) + len(pieces) <= room:
                self.waiting += pieces
            elif self.keep_open:
                self.out += [(*piece, None, None) for piece in pieces]
            else:
                self._place(pieces)

    def _place(self, pieces: list[tuple]) -> None:
        at = 0
        for piece in pieces:
            self.out.append((*piece, self.next, at))
            at += piece[2]
        self.next += 1

    def flush(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], _COLUMNS)


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, round_: int = 0, keep_open: bool = False) -> DataFrame:
    """Places pieces (``doc_id, start, length, ids_crc32, doc_tokens``) of at most ``capacity`` ids."""

    def work(batches):
        packer = _Packer(capacity, (round_ << 58) + (TaskContext.get().partitionId() << 34), keep_open)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(row)
            if len(packer.out) > 50_000:
                yield packer.flush()
        packer.pack(last=True)
        yield packer.flush()

    return pieces.select(*_COLUMNS[:5]).mapInArrow(work, _SCHEMA)


def document_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Ids of whole texts plus ``end_id``, cut every ``capacity`` ids; null text counts as empty."""

    def work(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids, starts = enc.encode(texts[a:b], end_id)
                rows = []
                for i in range(b - a):
                    first, last = int(starts[i]), int(starts[i + 1])
                    for at in range(first, last, capacity):
                        stop = min(at + capacity, last)
                        rows.append((keys[a + i], at - first, stop - at, crc_of(ids[at:stop]), last - first))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], _COLUMNS[:5])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and offset.

    Null or empty text: one piece with the end id. Null or repeated ``doc_id``: every row is packed as a
    document of its own. An empty table gives no rows. Other columns are ignored.
    """
    first = stage(pack_pieces(document_pieces(docs, vocabulary, end_id, capacity), capacity, keep_open=True), "packed")
    open_ = first.filter("sequence_id IS NULL")
    second = pack_pieces(open_.coalesce(max(1, open_.rdd.getNumPartitions() // FAN_IN)), capacity, round_=1)
    return first.filter("sequence_id IS NOT NULL").unionByName(second)


def padded_length(filled: int, capacity: int = CAPACITY) -> int:
    """Length a sequence is stored with: its own at a power of two, else the capacity."""
    return filled if filled & (filled - 1) == 0 else capacity


def sequences(pieces: DataFrame, token_rows: DataFrame) -> DataFrame:
    """The ids of every sequence: ``sequence_id`` and ``ids``, from pieces and ``doc_id, ids`` arrays."""
    cut = pieces.join(token_rows.select("doc_id", F.col("ids").alias("_ids")), "doc_id")
    part = cut.select("sequence_id", "offset", F.slice("_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("part"))
    listed = part.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return listed.select("sequence_id", F.flatten(F.col("parts.part")).alias("ids"))
