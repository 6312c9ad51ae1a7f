"""Token-id files in canonical length-limited Huffman code.

Steps: texts become ids (staged once); global counts of the ids, at most one row per vocabulary entry,
give code lengths by package-merge; documents are range-sorted by key and every task writes one file.

File: ``CHT1``, u32 length and deflated code lengths, then block payloads, then a deflated footer and
its u64 position. A block holds ``BLOCK`` ids and needs nothing from other blocks; its checkpoints give
the bits of every ``LANE`` ids, so the lanes of many blocks are decoded side by side from one table.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from signalloom.llm.common import crc_of, new_file, open_store, partitions, scratch, stage
from signalloom.llm.tokens import encoder, slices

MAGIC = b"CHT1"
LANE = 64
BLOCK = 1 << 16
MAX_LENGTH = 18
GROUP = 32  # blocks decoded at a time


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (more only if the alphabet needs it).

    Package-merge: every level joins the leaves, sorted by count, with the pairs of the level below.
    Leaves enter in order, so a level is told by how many of its first items are leaves.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, items = [], leaves
    leaf = np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        items, leaf = both[by], by < len(leaves)
    depth, take = np.zeros(len(leaves), np.int64), 2 * len(leaves) - 2
    for leaf in reversed(levels):
        chosen = int(leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol): each is the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=0))
    width = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
    firsts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(width)[:-1]]) if len(order) else width
    codes[order] = firsts >> (top - lengths[order]).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every bit string of the longest code's length."""
    top = int(lengths.max(initial=0)) or 1
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    repeat = 1 << (top - lengths[order]).astype(np.int64)
    symbols = np.zeros(1 << top, np.uint32)
    sizes = np.ones(1 << top, np.uint8)
    filled = int(repeat.sum())
    symbols[:filled] = np.repeat(order, repeat)
    sizes[:filled] = np.repeat(lengths[order], repeat)
    return symbols, sizes, top


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of the ids one after the other, most significant bit first, and each id's bit count."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if total:
        at = ends - size
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        left = codes[ids] << (64 - size).astype(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[starts]] = np.add.reduceat(left >> shift, starts)
        over = np.flatnonzero((at & 63) + size > 64)
        words[word[over] + 1] += left[over] << (np.uint64(64) - shift[over])
    return words.astype(">u8").tobytes()[: (total + 7) // 8], size


def unpack_lanes(data: bytes, starts: np.ndarray, counts: np.ndarray, table) -> np.ndarray:
    """Ids of lanes that start at the given bits; all lanes take one step at a time."""
    symbols, sizes, top = table
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    longest = int(counts.max(initial=0))
    out = np.zeros((len(starts), longest), np.uint32)
    at = starts.astype(np.int64).copy()
    for step in range(longest):
        if step and step >= counts.min():
            live = np.flatnonzero(counts > step)
            here = at[live]
            key = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - top)
            out[live, step] = symbols[key]
            at[live] = here + sizes[key]
        else:
            key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - top)
            out[:, step] = symbols[key]
            at += sizes[key]
    return out[np.arange(longest) < counts[:, None]] if longest else np.zeros(0, np.uint32)


class TokenFileWriter:
    """Writes documents' ids; memory holds one block and the table of documents."""

    def __init__(self, sink, lengths: np.ndarray):
        self.sink, self.lengths, self.codes = sink, lengths, canonical_codes(lengths)
        header = zlib.compress(lengths.tobytes())
        self.at = self._put(MAGIC + len(header).to_bytes(4, "little") + header)
        self.blocks, self.lanes, self.docs, self.sizes = [], [], [], []
        self.waiting, self.held, self.total = [], 0, 0

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        return len(data)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ready = np.concatenate(self.waiting)
            full = len(ready) // BLOCK * BLOCK
            for first in range(0, full, BLOCK):
                self._block(ready[first : first + BLOCK])
            self.waiting, self.held = [ready[full:]], len(ready) - full

    def _block(self, ids: np.ndarray) -> None:
        payload, bits = pack_bits(ids, self.codes, self.lengths)
        self.lanes.append(np.add.reduceat(bits, np.arange(0, len(bits), LANE)).astype(np.uint16))
        self.blocks.append((self.at, len(ids), len(payload)))
        self.at += self._put(payload)

    def close(self) -> None:
        rest = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        if len(rest):
            self._block(rest)
        parts = [np.array(self.blocks, np.int64).reshape(-1, 3), np.concatenate(self.lanes) if self.lanes else np.zeros(0, np.uint16), np.array(self.sizes, np.int64)]
        names = json.dumps(self.docs).encode()
        buffer = io.BytesIO()
        np.savez(buffer, *parts, np.frombuffer(names, np.uint8))
        self._put(zlib.compress(buffer.getvalue(), 1) + self.at.to_bytes(8, "little"))
        self.sink.close()


class TokenFile:
    """Reads a file from its footer; ``groups`` decodes runs of blocks in order."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        head = self.file.read_at(8, 0)
        if head[:4] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.table = decoding_table(np.frombuffer(zlib.decompress(self.file.read_at(int.from_bytes(head[4:], "little"), 8)), np.uint8))
        at = int.from_bytes(self.file.read_at(8, size - 8), "little")
        with np.load(io.BytesIO(zlib.decompress(self.file.read_at(size - 8 - at, at)))) as parts:
            self.blocks, self.lanes, self.sizes, names = (parts[f"arr_{i}"] for i in range(4))
        self.docs = json.loads(names.tobytes())

    def groups(self, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        """Ids of the blocks from first to last, ``GROUP`` blocks at a time."""
        per_block = (self.blocks[:, 1] + LANE - 1) // LANE
        lane_of = np.concatenate([[0], np.cumsum(per_block)]).astype(np.int64)
        last = len(self.blocks) if last is None else last
        for a in range(first, last, GROUP):
            b = min(a + GROUP, last)
            begin, end = int(self.blocks[a, 0]), int(self.blocks[b - 1, 0] + self.blocks[b - 1, 2])
            starts, counts = [], []
            for k in range(a, b):
                bits = self.lanes[lane_of[k] : lane_of[k + 1]].astype(np.int64)
                starts.append(8 * (int(self.blocks[k, 0]) - begin) + np.concatenate([[0], np.cumsum(bits)[:-1]]))
                n = np.full(len(bits), LANE, np.int64)
                n[-1] = self.blocks[k, 1] - LANE * (len(bits) - 1)
                counts.append(n)
            yield unpack_lanes(self.file.read_at(end - begin, begin), np.concatenate(starts), np.concatenate(counts), self.table)

    def documents(self) -> Iterator[tuple[object, list[np.ndarray]]]:
        """Every document's key and ids, in pieces as the blocks cut them."""
        groups, rest = self.groups(), np.zeros(0, np.uint32)
        for key, size in zip(self.docs, self.sizes.tolist()):
            pieces = []
            while size > len(rest):
                pieces.append(rest)
                size -= len(rest)
                rest = next(groups)
            pieces.append(rest[:size])
            rest = rest[size:]
            yield key, pieces


def token_ids(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``doc_id`` and ``ids``: little-endian ids of the whole text plus ``end_id``; null text counts as empty."""

    def work(batches):
        enc = encoder(vocabulary)
        kind = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            keys, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids, starts = enc.encode(texts[a:b], end_id)
                raw, width = ids.astype(kind).tobytes(), int(kind[-1])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array([raw[width * i : width * j] for i, j in zip(starts, starts[1:])], pa.binary()), pa.array([width] * (b - a), pa.int32())], ["doc_id", "ids", "width"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, ids binary, width int")


def count_ids(tokens: DataFrame) -> DataFrame:
    """Global count of each id; every task sends one row per id it has seen."""

    def work(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, width in zip(batch.column(0), batch.column(1)):
                seen = np.bincount(np.frombuffer(raw.as_buffer(), f"<u{width.as_py()}"))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return tokens.select("ids", "width").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(tokens: DataFrame, folder: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """Writes the documents in ascending ``doc_id`` order; returns the staged manifest, one row per file.

    The counts brought to the driver have one row per vocabulary entry. Files of lost or repeated
    attempts are named by no manifest row and so never read.
    """
    counts = count_ids(tokens).collect()
    table = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        table[r.id] = r.n
    lengths = code_lengths(table, max_length)

    def work(batches):
        writer = path = None
        for batch in batches:
            for key, raw, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if writer is None:
                    path, sink = new_file(folder, ".cht")
                    writer = TokenFileWriter(sink, lengths)
                writer.add(key, np.frombuffer(raw.as_buffer(), f"<u{width}").astype(np.uint32))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    spark = tokens.sparkSession
    ordered = tokens.select("doc_id", "ids", "width").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    return stage(ordered.mapInArrow(work, "path string, part int, n_docs long, n_ids long"), "token-files")


def read_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` among all ids, ``n_tokens``, ``ids_crc32``.

    The manifest, one row per file, passes through the driver to sum the files before each.
    """
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        rows.append((r.path, base))
        base += r.n_ids

    def work(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for key, pieces in TokenFile(path).documents():
                    crc, size = 0, 0
                    for piece in pieces:
                        crc, size = crc_of(piece, crc), size + len(piece)
                    out.append((key, start, size, crc))
                    start += size
                    if len(out) == 10_000:
                        yield _digest(out)
                        out = []
                yield _digest(out)

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_round_trip(docs: DataFrame, vocabulary: str, end_id: int, max_length: int = MAX_LENGTH) -> DataFrame:
    """Encodes, writes and reads back all documents.

    Null or empty text: the end id alone. Null ``doc_id`` sorts first. Rows that share a ``doc_id``
    all stay, ordered by their ids. An empty table gives no file and no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = stage(token_ids(docs, vocabulary, end_id), "token-ids")
    return read_files(spark, write_files(tokens, scratch(spark, "huffman"), max_length))
