"""Removal of repeated byte passages by merged suffix orders.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts elsewhere in the table.

1. Every such string holds an *anchor*: a position whose hash of ``GRAM`` bytes is the smallest of a
   string's ``SPAN`` grams. Equal strings have equal anchors at equal places, so it is enough to compare
   strings around anchors with the same gram. Grams seen once are done; anchors whose whole surroundings
   (all strings over the anchor) are equal in every place are repeated as they stand. Both come from
   hash aggregation, so hot passages and groups of copies collapse before anything is sorted.
2. The rest are suffixes that differ somewhere near. They are dealt by the bytes that all strings of one
   half have in common (the gram and the ``REACH`` bytes to one side of it) and carry only the tails beyond.
3. A task sorts each shard (an Arrow batch) by the right tails, in eight-byte symbols. Shards are merged by
   refining their interleave symbol by symbol: only blocks that still hold suffixes of both shards are
   looked at, and the step and byte at which a block splits is the common prefix of the neighbours there. The
   same is done for what precedes, read backwards, in an order of its own. No suffix is sorted again after its
   shard. No Burrows-Wheeler transform is built: the short tails lie beside their rows, so the merge reads
   their own next symbols and need not recover them from preceding ones.
4. With common prefixes in both directions, a string is repeated when two suffixes share t bytes to the
   left and the rest to the right, for each t in turn.
5. A task orders whole keys of some ``BOUND`` suffixes at a time. Where more share one key, as at the edges of a
   passage that much of the corpus holds, their strings are counted by 128-bit hashes instead, so that
   the rows of a key never have to meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalloom.llm.common import partitions, stage

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1
BEFORE = SPAN - 1  # a string may begin so far before its anchor
REACH = BEFORE // 2
BOUND = 20_000  # suffixes that a task orders at once; keys with more are counted instead

_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on, by doubling the width."""
    hashes, step = _TABLE[data], 1
    while step < GRAM:
        hashes = hashes[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + hashes[step:]
        step *= 2
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of a text of at least ``LENGTH`` bytes; ties all count."""
    hashes = gram_hashes(data)
    smallest = _sliding(hashes, SPAN, np.minimum)
    around = np.zeros(len(smallest) + 2 * BEFORE, np.uint64)
    around[BEFORE : BEFORE + len(smallest)] = smallest
    at = np.flatnonzero(hashes == _sliding(around, SPAN, np.maximum))
    return at, hashes[at].view(np.int64)


def _named(docs: DataFrame, *columns) -> DataFrame:
    """``doc, mark`` and the given columns: the identifier and a hash of the text tell rows apart that repeat an
    identifier; rows equal in both are copies and share all they have. Without identifier the hash stands for it."""
    mark = F.xxhash64(F.col("text").cast("string"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), mark).alias("doc"), mark.alias("mark"), *columns)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``doc, mark, at, gram, around``: the anchors of every text with the hash of all bytes in reach."""

    def work(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, marks, places, grams, around = [], [], [], [], []
            for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = (text.as_py() or "").encode()
                if len(raw) < LENGTH:
                    continue
                at, gram = anchors(np.frombuffer(raw, np.uint8))
                places.append(at)
                grams.append(gram)
                keys.append(np.full(len(at), key, np.int64))
                marks.append(np.full(len(at), mark, np.int64))
                around += [digest(raw[max(0, p - BEFORE) : p + LENGTH], min(p, BEFORE)) for p in at.tolist()]
                if len(around) > 100_000:
                    yield _anchor_batch(keys, marks, places, grams, around)
                    keys, marks, places, grams, around = [], [], [], [], []
            if around:
                yield _anchor_batch(keys, marks, places, grams, around)

    return _named(docs, F.col("text").cast("string").alias("text")).mapInArrow(work, "doc long, mark long, at int, gram long, around long")


def _anchor_batch(keys, marks, places, grams, around) -> pa.RecordBatch:
    columns = [np.concatenate(keys), np.concatenate(marks), np.concatenate(places).astype(np.int32), np.concatenate(grams), np.array(around, np.uint64).view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "mark", "at", "gram", "around"])


def tails(raw: bytes, at: int) -> list[tuple[str, int, bytes, bytes]]:
    """The two halves of the strings over an anchor: side, hash of what all of a half share, the bytes
    before it read backwards, and the bytes after it."""
    import xxhash

    out = []
    for side, low, high in (("R", 0, REACH), ("L", REACH + 1, BEFORE)):  # bytes a string has before the anchor
        begin, end = at - low, at + LENGTH - high
        if begin < 0 or end > len(raw):
            continue
        reach = high - low
        out.append((side, xxhash.xxh3_64_intdigest(raw[begin:end], low) - (1 << 63), raw[max(0, begin - reach) : begin][::-1], raw[end : end + reach]))
    return out


class Order:
    """Suffixes in order: ``rank[i]`` places the i-th, ``prefix[j]`` is how many leading bytes (of the key
    columns and the tail) neighbours j - 1 and j share, or -1 where their keys differ."""

    def __init__(self, rows: np.ndarray, prefix: np.ndarray):
        self.rows, self.prefix = rows, prefix


def _symbols(matrix: np.ndarray) -> np.ndarray:
    """The tail bytes as big-endian words, padded with zeros."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    return padded.view(">u8").astype(np.uint64)


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes two unequal words share."""
    differ, shared = a ^ b, np.zeros(len(a), np.int64)
    for bits in range(56, 0, -8):
        shared += differ < np.uint64(1 << bits)
    return shared


def shard_order(columns: np.ndarray, rows: np.ndarray) -> Order:
    """Sorts one shard's rows by their symbol columns; the first two columns are the key."""
    order = rows[np.lexsort(columns[rows].T[::-1])] if len(rows) else rows
    prefix = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        a, b = columns[order[:-1]], columns[order[1:]]
        differ = a != b
        first = np.where(differ.any(1), differ.argmax(1), columns.shape[1])
        at = np.minimum(first, columns.shape[1] - 1)
        pick = np.arange(len(a))
        more = np.where(first < columns.shape[1], _shared_bytes(a[pick, at], b[pick, at]), 0)
        prefix[1:] = np.where(first < 2, -1, 8 * (first - 2) + more)
    return Order(order, prefix)


def merge_orders(columns: np.ndarray, a: Order, b: Order) -> Order:
    """Merges two shards by refining their interleave, one symbol column at a time.

    A block is a run of the merged order that agrees so far. Within a block both shards' suffixes stand
    in their own order, so the stable sort by the next symbol only interleaves two sorted runs.
    """
    rows = np.concatenate([a.rows, b.rows])
    from_b = np.concatenate([np.zeros(len(a.rows), bool), np.ones(len(b.rows), bool)])
    known = np.concatenate([a.prefix, b.prefix])  # towards the neighbour before, in the own shard
    block = np.zeros(len(rows), np.int64)
    split = np.full(len(rows), -2, np.int64)  # the prefix at boundaries the refinement has found
    active = np.ones(len(rows), bool)
    for step in range(columns.shape[1]):
        where = np.flatnonzero(active)
        if not len(where):
            break
        symbol = columns[rows[where], step]
        code = np.unique(symbol, return_inverse=True)[1]
        by = np.argsort(block[where] * (int(code.max()) + 1) + code, kind="stable")
        rows[where], from_b[where], known[where] = rows[where][by], from_b[where][by], known[where][by]
        symbol = symbol[by]
        inner = np.flatnonzero((block[where][1:] == block[where][:-1]) & (symbol[1:] != symbol[:-1])) + 1
        split[where[inner]] = -1 if step < 2 else 8 * (step - 2) + _shared_bytes(symbol[inner - 1], symbol[inner])
        bounds = np.zeros(len(rows), np.int64)
        bounds[where[inner]] = 1
        bounds[1:] |= block[1:] != block[:-1]
        block = np.cumsum(bounds)
        size = int(block[-1]) + 1
        in_b = np.bincount(block, from_b, size)
        mixed = (in_b > 0) & (in_b < np.bincount(block, minlength=size))
        active = mixed[block]
    prefix = known.copy()
    found = split > -2
    prefix[found] = split[found]
    across = np.zeros(len(rows), bool)
    across[1:] = (from_b[1:] != from_b[:-1]) & ~found[1:]
    prefix[across] = 8 * (columns.shape[1] - 2)  # never split: equal to the end
    if len(prefix):
        prefix[0] = -1
    return Order(rows, prefix)


def merged_order(columns: np.ndarray, shards: list[np.ndarray]) -> Order:
    """Order of all shards' rows, merged pairwise."""
    orders = [shard_order(columns, rows) for rows in shards] or [Order(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(orders) > 1:
        orders = [merge_orders(columns, *orders[i : i + 2]) if i + 1 < len(orders) else orders[i] for i in range(0, len(orders), 2)]
    return orders[0]


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values], np.int64)
    flat = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8)
    return flat.reshape(len(values), width), sizes


def repeated_strings(keys: np.ndarray, left: list[bytes], right: list[bytes], times: np.ndarray, shards: list[np.ndarray], reach: int) -> np.ndarray:
    """For each row and each t from 0 to ``reach``: does the string with t bytes on the left and
    ``reach - t`` on the right of the shared part occur in another place, or twice in the row's own?"""
    (lefts, left_size), (rights, right_size) = _matrix(left, reach), _matrix(right, reach)
    t = np.arange(reach + 1)
    valid = (t <= left_size[:, None]) & (reach - t <= right_size[:, None])
    out = valid & (times > 1)[:, None]

    def classes(matrix):
        order = merged_order(np.column_stack([keys, _symbols(matrix)]), shards)
        place = np.empty(len(order.rows), np.int64)
        place[order.rows] = np.arange(len(order.rows))
        return order.prefix, place

    (after, place_after), (before, place_before) = classes(rights), classes(lefts)
    for k in t:
        use = np.flatnonzero(valid[:, k])
        if len(use) < 2:
            continue
        one = np.cumsum(before < k)[place_before[use]]
        two = np.cumsum(after < reach - k)[place_after[use]]
        pair = one * (len(keys) + 1) + two
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        out[use[by[1:][same]], k] = True
        out[use[by[:-1][same]], k] = True
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _ordered_ranges(pieces: list[list[list]]):
    """Ranges of the repeated strings of whole keys; each piece is a shard."""
    for side, low in (("R", 0), ("L", REACH + 1)):
        parts = [[[c[i] for i in chosen] for c in p] for p in pieces if (chosen := [i for i, s in enumerate(p[3]) if s == side])]
        if not parts:
            continue
        reach = REACH if side == "R" else BEFORE - REACH - 1
        bounds = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        shards = [np.arange(a, b) for a, b in zip(bounds, bounds[1:])]
        gram, around, times, _, core, left, right = ([x for p in parts for x in p[k]] for k in range(7))
        keys = np.column_stack([np.array(core, np.int64), np.array(gram, np.int64)]).view(np.uint64)
        flags = repeated_strings(keys, left, right, np.array(times), shards, reach)
        row, first, last = _ranges(flags)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(gram, np.int64)[row]), pa.array(np.array(around, np.int64)[row]), pa.array(first + low), pa.array(last + low)], ["gram", "around", "low", "high"])


def _whole_keys(batches, bound: int):
    """Lists of pieces of sorted batches, cut between keys once ``bound`` rows have come together."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_pylist() for c in batch.columns]
        keys = [last, *zip(*(columns[k] for k in (3, 4, 0)))]
        last, cut = keys[-1], None
        if rows + batch.num_rows > bound:
            cut = next((i for i in range(batch.num_rows - 1, -1, -1) if keys[i] != keys[i + 1]), None)
        if cut is not None:
            yield held + [[c[:cut] for c in columns]] * (cut > 0)
            held, rows, columns = [], 0, [c[cut:] for c in columns]
        held.append(columns)
        rows += len(columns[0])
    yield held


def _resolved(variants: DataFrame) -> DataFrame:
    """Repeated strings over anchors whose surroundings differ: ``gram, around, low, high`` in bytes before the anchor."""
    bound = BOUND

    def work(batches):
        for pieces in _whole_keys(batches, bound):
            yield from _ordered_ranges(pieces)

    schema, key = "gram long, around long, low long, high long", ["side", "core", "gram"]
    hot = stage(variants.groupBy(*key).count().filter(f"count > {bound}").select(*key), "hot-cores")  # one row per ``bound`` suffixes at most
    if hot.isEmpty():
        return variants.repartition(partitions(variants.sparkSession), *key).sortWithinPartitions(*key).mapInArrow(work, schema)
    rest = variants.join(hot, key, "left_anti").select(*variants.columns)
    ordered = rest.repartition(partitions(variants.sparkSession), *key).sortWithinPartitions(*key).mapInArrow(work, schema)
    return ordered.unionByName(_counted(variants.join(hot, key, "left_semi").select(*variants.columns)))


def _counted(variants: DataFrame) -> DataFrame:
    """The same by counts of the strings' hashes, without bringing the rows of a key together."""

    def strings(batches):
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = []
                for gram, around, times, side, core, left, right in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns)):
                    reach, low = (REACH, 0) if side == "R" else (BEFORE - REACH - 1, REACH + 1)
                    for t in range(max(0, reach - len(right)), min(reach, len(left)) + 1):
                        out.append((gram, around, times, core, t + low, xxhash.xxh3_128_digest(left[:t] + right[: reach - t], t + low)))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["gram", "around", "times", "core", "before", "digest"])

    def ranges(batches):
        for batch in batches:
            out = []
            for gram, around, before in zip(*(c.to_pylist() for c in batch.columns)):
                before = sorted(set(before))
                firsts = [b for i, b in enumerate(before) if not i or before[i - 1] != b - 1]
                lasts = [b for i, b in enumerate(before) if i + 1 == len(before) or before[i + 1] != b + 1]
                out += [(gram, around, a, b) for a, b in zip(firsts, lasts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["gram", "around", "low", "high"])

    key = ["gram", "core", "before", "digest"]
    found = variants.mapInArrow(strings, "gram long, around long, times long, core long, before long, digest binary")
    twice = stage(found.groupBy(*key).agg(F.sum("times").alias("n")).filter("n > 1").select(*key), "counted")  # a plain table, so that a hot string's join can be split
    return found.join(twice, key).groupBy("gram", "around").agg(F.collect_set("before").alias("before")).mapInArrow(ranges, "gram long, around long, low long, high long")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``doc, mark, low, high``: starts of strings that also occur elsewhere; the last of a text may lie
    behind its last string and stands for that one."""
    found = stage(anchor_rows(docs), "anchors")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b"))
    grams = stage(grams.filter("n > 1").select("gram", F.expr("a = b").alias("alike")), "shared-grams")  # a plain table, so that a hot gram's join can be split
    shared = stage(found.join(grams, "gram"), "shared-anchors")
    whole = shared.filter("alike").select("doc", "mark", F.greatest(F.col("at") - BEFORE, F.lit(0)).alias("low"), F.col("at").alias("high"))

    mixed = shared.filter("NOT alike")
    kinds = mixed.groupBy("gram", "around").agg(F.count("*").alias("times"), F.min(F.struct("doc", "mark", "at")).alias("one"))
    wanted = kinds.groupBy("one.doc", "one.mark").agg(F.collect_list(F.struct("gram", "around", "times", F.col("one.at").alias("at"))).alias("wanted"))
    texts = _named(docs, _packed()(F.col("text").cast("string")).alias("text")).join(wanted, ["doc", "mark"]).select("text", "wanted")

    def cut(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = _unpacked(text.as_py())
                for w in wanted.as_py():
                    out += [(w["gram"], w["around"], w["times"], *half) for half in tails(raw, w["at"])]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["gram", "around", "times", "side", "core", "left", "right"])

    variants = stage(texts.mapInArrow(cut, "gram long, around long, times long, side string, core long, left binary, right binary"), "variants")
    ranges = _resolved(variants)
    place = F.col("at")
    partly = mixed.join(ranges, ["gram", "around"]).select("doc", "mark", (place - F.col("high")).alias("low"), (place - F.col("low")).alias("high"))
    return whole.unionByName(partly)


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans and the number of maximal removed runs."""
    cover = np.zeros(len(raw) + 1, np.int32)
    low, high = np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64)
    np.add.at(cover, low, 1)
    np.add.at(cover, high, -1)
    gone = np.cumsum(cover)[:-1] > 0
    runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), runs


def _packed():
    """Compressed texts: whole texts cross a shuffle twice, and fast block compression alone saves little of them."""

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        return text.map(lambda t: packer.compress(t.encode()), na_action="ignore")

    return packed


def _unpacked(packed: bytes | None) -> bytes:
    import zstandard

    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


_OUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _removal():
    @F.pandas_udf(_OUT)
    def removal(packed: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for one, ranges in zip(packed, spans):
            raw = _unpacked(one)
            cuts = [(s["low"], min(s["high"] + LENGTH, len(raw))) for s in ([] if ranges is None else ranges) if s["low"] < len(raw)]
            kept, runs = _kept(raw, cuts) if cuts else (raw, 0)
            rows.append((len(raw), len(raw) - len(kept), runs, kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return removal


def remove_repeats(docs: DataFrame, *columns: str) -> DataFrame:
    """``row``, a struct of the given columns of ``docs``, and ``cut``, a struct of ``n_bytes, n_removed, n_spans``
    and ``kept``, the remaining bytes, null for a null text.

    Null text counts as empty; texts under ``LENGTH`` bytes hold no string and stay whole. Rows with a null or
    repeated ``doc_id`` are texts of their own like all others; rows equal in ``doc_id`` and text
    are copies, so all their strings repeat. An empty table gives no rows.
    """
    spans = repeated_starts(docs).groupBy(F.col("doc").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    slim = _named(docs, F.struct(*columns).alias("row"), _packed()(F.col("text").cast("string")).alias("packed"))
    joined = slim.join(spans, (F.col("doc") == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    return joined.withColumn("cut", _removal()("packed", "spans")).select("row", "cut", F.col("packed").isNull().alias("none"))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    return remove_repeats(docs, "doc_id").select(F.col("row.doc_id").cast("long").alias("doc_id"), "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with the remaining text and its length in ``n_chars``.

    A cut may split a character; what is left of it goes too. Null text stays null. Other columns may have any name.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.when(~F.col("none"), _decoded()(F.col("cut.kept")))
    held = remove_repeats(docs, *others).select("row", text.alias("text"))
    return held.select(*(F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def _decoded():
    @F.pandas_udf("string")
    def decoded(kept: pd.Series) -> pd.Series:
        return kept.map(lambda raw: raw.decode("utf-8", "ignore"), na_action="ignore")

    return decoded
