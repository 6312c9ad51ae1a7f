"""Near-duplicate components by HyperMinHash.

1. Each text becomes its set of word shingles (64-bit hashes). Equal sets form one class, told by a
   128-bit digest; only the smallest id of a class goes on.
2. A sketch has ``2 ** P`` buckets. The leading bits of a hash choose the bucket; of the smallest rest in a
   bucket the register holds the count of leading zeros and the next ``MANTISSA`` bits.
3. Bands of ``ROWS`` registers are bucket keys. Members of a bucket are paired with its smallest member
   only. A pair whose collision-corrected similarity estimate lies ``SIGMAS`` standard errors below the
   threshold is dropped; others are verified on their full sets, one pair per document first, then all
   pairs whose ends are still in different components.
4. In buckets that still hold several components, every member outside the bucket's main component meets
   the members of other components, in groups of bounded size. A likely pair must also be possible by the
   smallest hashes of both sets, which are the whole sets of short texts. The likeliest partner of each other
   component is verified first, then all likely pairs that are still apart. So every likely pair that
   shares a band and is not already joined gets verified, and nothing emits all pairs of a group.

A pair at similarity 0.75 shares no band with probability (1 - 0.75 ** 4) ** 32, about 5 in a million.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalloom.llm.common import claim_cache, partitions, stage
from signalloom.llm.graph import components

WIDTH = 5
PERCENT = 75
P = 7
MANTISSA = 10
ROWS = 4
SIGMAS = 4.0
GROUP = 5_000  # rows of each side of a bucket that meet in one group
STEP = 1.34  # of sizes from class to class, above 100 / PERCENT: linked sets are in the same class or in neighbouring ones
LEAST = 256  # smallest hashes of a set that go with a row of a mixed bucket; 32 bits of each
CACHE_WORDS = 300_000
COLLISIONS = 0.169919487159739093975315012348  # fixed value of the published collision estimate
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, none an empty set."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    claim_cache("shingles", _words.clear)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ codes[k : k + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def registers(hashes: np.ndarray, p: int = P, mantissa: int = MANTISSA) -> np.ndarray:
    """One register per bucket, 0 where the bucket is empty; ``hashes`` are sorted and distinct."""
    out = np.zeros(1 << p, np.uint16)
    if len(hashes):
        bucket = hashes >> np.uint64(64 - p)
        first = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])  # the smallest of each bucket
        rest = (hashes[first] << np.uint64(p)) >> np.uint64(11)  # 53 bits, exact as a float
        fraction, exponent = np.frexp(rest.astype(np.float64))
        zeros = 53 - exponent
        bits = np.where(rest > 0, (fraction * 2 - 1) * (1 << mantissa), 0).astype(np.int64)
        out[bucket[first].astype(np.int64)] = (zeros << mantissa) + bits + 1
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS, every: bool = False) -> np.ndarray:
    """A signed 64-bit key for each band that has a filled register, or for every band."""
    keys = sketch.reshape(-1, rows).astype("<u2").copy().view("<u8").ravel()
    band = np.arange(len(keys)) if every else np.flatnonzero(keys)
    mixed = (keys[band] + np.uint64(1)) * _MIX ^ (band.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, p: int = P, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of sketches and how many buckets they rest on."""
    filled = np.maximum(((a > 0) | (b > 0)).sum(1), 1)
    equal = ((a == b) & (a > 0)).sum(1)
    ratio = n / m
    expected = COLLISIONS * 2.0 ** (p - mantissa) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(equal - expected, 0) / filled, filled


def _plausible(estimate: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Estimates that do not rule the threshold out."""
    limit = PERCENT / 100
    return estimate >= limit - SIGMAS * np.sqrt(limit * (1 - limit) / filled)


def _possible(own: np.ndarray, size: int, table: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the smallest hashes of a set of ``size`` and of other sets leave the threshold possible.

    A row of ``table`` holds ``lengths`` ascending hashes of a set of ``sizes``. Two whole sets decide, up to
    one hash for equal leading bits; parts of sets are samples of the union up to the smaller of their last
    hashes, judged like the other estimate.
    """
    beyond = 1 << 32
    last = table[np.arange(len(table)), lengths - 1].astype(np.int64)
    top = np.minimum(np.where(lengths < sizes, last, beyond), int(own[-1]) if len(own) < size else beyond)
    counted = (np.arange(table.shape[1]) < lengths[:, None]) & (table <= top[:, None])
    found = own[np.minimum(np.searchsorted(own, table), len(own) - 1)] == table
    both = (found & counted).sum(1)
    union = np.searchsorted(own, top, "right") + counted.sum(1) - both
    limit = PERCENT / 100
    slack = np.where(top < beyond, SIGMAS * np.sqrt(limit * (1 - limit) / np.maximum(union, 1)), 0)
    return both + 1 >= (limit - slack) * (union - 1)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, sketch`` of every row; ``digest`` names the set and is null for an empty one."""

    def work(batches):
        import xxhash

        for batch in batches:
            sizes, digests, sketch = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sketch.append(registers(found).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_shingles long, digest binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            keys, ids, sizes = [], [], []
            for node, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = band_keys(np.frombuffer(raw.as_buffer(), "<u2")).tolist()
                keys += found
                ids += [node] * len(found)
                sizes += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, ids, sizes)], ["key", "node", "n"])

    return classes.select("node", "n_shingles", "sketch").mapInArrow(work, "key long, node long, n long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``u, v`` whose estimate does not rule the threshold out."""

    def work(batches):
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(size, -1) for i in (2, 3))
            n, m = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            keep = _plausible(*similarity(a, b, n, m))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["u", "v"])

    side = classes.select(F.col("node"), "sketch", "n_shingles")
    left = side.select(F.col("node").alias("u"), F.col("sketch").alias("a"), F.col("n_shingles").alias("n"))
    right = side.select(F.col("node").alias("v"), F.col("sketch").alias("b"), F.col("n_shingles").alias("m"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b", "n", "m").mapInArrow(work, "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= ``PERCENT`` * union."""

    def work(batches):
        last, left = None, None
        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last is None or last[0] != u:
                    last, left = (u,), shingle_set(a.as_py())
                right = shingle_set(b.as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= PERCENT * (len(left) + len(right) - both) > 0:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.select("u", "v").join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(work, "u long, v long")


def _with_least(texts: DataFrame) -> DataFrame:
    """``node, text`` with the ``LEAST`` smallest hashes of the text's set."""

    def work(batches):
        for batch in batches:
            least = [(shingle_set(text.as_py())[:LEAST] >> np.uint64(32)).astype("<u4").tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.binary())], ["node", "text", "least"])

    return texts.select("node", "text").mapInArrow(work, "node long, text string, least binary")


def _texts_of(plain: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of some ids. The ids grow with the corpus, so they are merged and not broadcast at any size."""
    return plain.join(ids.hint("merge"), "node", "left_semi")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different components; nodes without a label are their own."""
    of_u = labels.select(F.col("node").alias("u"), F.col("component").alias("_cu"))
    of_v = labels.select(F.col("node").alias("v"), F.col("component").alias("_cv"))
    joined = pairs.join(of_u, "u", "left").join(of_v, "v", "left")
    return joined.filter(F.coalesce("_cu", "u") != F.coalesce("_cv", "v")).select("u", "v")


def _dealt(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, cell, node, n, c, lone, apart``: the members of mixed buckets, dealt so that rows of one cell meet.

    A cell holds a block of ``lone`` rows, outside the bucket's main component, and a block of all its members,
    ``apart`` where they are outside too. Both have about ``GROUP`` rows at most. Each lone row meets every
    member of its own and the neighbouring size classes in one cell.
    """
    placed = buckets.filter("size > 2").join(labels.select("node", "component"), "node", "left")
    placed = stage(placed.select("key", "node", "n", "size", "u", F.coalesce("component", "node").alias("c")), "placed")
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"))
    parts = stage(parts.filter("parts > 1").select("key", "main"), "mixed-keys")
    mixed = placed.filter("node <> u").join(parts, "key").withColumn("apart", F.expr("c <> main")).withColumn("kind", F.floor(F.log(STEP, "n")).cast("int"))
    columns = ["key", "node", "n", "c", "apart"]
    near = F.explode(F.array(*(F.col("kind") + k for k in (-1, 0, 1))))

    small, large = mixed.filter(f"size <= {GROUP}").withColumn("cell", F.lit(0).cast("long")), mixed.filter(f"size > {GROUP}")
    counts = large.groupBy("key", "kind").agg(F.count("*").alias("all"), F.count_if("apart").alias("lone"))
    meet = counts.select("key", near.alias("kind"), "lone").groupBy("key", "kind").agg(F.sum("lone").alias("lone"))
    cells = counts.select("key", "kind", "all").join(meet.filter("lone > 0"), ["key", "kind"])
    cells = stage(cells.select("key", "kind", *(F.ceil(F.col(k) / GROUP).cast("long").alias(k) for k in ("all", "lone"))), "cells")
    block = lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    number = lambda lone, every: ((F.col("kind") * F.lit(1 << 24) + lone) * F.lit(1 << 24) + every).alias("cell")
    span = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    others = large.join(cells, ["key", "kind"]).withColumn("_block", span("lone")).select(*columns, number(F.col("_block"), block("all")), F.lit(False).alias("lone"))
    lone = large.filter("apart").select(*columns, near.alias("kind")).join(cells, ["key", "kind"]).withColumn("_block", span("all")).select(*columns, number(block("lone"), F.col("_block")), F.lit(True).alias("lone"))
    small = small.select(*columns, "cell")
    out = small.withColumn("lone", F.lit(False)).unionByName(small.filter("apart").withColumn("lone", F.lit(True)))
    return out.unionByName(others).unionByName(lone).select("key", "cell", "node", "n", "c", "lone", "apart")


def _mixed_pairs(buckets: DataFrame, labels: DataFrame, classes: DataFrame, candidates: DataFrame, best_only: bool) -> DataFrame:
    """Likely pairs ``u, v`` of different components inside a bucket, its smallest member aside.

    Members outside the bucket's main component meet the others in the cells of ``_dealt``, so a large
    bucket is dealt over many tasks; estimates are computed in blocks and only likely pairs that the smallest
    hashes leave possible leave a task. With ``best_only`` that is the most likely partner in each other component.
    """

    def first_shared(row, sketch):
        """Whether this bucket's band is the first the two share, so that a pair leaves one bucket only."""
        own = np.frombuffer(row[5], "<u2").reshape(-1, ROWS)
        same = (own[None] == sketch.reshape(len(sketch), -1, ROWS)).all(2) & (own > 0).any(1)[None]
        return band_keys(own.reshape(-1), every=True)[same.argmax(1)] == row[0]

    def pairs_of(lone, others):
        if not lone or not others:
            return
        sketch, numbers = (np.frombuffer(b"".join(r[k] for r in others), "<u2").reshape(len(others), -1) if k == 5 else np.array([r[2:5] for r in others], np.int64) for k in (5, 0))
        node, n, part = numbers.T
        lengths = np.array([len(r[6]) // 4 for r in others], np.int64)
        least = np.frombuffer(b"".join(r[6].ljust(4 * lengths.max(initial=1), b"\0") for r in others), "<u4").reshape(len(others), -1)
        double = np.array([r[8] for r in others])  # lone too: this pair comes from both sides
        for row in lone:
            fits = (100 * np.minimum(n, row[3]) >= PERCENT * np.maximum(n, row[3])) & (part != row[4])
            if not best_only:
                fits &= ~double | (node > row[2])
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            own = np.broadcast_to(np.frombuffer(row[5], "<u2"), (len(at), sketch.shape[1]))
            estimate, filled = similarity(own, sketch[at], np.full(len(at), float(row[3])), n[at].astype(float))
            at, estimate = at[likely := _plausible(estimate, filled)], estimate[likely]
            if not len(at):
                continue
            at, estimate = at[first := first_shared(row, sketch[at])], estimate[first]
            if not len(at):
                continue
            possible = _possible(np.frombuffer(row[6], "<u4"), row[3], least[at], lengths[at], n[at])
            at, estimate = at[possible], estimate[possible]
            if best_only and len(at):
                by = np.lexsort((node[at], -estimate, part[at]))
                at = at[by][np.concatenate([[True], np.diff(part[at][by]) != 0])]
            for other in node[at].tolist():
                yield min(row[2], other), max(row[2], other)

    def work(batches):
        key, rows = None, []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    found += pairs_of([r for r in rows if r[7]], [r for r in rows if not r[7]]) if rows else []
                    key, rows = row[:2], []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])
        found = list(pairs_of([r for r in rows if r[7]], [r for r in rows if not r[7]])) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    columns = ["key", "cell", "node", "n", "c", "sketch", "least", "lone", "apart"]
    rows = _dealt(buckets, labels).join(classes.select("node", "sketch"), "node").join(candidates.select("node", "least"), "node").select(*columns)
    dealt = rows.repartition(partitions(classes.sparkSession), "key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row.

    Null or empty text, or text of white space: an empty set, linked with nothing. A row without
    ``doc_id`` takes no part and is kept. Rows that repeat a ``doc_id`` count as one document with all
    their links. Long texts are hashed whole. An empty table gives no rows. Other columns are ignored.
    """
    sized = f"100 * least(n, m) >= {PERCENT} * greatest(n, m)"  # whole numbers: SQL reads 1.33... as a decimal
    sketched = stage(sketches(docs), "sketches")
    members = sketched.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = stage(members.groupBy("digest").agg(F.min_by(F.struct("n_shingles", "sketch"), "doc_id").alias("s"), F.min("doc_id").alias("node")).select("digest", "node", "s.*"), "classes")
    bands = _bands(classes)
    shared = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("size")).filter("size > 1")
    buckets = stage(bands.join(shared, "key").select("key", "node", "n", "size", F.col("first.node").alias("u"), F.col("first.n").alias("m")), "buckets")
    stars = buckets.filter(f"node <> u AND {sized}").select("u", F.col("node").alias("v")).distinct()
    likely = stage(_likely(stars, classes), "likely")

    ids = likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    candidates = stage(_with_least(_texts_of(plain, buckets.select("node").distinct())), "candidates")
    texts = stage(_texts_of(candidates.select("node", "text"), ids), "texts")
    first = likely.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = stage(_verified(first, texts), "links")
    labels = components(links)
    rest = _across(likely.join(first, ["u", "v"], "left_anti"), labels)
    more = stage(_verified(rest, texts), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)

    tested = likely.unionByName(first).select("u", "v")
    for best_only in (True, False):
        cross = _mixed_pairs(buckets, labels, classes, candidates, best_only)
        cross = stage(cross.distinct().join(tested, ["u", "v"], "left_anti"), "cross")
        if cross.isEmpty():
            continue
        ids = cross.select(F.col("u").alias("node")).union(cross.select("v")).distinct()
        more = stage(_verified(cross, stage(_texts_of(candidates.select("node", "text"), ids), "texts")), "links")
        tested, links = tested.unionByName(cross), links.unionByName(more)
        if not more.isEmpty():
            labels = components(links)

    by_class = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns: all without ``doc_id``, and one of those that
    repeat both ``doc_id`` and text."""
    found = near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id")
    ids = found.agg(F.max("kept").alias("kept"), (F.count("*") > 1).alias("again")).filter("kept").drop("kept")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row"))  # other columns may have any name
    rows = held.join(ids, "doc_id")
    repeated = rows.filter("again").withColumn("text", F.col("row.text")).dropDuplicates(["doc_id", "text"]).drop("text")
    kept = rows.filter("NOT again").unionByName(repeated).drop("again").unionByName(held.filter("doc_id IS NULL"))
    return kept.select("row.*")
