"""Windows, top-k, numbering, paging, set operations and order-dependent dedupe."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions.text import as_col, casefold
from signalloom.session import settle


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order``. Spark keeps one row per task before the shuffle."""
    return top_n(df, keys, order, 1)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key under ``order``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def argmax_per(df: DataFrame, keys: Sequence[str], score: str, tiebreak: Sequence[Column]) -> DataFrame:
    """Strongest row per key."""
    return latest_per(df, keys, [F.col(score).desc(), *tiebreak])


def latest_enrichment(enrichments: DataFrame) -> DataFrame:
    """Newest enrichment version per job: timestamp, schema version, provider, model descending."""
    return latest_per(
        enrichments,
        ["job_id"],
        [F.desc("enrichment_timestamp"), F.desc("prompt_schema_version"), F.desc("provider"), F.desc("model")],
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest collection run per organization."""
    return latest_per(runs, ["organization"], [F.desc("completed_at"), F.desc("started_at"), F.desc("run_id")])


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Running number from 1 in ``order``, per ``by`` group when given.

    The frame is range-sorted and written once; numbers come from each row's place in its
    partition plus the partition's offset, so neither the frame nor a hot group meets one task.
    """
    place = settle(df.orderBy(*[F.col(b) for b in by], *order).withColumn("_place", F.monotonically_increasing_id()))
    place = place.withColumns({"_part": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = place.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = place.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_row") + 1)
    if by:
        starts = placed.groupBy(*by).agg(F.min(name).alias("_start"))
        placed = placed.join(starts, list(by)).withColumn(name, F.col(name) - F.col("_start") + 1)
    return placed.select(*df.columns, name)


def sequence_id(df: DataFrame, prefix: str, width: int, order: Sequence[Column], by: Sequence[str] = (), name: str = "sequence_id") -> DataFrame:
    """Zero-padded sequential ids in ``order``."""
    placed = numbered(df, order, by, "_n")
    return placed.withColumn(name, F.format_string(f"{prefix}%0{width}d", "_n")).drop("_n")


# --- first wins on either of two keys -------------------------------------------------------


def dedupe_either(df: DataFrame, key_a, key_b, order: str) -> DataFrame:
    """Rows kept by first-wins dedupe on either key, where only kept rows claim their keys.

    ``order`` is a sortable column, unique per row. Equal key pairs shrink to their earliest row. A pending pair
    is blocked by the earlier pending pairs that share a key with it. One without a blocker is kept; one with a
    single blocker is kept if that is not, so along a chain of such pairs every second one is: their pointers
    to the blocker are doubled until they reach the chain's head, which settles a chain in as many
    rounds as the logarithm of its length. Pairs with more blockers wait until these are settled. All steps
    are min-aggregations and equi-joins, so a key holding many rows is combined before the shuffle.
    """
    blank = F.lit("")
    keyed = df.withColumns({"_a": F.coalesce(as_col(key_a), blank), "_b": F.coalesce(as_col(key_b), blank)})
    pending = settle(keyed.groupBy("_a", "_b").agg(F.min(order).alias("_o")))
    kept = []
    while not pending.isEmpty():
        blocked = settle(_blockers(_blockers(pending, "_a"), "_b").select("_a", "_b", "_o", (F.col("_n_a") + F.col("_n_b")).alias("_n"), F.coalesce("_by_a", "_by_b").alias("_by")))
        free = blocked.filter("_n = 0").select("_a", "_b", "_o")
        chained = _chain_heads(blocked.filter("_n = 1").select("_o", F.col("_by").alias("_head"), F.lit(True).alias("_odd")))
        known = chained.join(free.select(F.col("_o").alias("_head")), "_head", "left_semi")
        won = settle(free.unionByName(blocked.join(known.filter("NOT _odd"), "_o", "left_semi").select("_a", "_b", "_o")))
        kept.append(won)
        rest = pending.join(known.select("_o"), "_o", "left_anti")
        pending = settle(rest.join(won.select("_a"), "_a", "left_anti").join(won.select("_b"), "_b", "left_anti"))
    if not kept:
        return df.limit(0)
    chosen = reduce(DataFrame.unionByName, kept).select("_a", "_b", F.col("_o").alias(order))
    return keyed.join(chosen, ["_a", "_b", order], "left_semi").dropDuplicates(["_a", "_b"]).drop("_a", "_b")


def _blockers(pairs: DataFrame, key: str) -> DataFrame:
    """Adds how many earlier pairs share the key (2 stands for more) and the earliest of them where it is the only one."""
    first = pairs.groupBy(key).agg(F.min("_o").alias("_first"))
    later = pairs.join(first, key)
    second = later.filter("_o > _first").groupBy(key).agg(F.min("_o").alias("_second"))
    counted = later.join(second, key, "left")
    n = F.when(F.col("_o") == F.col("_first"), 0).when(F.col("_o") == F.col("_second"), 1).otherwise(2)
    return counted.withColumns({f"_n{key}": n, f"_by{key}": F.when(n == 1, F.col("_first"))}).drop("_first", "_second")


def _chain_heads(links: DataFrame) -> DataFrame:
    """``_o, _head, _odd`` with every pointer followed to the end of its chain; each round doubles the reach."""
    links = settle(links)
    while True:
        ahead = links.select(F.col("_o").alias("_head"), F.col("_head").alias("_next"), F.col("_odd").alias("_more"))
        if links.join(ahead, "_head", "left_semi").isEmpty():
            return links
        links = settle(links.join(ahead, "_head", "left").select("_o", F.coalesce("_next", "_head").alias("_head"), (F.col("_odd") != F.coalesce("_more", F.lit(False))).alias("_odd")))


def select_sources(sources: DataFrame, url_key: Column, rank: Column, order: str, group: str, n: int = 20) -> DataFrame:
    """Canonical-URL first-wins, then the best ``n`` per group by source rank and arrival."""
    first = latest_per(sources.withColumn("_url", url_key), [group, "_url"], [F.col(order)])
    ranked = first.withColumns({"_source_rank": rank})
    window = Window.partitionBy(group).orderBy("_source_rank", order)
    return ranked.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n).drop("_url", "_source_rank")


# --- sorting and paging ---------------------------------------------------------------------


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result; Spark takes the first ``offset + limit`` rows per task only."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if offset < 0:
        raise ValueError("offset must be non-negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_envelope(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows carry total, limit, offset and returned count."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = page(df, order, limit, offset)
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), total - F.lit(offset)))
    return rows.withColumns({"total": total, "limit": F.lit(limit), "offset": F.lit(offset), "returned_count": returned})


def rank(df: DataFrame, count_col: str, name_col: str, fold: bool = False) -> list[Column]:
    """Ranking order: count descending, then name (folded first when asked)."""
    tail = [casefold(name_col), F.col(name_col)] if fold else [F.col(name_col)]
    return [F.desc(count_col), *tail]


def jobs_page_order() -> list[Column]:
    return [F.desc("posted_date"), F.col("organization"), F.col("source_job_id")]


def analytics_order() -> list[Column]:
    return [F.col("posted_date"), F.col("job_id")]


def runs_order() -> list[Column]:
    return [F.desc("completed_at"), F.desc("started_at"), F.desc("run_id")]


def evidence_order() -> list[Column]:
    return [F.desc("observed_at"), casefold("job_title"), F.col("evidence_id")]


def observation_order() -> list[Column]:
    return [casefold("normalized_technology"), F.col("observation_date"), F.col("job_id")]


def signal_order(title: str = "title") -> list[Column]:
    return [F.col("signal_type"), F.col(title), F.col("signal_id")]


# --- sets -----------------------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect_count(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], name: str = "shared") -> DataFrame:
    """Distinct common keys per group."""
    both = left.select(*by, *keys).distinct().join(right.select(*by, *keys).distinct(), [*by, *keys], "left_semi")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def distinct_first(df: DataFrame, keys: Sequence[str], order: str, by: Sequence[str] = (), name: str = "first_seen") -> DataFrame:
    """Distinct keys per ``by`` group with the order of their first occurrence, by which a list of them is sorted.

    One map-side minimum per key; no group's values meet in one task.
    """
    return df.groupBy(*by, *keys).agg(F.min(order).alias(name))


def not_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the left whose keys the right does not know."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def subset_violations(members: DataFrame, universe: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group, how many member keys lie outside the universe; no rows means subset."""
    return not_in(members, universe, keys).groupBy(*by).agg(F.count(F.lit(1)).alias("outside"))
