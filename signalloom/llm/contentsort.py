"""Exact deduplication by a distributed sort of the normalised contents.

Sampled splitters range-partition the rows by content, each task sorts its range externally, so that equal
texts stand next to each other, and neighbours are compared in full; the smallest identifier of a run stays.

The splitters travel through the driver, so the sort key begins with a bounded part of the text and goes on
with the digest of all of it; the whole text decides after that. A text that more than one of ``SHARE``
times the shuffle partitions' rows hold is dealt over several cells by identifier, each a run of its own;
the few cell heads are then merged by whole text. Native expressions only: no row passes through Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from signalloom.llm.common import partitions, stage

LEAD = 32  # characters of the text in front of the sort key
SHARE = 4  # a text is hot beyond 1 / (SHARE * partitions) of all rows


def normalised(text):
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hot_contents(contents: DataFrame) -> DataFrame:
    """``mark, cells``: hashes of texts too frequent for one run. Less than SHARE * partitions rows by definition.

    The hash only decides how rows are dealt, so a collision costs a needless split and nothing else.
    """
    share = max(1, contents.count() // (SHARE * partitions(contents.sparkSession)))
    marks = contents.groupBy(F.xxhash64("content").alias("mark")).agg(F.count("*").alias("n"))
    return marks.filter(F.col("n") > share).select("mark", F.ceil(F.col("n") / share).cast("long").alias("cells"))


def _first(order: str = "doc_id"):
    return F.asc_nulls_last(order)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Null text counts as empty, so null, empty and blank-free empty texts are one group. Exactly one row of
    each group stays, also when a ``doc_id`` repeats with equal text. A null ``doc_id`` stays only where no
    row of the group has one, and ``keep_id`` is null there. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    contents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content"))
    hot = stage(hot_contents(contents), "hot-contents")
    keyed = contents.withColumn("mark", F.xxhash64("content")).join(F.broadcast(hot), "mark", "left").select(
        "doc_id", "content", F.sha2("content", 256).alias("text_sha256"), F.substring("content", 1, LEAD).alias("lead"),
        F.coalesce("cells", F.lit(1)).alias("cells"), F.pmod(F.xxhash64("doc_id"), F.coalesce("cells", F.lit(1))).alias("cell"),
    )
    run = Window.partitionBy("lead", "text_sha256", "cell", "content")
    ordered = run.orderBy(_first())
    sorted_ = keyed.repartitionByRange("lead", "text_sha256", "cell").select(
        "doc_id", "text_sha256", "cells", "cell", F.row_number().over(ordered).alias("place"),
        F.first("doc_id").over(ordered).alias("keep_id"), F.count("*").over(run).alias("group_size"), "content",
    )
    slim = sorted_.withColumn("content", F.when((F.col("cells") > 1) & (F.col("place") == 1), F.col("content")))
    if hot.isEmpty():
        return _verdicts(slim, F.col("place") == 1)
    slim = stage(slim, "content-runs")
    heads = slim.filter("cells > 1 AND place = 1")
    head = F.struct(F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id"), F.col("cell").alias("cell"))
    groups = heads.groupBy("content", "text_sha256").agg(F.min(head).alias("head"), F.sum("group_size").alias("size"))  # some SHARE * partitions rows again
    groups = groups.select(F.col("text_sha256").alias("_digest"), "head", "size")
    merged = slim.filter("cells > 1").join(F.broadcast(groups), F.col("text_sha256") == F.col("_digest")).select(
        "doc_id", F.col("head.id").alias("keep_id"), F.col("size").alias("group_size"), "text_sha256", ((F.col("place") == 1) & (F.col("cell") == F.col("head.cell"))).alias("kept"),
    )
    return _verdicts(slim.filter("cells = 1"), F.col("place") == 1).unionByName(merged)


def _verdicts(runs: DataFrame, kept) -> DataFrame:
    return runs.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identifier stays; rows without ``doc_id`` have none and go."""
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col("_kept_id"), "left_semi")
