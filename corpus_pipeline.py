"""From raw documents to packed training sequences; each stage's result is written and read again.

Toxic documents go, then those that fail the quality rules; one document of each near-duplicate group
stays; passages that repeat across documents are cut out; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import hyperminhash, packing, quality, suffixes, toxicity
from signalloom.llm.common import stage, table, whole_texts
from signalloom.llm.queries import vocabulary

#: Stages rest on trained models, compression and tokenizers, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole_texts(spark)
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole_texts(spark)
    return hyperminhash.one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole_texts(spark)
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole_texts(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. Null texts fail the quality rules; empty tables give no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
