"""Gates and scores of research signals, citations and findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from signalloom.functions import lexicons as L
from signalloom.functions.dates import is_recent
from signalloom.functions.numbers import half_even, ratio, unit
from signalloom.functions.text import as_col, lookup


def source_rank(source_type) -> Column:
    """Retrieval rank of a source type; unknown types last."""
    return F.coalesce(lookup({k: str(v) for k, v in L.SOURCE_RANKS.items()}, source_type).cast("int"), F.lit(len(L.SOURCE_RANKS)))


def attach_source(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence of known sources; the source's address, type and date replace the extracted ones."""
    chosen = sources.select("source_id", "url", "source_type", "publication_date")
    replaced = [c for c in ("source_url", "source_type", "publication_date") if c in evidence.columns]
    return evidence.drop(*replaced).join(chosen, "source_id").withColumnRenamed("url", "source_url")


def forward(text) -> Column:
    return as_col(text).rlike(L.FORWARD_GUIDANCE)


def gate_measures(evidence: DataFrame, by: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Everything the gates need from the evidence of each signal, in one aggregation."""
    text = F.col("statement")
    return evidence.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_distinct("source_id").alias("sources"),
        F.bool_or(F.col("source_type").isin(*L.TIER_ONE_SOURCES) & forward(text)).alias("tier_one_guidance"),
        F.bool_or(text.rlike(L.EXPLICIT_PRIORITY)).alias("explicit_priority"),
        F.bool_or(text.rlike(L.COMPLETED_ACTIVITY)).alias("completed"),
        F.bool_or(forward(text) | text.rlike(L.ACTIVE_ACTIVITY)).alias("ongoing"),
    )


def minimum_evidence() -> Column:
    """Two items from two sources, or one first-tier source with forward guidance."""
    return ((F.col("items") >= 2) & (F.col("sources") >= 2)) | F.col("tier_one_guidance")


def needs_explicit_priority(question) -> Column:
    return as_col(question).rlike(L.YES_NO_QUESTION) & as_col(question).rlike(L.MAJOR_PRIORITY_QUESTION)


def question_strength(question) -> Column:
    """A yes/no question about a major priority needs explicit priority text."""
    return ~needs_explicit_priority(question) | F.col("explicit_priority")


def temporal_consistency() -> Column:
    """Completed activity alone does not make a direction."""
    return ~F.col("completed") | F.col("ongoing")


def self_negating(hypothesis) -> Column:
    return as_col(hypothesis).rlike(L.SELF_NEGATING)


def quality_gate(signals: DataFrame, evidence: DataFrame, question_col: str = "question", key: str = "signal_id") -> DataFrame:
    """Signals with one column per gate and ``passes`` for all of them."""
    joined = signals.join(gate_measures(evidence, [key]), key)
    return joined.withColumns(
        {
            "minimum_evidence": minimum_evidence(), "question_strength": question_strength(question_col),
            "temporal_consistency": temporal_consistency(), "self_negating": self_negating("hypothesis"),
        }
    ).withColumn("passes", F.expr("minimum_evidence AND question_strength AND temporal_consistency AND NOT self_negating"))


def research_confidence(evidence: DataFrame, as_of, by: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Five-part confidence of each signal from its evidence."""
    part = lambda cond, weight: F.when(cond, weight).otherwise(0.0)
    scored = evidence.groupBy(*by).agg(
        part(F.bool_or(F.col("source_type").isin(*L.OFFICIAL_SOURCES)), 0.30).alias("official_source"),
        part(F.bool_or(F.col("source_type").isin(*L.LEADERSHIP_SOURCES)), 0.25).alias("leadership_or_earnings"),
        part(F.count_distinct("source_id") >= 2, 0.20).alias("multiple_sources"),
        part(F.bool_or(F.col("source_type").isin(*L.EXTERNAL_SOURCES)), 0.15).alias("independent_confirmation"),
        part(F.bool_or(is_recent("publication_date", as_of)), 0.10).alias("recency"),
    )
    total = F.expr("official_source + leadership_or_earnings + multiple_sources + independent_confirmation + recency")
    return scored.withColumn("confidence", half_even(F.least(total, F.lit(1.0)), 2))


def _weight(kind, weights: Mapping[str, float]) -> Column:
    return lookup({k: str(v) for k, v in weights.items()}, kind).cast("double")


def citation_reliability(answers: DataFrame, citations: DataFrame, catalog: DataFrame, maximum_evidence: int, key: str = "answer_id", weights=L.CITATION_WEIGHTS) -> DataFrame:
    """Reliability of each answer: relationship quality, independent support and catalog availability."""
    sizes = catalog.groupBy(key).agg(F.count_distinct("evidence_id").alias("catalog_size"))
    cited = citations.groupBy(key).agg(F.avg(_weight("relationship_type", weights)).alias("_quality"), F.count_distinct("evidence_id").alias("cited"))
    joined = answers.select(key).join(sizes, key, "left").join(cited, key, "left").na.fill(0, ["catalog_size", "cited"])
    available = F.col("catalog_size") / maximum_evidence
    full = (F.col("_quality") + F.least(F.col("cited") / 3, F.lit(1.0)) + F.least(available, F.lit(1.0))) / 3
    return joined.withColumn(
        "reliability",
        F.when(F.col("catalog_size") == 0, 0.0).when(F.col("cited") == 0, half_even(F.least(F.lit(0.4), available), 4)).otherwise(half_even(F.least(F.lit(1.0), full), 4)),
    ).drop("_quality")


def finding_reliability(answers: DataFrame, supports: DataFrame, context: DataFrame, key: str = "answer_id", weights=L.SUPPORT_WEIGHTS) -> DataFrame:
    """Six-part reliability of each answer, capped at .35 when nothing was found.

    ``supports(key, finding_id, support_class, job_id)`` has one row per finding, support and job;
    a finding without support has null ``support_class``. ``context`` gives coverages and the period.
    """
    distinct = supports.select(key, "finding_id", "support_id", "support_class").distinct()
    quality = distinct.groupBy(key).agg(F.avg(_weight("support_class", weights)).alias("_quality"))
    findings = distinct.groupBy(key, "finding_id").agg(F.count("support_class").alias("_n")).groupBy(key).agg(F.count(F.lit(1)).alias("findings"), F.min("_n").alias("_least"))
    jobs = supports.groupBy(key).agg(F.count_distinct("job_id").alias("_jobs"))
    joined = answers.select(key).join(quality, key, "left").join(findings, key, "left").join(jobs, key, "left").join(context, key, "left").na.fill(
        0, ["_quality", "findings", "_least", "_jobs", "evidence_coverage", "enrichment_coverage"]
    )
    observed = F.coalesce(F.least(F.datediff("observation_end", "observation_start") / 30, F.lit(1.0)), F.lit(0.0))
    cited = F.when((F.col("findings") > 0) & (F.col("_least") > 0), 1.0).otherwise(0.0)
    score = (
        0.25 * F.col("_quality") + 0.2 * F.least(F.col("_jobs") / 5, F.lit(1.0)) + 0.2 * F.col("evidence_coverage")
        + 0.15 * F.col("enrichment_coverage") + 0.1 * observed + 0.1 * cited
    )
    capped = F.when(F.col("findings") == 0, F.least(score, F.lit(0.35))).otherwise(score)
    return joined.select(key, "findings", half_even(unit(capped), 4).alias("reliability"))
