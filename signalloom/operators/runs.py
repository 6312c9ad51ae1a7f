"""Ingest audit and enrichment planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions.ids import content_hash
from signalloom.functions.text import nonblank
from signalloom.operators.ordering import latest_per


def run_audit(records: DataFrame, by: str = "run_id") -> DataFrame:
    """Counts per run from records with ``page``, ``reject_codes``; encountered = collected + skipped."""
    skipped = F.size("reject_codes") > 0
    return records.groupBy(by).agg(
        F.count_distinct("page").alias("pages_attempted"),
        F.count(F.lit(1)).alias("records_encountered"),
        F.count_if(~skipped).alias("records_collected"),
        F.count_if(skipped).alias("records_skipped"),
        F.count_if(skipped).alias("issue_count"),
    )


def audit_violations(audit: DataFrame) -> DataFrame:
    """Runs whose counts do not add up or whose times run backwards."""
    bad = F.col("records_encountered") != F.col("records_collected") + F.col("records_skipped")
    if {"started_at", "completed_at"} <= set(audit.columns):
        bad = bad | (F.col("completed_at") < F.col("started_at"))
    return audit.filter(bad)


def run_status(collected, issues, natural_completion, source_failure, stopped_by_limit) -> Column:
    """``failed``, ``completed`` or ``partial``."""
    return (
        F.when(source_failure & (collected == 0), F.lit("failed"))
        .when(natural_completion & (issues == 0), F.lit("completed"))
        .when((issues > 0) | stopped_by_limit | source_failure, F.lit("partial"))
        .otherwise(F.lit("completed"))
    )


CURRENT_KEY = ["job_id", "evidence_id", "provider", "model", "prompt_schema_version", "source_content_hash"]


def current_enrichments(enrichments: DataFrame, provider: str, model: str, version: str) -> DataFrame:
    """Identity keys of enrichments made by one provider, model and schema version."""
    return enrichments.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("prompt_schema_version") == version)).select(
        "job_id", "evidence_id", "source_content_hash"
    ).distinct()


def eligible_for_enrichment(jobs: DataFrame, evidence: DataFrame, current: DataFrame) -> DataFrame:
    """Usable jobs with evidence whose content has no current enrichment."""
    usable = jobs.join(evidence.select("evidence_id", "source_excerpt"), "evidence_id").filter(nonblank("description").isNotNull() | nonblank("source_excerpt").isNotNull())
    return usable.withColumn("source_content_hash", content_hash()).join(current, ["job_id", "evidence_id", "source_content_hash"], "left_anti")


def enrichment_plan(jobs: DataFrame, evidence: DataFrame, current: DataFrame, max_jobs: int = 5) -> DataFrame:
    """Status of every job: skipped with its reason, planned (first ``max_jobs`` eligible by date and id) or deferred.

    Only the first ``max_jobs`` eligible rows per organization are ranked; Spark keeps that many
    per task, so a large organization does not gather in one.
    """
    stored = evidence.select("evidence_id", "source_excerpt", F.lit(True).alias("_evidence"))
    have = current.withColumn("_current", F.lit(True))
    joined = jobs.withColumn("source_content_hash", content_hash()).join(stored, "evidence_id", "left").join(have, ["job_id", "evidence_id", "source_content_hash"], "left")
    usable = nonblank("description").isNotNull() | nonblank("source_excerpt").isNotNull()
    checked = joined.withColumn(
        "status",
        F.when(F.col("_evidence").isNull(), F.lit("skipped_no_evidence"))
        .when(~usable, F.lit("skipped_unusable_evidence"))
        .when(F.col("_current"), F.lit("skipped_existing")),
    ).select("organization", "job_id", "evidence_id", "posted_date", "title", "status")
    window = Window.partitionBy("organization").orderBy("posted_date", "job_id")
    first = (
        checked.filter("status IS NULL").select("organization", "posted_date", "job_id")
        .withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= max_jobs)
        .select("job_id", F.lit(True).alias("_planned"))
    )
    return checked.join(first, "job_id", "left").withColumn(
        "status", F.coalesce("status", F.when(F.col("_planned"), F.lit("planned")), F.lit("deferred_limit"))
    ).drop("_planned")


def apply_outcomes(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Plan with the reported outcome of each planned job (enriched, failed_…) in place of ``planned``.

    A planned job nobody attempted becomes deferred.
    """
    reported = latest_per(outcomes, ["job_id"], [F.col("outcome")])
    return plan.join(reported.select("job_id", "outcome"), "job_id", "left").withColumn(
        "status", F.when(F.col("status") == "planned", F.coalesce("outcome", F.lit("deferred_limit"))).otherwise(F.col("status"))
    ).drop("outcome")


def plan_counts(plan: DataFrame) -> DataFrame:
    """Outcome counts per organization; eligible plus skips cover every discovered job."""
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    failures = ("failed_validation", "failed_provider", "failed_persistence")
    return plan.groupBy("organization").agg(
        F.count(F.lit(1)).alias("discovered_jobs"),
        F.count_if(~F.col("status").startswith("skipped")).alias("eligible_jobs"),
        n("planned", "enriched", *failures).alias("planned_jobs"),
        n("enriched", *failures).alias("attempted_jobs"),
        n("enriched").alias("enriched_jobs"),
        n("skipped_existing").alias("existing_enrichment_skips"),
        n("skipped_no_evidence").alias("no_evidence_skips"),
        n("skipped_evidence_mismatch").alias("evidence_mismatch_skips"),
        n("skipped_unusable_evidence").alias("unusable_evidence_skips"),
        n(*failures).alias("failed_jobs"),
        n("deferred_limit").alias("deferred_jobs"),
    )


def plan_violations(counts: DataFrame) -> DataFrame:
    """Organizations whose plan counts do not cover their jobs."""
    covered = F.col("eligible_jobs") + F.col("existing_enrichment_skips") + F.col("no_evidence_skips") + F.col("evidence_mismatch_skips") + F.col("unusable_evidence_skips")
    return counts.filter((covered != F.col("discovered_jobs")) | (F.col("attempted_jobs") != F.col("enriched_jobs") + F.col("failed_jobs")))


def isolation_violations(rows: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Output rows that carry another organization than the job they cite."""
    owner = jobs.select(key, F.col("organization").alias("_owner"))
    return rows.join(owner, key).filter(F.col("organization") != F.col("_owner")).drop("_owner")
