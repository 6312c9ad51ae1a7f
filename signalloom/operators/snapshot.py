"""Signals of an active-jobs snapshot against its history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions import lexicons as L
from signalloom.functions.dates import iso_date
from signalloom.functions.numbers import half_even
from signalloom.functions.text import casefold, clean_array, nonblank, normalize_label
from signalloom.operators.ordering import sequence_id

GROUP = ["company_id", "business_unit", "department", "capability"]
DONE, LOST = ("completed", "cached"), ("failed", "expired", "blocked")


def enriched_jobs(jobs: DataFrame, labels=L.CAPABILITY_LABELS) -> DataFrame:
    """Classified jobs in their final shape: structured date first, capability defaulted, lists cleaned."""
    return jobs.withColumns(
        {
            "source_posted_at": F.coalesce(iso_date(F.coalesce("structured_posted", F.lit(""))), iso_date("source_posted_at")).cast("string"),
            "capability": F.coalesce(normalize_label("capability", labels), F.lit("Other")),
            "technologies": clean_array("technologies"),
            "skills": clean_array("skills"),
        }
    )


def place(city="city", state="state", country="country") -> Column:
    """``city, state, country`` of what is set, null when nothing is."""
    joined = F.concat_ws(", ", *[F.nullif(F.col(c), F.lit("")) for c in (city, state, country)])
    return F.nullif(joined, F.lit(""))


def snapshot_evidence(jobs: DataFrame, order: Sequence[Column], prefix: str = "HIRE_EV_") -> DataFrame:
    """One statement per open role, numbered within its company in arrival order."""
    rows = sequence_id(jobs, prefix, 5, order, by=["company_id"], name="evidence_id")
    return rows.select(
        "evidence_id", "company_id", "source_job_id", F.col("title").alias("job_title"), "business_unit", "capability",
        place().alias("location"), F.col("source_posted_at").alias("posting_date"), F.col("posting_url").alias("source_url"),
        F.format_string("Open role: %s; capability: %s", "title", "capability").alias("statement"),
    )


def posting_intervals(sightings: DataFrame, keys: Sequence[str], seen: str = "seen_on") -> DataFrame:
    """First and last sighting of each posting: ``(keys…, first_seen, last_seen)``."""
    return sightings.filter(F.col(seen).isNotNull()).groupBy(*keys).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def open_postings(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open postings per key over time: ``(keys…, day, open_count, until)``, one row per day on which something changes.

    A posting is open from its first to its last sighting: +1 on the one, -1 on the day after the other. Changes
    are summed per key and day before they are shuffled, and the running sum goes over days, not postings.
    """
    changes = F.explode(F.array(F.struct(F.col("first_seen").alias("day"), F.lit(1).alias("change")), F.struct(F.date_add("last_seen", 1).alias("day"), F.lit(-1).alias("change"))))
    daily = intervals.select(*keys, changes.alias("c")).groupBy(*keys, F.col("c.day").alias("day")).agg(F.sum("c.change").alias("change"))
    over = Window.partitionBy(*keys).orderBy("day")
    return daily.select(*keys, "day", F.sum("change").over(over).alias("open_count"), F.lead("day").over(over).alias("until"))


def historical_counts(sweep: DataFrame, as_of: DataFrame, without_history: DataFrame | None = None, capability: str = "capability") -> DataFrame:
    """Jobs open per company and capability at each company's date of ``as_of(company_id, as_of)``.

    Companies of ``without_history(company_id)`` have supplied no history and get no rows.
    """
    dates = as_of if without_history is None else as_of.join(without_history.select("company_id"), "company_id", "left_anti")
    at = (F.col("day") <= F.col("as_of")) & (F.col("until").isNull() | (F.col("until") > F.col("as_of")))
    return sweep.join(dates, "company_id").filter(at & (F.col("open_count") > 0)).select("company_id", capability, F.col("open_count").alias("previous_job_count"))


def direction(current: Column, previous: Column) -> Column:
    """Growth, decline or stable beyond a tenth of the history (at least one); concentration without history."""
    change = current - previous
    threshold = F.greatest(F.lit(1), half_even(previous * F.lit(0.1), 0))
    return F.when(previous.isNull(), F.lit("concentration")).when(change > threshold, F.lit("growth")).when(change < -threshold, F.lit("decline")).otherwise(F.lit("stable"))


def snapshot_signals(jobs: DataFrame, history: DataFrame | None = None, senior_levels: Sequence[str] = L.SENIOR_LEVELS) -> DataFrame:
    """One signal per business unit, department and capability of a company.

    A company with no history at all reports concentration; one with history counts a missing
    capability as zero.
    """
    grouped = jobs.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("job_count"),
        F.count_if(F.col("seniority").isin(*senior_levels)).alias("senior_role_count"),
        F.avg("classification_confidence").alias("_confidence"),
        F.avg(F.col("extraction_status").isin(*DONE).cast("double")).alias("_completion"),
        F.avg((F.col("classification_source") == "llm").cast("double")).alias("_supplied"),
    )
    grouped = grouped.join(jobs.groupBy("company_id").agg(F.count(F.lit(1)).alias("_total")), "company_id")
    if history is None:
        joined = grouped.withColumn("previous_job_count", F.lit(None).cast("long"))
    else:
        known = history.select("company_id").distinct().withColumn("_has_history", F.lit(True))
        joined = grouped.join(history, ["company_id", "capability"], "left").join(known, "company_id", "left").withColumn(
            "previous_job_count", F.when(F.col("_has_history"), F.coalesce("previous_job_count", F.lit(0)))
        ).drop("_has_history")
    n = F.col("job_count")
    parts = {
        "classification": half_even(F.col("_confidence") * 0.4, 3),
        "page_enrichment": half_even(F.col("_completion") * 0.25, 3),
        "llm_coverage": half_even(F.col("_supplied") * 0.15, 3),
        "sample_size": half_even(F.least(n / 10, F.lit(1.0)) * 0.2, 3),
    }
    strength = 0.55 * (n / F.col("_total")) + 0.30 * F.least(n / 20, F.lit(1.0)) + 0.15 * F.least(F.col("senior_role_count") / 3, F.lit(1.0))
    return joined.select(
        *GROUP, "job_count", "previous_job_count", "senior_role_count",
        direction(n, F.col("previous_job_count")).alias("direction"),
        half_even(F.least(F.lit(1.0), strength), 2).alias("strength"),
        half_even(F.least(F.lit(1.0), sum(parts.values(), F.lit(0.0))), 2).alias("confidence"),
        *[v.alias(f"confidence_{k}") for k, v in parts.items()],
        F.when(F.col("previous_job_count").isNull(), F.lit("current active-job snapshot")).otherwise(F.lit("current snapshot vs historical snapshot")).alias("analysis_period"),
    )


def top_values(jobs: DataFrame, keys: Sequence[str], array_col: str, n: int = 10) -> DataFrame:
    """Most common array values per group, ties by name; one row per kept value."""
    counts = jobs.select(*keys, F.explode(array_col).alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("value_count"))
    window = Window.partitionBy(*keys).orderBy(F.desc("value_count"), "value")
    return counts.withColumn("value_rank", F.row_number().over(window)).filter(F.col("value_rank") <= n)


def snapshot_warnings(jobs: DataFrame, pages_read: bool, classifier_used: bool, history: DataFrame | None = None) -> DataFrame:
    """Warnings and job totals per company."""
    totals = jobs.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("unique_jobs"),
        F.count_if(F.col("extraction_status").isin(*DONE)).alias("enriched_jobs"),
        F.count_if(F.col("extraction_status").isin(*LOST)).alias("failed_enrichments"),
    )
    if history is None:
        totals = totals.withColumn("_known", F.lit(False))
    else:
        totals = totals.join(history.select("company_id").distinct().withColumn("_h", F.lit(True)), "company_id", "left").withColumn("_known", F.col("_h").isNotNull()).drop("_h")
    notes = F.array_compact(
        F.array(
            F.when(F.col("failed_enrichments") > 0, F.format_string("%d job pages were unavailable; CSV metadata was retained.", "failed_enrichments")),
            F.when(F.lit(not pages_read), F.lit("URL enrichment was disabled.")),
            F.when(F.lit(not classifier_used), F.lit("LLM classification was disabled; heuristic classification was used.")),
            F.when(~F.col("_known"), F.lit("Only a current active-job snapshot was supplied; signals describe concentration, not growth.")),
        )
    )
    return totals.withColumn("warnings", notes).drop("_known")


def snapshot_status(companies: DataFrame, signals: DataFrame) -> DataFrame:
    """Per company: analyzed when it has a signal, else insufficient data with the note."""
    found = signals.groupBy("company_id").agg(F.count(F.lit(1)).alias("signal_count"))
    joined = companies.select("company_id").distinct().join(found, "company_id", "left").na.fill(0, ["signal_count"])
    return joined.withColumns(
        {
            "status": F.when(F.col("signal_count") > 0, F.lit("analyzed")).otherwise(F.lit("insufficient_data")),
            "note": F.when(F.col("signal_count") == 0, F.lit("No persisted jobs are available for this organization yet.")),
        }
    )
