"""Hiring analytics and signals of every organization in one pass over the jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions import text as X
from signalloom.functions.dates import week_start
from signalloom.functions.ids import uuid5
from signalloom.functions.numbers import days_between, general_format, half_even, pct, ratio, unit

FAMILIES = ("total", "with_capability", "with_seniority", "with_location", "country", "region", "city", "capability", "seniority", "leadership", "day", "week")


def capabilities(jobs_col: str = "capability_classifications") -> Column:
    return X.clean_array(jobs_col)


def facet_array(families: Sequence[str]) -> Column:
    """The facet values a job counts towards, distinct, as an array of ``family, value``."""
    country = X.strip("country")
    one = lambda family, value, cond=None: F.array(F.when(F.lit(True) if cond is None else cond, F.struct(F.lit(family).alias("family"), value.alias("value"))))
    many = lambda family, values: F.transform(values, lambda v: F.struct(F.lit(family).alias("family"), v.alias("value")))
    nothing = F.lit("")
    parts = {
        "total": lambda: one("total", nothing),
        "with_capability": lambda: one("with_capability", nothing, F.size(capabilities()) > 0),
        "with_seniority": lambda: one("with_seniority", nothing, F.col("seniority_level").isNotNull()),
        "with_location": lambda: one("with_location", nothing, X.strip("location") != ""),
        "country": lambda: one("country", country, country != ""),
        "region": lambda: many("region", X.regions("location", "country")),
        "city": lambda: many("city", X.cities("location")),
        "capability": lambda: many("capability", capabilities()),
        "seniority": lambda: one("seniority", F.col("seniority_level"), F.col("seniority_level").isNotNull()),
        "leadership": lambda: one("leadership", nothing, F.col("is_leadership")),
        "day": lambda: one("day", F.col("posted_date").cast("string"), F.col("posted_date").isNotNull()),
        "week": lambda: one("week", week_start("posted_date").cast("string"), F.col("posted_date").isNotNull()),
    }
    return F.array_compact(X.chained(*[F.coalesce(parts[f](), F.array().cast("array<struct<family:string,value:string>>")) for f in families]))


def job_facets(jobs: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """One row per job and facet value it counts towards: ``(organization, family, value, job_id, evidence_id, posted_date)``.

    Values are distinct within a job, so counting rows counts jobs.
    """
    # An inner explode would make Catalyst build the array a second time to filter on its size.
    sole = ["sole"] if "sole" in jobs.columns else []
    return jobs.select("organization", "job_id", "evidence_id", "posted_date", *sole, F.explode_outer(facet_array(families)).alias("f")).filter("f IS NOT NULL").select(
        "organization", "f.family", "f.value", "job_id", "evidence_id", "posted_date", *sole
    )


def distinct_evidence(facets: DataFrame) -> Column:
    """Distinct evidence of a group; evidence that one job alone cites is summed, only the rest is compared."""
    if "sole" not in facets.columns:
        return F.count_distinct("evidence_id")
    return F.count_if(F.col("sole") & F.col("evidence_id").isNotNull()) + F.count_distinct(F.when(~F.col("sole"), F.col("evidence_id")))


def facet_counts(facets: DataFrame, with_evidence: bool = True) -> DataFrame:
    """Jobs, distinct evidence and date span per organization, family and value."""
    measures = [F.count(F.lit(1)).alias("job_count"), F.min("posted_date").alias("first_date"), F.max("posted_date").alias("last_date")]
    if with_evidence:
        measures.append(distinct_evidence(facets).alias("evidence_count"))
    return facets.groupBy("organization", "family", "value").agg(*measures)


def _per_org(condition: Column, measure: Column) -> Column:
    """Organization-wide figure read off the facet rows themselves."""
    return F.max(F.when(condition, measure)).over(Window.partitionBy("organization"))


def with_totals(counts: DataFrame) -> DataFrame:
    """Attach the organization's totals to every facet row (facet rows are few per organization)."""
    total = lambda family: F.coalesce(_per_org(F.col("family") == family, F.col("job_count")), F.lit(0))
    return counts.withColumns(
        {
            "total_jobs": total("total"),
            "classified_jobs": total("with_capability"),
            "seniority_jobs": total("with_seniority"),
            "location_jobs": total("with_location"),
            "observation_start": _per_org(F.col("family") == "total", F.col("first_date")),
            "observation_end": _per_org(F.col("family") == "total", F.col("last_date")),
        }
    )


def snapshot(jobs: DataFrame) -> DataFrame:
    """Totals, coverage counts and observation period per organization."""
    return jobs.groupBy("organization").agg(
        F.count(F.lit(1)).alias("total_active_jobs"),
        F.count_if(F.size(capabilities()) > 0).alias("jobs_with_capability_classification"),
        F.count("seniority_level").alias("jobs_with_seniority"),
        F.count_if(X.strip("location") != "").alias("jobs_with_location"),
        F.min("posted_date").alias("observation_start"),
        F.max("posted_date").alias("observation_end"),
    )


DENOMINATORS = {"country": "total_jobs", "region": "total_jobs", "city": "total_jobs", "capability": "classified_jobs", "seniority": "seniority_jobs", "leadership": "total_jobs"}
BASES = {"total_jobs": "total", "classified_jobs": "with_capability", "seniority_jobs": "with_seniority"}


def concentration(jobs: DataFrame, family: str) -> DataFrame:
    """Job count and percentage per value of one family, against the family's denominator."""
    denominator = DENOMINATORS[family]
    base = BASES[denominator]
    counts = facet_counts(job_facets(jobs, [base, family]), with_evidence=False)
    total = F.coalesce(_per_org(F.col("family") == base, F.col("job_count")), F.lit(0))
    return (
        counts.withColumn("denominator", total).filter(F.col("family") == family)
        .select("organization", F.col("value").alias(family), "job_count", "denominator", pct("job_count", "denominator").alias("percentage"))
    )


def geographic_concentration(jobs: DataFrame) -> DataFrame:
    """Country, region and city concentrations in one scan."""
    counts = facet_counts(job_facets(jobs, ["total", "country", "region", "city"]), with_evidence=False)
    total = _per_org(F.col("family") == "total", F.col("job_count"))
    return counts.withColumn("total_jobs", total).filter(F.col("family") != "total").select(
        "organization", F.col("family").alias("level"), "value", "job_count", pct("job_count", "total_jobs").alias("percentage_of_total")
    )


def leadership(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("organization").agg(F.count(F.lit(1)).alias("total_jobs"), F.count_if("is_leadership").alias("leadership_job_count")).withColumn(
        "leadership_percentage", pct("leadership_job_count", "total_jobs")
    )


def trend(jobs: DataFrame, granularity: str = "week") -> DataFrame:
    """Populated day or Monday-week buckets."""
    bucket = F.col("posted_date") if granularity == "day" else week_start("posted_date")
    return jobs.filter("posted_date IS NOT NULL").groupBy("organization", bucket.alias("bucket_start")).agg(F.count(F.lit(1)).alias("job_count"))


def references(jobs: DataFrame, family: str) -> DataFrame:
    """Contributing records of every group, one row each: ``(organization, value, job_id, evidence_id)``.

    Lists stay long rows; a group may hold a third of the table.
    """
    return job_facets(jobs, [family]).select("organization", "value", "job_id", "evidence_id")


def analytics(jobs: DataFrame) -> DataFrame:
    """All analytics families from one scan and one aggregation."""
    counts = with_totals(facet_counts(job_facets(jobs), with_evidence=False))
    share = F.lit(None).cast("double")
    for family, denominator in DENOMINATORS.items():
        share = F.when(F.col("family") == family, pct("job_count", denominator)).otherwise(share)
    return counts.select("organization", "family", "value", "job_count", share.alias("percentage"), "total_jobs", "observation_start", "observation_end")


# --- signals --------------------------------------------------------------------------------


@dataclass(frozen=True)
class HiringThresholds:
    geographic_minimum_total_jobs: int = 5
    geographic_minimum_job_count: int = 2
    geographic_minimum_percentage: float = 30.0
    capability_minimum_classified_jobs: int = 3
    capability_minimum_classification_coverage: float = 0.5
    capability_minimum_job_count: int = 2
    capability_minimum_percentage: float = 30.0
    leadership_minimum_total_jobs: int = 5
    leadership_minimum_seniority_coverage: float = 0.5
    leadership_minimum_job_count: int = 2
    hiring_volume_minimum_jobs: int = 5
    trend_minimum_buckets: int = 4
    trend_minimum_observation_days: int = 21
    trend_minimum_directional_change: float = 0.25
    limited_observation_window_days: int = 28
    small_sample_job_count: int = 20
    single_source_data: bool = True


# One facet table serves signals and overlap groups.
SIGNAL_FAMILIES = ("total", "with_capability", "with_seniority", "with_location", "country", "region", "city", "capability", "leadership", "week")
LEVELS = {"country": "country", "region": "state/region", "city": "city"}


def half_change(weeks: DataFrame, by: Sequence[str] = ("organization",), order: str = "bucket_start", measure: str = "job_count") -> DataFrame:
    """Average of the earlier half of the ordered buckets against the later half, per group."""
    ordered = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    early = F.col("_n") <= F.floor(F.col("_buckets") / 2)
    return (
        weeks.withColumns({"_n": F.row_number().over(ordered), "_buckets": F.count(F.lit(1)).over(whole)})
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("bucket_count"),
            F.avg(F.when(early, F.col(measure))).alias("earlier_average"),
            F.avg(F.when(~early, F.col(measure))).alias("later_average"),
        )
        .withColumn("change", F.when(F.col("earlier_average") != 0, (F.col("later_average") - F.col("earlier_average")) / F.col("earlier_average")))
    )


def _case(pairs: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out if default is None else out.otherwise(default)


def limitations(t: HiringThresholds, signal_type: Column) -> Column:
    """Notes of a signal from totals and coverages on the row."""
    span = days_between("observation_end", "observation_start")
    return F.array_compact(
        F.array(
            F.when(F.lit(t.single_source_data), F.lit("Based on a single public hiring source.")),
            F.when(F.col("total_jobs") < t.small_sample_job_count, F.lit("Observed job sample is small.")),
            F.when(span < t.limited_observation_window_days, F.lit("Observation window is limited.")),
            F.when((signal_type == "capability_hiring_concentration") & (F.col("classified_jobs") < F.col("total_jobs")), F.lit("Capability classification coverage is incomplete.")),
            F.when((signal_type == "leadership_hiring") & (F.col("seniority_jobs") < F.col("total_jobs")), F.lit("Seniority coverage is incomplete.")),
            F.when(signal_type == "hiring_trend", F.lit("Trend compares populated time buckets and does not model zero-posting intervals.")),
        )
    )


def hiring_signals(jobs: DataFrame, thresholds: HiringThresholds | None = None) -> DataFrame:
    """Thresholded hiring signals with score, identity, text and limitations.

    One scan explodes each job into its facets, one aggregation counts them; totals, week halves
    and gates are read off the small facet table with windows, so the jobs are not read again.
    """
    return signals_from_counts(facet_counts(job_facets(jobs, SIGNAL_FAMILIES)), thresholds or HiringThresholds())


def signals_from_counts(counts: DataFrame, t: HiringThresholds) -> DataFrame:
    org = Window.partitionBy("organization")
    is_week, is_total = F.col("family") == "week", F.col("family") == "total"
    weeks = Window.partitionBy("organization", "family").orderBy("value")
    base = with_totals(counts).withColumns(
        {
            "_n": F.row_number().over(weeks),
            "bucket_count": F.count_if(is_week).over(org),
            "span_days": days_between("observation_end", "observation_start"),
        }
    )
    early = F.col("_n") <= F.floor(F.col("bucket_count") / 2)
    base = base.withColumns(
        {
            "earlier_average": F.avg(F.when(is_week & early, F.col("job_count"))).over(org),
            "later_average": F.avg(F.when(is_week & ~early, F.col("job_count"))).over(org),
        }
    )
    # The total row yields two candidates: volume and trend.
    candidates = base.withColumn("kind", F.explode(F.when(is_total, F.array(F.lit("volume"), F.lit("trend"))).otherwise(F.array(F.col("family")))))
    kind = F.col("kind")
    geographic = kind.isin(*LEVELS)
    change = F.when(F.col("earlier_average") != 0, (F.col("later_average") - F.col("earlier_average")) / F.col("earlier_average"))
    share = _case(
        [(geographic, pct("job_count", "total_jobs")), (kind == "capability", pct("job_count", "classified_jobs")), (kind == "leadership", pct("job_count", "total_jobs"))],
    )
    coverage = _case(
        [
            (geographic, ratio("location_jobs", "total_jobs")),
            (kind == "capability", ratio("classified_jobs", "total_jobs")),
            (kind == "leadership", ratio("seniority_jobs", "total_jobs")),
            (kind == "volume", F.lit(1.0)),
            (kind == "trend", unit(F.col("span_days") / t.trend_minimum_observation_days)),
        ]
    )
    measured = candidates.withColumns({"percentage": share, "data_coverage": coverage, "change": change})
    total, count = F.col("total_jobs"), F.col("job_count")
    gate = _case(
        [
            (geographic, (total >= t.geographic_minimum_total_jobs) & (count >= t.geographic_minimum_job_count) & (F.col("percentage") >= t.geographic_minimum_percentage)),
            (
                kind == "capability",
                (F.col("classified_jobs") >= t.capability_minimum_classified_jobs)
                & (F.col("data_coverage") >= t.capability_minimum_classification_coverage)
                & (count >= t.capability_minimum_job_count)
                & (F.col("percentage") >= t.capability_minimum_percentage),
            ),
            (kind == "leadership", (total >= t.leadership_minimum_total_jobs) & (F.col("data_coverage") >= t.leadership_minimum_seniority_coverage) & (count >= t.leadership_minimum_job_count)),
            (kind == "volume", total >= t.hiring_volume_minimum_jobs),
            (
                kind == "trend",
                (F.col("bucket_count") >= t.trend_minimum_buckets)
                & (F.col("span_days") >= t.trend_minimum_observation_days)
                & F.coalesce(F.abs("change") >= t.trend_minimum_directional_change, F.lit(False)),
            ),
        ],
        F.lit(False),
    )
    kept = measured.filter(gate & F.col("observation_start").isNotNull())
    sufficiency = unit(
        _case(
            [
                (geographic, count / (t.geographic_minimum_job_count * 2)),
                (kind == "capability", count / (t.capability_minimum_job_count * 2)),
                (kind == "leadership", count / (t.leadership_minimum_job_count * 2)),
                (kind == "volume", total / (t.hiring_volume_minimum_jobs * 2)),
                (kind == "trend", F.col("bucket_count") / (t.trend_minimum_buckets * 2)),
            ]
        )
    )
    strength = unit(_case([(kind == "volume", total / (t.hiring_volume_minimum_jobs * 2)), (kind == "trend", F.abs("change"))], F.col("percentage") / 100))
    evidence = unit(ratio("evidence_count", "job_count"))
    direction = F.when(F.col("change") > 0, F.lit("increased")).otherwise(F.lit("decreased"))
    level = _case([(kind == k, F.lit(v)) for k, v in LEVELS.items()])
    signal_type = _case(
        [
            (geographic, F.lit("geographic_hiring_concentration")),
            (kind == "capability", F.lit("capability_hiring_concentration")),
            (kind == "leadership", F.lit("leadership_hiring")),
            (kind == "volume", F.lit("hiring_volume")),
        ],
        F.lit("hiring_trend"),
    )
    subject = _case(
        [
            (geographic, F.concat(level, F.lit(":"), F.col("value"))),
            (kind == "capability", F.col("value")),
            (kind == "leadership", F.lit("leadership")),
            (kind == "volume", F.lit("observed-volume")),
        ],
        F.concat(F.lit("weekly:"), direction),
    )
    title = _case(
        [
            (geographic, F.concat(F.lit("Observed hiring concentration in "), F.col("value"))),
            (kind == "capability", F.concat(F.lit("Observed hiring demand for "), F.col("value"))),
            (kind == "leadership", F.lit("Observed leadership hiring activity")),
            (kind == "volume", F.lit("Observed hiring volume")),
        ],
        F.concat(F.lit("Observed weekly hiring activity "), direction),
    )
    share_text, whole = general_format("percentage"), F.col("total_jobs")
    summary = _case(
        [
            (geographic, F.format_string(
                "%s represents %s%% of observed hiring activity (%d of %d jobs) at the %s level; this is a hiring concentration signal, not proof of investment.",
                F.col("value"), share_text, count, whole, level)),
            (kind == "capability", F.format_string(
                "%s accounts for %s%% of classified hiring activity (%d of %d classified jobs); observed demand suggests a hiring focus, not confirmed investment.",
                F.col("value"), share_text, count, F.col("classified_jobs"))),
            (kind == "leadership", F.format_string(
                "Leadership roles represent %s%% of observed hiring activity (%d of %d jobs); this hiring signal does not establish an organizational investment decision.",
                share_text, count, whole)),
            (kind == "volume", F.format_string(
                "%d active job postings were observed during the observation period; this volume is a hiring activity signal and does not by itself confirm strategic investment.", whole)),
        ],
        F.format_string(
            "Average observed weekly hiring activity %s from %s to %s jobs per populated bucket across the observation period; this directional hiring signal is not proof of sustained growth, decline, or investment.",
            direction, general_format("earlier_average"), general_format("later_average")),
    )
    identity = F.concat_ws("|", "organization", "signal_type", "subject", F.col("observation_start").cast("string"), F.col("observation_end").cast("string"))
    return (
        kept.withColumns({"signal_type": signal_type, "subject": subject, "title": title, "summary": summary})
        .select(
            "organization",
            uuid5(F.concat(F.lit("hiring-signal:"), identity)).alias("signal_id"),
            "signal_type", "subject", "title", "summary",
            half_even(strength, 4).alias("strength"),
            half_even((evidence + sufficiency + F.col("data_coverage")) / 3, 4).alias("confidence"),
            half_even(evidence, 4).alias("evidence_coverage"),
            "observation_start", "observation_end",
            limitations(t, F.col("signal_type")).alias("limitations"),
            "evidence_count",
            F.when(kind.isin("volume", "trend"), F.lit("total")).otherwise(F.col("family")).alias("family"),
            "value",
        )
    )


#: Facets whose jobs support a signal.
SUPPORT_FAMILIES = ("total", "country", "region", "city", "capability", "leadership")


def hiring_signal_support(jobs: DataFrame, signals: DataFrame) -> DataFrame:
    """Supporting records of every signal, one row each."""
    facets = job_facets(jobs, SUPPORT_FAMILIES).drop("posted_date", "sole")
    chosen = signals.select("organization", "family", "value", "signal_id", "signal_type", "title")
    return facets.join(chosen, ["organization", "family", "value"]).select("organization", "signal_id", "signal_type", "title", "job_id", "evidence_id")


def organization_summary(jobs: DataFrame, enrichments: DataFrame, signals: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence and enrichment coverage, signal count and latest run per organization.

    Every job counts as having evidence, and any enrichment version counts its job.
    """
    totals = jobs.groupBy("organization").agg(
        F.count(F.lit(1)).alias("total_observed_jobs"), F.min("posted_date").alias("observation_start"), F.max("posted_date").alias("observation_end")
    )
    enriched = jobs.select("organization", "job_id").join(enrichments.select("job_id"), "job_id", "left_semi").groupBy("organization").agg(F.count(F.lit(1)).alias("enriched_job_count"))
    counted = signals.groupBy("organization").agg(F.count(F.lit(1)).alias("signal_count"))
    return (
        totals.join(enriched, "organization", "left").join(counted, "organization", "left")
        .join(runs.select("organization", F.col("run_id").alias("latest_run_id"), F.col("status").alias("latest_run_status")), "organization", "left")
        .na.fill(0, ["enriched_job_count", "signal_count"])
        .withColumns(
            {
                "jobs_with_evidence": F.col("total_observed_jobs"),
                "evidence_coverage": pct("total_observed_jobs", "total_observed_jobs"),
                "enrichment_coverage": pct("enriched_job_count", "total_observed_jobs"),
            }
        )
    )
