"""Hiring analytics and signals."""

from pyspark.sql import Window, functions as F

from signalloom.operators import analytics as A, ordering as O, runs
from signalloom.plans.binding import HIRING
from signalloom.plans.registry import day, query


@query("agg1_snapshot", """
SELECT organization, total_jobs AS total_active_jobs, classified_jobs AS jobs_with_capability_classification, seniority_jobs AS jobs_with_seniority, location_jobs AS jobs_with_location,
  strftime(d0, '%Y-%m-%d') AS observation_start, strftime(d1, '%Y-%m-%d') AS observation_end FROM b_totals""")
def _(b):
    s = A.snapshot(b.jobs)
    return s.select("organization", "total_active_jobs", "jobs_with_capability_classification", "jobs_with_seniority", "jobs_with_location", day("observation_start"), day("observation_end"))


@query("agg2_contributing_records", "SELECT organization, capability AS value, job_id, evidence_id FROM b_jobs JOIN b_caps USING (job_id)")
def _(b):
    return A.references(b.jobs, "capability")


for _family, _total in (("country", "total_jobs"), ("region", "total_jobs"), ("city", "total_jobs"), ("capability", "classified_jobs"), ("seniority", "seniority_jobs")):
    _id = {"country": "agg3", "region": "agg4", "city": "agg5", "capability": "agg6", "seniority": "agg7"}[_family]

    @query(f"{_id}_{_family}_concentration", f"""
    SELECT c.organization, value AS {_family}, job_count, {_total} AS denominator, round_even(job_count / {_total} * 100, 2) AS percentage
    FROM b_counts c JOIN b_totals USING (organization) WHERE family = '{_family}'""")
    def _(b, family=_family):
        return A.concentration(b.jobs if family == "capability" else b.postings.withColumn("capability_classifications", F.array().cast("array<string>")), family)


@query("agg8_leadership", "SELECT organization, total_jobs, leaders AS leadership_job_count, round_even(leaders / total_jobs * 100, 2) AS leadership_percentage FROM b_totals")
def _(b):
    return A.leadership(b.jobs)


@query("agg9_daily_trend", "SELECT organization, strftime(posted_date, '%Y-%m-%d') AS bucket_start, count(*) AS job_count FROM b_jobs GROUP BY ALL")
def _(b):
    return A.trend(b.postings, "day").select("organization", day("bucket_start"), "job_count")


@query("agg10_weekly_trend", "SELECT organization, strftime(date_trunc('week', posted_date), '%Y-%m-%d') AS bucket_start, count(*) AS job_count FROM b_jobs GROUP BY ALL")
def _(b):
    return A.trend(b.postings, "week").select("organization", day("bucket_start"), "job_count")


@query("agg12_analytics_bundle", """
SELECT c.organization, family, value, job_count, total_jobs,
  CASE WHEN family IN ('country', 'region', 'city', 'leadership') THEN round_even(job_count / total_jobs * 100, 2) WHEN family = 'capability' THEN round_even(job_count / classified_jobs * 100, 2)
       WHEN family = 'seniority' THEN round_even(job_count / seniority_jobs * 100, 2) END AS percentage
FROM b_counts c JOIN b_totals USING (organization)""")
def _(b):
    return A.analytics(b.jobs).select("organization", "family", "value", "job_count", "total_jobs", "percentage")


@query("geographic_concentration_levels", """
SELECT c.organization, family AS level, value, job_count, round_even(job_count / total_jobs * 100, 2) AS percentage_of_total FROM b_counts c JOIN b_totals USING (organization) WHERE family IN ('country', 'region', 'city')""")
def _(b):
    return A.geographic_concentration(b.postings)


@query("agg11_percentage", """
SELECT c_mktsegment AS segment, c_nationkey % 7 AS bucket, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM customer) * 100, 2) AS percentage FROM customer GROUP BY ALL""")
def _(b):
    from signalloom.functions.numbers import pct

    customer = b.table("customer")
    groups = customer.groupBy(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 7).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counted = groups.withColumn("total", F.sum("n").over(Window.partitionBy()))  # over the few groups, not over customers
    return counted.withColumn("percentage", pct("n", "total")).drop("total")


@query("agg13_organization_summary", """
SELECT t.organization, total_jobs AS total_observed_jobs, total_jobs AS jobs_with_evidence, 100.0::DOUBLE AS evidence_coverage, coalesce(enriched, 0) AS enriched_job_count,
  round_even(coalesce(enriched, 0) / total_jobs * 100, 2) AS enrichment_coverage, coalesce(signals, 0) AS signal_count, r.run_id AS latest_run_id, r.status AS latest_run_status
FROM b_totals t LEFT JOIN (SELECT organization, count(*) AS enriched FROM b_jobs WHERE job_id IN (SELECT job_id FROM b_enr) GROUP BY 1) USING (organization)
LEFT JOIN (SELECT organization, count(*) AS signals FROM b_hsig GROUP BY 1) USING (organization) LEFT JOIN b_lastrun r USING (organization)""")
def _(b):
    out = A.organization_summary(b.jobs, b.enrichments, b.hiring_signals, O.latest_run(b.runs))
    return out.select("organization", "total_observed_jobs", "jobs_with_evidence", "evidence_coverage", "enriched_job_count", "enrichment_coverage", "signal_count", "latest_run_id", "latest_run_status")


_SIGNALS = "SELECT organization, signal_id, signal_type, subject, title, strength, confidence, evidence_coverage FROM b_hsig"
for _name, _types in (
    ("sig1_geographic_signals", ["geographic_hiring_concentration"]), ("sig2_capability_signals", ["capability_hiring_concentration"]), ("sig3_leadership_signals", ["leadership_hiring"]),
    ("sig4_volume_signals", ["hiring_volume"]), ("sig5_trend_signals", ["hiring_trend"]), ("sig8_hiring_signals", None),
):
    _where = "" if _types is None else f" WHERE signal_type = '{_types[0]}'"

    @query(_name, _SIGNALS + _where)
    def _(b, types=_types):
        s = b.hiring_signals if types is None else b.hiring_signals.filter(F.col("signal_type").isin(*types))
        return s.select("organization", "signal_id", "signal_type", "subject", "title", "strength", "confidence", "evidence_coverage")


@query("sig6_hiring_limitations", """
SELECT organization, signal_id, concat_ws(' ', 'Based on a single public hiring source.', CASE WHEN total_jobs < 20 THEN 'Observed job sample is small.' END, CASE WHEN span < 28 THEN 'Observation window is limited.' END,
  CASE WHEN signal_type = 'capability_hiring_concentration' AND classified_jobs < total_jobs THEN 'Capability classification coverage is incomplete.' END,
  CASE WHEN signal_type = 'leadership_hiring' AND seniority_jobs < total_jobs THEN 'Seniority coverage is incomplete.' END,
  CASE WHEN signal_type = 'hiring_trend' THEN 'Trend compares populated time buckets and does not model zero-posting intervals.' END) AS limitations FROM b_hsig""")
def _(b):
    return b.hiring_signals.select("organization", "signal_id", F.array_join("limitations", " ").alias("limitations"))


@query("sig7_hiring_scores", "SELECT signal_type, count(*) AS n, max(strength) AS strongest, min(confidence) AS least_confident, max(evidence_coverage) AS coverage FROM b_hsig GROUP BY 1")
def _(b):
    return b.hiring_signals.groupBy("signal_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("strength").alias("strongest"), F.min("confidence").alias("least_confident"), F.max("evidence_coverage").alias("coverage"))


@query("sig8_signal_summaries", """
SELECT signal_id, CASE signal_type
 WHEN 'geographic_hiring_concentration' THEN value || ' represents ' || format('{:g}', pct) || '% of observed hiring activity (' || job_count || ' of ' || total_jobs || ' jobs) at the ' || CASE family WHEN 'region' THEN 'state/region' ELSE family END || ' level; this is a hiring concentration signal, not proof of investment.'
 WHEN 'capability_hiring_concentration' THEN value || ' accounts for ' || format('{:g}', pct) || '% of classified hiring activity (' || job_count || ' of ' || classified_jobs || ' classified jobs); observed demand suggests a hiring focus, not confirmed investment.'
 WHEN 'leadership_hiring' THEN 'Leadership roles represent ' || format('{:g}', pct) || '% of observed hiring activity (' || job_count || ' of ' || total_jobs || ' jobs); this hiring signal does not establish an organizational investment decision.'
 WHEN 'hiring_volume' THEN total_jobs || ' active job postings were observed during the observation period; this volume is a hiring activity signal and does not by itself confirm strategic investment.'
 ELSE 'Average observed weekly hiring activity ' || CASE WHEN a1 > a0 THEN 'increased' ELSE 'decreased' END || ' from ' || format('{:g}', a0) || ' to ' || format('{:g}', a1) || ' jobs per populated bucket across the observation period; this directional hiring signal is not proof of sustained growth, decline, or investment.' END AS summary
FROM b_hsig JOIN b_halves USING (organization)""")
def _(b):
    return b.hiring_signals.select("signal_id", "summary")


@query("sig8_signal_evidence", "SELECT organization, signal_id, evidence_id FROM b_hsup")
def _(b):
    b = b.staged
    return b.hiring_support.select("organization", "signal_id", "evidence_id")


@query("win6_half_change", "SELECT organization, bucket_count, round_even(a0, 6) AS earlier_average, round_even(a1, 6) AS later_average, round_even((a1 - a0) / a0, 6) AS change FROM b_halves")
def _(b):
    h = A.half_change(A.trend(b.postings, "week"))
    return h.select("organization", "bucket_count", *[F.bround(c, 6).alias(c) for c in ("earlier_average", "later_average", "change")])


@query("agg3_signals_default_thresholds", """
SELECT c.organization, family, value, job_count, round_even(job_count / total_jobs * 100, 2) AS percentage FROM b_counts c JOIN b_totals USING (organization)
WHERE family IN ('country', 'region', 'city') AND total_jobs >= 5 AND job_count >= 2 AND round_even(job_count / total_jobs * 100, 2) >= 30.0""")
def _(b):
    s = A.hiring_signals(b.jobs).filter("signal_type = 'geographic_hiring_concentration'").select("organization", "family", "value")
    return s.join(A.geographic_concentration(b.postings).withColumnRenamed("level", "family"), ["organization", "family", "value"]).select("organization", "family", "value", "job_count", F.col("percentage_of_total").alias("percentage"))


@query("flt16_isolation_violations", "SELECT 'Elsewhere' AS organization, job_id, count(*) AS n FROM b_hsup WHERE CAST(job_id AS BIGINT) % 50 = 0 GROUP BY ALL")
def _(b):
    b = b.staged
    strayed = F.when(F.col("job_id").cast("long") % 50 == 0, F.lit("Elsewhere")).otherwise(F.col("organization"))
    support = b.hiring_support.withColumn("organization", strayed)
    return runs.isolation_violations(support, b.postings).groupBy("organization", "job_id").agg(F.count(F.lit(1)).alias("n"))
