"""Unified evidence, job search, paging."""

from pyspark.sql import Window, functions as F

from signalloom.operators import analytics as A, evidence as E, ordering as O
from signalloom.plans.registry import day, query
from signalloom.sources import tables as S


@query("joi12_evidence_links", "SELECT * FROM b_links")
def _(b):
    b = b.lean("technology")
    return b.links.select("evidence_id", "hiring_signal_count", "technology_signal_count", "technology_observation_count")


@query("joi12_signal_references", """
SELECT DISTINCT organization, evidence_id, 'hiring' AS domain, signal_type, title, signal_id FROM b_hsup UNION ALL SELECT DISTINCT organization, evidence_id, 'technology', signal_type, title, signal_id FROM b_tsup""")
def _(b):
    b = b.lean("technology")
    return b.sole.references.unionByName(b.shared.references)


@query("unified_evidence", """
SELECT organization, job_id, evidence_id, source, source_type, strftime(observed_at, '%Y-%m-%d') AS observed_at, coalesce(business_unit, '') AS business_unit, enrichment_present, coalesce(provider, '') AS enrichment_provider,
  coalesce(seniority, '') AS seniority, preview AS evidence_preview, coalesce(hiring_signal_count, 0) AS hiring_signal_count, coalesce(technology_observation_count, 0) AS technology_observation_count
FROM b_uni LEFT JOIN b_links USING (evidence_id)""")
def _(b):
    b = b.staged
    u = b.unified
    return u.select("organization", "job_id", "evidence_id", "source", "source_type", day("observed_at"), F.coalesce("business_unit", F.lit("")).alias("business_unit"), "enrichment_present",
                    F.coalesce("enrichment_provider", F.lit("")).alias("enrichment_provider"), F.coalesce("seniority", F.lit("")).alias("seniority"), "evidence_preview", "hiring_signal_count", "technology_observation_count")


@query("agg20_evidence_summary", """
SELECT t.organization, t.total_jobs, count(u.job_id) AS total_evidence_records, count(DISTINCT u.job_id) AS jobs_with_evidence, count(*) FILTER (enrichment_present) AS enriched_evidence_count,
  count(*) FILTER (hiring_signal_count > 0) AS evidence_supporting_hiring_signals, count(*) FILTER (technology_observation_count > 0) AS evidence_supporting_technology_observations,
  count(*) FILTER (technology_signal_count > 0) AS evidence_supporting_technology_signals, round_even(count(DISTINCT u.job_id) / t.total_jobs * 100, 2) AS evidence_coverage,
  round_even(count(*) FILTER (enrichment_present) / count(u.job_id) * 100, 2) AS enrichment_coverage, strftime(max(captured_at), '%Y-%m-%d') AS latest_capture
FROM b_totals t LEFT JOIN b_uni u ON u.organization = t.organization LEFT JOIN b_links USING (evidence_id) GROUP BY t.organization, t.total_jobs""")
def _(b):
    b = b.lean("summary")
    s = E.evidence_summary(b.postings, b.unified)
    return s.select("organization", "total_jobs", "total_evidence_records", "jobs_with_evidence", "enriched_evidence_count", "evidence_supporting_hiring_signals",
                    "evidence_supporting_technology_observations", "evidence_supporting_technology_signals", "evidence_coverage", "enrichment_coverage", day("latest_capture"))


@query("agg21_source_distribution", "SELECT organization, source, source_type, count(*) AS evidence_count FROM b_uni GROUP BY ALL")
def _(b):
    return E.source_distribution(b.records)


@query("flt5_search_evidence", """
SELECT organization, job_id, evidence_id FROM b_uni WHERE contains(lower(job_title || ' ' || job_location || ' ' || coalesce(preview, '') || ' ' || coalesce(CASE WHEN t1 = t2 THEN t1 ELSE t1 || ' ' || t2 END, '') || ' ' || coalesce(capability, '')), 'machinery')
  AND contains(lower(source), 'work') AND enrichment_present AND (contains(lower(t1), 'brand#2') OR contains(lower(t2), 'brand#2')) AND contains(lower(capability), 'm') AND contains(lower(job_location), 'nation_1')""")
def _(b):
    found = E.search_evidence(b.records, search="Machinery", source="WORK", enriched=True, technology="brand#2", capability="M", location="NATION_1")
    return found.select("organization", "job_id", "evidence_id")


@query("srt7_evidence_page", """
SELECT evidence_id, job_title FROM b_uni WHERE organization = 'EUROPE' ORDER BY observed_at DESC, lower(job_title), evidence_id LIMIT 25 OFFSET 5""")
def _(b):
    return O.page(E.search_evidence(b.records, organization="EUROPE"), O.evidence_order(), 25, 5).select("evidence_id", "job_title")


@query("srt9_page_envelope", """
SELECT job_id, (SELECT count(*) FROM b_jobs WHERE country = 'US') AS total, 20 AS "limit", 10 AS "offset", 20 AS returned_count FROM b_jobs WHERE country = 'US' ORDER BY posted_date DESC, organization, job_id LIMIT 20 OFFSET 10""")
def _(b):
    return O.page_envelope(E.search_jobs(b.postings, country="US"), O.jobs_page_order(), 20, 10).select("job_id", "total", "limit", "offset", F.col("returned_count").cast("int").alias("returned_count"))


@query("flt1_search_jobs", "SELECT organization, job_id FROM b_jobs WHERE organization = 'ASIA' AND country = 'IN' AND employment_type = 'F' AND seniority_level = 'HIGH'")
def _(b):
    return E.search_jobs(b.postings, organization="ASIA", country="IN", employment_type="F", seniority="HIGH").select("organization", "job_id")


@query("flt2_location_like", "SELECT organization, job_id, location FROM b_jobs WHERE lower(location) LIKE lower('%nation_1_, auto%')")
def _(b):
    return E.search_jobs(b.postings, location="nation_1_, AUTO").select("organization", "job_id", "location")


@query("flt3_capability_member", "SELECT organization, job_id FROM b_jobs WHERE job_id IN (SELECT job_id FROM b_caps WHERE lower(capability) = 'promo')")
def _(b):
    return E.search_jobs(b.jobs, capability="Promo").select("organization", "job_id")


@query("flt4_count_jobs", "SELECT count(*) AS total FROM b_jobs WHERE country = 'CA' AND lower(location) LIKE '%machinery%'")
def _(b):
    return E.count_jobs(b.postings, country="CA", location="machinery")


@query("srt1_jobs_page", "SELECT organization, job_id, strftime(posted_date, '%Y-%m-%d') AS posted_date FROM b_jobs ORDER BY b_jobs.posted_date DESC, organization, job_id LIMIT 100 OFFSET 50")
def _(b):
    return O.page(b.postings, O.jobs_page_order(), 100, 50).select("organization", "job_id", day("posted_date"))


@query("srt2_analytics_order", "SELECT job_id, row_number() OVER (ORDER BY posted_date, job_id) AS position FROM b_jobs WHERE organization = 'AFRICA'")
def _(b):
    return O.numbered(S.scan(b.postings, "AFRICA").select("job_id", "posted_date"), O.analytics_order()).select("job_id", "position")


@query("srt3_runs_page", "SELECT run_id, organization FROM b_runs ORDER BY completed_at DESC, started_at DESC, run_id DESC LIMIT 15")
def _(b):
    return O.page(b.runs, O.runs_order(), 15).select("run_id", "organization")


@query("srt4_ranked_capabilities", """
SELECT organization, value AS capability, job_count, row_number() OVER (PARTITION BY organization ORDER BY job_count DESC, value) AS position FROM b_counts WHERE family = 'capability'""")
def _(b):
    c = A.concentration(b.jobs, "capability")
    return c.select("organization", "capability", "job_count", F.row_number().over(Window.partitionBy("organization").orderBy(*O.rank(c, "job_count", "capability"))).alias("position"))


@query("srt6_signal_order", "SELECT signal_id, row_number() OVER (PARTITION BY organization ORDER BY signal_type, title, signal_id) AS position FROM b_hsig")
def _(b):
    return b.hiring_signals.select("signal_id", F.row_number().over(Window.partitionBy("organization").orderBy(*O.signal_order())).alias("position"))


@query("srt10_top_cities", """
SELECT organization, value AS city, job_count FROM (SELECT *, row_number() OVER (PARTITION BY organization ORDER BY job_count DESC, value) AS n FROM b_counts WHERE family = 'city') WHERE n <= 7""")
def _(b):
    c = A.concentration(b.postings.withColumn("capability_classifications", F.array().cast("array<string>")), "city")
    return O.top_n(c, ["organization"], O.rank(c, "job_count", "city"), 7).select("organization", "city", "job_count")


@query("joi2_jobs_with_latest", """
SELECT j.organization, j.job_id, coalesce(l.prompt_schema_version, '') AS version, l.job_id IS NOT NULL AS available FROM b_jobs j LEFT JOIN b_latest l USING (job_id)""")
def _(b):
    return E.job_intelligence(b.jobs, b.latest).select("organization", "job_id", F.coalesce("prompt_schema_version", F.lit("")).alias("version"), "available")


@query("prj36_job_intelligence", """
SELECT j.job_id, j.title, j.country, coalesce(j.seniority_level, '') AS seniority_level, l.job_id IS NOT NULL AS available, coalesce(l.business_unit, '') AS enriched_business_unit, coalesce(l.confidence, 0.0) AS confidence
FROM b_jobs j LEFT JOIN b_latest l USING (job_id)""")
def _(b):
    j = E.job_intelligence(b.jobs, b.latest)
    return j.select("job_id", "title", "country", F.coalesce("seniority_level", F.lit("")).alias("seniority_level"), "available", F.coalesce("enriched_business_unit", F.lit("")).alias("enriched_business_unit"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("joi3_enrichments_of_organization", "SELECT count(*) AS versions, count(DISTINCT job_id) AS jobs FROM b_enr JOIN b_jobs USING (job_id) WHERE organization = 'ASIA'")
def _(b):
    own = S.scan(b.postings, "ASIA").select("job_id")
    return b.enrichments.join(own, "job_id").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("job_id").alias("jobs"))


@query("joi4_exact_enrichment", "SELECT job_id, evidence_id, provider, model, prompt_schema_version FROM b_enr WHERE provider = 'A' AND model = 'F' AND prompt_schema_version LIKE 'v1.%'")
def _(b):
    keys = b.enrichments.filter("provider = 'A' AND model = 'F' AND prompt_schema_version LIKE 'v1.%'").select(*S.ENRICHMENT_KEY)
    return S.lookup_batch(b.enrichments, keys).select(*S.ENRICHMENT_KEY)


@query("win1_latest_enrichment", "SELECT job_id, evidence_id, provider, model, prompt_schema_version FROM b_latest")
def _(b):
    return b.latest.select(*S.ENRICHMENT_KEY)


@query("src6_organization_scan", "SELECT job_id, source_url FROM b_jobs WHERE organization = 'MIDDLE EAST'")
def _(b):
    return S.scan(b.postings, "MIDDLE EAST").select("job_id", "source_url")


@query("src7_point_lookup", "SELECT organization, job_id, title FROM b_jobs WHERE organization = 'ASIA' AND job_id IN (SELECT job_id FROM b_jobs WHERE country = 'AU')")
def _(b):
    keys = b.postings.filter("country = 'AU'").select("job_id")
    return S.lookup_batch(S.lookup(b.postings, organization="ASIA"), keys).select("organization", "job_id", "title")


@query("agg36_collection_context", """
SELECT organization, count(*) AS returned_count, arg_max(status, (completed_at, started_at, run_id)) AS latest_status FROM b_runs GROUP BY 1""")
def _(b):
    return E.collection_context(b.runs)


@query("win9_latest_run", "SELECT organization, run_id, status FROM b_lastrun")
def _(b):
    return O.latest_run(b.runs).select("organization", "run_id", "status")
