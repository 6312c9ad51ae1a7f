"""Technology observations, aggregates and signals."""

from pyspark.sql import functions as F

from signalloom.operators import evidence as E, ordering as O, technology as T
from signalloom.plans.binding import CATEGORIES, NAMES, TECHNOLOGY
from signalloom.plans.registry import day, query


@query("prj10_normalize_technology", """
SELECT DISTINCT p_brand AS brand, CASE lower(p_brand) WHEN 'brand#1' THEN 'AWS' WHEN 'brand#2' THEN 'AWS' WHEN 'brand#3' THEN 'Oracle' ELSE p_brand END AS normalized FROM part""")
def _(b):
    return b.table("part").select(F.col("p_brand").alias("brand"), T.normalize_technology(F.concat(F.lit("  "), F.col("p_brand")), NAMES).alias("normalized")).distinct()


@query("prj11_categorize_technology", """
SELECT normalized_technology, category, count(*) AS n FROM b_obs GROUP BY ALL""")
def _(b):
    return b.observations.groupBy("normalized_technology", "category").agg(F.count(F.lit(1)).alias("n"))


@query("joi14_observations", "SELECT organization, job_id, evidence_id, technology, normalized_technology, category, coalesce(business_unit, '') AS business_unit, seniority, confidence, provider, coalesce(excerpt, '') AS excerpt FROM b_obs")
def _(b):
    return b.observations.select("organization", "job_id", "evidence_id", "technology", "normalized_technology", "category", F.coalesce("business_unit", F.lit("")).alias("business_unit"), "seniority", "confidence", "provider", F.coalesce(F.col("support")[0]["excerpt"], F.lit("")).alias("excerpt"))


@query("joi15_support_excerpts", "SELECT job_id, normalized_technology, coalesce(excerpt, '') AS excerpt, evidence_id FROM b_obs")
def _(b):
    return b.observations.select("job_id", "normalized_technology", F.coalesce(F.col("support")[0]["excerpt"], F.lit("")).alias("excerpt"), F.col("support")[0]["evidence_id"].alias("evidence_id"))


@query("joi1_jobs_with_evidence", "SELECT j.organization, count(*) AS jobs, count(DISTINCT source_type) AS types FROM b_jobs j JOIN b_evidence USING (evidence_id) GROUP BY 1")
def _(b):
    return T.jobs_with_evidence(b.postings, b.evidence.select("evidence_id", "source_type")).groupBy("organization").agg(F.count(F.lit(1)).alias("jobs"), F.count_distinct("source_type").alias("types"))


@query("agg14_technology_snapshot", """
SELECT organization, total_jobs, enriched_jobs, observations AS technology_observation_count, techs AS unique_technologies, jobs_with_signal,
  round_even(enriched_jobs / total_jobs * 100, 8) AS technology_coverage_percentage, round_even(jobs_with_signal / total_jobs * 100, 8) AS technology_signal_coverage_percentage FROM b_ttot""")
def _(b):
    s = b.tech_snapshot
    return s.select("organization", "total_jobs", "enriched_jobs", "technology_observation_count", "unique_technologies", "jobs_with_signal",
                    *[F.bround(c, 8).alias(c) for c in ("technology_coverage_percentage", "technology_signal_coverage_percentage")])


@query("agg15_top_technologies", """
SELECT c.organization, technology, category, job_count, observation_count, evidence_count, round_even(least(job_count / enriched_jobs * 100, 100.0), 8) AS percentage_of_enriched_jobs,
  round_even(least(job_count / jobs_with_signal * 100, 100.0), 8) AS percentage_of_technology_classified_jobs FROM b_tcnt c JOIN b_ttot USING (organization) WHERE family = 'technology'""")
def _(b):
    t = T.top_technologies(b.tech_counts)
    return t.select("organization", "technology", "category", "job_count", "observation_count", "evidence_count",
                    *[F.bround(c, 8).alias(c) for c in ("percentage_of_enriched_jobs", "percentage_of_technology_classified_jobs")])


@query("agg16_technology_categories", """
SELECT c.organization, c.category, cat_techs AS unique_technology_count, observation_count, job_count FROM b_tcnt c JOIN b_tcat k ON k.organization = c.organization AND k.category = c.category WHERE family = 'category'""")
def _(b):
    return T.tech_categories(b.tech_counts)


for _id, _family in (("agg17", "business_unit"), ("agg18", "location"), ("agg19", "seniority")):

    @query(f"{_id}_{_family}_cross_tab", f"SELECT organization, label AS {_family}, technology, job_count FROM b_tcnt WHERE family = '{_family}'")
    def _(b, family=_family):
        return T.cross_tab(T.tech_counts(T.tech_facets(b.rows, NAMES, CATEGORIES, [family])), family)


@query("sig9_foundation", """
SELECT organization, round_even(coverage, 8) AS enrichment_coverage, enriched_jobs >= 5 AND coverage >= 0.25 AND observations >= 5 AS sufficient,
  concat_ws(' ', CASE WHEN coverage < 1 THEN 'Technology classifications cover only a subset of observed hiring records.' END, CASE WHEN enriched_jobs < 10 THEN 'The enriched hiring sample is small.' END,
  CASE WHEN span < 28 THEN 'The observation period is limited.' END, 'Observations derive from a single public hiring source.',
  'Technology classifications are derived from hiring evidence and do not prove production deployment.', 'Concentration does not imply enterprise technology adoption.',
  'Absence from observed hiring does not prove absence from the organization.') AS result_limitations FROM b_ttot""")
def _(b):
    f = T.foundation(b.tech_snapshot, TECHNOLOGY)
    return f.select("organization", F.bround("enrichment_coverage", 8).alias("enrichment_coverage"), "sufficient", F.array_join("result_limitations", " ").alias("result_limitations"))


_COLS = "organization, signal_id, subject, title, round_even(strength, 8) AS strength, round_even(confidence, 8) AS confidence, round_even(evidence_coverage, 8) AS evidence_coverage"
for _name, _type in (
    ("sig10_technology_signals", "technology_concentration"), ("sig11_category_signals", "technology_category_concentration"), ("sig12_business_unit_signals", "business_unit_technology_concentration"),
    ("sig13_geographic_technology_signals", "geographic_technology_concentration"), ("sig14_cluster_signals", "technology_hiring_cluster"), ("sig15_all_technology_signals", None),
):

    @query(_name, f"SELECT {_COLS} FROM b_tsig" + (f" WHERE signal_type = '{_type}'" if _type else ""))
    def _(b, kind=_type):
        s = b.technology_signals if kind is None else b.technology_signals.filter(F.col("signal_type") == kind)
        return s.select("organization", "signal_id", "subject", "title", *[F.bround(c, 8).alias(c) for c in ("strength", "confidence", "evidence_coverage")])


@query("sig15_technology_signal_evidence", "SELECT organization, signal_id, job_id, evidence_id FROM b_tsup")
def _(b):
    b = b.lean("observed")
    return b.technology_support.select("organization", "signal_id", "job_id", "evidence_id")


@query("flt6_search_observations", """
SELECT organization, job_id, normalized_technology, category FROM b_obs WHERE contains(lower(normalized_technology), 'brand#1') AND category = 'Data Platform' AND contains(lower(business_unit), '1') AND contains(lower(location), 'nation')""")
def _(b):
    return E.search_observations(b.observations, technology="BRAND#1", category="Data Platform", business_unit="1", location="nation").select("organization", "job_id", "normalized_technology", "category")


@query("srt8_observation_page", """
SELECT job_id, normalized_technology, strftime(observation_date, '%Y-%m-%d') AS observation_date FROM b_obs WHERE organization = 'ASIA' ORDER BY lower(normalized_technology), b_obs.observation_date, job_id LIMIT 40 OFFSET 10""")
def _(b):
    found = E.search_observations(b.observations, organization="ASIA")
    return O.page(found, O.observation_order(), 40, 10).select("job_id", "normalized_technology", day("observation_date"))


@query("srt5_ranked_technologies", """
SELECT organization, technology, job_count, row_number() OVER (PARTITION BY organization ORDER BY job_count DESC, lower(technology), technology) AS position FROM b_tcnt WHERE family = 'technology'""")
def _(b):
    from pyspark.sql import Window

    t = T.top_technologies(b.tech_counts).select("organization", "technology", "job_count")
    return t.withColumn("position", F.row_number().over(Window.partitionBy("organization").orderBy(*O.rank(t, "job_count", "technology", fold=True))))
