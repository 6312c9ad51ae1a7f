"""Technology observations, aggregates and signals of every organization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions import lexicons as L
from signalloom.functions.ids import uuid5
from signalloom.functions.numbers import days_between, general_format, ratio, unit
from signalloom.functions.text import as_col, bound, casefold, chained, lookup, squash
from signalloom.operators.analytics import distinct_evidence
from signalloom.operators.terms import WINDOW, listed, term_excerpts

KEYWORD_PROVIDER, KEYWORD_MODEL, KEYWORD_VERSION, KEYWORD_CONFIDENCE = "keyword_match", "technology_keywords_v1", "persisted_source_keyword_match_v1", 0.6


def normalize_technology(value, names: Mapping[str, str] = L.TECHNOLOGY_NAMES) -> Column:
    """Preferred spelling of a technology."""
    return bound(squash(value), lambda compact: F.coalesce(lookup(names, casefold(compact)), compact))


def categorize_technology(value, categories: Mapping[str, str] = L.TECHNOLOGY_CATEGORIES) -> Column:
    return F.coalesce(lookup(categories, value), F.lit("Other"))


def jobs_with_evidence(jobs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Jobs joined to their evidence; jobs without evidence are left out."""
    return jobs.join(evidence, "evidence_id")


def enriched_jobs(jobs: DataFrame, evidence: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per job with evidence, its latest enrichment attached where that cites the same evidence.

    ``latest`` holds one enrichment per job (``latest_enrichment``). The newest version is chosen
    first; when it cites other evidence the job is not enriched. ``sole`` tells that no other row has the job's id or
    evidence (``intelligence_rows``).
    """
    chosen = latest.select(
        "job_id",
        F.struct(
            "evidence_id", "provider", "model", "prompt_schema_version", "enrichment_timestamp", "technologies", "business_unit", "seniority_level",
            "confidence", "field_confidences", "field_support",
        ).alias("enrichment"),
    )
    has = evidence.select("evidence_id", "source_type")
    alone = lambda key: F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
    named = jobs.join(chosen, "job_id", "left").withColumn("_named_once", alone("job_id"))
    joined = named.join(has, "evidence_id").withColumn("sole", F.col("_named_once") & alone("evidence_id")).drop("_named_once")
    valid = F.coalesce(F.col("enrichment.evidence_id") == F.col("evidence_id"), F.lit(False))
    return joined.withColumn("is_enriched", valid)


def _first_by(array: Column, key: str) -> Column:
    """Array of structs without later entries of an equal key."""
    keys = F.transform(array, lambda x: x[key])
    return F.filter(array, lambda x, i: F.array_position(keys, x[key]) == i + 1)


def observed(rows: DataFrame, names: Mapping[str, str] = L.TECHNOLOGY_NAMES) -> DataFrame:
    """Add ``observations``: enrichment technologies first, keyword ones only when not seen in the job.

    Works on arrays within the job row, so no shuffle follows the joins of ``enriched_jobs``; rows
    that carry the column already are returned as they are.
    """
    if "observations" in rows.columns:
        return rows
    none = F.array().cast("array<string>")
    normalized = lambda array: F.transform(F.coalesce(array, none), lambda t: F.struct(t.alias("technology"), normalize_technology(t, names).alias("normalized")))
    shaped = lambda array, source: F.filter(
        F.transform(normalized(array), lambda t: F.struct(t["technology"].alias("technology"), t["normalized"].alias("normalized"), casefold(t["normalized"]).alias("key"), F.lit(source).alias("source"))),
        lambda o: F.coalesce(o["normalized"] != "", F.lit(False)),
    )
    own = F.when(F.col("is_enriched"), F.col("enrichment.technologies"))
    return rows.withColumn("_candidates", chained(shaped(own, "enrichment"), shaped(F.col("technologies"), "keyword"))).withColumn(
        "observations", _first_by(F.col("_candidates"), "key")
    ).drop("_candidates")


def observed_names(rows: DataFrame, names: Mapping[str, str] = L.TECHNOLOGY_NAMES) -> DataFrame:
    """Job, evidence and normalised technology of every row of ``observations``, without provenance."""
    seen = observed(rows, names).select("organization", "job_id", "evidence_id", F.explode_outer("observations.normalized").alias("normalized_technology"))
    return seen.filter("normalized_technology IS NOT NULL")


def observations(
    rows: DataFrame, names=L.TECHNOLOGY_NAMES, categories=L.TECHNOLOGY_CATEGORIES, terms: Mapping[str, Sequence[str]] = L.TECHNOLOGY_TERMS,
    cased_terms: Mapping[str, Sequence[str]] = L.CASED_TECHNOLOGY_TERMS, text_cols: Sequence[str] = ("title", "description"), window: int = WINDOW,
) -> DataFrame:
    """One row per job and normalised technology with provenance.

    Enrichment observations cite their supporting excerpts; keyword observations the text around the first match
    of the technology's forms in the job's own texts.
    """
    from_enrichment = F.col("o.source") == "enrichment"
    enrichment = F.col("enrichment")
    pick = lambda field, other: F.when(from_enrichment, enrichment[field]).otherwise(other)
    keywords = F.transform(F.filter("observations", lambda o: o["source"] == "keyword"), lambda o: o["technology"])
    cited = observed(rows, names).withColumn("_keywords", keywords)
    cited = cited.withColumn("_excerpts", term_excerpts("_keywords", text_cols, listed(terms, cased_terms), window))
    cut = F.when(~from_enrichment, F.try_element_at("_excerpts", F.array_position("_keywords", F.col("o.technology")).cast("int")))
    return (
        cited.withColumn("o", F.explode_outer("observations")).filter("o IS NOT NULL")
        .select(
            "organization", "job_id", "evidence_id", F.col("title").alias("job_title"), "source_type",
            F.col("o.technology").alias("technology"),
            F.col("o.normalized").alias("normalized_technology"),
            categorize_technology("o.normalized", categories).alias("category"),
            F.col("posted_date").alias("observation_date"), "location",
            F.when(from_enrichment, F.coalesce(F.nullif(enrichment["business_unit"], F.lit("")), F.col("business_unit"))).otherwise(F.col("business_unit")).alias("business_unit"),
            pick("seniority_level", F.lit("unknown")).alias("seniority"),
            F.when(from_enrichment, F.coalesce(F.try_element_at(enrichment["field_confidences"], F.lit("technologies")), enrichment["confidence"])).otherwise(F.lit(KEYWORD_CONFIDENCE)).alias("confidence"),
            pick("provider", F.lit(KEYWORD_PROVIDER)).alias("provider"),
            pick("model", F.lit(KEYWORD_MODEL)).alias("model"),
            pick("prompt_schema_version", F.lit(KEYWORD_VERSION)).alias("prompt_schema_version"),
            pick("enrichment_timestamp", F.lit(None).cast("timestamp")).alias("enrichment_timestamp"),
            F.when(
                from_enrichment,
                F.filter(
                    F.coalesce(enrichment["field_support"], F.array().cast("array<struct<field:string,value:string,excerpt:string,evidence_id:string>>")),
                    lambda s: (s["field"] == "technologies") & (casefold(normalize_technology(s["value"], names)) == F.col("o.key")) & (s["evidence_id"] == F.col("evidence_id")),
                ),
            ).alias("_support"),
            cut.alias("_cut"),
        )
        .withColumn(
            "support",
            F.when(F.size("_support") > 0, F.transform("_support", lambda s: F.struct(s["evidence_id"].alias("evidence_id"), s["excerpt"].alias("excerpt"))))
            .otherwise(F.array(F.struct(F.col("evidence_id").alias("evidence_id"), F.col("_cut").alias("excerpt")))),
        )
        .drop("_support", "_cut")
    )


# --- aggregates -----------------------------------------------------------------------------

TAB_FAMILIES = ("business_unit", "location", "seniority")


def tech_facet_array(categories=L.TECHNOLOGY_CATEGORIES, families: Sequence[str] = ("technology", "category", *TAB_FAMILIES)) -> Column:
    """A job's technology facets, read off its ``observations``; also one ``total`` entry."""
    unit_value = F.coalesce(F.nullif(F.col("enrichment.business_unit"), F.lit("")), F.col("business_unit"))
    category = lambda o: categorize_technology(o["normalized"], categories)
    entry = lambda family, label, tech, cat, n: F.struct(
        F.lit(family).alias("family"), label.cast("string").alias("label"), tech.cast("string").alias("technology"), cat.cast("string").alias("category"), n.cast("long").alias("observations")
    )
    null, one = F.lit(None), F.lit(1)
    usable = lambda label: label.isNotNull() & (label != "unknown")
    labels = {
        "business_unit": lambda o: F.when(o["source"] == "enrichment", unit_value).otherwise(F.col("business_unit")),
        "location": lambda o: F.col("location"),
        "seniority": lambda o: F.when(o["source"] == "enrichment", F.col("enrichment.seniority_level")),
    }
    seen = F.col("observations")
    def tabbed(family):
        made = F.transform(seen, lambda o: entry(family, labels[family](o), o["normalized"], null, one))
        return F.filter(made, lambda e: usable(e["label"]))

    # Two spellings that differ only in case stay one observation per job, so values are distinct already.
    parts = [F.array(entry("total", null, null, null, F.size(seen)))]
    if "technology" in families:
        parts.append(F.transform(seen, lambda o: entry("technology", o["normalized"], o["normalized"], category(o), one)))
    if "category" in families:
        cats = F.transform(seen, category)
        parts.append(F.transform(F.array_distinct(cats), lambda c: entry("category", c, null, c, F.size(F.filter(cats, lambda x: x == c)))))
    for family in TAB_FAMILIES:
        if family in families:
            parts.append(tabbed(family))
    return chained(*parts)


def tech_facets(rows: DataFrame, names=L.TECHNOLOGY_NAMES, categories=L.TECHNOLOGY_CATEGORIES, families: Sequence[str] = ("technology", "category", *TAB_FAMILIES)) -> DataFrame:
    """One row per job and technology facet: ``(organization, family, label, technology, category, observations, job_id, evidence_id)``.

    Facets are distinct within a job. Also emits one ``total`` row per job with its flags.
    """
    sole = ["sole"] if "sole" in rows.columns else []
    return observed(rows, names).select(
        "organization", "job_id", "evidence_id", "is_enriched", "posted_date", *sole, F.explode_outer(tech_facet_array(categories, families)).alias("f")
    ).select("organization", "f.*", "job_id", "evidence_id", "is_enriched", *sole)


def tech_counts(facets: DataFrame) -> DataFrame:
    """Jobs, observations and distinct evidence per facet."""
    return facets.groupBy("organization", "family", "label", "technology", "category").agg(
        F.count(F.lit(1)).alias("job_count"),
        F.sum("observations").alias("observation_count"),
        F.count_if("is_enriched").alias("enriched_count"),
        F.count_if(F.col("observations") > 0).alias("signal_jobs"),
        distinct_evidence(facets).alias("evidence_count"),
    )


def with_tech_totals(counts: DataFrame) -> DataFrame:
    """Organization-wide enriched jobs, jobs with a technology, observations and unique technologies on every row."""
    org = Window.partitionBy("organization")
    total = F.col("family") == "total"
    pick = lambda c: F.coalesce(F.max(F.when(total, F.col(c))).over(org), F.lit(0))
    by_category = Window.partitionBy("organization", "category")
    return counts.withColumns(
        {
            "enriched_jobs": pick("enriched_count"),
            "jobs_with_signal": pick("signal_jobs"),
            "total_observations": pick("observation_count"),
            "unique_technologies": F.count_if(F.col("family") == "technology").over(org),
            "category_technologies": F.count_if(F.col("family") == "technology").over(by_category),
        }
    )


def top_technologies(counts: DataFrame) -> DataFrame:
    """Distinct jobs, observations, evidence and clamped percentages per technology."""
    share = lambda base: F.least(ratio("job_count", base) * 100, F.lit(100.0))
    return with_tech_totals(counts).filter("family = 'technology'").select(
        "organization", "technology", "category", "job_count", "observation_count", "evidence_count",
        share("enriched_jobs").alias("percentage_of_enriched_jobs"),
        share("jobs_with_signal").alias("percentage_of_technology_classified_jobs"),
    )


def tech_categories(counts: DataFrame) -> DataFrame:
    return with_tech_totals(counts).filter("family = 'category'").select(
        "organization", "category", F.col("category_technologies").alias("unique_technology_count"), "observation_count", "job_count"
    )


def cross_tab(counts: DataFrame, family: str) -> DataFrame:
    """Jobs per label and technology; null and the literal ``unknown`` labels are left out."""
    return counts.filter(F.col("family") == family).select("organization", F.col("label").alias(family), "technology", "job_count")


def tech_snapshot(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """Totals and unrounded coverages; jobs without evidence still count in the total."""
    totals = jobs.groupBy("organization").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.min("posted_date").alias("observation_start"), F.max("posted_date").alias("observation_end")
    )
    figures = with_tech_totals(counts).filter("family = 'total'").select("organization", "enriched_jobs", "jobs_with_signal", F.col("total_observations").alias("technology_observation_count"), "unique_technologies")
    return totals.join(figures, "organization", "left").na.fill(0, ["enriched_jobs", "jobs_with_signal", "technology_observation_count", "unique_technologies"]).withColumns(
        {
            "technology_coverage_percentage": ratio("enriched_jobs", "total_jobs") * 100,
            "technology_signal_coverage_percentage": ratio("jobs_with_signal", "total_jobs") * 100,
        }
    )


# --- signals --------------------------------------------------------------------------------


@dataclass(frozen=True)
class TechnologyThresholds:
    minimum_enriched_jobs: int = 5
    minimum_enrichment_coverage: float = 0.25
    minimum_observations: int = 5
    minimum_contributing_jobs: int = 3
    technology_minimum_concentration: float = 0.4
    category_minimum_concentration: float = 0.4
    category_minimum_unique_technologies: int = 2
    context_minimum_concentration: float = 0.4
    cluster_minimum_unique_technologies: int = 3
    cluster_minimum_observations: int = 5
    limited_observation_window_days: int = 28
    small_enriched_sample: int = 10
    single_hiring_source: bool = True
    configuration_version: str = "technology-signals-v1"


def signal_limitations(t: TechnologyThresholds, coverage: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(coverage < 1, F.lit("Technology classifications cover only a subset of observed hiring records.")),
            F.when(F.col("enriched_jobs") < t.small_enriched_sample, F.lit("The enriched hiring sample is small.")),
            F.when(days_between("observation_end", "observation_start") < t.limited_observation_window_days, F.lit("The observation period is limited.")),
            F.when(F.lit(t.single_hiring_source), F.lit("Observations derive from a single public hiring source.")),
            F.lit("Technology classifications are derived from hiring evidence and do not prove production deployment."),
            F.lit("Concentration does not imply enterprise technology adoption."),
            F.lit("Absence from observed hiring does not prove absence from the organization."),
        )
    )


def foundation(snapshot: DataFrame, t: TechnologyThresholds | None = None) -> DataFrame:
    """Snapshot rows with coverage, the foundation gate and the result limitations."""
    t = t or TechnologyThresholds()
    coverage = ratio("enriched_jobs", "total_jobs")
    few = F.array_compact(
        F.array(
            F.when(F.col("enrichment_coverage") < t.minimum_enrichment_coverage, F.lit("Enrichment coverage is below the configured minimum for reliable technology signal generation.")),
            F.when(F.col("enriched_jobs") < t.minimum_enriched_jobs, F.lit("The enriched hiring sample is smaller than the configured minimum.")),
            F.when(F.col("technology_observation_count") < t.minimum_observations, F.lit("Too few technology observations are available for signal generation.")),
        )
    )
    based = snapshot.withColumn("enrichment_coverage", coverage)
    return based.withColumns(
        {
            "sufficient": (F.col("enriched_jobs") >= t.minimum_enriched_jobs)
            & (F.col("enrichment_coverage") >= t.minimum_enrichment_coverage)
            & (F.col("technology_observation_count") >= t.minimum_observations)
            & F.col("observation_start").isNotNull(),
            "result_limitations": F.array_distinct(F.concat(few, signal_limitations(t, F.col("enrichment_coverage")))),
        }
    )


def technology_signals(snapshot: DataFrame, counts: DataFrame, thresholds: TechnologyThresholds | None = None) -> DataFrame:
    """Technology, category, business-unit, geographic and cluster signals of organizations with a sound foundation."""
    t = thresholds or TechnologyThresholds()
    sound = foundation(snapshot, t).filter("sufficient").select("organization", "total_jobs", "observation_start", "observation_end", "enrichment_coverage")
    # Only facets that enough jobs support can become signals, so the rest goes before the join.
    rows = with_tech_totals(counts).filter((F.col("job_count") >= t.minimum_contributing_jobs) & F.col("family").isin("technology", "category", "business_unit", "location"))
    kinds = F.when(F.col("family") == "category", F.array(F.lit("category"), F.lit("cluster"))).otherwise(F.array(F.col("family")))
    rows = rows.join(sound, "organization").withColumn("kind", F.explode(kinds))
    kind = F.col("kind")
    share = F.least(ratio("job_count", "enriched_jobs") * 100, F.lit(100.0))
    of_enriched = ratio("job_count", "enriched_jobs")
    of_observations = ratio("observation_count", "total_observations")
    context = kind.isin("business_unit", "location")
    strength = (
        F.when(kind == "technology", unit(share / 100)).when(kind == "category", of_observations).when(context, of_enriched)
        .otherwise(unit(F.col("category_technologies") / (t.cluster_minimum_unique_technologies * 2)))
    )
    gate = (
        F.when(kind == "technology", F.col("strength") >= t.technology_minimum_concentration)
        .when(kind == "category", (F.col("category_technologies") >= t.category_minimum_unique_technologies) & (F.col("strength") >= t.category_minimum_concentration))
        .when(context, F.col("strength") >= t.context_minimum_concentration)
        .otherwise((F.col("category_technologies") >= t.cluster_minimum_unique_technologies) & (F.col("observation_count") >= t.cluster_minimum_observations))
    )
    kept = rows.withColumns({"strength": strength, "_share": share}).filter(gate)
    signal_type = (
        F.when(kind == "technology", F.lit("technology_concentration"))
        .when(kind == "category", F.lit("technology_category_concentration"))
        .when(kind == "business_unit", F.lit("business_unit_technology_concentration"))
        .when(kind == "location", F.lit("geographic_technology_concentration"))
        .otherwise(F.lit("technology_hiring_cluster"))
    )
    label, technology, jobs = F.col("label"), F.col("technology"), F.col("job_count")
    subject = F.when(context, F.concat(label, F.lit(":"), technology)).otherwise(label)
    title = (
        F.when(kind == "technology", F.concat(F.lit("Observed hiring concentration for "), label))
        .when(kind == "category", F.format_string("Observed %s hiring concentration", label))
        .when(context, F.format_string("Observed %s hiring cluster in %s", technology, label))
        .otherwise(F.concat(F.lit("Observed technology hiring cluster in "), label))
    )
    summary = (
        F.when(kind == "technology", F.format_string(
            "Within the currently enriched hiring sample, %s appears in %d enriched job records (%s%% of enriched jobs). This is an observed hiring concentration, not evidence of enterprise adoption.",
            label, jobs, general_format("_share")))
        .when(kind == "category", F.format_string(
            "Within the currently enriched hiring sample, %s accounts for %d of %d technology observations across %d jobs. Concentration in hiring evidence does not establish organization-wide technology strategy.",
            label, F.col("observation_count"), F.col("total_observations"), jobs))
        .when(context, F.format_string(
            "Within the currently enriched hiring sample, %s appears in %d job records associated with %s. This describes observed hiring evidence and does not prove production deployment.",
            technology, jobs, label))
        .otherwise(F.format_string(
            "The currently enriched hiring evidence contains %d distinct %s technologies across %d jobs. This is a hiring cluster observation, not an enterprise technology strategy claim.",
            F.col("category_technologies"), label, jobs))
    )
    evidence = ratio("evidence_count", "job_count")
    sufficiency = unit(jobs / (t.minimum_contributing_jobs * 2))
    identity = F.concat_ws("|", "organization", "signal_type", "subject", F.col("observation_start").cast("string"), F.col("observation_end").cast("string"), F.lit(t.configuration_version))
    return kept.withColumns({"signal_type": signal_type, "subject": subject, "title": title, "summary": summary}).select(
        "organization", uuid5(identity).alias("signal_id"), "signal_type", "subject", "title", "summary",
        unit("strength").alias("strength"),
        unit((F.col("enrichment_coverage") + evidence + sufficiency) / 3).alias("confidence"),
        evidence.alias("evidence_coverage"),
        "observation_start", "observation_end",
        signal_limitations(t, F.col("enrichment_coverage")).alias("limitations"),
        "job_count", "evidence_count", "family", "label", "technology",
    )


def technology_signal_support(facets: DataFrame, signals: DataFrame) -> DataFrame:
    """Supporting records of every technology signal, one row each."""
    chosen = signals.select("organization", "family", "label", F.coalesce("technology", F.lit("")).alias("_tech"), "signal_id", "signal_type", "title")
    members = facets.filter(F.col("family") != "total").withColumn("_tech", F.coalesce("technology", F.lit("")))
    return members.join(chosen, ["organization", "family", "label", "_tech"]).select("organization", "signal_id", "signal_type", "title", "job_id", "evidence_id")
