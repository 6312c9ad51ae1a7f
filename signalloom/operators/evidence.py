"""Unified evidence: the denormalised view, its reverse index, summaries and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions.numbers import pct
from signalloom.functions.text import as_col, casefold, nonblank, preview, squash


def evidence_source(provenance="provenance_metadata", collector="collector_identity") -> Column:
    """Source system named in the provenance, else the collector."""
    named = F.get_json_object(as_col(provenance), "$.source_system")
    return F.coalesce(F.when(nonblank(named).isNotNull(), named), as_col(collector))


def evidence_links(hiring_support: DataFrame, technology_support: DataFrame, observations: DataFrame, sole: bool = False) -> DataFrame:
    """Signals and observations per evidence: ``(evidence_id, hiring_signals, technology_signals, observation_count)``.

    Rows of ``sole`` jobs (``intelligence_rows``) are distinct already, so they are summed within the task at once.
    """
    if sole:
        hiring, technology, seen = (frame.select("evidence_id") for frame in (hiring_support, technology_support, observations))
    else:
        hiring = hiring_support.select("evidence_id", "signal_id").distinct()
        technology = technology_support.select("evidence_id", "signal_id").distinct()
        seen = observations.select("evidence_id", F.concat_ws("\u0001", "job_id", "normalized_technology").alias("signal_id")).distinct()
    kinds = {"hiring": hiring, "technology": technology, "observation": seen}
    rows = reduce(DataFrame.unionByName, [frame.select("evidence_id", F.lit(kind).alias("kind")) for kind, frame in kinds.items()])
    return rows.groupBy("evidence_id").agg(
        F.count_if(F.col("kind") == "hiring").alias("hiring_signal_count"),
        F.count_if(F.col("kind") == "technology").alias("technology_signal_count"),
        F.count_if(F.col("kind") == "observation").alias("technology_observation_count"),
    )


def signal_references(support: Mapping[str, DataFrame], sole: bool = False) -> DataFrame:
    """Signals of every domain citing each evidence, one row each, in reference order by type, title and id.

    Rows of ``sole`` jobs (``intelligence_rows``) are distinct already.
    """
    cited = [frame.select("organization", "evidence_id", F.lit(domain).alias("domain"), "signal_type", "title", "signal_id") for domain, frame in support.items()]
    return reduce(DataFrame.unionByName, cited if sole else [frame.distinct() for frame in cited])


def unified_evidence(jobs: DataFrame, evidence: DataFrame, latest: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One wide row per job with evidence.

    The latest enrichment of the job is shown whatever evidence it cites, and its business unit
    replaces the job's even when null.
    """
    enrichment = latest.select("job_id", F.struct(*[c for c in ENRICHMENT_FIELDS if c in latest.columns]).alias("enrichment"))
    own = jobs.select("organization", "job_id", "evidence_id", "title", "location", "business_unit", "posted_date")
    source = evidence.select("evidence_id", evidence_struct().alias("evidence"))
    return unified_rows(own.join(source, "evidence_id").join(enrichment, "job_id", "left"), links)


ENRICHMENT_FIELDS = (
    "evidence_id provider model prompt_schema_version enrichment_timestamp technologies capability_classifications skills business_unit seniority_level "
    "confidence field_confidences field_support source_content_hash"
).split()


EVIDENCE_FIELDS = ("source_type", "source_url", "retrieved_at", "source_excerpt", "raw_reference", "collector_identity", "source")


def evidence_struct(fields: Sequence[str] = EVIDENCE_FIELDS) -> Column:
    return F.struct(*[evidence_source().alias("source") if f == "source" else f for f in fields])


def unified_rows(joined: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The wide view over jobs that carry ``evidence`` and ``enrichment`` structs already; what they were read without is left out."""
    has, none = F.col("enrichment").isNotNull(), F.array().cast("array<string>")
    known = {name: joined.schema[name].dataType.names for name in ("evidence", "enrichment")}
    of = lambda struct, names: [F.col(struct)[field].alias(name) for name, field in names.items() if field in known[struct]]
    listed = {"technologies": "technologies", "capabilities": "capability_classifications", "skills": "skills"}
    wide = joined.select(
        "evidence_id", "organization", *of("evidence", {"source": "source", "source_type": "source_type", "source_url": "source_url", "captured_at": "retrieved_at"}),
        F.col("posted_date").alias("observed_at"), "job_id", *[F.col(c).alias(f"job_{c}") for c in ("title", "location") if c in joined.columns],
        F.when(has, F.col("enrichment")["business_unit"]).otherwise(F.col("business_unit")).alias("business_unit"),
        has.alias("enrichment_present"),
        *of("enrichment", {"enrichment_provider": "provider", "enrichment_model": "model", "enrichment_schema_version": "prompt_schema_version", "application_confidence": "confidence"}),
        *[F.coalesce(F.col("enrichment")[field], none).alias(name) for name, field in listed.items() if field in known["enrichment"]],
        *of("enrichment", {"seniority": "seniority_level"}),
        *[preview(c).alias("evidence_preview") for c in of("evidence", {"source_excerpt": "source_excerpt"})],
        *of("evidence", {"source_excerpt": "source_excerpt", "raw_reference": "raw_reference", "collector_identity": "collector_identity"}),
    )
    if links is None:
        return wide
    return wide.join(links, "evidence_id", "left").na.fill(0, ["hiring_signal_count", "technology_signal_count", "technology_observation_count"])


def intelligence_rows(jobs: DataFrame, evidence: DataFrame, latest: DataFrame | None, cited: Sequence[str] = EVIDENCE_FIELDS) -> DataFrame:
    """Every job with its evidence and latest enrichment as structs: the one table all later steps read.

    The structs hold the ``cited`` fields of the evidence and the columns ``latest`` has; without its evidence nothing tells whether a job is enriched.

    ``sole`` tells that no other row has the job's id or cites its evidence: what is distinct within such a row is
    distinct in the table and needs no comparison with other rows. The counts share the shuffles of the joins on the
    same two keys: by job first, where the jobs may lie already, then by evidence.
    """
    source = evidence.select("evidence_id", evidence_struct(cited).alias("evidence"))
    alone = lambda key: F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
    rows = jobs
    if latest is not None:
        enrichment = latest.select("job_id", F.struct(*[c for c in ENRICHMENT_FIELDS if c in latest.columns]).alias("enrichment"))
        rows = rows.join(enrichment, "job_id", "left")
    joined = rows.withColumn("_named_once", alone("job_id")).join(source, "evidence_id", "left").withColumn("sole", F.col("_named_once") & alone("evidence_id")).drop("_named_once")
    if latest is None or "evidence_id" not in latest.columns:
        return joined.withColumn("source_type", F.col("evidence.source_type"))
    return joined.withColumns(
        {
            "is_enriched": F.coalesce((F.col("enrichment.evidence_id") == F.col("evidence_id")) & F.col("evidence").isNotNull(), F.lit(False)),
            "source_type": F.col("evidence.source_type"),
        }
    )


def evidence_summary(jobs: DataFrame, unified: DataFrame) -> DataFrame:
    """Records, coverage, enrichment and support counts per organization."""
    totals = jobs.groupBy("organization").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.min("posted_date").alias("observation_start"), F.max("posted_date").alias("observation_end")
    )
    figures = unified.groupBy("organization").agg(
        F.count(F.lit(1)).alias("total_evidence_records"),
        F.count_distinct("job_id").alias("jobs_with_evidence"),
        F.count_if("enrichment_present").alias("enriched_evidence_count"),
        F.count_if(F.col("hiring_signal_count") > 0).alias("evidence_supporting_hiring_signals"),
        F.count_if(F.col("technology_observation_count") > 0).alias("evidence_supporting_technology_observations"),
        F.count_if(F.col("technology_signal_count") > 0).alias("evidence_supporting_technology_signals"),
        F.max("captured_at").alias("latest_capture"),
    )
    counts = [c for c in figures.columns if c not in ("organization", "latest_capture")]
    return totals.join(figures, "organization", "left").na.fill(0, counts).withColumns(
        {
            "evidence_coverage": pct("jobs_with_evidence", "total_jobs"),
            "enrichment_coverage": pct("enriched_evidence_count", "total_evidence_records"),
        }
    )


def source_distribution(unified: DataFrame) -> DataFrame:
    return unified.groupBy("organization", "source", "source_type").agg(F.count(F.lit(1)).alias("evidence_count"))


def _has(value, needle: str) -> Column:
    return F.contains(casefold(value), F.lit(needle.casefold()))


def search_evidence(unified: DataFrame, organization=None, search=None, source=None, enriched=None, technology=None, capability=None, location=None, job_id=None) -> DataFrame:
    """Evidence records under optional filters, all of which must hold; the search reads the whole source text."""
    out = unified if organization is None else unified.filter(F.col("organization") == organization)
    if search:
        text = F.concat_ws(" ", "job_title", "job_location", F.coalesce(squash("source_excerpt"), F.lit("")), F.array_join("technologies", " "), F.array_join("capabilities", " "))
        out = out.filter(_has(text, search))
    if source:
        out = out.filter(_has("source", source))
    if enriched is not None:
        out = out.filter(F.col("enrichment_present") == enriched)
    if technology:
        out = out.filter(F.exists("technologies", lambda v: _has(v, technology)))
    if capability:
        out = out.filter(F.exists("capabilities", lambda v: _has(v, capability)))
    if location:
        out = out.filter(_has("job_location", location))
    if job_id:
        out = out.filter(F.col("job_id") == job_id)
    return out


def search_observations(observations: DataFrame, organization=None, technology=None, category=None, business_unit=None, location=None) -> DataFrame:
    """Observations under optional filters; the category must match exactly."""
    out = observations if organization is None else observations.filter(F.col("organization") == organization)
    if technology:
        out = out.filter(_has("normalized_technology", technology))
    if category:
        out = out.filter(F.col("category") == category)
    if business_unit:
        out = out.filter(F.coalesce(_has("business_unit", business_unit), F.lit(False)))
    if location:
        out = out.filter(_has("location", location))
    return out


def search_jobs(jobs: DataFrame, organization=None, country=None, employment_type=None, location=None, capability=None, seniority=None) -> DataFrame:
    """Jobs under optional filters; ``%`` and ``_`` in the location act as wildcards."""
    out = jobs
    for column, value in (("organization", organization), ("country", country), ("employment_type", employment_type), ("seniority_level", seniority)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if location is not None:
        out = out.filter(F.lower("location").like("%" + location.lower().replace("\\", "\\\\") + "%"))
    if capability is not None:
        out = out.filter(F.exists("capability_classifications", lambda v: F.lower(v) == capability.lower()))
    return out


def count_jobs(jobs: DataFrame, **filters) -> DataFrame:
    return search_jobs(jobs, **filters).agg(F.count(F.lit(1)).alias("total"))


def trace(unified: DataFrame, cross_support: DataFrame) -> DataFrame:
    """What cites each evidence record, and what does not.

    ``cross_support`` holds long rows with ``signal_id``, or evidence with its ``cross_domain_signal_count``.
    """
    cross = cross_support
    if "cross_domain_signal_count" not in cross.columns:
        cross = cross.select("evidence_id", "signal_id").distinct().groupBy("evidence_id").agg(F.count(F.lit(1)).alias("cross_domain_signal_count"))
    joined = unified.join(cross, "evidence_id", "left").na.fill(0, ["cross_domain_signal_count"])
    return joined.withColumn(
        "limitations",
        F.array_compact(
            F.array(
                F.when(~F.col("enrichment_present"), F.lit("No persisted enrichment uses this evidence.")),
                F.when(F.col("technology_signal_count") == 0, F.lit("No technology signals currently cite this evidence.")),
                F.when(F.col("cross_domain_signal_count") == 0, F.lit("No cross-domain strategic signals currently cite this evidence.")),
            )
        ),
    ).select(
        "evidence_id", "job_id", "organization", "enrichment_present", "enrichment_provider", "enrichment_model", "enrichment_schema_version",
        "hiring_signal_count", "technology_observation_count", "technology_signal_count", "cross_domain_signal_count", "limitations",
    )


def job_intelligence(jobs: DataFrame, latest: DataFrame) -> DataFrame:
    """Compact job summary with its enrichment summary and an ``available`` flag."""
    enrichment = latest.select(
        "job_id", F.lit(True).alias("_available"), "provider", "model", "prompt_schema_version", "confidence",
        F.col("technologies").alias("enriched_technologies"), F.col("seniority_level").alias("enriched_seniority"), F.col("business_unit").alias("enriched_business_unit"),
    )
    summary = ("job_id evidence_id organization title location country business_unit capability_classifications seniority_level posted_date employment_type source_url").split()
    return jobs.select(*summary).join(enrichment, "job_id", "left").withColumn("available", F.col("_available").isNotNull()).drop("_available")


def collection_context(runs: DataFrame) -> DataFrame:
    """Runs returned and status of the latest run per organization."""
    return runs.groupBy("organization").agg(
        F.count(F.lit(1)).alias("returned_count"), F.max_by("status", F.struct("completed_at", "started_at", "run_id")).alias("latest_status")
    )
