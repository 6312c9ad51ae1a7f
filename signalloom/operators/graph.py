"""Provenance graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions.numbers import half_even, ratio
from signalloom.functions.text import as_col, casefold, chained, nonblank, slug
from signalloom.operators.ordering import top_n
from signalloom.session import stage

# Node and edge type names.
NODE_TYPES = ["Organization", "Job", "Evidence", "Location", "BusinessUnit", "Capability", "Technology", "Seniority", "HiringSignal", "StrategicTheme", "StrategyEvidence"]
EDGE_TYPES = [
    "HAS_JOB", "SUPPORTED_BY", "LOCATED_IN", "BELONGS_TO", "CLASSIFIED_AS", "USES_TECHNOLOGY", "HAS_SENIORITY",
    "HAS_HIRING_SIGNAL", "ABOUT_CAPABILITY", "ABOUT_BUSINESS_UNIT", "RELATED_TECHNOLOGY", "HAS_STRATEGIC_THEME",
]
PREFIXES = {"Location": "location", "BusinessUnit": "business_unit", "Capability": "capability", "Technology": "technology", "Seniority": "seniority", "StrategicTheme": "strategic_theme"}
SOURCE, KEYWORD, ENRICHED = "persisted_source", "persisted_source_keyword_match", "latest_persisted_enrichment"


def organization_id(organization) -> Column:
    return F.concat(F.lit("org:"), slug(organization))


def job_id(value) -> Column:
    return F.concat(F.lit("job:"), as_col(value))


def evidence_id(value) -> Column:
    return F.concat(F.lit("evidence:"), as_col(value))


def concept_id(prefix, organization_key, value) -> Column:
    return F.concat_ws(":", prefix, organization_key, slug(value))


def signal_id(value) -> Column:
    return F.concat(F.lit("hiring_signal:"), as_col(value))


ENRICHED_FIELDS = ("provider", "model", "prompt_schema_version", "confidence", "source_content_hash", "business_unit", "capability_classifications", "technologies", "seniority_level")


def present_jobs(jobs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Jobs with the address and kind of their evidence; jobs without evidence are left out."""
    return jobs.drop("source_url", "source_type").join(evidence.select("evidence_id", "source_url", "source_type"), "evidence_id")


def linked_jobs(present: DataFrame, latest: DataFrame) -> DataFrame:
    """``present_jobs`` with the latest enrichment as ``e``."""
    return present.join(latest.select("job_id", F.struct(*ENRICHED_FIELDS).alias("e")), "job_id", "left")


def present_rows(rows: DataFrame) -> DataFrame:
    """``linked_jobs`` over sole rows that carry ``evidence`` and ``enrichment`` structs already; ``present_jobs`` without the latter."""
    e = F.col("enrichment")
    present = rows.drop("source_url", "source_type").withColumns({"source_url": F.col("evidence.source_url"), "source_type": F.col("evidence.source_type")})
    if "enrichment" not in rows.columns:
        return present
    return present.withColumn("e", F.when(e.isNotNull(), F.struct(*[e[c].alias(c) for c in ENRICHED_FIELDS])))


def _lined(node_types: Sequence[str] | None = None) -> Column:
    """All values a job names, in derivation order; of some node types only, if given."""
    none = F.array().cast("array<string>")
    entry = lambda node, edge, why: lambda v: F.struct(F.lit(node).alias("node_type"), F.lit(edge).alias("edge_type"), v.alias("value"), F.lit(why).alias("derivation_type"))
    many = lambda values, node, edge, why: F.transform(F.coalesce(values, none), entry(node, edge, why))
    e = F.col("e")
    seniority = F.when(F.coalesce(e["seniority_level"], F.lit("unknown")) != "unknown", F.array(e["seniority_level"])).otherwise(none)
    unit = F.when(F.coalesce(e["business_unit"], F.lit("")) != "", F.array(e["business_unit"])).otherwise(none)
    named = [
        (F.array("location"), "Location", "LOCATED_IN", SOURCE),
        (F.col("capability_classifications"), "Capability", "CLASSIFIED_AS", SOURCE),
        (F.col("technologies"), "Technology", "USES_TECHNOLOGY", KEYWORD),
        (unit, "BusinessUnit", "BELONGS_TO", ENRICHED),
        (e["capability_classifications"], "Capability", "CLASSIFIED_AS", ENRICHED),
        (e["technologies"], "Technology", "USES_TECHNOLOGY", ENRICHED),
        (seniority, "Seniority", "HAS_SENIORITY", ENRICHED),
    ]
    lined = chained(*[many(*n) for n in named if node_types is None or n[1] in node_types])
    return F.filter(lined, lambda c: nonblank(c["value"]).isNotNull())


def _prefix(node_type) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair]), node_type)


def concept_links(linked: DataFrame, node_types: Sequence[str] | None = None) -> DataFrame:
    """Concept edges of every row of ``linked_jobs``, one per row, edge type and target: the last derivation stays; to some node types only, if given.

    The choice is made within the row; only rows that share their job with others (``keyed_concepts``) are grouped.
    """
    keyed = linked.withColumns({"_org": slug("organization"), "_lined": _lined(node_types)}).withColumn("_ids", F.transform("_lined", lambda c: F.concat_ws(":", _prefix(c["node_type"]), F.col("_org"), slug(c["value"]))))
    # An edge type has one node type, so the node id alone tells two edges of a job apart.
    last = lambda at: ~F.coalesce(F.array_contains(F.slice("_ids", at + 2, F.size("_ids")), F.get("_ids", at)), F.lit(False))
    placed = F.transform("_lined", lambda c, at: F.struct(F.get("_ids", at).alias("node_id"), c["edge_type"].alias("edge_type"), c["node_type"].alias("node_type"), c["value"].alias("value"), c["derivation_type"].alias("derivation_type"), at.alias("position")))
    made = keyed.select(
        "organization", "job_id", "source_job_id", "evidence_id", "source_url", "posted_date", "e", F.explode_outer(F.filter(placed, lambda c: last(c["position"]))).alias("c")
    ).filter("c IS NOT NULL")
    only = lambda field: F.when(F.col("c.derivation_type") == ENRICHED, F.col("e")[field])
    return made.select(
        "organization", "job_id", "c.edge_type", "c.node_id", "c.node_type", "c.value", "c.derivation_type", "source_job_id", "evidence_id", "source_url", "posted_date",
        only("provider").alias("enrichment_provider"), only("model").alias("enrichment_model"), only("prompt_schema_version").alias("prompt_schema_version"),
        only("confidence").alias("enrichment_confidence"), only("source_content_hash").alias("source_content_hash"), "c.position",
    )


def keyed_concepts(links: DataFrame) -> DataFrame:
    """Concept links, one per job, edge type and target, of jobs that several rows name: the last derivation stays."""
    keys = ["organization", "job_id", "edge_type", "node_id"]
    rest = [c for c in links.columns if c not in (*keys, "position")]
    return links.groupBy(*keys).agg(F.max_by(F.struct(*rest), "position").alias("x"), F.max("position").alias("position")).select(*keys, "x.*", "position")


def known_concepts(linked: DataFrame, node_types: Sequence[str]) -> DataFrame:
    """``organization, node_id, node_type`` of the concepts of some types, one row each, without their spellings."""
    named = linked.select("organization", F.explode_outer(_lined(node_types)).alias("c")).filter("c IS NOT NULL")
    values = named.select("organization", "c.node_type", "c.value").distinct()
    return values.select("organization", concept_id(_prefix(F.col("node_type")), slug("organization"), F.col("value")).alias("node_id"), "node_type").distinct()


def last_spellings(linked: DataFrame, concepts: DataFrame, node_types: Sequence[str] | None = None) -> DataFrame:
    """``organization, node_id, node_type, value`` of every concept, or those of the types of ``concepts``: the spelling written last.

    Spellings of a node are few, so they get their node ids after they are made distinct, and dates are compared
    among them; jobs are compared only where spellings of a node share the newest date. A spelling that gives way to
    another in every job of that date shares it with the other one.
    """
    spelled = ["organization", "node_id", "node_type", "value"]
    named = linked.withColumn("_lined", _lined(node_types)).select("organization", "posted_date", F.explode_outer("_lined").alias("c")).filter("c IS NOT NULL")
    variants = named.groupBy("organization", F.col("c.node_type").alias("node_type"), F.col("c.value").alias("value")).agg(F.max("posted_date").alias("_date"))
    variants = variants.withColumn("node_id", concept_id(_prefix(F.col("node_type")), slug("organization"), F.col("value")))
    node = Window.partitionBy("organization", "node_id")
    newest = variants.withColumn("_newest", F.max("_date").over(node)).filter(F.col("_date").eqNullSafe(F.col("_newest"))).withColumn("_tied", F.count(F.lit(1)).over(node) > 1)
    newest = stage(newest.select(*spelled, "_date", "_tied"), "graph-spellings")
    tied = newest.filter("_tied").select(*[F.col(c).alias(f"_{c}") for c in spelled], F.col("_date").alias("_d"))
    same = F.col("_d").eqNullSafe(F.col("posted_date"))
    for c in spelled:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    last = concepts.select(*spelled, "posted_date", "job_id", "position").join(tied, same).groupBy("organization", "node_id").agg(F.max_by(F.struct("node_type", "value"), F.struct("job_id", "position")).alias("x"))
    return newest.filter("NOT _tied").select(*spelled).unionByName(last.select("organization", "node_id", "x.*"))


def _node(organization, node, kind, label, value=None, **attrs) -> list[Column]:
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), as_col(v).cast("string"))]
    return [
        as_col(organization).alias("organization"), node.alias("node_id"), F.lit(kind).alias("node_type") if isinstance(kind, str) else kind.alias("node_type"),
        as_col(label).cast("string").alias("label"), (F.lit(None).cast("string") if value is None else as_col(value)).alias("value"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attrs"),
    ]


def cited_sources(present: DataFrame) -> DataFrame:
    """Evidence of ``present_jobs`` for its nodes."""
    return present.select("organization", "evidence_id", "source_url", "source_type")


def graph_nodes(jobs: DataFrame, present: DataFrame, sources: DataFrame, spellings: DataFrame, signals: DataFrame | None = None, themes: DataFrame | None = None, theme_evidence: DataFrame | None = None) -> DataFrame:
    """Nodes, one per id, from jobs with evidence, ``cited_sources`` with one row per evidence and ``last_spellings``."""
    frames = [
        jobs.select("organization").distinct().select(*_node("organization", organization_id("organization"), "Organization", "organization")),
        present.select(*_node("organization", job_id("job_id"), "Job", "title", job_id="job_id", source_job_id="source_job_id")),
        sources.select(*_node("organization", evidence_id("evidence_id"), "Evidence", F.lit(None), evidence_id="evidence_id", source_url="source_url", source_type="source_type")),
        spellings.select(*_node("organization", F.col("node_id"), F.col("node_type"), "value", "value")),
    ]
    if signals is not None:
        frames.append(signals.select(*_node("organization", signal_id("signal_id"), "HiringSignal", "title", signal_id="signal_id", signal_type="signal_type", confidence="confidence", strength="strength")))
    if themes is not None:
        frames.append(
            themes.groupBy("organization", theme_id().alias("node_id")).agg(F.max_by(F.struct("priority", "direction", "hypothesis", "business_unit", "time_horizon", "confidence"), "position").alias("x")).select(
                *_node("organization", F.col("node_id"), "StrategicTheme", "x.priority", "x.priority", direction="x.direction", hypothesis="x.hypothesis", business_unit="x.business_unit", time_horizon="x.time_horizon", confidence="x.confidence")
            )
        )
    if theme_evidence is not None:
        frames.append(
            theme_evidence.groupBy("organization", theme_evidence_id().alias("node_id")).agg(F.max_by(F.struct("evidence_id", "source_url", "source_type", "statement", "publication_date"), "position").alias("x")).select(
                *_node("organization", F.col("node_id"), "StrategyEvidence", F.lit(None), None, evidence_id="x.evidence_id", source_url="x.source_url", source_type="x.source_type", statement="x.statement", publication_date="x.publication_date")
            )
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def theme_id(organization="organization", priority="priority") -> Column:
    return concept_id(F.lit("strategic_theme"), slug(organization), priority)


def theme_evidence_id(organization="organization", evidence="evidence_id") -> Column:
    return F.concat_ws(":", F.lit("strategy_evidence"), slug(organization), as_col(evidence))


PROVENANCE = ["job_id", "source_job_id", "evidence_id", "source_url", "enrichment_provider", "enrichment_model", "prompt_schema_version", "enrichment_confidence", "source_content_hash"]


def _edge(part, organization, src, dst, kind, why, known: Sequence[str] = ()) -> list[Column]:
    fields = [(F.col(p).cast("string") if p in known else F.lit(None).cast("string")).alias(p) for p in PROVENANCE]
    return [
        as_col(organization).alias("organization"), src.alias("src"), dst.alias("dst"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"), (F.lit(why) if isinstance(why, str) else why).alias("derivation_type"), F.struct(*fields).alias("provenance"),
        F.lit(part).alias("part"),
    ]


def graph_edges(present: DataFrame | None = None, concepts: DataFrame | None = None, spellings: DataFrame | None = None, signals: DataFrame | None = None, signal_support: DataFrame | None = None, themes: DataFrame | None = None, theme_evidence: DataFrame | None = None) -> DataFrame:
    """Edges, one per source, target and type; ``signal_support`` holds one row per signal and evidence.

    ``part`` tells which step made an edge (job, concept, signal, theme). A query that needs one part gives the frames of
    that part alone. Signals and themes look their targets up among ``spellings``, for which ``known_concepts`` will do.
    """
    from_source = ("job_id", "source_job_id", "evidence_id", "source_url")
    frames = []
    if present is not None:
        frames.append(present.select(*_edge("job", "organization", organization_id("organization"), job_id("job_id"), "HAS_JOB", SOURCE, from_source)))
        frames.append(present.select(*_edge("job", "organization", job_id("job_id"), evidence_id("evidence_id"), "SUPPORTED_BY", SOURCE, from_source)))
    if concepts is not None:
        frames.append(concepts.select(*_edge("concept", "organization", job_id("job_id"), F.col("node_id"), F.col("edge_type"), F.col("derivation_type"), PROVENANCE)))
    if signals is not None:
        derived = "deterministic_hiring_signal"
        frames.append(signals.select(*_edge("signal", "organization", organization_id("organization"), signal_id("signal_id"), "HAS_HIRING_SIGNAL", derived)))
        about = signals.filter("signal_type = 'capability_hiring_concentration'").withColumn("_target", concept_id(F.lit("capability"), slug("organization"), F.col("subject")))
        known = spellings.filter("node_type = 'Capability'").select(F.col("node_id").alias("_target")).distinct()
        frames.append(about.join(known, "_target", "left_semi").select(*_edge("signal", "organization", signal_id("signal_id"), F.col("_target"), "ABOUT_CAPABILITY", derived)))
    if signal_support is not None:
        frames.append(signal_support.select(*_edge("signal", "organization", signal_id("signal_id"), evidence_id("evidence_id"), "SUPPORTED_BY", "deterministic_hiring_signal", ("evidence_id",))))
    if themes is not None:
        derived = "cached_strategy_research"
        owned = themes.select("organization", theme_id().alias("_theme"), "business_unit").distinct()
        frames.append(owned.select("organization", "_theme").distinct().select(*_edge("theme", "organization", organization_id("organization"), F.col("_theme"), "HAS_STRATEGIC_THEME", derived)))
        units = owned.filter("business_unit <> ''").withColumn("_target", concept_id(F.lit("business_unit"), slug("organization"), F.col("business_unit")))
        known = spellings.filter("node_type = 'BusinessUnit'").select(F.col("node_id").alias("_target")).distinct()
        frames.append(units.join(known, "_target", "left_semi").select("organization", "_theme", "_target").distinct().select(*_edge("theme", "organization", F.col("_theme"), F.col("_target"), "ABOUT_BUSINESS_UNIT", derived)))
    if theme_evidence is not None:
        cited = theme_evidence.select("organization", theme_id().alias("_theme"), theme_evidence_id().alias("_evidence"), "evidence_id").distinct()
        frames.append(cited.select(*_edge("theme", "organization", F.col("_theme"), F.col("_evidence"), "SUPPORTED_BY", "cached_strategy_research", ("evidence_id",))))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# --- queries --------------------------------------------------------------------------------


def concepts_of(nodes: DataFrame, node_type: str) -> DataFrame:
    """Distinct concept values of an organization with their folded sort key."""
    return nodes.filter(F.col("node_type") == node_type).select("organization", "value").distinct().withColumn("sort_key", casefold("value"))


def jobs_of(edges: DataFrame, nodes: DataFrame, node_type: str, edge_type: str) -> DataFrame:
    """Jobs one hop before each concept: ``(organization, node_id, value, job_id)``."""
    targets = nodes.filter(F.col("node_type") == node_type).select(F.col("node_id").alias("dst"), "value")
    into = edges.filter((F.col("part") == "concept") & (F.col("edge_type") == edge_type) & F.col("src").startswith("job:"))
    return into.join(targets, "dst").select("organization", F.col("dst").alias("node_id"), "value", F.expr("substring(src, 5)").alias("job_id")).distinct()


def evidence_of_jobs(edges: DataFrame) -> DataFrame:
    """Evidence one hop after each job."""
    out = edges.filter((F.col("part") == "job") & (F.col("edge_type") == "SUPPORTED_BY") & F.col("src").startswith("job:"))
    return out.select("organization", F.expr("substring(src, 5)").alias("job_id"), F.expr("substring(dst, 10)").alias("evidence_id")).distinct()


def evidence_of_themes(edges: DataFrame) -> DataFrame:
    """Research evidence one hop after each theme."""
    out = edges.filter((F.col("part") == "theme") & (F.col("edge_type") == "SUPPORTED_BY") & F.col("src").startswith("strategic_theme:") & F.col("dst").startswith("strategy_evidence:"))
    return out.select("organization", F.col("src").alias("node_id"), F.col("provenance.evidence_id").alias("evidence_id")).distinct()


def jobs_of_signals(edges: DataFrame) -> DataFrame:
    """Jobs two hops from each signal: signal to evidence, evidence back to job."""
    support = edges.filter(F.col("edge_type") == "SUPPORTED_BY")
    signals = support.filter((F.col("part") == "signal") & F.col("src").startswith("hiring_signal:")).select("organization", F.expr("substring(src, 15)").alias("signal_id"), "dst")
    jobs = support.filter((F.col("part") == "job") & F.col("src").startswith("job:")).select("dst", F.expr("substring(src, 5)").alias("job_id"))
    return signals.join(jobs, "dst").select("organization", "signal_id", "job_id").distinct()


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts by type, zero where a type is absent: ``(organization, kind, type, count)``."""
    def counted(frame, kind, column, types):
        wide = frame.groupBy("organization").agg(*[F.count_if(F.col(column) == t).alias(f"_{t}") for t in types])
        return wide.select("organization", F.lit(kind).alias("kind"), F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in types]), F.array(*[F.col(f"_{t}") for t in types]))).alias("type", "count"))

    return counted(nodes, "node", "node_type", NODE_TYPES).unionByName(counted(edges, "edge", "edge_type", EDGE_TYPES))


LINKS = {"Capability": "CLASSIFIED_AS", "Technology": "USES_TECHNOLOGY", "BusinessUnit": "BELONGS_TO"}


def concept_jobs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Job rows of capabilities, technologies and business units in one pass over the edges."""
    wanted = edges.filter((F.col("part") == "concept") & F.col("edge_type").isin(*LINKS.values()) & F.col("src").startswith("job:"))
    named = nodes.filter(F.col("node_type").isin(*LINKS)).select(F.col("node_id").alias("dst"), "node_type", "value")
    return wanted.join(named, "dst").select("organization", "node_type", F.col("dst").alias("node_id"), "value", F.expr("substring(src, 5)").alias("job_id"))


def graph_insights(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Top capabilities and technologies by job count."""
    counts = concept_jobs(nodes, edges).filter(F.col("node_type") != "BusinessUnit").groupBy("organization", "node_type", "value").agg(F.count(F.lit(1)).alias("job_count"))
    return top_n(counts, ["organization", "node_type"], [F.desc("job_count"), casefold("value"), F.col("value")], n)


def theme_insights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strategic themes with direction, confidence and evidence count."""
    cited = evidence_of_themes(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    themes = nodes.filter("node_type = 'StrategicTheme'")
    return themes.join(cited, "node_id", "left").na.fill(0, ["evidence_count"]).select(
        "organization", F.col("value").alias("name"), F.col("attrs.direction").alias("direction"), F.col("attrs.confidence").cast("double").alias("confidence"),
        F.col("attrs.time_horizon").alias("time_horizon"), F.col("attrs.business_unit").alias("business_unit"), "evidence_count",
    )


def graph_compact(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Job count per concept and the first ``n`` supporting job ids, one row per kept id."""
    rows = concept_jobs(nodes, edges)
    counts = rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("job_count"))
    first = top_n(rows, ["node_id"], [F.col("job_id")], n)
    return first.join(counts, "node_id").select("organization", "node_type", slug("value", fold_accents=False).alias("key"), "value", "job_count", "job_id")


def graph_signal_support(edges: DataFrame, n: int = 10) -> DataFrame:
    """Job count per signal and the first ``n`` supporting job ids, one row per kept id."""
    rows = jobs_of_signals(edges)
    counts = rows.groupBy("signal_id").agg(F.count(F.lit(1)).alias("job_count"))
    return top_n(rows, ["signal_id"], [F.col("job_id")], n).join(counts, "signal_id")


def graph_totals(linked: DataFrame) -> DataFrame:
    """Jobs read, enriched and classified per organization, from ``linked_jobs``."""
    joined = linked.select("organization", "evidence_id", "capability_classifications", F.col("e").isNotNull().alias("_e"), (F.size("e.capability_classifications") > 0).alias("_c"))
    return joined.groupBy("organization").agg(
        F.count(F.lit(1)).alias("jobs_read"),
        F.count_distinct("evidence_id").alias("evidence_records_used"),
        F.count_if("_e").alias("enriched_jobs_used"),
        F.count_if((F.size("capability_classifications") > 0) | F.coalesce(F.col("_e") & F.col("_c"), F.lit(False))).alias("classified_jobs_used"),
    )


def coverage(totals: DataFrame) -> DataFrame:
    """Enriched and classified shares (four decimals) with the limitation texts."""
    enriched, classified = ratio("enriched_jobs_used", "jobs_read") * 100, ratio("classified_jobs_used", "jobs_read") * 100
    two = lambda c: F.format_string("%.2f", F.bround(c, 2))
    notes = F.array_compact(
        F.array(
            F.when(F.col("jobs_read") == 0, F.format_string("No persisted %s hiring jobs are available for enrichment coverage.", F.col("organization")))
            .when(F.col("enriched_jobs_used") < F.col("jobs_read"), F.format_string(
                "Persisted hiring enrichment currently covers %d of %d %s jobs (%s%%); enrichment-derived technology/skills relationships should be treated as directional rather than comprehensive.",
                F.col("enriched_jobs_used"), F.col("jobs_read"), F.col("organization"), two(enriched))),
            F.when((F.col("jobs_read") > 0) & (F.col("classified_jobs_used") > F.col("enriched_jobs_used")), F.format_string(
                "Capability classification (business-area categorization from the source data, not LLM-verified) separately covers %d of %d %s jobs (%s%%); "
                "this is independent of, and typically broader than, the technology/skills enrichment coverage above.",
                F.col("classified_jobs_used"), F.col("jobs_read"), F.col("organization"), two(classified))),
        )
    )
    return totals.select(
        "organization", F.col("jobs_read").alias("total_jobs"), F.col("enriched_jobs_used").alias("enriched_jobs"), F.col("classified_jobs_used").alias("classified_jobs"),
        half_even(enriched, 4).alias("enrichment_coverage_percentage"), half_even(classified, 4).alias("classification_coverage_percentage"), notes.alias("limitations"),
    )


def row_checks(rows: DataFrame) -> DataFrame:
    """``graph_checks`` of sole rows, which carry all evidence and enrichment that concerns their job."""
    missing = F.when(F.col("evidence").isNull(), F.lit("missing_evidence"))
    differs = F.when(F.col("enrichment.evidence_id") != F.col("evidence_id"), F.lit("enrichment_mismatch"))
    return rows.select("organization", F.col("job_id").alias("subject"), F.explode(F.array_compact(F.array(missing, differs))).alias("violation"))


def graph_checks(jobs: DataFrame, evidence: DataFrame, latest: DataFrame, signal_support: DataFrame | None = None) -> DataFrame:
    """Violations that would make the graph unsound: ``(organization, subject, violation)``."""
    missing = jobs.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("organization", F.col("job_id").alias("subject"), F.lit("missing_evidence").alias("violation"))
    versions = latest.select("job_id", F.col("evidence_id").alias("_cited"))
    differs = jobs.join(versions, "job_id").filter(F.col("_cited") != F.col("evidence_id")).select("organization", F.col("job_id").alias("subject"), F.lit("enrichment_mismatch").alias("violation"))
    out = missing.unionByName(differs)
    if signal_support is not None:
        own = jobs.join(evidence.select("evidence_id"), "evidence_id", "left_semi").select("organization", "evidence_id")
        outside = signal_support.join(own, ["organization", "evidence_id"], "left_anti").select("organization", F.col("signal_id").alias("subject"), F.lit("signal_evidence_outside").alias("violation"))
        out = out.unionByName(outside.distinct())
    return out
