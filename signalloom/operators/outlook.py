"""Evidence assessment, opportunity scoring, horizons, outlook rows and report findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions import lexicons as L
from signalloom.functions.dates import recency_score, valid_date
from signalloom.functions.numbers import half_even, unit
from signalloom.functions.text import as_col, casefold, nonblank, slug
from signalloom.operators.ordering import dedupe_either, latest_per


def name_key(value) -> Column:
    """Comparison form of a name: letters and digits with single blanks."""
    return slug(value, " ", fold_accents=False)


def validate_evidence(items: DataFrame, names: DataFrame, order: str = "position", scope: str = "company") -> DataFrame:
    """Evidence with ``reject_reason``: unrelated company, invalid source date, duplicate, or null.

    ``names(scope, company_key)`` lists accepted names. Of the remaining items the first of an id or
    of equal content wins, within each scope.
    """
    accepted = names.select(scope, "company_key").distinct().withColumn("_known", F.lit(True))
    keyed = items.withColumn("company_key", F.when(F.coalesce(F.col("company_id"), F.lit("")) != "", name_key("company_id")))
    checked = keyed.join(accepted, [scope, "company_key"], "left").withColumn(
        "reject_reason",
        F.when(F.col("company_key").isNotNull() & F.col("_known").isNull(), F.lit("unrelated company"))
        .when((F.coalesce("source_date", F.lit("")) != "") & ~valid_date("source_date"), F.lit("invalid source date")),
    ).drop("_known", "company_key")
    bar = F.lit("\u0001")
    fingerprint = F.concat(as_col(scope), bar, name_key("statement"), bar, name_key(F.coalesce("source_url", F.lit(""))), bar, F.coalesce("source_date", F.lit("")))
    kept = dedupe_either(checked.filter("reject_reason IS NULL"), F.concat(as_col(scope), bar, F.col("evidence_id")), fingerprint, order)
    return checked.join(kept.select(order, F.lit(True).alias("_kept")), order, "left").withColumn(
        "reject_reason", F.when(F.col("reject_reason").isNull() & F.col("_kept").isNull(), F.lit("duplicate evidence")).otherwise(F.col("reject_reason"))
    ).drop("_kept")


def _directed(evidence: DataFrame) -> DataFrame:
    word = name_key(F.coalesce("direction", F.lit("")))
    return evidence.withColumns(
        {
            "topic_key": name_key(F.coalesce(F.nullif("topic", F.lit("")), F.lit("general"))),
            "unit_key": name_key(F.coalesce("business_unit", F.lit(""))),
            "_up": word.isin(*L.UP_WORDS),
            "_down": word.isin(*L.DOWN_WORDS),
        }
    )


def direction_conflicts(evidence: DataFrame, by: Sequence[str] = ("company",)) -> DataFrame:
    """Topic and business unit with both an upward and a downward item."""
    return _directed(evidence).groupBy(*by, "topic_key", "unit_key").agg(
        F.count_if("_up").alias("up_count"), F.count_if("_down").alias("down_count")
    ).filter("up_count > 0 AND down_count > 0")


def conflicting_evidence(evidence: DataFrame, conflicts: DataFrame, by: Sequence[str] = ("company",)) -> DataFrame:
    """Items on either side of a conflict, one row each."""
    return _directed(evidence).filter("_up OR _down").join(conflicts.select(*by, "topic_key", "unit_key"), [*by, "topic_key", "unit_key"], "left_semi").select(*by, "topic_key", "unit_key", "evidence_id")


def assess(evidence: DataFrame, conflicting: DataFrame, by: Sequence[str] = ("company",)) -> DataFrame:
    """Overall confidence and sufficiency: mean, a bonus for two agents, a penalty per conflicting item."""
    base = evidence.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evidence_count"), F.avg("confidence").alias("_mean"), F.count_distinct("agent").alias("agents"),
        F.count_if(F.col("agent") == "strategy").alias("_strategy"), F.count_if(F.col("agent") == "hiring").alias("_hiring"),
    )
    disputed = conflicting.groupBy(*by).agg(F.count_distinct("evidence_id").alias("conflict_count"))
    joined = base.join(disputed, list(by), "left").na.fill(0, ["conflict_count"])
    raw = unit(F.col("_mean") + F.when(F.col("agents") == 2, 0.1).otherwise(0.0) - F.least(F.lit(0.25), F.col("conflict_count") * 0.05))
    missing = F.array_compact(
        F.array(
            F.when(F.col("_strategy") == 0, F.lit("Strategy evidence is missing.")),
            F.when(F.col("_hiring") == 0, F.lit("Hiring evidence is missing.")),
        )
    )
    return joined.withColumns({"sufficient": raw >= 0.35, "overall_confidence": half_even(raw, 3), "missing_questions": missing}).drop("_mean", "_strategy", "_hiring")


# --- drafts ---------------------------------------------------------------------------------


def checked_references(drafts: DataFrame, evidence: DataFrame, key: str, by: Sequence[str] = ("company",)) -> DataFrame:
    """Drafts with ``valid_references``: they cite something and only known evidence."""
    cited = drafts.select(*by, key, F.explode_outer(F.array_distinct("supporting_evidence_ids")).alias("evidence_id"))
    known = evidence.select(*by, "evidence_id").distinct().withColumn("_known", F.lit(True))
    verdict = cited.join(known, [*by, "evidence_id"], "left").groupBy(*by, key).agg((F.count("evidence_id") > 0).alias("_some"), F.count_if(F.col("_known").isNull()).alias("_unknown"))
    return drafts.withColumn("supporting_evidence_ids", F.array_distinct("supporting_evidence_ids")).join(verdict, [*by, key], "left").withColumn(
        "valid_references", F.coalesce(F.col("_some") & (F.col("_unknown") == 0), F.lit(False))
    ).drop("_some", "_unknown")


def validate_priorities(drafts: DataFrame, evidence: DataFrame, key: str = "priority_id", by: Sequence[str] = ("company",)) -> DataFrame:
    """Priorities with ``limitation``: null when kept."""
    return checked_references(drafts, evidence, key, by).withColumn(
        "limitation", F.when(~F.col("valid_references"), F.format_string("Priority '%s' was removed because its evidence was invalid.", "priority"))
    ).drop("valid_references")


def validate_opportunities(drafts: DataFrame, evidence: DataFrame, priorities: DataFrame, key: str = "opportunity_id", by: Sequence[str] = ("company",)) -> DataFrame:
    """Opportunities with ``limitation``: null when kept.

    Where a company has kept priorities, the opportunity must belong to one of them.
    """
    kept = priorities.filter("limitation IS NULL").select(*by, name_key("priority").alias("priority_key")).distinct()
    some = kept.select(*by).distinct().withColumn("_some", F.lit(True))
    checked = checked_references(drafts, evidence, key, by).withColumn("priority_key", name_key("client_priority"))
    joined = checked.join(kept.withColumn("_match", F.lit(True)), [*by, "priority_key"], "left").join(some, list(by), "left")
    return joined.withColumn(
        "limitation",
        F.when(~F.col("valid_references"), F.format_string("Opportunity '%s' was removed because it lacked valid evidence.", "title"))
        .when(F.col("_some").isNotNull() & F.col("_match").isNull(), F.format_string("Opportunity '%s' was removed because it lacked a validated priority.", "title")),
    ).drop("_some", "_match", "valid_references")


def score_opportunities(opportunities: DataFrame, evidence: DataFrame, priorities: DataFrame, as_of, key: str = "opportunity_id", by: Sequence[str] = ("company",), weights=L.OPPORTUNITY_WEIGHTS) -> DataFrame:
    """Weighted eight-part score of each opportunity over the evidence it cites."""
    known = evidence.select(*by, "evidence_id", "agent", "evidence_type", "confidence", recency_score("source_date", as_of).alias("_recency"))
    cited = opportunities.select(*by, key, F.explode("supporting_evidence_ids").alias("evidence_id")).join(known, [*by, "evidence_id"])
    has = lambda cond: F.coalesce(F.max(cond.cast("double")), F.lit(0.0))
    parts = cited.groupBy(*by, key).agg(
        has(F.col("agent") == "strategy").alias("_strategy"),
        F.coalesce(F.max(F.when(F.col("agent") == "hiring", F.col("confidence"))), F.lit(0.0)).alias("_hiring"),
        *[has(F.col("evidence_type") == t).alias(f"_{t}") for t in ("leadership", "financial", "technology", "news")],
        F.max("_recency").alias("_recency"),
    )
    held = latest_per(
        priorities.select(*by, name_key("priority").alias("priority_key"), F.col("confidence").alias("_priority"), F.col("priority_id").alias("_pid")), [*by, "priority_key"], [F.desc("_pid")]
    ).drop("_pid")
    keyed = opportunities.withColumn("priority_key", name_key("client_priority"))
    joined = keyed.join(parts, [*by, key], "left").join(held, [*by, "priority_key"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = {
        "strategy": F.coalesce("_priority", zero("_strategy")), "leadership": zero("_leadership"), "hiring": zero("_hiring"), "financial": zero("_financial"),
        "technology": zero("_technology"), "news": zero("_news"), "consulting_fit": F.col("consulting_fit"), "recency": F.coalesce("_recency", F.lit(0.25)),
    }
    total = sum((values[k] * w for k, w in weights.items()), F.lit(0.0))
    scored = joined.withColumn("score", half_even(total * 100, 1))
    return map_horizon(scored).withColumn("confidence", half_even(F.col("score") / 100, 3)).drop("_strategy", "_hiring", "_leadership", "_financial", "_technology", "_news", "_recency", "_priority")


def map_horizon(scored: DataFrame) -> DataFrame:
    """Suggested horizon when it is one of the fixed ones, else by score."""
    suggested = F.col("suggested_horizon_days").isin(*L.HORIZONS)
    score = F.col("score")
    steps = [
        (75, 30, "High evidence and fit support immediate discovery."),
        (60, 60, "Strong signals support near-term stakeholder qualification."),
        (45, 90, "Moderate readiness supports assessment or early proposal work."),
        (30, 180, "Further relationship and solution development is required."),
    ]
    days, reason = F.when(suggested, F.col("suggested_horizon_days")), F.when(suggested, F.format_string("Evidence-backed action mapped to the %d-day window.", F.col("suggested_horizon_days")))
    for least, horizon, text in steps:
        days, reason = days.when(score >= least, horizon), reason.when(score >= least, F.lit(text))
    return scored.withColumns(
        {"horizon_days": days.otherwise(360).cast("int"), "horizon_reason": reason.otherwise(F.lit("Limited readiness makes this a longer-term monitoring opportunity."))}
    )


def horizon_sections(scored: DataFrame, by: Sequence[str] = ("company",)) -> DataFrame:
    """Opportunities per horizon, every horizon present, with its meaning."""
    counts = scored.groupBy(*by).agg(*[F.count_if(F.col("horizon_days") == h).alias(str(h)) for h in L.HORIZONS])
    sections = F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.lit(m).alias("meaning"), F.col(str(h)).alias("opportunity_count")) for h, m in L.HORIZONS.items()])
    return counts.select(*by, F.explode(sections).alias("s")).select(*by, "s.*")


# --- outlook --------------------------------------------------------------------------------


def outlook_support(opportunities: DataFrame, evidence: DataFrame, index: DataFrame, by: Sequence[str] = ("company",)) -> DataFrame:
    """Hiring support of each priority: ``(…, priority_key, reference, job_id)``.

    ``index(company, evidence_id, reference, job_id)`` is long; hiring evidence ids of the priority's
    opportunities are joined to it.
    """
    hiring = evidence.filter("agent = 'hiring'").select(*by, "evidence_id").distinct()
    cited = opportunities.select(*by, name_key("client_priority").alias("priority_key"), F.explode("supporting_evidence_ids").alias("evidence_id")).distinct()
    return cited.join(hiring, [*by, "evidence_id"], "left_semi").join(index, [*by, "evidence_id"]).select(*by, "priority_key", "reference", "job_id").distinct()


def outlook(opportunities: DataFrame, evidence: DataFrame, index: DataFrame, by: Sequence[str] = ("company",), n: int = 5) -> DataFrame:
    """Up to ``n`` rows per company, one per normalised priority, with the exact union of supporting jobs.

    Ranked by best score, then priority; horizon columns hold the action of the priority's last
    opportunity of that horizon in score order.
    """
    keyed = opportunities.withColumn("priority_key", name_key("client_priority"))
    # Order of the horizon sections: horizon, then score descending, then draft order.
    place = F.struct(F.col("horizon_days"), (-F.col("score")).alias("s"), F.col("opportunity_id").alias("o"))
    last_of = lambda h: F.max_by(F.when(F.col("horizon_days") == h, F.col("recommended_sales_action")), F.when(F.col("horizon_days") == h, place))
    named = F.coalesce(nonblank("title"), nonblank("recommended_solution"), nonblank("business_problem"))
    best_name = F.struct((-F.col("score")).alias("s"), casefold("title").alias("t"), F.col("opportunity_id").alias("o"))
    grouped = keyed.groupBy(*by, "priority_key").agg(
        F.min_by("client_priority", place).alias("_first_priority"),
        F.min_by("client_priority", F.struct((-F.col("score")).alias("s"), place.alias("p"))).alias("supervisor_priority"),
        F.coalesce(F.min_by(named, F.when(named.isNotNull(), best_name)), F.lit("Opportunity not specified")).alias("opportunity_theme"),
        F.max("score").alias("score"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("opportunity_count"),
        *[last_of(h).alias(f"horizon_{h}") for h in L.HORIZONS],
    )
    window = Window.partitionBy(*by).orderBy(F.desc("score"), casefold("_first_priority"), "priority_key")
    top = grouped.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n).drop("_first_priority")
    support = outlook_support(opportunities, evidence, index, by)
    jobs = support.groupBy(*by, "priority_key").agg(F.count_distinct("job_id").alias("relevant_hiring_jobs"), F.count_distinct("reference").alias("reference_count"))
    cited = (
        keyed.select(*by, "priority_key", F.explode("supporting_evidence_ids").alias("evidence_id")).distinct()
        .groupBy(*by, "priority_key").agg(F.count(F.lit(1)).alias("cited_evidence_count"))
    )
    return top.join(jobs, [*by, "priority_key"], "left").join(cited, [*by, "priority_key"], "left").withColumn(
        "limitation", F.when(F.col("reference_count").isNull(), F.lit("No direct hiring evidence was linked to this opportunity."))
    )


# --- report ---------------------------------------------------------------------------------


def report_references(evidence: DataFrame, concepts: DataFrame, by: Sequence[str] = ("company",)) -> DataFrame:
    """References keyed by id, the last one written wins: evidence first, graph concepts after."""
    own = evidence.select(*by, F.col("evidence_id").alias("reference_id"), F.col("agent").alias("domain"), F.struct(F.lit(0).alias("a"), F.col("position").cast("long").alias("b")).alias("_order"))
    graph = concepts.select(*by, F.concat(F.lit("kg:"), "concept_type", F.lit(":"), "concept_key").alias("reference_id"), F.lit("hiring_kg").alias("domain"), F.struct(F.lit(1).alias("a"), F.lit(0).cast("long").alias("b")).alias("_order"))
    return latest_per(own.unionByName(graph), [*by, "reference_id"], [F.desc("_order")]).drop("_order")


def known_references(findings: DataFrame, references: DataFrame, ids_col: str = "supporting_evidence_ids", by: Sequence[str] = ("company",), key: str = "priority_id") -> DataFrame:
    """Finding references that exist in the report, one row each."""
    cited = findings.select(*by, key, F.posexplode(ids_col).alias("position", "reference_id"))
    return cited.join(references.select(*by, "reference_id"), [*by, "reference_id"], "left_semi")


def aligned_priorities(priorities: DataFrame, evidence: DataFrame, by: Sequence[str] = ("company",), key: str = "priority_id") -> DataFrame:
    """Priorities that both a strategy and a hiring item support."""
    agents = evidence.select(*by, "evidence_id", "agent")
    cited = priorities.select(*by, key, "priority", F.explode("supporting_evidence_ids").alias("evidence_id")).join(agents, [*by, "evidence_id"])
    return cited.groupBy(*by, key, "priority").agg(F.bool_or(F.col("agent") == "strategy").alias("_s"), F.bool_or(F.col("agent") == "hiring").alias("_h")).filter("_s AND _h").drop("_s", "_h")


def report_findings(priorities: DataFrame, aligned: DataFrame, technologies: DataFrame, business_units: DataFrame, signals: DataFrame) -> DataFrame:
    """Priority, hiring, alignment and business-area findings: ``(company, section, title, narrative, reference)``."""
    dot = lambda c: F.regexp_replace(as_col(c), r"\.+$", "")
    rows = [
        priorities.select("company", F.lit("strategic_priorities").alias("section"), F.col("priority").alias("title"), F.concat(
            F.lit("Strategic evidence suggests "), dot("explanation"), F.lit(" This is an evidence-backed interpretation, not confirmed causation.")).alias("narrative"), F.lit(None).cast("string").alias("reference")),
        technologies.select("company", F.lit("hiring_intelligence").alias("section"), F.concat(F.lit("Observed technology: "), "name").alias("title"), F.format_string(
            "Persisted hiring data observed %s in %d job record(s). This is observed hiring evidence, not proof of enterprise-wide investment or causation.", "name", "job_count").alias("narrative"), F.concat(F.lit("kg:technology:"), "concept_key").alias("reference")),
        signals.select("company", F.lit("hiring_intelligence").alias("section"), "title", F.concat(
            F.lit("Observed hiring indicates "), dot("summary"), F.lit(" The signal describes public hiring activity, not confirmed investment.")).alias("narrative"), F.col("signal_id").alias("reference")),
        aligned.select("company", F.lit("cross_domain_alignment").alias("section"), F.col("priority").alias("title"), F.lit(
            "Strategy and observed hiring evidence appear aligned around this priority; the relationship is correlational rather than causal.").alias("narrative"), F.lit(None).cast("string").alias("reference")),
        business_units.select("company", F.lit("business_areas_to_watch").alias("section"), F.col("name").alias("title"), F.format_string(
            "Observed hiring enrichment identifies %s across %d persisted-enriched job record(s); treat this as directional.", "name", "job_count").alias("narrative"), F.concat(F.lit("kg:business_unit:"), "concept_key").alias("reference")),
    ]
    out = rows[0]
    for frame in rows[1:]:
        out = out.unionByName(frame)
    return out


def strategy_summary(signals: DataFrame, by: Sequence[str] = ("company",), order: str = "position") -> DataFrame:
    """Reliability, themes and status of a research answer."""
    grouped = signals.groupBy(*by).agg(
        half_even(F.avg("confidence"), 4).alias("reliability"), F.count(F.lit(1)).alias("theme_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "priority"))), lambda s: s["priority"]), ", ").alias("themes"),
    )
    return grouped.withColumns(
        {
            "status": F.lit("answered"),
            "executive_summary": F.format_string("Evidence-backed research identified %d supported strategic theme%s: %s.", "theme_count", F.when(F.col("theme_count") != 1, F.lit("s")).otherwise(F.lit("")), "themes"),
        }
    )
