"""Nested documents, evidence assessment, gates, scores, outlook and report.

Scores are compared after rounding the exact binary value, which in DuckDB is what ``printf`` does;
its ``round_even`` rounds the product with the power of ten and turns 0.0375 into 0.038.
"""

from pyspark.sql import functions as F

from signalloom.functions import lexicons as L
from signalloom.operators import documents as D, outlook as W, research as R
from signalloom.plans.registry import query, view

AS_OF = "2026-08-31"

# --- nested documents -----------------------------------------------------------------------


def _nested(b):
    """Events wrapped into documents with evidence at several depths."""
    e = b.table("events")
    record = lambda name, text: F.struct(F.lit(name).alias("id"), text.alias("summary"), F.col("event_type").alias("theme"), F.lit("  ").alias("topic"), F.col("value").alias("relevance_score"))
    doc = F.struct(
        F.struct(F.array(record("a", F.concat(F.lit("seen "), "event_type"))).alias("Evidence"), F.lit("kept out").alias("title")).alias("analysis"),
        F.array(F.struct(F.array(F.struct(F.col("event_type").alias("statement"), (F.col("user_id") % 3 == 0).alias("flag"), F.array(F.struct(F.lit("deep").alias("title"))).alias("sources"))).alias("findings"))).alias("sections"),
        F.array(F.concat(F.lit(" note "), F.col("event_type")), F.lit(""), F.lit("note error")).alias("limitations"),
        F.struct(F.lit("2024-01-01").alias("observation_start"), F.date_format("ts", "yyyy-MM-dd").alias("observation_end"), F.when(F.col("user_id") % 2 == 0, F.lit("Acme Corp.")).otherwise(F.lit("Other")).alias("company_name")).alias("context"),
        F.array(F.concat(F.lit("6BA7B811-9DAD-11D1-80B4-"), F.lpad(F.col("event_id").cast("string"), 12, "0")), F.lit("not-an-id")).alias("supporting_evidence_ids"),
    )
    return e.select("event_id", F.when(F.col("user_id") % 4 == 0, F.lit("hiring")).otherwise(F.lit("strategy")).alias("agent"), F.to_json(doc).alias("doc"))


@query("doc1_extract_evidence", """
SELECT event_id, statement, coalesce(topic, '') AS topic, confidence, evidence_type FROM (
  SELECT event_id, 'seen ' || event_type AS statement, event_type AS topic, greatest(0.0, least(1.0, value)) AS confidence, CASE WHEN user_id % 4 = 0 THEN 'hiring' ELSE 'strategy' END AS evidence_type FROM events
  UNION ALL SELECT event_id, event_type, NULL, 0.5::DOUBLE, CASE WHEN user_id % 4 = 0 THEN 'hiring' ELSE 'strategy' END FROM events)""")
def _(b):
    found = D.extract_evidence(_nested(b), ["event_id"], "doc")
    return found.select("event_id", "statement", F.coalesce("topic", F.lit("")).alias("topic"), "confidence", "evidence_type")


@query("doc2_collect_limitations", "SELECT event_id, value FROM (SELECT event_id, 'note ' || event_type AS value FROM events UNION SELECT event_id, 'note error' FROM events)")
def _(b):
    return D.collect_nested(_nested(b), ["event_id"], "doc").select("event_id", "value")


@query("doc2_observation_periods", "SELECT event_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) < 28 AS is_limited FROM events")
def _(b):
    rows = D.observation_periods(_nested(b), ["event_id"], "doc")
    return rows.select("event_id", (F.datediff("observation_end", "observation_start") < 28).alias("is_limited"))


@query("doc3_collect_ids", "SELECT event_id, '6ba7b811-9dad-11d1-80b4-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id FROM events")
def _(b):
    return D.collect_ids(_nested(b), ["event_id"], "doc", ["supporting_evidence_ids", "evidence_id"]).select("event_id", "id")


@query("flt9_contamination", "SELECT event_id, 'Other' AS value FROM events WHERE user_id % 2 = 1")
def _(b):
    docs = _nested(b).withColumn("scope", F.lit("acme"))
    names = b.spark.createDataFrame([("acme", "acme corp"), ("acme", "acme")], "scope string, company_key string")
    return D.contamination(docs, ["event_id", "scope"], "doc", names).select("event_id", "value")


# --- evidence -------------------------------------------------------------------------------


def _evidence(b):
    """Events as evidence of five companies."""
    e = b.table("events")
    company = F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string"))
    return e.select(
        company.alias("company"), F.col("event_id").alias("position"), F.concat(F.lit("EV"), F.floor(F.col("event_id") / 2).cast("string")).alias("evidence_id"),
        F.when(F.col("user_id") % 2 == 0, F.lit("strategy")).otherwise(F.lit("hiring")).alias("agent"),
        F.when(F.col("user_id") % 11 == 0, F.lit("Stranger")).when(F.col("user_id") % 3 == 0, company).alias("company_id"),
        F.when(F.col("event_type") == "view", F.lit("Unit A")).alias("business_unit"), F.concat(F.lit("topic "), (F.col("user_id") % 30).cast("string")).alias("topic"),
        F.when(F.col("event_type") == "error", F.lit("leadership")).when(F.col("event_type") == "click", F.lit("financial")).otherwise(F.lit("strategy")).alias("evidence_type"),
        F.when(F.col("event_type") == "purchase", F.lit("Growth")).when(F.col("event_type") == "error", F.lit(" DOWN ")).otherwise(F.lit("flat")).alias("direction"),
        F.concat(F.lit("Statement "), F.floor((F.col("event_id") + 1) / 2).cast("string")).alias("statement"), F.lit("https://e.example.com").alias("source_url"),
        F.when(F.col("user_id") % 13 == 0, F.lit("2024-13-01")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("source_date"),
        (F.col("value") / 1000 - F.floor(F.col("value") / 1000)).alias("raw_confidence"), (F.col("user_id") % 10 / 10).alias("confidence"),
    )


view("w_ev", """
SELECT 'C' || (user_id % 5) AS company, event_id AS position, 'EV' || (event_id // 2) AS evidence_id, CASE WHEN user_id % 2 = 0 THEN 'strategy' ELSE 'hiring' END AS agent,
  CASE WHEN event_type = 'view' THEN 'unit a' ELSE '' END AS unit_key, 'topic ' || (user_id % 30) AS topic_key, CASE event_type WHEN 'error' THEN 'leadership' WHEN 'click' THEN 'financial' ELSE 'strategy' END AS evidence_type,
  event_type = 'purchase' AS up, event_type = 'error' AS down, (user_id % 10) / 10 AS confidence, user_id, ts FROM events
""")


view("w_reason", "SELECT *, CASE WHEN user_id % 11 = 0 THEN 'unrelated company' WHEN user_id % 13 = 0 THEN 'invalid source date' END AS reason FROM w_ev")
view("w_rounds", """
SELECT 0 AS round, a, b, o, 'open' AS state FROM (
  SELECT company || '|' || evidence_id AS a, company || '|' || ((position + 1) // 2) || '|' || strftime(ts, '%Y-%m-%d') AS b, min(position) AS o FROM w_reason WHERE reason IS NULL GROUP BY ALL)
UNION ALL
SELECT round + 1, a, b, o, CASE WHEN state <> 'open' THEN state WHEN kept_a OR kept_b THEN 'dropped' WHEN o = first_a AND o = first_b THEN 'kept' ELSE 'open' END
FROM (SELECT *, min(CASE WHEN state = 'open' THEN o END) OVER (PARTITION BY a) AS first_a, min(CASE WHEN state = 'open' THEN o END) OVER (PARTITION BY b) AS first_b,
  bool_or(state = 'kept') OVER (PARTITION BY a) AS kept_a, bool_or(state = 'kept') OVER (PARTITION BY b) AS kept_b, bool_or(state = 'open') OVER () AS going FROM w_rounds)
WHERE going
""", recursive=True)


@query("flt10_reject_reasons", """
SELECT company, coalesce(reason, CASE WHEN k.o IS NULL THEN 'duplicate evidence' ELSE 'none' END) AS reason, count(*) AS n
FROM w_reason r LEFT JOIN (SELECT o FROM w_rounds WHERE state = 'kept' AND round = (SELECT max(round) FROM w_rounds)) k ON k.o = r.position GROUP BY ALL""")
def _(b):
    names = b.spark.createDataFrame([(f"C{i}", f"c{i}") for i in range(5)], "company string, company_key string")
    checked = W.validate_evidence(_evidence(b), names)
    return checked.groupBy("company", F.coalesce("reject_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


view("w_conf", "SELECT company, topic_key, unit_key, count(*) FILTER (up) AS up_count, count(*) FILTER (down) AS down_count FROM w_ev GROUP BY ALL HAVING count(*) FILTER (up) > 0 AND count(*) FILTER (down) > 0")


@query("agg31_direction_conflicts", "SELECT * FROM w_conf")
def _(b):
    return W.direction_conflicts(_evidence(b)).select("company", "topic_key", "unit_key", "up_count", "down_count")


@query("agg32_assessment", """
SELECT e.company, count(*) AS evidence_count, round_even(greatest(0.0, least(1.0, avg(confidence) + CASE WHEN count(DISTINCT agent) = 2 THEN 0.1 ELSE 0.0 END - least(0.25, max(coalesce(c.n, 0)) * 0.05))), 3) AS overall_confidence, count(DISTINCT agent) AS agents
FROM w_ev e LEFT JOIN (SELECT company, count(DISTINCT evidence_id) AS n FROM w_ev JOIN w_conf USING (company, topic_key, unit_key) WHERE up OR down GROUP BY 1) c USING (company) GROUP BY e.company""")
def _(b):
    e = _evidence(b)
    a = W.assess(e, W.conflicting_evidence(e, W.direction_conflicts(e)))
    return a.select("company", "evidence_count", "overall_confidence", "agents")


# --- drafts, scores, outlook ----------------------------------------------------------------


def _priorities(b):
    s = b.table("supplier")
    key = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("C"), (key % 5).cast("string")).alias("company"), key.alias("priority_id"), F.concat(F.lit("Priority "), key.cast("string")).alias("priority"), (key % 10 / 10).alias("confidence"),
        F.lit("growing quickly.").alias("explanation"),
        F.when(key % 7 == 0, F.array().cast("array<string>")).when(key % 6 == 0, F.array(F.lit("EV1"), F.lit("missing"))).otherwise(F.array(F.concat(F.lit("S"), key.cast("string")), F.concat(F.lit("H"), (key + F.when(key % 2 == 0, 0).otherwise(10000)).cast("string")), F.concat(F.lit("S"), key.cast("string")))).alias("supporting_evidence_ids"),
    )


def _facts(b):
    """Known evidence: one strategy item per supplier and a hiring item for the even ones (odd ones point past 10000)."""
    key = F.col("s_suppkey")
    s = b.table("supplier")
    company = F.concat(F.lit("C"), (key % 5).cast("string")).alias("company")
    strategy = s.select(company, F.concat(F.lit("S"), key.cast("string")).alias("evidence_id"), F.lit("strategy").alias("agent"), F.when(key % 3 == 0, F.lit("leadership")).otherwise(F.lit("news")).alias("evidence_type"), (key % 4 / 4).alias("confidence"),
                        F.when(key % 2 == 0, F.lit("2026-08-01")).otherwise(F.lit("2026-01-01")).alias("source_date"), key.alias("position"))
    hiring = s.select(company, F.concat(F.lit("H"), (key + F.when(key % 2 == 0, 0).otherwise(10000)).cast("string")).alias("evidence_id"), F.when(key % 2 == 0, F.lit("hiring")).otherwise(F.lit("strategy")).alias("agent"), F.lit("hiring").alias("evidence_type"),
                      (key % 8 / 8).alias("confidence"), F.lit("2025-09-15").alias("source_date"), (key + 100000).alias("position"))
    return strategy.unionByName(hiring)


def _opportunities(b):
    key = F.col("s_suppkey")
    return b.table("supplier").select(
        F.concat(F.lit("C"), (key % 5).cast("string")).alias("company"), key.alias("opportunity_id"), F.concat(F.lit("Deal "), key.cast("string")).alias("title"), F.concat(F.lit("PRIORITY--"), key.cast("string")).alias("client_priority"),
        F.lit("solve").alias("recommended_solution"), F.lit("problem").alias("business_problem"), F.concat(F.lit("act "), key.cast("string")).alias("recommended_sales_action"), (key % 5 / 5).alias("consulting_fit"),
        F.when(key % 9 == 0, F.lit(180)).alias("suggested_horizon_days"), F.array(F.concat(F.lit("S"), key.cast("string")), F.when(key % 2 == 0, F.concat(F.lit("H"), key.cast("string"))).otherwise(F.concat(F.lit("S"), key.cast("string")))).alias("supporting_evidence_ids"),
    )


view("w_prio", """
SELECT 'C' || (s_suppkey % 5) AS company, s_suppkey AS id, 'Priority ' || s_suppkey AS priority, (s_suppkey % 10) / 10 AS confidence, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 6 = 0 THEN false ELSE true END AS ok FROM supplier
""")


@query("flt15_priorities", "SELECT company, priority, CASE WHEN ok THEN '' ELSE 'Priority ''' || priority || ''' was removed because its evidence was invalid.' END AS limitation FROM w_prio")
def _(b):
    return W.validate_priorities(_priorities(b), _facts(b)).select("company", "priority", F.coalesce("limitation", F.lit("")).alias("limitation"))


@query("flt15_opportunities", "SELECT company, 'Deal ' || id AS title, CASE WHEN ok THEN '' ELSE 'Opportunity ''Deal ' || id || ''' was removed because it lacked a validated priority.' END AS limitation FROM w_prio")
def _(b):
    kept = W.validate_priorities(_priorities(b), _facts(b))
    return W.validate_opportunities(_opportunities(b), _facts(b), kept).select("company", "title", F.coalesce("limitation", F.lit("")).alias("limitation"))


view("w_score", """
SELECT company, id, round_even((0.20 * confidence + 0.15 * CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + 0.15 * CASE WHEN id % 2 = 0 THEN (id % 8) / 8 ELSE 0 END + 0.10 * CASE WHEN id % 3 <> 0 THEN 1 ELSE 0 END
  + 0.10 * (id % 5) / 5 + 0.05 * CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.5 END) * 100, 1)::DOUBLE AS score FROM w_prio WHERE ok
""")
view("w_hor", "SELECT *, CASE WHEN id % 9 = 0 THEN 180 WHEN score >= 75 THEN 30 WHEN score >= 60 THEN 60 WHEN score >= 45 THEN 90 WHEN score >= 30 THEN 180 ELSE 360 END AS horizon_days FROM w_score")


def _scored(b):
    prios = W.validate_priorities(_priorities(b), _facts(b))
    kept = W.validate_opportunities(_opportunities(b), _facts(b), prios).filter("limitation IS NULL").drop("priority_key", "limitation")
    return W.score_opportunities(kept, _facts(b), prios.filter("limitation IS NULL"), AS_OF)


@query("sig22_opportunity_scores", "SELECT company, id AS opportunity_id, score FROM w_score")
def _(b):
    return _scored(b).select("company", "opportunity_id", "score")


@query("sig24_horizons", "SELECT company, id AS opportunity_id, horizon_days, CASE WHEN id % 9 = 0 THEN 'Evidence-backed action mapped to the 180-day window.' WHEN horizon_days = 180 THEN 'Further relationship and solution development is required.' WHEN horizon_days = 90 THEN 'Moderate readiness supports assessment or early proposal work.' WHEN horizon_days = 60 THEN 'Strong signals support near-term stakeholder qualification.' WHEN horizon_days = 30 THEN 'High evidence and fit support immediate discovery.' ELSE 'Limited readiness makes this a longer-term monitoring opportunity.' END AS horizon_reason FROM w_hor")
def _(b):
    return _scored(b).select("company", "opportunity_id", "horizon_days", "horizon_reason")


@query("sig24_horizon_sections", """
SELECT c.company, h.horizon_days, (SELECT count(*) FROM w_hor w WHERE w.company = c.company AND w.horizon_days = h.horizon_days) AS opportunity_count FROM (SELECT DISTINCT company FROM w_hor) c, (VALUES (30), (60), (90), (180), (360)) h(horizon_days)""")
def _(b):
    return W.horizon_sections(_scored(b)).select("company", "horizon_days", "opportunity_count")


@query("sig23_recency", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.25 WHEN o_orderkey % 7 = 0 THEN 0.0 WHEN d <= 90 THEN 1.0 WHEN d <= 180 THEN 0.75 WHEN d <= 365 THEN 0.5 ELSE 0.25 END::DOUBLE AS recency FROM (SELECT o_orderkey, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-06-01')) AS d FROM orders)")
def _(b):
    from signalloom.functions.dates import recency_score

    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 0, F.lit("soon")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return b.table("orders").select("o_orderkey", recency_score(text, "2000-06-01").alias("recency"))


def _index(b):
    """Hiring support: the lines of each supplier."""
    return b.table("lineitem").select(
        F.concat(F.lit("C"), (F.col("l_suppkey") % 5).cast("string")).alias("company"), F.concat(F.lit("H"), F.col("l_suppkey").cast("string")).alias("evidence_id"),
        F.concat(F.lit("kg:technology:"), F.col("l_suppkey").cast("string")).alias("reference"), F.col("l_orderkey").cast("string").alias("job_id"))


@query("sig25_outlook", """
SELECT w.company, w.id AS deal, score, position, coalesce(j.n, 0) AS relevant_hiring_jobs, CASE WHEN w.id % 2 = 0 THEN '' ELSE 'No direct hiring evidence was linked to this opportunity.' END AS limitation, 'act ' || w.id AS action
FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY score DESC, 'priority--' || id) AS position FROM w_hor) w LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) j ON l_suppkey = w.id WHERE position <= 5""")
def _(b):
    o = W.outlook(_scored(b), _facts(b), _index(b))
    action = F.coalesce(*[F.col(f"horizon_{h}") for h in L.HORIZONS])
    return o.select("company", F.expr("cast(substring(opportunity_theme, 6) AS int)").alias("deal"), "score", "position", F.coalesce("relevant_hiring_jobs", F.lit(0)).alias("relevant_hiring_jobs"), F.coalesce("limitation", F.lit("")).alias("limitation"), action.alias("action"))


@query("joi18_outlook_support", "SELECT DISTINCT w.company, 'priority ' || w.id AS priority_key, CAST(l_orderkey AS VARCHAR) AS job_id FROM w_hor w JOIN lineitem ON l_suppkey = w.id WHERE w.id % 2 = 0")
def _(b):
    return W.outlook_support(_scored(b), _facts(b), _index(b)).select("company", "priority_key", "job_id")


def _kg(b):
    return b.table("supplier").select(F.concat(F.lit("C"), (F.col("s_suppkey") % 5).cast("string")).alias("company"), F.lit("technology").alias("concept_type"), F.lower("s_name").alias("concept_key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("job_count"))


@query("joi19_report_references", """
SELECT company, domain, count(*) AS n FROM (SELECT 'C' || (s_suppkey % 5) AS company, unnest(['strategy', CASE WHEN s_suppkey % 2 = 0 THEN 'hiring' ELSE 'strategy' END, 'hiring_kg']) AS domain FROM supplier) GROUP BY ALL""")
def _(b):
    return W.report_references(_facts(b), _kg(b)).groupBy("company", "domain").agg(F.count(F.lit(1)).alias("n"))


@query("joi19_known_references", "SELECT company, id AS priority_id, CASE WHEN id % 6 = 0 THEN 0 ELSE 3 END AS n FROM w_prio WHERE id % 7 <> 0 AND id % 6 <> 0")
def _(b):
    known = W.known_references(_priorities(b), W.report_references(_facts(b), _kg(b)))
    return known.groupBy("company", "priority_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("joi20_aligned_priorities", "SELECT company, priority FROM w_prio WHERE ok AND id % 2 = 0")
def _(b):
    kept = W.validate_priorities(_priorities(b), _facts(b)).filter("limitation IS NULL")
    return W.aligned_priorities(kept, _facts(b)).select("company", "priority")


@query("sig26_report_findings", """
SELECT section, count(*) AS n, max(title) AS last_title FROM (SELECT 'strategic_priorities' AS section, priority AS title FROM w_prio WHERE ok UNION ALL SELECT 'cross_domain_alignment', priority FROM w_prio WHERE ok AND id % 2 = 0
  UNION ALL SELECT 'hiring_intelligence', 'Observed technology: ' || s_name FROM supplier UNION ALL SELECT 'business_areas_to_watch', s_name FROM supplier) GROUP BY 1""")
def _(b):
    kept = W.validate_priorities(_priorities(b), _facts(b)).filter("limitation IS NULL")
    none = b.spark.createDataFrame([], "company string, title string, summary string, signal_id string")
    findings = W.report_findings(kept, W.aligned_priorities(kept, _facts(b)), _kg(b), _kg(b), none)
    return findings.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.max("title").alias("last_title"))


@query("sig27_strategy_summary", """
SELECT company, round_even(avg(confidence), 4) AS reliability, count(*) AS theme_count, string_agg(priority, ', ' ORDER BY id) AS themes FROM w_prio GROUP BY 1""")
def _(b):
    return W.strategy_summary(_priorities(b), order="priority_id").select("company", "reliability", "theme_count", "themes")


# --- research gates -------------------------------------------------------------------------

_PHRASES = ["we will expand", "Our top priority is cost", "completed the exit", "is focused on growth", "nothing stated"]
_TYPES = ["annual_report", "news", "earnings_call", "other", "sec_filing"]


def _research(b):
    """Lines as research evidence of their order's signal."""
    line = b.table("lineitem")
    pick = lambda column, values: F.element_at(F.array(*[F.lit(v) for v in values]), (column % 5 + 1).cast("int"))
    return line.select(
        F.col("l_orderkey").alias("signal_id"), F.col("l_suppkey").cast("string").alias("source_id"), pick(F.col("l_partkey"), _PHRASES).alias("statement"), pick(F.col("l_suppkey"), _TYPES).alias("source_type"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("publication_date"))


view("r_ev", """
SELECT l_orderkey AS signal_id, l_suppkey AS source_id, l_partkey % 5 AS ph, l_suppkey % 5 AS ty, CAST(l_shipdate AS DATE) AS d FROM lineitem
""")
view("r_gate", """
SELECT signal_id, (count(*) >= 2 AND count(DISTINCT source_id) >= 2) OR bool_or(ty IN (0, 2, 4) AND ph = 0) AS minimum_evidence, signal_id % 2 <> 0 OR bool_or(ph = 1) AS question_strength,
  NOT bool_or(ph = 2) OR bool_or(ph IN (0, 3)) AS temporal_consistency, signal_id % 3 = 0 AS self_negating FROM r_ev GROUP BY 1
""")


def _gated(b):
    signals = b.table("lineitem").select(F.col("l_orderkey").alias("signal_id")).distinct().withColumns(
        {
            "question": F.when(F.col("signal_id") % 2 == 0, F.lit("Is cloud a major strategic priority?")).otherwise(F.lit("What is a major priority?")),
            "hypothesis": F.when(F.col("signal_id") % 3 == 0, F.lit("Cost is not a major standalone priority")).otherwise(F.lit("Cost is a major priority")),
        }
    )
    return R.quality_gate(signals, _research(b))


for _name, _column in (("flt11_minimum_evidence", "minimum_evidence"), ("flt12_question_strength", "question_strength"), ("flt13_temporal_consistency", "temporal_consistency"), ("flt14_self_negating", "self_negating")):

    @query(_name, f"SELECT signal_id, {_column} FROM r_gate")
    def _(b, column=_column):
        return _gated(b).select("signal_id", column)


@query("agg33_research_confidence", """
SELECT signal_id, round_even(least(1.0, CASE WHEN bool_or(ty IN (0, 4)) THEN 0.30 ELSE 0.0 END + CASE WHEN bool_or(ty = 2) THEN 0.25 ELSE 0.0 END + CASE WHEN count(DISTINCT source_id) >= 2 THEN 0.20 ELSE 0.0 END + CASE WHEN bool_or(ty = 1) THEN 0.15 ELSE 0.0 END
  + CASE WHEN bool_or(d >= DATE '2000-06-01' - 548) THEN 0.10 ELSE 0.0 END), 2)::DOUBLE AS confidence FROM r_ev GROUP BY 1""")
def _(b):
    return R.research_confidence(_research(b), "2000-06-01").select("signal_id", "confidence")


@query("joi16_attach_source", "SELECT l_orderkey AS signal_id, l_linenumber AS n, 'https://s.example.com/' || l_suppkey AS source_url, 'news' AS source_type FROM lineitem WHERE l_suppkey % 4 <> 0")
def _(b):
    evidence = b.table("lineitem").select(F.col("l_orderkey").alias("signal_id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("source_id"), F.lit("claimed").alias("source_url"), F.lit("other").alias("source_type"))
    sources = b.table("supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("https://s.example.com/"), F.col("s_suppkey").cast("string")).alias("url"), F.lit("news").alias("source_type"), F.lit("2026-01-01").alias("publication_date"))
    return R.attach_source(evidence, sources).select("signal_id", "n", "source_url", "source_type")


_RELATIONS = list(L.CITATION_WEIGHTS)


@query("agg34_citation_reliability", """
SELECT o.o_orderkey AS answer_id, CASE WHEN coalesce(k.n, 0) = 0 THEN 0.0 WHEN coalesce(c.m, 0) = 0 THEN CAST(printf('%.4f', CAST(least(0.4, k.n / 5) AS DOUBLE)) AS DOUBLE) ELSE CAST(printf('%.4f', CAST(least(1.0, (c.q + least(c.m / 3, 1.0) + least(k.n / 5, 1.0)) / 3) AS DOUBLE)) AS DOUBLE) END::DOUBLE AS reliability FROM orders o
LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) k ON k.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS m, avg(CASE l_linenumber % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 WHEN 3 THEN 0.7 WHEN 4 THEN 0.65 ELSE 0.65 END::DOUBLE) AS q FROM lineitem WHERE l_quantity > 25 GROUP BY 1) c ON c.l_orderkey = o_orderkey""")
def _(b):
    answers = b.table("orders").select(F.col("o_orderkey").alias("answer_id"))
    catalog = b.table("lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_partkey").alias("evidence_id"))
    relation = F.element_at(F.array(*[F.lit(r) for r in _RELATIONS]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    cited = b.table("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("answer_id"), F.col("l_partkey").alias("evidence_id"), relation.alias("relationship_type"))
    return R.citation_reliability(answers, cited, catalog, 5).select("answer_id", "reliability")


_CLASSES = list(L.SUPPORT_WEIGHTS)


@query("agg35_finding_reliability", """
SELECT o_orderkey AS answer_id, round_even(greatest(0.0, least(1.0, CASE WHEN f.n IS NULL THEN least(0.35, s) ELSE s END)), 4) AS reliability FROM (
  SELECT o_orderkey, f.n, 0.25::DOUBLE * coalesce(f.q, 0) + 0.2::DOUBLE * least(coalesce(f.jobs, 0) / 5, 1.0) + 0.2::DOUBLE * 0.81234 + 0.15::DOUBLE * 0.51237 + 0.1::DOUBLE * least(15 / 30, 1.0) + 0.1::DOUBLE * CASE WHEN f.n > 0 THEN 1 ELSE 0 END AS s
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, avg(w) AS q, count(DISTINCT l_partkey) AS jobs FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 ELSE 0.8 END::DOUBLE AS w FROM lineitem WHERE l_quantity > 25) GROUP BY 1) f ON l_orderkey = o_orderkey)
  LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) f ON f.k = o_orderkey""")
def _(b):
    answers = b.table("orders").select(F.col("o_orderkey").alias("answer_id"))
    kind = F.element_at(F.array(*[F.lit(r) for r in _CLASSES]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    row = F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    supports = b.table("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("answer_id"), F.lit(1).alias("finding_id"), row.alias("support_id"), kind.alias("support_class"), F.col("l_partkey").alias("job_id"))
    context = answers.select("answer_id", F.lit(0.81234).alias("evidence_coverage"), F.lit(0.51237).alias("enrichment_coverage"), F.lit("2026-01-01").cast("date").alias("observation_start"), F.lit("2026-01-16").cast("date").alias("observation_end"))
    return R.finding_reliability(answers, supports, context).select("answer_id", "reliability")
