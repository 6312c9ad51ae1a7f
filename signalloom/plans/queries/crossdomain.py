"""Cross-domain overlaps."""

from pyspark.sql import Window, functions as F

from signalloom.operators import crossdomain as X, evidence as E, ordering as O
from signalloom.plans.binding import UNITS
from signalloom.plans.registry import query

_COLS = "organization, signal_id, signal_type, p AS primary_subject, r AS related_subject, hs AS hiring_contributor_count, ts AS technology_contributor_count, ov AS overlap, round_even(strength, 8) AS strength, round_even(confidence, 8) AS confidence, round_even(evidence_coverage, 8) AS evidence_coverage"


def _show(frame):
    return frame.select("organization", "signal_id", "signal_type", "primary_subject", "related_subject", "hiring_contributor_count", "technology_contributor_count", "overlap",
                        *[F.bround(c, 8).alias(c) for c in ("strength", "confidence", "evidence_coverage")])


for _name, _family in (("joi6_capability_overlap", "capability"), ("joi7_city_overlap", "city"), ("joi9_leadership_overlap", "leadership")):

    @query(_name, f"SELECT {_COLS} FROM b_align WHERE family = '{_family}'")
    def _(b, family=_family):
        return _show(b.lean("technology").alignments.filter(F.col("family") == family))


@query("joi8_business_unit_overlap", f"SELECT {_COLS} FROM b_ualign")
def _(b):
    b = b.lean("technology")
    return _show(X.alignments(b.unit_overlaps, b.gate, UNITS))


@query("joi10_signal_clusters", f"SELECT {_COLS} FROM b_calign")
def _(b):
    return _show(b.lean("technology").alignments.filter("family = 'cluster'"))


@query("sig16_coverage_context", """
SELECT t.organization, t.total_jobs, t.enriched_jobs, t.observations AS technology_observation_count, coalesce(u.n, 0) AS jobs_with_evidence, coalesce(h.n, 0) AS hiring_signal_count, coalesce(s.n, 0) AS technology_signal_count,
  round_even(t.coverage, 8) AS enrichment_coverage, t.organization IN (SELECT organization FROM b_gate) AS passes
FROM b_ttot t LEFT JOIN (SELECT organization, count(DISTINCT job_id) AS n FROM b_uni GROUP BY 1) u USING (organization)
LEFT JOIN (SELECT organization, count(*) AS n FROM b_hsig GROUP BY 1) h USING (organization) LEFT JOIN (SELECT organization, count(*) AS n FROM b_tsig GROUP BY 1) s USING (organization)""")
def _(b):
    b = b.lean("technology")
    c = b.context
    return c.select("organization", "total_jobs", "enriched_jobs", "technology_observation_count", "jobs_with_evidence", "hiring_signal_count", "technology_signal_count", F.bround("enrichment_coverage", 8).alias("enrichment_coverage"), "passes")


@query("sig17_alignment_titles", """
SELECT signal_id, CASE family WHEN 'capability' THEN 'Observed overlap between ' || p || ' hiring and ' || r WHEN 'leadership' THEN 'Observed leadership hiring overlap with ' || r
  WHEN 'cluster' THEN 'Observed overlap between hiring and technology signals' ELSE 'Observed ' || r || ' hiring overlap in ' || p END AS title FROM (SELECT * FROM b_cross UNION ALL SELECT * FROM b_ualign)""")
def _(b):
    b = b.lean("technology")
    return b.alignments.unionByName(X.alignments(b.unit_overlaps, b.gate, UNITS)).select("signal_id", "title")


@query("sig18_cross_domain_signals", f"SELECT {_COLS} FROM b_cross")
def _(b):
    b = b.lean("technology")
    return _show(b.alignments)


@query("sig18_cross_domain_support", "SELECT DISTINCT x.organization, signal_id, u.job_id, evidence_id FROM b_xsup x JOIN b_uni u USING (evidence_id)")
def _(b):
    return b.lean("technology").alignment_support


@query("joi11_related_signals", """
SELECT DISTINCT x.organization, x.signal_id, s.domain, s.signal_id AS related_id FROM b_xsup x
JOIN (SELECT 'hiring' AS domain, signal_id, evidence_id FROM b_hsup UNION ALL SELECT 'technology', signal_id, evidence_id FROM b_tsup) s USING (evidence_id) WHERE family <> 'cluster'
UNION ALL SELECT organization, signal_id, 'hiring', hid FROM b_calign UNION ALL SELECT organization, signal_id, 'technology', tid FROM b_calign""")
def _(b):
    b = b.lean("technology")
    return X.related_signals(b.tagged, b.alignments, X.signal_gates(b.hiring_signals, b.technology_signals, b.gate))


@query("joi13_evidence_trace", """
SELECT u.evidence_id, u.job_id, u.organization, enrichment_present, coalesce(hiring_signal_count, 0) AS hiring_signal_count, coalesce(technology_signal_count, 0) AS technology_signal_count, coalesce(x.n, 0) AS cross_domain_signal_count,
  concat_ws(' ', CASE WHEN NOT enrichment_present THEN 'No persisted enrichment uses this evidence.' END, CASE WHEN coalesce(technology_signal_count, 0) = 0 THEN 'No technology signals currently cite this evidence.' END,
  CASE WHEN coalesce(x.n, 0) = 0 THEN 'No cross-domain strategic signals currently cite this evidence.' END) AS limitations
FROM b_uni u LEFT JOIN b_links USING (evidence_id) LEFT JOIN (SELECT evidence_id, count(DISTINCT signal_id) AS n FROM b_xsup GROUP BY 1) x USING (evidence_id)""")
def _(b):
    b = b.staged
    t = E.trace(b.unified, X.alignment_citations(b.tagged, b.alignments))
    return t.select("evidence_id", "job_id", "organization", "enrichment_present", "hiring_signal_count", "technology_signal_count", "cross_domain_signal_count", F.array_join("limitations", " ").alias("limitations"))


@query("set1_signal_union", """
SELECT organization, 'hiring' AS domain, signal_id, signal_type FROM b_hsig UNION ALL SELECT organization, 'technology', signal_id, signal_type FROM b_tsig""")
def _(b):
    b = b.staged
    side = lambda frame, name: frame.select("organization", F.lit(name).alias("domain"), "signal_id", "signal_type")
    return O.union_all(side(b.hiring_signals, "hiring"), side(b.technology_signals, "technology"))


@query("set2_intersection_count", """
SELECT t.organization, t.normalized_technology, count(*) AS shared FROM (SELECT DISTINCT organization, normalized_technology, job_id FROM b_obs) t WHERE job_id IN (SELECT job_id FROM b_caps WHERE capability = 'PROMO') GROUP BY ALL""")
def _(b):
    left = b.observations.select("organization", "normalized_technology", "job_id")
    promo = E.search_jobs(b.jobs, capability="PROMO").select("organization", "job_id")
    return O.intersect_count(left, left.join(promo, ["organization", "job_id"], "left_semi"), ["job_id"], ["organization", "normalized_technology"])


@query("set3_unknown_evidence", "SELECT job_id, evidence_id FROM b_jobs WHERE evidence_id NOT IN (SELECT evidence_id FROM b_evidence)")
def _(b):
    return O.not_in(b.postings, b.evidence, ["evidence_id"]).select("job_id", "evidence_id")


@query("set5_distinct_first", """
SELECT user_id, event_type, first_seen, row_number() OVER (PARTITION BY user_id ORDER BY first_seen) AS place FROM (SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY ALL)""")
def _(b):
    found = O.distinct_first(b.table("events"), ["event_type"], "event_id", ["user_id"])
    return found.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("first_seen")))  # as many rows as a user has event types


@query("set4_subset_check", """
SELECT signal_id, count(*) AS outside FROM (SELECT DISTINCT signal_id, evidence_id FROM b_hsup) WHERE evidence_id NOT IN (SELECT evidence_id FROM b_evidence) GROUP BY 1""")
def _(b):
    b = b.lean("hiring")
    pairs = lambda share: share.hiring_support.select("signal_id", "evidence_id")
    cited = pairs(b.sole).unionByName(pairs(b.shared).distinct())
    return O.subset_violations(cited, b.evidence, ["evidence_id"], ["signal_id"])
