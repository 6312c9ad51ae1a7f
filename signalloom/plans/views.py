"""Building blocks of the checking SQL: the bound model over the driver's tables."""

from signalloom.plans.registry import view

view("b_jobs", """
SELECT r_name AS organization, CAST(o_orderkey AS VARCHAR) AS job_id, c_name AS title,
  c_mktsegment || ' role at ' || c_name || ', ' || n_name AS description,
  CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN n_name || ', ' || c_mktsegment WHEN o_orderkey % 4 = 1 THEN n_name
       WHEN o_orderkey % 4 = 2 THEN n_name || ', ' || c_mktsegment || ', ' || r_name ELSE n_name || ', ' || c_mktsegment || ' / Remote, ' || r_name END AS location,
  CASE n_nationkey // 5 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'IN' WHEN 3 THEN 'GB' ELSE 'AU' END AS country,
  CASE WHEN o_orderkey % 3 <> 0 THEN c_mktsegment END AS business_unit,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN substr(o_orderpriority, 3) END AS seniority_level,
  o_orderpriority = '1-URGENT' AS is_leadership, CAST(o_orderdate AS DATE) AS posted_date, o_orderstatus AS employment_type,
  'https://jobs.example.com/' || o_orderkey AS source_url, 'E' || o_orderkey AS evidence_id
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
view("b_caps", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS job_id, p_type AS capability FROM lineitem JOIN part ON l_partkey = p_partkey")
view("b_techs", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS job_id, p_brand AS technology FROM lineitem JOIN part ON l_partkey = p_partkey")
view("b_evidence", """
SELECT 'E' || o_orderkey AS evidence_id, 'https://jobs.example.com/' || o_orderkey AS source_url, CASE WHEN o_orderkey % 2 = 0 THEN 'career_site' ELSE 'job_board' END AS source_type,
  c_name AS source_title, o_orderdate AS retrieved_at, c_mktsegment || ' role  at ' || c_name AS source_excerpt, 'ref:' || o_orderkey AS raw_reference,
  c_mktsegment AS collector_identity, CASE WHEN o_orderkey % 5 = 0 THEN 'Workday' ELSE c_mktsegment END AS source
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 50 <> 0
""")
view("b_enr", """
SELECT CAST(l_orderkey AS VARCHAR) AS job_id, CASE WHEN l_linenumber = 3 THEN 'X' ELSE 'E' END || l_orderkey AS evidence_id, l_returnflag AS provider, l_linestatus AS model,
  printf('v%d.%09d.%09d', l_linenumber, l_partkey, l_suppkey) AS prompt_schema_version, l_shipdate AS enrichment_timestamp,
  p_brand AS t1, 'Brand#' || (l_suppkey % 25 + 1) AS t2, p_type AS capability, p_name, CASE WHEN l_suppkey % 7 <> 0 THEN n_name END AS business_unit,
  CASE l_linenumber % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'director' ELSE 'unknown' END AS seniority_level,
  l_discount + 0.5 AS confidence, l_tax > 0.04 AS has_field_confidence, sha256(p_name) AS source_content_hash
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
""")
view("b_latest", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY enrichment_timestamp DESC, prompt_schema_version DESC, provider DESC, model DESC) AS rn FROM b_enr) WHERE rn = 1
""")
view("b_runs", """
SELECT printf('run-%09d-%d', l_suppkey, y) AS run_id, r_name AS organization, started_at, completed_at, pages_attempted, records_encountered, records_encountered - records_skipped AS records_collected, records_skipped,
  CASE WHEN records_skipped = 0 THEN 'completed' ELSE 'partial' END AS status
FROM (SELECT l_suppkey, year(l_shipdate) AS y, min(l_shipdate) AS started_at, max(l_shipdate) AS completed_at, count(*) AS records_encountered, count(*) FILTER (l_returnflag = 'R') AS records_skipped, count(DISTINCT l_orderkey) AS pages_attempted
  FROM lineitem GROUP BY ALL) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
view("b_lastrun", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organization ORDER BY completed_at DESC, started_at DESC, run_id DESC) AS n FROM b_runs) WHERE n = 1")
view("b_rows", """
SELECT j.*, e.source_type, l.job_id IS NOT NULL AND l.evidence_id = j.evidence_id AS is_enriched, l.t1, l.t2, l.business_unit AS e_unit, l.seniority_level AS e_seniority,
  l.confidence AS e_confidence, l.has_field_confidence, l.provider, l.model, l.prompt_schema_version, l.p_name AS e_name
FROM b_jobs j JOIN b_evidence e USING (evidence_id) LEFT JOIN b_latest l USING (job_id)
""")
view("b_cand", """
SELECT job_id, technology, prio FROM (
  SELECT job_id, t1 AS technology, 1 AS prio FROM b_rows WHERE is_enriched
  UNION ALL SELECT job_id, t2, 2 FROM b_rows WHERE is_enriched
  UNION ALL SELECT t.job_id, t.technology, 3 FROM b_techs t JOIN b_rows r USING (job_id))
""")
view("b_norm", """
SELECT *, CASE lower(technology) WHEN 'brand#1' THEN 'AWS' WHEN 'brand#2' THEN 'AWS' WHEN 'brand#3' THEN 'Oracle' ELSE technology END AS normalized FROM b_cand
""")
view("b_obs", """
SELECT r.organization, n.job_id, r.evidence_id, r.title AS job_title, r.source_type, n.technology, n.normalized AS normalized_technology,
  CASE WHEN n.normalized = 'AWS' THEN 'Cloud Platform' WHEN n.normalized = 'Oracle' THEN 'Database'
       WHEN CAST(regexp_extract(n.normalized, '[0-9]+') AS INT) BETWEEN 5 AND 12 THEN 'Data Platform' ELSE 'Other' END AS category,
  r.posted_date AS observation_date, r.location,
  CASE WHEN n.prio < 3 THEN coalesce(r.e_unit, r.business_unit) ELSE r.business_unit END AS business_unit,
  CASE WHEN n.prio < 3 THEN r.e_seniority ELSE 'unknown' END AS seniority,
  CASE WHEN n.prio < 3 THEN CASE WHEN r.has_field_confidence THEN 0.9::DOUBLE ELSE r.e_confidence END ELSE 0.6::DOUBLE END AS confidence,
  CASE WHEN n.prio < 3 THEN r.provider ELSE 'keyword_match' END AS provider, r.is_enriched, n.prio,
  CASE WHEN n.prio = 3 THEN CASE WHEN brand % 3 = 0 AND form_at > 0 THEN trim(substr(r.description, greatest(1, form_at - 10), form_at + 17 - greatest(1, form_at - 10)))
    WHEN brand % 3 = 1 AND starts_with(lower(r.description), segment || ' ') THEN trim(substr(r.description, 1, length(segment) + 10)) END
  WHEN (CASE lower(r.t1) WHEN 'brand#1' THEN 'AWS' WHEN 'brand#2' THEN 'AWS' WHEN 'brand#3' THEN 'Oracle' ELSE r.t1 END) = n.normalized THEN r.e_name END AS excerpt
FROM (SELECT job_id, arg_min(technology, (prio, technology)) AS technology, arg_min(normalized, (prio, technology)) AS normalized, min(prio) AS prio FROM b_norm GROUP BY job_id, lower(normalized)) m
JOIN (SELECT *, strpos(description, 'role at') AS form_at FROM b_rows) r USING (job_id),
LATERAL (SELECT m.job_id, m.technology, m.normalized, m.prio, CAST(regexp_extract(m.technology, '[0-9]+') AS INT) AS brand,
  ['automobile', 'building', 'furniture', 'household', 'machinery'][CAST(regexp_extract(m.technology, '[0-9]+') AS INT) % 5 + 1] AS segment) n
""")
view("b_places", """
SELECT organization, job_id, evidence_id, country, list_filter(list_transform(string_split(place, ','), lambda x: trim(x)), lambda x: x <> '') AS parts
FROM (SELECT organization, job_id, evidence_id, country, unnest(string_split(location, ' / ')) AS place FROM b_jobs)
""")
view("b_facets", """
SELECT organization, 'total' AS family, '' AS value, job_id, evidence_id, posted_date FROM b_jobs
UNION ALL SELECT j.organization, 'with_capability', '', job_id, evidence_id, posted_date FROM b_jobs j WHERE job_id IN (SELECT job_id FROM b_caps)
UNION ALL SELECT organization, 'with_seniority', '', job_id, evidence_id, posted_date FROM b_jobs WHERE seniority_level IS NOT NULL
UNION ALL SELECT organization, 'with_location', '', job_id, evidence_id, posted_date FROM b_jobs WHERE trim(location) <> ''
UNION ALL SELECT organization, 'country', trim(country), job_id, evidence_id, posted_date FROM b_jobs WHERE trim(country) <> ''
UNION ALL SELECT DISTINCT p.organization, 'city', p.parts[1], p.job_id, p.evidence_id, j.posted_date FROM b_places p JOIN b_jobs j USING (job_id) WHERE len(p.parts) > 0
UNION ALL SELECT DISTINCT p.organization, 'region', CASE WHEN len(p.parts) >= 3 THEN p.parts[-2] ELSE p.parts[2] END, p.job_id, p.evidence_id, j.posted_date
  FROM b_places p JOIN b_jobs j USING (job_id) WHERE len(p.parts) >= 3 OR (len(p.parts) = 2 AND upper(p.country) IN ('US', 'CA', 'AU'))
UNION ALL SELECT organization, 'capability', capability, job_id, evidence_id, posted_date FROM b_jobs JOIN b_caps USING (job_id)
UNION ALL SELECT organization, 'seniority', seniority_level, job_id, evidence_id, posted_date FROM b_jobs WHERE seniority_level IS NOT NULL
UNION ALL SELECT organization, 'leadership', '', job_id, evidence_id, posted_date FROM b_jobs WHERE is_leadership
UNION ALL SELECT organization, 'day', strftime(posted_date, '%Y-%m-%d'), job_id, evidence_id, posted_date FROM b_jobs
UNION ALL SELECT organization, 'week', strftime(date_trunc('week', posted_date), '%Y-%m-%d'), job_id, evidence_id, posted_date FROM b_jobs
""")
view("b_counts", """
SELECT organization, family, value, count(*) AS job_count, count(DISTINCT evidence_id) AS evidence_count FROM b_facets GROUP BY ALL
""")
view("b_totals", """
SELECT organization, count(*) AS total_jobs, count(*) FILTER (job_id IN (SELECT job_id FROM b_caps)) AS classified_jobs, count(seniority_level) AS seniority_jobs,
  count(*) FILTER (trim(location) <> '') AS location_jobs, count(*) FILTER (is_leadership) AS leaders, count(DISTINCT evidence_id) AS all_evidence,
  min(posted_date) AS d0, max(posted_date) AS d1, date_diff('day', min(posted_date), max(posted_date)) AS span
FROM b_jobs GROUP BY organization
""")
view("b_halves", """
SELECT organization, count(*) AS bucket_count, avg(job_count) FILTER (n <= bn // 2) AS a0, avg(job_count) FILTER (n > bn // 2) AS a1
FROM (SELECT *, row_number() OVER (PARTITION BY organization ORDER BY value) AS n, count(*) OVER (PARTITION BY organization) AS bn FROM b_counts WHERE family = 'week') GROUP BY organization
""")
UUID5 = "substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||substr({h},21,12)"


def uuid5(text: str) -> str:
    """Name-based UUID of a SQL text expression."""
    return UUID5.format(h=f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')||encode({text}))")


# The thresholds of the binding, written out.
view("b_hsig0", """
SELECT c.organization, family, value, job_count, evidence_count, 'geographic_hiring_concentration' AS signal_type,
  CASE family WHEN 'country' THEN 'country' WHEN 'region' THEN 'state/region' ELSE 'city' END || ':' || value AS subject, 'Observed hiring concentration in ' || value AS title,
  round_even(job_count / total_jobs * 100, 2) AS pct, round_even(job_count / total_jobs * 100, 2) / 100 AS s, least(1.0, job_count / 4) AS suff, location_jobs / total_jobs AS cov
FROM b_counts c JOIN b_totals t USING (organization) WHERE family IN ('country', 'region', 'city') AND total_jobs >= 5 AND job_count >= 2 AND round_even(job_count / total_jobs * 100, 2) >= 18.0
UNION ALL
SELECT c.organization, family, value, job_count, evidence_count, 'capability_hiring_concentration', value, 'Observed hiring demand for ' || value,
  round_even(job_count / classified_jobs * 100, 2), round_even(job_count / classified_jobs * 100, 2) / 100, least(1.0, job_count / 4), classified_jobs / total_jobs
FROM b_counts c JOIN b_totals t USING (organization) WHERE family = 'capability' AND classified_jobs >= 3 AND classified_jobs / total_jobs >= 0.5 AND job_count >= 2 AND round_even(job_count / classified_jobs * 100, 2) >= 30.0
UNION ALL
SELECT c.organization, family, value, job_count, evidence_count, 'leadership_hiring', 'leadership', 'Observed leadership hiring activity',
  round_even(job_count / total_jobs * 100, 2), round_even(job_count / total_jobs * 100, 2) / 100, least(1.0, job_count / 4), seniority_jobs / total_jobs
FROM b_counts c JOIN b_totals t USING (organization) WHERE family = 'leadership' AND total_jobs >= 5 AND seniority_jobs / total_jobs >= 0.5 AND job_count >= 2
UNION ALL
SELECT organization, 'total', '', total_jobs, all_evidence, 'hiring_volume', 'observed-volume', 'Observed hiring volume', NULL, least(1.0, total_jobs / 10), least(1.0, total_jobs / 10), 1.0
FROM b_totals WHERE total_jobs >= 5
UNION ALL
SELECT organization, 'total', '', total_jobs, all_evidence, 'hiring_trend', 'weekly:' || CASE WHEN a1 > a0 THEN 'increased' ELSE 'decreased' END,
  'Observed weekly hiring activity ' || CASE WHEN a1 > a0 THEN 'increased' ELSE 'decreased' END, NULL, least(1.0, abs((a1 - a0) / a0)), least(1.0, bucket_count / 8), least(1.0, span / 21)
FROM b_totals JOIN b_halves USING (organization) WHERE bucket_count >= 4 AND span >= 21 AND abs((a1 - a0) / a0) >= 0.02
""")
view("b_hsig", f"""
SELECT s.*, {uuid5("'hiring-signal:' || organization || '|' || signal_type || '|' || subject || '|' || strftime(d0, '%Y-%m-%d') || '|' || strftime(d1, '%Y-%m-%d')")} AS signal_id,
  round_even(greatest(0.0, least(1.0, s)), 4) AS strength, round_even((least(1.0, evidence_count / job_count) + suff + cov) / 3, 4) AS confidence,
  round_even(least(1.0, evidence_count / job_count), 4) AS evidence_coverage, d0, d1, total_jobs, classified_jobs, seniority_jobs, span
FROM b_hsig0 s JOIN b_totals USING (organization)
""")
view("b_hsup", "SELECT f.organization, s.signal_id, s.signal_type, s.title, f.job_id, f.evidence_id FROM b_facets f JOIN b_hsig s USING (organization, family, value)")
view("b_tfac", """
SELECT organization, 'technology' AS family, normalized_technology AS label, normalized_technology AS technology, category, 1 AS n, job_id, evidence_id FROM b_obs
UNION ALL SELECT organization, 'category', category, NULL, category, count(*), job_id, evidence_id FROM b_obs GROUP BY ALL
UNION ALL SELECT organization, 'business_unit', business_unit, normalized_technology, NULL, 1, job_id, evidence_id FROM b_obs WHERE business_unit IS NOT NULL AND business_unit <> 'unknown'
UNION ALL SELECT organization, 'location', location, normalized_technology, NULL, 1, job_id, evidence_id FROM b_obs WHERE location <> 'unknown'
UNION ALL SELECT organization, 'seniority', seniority, normalized_technology, NULL, 1, job_id, evidence_id FROM b_obs WHERE seniority <> 'unknown'
""")
view("b_tcnt", "SELECT organization, family, label, technology, category, count(*) AS job_count, sum(n)::BIGINT AS observation_count, count(DISTINCT evidence_id) AS evidence_count FROM b_tfac GROUP BY ALL")
view("b_ttot", """
SELECT t.organization, t.total_jobs, t.d0, t.d1, t.span, coalesce(enriched_jobs, 0) AS enriched_jobs, coalesce(jobs_with_signal, 0) AS jobs_with_signal, coalesce(observations, 0) AS observations, coalesce(techs, 0) AS techs,
  coalesce(enriched_jobs, 0) / total_jobs AS coverage
FROM b_totals t LEFT JOIN (SELECT organization, count(*) FILTER (is_enriched) AS enriched_jobs FROM b_rows GROUP BY 1) USING (organization)
LEFT JOIN (SELECT organization, count(DISTINCT job_id) AS jobs_with_signal, count(*) AS observations, count(DISTINCT normalized_technology) AS techs FROM b_obs GROUP BY 1) USING (organization)
""")
view("b_tcat", "SELECT organization, category, count(*) AS cat_techs FROM b_tcnt WHERE family = 'technology' GROUP BY ALL")
view("b_tsig0", """
SELECT c.organization, family, label, technology, job_count, evidence_count, 'technology_concentration' AS signal_type, label AS subject, 'Observed hiring concentration for ' || label AS title,
  least(job_count / enriched_jobs * 100, 100.0) / 100 AS s FROM b_tcnt c JOIN b_ttot USING (organization)
WHERE family = 'technology' AND job_count >= 3 AND least(job_count / enriched_jobs * 100, 100.0) / 100 >= 0.2
UNION ALL SELECT c.organization, family, label, technology, job_count, evidence_count, 'technology_category_concentration', label, 'Observed ' || label || ' hiring concentration', observation_count / observations
FROM b_tcnt c JOIN b_ttot USING (organization) JOIN b_tcat k ON k.organization = c.organization AND k.category = c.category WHERE family = 'category' AND job_count >= 3 AND cat_techs >= 2 AND observation_count / observations >= 0.3
UNION ALL SELECT c.organization, family, label, technology, job_count, evidence_count, 'business_unit_technology_concentration', label || ':' || technology, 'Observed ' || technology || ' hiring cluster in ' || label, job_count / enriched_jobs
FROM b_tcnt c JOIN b_ttot USING (organization) WHERE family = 'business_unit' AND job_count >= 3 AND job_count / enriched_jobs >= 0.02
UNION ALL SELECT c.organization, family, label, technology, job_count, evidence_count, 'geographic_technology_concentration', label || ':' || technology, 'Observed ' || technology || ' hiring cluster in ' || label, job_count / enriched_jobs
FROM b_tcnt c JOIN b_ttot USING (organization) WHERE family = 'location' AND job_count >= 3 AND job_count / enriched_jobs >= 0.02
UNION ALL SELECT c.organization, family, label, technology, job_count, evidence_count, 'technology_hiring_cluster', label, 'Observed technology hiring cluster in ' || label, least(1.0, cat_techs / 6)
FROM b_tcnt c JOIN b_tcat k ON k.organization = c.organization AND k.category = c.category WHERE family = 'category' AND job_count >= 3 AND cat_techs >= 3 AND observation_count >= 5
""")
view("b_tsig", f"""
SELECT s.*, {uuid5("s.organization || '|' || signal_type || '|' || subject || '|' || strftime(d0, '%Y-%m-%d') || '|' || strftime(d1, '%Y-%m-%d') || '|technology-signals-v1'")} AS signal_id,
  greatest(0.0, least(1.0, s.s)) AS strength, evidence_count / job_count AS evidence_coverage,
  least(1.0, (coverage + evidence_count / job_count + least(1.0, job_count / 6)) / 3) AS confidence, d0, d1
FROM b_tsig0 s JOIN b_ttot t ON t.organization = s.organization WHERE enriched_jobs >= 5 AND coverage >= 0.25 AND observations >= 5
""")
view("b_tsup", """
SELECT f.organization, s.signal_id, s.signal_type, s.title, f.job_id, f.evidence_id FROM b_tfac f JOIN b_tsig s
ON f.organization = s.organization AND f.family = s.family AND f.label = s.label AND coalesce(f.technology, '') = coalesce(s.technology, '')
""")
view("b_uni", """
SELECT j.organization, j.job_id, j.evidence_id, j.title AS job_title, j.location AS job_location, j.posted_date AS observed_at, e.source, e.source_type, e.retrieved_at AS captured_at,
  CASE WHEN l.job_id IS NOT NULL THEN l.business_unit ELSE j.business_unit END AS business_unit, l.job_id IS NOT NULL AS enrichment_present, l.provider, l.model, l.prompt_schema_version,
  l.confidence, l.t1, l.t2, l.capability, l.seniority_level AS seniority, trim(regexp_replace(e.source_excerpt, '\\s+', ' ', 'g')) AS preview
FROM b_jobs j JOIN b_evidence e USING (evidence_id) LEFT JOIN b_latest l USING (job_id)
""")
view("b_links", """
SELECT evidence_id, count(*) FILTER (k = 'h') AS hiring_signal_count, count(*) FILTER (k = 't') AS technology_signal_count, count(*) FILTER (k = 'o') AS technology_observation_count FROM (
  SELECT DISTINCT evidence_id, signal_id, 'h' AS k FROM b_hsup UNION ALL SELECT DISTINCT evidence_id, signal_id, 't' FROM b_tsup
  UNION ALL SELECT DISTINCT evidence_id, job_id || '~' || normalized_technology, 'o' FROM b_obs) GROUP BY evidence_id
""")
view("b_gate", """
SELECT * FROM b_ttot WHERE total_jobs >= 10 AND enriched_jobs >= 5 AND coverage >= 0.25 AND observations >= 3 AND span >= 14
""")
view("b_hgrp", """
SELECT c.organization, family, value AS subject, job_count AS size, CASE WHEN family = 'capability' THEN round_even(job_count / classified_jobs * 100, 2) ELSE round_even(job_count / total_jobs * 100, 2) END / 100 AS conc
FROM b_counts c JOIN b_totals USING (organization) WHERE family IN ('capability', 'city', 'leadership') AND organization IN (SELECT organization FROM b_gate)
""")
view("b_hmem", """
SELECT f.organization, f.family, f.value AS subject, f.job_id AS member, f.evidence_id, size, conc FROM b_facets f JOIN b_hgrp g ON f.organization = g.organization AND f.family = g.family AND f.value = g.subject
WHERE size >= 3 AND conc >= 0.18
""")
view("b_tmem", """
SELECT f.organization, f.technology AS subject, f.job_id AS member, f.evidence_id, c.job_count AS size, least(c.job_count / enriched_jobs * 100, 100.0) / 100 AS conc
FROM b_tfac f JOIN b_tcnt c ON c.family = 'technology' AND f.organization = c.organization AND f.technology = c.technology JOIN b_gate t ON t.organization = f.organization
WHERE f.family = 'technology' AND c.job_count >= 3 AND least(c.job_count / enriched_jobs * 100, 100.0) / 100 >= 0.18
""")
view("b_pairs", """
SELECT h.organization, h.family, h.subject AS p, t.subject AS r, h.member, h.evidence_id, h.size AS hs, t.size AS ts, h.conc AS hc, t.conc AS tc, NULL AS hid, NULL AS tid
FROM b_hmem h JOIN b_tmem t ON h.organization = t.organization AND h.member = t.member
""")
view("b_urec", """
SELECT organization, business_unit AS unit, job_id, evidence_id, t1, t2 FROM b_uni WHERE business_unit <> ''
""")
view("b_utech", "SELECT organization, unit, job_id, evidence_id, t1 AS tech FROM b_urec WHERE t1 IS NOT NULL UNION SELECT organization, unit, job_id, evidence_id, t2 FROM b_urec WHERE t2 IS NOT NULL")
for _name, _least in (("b_upairs", 0.18), ("b_upairs_low", 0.004)):
    view(_name, f"""
SELECT x.organization, 'business_unit' AS family, x.unit AS p, x.tech AS r, x.job_id AS member, x.evidence_id, u.hs, y.ts, u.hs / g.total_jobs AS hc, y.ts / g.enriched_jobs AS tc, NULL AS hid, NULL AS tid
FROM b_utech x JOIN (SELECT organization, unit, count(*) AS hs FROM b_urec GROUP BY ALL) u ON u.organization = x.organization AND u.unit = x.unit
JOIN (SELECT organization, unit, tech, count(*) AS ts FROM b_utech GROUP BY ALL) y ON y.organization = x.organization AND y.unit = x.unit AND y.tech = x.tech
JOIN b_gate g ON g.organization = x.organization
WHERE u.hs >= 3 AND y.ts >= 3 AND u.hs / g.total_jobs >= {_least} AND y.ts / g.enriched_jobs >= {_least}
""")
view("b_cside", """
SELECT 'h' AS side, s.organization, s.signal_id, s.title, s.strength AS conc, m.evidence_id FROM b_hsig s JOIN (SELECT DISTINCT signal_id, evidence_id FROM b_hsup) m USING (signal_id)
WHERE s.strength >= 0.18 AND s.organization IN (SELECT organization FROM b_gate) AND m.evidence_id IN (SELECT evidence_id FROM b_uni)
UNION ALL SELECT 't', s.organization, s.signal_id, s.title, s.strength, m.evidence_id FROM b_tsig s JOIN (SELECT DISTINCT signal_id, evidence_id FROM b_tsup) m USING (signal_id)
WHERE s.strength >= 0.18 AND s.organization IN (SELECT organization FROM b_gate) AND m.evidence_id IN (SELECT evidence_id FROM b_uni)
""")
view("b_csize", "SELECT signal_id, count(*) AS size FROM b_cside GROUP BY 1 HAVING count(*) >= 3")
view("b_cpairs", """
SELECT h.organization, 'cluster' AS family, h.title AS p, t.title AS r, h.evidence_id AS member, h.evidence_id, hz.size AS hs, tz.size AS ts, h.conc AS hc, t.conc AS tc, h.signal_id AS hid, t.signal_id AS tid
FROM b_cside h JOIN b_cside t ON h.side = 'h' AND t.side = 't' AND h.organization = t.organization AND h.evidence_id = t.evidence_id
JOIN b_csize hz ON hz.signal_id = h.signal_id JOIN b_csize tz ON tz.signal_id = t.signal_id
""")
CROSS_ID = uuid5("'cross-domain:' || a.organization || '|' || signal_type || '|' || p || '|' || r || '|' || strftime(d0, '%Y-%m-%d') || '|' || strftime(d1, '%Y-%m-%d') || '|cross-domain-signals-v1'")
_TYPE = "CASE family WHEN 'capability' THEN 'capability_technology_alignment' WHEN 'city' THEN 'geographic_technology_alignment' WHEN 'business_unit' THEN 'business_unit_technology_alignment' WHEN 'leadership' THEN 'leadership_technology_alignment' ELSE 'hiring_technology_cluster' END"
for _name, _source in (("b_align", "SELECT * FROM b_pairs UNION ALL SELECT * FROM b_upairs"), ("b_calign", "SELECT * FROM b_cpairs"), ("b_ualign", "SELECT * FROM b_upairs_low")):
    view(_name, f"""
SELECT a.*, {CROSS_ID} AS signal_id, least(1.0, (hc + tc + least(1.0, ov / greatest(hs, ts))) / 3) AS strength, least(1.0, ev / ov) AS evidence_coverage,
  least(1.0, (coverage + least(1.0, ev / ov) + least(1.0, ov / 6)) / 3) AS confidence
FROM (SELECT organization, family, {_TYPE} AS signal_type, CASE WHEN family = 'leadership' THEN 'leadership hiring' ELSE p END AS p, r, hs, ts, hc, tc, hid, tid, count(*) AS ov, count(DISTINCT evidence_id) AS ev
  FROM ({_source}) GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT evidence_id) >= 3) a JOIN b_gate g ON g.organization = a.organization""")
view("b_cross", "SELECT * FROM b_align UNION ALL SELECT * FROM b_calign")
view("b_xsup", """
SELECT DISTINCT a.organization, a.signal_id, a.family, m.evidence_id FROM b_align a JOIN (SELECT * FROM b_pairs UNION ALL SELECT * FROM b_upairs) m
ON m.organization = a.organization AND m.family = a.family AND CASE WHEN m.family = 'leadership' THEN 'leadership hiring' ELSE m.p END = a.p AND m.r = a.r
UNION SELECT c.organization, c.signal_id, 'cluster', m.evidence_id FROM b_calign c JOIN b_cpairs m ON m.hid = c.hid AND m.tid = c.tid
""")
