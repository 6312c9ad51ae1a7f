"""Sources, sinks, snapshot signals, audits, planning and streams.

Scores are compared after rounding the exact binary value, which in DuckDB is what ``printf`` does;
its ``round_even`` rounds the product with the power of ten and turns 0.0375 into 0.038.
"""

from pyspark.sql import functions as F

from signalloom.functions import ids as I, text as X
from signalloom.operators import ordering as O, runs as R, snapshot as P
from signalloom.plans.registry import day, query, view
from signalloom.session import scratch_path
from signalloom.sources import snapshots as S, tables
from signalloom.streaming import events as V

# --- snapshot files -------------------------------------------------------------------------


def _snapshot_rows(b):
    """Orders as snapshot rows: several orders share a job id or an address."""
    orders = b.table("orders").join(b.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(b.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("o_orderkey")
    return orders.select(
        F.col("r_name").alias("company"), F.concat(F.lit("J"), F.floor(key / 3).cast("string")).alias("source_job_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("role_family"),
        F.col("n_name").alias("city"), F.lit("").alias("state"), F.lit("US").alias("country"), F.when(F.col("o_orderstatus") == "F", F.lit("Full Time")).otherwise(F.lit("Contract")).alias("employment_type"),
        F.concat(F.lit("Role, with \"quotes\"\nand lines "), F.col("o_orderpriority")).alias("description_text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("source_posted_at"),
        F.concat(F.lit("HTTPS://Jobs.example.com/p/"), F.floor((key + 1) / 2).cast("string"), F.when(key % 2 == 0, F.lit("/?ref=1")).otherwise(F.lit(""))).alias("posting_url"), key.alias("n"),
    )


def _csv(b):
    path = scratch_path(b.spark, "snapshot")
    _snapshot_rows(b).repartitionByRange(4, "n").sortWithinPartitions("n").withColumn("n", F.col("n").cast("string")).write.option("header", True).option("escape", '"').csv(path)
    return path


_RAW = "SELECT r_name AS company, 'J' || (o_orderkey // 3) AS source_job_id, 'https://jobs.example.com/p/' || ((o_orderkey + 1) // 2) AS url, o_orderkey AS n, c_name AS title, o_orderpriority, o_orderdate, o_orderstatus, n_name AS city, c_mktsegment AS role_family FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
view("s_raw", _RAW)


@query("src1_read_snapshot", "SELECT company, source_job_id, title, CAST(n AS VARCHAR) AS n, length('Role, with \"quotes\" and lines ' || o_orderpriority) AS description_chars FROM s_raw")
def _(b):
    df = S.read_snapshot(b.spark, _csv(b))
    return df.select("company", "source_job_id", "title", "n", F.length("description_text").alias("description_chars"))


@query("src2_row_origin", "SELECT count(*) AS rows_read, count(DISTINCT o_orderkey) AS positions FROM orders")
def _(b):
    return S.read_snapshot(b.spark, _csv(b)).agg(F.count(F.lit(1)).alias("rows_read"), F.count_distinct("arrival").alias("positions"))


@query("src3_column_aliases", "SELECT CAST(n AS VARCHAR) AS n, CASE WHEN n % 2 = 0 THEN title ELSE role_family END AS description FROM s_raw")
def _(b):
    raw = _snapshot_rows(b).select(F.col("n").cast("string").alias("n"), F.when(F.col("n") % 2 == 0, F.col("title")).alias("description"), F.col("role_family").alias("description_text"))
    return S.coalesce_aliases(raw, {"description": ["description", "description_text", "absent"]}).select("n", "description")


def _contexts(b):
    return b.table("region").filter("r_name <> 'AFRICA'").select(
        F.upper(X.slug("r_name")).alias("company_id"), F.col("r_name").alias("canonical_name"), F.array(F.lower("r_name")).alias("aliases"), F.lit(None).cast("array<string>").alias("allowed_subsidiaries"), F.array(F.lit("Nobody")).alias("excluded_entities"))


@query("flt7_company_scope", "SELECT replace(company, ' ', '_') AS company_id, count(*) AS n FROM s_raw WHERE company <> 'AFRICA' GROUP BY 1")
def _(b):
    return S.filter_company(_snapshot_rows(b), _contexts(b)).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))


# First-wins in rounds: pairs that are first under both keys stay, those that share a key with one go.
view("s_rounds", """
SELECT 0 AS round, a, b, o, 'open' AS state FROM (SELECT company || '|' || source_job_id AS a, company || '|' || url AS b, min(n) AS o FROM s_raw GROUP BY ALL)
UNION ALL
SELECT round + 1, a, b, o, CASE WHEN state <> 'open' THEN state WHEN kept_a OR kept_b THEN 'dropped' WHEN o = first_a AND o = first_b THEN 'kept' ELSE 'open' END
FROM (SELECT *, min(CASE WHEN state = 'open' THEN o END) OVER (PARTITION BY a) AS first_a, min(CASE WHEN state = 'open' THEN o END) OVER (PARTITION BY b) AS first_b,
  bool_or(state = 'kept') OVER (PARTITION BY a) AS kept_a, bool_or(state = 'kept') OVER (PARTITION BY b) AS kept_b, bool_or(state = 'open') OVER () AS going FROM s_rounds)
WHERE going
""", recursive=True)
view("s_first", "SELECT r.* FROM s_raw r JOIN s_rounds d ON d.o = r.n AND d.state = 'kept' AND d.round = (SELECT max(round) FROM s_rounds)")


@query("win3_dedupe_either", "SELECT company, source_job_id, url AS address, n FROM s_first")
def _(b):
    rows = _snapshot_rows(b).withColumn("address", X.canonical_url("posting_url"))
    keyed = rows.withColumns({"k1": F.concat_ws("|", "company", "source_job_id"), "k2": F.concat_ws("|", "company", "address")})
    return O.dedupe_either(keyed, "k1", "k2", "n").select("company", "source_job_id", "address", "n")


@query("agg25_ingest_diagnostics", """
SELECT replace(r.company, ' ', '_') AS company_id, (SELECT count(*) FROM s_raw) AS rows_read, accepted AS rows_accepted, 0::BIGINT AS rows_rejected, own - accepted AS duplicates_removed, (SELECT count(*) FROM s_raw) - own AS other_company_rows
FROM (SELECT company, count(*) AS own FROM s_raw GROUP BY 1) r JOIN (SELECT company, count(*) AS accepted FROM s_first GROUP BY 1) f USING (company) WHERE r.company <> 'AFRICA'""")
def _(b):
    _, diagnostics = S.load_snapshot(_snapshot_rows(b), _contexts(b), order="n")
    return diagnostics


@query("import_snapshot_rows", "SELECT source_job_id, role_family AS capability, strftime(o_orderdate, '%Y-%m-%d') AS posted_date, CASE WHEN o_orderstatus = 'F' THEN 'full_time' ELSE 'contract' END AS employment_type, city AS location, 'csv_import:' || replace(lower(company), ' ', '_') || ':' || source_job_id AS raw_reference FROM s_raw")
def _(b):
    raw = _snapshot_rows(b).withColumns({c: F.lit(None).cast("string") for c in ("qualifications_text", "responsibilities_text", "first_seen_at", "workplace_type")})
    good, _ = S.split_quarantine(S.import_rows(raw.withColumn("company", F.replace("company", F.lit(" "), F.lit("_"))), "2026-08-31"))
    return good.select("source_job_id", F.col("capability_classifications")[0].alias("capability"), day("posted_date"), "employment_type", "location", "raw_reference")


def _payloads(b):
    key = F.col("o_orderkey")
    info = F.struct(
        F.when(key % 10 != 0, F.col("c_name")).alias("title"), F.concat(F.lit("<p>Work &amp; grow</p><div>"), F.col("c_mktsegment"), F.lit("</div>")).alias("jobDescription"), F.col("n_name").alias("location"),
        F.array(F.col("n_name"), F.lit("Remote ")).alias("additionalLocations"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("startDate"), F.lit("Full time").alias("timeType"),
        F.when(key % 7 != 0, key.cast("string")).alias("jobReqId"), F.concat(F.lit("https://x.example.com/"), key.cast("string")).alias("externalUrl"), F.struct(F.lit("India").alias("descriptor"), F.lit("in").alias("alpha2Code")).alias("country"),
        F.struct(F.struct(F.when(key % 3 == 0, F.lit("GBR")).alias("alpha2Code")).alias("country")).alias("jobRequisitionLocation"),
    )
    rows = b.table("orders").join(b.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(b.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    shaped = rows.select(
        F.struct(F.lit("fallback title").alias("title"), F.lit("/p").alias("externalPath"), F.array(F.lit("Posting End Date: 2030-01-31")).alias("bulletFields")).alias("search_summary"),
        F.struct(info.alias("jobPostingInfo"), F.struct(F.lit("Acme").alias("name")).alias("hiringOrganization")).alias("job_detail"),
        (key % 100).alias("page"), (key % 5).cast("string").alias("run_id"),
    )
    path = scratch_path(b.spark, "payloads")
    shaped.write.json(path)
    return S.normalize_payloads(S.read_payloads(b.spark, path, "page int, run_id string"), "Acme", "acme-feed-v1", "acme:")


@query("src4_nested_payloads", """
SELECT coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END, '') AS source_job_id, CASE WHEN o_orderkey % 10 <> 0 THEN c_name ELSE 'fallback title' END AS title, 'Work & grow' || chr(10) || c_mktsegment AS description,
  n_name || ' / Remote' AS location, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'IN' END AS country, '2030-01-31' AS closing_date, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'missing_requisition_id' END, CASE WHEN o_orderkey % 3 = 0 THEN 'missing_country' END) AS codes
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(b):
    p = _payloads(b)
    return p.select(F.coalesce("source_job_id", F.lit("")).alias("source_job_id"), "title", "description", "location", F.coalesce("country", F.lit("")).alias("country"), day("closing_date"), F.array_join("reject_codes", ",").alias("codes"))


_BAD = "(o_orderkey % 7 = 0 OR o_orderkey % 3 = 0)"


@query("agg26_run_audit", f"""
SELECT CAST(o_orderkey % 5 AS VARCHAR) AS run_id, count(DISTINCT o_orderkey % 100) AS pages_attempted, count(*) AS records_encountered, count(*) FILTER (NOT {_BAD}) AS records_collected, count(*) FILTER ({_BAD}) AS records_skipped, count(*) FILTER ({_BAD}) AS issue_count FROM orders GROUP BY 1""")
def _(b):
    return R.run_audit(_payloads(b))


@query("agg26_audit_violations", "SELECT run_id FROM b_runs WHERE records_encountered <> records_collected + records_skipped OR completed_at < started_at")
def _(b):
    return R.audit_violations(b.runs).select("run_id")


@query("agg27_run_status", """
SELECT run_id, CASE WHEN records_skipped > 3 AND records_collected = 0 THEN 'failed' WHEN pages_attempted % 2 = 0 AND records_skipped = 0 THEN 'completed' WHEN records_skipped > 0 OR pages_attempted % 2 = 1 THEN 'partial' ELSE 'completed' END AS resolved FROM b_runs""")
def _(b):
    stopped = F.col("pages_attempted") % 2 == 1
    return b.runs.select("run_id", R.run_status(F.col("records_collected"), F.col("records_skipped"), ~stopped, F.col("records_skipped") > 3, stopped).alias("resolved"))


def _page_cache(b):
    """Pages as JSON lines; one in five is cut off in the middle."""
    pages = b.table("pages")
    path = scratch_path(b.spark, "page-cache")
    address = F.concat(F.lit("HTTPS://Cache.example.com/p/"), F.col("page_id").cast("string"))
    fields = F.struct(
        F.lit("completed").alias("status"), address.alias("source_url"), F.col("html").alias("text"),
        F.struct(F.struct(F.when(F.col("page_id") % 4 == 0, F.lit("Other Corp")).when(F.col("page_id") % 4 == 1, F.lit("ACME, Inc.")).alias("name")).alias("hiringOrganization")).alias("structured_data"),
    )
    line = F.to_json(fields)
    pages.select(F.when(F.col("page_id") % 5 == 2, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    return S.read_page_cache(b.spark, path, per_file=False)


@query("src5_unreadable_pages", "SELECT 'unreadable' AS status, count(*) AS n FROM pages WHERE page_id % 5 = 2")
def _(b):
    return _page_cache(b).filter("status = 'unreadable' AND warning LIKE 'not a page document: %' AND url_key IS NULL").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("src5_page_cache", """
SELECT page_id, CASE WHEN page_id % 5 = 2 THEN 'none' WHEN page_id % 4 = 0 THEN 'failed' ELSE 'cached' END AS status,
  CASE WHEN page_id % 4 = 0 OR page_id % 5 = 2 THEN 0 ELSE length(html) END AS chars FROM pages""")
def _(b):
    pages = b.table("pages")
    address = F.concat(F.lit("HTTPS://Cache.example.com/p/"), F.col("page_id").cast("string"))
    contexts = b.spark.createDataFrame([("ACME", "Acme", ["acme inc"], [], [])], "company_id string, canonical_name string, aliases array<string>, allowed_subsidiaries array<string>, excluded_entities array<string>")
    jobs = pages.select("page_id", F.concat(address, F.lit("/?again")).alias("posting_url"), F.lit("ACME").alias("company_id"))
    checked = S.validate_page_company(S.attach_pages(jobs, _page_cache(b)), contexts)
    return checked.select("page_id", F.coalesce("page_status", F.lit("none")).alias("status"), F.coalesce(F.length("page_text"), F.lit(0)).alias("chars"))


@query("flt8_page_company", "SELECT page_id, page_id % 4 = 0 AS is_foreign FROM pages")
def _(b):
    pages = b.table("pages").select("page_id", F.lit("ACME").alias("company_id"), F.when(F.col("page_id") % 4 == 0, F.lit("Other Corp")).when(F.col("page_id") % 4 == 1, F.lit("acme")).alias("named"), F.col("html").alias("page_text"), F.lit("cached").alias("page_status"), F.lit(None).cast("string").alias("page_warning"))
    contexts = b.spark.createDataFrame([("ACME", "Acme")], "company_id string, canonical_name string").withColumns({c: F.lit(None).cast("array<string>") for c in ("aliases", "allowed_subsidiaries", "excluded_entities")})
    return S.validate_page_company(pages, contexts, "named").select("page_id", F.col("page_text").isNull().alias("is_foreign"))


# --- upserts --------------------------------------------------------------------------------


def _upserted(b, stored, updates, keys, preserve=(), order=()):
    """The stored table after the updates, by way of its files."""
    path = scratch_path(b.spark, "bucketed")
    tables.create_buckets(stored, path, keys)
    tables.upsert_buckets(b.spark, path, updates, keys, preserve, order)
    return tables.read_buckets(b.spark, path).drop("bucket")


@query("snk1_upsert_evidence", """
SELECT coalesce(u.evidence_id, e.evidence_id) AS evidence_id, coalesce(u.title, e.source_title) AS source_title FROM b_evidence e FULL JOIN (SELECT 'E' || o_orderkey AS evidence_id, 'new ' || o_orderkey AS title FROM orders WHERE o_orderkey % 10 = 0) u USING (evidence_id)""")
def _(b):
    updates = b.table("orders").filter("o_orderkey % 10 = 0").select(F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("evidence_id"), F.concat(F.lit("new "), F.col("o_orderkey").cast("string")).alias("source_title"))
    return _upserted(b, b.evidence.select("evidence_id", "source_title"), updates, tables.EVIDENCE_KEY)


@query("snk2_upsert_jobs", """
SELECT organization, j.job_id AS source_job_id, j.job_id, CASE WHEN CAST(j.job_id AS INT) % 4 = 0 THEN 'F' || j.job_id ELSE j.evidence_id END AS evidence_id FROM b_jobs j
UNION ALL SELECT 'NEW', 'N' || n_nationkey, 'fresh-' || n_nationkey, 'FN' || n_nationkey FROM nation""")
def _(b):
    stored = b.postings.select("organization", "source_job_id", "job_id", "evidence_id")
    changed = stored.filter("cast(job_id AS int) % 4 = 0").select("organization", "source_job_id", F.concat(F.lit("other-"), "job_id").alias("job_id"), F.concat(F.lit("F"), "job_id").alias("evidence_id"), F.lit(2).alias("position"))
    earlier = changed.withColumns({"evidence_id": F.lit("lost"), "position": F.lit(1)})
    name = F.col("n_nationkey").cast("string")
    fresh = b.table("nation").select(F.lit("NEW").alias("organization"), F.concat(F.lit("N"), name).alias("source_job_id"), F.concat(F.lit("fresh-"), name).alias("job_id"), F.concat(F.lit("FN"), name).alias("evidence_id"), F.lit(1).alias("position"))
    return _upserted(b, stored, changed.unionByName(earlier).unionByName(fresh), tables.JOB_KEY, ["job_id"], [F.col("position")])


@query("snk3_upsert_enrichments", "SELECT job_id, evidence_id, provider, model, prompt_schema_version, CASE WHEN provider = 'R' THEN 0.99 ELSE confidence END::DOUBLE AS confidence FROM b_enr")
def _(b):
    stored = b.enrichments.select(*tables.ENRICHMENT_KEY, "confidence")
    return _upserted(b, stored, stored.filter("provider = 'R'").withColumn("confidence", F.lit(0.99)), tables.ENRICHMENT_KEY)


@query("snk4_upsert_runs", "SELECT run_id, CASE WHEN records_skipped > 2 THEN 'rerun' ELSE status END AS status FROM b_runs")
def _(b):
    stored = b.runs.select("run_id", "status", "records_skipped")
    return _upserted(b, stored, stored.filter("records_skipped > 2").withColumn("status", F.lit("rerun")), tables.RUN_KEY).select("run_id", "status")


def _research(b):
    rows = b.table("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max("l_shipdate").alias("created_at"), F.count(F.lit(1)).alias("n"))
    supplier = b.table("supplier").join(b.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("r_name").alias("organization"), F.col("s_name").alias("question_key"), F.col("l_returnflag").alias("time_horizon"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("v1").alias("agent_version"), "created_at", "n")


view("s_research", "SELECT r_name AS organization, s_name AS question_key, l_returnflag AS time_horizon, max(l_shipdate) AS created_at, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")


@query("snk5_upsert_research", "SELECT organization, question_key, time_horizon, CASE WHEN time_horizon = 'A' THEN -1 ELSE n END AS n FROM s_research")
def _(b):
    stored = _research(b)
    updates = stored.filter("time_horizon = 'A'").withColumn("n", F.lit(-1).cast("long"))
    return _upserted(b, stored, updates, tables.RESEARCH_KEY).select("organization", "question_key", "time_horizon", "n")


@query("win2_latest_research", "SELECT organization, question_key, time_horizon FROM (SELECT *, row_number() OVER (PARTITION BY organization ORDER BY created_at DESC, question_key, time_horizon) AS rn FROM s_research) WHERE rn = 1")
def _(b):
    return O.latest_per(_research(b), ["organization"], [F.desc("created_at"), F.col("question_key"), F.col("time_horizon")]).select("organization", "question_key", "time_horizon")


@query("snk6_save_batch", "SELECT organization, count(*) AS jobs, (SELECT count(*) FROM orders) AS saved FROM b_jobs GROUP BY 1")
def _(b):
    jobs = b.postings.withColumn("position", F.col("job_id").cast("long"))
    evidence = jobs.select("position", "evidence_id", "source_url")
    path = scratch_path(b.spark, "batch")
    saved = tables.save_batch(b.spark, jobs, evidence, path, "v1")
    stored = tables.read_saved(b.spark, path, "jobs")
    return stored.groupBy("organization").agg(F.count(F.lit(1)).alias("jobs")).withColumn("saved", F.lit(saved).cast("long"))


@query("snk7_check_enrichments", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN e.evidence_id NOT IN (SELECT evidence_id FROM b_evidence) OR e.job_id NOT IN (SELECT job_id FROM b_jobs) THEN 'enrichment source job and evidence must exist' ELSE 'none' END AS reason FROM b_enr e) GROUP BY 1""")
def _(b):
    checked = tables.check_enrichments(b.enrichments, b.postings, b.evidence)
    return checked.groupBy(F.coalesce("reject_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("snk9_report_documents", "SELECT organization, total_jobs FROM b_totals")
def _(b):
    path = scratch_path(b.spark, "report")
    tables.write_report(b.postings.groupBy("organization").agg(F.count(F.lit(1)).alias("total_jobs")), path)
    return b.spark.read.schema("organization string, total_jobs long").json(path)


# --- enrichment planning --------------------------------------------------------------------

_CURRENT = "SELECT job_id FROM b_enr WHERE provider = 'R' AND model = 'F' AND prompt_schema_version LIKE 'v1.%'"


def _current(b):
    """First versions of one provider and model; those of provider R were made from the job's present content."""
    present = b.postings.select("job_id", I.content_hash().alias("_present"))
    versions = b.enrichments.join(present, "job_id").withColumns({
        "prompt_schema_version": F.substring_index("prompt_schema_version", ".", 1),
        "source_content_hash": F.when(F.col("provider") == "R", F.col("_present")).otherwise(F.col("source_content_hash")),
    })
    return R.current_enrichments(versions, "R", "F", "v1")


@query("joi5_eligible", f"SELECT job_id FROM b_rows WHERE job_id NOT IN ({_CURRENT})")
def _(b):
    return R.eligible_for_enrichment(b.postings, b.evidence, _current(b)).select("job_id")


view("s_plan", f"""
SELECT organization, job_id, posted_date, CASE WHEN evidence_id NOT IN (SELECT evidence_id FROM b_evidence) THEN 'skipped_no_evidence' WHEN job_id IN ({_CURRENT}) THEN 'skipped_existing' END AS skip FROM b_jobs
""")
view("s_planned", "SELECT *, coalesce(skip, CASE WHEN row_number() OVER (PARTITION BY organization, skip IS NULL ORDER BY posted_date, job_id) <= 25 THEN 'planned' ELSE 'deferred_limit' END) AS status FROM s_plan")


@query("agg28_enrichment_plan", """
SELECT organization, count(*) AS discovered_jobs, count(*) FILTER (skip IS NULL) AS eligible_jobs, count(*) FILTER (status = 'planned') AS planned_jobs, count(*) FILTER (status = 'skipped_existing') AS existing_enrichment_skips,
  count(*) FILTER (status = 'skipped_no_evidence') AS no_evidence_skips, count(*) FILTER (status = 'deferred_limit') AS deferred_jobs FROM s_planned GROUP BY 1""")
def _(b):
    counts = R.plan_counts(R.enrichment_plan(b.postings, b.evidence, _current(b), 25))
    return counts.select("organization", "discovered_jobs", "eligible_jobs", "planned_jobs", "existing_enrichment_skips", "no_evidence_skips", "deferred_jobs")


_OUTCOMES = ["failed_validation", "failed_provider", "failed_persistence", None, "enriched", "enriched", "enriched"]
view("s_outcomes", """
SELECT organization, job_id, CASE WHEN status <> 'planned' THEN status ELSE coalesce((['failed_validation', 'failed_provider', 'failed_persistence', NULL, 'enriched', 'enriched', 'enriched'])[CAST(job_id AS BIGINT) % 7 + 1], 'deferred_limit') END AS status FROM s_planned
""")


def _reported(b):
    """What became of each planned job; one in seven was never attempted."""
    plan = R.enrichment_plan(b.postings, b.evidence, _current(b), 25)
    outcome = F.element_at(F.array(*map(F.lit, _OUTCOMES)), (F.col("job_id").cast("long") % 7 + 1).cast("int"))
    reported = b.postings.select("job_id", outcome.alias("outcome")).filter("outcome IS NOT NULL")
    return R.apply_outcomes(plan, reported)


@query("agg28_enrichment_outcomes", """
SELECT organization, count(*) AS discovered_jobs, count(*) FILTER (status NOT LIKE 'skipped%') AS eligible_jobs, count(*) FILTER (status = 'enriched' OR status LIKE 'failed%') AS planned_jobs, count(*) FILTER (status = 'enriched' OR status LIKE 'failed%') AS attempted_jobs,
  count(*) FILTER (status = 'enriched') AS enriched_jobs, count(*) FILTER (status = 'skipped_existing') AS existing_enrichment_skips, count(*) FILTER (status = 'skipped_no_evidence') AS no_evidence_skips, 0::BIGINT AS evidence_mismatch_skips, 0::BIGINT AS unusable_evidence_skips,
  count(*) FILTER (status LIKE 'failed%') AS failed_jobs, count(*) FILTER (status = 'deferred_limit') AS deferred_jobs FROM s_outcomes GROUP BY 1""")
def _(b):
    return R.plan_counts(_reported(b))


@query("agg28_outcome_statuses", "SELECT organization, status, count(*) AS n FROM s_outcomes GROUP BY ALL")
def _(b):
    return _reported(b).groupBy("organization", "status").agg(F.count(F.lit(1)).alias("n"))


@query("win7_first_eligible", "SELECT organization, job_id FROM s_planned WHERE status = 'planned'")
def _(b):
    return R.enrichment_plan(b.postings, b.evidence, _current(b), 25).filter("status = 'planned'").select("organization", "job_id")


@query("agg28_plan_violations", "SELECT r_name AS organization FROM region WHERE r_name LIKE 'A%'")
def _(b):
    """Counts of some organizations are made wrong, each in another way; all others add up."""
    counts = R.plan_counts(_reported(b))
    wrong = counts.withColumns({
        "eligible_jobs": F.when(F.col("organization") == "AFRICA", F.col("eligible_jobs") - 1).otherwise(F.col("eligible_jobs")),
        "failed_jobs": F.when(F.col("organization").startswith("A") & (F.col("organization") != "AFRICA"), F.col("failed_jobs") + 1).otherwise(F.col("failed_jobs")),
    })
    return R.plan_violations(wrong).select("organization")


# --- snapshot signals -----------------------------------------------------------------------


def _current_jobs(b):
    """All jobs as classified snapshot rows."""
    return b.jobs.select(
        F.col("organization").alias("company_id"), F.col("job_id").alias("source_job_id"), "title", "business_unit", F.lit(None).cast("string").alias("department"),
        F.coalesce(F.try_element_at("capability_classifications", F.lit(1)), F.lit("Other")).alias("capability"), F.col("technologies"), F.split("title", "#").alias("skills"),
        F.when(F.col("is_leadership"), F.lit("Director")).otherwise(F.lit("Mid")).alias("seniority"),
        F.when(F.col("employment_type") == "F", F.lit("completed")).when(F.col("employment_type") == "O", F.lit("failed")).otherwise(F.lit("skipped")).alias("extraction_status"),
        F.when(F.col("country") == "US", F.lit("llm")).otherwise(F.lit("heuristic")).alias("classification_source"), F.when(F.col("country") == "US", 0.75).otherwise(0.5).alias("classification_confidence"),
        F.lit("x").alias("city"), F.lit("").alias("state"), F.col("country"), F.col("posted_date").cast("string").alias("source_posted_at"), F.lit(None).cast("string").alias("structured_posted"), F.col("source_url").alias("posting_url"),
    )


def _sweep(b):
    """Open postings of all companies and capabilities over time; an order's dates are the sightings of its posting."""
    seen = b.table("orders").select(F.col("o_orderkey").cast("string").alias("source_job_id"), F.to_date("o_orderdate").alias("seen_on"))
    seen = seen.unionByName(b.table("lineitem").select(F.col("l_orderkey").cast("string").alias("source_job_id"), F.to_date("l_shipdate").alias("seen_on")))
    intervals = P.posting_intervals(seen, ["source_job_id"])
    return P.open_postings(_current_jobs(b).select("company_id", "capability", "source_job_id").join(intervals, "source_job_id"), ["company_id", "capability"])


def _history(b):
    """Counts one year before each company's newest posting; the first company by name has supplied none."""
    newest = b.postings.groupBy(F.col("organization").alias("company_id")).agg(F.add_months(F.max("posted_date"), -12).alias("as_of"))
    return P.historical_counts(_sweep(b), newest, b.table("region").agg(F.min("r_name").alias("company_id")))


view("p_all", """
SELECT organization AS company_id, job_id, title, business_unit, coalesce((SELECT min(capability) FROM b_caps c WHERE c.job_id = j.job_id), 'Other') AS capability, is_leadership, employment_type, country, posted_date, source_url FROM b_jobs j
""")
view("p_none", "SELECT min(r_name) AS without_history FROM region")
view("p_seen", """
SELECT job_id, min(d) AS first_seen, max(d) AS last_seen FROM (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY 1
""")
view("p_asof", "SELECT company_id, CAST(max(posted_date) - INTERVAL 12 MONTH AS DATE) AS as_of FROM p_all GROUP BY 1")
view("p_hist", """
SELECT company_id, capability, count(*) AS prev FROM p_all JOIN p_seen USING (job_id) JOIN p_asof USING (company_id)
WHERE first_seen <= as_of AND as_of <= last_seen AND company_id <> (SELECT without_history FROM p_none) GROUP BY ALL
""")
view("p_sig", """
SELECT g.*, CASE WHEN company_id = (SELECT without_history FROM p_none) THEN NULL ELSE coalesce(prev, 0) END AS previous, t.total FROM (
  SELECT company_id, business_unit, capability, count(*) AS n, count(*) FILTER (is_leadership) AS senior, avg(CASE WHEN country = 'US' THEN 0.75 ELSE 0.5 END::DOUBLE) AS conf, avg(CASE WHEN employment_type = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE) AS done, avg(CASE WHEN country = 'US' THEN 1.0 ELSE 0.0 END::DOUBLE) AS llm
  FROM p_all GROUP BY ALL) g LEFT JOIN p_hist USING (company_id, capability) JOIN (SELECT company_id, count(*) AS total FROM p_all GROUP BY 1) t USING (company_id)
""")


@query("agg22_snapshot_signals", """
SELECT company_id, coalesce(business_unit, '') AS business_unit, capability, n AS job_count, coalesce(previous, -1) AS previous_job_count, senior AS senior_role_count,
  CAST(printf('%.2f', CAST(least(1.0, 0.55 * (n / total) + 0.30 * least(n / 20, 1.0) + 0.15 * least(senior / 3, 1.0)) AS DOUBLE)) AS DOUBLE) AS strength,
  CAST(printf('%.2f', CAST(least(1.0, CAST(printf('%.3f', CAST(conf * 0.4 AS DOUBLE)) AS DOUBLE) + CAST(printf('%.3f', CAST(done * 0.25 AS DOUBLE)) AS DOUBLE) + CAST(printf('%.3f', CAST(llm * 0.15 AS DOUBLE)) AS DOUBLE) + CAST(printf('%.3f', CAST(least(n / 10, 1.0) * 0.2 AS DOUBLE)) AS DOUBLE)) AS DOUBLE)) AS DOUBLE) AS confidence FROM p_sig""")
def _(b):
    s = P.snapshot_signals(_current_jobs(b), _history(b))
    return s.select("company_id", F.coalesce("business_unit", F.lit("")).alias("business_unit"), "capability", "job_count", F.coalesce("previous_job_count", F.lit(-1)).alias("previous_job_count"), "senior_role_count", "strength", "confidence")


@query("sig19_snapshot_direction", """
SELECT company_id, coalesce(business_unit, '') AS business_unit, capability, CASE WHEN previous IS NULL THEN 'concentration' WHEN n - previous > greatest(1, round_even(previous * 0.1, 0)) THEN 'growth' WHEN n - previous < -greatest(1, round_even(previous * 0.1, 0)) THEN 'decline' ELSE 'stable' END AS direction,
  CASE WHEN previous IS NULL THEN 'current active-job snapshot' ELSE 'current snapshot vs historical snapshot' END AS analysis_period FROM p_sig""")
def _(b):
    return P.snapshot_signals(_current_jobs(b), _history(b)).select("company_id", F.coalesce("business_unit", F.lit("")).alias("business_unit"), "capability", "direction", "analysis_period")


@query("sig20_confidence_parts", """
SELECT company_id, coalesce(business_unit, '') AS business_unit, capability, CAST(printf('%.3f', CAST(conf * 0.4 AS DOUBLE)) AS DOUBLE) AS confidence_classification, CAST(printf('%.3f', CAST(done * 0.25 AS DOUBLE)) AS DOUBLE) AS confidence_page_enrichment, CAST(printf('%.3f', CAST(llm * 0.15 AS DOUBLE)) AS DOUBLE) AS confidence_llm_coverage,
  CAST(printf('%.3f', CAST(least(n / 10, 1.0) * 0.2 AS DOUBLE)) AS DOUBLE) AS confidence_sample_size FROM p_sig""")
def _(b):
    s = P.snapshot_signals(_current_jobs(b), _history(b))
    return s.select("company_id", F.coalesce("business_unit", F.lit("")).alias("business_unit"), "capability", *[c for c in s.columns if c.startswith("confidence_")])


@query("joi17_history_join", "SELECT company_id, capability, sum(n)::BIGINT AS now, max(coalesce(previous, -1)) AS before FROM p_sig GROUP BY ALL")
def _(b):
    s = P.snapshot_signals(_current_jobs(b), _history(b))
    return s.groupBy("company_id", "capability").agg(F.sum("job_count").alias("now"), F.max(F.coalesce("previous_job_count", F.lit(-1))).alias("before"))


@query("agg24_open_postings", """
SELECT company_id, capability, strftime(day, '%Y-%m-%d') AS day, CAST(sum(change) OVER (PARTITION BY company_id, capability ORDER BY day) AS BIGINT) AS open_count FROM (
  SELECT company_id, capability, day, sum(change) AS change FROM (
    SELECT company_id, capability, first_seen AS day, 1 AS change FROM p_all JOIN p_seen USING (job_id) UNION ALL SELECT company_id, capability, last_seen + 1, -1 FROM p_all JOIN p_seen USING (job_id)) GROUP BY ALL)""")
def _(b):
    return _sweep(b).select("company_id", "capability", day("day"), "open_count")


@query("agg24_historical_counts", "SELECT company_id, capability, prev AS previous_job_count FROM p_hist")
def _(b):
    return _history(b)


@query("agg23_top_technologies", """
SELECT company_id, coalesce(business_unit, '') AS business_unit, capability, value, value_count, value_rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id, business_unit, capability ORDER BY value_count DESC, value) AS value_rank FROM (
  SELECT company_id, business_unit, capability, technology AS value, count(*) AS value_count FROM p_all JOIN b_techs USING (job_id) GROUP BY ALL)) WHERE value_rank <= 10""")
def _(b):
    t = P.top_values(_current_jobs(b), ["company_id", "business_unit", "capability"], "technologies", 10)
    return t.select("company_id", F.coalesce("business_unit", F.lit("")).alias("business_unit"), "capability", "value", "value_count", "value_rank")


@query("sig21_snapshot_warnings", """
SELECT company_id, count(*) AS unique_jobs, count(*) FILTER (employment_type = 'F') AS enriched_jobs, count(*) FILTER (employment_type = 'O') AS failed_enrichments,
  concat_ws(' ', CASE WHEN count(*) FILTER (employment_type = 'O') > 0 THEN count(*) FILTER (employment_type = 'O') || ' job pages were unavailable; CSV metadata was retained.' END, 'LLM classification was disabled; heuristic classification was used.',
  CASE WHEN company_id = (SELECT without_history FROM p_none) THEN 'Only a current active-job snapshot was supplied; signals describe concentration, not growth.' END) AS warnings FROM p_all GROUP BY 1""")
def _(b):
    w = P.snapshot_warnings(_current_jobs(b), True, False, _history(b))
    return w.withColumn("warnings", F.array_join("warnings", " "))


@query("sig28_snapshot_status", """
SELECT company_id, CASE WHEN company_id IN (SELECT company_id FROM p_all) THEN 'analyzed' ELSE 'insufficient_data' END AS status FROM (SELECT r_name AS company_id FROM region UNION SELECT n_name FROM nation)""")
def _(b):
    companies = b.table("region").select(F.col("r_name").alias("company_id")).unionByName(b.table("nation").select(F.col("n_name").alias("company_id")))
    return P.snapshot_status(companies, P.snapshot_signals(_current_jobs(b))).select("company_id", "status")


@query("win5_sequence_ids", """
SELECT company_id, job_id AS source_job_id, printf('HIRE_EV_%05d', row_number() OVER (PARTITION BY company_id ORDER BY CAST(job_id AS BIGINT))) AS evidence_id, 'Open role: ' || title || '; capability: ' || capability AS statement FROM p_all""")
def _(b):
    return P.snapshot_evidence(_current_jobs(b), [F.col("source_job_id").cast("long")]).select("company_id", "source_job_id", "evidence_id", "statement")


@query("win4_select_sources", """
SELECT source AS grp, page, position FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rnk, doc_id) AS position FROM (SELECT source, doc_id, doc_id % 7 AS page, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 3 ELSE 8 END AS rnk, row_number() OVER (PARTITION BY source, doc_id % 7 ORDER BY doc_id) AS f FROM documents) WHERE f = 1) WHERE position <= 5""")
def _(b):
    docs = b.table("documents").select(F.col("source").alias("grp"), "doc_id", (F.col("doc_id") % 7).alias("page"), F.when(F.col("lang") == "en", "quarterly_report").when(F.col("lang") == "de", "sec_filing").otherwise("news").alias("source_type"))
    from signalloom.operators.research import source_rank

    url = F.concat(F.lit("https://www.x.com/"), F.col("page").cast("string"), F.lit("/?a=1"))
    return O.select_sources(docs, X.canonical_url(url, strip_www=True), source_rank("source_type"), "doc_id", "grp", 5).select("grp", "page", "position")


@query("win8_strongest", "SELECT l_orderkey, p, q FROM (SELECT l_orderkey, l_partkey AS p, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1")
def _(b):
    return O.argmax_per(b.table("lineitem"), ["l_orderkey"], "l_quantity", [F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))


# --- streams --------------------------------------------------------------------------------


def _stream(b):
    schema = b.table("events").schema
    return V.file_stream(b.spark, b.folder, schema, pattern="events.parquet")


def _zoned(stream):
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("str1_incremental_ingest", "SELECT event_type, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY 1")
def _(b):
    target, checkpoint = scratch_path(b.spark, "ingest"), scratch_path(b.spark, "ingest-checkpoint")
    for _ in range(2):  # the second run finds nothing new
        V.ingest_available(_stream(b), target, checkpoint).awaitTermination()
    return b.spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("value"), 2).alias("total"))


@query("str2_stream_upsert", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(b):
    table, checkpoint = scratch_path(b.spark, "upsert"), scratch_path(b.spark, "upsert-checkpoint")
    V.upsert_stream(_stream(b), table, checkpoint, ["user_id"], [F.col("ts"), F.col("event_id")]).awaitTermination()
    return tables.read_buckets(b.spark, table).select("user_id", "event_type")


def _run_to_table(b, frame, mode, label):
    target, checkpoint = scratch_path(b.spark, label), scratch_path(b.spark, f"{label}-checkpoint")
    # A batch without data lets the watermark close the windows that are complete.
    frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return b.spark.read.schema(frame.schema).parquet(target)


@query("str3_weekly_trend", """
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS bucket_start, event_type, count(*) AS event_count FROM events WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def _(b):
    trend = V.weekly_trend(_zoned(_stream(b)), "ts", ["event_type"], watermark="1 day")
    return _run_to_table(b, trend, "append", "trend").select(day("bucket_start"), "event_type", "event_count")


@query("str3_daily_trend", """
SELECT strftime(ts, '%Y-%m-%d') AS bucket_start, event_type, count(*) AS event_count FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def _(b):
    trend = V.daily_trend(_zoned(_stream(b)), "ts", ["event_type"])
    return _run_to_table(b, trend, "append", "daily").select(day("bucket_start"), "event_type", "event_count")


@query("str4_stream_dedupe", "SELECT count(DISTINCT (user_id, event_type)) AS identities FROM events")
def _(b):
    once = V.dedupe_stream(_zoned(_stream(b)), "ts", ["user_id", "event_type"], "60 days")
    return _run_to_table(b, once, "append", "dedupe").agg(F.count(F.lit(1)).alias("identities"))


@query("str5_batch_audit", "SELECT count(*) AS records_encountered, count(*) FILTER (event_type = 'error') AS records_skipped, 0::BIGINT AS run_id FROM events")
def _(b):
    path, checkpoint = scratch_path(b.spark, "audit"), scratch_path(b.spark, "audit-checkpoint")
    measures = {"records_encountered": F.count(F.lit(1)), "records_skipped": F.count_if(F.col("event_type") == "error")}
    V.audit_stream(_stream(b), path, checkpoint, measures).awaitTermination()
    return b.spark.read.parquet(path).select("records_encountered", "records_skipped", "run_id")
