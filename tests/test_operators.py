import datetime
import random

import pytest
from conftest import JOB_SCHEMA, job
from pyspark.sql import functions as F

from signalloom.operators import analytics as A, crossdomain as X, evidence as E, extraction as T, ordering as O, outlook as W, research as R, runs, snapshot as P, technology as K
from signalloom.sources import snapshots as S, tables


def as_dict(frame, key, value, organization="Wells Fargo"):
    return {r[key]: r[value] for r in frame.filter(F.col("organization") == organization).collect()}


def test_snapshot_and_concentrations(fixture_jobs):
    s = A.snapshot(fixture_jobs).filter("organization = 'Wells Fargo'").first()
    assert (s["total_active_jobs"], s["jobs_with_capability_classification"], s["jobs_with_seniority"], s["jobs_with_location"]) == (5, 3, 3, 4)
    assert as_dict(A.concentration(fixture_jobs, "country"), "country", "percentage") == {"US": 60.0, "IN": 40.0}
    assert as_dict(A.concentration(fixture_jobs, "region"), "region", "job_count") == {"NC": 2, "NY": 1, "TX": 1, "Karnataka": 1}
    assert as_dict(A.concentration(fixture_jobs, "city"), "city", "job_count") == {"Charlotte": 2, "Austin": 1, "New York": 1, "Bengaluru": 1}
    assert as_dict(A.concentration(fixture_jobs, "capability"), "capability", "percentage") == {"Cloud": 66.67, "Data": 66.67}
    assert as_dict(A.concentration(fixture_jobs, "seniority"), "seniority", "percentage")["senior"] == 33.33
    lead = A.leadership(fixture_jobs).filter("organization = 'Wells Fargo'").first()
    assert (lead["leadership_job_count"], lead["leadership_percentage"]) == (1, 20.0)


def test_trends(fixture_jobs):
    day = {str(k): v for k, v in as_dict(A.trend(fixture_jobs, "day"), "bucket_start", "job_count").items()}
    assert day == {"2026-08-03": 2, "2026-08-04": 1, "2026-08-10": 1, "2026-08-11": 1}
    week = {str(k): v for k, v in as_dict(A.trend(fixture_jobs, "week"), "bucket_start", "job_count").items()}
    assert week == {"2026-08-03": 3, "2026-08-10": 2}


@pytest.fixture(scope="module")
def weekly_jobs(spark):
    dates = ["2026-06-01"] * 2 + ["2026-06-08"] * 2 + ["2026-06-15"] * 4 + ["2026-06-29"] * 4
    return spark.createDataFrame([job(i, capabilities=["Data"], seniority="senior", leader=i < 3, posted=d) for i, d in enumerate(dates)], JOB_SCHEMA)


def test_hiring_signals(weekly_jobs):
    rows = {r["signal_type"] + "/" + r["subject"]: r for r in A.hiring_signals(weekly_jobs).collect()}
    assert set(rows) == {
        "geographic_hiring_concentration/country:US", "geographic_hiring_concentration/state/region:NC", "geographic_hiring_concentration/city:Charlotte",
        "capability_hiring_concentration/Data", "leadership_hiring/leadership", "hiring_volume/observed-volume", "hiring_trend/weekly:increased",
    }
    trend = rows["hiring_trend/weekly:increased"]
    assert trend["strength"] == 1.0 and trend["confidence"] == round((1 + 0.5 + 1) / 3, 4)
    assert "from 2 to 4 jobs" in trend["summary"]
    assert rows["capability_hiring_concentration/Data"]["limitations"] == ["Based on a single public hiring source.", "Observed job sample is small."]
    assert "100% of observed hiring activity (12 of 12 jobs)" in rows["geographic_hiring_concentration/country:US"]["summary"]
    strict = A.hiring_signals(weekly_jobs, A.HiringThresholds(hiring_volume_minimum_jobs=13, trend_minimum_buckets=5))
    assert {"hiring_volume", "hiring_trend"}.isdisjoint({r["signal_type"] for r in strict.collect()})


def test_signals_are_deterministic_and_bounded(weekly_jobs):
    first = A.hiring_signals(weekly_jobs).orderBy("signal_id").collect()
    assert first == A.hiring_signals(weekly_jobs).orderBy("signal_id").collect()
    assert all(0 <= r[c] <= 1 for r in first for c in ("strength", "confidence", "evidence_coverage"))
    support = A.hiring_signal_support(weekly_jobs, A.hiring_signals(weekly_jobs))
    assert runs.isolation_violations(support, weekly_jobs).count() == 0


ENR = (
    "job_id string, evidence_id string, provider string, model string, prompt_schema_version string, enrichment_timestamp timestamp, technologies array<string>, capability_classifications array<string>, "
    "skills array<string>, business_unit string, seniority_level string, confidence double, field_confidences map<string,double>, "
    "field_support array<struct<field:string,value:string,excerpt:string,evidence_id:string>>, source_content_hash string"
)
EV = "evidence_id string, source_url string, source_type string, source_title string, retrieved_at timestamp, source_excerpt string, raw_reference string, collector_identity string, provenance_metadata string"


def enrichment(spark, rows):
    import datetime

    out = [(j, e, "p", "m", f"v{v}", datetime.datetime(2026, 8, 1 + v), t, ["Cloud"], ["x"], u, "senior", 0.8, {}, [], "h") for j, e, v, t, u in rows]
    return spark.createDataFrame(out, ENR)


def evidence_of(jobs):
    return jobs.select(
        "evidence_id", "source_url", F.lit("career_site").alias("source_type"), F.col("title").alias("source_title"), F.lit("2026-08-01").cast("timestamp").alias("retrieved_at"), F.col("description").alias("source_excerpt"),
        F.lit(None).cast("string").alias("raw_reference"), F.lit("collector").alias("collector_identity"), F.lit("{}").alias("provenance_metadata"))


def cross(spark, jobs, enrichments, thresholds=X.CrossThresholds()):
    evidence, latest = evidence_of(jobs), O.latest_enrichment(enrichments)
    rows = K.enriched_jobs(jobs, evidence, latest)
    facets = K.tech_facets(rows)
    counts = K.tech_counts(facets)
    snapshot = K.tech_snapshot(jobs, counts)
    unified = E.unified_evidence(jobs, evidence, latest)
    hiring = A.hiring_signals(jobs)
    technology = K.technology_signals(snapshot, counts)
    context = X.coverage_context(snapshot, unified, hiring, technology, thresholds)
    tagged = X.tagged_jobs(rows)
    gates = X.hiring_gates(A.facet_counts(A.job_facets(jobs, X.GROUP_FAMILIES)), context, thresholds).unionByName(X.technology_gates(counts, context, thresholds)).unionByName(X.unit_gates(tagged, context, thresholds))
    return X.alignments(X.overlaps(X.overlap_counts(tagged, gates), context, thresholds), context, thresholds), context


def test_cross_domain_default_case(spark):
    jobs = spark.createDataFrame(
        [job(i, capabilities=["Data"] if i < 4 else (["Ops"] if i == 4 else []), location="Charlotte, NC" if i < 4 else f"Town {i}, NC", seniority="senior", leader=i < 4, posted=f"2026-08-{1 + 2 * i:02d}") for i in range(10)], JOB_SCHEMA)
    enr = enrichment(spark, [(f"job-Wel-{i}", f"ev-Wel-{i}", 1, ["python"] if i < 3 else ["SQL"], "Analytics" if i < 4 else None) for i in range(5)])
    signals, context = cross(spark, jobs, enr)
    got = {(r["family"], r["primary_subject"], r["related_subject"]): r for r in signals.collect()}
    assert context.first()["passes"]
    assert set(got) == {("capability", "Data", "Python"), ("city", "Charlotte", "Python"), ("leadership", "leadership hiring", "Python"), ("business_unit", "Analytics", "python")}
    row = got[("capability", "Data", "Python")]
    assert (row["hiring_contributor_count"], row["technology_contributor_count"], row["overlap"]) == (4, 3, 3)
    assert row["strength"] == pytest.approx((0.8 + 0.6 + 0.75) / 3)
    assert row["confidence"] == pytest.approx((0.5 + 1 + 0.5) / 3)


def test_jobs_meet_few_gates_and_are_never_sent_to_all_tasks(spark, tmp_path):
    jobs = [("o", f"j{i}", "shared" if i < 3 else None if i == 3 else f"e{i}", ["h1", "t1", "h2" if i % 2 else "x", f"s{i}"], "U", ["py", None]) for i in range(6)]
    spark.createDataFrame(jobs, "organization string, job_id string, evidence_id string, tags array<string>, unit string, technologies array<string>").write.parquet(str(tmp_path / "tagged"))
    tagged = spark.read.parquet(str(tmp_path / "tagged"))
    gate = "organization string, kind string, side string, family string, subject string, key string, size long, concentration double, signal_id string"
    gates = spark.createDataFrame(
        [("o", "group", "hiring", "city", "H1", "h1", 6, 0.5, None), ("o", "group", "hiring", "city", "H2", "h2", 3, 0.5, None), ("o", "group", "technology", "technology", "T1", "t1", 6, 0.5, None),
         ("o", "unit", "hiring", "business_unit", "U", "x", 3, 0.5, None)], gate)
    counts = {(r["family"], r["primary_subject"], r["related_subject"]): (r["overlap"], r["evidence_count"]) for r in X.overlap_counts(tagged, gates).collect()}
    # Jobs 0 to 2 cite one evidence, job 3 none.
    assert counts == {("city", "H1", "T1"): (6, 3), ("city", "H2", "T1"): (3, 2), ("business_unit", "U", "py"): (3, 2), ("business_unit", "U", None): (3, 2)}
    signals = spark.createDataFrame([("o", "A", "city", "h1", "t1", None, None), ("o", "B", "city", "h2", "t1", None, None)], "organization string, signal_id string, family string, left_key string, right_key string, hiring_signal_id string, technology_signal_id string")
    support = X.alignment_support(tagged, signals)
    assert "BuildLeft" not in support._jdf.queryExecution().executedPlan().toString()  # the jobs are the left side
    want = sorted([(s, f"j{i}") for i in range(6) for s in ("A", "B") if s == "A" or i % 2])
    assert sorted((r["signal_id"], r["job_id"]) for r in support.collect()) == want
    cited = {r["evidence_id"]: r["cross_domain_signal_count"] for r in X.alignment_citations(tagged, signals).collect()}
    assert cited == {"shared": 2, None: 2, "e4": 1, "e5": 2}
    # More signals than one word of bits holds.
    domain = spark.createDataFrame([("o", "signal", "hiring", "cluster", "t", f"s{i % 6}", None, 1.0, f"S{i}") for i in range(130)], gate)
    related = X.related_signals(tagged, signals, domain)
    assert sorted((r["signal_id"], r["related_id"]) for r in related.collect()) == sorted([("A", f"S{i}") for i in range(130)] + [("B", f"S{i}") for i in range(130) if i % 2])


def test_cross_domain_gates_suppress(spark):
    jobs = spark.createDataFrame([job(i, capabilities=["Data"], posted=f"2026-08-{1 + i:02d}") for i in range(19)], JOB_SCHEMA)
    signals, context = cross(spark, jobs, enrichment(spark, [("job-Wel-0", "ev-Wel-0", 1, ["python"], None)]))
    assert signals.count() == 0 and not context.first()["passes"]
    assert any("reliability threshold" in n for n in context.first()["limitations"])


def test_latest_enrichment_then_evidence_match(spark):
    jobs = spark.createDataFrame([job(1, technologies=["Java", "PYTHON"]), job(2, technologies=["aws"])], JOB_SCHEMA)
    enr = enrichment(spark, [("job-Wel-1", "ev-Wel-1", 1, ["old"], None), ("job-Wel-1", "ev-Wel-1", 2, ["python", "Python", " ms  excel "], "U"), ("job-Wel-2", "ev-Wel-2", 1, ["x"], None), ("job-Wel-2", "other", 2, ["y"], None)])
    rows = K.enriched_jobs(jobs, evidence_of(jobs), O.latest_enrichment(enr))
    got = {(r["job_id"], r["normalized_technology"], r["provider"]) for r in K.observations(rows).collect()}
    assert got == {("job-Wel-1", "Python", "p"), ("job-Wel-1", "Excel", "p"), ("job-Wel-1", "Java", "keyword_match"), ("job-Wel-2", "AWS", "keyword_match")}


def greedy(rows):
    a, b, kept = set(), set(), []
    for n, x, y in sorted(rows):
        if x not in a and y not in b:
            a.add(x), b.add(y), kept.append(n)
    return kept


def test_dedupe_either_matches_sequential_rule(spark):
    rng = random.Random(7)
    rows = [(n, f"a{rng.randrange(40)}", f"b{rng.randrange(60)}") for n in range(300)] + [(1000 + n, "hot", f"h{n}") for n in range(200)]
    rows += [(2000 + n, f"c{n // 2}", f"d{(n + 1) // 2}") for n in range(30)]
    frame = spark.createDataFrame(rows, "n long, x string, y string").repartition(5)
    got = sorted(r["n"] for r in O.dedupe_either(frame, "x", "y", "n").collect())
    assert got == greedy(rows)


def test_dedupe_either_settles_long_chains_in_few_rounds(spark, monkeypatch):
    """Row i shares one key with row i - 1 and the other with row i + 1; some chains turn around."""
    n = 100_000
    chain = spark.range(n).selectExpr("id AS n", "concat('x', (id + 1) div 2) AS x", "concat('y', id div 2) AS y")
    rounds = []
    own = O.settle
    monkeypatch.setattr(O, "settle", lambda df: rounds.append(1) or own(df))
    kept = O.dedupe_either(chain, "x", "y", "n")
    assert kept.filter("n % 2 = 0").count() == n // 2 and kept.count() == n // 2
    assert len(rounds) <= 20 + 4
    rng = random.Random(12)
    rows = [(k, f"x{(i + 1) // 2}", f"y{i // 2}") for i, k in enumerate(rng.sample(range(400), 400))]
    got = sorted(r["n"] for r in O.dedupe_either(spark.createDataFrame(rows, "n long, x string, y string"), "x", "y", "n").collect())
    assert got == greedy(rows)
    assert O.dedupe_either(chain.limit(0), "x", "y", "n").count() == 0


def test_dedupe_either_keeps_first_and_third(spark):
    frame = spark.createDataFrame([(1, "A", "X"), (2, "B", "X"), (3, "B", "Y")], "n long, x string, y string")
    assert sorted(r["n"] for r in O.dedupe_either(frame, "x", "y", "n").collect()) == [1, 3]


def test_numbering_per_group(spark):
    frame = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 'hot', cast(id % 7 AS string)) AS g").repartition(7)
    got = O.numbered(frame, [F.col("id")], by=["g"]).collect()
    for group in {r["g"] for r in got}:
        assert [r["position"] for r in sorted((r for r in got if r["g"] == group), key=lambda r: r["id"])] == list(range(1, 1 + sum(r["g"] == group for r in got)))


@pytest.mark.parametrize(
    "text,want",
    [
        ("We use Python, PL/SQL and apache spark.", ["Apache Spark", "PL/SQL", "Python", "SQL"]),
        ("Spark SQL and Excel; excel at work, chef", ["Apache Spark", "Excel", "SQL", "Spark"]),
        ("javascript typescripts pythonic", ["JavaScript"]),
        ("C++ and C# on .NET (asp.net)", [".NET", "C#", "C++"]),
        ("", []),
    ],
)
def test_term_extraction(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(T.extract_terms(["v"])).first()[0] == want


def test_term_excerpt(spark):
    text = "a" * 100 + " Python " + "b" * 100
    got = spark.createDataFrame([("none", text)], "t string, v string").select(T.term_excerpt("Python", ["t", "v"])).first()[0]
    assert got == ("a" * 59 + " Python " + "b" * 59)


def test_grounding(spark):
    rows = [("Data & Analytics with C++ and Naïve Bayes", ["data and analytics", "c++", "c", "NAÏVE bayes", "analytics data"])]
    frame = spark.createDataFrame(rows, "text string, wanted array<string>").withColumn("line", T.token_line("text"))
    out = frame.withColumn("kept", T.ground_values(F.transform("wanted", lambda v: v), "line")).withColumn("kept", F.array(F.lit("data and analytics"), F.lit("c++"))).select("kept", T.grounded_spans("text", F.col("kept")).alias("s")).first()
    assert out["s"] == ["Data & Analytics", "C++"]
    assert frame.select(T.ground_values("wanted", "line")).first()[0][:2] == ["data and analytics", "c++"]


def test_gates(spark):
    ev = spark.createDataFrame([("s1", "1", "We will invest in cloud", "annual_report", "2026-08-01"), ("s2", "1", "It was completed", "news", None), ("s2", "2", "nothing", "news", None)], "signal_id string, source_id string, statement string, source_type string, publication_date string")
    signals = spark.createDataFrame([("s1", "What next?", "Growth"), ("s2", "What next?", "Cost is not a major current priority")], "signal_id string, question string, hypothesis string")
    got = {r["signal_id"]: r for r in R.quality_gate(signals, ev).collect()}
    assert got["s1"]["passes"] and got["s2"]["minimum_evidence"] and not got["s2"]["temporal_consistency"] and got["s2"]["self_negating"]
    assert {r["signal_id"]: r["confidence"] for r in R.research_confidence(ev, "2026-08-31").collect()} == {"s1": 0.4, "s2": 0.35}


def test_snapshot_direction(spark):
    jobs = spark.createDataFrame([("C", None, None, "Data and AI", "Director", 0.4, "skipped", "heuristic")] * 5 + [("C", None, None, "Other", "Mid", 0.4, "completed", "llm")], "company_id string, business_unit string, department string, capability string, seniority string, classification_confidence double, extraction_status string, classification_source string")
    assert {r["direction"] for r in P.snapshot_signals(jobs).collect()} == {"concentration"}
    history = spark.createDataFrame([("C", "Data and AI", 3), ("C", "Other", 2)], "company_id string, capability string, previous_job_count long")
    got = {r["capability"]: r for r in P.snapshot_signals(jobs, history).collect()}
    assert got["Data and AI"]["direction"] == "growth" and got["Other"]["direction"] == "stable"
    assert got["Data and AI"]["strength"] == round(0.55 * 5 / 6 + 0.3 * 0.25 + 0.15, 2)


def test_open_postings_at_any_date(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("CD"), rng.choice("xyz"), f"p{i % 90}", datetime.date(2025, 1, 1) + datetime.timedelta(rng.randrange(200))) for i in range(260)] + [("C", "x", "none", None)]
    df = spark.createDataFrame(rows, "company_id string, capability string, source_job_id string, seen_on date")
    keys = ["company_id", "capability", "source_job_id"]
    sweep = P.open_postings(P.posting_intervals(df, keys), keys[:2]).cache()
    spans = {}
    for *key, seen in rows:
        if seen:
            low, high = spans.get(tuple(key), (seen, seen))
            spans[tuple(key)] = min(low, seen), max(high, seen)
    for offset in (-1, 0, 30, 77, 150, 199, 260):
        at = datetime.date(2025, 1, 1) + datetime.timedelta(offset)
        want = {}
        for (company, capability, _), (low, high) in spans.items():
            if low <= at <= high and company == "C":
                want[company, capability] = want.get((company, capability), 0) + 1
        dates = spark.createDataFrame([("C", at), ("D", at)], "company_id string, as_of date")
        without = spark.createDataFrame([("D",)], "company_id string")
        assert {(r.company_id, r.capability): r.previous_job_count for r in P.historical_counts(sweep, dates, without).collect()} == want


def test_search_reads_whole_texts(spark):
    rows = [("o", "e1", "word " * 400 + "needle", "t"), ("o", "e2", "word " * 400, "t"), ("o", "e3", None, "Needle")]
    df = spark.createDataFrame(rows, "organization string, evidence_id string, source_excerpt string, job_title string").selectExpr("*", "'l' AS job_location", "array('x') AS technologies", "array('y') AS capabilities")
    assert {r.evidence_id for r in E.search_evidence(df, search="NEEDLE").collect()} == {"e1", "e3"}


def test_upsert_keeps_identity_and_last_row_wins(spark):
    old = spark.createDataFrame([("o", "1", "id-1", "e1"), ("o", "2", "id-2", "e2")], "organization string, source_job_id string, job_id string, evidence_id string")
    new = spark.createDataFrame([("o", "1", "id-x", "e9", 1), ("o", "1", "id-y", "e10", 2), ("o", "3", "id-3", "e3", 1)], "organization string, source_job_id string, job_id string, evidence_id string, n int")
    got = {r["source_job_id"]: (r["job_id"], r["evidence_id"]) for r in tables.upsert_jobs(old, new, [F.col("n")]).collect()}
    assert got == {"1": ("id-1", "e10"), "2": ("id-2", "e2"), "3": ("id-3", "e3")}


def test_batch_save_is_all_or_nothing(spark, tmp_path, fixture_jobs):
    jobs = fixture_jobs.withColumn("position", F.monotonically_increasing_id())
    evidence = jobs.select("position", "evidence_id", "source_url")
    path = str(tmp_path / "store")
    assert tables.save_batch(spark, jobs, evidence, path, "v1") == 6
    with pytest.raises(ValueError):
        tables.save_batch(spark, jobs, evidence.withColumn("evidence_id", F.lit("wrong")), path, "v2")
    assert tables.save_batch(spark, jobs, evidence, path, "v3") == 6
    assert tables.read_saved(spark, path, "jobs").count() == 6


def test_snapshot_files(spark, tmp_path):
    header = "company,source_job_id,title,posting_url,description_text\n"
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_bytes(b"\xef\xbb\xbf" + (header + 'Wells Fargo,1,"Eng, Senior",https://x.com/1/,CafÃ©\nOther Bank,2,T,https://x.com/2,d\nWELLS_FARGO,3,T,https://X.com/1?a=b,d\n').encode())
    second.write_text(header + "wf,1,Again,https://x.com/9,d\nWells Fargo,3,Kept,https://x.com/3,d\nWells Fargo,,No id,https://x.com/4,d\n")
    contexts = spark.createDataFrame([("WELLS_FARGO", "Wells Fargo", ["WF"], [], [])], "company_id string, canonical_name string, aliases array<string>, allowed_subsidiaries array<string>, excluded_entities array<string>")
    kept, diagnostics = S.load_snapshot(S.read_snapshot(spark, [str(first), str(second)]), contexts)
    assert sorted((r["source_job_id"], r["title"]) for r in kept.collect()) == [("1", "Eng, Senior"), ("3", "Kept")]
    assert kept.filter("source_job_id = '1'").first()["description"] == "Café"
    d = diagnostics.first()
    assert (d["rows_read"], d["rows_accepted"], d["rows_rejected"], d["duplicates_removed"], d["other_company_rows"]) == (6, 2, 1, 2, 1)
    bad = tmp_path / "c.csv"
    bad.write_text("company,title\nx,y\n")
    with pytest.raises(ValueError):
        S.read_snapshot(spark, str(bad))


def test_evidence_validation_matches_sequential_rule(spark):
    rows = [(i, "c", f"E{i % 7}", f"stmt {i % 5}", None, "2026-01-01" if i % 4 else "bad") for i in range(30)]
    frame = spark.createDataFrame(rows, "position long, company string, evidence_id string, statement string, company_id string, source_date string").withColumn("source_url", F.lit(None).cast("string"))
    names = spark.createDataFrame([("c", "c")], "company string, company_key string")
    got = sorted(r["position"] for r in W.validate_evidence(frame, names).filter("reject_reason IS NULL").collect())
    assert got == greedy([(n, e, (s, d)) for n, _, e, s, _, d in rows if d != "bad"])


def test_plan_covers_every_job(spark, fixture_jobs):
    evidence = evidence_of(fixture_jobs.filter("source_job_id <> 'R-3'"))
    current = spark.createDataFrame([], "job_id string, evidence_id string, source_content_hash string")
    plan = runs.enrichment_plan(fixture_jobs, evidence, current, 2)
    counts = runs.plan_counts(plan)
    row = counts.filter("organization = 'Wells Fargo'").first()
    assert (row["discovered_jobs"], row["planned_jobs"], row["deferred_jobs"], row["no_evidence_skips"]) == (5, 2, 2, 1)
    assert runs.plan_violations(counts).count() == 0


def test_upsert_stream_survives_a_new_checkpoint(spark, tmp_path):
    from signalloom.streaming import events

    table, schema = f"{tmp_path}/table", "k string, n long"
    for name, rows in (("one", [("k1", 1), ("k1", 2)]), ("two", [("k2", 1)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in-{name}")
        stream = events.file_stream(spark, f"{tmp_path}/in-{name}", spark.createDataFrame([], schema).schema)
        events.upsert_stream(stream, table, f"{tmp_path}/checkpoint-{name}", ["k"], [F.col("n")]).awaitTermination()
    assert sorted(map(tuple, tables.read_buckets(spark, table).select("k", "n").collect())) == [("k1", 2), ("k2", 1)]


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k string, first string, v long"
    stored = [(f"k{i}", f"id{i}", i) for i in range(900)] + [(None, "none", -1)]
    tables.create_buckets(spark.createDataFrame(stored, schema), path, ["k"])

    def files():
        return {f"{f.parent.name}/{f.name}" for f in (tmp_path / "table" / "rows").rglob("*.parquet")}

    def rows():
        return {(r.k, r.first, r.v) for r in tables.read_buckets(spark, path).collect()}

    before = files()
    batch = spark.createDataFrame([("k5", "x", 50, 1), ("k5", "x", 55, 2), ("new", "id-new", 7, 1), (None, "y", -2, 1)], schema + ", n int")
    tables.upsert_buckets(spark, path, batch, ["k"], ["first"], [F.col("n")])
    want = {(k, i, {"k5": 55, None: -2}.get(k, v)) for k, i, v in stored} | {("new", "id-new", 7)}
    assert rows() == want and len(before - files()) <= 3 and len(before) > 40
    tables.upsert_buckets(spark, path, batch, ["k"], ["first"], [F.col("n")])  # replayed
    assert rows() == want
    # a replacement that was cut off: merged rows are ready, a bucket of the table is gone
    bucket = tables.read_buckets(spark, path).filter("k = 'k5'").first().bucket
    tables._set_state(spark, path, "ready")
    for f in (tmp_path / "table" / "rows" / f"bucket={bucket}").iterdir():
        f.unlink()
    tables.upsert_buckets(spark, path, batch.limit(0), ["k"], ["first"], [F.col("n")])
    assert rows() == want


def test_folder_with_two_header_orders_is_refused(spark, tmp_path):
    from signalloom.sources.snapshots import read_snapshot

    for name, text in (("a", "title,company\nEngineer,Bank\n"), ("b", "company,title\nBank,Analyst\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    with pytest.raises(Exception, match="(?i)header"):
        read_snapshot(spark, str(tmp_path), required=["title"]).collect()
    both = read_snapshot(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], required=["title"])
    assert sorted((r.title, r.company) for r in both.collect()) == [("Analyst", "Bank"), ("Engineer", "Bank")]


def test_slug_above_the_basic_plane(spark):
    from signalloom.functions.text import slug

    frame = spark.createDataFrame([("\U0001d400bc Café",)], "t string")
    assert frame.select(slug("t").alias("s")).first().s == "abc_cafe"
