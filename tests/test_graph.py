import datetime

from conftest import JOB_SCHEMA, job
from pyspark.sql import functions as F

from signalloom.operators import analytics as A, crossdomain as X, evidence as E, graph as G

EVIDENCE = "evidence_id string, source_url string, source_type string, source_excerpt string, retrieved_at timestamp, raw_reference string, collector_identity string, provenance_metadata string"
LATEST = (
    "job_id string, evidence_id string, provider string, model string, prompt_schema_version string, enrichment_timestamp timestamp, technologies array<string>, capability_classifications array<string>, "
    "skills array<string>, business_unit string, seniority_level string, confidence double, field_confidences map<string,double>, field_support array<struct<field:string,value:string,excerpt:string,evidence_id:string>>, source_content_hash string"
)


def latest_of(spark, rows):
    return spark.createDataFrame([(j, f"ev-{j}", "p", "m", "v1", datetime.datetime(2026, 8, 1), t, ["Cloud"], [], unit, "senior", 0.8, {}, [], "h") for j, t, unit in rows], LATEST)


def sample(spark):
    jobs = spark.createDataFrame(
        [job(1, technologies=["Caf\u00e9 DB", "AWS"], capabilities=["Cloud"], posted="2026-08-03"), job(2, technologies=["cafe db"], posted="2026-08-04"), job(3, technologies=["CAFE DB"], posted="2026-08-04"),
         job(4, evidence="ev-Wel-3", technologies=["AWS"]), job(5, evidence="none"), job(1, organization="Example Bank", technologies=["AWS"])], JOB_SCHEMA)
    evidence = spark.createDataFrame([(f"ev-Wel-{i}", f"u{i}", "career_site", "", None, None, "c", "{}") for i in (1, 2, 3)] + [("ev-Exa-1", "u9", "job_board", "", None, None, "c", "{}")], EVIDENCE)
    return jobs, evidence, latest_of(spark, [("job-Wel-1", ["aws", "Spark", "AWS"], "Data"), ("job-Wel-3", [None, " "], "")])


def test_sole_rows_are_those_that_share_neither_job_nor_evidence(spark):
    got = {r["job_id"]: r["sole"] for r in E.intelligence_rows(*sample(spark)).collect()}
    assert got == {"job-Wel-1": True, "job-Wel-2": True, "job-Wel-3": False, "job-Wel-4": False, "job-Wel-5": True, "job-Exa-1": True}


def test_concepts_of_sole_rows_are_made_without_a_shuffle(spark, tmp_path):
    jobs, evidence, latest = sample(spark)
    E.intelligence_rows(jobs, evidence, latest).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).filter("evidence IS NOT NULL")
    own = G.concept_links(G.present_rows(rows))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    keep = lambda frame: sorted((r["job_id"], r["edge_type"], r["node_id"], r["value"], r["derivation_type"], r["position"], r["enrichment_provider"]) for r in frame.collect())
    joined = G.concept_links(G.linked_jobs(G.present_jobs(jobs, evidence), latest))
    assert keep(own) == keep(joined) == keep(G.keyed_concepts(joined.unionByName(joined)))
    used = {n: (v, d) for j, e, n, v, d, _, _ in keep(own) if j == "job-Wel-1" and e == "USES_TECHNOLOGY"}
    assert used == {"technology:wells_fargo:cafe_db": ("Caf\u00e9 DB", G.KEYWORD), "technology:wells_fargo:aws": ("AWS", G.ENRICHED), "technology:wells_fargo:spark": ("Spark", G.ENRICHED)}


def test_spelling_of_the_newest_job_names_a_concept(spark):
    jobs, evidence, latest = sample(spark)
    linked = G.linked_jobs(G.present_jobs(jobs, evidence), latest)
    concepts = G.keyed_concepts(G.concept_links(linked))
    got = sorted(tuple(r) for r in G.last_spellings(linked, concepts).select("organization", "node_id", "node_type", "value").collect())
    last = concepts.groupBy("organization", "node_id").agg(F.max_by(F.struct("node_type", "value"), F.struct("posted_date", "job_id", "position")).alias("x"))
    assert got == sorted(tuple(r) for r in last.select("organization", "node_id", "x.*").collect())
    assert ("Wells Fargo", "technology:wells_fargo:cafe_db", "Technology", "CAFE DB") in got


def test_a_part_of_the_graph_plans_no_other(spark):
    jobs, evidence, latest = sample(spark)
    present = G.present_jobs(jobs, evidence)
    concepts = G.concept_links(G.linked_jobs(present, latest))
    spellings = spark.createDataFrame([], "organization string, node_id string, node_type string, value string")
    edges = G.graph_edges(present, concepts, spellings)
    assert "Generate" in edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in G.evidence_of_jobs(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["evidence_id"] for r in G.evidence_of_jobs(edges).filter("organization = 'Wells Fargo'").collect()) == ["ev-Wel-1", "ev-Wel-2", "ev-Wel-3", "ev-Wel-3"]


def test_counts_of_sole_rows_equal_distinct_counts(spark):
    rows = E.intelligence_rows(*sample(spark))
    keys = ["organization", "family", "value"]
    count = lambda frame: sorted(tuple(r) for r in A.facet_counts(A.job_facets(frame, A.SIGNAL_FAMILIES)).select(*keys, "job_count", "evidence_count").collect())
    assert count(rows) == count(rows.drop("sole"))
    tagged = spark.createDataFrame([("o", f"j{i}", "e" if i < 3 else f"e{i}", i >= 3, ["h", "t"], None, []) for i in range(6)], "organization string, job_id string, evidence_id string, sole boolean, tags array<string>, unit string, technologies array<string>")
    gates = spark.createDataFrame([("o", "group", s, "city", s, s[0], 6, 0.5, None) for s in ("hiring", "technology")], "organization string, kind string, side string, family string, subject string, key string, size long, concentration double, signal_id string")
    for frame in (tagged, tagged.drop("sole")):
        assert [(r["overlap"], r["evidence_count"]) for r in X.overlap_counts(frame, gates).collect()] == [(6, 4)]
    context = spark.createDataFrame([("o", 6)], "organization string, enriched_jobs long")
    met = X.overlaps(X.overlap_counts(tagged, gates), context, X.CrossThresholds())
    assert "Generate" not in met._jdf.queryExecution().optimizedPlan().toString()  # the pairs of the jobs are not made again
    assert [(r["overlap"], r["evidence_count"]) for r in met.collect()] == [(6, 4)]


def test_links_of_sole_rows_are_summed_without_distinct(spark):
    hiring = spark.createDataFrame([("o", "e1", "s1", "t", "x"), ("o", "e1", "s2", "t", "x"), ("o", "e2", "s1", "t", "x")], "organization string, evidence_id string, signal_id string, signal_type string, title string")
    seen = spark.createDataFrame([("e1", "j1", "AWS"), ("e2", "j2", "AWS")], "evidence_id string, job_id string, normalized_technology string")
    show = lambda frame: sorted(tuple(r) for r in frame.collect())
    assert show(E.evidence_links(hiring, hiring, seen, True)) == show(E.evidence_links(hiring, hiring, seen)) == [("e1", 2, 2, 1), ("e2", 1, 1, 1)]
    assert show(E.signal_references({"h": hiring}, True)) == show(E.signal_references({"h": hiring}))
