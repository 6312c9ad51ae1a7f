"""Queries read the job table with the columns of their kind, and the graph part by part."""

from pyspark.sql import functions as F
from test_graph import sample

from signalloom.operators import crossdomain as X, evidence as E, graph as G, technology as K
from signalloom.plans.binding import HIRED, Binding, NEEDS, Need, Staged


def kept(frame, *columns):
    return sorted(str(tuple(r)) for r in frame.select(*columns).collect())


def test_lean_rows_hold_the_asked_fields_and_the_same_sole_rows(spark):
    jobs, evidence, latest = sample(spark)
    whole = E.intelligence_rows(jobs, evidence, latest)
    bare = E.intelligence_rows(jobs, evidence, None, ("source_type",))
    assert "enrichment" not in bare.columns and bare.schema["evidence"].dataType.names == ["source_type"]
    assert kept(bare, "job_id", "evidence_id", "source_type", "sole") == kept(whole, "job_id", "evidence_id", "source_type", "sole")
    some = E.intelligence_rows(jobs, evidence, latest.select("job_id", "evidence_id", "technologies"), ("source_type",))
    assert some.schema["enrichment"].dataType.names == ["evidence_id", "technologies"]
    assert kept(some, "job_id", "is_enriched", "enrichment.technologies") == kept(whole, "job_id", "is_enriched", "enrichment.technologies")
    placed = E.intelligence_rows(jobs, evidence, None, ("source_type", "source_url")).filter("evidence IS NOT NULL")
    assert kept(G.present_rows(placed), "job_id", "evidence_id") == kept(G.present_jobs(jobs, evidence), "job_id", "evidence_id")


def test_a_lean_model_plans_no_enrichment_it_does_not_need(spark, monkeypatch):
    assert NEEDS["hiring"].enrichment == ()
    model = Staged(spark, "nowhere")
    model.need = Need()
    jobs, evidence, _ = sample(spark)
    monkeypatch.setattr(Binding, "_jobs", lambda self, lists: jobs)
    monkeypatch.setattr(Staged, "_lists", lambda self: None)
    model.__dict__["evidence"] = evidence  # latest is not bound: reading it would fail for want of tables
    assert set(model.intelligence.columns) == {*HIRED, "evidence", "source_type", "sole"}


def test_known_concepts_are_the_node_ids_of_all_concepts_of_a_type(spark):
    jobs, evidence, latest = sample(spark)
    linked = G.linked_jobs(G.present_jobs(jobs, evidence), latest)
    concepts = G.concept_links(linked)
    for node_type in ("Capability", "Technology", "BusinessUnit"):
        want = concepts.filter(F.col("node_type") == node_type).select("organization", "node_id", "node_type").distinct()
        assert kept(G.known_concepts(linked, [node_type]), "organization", "node_id", "node_type") == kept(want, "organization", "node_id", "node_type")


def test_edges_of_one_part_come_from_its_frames_alone(spark):
    jobs, evidence, latest = sample(spark)
    present = G.present_jobs(jobs, evidence)
    linked = G.linked_jobs(present, latest)
    concepts = G.keyed_concepts(G.concept_links(linked))
    themes = spark.createDataFrame([("Wells Fargo", "Grow", "Data"), ("Wells Fargo", "Shrink", "Unknown")], "organization string, priority string, business_unit string")
    cited = spark.createDataFrame([("Wells Fargo", "Grow", "EV_1")], "organization string, priority string, evidence_id string")
    spellings = G.last_spellings(linked, concepts)
    every = G.graph_edges(present, concepts, spellings, themes=themes, theme_evidence=cited)
    columns = ("src", "dst", "edge_type", "part")
    assert kept(G.graph_edges(present), *columns) == kept(every.filter("part = 'job'"), *columns)
    assert kept(G.graph_edges(concepts=concepts), *columns) == kept(every.filter("part = 'concept'"), *columns)
    own = G.graph_edges(spellings=G.known_concepts(linked, ["BusinessUnit"]), themes=themes, theme_evidence=cited)
    assert kept(own, *columns) == kept(every.filter("part = 'theme'"), *columns)
    assert own.filter("edge_type = 'ABOUT_BUSINESS_UNIT'").count() == 1
    assert kept(G.evidence_of_themes(G.graph_edges(theme_evidence=cited)), "node_id", "evidence_id") == kept(G.evidence_of_themes(every), "node_id", "evidence_id")


def test_observed_names_are_those_of_the_observations(spark):
    jobs, evidence, latest = sample(spark)
    rows = K.enriched_jobs(jobs, evidence, latest)
    columns = ("organization", "job_id", "evidence_id", "normalized_technology")
    assert kept(K.observed_names(rows), *columns) == kept(K.observations(rows), *columns)


def test_hits_are_the_gates_of_a_jobs_tags(spark):
    tagged = spark.createDataFrame([("o", "j1", ["a", "b", "b", None]), ("o", "j2", ["c"]), ("o", "j3", None), ("p", "j4", ["a"])], "organization string, job_id string, tags array<string>")
    listed = spark.createDataFrame([("o", [(0, "a"), (1, "b"), (2, "a"), (3, "z")])], "organization string, _gates array<struct<at:int,key:string>>")
    got = {r["job_id"]: [h["at"] for h in r["hits"]] for r in X.with_hits(tagged, listed).collect()}
    assert got == {"j1": [0, 1, 2], "j2": [], "j3": []}
