"""Queries read the job table with the fields of their kind alone and give what the whole table gives."""

import datetime

from pyspark.sql import functions as F
from test_aligned import told
from test_graph import sample

from signalloom.operators import evidence as E, graph as G, technology as K
from signalloom.plans.binding import NEEDS, Binding, Staged, _with_graph_columns


def lean_rows(jobs, evidence, latest, kind):
    need = NEEDS[kind]
    return E.intelligence_rows(jobs.select(*need.base, *need.jobs), evidence, latest.select("job_id", *need.enrichment), need.evidence)


def test_concepts_of_some_types_are_those_of_all(spark):
    jobs, evidence, latest = sample(spark)
    linked = G.linked_jobs(G.present_jobs(jobs, evidence), latest)
    columns = ("organization", "job_id", "edge_type", "node_id", "value", "derivation_type", "evidence_id")
    every = G.concept_links(linked)
    spelled = G.last_spellings(linked, G.keyed_concepts(every))
    for kind, types in (("capabilities", ["Capability"]), ("technologies", ["Technology"]), ("insights", ["Capability", "Technology"])):
        rows = G.present_rows(_with_graph_columns(lean_rows(jobs, evidence, latest, kind)).filter("evidence IS NOT NULL"))
        some = G.concept_links(rows, types)
        assert told(some, *columns) == told(every.filter(F.col("node_type").isin(types)), *columns)
        assert told(G.last_spellings(rows, G.keyed_concepts(some), types), "node_id", "value") == told(spelled.filter(F.col("node_type").isin(types)), "node_id", "value")
    provenance = G.concept_links(G.present_rows(_with_graph_columns(lean_rows(jobs, evidence, latest, "provenance")).filter("evidence IS NOT NULL")), ["Capability"])
    columns = ("job_id", "node_id", "source_job_id", "evidence_id", "enrichment_provider")
    assert told(provenance, *columns) == told(every.filter("node_type = 'Capability'"), *columns)


def test_checks_of_sole_rows_are_those_of_the_joins(spark):
    jobs, evidence, latest = sample(spark)
    latest = latest.withColumn("evidence_id", F.when(F.col("job_id") == "job-Wel-1", "other").otherwise(F.col("evidence_id")))
    rows = _with_graph_columns(lean_rows(jobs, evidence, latest, "checks")).filter("sole")
    sole = rows.select("job_id")
    checked = G.graph_checks(jobs.join(sole, "job_id", "left_semi"), evidence, latest)
    columns = ("organization", "subject", "violation")
    assert told(G.row_checks(rows), *columns) == told(checked, *columns)
    assert {r["violation"] for r in checked.collect()} == {"missing_evidence", "enrichment_mismatch"}


def test_enriched_jobs_tell_sole_rows_and_count_the_same(spark):
    jobs, evidence, latest = sample(spark)
    rows = K.enriched_jobs(jobs, evidence, latest)
    assert {r["job_id"]: r["sole"] for r in rows.collect()} == {"job-Wel-1": True, "job-Wel-2": True, "job-Wel-3": False, "job-Wel-4": False, "job-Exa-1": True}
    columns = ("organization", "family", "label", "technology", "job_count", "enriched_count", "evidence_count")
    assert told(K.tech_counts(K.tech_facets(rows)), *columns) == told(K.tech_counts(K.tech_facets(rows.drop("sole"))), *columns)
    twice = K.enriched_jobs(jobs.unionByName(jobs.filter("job_id = 'job-Wel-1'")), evidence, latest)
    assert [r["sole"] for r in twice.filter("job_id = 'job-Wel-1'").collect()] == [False, False]


def test_the_unified_view_leaves_out_what_rows_are_read_without(spark):
    jobs, evidence, latest = sample(spark)
    whole = E.unified_rows(E.intelligence_rows(jobs, evidence, latest).filter("evidence IS NOT NULL"))
    some = E.unified_rows(lean_rows(jobs, evidence, latest, "summary").filter("evidence IS NOT NULL"))
    assert {"captured_at", "enrichment_present", "observed_at"} < {*some.columns} < {*whole.columns}
    assert told(some, *some.columns) == told(whole, *some.columns)


def tables(spark):
    at = lambda n: datetime.datetime(2000, 1, n)
    return {
        "nation": spark.createDataFrame([(1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"), "region": spark.createDataFrame([(1, "R")], "r_regionkey int, r_name string"),
        "customer": spark.createDataFrame([(1, "C", 1, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": spark.createDataFrame([(1, "S", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": spark.createDataFrame([(1, "a b", "Brand#1", "T1"), (2, "c d", "Brand#2", "T2")], "p_partkey long, p_name string, p_brand string, p_type string"),
        "orders": spark.createDataFrame([(i, 1, "F", at(i), "1-URGENT") for i in (1, 2)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": spark.createDataFrame(
            [(1, p, s, n, 0.0, 0.0, "R", "F", at(d)) for p, s, n, d in ((1, 1, 1, 1), (2, 1, 2, 2), (1, 9, 3, 9), (2, None, 4, 9), (9, 1, 5, 9))],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }


def test_lines_without_supplier_or_part_are_no_version_and_jobs_keep_their_lists(spark, monkeypatch):
    made = tables(spark)
    monkeypatch.setattr(Binding, "table", lambda self, name: made[name])
    b = Binding(spark, "nowhere")
    assert [(r["job_id"], r["prompt_schema_version"][:2]) for r in b.latest.collect()] == [("1", "v2")]
    assert {r["job_id"]: r["technologies"] for r in b.jobs.collect()} == {"1": ["Brand#1", "Brand#2"], "2": []}
    # Lines of a job meet once: the newest one is chosen, made wide and joined to its job in the same task.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        model = Staged(spark, "nowhere")
        model.need = NEEDS["technologies"]
        rows = E.intelligence_rows(model.jobs_of_need(), model.evidence, model.latest.select("job_id", *model.need.enrichment), model.need.evidence)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning(job_id" in line for line in plan.splitlines()) == 3 and "hashpartitioning(l_orderkey" not in plan  # orders, lists, lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
