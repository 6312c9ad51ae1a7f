"""Pairs of gates summed within tasks equal those of one row per job and pair."""

import pytest
from pyspark.sql import functions as F

from signalloom.functions.text import chained
from signalloom.operators import crossdomain as X

TAGGED = "organization string, job_id string, evidence_id string, sole boolean, tags array<string>, unit string, technologies array<string>"
GATE = "organization string, kind string, side string, family string, subject string, key string, size long, concentration double, signal_id string"


def frames(spark):
    tags = lambda i: [t for t, n in (("h1", 1), ("h2", 2), ("t1", 3), ("t2", 1), ("u", 2), ("x", 1)) if i % n == 0] + [None, "h1"]
    jobs = [("op"[i % 2], f"j{i}", f"e{i}" if i % 7 else None, True, tags(i), "U", ["py", None, "go"][: i % 4]) for i in range(60)]
    jobs += [("o", f"s{i}", f"shared{i % 3}", False, tags(i), "U", ["py"]) for i in range(12)]
    jobs += [(None, "n", "en", True, ["h1", "t1"], None, []), ("q", "q", "eq", True, ["h1", "t1"], None, []), ("o", "z", "ez", True, [], None, [])]
    gates = [(o, kind, side, "f", k, k, 6, 0.5, f"{kind}-{k}" if kind == "signal" else None)
             for o in ("o", "p") for kind in ("group", "signal") for side, k in (("hiring", "h1"), ("hiring", "h2"), ("technology", "t1"), ("technology", "t2"))]
    gates += [("o", "unit", "hiring", "business_unit", "U", "u", 3, 0.5, None), ("o", "group", "hiring", "f", "none", None, 3, 0.5, None)]
    return spark.createDataFrame(jobs, TAGGED).repartition(3), spark.createDataFrame(gates, GATE)


def counts(frame):
    return sorted((str(tuple(r[c] for c in ("organization", *X.PAIR))), r["overlap"], r["evidence_count"]) for r in frame.collect())


@pytest.mark.parametrize("held", [100_000, 0])
def test_pairs_of_sole_rows_are_summed_within_tasks(spark, monkeypatch, held):
    tagged, gates = frames(spark)
    monkeypatch.setattr(X, "NAMED_PAIRS", held)
    lean = X.overlap_counts(tagged, gates)
    assert "MapInArrow" in lean._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(X, "MATRIX_CELLS", 0)  # too many gates for a table: every pair is a row
    plain = X.overlap_counts(tagged, gates)
    assert "MapInArrow" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert counts(lean) == counts(plain)
    assert {r["family"] for r in plain.collect()} == {"f", "signal", "business_unit"}


def test_chained_arrays_are_those_of_concat(spark):
    rows = spark.createDataFrame([(["a", None], ["b"]), ([], ["c"]), (None, ["d"])], "x array<string>, y array<string>")
    assert [r[0] for r in rows.select(chained("x", F.col("y"))).collect()] == [r[0] for r in rows.select(F.concat("x", "y")).collect()]
