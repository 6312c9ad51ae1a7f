"""Alignments and related signals met within tasks equal those found by a row per job."""

from pyspark.sql import functions as F
from test_pairs import frames

from signalloom.operators import crossdomain as X


def alignments(spark):
    rows = [(o, f"{o}-{left}-{right}", "f", left, right, None, None) for o in ("o", "p", "r") for left, right in (("h1", "t1"), ("h2", "t1"), ("h2", "t2"), ("u", "x"), ("h1", "gone"), (None, "t1"))]
    rows += [("o", "o-h1-t1", "f", "u", "t2", None, None), ("o", "c", "cluster", "h1", "t2", "s-h", "s-t")]
    return spark.createDataFrame(rows, "organization string, signal_id string, family string, left_key string, right_key string, hiring_signal_id string, technology_signal_id string")


def told(frame, *columns):
    return sorted(str(tuple(r)) for r in frame.select(*columns).collect())


def test_places_of_sole_rows_are_found_within_tasks(spark, monkeypatch):
    tagged, _ = frames(spark)
    signals, columns = alignments(spark), ("organization", "signal_id", "job_id", "evidence_id")
    lean = X.alignment_support(tagged, signals)
    assert "MapInArrow" in lean._jdf.queryExecution().optimizedPlan().toString()
    want = told(X.alignment_support(tagged.drop("sole"), signals), *columns)
    assert told(lean, *columns) == want and len(want) > 50
    monkeypatch.setattr(X, "CELLS", 7)  # a row or two at a time
    assert told(X.alignment_support(tagged, signals), *columns) == want
    monkeypatch.setattr(X, "FEW_SIDES", 0)
    plain = X.alignment_support(tagged, signals)
    assert "MapInArrow" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert told(plain, *columns) == want


def test_signals_of_alignments_are_met_within_tasks(spark, monkeypatch):
    tagged, gates = frames(spark)
    gates = gates.filter("kind = 'signal'").unionByName(gates.filter("kind = 'signal'").withColumns({"organization": F.lit("o"), "signal_id": F.concat("signal_id", F.lit("-again")), "key": F.lit("x")}))
    many = spark.range(70).select(F.lit("o").alias("organization"), F.lit("signal").alias("kind"), F.lit("hiring").alias("side"), F.lit("f").alias("family"), F.lit("n").alias("subject"),
                                  F.when(F.col("id") % 2 == 0, "h2").alias("key"), F.lit(1).cast("long").alias("size"), F.lit(0.5).alias("concentration"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("signal_id"))
    columns = ("organization", "signal_id", "domain", "related_id")
    lean = X.related_signals(tagged, alignments(spark), gates.unionByName(many))
    assert "MapInArrow" in lean._jdf.queryExecution().optimizedPlan().toString()
    got = told(lean, *columns)
    monkeypatch.setattr(X, "MATRIX_CELLS", 0)
    plain = X.related_signals(tagged, alignments(spark), gates.unionByName(many))
    assert "MapInArrow" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert got == told(plain, *columns) and len(got) > 50


def test_no_alignment_relates_to_nothing(spark):
    tagged, gates = frames(spark)
    none = alignments(spark).limit(0)
    assert X.related_signals(tagged, none, gates.filter("kind = 'signal'")).collect() == X.alignment_support(tagged, none).collect() == []
