"""Tables on plain Parquet: lookups, upserts, guarded batch saves, graph and report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from signalloom.operators.ordering import latest_per

EVIDENCE_KEY = ["evidence_id"]
JOB_KEY = ["organization", "source_job_id"]
ENRICHMENT_KEY = ["job_id", "evidence_id", "provider", "model", "prompt_schema_version"]
RUN_KEY = ["run_id"]
RESEARCH_KEY = ["organization", "question_key", "time_horizon", "provider", "model", "agent_version"]


def scan(table: DataFrame, organization: str | None = None) -> DataFrame:
    """All rows, or those of one organization (a partition filter where the table is partitioned)."""
    return table if organization is None else table.filter(F.col("organization") == organization)


def lookup(table: DataFrame, **keys) -> DataFrame:
    """Rows with the given key values."""
    out = table
    for column, value in keys.items():
        out = out.filter(F.col(column) == value)
    return out


def lookup_batch(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose keys occur in the frame of keys."""
    return table.join(keys, keys.columns, "left_semi")


def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], preserve: Sequence[str] = (), order: Sequence[Column] = ()) -> DataFrame:
    """Target after replacing or adding the updates by key.

    Within one batch the last row of a key under ``order`` wins. ``preserve`` columns keep the
    stored value of rows that exist already. Null keys match each other.
    """
    fresh = latest_per(updates, keys, [c.desc() for c in order]) if order else updates.dropDuplicates(list(keys))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    arrived, stored = F.expr("new._arrived"), F.expr("old._stored")
    both = target.withColumn("_stored", F.lit(True)).alias("old").join(fresh.withColumn("_arrived", F.lit(True)).alias("new"), same("old", "new"), "full_outer")
    columns = []
    for name in target.columns:
        if name not in updates.columns:
            columns.append(F.col(f"old.{name}").alias(name))
        elif name in preserve:
            columns.append(F.when(stored.isNotNull(), F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name))
        else:
            columns.append(F.when(arrived.isNotNull(), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name))
    return both.select(*columns)


def upsert_evidence(target, updates, order=()):
    return merge_upsert(target, updates, EVIDENCE_KEY, order=order)


def upsert_jobs(target, updates, order=()):
    """Jobs keep the id they were first stored with."""
    return merge_upsert(target, updates, JOB_KEY, preserve=["job_id"], order=order)


# --- tables in key buckets -------------------------------------------------------------------

BUCKETS = 64  # of a table, fixed when it is created; a large table takes more


def _in_buckets(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Writes a table dealt by the hash of its keys into one partition folder per bucket."""
    _in_buckets(df, keys, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")


def read_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """The table with its ``bucket`` column, None before it is created."""
    try:
        return spark.read.parquet(f"{path}/rows")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def upsert_buckets(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], preserve: Sequence[str] = (), order: Sequence[Column] = (), buckets: int = BUCKETS) -> None:
    """``merge_upsert`` into a table in key buckets: only the buckets the batch touches are read and rewritten.

    The merged buckets are written beside the table first and replace the old ones by dynamic partition
    overwrite; a replacement that is cut off is repeated before anything else is done. The same batch
    again changes nothing. One writer at a time.
    """
    _replace_merged(spark, path)
    stored = read_buckets(spark, path)
    dealt = _in_buckets(updates, keys, buckets)
    touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    if not touched:
        return
    if stored is None:
        merged = latest_per(dealt, keys, [c.desc() for c in order]) if order else dealt.dropDuplicates(list(keys))
    else:
        merged = merge_upsert(stored.filter(F.col("bucket").isin(touched)), dealt, [*keys, "bucket"], preserve, order)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/_merged/rows")
    _set_state(spark, path, "ready")
    _replace_merged(spark, path)


def _set_state(spark: SparkSession, path: str, state: str) -> None:
    spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/_merged/state")


def _replace_merged(spark: SparkSession, path: str) -> None:
    """Puts merged buckets in the place of the old ones, if there are any that have not got there."""
    try:
        ready = spark.read.schema("state string").json(f"{path}/_merged/state").filter("state = 'ready'").count() > 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        ready = False
    if ready:
        merged = spark.read.parquet(f"{path}/_merged/rows")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
        _set_state(spark, path, "done")


# --- guarded batches -------------------------------------------------------------------------

_VERSIONS = "sequence long, version string"


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and name of the version announced last; -1 and None before the first."""
    try:
        row = spark.read.schema(_VERSIONS).json(f"{path}/_versions").agg(F.max("sequence").alias("sequence"), F.max_by("version", "sequence").alias("version")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, None
    return (-1, None) if row.sequence is None else (row.sequence, row.version)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version announced last, None before the first."""
    return _newest(spark, path)[1]


def _announce(spark: SparkSession, path: str, version: str) -> None:
    """Adds the version to the list readers go by; earlier entries are never rewritten."""
    sequence = _newest(spark, path)[0] + 1
    spark.createDataFrame([(sequence, version)], _VERSIONS).coalesce(1).write.mode("append").json(f"{path}/_versions")


def save_batch(spark: SparkSession, jobs: DataFrame, evidence: DataFrame, path: str, version: str, order: str = "position") -> int:
    """Evidence then jobs, all or nothing; returns the number of rows saved.

    ``jobs`` and ``evidence`` come paired by ``position``. One pair with differing ids rejects the batch.
    """
    pairs = jobs.select(order, F.col("evidence_id").alias("posting_evidence_id")).join(evidence.select(order, "evidence_id"), order, "left")
    counts = pairs.agg(F.count(F.lit(1)), F.count_if(~F.col("posting_evidence_id").eqNullSafe(F.col("evidence_id")))).first()
    if counts[1]:
        raise ValueError("posting evidence_id must match evidence evidence_id")
    for name, updates, upsert, parts in (("evidence", evidence, upsert_evidence, ()), ("jobs", jobs, upsert_jobs, ("organization",))):
        stored = read_saved(spark, path, name)
        merged = latest_per(updates, EVIDENCE_KEY if name == "evidence" else JOB_KEY, [F.desc(order)]).drop(order) if stored is None else upsert(stored, updates, [F.col(order)])
        writer = merged.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{path}/{name}/{version}")
    _announce(spark, path, version)  # one entry for both tables: readers see all of the batch or nothing
    return counts[0]


def read_saved(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """One of the tables of the last complete batch."""
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/{name}/{version}")


def check_enrichments(enrichments: DataFrame, jobs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Enrichments with ``reject_reason``: null means the version may be stored."""
    foreign = F.exists("field_support", lambda s: s["evidence_id"] != F.col("evidence_id"))
    known_jobs = jobs.select("job_id", F.col("evidence_id").alias("_job_evidence"))
    known_evidence = evidence.select("evidence_id", F.lit(True).alias("_evidence"))
    joined = enrichments.join(known_jobs, "job_id", "left").join(known_evidence, "evidence_id", "left")
    reason = (
        F.when(F.coalesce(foreign, F.lit(False)), F.lit("enrichment support evidence_id must match enrichment evidence_id"))
        .when(F.col("_job_evidence").isNull() | F.col("_evidence").isNull(), F.lit("enrichment source job and evidence must exist"))
        .when(F.col("_job_evidence") != F.col("evidence_id"), F.lit("enrichment evidence_id must match the source job evidence_id"))
    )
    return joined.withColumn("reject_reason", reason).drop("_job_evidence", "_evidence")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables partitioned by organization; only the organizations written are replaced."""
    for name, frame in (("nodes", nodes), ("edges", edges)):
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("organization").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, organization: str | None = None) -> tuple[DataFrame, DataFrame]:
    return scan(spark.read.parquet(f"{path}/nodes"), organization), scan(spark.read.parquet(f"{path}/edges"), organization)


def load_or_build_graph(spark: SparkSession, path: str, build) -> tuple[DataFrame, DataFrame]:
    """The stored graph, or the one ``build()`` returns after storing it."""
    try:
        return read_graph(spark, path)
    except AnalysisException:
        nodes, edges = build()
        write_graph(nodes, edges, path)
        return read_graph(spark, path)


def write_report(df: DataFrame, path: str) -> None:
    """Result rows as JSON documents."""
    df.write.mode("overwrite").json(path)
