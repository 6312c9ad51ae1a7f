"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "signalloom", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for intermediate tables.

    ``spark.checkpoint.dir`` if the session names one, else the context's checkpoint folder, else a
    folder inside the warehouse, which all executors share too. Never a machine-local temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame several steps read to the shared folder as Parquet and read it from there.

    Later reads prune columns, survive lost executors and do not repeat the work.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and cut its lineage there."""
    return stage(df, "settled")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once per application.

    Workers that start in another folder import it from the archive, which Spark serves from the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_signalloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="package-")
    archive = shutil.make_archive(f"{folder}/signalloom", "zip", os.path.dirname(root), os.path.basename(root))
    context.addPyFile(archive)
    context._signalloom_shipped = True
