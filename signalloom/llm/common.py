"""Helpers the operators share: tables, files on the shared store, digests."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from signalloom.session import scratch_path, stage  # noqa: F401  (stage is used by the operators)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(spark: SparkSession) -> None:
    """Rows of these operators hold whole texts, so fewer go in an Arrow batch, unless the session says how many."""
    if spark.conf.get(_BATCH) == "10000":  # Spark's own default, meant for short rows
        spark.conf.set(_BATCH, "2000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    whole_texts(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_store(uri: str):
    """The file system and path behind a URI; on an executor it must be a store that all of them share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def new_file(folder: str, suffix: str):
    """Creates a file under a name no other attempt uses; it counts only once a manifest names it."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


def scratch(spark: SparkSession, label: str) -> str:
    path = scratch_path(spark, label)
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


_owner: list = [None, None]


def claim_cache(owner, forget) -> None:
    """Gives a worker's memory for remembered results to one operator; the one before forgets its own.

    Workers live on from stage to stage, so without this the caches of all operators would add up.
    """
    if _owner[0] != owner:
        if _owner[1] is not None:
            _owner[1]()
            give_back_memory()
        _owner[:] = owner, forget


def give_back_memory() -> None:
    """Returns freed memory to the system; the allocators of Arrow and of the C library would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_of(ids: np.ndarray, crc: int = 0) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes(), crc)
