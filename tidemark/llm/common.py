"""Helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode
    (tests); on a cluster that is an error, as a folder of one machine would give wrong results."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of 8 MB (or most) instead of Spark's 64, unless the session sets a size of its own (but for 8m and
    4m, which another operator may have set): what a Python worker and its executor hold then doesn't grow with the length
    of the texts."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) in ("67108864b", "64m", "64MB", "8m", "4m"):
        spark.conf.set(size, most)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def release() -> None:
    """Let go of what this Python worker holds, and give freed memory back to the system."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_worker(key, make: Callable):
    """What make gives, kept in this Python worker for the tasks that follow. A worker keeps one such thing: tasks of
    another operator, or of another model, let the earlier one go."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def text_key(text: str) -> Column:
    """Identity of a text: 128 bits of its SHA-256; null stays null."""
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents whose crc32(doc_id as text) mod 3 is 1; no model learns from them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
