"""Reading of benchmarks, and reports, snapshots and versions written to shared storage.

Writes go below spark.checkpoint.dir, which driver and executors share; only where it is unset in local
mode (tests) a temporary folder is used. Every write is a Parquet or JSON dataset that Spark commits whole.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_date


def fresh_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as written to the shared folder and read back, for results that are used several times."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_benchmark(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """bm_date, bm_value, duplicate. Rows without a date or value are dropped; duplicate marks dates that occur more than
    once, which is an error of the source."""
    rows = df.select(parse_date(date_col).alias("bm_date"), F.col(value_col).try_cast("double").alias("bm_value")).where("bm_date is not null and bm_value is not null")
    return rows.withColumn("duplicate", F.count("*").over(Window.partitionBy("bm_date")) > 1)


def write_report(df: DataFrame) -> DataFrame:
    """Write a report as JSON and return it as read back."""
    path = fresh_path(df.sparkSession, "report")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def fingerprint_of(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free hash of them."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")), 256).alias("fingerprint"))


def save_snapshot(df: DataFrame, config: str, scope: str, passed: bool) -> str:
    """Store resolved observations with the fingerprints that they depend on; returns the path."""
    path = fresh_path(df.sparkSession, "snapshot")
    df.write.parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(config, scope, passed)], "config string, scope string, passed boolean").write.parquet(f"{path}/facts")
    return path


def load_snapshot(spark: SparkSession, path: str, config: str, scope: str) -> DataFrame:
    """The snapshot's rows; refuses where configuration or scope changed or the last run didn't pass."""
    facts = spark.read.parquet(f"{path}/facts").first()
    for name, now in (("config", config), ("scope", scope)):
        if facts[name] != now:
            raise ValueError(f"the snapshot's {name} isn't the present one")
    if not facts["passed"]:
        raise ValueError("the snapshot's run didn't pass")
    return spark.read.parquet(f"{path}/rows")


def files_at(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one of that name: of several writers exactly one gets true. On a local
    disk by a hard link; on HDFS by a rename that refuses to overwrite; on object stores by their conditional put."""
    files, where = files_at(spark, path)
    files.mkdirs(where.getParent())
    if files.getScheme() in ("s3a", "abfs", "abfss", "gs"):
        builder = files.createFile(where).overwrite(False)
        if files.getScheme() == "s3a":
            builder = builder.must("fs.option.create.conditional.overwrite", True)
        try:
            out = builder.build()
            out.write(bytearray(text.encode()))
            out.close()
            return True
        except Py4JJavaError:
            if files.exists(where):
                return False
            raise
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() == "file":
            local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(local(where), local(aside))
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(aside, where, spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Py4JJavaError:
        if files.exists(where):
            return False
        raise
    finally:
        files.delete(aside, False)


LOG = "fingerprint string, rows long, location string, version long"


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """The commit log: an entry per version that is kept."""
    files, where = files_at(spark, f"{path}/log")
    return spark.read.schema(LOG).json(f"{path}/log/*.json") if files.exists(where) else spark.createDataFrame([], LOG)


def current_fingerprint(spark: SparkSession, path: str) -> str | None:
    row = pointers(spark, path).agg(F.max_by("fingerprint", "version")).first()
    return row[0] if row else None


def publish_version(df: DataFrame, path: str, expected: str | None, keep: int) -> int:
    """Stage df as the next version, read it back and compare, check that the base is still the expected one, then enter
    it in the commit log and let all but the newest `keep` versions go. Until the entry is there, readers see the version
    before. Entries are numbered and put only where there is none, so of writers at one base exactly one wins; the
    others get an error, and their staged rows go. Returns the version."""
    spark = df.sparkSession
    staged = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(staged)
    try:
        made, found = fingerprint_of(df).first(), fingerprint_of(spark.read.parquet(staged)).first()
        if made != found:
            raise ValueError("the staged rows aren't those that were to be written")
        base = pointers(spark, path).agg(F.max_by("fingerprint", "version").alias("fingerprint"), F.max("version").alias("version")).first()
        if base["fingerprint"] != expected:
            raise ValueError("the base has changed since the plan was made")
        version = (base["version"] or 0) + 1
        entry = json.dumps({"fingerprint": found["fingerprint"], "rows": found["n"], "location": staged, "version": version})
        if not put_if_absent(spark, f"{path}/log/{version:012d}.json", entry):
            raise ValueError("another writer has published this version")
    except ValueError:
        files, where = files_at(spark, staged)
        files.delete(where, True)
        raise
    prune(spark, path, keep)
    return version


def prune(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the newest `keep` versions: first the entry, then the rows."""
    for old in pointers(spark, path).orderBy(F.desc("version")).offset(keep).collect():  # as many as were published since
        for gone in (f"{path}/log/{old['version']:012d}.json", old["location"]):
            files, where = files_at(spark, gone)
            files.delete(where, True)


def append_batch(batch: DataFrame, path: str, stream: str, number: int, fresh) -> bool:
    """Append fresh(batch) to the table at path once, whatever is replayed: its rows go to a folder of their own, which is
    entered in a ledger of batches. A batch that the ledger knows does nothing, and reads nothing of the table. Returns
    whether rows were appended."""
    spark = batch.sparkSession
    entry = f"{path}/ledger/{stream}/{number:012d}.json"
    files, where = files_at(spark, entry)
    if files.exists(where):
        return False
    own = f"{path}/batches/{stream}-{number:012d}"
    fresh(batch).write.mode("overwrite").parquet(own)
    return put_if_absent(spark, entry, json.dumps({"stream": stream, "batch": number, "location": own}))


def appended_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the batches that the ledger knows."""
    files, where = files_at(spark, f"{path}/ledger")
    if not files.exists(where):
        return spark.createDataFrame([], schema)
    known = [r["location"] for r in spark.read.schema("location string").json(f"{path}/ledger/*/*.json").collect()]  # a line per batch
    return spark.read.schema(schema).parquet(*known) if known else spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, rows of what is kept."""
    return pointers(spark, path).select("version", "rows")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(pointers(spark, path).agg(F.max_by("location", "version")).first()[0])
