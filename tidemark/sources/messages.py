"""The table of messages: its schema, and reading it from files or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType, TimestampType

from tidemark.operators.filters import exact_sender

ATTACHMENT = StructType([StructField("name", StringType()), StructField("suffix", StringType()), StructField("content_type", StringType()), StructField("payload", BinaryType())])
#: One row per message: identity, headers, size in bytes, bodies and attachments.
MESSAGE = StructType(
    [
        StructField("message_id", StringType()),
        StructField("uid", LongType()),
        StructField("from_raw", StringType()),
        StructField("subject", StringType()),
        StructField("sent_at", TimestampType()),
        StructField("size", LongType()),
        StructField("plain", ArrayType(StringType())),
        StructField("html", ArrayType(StringType())),
        StructField("attachments", ArrayType(ATTACHMENT)),
    ]
)


def read_messages(spark: SparkSession, path: str, kind: str = "parquet", streaming: bool = False) -> DataFrame:
    """Messages of MESSAGE's schema from Parquet or JSON files (payloads in Base64 there), whatever columns the files have
    besides; a column that they lack is null. Adds sender: the one address of the header, null if there isn't exactly
    one. Columns that a query doesn't use aren't read."""
    reader = (spark.readStream if streaming else spark.read).schema(MESSAGE)
    rows = reader.json(path) if kind == "json" else reader.parquet(path)
    return rows.withColumn("sender", exact_sender("from_raw"))


def body(parts: Column | str) -> Column:
    """The parts of a body as one text; null without any."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def header_facts(messages: DataFrame) -> DataFrame:
    """message_id, sender, subject, size, and what the bodies and attachments hold: characters of each kind of body, number
    and bytes of attachments."""
    length = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    files = F.coalesce("attachments", F.array().cast(ArrayType(ATTACHMENT)))
    sizes = F.aggregate(files, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["payload"]))
    return messages.select("message_id", "uid", "sender", "subject", "size", length(F.col("plain")).alias("plain_chars"), length(F.col("html")).alias("html_chars"), F.size(files).alias("n_files"), sizes.alias("file_bytes"))
