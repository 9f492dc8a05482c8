"""Corpus preparation over `documents`: each stage reads what the one before it kept.

1. language_id: documents without a language (no letters), or whose language has less than half of their words, go.
2. near_duplicates: one document of each component of the n-gram Jaccard join stays, and one row of it.
3. decontamination: documents that hold a benchmark item go.
4. mixing: documents are taken 0 to 2 times, so that the sources reach their target weights.
5. token_ids: what is left is written as token ids with a perfect hash index, and read back from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, mixing, ngram_join, token_index
from tidemark.llm.common import staged, table, text_key
from tidemark.llm.queries import tokenizer_path

#: Least share of a document's words that its language must have, and n-gram similarity (in per cent) of duplicates.
LEAST_SHARE, SIMILAR = 0.5, 85


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns are carried as they are, whatever their names."""
    found = langid.identify(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "lang"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the least doc_id (null last; one of equal rows). Texts are joined
    under a number of the text, so rows with one doc_id are told apart. Texts without words are no duplicates of
    anything, so all their rows stay."""
    key = F.coalesce(text_key("text"), F.lit(b""))
    joined = ngram_join.join(docs.select(key.alias("doc_id"), "text"), SIMILAR)
    texts = joined.groupBy("doc_id").agg(F.first("component_id").alias("component"), F.max("n_shingles").alias("size")).withColumnRenamed("doc_id", "_t")
    rows = docs.select(key.alias("_k"), "doc_id").groupBy("_k", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_k", "n")).alias("_first")
    keep = rows.join(texts, F.col("_k") == F.col("_t")).groupBy("component").agg((F.max("size") > 0).alias("_worded"), first)
    keep = staged(keep.select(F.col("_first._k").alias("_k"), "_worded", "_first"), "kept-texts")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), F.col("doc_id").alias("_id"))
    stays = whole.join(keep, F.col("_key") == F.col("_k")).where(~F.col("_worded") | F.col("_id").eqNullSafe(F.col("_first.doc_id")))
    if keep.where("_worded and _first.n > 1").isEmpty():
        return stays.select("_row.*")
    repeated = F.col("_worded") & (F.col("_first.n") > 1)
    one = stays.where(repeated).groupBy("_key").agg(F.first("_row").alias("_row"))
    return stays.where(~repeated).select("_row.*").unionByName(one.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_index.roundtrip(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_ids", token_ids),
]

#: None: two stages learn models and one searches a latent space, which SQL can't express; tests hold run() against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
