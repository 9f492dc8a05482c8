"""Quality rules with cross-document line frequency. DataFrame operations only.

Base rules look at one text. The corpus rule hashes normalised lines, counts the distinct documents (by content) of each
host that hold a line, removes lines above the limit, and rejects documents that have too little left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: The ASCII white space that separates words, and the symbols that are counted.
SPACE, SYMBOLS = "\x20\t\n\x0b\x0c\r", "#*$%&|<>"


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of `width` words that occur twice or more. Window hashes are sorted with their positions,
    equal neighbours are kept, and the covered words are summed as a union of intervals."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def bound(value: Column, f) -> Column:
        """f of a value that is computed once."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    repeats = F.size(F.array_distinct(hashes)) < n - width + 1
    return F.when((n > width) & repeats, bound(bound(pairs, positions), covered)).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures of one text (null counts as empty), key (a hash of the text) and lines: hash and
    number of words of each normalised line with a word, in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    df = df.select("*", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"), lines.alias("_lines"), normal_lines(F.col("text")).alias("_normal"))
    return df.select(
        "doc_id",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.xxhash64("text").alias("key"),
        F.transform("_normal", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("n"))).alias("lines"),
    )


def normal_lines(text: Column) -> Column:
    """Lines that hold a word: lower case, white space runs as one space, trimmed."""
    even = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    return F.filter(F.transform(F.split(even, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def frequent_lines(facts: DataFrame, line_docs: int, line_share: float) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (source, key, lines), and per host (source) the hashes of its boilerplate lines. A host has at
    most 1 / line_share times as many of them as its texts have lines on average, so they fit one row."""
    texts = facts.groupBy("source", "key").agg(F.first("lines").alias("lines"))
    per_host = texts.groupBy("source").agg(F.count("*").alias("_texts")).withColumnRenamed("source", "_hs")
    held = texts.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    per_line = held.groupBy("source", "h").agg(F.count("*").alias("_docs")).where(F.col("_docs") > line_docs)
    over = per_line.join(per_host, F.col("source").eqNullSafe(F.col("_hs"))).where(F.col("_docs") > F.col("_texts") * F.lit(line_share))
    return texts, over.groupBy("source").agg(F.collect_list("h").alias("_often"))


def judge(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, line_docs: int = 5, line_share: float = 0.05, min_left: float = 0.3, salts: int = 16) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_words.

    A line is boilerplate of a host (`source`) when over max(line_docs, line_share * the host's distinct texts)
    distinct texts hold it; copies of one text count once, so a document isn't rejected for being copied. The share
    decides at every size of host; line_docs only keeps chance from deciding on a handful of texts. A document whose
    words outside such lines are under min_words or under min_left of its words is rejected.

    Null texts count as empty and fail the base rules; a very long text is measured whole, and only hashes of its lines
    are shuffled; a null source is a host of its own; a null doc_id is a row like any other; repeated rows are judged
    alike; a line exactly at a limit stays; an empty table gives no rows; further columns are not read.
    """
    facts = staged(measured(docs), "quality-facts")
    texts, frequent = frequent_lines(facts, line_docs, line_share)
    # stored, so that the planner knows its size; a hot host's texts are dealt to salts
    frequent = staged(frequent.select(F.col("source").alias("_fs"), "_often"), "quality-lines").withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = texts.withColumn("_salt", F.pmod("key", F.lit(salts)).cast("int"))
    hit = salted.join(frequent, F.col("source").eqNullSafe(F.col("_fs")) & (F.col("_salt") == F.col("_of")))
    hit = hit.withColumn("_some", F.array_intersect(F.transform("lines", lambda x: x["h"]), F.col("_often"))).where(F.size("_some") > 0)
    words = F.aggregate(F.filter("lines", lambda x: F.array_contains("_some", x["h"])), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    removed = hit.select(F.col("source").alias("_rs"), F.col("key").alias("_rk"), words.alias("_removed"))
    out = facts.drop("lines").join(removed, F.col("source").eqNullSafe(F.col("_rs")) & (F.col("key") == F.col("_rk")), "left")
    gone = F.coalesce(F.col("_removed"), F.lit(0)).cast("long")
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    depleted = (gone > 0) & ((left < min_words) | (left < F.lit(min_left) * F.col("n_words")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("n_removed_words")
    )
