"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame operations only.

1. Targets: weights are shared out under a ceiling per source (water-filling over one row per source).
2. Blocks: a document's seeded hash puts it into one of FINE cells of its source; runs of cells are blocks, so block
   order is a random permutation of the source's documents. A source takes whole epochs plus the first runs of cells
   that fill the rest; in the one run on the border, documents are taken in hash order while they fit, then one more
   that comes nearest. Small sources have longer runs, so that a border run has some documents to choose from.
3. Splitting tree: each drawn block is a token of its source. The root holds all tokens; every node ranks its tokens by
   a seeded hash and gives the first half to its left child. The counts per source on the left then follow the
   multivariate hypergeometric law, with exact row and column sums. Leaves are output shards, so each shard's
   blocks are disjoint from every other's.
4. Rows of a shard are shuffled locally by a seeded order key.

The number of tokens is bounded by 2 * (BLOCKS + number of sources), whatever the size of the tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, staged

#: Hash cells per source, and blocks over all sources.
FINE, BLOCKS = 4096, 4096
#: Documents that a run of cells has on average, where the source is large enough.
RUN_DOCS = 64
WEIGHTS, SHARE, CEILING = (5, 2, 1), 1.5, 2.0


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size (words), h (a seeded hash of the row) and cell."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.withColumns({"_size": size, "_h": h}).withColumn("_cell", F.pmod(F.col("_h"), F.lit(FINE)).cast("int"))


def targets(cells: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, source_docs, target from (source, _cell, _words, _docs): sources by code point, null last, weigh `weights` in
    turn. The common level is the first at which no further source reaches its ceiling."""
    per = cells.groupBy("source").agg(F.sum("_words").alias("source_size"), F.sum("_docs").alias("source_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(ceiling))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("_w").over(onward)
    per = per.withColumn("_level", level)
    reached = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))
    per = per.withColumn("_final", F.max(reached).over(everything))
    return per.select("source", "source_size", "source_docs", F.least("_cap", F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).alias("target"))


def plan(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source: epochs (whole passes), run (cells per run), border (the run that is taken in part, null if none),
    quota (words to take in the border run), blocks (number of blocks)."""
    total = F.sum("source_size").over(Window.partitionBy())
    per = wanted.withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(FINE), F.round(F.col("source_size") * BLOCKS / F.greatest(total, F.lit(1))))).cast("int"))
    per = per.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("int"))
    per = per.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    per = per.withColumn("run", F.least(F.lit(FINE), F.greatest(F.lit(1), F.ceil(FINE * RUN_DOCS / F.col("source_docs")))).cast("int"))
    runs = cells.alias("c").join(per.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")))
    facts = [F.col("p.source").alias("source"), *map(F.col, ("source_size", "target", "epochs", "blocks", "run", "_rest"))]
    runs = runs.select(*facts, F.expr("_cell div run").cast("int").alias("_run"), "_words")
    names = ["source", "source_size", "target", "epochs", "blocks", "run", "_rest"]
    runs = runs.groupBy(*names, "_run").agg(F.sum("_words").alias("_words"))
    runs = runs.withColumn("_upto", F.sum("_words").over(Window.partitionBy("source").orderBy("_run")))
    reached = F.when((F.col("_rest") > 0.5) & (F.col("_upto") >= F.col("_rest")), F.struct(F.col("_run").alias("at"), (F.col("_rest") - (F.col("_upto") - F.col("_words"))).alias("quota")))
    return runs.groupBy(*names).agg(F.min(reached).alias("_b")).select(*names[:-1], F.col("_b.at").alias("border"), F.col("_b.quota").alias("quota"))


def border_picks(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """(source, _h, doc_id) of the documents in border runs that are taken once more. Equal rows share a fate."""
    border = per_source.where(F.col("border").isNotNull()).select(F.col("source").alias("_s"), F.col("border").alias("_b"), "run", "quota")
    inside = rows.select("source", "doc_id", "_h", "_size", "_cell").join(border, F.col("source").eqNullSafe(F.col("_s")) & (F.expr("_cell div run") == F.col("_b")))
    inside = inside.groupBy("source", "_h", "doc_id", "_size", "quota").agg(F.count("*").alias("_n")).where("_size > 0")
    order = Window.partitionBy("source").orderBy("_h", "doc_id")  # one border run per source
    cell = Window.partitionBy("source")
    words = F.col("_size") * F.col("_n")
    inside = inside.withColumn("_in", F.sum(words).over(order) <= F.col("quota"))
    inside = inside.withColumn("_gap", F.col("quota") - F.coalesce(F.sum(F.when(F.col("_in"), words)).over(cell), F.lit(0)))
    nearest = F.struct(F.abs(F.col("_gap") - words).alias("off"), F.col("_h").alias("h"), F.col("doc_id").alias("d"))
    helps = ~F.col("_in") & (F.abs(F.col("_gap") - words) < F.col("_gap"))
    inside = inside.withColumn("_best", F.min(F.when(helps, nearest)).over(cell))
    chosen = F.col("_in") | F.coalesce(helps & (nearest == F.col("_best")), F.lit(False))
    return inside.where(chosen).select(F.col("source").alias("_ps"), F.col("_h").alias("_ph"), F.col("doc_id").alias("_pd"), F.lit(1).alias("_picked"))


def splitting_tree(per_source: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, draw, shard): the output shard of each drawn block. Every level halves each node's tokens."""
    drawn = F.col("epochs") * F.col("blocks") + F.when(F.col("border").isNotNull(), F.expr(f"least((border + 1) * run - 1, {FINE - 1}) * blocks div {FINE}") + 1).otherwise(0)
    tokens = per_source.withColumn("_d", drawn.cast("int")).where("_d > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("_d") - 1)).alias("draw"), F.lit(0).alias("shard"))
    for depth in range(int(math.log2(shards))):
        node = Window.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(depth), F.col("source"), F.col("draw")), F.col("source"), F.col("draw")))
        half = F.expr("(_all + 1) div 2")
        tokens = tokens.withColumns({"_rank": rank, "_all": F.count("*").over(node)}).select("source", "draw", (F.col("shard") * 2 + (F.col("_rank") > half).cast("int")).alias("shard"))
    return tokens


def drawn(docs: DataFrame, shards: int, seed: int, weights: tuple, share: float, ceiling: float) -> DataFrame:
    """_row (all columns of docs), _size, source_size, target, copies, shards."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text")
    rows = sized(whole, seed).drop("text")
    facts = rows.select("source", "doc_id", "_h", "_size", "_cell").hint("rebalance")  # files by bytes, not one per split of the texts
    facts = staged(facts, "mix-sizes")
    cells = facts.groupBy("source", "_cell").agg(F.sum("_size").alias("_words"), F.count("*").alias("_docs"))
    per_source = staged(plan(cells, targets(cells, weights, share, ceiling)), "mix-plan")
    picks = staged(border_picks(facts, per_source), "mix-border")
    tokens = staged(splitting_tree(per_source, shards, seed), "mix-tokens")

    if set(docs.columns) <= {"source", "doc_id"}:  # sizes are known already
        rows = facts.withColumn("_row", F.struct(*docs.columns))
    named = per_source.withColumnRenamed("source", "_ps")
    out = rows.join(named, F.col("source").eqNullSafe(F.col("_ps"))).drop("_ps")
    out = out.join(picks, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_h") == F.col("_ph")) & F.col("doc_id").eqNullSafe(F.col("_pd")), "left").drop("_ps", "_ph", "_pd")
    at = F.expr("_cell div run")
    more = F.when(at < F.col("border"), 1).when(at == F.col("border"), F.coalesce(F.col("_picked"), F.lit(0))).otherwise(0)
    out = out.withColumn("copies", F.when(F.col("_size") > 0, F.col("epochs") + more).otherwise(0).cast("int"))
    out = out.withColumn("_block", F.expr(f"_cell * blocks div {FINE}").cast("int"))
    for n in range(int(ceiling)):
        taken = tokens.select(F.col("source").alias("_ts"), F.col("draw").alias("_td"), F.col("shard").alias(f"_shard{n}"))
        draw = F.when(F.col("copies") > n, F.lit(n) * F.col("blocks") + F.col("_block"))
        out = out.join(taken, F.col("source").eqNullSafe(F.col("_ts")) & (draw == F.col("_td")), "left").drop("_ts", "_td")
    shard_of: list[Column] = [F.col(f"_shard{n}") for n in range(int(ceiling))]
    return out.select("_row", "_size", "source_size", "target", "copies", F.filter(F.array(*shard_of), lambda x: x.isNotNull()).alias("shards"))


def mix(docs: DataFrame, shards: int = 8, seed: int = 29, weights: tuple = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """All columns of docs, plus size, source_size, target, taken (words the mix takes, repeats counted), copies (0 to
    2) and shards (the output shard of each copy; as many entries as copies).

    Null or empty text: size 0, never taken. A null source is a source of its own, last in order. Equal rows are taken
    alike. A source without words has target 0. An empty table gives no rows. Other columns are carried along; the
    result's own names win over a column of the same name. `shards` must be a power of two.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies", "shards")]
    out = drawn(docs, shards, seed, weights, share, ceiling)
    return out.select(*[F.col(f"_row.{c}") for c in own], F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).cast("long").alias("taken"), "copies", "shards")


def mixed_documents(docs: DataFrame, shards: int = 8, seed: int = 29) -> DataFrame:
    """The mix itself: each document once per copy, laid out by output shard and shuffled inside each shard. Columns are
    those of docs, whatever their names."""
    out = drawn(docs, shards, seed, WEIGHTS, SHARE, CEILING).where("copies > 0").select("_row", F.posexplode("shards").alias("_copy", "_shard"))
    key = F.xxhash64(F.lit(seed + 1), F.col("_copy"), F.col("_row.doc_id"))
    out = out.withColumn("_key", key).repartition("_shard", F.pmod(F.col("_key"), F.lit(64))).sortWithinPartitions("_shard", "_key")
    return out.select("_row.*")
