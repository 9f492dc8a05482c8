"""Where two versions of a table of cells differ: a tree of digests per sheet over blocks of rows. Two versions are compared
from the roots down, only below nodes that differ, and only the blocks at its end are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, FANOUT = 256, 16


def block_of(row: str = "row"):
    return F.floor((F.col(row) - 1) / BLOCK_ROWS).cast("long")


def summed(*columns: str):
    """An order-free digest of rows."""
    h = F.xxhash64(*columns)
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string")), 256)


def digest_tree(cells: DataFrame) -> DataFrame:
    """sheet, level, node, digest: level 0 has the blocks of BLOCK_ROWS rows, each level above the digests of FANOUT nodes
    below; every sheet ends in node 0 of the top level, which is the same for all. Small beside the cells; stored with a
    version, it spares reading the cells again."""
    level = cells.groupBy("sheet", block_of().alias("node")).agg(summed("row", "col", "kind", "value").alias("digest"))
    last = cells.agg(F.max(block_of())).first()[0] or 0
    out, number = level.select("sheet", F.lit(0).alias("level"), "node", "digest"), 0
    while last > 0:
        level = level.groupBy("sheet", F.floor(F.col("node") / FANOUT).alias("node")).agg(summed("node", "digest").alias("digest"))
        number, last = number + 1, last // FANOUT
        out = out.unionByName(level.select("sheet", F.lit(number).alias("level"), "node", "digest"))
    return out


def lifted(tree: DataFrame, top: int, own: int) -> DataFrame:
    """A tree with levels of single nodes on top, so that it is as high as another one."""
    root = tree.where(F.col("level") == own)
    for level in range(own + 1, top + 1):
        root = root.groupBy("sheet").agg(F.lit(0).cast("long").alias("node"), summed("node", "digest").alias("digest")).select("sheet", F.lit(level).alias("level"), "node", "digest")
        tree = tree.unionByName(root)
    return tree


def differing_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """sheet, block of the blocks in which two digest trees differ (on one side only, too), found from the roots down."""
    tops = [t.agg(F.max("level")).first()[0] or 0 for t in (before, after)]
    top = max(tops)
    sides = [lifted(t, top, own) for t, own in zip((before, after), tops, strict=True)]
    asked = None
    for level in range(top, -1, -1):
        a, b = (t.where(F.col("level") == level).select("sheet", "node", "digest") for t in sides)
        if asked is not None:
            parents = asked.select("sheet", F.col("node").alias("_up"))
            a, b = (x.withColumn("_up", F.floor(F.col("node") / FANOUT)).join(parents, ["sheet", "_up"], "left_semi").drop("_up") for x in (a, b))
        both = a.join(b.withColumnRenamed("digest", "other"), ["sheet", "node"], "full_outer")
        asked = both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("sheet", "node")
    return asked.select("sheet", F.col("node").alias("block"))


def changed_ranges(before: DataFrame, after: DataFrame, blocks: DataFrame) -> DataFrame:
    """sheet, first_row, last_row, cells: runs of rows with cells that differ, within differing blocks; a run goes on over
    the edge of a block. Of both versions only the cells of these blocks are compared."""
    some = [x.withColumn("_block", block_of()).join(blocks.withColumnRenamed("block", "_block"), ["sheet", "_block"], "left_semi").select("sheet", "row", "col", F.struct("kind", "value").alias(n)) for x, n in ((before, "old"), (after, "new"))]
    rows = some[0].join(some[1], ["sheet", "row", "col"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).groupBy("sheet", "row").agg(F.count("*").alias("n"))
    # runs inside each block first, then over the edges: no task holds all changed rows of a sheet
    own = Window.partitionBy("sheet", "_block").orderBy("row")
    runs = rows.withColumn("_block", block_of()).withColumn("_run", F.col("row") - F.row_number().over(own))
    runs = runs.groupBy("sheet", "_block", "_run").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.sum("n").alias("cells"))
    by_sheet = Window.partitionBy("sheet").orderBy("first_row")
    starts = F.when(F.lag("last_row").over(by_sheet) + 1 == F.col("first_row"), 0).otherwise(1)
    merged = runs.withColumn("_new", starts).withColumn("_g", F.sum("_new").over(by_sheet.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("sheet", "_g").agg(F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.sum("cells").alias("cells")).drop("_g")
