"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A key descends from the root: at each node every child draws an exponential variate from the key and its own name,
divided by its weight (the sum of its shards' weights), and the least draw wins, so a child is chosen in proportion to
its weight. A key meets only the children of the nodes it reaches. A draw depends on nothing but the key, the child and
its weight, so a change of weights below one child moves keys into it, out of it or within it, never between its
untouched siblings or inside them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 3, regions: int = 2) -> list[Leaf]:
    """Shards of equal weight, four to a rack and three racks to a region; beyond the given regions (24 shards), each
    shard has a region of its own, so that a tree of one more shard is the tree grown by one."""
    each = per_rack * racks_per_region
    base = [Leaf(s // each, s // per_rack, s) for s in range(min(shards, regions * each))]
    for _ in range(shards - len(base)):
        base = grown(base)
    return base


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard. It gets a region of its own, so that keys only move into it."""
    return [*tree, Leaf(max((x.region for x in tree), default=-1) + 1, max((x.rack for x in tree), default=-1) + 1, max((x.shard for x in tree), default=-1) + 1, weight)]


def draw(level: str, child: Column, weight: Column, key: str, seed: int) -> Column:
    """An exponential variate of a child: the least wins in proportion to its weight."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), child, F.col(key)), 11).cast("double")
    return -F.log((h + 0.5) / F.lit(float(1 << 53))) / weight


def least_draw(children: Column, level: str, key: str, seed: int) -> Column:
    """struct(draw, child, node) of the child that wins."""
    return F.array_min(F.transform(children, lambda c: F.struct(draw(level, c["child"], c["weight"], key, seed).alias("draw"), c["child"].alias("child"), c["node"].alias("node"))))


def descend(df: DataFrame, key: str, tree: list[Leaf], names: tuple[str, str, str] = ("region", "rack", "shard"), seed: int = 17, root: str | None = None) -> DataFrame:
    """df with the region, rack and shard of a key column, and, if `root` is given, the draw that won at the root under
    that name. Leaves of weight 0 or less take nothing; a null key is hashed as null. The tree is a table per level: the
    children of each node, with the node of the level below that a child leads to."""
    leaves = [x for x in tree if x.weight > 0]
    if not leaves:
        raise ValueError("the tree has no leaf of positive weight")
    # a rack is named by its region too
    paths = {x: [(), (x.region,), (x.region, x.rack), (x.region, x.rack, x.shard)] for x in leaves}
    node, chosen = F.lit(0), []
    for depth, level in enumerate(("region", "rack", "shard")):
        at, below = ({p: i for i, p in enumerate(sorted({paths[x][d] for x in leaves}))} for d in (depth, depth + 1))
        weights: list[dict] = [{} for _ in at]
        for x in leaves:
            own = weights[at[paths[x][depth]]]
            own[paths[x][depth + 1]] = own.get(paths[x][depth + 1], 0.0) + x.weight
        child = lambda p, w, below=below: F.struct(F.lit(p[-1]).alias("child"), F.lit(float(w)).alias("weight"), F.lit(below[p]).alias("node"))
        children = F.element_at(F.array(*[F.array(*[child(p, w) for p, w in sorted(own.items())]) for own in weights]), node + 1)
        df = df.withColumn(f"_{level}", least_draw(children, level, key, seed))
        node = F.col(f"_{level}.node")
        chosen.append(F.col(f"_{level}.child"))
    df = df.withColumns(dict(zip(names, chosen, strict=True)) | ({root: F.col("_region.draw")} if root else {}))
    return df.drop("_region", "_rack", "_shard")


def slots(df: DataFrame, shard: str, order: list[str], fine: int = 1024) -> DataFrame:
    """Adds slot: gapless from 0 in each shard. A shard is cut into fine pieces by a hash of the order
    columns; pieces are counted, their counts summed up in order (shards x fine rows at most), and rows numbered inside a piece, so no task
    holds a whole shard."""
    piece = F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(fine)).cast("int")
    df = df.withColumn("_piece", piece)
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(shard, "_piece").agg(F.count("*").alias("_n")).select(shard, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(shard, "_piece").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(own))
        .join(F.broadcast(starts), [shard, "_piece"])  # shards x fine rows at most
        .withColumn("slot", (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_piece", "_row", "_start")
    )


def assign(docs: DataFrame, shards: int = 24, tree: list[Leaf] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard.

    The law is `key`: doc_id and the number of shards decide, and one more shard takes rows only into itself. Null or
    empty text: size 8 and the crc32 of no bytes; repeated rows get slots of their own; a null doc_id is a key like
    any other; a very long text only counts by its bytes; an empty table gives no rows; columns of the input besides doc_id and text are not read.
    """
    tree = tree or even_tree(shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = descend(sized, "doc_id", tree, root="_won")
    # the shard that a grown tree has more is a region of its own, so it takes the keys that it wins at the root
    added = grown(tree)[-1]
    taken = draw("region", F.lit(added.region), F.lit(added.weight), "doc_id", 17) < F.col("_won")
    placed = placed.withColumn("grown_shard", F.when(taken, F.lit(added.shard)).otherwise(F.col("shard"))).drop("_won")
    return slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack"
    )
