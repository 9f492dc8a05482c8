"""A Merkle manifest of a table as an append log in postorder.

Rows are leaves; the leaves of a group (a language) stand in order of their key, and pairs of nodes become their hash,
level by level, until one is left; the last node of a level may stand alone and is hashed alone. The groups' roots, in
order, make the same kind of tree, whose root stands for the table.

A group's leaves are cut into aligned blocks of 2 ** levels leaves. A builder appends the nodes of its block in the order
in which they are completed: a leaf, then each ancestor whose last leaf it is. So the place of a node needs no pointers:
leaf r stands behind the r leaves before it and the r - popcount(r) nodes that these completed, and its ancestors follow
one by one. A node of level l whose last leaf is r is at 2 r - popcount(r) + l. Roots of blocks are the leaves of the next
tier of blocks, so no task ever holds more than one block, however large a group is.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Levels of a block: 4,096 leaves, 8,191 nodes.
BLOCK = 12
LOG = "tree string, chunk long, size long, height int, nodes binary"
PROOF = "array<struct<sibling: string, left: boolean>>"
HEX = 64


def field(c: Column) -> Column:
    """A value as its number of bytes, a colon and the value; null as a hyphen."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def digest(*nodes: bytes) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def height_of(leaves: int) -> int:
    return (leaves - 1).bit_length()


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """Nodes of a block in the order in which they are completed. The last leaf completes all that is open, up to the
    height (that of whole blocks, where a group has several)."""
    log: list[bytes] = []
    waiting: dict[int, bytes] = {}  # first halves of pairs, by level
    for r, node in enumerate(leaves):
        log.append(node)
        place, last = r, r == len(leaves) - 1
        for level in range(height):
            if place & 1:
                node = digest(waiting.pop(level), node)
            elif last:
                node = digest(node)
            else:
                waiting[level] = node
                break
            log.append(node)
            place >>= 1
    return log


def place_of(level: int, i: np.ndarray, leaves: int) -> np.ndarray:
    """Where the log has node i of a level."""
    last = np.minimum((i + 1) << level, leaves) - 1
    return 2 * last - np.bitwise_count(last).astype(np.int64) + level


def siblings(leaves: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each leaf and level: the sibling's place in the log, whether there is one, and whether it stands on the left."""
    r = np.arange(leaves)
    at, some, left = (np.zeros((leaves, height), t) for t in (np.int64, bool, bool))
    for level in range(height):
        other = (r >> level) ^ 1
        some[:, level] = other <= (leaves - 1) >> level
        at[:, level] = np.where(some[:, level], place_of(level, np.where(some[:, level], other, 0), leaves), 0)
        left[:, level] = (r >> level) & 1
    return at, some, left


def proof_array(digests: np.ndarray, some: np.ndarray, left: np.ndarray) -> pa.Array:
    """An array of PROOF from rows by levels; digests has HEX bytes a node."""
    ends = np.concatenate([[0], np.cumsum(np.where(some.ravel(), HEX, 0))]).astype(np.int32)
    data = digests.ravel()[some.ravel()].tobytes()
    bitmap = pa.py_buffer(np.packbits(some.ravel(), bitorder="little").tobytes())
    text = pa.Array.from_buffers(pa.string(), some.size, [bitmap, pa.py_buffer(ends), pa.py_buffer(data)])
    steps = pa.StructArray.from_arrays([text, pa.array(left.ravel())], ["sibling", "left"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * some.shape[1], pa.int32()), steps)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank, from 0, in each tree. Rows are dealt by ranges of tree and order (equal rows too, as they may be
    many); what stands before a task's rows is summed over tasks."""
    rows = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange("tree", *order, "_salt").sortWithinPartitions("tree", *order).drop("_salt")
    dealt = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted-leaves").withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = parts.select(F.col("tree").alias("_tree"), F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    found = dealt.join(starts, (dealt["tree"] == F.col("_tree")) & (dealt["_part"] == F.col("_of")))
    return found.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_tree", "_of", "_shift")


def built(leaves: DataFrame, levels: int = BLOCK) -> list[DataFrame]:
    """The logs of the tiers over leaves (tree, rank, digest): tree, chunk, size, height, nodes. A tree ends in the tier
    where it has one block."""
    tiers = []
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("total"))
    while True:
        sized = leaves.join(sizes.select(F.col("tree").alias("_tree"), (F.col("total") > 1 << levels).alias("_many")), leaves["tree"] == F.col("_tree"))
        blocks = sized.select("tree", F.shiftright("rank", levels).alias("chunk"), "rank", "digest", "_many")

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("rank")
            nodes = [x.encode() for x in rows.column("digest").to_pylist()]
            height = levels if rows.column("_many")[0].as_py() else height_of(len(nodes))
            out = {"tree": [key[0].as_py()], "chunk": [key[1].as_py()], "size": [len(nodes)], "height": [height], "nodes": [b"".join(append_log(nodes, height))]}
            return pa.table(out, pa.schema([("tree", pa.string()), ("chunk", pa.int64()), ("size", pa.int64()), ("height", pa.int32()), ("nodes", pa.binary())]))

        # dealt by block: by tree alone, as joined above, a large group would be one task
        blocks = blocks.repartition("tree", "chunk")
        log = staged(blocks.groupBy("tree", "chunk").applyInArrow(build, LOG), "merkle-log")
        tiers.append(log)
        sizes = log.groupBy("tree").agg(F.count("*").alias("total")).where("total > 1")
        if sizes.isEmpty():
            return tiers
        leaves = log.join(sizes.select("tree"), "tree", "left_semi").select("tree", F.col("chunk").alias("rank"), root_of("nodes").alias("digest"))


def root_of(nodes: str) -> Column:
    """The last node of a block is its root."""
    return F.right(F.col(nodes).cast("string"), F.lit(HEX))


def roots(tiers: list[DataFrame]) -> DataFrame:
    """tree, root."""
    out = None
    for i, log in enumerate(tiers):
        own = log.select("tree", "chunk", root_of("nodes").alias("root"))
        if i + 1 < len(tiers):
            own = own.join(tiers[i + 1].select("tree"), "tree", "left_anti")
        out = own if out is None else out.union(own)
    return out.select("tree", "root")


def cutter(kept: list[str], extra: list[str], levels: int):
    """The proofs of a block's leaves: wanted has the leaves, block the log, the proof of the block's root, and extra."""

    def cut(key: tuple, wanted: pa.Table, block: pa.Table) -> pa.Table:
        size, height = block.column("size")[0].as_py(), block.column("height")[0].as_py()
        nodes = np.frombuffer(block.column("nodes")[0].as_py(), f"V{HEX}")
        at, some, left = siblings(size, height)
        mine = wanted.column("rank").to_numpy() & (1 << levels) - 1
        higher = block.column("proof")[0].as_py()
        rest = np.frombuffer(b"".join((x["sibling"] or "").encode().ljust(HEX) for x in higher), f"V{HEX}")
        wide = lambda own, more: np.concatenate([own[mine], np.tile(more, (len(mine), 1))], 1)
        proof = proof_array(
            wide(nodes[at], rest),
            wide(some, np.array([x["sibling"] is not None for x in higher], bool)),
            wide(left, np.array([x["left"] for x in higher], bool)),
        )
        out = {"tree": wanted.column("tree"), "rank": wanted.column("rank"), "proof": proof}
        out |= {c: wanted.column(c) for c in kept}
        return pa.table(out | {c: pa.array([block.column(c)[0].as_py()] * len(mine), block.schema.field(c).type) for c in extra})

    return cut


def proven(rows: DataFrame, tiers: list[DataFrame], above: DataFrame, levels: int = BLOCK) -> DataFrame:
    """rows (tree, rank, and what is carried along) with the columns of above (tree, proof and what else it has) and proof
    now from the row's leaf on: tiers are descended, and each block's proofs are cut out of its log."""
    extra = [f for f in above.schema.fields if f.name not in ("tree", "proof")]
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in extra)
    upper = None
    for i in range(len(tiers) - 1, -1, -1):
        log = tiers[i]
        top = log if i == len(tiers) - 1 else log.join(tiers[i + 1].select("tree").distinct(), "tree", "left_anti")
        own = top.join(above, "tree")
        if upper is not None:
            below = upper.select(F.col("tree").alias("_tree"), F.col("rank").alias("_rank"), "proof", *[f.name for f in extra])
            own = own.unionByName(log.join(below, (log["tree"] == F.col("_tree")) & (log["chunk"] == F.col("_rank"))).drop("_tree", "_rank"))
        asked = rows if i == 0 else tiers[i - 1].join(log.select("tree").distinct(), "tree", "left_semi").select("tree", F.col("chunk").alias("rank"))
        kept = [f for f in asked.schema.fields if f.name not in ("tree", "rank")]
        schema = ", ".join(["tree string, rank long", f"proof {PROOF}", *[f"{f.name} {f.dataType.simpleString()}" for f in kept], carried]).rstrip(", ")
        dealt = asked.withColumn("chunk", F.shiftright("rank", levels)).repartition("tree", "chunk").groupBy("tree", "chunk")
        upper = dealt.cogroup(own.repartition("tree", "chunk").groupBy("tree", "chunk")).applyInArrow(cutter([f.name for f in kept], [f.name for f in extra], levels), schema)
    return upper


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""

    def step(node: Column, s: Column) -> Column:
        other = F.coalesce(s["sibling"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(other, node)).otherwise(F.concat(node, other)).cast("binary"), 256)

    return F.aggregate(proof, start, step)


def manifest(rows: DataFrame, carry: list[str], levels: int = BLOCK) -> DataFrame:
    """rows (tree, leaf, and the columns of carry, of which the first orders the leaves of a tree; equal ones are ordered
    by their leaf) with subroot, root, and proof: from the leaf up, each level's sibling (null where there is none) and
    whether it stands on the left."""
    order = [carry[0], "leaf"]
    placed = staged(ranked(rows.select("tree", "leaf", *carry), order), "ranked-leaves")
    tiers = built(placed.select("tree", "rank", F.col("leaf").alias("digest")), levels)
    subroots = staged(roots(tiers), "subroots")
    trees = staged(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("subroot")), ["name"]), "ranked-trees")
    top = built(trees.select("tree", "rank", F.col("subroot").alias("digest")), levels)
    whole = roots(top).select("tree", "root", F.array().cast(PROOF).alias("proof"))
    above = staged(proven(trees, top, whole, levels).select(F.col("name").alias("tree"), "subroot", "root", "proof"), "tree-proofs")
    return proven(placed, tiers, above, levels)


def verify(docs: DataFrame, levels: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings), folded_root (from the leaf, which is tampered with
    where 7 divides the crc32 of the doc_id: n_chars is one more), verified.

    A leaf is the hash of doc_id, source, lang, n_chars and text; trees are by lang (null first). Nulls in any column
    are hashed as such (a null doc_id comes first in its tree, and isn't tampered with); empty and very long texts are
    hashed whole. Rows with equal doc_ids are ordered by their leaves; equal rows stand side by side, each with its own
    proof. A lone leaf is its tree's root, and has an empty proof if its tree is the only one. An empty table gives no
    rows. Other columns aren't read.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*values[:3], F.try_add(F.col("n_chars").cast("long"), F.lit(1)), values[4]]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))  # "-" stands before "="
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*values).alias("leaf"), F.when(tampered, leaf(*changed)).alias("altered"))
    found = manifest(staged(rows, "leaves"), ["doc_id", "altered"], levels)
    proof = F.array_join(F.transform("proof", lambda s: s["sibling"]), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
