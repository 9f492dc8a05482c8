import math
import struct

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import sharding


def hashed(level: str, child: int, key: int | None, seed: int = 17) -> int:
    """Spark's xxhash64 of (seed, level, child, key): a column's hash seeds the next one's; null leaves it as it is."""
    h = 42
    for raw in (struct.pack("<i", seed), level.encode(), struct.pack("<i", child), None if key is None else struct.pack("<q", key)):
        h = h if raw is None else xxhash.xxh64_intdigest(raw, seed=h)
    return h


def plain_shard(key: int | None, tree: list[sharding.Leaf]) -> tuple[int, int, int]:
    inside, path = [x for x in tree if x.weight > 0], []
    for level in ("region", "rack", "shard"):
        weights: dict[int, float] = {}
        for x in inside:
            weights[getattr(x, level)] = weights.get(getattr(x, level), 0.0) + x.weight
        path.append(min((-math.log(((hashed(level, c, key) >> 11) + 0.5) / (1 << 53)) / w, c) for c, w in weights.items())[1])
        inside = [x for x in inside if getattr(x, level) == path[-1]]
    return tuple(path)


def test_draws_recomputed_in_plain_python(spark):
    tree = [*sharding.even_tree(26), sharding.Leaf(0, 1, 90, 2.5), sharding.Leaf(7, 1, 91, 0.5), sharding.Leaf(1, 3, 92, 0.0)]
    keys = [*range(1500), -5, 1 << 60, None]
    got = sharding.descend(spark.createDataFrame([(k,) for k in keys], "key long"), "key", tree).collect()
    assert {r.key: (r.region, r.rack, r.shard) for r in got} == {k: plain_shard(k, tree) for k in keys}


def test_a_grown_shard_is_the_next_count_s_shard(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    now = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(docs, 24).collect()}
    for shards in (25, 26, 27):
        then = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(docs, shards).collect()}
        for k, (shard, grown) in now.items():
            assert then[k][0] == grown and grown in (shard, shards - 1)
        now = then
