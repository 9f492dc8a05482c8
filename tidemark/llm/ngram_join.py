"""Exact n-gram Jaccard self-join of documents, returned as connected components.

The product of the document by shingle matrix with its transpose gives the overlap of every pair. It is computed in
blocks (one shingle's column after another, dealt by Spark), and only where the sizes leave a pair a chance:

- Texts with one shingle set form a class; one representative goes on.
- Shingles have one global order: common ones last, then the longer first. If the threshold is t, two sets of n
  shingles that reach it must share one of their first n - ceil(t n) + 1, so only those columns are multiplied.
- Overlaps are accumulated over these columns. Pairs whose sizes differ by more than the factor t, or whose count is
  below what the two sizes ask for, are dropped; the rest is verified on whole sets.

Long columns (large groups of near copies) would give pairs in the square of their length. There each row is first
compared with one pivot, the most central row. The links found so far, of all columns, make components, and rows of
one component need no further links among each other. A pair of two components is compared if sizes, distances to the pivot (Jaccard distance is
a metric; where a distance isn't measured, the bitmaps give a bound) and the parity bitmaps of the two sets (each differing bit needs a differing shingle) leave it a chance. So
no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, in_worker, staged

WIDTH = 4
#: A shingle is common if it makes up this share of all shingles, so at most 1 / COMMON of them can be.
COMMON = 1e-6
#: A shingle's count in a task is reported when it occurs this often among LOOK shingles.
LOOK, LOCAL = 1 << 20, 3
#: Columns of up to so many rows are multiplied outright.
LONG = 48
#: Bits of the parity bitmaps: the power of two next above the set's size, within these bounds.
LEAST_BITS, MOST_BITS = 256, 8192


class WordHashes(dict):
    """58 bits of a word's hash, and its length, up to 63 bytes, in the six lowest."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) & ~63 | min(len(word), 63)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle ids of each text. An id has the shingle's length, longest first, in its top byte and 56
    bits of hash below. Words are parted by ASCII white space; A-Z are lower-cased; a text of fewer than WIDTH words
    has one shingle of all its words, one without words none."""
    get = in_worker("word-hashes", WordHashes).__getitem__
    ids, counts = [], []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").lower().split()
        ids += map(get, words)
        counts.append(len(words))
    words = np.array(ids, np.uint64)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WIDTH + 1)
        rolled, length = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(WIDTH):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
            length += words[k : k + n] & np.uint64(63)
        every = (np.uint64(255) - np.minimum(length, np.uint64(255))) << np.uint64(56) | mixed(rolled) >> np.uint64(8)
        out, start = [], 0
        for c in counts:
            if c >= WIDTH:
                out.append(np.unique(every[start : start + c - WIDTH + 1]))
            elif c:
                whole, size = np.uint64(c + 1), 0
                for w in words[start : start + c]:
                    whole = np.uint64(whole * np.uint64(0xC2B2AE3D27D4EB4F) + w)
                    size += int(w & np.uint64(63))
                out.append(np.array([np.uint64(255 - min(size, 255)) << np.uint64(56) | mixed(np.array([whole]))[0] >> np.uint64(8)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            start += c
    return out


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted ids of common shingles: counts of each task's frequent ones, summed. Any set of ids gives right results;
    this one keeps boilerplate and copies out of the first columns."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def told() -> pd.DataFrame:
            ids, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL
            total = pd.DataFrame({"id": [-1], "n": [n]})
            return pd.concat([pd.DataFrame({"id": ids[often].view(np.int64), "n": counts[often]}), total])

        for f in frames:
            for i in range(0, len(f), 256):
                sets = shingles(f["text"].iloc[i : i + 256].tolist())
                held += sets
                n += sum(map(len, sets))
                if n >= LOOK:
                    yield told()
                    held, n = [], 0
        if held:
            yield told()

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = staged(counted, "shingle-counts")
    total = counted.where("id = -1").agg(F.sum("n")).first()[0] or 0
    ids = counted.where((F.col("id") != -1) & (F.col("n") >= max(20.0, COMMON * total))).select("id").toPandas()["id"]  # at most 1 / COMMON rows
    return np.sort(ids.to_numpy(np.int64).view(np.uint64))


def prefix_size(n: int, pct: int) -> int:
    return n - -(-pct * n // 100) + 1


def signatures(docs: DataFrame, common: np.ndarray, pct: int) -> DataFrame:
    """doc_id, n, cls (a hash of the shingle set), spread (share of shingles that aren't common, in 1/1000), prefix and
    bits (parity bitmap)."""
    frequent = docs.sparkSession.sparkContext.broadcast(common)  # at most 1 / COMMON ids

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = frequent.value
        for f in frames:
            for i in range(0, len(f), 256):
                rows = []
                for doc, s in zip(f["doc_id"].iloc[i : i + 256], shingles(f["text"].iloc[i : i + 256].tolist()), strict=True):
                    if not len(s):
                        rows.append((doc, 0, None, 0, None, None))
                        continue
                    at = np.searchsorted(ids, s)
                    often = ids[np.minimum(at, len(ids) - 1)] == s if len(ids) else np.zeros(len(s), bool)
                    rare = s[~often]
                    p = prefix_size(len(s), pct)
                    first = rare[:p] if len(rare) >= p else np.concatenate([rare, s[often][: p - len(rare)]])
                    size = min(MOST_BITS, max(LEAST_BITS, 1 << len(s).bit_length()))
                    bits = np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).view(np.int64)
                    rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), len(rare) * 1000 // len(s), first.view(np.int64), bits))
                yield pd.DataFrame(rows, columns=["doc_id", "n", "cls", "spread", "prefix", "bits"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(sign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, cls binary, spread int, prefix array<long>, bits array<long>")


def fits(a: str, b: str, pct: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * pct


def may_differ(n: Column, pct: int) -> Column:
    """The most that the symmetric difference of two linked sets with n shingles together can be."""
    return F.floor(n * (100 - pct) / (100 + pct))


def folded(bits: Column, other: Column) -> Column:
    """A bitmap cut to half its length where the other one is shorter: bit i and bit i + half fall on one another."""
    half = F.floor(F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(bits)


def differing(bits1: str, bits2: str) -> Column:
    """Bits in which two bitmaps differ: the least that the symmetric difference of the sets can be. Of sets whose
    bitmaps differ in length by more than a factor of two nothing is said."""
    x, y = F.col(bits1), F.col(bits2)
    apart = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    for words in (8, 4):  # the usual lengths, without making arrays
        each = [F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(words)]
        apart = F.when((F.size(x) == words) & (F.size(y) == words), sum(each[1:], each[0])).otherwise(apart)
    return F.when((F.size(x) <= 2 * F.size(y)) & (F.size(y) <= 2 * F.size(x)), apart).otherwise(0)


def may_link(n1: str, n2: str, bits1: str, bits2: str, pct: int) -> Column:
    """Whether sizes and bitmaps leave two sets a chance to link. Linked sets differ in size by less than a factor of two,
    so one bitmap is at most twice as long as the other."""
    return fits(n1, n2, pct) & (differing(bits1, bits2) <= may_differ(F.col(n1) + F.col(n2), pct))


def least_distance(n1: str, n2: str, bits1: str, bits2: str) -> Column:
    """The least Jaccard distance that sizes and bitmaps allow."""
    least = F.greatest(differing(bits1, bits2), F.abs(F.col(n1) - F.col(n2)))
    return 2 * least / (F.col(n1) + F.col(n2) + least)


def least_shared(na: str, nb: str, pct: int) -> Column:
    """Shingles that the prefixes of two linked sets share at least. Up to the lesser of the two prefixes' last ids,
    both prefixes hold all that their sets hold, so shingles in common are either among these or beyond one of the
    prefixes."""
    a, b = F.col(na), F.col(nb)
    overlap = F.ceil((a + b) * pct / (100 + pct))
    beyond = lambda n: F.ceil(n * pct / 100) - 1
    return F.greatest(F.lit(1), overlap - F.greatest(beyond(a), beyond(b)))


def verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """a, b, near (whether they link), far (Jaccard distance) of distinct pairs, from their whole shingle sets."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    inside = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", inside.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return counted.select("a", "b", (100 * F.col("i") >= pct * (F.col("n") - F.col("i"))).alias("near"), (1 - F.col("i") / (F.col("n") - F.col("i"))).alias("far"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of the nodes of edges(a, b): the least node reachable. Each round takes the least label among
    the neighbours, then the label's own label; rounds go through the shared folder, so nothing is computed again."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        merged = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        merged = staged(merged, "labels")
        up = merged.select(F.col("node").alias("at"), F.col("label").alias("higher"))
        jumped = merged.join(up, merged["label"] == up["at"], "left").select("node", F.least("label", F.coalesce("higher", "label")).alias("label"), "was")
        jumped = staged(jumped, "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> was").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def link_candidates(bodies: DataFrame, sets_of, pct: int) -> DataFrame:
    """Links (a, b) that make the components of representatives: a tie of each row of a first pass's components to its
    least one, and verified links between these components. bodies: rep, n, spread, prefix, bits. Columns are dealt once by
    shingle; those with one row, nearly all, end there."""
    columns = bodies.select("rep", "n", "spread", F.explode("prefix").alias("h"))
    column = Window.partitionBy("h")
    shared = columns.withColumns({"m": F.count("*").over(column), "p": F.min(F.struct("spread", "rep", "n")).over(column)}).where("m > 1")
    shared = staged(shared.select("h", "rep", "n", "m", F.col("p.rep").alias("pivot")), "columns")
    rows = shared.groupBy("rep").agg(F.count_if(F.col("m") > LONG).alias("long"))
    short = shared.where(F.col("m") <= LONG)
    x, y = short.select("h", F.col("rep").alias("a"), F.col("n").alias("na")), short.select("h", F.col("rep").alias("b"), F.col("n").alias("nb"))
    met = x.join(y, "h").where((F.col("a") < F.col("b")) & fits("na", "nb", pct)).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    # what the pair may share in long columns isn't counted, so it is allowed for
    met = met.join(rows.select(F.col("rep").alias("a"), F.col("long").alias("la")), "a").join(rows.select(F.col("rep").alias("b"), F.col("long").alias("lb")), "b")
    outright = met.where(F.col("shared") + F.least("la", "lb") >= least_shared("na", "nb", pct)).select("a", "b")

    long = shared.where(F.col("m") > LONG).select("h", "rep", "n", "pivot")
    long = staged(long.join(bodies.select("rep", "bits").dropDuplicates(["rep"]), "rep"), "long-columns")
    centre = long.where(F.col("rep") == F.col("pivot")).select("h", F.col("n").alias("pn"), F.col("bits").alias("pbits"))
    starred = long.join(centre.dropDuplicates(["h"]), "h").where((F.col("rep") != F.col("pivot")) & may_link("n", "pn", "bits", "pbits", pct))
    starred = starred.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    first = staged(outright.union(starred).distinct(), "pairs")
    sets = sets_of(first.select(F.col("a").alias("rep")).union(first.select("b")).distinct())
    told = staged(verified(first, sets, pct), "overlaps")
    parts = components(told.where("near"))

    # second pass over long columns: pairs of different components, of which one at least isn't the pivot's
    component_of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    centre = long.where(F.col("rep") == F.col("pivot")).select("h", "pivot", F.col("n").alias("pn"), F.col("bits").alias("pbits")).dropDuplicates(["h"])
    centre = centre.join(component_of("pivot"), "pivot", "left").select("h", "pn", "pbits", F.coalesce("pivot_part", "pivot").alias("pivot_part"))
    bound = long.join(centre, "h").withColumn("low", least_distance("n", "pn", "bits", "pbits")).drop("pn", "pbits")
    keyed = bound.withColumns({"a": F.least("rep", "pivot"), "b": F.greatest("rep", "pivot")}).join(told.select("a", "b", "far"), ["a", "b"], "left").join(component_of("rep"), "rep", "left")
    at_pivot = lambda c: F.when(F.col("rep") == F.col("pivot"), 0.0).otherwise(c)
    part = F.coalesce("rep_part", "rep")
    keyed = keyed.select("h", "rep", "n", "bits", part.alias("part"), (part == F.col("pivot_part")).alias("near"), at_pivot(F.coalesce("far", "low")).alias("low"), at_pivot(F.col("far")).alias("far"))
    keyed = staged(keyed, "long-rows")
    out = keyed.where("not near").select("h", *[F.col(c).alias(f"{c}1") for c in ("rep", "n", "bits", "part", "far", "low")])
    any_ = keyed.select("h", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "bits", "part", "near", "far", "low")])
    chance = (
        (F.col("part1") != F.col("part2"))
        & (F.col("near2") | (F.col("rep1") < F.col("rep2")))
        & F.coalesce(F.col("low1") - F.col("far2") <= (100 - pct) / 100 + 1e-9, F.lit(True))
        & F.coalesce(F.col("low2") - F.col("far1") <= (100 - pct) / 100 + 1e-9, F.lit(True))
        & may_link("n1", "n2", "bits1", "bits2", pct)
    )
    second = out.join(any_, "h").where(chance).select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()
    second = staged(second.join(first, ["a", "b"], "left_anti"), "pairs")
    sets = sets_of(second.select(F.col("a").alias("rep")).union(second.select("b")).distinct())
    held = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return held.union(verified(second, sets, pct).where("near").select("a", "b"))


def join(docs: DataFrame, pct: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included), class_id (the least
    doc_id with the same shingle set).

    Two documents link when 100 * intersection >= pct * union of their shingle sets. A text without words (or null)
    has no shingles, links with nothing and is a component of its own. Rows of one doc_id are returned each and judged
    by their own text. Rows with a null doc_id are returned with null component and link nothing. An empty table gives no rows; further columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    common = common_shingles(docs)
    signed = staged(signatures(docs, common, pct), "signatures")
    named = signed.where("n > 0 and doc_id is not null")
    classes = staged(named.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    # copies of a text may have one doc_id (the pipeline's are keys of texts); only one of them goes on
    bodies = named.join(classes, ["cls", "doc_id"]).dropDuplicates(["cls", "doc_id"]).select("rep", "n", "spread", "prefix", "bits")

    def sets_of(wanted: DataFrame) -> DataFrame:
        def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for i in range(0, len(f), 256):
                    part = f.iloc[i : i + 256]
                    sets = shingles(part["text"].tolist())
                    same = [xxhash.xxh3_128_digest(s.tobytes()) == c for s, c in zip(sets, part["cls"], strict=True)]
                    yield pd.DataFrame({"rep": part["rep"], "s": [s.view(np.int64) for s in sets]})[same]

        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        rows = texts.join(classes.select("doc_id", "cls", "rep").join(wanted, "rep"), "doc_id").select("rep", "cls", "text")
        return staged(rows.mapInPandas(collect, "rep long, s array<long>").dropDuplicates(["rep"]), "sets")

    links = staged(link_candidates(bodies, sets_of, pct), "links")
    found = components(links)
    least = found.join(classes.select("rep", "doc_id"), found["node"] == F.col("rep")).groupBy("component").agg(F.min("doc_id").alias("least"))
    merged = found.join(least, "component").select("node", "least")
    of_class = classes.join(merged, classes["rep"] == merged["node"], "left").select("cls", F.col("doc_id").alias("class_id"), F.coalesce("least", "doc_id").alias("component_id"))
    return signed.join(of_class, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
    )
