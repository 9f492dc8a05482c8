"""Benchmark decontamination by latent semantic retrieval.

1. Documents become sequences of term numbers over the benchmark's vocabulary, cut into chunks of CHUNK words; TF-IDF
   statistics are counted over all chunks.
2. A distributed randomised SVD: two passes of Z = A'(A X) over all chunks (A: chunks by terms, X: terms by RANK),
   each summed in Spark; the benchmark's own passages are rows of A too, with as much weight as the corpus, so that
   the latent space doesn't lose their terms. The Rayleigh-Ritz step on the second pass gives the singular vectors.
3. Every window of two chunks that holds two weighted terms is compared with every benchmark passage by cosine in the
   latent space. Besides, as an exact way for items that are told again without their rarest words: a text that has VERBATIM of an item's words can't do without all of its rarest ones, as
   many as may be missing and TOGETHER more, so places of that many of these are candidates too.
4. Candidates are checked on their words: the longest common subsequence with the item, and for paraphrases also with
   the item's answer (its last sentence).

Benchmarks are taken in blocks of about BLOCK_WORDS words, so what is sent to the executors is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, release, staged, text_key
from tidemark.llm.token_index import gathered

CHUNK, RANK, BLOCK_WORDS = 16, 96, 300_000
#: Terms in more than this share of chunks carry no weight, except the KEPT rarest of each passage.
COMMON_SHARE, KEPT = 0.004, 6
#: Least cosine of a candidate; least share of the item in common for a leak, and with the answer check for a paraphrase.
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.4, 0.8, 0.6, 0.7
#: Needed words of an item that must stand together.
TOGETHER = 3
TERM = re.compile(r"\w+")


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]


@dataclass
class Block:
    vocabulary: dict[str, int]
    items: list[Item]

    @property
    def type(self) -> str:
        return "<u2" if len(self.vocabulary) < (1 << 16) - 1 else "<u4"


def read_block(rows: list) -> Block:
    vocabulary: dict[str, int] = {}
    items = []
    for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0)):
        number = lambda text: [vocabulary.setdefault(w, len(vocabulary) + 1) for w in TERM.findall(text.lower())]
        said = r["text"] or ""
        words = number(said)
        sentences = [s for s in re.split(r"[.?!\n]+", said) if TERM.search(s)]
        if words and r["item_id"] is not None:
            items.append(Item(r["item_id"], words, number(sentences[-1]) if sentences else []))
    return Block(vocabulary, items)


def numbered(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id and ids: the term number of every word, 0 for words that the benchmark doesn't hold."""
    get, kind = block.vocabulary.get, block.type

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for f in frames:
            for i in range(0, len(f), 1000):
                ids = [np.fromiter(map(get, TERM.findall(t.lower()), repeat(0)), kind) for t in f["text"].iloc[i : i + 1000]]
                keep = [bool(x.any()) for x in ids]
                yield pd.DataFrame({"doc_id": f["doc_id"].iloc[i : i + 1000], "ids": [x.tobytes() for x in ids]})[keep]

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return staged(rows.mapInPandas(number, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary"), "terms")


def chunked(ids: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All term numbers in whole chunks (padded with 0), and the first chunk of each document."""
    parts, first, at = [], [], 0
    for raw in ids:
        x = np.frombuffer(raw, kind)
        first.append(at)
        n = -(-len(x) // CHUNK)
        parts.append(x)
        if n * CHUNK > len(x):
            parts.append(np.zeros(n * CHUNK - len(x), kind))
        at += n
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([*first, at])


def batches(frames: Iterator[pd.DataFrame], kind: str, rows: int = 400):
    for f in frames:
        for i in range(0, len(f), rows):
            part = f.iloc[i : i + rows]
            yield part, *chunked(part["ids"].tolist(), kind)


def frequencies(terms: DataFrame, block: Block) -> tuple[np.ndarray, int]:
    """Number of chunks that hold each term, and the number of chunks."""
    size, kind = len(block.vocabulary) + 1, block.type

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for _, x, first in batches(frames, kind):
            total[0] += first[-1]
            at = np.flatnonzero(x)
            pairs = np.unique((at // CHUNK).astype(np.int64) * size + x[at])
            total += np.bincount(pairs % size, minlength=size)
        yield pd.DataFrame({"id": np.flatnonzero(total), "n": total[total > 0]})

    found = terms.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # bounded by the vocabulary
    out = np.zeros(size)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out, int(out[0])


def passages(item: Item) -> list[list[int]]:
    n = len(item.words)
    starts = list(range(0, max(1, n - 2 * CHUNK + 1), CHUNK))
    if starts[-1] + 2 * CHUNK < n:
        starts.append(n - 2 * CHUNK)
    return [item.words[s : s + 2 * CHUNK] for s in starts]


def weigh(block: Block, df: np.ndarray, chunks: int) -> np.ndarray:
    idf = np.log((chunks + 1) / (df + 0.5))
    weights = np.where(df <= COMMON_SHARE * chunks, idf, 0.0)
    for item in block.items:
        for p in passages(item):
            rare = sorted(set(p), key=lambda t: (df[t], t))[:KEPT]
            weights[rare] = np.maximum(idf[rare], 0.1)
    weights[0] = 0
    return weights.astype(np.float32)


def benchmark_rows(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of all passages in a row, where each passage starts, and the item of each passage."""
    flat, starts, owner = [], [], []
    for i, item in enumerate(block.items):
        for p in passages(item):
            starts.append(len(flat))
            owner.append(i)
            flat += p
    return np.array(flat, np.int64), np.array(starts, np.int64), np.array(owner, np.int64)


def latent(terms: DataFrame, block: Block, df: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Right singular vectors (terms by RANK) of the TF-IDF matrix of all chunks and the benchmark's passages."""
    sc, kind, size = terms.sparkSession.sparkContext, block.type, len(weights)
    rank = min(RANK, size)
    flat, starts, _ = benchmark_rows(block)
    share = float((df * weights**2).sum() / max((weights[flat] ** 2).sum(), 1e-9))

    def multiplied(x: np.ndarray) -> np.ndarray:
        """A'(A x), summed over all chunks, plus the benchmark's part."""
        sent = sc.broadcast((x * weights[:, None]).astype(np.float32))  # bounded by the vocabulary

        def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wx = sent.value
            total = np.zeros((size, rank), np.float64)
            for _, ids, _ in batches(frames, kind):
                at = np.flatnonzero(weights[ids])
                if not len(at):
                    continue
                t = ids[at]
                edge = np.concatenate([[True], np.diff(at // CHUNK) > 0])
                rows = np.add.reduceat(wx[t], np.flatnonzero(edge), axis=0)
                order = np.argsort(t, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(t[order].astype(np.int64)) > 0]))
                total[t[order][first]] += np.add.reduceat(rows[(np.cumsum(edge) - 1)[order]], first, axis=0)
            some = np.flatnonzero(total.any(1))
            yield pd.DataFrame({"id": some, **{f"z{k}": total[some, k] for k in range(rank)}})

        columns = [f"z{k}" for k in range(rank)]
        summed = terms.select("ids").mapInPandas(multiply, "id long, " + ", ".join(f"{c} double" for c in columns)).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # bounded by the vocabulary
        z = np.zeros((size, rank))
        z[summed["id"].to_numpy(np.int64)] = summed[columns].to_numpy()
        wx = x * weights[:, None]
        rows = np.add.reduceat(wx[flat], starts, axis=0)
        np.add.at(z, flat, share * np.repeat(rows, np.diff([*starts, len(flat)]), axis=0))
        return z * weights[:, None]

    q, _ = np.linalg.qr(multiplied(np.random.default_rng(7).standard_normal((size, rank))))
    gram = q.T @ multiplied(q)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return (q @ vectors[:, values > 1e-9 * max(values.max(), 1e-30)]).astype(np.float32)


def common_subsequence(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, a bit per item word."""
    at: dict[int, int] = {}
    for i, t in enumerate(item):
        at[t] = at.get(t, 0) | 1 << i
    row, full = (1 << len(item)) - 1, (1 << len(item)) - 1
    for t in region:
        if m := at.get(t):
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


def enough(ids: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray, members: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a region holds at least `least` different words of an item. members: a bit per item and term."""
    out = np.zeros(len(start), bool)
    order = np.argsort(end - start, kind="stable")
    at = 0
    while at < len(order):
        longest = int(end[order[at]] - start[order[at]])
        some = order[at : at + max(1, 1_000_000 // max(1, 2 * longest))]
        some = some[end[some] - start[some] <= 2 * longest]
        place = start[some][:, None] + np.arange(int((end[some] - start[some]).max()))
        inside = place < end[some][:, None]
        term = ids[np.minimum(place, len(ids) - 1)]
        bit = members[item[some][:, None], term >> 3] >> (term & 7).astype(np.uint8) & 1
        own = np.where(bit.astype(bool) & inside, term, 0)
        own.sort(axis=1)
        different = (own[:, :1] > 0).sum(1) + ((own[:, 1:] != own[:, :-1]) & (own[:, 1:] > 0)).sum(1)
        out[some] = different >= least[some]
        at += len(some)
    return out


def needed_terms(block: Block, df: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The items that each term is needed by (compressed rows), and, for each item, how many of its different words, and of
    these needed ones, a text with VERBATIM of its words has at least. Of the item's words so many may be missing; of its
    rarest ones, that many and TOGETHER more, TOGETHER are there."""
    pairs, least = [], []
    for i, item in enumerate(block.items):
        missing = len(item.words) - int(np.ceil(VERBATIM * len(item.words) - 1e-9))
        rare = sorted(set(item.words), key=lambda t: (df[t], t))
        some = rare[: missing + TOGETHER]
        least.append((len(rare) - missing, len(some) - missing))
        pairs += [(t, i) for t in some]
    pairs.sort()
    counts = np.bincount([t for t, _ in pairs], minlength=len(df) + 1)
    return (np.concatenate([[0], np.cumsum(counts)]), np.array([i for _, i in pairs], np.int64)), np.array(least, np.int64).reshape(-1, 2)


def search(terms: DataFrame, block: Block, df: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """Checked leaks: doc_id, item_id, cosine, shared, answered, kind, first_word, words."""
    sc, kind = terms.sparkSession.sparkContext, block.type
    flat, starts, owner = benchmark_rows(block)
    spaces = weights[:, None] * vectors
    items = np.add.reduceat(spaces[flat], starts, axis=0)
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    held = np.zeros((len(block.items), len(weights) // 8 + 1), np.uint8)
    for i, x in enumerate(block.items):
        for t in set(x.words):
            held[i, t >> 3] |= 1 << (t & 7)
    spreads = np.array([-(-len(x.words) // CHUNK) + 1 for x in block.items])
    fewest = np.array([PARAPHRASE * len(set(x.words)) for x in block.items])
    postings, strict = needed_terms(block, df)
    sent = sc.broadcast((postings, strict, spaces.astype(np.float32), items.T.astype(np.float32).copy(), weights > 0, owner, [(x.item_id, x.words, x.answer) for x in block.items], held, spreads, fewest))  # bounded by the block

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (first_of, item_of), least_same, space, wanted, heavy, whose, known, members, spread, least_words = sent.value
        step = max(64, 4_000_000 // max(1, wanted.shape[1]))
        for part, ids, first in batches(frames, kind, 100):  # what is held grows with the candidates of so many documents
            used = heavy[ids]
            at = np.flatnonzero(used)
            edge = np.concatenate([[True], np.diff(at // CHUNK) > 0])[: len(at)]
            rows = np.zeros((first[-1] + 1, space.shape[1]), np.float32)
            if len(at):
                rows[at[edge] // CHUNK] = np.add.reduceat(space[ids[at]], np.flatnonzero(edge), axis=0)
            terms_in = np.concatenate([used.reshape(-1, CHUNK).sum(1), [0]])
            document = np.repeat(np.arange(len(part)), np.diff(first))
            follows = np.concatenate([document[1:] == document[:-1], [False]])
            n = terms_in[:-1] + np.where(follows, terms_in[1:], 0)
            windows = np.flatnonzero(n > 1)
            hits = []
            for i in range(0, len(windows), step):
                w = windows[i : i + step]
                v = rows[w] + np.where(follows[w, None], rows[w + 1], 0)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                cosine = v @ wanted
                near = np.flatnonzero(cosine.ravel() >= COSINE)  # far faster than over two dimensions
                a, b = np.divmod(near, cosine.shape[1])
                hits.append((w[a], whose[b], cosine.ravel()[near]))
            exact = np.flatnonzero(first_of[ids.astype(np.int64) + 1] > first_of[ids])
            size = (first_of[ids[exact].astype(np.int64) + 1] - first_of[ids[exact]]).astype(np.int64)
            # needed terms per item and chunk, and in the chunks around
            chunks = len(rows)
            pairs, counts = np.unique(gathered(item_of, first_of[ids[exact]], size) * chunks + np.repeat(exact // CHUNK, size), return_counts=True)
            own, at = pairs // chunks, pairs % chunks
            upto = np.concatenate([[0], np.cumsum(counts)])
            reach = [np.searchsorted(pairs, own * chunks + edge) for edge in (np.maximum(first[document[at]], at - spread[own]), np.minimum(first[document[at] + 1], at + 2 + spread[own]))]
            some = upto[reach[1]] - upto[reach[0]] >= least_same[own, 1]
            own, at = own[some], at[some]
            if not hits and not len(own):
                continue
            w, item, cosine = (np.concatenate(x) for x in zip(*hits, (at, own, np.zeros(len(own))), strict=True))
            asked = np.concatenate([least_words[item[: len(item) - len(own)]], least_same[own, 0]])
            start = np.maximum(first[document[w]], w - spread[item]) * CHUNK
            end = np.minimum(first[document[w] + 1], w + 2 + spread[item]) * CHUNK
            held = enough(ids, start, end, item, members, asked)
            found: dict[tuple[int, int], list] = {}
            for place in zip(document[w[held]].tolist(), item[held].tolist(), cosine[held].tolist(), start[held].tolist(), end[held].tolist(), strict=True):
                found.setdefault(place[:2], []).append(place[2:])
            out = []
            for (d, i), places in found.items():
                item_id, words, answer = known[i]
                best, tried = None, set()
                for cosine_, at, to in sorted(places, reverse=True):
                    if (at, to) in tried:
                        continue
                    tried.add((at, to))
                    region = ids[at:to].tolist()
                    shared = common_subsequence(words, region) / len(words)
                    if shared >= PARAPHRASE and (best is None or shared > best[1]):
                        answered = common_subsequence(answer, region) / max(1, len(answer))
                        best = (cosine_, shared, answered, at - first[d] * CHUNK, to - at)
                        if shared >= VERBATIM:
                            break
                if best and (best[1] >= VERBATIM or best[2] >= ANSWER):
                    out.append((part["doc_id"].iloc[d], item_id, best[0], best[1], best[2], "verbatim" if best[1] >= VERBATIM else "paraphrase", int(best[3]), int(best[4])))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "shared", "answered", "kind", "first_word", "words"])

    return terms.mapInPandas(find, f"doc_id {terms.schema['doc_id'].dataType.simpleString()}, item_id long, cosine double, shared double, answered double, kind string, first_word long, words long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leak: doc_id, item_id, cosine, shared (share of the item's words in common), answered (of the
    answer's), kind (verbatim or paraphrase), first_word and words (the region of the document).

    Documents without a leak have no row. Null or empty texts, of either table, leak nothing; null ids are passed
    over; a very long text is searched whole; documents with one doc_id (of any type) are searched each and their leaks of one item are merged; ties go to the greater
    cosine. An empty table gives no rows; further columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * BLOCK_WORDS)))
    out = None
    for k in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").collect()  # about BLOCK_WORDS words
        block = read_block(rows)
        if not block.items:
            continue
        terms = numbered(docs, block)
        df, chunks = frequencies(terms, block)
        if not chunks:
            continue
        weights = weigh(block, df, chunks)
        found = search(terms, block, df, weights, latent(terms, block, df, weights))
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, cosine double, shared double, answered double, kind string, first_word long, words long")
    best = F.max(F.struct("shared", "cosine", "answered", "kind", "first_word", "words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.shared", "b.answered", "b.kind", "b.first_word", "b.words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak a benchmark item. Texts are searched under a hash of the text, so a row goes
    whatever its doc_id is, and rows with one doc_id are judged by their own texts. A null text stays."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), text_key("text").alias("_key"))
    found = staged(leaks(docs.select(text_key("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_key")).distinct(), "leaks")
    return whole.join(found, "_key", "left_anti").select("_row.*")
