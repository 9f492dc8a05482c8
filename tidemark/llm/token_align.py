"""Alignment of two tokenizers' tokens over the bytes of a text, by sparse matrix products.

A token's row in a token by byte matrix marks the bytes that it covers. The product of one tokenizer's matrix with the
transpose of the other's (row by row, after Gustavson: a row of the result is the sum of the rows that its entries
name) has an entry for each pair of tokens that overlap, with the number of bytes that they share. Places where tokens
of both end cut a text into groups; the product of the token by group matrices links the tokens of one group.

Matrices are held in compressed rows (where each row begins, and the columns of its entries), and products are made for
many segments at once: both tokenizers cut a text before white space that follows other signs, and between a word of
ASCII letters and the signs that end it (which is checked in the vocabulary), so a text is a sequence of segments, each of which is encoded and aligned once while a worker remembers it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters
from tidemark.llm.common import bounded_batches, in_worker, staged
from tidemark.llm.token_index import gathered, slices

#: A segment: a run of white space that begins with a space or a line feed, and what follows up to the next such run.
SEGMENT = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
#: The same, with signs that end a word of ASCII letters as segments of their own.
SIGNS = ".,;:!?"
FINER = re.compile(r"[ \n][A-Za-z]+(?=[.,;:!?]*(?:[ \n]|$))|(?<=[A-Za-z])[.,;:!?]+(?=[ \n]|$)|[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
#: Bytes of text that are aligned together, unless one text is longer.
TOGETHER = 1 << 20
KINDS = ("overlap", "end", "group")


class Rows:
    """A sparse matrix of zeros and ones in compressed rows."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int):
        self.starts, self.columns, self.width = starts, columns, width

    @classmethod
    def of_runs(cls, lengths: np.ndarray) -> Rows:
        """Row i covers the lengths[i] columns that follow those of row i - 1."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> Rows:
        """Row i has one entry, in column labels[i]."""
        return cls(np.arange(len(labels) + 1), labels, width)

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Rows(starts, self.rows()[order], len(self.starts) - 1)

    def times(self, other: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and counts of the product's entries, in order of rows and columns."""
        size = np.diff(other.starts)[self.columns]
        row = np.repeat(self.rows(), size)
        column = gathered(other.columns, other.starts[self.columns], size)
        entries, counts = np.unique(row * max(1, other.width) + column, return_counts=True)
        return entries // max(1, other.width), entries % max(1, other.width), counts


class Aligner:
    """Two tokenizers' tables, and the segments that a worker remembers."""

    LIMIT = 120_000

    def __init__(self, a_path: str, b_path: str, kind: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.kind = kind
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        a_bytes, b_bytes = vocabularies(a_path, b_path)
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(x), np.uint8) for x in (a_bytes, b_bytes))
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (a_bytes, b_bytes))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        # texts may be cut before a space or a line feed if no piece has one behind another sign
        self.cuts = not any(re.search(r"[^▁]▁|.[ \n]|[ \n].", p, re.S) for p in pieces)
        self.finer = not any(re.search(rf"[A-Za-z][{SIGNS}]", p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        # decimal ids with what may follow them: a comma, a bar; a comma, a semicolon
        na, nb = len(a_bytes), len(b_bytes)
        self.decimal = [*[f"{i}," for i in range(na)], *[f"{i}|" for i in range(na)], *[f"{i}," for i in range(nb)], *[f"{i};" for i in range(nb)]]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.facts = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.good = np.zeros(0, bool)
        self.told: list[str] = []
        self.links = np.zeros(0, np.int64)

    def segments(self, text: str) -> list[str]:
        """Segments of a text with a space before it."""
        return (FINER if self.finer else SEGMENT).findall(text) if self.cuts else [text]

    @staticmethod
    def same(ids: np.ndarray, counts: np.ndarray, flat: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each segment have the segment's bytes."""
        segment = np.repeat(np.arange(len(counts)), counts)
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.bincount(segment, sizes[ids], len(counts)).astype(np.int64) == want
        some = ids[good[segment]]
        made = gathered(flat, (np.cumsum(sizes) - sizes)[some], sizes[some])
        meant = np.frombuffer(b"".join(compress(raw, good.tolist())), np.uint8)
        good[np.repeat(np.flatnonzero(good), want[good])[made != meant]] = False
        return good

    def b_ids(self, segment: str, ids: list[int]) -> list[int]:
        """B puts a space before a text itself. Where a segment has none, that piece is taken off."""
        if segment[0] == " ":
            return [self.space] if segment == " " else ids
        return ids[1:] if ids[:1] == [self.space] else []

    def learn(self, new: list[str]) -> None:
        """Encode and align segments that aren't known."""
        a = [x.ids for x in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # a tail of signs is encoded behind a letter, whose piece is taken off
        texts = [s[1:] if s[0] == " " else f"a{s}" if s[0] in SIGNS else s for s in new]
        b = self.b.encode(texts, num_threads=1)
        b = [x[1:] if s[0] in SIGNS else self.b_ids(s, x) for x, s in zip(b, new, strict=True)]
        raw = [s.encode() for s in new]
        na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, na), (b, nb)))
        good = self.same(ids_a, na, self.a_flat, self.a_size, raw) & self.same(ids_b, nb, self.b_flat, self.b_size, raw)
        ids_a, ids_b = ids_a[np.repeat(good, na)], ids_b[np.repeat(good, nb)]
        na, nb = na * good, nb * good
        size_a, size_b = self.a_size[ids_a], self.b_size[ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        if self.kind == "group":
            i, j, _ = Rows.of_labels(group_a, len(cuts)).times(Rows.of_labels(group_b, len(cuts)).transposed())
        else:
            i, j, _ = Rows.of_runs(size_a).times(Rows.of_runs(size_b).transposed())
            if self.kind == "end":
                together = end_a[i] == end_b[j]
                i, j = i[together], j[together]
        segment_a = np.repeat(np.arange(len(new)), na)
        groups = np.bincount(segment_a[np.searchsorted(end_a, cuts)], minlength=len(new)) if len(cuts) else np.zeros(len(new), np.int64)
        links = np.bincount(segment_a[i], minlength=len(new)) if len(i) else np.zeros(len(new), np.int64)
        self.facts = np.concatenate([self.facts, np.stack([na, nb, groups, links], 1)])
        self.good = np.concatenate([self.good, good])
        self.links = np.concatenate([self.links, ids_a[i] * len(self.b_bytes) + ids_b[j]])
        self.told += self.written(ids_a, ids_b, group_a, group_b, na + nb)
        for s in new:
            self.at[s] = len(self.at)

    def written(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, sizes: np.ndarray) -> list[str]:
        """`a1,a2|b1;` of each segment's groups."""
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        n, m = len(self.a_bytes), len(self.b_bytes)
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(gb, ga, "left")] = a + n * last(ga)
        order[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = b + 2 * n + m * last(gb)
        words = [*map(self.decimal.__getitem__, order.tolist())]
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return ["".join(words[x:y]) for x, y in zip(ends, ends[1:], strict=False)]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Columns n_a, n_b, n_groups, groups (text), and all links (codes) with each text's first and last place."""
        if len(self.at) > self.LIMIT:
            self.forget()
        cut = [self.segments(f" {t}") if t else [] for t in texts]
        if new := list(set().union(*cut) - self.at.keys()):
            self.learn(new)
        # one behind the other: the segments of all texts whose bytes come back
        at = [[*map(self.at.__getitem__, x)] for x in cut]
        flat = np.fromiter(chain.from_iterable(at), np.int64)
        ends = np.cumsum([0, *map(len, at)])
        wrong = np.concatenate([[0], np.cumsum(~self.good[flat])])
        fine = wrong[ends[1:]] == wrong[ends[:-1]]
        kept = flat[np.repeat(fine, np.diff(ends))]
        ends = np.concatenate([[0], np.cumsum(np.diff(ends) * fine)])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.facts[kept], 0)])[ends]
        links = gathered(self.links, (np.cumsum(self.facts[:, 3]) - self.facts[:, 3])[kept], self.facts[kept, 3])
        told = self.told.__getitem__
        said = ["".join(map(told, x))[:-1] if f else "" for x, f in zip(at, fine.tolist(), strict=True)]
        n = np.diff(sums, axis=0)
        return n[:, 0], n[:, 1], n[:, 2], said, links, sums[:, 3]


def vocabularies(a_path: str, b_path: str) -> tuple[list[bytes], list[bytes]]:
    """Bytes of A's and B's tokens by id."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte_of = {c: b for b, c in enumerate(byte_letters())}
    vocab = Tokenizer.from_file(a_path).get_vocab()
    a = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        a[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
    model = SentencePieceProcessor(model_file=b_path)
    b = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        b.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return a, b


def align(docs: DataFrame, a_path: str, b_path: str, kind: str = "end") -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, groups (`a1,a2|b1;a3|b2,b3`), links (an array of A id * size of B's vocabulary
    + B id, one per pair of occurrences).

    A is a byte-level tokenizer's file, which encodes a space and the text; B a piece model, which adds that space.
    kind: `overlap` links tokens that share a byte, `end` those of them that end together, `group` all of one group.
    A null or empty text, and one whose tokens don't give its bytes back in either tokenizer, has no tokens, groups or
    links. Very long texts are aligned whole. Strings of special tokens are plain text. Repeated rows and null doc_ids
    are returned as they are; an empty table gives no rows; other columns aren't read.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    bounded_batches(docs.sparkSession)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = in_worker(("align", a_path, b_path, kind), lambda: Aligner(a_path, b_path, kind))
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                na, nb, groups, said, links, ends = tables.align(part.column("text").to_pylist())
                codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(links, pa.int64()))
                columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (na, nb, groups)), pa.array(said, pa.string()), codes]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(aligned, "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>")


def measure(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose id pair is the most frequent of its B id in
    the corpus, ties included), count_sum (over links, how often their id pair is linked in the corpus), groups_sha256.

    Links join tokens that end together. One of two such tokens ends in all the bytes of the other, so a token has at
    most one partner per length of its own or fewer bytes: the counts of id pairs are bounded by the bytes of both
    vocabularies, whatever the corpus, and are broadcast. Odd rows are as in align().
    """
    spark = docs.sparkSession
    a_bytes, b_bytes = vocabularies(a_path, b_path)
    bound, width = sum(map(len, a_bytes)) + sum(map(len, b_bytes)), len(b_bytes)
    rows = align(docs, a_path, b_path, "end")
    sha = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    rows = staged(rows.select("doc_id", "n_a", "n_b", "n_groups", "links", sha), "aligned")
    counted = rows.select(F.explode("links").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    table = staged(counted, "pair-counts").toPandas().sort_values("code")  # at most `bound` rows
    if len(table) > bound:
        raise ValueError("more pairs than two vocabularies can have")
    codes, counts = table["code"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
    best = np.zeros(width, np.int64)
    np.maximum.at(best, codes % width, counts)
    shared = spark.sparkContext.broadcast((codes, counts, counts == best[codes % width]))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, top = shared.value
        for batch in batches:
            links = batch.column("links")
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            at = np.searchsorted(known, links.flatten().to_numpy(zero_copy_only=False))
            each = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)])[ends])
            more = [pa.array(x, pa.int64()) for x in (np.diff(ends), each(top), each(n))]
            columns = [*map(batch.column, ("doc_id", "n_a", "n_b", "n_groups")), *more, batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.mapInArrow(weighed, schema)
