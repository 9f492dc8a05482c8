"""BPE encoding and decoding, with the merges of a word found by a segment tree.

A word's symbols stand at the leaves' places; leaf i holds the rank of the merge of symbol i with the symbol behind it,
and the tree keeps minima of (rank, place). Its root is therefore the leftmost merge of the lowest rank. A merge changes
three leaves, so it costs three walks to the root, and a word of n symbols costs n log n whatever it looks like. Short
words are merged many at a time, a step of each in one array operation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, in_worker
from tidemark.llm.token_index import gathered, latin, slices

#: Above all keys of a tree: no merge.
NONE = 1 << 62
#: Bits of a symbol in the key of a pair.
SYMBOL = 24


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others, in
    order, for the letters from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairTree:
    """Minima of (rank, place) over the adjacent pairs of a sequence of symbols."""

    def __init__(self, keys: list[int]):
        self.bits = max(1, len(keys) - 1).bit_length()
        self.size = 1 << self.bits
        self.nodes = [NONE] * self.size + [NONE if k is None else k << self.bits | i for i, k in enumerate(keys)] + [NONE] * (self.size - len(keys))
        for at in range(self.size - 1, 0, -1):
            self.nodes[at] = min(self.nodes[2 * at], self.nodes[2 * at + 1])

    def lowest(self) -> tuple[int, int] | None:
        """Rank and place of the leftmost pair of the lowest rank."""
        top = self.nodes[1]
        return None if top == NONE else (top >> self.bits, top & self.size - 1)

    def put(self, place: int, rank: int | None) -> None:
        """A new rank at a place; the walk ends where a minimum stays as it was."""
        nodes, at = self.nodes, self.size + place
        nodes[at] = NONE if rank is None else rank << self.bits | place
        while at > 1:
            at >>= 1
            a, b = nodes[2 * at], nodes[2 * at + 1]
            least = a if a < b else b
            if nodes[at] == least:
                return
            nodes[at] = least


def merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols after all merges. ranks: key of a pair (first << SYMBOL | second) to rank; made: the symbol of a rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = [*symbols]
    rank = ranks.get
    tree = PairTree([rank(a << SYMBOL | b) for a, b in zip(symbols, symbols[1:], strict=False)])
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    gone = bytearray(n)
    while low := tree.lowest():
        r, i = low
        j = after[i]
        symbols[i], gone[j] = made[r], 1
        k = after[i] = after[j]
        if j < n - 1:
            tree.put(j, None)
        if k < n:
            before[k] = i
            tree.put(i, rank(symbols[i] << SYMBOL | symbols[k]))
        else:
            tree.put(i, None)
        if (h := before[i]) >= 0:
            tree.put(h, rank(symbols[h] << SYMBOL | symbols[i]))
    return [s for s, g in zip(symbols, gone, strict=True) if not g]


class PairTrees:
    """PairTree for many words of about one length at once: row w of each array is a word's, and every step merges the
    lowest pair of each word that has one."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        """Sorted keys of the mergeable pairs, their ranks, and the symbol made by each rank."""
        self.keys, self.ranks, self.made = keys, ranks, made

    def rank(self, a: np.ndarray, b: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
        """Leaves of pairs at places; symbols below 0 merge with nothing."""
        key = a << SYMBOL | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at] << bits | places, NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: words by places, padded by -1. The same after all merges, with -1 where a symbol is gone."""
        words, n = symbols.shape
        bits = n.bit_length()
        size, wide = 1 << bits, n + 1
        s = np.full((words, wide), -1, np.int64)
        s[:, :n] = symbols
        nodes = np.full((words, 2 * size), NONE, np.int64)
        nodes[:, size : size + n] = self.rank(s[:, :n], s[:, 1:], np.arange(n), bits)
        level = size
        while level > 1:
            level >>= 1
            nodes[:, level : 2 * level] = np.minimum(nodes[:, 2 * level : 4 * level : 2], nodes[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, wide + 1), (words, 1)).ravel()
        before = np.tile(np.arange(-1, n), (words, 1)).ravel()
        s, nodes, live = s.ravel(), nodes.ravel(), np.arange(words)
        while True:
            top = nodes[live * (2 * size) + 1]
            some = top != NONE
            live, top = live[some], top[some]
            if not len(live):
                return s.reshape(words, wide)[:, :n]
            row, tree = live * wide, live * (2 * size) + size
            i, symbol = top & size - 1, self.made[top >> bits]
            j = after[row + i]
            k = np.minimum(after[row + j], n)
            s[row + i], s[row + j] = symbol, -1
            after[row + i] = k
            before[row + k] = i
            h = before[row + i]
            first = h < 0
            h = np.where(first, i, h)
            right = self.rank(symbol, s[row + k], i, bits)
            left = np.where(first, right, self.rank(s[row + h], symbol, h, bits))
            nodes[tree + j], nodes[tree + i] = NONE, right
            nodes[tree + h] = left
            base = tree - size
            at = np.stack([h, i, j]) + size
            for _ in range(bits):
                at >>= 1
                below = base + 2 * at
                nodes[base + at] = np.minimum(nodes[below], nodes[below + 1])


class Codec:
    """A byte-level BPE tokenizer's tables. Normalising and cutting into words are declared by the tokenizer's file, and
    its library applies them (plain Latin words need neither); the merges are done here. White space must part words for
    good (as it is dropped), so that a text's ids are those of its words."""

    #: Words and pieces that are remembered, and bytes of a piece up to which pieces are merged many at a time.
    LIMIT, SHORT = 250_000, 64
    #: Fixed value: how the tokenizer cuts text into pieces, for ASCII letters in lower case.
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, self.library = told["model"], Tokenizer.from_file(path)
        cuts = [p for p in told["pre_tokenizer"].get("pretokenizers", []) if p.get("behavior") == "Removed" and p.get("invert")]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or told.get("decoder") or [p["pattern"] for p in cuts] != [{"Regex": self.PATTERN}]:
            raise ValueError("not a BPE tokenizer of this kind: it must cut words by the pattern and join tokens by spaces")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.letters, self.last = (np.array([vocab[c + x] for c in letters], np.int64) for x in ("", suffix))
        ranks, made = {}, []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[vocab[a] << SYMBOL | vocab[b]] = r
            made.append(vocab[a + b])
        self.ranks, self.made = ranks, made
        keys = np.array(sorted(ranks), np.int64)
        self.trees = PairTrees(keys, np.array([ranks[k] for k in keys.tolist()], np.int64), np.array(made, np.int64))
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        every = vocab | self.special
        names = [None] * (max(every.values()) + 1)
        for token, i in every.items():
            names[i] = token
        self.names = pa.array(names, pa.string())
        #: Raw ids of pieces (by their bytes) and of words.
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def cut_up(self, word: str) -> list[bytes | int]:
        """The pieces of a word, as bytes, and special tokens, as ids."""
        if "<" not in word:
            if word.isalpha() and latin(word):
                return [word.lower().encode()]
            if word.isascii():
                return [x.encode() for x in self.ASCII.findall(word.lower())]
        out: list[bytes | int] = []
        for part in self.cut.split(word) if self.special else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def learn(self, pieces: list[bytes]) -> None:
        """Merge pieces that aren't known: those of about one length together, long ones by themselves."""
        by_size: dict[int, list[bytes]] = {}
        for p in pieces:
            by_size.setdefault(min(-(-len(p) // 4) * 4, self.SHORT + 1), []).append(p)
        for size, some in by_size.items():
            if size > self.SHORT:
                for p in some:
                    ids = self.letters[np.frombuffer(p, np.uint8)]
                    ids[-1] = self.last[p[-1]]
                    self.pieces[p] = np.array(merged(ids.tolist(), self.ranks, self.made), np.int32).tobytes()
                continue
            flat = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in some), np.uint8).reshape(-1, size)
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            symbols = np.where(np.arange(size) < lengths[:, None], self.letters[flat], -1)
            at = np.arange(len(some))
            symbols[at, lengths - 1] = self.last[flat[at, lengths - 1]]
            done = self.trees.merge(symbols)
            kept = done >= 0
            raw, ends = done[kept].astype(np.int32).tobytes(), np.cumsum(kept.sum(1)) * 4
            start = 0
            for p, end in zip(some, ends.tolist(), strict=True):
                self.pieces[p] = raw[start:end]
                start = end

    def of_words(self, words: list[str]) -> list[bytes]:
        """Raw ids of words without white space between them (or of any texts)."""
        new = [w for w in words if w not in self.words]
        cut = [self.cut_up(w) for w in new]
        if len(self.pieces) > self.LIMIT:
            self.pieces.clear()
        self.learn(list(dict.fromkeys(p for x in cut for p in x if isinstance(p, bytes) and p not in self.pieces)))
        get = self.pieces.__getitem__
        for w, x in zip(new, cut, strict=True):
            self.words[w] = get(x[0]) if len(x) == 1 and isinstance(x[0], bytes) else b"".join(get(p) if isinstance(p, bytes) else p.to_bytes(4, "little") for p in x)
        return [*map(self.words.__getitem__, words)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Lists of ids of texts (no nulls)."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        if len(self.words) > self.LIMIT:
            self.words = {"": b""}
        ids = self.of_words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(size[at])])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
        return pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(gathered(flat, first[at], size[at]), pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids: the tokens, joined by spaces; ids of no token are left out."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        known = (flat >= 0) & (flat < len(self.names))
        known[known] = self.names.is_valid().to_numpy(zero_copy_only=False)[flat[known]]
        upto = np.concatenate([[0], np.cumsum(known)])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        tokens = self.names.take(pa.array(flat[known], pa.int64()))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), tokens), " ")


def codec(path: str) -> Codec:
    return in_worker(("bpe", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), text (the ids decoded again).

    A null or empty text, or one of white space, has no ids and decodes to an empty text. A very long text, and one very
    long word, is encoded whole. Special tokens' strings in a text become their ids, as the library does. Repeated rows
    and null doc_ids are returned as they are; an empty table gives no rows; columns besides doc_id and text aren't
    read. Ties can't occur: of equal ranks the leftmost pair is merged.
    """
    bounded_batches(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = c.encode(part.column("text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, c.decode(ids)], ["doc_id", "ids", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(coded, "doc_id long, ids array<int>, text string")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with text: the ids decoded. Null ids: null."""

    @F.pandas_udf("string")
    def told(lists):
        c = codec(path)
        out = c.decode(pa.array([x if x is not None else [] for x in lists], pa.list_(pa.int32()))).to_pandas()
        out.index = lists.index
        return out.where(lists.notna(), None)

    return rows.withColumn("text", told(ids))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(ids).alias("ids_sha256"), sha(F.col("text")).alias("decoded_sha256"))
