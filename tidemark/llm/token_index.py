"""Token ids as binary shards with a minimal perfect hash index.

Files (Parquet, so that Spark's committer makes every write whole or absent):

- payload: `part`, `block`, `ids`. A block holds the ids of consecutive documents as raw little-endian integers of
  `width` bytes, in ascending doc_id order; it is closed at BLOCK_IDS ids or BLOCK_DOCS documents, and one longer
  document has a block of its own.
- index: `bucket`, `buckets` (their number), `n`, `pilots`, `slots`. Document keys are dealt to buckets by a hash; in each bucket a minimal
  perfect hash (pilots per small group: hash, displace) gives every key its own slot, where a 32-bit fingerprint, the
  part, block, offset in the block, length and start (ids of all documents before it) are stored. A lookup costs one
  pilot and one slot, however many documents there are.

A key is a doc_id with its occurrence number (0 for the first row of that doc_id), so repeated rows stay apart; a null
doc_id sorts first and is a key like any other.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, in_worker, release, shared_dir

BLOCK_IDS, BLOCK_DOCS = 1 << 17, 512
#: Keys of one index bucket on average, and keys that share a pilot on average.
BUCKET_KEYS, GROUP_KEYS = 20_000, 3
#: A pilot with this bit names the slot of its group's only key.
DIRECT = 1 << 31
NULL_KEY = -(1 << 63)
SLOT = np.dtype([("fingerprint", "<u4"), ("part", "<u4"), ("block", "<u4"), ("offset", "<u4"), ("n", "<u8"), ("start", "<u8")])


#: ASCII signs that are neither letters, digits nor white space, but for the apostrophe (it may begin a contraction).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this code point are letters to every version of the tables that the tokenizer may have been built with.
OLD_SCRIPTS = "\u0530"
#: Bytes of text that are encoded together, unless one text is longer.
TOGETHER = 1 << 22
#: Words whose ids are put in a row together.
GATHERED = 1 << 16
#: A row of payload or index is long, so a page's size is looked at after each row, not after every 100: Parquet's codecs
#: keep buffers of the largest page that a process has met, out of the heap.
PAGES = {"parquet.page.size.row.check.min": "1"}


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def letters_only(word: str) -> bool:
    """Whether the tokenizer keeps the word as one run of letters, lower-cased or not. (Some letters become a letter
    and a mark when they are lower-cased.)"""
    return word.isalpha() and (word.isascii() or max(word) < OLD_SCRIPTS and word.lower().isalpha())


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + size], one behind the other."""
    upto = np.cumsum(size)
    return flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - size), size)]


class WordEncoder:
    """Encodes texts by their distinct words and remembers words. The tokenizer lower-cases, drops white space and
    never joins across it, so a text's ids are its words' ids in a row. A word of letters is one pre-token, whose last
    token alone ends in the end-of-word mark, so many new ones are encoded at once and told apart by that mark; other
    new words are encoded together, parted by a special token."""

    #: Words that are remembered: those met last.
    LIMIT = 250_000

    def __init__(self, path: str, separator: str = "<|startoftext|>", mark: str = "</w>"):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # lower-case Latin-1 letters need neither normalising nor the general splitting pattern; the model is shared
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.separator, self.separator_id = separator, self.tokenizer.token_to_id(separator)
        size = self.tokenizer.get_vocab_size()
        self.width = width_of(size)
        self.type = np.dtype(f"<u{self.width}")
        self.ends = np.zeros(size, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(mark)]] = True
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, self.type)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def learn_parted(self, words: list[str], out: dict[str, bytes]) -> None:
        """Any words: parted by the special token, or alone if they might hold one themselves."""
        plain = [w for w in words if "<" not in w]
        for w in words:
            if "<" in w:
                out[w] = self.ids(w).tobytes()
        for i in range(0, len(plain), 512):
            ids = self.ids(self.separator.join(plain[i : i + 512]))
            for w, x in zip(plain[i : i + 512], np.split(ids, np.flatnonzero(ids == self.separator_id)), strict=True):
                out[w] = x[x != self.separator_id].tobytes()

    def learn_letters(self, words: list[str], out: dict[str, bytes]) -> None:
        for i in range(0, len(words), 512):
            some = words[i : i + 512]
            text = " ".join(some)
            if latin(text):  # whose letters are lower-cased alike here and in the tokenizer
                ids = np.array(self.plain.encode_batch_fast([text.lower()], add_special_tokens=False)[0].ids, self.type)
            else:
                ids = self.ids(text)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(ends) != len(some):
                self.learn_parted(some, out)
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                out[w] = raw[start:end]
                start = end

    def learned(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't known."""
        stems: list[str] = []
        letters, rest, tails = set(), [], set()
        for w in words:
            stem = w if w.isalpha() or "<" in w else w.rstrip(SIGNS)  # after letters, a run of such signs is one token group of its own
            if stem and letters_only(stem):
                letters.add(stem)
                tails.add(w[len(stem) :])
            else:
                rest.append(w)
                stem = ""
            stems.append(stem)
        out: dict[str, bytes] = {}
        self.learn_parted([*tails.difference([""]), *rest], out)
        out[""] = b""
        order = pa.array(letters, pa.string())
        at, some = self.recalled(order)
        for i in np.flatnonzero(some).tolist():
            k = at[i]
            out[order[i].as_py()] = self.flat[self.first[k] : self.first[k] + self.size[k]].tobytes()
        self.learn_letters(order.filter(pa.array(~some)).to_pylist(), out)
        return [out[stem] + out[w[len(stem) :]] if stem else out[w] for stem, w in zip(stems, words, strict=True)]

    def recalled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word in the memory, and whether it is there."""
        at = pc.index_in(words, value_set=self.words)
        some = at.is_valid().to_numpy(zero_copy_only=False)
        return at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), some

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all ids, and each word's first place and number of ids."""
        at, some = self.recalled(words)
        new = words.filter(pa.array(~some)).to_pylist()
        ids = [x for i in range(0, len(new), 1 << 16) for x in self.learned(new[i : i + (1 << 16)])]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        at[~some] = len(self.words) + np.arange(len(new))
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), self.type)])
        first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        size = np.concatenate([self.size, sizes])
        unseen = np.ones(len(self.words), bool)
        unseen[at[some]] = False
        older = np.flatnonzero(unseen)[: max(0, self.LIMIT - len(words))]
        kept = np.concatenate([at, older])[: self.LIMIT]
        self.words = pa.concat_arrays([words, self.words.take(pa.array(older))])[: self.LIMIT]
        self.flat, self.size = gathered(flat, first[kept], size[kept]), size[kept]
        self.first = np.cumsum(self.size) - self.size
        return flat, first[at], size[at]

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """Raw ids of each text (no nulls), with the end id behind them if one is given."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        flat, first, size = self.of_words(coded.dictionary)
        # entry 0, the end, stands behind each text's words
        ending = np.array([] if end is None else [end], self.type)
        flat, first, size = np.concatenate([ending, flat]), np.concatenate([[0], first + len(ending)]), np.concatenate([[len(ending)], size])
        words = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        lasts = np.cumsum(words + 1) - 1
        at = np.zeros(int((words + 1).sum()), np.int32)
        inside = np.ones(len(at), bool)
        inside[lasts] = False
        at[inside] = coded.indices.to_numpy(zero_copy_only=False)
        at[inside] += 1
        upto = np.cumsum(size[at])
        runs = (at[i : i + GATHERED] for i in range(0, len(at), GATHERED))
        ids = np.concatenate([flat[:0], *(gathered(flat, first[x], size[x]) for x in runs)])
        offsets = np.concatenate([[0], upto[lasts] * self.width])
        if offsets[-1] < 1 << 31:
            return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())


def width_of(ids: int) -> int:
    return 2 if ids <= 1 << 16 else 4


def width(path: str) -> int:
    """Bytes of an id in the files of this tokenizer."""
    from tokenizers import Tokenizer

    return width_of(Tokenizer.from_file(path).get_vocab_size())


def slices(batch: pa.RecordBatch, column: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `most` bytes together."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over integer keys, the same on every machine."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(doc_id.astype(np.int64).view(np.uint64) + mix64(copy.astype(np.uint64), 0x9E3779B97F4A7C15) * (copy != 0).astype(np.uint64), 0x51)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Pilots of a minimal perfect hash over distinct 64-bit hashes: groups of keys, largest first, each look for the
    least pilot that sends all their keys to free slots; groups of one key take the slots that are left."""
    n = len(keys)
    groups = max(1, -(-n // GROUP_KEYS))
    group = (mix64(keys, 0xA1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=groups)
    ends = np.cumsum(counts)
    pilots, taken = np.zeros(groups, "<u4"), np.zeros(n, bool)
    tries = np.arange(64, dtype=np.uint64)
    for g in np.argsort(-counts, kind="stable"):
        if counts[g] < 2:
            break
        own, base = keys[order[ends[g] - counts[g] : ends[g]]], 0
        while True:
            slots = slot_of(own[None, :], tries[:, None] + np.uint64(base), n)  # below DIRECT
            good = ~taken[slots].any(1)
            if len(own) > 1:
                good &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
            if good.any():
                found = int(good.argmax())
                pilots[g], taken[slots[found]] = base + found, True
                break
            base += len(tries)
            if base >= DIRECT - len(tries):
                raise ValueError("two keys of a bucket have one hash")
    single = np.flatnonzero(counts == 1)
    pilots[single] = np.flatnonzero(~taken)[: len(single)] + DIRECT
    return pilots


def slot_of(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key under its group's pilot."""
    searched = (mix64(keys ^ mix64(pilots.astype(np.uint64), 0xC3), 0xB2) % np.uint64(n)).astype(np.int64)
    return np.where(pilots >= DIRECT, pilots.astype(np.int64) - DIRECT, searched)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 0xD4) >> np.uint64(32)).astype("<u4")


def bounds(docs: DataFrame, parts: int) -> list[int]:
    """doc_ids that cut the documents into about equal parts: parts - 1 numbers at most."""
    if parts < 2:
        return []
    at = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"]
    return sorted(set(at or []))


BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("doc", pa.list_(pa.int64())), ("copy", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("offset", pa.list_(pa.int64())), ("start", pa.list_(pa.int64()))])


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and all bytes of a binary array without nulls."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def packer(width: int):
    """Sorted rows (part, key, ids) to blocks. Rows of a batch are cut out of its buffer as they lie."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, block, start, last, copy = -1, 0, 0, None, 0
        doc: list = []
        copies: list = []
        sizes: list = []
        pieces: list = []
        total = 0

        def closed() -> pa.RecordBatch:
            n = np.array(sizes, np.int64)
            before = np.cumsum(n) - n
            row = [part, block, b"".join(pieces), doc, copies, n, before, before + start]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

        for batch in batches:
            at, data = raw(batch.column("ids").cast(pa.binary()))
            parts, keys, lengths = batch.column("part").to_pylist(), batch.column("key").to_pylist(), (np.diff(at) // width).tolist()
            edges, open_from = at.tolist(), 0
            for i, n in enumerate(lengths):
                if sizes and (parts[i] != part or total + n > BLOCK_IDS or len(sizes) >= BLOCK_DOCS):
                    pieces.append(data[edges[open_from] : edges[i]].tobytes())
                    yield closed()
                    block, start = block + 1, start + total
                    doc, copies, sizes, pieces, total, open_from = [], [], [], [], 0, i
                if parts[i] != part:
                    part, block, start, last = parts[i], 0, 0, None
                copy = copy + 1 if keys[i] == last else 0
                last = keys[i]
                doc.append(last)
                copies.append(copy)
                sizes.append(n)
                total += n
            pieces.append(data[edges[open_from] : edges[-1]].tobytes())
        if sizes:
            yield closed()

    return pack


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, parts: int | None = None) -> None:
    """Encode every text of docs (null: no ids, then the end id) and write payload and index below path.

    Documents are range-parted by doc_id at quantiles read from the doc_id column alone, encoded where they lie, and
    only their ids are shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark, "4m")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(docs, parts)
    edges = np.array(cuts, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = in_worker(("words", tokenizer), lambda: WordEncoder(tokenizer))
        for batch in batches:
            for some in slices(batch, "text"):
                key = some.column("key")
                part = np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), key, words.encode(some.column("text"), end_id)], ["part", "key", "ids"])

    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(encode, "part int, key long, ids binary").repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "key", "ids")
    blocks = rows.mapInArrow(packer(width(tokenizer)), "part int, block int, ids binary, doc array<long>, copy array<int>, n array<long>, offset array<long>, start array<long>")
    blocks.write.options(**PAGES).parquet(f"{path}/payload")

    entries = spark.read.parquet(f"{path}/payload").select("part", "block", F.explode(F.arrays_zip("doc", "copy", "n", "offset", "start")).alias("e")).select("part", "block", "e.*")
    sizes = spark.read.parquet(f"{path}/payload").select("part", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size("doc").alias("d")).groupBy("part").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("d").over(Window.partitionBy()).alias("docs"))
    total = base.agg(F.max("docs")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_KEYS))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["bucket"] = (key_hash(f["doc"].to_numpy(), f["copy"].to_numpy()) % np.uint64(buckets)).astype(np.int64)
            yield f[["bucket", "doc", "copy", "part", "block", "n", "offset", "start"]]

    def build(f: pd.DataFrame) -> pd.DataFrame:
        keys = key_hash(f["doc"].to_numpy(), f["copy"].to_numpy())
        pilots = perfect_hash(keys)
        at = slot_of(keys, pilots[(mix64(keys, 0xA1) % np.uint64(len(pilots))).astype(np.int64)], len(keys))
        slots = np.zeros(len(keys), SLOT)
        slots["fingerprint"][at] = fingerprint(keys)
        for c in ("part", "block", "offset", "n", "start"):
            slots[c][at] = f[c].to_numpy()
        return pd.DataFrame({"bucket": [f["bucket"].iloc[0]], "buckets": [buckets], "n": [len(keys)], "pilots": [pilots.tobytes()], "slots": [slots.tobytes()]})

    entries = entries.join(F.broadcast(base.select("part", "base")), "part")  # one row per part
    entries = entries.select("doc", "copy", "part", "block", "n", "offset", (F.col("start") + F.col("base")).alias("start"))
    entries = entries.mapInPandas(deal, "bucket long, doc long, copy int, part int, block int, n long, offset long, start long")
    entries.groupBy("bucket").applyInPandas(build, "bucket long, buckets long, n long, pilots binary, slots binary").write.options(**PAGES).parquet(f"{path}/index")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys(doc_id, copy) -> doc_id, copy, part, block, offset, n, start, found. An unknown key has found = false, but
    for a chance of 2^-32 that its fingerprint equals the one in its slot."""
    index = spark.read.parquet(f"{path}/index")
    stored = index.select("buckets").first()
    buckets = stored["buckets"] if stored else 1

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(bucket=(key_hash(f["key"].to_numpy(), f["copy"].to_numpy()) % np.uint64(buckets)).astype(np.int64))

    def probe(wanted: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        hashes = key_hash(wanted["key"].to_numpy(), wanted["copy"].to_numpy())
        if not len(stored) or not len(wanted):
            return wanted.assign(part=0, block=0, offset=0, n=0, start=0, found=False)[LOOKUP_COLUMNS]
        pilots, slots = np.frombuffer(stored["pilots"].iloc[0], "<u4"), np.frombuffer(stored["slots"].iloc[0], SLOT)
        hit = slots[slot_of(hashes, pilots[(mix64(hashes, 0xA1) % np.uint64(len(pilots))).astype(np.int64)], len(slots))]
        return wanted.assign(**{c: hit[c].astype(np.int64) for c in ("part", "block", "offset", "n", "start")}, found=hit["fingerprint"] == fingerprint(hashes))[LOOKUP_COLUMNS]

    wanted = keys.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), F.col("copy").cast("int").alias("copy")).mapInPandas(deal, "key long, copy int, bucket long")
    found = wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, "key long, copy int, part long, block long, offset long, n long, start long, found boolean")
    return found.select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), "copy", F.col("part").cast("int").alias("part"), F.col("block").cast("int").alias("block"), "offset", "n", "start", "found")


LOOKUP_COLUMNS = ["key", "copy", "part", "block", "offset", "n", "start", "found"]


def read(spark: SparkSession, path: str, keys: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, copy, start, n_tokens, ids (raw) of the keys that the index holds. Keys are gathered per block (at most
    BLOCK_DOCS documents each), and every block is cut once."""
    places = lookup(spark, path, keys).where("found").groupBy("part", "block").agg(F.collect_list(F.struct("doc_id", "copy", "start", "n", "offset")).alias("e"))
    blocks = spark.read.parquet(f"{path}/payload").select("part", "block", "ids")
    own = F.transform("e", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["copy"].alias("copy"), x["start"].alias("start"), x["n"].alias("n_tokens"), F.substring("ids", (x["offset"] * width + 1).cast("int"), (x["n"] * width).cast("int")).alias("ids")))
    return blocks.join(places, ["part", "block"]).select(F.explode(own).alias("e")).select("e.*")


def checked(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, over the ids as 32-bit little-endian integers), copy."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            at, data = raw(batch.column("ids").cast(pa.binary()))
            ids = np.frombuffer(data[at[0] : at[-1]].tobytes(), f"<u{width}").astype("<u4").view(np.uint8)
            edges = ((at - at[0]) // width * 4).tolist()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64()), batch.column("copy")], ["doc_id", "start", "n_tokens", "ids_crc32", "copy"])

    return rows.select("doc_id", "start", "n_tokens", "ids", "copy").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long, copy int")


def roundtrip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs, then look every document up in the files: doc_id, copy, start, n_tokens, ids_crc32.

    Null or empty text: only the end id. A very long text is encoded whole and has a block of its own. Repeated doc_ids are stored one after the other (ordered by their ids) with
    copy 0, 1, ... A null doc_id is stored first and returned as null. An empty table gives no rows. Columns besides
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-index-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    stored = spark.read.parquet(f"{path}/payload").select(F.explode(F.arrays_zip("doc", "copy")).alias("e")).select(F.when(F.col("e.doc") != NULL_KEY, F.col("e.doc")).alias("doc_id"), "e.copy")
    size = width(tokenizer)
    return checked(read(spark, path, stored, size), size)
