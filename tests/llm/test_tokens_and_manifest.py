import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, merkle, token_align
from tidemark.llm.queries import tokenizer_path

WORDS, A, B = (tokenizer_path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "a\tb", "It's <|endoftext|>x<|startoftext|>'S ÀÉ ΑΣ ΣΑΣ İstanbul Ǻ 漢字 💡\x1cfoo\x85bar　z 123 4½ x²", "aab" * 3000, "\ńé",
    "don't WE'LL \r\n\x0b\x0c x", "<|endoftext|", "ſ ﬀ ǅ İ ª º µ ß ÿ", "▁ x", "foo\r\n bar;\r\n  }\r\n", "foo\t bar\t\t baz \t\n x", "\n\nfoo", "foo \n", "\x00\x01 a",
    "  lead", "trail   ", "<0x0A> </s> <unk>", "x\x1c y\x1f\n z",
]


def made_up(seed: int, n: int, letters: str) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(n)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_equals_the_library_on_odd_and_made_up_texts():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), bpe.Codec(WORDS)
    every = "".join(map(chr, [*range(32, 0x250), *range(0x370, 0x530)])) + "́̇漢💡 \n\t" * 20
    texts = ODD + made_up(1, 4000, " \n\tabcdeINGthst'<|>.,!0129éÉßªº") + made_up(2, 4000, every)
    ids = own.encode(pa.array(texts, pa.string()))
    for text, got, said in zip(texts, ids.to_pylist(), own.decode(ids).to_pylist(), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert got == want, text
        assert said == library.decode(want, skip_special_tokens=False)


def greedy(symbols: list[int], ranks: dict, made: list) -> list[int]:
    symbols = [*symbols]
    while True:
        found = [(ranks[k], i) for i in range(len(symbols) - 1) if (k := symbols[i] << bpe.SYMBOL | symbols[i + 1]) in ranks]
        if not found:
            return symbols
        r, i = min(found)
        symbols[i : i + 2] = [made[r]]


def test_both_trees_merge_as_a_plain_search_does():
    r = random.Random(3)
    pairs = sorted({(r.randint(0, 9), r.randint(0, 9)) for _ in range(40)})
    r.shuffle(pairs)
    ranks, made = {a << bpe.SYMBOL | b: i for i, (a, b) in enumerate(pairs)}, [r.randint(0, 9) for _ in pairs]
    keys = bpe.np.array(sorted(ranks), bpe.np.int64)
    trees = bpe.PairTrees(keys, bpe.np.array([ranks[k] for k in keys.tolist()]), bpe.np.array(made))
    words = [[r.randint(0, 9) for _ in range(r.randint(1, 20))] for _ in range(500)]
    grid = bpe.np.full((len(words), 20), -1)
    for row, w in zip(grid, words, strict=True):
        row[: len(w)] = w
    for w, many in zip(words, trees.merge(grid).tolist(), strict=True):
        want = greedy(w, ranks, made)
        assert bpe.merged(w, ranks, made) == want == [x for x in many if x >= 0]


def test_a_long_word_costs_n_log_n():
    own = bpe.Codec(WORDS)
    ids = own.encode(pa.array(["ab" * 100_000, "é" * 100_000], pa.string())).to_pylist()
    assert own.decode(pa.array(ids, pa.list_(pa.int32())))[0].as_py().replace(" ", "") == "ab" * 100_000 + "</w>"


def test_bpe_digests_of_odd_rows(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, bpe.digests(odd_docs, WORDS).collect())) == sorted(map(repr, [bpe_row(*x) for x in want]))
    assert bpe.digests(no_docs, WORDS).count() == 0
    rows = spark.createDataFrame([([1, 2, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in bpe.decode(rows, WORDS).collect()] == [library.decode([1, 2]), None, ""]


def bpe_row(doc_id, n, ids, text):
    from pyspark.sql import Row

    return Row(doc_id=doc_id, n_tokens=n, ids_sha256=ids, decoded_sha256=text)


def brute_alignment(texts: list[str | None], kind: str = "end") -> list[dict]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    a_bytes, b_bytes = token_align.vocabularies(A, B)
    out = []
    for text in texts:
        raw = f" {text}".encode()
        a = a_tok.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            out.append({"a": [], "b": [], "groups": "", "n_groups": 0, "links": []})
            continue
        spans = lambda ids, table: [(i, sum(len(table[x]) for x in ids[:k]), sum(len(table[x]) for x in ids[: k + 1])) for k, i in enumerate(ids)]
        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        cuts = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        group = lambda e: sum(c < e for c in cuts)
        said = ";".join(",".join(str(i) for i, _, e in sa if group(e) == g) + "|" + ",".join(str(i) for i, _, e in sb if group(e) == g) for g in range(len(cuts)))
        test = {"end": lambda x, y: x[2] == y[2], "overlap": lambda x, y: x[1] < y[2] and y[1] < x[2], "group": lambda x, y: group(x[2]) == group(y[2])}[kind]
        out.append({"a": a, "b": b, "groups": said, "n_groups": len(cuts), "links": sorted(x[0] * len(b_bytes) + y[0] for x in sa for y in sb if test(x, y))})
    return out


@pytest.mark.parametrize("kind", token_align.KINDS)
def test_alignment_equals_brute_force(kind):
    texts = [x for x in ODD if len(x) < 200] + made_up(5, 400, " \n\t\r 　abcXYZ019.,;'\"{}()<>é漢💡\x1c▁_-")
    own = token_align.Aligner(A, B, kind)
    na, nb, groups, said, codes, ends = own.align(texts)
    links = [codes[x:y] for x, y in zip(ends, ends[1:], strict=False)]
    for k, want in enumerate(brute_alignment(texts, kind)):
        assert (na[k], nb[k], groups[k], said[k], sorted(links[k].tolist())) == (len(want["a"]), len(want["b"]), want["n_groups"], want["groups"], want["links"]), texts[k]
    again = own.align(texts)  # now remembered
    assert again[3] == said


def test_alignment_counts_links_over_the_corpus(spark, no_docs):
    texts = [x for x in ODD if len(x) < 200] + ["the cat sat; the cat", "the cat sat; the cat", None, "The end. " * 30]
    docs = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    brute, count, best = brute_alignment(texts), {}, {}
    for x in brute:
        for c in x["links"]:
            count[c] = count.get(c, 0) + 1
    width = len(token_align.vocabularies(A, B)[1])
    for c, n in count.items():
        best[c % width] = max(best.get(c % width, 0), n)
    want = [
        (i % 9, len(x["a"]), len(x["b"]), x["n_groups"], len(x["links"]), sum(count[c] == best[c % width] for c in x["links"]), sum(count[c] for c in x["links"]), sha(x["groups"]) if x["groups"] else "")
        for i, x in enumerate(brute)
    ]
    assert sorted(map(tuple, token_align.measure(docs, A, B).collect())) == sorted(want)
    assert token_align.measure(no_docs, A, B).count() == 0


def test_sparse_product_equals_a_dense_one():
    np = bpe.np
    r = np.random.default_rng(1)
    x, y = (r.random((7, 11)) < 0.3), (r.random((11, 5)) < 0.3)

    def rows(m):
        return token_align.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])

    dense = np.zeros((7, 5), int)
    i, j, n = rows(x).times(rows(y))
    dense[i, j] = n
    assert (dense == x.astype(int) @ y.astype(int)).all()
    t = rows(x).transposed()
    assert (t.columns == np.nonzero(x.T)[1]).all() and (t.starts == np.concatenate([[0], np.cumsum(x.sum(0))])).all()


def h(*parts: str) -> str:
    return sha("".join(parts))


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels: list[list[str]], i: int, node: str) -> tuple[list[str], str]:
    seen = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            seen.append(level[i ^ 1])
        node = h(*([level[i - 1], node] if i & 1 else [node, *level[i + 1 : i + 2]]))
        i >>= 1
    return seen, node


def brute_manifest(rows: list) -> list[tuple]:
    def leaf(r, extra=0):
        n = None if r.n_chars is None else int(r.n_chars) + extra
        values = [None if v is None else str(v) for v in (r.doc_id, r.source, r.lang, n, r.text)]
        return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])

    groups: dict = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top = levels_of([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            below, node = path(trees[g], i, leaf(r, 1) if tampered else own)
            above, node = path(top, k, node)
            out.append((r.doc_id, own, trees[g][-1][0], top[-1][0], h(*below, *above), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 2, merkle.BLOCK])
def test_manifest_equals_a_plain_tree(odd_docs, no_docs, levels):
    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    want = brute_manifest(docs.collect())
    got = sorted(map(repr, map(tuple, merkle.verify(docs, levels).collect())))
    assert got == sorted(map(repr, want))
    assert merkle.verify(no_docs.withColumn("n_chars", F.lit(1)), levels).count() == 0


def test_manifest_of_one_row_and_of_many_equal_ones(spark):
    one = spark.createDataFrame([(1, "a", None, 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.verify(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    many = one.crossJoin(spark.range(300)).drop("id")
    got = merkle.verify(many, 3).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_manifest(many.collect())))


def test_places_follow_from_subtree_sizes():
    for n in range(1, 40):
        leaves = [f"{i:064d}".encode() for i in range(n)]
        height = merkle.height_of(n)
        log = merkle.append_log(leaves, height)
        level = leaves
        for k in range(height + 1):
            assert [log[p] for p in merkle.place_of(k, bpe.np.arange(len(level)), n)] == level
            level = [merkle.digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
