"""Each operator against brute force on small tables, with the odd cases that its docstring defines."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_text, langid, licenses, mixing, ngram_join, quality, sharding, token_index, toxicity
from tidemark.llm.queries import tokenizer_path

from .conftest import sentence


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_token_index(odd_docs, no_docs, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = rows(token_index.roundtrip(odd_docs, tokenizer_path()))
    assert len(got) == odd_docs.count()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert collections.Counter(want) == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)
    start = 0
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["copy"])):
        assert r["start"] == start
        start += r["n_tokens"]
    assert rows(token_index.roundtrip(no_docs, tokenizer_path())) == []


def test_words_are_encoded_as_the_tokenizer_does(monkeypatch):
    """Strings of letters that change in lower case, marks, digits, signs, contractions and special tokens."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_index.WordEncoder, "LIMIT", 900)  # so that words are forgotten and learned again
    t, words = Tokenizer.from_file(tokenizer_path()), token_index.WordEncoder(tokenizer_path())
    draw = random.Random(4)
    parts = [*"abzAZ éÉßİﬁΣσςЖж漢字ねカ ۱٣12½²Ⅷ'’.,!<|>-_\n\t\u0301\u0345\u3000\u00a0ǅŉJ\u030cẞ💡", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "𝐀", "Ა", "İ!", " "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(20_000)]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        got = words.encode(pa.array(some, pa.string()), 1).to_pylist()
        assert [np.frombuffer(x, words.type).tolist() for x in got] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in some]


def test_lookup_of_unknown_keys(odd_docs, spark, tmp_path):
    path = f"file://{tmp_path}/index"
    token_index.write(odd_docs, path, tokenizer_path(), parts=3)
    keys = spark.createDataFrame([(1, 0), (7, 1), (7, 2), (999, 0)], "doc_id long, copy int")
    found = {(r["doc_id"], r["copy"]): r["found"] for r in rows(token_index.lookup(spark, path, keys))}
    assert found == {(1, 0): True, (7, 1): True, (7, 2): False, (999, 0): False}


def test_perfect_hash_is_minimal():
    for n in (1, 2, 7, 500):
        keys = token_index.key_hash(np.arange(n), np.zeros(n, int))
        pilots = token_index.perfect_hash(keys)
        at = token_index.slot_of(keys, pilots[(token_index.mix64(keys, 0xA1) % np.uint64(len(pilots))).astype(np.int64)], n)
        assert sorted(at) == list(range(n))


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])


def brute_components(pairs, pct=85):
    parent = {}
    sets = [(d, shingle_set(t)) for d, t in pairs]
    for d, _ in sets:
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            inside = len(x & y)
            if x and y and 100 * inside >= pct * (len(x) + len(y) - inside):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {d: find(d) for d, _ in sets}


def test_ngram_join_of_near_copies(spark, monkeypatch):
    """Groups longer than a column may be: pivots, distances and bitmaps have to keep every link."""
    monkeypatch.setattr(ngram_join, "LONG", 6)
    base = [sentence(s, 90).split() for s in (1, 2)]
    docs = []
    rng = np.random.default_rng(5)
    for i in range(120):
        w = list(base[i % 2])
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = f"edit{int(rng.integers(0, 12))}"
        docs.append((i + 1, " ".join(w)))
    docs += [(500 + i, sentence(40 + i, 30 + i % 7)) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in rows(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == brute_components(docs)


def test_ngram_join_odd_cases(odd_docs, no_docs):
    got = rows(ngram_join.join(odd_docs))
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == by[7]["component_id"] == 1
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[5]["n_shingles"] == 0
    assert (by[3]["component_id"], by[4]["component_id"]) == (3, 4)
    assert by[8]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert rows(ngram_join.join(no_docs)) == []


def test_decontamination(spark, odd_docs, no_docs):
    items = [(1, "The rapid brown fox leaps across seventeen sleepy hounds near the quiet riverbank. It was Tuesday."), (2, None), (None, "x y z"), (3, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    said = items[0][1]
    docs = [(i, sentence(i, 80)) for i in range(60)]
    docs += [(100, sentence(70, 50) + " " + said + " " + sentence(71, 50)), (101, said.replace("rapid", "fast").replace("quiet", "calm")), (102, said[:40] + " " + sentence(72, 60)), (103, None), (None, said), (100, sentence(7, 9))]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in rows(decontaminate.leaks(table, bench))}
    assert got == {(100, 1): "verbatim", (101, 1): "verbatim"}
    kept = {r["doc_id"] for r in rows(decontaminate.clean(table, bench))}
    assert kept == {d for d, _ in docs} - {101, None}  # 100 has another text too; the text without an id goes
    assert rows(decontaminate.leaks(no_docs, bench)) == rows(decontaminate.leaks(table, bench.where("false"))) == []
    assert decontaminate.clean(odd_docs, bench).count() == odd_docs.count()


def test_decontamination_recall(spark):
    """Items in the words of other items, told again with a quarter or a third of their words replaced: every pair that
    the longest common subsequence calls a leak has to come out."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(900)]
    pick = lambda n: [words[int(900 * x**1.5)] for x in rng.random(n)]
    items = [pick(int(rng.integers(12, 40))) + ["."] + pick(6) for _ in range(600)]
    docs = []
    for d in range(240):
        said = [w for w in items[d] if w != "."]
        n = len(said) - 6
        if d % 3:
            for i in rng.choice(n, int(n * (0.35 if d % 3 == 1 else 0.25)), replace=False):
                said[i] = words[int(rng.integers(0, 900))]
        docs.append((d, " ".join(pick(int(rng.integers(20, 60))) + said + pick(int(rng.integers(20, 60))))))
    docs += [(240 + i, " ".join(pick(120))) for i in range(200)]
    rows_of = [{"item_id": i, "text": " ".join(x)} for i, x in enumerate(items)]
    block = decontaminate.read_block(rows_of)
    want = set()
    for item in block.items[:240]:
        region = [block.vocabulary.get(w, 0) for w in docs[item.item_id][1].split()]
        shared, answered = (decontaminate.common_subsequence(x, region) / len(x) for x in (item.words, item.answer))
        if shared >= decontaminate.VERBATIM or (shared >= decontaminate.PARAPHRASE and answered >= decontaminate.ANSWER):
            want.add((item.item_id, item.item_id))
    assert len(want) == 240
    bench = spark.createDataFrame([tuple(x.values()) for x in rows_of], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench))}
    assert want - got == set()


def test_subsequence():
    assert decontaminate.common_subsequence([1, 2, 3, 4], [9, 1, 3, 8, 4, 2]) == 3
    assert decontaminate.common_subsequence([5], []) == 0


def test_sharding(odd_docs, no_docs):
    got = rows(sharding.assign(odd_docs))
    assert len(got) == odd_docs.count()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in odd_docs.select("doc_id", "text").collect())
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert rows(sharding.assign(no_docs)) == []


def places(spark, tree, n=20_000):
    got = sharding.descend(spark.range(n).withColumnRenamed("id", "key"), "key", tree).orderBy("key").collect()
    return [(r["region"], r["rack"], r["shard"]) for r in got]


def test_tree_follows_weights(spark):
    tree = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 1, 1, 3.0), sharding.Leaf(1, 2, 2, 4.0), sharding.Leaf(1, 2, 3, 0.0)]
    at = places(spark, tree)
    n = collections.Counter(s for _, _, s in at)
    assert set(n) == {0, 1, 2} and abs(n[0] / 2500 - 1) < 0.1 and abs(n[1] / 7500 - 1) < 0.1
    assert {x for x in at} == {(0, 0, 0), (0, 1, 1), (1, 2, 2)}


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    tree = sharding.even_tree(shards)
    moved = [(a, b) for a, b in zip(places(spark, tree), places(spark, sharding.grown(tree)), strict=True) if a != b]
    assert moved and {b[2] for _, b in moved} == {shards}
    assert abs(len(moved) * (shards + 1) / 20_000 - 1) < 0.15
    assert sharding.grown(sharding.even_tree(24)) == sharding.even_tree(25)


def test_changed_weights_move_keys_only_at_their_subtree(spark):
    tree = sharding.even_tree(24)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 5.0 if x.shard == 6 else 1.0) for x in tree]
    shifted = [sharding.Leaf(x.region, x.rack, x.shard, {4: 2.0, 5: 0.0}.get(x.shard, 1.0)) for x in tree]
    before = places(spark, tree)
    moved = [(a, b) for a, b in zip(before, places(spark, heavier), strict=True) if a != b]
    assert moved and all(0 in (a[0], b[0]) for a, b in moved) and {b[0] for _, b in moved} == {0}  # region 0 grew
    within = [(a, b) for a, b in zip(before, places(spark, shifted), strict=True) if a != b]
    assert within and all(a[1] == b[1] == 1 for a, b in within)  # rack 1 weighs as before


def test_toxicity_learns_and_locates(spark, odd_docs, no_docs):
    bad = "vileword"
    docs = [(i, (sentence(i, 12) + ". " + (f"you {bad} " if i % 4 == 0 else "you friend ") + sentence(i + 1, 8) + ". " + sentence(i + 2, 9) + ".")) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.judge(table, labels))
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert all(bad in r["worst_sentence"] for r in got if r["predicted"])
    assert len(rows(toxicity.judge(odd_docs, labels))) == odd_docs.count()
    assert {r["score"] for r in rows(toxicity.judge(odd_docs.where("doc_id in (3, 4)"), labels))} == {0.0}
    assert len(rows(toxicity.judge(odd_docs, labels.where("false")))) == odd_docs.count()
    assert rows(toxicity.judge(no_docs, labels)) == []


def test_langid(spark, odd_docs, no_docs):
    words = {"en": "the of and with that this from which".split(), "fr": "le la les dans avec pour est une".split(), "el": "και της του στην από για".split()}
    docs = []
    for i in range(240):
        lang = list(words)[i % 3]
        w = words[lang]
        docs.append((i, " ".join(w[(i * j + j) % len(w)] for j in range(20)), lang))
    mixed = " ".join(words["en"] * 4) + " " + " ".join(words["fr"] * 6)
    docs += [(1000, mixed, None), (1001, "12 !", "en"), (1002, None, "en")]
    got = {r["doc_id"]: r for r in rows(langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")))}
    assert all(r["lang"] == r["lang_pred"] for d, r in got.items() if d < 1000)
    assert [s["lang"] for s in got[1000]["spans"]] == ["en", "fr"] and got[1000]["lang_pred"] == "fr"
    assert got[1000]["spans"][0]["words"] == 32
    assert got[1001]["lang_pred"] == got[1002]["lang_pred"] == "und"
    assert langid.identify(odd_docs).count() == odd_docs.count() and rows(langid.identify(no_docs)) == []
    assert {r["lang_pred"] for r in rows(langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


def test_langid_words():
    assert langid.words_of("½ ² Ⅷ ① 12 _") == [] and langid.words_of("Don't_stop 3x é") == ["don", "t", "stop", "x", "é"]
    assert langid.words_of("漢" * 19 + "abc" + "カ" * 9 + " Ж\u0301ъ" + "x" * 300) == ["漢" * 8, "漢" * 8, "漢" * 3, "abc", "カ" * 8, "カ", "ж", "ъ", "x" * 300]
    every = "".join(c for c in map(chr, range(0x30000)) if c.isalpha())
    assert len("".join(langid.words_of(every))) == len("".join(c for c in every.lower() if c.isalpha()))


def test_langid_reads_long_runs_to_their_ends(spark):
    """No letter of a run is left out: a run of Han letters that turns into another language's after 100 letters is
    labelled by both, and a long word of Latin letters by all of its trigrams."""
    one, two = "的一是在不了有和人这中大为上个国我以要他", "書類確認頂戴宜願致御座候也共間事者今日昨"
    docs = [(i, "".join((one, two)[i % 2][(i * j + j) % 20] for j in range(40)), ("x", "y")[i % 2]) for i in range(200)]
    docs += [(1000 + i, "".join(("abcde", "vwxyz")[i % 2][(i + j * j) % 5] for j in range(9)), ("p", "q")[i % 2]) for i in range(200)]
    docs += [(2000, docs[1][1][:20] * 5 + docs[0][1][:20] * 20, None), (2001, "a" * 61 + docs[201][1] * 40, None), (2002, "½ ² Ⅷ", "p")]
    got = {r["doc_id"]: r for r in rows(langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")))}
    assert got[2000]["lang_pred"] == "x" and [s["lang"] for s in got[2000]["spans"]] == ["y", "x"]
    assert got[2001]["lang_pred"] == "q" and (got[2002]["lang_pred"], got[2002]["score"]) == ("und", 0.0)


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    score = rng.normal(0, 9, (7, 3))

    def value(path):
        return sum(score[i, p] for i, p in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))

    import itertools

    best = max(itertools.product(range(3), repeat=7), key=value)
    assert tuple(langid.viterbi([score, score[:3]])[0]) == best


def brute_stats(text):
    w = (text or "").encode().split()
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(odd_docs, no_docs, spark):
    got = rows(quality.judge(odd_docs))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = collections.Counter((d, *brute_stats(t)) for d, t in odd_docs.select("doc_id", "text").collect())
    assert want == collections.Counter((r["doc_id"], *[r[n] for n in names]) for r in got)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert rows(quality.judge(no_docs)) == []
    line = " ".join(f"menu{i}" for i in range(30))
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    docs = [(i, line + "\n" + own(i, 40), "h1") for i in range(30)] + [(50 + i, line + "\n" + sentence(i, 5), "h1") for i in range(5)] + [(90, line + "\n" + sentence(90, 5), "h2"), (91, line + "\n" + sentence(90, 5), "h2")]
    kept = {r["doc_id"]: (r["kept"], r["n_removed_words"]) for r in rows(quality.judge(spark.createDataFrame(docs, "doc_id long, text string, source string"), line_docs=20, line_share=0.01))}
    assert all(kept[i] == (True, 30) for i in range(30)) and all(kept[50 + i] == (False, 30) for i in range(5))
    assert kept[90] == kept[91] == (True, 0)


def test_quality_share_decides_on_small_hosts(spark):
    """With the defaults: over 5 % of a host's distinct texts, and over five of them."""
    line = " ".join(f"menu{i}" for i in range(30))
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    texts = [("all", line + "\n" + own(i, 5 if i < 10 else 40)) for i in range(180)]
    for host, size, holders in (("few", 20, 5), ("six", 20, 6), ("at", 200, 10), ("above", 200, 11)):
        texts += [(host, (line + "\n" if i < holders else "") + own(i, 40)) for i in range(size)]
    texts += [("few", line + "\n" + own(0, 40))] * 3  # copies count once
    docs = [(i, text, host) for i, (host, text) in enumerate(texts)]
    got = collections.defaultdict(collections.Counter)
    for r in rows(quality.judge(spark.createDataFrame(docs, "doc_id long, text string, source string"))):
        got[docs[r["doc_id"]][2]][r["n_removed_words"], r["kept"]] += 1
    assert got["all"] == {(30, True): 170, (30, False): 10}
    assert got["few"] == {(0, True): 23} and got["six"] == {(0, True): 14, (30, True): 6}
    assert got["at"] == {(0, True): 200} and got["above"] == {(0, True): 189, (30, True): 11}


def test_licenses(odd_docs, no_docs, spark):
    mit = licenses.TEMPLATES[2].text
    docs = [(1, f"{sentence(1, 30)}\nLicensed under CC BY-NC 4.0.\n{sentence(2, 30)}"), (2, mit.replace("merge, ", "").replace("free of charge", "free of any charge")), (3, "the license of life"), (4, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (5, None)]
    got = [(r["doc_id"], r["license"]) for r in rows(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))]
    assert sorted(got) == [(1, "CC-BY-NC-4.0"), (2, "MIT"), (4, "Apache-2.0"), (4, "MIT")]
    assert rows(licenses.scan(odd_docs)) == rows(licenses.scan(no_docs)) == []


def test_repeated_licenses(spark):
    """A row per notice for copies one behind the other, whatever stands around them, and for templates of any words."""
    known = licenses.Templates(licenses.TEMPLATES)
    for text in ("Licensed under the MIT License. ", licenses.TEMPLATES[2].text + " ", licenses.TEMPLATES[5].text + " "):
        size = len(licenses.words_of(text))
        for n in (1, 2, 3, 4, 7):
            for before in ("", "some words of the text "):
                got = known.scan(before + text * n + "and more words")
                at = len(before.split())
                assert [(c, f, m) for _, c, f, m in got] == [(1.0, at + i * size, size) for i in range(n)]
    docs = spark.createDataFrame([(1, "GRATIS FÜR ALLE ZWECKE! Gratis für alle Zwecke."), (2, "nichts")], "doc_id long, text string")
    assert [(r["license"], r["first_word"]) for r in rows(licenses.scan(docs, [("own", "Gratis für alle Zwecke")]))] == [("own", 0), ("own", 4)]


def test_patience_alignment():
    pairs = licenses.align("a x b c d".split(), "a b c e d".split())
    assert pairs == [(0, 0), (2, 1), (3, 2), (4, 4)]


def test_mixing(odd_docs, no_docs):
    got = rows(mixing.mix(odd_docs))
    assert len(got) == odd_docs.count()
    per = collections.defaultdict(int)
    taken = collections.defaultdict(int)
    target = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and 0 <= r["taken"] <= 2 * r["size"]
        assert len(r["shards"]) == r["copies"] and all(0 <= s < 8 for s in r["shards"])
        per[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    # water-filling by bisection
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * per[s], mid * weight[s]) for s in per) < 1.5 * sum(per.values()) else (low, mid)
    assert all(target[s] == pytest.approx(min(2 * per[s], high * weight[s]), rel=1e-6) for s in per)
    assert {r["epochs"] for r in got} == {"epochs"}
    again = rows(mixing.mix(odd_docs.repartition(7)))
    key = lambda r: (str(r["doc_id"]), r["taken"], r["shards"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert rows(mixing.mix(no_docs)) == []
    whole = mixing.mixed_documents(odd_docs)
    assert whole.columns == odd_docs.columns and whole.count() == sum(r["copies"] for r in got)


def test_mixing_comes_near(spark):
    docs = [(i, sentence(i, 5 + i % 40), f"s{i % 7}") for i in range(1400)]
    got = rows(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")))
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 10


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><header><p>Site header text</p></header>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site to do things.</p></div>
<div class="content c12"><h1>Head &amp; line</h1><p>First   para with some
words that make it long enough.<!-- hidden --> <b>Bold</b> end.<p>Second para, unclosed, with <i>inline</i> text &copy; here.
<form><p>Your mail</p></form><div class="ad"><p>Buy this now for little money and much joy.</p></div><ul><li>Item one</li><li>Item two</li></ul></div>
<div id="comments"><p>A reader says that this is a long and winding comment about it all.</p></div><aside><p>Aside words.</p></aside><footer><p>Foot &copy;</p></footer></body></html>"""


def test_html(spark):
    want = "Head & line\nFirst para with some words that make it long enough. Bold end.\nSecond para, unclosed, with inline text © here.\nItem one\nItem two"
    other = PAGE.replace("c12", "c99")
    docs = [(1, "http://H.example/a", PAGE), (2, "http://h.example/b", other), (3, "http://h.example/c", None), (4, None, ""), (5, "http://h.example/d", PAGE[: PAGE.index("Item one")]), (1, "http://h.example/a", PAGE)]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in rows(html_text.extract(spark.createDataFrame(docs, "page_id long, url string, html string")))]
    cut = want[: want.index("\nItem one")]
    assert sorted(got) == sorted([(1, want, len(want))] * 2 + [(2, want, len(want)), (3, "", 0), (4, "", 0), (5, cut, len(cut))])
    assert rows(html_text.extract(spark.createDataFrame(docs, "page_id long, url string, html string").where("false"))) == []


def said(page: str) -> list[str]:
    return [x for _, x, _ in html_text.blocks_of(page)]


def test_html_tags():
    assert said("<p title=don't>First text here.</p><p>It's second.</p>") == ["First text here.", "It's second."]
    assert said("<article><div class='entry-header'><h1>Head</h1></div><p class=share-price>Price.</p><div class='share-buttons'>no</div></article>") == ["Head", "Price."]
    assert said("<p>a &lt; b < c</p><a href='x>y' b>z</a><p>n<!-- x > y --!> c</p>") == ["a < b < c", "z", "n"]
    assert said("<script>if(a</b)</scripty></script >ok<br/><P CLASS=A>q<div class=comment-list>r</div><div class=header>s</div>") == ["ok", "q"]
    assert said("<p>kept</p><a href='never closed") == ["kept"] and said("") == [] and said("<") == ["<"]


def test_html_scanner_is_linear():
    import time

    def cost(n: int) -> float:
        began = time.process_time()
        for piece in ('<p a="x', "<p a='\"", "<!-", "<script", "</p <x=", "<a/", "<"):
            html_text.blocks_of(piece * n)
        return time.process_time() - began

    cost(500)
    assert cost(32_000) < 10 * 8 * max(cost(4_000), 0.01)


def test_html_hosts_with_two_templates(spark):
    """Each page is read by the winning path that covers it; ties, clashing columns and null ids are carried."""
    long = " ".join(f"word{i}" for i in range(60))
    one = f"<body><div class=news><p>{long} one.</p></div><div class=box><p>Short teaser text of some length.</p></div></body>"
    two = f"<body><div class=news><p>Short teaser text of some length.</p></div><section class=story><p>{long} two.</p></section></body>"
    docs = [(i, "http://h.example/a", (one, two)[i % 3 == 0], "x") for i in range(30)] + [(None, "http://h.example/b", one, "x")]
    got = rows(html_text.extract(spark.createDataFrame(docs, "page_id long, url string, html string, path string")))
    assert len(got) == 31 and all(r["text"] == f"{long} {'one' if r['page_id'] is None or r['page_id'] % 3 else 'two'}." for r in got)
