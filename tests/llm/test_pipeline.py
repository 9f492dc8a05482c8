"""Every stage on odd input, and the pipeline's decisions against its operators' brute force."""

import collections
import os

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm.queries import ORACLES, QUERIES

from .conftest import sentence
from .test_operators import brute_components

SF = "/root/testdata/sf0.001"


def benchmark_dir(spark, tmp_path, docs):
    bench = spark.createDataFrame([(1, "Seven purple elephants quietly repaired the ancient lighthouse before midnight came.")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages_take_odd_input(spark, odd_docs, no_docs, tmp_path):
    where = benchmark_dir(spark, tmp_path, odd_docs)
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, where)
            if name != "token_ids":
                assert out.columns == docs.columns
            assert out.count() <= 2 * docs.count()


def test_run(spark, tmp_path):
    leak = "Seven purple elephants quietly repaired the ancient lighthouse before midnight came."
    docs = [(i, sentence(i, 60), "en", f"s{i % 3}", 1) for i in range(60)]
    docs += [(200, docs[5][1], "en", "s1", 1), (201, docs[6][1] + " more", "en", "s1", 1), (202, sentence(90, 20) + " " + leak, "en", "s0", 1), (203, "123 456", "en", "s0", 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    where = benchmark_dir(spark, tmp_path, table)
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, where).collect())
    parts = brute_components([(d, t) for d, t, *_ in docs])
    kept = {d for d, *_ in docs if d not in (202, 203) and parts[d] == d}
    assert set(got) <= kept and max(got.values()) <= 2
    words = {d: len(t.split()) for d, t, *_ in docs}
    total = sum(words[d] for d in kept)
    assert abs(sum(n * words[d] for d, n in got.items()) - 1.5 * total) <= 0.1 * total


def test_stages_carry_columns_and_judge_rows(spark, tmp_path):
    """Values of clashing columns stay, one of repeated rows stays, and rows without a doc_id are judged like others."""
    leak = "Seven purple elephants quietly repaired the ancient lighthouse before midnight came."
    base = [(i, sentence(i, 40), "en", "s1", "mine", 7) for i in range(30)]
    more = [(3, base[3][1], "en", "s1", "mine", 7)] * 2 + [(None, base[4][1], "en", "s1", "mine", 7), (None, sentence(60, 40), "en", "s1", "mine", 7)] * 2
    more += [(5, sentence(70, 40), "en", "s1", "mine", 7), (None, sentence(80, 30) + " " + leak, "en", "s1", "mine", 7)]
    docs = spark.createDataFrame(base + more, "doc_id long, text string, lang string, source string, score string, held_out long")
    where = benchmark_dir(spark, tmp_path, docs)
    named = dict(corpus_pipeline.STAGES)
    tagged = named["language_id"](spark, docs, where)
    assert tagged.columns == docs.columns and {(r["score"], r["held_out"]) for r in tagged.collect()} == {("mine", 7)}
    left = named["near_duplicates"](spark, docs, where)
    want = sorted([*base, more[3], more[-2], more[-1]], key=str)
    assert sorted([tuple(r) for r in left.collect()], key=str) == want
    clean = named["decontamination"](spark, docs, where)
    assert collections.Counter(map(tuple, clean.collect())) == collections.Counter(base + more[:-1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: v if isinstance(v, str) else int(v)
    key = lambda f: sorted(repr([*map(plain, r)]) for r in f[columns].astype(object).itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES}
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_ids"]
