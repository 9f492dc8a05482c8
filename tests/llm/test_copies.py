"""The n-gram join on copies that share a doc_id, as the pipeline has them, and on groups longer than a column may be."""

import numpy as np

from tidemark.llm import ngram_join

from .conftest import sentence
from .test_operators import brute_components


def test_copies_are_joined_once_and_components_not_again(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 6)
    rng, base, docs = np.random.default_rng(5), [sentence(s, 90).split() for s in (1, 2)], []
    for i in range(80):
        w = list(base[i % 2])
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = f"edit{int(rng.integers(0, 12))}"
        docs.append((i + 1, " ".join(w)))
    seen, calls, find, verify = [], [], ngram_join.link_candidates, ngram_join.verified

    def find_in(bodies, *more):
        seen.extend(r["rep"] for r in bodies.select("rep").collect())
        return find(bodies, *more)

    def verify_in(pairs, *more):
        told = verify(pairs, *more)
        calls.append([(r["a"], r["b"], r["near"]) for r in told.collect()])
        return told

    monkeypatch.setattr(ngram_join, "link_candidates", find_in)
    monkeypatch.setattr(ngram_join, "verified", verify_in)
    rows = ngram_join.join(spark.createDataFrame(docs * 3, "doc_id long, text string")).collect()
    assert len(rows) == 240 and {r["doc_id"]: r["component_id"] for r in rows} == brute_components(docs)
    assert len(seen) == len(set(seen))
    first, second = calls
    label = {r: r for r in seen}
    for _ in seen:
        for a, b, near in first:
            if near:
                label[a] = label[b] = min(label[a], label[b])
    assert not [(a, b) for a, b, _ in second if label[a] == label[b]]
