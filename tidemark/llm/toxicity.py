"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is logistic in the words and word beginnings it holds; a document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only document labels are needed to train it, and the sentence scores then locate the
offending sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, held_out, in_worker

#: Labelled documents that the model is fitted on, at most; hashed features; rounds of training.
TRAIN_DOCS, FEATURES, ROUNDS = 8_000, 1 << 18, 300
#: Features in fewer training documents, or not this many standard deviations more often in toxic ones than at random,
#: are dropped: they would only learn single documents by heart.
MIN_DOCS, MIN_SIGMAS = 4, 5.0
THRESHOLD = 0.7
SENTENCE, WORD = re.compile(r"[.!?\n]+"), re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its first four and five letters."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in ([word, f"^{word[:4]}", f"^{word[:5]}"] if len(word) > 5 else [word, f"^{word[:4]}"] if len(word) > 3 else [word])]


@dataclass
class Model:
    bias: float
    ids: np.ndarray
    weights: np.ndarray


class Weights(dict):
    """Weight of each word, worked out at first sight."""

    def __init__(self, model: Model):
        super().__init__()
        self.table = np.zeros(FEATURES)
        self.table[model.ids] = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = w = float(self.table[features(word)].sum())
        return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Noisy-or likelihood by Adagrad over all given documents, with a small L2 penalty."""
    own: dict[str, list[int]] = {}
    cols, sent, doc_of = [], [], []
    for d, text in enumerate(texts):
        for s in SENTENCE.split(text.lower()):
            words = set(WORD.findall(s))
            if words:
                hashed = {x for w in words for x in (own.get(w) or own.setdefault(w, features(w)))}
                cols += hashed
                sent += [len(doc_of)] * len(hashed)
                doc_of.append(d)
    cols, sent, doc_of = np.array(cols, np.int32), np.array(sent, np.int32), np.array(doc_of, np.int32)
    y = labels.astype(bool)
    seen = np.unique(doc_of[sent].astype(np.int64) * FEATURES + cols) if len(cols) else np.zeros(0, np.int64)
    every = np.bincount(seen % FEATURES, minlength=FEATURES)
    toxic = np.bincount((seen % FEATURES)[y[seen // FEATURES]], minlength=FEATURES)
    expected = every * y.mean() if len(y) else every
    common = np.flatnonzero((every >= MIN_DOCS) & (toxic - expected >= MIN_SIGMAS * np.sqrt(np.maximum(expected, 1e-9))))
    place = np.full(FEATURES, -1, np.int32)
    place[common] = np.arange(len(common))
    used = place[cols] >= 0
    cols, sent = place[cols[used]], sent[used]
    w, b = np.zeros(len(common)), -5.0
    gw, gb = np.full(len(common), 1e-6), 1e-6
    for _ in range(ROUNDS if len(doc_of) and y.any() and not y.all() else 0):
        p = sigmoid(b + np.bincount(sent, w[cols], len(doc_of)))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(texts)))
        pull = np.where(y, -clean / np.maximum(1 - clean, 1e-6), 1.0)[doc_of] * p
        step_w = np.bincount(cols, pull[sent], len(common)) + 0.02 * w
        step_b = pull.sum()
        gw += step_w**2
        gb += step_b**2
        w -= 0.5 * step_w / np.sqrt(gw)
        b -= 0.2 * step_b / np.sqrt(gb)
    return Model(float(b), common.astype(np.int32), w)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most about TRAIN_DOCS labelled documents outside the held-out third, drawn by a hash of doc_id. The
    sample is bounded, so one task fits the model and only weights reach the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = TRAIN_DOCS / max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"), "doc_id", "toxic")  # bounded by TRAIN_DOCS
    rows = rows.dropDuplicates(["doc_id", "h"]).withColumn("one", F.lit(0))

    def train(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "h"])
        m = fit(f["text"].tolist(), f["toxic"].to_numpy() > 0)
        return pd.DataFrame({"bias": [m.bias], "ids": [m.ids.tobytes()], "weights": [m.weights.tobytes()]})

    got = rows.groupBy("one").applyInPandas(train, "bias double, ids binary, weights binary").collect()
    if not got:
        return Model(-5.0, np.zeros(0, np.int32), np.zeros(0))
    return Model(got[0]["bias"], np.frombuffer(got[0]["ids"], np.int32), np.frombuffer(got[0]["weights"], np.float64))


def ready(model: Model) -> Weights:
    """The words' weights of one model per Python worker."""
    return in_worker(("toxicity", model.bias, len(model.ids), float(model.weights.sum())), lambda: Weights(model))


def score_text(text: str, weights: Weights, bias: float) -> tuple[float, int, float, str]:
    """Document score, number of offending sentences (over one half), the worst sentence's score and text."""
    sentences = SENTENCE.split(text)
    z = np.array([sum(map(weights.__getitem__, set(WORD.findall(s.lower())))) for s in sentences])
    some = np.array([bool(s.strip()) for s in sentences])
    p = np.where(some, sigmoid(z + bias), 0.0)
    worst = int(p.argmax())
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), int((p > 0.5).sum()), float(p[worst]), sentences[worst].strip() if p[worst] > 0.5 else ""


def judge(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, worst_score, worst_sentence (empty if none is over one half).

    Null or empty text: score 0. A very long text is scored whole, sentence by sentence. A document with several labels is
    toxic if one of them is; of equally bad sentences the first is named. Without positive and negative labels the model is its bias. Repeated rows score alike;
    a null doc_id isn't held out; an empty table gives no rows; further columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    model = model or learn(docs, labels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = ready(model)
        for f in frames:
            out = pd.DataFrame([score_text(t, weights, model.bias) for t in f["text"]], columns=["score", "n_offending", "worst_score", "worst_sentence"])
            out.insert(0, "doc_id", f["doc_id"].to_numpy())
            out.insert(1, "held_out", f["held_out"].to_numpy())
            out.insert(3, "predicted", (out["score"] >= THRESHOLD).astype(int))
            yield out

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, n_offending int, worst_score double, worst_sentence string")
