"""Language ID of mixed-language text: script ranges narrow the candidates of each word, character trigrams score them,
and Viterbi with a switching penalty labels spans.

The model is learned from labelled texts: at most TRAIN_DOCS documents per language (by a hash of doc_id), whose
trigrams are counted by Spark; each language keeps its GRAMS most frequent ones.

A word is a run of letters of one script range, scored whole. Scripts that don't part words by spaces are cut into units
of UNIT letters, so that a long run can change its language inside.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, held_out, in_worker

#: Documents that the model is fitted on, per language, and trigrams that each language keeps.
TRAIN_DOCS, GRAMS = 2_000, 20_000
#: Log-odds that another language must gain over a span before a switch pays.
SWITCH = 12.0
#: A script is a candidate script of a language when it holds this share of the language's words.
SCRIPT_SHARE = 0.005
#: Letters of a unit in scripts without spaces, and scores (words by languages) that a worker remembers.
UNIT, REMEMBERED = 8, 1_000_000

# First code points of Unicode script ranges (Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai
# to Myanmar, Georgian, Hangul Jamo, Ethiopic and others, Khmer, Mongolian and others, further Latin and Greek, kana,
# Han, Hangul, rest), and those of the ranges whose words aren't parted by spaces.
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x3040, 0x3100, 0xAC00, 0xD7B0)
UNSPACED = (0xE00, 0x1780, 0x3040, 0x3100)


def script(word: str) -> int:
    return bisect_right(SCRIPT_STARTS, ord(word[0])) - 1


@lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a word in Latin-1 text, and in any text."""
    runs: dict[int, list[str]] = {}
    for (k, _), letters in groupby(((bisect_right(SCRIPT_STARTS, c) - 1, c) for c in range(sys.maxunicode + 1) if chr(c).isalpha()), key=run_key()):
        run = [c for _, c in letters]
        runs.setdefault(k, []).append(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}")
    some = [f"[{''.join(r)}]" + (f"{{1,{UNIT}}}" if SCRIPT_STARTS[k] in UNSPACED else "+") for k, r in sorted(runs.items())]
    return re.compile(some[0]), re.compile("|".join(some))


def run_key():
    """Groups (script, code point) pairs into runs of consecutive code points of one script."""
    last = [-1, -2, 0]

    def key(x: tuple[int, int]) -> tuple[int, int]:
        if x[0] != last[0] or x[1] != last[1] + 1:
            last[2] += 1
        last[:2] = x
        return x[0], last[2]

    return key


def words_of(text: str) -> list[str]:
    """Lower-case words of a text."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return patterns()[1].findall(text)
    return patterns()[0].findall(text)


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]
    #: Log-probabilities, a row per gram and a last row for unknown grams.
    table: np.ndarray
    #: Per script the penalty of each language.
    scripts: dict[int, np.ndarray]
    words: dict[str, int] = field(default_factory=dict)
    scored: np.ndarray | None = None


def sample(docs: DataFrame) -> DataFrame:
    """text and lang of the training documents, about TRAIN_DOCS of each language at most."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().withColumn("_share", F.lit(float(TRAIN_DOCS)) / F.col("count"))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return labelled.select("doc_id", "lang", "text").join(F.broadcast(sizes.select("lang", "_share")), "lang").where(draw < F.col("_share")).select("lang", "text")  # one row per language


def learn(docs: DataFrame) -> Model:
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, texts in f.groupby("lang")["text"]:
                words = Counter(w for t in texts for w in words_of(t))
                grams: Counter = Counter()
                scripts: Counter = Counter()
                for w, n in words.items():
                    scripts[f"\x00{script(w)}"] += n
                    padded = f" {w} "
                    for i in range(len(padded) - 2):
                        grams[padded[i : i + 3]] += n
                for seen in (grams, scripts):
                    yield pd.DataFrame({"lang": lang, "gram": list(seen), "n": list(seen.values())})

    counted = sample(docs).mapInPandas(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc(F.col("gram").startswith("\x00")), F.desc("n"), "gram")
    ranked = counted.withColumn("_rank", F.row_number().over(best))
    per_gram = ranked.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"), F.min("_rank").alias("_rank"))
    top = per_gram.where(F.col("_rank") <= GRAMS).orderBy("gram").select("gram", "n").collect()  # at most GRAMS per language
    langs = sorted({x for r in top for x in r["n"]})
    if not langs:
        return Model([], {}, np.zeros((1, 0)), {})
    at = {x: i for i, x in enumerate(langs)}
    counts, grams, scripts = [], {}, {}
    for r in top:
        row = np.zeros(len(langs))
        for x, n in r["n"].items():
            row[at[x]] = n
        if r["gram"][0] == "\x00":
            scripts[int(r["gram"][1:])] = row
        else:
            grams[r["gram"]] = len(counts)
            counts.append(row)
    n = np.array([*counts, np.zeros(len(langs))]).reshape(-1, len(langs)) + 0.3
    table = np.log(n / n.sum(0))
    table -= table.max(1, keepdims=True)
    words = sum(scripts.values(), np.zeros(len(langs)))
    return Model(langs, grams, table, {s: np.where(row >= SCRIPT_SHARE * np.maximum(words, 1), 0.0, -20.0) for s, row in scripts.items()})


def score_new(model: Model, words: list[str]) -> np.ndarray:
    """Log-score of each word in each language, within the candidates of its script."""
    unknown, grams, get = len(model.grams), [], model.grams.get
    starts = []
    for w in words:
        padded = f" {w} "
        starts.append(len(grams))
        grams += [get(padded[i : i + 3], unknown) for i in range(len(padded) - 2)]
    out = np.add.reduceat(model.table[grams], starts, axis=0)
    blank = np.zeros(len(model.langs))
    mask = np.array([model.scripts.get(script(w), blank) for w in words])
    mask[(mask < 0).all(1)] = 0
    return out + mask


class Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def viterbi(scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best labelling of each document (words x languages) when a change of language costs SWITCH. Documents advance
    together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    langs = scores[0].shape[1]
    best = np.array([scores[i][0] for i in order])
    back = [np.zeros((len(order), langs), np.int16)]
    stacked = np.concatenate([scores[i] for i in order])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for step in range(1, lengths[0]):
        live = int(np.searchsorted(-lengths, -step, side="left"))
        top = best[:live].argmax(1)
        jump = best[np.arange(live), top][:, None] - SWITCH
        stay = best[:live] >= jump
        back.append(np.where(stay, np.arange(langs), top[:, None]).astype(np.int16))
        best[:live] = np.where(stay, best[:live], jump) + stacked[first[:live] + step]
    out: list = [None] * len(scores)
    for k, i in enumerate(order):
        labels = np.empty(lengths[k], np.int16)
        labels[-1] = best[k].argmax()
        for step in range(lengths[k] - 1, 0, -1):
            labels[step - 1] = back[step][k, labels[step]]
        out[i] = labels
    return out


def label(model: Model, texts: list[str]) -> list[tuple[str, float, list]]:
    """(language, share of the words that carry it, spans) per text."""
    if model.scored is None or len(model.words) * len(model.langs) > REMEMBERED:
        model.words, model.scored = Numbers(), np.zeros((0, len(model.langs)))
    known = model.words
    ids, ends = [], []
    for t in texts:
        ids += map(known.__getitem__, words_of(t))
        ends.append(len(ids))
    if len(known) > len(model.scored):
        new = list(known)[len(model.scored) :]
        model.scored = np.concatenate([model.scored, score_new(model, new)])
    every = model.scored[np.array(ids, np.int64)] if ids else np.zeros((0, len(model.langs)))
    out: list = [("und", 0.0, [])] * len(texts)
    mixed, start = [], 0
    for i, end in enumerate(ends):
        if end > start and model.langs:
            own = every[start:end]
            top = int(own.sum(0).argmax())
            # what leaving the best language gains, at most, over any run of words
            gain = np.concatenate([[0.0], np.cumsum(own.max(1) - own[:, top])])
            other = np.concatenate([[0.0], np.cumsum(np.delete(own, top, 1).max(1) - own[:, top])]) if len(model.langs) > 1 else -gain
            if (other - np.minimum.accumulate(other)).max() <= SWITCH:
                out[i] = (model.langs[top], 1.0, [(model.langs[top], 0, end - start)])
            else:
                mixed.append((i, own))
        start = end
    if mixed:
        for (i, _), labels in zip(mixed, viterbi([own for _, own in mixed]), strict=True):
            cuts = np.flatnonzero(np.diff(labels)) + 1
            edges = [0, *cuts.tolist(), len(labels)]
            spans = [(model.langs[labels[a]], a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
            counts = np.bincount(labels, minlength=len(model.langs))
            top = int(counts.argmax())
            out[i] = (model.langs[top], float(counts[top] / len(labels)), spans)
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of docs, plus held_out, lang_pred, score, spans (lang, first word, words).

    lang_pred is the label of most words, score its share of words. Text that is null or has no letter: `und`, 0, no
    spans; so is every text if there is nothing to learn from. A very long text is labelled whole. Equal shares go to
    the language first in order of name. Repeated rows are labelled alike; a null doc_id isn't held out; an empty table
    gives no rows; the result's names win over columns of the same name.
    """
    bounded_batches(docs.sparkSession)
    model = model or learn(docs)
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "spans", "_found")]

    @F.pandas_udf("lang_pred string, score double, spans array<struct<lang: string, first: int, words: int>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows: list = []
        for i in range(0, len(texts), 500):
            rows += label(shared(model), [t or "" for t in texts.iloc[i : i + 500]])
        return pd.DataFrame(rows, columns=["lang_pred", "score", "spans"]).assign(spans=[[{"lang": a, "first": b, "words": c} for a, b, c in r[2]] for r in rows])

    return docs.select(*kept, held_out(F.col("doc_id")).alias("held_out"), found(F.coalesce("text", F.lit(""))).alias("_found")).select(*kept, "held_out", "_found.*")


def shared(model: Model) -> Model:
    """One model per Python worker, so that the words it has scored last from batch to batch."""
    return in_worker(("langid", tuple(model.langs), len(model.grams), float(model.table.sum())), lambda: model)
