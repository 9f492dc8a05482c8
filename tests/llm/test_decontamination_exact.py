"""Items told again without their rarest words, and that clean text isn't taken for a leak."""

import random

from tidemark.llm import decontaminate

COMMON = [f"common{i}" for i in range(60)]


def case(replaced: int, seed: int = 5, items: int = 40):
    """Items of 24 common and 6 rare words, told again with some rare words replaced, among other text of common words."""
    r = random.Random(seed)
    bench, docs = [], []
    for i in range(items):
        words = r.sample(COMMON, 24) + [f"rare{i}x{k}" for k in range(6)]
        r.shuffle(words)
        bench.append((i, " ".join(words)))
        gone = set(r.sample([w for w in words if w.startswith("rare")], replaced))
        told = [f"new{r.randint(0, 10**6)}" if w in gone else w for w in words]
        filler = lambda n: [f"filler{r.randint(0, 3000)}" if r.random() < 0.5 else r.choice(COMMON) for _ in range(n)]
        docs.append((i, " ".join(filler(r.randint(5, 90)) + told + filler(r.randint(5, 90)))))
        docs.append((1000 + i, " ".join(filler(150))))
    return docs, bench


def test_items_without_their_rare_words_are_found(spark):
    for replaced in (0, 5, 6):
        docs, bench = case(replaced)
        got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
        found = {(r.doc_id, r.item_id) for r in got if r.kind == "verbatim"}
        assert {(i, i) for i in range(40)} <= found, replaced
        own = decontaminate.read_block([{"item_id": i, "text": t} for i, t in bench])
        number = lambda text: [own.vocabulary.get(w, 0) for w in text.split()]
        texts, items = dict(docs), {x.item_id: x.words for x in own.items}
        for d, i in found:  # each leak is one by brute force; clean documents have none
            assert d < 1000 or decontaminate.common_subsequence(items[i], number(texts[d])) >= 0.8 * 30
        assert len([d for d, _ in found if d >= 1000]) == 0

