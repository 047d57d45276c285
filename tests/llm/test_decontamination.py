"""Decontamination: every retrieved passage is verified, items repeat, chunks agree, bounds lose nothing."""

import random

import numpy as np

from orderloom.llm import decontamination as d

WORDS = [f"w{i}" for i in range(400)]


def items_of(rng, n, length=30):
    return [" ".join(rng.choices(WORDS, k=length)) + ". " + " ".join(rng.choices(WORDS, k=8)) + "." for _ in range(n)]


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in d.contaminated(docs, table).collect())


def test_a_worse_passage_that_holds_the_item_is_found(spark):
    rng = random.Random(1)
    items = items_of(rng, 20)
    shuffled = items[3].replace(".", "").split()
    rng.shuffle(shuffled)
    noise = [f"n{i}" for i in range(400)]
    text = " ".join([*shuffled, *shuffled, *noise]) + " " + items[3]
    assert [(a, b) for a, b, _ in found(spark, [text], list(enumerate(items)))] == [(0, 3)]


def test_equal_items_are_each_reported_and_chunks_do_not_matter(spark, monkeypatch):
    rng = random.Random(2)
    items = items_of(rng, 20)
    table = list(enumerate(items)) + [(100 + i, items[5]) for i in range(25)]
    texts = [" ".join(rng.choices(WORDS, k=200)) for _ in range(6)]
    texts[2] += " " + items[5] + " " + texts[3]
    texts[4] = items[11]
    texts[5] = (texts[5] + " ") * 400 + items[7]  # very long
    whole = found(spark, texts, table)
    assert {(a, b) for a, b, _ in whole} == {(2, 5), (4, 11), (5, 7)} | {(2, 100 + i) for i in range(25)}
    monkeypatch.setattr(d, "ITEM_CHUNK", 3)
    assert found(spark, texts, table) == whole


def test_repeated_documents_give_repeated_rows(spark):
    rng = random.Random(3)
    items = items_of(rng, 5)
    docs = spark.createDataFrame([(7, items[1], 0.0, "x")] * 3 + [(None, items[1], 0.0, "x")], "doc_id long, text string, score double, item_id string")
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in d.contaminated(docs, table).collect())
    assert got == [(-1, 1), (7, 1), (7, 1), (7, 1)]


def test_matches_finds_what_scoring_every_passage_finds():
    rng = random.Random(4)
    items = items_of(rng, 80)
    index = d.Index(list(enumerate(items)))
    memory = d.Memory(index.terms)
    hits = 0
    for _ in range(120):
        words = rng.choices(WORDS, k=rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):  # whole, partial and altered copies
            own = [w.strip(".") for w in rng.choice(items).split()]
            own = own[rng.randint(0, 6) : len(own) - rng.randint(0, 3)]
            own = [rng.choice(WORDS) if rng.random() < 0.03 else w for w in own]
            at = rng.randint(0, len(words))
            words[at:at] = own
        want = {}
        for a in range(0, len(words), d.STRIDE):
            terms = np.unique([index.terms[w] for w in words[a : a + d.PASSAGE_WORDS] if w in index.terms])
            scores = np.zeros(len(index.items))
            for t in terms:
                scores[index.posting_items[index.offsets[t] : index.offsets[t + 1]]] += index.impacts[index.offsets[t] : index.offsets[t + 1]]
            for i in np.flatnonzero(scores >= index.threshold).tolist():
                question, answer = index.parts[i]
                reach = len(question) + len(answer)
                near = words[max(0, a - reach) : a + d.PASSAGE_WORDS + reach]
                if all(len(d.grams(p, 5) & d.grams(near, 5)) >= d.OVERLAP * len(d.grams(p, 5)) for p in (question, answer)):
                    want[i] = max(want.get(i, 0.0), scores[i])
        got = d.matches(index, memory, " ".join(words))
        assert {m[0] for m in got} >= set(want)
        hits += len(want)
    assert hits > 40
