"""The pipeline on a small table with planted cases, stage by stage against plain Python."""

import random

import pytest

import corpus_pipeline
from orderloom.llm import decontamination as d
from orderloom.llm.common import new_path, through_table

WORDS = ["".join(random.Random(k).choices(["the", "er", "ing", "wh", "on", "at", "re", "st"], k=3)) + str(k % 7) for k in range(400)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, text(24) + ". " + text(8) + ".") for i in range(12)]
    texts = [text(rng.randint(20, 200)) for _ in range(60)]
    near = texts[0].split()
    near[5] = "other"
    texts += [texts[1], texts[1], " ".join(near), " ".join([texts[2], items[3][1], texts[3]]), items[7][1].upper(), None, "", "123 456 --- 789", "12 / 34"]
    rows = [(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    folder = new_path(spark, "planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r for r in rows}, items


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) * 100 >= 80 * len(a | b)


def test_stages(spark, planted):
    folder, rows, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [sorted(map(tuple, docs.collect()), key=str)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        docs = through_table(out, f"test-{k}")
        found.append([tuple(r) for r in docs.collect()])
    known, distinct, clean, mixed, sharded = found[1:]
    # texts without a letter go; the few documents here calibrate no other rejection
    assert {r[0] for r in known} == {i for i, r in rows.items() if any(c.isalpha() for c in r[1] or "")}
    # the smallest id of each group of linked documents stays
    sets = {r[0]: shingles(r[1]) for r in known}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and alike(sets[i], sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert sorted(r[0] for r in distinct) == sorted(set(group.values())) and len(distinct) == len(known) - 3
    # documents with an item's question and answer go
    bad = set()
    for i, text, *_ in distinct:
        words = d.words_of(text)
        for _, item in items:
            parts = d.question_and_answer(item)
            if all(len(d.grams(p, 5) & d.grams(words, 5)) >= d.OVERLAP * len(d.grams(p, 5)) for p in parts):
                bad.add(i)
    assert bad and {r[0] for r in clean} == {r[0] for r in distinct} - bad
    # the mix has known rows only, and no document more than twice
    assert set(mixed) <= set(clean) and all(mixed.count(r) <= 2 for r in set(mixed))
    # all of the mix is in shards, each with its slots
    assert sorted(r[:5] for r in sharded) == sorted(mixed)
    for shard in {r[5] for r in sharded}:
        slots = sorted(r[6] for r in sharded if r[5] == shard)
        assert 0 <= shard < 40 and slots == list(range(len(slots)))


def test_run_gives_the_same_rows_again(spark, planted):
    folder, _, _ = planted
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert one == two and one


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_run_on_an_empty_table(spark, planted, empty):
    folder, rows, _ = planted
    to = new_path(spark, "empty")
    for name in ("documents", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.limit(0) if name == empty else df).write.parquet(f"{to}/{name}.parquet")
    out = corpus_pipeline.run(spark, to)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    found = {r.doc_id for r in out.collect()}
    assert found <= {i for i, r in rows.items() if any(c.isalpha() for c in r[1] or "")} and bool(found) == (empty == "benchmark")
