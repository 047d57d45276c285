"""Corpus operators against brute force, exact round trips, held-out accuracy, and on awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import decontamination, html_text, language_id, media, mixing, ngram_join, sharding, token_files, toxicity, url_filters
from orderloom.llm.common import new_path, with_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double"
WORDS = [f"w{i}" for i in range(400)]
UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, extra=None):
    rows = [(i, t, None if t is None else "en", ["a", "b", None][i % 3], None, -1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + (extra or []), SCHEMA)


def awkward(spark):
    """Nulls, empty and blank texts, ties and repeats, null ids, clashing columns."""
    same = "the same words stand here twice and again so they are alike"
    return docs_of(spark, [None, "", "  \n\t ", same, same, "x", "é ß \u00a0 İ", "word " * 3000], [(None, same, None, None, None, -1, 0.5), (3, same, "en", "a", 9, -1, 0.5)])


def near_texts(seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, 60))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            out.append(" ".join(own).upper() if rng.random() < 0.3 else "  ".join(own))
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x for x in (t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).translate(UPPER_TO_LOWER).split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    return [(i, len(s), comp[i]) for i, s in enumerate(sets)]


def test_ngram_join_equals_brute_force(spark):
    texts = near_texts()
    got = ngram_join.jaccard_components(docs_of(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(texts)


def test_ngram_join_awkward(spark):
    got = {(r.doc_id, r.n_shingles > 0): r.component_id for r in ngram_join.jaccard_components(awkward(spark)).collect()}
    assert got[4, True] == 3 and got[None, True] == 3 and got[0, False] == 0
    assert ngram_join.jaccard_components(awkward(spark).limit(0)).count() == 0
    kept = ngram_join.distinct_documents(spark, awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == 10 - 3


def test_tree_traversal_loses_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.97], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, rng.integers(30, 80), dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (1, 2, 3, 3000)] + [sets[0], sets[-1]]

    def linked(x, y):
        both = len(np.intersect1d(x, y))
        return 100 * both >= 80 * (len(x) + len(y) - both)

    comps = np.arange(len(sets))
    found = {tuple(sorted(p)) for x, y in ngram_join.candidates(np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets], comps, comps) for p in zip(x.tolist(), y.tolist())}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if linked(sets[i], sets[j])}
    assert links and links <= found and len(found) < len(sets) * (len(sets) - 1) // 4
    joins = ngram_join.group_links(sets, comps)
    assert {tuple(sorted(p)) for p in joins} <= links and len(joins) < len(sets)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.v, r.c) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_mixing_targets_and_repeats(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 900))) for _ in range(150)]
    docs = docs_of(spark, texts)
    one = mixing.taken_words(docs).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, mixing.taken_words(docs).collect()))
    total = sum(r["size"] for r in one)
    assert all(r.taken <= 2 * r["size"] for r in one)
    targets = {r.source: r.target for r in one}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total
    for s, t in targets.items():
        assert abs(sum(r.taken for r in one if r.source == s) - t) <= 2 * mixing.BLOCK_WORDS


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("s")).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_mixed_texts_hold_whole_blocks(spark):
    docs = with_rows(docs_of(spark, [" ".join(WORDS[:300]), " ".join(WORDS[:50]), "a b c"]).drop("row"))
    sizes = mixing.document_sizes(docs, "row")
    mixed = mixing.mix(sizes, mixing.source_targets(sizes))
    blocks = mixing.mixed_texts(docs, mixed).collect()
    assert sum(len(b.words) for b in blocks) == mixed.agg(F.sum("words")).first()[0]
    assert all(len(b.words) <= mixing.BLOCK_WORDS for b in blocks)


def test_mixing_awkward(spark):
    got = mixing.taken_words(awkward(spark)).collect()
    assert len(got) == 10 and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.taken_words(awkward(spark).limit(0)).count() == 0


def test_flow_moves_the_fewest_bytes():
    supply, capacity = {0: 100, 1: 50, 2: 10}, {0: 40, 1: 60, 2: 30, 3: 30}
    sent = sharding.min_cost_flow(supply, capacity)
    moved = sum(n for (i, j), n in sent.items() if i != j)
    assert moved == sum(max(0, supply[i] - capacity.get(i, 0)) for i in supply)
    assert all(sum(n for (a, _), n in sent.items() if a == i) == supply[i] for i in supply)
    assert all(sum(n for (_, b), n in sent.items() if b == j) <= capacity[j] for j in capacity)
    with pytest.raises(ValueError):
        sharding.min_cost_flow({0: 2}, {0: 1})


def test_resharding_is_even_and_whole(spark):
    rng = random.Random(2)
    docs = with_rows(docs_of(spark, ["x" * rng.randint(0, 300) for _ in range(3000)]).drop("row"))
    sized, buckets = sharding.old_layout(docs)
    plan, transfers = sharding.plan_moves(sized)
    rows = plan.collect()
    assert len(rows) == 3000 and transfers
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * 316
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    back = sharding.rewrite(docs, plan, buckets, new_path(spark, "shards"))
    assert sorted((r.doc.doc_id, r.doc.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert sharding.sharded_documents(spark, awkward(spark)).count() == 10
    assert sharding.sharded_documents(spark, awkward(spark).limit(0)).count() == 0


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.tokenizer_path())
    texts = ["It's a test.", "", None, "A,%%% b... c.. d.,", "İstanbul ΣΑΣ é e\u0301", "x<|endoftext|>y", "tab\tand\nline\u00a0end", "123 4.5", "don't won't."]
    docs = docs_of(spark, texts)
    to = new_path(spark, "tokens")
    token_files.write_tokens(docs, to, tasks=2)
    got = sorted(token_files.with_starts(token_files.token_digests(token_files.read_tokens(spark, to))).collect(), key=lambda r: r.doc_id)
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].doc_id, got[i].start, got[i].n_tokens, got[i].ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)


def test_media_round_trip(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all() and (media.decode(media.encode_ppm(image)) == image).all()
    assert (media.decode(media.encode_ppm(image[:, :, 0])) == image[:, :, 0]).all()
    assert np.allclose(media.resize(image, 7, 5), image) and np.allclose(media.resize(image, 1, 1), image.mean((0, 1)))
    with pytest.raises(ValueError):
        media.decode(b"P6\n9 9\n255\n")
    got = media.image_features(media.text_images(awkward(spark), "bmp")).collect()
    assert len(got) == 10 and all(r.payload_bytes % 192 == 0 and r.payload_bytes > 0 for r in got)
    assert media.image_features(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).first().media_sha256 is None


def test_urls(spark):
    urls = ["http://Example.ORG/es/x", "https://a.example.org/en/12#top", "x://b.com/fr/", "http://b.com/de/1?q", "http://b.net/de/", "http://org", None, "no scheme/org/", "http://xorg/", "http://b.com/DE/"]
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.verdict) for r in url_filters.judge(pages, rules).orderBy("page_id").collect()]
    block, allow = "block", "allow"
    assert got == [("example.org/es/", block), ("example.org/en/1", block), ("com/fr/", allow), ("com/de/", block), (None, allow), (None, allow), (None, allow), (None, allow), (None, allow), (None, allow)]
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_very_long_urls(spark):
    labels, path = "a." * 100_000, "/de/" + "x" * 1_000_000
    urls = [f"http://{labels}example.org/en/1{path}?q", f"http://{labels}com{path}", "http://" + "b" * 1_000_000 + ".net/", "s" * 1_000_000, "x" * 500_000 + "://ORG/", f"http://{labels}", "http://com./de/"]
    rules = spark.createDataFrame([*url_filters.RULES, ("block", "c.d.example.org", ""), ("block", None, "/")], "verdict string, host string, path string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judge(pages, rules).orderBy("page_id").select("rule", "verdict", F.length("host").alias("h"), F.length("path").alias("p")).collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.org/en/1", "block"), ("com/de/", "block"), (None, "allow"), (None, "allow"), ("org/", "allow"), (None, "allow"), (None, "allow")]
    assert [(r.h, r.p) for r in got] == [(200_011, 1_000_009), (200_003, 1_000_004), (1_000_004, 1), (0, 0), (3, 1), (200_000, 0), (4, 4)]
    urls = [f"http://{'.'.join(x)}/{y}" for x in (["c", "d", "example", "org"], ["x", "c", "d", "example", "org"], ["d", "example", "org"], ["xc", "d", "example", "org"]) for y in ("", "es/")]
    got = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [r.rule for r in got] == ["c.d.example.org", "c.d.example.org", "c.d.example.org", "c.d.example.org", "org/", "example.org/es/", "org/", "example.org/es/"]
    assert [r.rule for r in url_filters.judge(pages, rules.limit(0)).collect()] == [None] * 7


def test_words_and_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(4)
    words = ["a", "Bc", "é" * 5, "x" * 20, "X" * 20, "日本語" * 9, "y" * 70, "y" * 71]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t  "]) * rng.randint(0, 2) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "   ", "z" * 50]
    whole = ngram_join.shingle_sets(texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(ngram_join, "PIECE", size)
        assert all((a == b).all() if len(a) == len(b) else False for a, b in zip(whole, ngram_join.shingle_sets(texts), strict=True))
    monkeypatch.undo()
    long = " ".join(f"w{i}" for i in range(400_000))  # some 2.7 MB
    word = "q" * (3 << 20)
    texts = [long, long + " end", word, word.upper(), word + "r", f"a b {word} c d", f"a b {word} c e", "a b c d"]
    got = sorted(map(tuple, ngram_join.jaccard_components(docs_of(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == [(0, 399_996, 0), (1, 399_997, 0), (2, 1, 2), (3, 1, 2), (4, 1, 4), (5, 1, 5), (6, 1, 6), (7, 1, 7)]


def test_language_id(spark):
    rng = random.Random(4)
    make = lambda parts: " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(40))
    rows = [(i, make(["the", "er", "ing", "wh"]) if i % 2 else make(["que", "ción", "ado", "ll"]), "en" if i % 2 else "es") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    odd = language_id.predict(awkward(spark), model, ["doc_id"]).collect()
    assert sum(r.lang_pred == "und" for r in odd) == 3 and all(0 <= r.score <= 1 for r in odd)
    nothing = language_id.train(docs.limit(0))
    assert language_id.predict(docs, nothing, ["doc_id"]).first().lang_pred == "und"
    assert language_id.known_language(spark, docs.withColumn("score", F.lit(1))).count() == 120


def test_decontamination(spark):
    rng = random.Random(6)
    items = [" ".join(rng.choices(WORDS, k=30)) + ". " + " ".join(rng.choices(WORDS, k=8)) + "." for _ in range(40)]
    texts = [" ".join(rng.choices(WORDS, k=300)) for _ in range(30)]
    texts[3] = texts[3] + " " + items[5] + " " + texts[4]
    texts[7] = items[9].upper()
    docs = docs_of(spark, texts + [None, ""])
    table = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, table).collect()}
    assert got == {(3, 5), (7, 9)}
    assert decontamination.contaminated(docs, table.limit(0)).count() == 0


def test_block_max_finds_what_full_scoring_finds():
    rng = random.Random(8)
    index = decontamination.Index([(i, " ".join(rng.choices(WORDS, k=20))) for i in range(70)])
    for _ in range(50):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), 60)))
        scores = np.zeros(len(index.items))
        for t in terms:
            for k in range(index.offsets[t], index.offsets[t + 1]):
                scores[index.posting_items[k]] += index.impacts[k]
        assert [i for i, _ in index.search(terms)] == [i for i in range(70) if scores[i] >= index.threshold[i]]


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        words = rng.choices(WORDS, k=60) + (rng.choices(["idiot", "moron", "scum"], k=4) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels[:200] + [(7, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.train_chain(docs, marks)).collect()}
    assert sum(got[i] == bool(t) for i, _, t in labels) >= 297
    assert toxicity.score(docs, toxicity.train_chain(docs, marks.limit(0))).where("toxic").count() == 0


def test_partial_and_long_copies_are_retrieved(spark):
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(3000)]

    def item(n):  # the rare words are at both ends, where excerpts lack them
        q, a = n * 2 // 3, n // 3
        question = [rng.choice(rare if i < 0.35 * q else common) for i in range(q)]
        return question, [rng.choice(rare if i > 0.65 * a else common) for i in range(a)]

    items = [item(n) for n in [30] * 20 + [50] * 20 + [120] * 10 + [300] * 10]
    table = [(i, " ".join(q) + ". " + " ".join(a)) for i, (q, a) in enumerate(items)]
    docs, want = [], set()
    for i, (q, a) in enumerate(items):
        q_grams, a_grams = decontamination.grams(q, 5), decontamination.grams(a, 5)
        b = max(b for b in range(len(q)) if len(decontamination.grams(q[b:], 5)) >= 0.6 * len(q_grams))
        e = min(e for e in range(len(a) + 1) if len(decontamination.grams(a[:e], 5)) >= 0.6 * len(a_grams))
        for part in (q[b:] + a[:e], q + a):
            noise = [f"n{rng.randrange(9)}" for _ in range(rng.randrange(100))]
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(noise + part + noise)))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(table, "item_id long, text string"))
    assert want <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_language_model_keeps_rare_ngrams_and_small_languages(spark, monkeypatch):
    rng = random.Random(9)
    texts = [("en", " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60))) for _ in range(20)] + [("xx", "abcab zzz abd")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "PART_ROWS", 500, raising=False)
    monkeypatch.setattr(language_id, "MODEL_NGRAMS", 200, raising=False)  # where there is a cap, it binds
    model = language_id.train(docs)
    assert model.langs == ["en", "xx"]
    windows = [w for word in ("abcab", "zzz", "hgq", "abdabd") for w in language_id.word_windows([word])[0].tolist()]
    for column, lang in enumerate(model.langs):
        counts = {}
        for own, t in texts:
            for word in t.split() if own == lang else []:
                for w in language_id.word_windows([word])[0].tolist():
                    counts[w] = counts.get(w, 0) + 1
        p = dict.fromkeys(windows, 1 / (language_id.CHARS + 2))
        orders = {5: counts}
        for k in (4, 3, 2, 1):
            shorter = {}
            for w in orders[k + 1]:
                w &= (1 << 12 * k) - 1
                shorter[w] = shorter.get(w, 0) + 1
            orders[k] = shorter
        for k in (1, 2, 3, 4, 5):
            n = list(orders[k].values())
            d = min(max(n.count(1) / max(n.count(1) + 2 * n.count(2), 1), 0.1), 0.9)
            for w in p:
                own = w & ((1 << 12 * k) - 1)
                same = [x for g, x in orders[k].items() if g >> 12 == own >> 12]
                if same:
                    p[w] = (max(orders[k].get(own, 0) - d, 0) + d * len(same) * p[w]) / sum(same)
        assert np.allclose(model.log_probabilities(np.array(windows))[:, column], [np.log(p[w]) for w in windows])


def test_mixed_documents_meet_targets_whatever_the_length(spark):
    rows = [(10_000 * s + i, " ".join(["w"] * n), name) for s, (name, many, n) in enumerate([("a", 1800, 100), ("b", 1800, 100), ("c", 300, 600)]) for i in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(spark, docs).collect()
    assert sorted(out) == sorted(mixing.mixed_documents(spark, docs).collect())
    targets = {r.source: float(r.target) for r in mixing.source_targets(mixing.document_sizes(docs)).collect()}
    got = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in targets}
    assert all(0.9 <= got[s] / t <= 1.1 for s, t in targets.items()), (got, targets)
