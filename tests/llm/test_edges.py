"""Awkward rows, and results against plain Python, for toxicity, URL filters, media, token files and mixing."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from orderloom.llm import media, mixing, token_files, toxicity, url_filters
from orderloom.llm.common import new_path, with_rows

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(WORDS, k=60) + (rng.choices(["idiot", "moron", "scum"], k=4) if i % 4 == 0 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_awkward_rows(spark, toxic):
    docs, labels = toxic
    model = toxicity.train_chain(docs, labels.union(spark.createDataFrame([(None, 1, 1), (500, None, 1)], labels.schema)))
    odd = [(1, None, 0.5), (1, "", 0.5), (1, "  \n ", 0.5), (None, "idiot scum " * 3, 0.5), (2, "idiot scum " * 3, 0.5), (3, "w1 w2 " * 200_000 + "moron idiot scum idiot", 0.5)]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string, p_toxic double"), model).collect()
    assert got[0][1:] == got[1][1:] == got[2][1:] and got[3][1:] == got[4][1:] and got[3].toxic and got[0].p_toxic < got[3].p_toxic
    assert len(got) == 6 and toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_equals_plain_python(spark, toxic):
    docs, labels = toxic
    model = toxicity.train_chain(docs, labels)
    for r, (_, text) in zip(toxicity.score(docs, model).orderBy("doc_id").collect(), sorted(map(tuple, docs.collect())), strict=True):
        x = np.zeros(len(model.features))
        for w in text.split():
            for f in toxicity.features_of_word(w):
                if f in model.features:
                    x[model.features.index(f)] += 1
        x = np.log1p(x)
        for w, p in zip(model.weights, (r.p_quality, r.p_toxic), strict=True):
            own = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
            assert abs(own - p) < 1e-6
            x = np.append(x, own)


def test_training_sample_is_bounded_when_ids_repeat(spark, toxic, monkeypatch):
    docs, labels = toxic
    many = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text"))
    seen = []
    fit = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, *a: seen.append(len(x)) or fit(x, *a))
    toxicity.train_chain(many, labels, most=100)
    assert seen == [100]


def test_equal_rules_block_and_names_do_not_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "p", "r", "v"), (None, "http://a.org/x", "h", "p", "r", "v")], "page_id long, url string, host string, path string, rule string, verdict string")
    for rules in ([("allow", "org", "/x"), ("block", "org", "/x")], [("block", "org", "/x"), ("allow", "org", "/x")]):
        out = url_filters.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
        assert out.columns == [*pages.columns, "host_", "path_", "rule_", "verdict_"]
        assert [r[2:] for r in out.collect()] == [("h", "p", "r", "v", "a.org", "/x", "org/x", "block")] * 2


def test_media_digests_equal_plain_python(spark):
    texts = [None, "", "x", "é" * 200, "a" * 192, "b" * 193, "long " * 400_000, "x"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = sorted(media.image_features(media.text_images(docs)).collect())
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert got[2][1:] == got[7][1:]
    assert media.image_features(media.text_images(docs.limit(0))).count() == 0


def test_resize_in_strips_equals_plain_means(monkeypatch):
    monkeypatch.setattr(media, "STRIP", 300)
    rng = np.random.default_rng(2)
    for shape in ((1, 64, 3), (7, 64, 3), (50, 6), (96, 64, 3)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        for height, width in ((16, 16), (1, 1), (3, 5)):
            fine = pixels.repeat(height, 0).repeat(width, 1).astype("f8")  # every pixel as height x width equal ones
            want = fine.reshape(height, shape[0], width, shape[1], *shape[2:]).mean((1, 3))
            assert np.allclose(media.resize(pixels, height, width), want)


def test_token_files_have_stripes_indexes_and_bloom_filters(spark, monkeypatch):
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 100_000)
    monkeypatch.setattr(token_files, "INDEX_ROWS", 1_000)
    rng = random.Random(4)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.sha2((F.col("id") * 7 + k).cast("string"), 256) for k in range(8))).alias("text"))
    to = new_path(spark, "tokens")
    token_files.write_tokens(docs, to, tasks=2)
    files = [f.removeprefix("file://") for f in spark.read.orc(to).inputFiles()]
    metas = [orc.ORCFile(f) for f in files]
    assert len(files) == 2 and all(m.nstripes > 2 for m in metas) and sum(m.nrows for m in metas) == 20_000
    assert all(m.row_index_stride == 1_000 for m in metas)
    # each stripe is a range of ids of its own
    for m in metas:
        ids = [m.read_stripe(k, ["doc_id"]).column(0).to_pylist() for k in range(m.nstripes)]
        assert all(a[-1] < b[0] for a, b in zip(ids, ids[1:], strict=False))
    jvm = spark._jvm
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        columns = spark.sparkContext._gateway.new_array(jvm.boolean, 4)
        columns[0] = columns[1] = True  # the row and doc_id
        index = reader.rows().readRowIndex(0, columns, columns)
        assert index.getRowGroupIndex()[1].getEntryCount() >= 1 and index.getBloomFilterIndex()[1].getBloomFilterCount() >= 1
    # a filter on doc_id reaches the reader, which reads one group of rows
    wanted = rng.randrange(20_000)
    found = token_files.read_tokens(spark, to).where(F.col("doc_id") == wanted)
    plan = found._jdf.queryExecution().executedPlan()
    assert "EqualTo(doc_id" in plan.toString()
    assert [r.doc_id for r in found.collect()] == [wanted]
    assert plan.collectLeaves().head().metrics().apply("numOutputRows").value() <= 2_000


def test_token_files_of_awkward_rows(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.tokenizer_path())
    rng = random.Random(6)
    odd = ["".join(rng.choices("aB1.,'éßΣ \t\n-<|>\u0301\u00a0中", k=rng.randint(0, 30))) for _ in range(400)]
    rows = [(None, "one two", 1), (None, None, 1), (5, "x. y,", 1), (5, "x. y,", 1), (6, "word, " * 100_000, 1)] + [(10 + i, t, 1) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    to = new_path(spark, "tokens")
    token_files.write_tokens(docs, to, tasks=3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, list(r.token_ids)) for r in token_files.read_tokens(spark, to).collect())
    assert got == sorted((-1 if i is None else i, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows)
    starts = sorted((r.start, r.n_tokens) for r in token_files.with_starts(token_files.token_digests(token_files.read_tokens(spark, to))).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    to = new_path(spark, "tokens")
    token_files.write_tokens(docs.limit(0), to, tasks=1)
    assert token_files.read_tokens(spark, to).count() == 0


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(tokenizer):
    coder = token_files.Encoder(token_files.tokenizer_path(tokenizer))
    texts = ["one two.", "A B", None]
    ids, begins = coder.encode(texts, 7)
    assert not coder.by_words
    for k, t in enumerate(texts):
        assert ids[begins[k] : begins[k + 1]].tolist() == [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 7]


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * share > 2 * sizes[s]]
        if not full:
            target |= {s: weight[s] * share for s in free}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_targets_equal_plain_resharing(spark):
    rng = random.Random(7)
    for _ in range(3):
        names = [*(f"s{i}" for i in range(rng.randint(1, 8))), None]
        rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(names) if i % 3 else names[0]) for i in range(80)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(t.split())
        got = {r.source: (r.source_size, float(r.target)) for r in mixing.source_targets(mixing.document_sizes(docs)).collect()}
        want = brute_targets(sizes)
        assert set(got) == set(sizes) and all(got[s][0] == sizes[s] and abs(got[s][1] - want[s]) < 1e-6 for s in sizes)


def test_row_numbers_of_a_table_are_distinct(spark):
    path = new_path(spark, "rows")
    spark.range(1_000).repartition(7).write.parquet(path)
    assert with_rows(spark.read.parquet(path)).select("row").distinct().count() == 1_000
