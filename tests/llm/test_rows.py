"""Row numbers that hold when a table is split into tasks in another way, and columns whose names clash."""

import random
import tempfile
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orderloom.llm import decontamination, language_id, mixing, ngram_join, sharding, token_files
from orderloom.llm.common import CLEANUP, new_path, through_table, with_rows

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60))), rng.choice(["a", "b"])) for i in range(400)]
    path = new_path(spark, "many-files")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(40, "doc_id").write.parquet(path)
    return path


@pytest.fixture
def splits(spark):
    """Several files share a task, as many tasks as are asked for."""
    names = ["spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"]

    def set_to(tasks):
        spark.conf.set(names[0], tasks)
        spark.conf.set(names[1], 1)

    yield set_to
    for name in names:
        spark.conf.unset(name)


def test_rows_do_not_depend_on_the_split(spark, stored, splits):
    found = []
    for tasks in (4, 16):
        splits(tasks)
        found.append({r.doc_id: r.row for r in with_rows(spark.read.parquet(stored)).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) == 400


def test_resharding_writes_all_rows_whatever_the_split(spark, stored, splits):
    splits(4)
    docs = with_rows(spark.read.parquet(stored))
    sized, buckets = sharding.old_layout(docs)
    plan, _ = sharding.plan_moves(sized)
    plan = plan.persist()
    assert plan.count() == 400
    splits(16)
    docs = with_rows(spark.read.parquet(stored))
    back = sharding.rewrite(docs, plan, buckets, new_path(spark, "shards"))
    assert sorted(r.doc.doc_id for r in back.collect()) == list(range(400))
    plan.unpersist()


def test_resharding_refuses_a_plan_of_other_rows(spark, stored):
    docs = with_rows(spark.read.parquet(stored))
    sized, buckets = sharding.old_layout(docs)
    plan, _ = sharding.plan_moves(sized)
    with pytest.raises(RuntimeError):
        sharding.rewrite(docs.where("doc_id < 300"), plan, buckets, new_path(spark, "shards"))


CLASHING = ["row", "file", "file_row", "copies", "times", "copy", "size", "bucket", "score", "n.n"]


@pytest.mark.parametrize("stage", [language_id.known_language, ngram_join.distinct_documents, decontamination.clean_documents, mixing.mixed_documents, sharding.sharded_documents])
def test_stages_keep_columns_with_clashing_names(spark, stored, stage):
    docs = spark.read.parquet(stored).withColumn("lang", F.lit("en"))
    last = stage is sharding.sharded_documents
    names = CLASHING + (["shard", "slot"] if last else [])
    docs = docs.withColumns({c: F.col("doc_id") * 2 + k for k, c in enumerate(names)})
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns + (["shard_", "slot_"] if last else [])
    rows = out.collect()
    assert rows and all(r[c] == r.doc_id * 2 + k for r in rows for k, c in enumerate(names))


@pytest.mark.parametrize("stage", [language_id.known_language, ngram_join.distinct_documents, decontamination.clean_documents, mixing.mixed_documents, sharding.sharded_documents])
def test_stages_with_null_ids_and_without_rows(spark, stage):
    same = "the same words stand here twice and again so they are alike"
    rows = [(None, same, "en", "a", 1), (None, "other words that no one has written before now", "en", None, 1), (1, None, None, None, None), (1, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert {r.text for r in out.collect()} <= {r[1] for r in rows}
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("n", [200, 1_000, 10_000, 30_000])
def test_rejection_is_calibrated_at_every_size(spark, n):
    rng = random.Random(3)
    parts = ["the", "er", "ing", "wh", "on", "at", "re", "st"]
    text = lambda n: " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(rng.randint(5, 40)), "en") for i in range(n)]
    noise = ["".join(rng.choices("qxzjvkbçñø", k=9)) + " " + " ".join("".join(rng.choices("qxzjvkbçñø", k=7)) for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame(rows + [(30_000 + i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string").repartition(8)
    kept = [r.doc_id for r in language_id.known_language(spark, docs).select("doc_id").collect()]
    assert not [i for i in kept if i >= 30_000]
    assert n - len(kept) <= 1 + n * 4 * language_id.REJECT_SHARE


def test_without_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}" if i % 7 else None, None, "a", 1) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    assert language_id.known_language(spark, docs).count() == 200
    got = language_id.predict(docs, language_id.train(docs), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, False)}


def test_the_calibration_sample_does_not_depend_on_the_schedule(spark):
    rows = [(i, f"{'abc' if i % 2 else 'xyz'} word{i % 90} " * (1 + i % 90 % 5), "en" if i % 2 else "de") for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.train(docs.repartition(k)) for k in (1, 7)]
    assert models[0].limit == models[1].limit < float("inf") and models[0].beta == models[1].beta
    assert language_id.entropy_limit(np.array([1.0, 1.1, 1.2]), np.full(3, 100)) == float("inf")
    assert 0.8 < language_id.entropy_limit(np.ones(50), np.full(50, 100)) < 1.0  # less the margin of 0.2


def test_a_folder_that_workers_cannot_open_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "through_table", lambda df, name: df)
    monkeypatch.setattr(language_id, "new_path", lambda spark, name: f"hdfs://somewhere/shared/{name}")
    with pytest.raises(ValueError, match="mounted"):
        language_id.Model.fit(spark.createDataFrame([("en", 5, 1)], "lang string, ngram long, n long"))


def test_resharding_moves_the_fewest_bytes_from_stored_shards(spark):
    rng, to = random.Random(8), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(i, "x" * rng.randint(0, 400), k) for k in range(32) for i in range(k * 1000, k * 1000 + 10 + 7 * (k % 9))]
    rows.append((99_999, "y" * 60_000, 31))  # more than any shard may take
    for k in range(32):  # a file for each old shard
        pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t} for i, t, own in rows if own == k]), f"{to}/part-{k:05d}.parquet")
    docs = with_rows(spark.read.parquet(f"file://{to}"))
    sized, buckets = sharding.old_layout(docs)
    supply = {r.old_shard: r.n for r in sized.groupBy("old_shard").agg(F.sum("size").alias("n")).collect()}
    assert len(supply) == 32 and supply == {k: sum(len(t) + 16 for _, t, own in rows if (own + 1) % 32 == k) for k in range(32)}  # files are numbered from 1
    total = sum(supply.values())
    capacity = {j: (j % 5 + 1) * total // 110 for j in range(40)}
    plan, transfers = sharding.plan_moves(sized, capacity)
    moved = sum(n for (i, j), n in transfers.items() if i != j)
    assert moved == total - sum(min(supply[k], capacity[k]) for k in range(32))  # what does not fit where it is must move, and no more
    assert all(sum(n for (_, j), n in transfers.items() if j == k) <= capacity[k] for k in capacity)
    plan = plan.collect()
    held = {j: sum(r.size for r in plan if r.shard == j) for j in capacity}
    largest = max(r.size for r in plan if r.doc_id != 99_999)
    assert len(plan) == len(rows) and all(n <= capacity[j] + 2 * largest or any(r.doc_id == 99_999 for r in plan if r.shard == j) for j, n in held.items())
    assert all(sorted(r.slot for r in plan if r.shard == j) == list(range(sum(r.shard == j for r in plan))) for j in capacity)
    written = sharding.rewrite(docs, spark.createDataFrame(plan, sharding.plan_moves(sized, capacity)[0].schema), buckets, new_path(spark, "resharded"))
    changed = {s for r in plan if r.shard != r.old_shard for s in (r.shard, r.old_shard)}
    assert sorted((r.doc.doc_id, r.shard, r.slot) for r in written.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in plan if r.shard in changed)


def test_documents_of_one_id_are_dealt_to_several_files(spark):
    rows = [(7 if i % 3 else None, f"text number {i}") for i in range(3_000)] + [(8, "the last")]
    to = new_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), to, tasks=6)
    found = token_files.with_starts(token_files.token_digests(token_files.read_tokens(spark, to)))
    got = found.select("doc_id", "start", "n_tokens", "file").collect()
    assert len(got) == 3_001 and len({r.file for r in got if r.doc_id == 7}) > 1 and len({r.file for r in got if r.doc_id is None}) > 1
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_a_passage_that_thousands_of_unlike_texts_share(spark):
    """Texts that only share a long passage lie in one open block: its rows are its members times its parts, and links inside it are found."""
    n, rng = 5_000, random.Random(4)
    passage = " ".join(f"p{k}" for k in range(40))
    own = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(8)) for _ in range(n)]
    rows = [(i, f"{t} {passage}") for i, t in enumerate(own)]
    near = [(n + i, f"x{i} {own[i].split(' ', 1)[1]} {passage}") for i in range(0, n, 500)]  # another first word: 43 of 45 shingles
    docs = with_rows(spark.createDataFrame(rows + near, "doc_id long, text string").repartition(8))
    made = ngram_join.document_sets(docs, 5)
    cells = ngram_join.cell_counts(made)
    assert cells.sum() == 44 * (n + len(near)) == made.where("row is not null").agg(F.sum("size")).first()[0]
    texts = docs.select(F.col("row").alias("cls"), "text")
    shared = ngram_join.shared_tokens(ngram_join.block_rows(texts, cells, 5, 80))
    none = spark.createDataFrame([], "v long, c long")
    opened = ngram_join.open_cells(shared, none)
    parts = -(-(n + len(near)) * 44 // ngram_join.PART_SHINGLES) + -(-(n + len(near)) // ngram_join.PART) + 1
    most = opened.groupBy("token").count().agg(F.max("count")).first()[0]
    assert n < most <= (n + len(near)) * parts
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs.select("row", "doc_id", "text"), row="row").collect()}
    assert got == {i: i for i in range(n)} | {n + i: i for i in range(0, n, 500)}


def test_every_labelled_text_is_learnt_and_calibrates(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(20)) for _ in range(8_000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    seen = []
    limit = language_id.tail_limit
    monkeypatch.setattr(language_id, "tail_limit", lambda values, counts: seen.append(int(counts.sum())) or limit(values, counts))
    counted = []
    counts = language_id.ngram_counts
    monkeypatch.setattr(language_id, "ngram_counts", lambda rows: counted.append(rows.count()) or counts(rows))
    assert language_id.known_language(spark, docs).count() >= 7_950
    assert seen == [8_000] and counted == [8_000]


def test_shuffles_of_a_table_end_with_its_write(spark):
    """Their files are gone once the table is there, not when the driver happens to collect its garbage; the session's setting stays as it was."""
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files() -> set:
        return {p for d in dirs for p in Path(d).glob("*/shuffle_*.data")}

    before, made = files(), []
    for setting in (None, "false"):
        if setting:
            spark.conf.set(CLEANUP, setting)
        kept = through_table(spark.range(200_000).repartition(5, "id").groupBy(F.pmod("id", F.lit(1000)).alias("k")).agg(F.count("*").alias("n")), "shuffled")
        assert spark.conf.get(CLEANUP, None) == setting
        made.append(kept)
    spark.conf.unset(CLEANUP)
    until = time.time() + 5  # they are removed in the background
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert all(t.agg(F.count("*"), F.sum("n")).first()[:] == (1000, 200_000) for t in made)


def test_prefixes_are_shuffled_without_texts(spark, monkeypatch):
    """Classes are picked among prefixes, so the texts themselves are not shuffled; salts of full cells and blank texts stay what they were."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([0, 3, 12, 60]))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(300, None)], "cls long, text string").repartition(3)
    cells = np.zeros(ngram_join.CELLS, "i8")
    np.add.at(cells, (np.concatenate(ngram_join.shingle_sets(texts)) % np.uint64(ngram_join.CELLS)).astype("i8"), 1)
    cells[::2] += 50
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 20)
    own = docs.where("cls % 3 = 0").select("cls")
    blocks = ngram_join.block_rows(docs, cells, 5, 80, own)
    plan = blocks._jdf.queryExecution().executedPlan()
    assert not any("text" in line for line in plan.toString().split("\n") if "Exchange" in line or "Sort" in line)
    crowded = np.floor(np.log2(np.maximum(cells / cells.mean(), 1.0)))
    want = set()
    for cls in range(0, 300, 3):
        s = ngram_join.shingle_sets([texts[cls]])[0]
        cell = (s % np.uint64(ngram_join.CELLS)).astype("i8")
        for k in np.argsort(crowded[cell], kind="stable")[: len(s) - -(-80 * len(s) // 100) + 1]:
            want.add((int(s[k].astype("i8")), cls, len(s), bool(cells[cell[k]] > 20)))
    got = [(r.token, r.cls, r["size"], r.salt > 0) for r in blocks.collect()]
    assert len(got) == len(want) and set(got) == want
    assert {x[3] for x in got} == {True, False}
