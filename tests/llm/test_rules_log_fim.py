"""Quality rules by host, the Merkle log and fill-in-middle: awkward rows against SQL, and parts against plain Python."""

import hashlib
import random
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orderloom.llm import fill_in_middle as fim
from orderloom.llm import merkle_log as ml
from orderloom.llm import quality_rules as qr

QUERIES = {**qr.QUERIES, **ml.QUERIES, **fim.QUERIES}
SQL = {**qr.SQL, **ml.SQL, **fim.SQL}
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("row", pa.string()), ("tree", pa.string()), ("n", pa.int64())])


def awkward():
    rng = random.Random(4)
    words = [f"w{i}é" for i in range(60)] + ["##", "a|b", "<S", "P>", "x" * 30]
    rows = []
    for i in range(1300):
        text = " ".join(rng.choices(words, k=rng.choice([5, 60, 200])))
        if i % 9 == 0:
            text = "\n".join([text[:80]] * 5 + ["", "  \t", text])
        rows.append([i, text, rng.choice(["de", "en", "en", "en", None, "ça"]), "good" if i % 3 else f"s{i % 40}", len(text)])
    rows += [[None, None, None, None, None], [7, "", "en", "", 0], [7, "", "en", "", 0], [8, "<P> is a marker", "en", "good", 3], [8, "A" * 70_000 + " " + "B ć \U0001f600 " * 9_000, "xx", "good", 1]]
    rows += [[None, "TEXT without id " * 9, "en", "good", 1]] * 3 + [[5, "Same row Twice", "en", "good", 1]] * 40
    rows += [[2000 + i, "# $ " * 60, "en", "bad.example", 1] for i in range(200)] + [[3000, "one fine text with words " * 3 + " ".join(f"v{i}" for i in range(80)), "en", "bad.example", 1]]
    return [[*r, "r", "t", 1] for r in rows]


def stored(rows):
    to = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA), f"{to}/documents.parquet", row_group_size=200)
    return to


@pytest.fixture(scope="module")
def folder():
    return stored(awkward())


def key(rows):
    return sorted(repr(r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows_equal_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = c.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert key(map(tuple, got.collect())) == key(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_an_empty_table_gives_no_rows(spark, name):
    assert QUERIES[name](spark, stored([])).collect() == []


# --- quality rules


def plain_measures(text):
    words = text.encode().split()
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(often)


def test_measures_equal_plain_python():
    rng = random.Random(1)
    texts = ["", " \n", "a", "a a", "a a a", "a a a a", "a b c a b c", "a b c d", "x\ny\nx\n x\nx"]
    texts += ["".join(rng.choices(["a ", "b ", "é", "\n", "# ", "c\t"], k=rng.randint(0, 120))) for _ in range(200)]
    got = qr.measure([t.encode() for t in texts])
    assert list(zip(*(got[m].tolist() for m in qr.MEASURES), strict=True)) == [plain_measures(t) for t in texts]


def test_a_bad_host_loses_all_and_small_hosts_are_shrunk(spark):
    fine = " ".join(f"w{i}" for i in range(70))
    rows = [(i, fine if i % 20 else "# $ " * 60, f"h{i % 10}") for i in range(2000)]
    rows += [(10_000 + i, "# $ " * 60 if i else fine, "bad") for i in range(100)] + [(20_000, "# $ " * 60, "tiny"), (20_001, fine, "tiny"), (20_002, "# $ " * 60, "other")]
    got = {r.doc_id: r for r in qr.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"]).collect()}
    assert got[10_000].host_blocked and not got[10_000].kept and not got[10_000].failed
    assert not got[20_001].host_blocked and got[20_001].kept and not got[20_000].kept
    assert all(r.kept == (not r.failed) for r in got.values() if r.source.startswith("h"))


def test_hosts_that_hardly_ever_fail_are_forgiven(spark):
    fine = " ".join(f"w{i}" for i in range(70))
    rows = [(i, fine if i != 7 else fine + " #" * 20, "clean") for i in range(900)] + [(1000 + i, fine + " #" * 20 * (i % 4 == 0), "mixed") for i in range(400)] + [(5000, "short", "clean")]
    got = {r.doc_id: r for r in qr.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"]).collect()}
    assert got[7].failed == ["symbols"] and got[7].kept and not got[1000].kept and got[1001].kept and not got[5000].kept


def test_kept_documents_have_their_own_columns(spark):
    fine = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, fine, "a", 5, True), (2, "short", "a", 6, False), (3, None, None, 7, None)], "doc_id long, text string, source string, n_words long, kept boolean")
    assert list(map(tuple, qr.kept_documents(docs).collect())) == [(1, fine, "a", 5, True)]


# --- the Merkle log


def plain_log(leaves):
    """Nodes (level, i, digest) in the order in which a recursive builder completes them."""
    out, wide = [], ml.widths(len(leaves))

    def complete(level, i):
        if level == 0:
            digest = leaves[i]
        else:
            digest = hashlib.sha256("".join(complete(level - 1, k) for k in range(8 * i, min(8 * i + 8, wide[level - 1]))).encode()).hexdigest()
        out.append((level, i, digest))
        return digest

    complete(len(wide) - 1, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 72, 73, 511, 512, 513, 585, 4097])
def test_positions_are_those_of_a_postorder_walk(n):
    log = plain_log([f"{i:064d}" for i in range(n)])
    assert [int(ml.position(n, level, i)) for level, i, _ in log] == list(range(len(log)))
    assert len(log) == sum(ml.widths(n))


def test_the_log_of_builders_is_that_of_a_walk(spark):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(1100)]
    rows = [(t, n, i, leaves[i]) for t, n in (("a", 1100), (None, 1), ("b", 513)) for i in range(n)]
    log = [r for part in ml.append_log(spark.createDataFrame(rows, "tree string, n long, i long, digest string")) for r in part.collect()]
    for tree, n in (("a", 1100), (None, 1), ("b", 513)):
        own = sorted((r.position, r.level, r.i, r.digest) for r in log if r.tree == tree)
        assert [r[1:] for r in own] == plain_log(leaves[:n]) and [r[0] for r in own] == list(range(len(own)))
        assert [(r.level, r.i) for r in log if r.tree == tree and r.is_root] == [(ml.height(n), 0)]


def test_folding_a_path_gives_the_root():
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(75)]
    log = plain_log(leaves)
    at, root = {(x, i): d for x, i, d in log}, log[-1][2]
    for i in range(75):
        path, k = "", i
        for level, width in enumerate(ml.widths(75)[:-1]):
            path += "".join(at[level, s] for s in range(k // 8 * 8, min(k // 8 * 8 + 8, width)) if s != k)
            k //= 8
        assert ml.fold(leaves[i], ml.places(75, i), path) == root != ml.fold("0" * 64, ml.places(75, i), path)


# --- fill-in-middle


def test_outputs_cut_anywhere_are_read_alike():
    rng = random.Random(2)
    for form, order in fim.FORMS.items():
        for _ in range(300):
            parts = ["".join(rng.choices(["<", "S", "P", "M", ">", "é"], k=rng.randint(0, 6))).encode() for _ in range(3)]
            whole = b"".join(parts)
            if any(m in p for m in (b"<P>", b"<S>", b"<M>") for p in (*parts, whole)):
                continue
            output = b"".join(m + p for m, p in zip(order, parts, strict=True)) if order else whole
            cuts = sorted(rng.choices(range(len(output) + 1), k=4))
            chunks = [output[a:b] for a, b in zip([0, *cuts], [*cuts, len(output)], strict=True)]
            got: dict = {}
            for part, chunk in fim.parts_of(form, chunks):
                got[part] = got.get(part, b"") + chunk
            want = {m: p for m, p in zip(order, parts, strict=True) if p} if order else {None: whole} if whole else {}
            assert got == want


def test_long_texts_are_pieces_of_whole_units():
    text = ("word " * 20_000 + "x" * 100_000 + " é" * 30_000).encode()
    units = fim.Units([b"ab", text, b"", b"cd"])
    chunks = list(units.chunks(1, text, 0, len(text)))
    assert b"".join(chunks) == text and len(chunks) > 4 and [units.count(k) for k in (0, 2, 3)] == [1, 0, 1]
    starts = set((units.starts[units.low[1] : units.high[1]] - units.begins[1]).tolist())
    assert set(np.cumsum([len(c) for c in chunks])[:-1].tolist()) <= starts
    assert all(len(c) <= fim.CHUNK or set(c) == {ord("x")} for c in chunks)


def test_outputs_give_the_texts_back(spark):
    texts = ["", None, "plain words and more of them " * 5, "<S> marker", "ünïcode ß " * 2_000]
    docs = spark.createDataFrame([(k, k, texts[k % 5]) for k in range(60)], "row long, doc_id long, text string")
    out = fim.outputs(docs)
    got = {r.row_: r for r in out.join(fim.restored_texts(out), "row_").collect()}
    assert len(got) == 60 and all(got[k].text == (texts[k % 5] or "") for k in got)
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    digest = {r.row_: r.output_sha256 for r in fim.round_trip(docs).collect()}
    assert all(hashlib.sha256(r.output.encode()).hexdigest() == digest[k] for k, r in got.items())
