"""Language identification with interpolated Kneser-Ney character models.

Training counts character 5-grams inside words (with word starts and ends) of all training documents: tasks count
words, turn them into n-grams and send partial counts; Spark adds them up. Orders 4 to 1 use continuation counts.
An n-gram is a 60-bit key, 12 hash bits for each character. A model holds all n-grams of the training documents: for
each language and order, Spark sorts keys with their counts, and contexts with their totals, into files of the shared
folder (a path that driver and executors can open), which workers memory-map and look up by binary search. The driver
gets a row for each language and order and for each file.
Texts are halved by hash. Each half has models of its own, and a text is judged by those of the other half: no text is judged by models
that counted it, every labelled text is learnt, and every one calibrates.
A document's language has the lowest cross-entropy for each symbol. The score is a probability
from the tempered likelihoods; temperature and the highest plausible entropy come from all labelled texts, summed up by Spark: the driver
gets a row for each temperature and for each RESOLUTION of entropy. The limit is where a generalised Pareto tail, fitted to the largest of their entropies, leaves
REJECT_SHARE of such texts above: it is found alike for any number of them, with more caution for few.

Edge cases: null texts and texts without letters get ``und`` and score 0, and are rejected; where nothing was learnt, all texts get that and
none is rejected; with fewer than 4 texts to calibrate with there is no limit (languages of fewer than FEW_DOCS documents, or with texts in one half alone, give none, and both halves learn all of theirs); ties go to the first language in order; repeated rows are
judged alike; long texts are judged whole, few at a time; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import new_path, own_columns, pieces, table, through_table

ORDER = 5
BITS = 12
CHARS = (1 << BITS) - 3
START, END = CHARS + 1, CHARS + 2
#: Rows of the model that a task sorts and writes.
PART_ROWS = 250_000
HALVES = 2
#: Languages with at least so many documents calibrate.
FEW_DOCS = 100
#: Entropies that differ by less are counted together (nats a symbol), and losses are added up as whole millionths, so that sums do not depend on their order.
RESOLUTION, MILLION = 0.001, 1_000_000
BETAS = np.geomspace(0.01, 1, 15).tolist()
#: Rejected is a text whose cross-entropy, less MARGIN / sqrt(symbols) for its uncertainty, is one that so small a share of texts of known languages has.
REJECT_SHARE, MARGIN = 0.001, 2.0
#: The tail's shape is taken to be this, as if so many texts had shown it.
TAIL_PRIOR = 0.25, 20
MEMORY_WORDS = 300_000
PIECE_ROWS, PIECE_BYTES = 1_000, 4 << 20
LETTERS = re.compile(r"[^\W\d_]+")


def word_windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams that end at each letter and at the end of each word, and where each word's begin."""
    lengths = np.fromiter(map(len, words), "i8", len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype("i8") % CHARS + 1
    pad = ORDER - 1
    begins = np.concatenate([[0], np.cumsum(lengths + pad + 1)])
    line = np.full(int(begins[-1]), START, "i8")
    line[begins[1:] - 1] = END
    inside = np.repeat(begins[:-1] + pad - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(letters))
    line[inside] = letters
    keys = np.zeros(len(line), "i8")
    for k in range(ORDER):
        keys[pad:] |= line[k : len(line) - pad + k] << (BITS * (ORDER - 1 - k))
    real = line != START
    ends = np.cumsum(lengths + 1)
    return keys[real], np.concatenate([[0], ends[:-1]])


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, ngram, count) over whole ``docs`` (text, lang)."""

    def emit(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, seen in counts.items():
            words: Counter = Counter()
            for token, n in seen.items():
                for w in LETTERS.findall(token):
                    words[w] += n
            if words:
                keys, begins = word_windows(list(words))
                weights = np.repeat(np.fromiter(words.values(), "i8", len(words)), np.diff([*begins, len(keys)]))
                keys, where = np.unique(keys, return_inverse=True)
                sums = np.bincount(where, weights).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(sums)], ["lang", "ngram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        parts = (part for batch in batches for part in pieces(batch, PIECE_ROWS, PIECE_BYTES))
        for part in parts:
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.lower().split())
                if len(counts[lang]) > MEMORY_WORDS:
                    yield from emit({lang: counts.pop(lang)})
        yield from emit(counts)

    labelled = docs.where("text is not null and lang is not null").select("text", "lang")
    return labelled.mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def orders_of(counts: DataFrame) -> DataFrame:
    """(lang, k, ngram, n): ``counts`` as order ORDER; a shorter n-gram counts the distinct symbols before it."""
    parts = [counts.select("lang", F.lit(ORDER).alias("k"), "ngram", "n")]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("ngram").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("ngram")
        parts.append(parts[-1].groupBy("lang", shorter).agg(F.count("*").alias("n")).select("lang", F.lit(k).alias("k"), "ngram", "n"))
    return reduce(DataFrame.unionByName, parts)


def sorted_files(rows: DataFrame, folder: str, count: int) -> None:
    """Write ``rows`` (tab, key, a, b) in key order: the files {tab}.key, {tab}.a and {tab}.b of 64-bit numbers in ``folder``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, firsts = uuid.uuid4().hex, {}
        for batch in batches:
            tabs, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(tabs)) + 1).tolist(), len(tabs)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if end > begin:
                    tab = int(tabs[begin])
                    firsts.setdefault(tab, int(columns[0][begin]))
                    for kind, column in zip(("key", "a", "b"), columns, strict=True):
                        with open(f"{folder}/{name}-{tab}.{kind}", "ab") as f:
                            f.write(column[begin:end].astype("i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(firsts), pa.int32()), pa.array(list(firsts.values()), pa.int64()), pa.array([f"{name}-{t}" for t in firsts], pa.string())], ["tab", "first", "name"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tab, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind in ("key", "a", "b"):
                    own = f"{folder}/{uuid.uuid4().hex}"
                    with open(own, "wb") as out:
                        for name in names:
                            with open(f"{folder}/{name}.{kind}", "rb") as f:
                                shutil.copyfileobj(f, out, 1 << 20)
                    os.replace(own, f"{folder}/{tab}.{kind}")
            yield batch.select(["tab"])

    ordered = rows.repartitionByRange(count // PART_ROWS + 1, "tab", "key").sortWithinPartitions("tab", "key")
    parts = ordered.mapInArrow(write, "tab int, first long, name string").orderBy("tab", "first").collect()  # a row for each file
    names: dict[int, list[str]] = {}
    for r in parts:
        names.setdefault(r.tab, []).append(r.name)
    rows.sparkSession.createDataFrame(list(names.items()), "tab int, names array<string>").repartition(min(len(names), 64), "tab").mapInArrow(join, "tab int").collect()
    for r in parts:
        for kind in ("key", "a", "b"):
            os.remove(f"{folder}/{r.name}.{kind}")


class Model:
    """Kneser-Ney values by half, language and order, from the sorted files in ``folder``; ``tables`` numbers the halves' languages."""

    def __init__(self, langs: list[str], folder: str | None = None, tables: dict[tuple[int, str], int] | None = None, discounts: dict[tuple[int, int], float] | None = None):
        self.langs, self.folder, self.tables, self.discounts = langs, folder, tables or {}, discounts or {}
        self.beta, self.limit, self.few = 1.0, float("inf"), []

    @classmethod
    def fit(cls, counts: DataFrame, halved: bool = False) -> Model:
        """The model of all of ``counts`` (lang, ngram, n); if they are ``halved``, lang begins with the number of the half."""
        spark = counts.sparkSession
        grams = through_table(orders_of(through_table(counts, "lang-counts")), "lang-orders")
        found = grams.groupBy("lang", "k").agg(F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()  # a row for each half, language and order
        names = sorted({r.lang for r in found})
        if not names:
            return cls([])
        folder = new_path(spark, "lang-model")
        if "://" in folder.removeprefix("file://"):
            raise ValueError(f"workers must be able to open the models' files, so {folder} must be a mounted path")
        folder = folder.removeprefix("file://")
        os.makedirs(folder)
        at = {x: i for i, x in enumerate(names)}
        number = spark.createDataFrame(list(at.items()), "lang string, i int")
        contexts = grams.groupBy("lang", "k", F.shiftright("ngram", BITS).alias("key")).agg(F.sum("n").alias("a"), F.count("*").alias("b"))
        rows = grams.select("lang", "k", F.lit(0).alias("kind"), F.col("ngram").alias("key"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
        rows = rows.unionByName(contexts.withColumn("kind", F.lit(1))).join(F.broadcast(number), "lang")  # a row for each half and language
        tab = F.col("i") * (2 * ORDER) + (F.col("k") - 1) * 2 + F.col("kind")
        sorted_files(rows.select(tab.cast("int").alias("tab"), "key", "a", "b"), folder, sum(r.types for r in found))
        discounts = {(at[r.lang], r.k): min(max(r.ones / max(r.ones + 2 * r.twos, 1), 0.1), 0.9) for r in found}
        tables = {(int(x[0]), x[1:]) if halved else (0, x): i for x, i in at.items()}
        return cls(sorted({lang for _, lang in tables}), folder, tables, discounts)

    def orders(self, table: int) -> list[tuple[np.ndarray, ...]]:
        """For each order: n-grams, their counts, contexts, their totals and numbers of types; all memory-mapped."""
        at = [table * 2 * ORDER + 2 * k for k in range(ORDER)]
        names = [(f"{t}.key", f"{t}.a", f"{t + 1}.key", f"{t + 1}.a", f"{t + 1}.b") for t in at]
        return [tuple(np.asarray(np.memmap(f"{self.folder}/{x}", "i8", "r")) for x in own) for own in names]

    def log_probabilities(self, windows: np.ndarray, half: int = 0) -> np.ndarray:
        """A row for each window, a column for each language, by the models of ``half``."""
        out = np.empty((len(windows), len(self.langs)))
        for column, lang in enumerate(self.langs):
            p, table = np.full(len(windows), 1 / (CHARS + 2)), self.tables.get((half, lang))
            for k, (keys, counts, contexts, totals, types) in enumerate(self.orders(table) if table is not None else [], 1):
                discount = self.discounts[table, k]
                own = windows & ((1 << (BITS * k)) - 1)
                at, found = self._find(contexts, own >> BITS)
                total = np.where(found, totals[at], 1)
                p *= np.where(found, discount * types[at] / total, 1.0)
                at, found = self._find(keys, own)
                p += np.where(found, (counts[at] - discount) / total, 0.0)
            out[:, column] = np.log(p)
        return out

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


class Scorer:
    """Sums of log probabilities of texts by the models of one half, each distinct word judged once and remembered."""

    def __init__(self, model: Model, half: int):
        self.model, self.half = model, half
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs) + 1), "f4")

    def learn(self, tokens: list[str]) -> None:
        parts = [LETTERS.findall(t) for t in tokens]
        words = [w for p in parts for w in p]
        sums = np.zeros((len(words), self.rows.shape[1]))
        if words:
            keys, begins = word_windows(words)
            distinct, where = np.unique(keys, return_inverse=True)
            sums[:, :-1] = np.add.reduceat(self.model.log_probabilities(distinct, self.half)[where], begins)
            sums[:, -1] = np.diff([*begins, len(keys)])
        owner = np.repeat(np.arange(len(tokens)), [len(p) for p in parts])
        at = len(self.known)
        while len(self.rows) < at + len(tokens):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        block = np.zeros((len(tokens), self.rows.shape[1]))
        np.add.at(block, owner, sums)
        self.rows[at : at + len(tokens)] = block
        self.known.update(zip(tokens, range(at, at + len(tokens)), strict=True))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text: log likelihood by language, then the number of symbols."""
        cut = [t.lower().split() if t else [] for t in texts]
        new = {w for w in set().union(*cut) if w not in self.known}
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.forget()
            new = set().union(*cut)
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, words in enumerate(cut):
            if words:
                out[i] = self.rows[np.fromiter(map(get, words), "i8", len(words))].sum(0, dtype="f8")
        return out


_SCORERS: dict[str, list[Scorer]] = {}


def half_of(text: Column) -> Column:
    """The half of a text: equal texts are in one."""
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(HALVES)), F.lit(0)).cast("int")


def likelihoods(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, with the sums for each text by the models of the other half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a discount for each half, language and order
    key = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = [Scorer(shared.value, HALVES - 1 - half) for half in range(HALVES)]
        scorers = _SCORERS[key]
        for batch in batches:
            for part in pieces(batch, PIECE_ROWS, PIECE_BYTES):
                halves = part.column(len(keep)).to_numpy(zero_copy_only=False)
                sums = np.zeros((len(halves), len(shared.value.langs) + 1))
                for half, scorer in enumerate(scorers):
                    mine = np.flatnonzero(halves == half)
                    if len(mine):
                        sums[mine] = scorer.sums(part.column(len(keep) + 1).take(pa.array(mine)).to_pylist())
                flat = pa.array(sums.ravel())
                width = sums.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype="i4") * width), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], [*keep, "sums"])

    return docs.select(*keep, half_of(F.col("text")).alias("half_"), "text").mapInArrow(score, docs.select(*keep).schema.add("sums", ArrayType(DoubleType())))


def tail_limit(values: np.ndarray, counts: np.ndarray) -> float:
    """What one of the ascending ``values``, found ``counts`` times, exceeds with a probability of REJECT_SHARE: a quantile of a generalised Pareto tail.

    The tail is what the largest tenth (10 at least) have above the next one; its mean counts with one standard error more, its shape comes from
    their moments and a prior.
    """
    n = int(counts.sum())
    if n < 4:
        return float("inf")
    k = min(n // 2, max(10, n // 10))
    ends = np.cumsum(counts)
    at = int(np.searchsorted(ends, n - k - 1, "right"))
    above, weights = values[at:] - values[at], counts[at:].astype("f8")
    weights[0] = ends[at] - (n - k)
    found = float((weights * above).sum() / k)
    var = float((weights * (above - found) ** 2).sum() / k)
    mean, (prior, weight) = max(found, 1e-3) * (1 + 1 / np.sqrt(k)), TAIL_PRIOR
    seen = (1 - mean**2 / max(var, 1e-6)) / 2
    shape = (max(seen, 0.0) * k + prior * weight) / (k + weight)
    return float(values[at] + mean * (1 - shape) / shape * (max(1.0, k / (n * REJECT_SHARE)) ** shape - 1))


def entropy_limit(entropies: np.ndarray, symbols: np.ndarray) -> float:
    """``tail_limit`` of the entropies, less the margin for their uncertainty."""
    found = np.sort(entropies - MARGIN / np.sqrt(symbols))
    return tail_limit(found, np.ones(len(found), "i8"))


def learn(docs: DataFrame) -> Model:
    """Models, not calibrated yet, of both halves of ``docs`` (text, lang), all of which are training documents."""
    labelled = docs.where("text is not null and lang is not null").select("text", "lang", half_of(F.col("text")).alias("half"))
    kinds = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.max("half") > F.min("half")).alias("both"))
    few = [r.lang for r in kinds.where((F.col("n") < FEW_DOCS) | ~F.col("both")).select("lang").collect()]  # at most a row for each language
    halves = F.when(F.col("lang").isin(few), F.array(*map(F.lit, range(HALVES)))).otherwise(F.array("half"))
    model = Model.fit(ngram_counts(labelled.withColumn("half", F.explode(halves)).withColumn("lang", F.concat("half", "lang"))), halved=True)
    model.few = few
    return model


def calibrate(model: Model, judged: DataFrame) -> Model:
    """``model`` with the temperature and the limit of all labelled texts of ``judged`` (lang, h, sums), each text once for each of its languages."""
    own = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")).cast("int")
    seen = judged.where(F.col("lang").isin(model.langs) & ~F.col("lang").isin(model.few) & (F.element_at("sums", -1) > 0)).dropDuplicates(["lang", "h"])
    logs = F.slice("sums", 1, len(model.langs))
    seen = through_table(seen.select(logs.alias("logs"), F.array_max(logs).alias("best"), F.element_at("sums", own).alias("own"), F.element_at("sums", -1).alias("n")), "lang-calibration")

    def loss_of(beta: float) -> Column:
        share = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("best")) * F.lit(beta)))
        return F.sum(F.round((F.log(share) + (F.col("best") - F.col("own")) * F.lit(beta)) * MILLION).cast("decimal(38,0)"))

    loss = seen.agg(*(loss_of(beta).alias(f"b{k}") for k, beta in enumerate(BETAS))).first()
    if loss[0] is None:
        return model
    model.beta = min(zip(loss, BETAS, strict=True))[1]
    spot = F.floor((-F.col("best") / F.col("n") - MARGIN / F.sqrt("n")) / RESOLUTION)
    bins = np.array([tuple(r) for r in seen.groupBy(spot.alias("bin")).count().orderBy("bin").collect()])  # a row for each RESOLUTION of entropy
    model.limit = tail_limit((bins[:, 0] + 0.5) * RESOLUTION, bins[:, 1])
    return model


def train(docs: DataFrame) -> Model:
    """A calibrated model of ``docs`` (doc_id, text, lang), all of which are training documents."""
    model = learn(docs)
    if not model.langs:
        return model
    return calibrate(model, likelihoods(docs.where("lang is not null").select("lang", F.xxhash64("text").alias("h"), "text"), model, ["lang", "h"]))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` with lang_pred, score, entropy (nats a symbol, in the best language) and rejected."""
    return verdicts(likelihoods(docs, model, keep) if model.langs else docs, model, keep)


def trained_verdicts(docs: DataFrame, training: Column, keep: list[str]) -> DataFrame:
    """``predict`` by a model of the rows of ``docs`` (text, lang, keep) that are ``training``: each text is judged once, for calibration and verdict."""
    model = learn(docs.where(training))
    if not model.langs:
        return verdicts(docs, model, keep)
    whole = docs.select(F.struct(*keep).alias("keep_"), F.when(training, F.col("lang")).alias("lang_"), F.xxhash64("text").alias("h_"), "text")
    judged = through_table(likelihoods(whole, model, ["keep_", "lang_", "h_"]), "lang-judged")
    calibrate(model, judged.select(F.col("lang_").alias("lang"), F.col("h_").alias("h"), "sums"))
    return verdicts(judged.select("keep_.*", "sums"), model, keep)


def verdicts(sums: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``predict`` from the sums of ``likelihoods``; none are needed where nothing was learnt."""
    if not model.langs:
        none = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "entropy": F.lit(None).cast("double"), "rejected": F.lit(False)}
        return sums.select(*keep).withColumns(none)
    logs = F.slice("sums", 1, len(model.langs))
    n = F.element_at("sums", -1)
    best = F.array_max(logs)
    out = sums.withColumn("best", best).withColumn("symbols", n)
    names = F.array(*map(F.lit, model.langs))
    share = F.aggregate(F.transform(logs, lambda x: F.exp((x - F.col("best")) * F.lit(model.beta))), F.lit(0.0), lambda a, x: a + x)
    real = F.col("symbols") > 0
    entropy = F.when(real, -F.col("best") / F.col("symbols"))
    return out.select(
        *keep,
        F.when(real, F.element_at(names, F.array_position(logs, F.col("best")).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(real, 1 / share).otherwise(0.0).alias("score"),
        entropy.alias("entropy"),
        F.coalesce(entropy - MARGIN / F.sqrt("symbols") > F.lit(model.limit), F.lit(True)).alias("rejected"),
    )


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = trained_verdicts(docs, ~held_out(F.col("doc_id")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the calibrated models do not reject: all, where no document has a language to learn."""
    whole = docs.select(F.struct(*own_columns(docs)).alias("doc"), "text", "lang")
    return trained_verdicts(whole, F.lit(True), ["doc"]).where("not rejected").select("doc.*")


QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
