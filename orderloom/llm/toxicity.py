"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models; each later model also sees the probabilities of the
earlier categories. In training those are out-of-fold predictions, so that a later model learns from
probabilities as they are on texts not seen. Features are the words and the word beginnings that tell the
categories best in the training documents, as log(1 + count) over the whole text. Folds are dealt by the smallest hash of a
document's word shingles, so that near copies mostly lie in one fold.

Training takes at most TRAIN_DOCS labelled ids, those with the smallest hash (a bounded sample), and one text for each.

Edge cases: null or blank texts have no features and get the probabilities of that; a null label leaves a document out of
training; documents without labels are scored like all; repeated rows get equal rows; ids that repeat in ``labels``
count once, by their largest label, and of documents with one id the smallest text trains; with no usable labels the probability is 0 and nothing is toxic; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, tasks_for, through_table

CHAIN = ("quality", "toxic")
TRAIN_DOCS = 8_000
FEATURES_EACH = 384
PREFIXES = (4, 5, 6, 7)
FOLDS = 5
RIDGE = 1e-3
#: Held-out F1 for toxic on a quarter of the labels of a table of 51,282 documents: 0.575 with 160 steps, 0.549 with 250.
STEPS = 160
SHINGLE = 5
MEMORY_WORDS = 300_000
#: Texts scored at a time: so many rows, and about so many bytes.
PIECE_ROWS, PIECE_BYTES = 1_000, 8 << 20
MARKS = ".,;:!?\"'()[]{}<>|*%$#&-_/\\…«»“”„¿¡"


def features_of_word(token: str) -> list[str]:
    w = token.strip(MARKS)
    return [f"={w}", *(w[:k] for k in PREFIXES if len(w) > k)] if w else []


def feature_counts(train: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """(feature, n, one count of positives for each category) over documents of ``train``."""
    names = ["feature", "n", *chain]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        positive: list[Counter] = [Counter() for _ in chain]

        def emit():
            keys = list(seen)
            columns = [pa.array(keys), pa.array([seen[k] for k in keys], pa.int64()), *(pa.array([p[k] for k in keys], pa.int64()) for p in positive)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            labels = [c.to_pylist() for c in batch.columns[1:]]
            for i, text in enumerate(batch.column(0).to_pylist()):
                own = {f for t in set((text or "").lower().split()) for f in features_of_word(t)}
                seen.update(own)
                for p, y in zip(positive, labels, strict=True):
                    if y[i]:
                        p.update(own)
            if len(seen) > MEMORY_WORDS:
                yield emit()
                seen.clear()
                for p in positive:
                    p.clear()
        yield emit()

    kinds = "feature string, n long, " + ", ".join(f"`{c}` long" for c in chain)
    parts = train.select("text", *chain).mapInArrow(count, kinds)
    return parts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names[1:]))


def telling_features(train: DataFrame, chain: tuple[str, ...], each: int = FEATURES_EACH) -> list[str]:
    """The features with the largest |log odds| / standard error, for each category."""
    totals = train.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in chain)).first()
    counts = through_table(feature_counts(train, chain).where("n >= 3"), "toxicity-features")
    out: dict[str, None] = {}
    for c in chain:
        pos, neg = F.col(c) + 0.5, F.col("n") - F.col(c) + 0.5
        odds = F.log(pos / (totals[c] + 1)) - F.log(neg / (totals["n"] - totals[c] + 1))
        best = counts.select("feature", F.abs(odds / F.sqrt(1 / pos + 1 / neg)).alias("z")).orderBy(F.desc("z"), "feature").limit(each)
        out |= dict.fromkeys(r.feature for r in best.collect())  # at most ``each`` rows
    return sorted(out)


def fold_of(text: str | None) -> int:
    words = (text or "").lower().split()
    return min((zlib.crc32(" ".join(words[i : i + SHINGLE]).encode("utf-8", "replace")) for i in range(max(1, len(words) - SHINGLE + 1))), default=0) // 7 % FOLDS


class Counts:
    """Counts of features in whole texts; what a word contributes is looked up once and remembered."""

    def __init__(self, features: list[str]):
        self.at = {f: i for i, f in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").lower().split()
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.known.clear()
            new = set(words)
        for w in new:
            self.known[w] = tuple(self.at[f] for f in features_of_word(w) if f in self.at)
        hits = [i for found in filter(None, map(self.known.__getitem__, words)) for i in found]
        ids, n = np.unique(np.array(hits, "i8"), return_counts=True)
        return ids, np.log1p(n)


def largest(a: np.ndarray) -> float:
    """About the largest eigenvalue of a'a, by power iteration, with a margin."""
    v = np.ones(a.shape[1], "f4")
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= max(np.linalg.norm(v), 1e-30)
    return float(np.linalg.norm(a @ v) ** 2) * 1.05 + 1e-9


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last one is the intercept) by accelerated gradient descent on columns scaled to unit variance."""
    scale = np.maximum(x.std(0), 1e-2)
    a = np.column_stack([x / scale, np.ones(len(x))]).astype("f4")
    step = 1 / (0.25 * largest(a) / max(1, len(a)) + RIDGE)
    w = back = np.zeros(a.shape[1])
    for k in range(STEPS):
        ahead = w + k / (k + 3) * (w - back)
        slope = a.T @ (1 / (1 + np.exp(-np.clip(a @ ahead.astype("f4"), -30, 30))) - y) / len(a)
        slope[:-1] += RIDGE * ahead[:-1]
        back, w = w, ahead - step * slope
    w[:-1] /= scale
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """The fitted chain: features, weights of each category, the threshold of the last one and its F1 on out-of-fold predictions."""

    def __init__(self, features: list[str], weights: list[np.ndarray], threshold: float, f1: float | None = None):
        self.features, self.weights, self.threshold, self.f1 = features, weights, threshold, f1

    def predict(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = np.column_stack([x, probability(x, w)])
        return x[:, len(self.features) :]


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, features: list[str]) -> Chain:
    weights, seen = [], x
    held = np.zeros(len(x))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype("f8")
        held = np.zeros(len(x))
        for k in range(FOLDS):
            out = folds == k
            held[out] = probability(seen[out], logistic(seen[~out], y[~out])) if (~out).any() else 0.0
        weights.append(logistic(seen, y))
        seen = np.column_stack([seen, held])
    # the threshold with the best F1 on out-of-fold predictions, nearest to one half
    y, best = labels[:, -1] > 0, (-1.0, 0.0, 0.5)
    for cut in np.arange(0.1, 0.91, 0.05):
        hit = held >= cut
        f1 = 2 * (hit & y).sum() / max(1, hit.sum() + y.sum())
        best = max(best, (round(float(f1), 4), -abs(float(cut) - 0.5), float(cut)))
    return Chain(features, weights, best[2], best[0])


def train_chain(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, most: int = TRAIN_DOCS) -> Chain:
    known = labels.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in chain)).dropna()
    # the sample is chosen among the labels: texts are read where they lie
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most).drop("h")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of numbers
    rows = rows.groupBy("doc_id", *chain).agg(F.min("text").alias("text"))  # at most ``most`` rows, however often an id repeats
    train = through_table(rows, "toxicity-train").repartition(tasks_for(docs.sparkSession, 8))
    features = telling_features(train, chain) if train.limit(1).count() else []
    if not features:
        return Chain([], [], 2.0)
    kinds = "doc_id long, fold long, labels array<double>, ids array<long>, counts array<double>"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(features)
        for batch in batches:
            found = [count(t) for t in batch.column(1).to_pylist()]
            folds = [fold_of(t) for t in batch.column(1).to_pylist()]
            marks = [list(map(float, y)) for y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            columns = [batch.column(0), pa.array(folds, pa.int64()), pa.array(marks, pa.list_(pa.float64())), pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fold", "labels", "ids", "counts"])

    got = train.select(F.col("doc_id").cast("long"), "text", *chain).mapInArrow(vectors, kinds).toPandas().sort_values("doc_id", kind="stable")  # at most ``most`` rows
    x = np.zeros((len(got), len(features)))
    for i, (ids, counts) in enumerate(zip(got["ids"], got["counts"], strict=True)):
        x[i, ids] = counts
    return fit_chain(x, np.array([np.asarray(y) for y in got["labels"]]), got["fold"].to_numpy(), features)


def score(docs: DataFrame, model: Chain, chain: tuple[str, ...] = CHAIN) -> DataFrame:
    """(doc_id, p_<category>..., <last category> boolean) for every row of ``docs`` (doc_id, text)."""
    names = ["doc_id", *(f"p_{c}" for c in chain)]
    if not model.features:
        return docs.select("doc_id", *(F.lit(0.0).alias(c) for c in names[1:]), F.lit(False).alias(chain[-1]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(model.features)
        for batch in batches:
            for part in pieces(batch, PIECE_ROWS, PIECE_BYTES):
                x = np.zeros((part.num_rows, len(model.features)))
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids, n = count(t)
                    x[i, ids] = n
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p) for p in model.predict(x).T)], names)

    kinds = "doc_id long, " + ", ".join(f"`{c}` double" for c in names[1:])
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, kinds)
    return out.withColumn(chain[-1], F.col(names[-1]) >= F.lit(model.threshold))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train_chain(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
