"""Benchmark decontamination: training passages as queries on a BM25 index of the test items.

The index holds, for each term, its postings (item, BM25 impact) in item order, cut into blocks of items, with the
largest impact of each block. A passage is scored by block-max pruning: the largest impacts of its terms in groups of
blocks are summed; below every threshold the passage is skipped; otherwise only blocks whose summed block maxima reach a
threshold are opened, and their items scored exactly. All items above their threshold are retrieved, none is cut off by
a top-k. (Blocks are aligned over all terms, so one sum of block maxima for each block stands for the pivots of WAND: it opens
just the blocks that a pivot may stop in.) A threshold is a share of what a copy of the item scores, and never above what the shortest excerpt that would
be confirmed scores, wherever the passages cut it. A retrieved pair is confirmed if the document has, around one of the passages
retrieved, most of the word n-grams of the item's question and of its answer (its last sentence).

Items are a stated query set: distinct item texts are read in chunks of about ITEM_CHUNK, each with an index of its own, and each
chunk meets all documents; nothing of the documents is shuffled. Document frequencies and the mean length are those of all items.

Edge cases: null or blank texts and items match nothing; repeated rows give repeated results; equal items are reported
each; an empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, own_columns, pieces, table, through_table, with_rows

#: A passage is PASSAGE_WORDS words, a multiple of STRIDE; the last ones of a text are shorter.
PASSAGE_WORDS, STRIDE = 96, 32
THRESHOLD = 0.5
OVERLAP, GRAM = 0.6, 5
BLOCK_ITEMS = 4
GROUPS = 64
#: Items of one index: about so many texts, dealt by hash, are on the driver and in each worker.
ITEM_CHUNK = 20_000
K1, B = 1.2, 0.75
MEMORY_WORDS = 1_000_000
#: Documents searched at a time: so many rows, and about so many bytes.
PIECE_ROWS, PIECE_BYTES = 2_000, 8 << 20
MARKS = ".,;:!?\"'()[]{}<>|*%$#&-_/\\…«»“”„¿¡"
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, at_word int"


def words_of(text: str | None) -> list[str]:
    return [w for t in (text or "").lower().split() if (w := t.strip(MARKS))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a single sentence, the last third of its words."""
    sentences = [words for part in text.replace("\n", ". ").split(". ") if (words := words_of(part))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = words_of(text)
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def shortest_excerpt(question: list[str], answer: list[str]) -> list[str]:
    """The end of the question and the beginning of the answer that just pass the overlaps."""
    kept = []
    for part in (question[::-1], answer):
        n = min(GRAM, len(part))
        want, seen, j = len(grams(part, n)) if n else 0, set(), n
        while n and j < len(part):
            seen.add(tuple(part[j - n : j]))
            if len(seen) / want >= OVERLAP:
                break
            j += 1
        kept.append(part[:j])
    return kept[0][::-1] + kept[1]


def worst_passage(words: list[str], impact: dict[str, float]) -> float:
    """The score of the best passage over a stretch of words, where the passages' beginnings fall worst."""
    if len(words) <= PASSAGE_WORDS - STRIDE + 1:
        return sum(impact[w] for w in set(words))
    best, score, inside = [0.0] * STRIDE, 0.0, Counter()
    for end in range(PASSAGE_WORDS + len(words)):
        if end < len(words):
            inside[words[end]] += 1
            score += impact[words[end]] if inside[words[end]] == 1 else 0.0
        if (old := end - PASSAGE_WORDS) >= 0:
            inside[words[old]] -= 1
            score -= impact[words[old]] if inside[words[old]] == 0 else 0.0
        best[end % STRIDE] = max(best[end % STRIDE], score)
    return min(best)


class Index:
    """Postings with block maxima over (item, text) rows. ``all_items`` has their number, mean length and document frequencies if
    these rows are only a part of the items."""

    def __init__(self, items: list[tuple[int, str | None]], all_items: tuple[int, float, dict[str, int]] | None = None):
        items = [(i, t) for i, t in items if words_of(t)]
        counts = [Counter(words_of(t)) for _, t in items]
        n, lengths = len(items), [sum(c.values()) for c in counts]
        many, mean, df = all_items or (n, sum(lengths) / max(1, n), Counter(w for c in counts for w in c))
        mean = max(1.0, mean)
        impacts = []
        for c, length in zip(counts, lengths, strict=True):
            norm = K1 * (1 - B + B * length / mean)
            impacts.append({w: float(np.log(1 + (many - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)) for w, tf in c.items()})
        parts = [question_and_answer(t) for _, t in items]
        # a passage cannot hold more than its words of a long item; a little less, as sums are rounded
        own = [(1 - 1e-9) * min(THRESHOLD * worst_passage(q + a, x), worst_passage(shortest_excerpt(q, a), x)) for (q, a), x in zip(parts, impacts, strict=True)]
        # items are numbered by threshold, so that those of a block have similar ones
        order = sorted(range(n), key=lambda i: (own[i], i))
        self.items = [items[i] for i in order]
        self.threshold = np.array([own[i] for i in order])
        self.parts = [parts[i] for i in order]
        self.terms = {w: k for k, w in enumerate(sorted({w for x in impacts for w in x}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for k, i in enumerate(order):
            for w, x in impacts[i].items():
                postings[self.terms[w]].append((k, x))
        self.offsets = np.cumsum([0, *map(len, postings)])
        self.posting_items = np.array([i for p in postings for i, _ in p], "i4")
        self.impacts = np.array([x for p in postings for _, x in p], "f8")
        # block maxima, as rows (term, block, impact) in term order
        self.blocks = max(1, -(-n // BLOCK_ITEMS))
        best: list[dict[int, float]] = []
        for p in postings:
            most: dict[int, float] = {}
            for i, x in p:
                most[i // BLOCK_ITEMS] = max(most.get(i // BLOCK_ITEMS, 0.0), x)
            best.append(most)
        self.block_offsets = np.cumsum([0, *map(len, best)])
        self.block_ids = np.array([b for m in best for b in m], "i4")
        self.block_most = np.array([x for m in best for x in m.values()], "f8")
        padded = np.full(self.blocks * BLOCK_ITEMS, np.inf)
        padded[:n] = self.threshold
        self.block_threshold = padded.reshape(-1, BLOCK_ITEMS).min(1)
        # the same for at most GROUPS runs of blocks, as a dense table
        run = -(-self.blocks // GROUPS)
        group = np.arange(self.blocks) // run
        self.group_threshold = np.full(int(group[-1]) + 1, np.inf)
        np.minimum.at(self.group_threshold, group, self.block_threshold)
        self.group_most = np.zeros((len(self.terms), len(self.group_threshold)), "f4")
        rows = np.repeat(np.arange(len(self.terms)), np.diff(self.block_offsets))
        np.maximum.at(self.group_most, (rows, group[self.block_ids]), self.block_most)

    @staticmethod
    def _slices(offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
        begins, lengths = offsets[terms], offsets[terms + 1] - offsets[terms]
        return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item index, score) of all items that reach their threshold for a passage of these distinct terms."""
        at = self._slices(self.block_offsets, terms)
        bounds = np.bincount(self.block_ids[at], self.block_most[at], self.blocks)
        opened = bounds >= self.block_threshold
        if not opened.any():
            return []
        at = self._slices(self.offsets, terms)
        at = at[opened[self.posting_items[at] // BLOCK_ITEMS]]
        scores = np.bincount(self.posting_items[at], self.impacts[at], len(self.items))
        return [(int(i), float(scores[i])) for i in np.flatnonzero((scores >= self.threshold) & (scores > 0))]


class Memory(dict):
    """Term numbers of raw words as they come, -1 for words that no item has."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY_WORDS:
            self.clear()
        self[word] = found = self.terms.get(word.strip(MARKS), -1)
        return found


def matches(index: Index, memory: Memory, text: str | None) -> list[tuple[int, float, float, float, int]]:
    """(item index, score, question overlap, answer overlap, first word of the best passage) for one whole text."""
    raw = (text or "").lower().split()
    if not raw:
        return []
    terms = np.fromiter(map(memory.__getitem__, raw), "i8", len(raw))
    # bounds of passages: distinct terms of each stretch of STRIDE words, summed over the stretches of a passage
    at = np.flatnonzero(terms >= 0)
    pairs = np.unique((at // STRIDE) * len(index.terms) + terms[at]) if len(at) else at
    if not len(pairs):
        return []
    stretch, own = np.divmod(pairs, len(index.terms))
    begins = np.flatnonzero(np.diff(stretch, prepend=-1))
    bounds = np.zeros((-(-len(raw) // STRIDE) + PASSAGE_WORDS // STRIDE - 1, index.group_most.shape[1]))
    bounds[stretch[begins]] = np.add.reduceat(index.group_most[own], begins)
    passages = sum(bounds[k : len(bounds) - PASSAGE_WORDS // STRIDE + 1 + k] for k in range(PASSAGE_WORDS // STRIDE))
    found: dict[int, list[tuple[int, float]]] = {}
    for a in (np.flatnonzero((passages * 1.0001 >= index.group_threshold).any(1)) * STRIDE).tolist():
        own = np.unique(terms[a : a + PASSAGE_WORDS])
        own = own[own >= 0]
        for i, score in index.search(own):
            found.setdefault(i, []).append((a, score))
    out = []
    for i, hits in sorted(found.items()):
        question, answer = index.parts[i]
        # an item may reach over its passage on both sides; passages that are near are looked at together
        reach = len(question) + len(answer)
        wanted = [(n, grams(part, n) if n else set()) for part in (question, answer) for n in [min(GRAM, len(part))]]
        stretches: list[list] = []
        for a, score in hits:
            if stretches and a - reach <= stretches[-1][1]:
                stretches[-1][1] = a + PASSAGE_WORDS + reach
                stretches[-1][2] = max(stretches[-1][2], (score, -a))
            else:
                stretches.append([max(0, a - reach), a + PASSAGE_WORDS + reach, (score, -a)])
        best = None
        for begin, end, (score, a) in stretches:
            near = [w for t in raw[begin:end] if (w := t.strip(MARKS))]
            overlaps = [len(want & grams(near, n)) / len(want) if want else 1.0 for n, want in wanted]
            if min(overlaps) >= OVERLAP:
                best = max(best or (0.0,), (min(overlaps), score, *overlaps, a))
        if best:
            out.append((i, best[1], best[2], best[3], -best[4]))
    return out


def term_statistics(texts: DataFrame) -> tuple[int, float, DataFrame]:
    """The number of ``texts`` (text) with words, their mean length, and (word, df)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(set(w)) for w in words], pa.list_(pa.string())), pa.array(list(map(len, words)), pa.int64())], ["words", "length"])

    cut = through_table(texts.select("text").mapInArrow(split, "words array<string>, length long"), "item-words").where("length > 0")
    total = cut.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    return total.n, total.mean or 0.0, through_table(cut.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "item-df")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, at_word): every confirmed pair. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    texts = with_rows(through_table(named.select("text").distinct(), "items"), "item")
    count = texts.count()
    chunks = max(1, -(-count // ITEM_CHUNK))
    many, mean, df = term_statistics(texts) if chunks > 1 else (0, 0.0, None)
    parts = []
    for k in range(chunks):
        own = texts.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == k)
        rows = [(r.item, r.text) for r in own.orderBy("item").collect()]  # about ITEM_CHUNK texts
        known = None
        if df is not None:
            words = spark.createDataFrame([(w,) for w in sorted({w for _, t in rows for w in words_of(t)})], "word string")
            known = (many, mean, {r.word: r.df for r in words.join(df, "word").collect()})  # the words of this chunk
        index = spark.sparkContext.broadcast(Index(rows, known))

        def scan(batches: Iterator[pa.RecordBatch], shared=index) -> Iterator[pa.RecordBatch]:
            found = shared.value
            memory = Memory(found.terms)
            for batch in (part for whole in batches for part in pieces(whole, PIECE_ROWS, PIECE_BYTES)):
                rows = [(i, found.items[m[0]][0], *m[1:]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matches(found, memory, t)]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item", "score", "question_overlap", "answer_overlap", "at_word"])

        parts.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, RESULT.replace("item_id", "item")))
    ids = named.join(texts, "text").select("item", "item_id")
    return reduce(DataFrame.unionByName, parts).join(ids, "item").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "at_word")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` without a confirmed benchmark item."""
    row = free_name(docs, "row")
    numbered = with_rows(docs, row)
    hits = contaminated(numbered.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return numbered.join(hits, row, "left_anti").select(*own_columns(docs))


QUERIES = {"op2_decontamination": op2_decontamination}
SQL: dict[str, str] = {}
