"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on the document ids.

Texts are dealt to ranges of ascending doc_id and sorted there, encoded inside the tasks, and written by Spark's
ORC writer as one row for each document: its id and the array of its token ids, which ORC run-length encodes.
Each file holds many stripes that tasks read in parallel; the stripes' statistics, row indexes and Bloom
filters on doc_id let a reader skip what it does not need. ``start`` is a running sum over files, then inside
a file.

Edge cases: a null or empty text has the end id alone; repeated rows and equal ids are separate documents, ordered by
their text's hash; null ids come first; an empty table writes files without rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, pieces, table, tasks_for, through_table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
STRIPE_BYTES = 8 << 20
INDEX_ROWS = 1_000
#: Texts are encoded so many, or so many bytes, at once: the more, the fewer words are looked up.
PIECE_ROWS, PIECE_BYTES = 3_000, 6 << 20
#: Words whose ids a Python worker remembers at once.
MEMORY_WORDS = 1_000_000


#: What a tokenizer does to text before its merges, if it never joins text across a space and each word of letters is a piece of its own.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
MARKS = ".,"
UNKNOWN = -(1 << 62)


def gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after another."""
    return values[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


class Encoder:
    """The tokenizer's ids for whole texts.

    If it works by WORD_STEPS, texts are cut at spaces, and each distinct word is encoded by the library once and remembered;
    a stop or comma behind letters is a piece of its own. Texts for which that may not hold (not in Unicode's composed form, or
    with letters whose lower case depends on their place) go to the library whole, as do all texts with another tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.by_words = all(steps[k] == v for k, v in WORD_STEPS.items()) and steps["model"].get("end_of_word_suffix") == "</w>"
        ends = [i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.forget()

    def forget(self) -> None:
        #: For each word the number of its entry, or -1 - (2 * the entry of its letters + the mark behind them).
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.begins, self.lengths = np.zeros(1 << 14, "i8"), np.zeros(1 << 14, "i8")
        self.entries = 0
        self.add([""], np.zeros(0, "<u4"), np.zeros(1, "i8"))
        for mark in MARKS:
            ids = self.whole(mark)
            self.add([mark], ids, np.array([len(ids)]))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember the ids of ``words``, which follow each other in ``ids``."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.entries + len(words) > len(self.begins):
            self.begins, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        own = slice(self.entries, self.entries + len(words))
        self.lengths[own], self.begins[own] = lengths, self.used + np.cumsum(lengths) - lengths
        self.known.update(zip(words, range(self.entries, self.entries + len(words)), strict=True))
        self.used, self.entries = self.used + len(ids), self.entries + len(words)

    def learn(self, words: list[str]) -> None:
        """Remember new ``words``."""
        stems = {w: w[:-1] for w in words if w[-1] in MARKS and w[:-1].isalpha()}
        new = {x for w in words if (x := stems.get(w, w)) not in self.known}
        plain, rest = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        parts = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        lines = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        for part, line in zip(parts, lines, strict=True):
            ids = np.array(line.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self.add(part, ids, np.diff(cuts, prepend=0))
            else:
                rest += part
        for w, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.add([w], np.array(found.ids, "<u4"), np.array([len(found.ids)]))
        for w, stem in stems.items():
            self.known[w] = -1 - (2 * self.known[stem] + MARKS.index(w[-1]))

    def by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and where each text's begin; they are in lower case and cut at spaces."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        distinct = words.flatten().dictionary_encode()
        names = distinct.dictionary.to_pylist()
        codes = np.fromiter(map(self.known.get, names, repeat(UNKNOWN)), "i8", len(names))
        new = np.flatnonzero(codes == UNKNOWN).tolist()
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.forget()
            new = [k for k, w in enumerate(names) if w not in self.known]
            codes = np.fromiter(map(self.known.get, names, repeat(UNKNOWN)), "i8", len(names))
        self.learn([names[k] for k in new])
        codes[new] = [self.known[names[k]] for k in new]
        codes = codes[distinct.indices.to_numpy()]
        double = codes < 0
        stem, mark = np.where(double, (-1 - codes) >> 1, codes), 1 + ((-1 - codes) & 1)
        entries = np.repeat(stem, 1 + double)
        entries[(np.cumsum(1 + double) - 1)[double]] = mark[double]
        lengths = self.lengths[entries]
        ends = np.concatenate([[0], np.cumsum(self.lengths[stem] + np.where(double, self.lengths[mark], 0))])
        return gathered(self.ids, self.begins[entries], lengths), ends[words.offsets.to_numpy()]

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, each followed by ``end_id``, and where each text's begin."""
        lines, odd = [], []
        for i, text in enumerate(texts):
            if self.by_words and (not text or unicodedata.is_normalized("NFC", text) and not ("İ" in text or "Σ" in text or "<|" in text)):
                lines.append((text or "").lower().replace("\n", " "))
            else:
                lines.append("")
                odd.append(i)
        ids, begins = self.by_word(lines)
        if odd:
            parts = [ids[a:b] for a, b in zip(begins, begins[1:], strict=False)]
            for i in odd:
                parts[i] = self.whole(texts[i] or "")
            ids, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        out = np.full(len(ids) + len(texts), end_id, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(begins))] = ids
        return out, begins + np.arange(len(begins))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, to: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, tasks: int | None = None) -> None:
    """Write (doc_id, token_ids) of ``docs`` (doc_id, text) as ORC files below ``to``, in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            for part in pieces(batch, PIECE_ROWS, PIECE_BYTES):
                ids, begins = coder.encode(part.column(1).to_pylist(), end_id)
                values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(begins.astype("i4")), values)], ["doc_id", "token_ids"])

    tasks = tasks or tasks_for(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # documents of one id, or of none, are dealt to several tasks by their texts
    dealt = docs.select("doc_id", "text").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": INDEX_ROWS, "orc.stripe.size": STRIPE_BYTES, "orc.rows.between.memory.checks": 100, "orc.encoding.strategy": "COMPRESSION"}
    dealt.mapInArrow(encode, "doc_id long, token_ids array<int>").write.options(**options).orc(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, token_ids array<int>").orc(path)


def token_digests(stored: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, file, nth) of each stored document, nth counting the rows of its partition's stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype("i8")), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], ["doc_id", "n_tokens", "ids_crc32", "file", "nth"])

    rows = stored.select("doc_id", "token_ids", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("nth"))
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, file string, nth long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add start: the ids of all documents before, in ascending order. Windows run inside a file, and over one row for each file."""
    order = [F.col("doc_id").asc_nulls_first(), "nth"]
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "file")).alias("first"))
    before = F.sum("ids").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(files), "file").withColumn("start", F.col("base") + F.col("inside"))  # a row for each file


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), to)
    rows = through_table(token_digests(read_tokens(spark, to)), "token-digests")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op3_token_orc": op3_token_orc}
SQL: dict[str, str] = {}
