"""Fill-in-middle documents by secondary sort.

Each text is cut into units (runs of letters, or single other characters) and, by draws from its id, into prefix, middle and suffix.
It leaves its task as pieces of whole units, keyed by document and place in the output. One shuffle by document, sorted inside
partitions by document and place (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
``repartitionAndSortWithinPartitions``), streams each output's pieces in order into a digest, without holding it. The stream is
also read as a reader of the output would, by its markers, and its parts are sorted again, by their place in the original text,
inside the same partitions, to stream the restored text into a second digest.

Edge cases: a null or empty text, and one that holds a marker, is ``plain``; a null id draws like an empty one; equal or null ids
are separate documents (pieces are keyed by row); long texts are many pieces, of about CHUNK bytes or one longer unit; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, pieces, table, tasks_for, with_rows

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The order of the parts in the output of each form.
FORMS = {"plain": [], "psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}
#: The order of the parts in the text.
PLACE = {None: 0, PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
TRANSFORMED, SUFFIX_FIRST = 90, 20  # per cent
CHUNK = 32 << 10
PIECE_ROWS, PIECE_BYTES = 2_000, 4 << 20
FLUSH_BYTES = 2 << 20

PIECE = "row_ long, place_ long, doc_id_ {id}, n long, form string, prefix_chars long, middle_chars long, chunk binary"
PART = "row_ long, place_ long, doc_id_ {id}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, chunk binary"

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def draws(doc_id: object) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def plan(text: bytes, n: int, doc_id: object) -> tuple[str, int, int]:
    """Form, and the units before the middle and before the suffix."""
    h1, h2, h3, h4 = draws(doc_id)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in PLACE if m) or h3 % 100 >= TRANSFORMED:
        return "plain", 0, 0
    return ("spm" if h4 % 100 < SUFFIX_FIRST else "psm"), first, second


class Units:
    """Where the units of some texts begin."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], "i8")
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        line = np.frombuffer(b"".join(texts), "u1")
        lead, letter = (line & 0xC0) != 0x80, LETTER[line]
        after_letter = np.concatenate([[False], letter[:-1]])
        after_letter[self.begins[lengths > 0]] = False
        self.starts = np.flatnonzero(lead & ~(letter & after_letter))
        self.chars = np.concatenate([[0], np.cumsum(lead, dtype="i8")])
        self.low, self.high = np.searchsorted(self.starts, self.begins), np.searchsorted(self.starts, self.ends)

    def count(self, k: int) -> int:
        return int(self.high[k] - self.low[k])

    def offset(self, k: int, unit: int) -> int:
        """The byte at which a unit of text ``k`` begins; that after the last one is where the text ends."""
        return int(self.starts[self.low[k] + unit] - self.begins[k]) if unit < self.count(k) else int(self.ends[k] - self.begins[k])

    def chunks(self, k: int, text: bytes, begin: int, end: int) -> Iterator[bytes]:
        """``text[begin:end]`` in pieces of whole units of about CHUNK bytes."""
        base = int(self.begins[k])
        while end - begin > CHUNK:
            at = int(np.searchsorted(self.starts, base + begin + CHUNK, "right")) - 1
            cut = int(self.starts[at]) - base
            if cut <= begin:  # a unit longer than CHUNK
                cut = int(self.starts[at + 1]) - base if at + 1 < self.high[k] else end
            cut = min(cut, end)
            yield text[begin:cut]
            begin = cut
        if begin < end:
            yield text[begin:end]


def text_pieces(units: Units, k: int, text: bytes, doc_id: object) -> tuple[dict, list[bytes]]:
    """What is known of a document, and the pieces of its output in order."""
    n = units.count(k)
    form, first, second = plan(text, n, doc_id)
    facts = {"n": n, "form": form, "prefix_chars": None, "middle_chars": None}
    if form == "plain":
        return facts, list(units.chunks(k, text, 0, len(text))) or [b""]
    a, b = units.offset(k, first), units.offset(k, second)
    chars = units.chars[units.begins[k] + np.array([0, a, b])]
    facts |= {"prefix_chars": int(chars[1] - chars[0]), "middle_chars": int(chars[2] - chars[1])}
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    out: list[bytes] = []
    for marker in FORMS[form]:
        first_chunk, *more = [*units.chunks(k, text, *spans[marker])] or [b""]
        out += [marker + first_chunk, *more]
    return facts, out


def parts_of(form: str, chunks: Iterable[bytes]) -> Iterator[tuple[bytes | None, bytes]]:
    """(part, bytes) of an output that comes in chunks, cut anywhere: read by its markers, whose order the form gives."""
    expected, part, held = list(FORMS[form]), None, b""
    for chunk in chunks:
        held += chunk
        while expected and (at := held.find(expected[0])) >= 0:
            if at:
                yield part, held[:at]
            part, held = expected.pop(0), held[at + 3 :]
        ready = len(held) - 2 if expected else len(held)  # the last bytes may begin a marker
        if ready > 0:
            yield part, held[:ready]
            held = held[ready:]
    if held:
        yield part, held


def document_pieces(docs: DataFrame, row: str = "row") -> DataFrame:
    """Pieces of the outputs of ``docs`` (row, doc_id, text). What is known of a document is on its first piece."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_ROWS, PIECE_BYTES):
                texts = pc.fill_null(part.column("text").cast(pa.binary()), b"").to_pylist()
                units, rows = Units(texts), []
                for k, (at, doc_id, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True)):
                    facts, chunks = text_pieces(units, k, text, doc_id)
                    rows += [{"row_": at, "place_": p, "chunk": c} | (facts | {"doc_id_": doc_id} if p == 0 else {}) for p, c in enumerate(chunks)]
                yield from batches_of(rows, schema)

    out = PIECE.format(id=kind)
    schema = arrow_schema(docs.sparkSession, out)
    return docs.select(F.col(row).alias("row_"), "doc_id", "text").mapInArrow(run, out)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def batches_of(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pydict({f.name: [r.get(f.name) for r in rows] for f in schema}, schema)


def in_order(df: DataFrame) -> DataFrame:
    """The secondary sort: a document's pieces meet in one partition, in the order of their places."""
    return df.repartition(tasks_for(df.sparkSession), "row_").sortWithinPartitions("row_", "place_")


def documents_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """(first piece, chunks) of each document of sorted pieces; the chunks must be used before the next document."""
    rows = (r for batch in batches for r in batch.to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        first = ahead

        def own(first: dict = first) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead["row_"] == first["row_"]:
                yield ahead["chunk"]
                ahead = next(rows, None)

        yield first, own()


def outputs(docs: DataFrame, row: str = "row") -> DataFrame:
    """(row_, doc_id_, form, output): the transformed texts themselves, whose size is that of the texts."""
    kind = dict(docs.dtypes)["doc_id"]
    out = f"row_ long, doc_id_ {kind}, form string, output string"
    schema = arrow_schema(docs.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for first, chunks in documents_in(batches):
            text = b"".join(chunks)
            rows.append({"row_": first["row_"], "doc_id_": first["doc_id_"], "form": first["form"], "output": text.decode()})
            size += len(text)
            if size > FLUSH_BYTES or len(rows) >= PIECE_ROWS:
                yield from batches_of(rows, schema)
                rows, size = [], 0
        yield from batches_of(rows, schema)

    return in_order(document_pieces(docs, row)).mapInArrow(run, out)


def restored_texts(outs: DataFrame) -> DataFrame:
    """(row_, text): the original texts of ``outs`` (row_, form, output)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for form, output in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = sorted(((PLACE[p], k, c) for k, (p, c) in enumerate(parts_of(form, [output.encode()]))), key=lambda x: x[:2])
                texts.append(b"".join(c for *_, c in found).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row_", "text"])

    return outs.select("row_", "form", "output").mapInArrow(run, "row_ long, text string")


def round_trip(docs: DataFrame, row: str = "row") -> DataFrame:
    """(row_, doc_id_, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each document."""
    kind = dict(docs.dtypes)["doc_id"]
    part_ddl, last = PART.format(id=kind), 1 << 62
    result_ddl = f"row_ long, doc_id_ {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    part_schema, result_schema = (arrow_schema(docs.sparkSession, x) for x in (part_ddl, result_ddl))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest the outputs, and give their parts with their places in the original text; then what is known of the document."""
        rows, size = [], 0
        for first, chunks in documents_in(batches):
            digest = hashlib.sha256()

            def read(chunks: Iterator[bytes] = chunks, digest=digest) -> Iterator[bytes]:
                for c in chunks:
                    digest.update(c)
                    yield c

            for k, (part, chunk) in enumerate(parts_of(first["form"], read())):
                rows.append({"row_": first["row_"], "place_": (PLACE[part] << 40) + k, "chunk": chunk})
                size += len(chunk)
                if size > FLUSH_BYTES:
                    yield from batches_of(rows, part_schema)
                    rows, size = [], 0
            rows.append({**first, "place_": last, "chunk": None, "output_sha256": digest.hexdigest()})
            if len(rows) >= PIECE_ROWS:
                yield from batches_of(rows, part_schema)
                rows, size = [], 0
        yield from batches_of(rows, part_schema)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digest = [], hashlib.sha256()
        for batch in batches:
            for r in batch.to_pylist():
                if r["place_"] < last:
                    digest.update(r["chunk"])
                    continue
                rows.append(r | {"restored_sha256": digest.hexdigest()})
                digest = hashlib.sha256()
            if len(rows) >= PIECE_ROWS:
                yield from batches_of(rows, result_schema)
                rows = []
        yield from batches_of(rows, result_schema)

    parts = in_order(document_pieces(docs, row)).mapInArrow(assemble, part_ddl)
    # all parts of a document are in one partition already: only the order is new
    return parts.sortWithinPartitions("row_", "place_").mapInArrow(restore, result_ddl)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    row = free_name(docs, "row")
    return round_trip(with_rows(docs, row), row).select(F.col("doc_id_").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL_TEXT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
SQL = {"op13_fill_in_middle": SQL_TEXT}
