"""Exactly-once ingestion of shipment files with Structured Streaming, one bad file at a time.

Two streams. The first carries new files: each batch lands its files by their own header in a folder of its own, valid rows beside
the rows that are not (with their text and reason), and writes what became of each file to the ledger: processing, then processed with
its rows, or failed with the error. A file that cannot be read is found by halving its batch, so the others go on. Files that the ledger
says to try again (failed, changed, or left while processing) are landed after that. The second stream carries the landed rows and drops
those whose hash it has seen; what it has seen is state of the stream (in RocksDB), so no batch reads what is stored.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from hashlib import md5

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shipment_files as S
from ..sources.storage import exists, move, remove, settings, stored

log = logging.getLogger(__name__)

FILE = "path string, modificationTime timestamp, length long, content binary"
PATTERN = "*.{csv,csv.gz}"
KEPT = "batch=*/group=*/kept=true"
#: Bytes of compressed text that a task reads: one large file, or some small ones.
PACKED_BYTES = "16m"
#: Bytes of landed rows in a batch of the second stream, whose shuffles are of about twice that size.
BATCH_BYTES = 512 << 20
#: After so many seconds, shuffles of finished batches go.
COLLECT_SECONDS = 10
#: State of streams in RocksDB, beyond the executors' heap; packed, as hashes are text, and without the versions that no restart needs.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@dataclass
class Outcome:
    """What became of the files of a batch: rows kept, or the error, by path."""

    rows: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def told(e: Exception) -> str:
    """An error in a line: its condition where Spark has one."""
    found = e.getCondition() if isinstance(e, PySparkException) else None
    return f"{type(e).__name__}: {found or (str(e).strip().splitlines() or [''])[0]}"[:300]


class Landing:
    """Where the rows of files are written first: a folder for each batch, and one for each header in it."""

    def __init__(self, spark: SparkSession, to: str, at: Column, multi_line: bool):
        self.spark, self.to, self.at, self.multi_line = spark, f"{to}/landing", at, multi_line

    def write(self, paths: list[str], header: list[str], to: str, batch: str) -> dict[str, int]:
        """Rows kept of each file, counted from what was written."""
        df, _ = S.read_csv(self.spark, paths, header=header, multi_line=self.multi_line)
        plain = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "^[a-z0-9]+:/*", "/")
        rows = S.split_rows(df.withColumn("path_", plain), batch, self.at)
        with settings(self.spark, {"spark.sql.files.maxPartitionBytes": PACKED_BYTES} if any(p.endswith(".gz") for p in paths) else {}):
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("kept").parquet(to)
        kept = self.spark.read.schema(rows.schema).parquet(to).where("kept").groupBy("path_").agg(F.count(F.lit(1)).alias("n"))
        got = {r.path_: r.n for r in kept.collect()}  # a row for each file of a batch
        return {p: got.get(_key(p), 0) for p in paths}

    def load(self, paths: list[str], batch: str) -> Outcome:
        """Land files whose rows become those of ``batch``; a batch that is run again replaces what it wrote."""
        out, groups = Outcome(), {}
        remove(self.spark, f"{self.to}/batch={batch}")
        for path in paths:
            try:
                names = S.header_of(self.spark, path)
                if lost := [c for c in S.REQUIRED if c not in names]:
                    raise ValueError(f"missing required fields: {', '.join(lost)}")
                groups.setdefault(tuple(names), []).append(path)
            except Exception as e:  # whatever is wrong with this file stays with it
                out.errors[path] = told(e)
        for k, header in enumerate(sorted(groups)):
            self._halve(groups[header], list(header), f"{self.to}/batch={batch}/group={k}", batch, out)
        return out

    def _halve(self, paths: list[str], header: list[str], to: str, batch: str, out: Outcome) -> None:
        try:
            out.rows |= self.write(paths, header, to, batch)
        except Exception as e:
            remove(self.spark, to)
            if len(paths) == 1:
                out.errors[paths[0]] = told(e)
                return
            half = len(paths) // 2
            self._halve(paths[:half], header, f"{to}.0", batch, out)
            self._halve(paths[half:], header, f"{to}.1", batch, out)


def _key(path: str) -> str:
    """A path without its scheme."""
    return "/" + path.split(":", 1)[-1].lstrip("/")


class Ledger:
    def __init__(self, spark: SparkSession, path: str, at: Column):
        self.spark, self.path, self.at = spark, path, at

    def log(self) -> DataFrame:
        return stored(self.spark, self.path, S.LEDGER)

    def begin(self, files: DataFrame) -> None:
        S.ledger_mark(files, "processing", self.at).write.mode("append").parquet(self.path)

    def end(self, files: DataFrame, out: Outcome) -> None:
        rows = [(p, "processed", n, None) for p, n in out.rows.items()] + [(p, "failed", None, e) for p, e in out.errors.items()]
        told = self.spark.createDataFrame(rows, "path string, status string, records long, error string")
        known = files.select("path", "size", "modified", "hash").join(F.broadcast(told), "path")  # a row for each file of a batch
        known.withColumn("at", self.at.cast("timestamp")).select(*(c.split()[0] for c in S.LEDGER.split(", "))).write.mode("append").parquet(self.path)


def listed(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("hash"))


def ingest_files(
    spark: SparkSession,
    folder: str,
    to: str,
    state: str,
    at: Column,
    most_files: int = 100,
    archive: str | None = None,
    multi_line: bool = False,
    tries: int = 3,
    stale_seconds: int = 3600,
) -> None:
    """Load all new files of ``folder``, and those to try again, into ``to`` and stop. With ``archive``, files that are processed go there."""
    stamp = spark.range(1).select(F.date_format(at, "yyyyMMdd_HHmmss")).first()[0] if archive else ""
    landing, ledger = Landing(spark, to, at, multi_line), Ledger(spark, f"{state}/ledger", at)

    def land(files: DataFrame, batch: str) -> None:
        paths = sorted(r.path for r in files.select("path").collect())  # at most most_files
        if not paths:
            return
        ledger.begin(files)
        out = landing.load(paths, batch)
        ledger.end(files, out)
        for path in out.rows if archive else ():
            try:
                move(spark, path, f"{archive}/{stamp}_{path.rsplit('/', 1)[-1]}")
            except Exception as e:  # the rows are stored: the file stays where it is
                log.warning("not archived: %s: %s", path, told(e))

    # decided before the new files are seen, so that each file is tried once in a run
    due = _to_try_again(spark, folder, ledger, stale_seconds, tries)
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", PATTERN).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files)
    # without their content, which each action on a batch would read again
    query = stream.load(folder).drop("content").writeStream.foreachBatch(lambda batch, n: land(listed(batch), str(n))).option("checkpointLocation", f"{state}/files").trigger(availableNow=True).start()
    query.awaitTermination()
    for k in range(0, len(due), most_files):
        some = due[k : k + most_files]
        files = spark.createDataFrame(some, "path string, size long, modified timestamp, hash string")
        land(files, "again-" + md5("\n".join(f"{r.path} {r.size} {r.modified}" for r in some).encode()).hexdigest())
    if exists(spark, f"{landing.to}/{KEPT}"):
        dedupe(spark, landing.to, f"{to}/rows", f"{state}/rows")


def _to_try_again(spark: SparkSession, folder: str, ledger: Ledger, stale_seconds: int, tries: int) -> list:
    """Files of the folder that the ledger knows and that are to be done: no row for the others, which stay in Spark."""
    if not exists(spark, ledger.path):
        return []
    files = listed(spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", True).load(folder))
    due = S.ledger_pending(files, ledger.log(), ledger.at, stale_seconds, tries).where("decision in ('retry', 'stale', 'changed')")
    return files.join(due.select("path"), "path", "left_semi").orderBy("modified", "path").collect()


def dedupe(spark: SparkSession, landing: str, to: str, checkpoint: str, key: str = "record_hash") -> None:
    """Append the landed valid rows that no batch had before to ``to``."""
    schema = spark.read.parquet(landing).drop("batch", "group", "kept", "path_").schema
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{landing}/{KEPT}")
    first_of_each(spark, rows.drop("line", "reason"), [key], to, checkpoint)


def first_of_each(spark: SparkSession, rows: DataFrame, keys: list[str], to: str, checkpoint: str) -> None:
    """Append those rows of a stream to ``to`` whose keys it has not had before, in this run or an earlier one, and stop."""
    with settings(spark, ROCKS):
        query = rows.dropDuplicates(keys).writeStream.format("parquet").option("path", to).option("compression", "zstd").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(COLLECT_SECONDS):
        spark._jvm.System.gc()  # Spark removes a finished batch's shuffles when the driver has collected its garbage


def ingested(spark: SparkSession, to: str) -> DataFrame:
    return spark.read.parquet(f"{to}/rows")


def quarantined(spark: SparkSession, to: str) -> DataFrame:
    """(source_file, line, reason) of the rows that were not kept."""
    return spark.read.parquet(f"{to}/landing").where("not kept").select("source_file", "line", "reason")
