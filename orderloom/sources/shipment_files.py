"""Shipment CSV files: reading by header, cleaning, the target schema; file manifests and the ledger of processed files."""

from __future__ import annotations

import csv
import io
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import record_hash
from .storage import first_bytes

# fixed values: the declared columns of shipment files, all text
COLUMNS = """shipment_id order_id tracking_number carrier shipping_method shipment_status shipped_date estimated_delivery_date actual_delivery_date
package_count total_weight weight_unit length width height dimension_unit shipping_cost insurance_cost currency
origin_street origin_city origin_state origin_postal_code origin_country
destination_street destination_city destination_state destination_postal_code destination_country
delivery_instructions signature_required delivered_to delivery_notes is_return return_reason return_date""".split()
REQUIRED = ["shipment_id", "order_id"]
NUMBERS = ["package_count", "total_weight", "shipping_cost", "insurance_cost"]
FLAGS = ["signature_required", "is_return"]
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": "", "columnNameOfCorruptRecord": "_corrupt_record"}


def declared_schema(columns: list[str] = COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), c not in REQUIRED) for c in columns])


def read_csv(spark: SparkSession, paths: str | list[str], columns: list[str] = COLUMNS, multi_line: bool = True, header: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Text columns bound by the header's names: missing ones are null, others only give a warning; and the warnings.

    All files of one call must share a header; broken rows keep their text in _corrupt_record. Without ``multi_line``, for files whose
    quoted fields hold no line breaks, a large file is read by several tasks.
    """
    options = CSV | {"multiLine": multi_line}
    header = header or spark.read.options(**options).csv(paths).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_corrupt_record"]])
    df = spark.read.options(**options).schema(schema).csv(paths)
    missing, extra = [c for c in columns if c not in header], [c for c in header if c not in columns]
    warnings = [f"missing column {c}" for c in missing] + [f"unknown column {c}" for c in extra]
    return df.select(*((F.col(c) if c in header else F.lit(None).cast("string").alias(c)) for c in columns), "_corrupt_record", F.col("_metadata.file_name").alias("source_file")), warnings


def read_with_fallback(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, list[str]]:
    """The declared columns where the header has the required ones; else an inferred schema."""
    df, warnings = read_csv(spark, paths)
    if any(f"missing column {c}" in warnings for c in REQUIRED):
        return spark.read.options(**CSV).option("inferSchema", True).csv(paths), [*warnings, "schema was inferred"]
    return df, warnings


def validated(df: DataFrame) -> DataFrame:
    """Cleaned rows with is_valid; rows without a required field are kept apart by is_valid = false."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required fields: {missing}")
    clean = {c: F.nullif(F.trim(c), F.lit("")) for c, kind in df.dtypes if kind == "string"}
    df = df.withColumns(clean)
    have = set(df.columns)
    word = {c: F.when(F.upper(c).isin("TRUE", "YES", "1", "Y"), "true").when(F.upper(c).isin("FALSE", "NO", "0", "N"), "false") for c in FLAGS if c in have}
    number = {c: F.nullif(F.regexp_replace(c, "[^0-9.]", ""), F.lit("")) for c in NUMBERS if c in have}
    code = {"currency": F.when(F.upper("currency").rlike("^[A-Z]{3}$"), F.upper("currency"))} if "currency" in have else {}
    return df.withColumns(word | number | code).withColumn("is_valid", F.col("shipment_id").isNotNull() & F.col("order_id").isNotNull())


def validation_stats(df: DataFrame) -> DataFrame:
    n, good = F.count(F.lit(1)), F.count_if("is_valid")
    return df.agg(n.alias("original_rows"), good.alias("valid_rows"), (n - good).alias("invalid_rows"), F.coalesce(F.try_divide(good.cast("double"), n.cast("double")), F.lit(0.0)).alias("validation_rate"))


def add_lineage(df: DataFrame, source_system: str, batch_id: str, at: Column) -> DataFrame:
    """Lineage columns; the hash covers business columns alone, so that equal rows match."""
    own = [c for c in df.columns if c in COLUMNS]
    return df.withColumns({"source_system": F.lit(source_system), "batch_id": F.lit(batch_id), "ingestion_timestamp": at, "record_hash": record_hash(*own), "row_id": F.monotonically_increasing_id()})


def target_schema(df: DataFrame, *more: str) -> DataFrame:
    """Addresses and dimensions packed as JSON, defaults, typed columns; and the columns ``more``."""

    def packed(prefix: str) -> Column:
        parts = ["street", "city", "state", "postal_code", "country"]
        whole = F.to_json(F.struct(*(F.col(f"{prefix}_{p}").alias(p) for p in parts)))
        return F.when(F.coalesce(*(F.col(f"{prefix}_{p}") for p in parts)).isNotNull(), whole)

    size = F.to_json(F.struct(*(F.col(c).try_cast("double").alias(c) for c in ("length", "width", "height")), F.col("dimension_unit").alias("unit")))
    plain = ["shipment_id", "order_id", "tracking_number", "carrier", "shipping_method", "shipment_status", "currency", "delivery_instructions", "delivered_to", "delivery_notes", "return_reason"]
    kept = [c for c in ("source_system", "source_file", "batch_id", "ingestion_timestamp", "record_hash", "is_valid") if c in df.columns]
    return df.select(
        *plain,
        *(F.col(c).try_cast("timestamp_ntz").alias(c) for c in ("shipped_date", "estimated_delivery_date", "actual_delivery_date", "return_date")),
        F.col("package_count").try_cast("int").alias("package_count"),
        F.col("total_weight").try_cast("decimal(10,3)").alias("total_weight"),
        F.coalesce("weight_unit", F.lit("kg")).alias("weight_unit"),
        *(F.col(c).try_cast("decimal(10,2)").alias(c) for c in ("shipping_cost", "insurance_cost")),
        *(F.col(c).cast("boolean").alias(c) for c in FLAGS),
        packed("origin").alias("origin_address"),
        packed("destination").alias("destination_address"),
        F.when(F.coalesce("length", "width", "height").isNotNull(), size).alias("dimensions"),
        *kept,
        *more,
    )


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The header's names, which may be quoted and hold line breaks: only the first bytes of the file are read."""
    names = next(csv.reader(io.StringIO(first_bytes(spark, path).decode("utf-8-sig", "replace"), newline="")), None)
    if not names:
        raise ValueError("no header")
    return names


def split_rows(df: DataFrame, batch_id: str, at: Column) -> DataFrame:
    """Rows of ``read_csv`` in the target schema with kept; for those that are not, ``line`` is their text and ``reason`` what is wrong."""
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.nullif(F.trim(c), F.lit("")).isNull(), F.lit(c)) for c in REQUIRED))), ", ")
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(missing != "", F.concat(F.lit("missing "), missing))
    line = F.coalesce("_corrupt_record", F.to_csv(F.struct(*COLUMNS)))
    told = df.withColumns({"reason_": reason, "line_": F.when(reason.isNotNull(), line)})
    typed = target_schema(add_lineage(validated(told.drop("_corrupt_record")), "csv", batch_id, at), "reason_", "line_", *(c for c in ("path_",) if c in df.columns))
    return typed.withColumn("kept", F.col("reason_").isNull()).withColumnsRenamed({"reason_": "reason", "line_": "line"})


def load_file(spark: SparkSession, paths: str | list[str], batch_id: str, at: Column, to: str, **how) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write files to ``to`` in one pass: valid rows in the target schema, and the rows that are not (source_file, line, reason). Gives both, and counts observed by the write."""
    df, _ = read_csv(spark, paths, **how)
    seen = Observation()
    rows = split_rows(df, batch_id, at).observe(seen, F.count(F.lit(1)).alias("original_rows"), F.count_if("kept").alias("valid_rows"), F.count_if(~F.col("kept")).alias("invalid_rows"))
    rows.write.mode("overwrite").partitionBy("kept").parquet(to)
    return *landed(spark, to, rows.schema), seen.get


def landed(spark: SparkSession, to: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """What ``split_rows`` has stored: valid rows, and the others with their text and reason."""
    rows = spark.read.schema(schema).parquet(to)
    return rows.where("kept").drop("kept", "line", "reason"), rows.where("not kept").select("source_file", "line", "reason")


# --- manifests


def manifest(spark: SparkSession, folder: str, pattern: str = "*.csv", hashes: bool = True, before: DataFrame | None = None) -> DataFrame:
    """(path, size, modified, hash) of the files of a folder. The hash sums up the lines of a text file, so that large files are read in pieces. Spark lists no empty files.

    With ``before``, an earlier listing, only files whose size or time has moved are read; the others keep their hash.
    """
    where = {"pathGlobFilter": pattern, "recursiveFileLookup": True}
    files = spark.read.format("binaryFile").options(**where).load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if not hashes:
        return files.withColumn("hash", F.lit(None).cast("string"))
    if before is None:
        return files.join(line_hashes(spark.read.options(**where).text(folder)), "path", "left")
    known = before.select("path", F.col("size").alias("b_size"), F.col("modified").alias("b_modified"), F.col("hash").alias("b_hash"))
    files = files.join(known, "path", "left")
    same = (F.col("size") == F.col("b_size")) & (F.col("modified") == F.col("b_modified")) & F.col("b_hash").isNotNull()
    moved = [r.path for r in files.where(~F.coalesce(same, F.lit(False))).select("path").collect()]  # paths of files that have moved
    fresh = line_hashes(spark.read.text([unquote(p) for p in moved])) if moved else spark.createDataFrame([], "path string, hash string")
    return files.join(fresh, "path", "left").select("path", "size", "modified", F.when(same, F.col("b_hash")).otherwise(F.col("hash")).alias("hash"))


def line_hashes(lines: DataFrame) -> DataFrame:
    """(path, hash): number, exclusive or and sum of the lines' hashes, whatever their order."""
    line = F.conv(F.substring(F.md5("value"), 1, 15), 16, 10).cast("long")
    summed = F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(line), F.sum(line.cast("decimal(38,0)")).cast("string"))
    return lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(summed.alias("hash"))


def file_changes(now: DataFrame, before: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(path, change): new, changed or deleted."""
    j = now.select("path", *(F.col(c).alias(f"n_{c}") for c in ("size", "modified", "hash"))).join(before.select("path", *(F.col(c).alias(f"b_{c}") for c in ("size", "modified", "hash"))), "path", "full")
    moved = F.abs(F.col("n_modified").cast("double") - F.col("b_modified").cast("double")) > tolerance
    differs = (F.col("n_size") != F.col("b_size")) | moved | F.coalesce(F.col("n_hash") != F.col("b_hash"), F.lit(False))
    change = F.when(F.col("b_size").isNull(), "new").when(F.col("n_size").isNull(), "deleted").when(differs, "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def file_filter(files: DataFrame, least: int = 0, most: int | None = None, hours: float | None = None, now: Column | None = None) -> DataFrame:
    out = files.where(F.col("size") >= least)
    if most is not None:
        out = out.where(F.col("size") <= most)
    if hours is not None:
        out = out.where(F.col("modified") >= now - F.make_dt_interval(hours=F.lit(int(hours))))
    return out


ORDERS = {"oldest": ("modified", True), "newest": ("modified", False), "smallest": ("size", True), "largest": ("size", False)}


def file_priority(files: DataFrame, mode: str, most: int) -> DataFrame:
    """The first ``most`` files; an unknown mode means the oldest first."""
    c, up = ORDERS.get(mode, ORDERS["oldest"])
    return files.orderBy(F.col(c).asc() if up else F.col(c).desc(), "path").limit(most)


def file_stats(files: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), zero).alias("total"), F.coalesce(F.floor(F.avg("size")), zero).alias("mean"), F.coalesce(F.min("size"), zero).alias("least"), F.coalesce(F.max("size"), zero).alias("most"), F.min_by("path", "modified").alias("oldest"), F.max_by("path", "modified").alias("newest"))


def file_ready(files: DataFrame, most: int = 1 << 30) -> DataFrame:
    reason = F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty").when(F.col("size") > most, "too large").otherwise("ok")
    return files.select("path", (reason == "ok").alias("is_ready"), reason.alias("reason"))


# --- the ledger: an append-only log (path, size, modified, hash, status, records, error, at)


def ledger_mark(files: DataFrame, status: str, at: Column, records: Column | None = None, error: str | None = None) -> DataFrame:
    return files.select("path", "size", "modified", "hash", F.lit(status).alias("status"), (records if records is not None else F.lit(None)).cast("long").alias("records"), F.lit(error).cast("string").alias("error"), at.cast("timestamp").alias("at"))


LEDGER = "path string, size long, modified timestamp, hash string, status string, records long, error string, at timestamp"
#: What a run appends for a file, in order: entries of one time are told apart by it.
STEPS = ["pending", "processing", "failed", "processed"]


def ledger_state(log: DataFrame) -> DataFrame:
    """The last entry of each path, with attempts, the times that it was begun."""
    rest = [c for c in log.columns if c != "path"]
    order = F.struct("at", F.array_position(F.array(*map(F.lit, STEPS)), F.col("status")))
    return log.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("last"), F.count_if(F.col("status") == "processing").alias("attempts")).select("path", "last.*", "attempts")


def ledger_pending(files: DataFrame, log: DataFrame, now: Column, stale_seconds: int = 3600, tries: int | None = None) -> DataFrame:
    """(path, decision): new, changed, retry or stale for files to process; skip for the others, and for those that have failed ``tries`` times."""
    s = ledger_state(log).select("path", F.col("status").alias("s_status"), F.col("size").alias("s_size"), F.col("hash").alias("s_hash"), F.col("modified").alias("s_modified"), F.col("at").alias("s_at"), "attempts")
    j = files.join(s, "path", "left")
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("s_at")
    changed = (F.col("size") != F.col("s_size")) | F.coalesce(F.col("hash") != F.col("s_hash"), F.lit(False))
    if tries is not None:  # a file that has changed since then has its tries again
        same = ~changed & (F.col("modified") == F.col("s_modified"))
        j = j.withColumn("s_status", F.when((F.col("s_status") == "failed") & same & (F.col("attempts") >= tries), "given up").otherwise(F.col("s_status")))
    decision = (
        F.when(F.col("size") == 0, "skip").when(F.col("s_status").isNull(), "new").when((F.col("s_status") == "processed") & changed, "changed").when(F.col("s_status").isin("failed", "pending"), "retry").when((F.col("s_status") == "processing") & (age >= stale_seconds), "stale").otherwise("skip")
    )
    return j.select("path", decision.alias("decision"))


def ledger_stats(log: DataFrame) -> DataFrame:
    names = ("processed", "failed", "processing")
    out = ledger_state(log).agg(F.count(F.lit(1)).alias("files"), *(F.count_if(F.col("status") == n).alias(n) for n in names), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    return out.withColumn("success_rate", F.coalesce(F.try_divide(F.col("processed").cast("double"), F.col("files").cast("double")), F.lit(0.0)))


def ledger_reset_failed(log: DataFrame, at: Column) -> DataFrame:
    """Entries to append so that failed files are tried again."""
    return ledger_state(log).where("status = 'failed'").drop("attempts").withColumns({"status": F.lit("pending"), "at": at.cast("timestamp")}).select(*log.columns)


def ledger_retained(log: DataFrame, files: DataFrame, now: Column, days: int) -> DataFrame:
    """The log without files that are gone and without processed ones older than ``days``."""
    state = ledger_state(log).join(files.select("path"), "path", "left_semi")
    old = (F.col("status") == "processed") & (F.datediff(now, "at") > days)
    return log.join(state.where(~old).select("path"), "path", "left_semi")


def ledger_export(log: DataFrame, path: str) -> None:
    """The last entry of each file as JSON, with the totals of all files in every line."""
    totals = ledger_stats(log).select(F.struct("*").alias("totals"))
    ledger_state(log).drop("attempts").join(F.broadcast(totals)).write.json(path)  # one row
