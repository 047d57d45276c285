"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset and Spark runs locally (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to remove the files of a query's shuffles when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def through_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    The write's shuffles end with it. Else they stay on disk until the driver happens to collect its garbage, and add up over a job's writes.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(text: Column) -> Column:
    """Length of the text in UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Bits of a row number that count the rows of a file; the others number the files.
FILE_ROW_BITS = 36


def is_file_scan(df: DataFrame) -> bool:
    """Is ``df`` a Parquet table as it was read, so that each row has a file and a place there?"""
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return False
    try:
        return len(df.select("_metadata.file_path", "_metadata.row_index").columns) == 2
    except AnalysisException:  # no Parquet
        return False


def with_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with the column ``name``, a number for each row that is the same in every job, however the files are split into tasks.

    It is made of the row's file and its place there; a frame that is no table as read is written to the shared folder first.
    """
    if not is_file_scan(df):
        df = through_table(df, "numbered")
    file, at, no = (free_name(df, x) for x in ("file", "file_row", "file_number"))
    path = F.xxhash64("_metadata.file_path").alias(file)
    # a row for each file; by name, so that a rewritten table has the same order
    files = df.select(path, F.col("_metadata.file_name").alias(at)).distinct()
    files = files.select(file, F.row_number().over(Window.orderBy(at, file)).cast("long").alias(no))
    placed = df.select("*", path, F.col("_metadata.row_index").alias(at))
    number = (F.shiftleft(no, FILE_ROW_BITS) + F.col(at)).alias(name)
    return placed.join(F.broadcast(files), file).select(*own_columns(df), number)


def pieces(batch: pa.RecordBatch, rows: int, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``rows`` rows and about ``size`` bytes of text; a longer text is alone."""
    total, begin = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)), 0
    while begin < batch.num_rows:
        done = total[begin - 1] if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(total, done + size, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end
