"""Folders for tables that queries write: below spark.checkpoint.dir, which driver and executors share; an own one where it is unset."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Files of a query's shuffles end with the query. Else they stay until the driver happens to collect its garbage, and add up.
SHUFFLES_END = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: Rows that a task of a shuffle should get.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, about ``rows`` long, hashed by columns into as many parts as keep a task small: joins and windows by these columns need no other shuffle."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder of this name? The name may hold wildcards."""
    fs, where = _file_system(spark, path)
    return bool(fs.globStatus(where))


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file; one that has the name already goes, and folders are made."""
    fs, where = _file_system(spark, path)
    _, there = _file_system(spark, to)
    fs.delete(there, False)
    fs.mkdirs(there.getParent())
    if not fs.rename(where, there):
        raise OSError(f"{path} cannot be moved to {to}")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written by the driver."""
    fs, where = _file_system(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, pattern: str) -> list[str]:
    """Last parts of the paths that a name with wildcards finds."""
    fs, where = _file_system(spark, pattern)
    return [x.getPath().getName() for x in fs.globStatus(where) or []]


def claim(spark: SparkSession, path: str, seconds: int) -> bool:
    """Make an empty file; false if there is one already that is not older than ``seconds``, so that of several writers one alone goes on."""
    fs, where = _file_system(spark, path)
    if fs.exists(where) and fs.getFileStatus(where).getModificationTime() < (time.time() - seconds) * 1000:
        fs.delete(where, False)
    return fs.createNewFile(where)


def first_bytes(spark: SparkSession, path: str, most: int = 1 << 16) -> bytes:
    """The first bytes of a file, unpacked if its name says that it is compressed."""
    fs, where = _file_system(spark, path)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(where)
    stream = fs.open(where)
    try:
        return bytes((codec.createInputStream(stream) if codec else stream).readNBytes(most))
    finally:
        stream.close()


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; without rows where nothing is there yet. A table that cannot be read is an error."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def load_table(df: DataFrame, path: str, if_exists: str = "append") -> None:
    """append, replace or fail."""
    df.write.mode({"append": "append", "replace": "overwrite", "fail": "errorifexists"}[if_exists]).parquet(path)


def materialize(df: DataFrame, name: str, layer: str, partition_by: list[str] | None = None, path: str | None = None) -> None:
    """A view for staging and intermediate models, a table for marts, at ``path`` if it is given."""
    if layer in ("staging", "intermediate"):
        df.createOrReplaceTempView(name)
    else:
        where = {"path": path} if path else {}
        df.write.mode("overwrite").options(**where).partitionBy(*(partition_by or [])).saveAsTable(name)


def refresh_partitions(build: Callable[[DataFrame], DataFrame], source: DataFrame, batch: DataFrame, part: Column, by: str, path: str) -> None:
    """Bring a mart partitioned by ``by`` up to date: ``build`` makes the partitions that ``batch`` touches anew from ``source``, and only these are replaced.

    ``part`` is a source row's partition. Rows of a null partition have one of their own.
    """
    touched = batch.select(part.alias("touched_")).distinct()  # a row for each partition
    rows = build(source.join(F.broadcast(touched), part.eqNullSafe(F.col("touched_")), "left_semi"))
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
