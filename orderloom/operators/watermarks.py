"""High-water marks in an append-only log: set, backup, restore to a backup or to a point in time, list with ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stored

LOG = "table_name string, column_name string, watermark timestamp_ntz, version long, written_at timestamp_ntz, kind string, label string, entry long"
KEYS = ["table_name", "column_name"]


def plain_name(name: Column) -> Column:
    """A table's name without its schema."""
    return F.element_at(F.split(name, r"\."), -1)


class Watermarks:
    """The log at ``path``. Entries count up, so that those of one time have an order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        return stored(self.spark, self.path, LOG)

    def _append(self, rows: DataFrame, kind: str, at: Column, label: str | None = None) -> None:
        last = self.log().agg(F.coalesce(F.max("entry"), F.lit(0)).alias("n")).first().n
        rows = rows.select(plain_name(F.col("table_name")).alias("table_name"), "column_name", F.col("watermark").cast("timestamp_ntz").alias("watermark"), F.col("version").cast("long").alias("version"))
        rows.select("*", at.cast("timestamp_ntz").alias("written_at"), F.lit(kind).alias("kind"), F.lit(label).cast("string").alias("label"), F.lit(last + 1).cast("long").alias("entry")).write.mode("append").parquet(self.path)

    def set(self, table: str, column: str, watermark: Column, at: Column, version: int | None = None) -> None:
        one = self.spark.range(1).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), watermark.alias("watermark"), F.lit(version).alias("version"))
        self._append(one, "set", at)

    def set_all(self, rows: DataFrame, at: Column) -> None:
        """Set the marks of ``rows`` (table_name, column_name, watermark)."""
        self._append(rows.withColumn("version", F.lit(None)), "set", at)

    def current(self, until: Column | None = None) -> DataFrame:
        """(table_name, column_name, watermark, version, written_at) of each mark, as of ``until``. The version is the largest one written."""
        log = self.log() if until is None else self.log().where(F.col("written_at") <= until)
        last = log.where("kind <> 'backup'").groupBy(*KEYS).agg(F.max_by(F.struct("watermark", "written_at"), "entry").alias("last"), F.max("version").alias("version"))
        return last.select(*KEYS, "last.watermark", "version", "last.written_at")

    def backup(self, label: str, at: Column) -> None:
        """Keep all marks as they are under ``label``."""
        self._append(self.current(), "backup", at, label)

    def restore(self, at: Column, label: str | None = None, until: Column | None = None) -> None:
        """Set the marks to those of the last backup ``label``, or to those of a point in time. Marks that it does not have stay."""
        if (label is None) == (until is None):
            raise ValueError("restore takes a label or a point in time")
        if label is None:
            rows = self.current(until)
        else:
            of = self.log().where((F.col("kind") == "backup") & (F.col("label") == label))
            last = of.agg(F.max("entry").alias("n")).first().n
            if last is None:
                raise ValueError(f"no backup {label}")
            rows = of.where(F.col("entry") == last)
        self._append(rows, "restore", at, label)

    def list(self, now: Column) -> DataFrame:
        """All marks with age_hours and the number of backups that have them."""
        kept = self.log().where("kind = 'backup'").groupBy(*KEYS).agg(F.countDistinct("entry").alias("backups"))
        age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("watermark").cast("timestamp"))) / 3600.0
        return self.current().join(kept, KEYS, "left").withColumns({"age_hours": age, "backups": F.coalesce("backups", F.lit(0))})
