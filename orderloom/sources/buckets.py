"""Tables hashed by key into buckets, in versions: a run writes the buckets that its batch touches, the others stay as they are.

Below the path: ``data/version=n/bucket=b`` are rows, ``manifest/version=n`` says which versions hold each bucket's rows. A
version counts when its manifest is complete. Of two writers of one version, the one that makes its claim goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import claim, exists, names, remove

MANIFEST = "bucket int, held long"


@dataclass
class BucketedTable:
    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int = 64
    #: Versions that stay readable.
    keep: int = 3
    #: A claim older than this was left by a run that has died.
    claim_seconds: int = 6 * 3600

    def bucket(self) -> Column:
        text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys))
        return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Those that are complete, oldest first."""
        found = [int(n.split("=")[1]) for n in names(self.spark, f"{self.path}/manifest/version=*")]
        return sorted(v for v in found if exists(self.spark, f"{self.path}/manifest/version={v}/_SUCCESS"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> DataFrame:
        """(bucket, held): the versions that hold the rows of each bucket."""
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}")

    def rows(self, version: int, only: list[int] | None = None, schema: DataFrame | None = None) -> DataFrame | None:
        """The rows of a version, or of its buckets ``only``; none of a frame like ``schema`` if there are none."""
        parts = self.manifest(version) if only is None else self.manifest(version).where(F.col("bucket").isin(only))
        paths = [f"{self.path}/data/version={r.held}/bucket={r.bucket}" for r in parts.orderBy("bucket", "held").collect()]  # a row for each bucket and insert since it was written
        if paths:
            return self.spark.read.parquet(*paths)
        return schema.limit(0) if schema is not None else None

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of the keys of ``batch``: at most ``buckets`` numbers."""
        return sorted(r.b for r in batch.select(self.bucket().alias("b")).distinct().collect())

    @contextmanager
    def writing(self, version: int):
        """The right to write ``version``; an error if another run has it."""
        mark = f"{self.path}/claims/version={version}"
        if not claim(self.spark, mark, self.claim_seconds):
            raise RuntimeError(f"another run writes version {version} of {self.path}")
        try:
            yield
        finally:
            remove(self.spark, mark)

    def write(self, version: int, rows: DataFrame, touched: list[int] | None) -> None:
        """``rows`` as the rows of the buckets ``touched`` in ``version``; with None they are added to what their buckets hold."""
        data, before = f"{self.path}/data/version={version}", self.manifest(version - 1)
        keyed = rows.withColumn("bucket", self.bucket())
        keyed.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = [int(n.split("=")[1]) for n in names(self.spark, f"{data}/bucket=*")]
        new = self.spark.createDataFrame([(b, version) for b in written], MANIFEST)  # a row for each bucket
        kept = before if touched is None else before.where(~F.col("bucket").isin(touched))
        kept.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def expire(self) -> None:
        """Take away what the last ``keep`` versions do not hold."""
        versions = self.versions()
        old, live = versions[: -self.keep], versions[-self.keep :]
        held = {(r.bucket, r.held) for v in live for r in self.manifest(v).collect()}
        for v in old:
            mine = [int(n.split("=")[1]) for n in names(self.spark, f"{self.path}/data/version={v}/bucket=*")]
            for b in mine:
                if (b, v) not in held:
                    remove(self.spark, f"{self.path}/data/version={v}/bucket={b}")
            remove(self.spark, f"{self.path}/manifest/version={v}")


def merge(table: BucketedTable, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], schema: DataFrame) -> int:
    """A version in which ``change(old rows, batch)`` replaces the buckets that ``batch``, a stored table, touches; and its number. ``schema`` is a frame like the rows."""
    version = table.version()
    with table.writing(version + 1):
        touched = table.touched(batch)
        if not touched:
            return version
        table.write(version + 1, change(table.rows(version, touched, schema), batch), touched)
        table.expire()
    return version + 1
