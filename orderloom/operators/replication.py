"""A replication run: what a source has above the stored watermark goes into a target table, then the watermark moves on.

The batch is written once, and counts, checks and the merge all read that. The target is a bucketed table: an upsert rewrites the
buckets that the batch touches, an insert rewrites none. The watermark is appended after the data, so that a run that fails leaves
both as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketedTable
from ..sources.storage import remove
from . import incremental as I
from . import quality as Q
from .watermarks import Watermarks


def target_table(spark: SparkSession, target: str, version: int) -> DataFrame | None:
    return BucketedTable(spark, target, []).rows(version)


def merged(old: DataFrame, new: DataFrame, keys: list[str], seen: Observation) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of their keys, each key once; ``seen`` gets inserted and updated from the pass that writes."""
    o = old.select(F.struct("*").alias("o_"), *(F.col(k).alias(f"ok_{n}") for n, k in enumerate(keys)))
    b = new.select(F.struct(*old.columns).alias("b_"), *(F.col(k).alias(f"bk_{n}") for n, k in enumerate(keys)))
    on = [F.col(f"ok_{n}") == F.col(f"bk_{n}") for n in range(len(keys))]
    both = o.join(b, on, "full").withColumn("both_", F.col("o_").isNotNull() & F.col("b_").isNotNull()).withColumn("new_", F.col("o_").isNull())
    counted = both.observe(seen, F.count_if("new_").alias("inserted"), F.count_if("both_").alias("updated"))
    return counted.select(F.coalesce("b_", "o_").alias("row_")).select("row_.*")


def apply_batch(table: BucketedTable, version: int, batch: DataFrame, mode: str, order: list[str], at: Column | None = None) -> tuple[int, int]:
    """Write ``batch``, a stored table, into the version after ``version``. Gives the rows inserted and updated."""
    with table.writing(version + 1):
        if mode == "insert":
            seen = Observation()
            table.write(version + 1, batch.observe(seen, F.count(F.lit(1)).alias("n")), None)
            counts = seen.get["n"], 0
        else:
            touched, seen = table.touched(batch), Observation()
            new = I.latest(batch, table.keys, order)
            old = table.rows(version, touched, batch)
            if at is not None and "updated_at" in old.columns:
                new = new.withColumn("updated_at", at)
            table.write(version + 1, merged(old, new, table.keys, seen), touched)
            counts = seen.get["inserted"], seen.get["updated"]
        table.expire()
    return counts


def replicate(
    source: DataFrame,
    target: str,
    state: str,
    table: str,
    watermark: str,
    keys: list[str],
    at: Column,
    mode: str = "upsert",
    most: int | None = None,
    where: Column | None = None,
    checks: list[Q.Check] | None = None,
    lag_tolerance: int | None = None,
    buckets: int = 64,
) -> DataFrame:
    """One run. Gives one row: extracted, inserted, updated, held, version, watermark_before, watermark_after, lag_breach."""
    spark = source.sparkSession
    absent = [c for c in [watermark, *keys] if c not in source.columns]
    if absent or mode not in ("insert", "upsert"):
        raise ValueError(f"no columns {absent} in the source" if absent else f"no mode {mode}")
    marks, held = Watermarks(spark, state), BucketedTable(spark, target, keys, buckets)
    known = marks.current().where((F.col("table_name") == table.split(".")[-1]) & (F.col("column_name") == watermark))
    now = known.first()
    version = (now and now.version) or 0
    before = F.lit(now.watermark if now else None).cast("timestamp_ntz")
    breach = False
    if lag_tolerance is not None and now is not None and now.watermark is not None:
        breach = I.replication_lag(source, known, watermark, lag_tolerance).first().breach
    kept, seen = f"{target}/batches/version={version + 1}", Observation()
    extracted = I.extract(source, watermark, before if now is not None and now.watermark is not None else None, most, where)
    extracted.observe(seen, F.count(F.lit(1)).alias("n"), F.max(watermark).alias("newest")).write.mode("overwrite").parquet(kept)
    batch, found, counts, after = spark.read.schema(extracted.schema).parquet(kept), seen.get, (0, 0), before
    try:
        if found["n"]:
            if checks and (failed := Q.run_suite(batch, "replication", table, checks).where("not success").select("check_name", "column_name").collect()):  # a row for each check
                raise ValueError(f"checks failed: {[tuple(r) for r in failed]}")
            counts = apply_batch(held, version, batch, mode, [watermark], at)
            version += 1
            after = F.lit(found["newest"]).cast("timestamp_ntz")
            marks.set(table, watermark, after, at, version)
    finally:
        remove(spark, kept)
    rows = held.rows(version)
    rows = rows.agg(F.count(F.lit(1)).alias("held")) if rows is not None else spark.range(1).select(F.lit(0).alias("held"))
    return rows.select(
        F.lit(found["n"]).alias("extracted"),
        F.lit(counts[0]).alias("inserted"),
        F.lit(counts[1]).alias("updated"),
        "held",
        F.lit(version).alias("version"),
        before.alias("watermark_before"),
        after.alias("watermark_after"),
        F.lit(breach).alias("lag_breach"),
    )
