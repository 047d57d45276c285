"""Incremental work: high-water marks, upsert, change versions, slowly changing dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.buckets import BucketedTable, merge

EPOCH = "1900-01-01 00:00:00"
END = "9999-12-31"


def extract(source: DataFrame, watermark: str, last: Column | None = None, most: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows above the last watermark in its order. With ``most``, the cut keeps all rows that tie with the last one taken."""
    rows = source.where(F.col(watermark) > (last if last is not None else F.lit(EPOCH).cast("timestamp_ntz")))
    if where is not None:
        rows = rows.where(where)
    if most is None:
        return rows
    cut = rows.select(watermark).orderBy(watermark).limit(most).agg(F.max(watermark).alias("cut"))
    return rows.join(F.broadcast(cut), F.col(watermark) <= F.col("cut")).drop("cut")  # one row


def newer_than(source: DataFrame, target: DataFrame, watermark: str) -> DataFrame:
    """Rows of ``source`` above the largest watermark of ``target``."""
    top = target.agg(F.coalesce(F.max(watermark), F.lit(EPOCH).cast("timestamp_ntz")).alias("top"))
    return source.join(F.broadcast(top), F.col(watermark) > F.col("top")).drop("top")  # one row


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], at: Column | None = None) -> DataFrame:
    """The target with the latest row of each key of the batch; updated_at is set on those if the target has it."""
    new = latest(batch, keys, order)
    if at is not None and "updated_at" in target.columns:
        new = new.withColumn("updated_at", at)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*target.columns))


def upsert_counts(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row: inserted, updated."""
    known = target.select(*keys).distinct().withColumn("known_", F.lit(True))
    j = batch.select(*keys).distinct().join(known, keys, "left")
    return j.agg(F.count_if(F.col("known_").isNull()).alias("inserted"), F.count_if(F.col("known_")).alias("updated"))


def versions(changes: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Every change as a version of its key: record_version, effective_from, effective_to, is_current. A DELETE closes the row."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    v = changes.withColumns({"record_version": F.row_number().over(w), "effective_from": F.col(at), "effective_to": F.lead(at).over(w)})
    return v.withColumn("is_current", F.col("effective_to").isNull() & (F.col("operation_type") != "DELETE"))


def scd2(changes: DataFrame, keys: list[str], attributes: list[str], at: str, tie: str) -> DataFrame:
    """A dimension with a row for each time that the attributes of a key changed; end_date 9999-12-31 while current."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    state = F.sha2(F.concat_ws("|", "operation_type", *(F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes)), 256)
    changed = changes.withColumn("state_", state).withColumn("before_", F.lag("state_").over(w)).where("before_ is null or before_ <> state_")
    ended = F.lead(F.to_date(at)).over(w)
    rows = changed.withColumns({"effective_date": F.to_date(at), "end_date": F.coalesce(ended, F.lit(END).cast("date")), "next_": F.lead("state_").over(w)})
    rows = rows.where("operation_type <> 'DELETE'")
    return rows.withColumn("is_current", F.col("next_").isNull()).select(*keys, *attributes, "effective_date", "end_date", "is_current")


def merge_versions(table: BucketedTable, arrivals: DataFrame, at: str, tie: str) -> int:
    """Put a stored batch of changes, late ones and repeats included, into stored ``versions``: those of its keys are closed and numbered anew, the others stay. Gives the version."""

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        old, batch = (df.repartition(table.buckets, *table.keys) for df in (old, batch))  # for all that follows
        keys = batch.select(*table.keys).distinct()
        again = old.join(keys, table.keys, "left_semi").select(*batch.columns).unionByName(batch).dropDuplicates([*table.keys, at, tie])
        return old.join(keys, table.keys, "left_anti").unionByName(versions(again, table.keys, at, tie))

    return merge(table, arrivals, change, versions(arrivals, table.keys, at, tie))


def merge_dimension(dimension: BucketedTable, changes: BucketedTable, arrivals: DataFrame, attributes: list[str], at: str, tie: str) -> int:
    """Bring a stored ``scd2`` dimension up to date after ``merge_versions`` of ``arrivals``: rows of their keys are made anew from the stored changes."""
    keys = dimension.keys

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        old, stored, batch = (df.repartition(dimension.buckets, *keys) for df in (old, changes.rows(changes.version(), changes.touched(batch)), batch))
        touched = batch.select(*keys).distinct()
        known = stored.join(touched, keys, "left_semi")
        return old.join(touched, keys, "left_anti").unionByName(scd2(known, keys, attributes, at, tie))

    return merge(dimension, arrivals, change, scd2(arrivals, keys, attributes, at, tie))


def replication_lag(source: DataFrame, state: DataFrame, watermark: str, tolerance_seconds: int = 6 * 3600) -> DataFrame:
    """One row: seconds between the newest source row and the stored watermark, status, breach of the tolerance."""
    j = source.agg(F.max(watermark).alias("newest")).join(state.agg(F.max("watermark").alias("stored")))
    seconds = F.greatest(F.lit(0), F.unix_timestamp(F.col("newest").cast("timestamp")) - F.unix_timestamp(F.col("stored").cast("timestamp")))
    out = j.withColumn("lag_seconds", seconds)
    status = F.when(F.col("stored").isNull(), "no_watermark").when(F.col("lag_seconds") > 3600, "lagging").otherwise("current")
    return out.withColumns({"lag_hours": F.col("lag_seconds") / 3600.0, "lag_days": F.col("lag_seconds") / 86400.0, "status": status, "breach": F.coalesce(F.col("lag_seconds") > tolerance_seconds, F.lit(False))})


def throughput(runs: DataFrame, records: str, seconds: str, size_mb: str) -> DataFrame:
    def rate(c: Column) -> Column:
        return F.when(F.col(seconds) > 0, F.round(c / F.col(seconds), 2)).otherwise(0.0)

    n = F.col(records).cast("double")
    return runs.withColumns({"records_per_second": rate(n), "records_per_minute": rate(n * 60), "records_per_hour": rate(n * 3600), "mb_per_second": rate(F.col(size_mb).cast("double"))})


def watermark_stats(df: DataFrame, watermark: str, now: Column) -> DataFrame:
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(watermark).cast("timestamp"))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(watermark).alias("with_watermark"), F.min(watermark).alias("oldest"), F.max(watermark).alias("newest"), F.avg(age).alias("avg_age_seconds"))


def current_watermarks(log: DataFrame) -> DataFrame:
    """The state of each (table, column) from an append-only log (table_name, column_name, watermark, written_at); a schema prefix does not count."""
    name = F.element_at(F.split("table_name", r"\."), -1)
    return log.withColumn("table_name", name).groupBy("table_name", "column_name").agg(F.max_by("watermark", "written_at").alias("watermark"), F.max("written_at").alias("written_at"))


def numbered(df: DataFrame, bucket: Column, *order: str, name: str = "id") -> DataFrame:
    """Rows numbered from 1 in the order of ``bucket``, then ``order``: no task gets more than a bucket, one row for each bucket is summed up."""
    df = df.withColumn("bucket_", bucket)
    before = F.sum("n").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    ahead = df.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n")).select("bucket_", F.coalesce(before, F.lit(0)).alias("ahead_"))
    nth = F.row_number().over(Window.partitionBy("bucket_").orderBy(*order))
    return df.withColumn("nth_", nth).join(ahead, "bucket_").withColumn(name, F.col("ahead_") + F.col("nth_")).drop("bucket_", "nth_", "ahead_")
