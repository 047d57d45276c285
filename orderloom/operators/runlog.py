"""Run logs: events of jobs, appended and folded; and analytics over tables of task runs (run_id, task_id, state, seconds, retries, error)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..sources.storage import stored


EVENTS = "job_id string, job_name string, kind string, at timestamp_ntz, status string, processed long, inserted long, updated long, failed long, error string"
COUNTS = ["processed", "inserted", "updated", "failed"]


def fold_events(events: DataFrame, now: Column, stale_seconds: int = 6 * 3600) -> DataFrame:
    """A row for each job of a log of EVENTS: started_at, ended_at, status, seconds, counts and error of its last end.

    A job without an end is RUNNING, or ABANDONED when it began more than ``stale_seconds`` ago; one that only has an end keeps that, without a
    start. Events that were appended twice count once.
    """
    started, ended = F.col("kind") == "start", F.col("kind") == "end"
    last = F.max_by(F.when(ended, F.struct("status", *COUNTS, "error", "at")), F.when(ended, F.col("at")))
    jobs = events.groupBy("job_id").agg(F.max("job_name").alias("job_name"), F.min(F.when(started, F.col("at"))).alias("started_at"), last.alias("e"))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    open_status = F.when(age > stale_seconds, "ABANDONED").otherwise("RUNNING")
    seconds = F.unix_timestamp(F.col("e.at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return jobs.select("job_id", "job_name", "started_at", F.col("e.at").alias("ended_at"), F.when(F.col("e").isNull(), open_status).otherwise(F.col("e.status")).alias("status"), seconds.alias("seconds"), *(f"e.{c}" for c in (*COUNTS, "error")))


class JobLog:
    """An append-only log of EVENTS at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, job_id: str, job_name: str, kind: str, at: Column, status: str | None = None, error: str | None = None, **counts: int) -> None:
        one = self.spark.range(1).select(F.lit(job_id).alias("job_id"), F.lit(job_name).alias("job_name"), F.lit(kind).alias("kind"), at.cast("timestamp_ntz").alias("at"), F.lit(status).cast("string").alias("status"), *(F.lit(counts.get(c)).cast("long").alias(c) for c in COUNTS), F.lit(error).cast("string").alias("error"))
        one.write.mode("append").parquet(self.path)

    def run(self, job_id: str, job_name: str, df: Callable[[], DataFrame], to: str, at: Column | None = None) -> bool:
        """Write what ``df`` gives to ``to`` between a start and an end event, which has the rows counted by the write, or the error. False if it failed."""
        now, seen = at if at is not None else F.current_timestamp(), Observation()
        self.append(job_id, job_name, "start", now)
        try:
            df().observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(to)
        except Exception as e:
            self.append(job_id, job_name, "end", now, "FAILED", f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"[:300])
            return False
        self.append(job_id, job_name, "end", now, "SUCCESS", processed=seen.get["n"], inserted=seen.get["n"])
        return True

    def jobs(self, now: Column) -> DataFrame:
        return fold_events(stored(self.spark, self.path, EVENTS), now)


def task_metrics(log: DataFrame) -> DataFrame:
    """A row for each run: states, total and longest duration, retries."""
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("state") == "success").alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.sum("seconds").alias("total_seconds"),
        F.sum("retries").alias("retries"),
        F.max_by("task_id", F.struct("seconds", "task_id")).alias("longest_task"),
    )


def performance(log: DataFrame, good_seconds: float = 300.0) -> DataFrame:
    """A row for each run: success and failure rates, mean seconds of successes, score up to 100."""
    m = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "success").alias("good"), F.count_if(F.col("state") == "failed").alias("bad"), F.avg(F.when(F.col("state") == "success", F.col("seconds"))).alias("mean"))
    m = m.withColumns({"success_rate": F.col("good") / F.col("n"), "failure_rate": F.col("bad") / F.col("n"), "avg_seconds": F.coalesce("mean", F.lit(0.0))})
    speed = F.greatest(F.lit(0.0), (F.lit(good_seconds) - F.col("avg_seconds")) / good_seconds * 30)
    return m.withColumn("score", F.least(F.lit(100.0), F.col("success_rate") * 70 + speed))


def sla(log: DataFrame, limits: DataFrame) -> DataFrame:
    """One row: monitored tasks, misses, largest overage, compliance (1.0 with nothing monitored). limits: (task_kind, limit_seconds)."""
    j = log.join(F.broadcast(limits), "task_kind")  # a stated list of limits
    over = F.col("seconds") - F.col("limit_seconds")
    out = j.agg(F.count(F.lit(1)).alias("monitored"), F.count_if(over > 0).alias("misses"), F.max(F.when(over > 0, over)).alias("largest_overage"))
    return out.withColumn("compliance", F.when(F.col("monitored") > 0, 1 - F.col("misses") / F.col("monitored")).otherwise(1.0))


def sla_by_run(log: DataFrame, limits: DataFrame) -> DataFrame:
    """(run_id, compliance): the share of a run's monitored tasks within their limits; runs without such tasks are left out."""
    j = log.join(F.broadcast(limits), "task_kind")  # a stated list of limits
    return j.groupBy("run_id").agg((1 - F.count_if(F.col("seconds") > F.col("limit_seconds")) / F.count(F.lit(1))).alias("compliance"))


def error_kind(text: Column) -> Column:
    t = F.lower(text)
    return first_match([(t.contains("connection"), "connection"), (t.contains("timeout"), "timeout"), (t.contains("validation"), "validation")], "unknown")


def error_patterns(log: DataFrame) -> DataFrame:
    return log.where("state = 'failed'").groupBy(error_kind(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def alerts(runs: DataFrame, score_below: float = 70, failures_above: float = 0, seconds_above: float = 4 * 3600, retries_above: int = 5, compliance_below: float = 0.9) -> DataFrame:
    """(run_id, level, reason): one row for each threshold that a run breaks."""
    rules = [(F.col("failed") > failures_above, "critical", "failed tasks"), (F.col("score") < score_below, "warning", "low score"), (F.col("total_seconds") > seconds_above, "warning", "long run"), (F.col("retries") > retries_above, "info", "many retries")]
    if "compliance" in runs.columns:
        rules.append((F.coalesce("compliance", F.lit(1.0)) < compliance_below, "warning", "SLA missed"))
    found = F.array_compact(F.array(*(F.when(holds, F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))) for holds, level, reason in rules)))
    return runs.select("run_id", F.inline(found))
