"""Queries of data quality, incremental work and run logs over the given tables, and their oracles."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constraints import CONSTRAINTS
from ..operators import incremental as I
from ..operators import quality as Q
from ..operators import replication as P
from ..operators import runlog as L
from ..operators.watermarks import Watermarks
from ..sources import database, retail
from ..sources.buckets import BucketedTable
from ..sources.storage import refresh_partitions, scratch
from ..streaming import ingest
from .results import parse, result, result_sql
from .warehouse import FACT, MODELS_SQL, NOW, Warehouse

CUT = "2024-01-20 00:00:00"
BUCKETS = 16
#: Stored versions have a bucket for so many orders, if these are more than BUCKETS.
BUCKET_ORDERS = 100_000
LIMITS = [("click", 5.0), ("view", 50.0)]
#: Texts of these tables in a database.
TEXTS = "event_type VARCHAR(100)"


class Changes(Warehouse):
    """The warehouse, a replication source and target, a change feed and a run log, all derived from the given tables."""

    events = cached_property(lambda self: retail.read(self.spark, self.sf_dir, "events"))
    source = cached_property(lambda self: self.events.select("event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents")))
    runs = cached_property(lambda self: L.task_metrics(self.log).join(L.performance(self.log).select("run_id", "success_rate", "failure_rate", "avg_seconds", "score"), "run_id"))

    @cached_property
    def target(self) -> DataFrame:
        changed = F.when(F.col("event_id") % 10 == 0, F.col("cents") + 1).otherwise(F.col("cents"))
        return self.source.where(F.col("ts") < self.cut).withColumn("cents", changed)

    @cached_property
    def feed(self) -> DataFrame:
        k = F.col("o_orderkey")
        feed = retail.read(self.spark, self.sf_dir, "orders").withColumn("nth", F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))))
        return feed.select(
            k.alias("order_key"), "nth", retail.plus_days(F.col("o_orderdate"), F.col("nth") * 2).alias("changed_at"),
            F.when((k % 100 == 99) & (F.col("nth") == k % 3), "DELETE").when(F.col("nth") == 0, "INSERT").otherwise("UPDATE").alias("operation_type"),
            F.when((F.col("nth") == 2) & (k % 2 == 0), "closed").when(F.col("nth") == 0, "new").otherwise("open").alias("status"),
        )

    @cached_property
    def log(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(
            F.col("user_id").alias("run_id"), e.alias("task_id"), F.col("event_type").alias("task_kind"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("state"),
            (F.round(F.col("value") * 100).cast("long") / 10.0).alias("seconds"), (e % 3).alias("retries"),
            F.when(e % 4 == 0, "Connection refused").when(e % 4 == 1, "read TIMEOUT").when(e % 4 == 2, "validation failed").otherwise("out of disk").alias("error"),
        )

    @property
    def cut(self) -> Column:
        return F.lit(CUT).cast("timestamp_ntz")


CHANGES_SQL = MODELS_SQL + f""",
source AS (SELECT event_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
target AS (SELECT event_id, ts, event_type, cents + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS cents FROM source WHERE ts < TIMESTAMP '{CUT}'),
feed AS (SELECT o_orderkey AS order_key, nth, o_orderdate + CAST(nth * 2 AS INTEGER) * INTERVAL 1 DAY AS changed_at,
  CASE WHEN o_orderkey % 100 = 99 AND nth = o_orderkey % 3 THEN 'DELETE' WHEN nth = 0 THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
  CASE WHEN nth = 2 AND o_orderkey % 2 = 0 THEN 'closed' WHEN nth = 0 THEN 'new' ELSE 'open' END AS status
  FROM (SELECT *, unnest(range(0, o_orderkey % 3 + 1)) AS nth FROM orders)),
log AS (SELECT user_id AS run_id, event_id AS task_id, event_type AS task_kind, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS state, CAST(round(value * 100) AS BIGINT) / CAST(10 AS DOUBLE) AS seconds, event_id % 3 AS retries,
  CASE event_id % 4 WHEN 0 THEN 'Connection refused' WHEN 1 THEN 'read TIMEOUT' WHEN 2 THEN 'validation failed' ELSE 'out of disk' END AS error FROM events),
runs AS (SELECT *, least(100, success_rate * 70 + greatest(0, (300 - avg_seconds) / 300 * 30)) AS score FROM (
  SELECT run_id, count(*) AS tasks, count(*) FILTER (state = 'success') AS succeeded, count(*) FILTER (state = 'failed') AS failed, sum(seconds) AS total_seconds, sum(retries) AS retries, arg_max(task_id, (seconds, task_id)) AS longest_task,
    CAST(count(*) FILTER (state = 'success') AS DOUBLE) / count(*) AS success_rate, CAST(count(*) FILTER (state = 'failed') AS DOUBLE) / count(*) AS failure_rate, coalesce(avg(seconds) FILTER (state = 'success'), 0) AS avg_seconds FROM log GROUP BY 1))
"""

CHECK = "suite check_name table_name column_name success:b observed:d expected"


def suite_sql(table: str, suite: str, checks: list[tuple[str, str, str, str]]) -> str:
    """checks: (name, column, measure, 'low..high')."""
    parts = []
    for name, column, measure, expected in checks:
        low, high = expected.split("..")
        good = " AND ".join([*([f"m >= {low}"] if low else []), *([f"m <= {high}"] if high else [])]) or "true"
        parts.append(f"SELECT '{suite}' AS suite, '{name}' AS check_name, '{table}' AS table_name, '{column}' AS column_name, {good} AS success, m AS observed, '{expected}' AS expected FROM (SELECT CAST({measure} AS DOUBLE) AS m FROM {table})")
    return " UNION ALL ".join(parts)


STATUS = ["pending", "processing", "shipped", "delivered", "cancelled", "refunded"]
SUITES = {
    "orders": ("stg_orders", [Q.row_count(1, None), Q.not_null("order_id"), Q.not_null("customer_id"), Q.accepted_values("order_status", STATUS), Q.between("total_amount", 0, 100000), Q.matches("currency", "^[A-Z]{3}$"), Q.null_percentage("net_amount", 10)], [
        ("row_count", "*", "count(*)", "1.."), ("not_null", "order_id", "count(*) FILTER (order_id IS NULL)", "0..0"), ("not_null", "customer_id", "count(*) FILTER (customer_id IS NULL)", "0..0"),
        ("accepted_values", "order_status", "count(*) FILTER (order_status NOT IN ('pending','processing','shipped','delivered','cancelled','refunded'))", "0..0"), ("between", "total_amount", "count(*) FILTER (total_amount NOT BETWEEN 0 AND 100000)", "0..0"),
        ("regex", "currency", "count(*) FILTER (NOT regexp_matches(currency, '^[A-Z]{3}$'))", "0..0"), ("null_percentage", "net_amount", "coalesce(avg(CASE WHEN net_amount IS NULL THEN 100.0 ELSE 0 END), 0)", "0..10"),
    ]),
    "customers": ("stg_customers", [Q.row_count(1, None), Q.not_null("email"), Q.matches("email", r"^[^@]+@[^@]+\.[a-z]+$"), Q.accepted_values("customer_tenure", ["new", "active", "established"]), Q.not_null("country"), Q.between("days_since_last_login", 0, 59)], [
        ("row_count", "*", "count(*)", "1.."), ("not_null", "email", "count(*) FILTER (email IS NULL)", "0..0"), ("regex", "email", r"count(*) FILTER (NOT regexp_matches(email, '^[^@]+@[^@]+\.[a-z]+$'))", "0..0"),
        ("accepted_values", "customer_tenure", "count(*) FILTER (customer_tenure NOT IN ('new','active','established'))", "0..0"), ("not_null", "country", "count(*) FILTER (country IS NULL)", "0..0"), ("between", "days_since_last_login", "count(*) FILTER (days_since_last_login NOT BETWEEN 0 AND 59)", "0..0"),
    ]),
    "revenue": ("daily", [Q.row_count(1, None), Q.not_null("date_day"), Q.between("gross_revenue", 0, 10000000), Q.between("fulfillment_rate", 0, 1), Q.parseable("date_day")], [
        ("row_count", "*", "count(*)", "1.."), ("not_null", "date_day", "count(*) FILTER (date_day IS NULL)", "0..0"), ("between", "gross_revenue", "count(*) FILTER (gross_revenue NOT BETWEEN 0 AND 10000000)", "0..0"), ("between", "fulfillment_rate", "count(*) FILTER (fulfillment_rate NOT BETWEEN 0 AND 1)", "0..0"),
        ("parseable_date", "date_day", "count(*) FILTER (date_day IS NOT NULL AND TRY_CAST(date_day AS DATE) IS NULL)", "0..0"),
    ]),
}


def _suite(name: str, only: str | None = None):
    table, checks, sql = SUITES[name]
    kept = [i for i, c in enumerate(checks) if only is None or c.name.startswith(only)]
    return (lambda w: Q.run_suite(getattr(w, table), name, table, [checks[i] for i in kept]), CHECK, suite_sql(table, name, [sql[i] for i in kept]))


def _all_suites(w) -> DataFrame:
    parts = [_suite(n)[0](w) for n in SUITES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _constraints(w) -> DataFrame:
    rules = {"amount_not_negative": F.col("total_amount") >= 0, "currency_code": F.col("currency").rlike("^[A-Z]{3}$"), "discount_below_total": F.col("discount_amount") <= F.col("total_amount")}
    return Q.violated(w.raw_orders.drop("is_valid"), rules).select("order_id", F.array_join("validation_errors", ",").alias("errors"), "is_valid")


def _late(w) -> DataFrame:
    """A batch of changed and new source rows, twice each, the older value second."""
    b = w.source.where((F.col("ts") >= w.cut) | (F.col("event_id") % 10 == 0))
    return b.unionByName(b.withColumns({"ts": F.col("ts") - F.make_dt_interval(F.lit(1)), "cents": F.lit(0).cast("long")}))


BATCH = f"(SELECT * FROM source WHERE ts >= TIMESTAMP '{CUT}' OR event_id % 10 = 0)"
VERSION = "order_key:l nth:l operation_type status record_version:l effective_from effective_to is_current:b"
VERSION_SQL = "SELECT *, effective_to IS NULL AND operation_type <> 'DELETE' AS is_current FROM (SELECT *, row_number() OVER w AS record_version, changed_at AS effective_from, lead(changed_at) OVER w AS effective_to FROM feed WINDOW w AS (PARTITION BY order_key ORDER BY changed_at, nth))"
SCD2_SQL = "SELECT order_key, status, CAST(changed_at AS DATE) AS effective_date, coalesce(nxt, DATE '9999-12-31') AS end_date, nxt IS NULL AS is_current FROM (SELECT *, lead(CAST(changed_at AS DATE)) OVER w AS nxt FROM (SELECT * FROM feed QUALIFY coalesce(lag(operation_type || '|' || status) OVER (PARTITION BY order_key ORDER BY changed_at, nth) <> operation_type || '|' || status, true)) WINDOW w AS (PARTITION BY order_key ORDER BY changed_at, nth)) WHERE operation_type <> 'DELETE'"
EVENT = "event_id:l ts event_type cents:l"


def _watermarks(w) -> tuple[Watermarks, DataFrame]:
    """The marks of each event type as they were at the cut, kept as a backup, then as they are."""

    def marks(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.concat(F.lit("raw."), "event_type").alias("table_name")).agg(F.max("ts").alias("watermark")).withColumn("column_name", F.lit("ts"))

    m = Watermarks(w.spark, scratch(w.spark, "watermarks"))
    m.set_all(marks(w.events.where(F.col("ts") < w.cut)), w.now)
    m.backup("daily", w.now)
    m.set_all(marks(w.events), w.now + F.make_dt_interval(hours=F.lit(2)))
    return m, m.list(w.now)


def _restored(w) -> DataFrame:
    """Marks restored from a backup, and to a point in time, and how many backups they have."""
    by_label, by_time = _watermarks(w)[0], _watermarks(w)[0]
    by_label.restore(w.now + F.make_dt_interval(hours=F.lit(3)), label="daily")
    by_time.restore(w.now + F.make_dt_interval(hours=F.lit(3)), until=w.now + F.make_dt_interval(hours=F.lit(1)))
    by_time.backup("after", w.now + F.make_dt_interval(hours=F.lit(4)))
    return by_label.list(w.now).withColumn("how", F.lit("label")).unionByName(by_time.list(w.now).withColumn("how", F.lit("time")))


def versions_of(w) -> DataFrame:
    return I.versions(w.feed, ["order_key"], "changed_at", "nth")


def _events_log(w) -> DataFrame:
    """Start and end events of jobs, appended in two writes; some jobs have no end, some no start, some ends come twice."""
    e, to = F.col("event_id"), scratch(w.spark, "job-events")
    base = w.events.select(F.concat(F.lit("job-"), e).alias("job_id"), F.col("event_type").alias("job_name"), "ts", e, (e % 50).alias("secs"))
    starts = base.where(e % 7 != 0).select("job_id", "job_name", F.lit("start").alias("kind"), F.col("ts").alias("at"))
    at = F.col("ts") + F.make_dt_interval(secs=F.col("secs").cast("decimal(18,6)"))
    failed = e % 3 == 0
    ends = base.where(e % 5 != 0).select("job_id", "job_name", F.lit("end").alias("kind"), at.alias("at"), F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"), e.alias("processed"), F.when(~failed, e).alias("inserted"), F.lit(0).cast("long").alias("updated"), F.when(failed, e).otherwise(0).alias("failed"), F.when(failed, "broken").alias("error"))
    none = w.spark.createDataFrame([], L.EVENTS)
    for rows in (starts, ends, ends.where(e % 11 == 0)):
        none.unionByName(rows, allowMissingColumns=True).write.mode("append").parquet(to)
    return w.spark.read.parquet(to)


def _models_run(w) -> DataFrame:
    """Three models written under the log, and one that cannot be."""
    log = L.JobLog(w.spark, scratch(w.spark, "model-log"))
    models = {"stg_orders": lambda: w.stg_orders, "stg_customers": lambda: w.stg_customers, "revenue_daily": lambda: w.daily, "broken": lambda: w.stg_orders.select("no_such_column")}
    for name, build in models.items():
        log.run(f"run-{name}", name, build, scratch(w.spark, name), w.now)
    return log.jobs(w.now).withColumn("error", F.substring_index("error", ":", 1))


def _constraints_of_all(w) -> DataFrame:
    """The violations of every constraint, from one pass over each table."""
    items = w.order_items.select("quantity", F.col("line_amount").alias("total_price"), (F.col("line_amount") / F.col("quantity")).alias("unit_price"))
    products = w.dim_products.select(F.col("unit_price").alias("price"), F.col("unit_cost").alias("cost"))
    shelf = w.dim_products.select(F.col("unit_price").alias("current_price"), F.col("unit_price").alias("original_price"), F.col("unit_cost").alias("cost"))
    frames = {
        "raw_orders": w.raw_orders, "raw_customers": w.raw_customers, "raw_shipments": w.raw_shipments, "staging_orders": w.stg_orders, "staging_order_items": items, "staging_customers": w.stg_customers,
        "staging_products": products, "staging_shipments": w.stg_shipments, "dim_customers": w.dim, "dim_products": shelf, "fact_orders": w.fact.withColumnRenamed("order_currency", "currency"),
    }
    versions = Q.constraint_violations(versions_of(w), "staging_orders").where("checked")
    return reduce(DataFrame.unionByName, (Q.constraint_violations(df, t) for t, df in frames.items())).unionByName(versions)


def _constraints_sql() -> str:
    tables = {
        "raw_orders": "raw_orders", "raw_customers": "raw_customers", "raw_shipments": "raw_shipments", "staging_orders": "stg_orders", "staging_customers": "stg_customers", "staging_shipments": "stg_shipments", "dim_customers": "dim",
        "staging_order_items": "(SELECT quantity, line_amount AS total_price, line_amount / quantity AS unit_price FROM order_items)", "staging_products": "(SELECT unit_price AS price, unit_cost AS cost FROM dim_products)",
        "dim_products": "(SELECT unit_price AS current_price, unit_price AS original_price, unit_cost AS cost FROM dim_products)", "fact_orders": "(SELECT * EXCLUDE (order_currency), order_currency AS currency FROM fact)",
    }
    parts = []
    for t, own in CONSTRAINTS.items():
        for name, sql in own.items():
            seen, test = name in CHECKED[t], sql.replace("regexp_like(", "regexp_matches(")
            found = f"(SELECT count(*) FILTER (NOT ({test})) FROM {tables[t]})" if seen else "NULL"
            parts.append(f"SELECT '{t}' AS table_name, '{name}' AS constraint_name, {seen} AS checked, {found} AS violations")
            if t == "staging_orders" and name in CHECKED["versions"]:
                parts.append(f"SELECT '{t}', '{name}', true, (SELECT count(*) FILTER (NOT ({test})) FROM ({VERSION_SQL}))")
    return " UNION ALL ".join(parts)


#: The constraints whose columns these tables have.
CHECKED = {
    "raw_orders": ["chk_raw_orders_amount_positive", "chk_raw_orders_currency_format"],
    "raw_customers": ["chk_raw_customers_email_format", "chk_raw_customers_country_format"],
    "raw_shipments": ["chk_raw_shipments_package_count_positive", "chk_raw_shipments_cost_positive", "chk_raw_shipments_delivery_logic"],
    "staging_orders": ["chk_staging_orders_amount_positive", "chk_staging_orders_currency_valid"],
    "versions": ["chk_staging_orders_operation_type", "chk_staging_orders_effective_dates"],
    "staging_order_items": ["chk_staging_order_items_quantity_positive", "chk_staging_order_items_prices_positive"],
    "staging_customers": ["chk_staging_customers_email_valid", "chk_staging_customers_country_valid"],
    "staging_products": ["chk_staging_products_price_positive", "chk_staging_products_cost_positive"],
    "staging_shipments": ["chk_staging_shipments_cost_positive"],
    "dim_customers": ["chk_dim_customers_email_valid", "chk_dim_customers_country_valid"],
    "dim_products": ["chk_dim_products_prices_positive"],
    "fact_orders": ["chk_fact_orders_amounts_valid", "chk_fact_orders_currency_valid"],
}


def _monthly_mart(orders: DataFrame) -> DataFrame:
    month = F.date_format("order_date", "yyyy-MM")
    return orders.groupBy(month.alias("month"), F.to_date("order_date").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("amount"))


def _mart_refreshed(w) -> DataFrame:
    """A mart of the orders that were not cancelled, then the months of the cancelled ones since 1997 brought up to date."""
    to, month = scratch(w.spark, "mart"), F.date_format("order_date", "yyyy-MM")
    cancelled = (F.col("order_status_group") == "cancelled") & (F.col("order_date") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    first, late = w.stg_orders.where(F.col("order_status_group") != "cancelled"), w.stg_orders.where(cancelled)
    refresh_partitions(_monthly_mart, first, first, month, "month", to)
    refresh_partitions(_monthly_mart, first.unionByName(late), late, month, "month", to)
    return w.spark.read.schema("day date, orders long, amount decimal(38,2), month string").parquet(to)


def _kept(w, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table."""
    to = scratch(w.spark, name)
    df.write.parquet(to)
    return w.spark.read.parquet(to)


def _replicated(w) -> DataFrame:
    """A batch upserted into a stored target: what the write has counted, and the rows then held."""
    t = BucketedTable(w.spark, scratch(w.spark, "replicated"), ["event_id"], BUCKETS)
    P.apply_batch(t, 0, _kept(w, w.target, "batch"), "upsert", ["ts"])
    inserted, updated = P.apply_batch(t, 1, _kept(w, _late(w), "batch"), "upsert", ["ts"])
    return t.rows(2).agg(F.count(F.lit(1)).alias("held")).withColumns({"inserted": F.lit(inserted), "updated": F.lit(updated)})


def _buckets_written(w) -> DataFrame:
    """(bucket, held): after a batch of the last hours, the version that holds each bucket of the target."""
    t = BucketedTable(w.spark, scratch(w.spark, "replicated"), ["event_id"], BUCKETS)
    P.apply_batch(t, 0, _kept(w, w.source, "batch"), "upsert", ["ts"])
    last = w.source.agg((F.max("ts") - F.make_dt_interval(hours=F.lit(6))).alias("since"))
    P.apply_batch(t, 1, _kept(w, w.source.join(F.broadcast(last), F.col("ts") > F.col("since")).drop("since"), "batch"), "upsert", ["ts"])  # one row
    return t.manifest(2)


def _inserted(w) -> DataFrame:
    """Two runs that append."""
    to, state = scratch(w.spark, "appended"), scratch(w.spark, "appended-state")
    for source in (w.target, w.source):
        P.replicate(source, to, state, "raw.events", "ts", ["event_id"], w.now, mode="insert", buckets=BUCKETS)
    return P.target_table(w.spark, to, 2)


def _arrived(w) -> tuple[BucketedTable, BucketedTable]:
    """The feed in three batches, the first changes of orders after the second ones: stored versions, and a stored dimension."""
    buckets = max(BUCKETS, retail.read(w.spark, w.sf_dir, "orders").count() // BUCKET_ORDERS)
    v = BucketedTable(w.spark, scratch(w.spark, "versions"), ["order_key"], buckets)
    d = BucketedTable(w.spark, scratch(w.spark, "dimension"), ["order_key"], buckets)
    for nth in (1, 0, 2):
        batch = _kept(w, w.feed.where(F.col("nth") == nth), "arrivals")
        I.merge_versions(v, batch, "changed_at", "nth")
        I.merge_dimension(d, v, batch, ["status"], "changed_at", "nth")
    return v, d


def _deduped(w) -> DataFrame:
    """The feed's order statuses in three deliveries, each to a stream that keeps what it has seen."""
    folder, to, state = (scratch(w.spark, n) for n in ("deliveries", "distinct", "distinct-state"))
    for nth in range(3):
        w.feed.where(F.col("nth") == nth).select("order_key", "status").write.mode("append").parquet(folder)
        rows = w.spark.readStream.schema("order_key long, status string").parquet(folder)
        ingest.first_of_each(w.spark, rows, ["order_key", "status"], to, state)
    return w.spark.read.parquet(to)


def _run_three_times(w) -> tuple[list[DataFrame], str]:
    """The target's rows, then the source's, then nothing new, replicated into one table."""
    to, state = scratch(w.spark, "replica"), scratch(w.spark, "replica-state")
    checks = [Q.not_null("event_id"), Q.not_null("ts"), Q.row_count(1, None)]
    how = {"target": to, "state": state, "table": "events", "watermark": "ts", "keys": ["event_id"], "at": w.now, "checks": checks, "lag_tolerance": 3600, "buckets": BUCKETS}
    return [P.replicate(source, **how) for source in (w.target, w.source, w.source)], to


def _replication_runs(w) -> DataFrame:
    return reduce(DataFrame.unionByName, (r.withColumn("run", F.lit(k + 1)) for k, r in enumerate(_run_three_times(w)[0])))


def _replication_target(w) -> DataFrame:
    _, to = _run_three_times(w)
    return P.target_table(w.spark, to, 2)


def _scanned(w) -> DataFrame:
    """The source in a database, read in ranges of its key above the cut."""
    url = database.local_url(w.spark)
    database.write(_kept(w, w.source, "batch"), url, "source_events", "b1", column_types=TEXTS)
    database.index(w.spark, url, "source_events", "event_id")
    return database.scan(w.spark, url, "source_events", "event_id", "ts", w.cut, task_rows=2_000)


def _sunk(w) -> DataFrame:
    """Two batches appended to a table of a database, the first one twice, and a third that replaces the rows of its keys in another."""
    url, target, source = database.local_url(w.spark), _kept(w, w.target, "batch"), _kept(w, w.source, "batch")
    for rows, batch in ((target, "b1"), (source, "b2"), (target, "b1")):
        database.write(rows, url, "appended", batch, column_types=TEXTS)
    for rows, batch in ((target, "u1"), (source, "u2")):
        database.write(rows, url, "replaced", batch, keys=["event_id"], column_types=TEXTS)
    for t in ("appended", "replaced"):
        database.index(w.spark, url, t, "event_id")
    both = [database.scan(w.spark, url, t, "event_id", task_rows=2_000).withColumn("how", F.lit(t)) for t in ("appended", "replaced")]
    return both[0].unionByName(both[1])


def _saved_checks(w) -> DataFrame:
    to = scratch(w.spark, "quality-results")
    for name in SUITES:
        Q.save_results(_suite(name)[0](w), to, f"batch-{name}", w.now)
    return w.spark.read.parquet(to)


#: query: (function, columns, SQL after the derived tables)
QUERIES = {
    "check_not_null": _suite("orders", "not_null"),
    "check_accepted_values": _suite("orders", "accepted"),
    "check_between": _suite("orders", "between"),
    "check_regex": _suite("customers", "regex"),
    "check_row_count": _suite("orders", "row_count"),
    "check_parseable_date": _suite("revenue", "parseable"),
    "batch_null_check": _suite("orders", "null_percentage"),
    "null_percentage": _suite("orders", "null_percentage"),
    "quality_suites": (_all_suites, CHECK, " UNION ALL ".join(_suite(n)[2] for n in SUITES)),
    "check_unique": (lambda w: Q.duplicate_keys(w.raw_orders, ["customer_id", "order_date"]), "customer_id order_date n:l", "SELECT customer_id, order_date, count(*) AS n FROM raw_orders GROUP BY 1, 2 HAVING count(*) > 1"),
    "batch_duplicate_check": (lambda w: Q.rows_beyond_first(w.raw_orders, ["customer_id", "order_status"]), "duplicates:l", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, order_status FROM raw_orders)) AS duplicates FROM raw_orders"),
    "duplicate_count": (lambda w: Q.rows_beyond_first(w.raw_customers, ["country"]), "duplicates:l", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT country FROM raw_customers)) AS duplicates FROM raw_customers"),
    "batch_range_check": (lambda w: w.raw_orders.agg(Q.failing(F.col("total_amount") < 20).alias("below"), Q.failing(F.col("total_amount") > 5000).alias("above")), "below:l above:l", "SELECT count(*) FILTER (total_amount < 20) AS below, count(*) FILTER (total_amount > 5000) AS above FROM raw_orders"),
    "batch_count_check": (lambda w: w.raw_orders.agg(F.count(F.lit(1)).alias("n")).select("n", F.when(F.col("n").between(1, 10000000), "ok").otherwise("error").alias("severity")), "n:l severity", "SELECT count(*) AS n, CASE WHEN count(*) BETWEEN 1 AND 10000000 THEN 'ok' ELSE 'error' END AS severity FROM raw_orders"),
    "business_rules": (
        lambda w: w.raw_customers.agg(Q.failing(~F.col("email").contains("@")).alias("bad_email"), Q.failing(~F.col("registration_date").between(F.lit("2000-01-01").cast("timestamp_ntz"), w.now)).alias("bad_date")),
        "bad_email:l bad_date:l", f"SELECT count(*) FILTER (NOT contains(email, '@')) AS bad_email, count(*) FILTER (registration_date NOT BETWEEN TIMESTAMP '2000-01-01' AND {NOW}) AS bad_date FROM raw_customers"),
    "type_check": (lambda w: Q.type_check(w.raw_orders, {"total_amount": "double", "order_date": "timestamp", "currency": "bigint", "absent": "string"}), "column_name expected missing:b not_castable:l", "SELECT unnest(['total_amount', 'order_date', 'currency', 'absent']) AS column_name, unnest(['double', 'timestamp', 'bigint', 'string']) AS expected, unnest([false, false, false, true]) AS missing, unnest([0, 0, (SELECT count(*) FROM raw_orders), 0]) AS not_castable"),
    "constraint_validators": (_constraints, "order_id errors is_valid:b", "SELECT order_id, array_to_string(list_filter([CASE WHEN total_amount < 0 THEN 'amount_not_negative' END, CASE WHEN NOT regexp_matches(currency, '^[A-Z]{3}$') THEN 'currency_code' END, CASE WHEN discount_amount > total_amount THEN 'discount_below_total' END], lambda x: x IS NOT NULL), ',') AS errors, NOT (coalesce(total_amount < 0, false) OR coalesce(NOT regexp_matches(currency, '^[A-Z]{3}$'), false) OR coalesce(discount_amount > total_amount, false)) AS is_valid FROM raw_orders"),
    "constraint_violations": (_constraints_of_all, "table_name constraint_name checked:b violations:l", _constraints_sql()),
    "mart_refresh": (_mart_refreshed, "month day orders:l amount:d", "SELECT strftime(order_date, '%Y-%m') AS month, CAST(order_date AS DATE) AS day, count(*) AS orders, sum(total_amount) AS amount FROM stg_orders WHERE order_status_group <> 'cancelled' OR order_date >= TIMESTAMP '1997-01-01' GROUP BY 1, 2"),
    "current_row_uniqueness": (lambda w: versions_of(w).groupBy("order_key").agg(F.count_if("is_current").alias("current")).groupBy("current").agg(F.count(F.lit(1)).alias("keys")), "current:l keys:l", f"SELECT current, count(*) AS keys FROM (SELECT order_key, count(*) FILTER (is_current) AS current FROM ({VERSION_SQL}) GROUP BY 1) GROUP BY 1"),
    "referential_orphans": (lambda w: Q.orphans(w.stg_orders, w.dim, "customer_id").select("order_id", "customer_id"), "order_id customer_id", "SELECT order_id, customer_id FROM stg_orders WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM dim)"),
    "check_relationships": (lambda w: Q.orphans(w.stg_shipments, w.stg_orders, "order_id").select("shipment_id", "order_id"), "shipment_id order_id", "SELECT shipment_id, order_id FROM stg_shipments WHERE order_id NOT IN (SELECT order_id FROM stg_orders)"),
    "source_target_consistency": (lambda w: Q.consistency(w.source, w.target, ["event_id", "cents"]), "source_count:l target_count:l missing_in_target:l extra_in_target:l matching:l passed:b", "SELECT (SELECT count(*) FROM source) AS source_count, (SELECT count(*) FROM target) AS target_count, count(*) FILTER (t.event_id IS NULL) AS missing_in_target, count(*) FILTER (s.event_id IS NULL) AS extra_in_target, count(*) FILTER (s.event_id IS NOT NULL AND t.event_id IS NOT NULL) AS matching, count(*) FILTER (t.event_id IS NULL) = 0 AS passed FROM source s FULL JOIN target t ON s.event_id = t.event_id AND s.cents = t.cents"),
    "key_set_difference": (lambda w: w.source.select("event_id").exceptAll(w.target.select("event_id")), "event_id:l", "SELECT event_id FROM source EXCEPT ALL SELECT event_id FROM target"),
    "key_set_intersection": (lambda w: w.source.select("event_id").intersect(w.target.select("event_id")), "event_id:l", "SELECT event_id FROM source INTERSECT SELECT event_id FROM target"),
    "incremental_extract": (lambda w: I.extract(w.source, "ts", w.cut, where=F.col("event_type") != "view"), EVENT, f"SELECT * FROM source WHERE ts > TIMESTAMP '{CUT}' AND event_type <> 'view'"),
    "incremental_topn": (lambda w: I.extract(w.source, "ts", w.cut, most=100), EVENT, f"SELECT * FROM source WHERE ts > TIMESTAMP '{CUT}' QUALIFY rank() OVER (ORDER BY ts) <= 100"),
    "source_availability": (lambda w: I.newer_than(w.source, w.target, "ts").agg(F.count(F.lit(1)).alias("newer")), "newer:l", "SELECT count(*) AS newer FROM source WHERE ts > (SELECT max(ts) FROM target)"),
    "scalar_subquery_filter": (lambda w: I.newer_than(w.source, w.target, "ts"), EVENT, "SELECT * FROM source WHERE ts > coalesce((SELECT max(ts) FROM target), TIMESTAMP '1900-01-01')"),
    "data_freshness": (lambda w: w.source.agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest")).select("n", "latest", ((F.col("n") >= 10) & (F.col("latest") >= w.cut)).alias("available")), "n:l latest available:b", f"SELECT count(*) AS n, max(ts) AS latest, count(*) >= 10 AND max(ts) >= TIMESTAMP '{CUT}' AS available FROM source"),
    "table_row_counts": (lambda w: w.raw_orders.agg(F.lit("orders").alias("t"), F.count(F.lit(1)).alias("n")).unionByName(w.raw_customers.agg(F.lit("customers").alias("t"), F.count(F.lit(1)).alias("n"))).unionByName(w.raw_shipments.agg(F.lit("shipments").alias("t"), F.count(F.lit(1)).alias("n"))), "t n:l", "SELECT 'orders' AS t, count(*) AS n FROM raw_orders UNION ALL SELECT 'customers', count(*) FROM raw_customers UNION ALL SELECT 'shipments', count(*) FROM raw_shipments"),
    "upsert": (lambda w: I.upsert(w.target, _late(w), ["event_id"], ["ts"]), EVENT, f"SELECT * FROM target WHERE event_id NOT IN (SELECT event_id FROM {BATCH}) UNION ALL SELECT * FROM {BATCH}"),
    "replicate_upsert": (_replicated, "inserted:l updated:l held:l", f"SELECT count(*) FILTER (event_id NOT IN (SELECT event_id FROM target)) AS inserted, count(*) FILTER (event_id IN (SELECT event_id FROM target)) AS updated, (SELECT count(*) FROM target WHERE event_id NOT IN (SELECT event_id FROM {BATCH})) + count(*) AS held FROM {BATCH}"),
    "replication_run": (_replication_runs, "run:l extracted:l inserted:l updated:l held:l version:l watermark_before watermark_after", f"""
SELECT 1 AS run, count(*) AS extracted, count(*) AS inserted, 0 AS updated, count(*) AS held, 1 AS version, NULL AS watermark_before, max(ts) AS watermark_after FROM target
UNION ALL SELECT 2, count(*), count(*) FILTER (event_id NOT IN (SELECT event_id FROM target)), count(*) FILTER (event_id IN (SELECT event_id FROM target)), (SELECT count(DISTINCT event_id) FROM source), 2, (SELECT max(ts) FROM target), max(ts) FROM source WHERE ts > (SELECT max(ts) FROM target)
UNION ALL SELECT 3, 0, 0, 0, count(DISTINCT event_id), 2, max(ts), max(ts) FROM source"""),
    "replication_target": (_replication_target, EVENT, "SELECT * FROM target UNION ALL SELECT * FROM source WHERE ts > (SELECT max(ts) FROM target)"),
    "replication_buckets": (_buckets_written, "bucket:l held:l", f"SELECT bucket, CASE WHEN max(ts) > (SELECT max(ts) FROM source) - INTERVAL 6 HOUR THEN 2 ELSE 1 END AS held FROM (SELECT *, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % {BUCKETS} AS bucket FROM source) GROUP BY bucket"),
    "jdbc_scan_incremental": (_scanned, EVENT, f"SELECT * FROM source WHERE ts > TIMESTAMP '{CUT}'"),
    "jdbc_sink": (_sunk, "how " + EVENT, "SELECT 'appended' AS how, * FROM target UNION ALL SELECT 'appended', * FROM source UNION ALL SELECT 'replaced', * FROM source"),
    "quality_results_sink": (_saved_checks, CHECK + " batch_id", " UNION ALL ".join(f"SELECT *, 'batch-{n}' AS batch_id FROM ({_suite(n)[2]})" for n in SUITES)),
    "replicate_insert": (_inserted, EVENT, "SELECT * FROM target UNION ALL SELECT * FROM source WHERE ts > (SELECT max(ts) FROM target)"),
    "watermark_store": (lambda w: _watermarks(w)[1], "table_name column_name watermark backups:l age_hours:d", f"SELECT event_type AS table_name, 'ts' AS column_name, max(ts) AS watermark, CASE WHEN min(ts) < TIMESTAMP '{CUT}' THEN 1 ELSE 0 END AS backups, (epoch({NOW}) - floor(epoch(max(ts)))) / CAST(3600 AS DOUBLE) AS age_hours FROM events GROUP BY 1"),
    "watermark_restore": (_restored, "how table_name watermark backups:l", f"SELECT how, event_type AS table_name, coalesce(max(ts) FILTER (ts < TIMESTAMP '{CUT}'), max(ts)) AS watermark, CASE WHEN min(ts) < TIMESTAMP '{CUT}' THEN 1 ELSE 0 END + CASE how WHEN 'time' THEN 1 ELSE 0 END AS backups FROM events, (VALUES ('label'), ('time')) AS v(how) GROUP BY 1, 2"),
    "replication_lag": (lambda w: I.replication_lag(w.source, w.target.groupBy("event_type").agg(F.max("ts").alias("watermark")), "ts"), "lag_seconds:l status breach:b", "SELECT CAST(floor(epoch(max(s.ts))) - floor((SELECT epoch(max(ts)) FROM target)) AS BIGINT) AS lag_seconds, 'lagging' AS status, true AS breach FROM source s"),
    "replication_throughput": (lambda w: I.throughput(w.runs.withColumn("mb", F.col("tasks") * 0.5), "tasks", "total_seconds", "mb"), "run_id:l records_per_second:d records_per_minute:d mb_per_second:d", "SELECT run_id, CASE WHEN total_seconds > 0 THEN round(tasks / total_seconds, 2) ELSE 0 END AS records_per_second, CASE WHEN total_seconds > 0 THEN round(tasks * 60 / total_seconds, 2) ELSE 0 END AS records_per_minute, CASE WHEN total_seconds > 0 THEN round(tasks * CAST(0.5 AS DOUBLE) / total_seconds, 2) ELSE 0 END AS mb_per_second FROM runs"),
    "watermark_stats": (lambda w: I.watermark_stats(w.source, "ts", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")), "total:l with_watermark:l oldest newest avg_age_seconds:d", "SELECT count(*) AS total, count(ts) AS with_watermark, min(ts) AS oldest, max(ts) AS newest, avg(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) AS avg_age_seconds FROM source"),
    "watermark_range": (lambda w: w.source.where("ts is not null").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), (F.count("ts") > 0).alias("present")), "low high present:b", "SELECT min(ts) AS low, max(ts) AS high, count(ts) > 0 AS present FROM source"),
    "replication_setup_check": (lambda w: w.source.agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("marked"), F.max("ts").alias("high")).withColumn("is_valid", F.lit("ts" in w.source.columns) & (F.col("marked") > 0)), "n:l marked:l high is_valid:b", "SELECT count(*) AS n, count(ts) AS marked, max(ts) AS high, count(ts) > 0 AS is_valid FROM source"),
    "post_load_check": (lambda w: I.newer_than(w.source, w.target, "ts").agg(F.count(F.lit(1)).alias("loaded")).join(w.target.agg(F.count(F.lit(1)).alias("held"))).withColumn("passed", ~((F.col("loaded") > 0) & (F.col("held") == 0))), "loaded:l held:l passed:b", "SELECT count(*) AS loaded, (SELECT count(*) FROM target) AS held, NOT (count(*) > 0 AND (SELECT count(*) FROM target) = 0) AS passed FROM source WHERE ts > (SELECT max(ts) FROM target)"),
    "cdc_versioning": (versions_of, VERSION, VERSION_SQL),
    "cdc_arrivals": (lambda w: (t := _arrived(w)[0]).rows(t.version()), VERSION, VERSION_SQL),
    "scd2_arrivals": (lambda w: (t := _arrived(w)[1]).rows(t.version()), "order_key:l status effective_date end_date is_current:b", SCD2_SQL),
    "version_number": (lambda w: versions_of(w).groupBy("order_key").agg((F.max("record_version") + 1).alias("next_version")), "order_key:l next_version:l", "SELECT order_key, count(*) + 1 AS next_version FROM feed GROUP BY 1"),
    "current_rows": (lambda w: versions_of(w).where("is_current"), VERSION, f"SELECT * FROM ({VERSION_SQL}) WHERE is_current"),
    "order_history": (lambda w: versions_of(w).where("effective_from >= timestamp_ntz '2000-01-01 00:00:00'").orderBy("order_key", "record_version"), VERSION, f"SELECT * FROM ({VERSION_SQL}) WHERE effective_from >= TIMESTAMP '2000-01-01'"),
    "scd2_dimension": (lambda w: I.scd2(w.feed, ["order_key"], ["status"], "changed_at", "nth"), "order_key:l status effective_date end_date is_current:b", SCD2_SQL),
    "stateful_dedupe": (_deduped, "order_key:l status", "SELECT DISTINCT order_key, status FROM feed"),
    "row_number_global": (lambda w: I.numbered(w.source, F.to_date("ts"), "ts", "event_id"), "event_id:l id:l", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS id FROM source"),
    "lateral_generate": (lambda w: w.raw_orders.select("order_id", F.explode(F.sequence(F.lit(1), (F.substring("order_id", 5, 9).cast("int") % 3 + 1))).alias("line")), "order_id line:l", "SELECT order_id, line FROM raw_orders, LATERAL (SELECT unnest(generate_series(1, CAST(substr(order_id, 5, 9) AS INTEGER) % 3 + 1)) AS line)"),
    "task_metrics": (lambda w: w.runs, "run_id:l tasks:l succeeded:l failed:l total_seconds:d retries:l longest_task:l", "SELECT * FROM runs"),
    "performance_metrics": (lambda w: w.runs, "run_id:l success_rate:d failure_rate:d avg_seconds:d score:d", "SELECT * FROM runs"),
    "sla_metrics": (lambda w: L.sla(w.log, w.spark.createDataFrame(LIMITS, "task_kind string, limit_seconds double")), "monitored:l misses:l largest_overage:d compliance:d", "SELECT count(*) AS monitored, count(*) FILTER (seconds > lim) AS misses, max(seconds - lim) FILTER (seconds > lim) AS largest_overage, 1 - CAST(count(*) FILTER (seconds > lim) AS DOUBLE) / count(*) AS compliance FROM log JOIN (VALUES ('click', CAST(5 AS DOUBLE)), ('view', 50)) AS v(task_kind, lim) USING (task_kind)"),
    "error_patterns": (lambda w: L.error_patterns(w.log), "kind n:l", "SELECT CASE WHEN error ILIKE '%connection%' THEN 'connection' WHEN error ILIKE '%timeout%' THEN 'timeout' WHEN error ILIKE '%validation%' THEN 'validation' ELSE 'unknown' END AS kind, count(*) AS n FROM log WHERE state = 'failed' GROUP BY 1"),
    "most_common_error": (lambda w: L.error_patterns(w.log).agg(F.max_by("kind", F.struct("n", "kind")).alias("kind")), "kind", "SELECT kind FROM (SELECT CASE WHEN error ILIKE '%connection%' THEN 'connection' WHEN error ILIKE '%timeout%' THEN 'timeout' WHEN error ILIKE '%validation%' THEN 'validation' ELSE 'unknown' END AS kind, count(*) AS n FROM log WHERE state = 'failed' GROUP BY 1) ORDER BY n DESC, kind DESC LIMIT 1"),
    "longest_task": (lambda w: w.log.groupBy("task_kind").agg(F.max_by("task_id", F.struct("seconds", "task_id")).alias("longest")), "task_kind longest:l", "SELECT task_kind, arg_max(task_id, (seconds, task_id)) AS longest FROM log GROUP BY 1"),
    "alert_rules": (lambda w: L.alerts(w.runs.join(L.sla_by_run(w.log, w.spark.createDataFrame(LIMITS, "task_kind string, limit_seconds double")), "run_id", "left"), failures_above=1, seconds_above=100), "run_id:l level reason", "SELECT run_id, 'critical' AS level, 'failed tasks' AS reason FROM runs WHERE failed > 1 UNION ALL SELECT run_id, 'warning', 'low score' FROM runs WHERE score < 70 UNION ALL SELECT run_id, 'warning', 'long run' FROM runs WHERE total_seconds > 100 UNION ALL SELECT run_id, 'info', 'many retries' FROM runs WHERE retries > 5 UNION ALL SELECT run_id, 'warning', 'SLA missed' FROM log JOIN (VALUES ('click', CAST(5 AS DOUBLE)), ('view', 50)) AS v(task_kind, lim) USING (task_kind) GROUP BY run_id HAVING 1 - CAST(count(*) FILTER (seconds > lim) AS DOUBLE) / count(*) < 0.9"),
    "job_log": (
        lambda w: L.fold_events(_events_log(w), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 15 * 86400), "job_id job_name status seconds:l processed:l inserted:l updated:l failed:l error started_at ended_at",
        "SELECT 'job-' || event_id AS job_id, event_type AS job_name, CASE WHEN done THEN CASE WHEN bad THEN 'FAILED' ELSE 'SUCCESS' END WHEN epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) > 15 * 86400 THEN 'ABANDONED' ELSE 'RUNNING' END AS status, CASE WHEN done AND event_id % 7 <> 0 THEN event_id % 50 END AS seconds, CASE WHEN done THEN event_id END AS processed, CASE WHEN done AND NOT bad THEN event_id END AS inserted, CASE WHEN done THEN 0 END AS updated, CASE WHEN done THEN CASE WHEN bad THEN event_id ELSE 0 END END AS failed, CASE WHEN done AND bad THEN 'broken' END AS error, CASE WHEN event_id % 7 <> 0 THEN ts END AS started_at, CASE WHEN done THEN ts + CAST(event_id % 50 AS INTEGER) * INTERVAL 1 SECOND END AS ended_at FROM (SELECT *, event_id % 5 <> 0 AS done, event_id % 3 = 0 AS bad FROM events WHERE event_id % 35 <> 0)"),
    "run_log_model": (_models_run, "job_name status processed:l error", "SELECT 'stg_orders' AS job_name, 'SUCCESS' AS status, count(*) AS processed, NULL AS error FROM stg_orders UNION ALL SELECT 'stg_customers', 'SUCCESS', count(*), NULL FROM stg_customers UNION ALL SELECT 'revenue_daily', 'SUCCESS', count(*), NULL FROM daily UNION ALL SELECT 'broken', 'FAILED', NULL, 'AnalysisException'"),
    "ingest_totals": (lambda w: w.runs.agg(F.sum("tasks").alias("records"), F.count_if(F.col("failed") == 0).alias("passed"), F.count_if(F.col("failed") > 0).alias("failed")), "records:l passed:l failed:l", "SELECT sum(tasks) AS records, count(*) FILTER (failed = 0) AS passed, count(*) FILTER (failed > 0) AS failed FROM runs"),
}


def queries():
    return {name: (lambda s, d, f=f, spec=spec: result(f(Changes(s, d)), spec)) for name, (f, spec, _) in QUERIES.items()}


def oracle_sql():
    return {name: f"WITH {CHANGES_SQL}, answer AS ({sql}) {result_sql('answer', spec)}" for name, (_, spec, sql) in QUERIES.items()}
