"""Queries of file work: CSV files, API records, manifests and ledgers written from the given tables into the shared folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import api_orders as A
from ..sources import shipment_files as S
from ..sources.storage import SHUFFLES_END, load_table, move, put, remove, scratch, settings, spread
from ..streaming import ingest
from .results import result, result_sql
from .warehouse import MODELS_SQL, NOW, Warehouse

#: Files of shipments: at least so many, and one for so many rows.
PARTS, FILE_ROWS = 4, 250_000
#: Files without order ids.
BAD = 2


class Files(Warehouse):
    @cached_property
    def shipments(self) -> DataFrame:
        """Raw shipments as a stored table, as they are counted first and may be written in several forms."""
        self.shipments_at = scratch(self.spark, "shipments")
        with settings(self.spark, SHUFFLES_END):
            self.raw_shipments.write.option("compression", "zstd").parquet(self.shipments_at)
        return self.spark.read.parquet(self.shipments_at)

    @cached_property
    def parts(self) -> int:
        return max(PARTS, self.shipments.count() // FILE_ROWS)

    def flat(self, where: str = "true", parts: int | None = None) -> DataFrame:
        """Raw shipments as text, some with blank ids and odd words, in ``parts`` parts."""
        rows = self.shipments.where(where).repartition(parts or self.parts, "shipment_id")  # while they are narrow
        n = F.conv(F.substring(F.md5(F.col("shipment_id").cast("binary")), 1, 8), 16, 10).cast("long") % 10
        own = rows.withColumns({"is_return": F.when(n == 1, " yes ").when(n == 2, "N").when(n == 3, "maybe").otherwise(F.col("is_return").cast("string")), "currency": F.when(n < 5, "usd").otherwise("US$"), "shipping_cost": F.concat(F.lit("$"), F.col("shipping_cost").cast("string"))})
        own = own.withColumn("order_id", F.when(F.col("package_count") == 3, " ").otherwise(F.col("order_id")))
        return own.select(*(F.col(c).cast("string") if c in own.columns else F.lit("x, \"y\"" if c == "delivery_notes" else None).cast("string").alias(c) for c in S.COLUMNS))

    def folder(self, compression: str = "none") -> str:
        to = scratch(self.spark, "shipments-csv")
        with settings(self.spark, SHUFFLES_END):
            self.flat().write.options(header=True, escape='"', compression=compression).csv(to)
        return to

    def incoming(self, bad: bool = False) -> str:
        """A folder of compressed files to ingest, ``bad`` ones among them: without order ids, and no gzip. The table that they are written from goes."""
        to = self.folder("gzip")
        if bad:
            with settings(self.spark, SHUFFLES_END):
                self.flat("package_count = 7", BAD).drop("order_id").write.options(header=True, escape='"', compression="gzip").csv(f"{to}/no-order-ids")
            put(self.spark, f"{to}/damaged.csv.gz", b"this is no gzip file")
        remove(self.spark, self.shipments_at)
        return to

    def lines(self) -> DataFrame:
        """API records as JSON lines with mixed names; some are invalid, some have negative totals, some occur twice."""
        n = F.substring("order_id", 5, 9).cast("long")
        one = F.to_json(F.struct(F.col("order_id").alias("id"), "customer_id", F.concat(F.when(n % 14 == 0, "-").otherwise(""), F.col("total_amount").cast("string")).alias("total"), F.lit("EUR").alias("currency")))
        two = F.to_json(F.struct("order_id", F.col("customer_id").alias("customerId"), F.when(n % 4 == 0, "invalid_amount").otherwise(F.col("total_amount").cast("string")).alias("total_amount"), F.when(n % 3 == 0, "INVALID").alias("currency")))
        rows = self.raw_orders.select(F.when(n % 2 == 0, one).otherwise(two).alias("value"), n.alias("n"))
        return rows.select("value").unionByName(rows.where("n % 10 = 0").select("value"))


def _now(w):
    return w.now.cast("timestamp")


def _api(w):
    return A.with_errors(A.raw_orders(w.lines(), "api", "b1"))


def _csv(w):
    return S.read_csv(w.spark, w.folder())[0]


def _month_files(w, rows: DataFrame | None = None) -> str:
    """A folder with a text file of shipment ids for each month."""
    to = scratch(w.spark, "months")
    ids = (w.raw_shipments if rows is None else rows).select("shipment_id", F.date_format("shipped_date", "yyyy-MM").alias("month"))
    ids.repartition("month").write.partitionBy("month").text(to)
    return to


def _by_month(files: DataFrame) -> DataFrame:
    return files.withColumn("path", F.regexp_extract("path", "month=([0-9-]+)", 1))


def _listed(w, folder: str, before: DataFrame | None = None) -> DataFrame:
    """The listing of a folder as it is now, stored as a version."""
    to = scratch(w.spark, "listing")
    S.manifest(w.spark, folder, "*.txt", before=before).write.parquet(to)
    return w.spark.read.parquet(to)


def _months(w) -> DataFrame:
    """The listing of the months' files."""
    return _by_month(_listed(w, _month_files(w)))


#: the month's number, by which files are done, failed, open or not seen yet
NTH = "CAST(substr(path, 6, 2) AS INT) % 4"
LINE = "CAST('0x' || substr(md5(shipment_id), 1, 15) AS BIGINT)"
MONTHS = f"(SELECT *, CAST(substr(path, 6, 2) AS INT) % 4 AS nth FROM (SELECT strftime(shipped_date, '%Y-%m') AS path, sum(length(shipment_id) + 1) AS size, count(*) || ':' || bit_xor({LINE}) || ':' || sum({LINE}) AS hash FROM raw_shipments GROUP BY 1))"
LOGGED = f"(SELECT path, CASE nth WHEN 0 THEN 'processed' WHEN 1 THEN 'failed' ELSE 'processing' END AS status, CASE nth WHEN 0 THEN size END AS records, CASE nth WHEN 1 THEN 'broken' END AS error FROM {MONTHS} WHERE nth < 3)"


def _log(w, files: DataFrame) -> DataFrame:
    first = S.ledger_mark(files.where(f"{NTH} < 3"), "processing", _now(w) - F.expr("interval 1 minute"))
    done = S.ledger_mark(files.where(f"{NTH} = 0"), "processed", _now(w), F.col("size"))
    failed = S.ledger_mark(files.where(f"{NTH} = 1"), "failed", _now(w), error="broken")
    return first.unionByName(done).unionByName(failed)


def _changes(w):
    """A folder is listed, then files come, grow and go, and it is listed again."""
    nth = F.month("shipped_date") % 4
    folder = _month_files(w, w.raw_shipments.where(nth > 0))
    before = _listed(w, folder)
    where = {"new": _month_files(w, w.raw_shipments.where(nth == 0)), "grown": _month_files(w, w.raw_shipments.where(nth == 1).unionByName(w.raw_shipments.where((nth == 1) & (F.col("package_count") == 1))))}
    old = {_month(r.path): r.path for r in before.select("path").collect()}  # a row for each month
    for kind, extra in where.items():
        for r in S.manifest(w.spark, extra, "*.txt", hashes=False).select("path").collect():
            move(w.spark, r.path, old[_month(r.path)] if kind == "grown" else r.path.replace(extra.rsplit("/", 1)[-1], folder.rsplit("/", 1)[-1]))
    for month, path in old.items():
        if int(month[5:7]) % 4 == 2:
            remove(w.spark, path)
    now = _listed(w, folder, before)
    return _by_month(S.file_changes(now, before)).join(_by_month(now).select("path", "size", "hash"), "path", "left")


def _month(path: str) -> str:
    return path.split("month=", 1)[1][:7]


def _ready(w):
    size = F.when(F.expr(f"{NTH} = 1"), 0).when(F.expr(f"{NTH} = 2"), 1 << 40).when(F.expr(f"{NTH} < 3"), F.col("size"))
    return S.file_ready(_months(w).withColumn("size", size))


def _exported(w):
    to = scratch(w.spark, "ledger-json")
    S.ledger_export(_log(w, _months(w)), to)
    return w.spark.read.schema("path string, status string, records long, totals struct<files: long, failed: long>").json(to).select("path", "status", "records", "totals.files", "totals.failed")


def _without_ids(w):
    """Files whose header lacks a required column."""
    to = scratch(w.spark, "no-order-ids")
    w.flat().drop("order_id").write.option("header", True).option("escape", '"').csv(to)
    df, warnings = S.read_with_fallback(w.spark, to)
    return df.withColumns({"inferred": F.lit("schema was inferred" in warnings), "kind": F.lit(dict(df.dtypes)["package_count"])})


def _schema(w):
    """The declared columns: their order, whether they may be null, and whether a file of shipments fills them."""
    df = _csv(w)
    one = df.agg(*(F.count(c).alias(c) for c in S.COLUMNS))
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(k).alias("place"), F.lit(f.nullable).alias("nullable"), (F.col(f.name) > 0).alias("filled")) for k, f in enumerate(S.declared_schema().fields)]
    return one.select(F.inline(F.array(*rows)))


FILLED = "shipment_id order_id carrier shipping_method shipment_status shipped_date estimated_delivery_date actual_delivery_date package_count shipping_cost insurance_cost is_return".split()
SCHEMA_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {k} AS place, {c not in S.REQUIRED} AS nullable, {f'count({c}) > 0' if c in FILLED else 'count(*) > 0' if c in ('delivery_notes', 'currency') else 'count(*) < 0'} AS filled FROM raw_shipments" for k, c in enumerate(S.COLUMNS)
)


def _ingested_folder(w) -> tuple[str, str]:
    """Shipments, two kinds of bad files (no order ids in them; no gzip), ingested in two runs; and the state of that."""
    folder, to, state = w.incoming(bad=True), scratch(w.spark, "ingested"), scratch(w.spark, "ingest-state")
    for hours in (0, 1):
        # two batches, whatever the number of files: each has the files of many tasks
        ingest.ingest_files(w.spark, folder, to, state, w.now + F.make_dt_interval(hours=F.lit(hours)), most_files=(w.parts + BAD + 2) // 2)
    return to, state


def _ledger(w) -> DataFrame:
    """What the ingestion's ledger holds: status, reason, attempts, files and their rows."""
    log = S.ledger_state(w.spark.read.parquet(f"{_ingested_folder(w)[1]}/ledger"))
    reason = F.when(F.col("error").startswith("ValueError: "), F.substring_index("error", ": ", -2)).when(F.col("error").isNotNull(), "unreadable")
    return log.groupBy("status", reason.alias("reason"), "attempts").agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"))


def _broken_folder(w) -> str:
    """Rows without an order id, and rows with too many fields, which are written with another quote than is read."""
    to = scratch(w.spark, "broken")
    w.flat("package_count is null or package_count <> 5").write.option("header", True).option("escape", '"').csv(to)
    w.flat("package_count = 5").withColumn("return_date", F.lit("a,b")).write.mode("append").option("header", True).option("quote", "\u0001").csv(to)
    return to


def _field_counts(w) -> DataFrame:
    lines = w.spark.read.text(_broken_folder(w)).where(~F.col("value").startswith("shipment_id,"))
    return Q.field_counts(lines, len(S.COLUMNS))


def _quarantined(w) -> DataFrame:
    good, bad, seen = S.load_file(w.spark, _broken_folder(w), "b1", w.now, scratch(w.spark, "loaded"))
    counts = w.spark.range(1).select(*(F.lit(n).alias(k) for k, n in seen.items()))
    rows = bad.select(F.substring_index("line", ",", 1).alias("shipment_id"), "reason").unionByName(good.select("shipment_id", F.lit("kept").alias("reason")))
    return rows.join(F.broadcast(counts))  # one row


def _lineage(w) -> DataFrame:
    """Lineage by value: the hash, a file of the folder, and a row number that no other row has."""
    rows = S.add_lineage(S.validated(_csv(w)), "csv", "b1", w.now)
    rows = spread(rows.drop(*(c for c in S.COLUMNS if c != "shipment_id"), "_corrupt_record"), w.shipments.count(), "row_id")
    return rows.withColumns({"is_part": F.col("source_file").rlike(r"^part-\d+.*\.csv$"), "numbered_once": F.count(F.lit(1)).over(Window.partitionBy("row_id")) == 1})


#: The cleaned values of a shipment file's columns, as ``Files.flat`` writes them; the other columns are empty.
DIGIT = "CAST('0x' || substr(md5(shipment_id), 1, 8) AS BIGINT) % 10"
CLEANED_SQL = {c: c for c in "shipment_id carrier shipping_method shipment_status shipped_date estimated_delivery_date actual_delivery_date package_count shipping_cost insurance_cost".split()} | {
    "order_id": "CASE WHEN package_count IS NULL OR package_count <> 3 THEN order_id END",
    "currency": f"CASE WHEN {DIGIT} < 5 THEN 'USD' END",
    "delivery_notes": "'x, \"y\"'",
    "is_return": f"CASE {DIGIT} WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN NULL ELSE CAST(is_return AS VARCHAR) END",
}
HASH_SQL = "sha256(" + " || '|' || ".join(f"coalesce(CAST({CLEANED_SQL[c]} AS VARCHAR), '')" if c in CLEANED_SQL else "''" for c in S.COLUMNS) + ")"


def _loaded(w) -> DataFrame:
    return S.load_file(w.spark, w.folder(), "b1", w.now, scratch(w.spark, "loaded"))[0]


def _archived(w):
    """The rows of the archived files, read back from the archive."""
    archive = scratch(w.spark, "archive")
    ingest.ingest_files(w.spark, w.incoming(), scratch(w.spark, "ingested"), scratch(w.spark, "ingest-state"), w.now, most_files=max(2, w.parts // 2), archive=archive)
    return S.read_csv(w.spark, archive)[0].withColumn("stamp", F.substring("source_file", 1, 15))


def _saved(w):
    """A table written anew, appended to, refused where it exists, and another one replaced."""
    to, other = scratch(w.spark, "table"), scratch(w.spark, "table")
    early = F.col("order_date") < F.lit("1998-01-01").cast("timestamp_ntz")
    load_table(w.stg_orders.where(early), to, "fail")
    load_table(w.stg_orders.where(~early), to, "append")
    try:
        load_table(w.stg_orders, to, "fail")
        raise RuntimeError("a table that exists was written")
    except AnalysisException:
        pass
    load_table(w.stg_orders, other, "fail")
    load_table(w.stg_orders.where(early), other, "replace")
    rows = w.spark.read.parquet(to).withColumn("how", F.lit("append"))
    return rows.unionByName(w.spark.read.parquet(other).withColumn("how", F.lit("replace")))


#: API records by order: the first form has the total as it is, the second one may have a bad total or currency
API = """(SELECT order_id, customer_id, n, form, CASE WHEN form = 1 AND n % 14 = 0 THEN '-' || CAST(total_amount AS VARCHAR) WHEN form = 1 OR n % 4 <> 0 THEN CAST(total_amount AS VARCHAR) ELSE 'invalid_amount' END AS total_amount,
  CASE WHEN form = 1 THEN 'EUR' WHEN n % 3 = 0 THEN 'INVALID' ELSE 'USD' END AS currency
  FROM (SELECT *, CAST(substr(order_id, 5, 9) AS BIGINT) AS n, CASE WHEN CAST(substr(order_id, 5, 9) AS BIGINT) % 2 = 0 THEN 1 ELSE 2 END AS form FROM raw_orders)
  CROSS JOIN (VALUES (1), (2)) AS copies(c) WHERE c = 1 OR n % 10 = 0)"""
ERRORS = "concat_ws(',', CASE WHEN total_amount = 'invalid_amount' THEN 'total is no number' END, CASE WHEN length(currency) <> 3 THEN 'bad currency' END)"
API_CHECKED = f"(SELECT *, {ERRORS} AS errors, {ERRORS} = '' AS is_valid FROM {API})"

#: query: (function, columns, SQL or None)
QUERIES = {
    "csv_scan": (lambda w: _csv(w).select("shipment_id", "carrier", "delivery_notes"), "shipment_id carrier delivery_notes", "SELECT shipment_id, carrier, 'x, \"y\"' AS delivery_notes FROM raw_shipments"),
    "csv_scan_fallback": (_without_ids, "shipment_id carrier inferred:b kind", "SELECT shipment_id, carrier, true AS inferred, 'int' AS kind FROM raw_shipments"),
    "shipments_csv_schema": (_schema, "column_name place:l nullable:b filled:b", SCHEMA_SQL),
    "validate_shipments": (lambda w: S.validated(_csv(w)).where("is_valid"), "shipment_id order_id carrier shipping_cost:d is_valid:b", "SELECT shipment_id, order_id, carrier, shipping_cost, true AS is_valid FROM raw_shipments WHERE package_count IS NULL OR package_count <> 3"),
    "validate_shipments_stats": (lambda w: S.validation_stats(S.validated(_csv(w))), "original_rows:l valid_rows:l invalid_rows:l validation_rate:d", "SELECT count(*) AS original_rows, count(*) FILTER (package_count IS NULL OR package_count <> 3) AS valid_rows, count(*) FILTER (package_count = 3) AS invalid_rows, 1 - CAST(count(*) FILTER (package_count = 3) AS DOUBLE) / count(*) AS validation_rate FROM raw_shipments"),
    "shipments_target_schema": (lambda w: S.target_schema(S.validated(_csv(w))), "shipment_id shipped_date package_count:l shipping_cost:d weight_unit", "SELECT shipment_id, shipped_date, package_count, shipping_cost, 'kg' AS weight_unit FROM raw_shipments"),
    "add_lineage": (
        _lineage, "shipment_id source_system batch_id ingestion_timestamp record_hash is_part:b numbered_once:b",
        f"SELECT shipment_id, 'csv' AS source_system, 'b1' AS batch_id, {NOW} AS ingestion_timestamp, {HASH_SQL} AS record_hash, true AS is_part, true AS numbered_once FROM raw_shipments"),
    "load_shipments_file": (_loaded, "shipment_id order_id carrier shipping_cost:d", "SELECT shipment_id, order_id, carrier, shipping_cost FROM raw_shipments WHERE package_count IS NULL OR package_count <> 3"),
    "quarantined_rows": (
        _quarantined, "shipment_id reason original_rows:l valid_rows:l invalid_rows:l",
        "SELECT shipment_id, CASE package_count WHEN 3 THEN 'missing order_id' WHEN 5 THEN 'malformed' ELSE 'kept' END AS reason, count(*) OVER () AS original_rows, count(*) FILTER (package_count IS NULL OR package_count NOT IN (3, 5)) OVER () AS valid_rows, count(*) FILTER (package_count IN (3, 5)) OVER () AS invalid_rows FROM raw_shipments"),
    "check_column_count": (_field_counts, "fields:l lines:l as_expected:b", f"SELECT CASE WHEN package_count = 5 THEN {len(S.COLUMNS) + 2} ELSE {len(S.COLUMNS)} END AS fields, count(*) AS lines, fields = {len(S.COLUMNS)} AS as_expected FROM raw_shipments GROUP BY 1"),
    "file_stream_ledger": (
        _ledger, "status reason attempts:l files:l records:l",
        f"SELECT 'processed' AS status, NULL AS reason, 1 AS attempts, greatest({PARTS}, count(*) // {FILE_ROWS}) AS files, count(*) FILTER (package_count IS NULL OR package_count <> 3) AS records FROM raw_shipments UNION ALL SELECT 'failed', 'missing required fields: order_id', 2, {BAD}, NULL UNION ALL SELECT 'failed', 'unreadable', 2, 1, NULL"),
    "file_stream_ingest": (lambda w: ingest.ingested(w.spark, _ingested_folder(w)[0]), "shipment_id order_id carrier shipping_cost:d", "SELECT shipment_id, order_id, carrier, shipping_cost FROM raw_shipments WHERE package_count IS NULL OR package_count <> 3"),
    "raw_api_orders": (lambda w: A.raw_orders(w.lines(), "api", "b1"), "order_id customer_id total_amount currency order_items", f"SELECT order_id, coalesce(customer_id, '') AS customer_id, total_amount, currency, '[]' AS order_items FROM {API}"),
    "validate_api_order": (lambda w: _api(w).withColumn("errors", F.array_join("errors", ",")), "order_id errors is_valid:b", f"SELECT order_id, errors, is_valid FROM {API_CHECKED}"),
    "api_order_dedupe_load": (lambda w: A.new_orders(_api(w), w.raw_orders.where("order_status = 'pending'")), "order_id total_amount:d", "SELECT order_id, total_amount FROM (SELECT *, CAST(substr(order_id, 5, 9) AS BIGINT) AS n FROM raw_orders) WHERE order_status <> 'pending' AND (n % 2 = 0 OR n % 3 <> 0) AND NOT (n % 14 = 0 AND total_amount > 0)"),
    "ingestion_stats": (
        lambda w: A.ingestion_stats(_api(w), w.raw_orders.where("order_status = 'pending'")), "fetched:l valid:l invalid:l inserted:l failed:l skipped:l success_rate:d validation_rate:d",
        f"""SELECT *, fetched - valid AS invalid, valid - inserted - failed AS skipped, inserted / CAST(fetched AS DOUBLE) AS success_rate, valid / CAST(fetched AS DOUBLE) AS validation_rate
  FROM (SELECT count(*) AS fetched, count(*) FILTER (is_valid) AS valid, count(DISTINCT order_id) FILTER (is_new AND amount >= 0) AS inserted, count(*) FILTER (is_new AND amount < 0) AS failed
    FROM (SELECT *, TRY_CAST(total_amount AS DOUBLE) AS amount, is_valid AND order_id NOT IN (SELECT order_id FROM raw_orders WHERE order_status = 'pending') AS is_new FROM {API_CHECKED}))"""),
    "table_load": (_saved, "how order_id total_amount:d", "SELECT 'append' AS how, order_id, total_amount FROM stg_orders UNION ALL SELECT 'replace', order_id, total_amount FROM stg_orders WHERE order_date < TIMESTAMP '1998-01-01'"),
    "archive_processed": (_archived, "shipment_id carrier stamp", f"SELECT shipment_id, carrier, strftime({NOW}, '%Y%m%d_%H%M%S') AS stamp FROM raw_shipments"),
    "file_manifest": (_months, "path size:l hash", f"SELECT path, size, hash FROM {MONTHS}"),
    "file_changes": (_changes, "path change size:l hash", f"""SELECT path, CASE nth WHEN 0 THEN 'new' ELSE 'changed' END AS change, size, hash FROM {MONTHS} WHERE nth = 0
UNION ALL SELECT path, 'deleted', NULL, NULL FROM {MONTHS} WHERE nth = 2
UNION ALL SELECT strftime(shipped_date, '%Y-%m'), 'changed', sum(length(shipment_id) + 1), count(*) || ':' || bit_xor({LINE}) || ':' || sum({LINE}) FROM (SELECT * FROM raw_shipments UNION ALL SELECT * FROM raw_shipments WHERE package_count = 1) WHERE month(shipped_date) % 4 = 1 GROUP BY 1"""),
    "file_filter": (lambda w: S.file_filter(_months(w), least=300, most=1 << 40, hours=24, now=F.current_timestamp()), "path", f"SELECT path FROM {MONTHS} WHERE size BETWEEN 300 AND 1099511627776"),
    "file_priority_topk": (lambda w: S.file_priority(_months(w), "largest", 20), "path size:l", f"SELECT path, size FROM {MONTHS} ORDER BY size DESC, path LIMIT 20"),
    "file_stats": (lambda w: S.file_stats(_months(w)), "files:l total:l mean:l least:l most:l", f"SELECT count(*) AS files, sum(size) AS total, floor(avg(size)) AS mean, min(size) AS least, max(size) AS most FROM {MONTHS}"),
    "file_ready_check": (_ready, "path is_ready:b reason", f"SELECT path, nth = 0 AS is_ready, CASE nth WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'too large' ELSE 'missing' END AS reason FROM {MONTHS}"),
    "file_ledger_pending": (lambda w: S.ledger_pending(m := _months(w), _log(w, m), _now(w)), "path decision", f"SELECT path, CASE nth WHEN 1 THEN 'retry' WHEN 3 THEN 'new' ELSE 'skip' END AS decision FROM {MONTHS}"),
    "file_ledger_mark": (lambda w: S.ledger_state(_log(w, _months(w))), "path status records:l error", f"SELECT * FROM {LOGGED}"),
    "file_ledger_stats": (lambda w: S.ledger_stats(_log(w, _months(w))), "files:l processed:l failed:l processing:l records:l success_rate:d", f"SELECT *, processed / CAST(files AS DOUBLE) AS success_rate FROM (SELECT count(*) AS files, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS processing, coalesce(sum(records), 0) AS records FROM {LOGGED})"),
    "file_ledger_failed": (lambda w: S.ledger_reset_failed(_log(w, _months(w)), _now(w)), "path status", f"SELECT path, 'pending' AS status FROM {LOGGED} WHERE status = 'failed'"),
    "file_ledger_export": (_exported, "path status records:l files:l failed:l", f"SELECT path, status, records, (SELECT count(*) FROM {LOGGED}) AS files, (SELECT count(*) FROM {LOGGED} WHERE status = 'failed') AS failed FROM {LOGGED}"),
    "file_ledger_retention": (lambda w: S.ledger_retained(_log(w, m := _months(w)), m.where("path >= '1995'"), _now(w) + F.expr("interval 40 days"), 30), "path status", f"SELECT path, unnest(CASE status WHEN 'failed' THEN ['processing', 'failed'] ELSE ['processing'] END) AS status FROM {LOGGED} WHERE status <> 'processed' AND path >= '1995'"),
}


def queries():
    return {name: (lambda s, d, f=f, spec=spec: result(f(Files(s, d)), spec)) for name, (f, spec, _) in QUERIES.items()}


def oracle_sql():
    return {name: f"WITH {MODELS_SQL}, answer AS ({sql}) {result_sql('answer', spec)}" for name, (_, spec, sql) in QUERIES.items() if sql}
