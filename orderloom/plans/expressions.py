"""Queries of the expression library: scalar functions by family, and the business rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from .results import result, result_sql
from .warehouse import MODELS_SQL, NOW, Warehouse

EMAIL_ANY = r"'(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'"
LTV_SQL = "round(CAST(total_order_value AS DOUBLE) * CASE customer_segment WHEN 'vip' THEN 2.5 WHEN 'champion' THEN 2.0 WHEN 'loyal_customer' THEN 1.8 WHEN 'potential_loyalist' THEN 1.5 ELSE 1.1 END, 4)"
AGE_SQL = f"CASE WHEN date_of_birth IS NULL THEN 'Unknown' WHEN age < 18 THEN 'Under 18' WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' ELSE '65+' END"
AGED = f"(SELECT *, datesub('year', date_of_birth, CAST({NOW} AS DATE)) AS age FROM raw_customers)"
TIER_SQL = "CASE WHEN {0} IS NULL OR {0} = 0 THEN 'New' WHEN {0} >= 10000 THEN 'Platinum' WHEN {0} >= 5000 THEN 'Gold' WHEN {0} >= 1000 THEN 'Silver' ELSE 'Bronze' END"
REGION_SQL = "CASE " + " ".join(f"WHEN upper(trim(country)) IN ({', '.join(repr(c) for c in cs)}) THEN '{r}'" for r, cs in R.REGIONS.items()) + " ELSE 'Other' END"
RFM_SQL = (
    "CASE WHEN days_since_last_order <= 30 THEN '5' WHEN days_since_last_order <= 90 THEN '4' WHEN days_since_last_order <= 365 THEN '3' WHEN days_since_last_order <= 730 THEN '2' ELSE '1' END"
    " || CASE WHEN total_orders >= 10 THEN '5' WHEN total_orders >= 5 THEN '4' WHEN total_orders >= 2 THEN '3' WHEN total_orders >= 1 THEN '2' ELSE '1' END"
    " || CASE WHEN total_order_value >= 1000 THEN '5' WHEN total_order_value >= 500 THEN '4' WHEN total_order_value >= 100 THEN '3' WHEN total_order_value >= 1 THEN '2' ELSE '1' END"
)
FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"]
FORMATS_SQL = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%m/%d/%Y"]


def written_dates(w: Warehouse):
    """Order dates as text in several forms, some of them no dates."""
    n = F.substring("order_id", 5, 9).cast("long")
    day = F.col("order_date")
    forms = [F.date_format(day, f.replace("'Z'", "'Z'")) for f in (FORMATS[0], FORMATS[2], FORMATS[3], FORMATS[4], FORMATS[6])]
    return w.raw_orders.select("order_id", F.when(n % 6 == 5, "invalid-date").otherwise(F.element_at(F.array(*forms), (n % 6 + 1).cast("int"))).alias("written"))


WRITTEN_SQL = "(SELECT order_id, CASE CAST(substr(order_id, 5, 9) AS BIGINT) % 6 WHEN 0 THEN strftime(order_date, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(order_date, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(order_date, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(order_date, '%Y-%m-%d') WHEN 4 THEN strftime(order_date, '%m/%d/%Y') ELSE 'invalid-date' END AS written FROM raw_orders)"

#: query: (frame, its table, key columns, {column and kind: (Column, SQL)})
QUERIES = {
    "scalar_string": ("raw_customers", "raw_customers", "customer_id", {
        "lowered": (lambda w: F.lower(F.trim("email")), "lower(trim(email))"),
        "upped": (lambda w: F.upper(F.trim("country")), "upper(trim(country))"),
        "title": (lambda w: R.title_case(F.trim("first_name")), "upper(substr(trim(first_name), 1, 1)) || lower(substr(trim(first_name), 2))"),
        "joined": (lambda w: F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))), "concat(first_name, ' ', last_name)"),
        "padded": (lambda w: F.lpad(F.substring("customer_id", 6, 7), 10, "0"), "lpad(substr(customer_id, 6, 7), 10, '0')"),
        "base": (lambda w: F.element_at(F.split("customer_id", "-"), -1), "split(customer_id, '-')[-1]"),
    }),
    "scalar_regex": ("raw_customers", "raw_customers", "customer_id", {
        "strict:b": (lambda w: F.col("email").rlike(R.EMAIL), f"regexp_matches(email, '{R.EMAIL}')"),
        "loose:b": (lambda w: F.col("email").rlike("(?i)^customer"), "regexp_matches(email, '(?i)^customer')"),
        "digits": (lambda w: F.regexp_replace("phone", "[^0-9]", ""), "regexp_replace(phone, '[^0-9]', '', 'g')"),
    }),
    "scalar_conditional": ("raw_orders", "raw_orders", "order_id", {
        "searched": (lambda w: R.order_value_tier("total_amount"), "CASE WHEN total_amount >= 1000 THEN 'high_value' WHEN total_amount >= 100 THEN 'medium_value' ELSE 'low_value' END"),
        "filled:d": (lambda w: F.coalesce("discount_amount", F.lit(0)), "coalesce(discount_amount, 0)"),
        "nulled": (lambda w: F.nullif("currency", F.lit("EUR")), "nullif(currency, 'EUR')"),
        "among:b": (lambda w: F.col("currency").isin("EUR", "GBP"), "currency IN ('EUR', 'GBP')"),
        "within:b": (lambda w: F.col("total_amount").between(100, 500), "total_amount BETWEEN 100 AND 500"),
        "larger:d": (lambda w: F.greatest("tax_amount", F.lit(20)), "greatest(tax_amount, 20)"),
        "smaller:d": (lambda w: F.least("tax_amount", F.lit(20)), "least(tax_amount, 20)"),
    }),
    "scalar_cast": ("raw_orders", "raw_orders", "order_id", {
        "day": (lambda w: F.col("order_date").cast("date"), "CAST(order_date AS DATE)"),
        "number:d": (lambda w: F.col("total_amount").cast("string").cast("double"), "CAST(CAST(total_amount AS VARCHAR) AS DOUBLE)"),
        "failed:d": (lambda w: F.col("currency").try_cast("double"), "TRY_CAST(currency AS DOUBLE)"),
        "word": (lambda w: F.when(F.upper("source_system").isin("WEB", "YES"), "true").when(F.upper("source_system").isin("STORE", "NO"), "false"), "CASE WHEN upper(source_system) IN ('WEB', 'YES') THEN 'true' WHEN upper(source_system) IN ('STORE', 'NO') THEN 'false' END"),
    }),
    "scalar_math": ("raw_orders", "raw_orders", "order_id", {
        "summed:d": (lambda w: F.col("total_amount") + F.col("tax_amount"), "total_amount + tax_amount"),
        "product:d": (lambda w: F.col("total_amount").cast("double") * 1.5, "CAST(total_amount AS DOUBLE) * 1.5"),
        "quotient:d": (lambda w: F.try_divide(F.col("tax_amount").cast("double"), F.col("total_amount").cast("double")), "CAST(tax_amount AS DOUBLE) / nullif(CAST(total_amount AS DOUBLE), 0)"),
        "floored:l": (lambda w: F.floor("total_amount"), "floor(total_amount)"),
        "rounded:d": (lambda w: F.round("total_amount", 1), "round(total_amount, 1)"),
    }),
    "scalar_date": ("raw_orders", "raw_orders", "order_id", {
        "later": (lambda w: F.col("order_date") + F.make_dt_interval(F.lit(30)), "order_date + INTERVAL 30 DAY"),
        "age_days:l": (lambda w: F.datediff(w.now, "order_date"), f"datediff('day', order_date, {NOW})"),
        "y:l": (lambda w: F.year("order_date"), "year(order_date)"),
        "q:l": (lambda w: F.quarter("order_date"), "quarter(order_date)"),
        "wk:l": (lambda w: F.weekofyear("order_date"), "weekofyear(order_date)"),
        "dow:l": (lambda w: F.dayofweek("order_date") - 1, "dayofweek(order_date)"),
        "doy:l": (lambda w: F.dayofyear("order_date"), "dayofyear(order_date)"),
        "epoch:l": (lambda w: F.unix_timestamp(F.col("order_date").cast("timestamp")), "CAST(epoch(order_date) AS BIGINT)"),
        "written": (lambda w: F.date_format("order_date", "yyyyMMdd"), "strftime(order_date, '%Y%m%d')"),
        "month_name": (lambda w: F.date_format("order_date", "MMMM"), "monthname(order_date)"),
    }),
    "scalar_datetime_parse": (written_dates, WRITTEN_SQL, "order_id written", {
        "parsed": (lambda w: F.date_format(R.parse_datetime("written", FORMATS), "yyyy-MM-dd HH:mm:ss"), "strftime(coalesce(" + ", ".join(f"try_strptime(written, '{f}')" for f in FORMATS_SQL) + "), '%Y-%m-%d %H:%M:%S')"),
    }),
    "scalar_hash": ("raw_orders", "raw_orders", "order_id", {
        "md5_hex": (lambda w: F.md5("order_id"), "md5(order_id)"),
        "sha_hex": (lambda w: F.sha2("order_id", 256), "sha256(order_id)"),
        "key": (lambda w: R.surrogate_key("order_id", "customer_id"), "md5(order_id || '-' || coalesce(customer_id, '_null_'))"),
    }),
    "scalar_json": ("raw_customers", "raw_customers", "customer_id", {
        "country": (lambda w: F.get_json_object(F.to_json(F.struct("customer_id", "country")), "$.country"), "json_object('customer_id', customer_id, 'country', country) ->> 'country'"),
        "size:l": (lambda w: F.json_array_length(F.to_json(F.array("customer_id", "phone"))), "json_array_length(json_array(customer_id, phone))"),
        "read": (lambda w: F.from_json(F.to_json(F.struct("phone")), "phone string")["phone"], "phone"),
    }),
    "scalar_array": ("raw_customers", "raw_customers", "customer_id", {
        "picked": (lambda w: F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.substring("customer_id", 6, 7).cast("int") % 3 + 1)), "(['a', 'b', 'c'])[CAST(substr(customer_id, 6, 7) AS INTEGER) % 3 + 1]"),
        "errors": (lambda w: F.array_join(F.array_compact(F.array(F.when(F.col("email").isNull(), "email"), F.when(F.col("country").isNull(), "country"))), ","), "array_to_string(list_filter([CASE WHEN email IS NULL THEN 'email' END, CASE WHEN country IS NULL THEN 'country' END], lambda x: x IS NOT NULL), ',')"),
        "parts:l": (lambda w: F.size(F.split("phone", "-")), "len(split(phone, '-'))"),
    }),
    "predicted_ltv": ("dim", "dim", "customer_id", {"ltv:d": (lambda w: R.predicted_ltv("total_order_value", "customer_segment"), LTV_SQL)}),
    "standardize_currency": ("raw_orders", "raw_orders", "order_id", {"clean": (lambda w: R.standardize_currency("currency"), "upper(trim(currency))")}),
    "order_value_tier": ("raw_orders", "raw_orders", "order_id", {"tier": (lambda w: R.order_value_tier("total_amount", 500, 50), "CASE WHEN total_amount >= 500 THEN 'high_value' WHEN total_amount >= 50 THEN 'medium_value' ELSE 'low_value' END")}),
    "rfm_score": ("metrics", "metrics", "customer_id", {"rfm": (lambda w: R.rfm_score("days_since_last_order", "total_orders", "total_order_value"), RFM_SQL)}),
    "clean_email": ("raw_customers", "raw_customers", "customer_id", {"clean": (lambda w: R.clean_email("email"), "lower(trim(email))")}),
    "clean_phone": ("raw_customers", "raw_customers", "customer_id", {
        "digits": (lambda w: R.clean_phone("phone"), "regexp_replace(phone, '[^0-9]', '', 'g')"),
        "with_plus": (lambda w: R.clean_phone("phone", keep_plus=True), "regexp_replace(phone, '[^0-9+]', '', 'g')"),
    }),
    "delivery_performance": ("stg_shipments", "stg_shipments", "shipment_id", {
        "rated": (lambda w: R.delivery_performance("actual_delivery_date", "estimated_delivery_date"), "CASE WHEN actual_delivery_date IS NULL THEN 'not_delivered' WHEN actual_delivery_date <= estimated_delivery_date THEN 'on_time' WHEN actual_delivery_date <= estimated_delivery_date + 1 THEN 'slightly_late' ELSE 'significantly_late' END"),
    }),
    "surrogate_key": ("raw_orders", "raw_orders", "order_id", {"key": (lambda w: R.surrogate_key("order_id", "customer_id", "order_status"), "md5(order_id || '-' || coalesce(customer_id, '_null_') || '-' || order_status)")}),
    "safe_divide": ("metrics", "metrics", "customer_id", {"share:d": (lambda w: R.safe_divide("cancelled_orders", "high_value_orders"), "coalesce(cancelled_orders / nullif(high_value_orders, 0), 0)")}),
    "age_group": ("raw_customers", AGED, "customer_id", {"band": (lambda w: R.age_group("date_of_birth", F.to_date(w.now)), AGE_SQL)}),
    "customer_tier": ("dim", "dim", "customer_id", {"tier": (lambda w: R.customer_tier("total_order_value"), TIER_SQL.format("total_order_value"))}),
    "region_from_country": ("raw_customers", "raw_customers", "customer_id", {"region": (lambda w: R.region_from_country("country"), REGION_SQL)}),
    "record_hash": ("raw_orders", "raw_orders", "order_id", {"hash": (lambda w: R.record_hash("order_id", "customer_id"), "sha256(order_id || '|' || coalesce(customer_id, ''))")}),
    "is_valid_email": ("raw_customers", "raw_customers", "customer_id", {"valid:b": (lambda w: R.is_valid_email("email"), f"coalesce(regexp_matches(email, {EMAIL_ANY}), false)")}),
    "quality_score": (
        lambda w: w.raw_customers.groupBy("country").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("email").isNull()).alias("nulls"), F.count_if(~F.col("is_valid")).alias("invalid"), (F.count(F.lit(1)) - F.countDistinct("phone")).alias("dup")),
        "(SELECT country, count(*) AS total, count(*) FILTER (email IS NULL) AS nulls, count(*) FILTER (NOT is_valid) AS invalid, count(*) - count(DISTINCT phone) AS dup FROM raw_customers GROUP BY 1)",
        "country", {"score:d": (lambda w: R.quality_score("total", "nulls", "invalid", "dup"), "CASE WHEN total = 0 THEN 0 ELSE round(greatest(0, least(1, 1 - (CAST(0.3 AS DOUBLE) * nulls + CAST(0.5 AS DOUBLE) * invalid + CAST(0.2 AS DOUBLE) * dup) / total)), 2) END")},
    ),
    "customer_derived_fields": (lambda w: w.raw_customers.join(w.metrics.select("customer_id", "total_order_value"), "customer_id", "left"), f"(SELECT * FROM {AGED} LEFT JOIN (SELECT customer_id, total_order_value FROM metrics) USING (customer_id))", "customer_id", {
        "band": (lambda w: R.age_group("date_of_birth", F.to_date(w.now)), AGE_SQL),
        "tier": (lambda w: R.customer_tier("total_order_value"), TIER_SQL.format("total_order_value")),
        "region": (lambda w: R.region_from_country("country"), REGION_SQL),
        "name": (lambda w: F.trim(F.concat(F.coalesce(F.trim("first_name"), F.lit("")), F.lit(" "), F.coalesce(F.trim("last_name"), F.lit("")))), "trim(coalesce(trim(first_name), '') || ' ' || coalesce(trim(last_name), ''))"),
    }),
    "product_margin": ("dim_products", "dim_products", "product_key", {"margin:d": (lambda w: R.product_margin("unit_price", "unit_cost"), "CASE WHEN unit_price > 0 THEN round((CAST(unit_price AS DOUBLE) - CAST(unit_cost AS DOUBLE)) / CAST(unit_price AS DOUBLE) * 100, 4) END")}),
    "order_derived_fields": ("fact", "fact", "order_id", {
        "total:d": (lambda w: F.coalesce("gross_amount", F.lit(0)) - F.coalesce("total_shipping_cost", F.lit(0)), "coalesce(gross_amount, 0) - coalesce(total_shipping_cost, 0)"),
        "is_first:b": (lambda w: F.col("customer_order_sequence") == 1, "customer_order_sequence = 1"),
        "is_repeat:b": (lambda w: F.col("customer_order_sequence") > 1, "customer_order_sequence > 1"),
    }),
    "touch_updated_at": ("raw_orders", "raw_orders", "order_id", {"updated_at": (lambda w: F.when(F.lower(F.trim("order_status")) != F.col("order_status"), w.now).otherwise(F.col("order_date")), f"CASE WHEN lower(trim(order_status)) <> order_status THEN {NOW} ELSE order_date END")}),
}


def _frame(w: Warehouse, frame):
    return frame(w) if callable(frame) else getattr(w, frame)


def _plain(spark, sf_dir, entry):
    frame, _, key, columns = entry
    w = Warehouse(spark, sf_dir)
    df = _frame(w, frame).withColumns({f"out_{c.split(':')[0]}": f(w) for c, (f, _) in columns.items()})
    names = [F.col(k) for k in key.split()] + [F.col(f"out_{c.split(':')[0]}").alias(c.split(":")[0]) for c in columns]
    return result(df.select(*names), _spec(key, columns))


def _spec(key, columns):
    return " ".join([k + ":l" if k == "product_key" else k for k in key.split()] + list(columns))


def _plain_sql(entry):
    _, table, key, columns = entry
    own = ", ".join([f"t.{k} AS {k}" for k in key.split()] + [f"{sql} AS out_{c.split(':')[0]}" for c, (_, sql) in columns.items()])
    renamed = ", ".join([*key.split(), *(f"out_{c.split(':')[0]} AS {c.split(':')[0]}" for c in columns)])
    return f"WITH {MODELS_SQL}, made AS (SELECT {own} FROM {table} AS t), answer AS (SELECT {renamed} FROM made) {result_sql('answer', _spec(key, columns))}"


def _series(spark, sf_dir):
    """One row for each day between the first and the last order, the last excluded, with the orders of that day."""
    w = Warehouse(spark, sf_dir)
    ends = w.raw_orders.agg(F.min(F.to_date("order_date")).alias("a"), F.max(F.to_date("order_date")).alias("b"))
    days = ends.where("b > a").select(F.explode(F.sequence("a", F.date_sub("b", 1))).alias("day"))
    n = w.raw_orders.groupBy(F.to_date("order_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return result(days.join(n, "day", "left").withColumn("orders", F.coalesce("n", F.lit(0))), "day orders:l")


SERIES_SQL = f"WITH {MODELS_SQL}, days AS (SELECT CAST(unnest(generate_series(min(CAST(order_date AS DATE)), max(CAST(order_date AS DATE)) - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM raw_orders), answer AS (SELECT day, count(order_id) AS orders FROM days LEFT JOIN raw_orders ON CAST(order_date AS DATE) = day GROUP BY 1) {result_sql('answer', 'day orders:l')}"


def queries():
    out = {name: (lambda s, d, e=entry: _plain(s, d, e)) for name, entry in QUERIES.items()}
    return out | {"series_generate": _series, "date_spine": _series}


def oracle_sql():
    return {name: _plain_sql(entry) for name, entry in QUERIES.items()} | {"series_generate": SERIES_SQL, "date_spine": SERIES_SQL}
