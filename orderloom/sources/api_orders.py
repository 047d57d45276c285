"""Order records of an API as JSON lines: aliased keys, defaults, validation, deduplicated load, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constraints import checkable
from ..functions.rules import EMAIL

# fixed values: names that a field may have, and its default
FIELDS = {
    "order_id": (("id", "order_id"), ""),
    "customer_id": (("customer_id", "customerId"), ""),
    "order_date": (("order_date", "orderDate"), None),
    "order_status": (("status", "order_status"), None),
    "total_amount": (("total", "total_amount"), "0"),
    "currency": (("currency",), "USD"),
    "payment_method": (("payment_method", "paymentMethod"), None),
    "shipping_address": (("shipping_address", "shippingAddress"), None),
    "billing_address": (("billing_address", "billingAddress"), None),
    "order_items": (("items", "order_items"), "[]"),
    "discount_amount": (("discount", "discount_amount"), "0"),
    "tax_amount": (("tax", "tax_amount"), "0"),
    "shipping_cost": (("shipping", "shipping_cost"), "0"),
    "notes": (("notes", "comments"), None),
    "email": (("email",), None),
}


def raw_orders(lines: DataFrame, source_system: str, batch_id: str, value: str = "value") -> DataFrame:
    """A row for each JSON line, all fields as text; a damaged line has the defaults."""
    one = {name: F.coalesce(*(F.get_json_object(value, f"$.{a}") for a in aliases), F.lit(default)).alias(name) for name, (aliases, default) in FIELDS.items()}
    return lines.select(*one.values(), F.lit(source_system).alias("source_system"), F.lit(batch_id).alias("batch_id"), F.sha2(value, 256).alias("record_hash"))


def with_errors(orders: DataFrame) -> DataFrame:
    """errors and is_valid; fields that are null or empty are not checked, but the id."""

    def given(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c) != "")

    rules = {
        "missing order id": ~given("order_id"),
        "total is no number": given("total_amount") & F.col("total_amount").try_cast("double").isNull(),
        "bad email": given("email") & ~F.col("email").rlike(EMAIL),
        "bad currency": given("currency") & (F.char_length("currency") != 3),
    }
    errors = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return orders.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def with_refusal(checked: DataFrame) -> DataFrame:
    """``refused``: does the row break a constraint of the stored table? The check reads the total as a number, the row keeps its text."""
    rules = checkable("raw_orders", checked.columns)
    broken = reduce(Column.__or__, (F.coalesce(~F.expr(sql), F.lit(False)) for sql in rules.values()))
    typed = checked.withColumns({"text_": F.col("total_amount"), "total_amount": F.col("total_amount").try_cast("double")})
    return typed.withColumn("refused", broken).withColumn("total_amount", F.col("text_")).drop("text_")


def new_orders(checked: DataFrame, stored: DataFrame) -> DataFrame:
    """Valid orders that are not stored yet and that the table takes, one for each id."""
    rows = with_refusal(checked).where("is_valid and not refused").drop("refused")
    return rows.dropDuplicates(["order_id"]).join(stored.select("order_id"), "order_id", "left_anti")


def ingestion_stats(checked: DataFrame, stored: DataFrame) -> DataFrame:
    """What a load of ``checked`` into ``stored`` does with its rows.

    Of the valid rows those with a stored id are skipped; of the others those that break a constraint failed, and of each id one of the
    rest is inserted: its repeats are skipped too.
    """
    known = stored.select("order_id").distinct().withColumn("known", F.lit(True))
    rows = with_refusal(checked).select("order_id", "is_valid", "refused")
    # counts by id first, so that an id with many rows is one row in the join
    by_id = rows.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_valid").alias("valid"), F.count_if(F.col("is_valid") & F.col("refused")).alias("refused")
    ).join(known, "order_id", "left")
    new = F.col("known").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = by_id.agg(
        total("rows").alias("fetched"),
        total("valid").alias("valid"),
        F.count_if(new & (F.col("valid") > F.col("refused"))).alias("inserted"),
        total(F.when(new, F.col("refused"))).alias("failed"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return n.withColumns({
        "invalid": F.col("fetched") - F.col("valid"),
        "skipped": F.col("valid") - F.col("inserted") - F.col("failed"),
        "success_rate": rate("inserted", "fetched"),
        "validation_rate": rate("valid", "fetched"),
    })
