"""The warehouse models: staging, order and shipment summaries, customer dimension, order fact, daily revenue, segmentation.

Every model is a function of DataFrames. Flags and groups derive from the raw columns, as the models define them,
not from the cleaned columns of the same name.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import STATUS_GROUPS, SHIPMENT_GROUPS, band, calendar_parts, clean_email, clean_phone, days_between, first_match, full_name, grouped, order_value_tier, predicted_ltv, safe_divide, standardize_currency, title_case


def zero() -> Column:
    return F.lit(0).cast("decimal(10,2)")


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where("is_valid")


def with_key(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull())


def stg_orders(raw: DataFrame) -> DataFrame:
    return valid_rows(raw).select(
        "order_id",
        "customer_id",
        "order_date",
        F.lower(F.trim("order_status")).alias("order_status"),
        "total_amount",
        standardize_currency("currency").alias("currency"),
        F.lower(F.trim("payment_method")).alias("payment_method"),
        *(F.coalesce(c, zero()).alias(c) for c in ("discount_amount", "tax_amount", "shipping_cost")),
        order_value_tier("total_amount").alias("order_value_tier"),
        grouped("order_status", STATUS_GROUPS).alias("order_status_group"),
        (F.col("total_amount") - F.col("discount_amount")).alias("net_amount"),
        (F.col("total_amount") + F.col("tax_amount") + F.col("shipping_cost")).alias("gross_amount"),
    )


def stg_customers(raw: DataFrame, now: Column) -> DataFrame:
    email = F.coalesce(F.col("email").rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lit(False))
    age = F.datediff(now, "registration_date")
    out = valid_rows(raw).select(
        "customer_id",
        clean_email("email").alias("email"),
        title_case(F.trim("first_name")).alias("first_name"),
        title_case(F.trim("last_name")).alias("last_name"),
        clean_phone("phone").alias("phone_cleaned"),
        F.upper(F.trim("country")).alias("country"),
        "registration_date",
        F.col("last_login").alias("last_login_date"),
        F.coalesce("marketing_consent", F.lit(False)).alias("marketing_consent"),
        full_name("first_name", "last_name").alias("full_name"),
        email.alias("has_valid_email"),
        band(age, [(30, "new"), (365, "active")], "established", at_most=True).alias("customer_tenure"),
        days_between(now, F.col("last_login")).alias("days_since_last_login"),
    )
    named = [F.col(c).isNotNull() for c in ("email", "first_name", "last_name", "country")]
    passes = reduce(and_, named, F.col("has_valid_email"))
    return out.withColumn("passes_quality_checks", passes)


def stg_shipments(raw: DataFrame) -> DataFrame:
    actual, promised, sent = F.to_date("actual_delivery_date"), F.to_date("estimated_delivery_date"), F.to_date("shipped_date")
    arrived = F.col("shipment_status") == "delivered"
    first = valid_rows(raw).select(
        "shipment_id",
        "order_id",
        title_case(F.trim("carrier")).alias("carrier"),
        F.lower(F.trim("shipping_method")).alias("shipping_method"),
        F.lower(F.trim("shipment_status")).alias("shipment_status"),
        "shipped_date",
        promised.alias("estimated_delivery_date"),
        actual.alias("actual_delivery_date"),
        F.coalesce("package_count", F.lit(1)).alias("package_count"),
        F.coalesce("shipping_cost", zero()).alias("shipping_cost"),
        F.coalesce("insurance_cost", zero()).alias("insurance_cost"),
        F.coalesce("is_return", F.lit(False)).alias("is_return"),
        F.datediff(actual, promised).cast("long").alias("delivery_variance_days"),
        F.datediff(actual, sent).cast("long").alias("total_delivery_days"),
        F.when(arrived, F.col("actual_delivery_date") <= F.col("estimated_delivery_date")).alias("delivered_on_time"),
        grouped("shipment_status", SHIPMENT_GROUPS).alias("shipment_status_group"),
    )
    late = ~F.col("delivered_on_time")
    performance = first_match([(F.col("delivered_on_time"), "on_time"), (late & (F.col("delivery_variance_days") <= 2), "slightly_late"), (late & (F.col("delivery_variance_days") > 2), "significantly_late")], "unknown")
    speed = band("total_delivery_days", [(1, "same_day"), (3, "fast"), (7, "standard")], "slow", at_most=True)
    return first.withColumns({"delivery_performance": performance, "delivery_speed_category": speed})


def customer_order_metrics(orders: DataFrame, now: Column) -> DataFrame:
    """One row for each customer of staged orders."""
    group, tier = F.col("order_status_group"), F.col("order_value_tier")
    m = with_key(orders, "customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_if(group == "fulfilled").alias("fulfilled_orders"),
        count_if(group == "cancelled").alias("cancelled_orders"),
        F.sum("total_amount").alias("total_order_value"),
        F.sum("net_amount").alias("total_net_value"),
        F.sum("gross_amount").alias("total_gross_value"),
        F.max("total_amount").alias("highest_order_value"),
        F.min("total_amount").alias("lowest_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        *(count_if(tier == f"{t}_value").alias(f"{t}_value_orders") for t in ("high", "medium", "low")),
    )
    m = m.withColumns(
        {
            "average_order_value": safe_divide("total_order_value", "total_orders"),
            "cancellation_rate": safe_divide("cancelled_orders", "total_orders"),
            "fulfillment_rate": safe_divide("fulfilled_orders", "total_orders"),
            "days_since_last_order": days_between(now, F.col("last_order_date")),
            "customer_lifetime_days": days_between(F.col("last_order_date"), F.col("first_order_date")),
        }
    )
    life, done, lost = F.col("customer_lifetime_days"), F.col("fulfilled_orders"), F.col("cancellation_rate")
    return m.withColumns(
        {
            "customer_frequency_segment": first_match([(F.col("total_orders") == 1, "one_time"), (F.col("total_orders").between(2, 5), "occasional"), (F.col("total_orders").between(6, 20), "regular")], "frequent"),
            "customer_value_segment": band("average_order_value", [(500, "premium"), (100, "standard")], "budget"),
            "recency_segment": band("days_since_last_order", [(30, "recent"), (90, "lapsing"), (365, "dormant")], "lost", at_most=True),
            "annual_order_value": F.when(life > 0, F.col("total_order_value").cast("double") / (life / F.lit(365.0))).otherwise(F.col("total_order_value").cast("double")),
            "loyalty_segment": first_match([((done >= n) & (lost < share), name) for n, share, name in ((10, 0.1, "loyal"), (5, 0.2, "engaged"), (2, 0.3, "developing"))], "new_or_risky"),
        }
    )


def order_shipment_summary(shipments: DataFrame) -> DataFrame:
    """One row for each order of staged shipments."""
    group, on_time = F.col("shipment_status_group"), F.col("delivered_on_time")
    s = shipments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("total_shipments"),
        count_if(group == "delivered").alias("delivered_shipments"),
        count_if(group == "exception").alias("exception_shipments"),
        count_if(F.col("is_return")).alias("return_shipments"),
        F.sum("shipping_cost").alias("total_shipping_cost"),
        F.sum("insurance_cost").alias("total_insurance_cost"),
        F.min("shipped_date").alias("first_shipment_date"),
        F.max("shipped_date").alias("last_shipment_date"),
        F.min("estimated_delivery_date").alias("earliest_estimated_delivery"),
        F.max("estimated_delivery_date").alias("latest_estimated_delivery"),
        F.min("actual_delivery_date").alias("first_delivery_date"),
        F.max("actual_delivery_date").alias("last_delivery_date"),
        F.avg("delivery_variance_days").alias("avg_delivery_variance_days"),
        F.avg("total_delivery_days").alias("avg_total_delivery_days"),
        F.try_divide(count_if(on_time).cast("double"), F.count("delivered_on_time").cast("double")).alias("on_time_delivery_rate"),
        *(F.mode(c, True).alias(f"primary_{n}") for c, n in (("carrier", "carrier"), ("shipping_method", "shipping_method"), ("delivery_speed_category", "delivery_speed"))),
    )
    return s


def order_shipment_combined(orders: DataFrame, summary: DataFrame) -> DataFrame:
    j = orders.withColumnRenamed("currency", "order_currency").join(summary, "order_id", "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_shipments", "delivered_shipments", "exception_shipments", "return_shipments")})
    n, done, bad = F.col("total_shipments"), F.col("delivered_shipments"), F.col("exception_shipments")
    return j.withColumns(
        {
            "days_to_first_shipment": days_between(F.col("first_shipment_date"), F.col("order_date")),
            "days_to_complete_delivery": days_between(F.col("last_delivery_date").cast("timestamp_ntz"), F.col("order_date")),
            "fulfillment_status": first_match([(n == 0, "not_shipped"), (done == n, "fully_delivered"), (done > 0, "partially_delivered"), (bad > 0, "delivery_issues")], "in_transit"),
            "has_returns": F.col("return_shipments") > 0,
            "shipping_cost_ratio": F.when((F.col("total_shipping_cost") > 0) & (F.col("total_amount") > 0), F.col("total_shipping_cost").cast("double") / F.col("total_amount").cast("double")).otherwise(0.0),
        }
    )


def customer_segment_rule() -> Column:
    loyal, value = F.col("loyalty_segment") == "loyal", F.col("customer_value_segment")
    recent, cooling = F.col("recency_segment") == "recent", F.col("recency_segment").isin("lapsing", "dormant")
    n, often = F.col("total_orders"), F.col("customer_frequency_segment").isin("regular", "frequent")
    rules = [
        (n == 0, "prospect"),
        (loyal & (value == "premium"), "vip"),
        (loyal & (value == "standard"), "champion"),
        (recent & often, "loyal_customer"),
        (recent & (n >= 2), "potential_loyalist"),
        (recent & (n == 1), "new_customer"),
        (cooling & (value == "premium"), "at_risk"),
        (cooling, "need_attention"),
        (F.col("recency_segment") == "lost", "cannot_lose_them"),
    ]
    return first_match(rules, "other")


def activity_flags() -> dict[str, Column]:
    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return {
        "is_active_user": sure(F.col("days_since_last_login") <= 30),
        "is_active_buyer": sure(F.col("days_since_last_order") <= 90),
        "has_purchased": F.col("total_orders") > 0,
        "is_marketable": sure(F.col("marketing_consent") & F.col("has_valid_email")),
    }


def dim_customers(customers: DataFrame, metrics: DataFrame) -> DataFrame:
    j = customers.where("passes_quality_checks").join(metrics, "customer_id", "left")
    numbers = ["total_orders", "fulfilled_orders", "cancelled_orders", "total_order_value", "average_order_value", "cancellation_rate", "fulfillment_rate", "annual_order_value"]
    names = {"customer_frequency_segment": "new", "customer_value_segment": "new", "recency_segment": "new", "loyalty_segment": "new_or_risky"}
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers} | {c: F.coalesce(c, F.lit(d)) for c, d in names.items()})
    return j.withColumns({"customer_segment": customer_segment_rule(), **activity_flags()}).withColumnRenamed("phone_cleaned", "phone")


def order_business_metrics() -> dict[str, Column]:
    group, amount = F.col("order_status_group"), F.col("total_amount")
    blank = zero()
    return {
        "fulfilled_revenue": F.when(group == "fulfilled", amount).otherwise(blank),
        "cancelled_revenue": F.when(group == "cancelled", amount).otherwise(blank),
        "returned_revenue": F.when(F.col("has_returns"), amount).otherwise(blank),
        "delivered_on_time": F.coalesce(F.col("on_time_delivery_rate") >= 1.0, F.lit(False)),
        "fulfillment_speed": band("days_to_first_shipment", [(1, "same_day"), (3, "fast"), (7, "standard")], "slow", at_most=True),
        "estimated_profit": F.col("net_amount") - F.coalesce("total_shipping_cost", blank) - F.coalesce("total_insurance_cost", blank),
        "clean_order": (F.col("exception_shipments") == 0) & (F.col("return_shipments") == 0),
    }


def customer_history() -> dict[str, Column]:
    """Order number, gap and running totals inside a customer, in order of date and id; one sort for all. ``part_`` cuts orders without a customer by day."""
    w = Window.partitionBy("customer_id", "part_").orderBy("order_date", "order_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {
        "customer_order_sequence": F.row_number().over(w).cast("long"),
        "previous_": F.lag("order_date").over(w),
        "cumulative_customer_value": F.sum("total_amount").over(so_far),
        "cumulative_order_count": F.count(F.lit(1)).over(so_far),
    }


def days_without_customer(orders: DataFrame) -> DataFrame:
    """(part_, orders, value and last date of the days before) of orders without a customer: a row for each day."""
    days = orders.where("customer_id is null").groupBy(F.to_date("order_date").alias("part_")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("v"), F.max("order_date").alias("d"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("part_", F.sum("n").over(before).alias("orders_before_"), F.sum("v").over(before).alias("value_before_"), F.max("d").over(before).alias("date_before_"))


CUSTOMER_COLUMNS = ("customer_segment", "customer_frequency_segment", "customer_value_segment", "loyalty_segment", "is_active_buyer")


def fact_orders(combined: DataFrame, customers: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Orders with shipments, customer and history. ``orders``: the orders alone, if at hand; orders without a customer are one long history."""
    who = customers.select("customer_id", *CUSTOMER_COLUMNS, F.col("country").alias("customer_country"))
    j = combined.join(who, "customer_id", "left").withColumn("part_", F.when(F.col("customer_id").isNull(), F.to_date("order_date")))
    return with_history(j.withColumns(calendar_parts("order_date") | order_business_metrics()), combined if orders is None else orders)


def with_history(j: DataFrame, orders: DataFrame) -> DataFrame:
    """``j`` (with part_) and the history columns; ``orders`` are the same orders."""
    j = j.withColumns(customer_history()).join(F.broadcast(days_without_customer(orders)), "part_", "left")  # a row for each day
    none = F.lit(0)
    ahead = F.coalesce("orders_before_", none)
    j = j.withColumns(
        {
            "customer_order_sequence": F.col("customer_order_sequence") + ahead,
            "cumulative_order_count": F.col("cumulative_order_count") + ahead,
            "cumulative_customer_value": F.when(F.col("value_before_").isNull(), F.col("cumulative_customer_value")).otherwise(F.coalesce("cumulative_customer_value", none) + F.col("value_before_")),
            "days_since_previous_order": F.coalesce(days_between(F.col("order_date"), F.coalesce("previous_", "date_before_")), none),
        }
    )
    return j.drop("part_", "previous_", "orders_before_", "value_before_", "date_before_")


def revenue_daily(fact: DataFrame) -> DataFrame:
    amount, segment = F.col("total_amount"), F.col("customer_segment")
    day = fact.groupBy(F.to_date("order_date").alias("date_day")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_if(F.col("order_status_group") == "fulfilled").alias("fulfilled_orders"),
        count_if(F.col("order_status_group") == "cancelled").alias("cancelled_orders"),
        count_if(F.col("has_returns")).alias("returned_orders"),
        count_if(F.col("clean_order")).alias("clean_orders"),
        F.sum("total_amount").alias("gross_revenue"),
        F.sum("fulfilled_revenue").alias("net_revenue"),
        F.sum("cancelled_revenue").alias("cancelled_revenue"),
        F.sum("returned_revenue").alias("returned_revenue"),
        *(F.sum(F.when(segment == s, amount).otherwise(zero())).alias(f"{s}_revenue") for s in ("vip", "champion", "new_customer")),
    )
    # a row for each day from here on
    by_day = Window.orderBy("date_day")
    week = by_day.rowsBetween(-6, Window.currentRow)
    return day.withColumns(
        {
            "average_order_value": safe_divide("gross_revenue", "total_orders"),
            "fulfillment_rate": safe_divide("fulfilled_orders", "total_orders"),
            "cancellation_rate": safe_divide("cancelled_orders", "total_orders"),
            "return_rate": safe_divide("returned_orders", "total_orders"),
            "revenue_realization_rate": safe_divide("net_revenue", "gross_revenue"),
            "gross_revenue_7d_ma": F.sum("gross_revenue").over(week).cast("double") / F.count("gross_revenue").over(week),
            "total_orders_7d_ma": F.avg("total_orders").over(week),
            "gross_revenue_yoy": F.lag("gross_revenue", 365).over(by_day),
        }
    )


def segment_analysis(customers: DataFrame, now: Column) -> DataFrame:
    s = customers.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("total_order_value").alias("segment_revenue"),
        F.avg("average_order_value").alias("avg_order_value"),
        F.avg("total_orders").alias("avg_orders_per_customer"),
        F.avg("days_since_last_order").alias("avg_days_since_last_order"),
        count_if(F.col("is_marketable")).alias("marketable_customers"),
        count_if(F.col("is_active_buyer")).alias("active_buyers"),
        F.avg(days_between(now, F.col("registration_date"))).alias("avg_days_since_registration"),
        F.mode("country", True).alias("primary_country"),
    )
    return s.withColumn("avg_customer_value", safe_divide("segment_revenue", "customer_count"))


# fixed values: action and priority by segment, for customers who may be written to
ACTIONS = {
    "vip": ("vip_exclusive_offers", 9),
    "champion": ("loyalty_rewards", 7),
    "loyal_customer": ("retention_campaigns", 5),
    "potential_loyalist": ("conversion_campaigns", 6),
    "new_customer": ("onboarding_sequence", 3),
    "at_risk": ("win_back_campaigns", 8),
    "need_attention": ("reactivation_campaigns", 4),
    "cannot_lose_them": ("urgent_retention", 10),
}


def marketing_actions() -> dict[str, Column]:
    segment, open_to = F.col("customer_segment"), F.col("is_marketable")
    strategy = [(F.col("customer_value_segment") == "premium", "personalized_high_touch"), (F.col("customer_frequency_segment") == "frequent", "regular_engagement"), (segment == "new_customer", "educational_content")]
    ltv = F.when(segment == "new_customer", F.round(F.col("average_order_value") * 3, 4)).otherwise(predicted_ltv("total_order_value", "customer_segment"))
    return {
        "marketing_recommendation": F.when(~open_to, "not_marketable").otherwise(first_match([(segment == s, a) for s, (a, _) in ACTIONS.items()], "no_action")),
        "communication_strategy": first_match(strategy, "standard_communication"),
        "marketing_priority": F.when(open_to, first_match([(segment == s, p) for s, (_, p) in ACTIONS.items()], 1)).otherwise(1),
        "predicted_lifetime_value": ltv,
    }


def customer_segmentation(customers: DataFrame, segments: DataFrame) -> DataFrame:
    own = segments.select("customer_segment", F.col("customer_count").alias("segment_size"), "segment_revenue", F.col("avg_customer_value").alias("segment_avg_value"), F.col("marketable_customers").alias("segment_marketable_count"))
    j = customers.join(F.broadcast(own), "customer_segment", "left")  # ten segments at most
    value, mean = F.col("total_order_value").cast("double"), F.col("segment_avg_value")
    versus = first_match([(value > mean, "above_average"), (value == mean, "average")], "below_average")
    return j.withColumn("value_vs_segment", versus).withColumns(marketing_actions())
