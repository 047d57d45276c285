"""Queries of the warehouse models over the given tables, and their oracles."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import models as M
from ..sources import retail
from ..sources.retail import AS_OF, RAW_SQL
from ..sources.storage import materialize, scratch, spread
from .results import result, result_sql


class Warehouse:
    """The models over one data folder: each is built when a query asks for it, and plans compose lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.now = spark, sf_dir, retail.as_of()

    def raw(self, name: str) -> DataFrame:
        return getattr(retail, name)(self.spark, self.sf_dir)

    raw_orders = cached_property(lambda self: self.raw("raw_orders"))
    raw_shipments = cached_property(lambda self: self.raw("raw_shipments"))
    raw_customers = cached_property(lambda self: self.raw("raw_customers"))
    order_items = cached_property(lambda self: self.raw("order_items"))
    dim_products = cached_property(lambda self: self.raw("dim_products"))
    stg_orders = cached_property(lambda self: M.stg_orders(self.raw_orders))
    stg_customers = cached_property(lambda self: M.stg_customers(self.raw_customers, self.now))
    stg_shipments = cached_property(lambda self: M.stg_shipments(self.raw_shipments))
    metrics = cached_property(lambda self: M.customer_order_metrics(self.stg_orders, self.now))
    summary = cached_property(lambda self: M.order_shipment_summary(self.stg_shipments))
    combined = cached_property(lambda self: M.order_shipment_combined(self.stg_orders, self.summary))
    dim = cached_property(lambda self: M.dim_customers(self.stg_customers, self.metrics))
    fact = cached_property(lambda self: M.fact_orders(self.combined, self.dim, self.stg_orders))
    daily = cached_property(lambda self: M.revenue_daily(self.fact))
    segments = cached_property(lambda self: M.segment_analysis(self.dim, self.now))
    segmentation = cached_property(lambda self: M.customer_segmentation(self.dim, self.segments))


EMAIL_SQL = r"'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'"
NOW = f"TIMESTAMP '{AS_OF}'"


def title_sql(x: str) -> str:
    return f"upper(substr(trim({x}), 1, 1)) || lower(substr(trim({x}), 2))"


MODELS_SQL = RAW_SQL + rf""",
stg_orders AS (
  SELECT order_id, customer_id, order_date, lower(trim(order_status)) AS order_status, total_amount, upper(trim(currency)) AS currency, lower(trim(payment_method)) AS payment_method,
    coalesce(discount_amount, 0) AS discount_amount, coalesce(tax_amount, 0) AS tax_amount, coalesce(shipping_cost, 0) AS shipping_cost,
    CASE WHEN total_amount >= 1000 THEN 'high_value' WHEN total_amount >= 100 THEN 'medium_value' ELSE 'low_value' END AS order_value_tier,
    CASE WHEN r.order_status IN ('pending', 'processing') THEN 'active' WHEN r.order_status IN ('shipped', 'delivered') THEN 'fulfilled' WHEN r.order_status IN ('cancelled', 'refunded') THEN 'cancelled' ELSE 'unknown' END AS order_status_group,
    r.total_amount - r.discount_amount AS net_amount, r.total_amount + r.tax_amount + r.shipping_cost AS gross_amount
  FROM raw_orders r WHERE is_valid),
stg_customers0 AS (
  SELECT customer_id, lower(trim(r.email)) AS email, {title_sql('r.first_name')} AS first_name, {title_sql('r.last_name')} AS last_name, regexp_replace(phone, '[^0-9]', '', 'g') AS phone_cleaned, upper(trim(r.country)) AS country,
    registration_date, last_login AS last_login_date, coalesce(r.marketing_consent, false) AS marketing_consent,
    coalesce({title_sql('r.first_name')}, '') || ' ' || coalesce({title_sql('r.last_name')}, '') AS full_name,
    coalesce(regexp_matches(r.email, {EMAIL_SQL}), false) AS has_valid_email,
    CASE WHEN registration_date >= {NOW} - INTERVAL 30 DAY THEN 'new' WHEN registration_date >= {NOW} - INTERVAL 365 DAY THEN 'active' ELSE 'established' END AS customer_tenure,
    datediff('day', last_login, {NOW}) AS days_since_last_login
  FROM raw_customers r WHERE is_valid),
stg_customers AS (SELECT *, email IS NOT NULL AND has_valid_email AND first_name IS NOT NULL AND last_name IS NOT NULL AND country IS NOT NULL AS passes_quality_checks FROM stg_customers0),
stg_shipments0 AS (
  SELECT shipment_id, order_id, {title_sql('r.carrier')} AS carrier, lower(trim(r.shipping_method)) AS shipping_method, lower(trim(r.shipment_status)) AS shipment_status, shipped_date,
    CAST(r.estimated_delivery_date AS DATE) AS estimated_delivery_date, CAST(r.actual_delivery_date AS DATE) AS actual_delivery_date,
    coalesce(r.package_count, 1) AS package_count, coalesce(r.shipping_cost, 0) AS shipping_cost, coalesce(r.insurance_cost, 0) AS insurance_cost, coalesce(r.is_return, false) AS is_return,
    CAST(r.actual_delivery_date AS DATE) - CAST(r.estimated_delivery_date AS DATE) AS delivery_variance_days,
    CAST(r.actual_delivery_date AS DATE) - CAST(r.shipped_date AS DATE) AS total_delivery_days,
    CASE WHEN r.shipment_status = 'delivered' THEN r.actual_delivery_date <= r.estimated_delivery_date END AS delivered_on_time,
    CASE WHEN r.shipment_status IN ('pending', 'processing') THEN 'preparing' WHEN r.shipment_status IN ('shipped', 'in_transit') THEN 'in_transit' WHEN r.shipment_status = 'delivered' THEN 'delivered' WHEN r.shipment_status IN ('returned', 'lost', 'damaged') THEN 'exception' ELSE 'unknown' END AS shipment_status_group
  FROM raw_shipments r WHERE is_valid),
stg_shipments AS (
  SELECT *, CASE WHEN delivered_on_time THEN 'on_time' WHEN NOT delivered_on_time AND delivery_variance_days <= 2 THEN 'slightly_late' WHEN NOT delivered_on_time AND delivery_variance_days > 2 THEN 'significantly_late' ELSE 'unknown' END AS delivery_performance,
    CASE WHEN total_delivery_days <= 1 THEN 'same_day' WHEN total_delivery_days <= 3 THEN 'fast' WHEN total_delivery_days <= 7 THEN 'standard' ELSE 'slow' END AS delivery_speed_category FROM stg_shipments0),
metrics0 AS (
  SELECT customer_id, count(*) AS total_orders, count(*) FILTER (order_status_group = 'fulfilled') AS fulfilled_orders, count(*) FILTER (order_status_group = 'cancelled') AS cancelled_orders,
    sum(total_amount) AS total_order_value, sum(net_amount) AS total_net_value, sum(gross_amount) AS total_gross_value, max(total_amount) AS highest_order_value, min(total_amount) AS lowest_order_value,
    min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(*) FILTER (order_value_tier = 'high_value') AS high_value_orders, count(*) FILTER (order_value_tier = 'medium_value') AS medium_value_orders, count(*) FILTER (order_value_tier = 'low_value') AS low_value_orders
  FROM stg_orders WHERE customer_id IS NOT NULL GROUP BY customer_id),
metrics1 AS (
  SELECT *, CAST(total_order_value AS DOUBLE) / total_orders AS average_order_value, cancelled_orders / total_orders AS cancellation_rate, fulfilled_orders / total_orders AS fulfillment_rate,
    date_part('day', {NOW} - last_order_date) AS days_since_last_order, date_part('day', last_order_date - first_order_date) AS customer_lifetime_days FROM metrics0),
metrics AS (
  SELECT *, CASE WHEN total_orders = 1 THEN 'one_time' WHEN total_orders <= 5 THEN 'occasional' WHEN total_orders <= 20 THEN 'regular' ELSE 'frequent' END AS customer_frequency_segment,
    CASE WHEN average_order_value >= 500 THEN 'premium' WHEN average_order_value >= 100 THEN 'standard' ELSE 'budget' END AS customer_value_segment,
    CASE WHEN days_since_last_order <= 30 THEN 'recent' WHEN days_since_last_order <= 90 THEN 'lapsing' WHEN days_since_last_order <= 365 THEN 'dormant' ELSE 'lost' END AS recency_segment,
    CASE WHEN customer_lifetime_days > 0 THEN CAST(total_order_value AS DOUBLE) / (customer_lifetime_days / CAST(365 AS DOUBLE)) ELSE CAST(total_order_value AS DOUBLE) END AS annual_order_value,
    CASE WHEN fulfilled_orders >= 10 AND cancellation_rate < 0.1 THEN 'loyal' WHEN fulfilled_orders >= 5 AND cancellation_rate < 0.2 THEN 'engaged' WHEN fulfilled_orders >= 2 AND cancellation_rate < 0.3 THEN 'developing' ELSE 'new_or_risky' END AS loyalty_segment FROM metrics1),
summary AS (
  SELECT order_id, count(*) AS total_shipments, count(*) FILTER (shipment_status_group = 'delivered') AS delivered_shipments, count(*) FILTER (shipment_status_group = 'exception') AS exception_shipments, count(*) FILTER (is_return) AS return_shipments,
    sum(shipping_cost) AS total_shipping_cost, sum(insurance_cost) AS total_insurance_cost, min(shipped_date) AS first_shipment_date, max(shipped_date) AS last_shipment_date,
    min(estimated_delivery_date) AS earliest_estimated_delivery, max(estimated_delivery_date) AS latest_estimated_delivery, min(actual_delivery_date) AS first_delivery_date, max(actual_delivery_date) AS last_delivery_date,
    avg(delivery_variance_days) AS avg_delivery_variance_days, avg(total_delivery_days) AS avg_total_delivery_days,
    CAST(count(*) FILTER (delivered_on_time) AS DOUBLE) / nullif(count(delivered_on_time), 0) AS on_time_delivery_rate,
    mode() WITHIN GROUP (ORDER BY carrier) AS primary_carrier, mode() WITHIN GROUP (ORDER BY shipping_method) AS primary_shipping_method, mode() WITHIN GROUP (ORDER BY delivery_speed_category) AS primary_delivery_speed
  FROM stg_shipments GROUP BY order_id),
combined0 AS (
  SELECT o.* EXCLUDE (currency), o.currency AS order_currency, coalesce(s.total_shipments, 0) AS total_shipments, coalesce(s.delivered_shipments, 0) AS delivered_shipments, coalesce(s.exception_shipments, 0) AS exception_shipments, coalesce(s.return_shipments, 0) AS return_shipments,
    s.* EXCLUDE (order_id, total_shipments, delivered_shipments, exception_shipments, return_shipments)
  FROM stg_orders o LEFT JOIN summary s ON o.order_id = s.order_id),
combined AS (
  SELECT *, date_part('day', first_shipment_date - order_date) AS days_to_first_shipment, date_part('day', CAST(last_delivery_date AS TIMESTAMP) - order_date) AS days_to_complete_delivery,
    CASE WHEN total_shipments = 0 THEN 'not_shipped' WHEN delivered_shipments = total_shipments THEN 'fully_delivered' WHEN delivered_shipments > 0 THEN 'partially_delivered' WHEN exception_shipments > 0 THEN 'delivery_issues' ELSE 'in_transit' END AS fulfillment_status,
    return_shipments > 0 AS has_returns, CASE WHEN total_shipping_cost > 0 AND total_amount > 0 THEN CAST(total_shipping_cost AS DOUBLE) / CAST(total_amount AS DOUBLE) ELSE 0 END AS shipping_cost_ratio FROM combined0),
dim0 AS (
  SELECT c.* EXCLUDE (phone_cleaned), c.phone_cleaned AS phone, coalesce(m.total_orders, 0) AS total_orders, coalesce(m.fulfilled_orders, 0) AS fulfilled_orders, coalesce(m.cancelled_orders, 0) AS cancelled_orders, coalesce(m.total_order_value, 0) AS total_order_value,
    coalesce(m.average_order_value, 0) AS average_order_value, m.first_order_date, m.last_order_date, coalesce(m.cancellation_rate, 0) AS cancellation_rate, coalesce(m.fulfillment_rate, 0) AS fulfillment_rate, m.days_since_last_order, m.customer_lifetime_days, coalesce(m.annual_order_value, 0) AS annual_order_value,
    coalesce(m.customer_frequency_segment, 'new') AS customer_frequency_segment, coalesce(m.customer_value_segment, 'new') AS customer_value_segment, coalesce(m.recency_segment, 'new') AS recency_segment, coalesce(m.loyalty_segment, 'new_or_risky') AS loyalty_segment
  FROM stg_customers c LEFT JOIN metrics m ON c.customer_id = m.customer_id WHERE c.passes_quality_checks),
dim AS (
  SELECT *, CASE WHEN total_orders = 0 THEN 'prospect' WHEN loyalty_segment = 'loyal' AND customer_value_segment = 'premium' THEN 'vip' WHEN loyalty_segment = 'loyal' AND customer_value_segment = 'standard' THEN 'champion'
      WHEN recency_segment = 'recent' AND customer_frequency_segment IN ('regular', 'frequent') THEN 'loyal_customer' WHEN recency_segment = 'recent' AND total_orders >= 2 THEN 'potential_loyalist' WHEN recency_segment = 'recent' AND total_orders = 1 THEN 'new_customer'
      WHEN recency_segment IN ('lapsing', 'dormant') AND customer_value_segment = 'premium' THEN 'at_risk' WHEN recency_segment IN ('lapsing', 'dormant') THEN 'need_attention' WHEN recency_segment = 'lost' THEN 'cannot_lose_them' ELSE 'other' END AS customer_segment,
    coalesce(days_since_last_login <= 30, false) AS is_active_user, coalesce(days_since_last_order <= 90, false) AS is_active_buyer, total_orders > 0 AS has_purchased, coalesce(marketing_consent AND has_valid_email, false) AS is_marketable FROM dim0),
fact0 AS (
  SELECT o.*, d.customer_segment, d.customer_frequency_segment, d.customer_value_segment, d.loyalty_segment, d.is_active_buyer, d.country AS customer_country,
    year(order_date) AS order_year, quarter(order_date) AS order_quarter, month(order_date) AS order_month, weekofyear(order_date) AS order_week, dayofweek(order_date) AS order_day_of_week,
    CASE WHEN order_status_group = 'fulfilled' THEN total_amount ELSE 0 END AS fulfilled_revenue, CASE WHEN order_status_group = 'cancelled' THEN total_amount ELSE 0 END AS cancelled_revenue, CASE WHEN has_returns THEN total_amount ELSE 0 END AS returned_revenue,
    coalesce(on_time_delivery_rate >= 1, false) AS delivered_on_time, CASE WHEN days_to_first_shipment <= 1 THEN 'same_day' WHEN days_to_first_shipment <= 3 THEN 'fast' WHEN days_to_first_shipment <= 7 THEN 'standard' ELSE 'slow' END AS fulfillment_speed,
    net_amount - coalesce(total_shipping_cost, 0) - coalesce(total_insurance_cost, 0) AS estimated_profit, exception_shipments = 0 AND return_shipments = 0 AS clean_order
  FROM combined o LEFT JOIN dim d ON o.customer_id = d.customer_id),
fact AS (
  SELECT *, row_number() OVER w AS customer_order_sequence, coalesce(date_part('day', order_date - lag(order_date) OVER w), 0) AS days_since_previous_order,
    sum(total_amount) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_customer_value, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_order_count
  FROM fact0 WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)),
daily0 AS (
  SELECT CAST(order_date AS DATE) AS date_day, count(*) AS total_orders, count(*) FILTER (order_status_group = 'fulfilled') AS fulfilled_orders, count(*) FILTER (order_status_group = 'cancelled') AS cancelled_orders, count(*) FILTER (has_returns) AS returned_orders, count(*) FILTER (clean_order) AS clean_orders,
    sum(total_amount) AS gross_revenue, sum(fulfilled_revenue) AS net_revenue, sum(cancelled_revenue) AS cancelled_revenue, sum(returned_revenue) AS returned_revenue,
    coalesce(sum(total_amount) FILTER (customer_segment = 'vip'), 0) AS vip_revenue, coalesce(sum(total_amount) FILTER (customer_segment = 'champion'), 0) AS champion_revenue, coalesce(sum(total_amount) FILTER (customer_segment = 'new_customer'), 0) AS new_customer_revenue
  FROM fact GROUP BY 1),
daily AS (
  SELECT *, CAST(gross_revenue AS DOUBLE) / total_orders AS average_order_value, fulfilled_orders / total_orders AS fulfillment_rate, cancelled_orders / total_orders AS cancellation_rate, returned_orders / total_orders AS return_rate,
    coalesce(CAST(net_revenue AS DOUBLE) / nullif(CAST(gross_revenue AS DOUBLE), 0), 0) AS revenue_realization_rate,
    CAST(sum(gross_revenue) OVER w AS DOUBLE) / count(gross_revenue) OVER w AS gross_revenue_7d_ma, avg(total_orders) OVER w AS total_orders_7d_ma, lag(gross_revenue, 365) OVER (ORDER BY date_day) AS gross_revenue_yoy
  FROM daily0 WINDOW w AS (ORDER BY date_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
segments AS (
  SELECT customer_segment, count(*) AS customer_count, sum(total_order_value) AS segment_revenue, CAST(sum(total_order_value) AS DOUBLE) / count(*) AS avg_customer_value, avg(average_order_value) AS avg_order_value, avg(total_orders) AS avg_orders_per_customer, avg(days_since_last_order) AS avg_days_since_last_order,
    count(*) FILTER (is_marketable) AS marketable_customers, count(*) FILTER (is_active_buyer) AS active_buyers, avg(date_part('day', {NOW} - registration_date)) AS avg_days_since_registration, mode() WITHIN GROUP (ORDER BY country) AS primary_country
  FROM dim GROUP BY 1),
segmentation0 AS (
  SELECT d.*, s.customer_count AS segment_size, s.segment_revenue, s.avg_customer_value AS segment_avg_value, s.marketable_customers AS segment_marketable_count,
    CASE WHEN CAST(d.total_order_value AS DOUBLE) > s.avg_customer_value THEN 'above_average' WHEN CAST(d.total_order_value AS DOUBLE) = s.avg_customer_value THEN 'average' ELSE 'below_average' END AS value_vs_segment,
    CASE WHEN NOT is_marketable THEN 'not_marketable' ELSE CASE d.customer_segment WHEN 'vip' THEN 'vip_exclusive_offers' WHEN 'champion' THEN 'loyalty_rewards' WHEN 'loyal_customer' THEN 'retention_campaigns' WHEN 'potential_loyalist' THEN 'conversion_campaigns' WHEN 'new_customer' THEN 'onboarding_sequence' WHEN 'at_risk' THEN 'win_back_campaigns' WHEN 'need_attention' THEN 'reactivation_campaigns' WHEN 'cannot_lose_them' THEN 'urgent_retention' ELSE 'no_action' END END AS marketing_recommendation,
    CASE WHEN d.customer_value_segment = 'premium' THEN 'personalized_high_touch' WHEN d.customer_frequency_segment = 'frequent' THEN 'regular_engagement' WHEN d.customer_segment = 'new_customer' THEN 'educational_content' ELSE 'standard_communication' END AS communication_strategy,
    CASE d.customer_segment WHEN 'vip' THEN CAST(total_order_value AS DOUBLE) * 2.5 WHEN 'champion' THEN CAST(total_order_value AS DOUBLE) * 2.0 WHEN 'loyal_customer' THEN CAST(total_order_value AS DOUBLE) * 1.8 WHEN 'potential_loyalist' THEN CAST(total_order_value AS DOUBLE) * 1.5 WHEN 'new_customer' THEN average_order_value * 3 ELSE CAST(total_order_value AS DOUBLE) * 1.1 END AS ltv
  FROM dim d LEFT JOIN segments s ON d.customer_segment = s.customer_segment),
segmentation AS (
  SELECT *, round(ltv, 4) AS predicted_lifetime_value, CASE marketing_recommendation WHEN 'urgent_retention' THEN 10 WHEN 'vip_exclusive_offers' THEN 9 WHEN 'win_back_campaigns' THEN 8 WHEN 'loyalty_rewards' THEN 7 WHEN 'conversion_campaigns' THEN 6 WHEN 'retention_campaigns' THEN 5 WHEN 'reactivation_campaigns' THEN 4 WHEN 'onboarding_sequence' THEN 3 ELSE 1 END AS marketing_priority FROM segmentation0)
"""

ORDER = "order_id customer_id order_date order_status total_amount:d currency payment_method discount_amount:d tax_amount:d shipping_cost:d order_value_tier order_status_group net_amount:d gross_amount:d"
CUSTOMER = "customer_id email first_name last_name phone_cleaned country registration_date last_login_date marketing_consent:b full_name has_valid_email:b customer_tenure days_since_last_login:l passes_quality_checks:b"
SHIPMENT = "shipment_id order_id carrier shipping_method shipment_status shipped_date estimated_delivery_date actual_delivery_date package_count:l shipping_cost:d insurance_cost:d is_return:b delivery_variance_days:l total_delivery_days:l delivered_on_time:b shipment_status_group delivery_performance delivery_speed_category"
METRICS = "customer_id total_orders:l fulfilled_orders:l cancelled_orders:l total_order_value:d total_net_value:d total_gross_value:d average_order_value:d highest_order_value:d lowest_order_value:d first_order_date last_order_date high_value_orders:l medium_value_orders:l low_value_orders:l cancellation_rate:d fulfillment_rate:d days_since_last_order:l customer_lifetime_days:l customer_frequency_segment customer_value_segment recency_segment annual_order_value:d loyalty_segment"
SUMMARY = "order_id total_shipments:l delivered_shipments:l exception_shipments:l return_shipments:l total_shipping_cost:d total_insurance_cost:d first_shipment_date last_shipment_date earliest_estimated_delivery latest_estimated_delivery first_delivery_date last_delivery_date avg_delivery_variance_days:d avg_total_delivery_days:d on_time_delivery_rate:d primary_carrier primary_shipping_method primary_delivery_speed"
COMBINED = "customer_id order_date order_status_group order_currency total_amount:d " + SUMMARY + " days_to_first_shipment:l days_to_complete_delivery:l fulfillment_status has_returns:b shipping_cost_ratio:d"
DIM = CUSTOMER.replace("phone_cleaned", "phone").replace(" passes_quality_checks:b", "") + " total_orders:l fulfilled_orders:l cancelled_orders:l total_order_value:d average_order_value:d first_order_date last_order_date cancellation_rate:d fulfillment_rate:d days_since_last_order:l customer_lifetime_days:l annual_order_value:d customer_frequency_segment customer_value_segment recency_segment loyalty_segment customer_segment is_active_user:b is_active_buyer:b has_purchased:b is_marketable:b"
FACT = "order_id customer_id order_date order_year:l order_quarter:l order_month:l order_week:l order_day_of_week:l order_status order_status_group order_value_tier payment_method order_currency customer_segment customer_frequency_segment customer_value_segment loyalty_segment is_active_buyer:b customer_country total_amount:d net_amount:d gross_amount:d total_shipping_cost:d total_insurance_cost:d shipping_cost_ratio:d total_shipments:l delivered_shipments:l exception_shipments:l return_shipments:l fulfillment_status has_returns:b primary_carrier primary_shipping_method primary_delivery_speed first_shipment_date last_shipment_date first_delivery_date last_delivery_date days_to_first_shipment:l days_to_complete_delivery:l avg_delivery_variance_days:d avg_total_delivery_days:d on_time_delivery_rate:d fulfilled_revenue:d cancelled_revenue:d returned_revenue:d delivered_on_time:b fulfillment_speed estimated_profit:d clean_order:b customer_order_sequence:l days_since_previous_order:l cumulative_customer_value:d cumulative_order_count:l"
DAILY = "date_day total_orders:l fulfilled_orders:l cancelled_orders:l returned_orders:l clean_orders:l gross_revenue:d net_revenue:d cancelled_revenue:d returned_revenue:d average_order_value:d vip_revenue:d champion_revenue:d new_customer_revenue:d fulfillment_rate:d cancellation_rate:d return_rate:d revenue_realization_rate:d gross_revenue_7d_ma:d total_orders_7d_ma:d gross_revenue_yoy:d"
SEGMENTS = "customer_segment customer_count:l segment_revenue:d avg_customer_value:d avg_order_value:d avg_orders_per_customer:d avg_days_since_last_order:d marketable_customers:l active_buyers:l avg_days_since_registration:d primary_country"
SEGMENTATION = "customer_id customer_segment total_order_value:d segment_size:l segment_revenue:d segment_avg_value:d segment_marketable_count:l value_vs_segment marketing_recommendation communication_strategy marketing_priority:l predicted_lifetime_value:d"

#: query: (frame of the warehouse, table of the oracle, columns)
PLAIN = {
    "stg_orders": ("stg_orders", "stg_orders", ORDER),
    "stg_customers": ("stg_customers", "stg_customers", CUSTOMER),
    "stg_shipments": ("stg_shipments", "stg_shipments", SHIPMENT),
    "customer_order_metrics": ("metrics", "metrics", METRICS),
    "order_shipment_summary": ("summary", "summary", SUMMARY),
    "order_shipment_combined": ("combined", "combined", COMBINED),
    "dim_customers": ("dim", "dim", DIM),
    "fact_orders": ("fact", "fact", FACT),
    "revenue_daily": ("daily", "daily", DAILY),
    "segment_analysis": ("segments", "segments", SEGMENTS),
    "customer_segmentation": ("segmentation", "segmentation", SEGMENTATION),
    "customer_segment_rule": ("dim", "dim", "customer_id total_orders:l loyalty_segment customer_value_segment recency_segment customer_segment"),
    "customer_activity_flags": ("dim", "dim", "customer_id is_active_user:b is_active_buyer:b has_purchased:b is_marketable:b"),
    "marketing_actions": ("segmentation", "segmentation", "customer_id marketing_recommendation communication_strategy marketing_priority:l predicted_lifetime_value:d"),
    "fulfillment_status": ("combined", "combined", "order_id fulfillment_status has_returns:b shipping_cost_ratio:d days_to_first_shipment:l days_to_complete_delivery:l"),
    "order_business_metrics": ("fact", "fact", "order_id fulfilled_revenue:d cancelled_revenue:d returned_revenue:d delivered_on_time:b fulfillment_speed estimated_profit:d clean_order:b"),
    "calendar_parts": ("fact", "fact", "order_id order_year:l order_quarter:l order_month:l order_week:l order_day_of_week:l"),
    "customer_order_sequence": ("fact", "fact", "order_id customer_id customer_order_sequence:l"),
    "days_since_previous_order": ("fact", "fact", "order_id days_since_previous_order:l"),
    "cumulative_customer_value": ("fact", "fact", "order_id cumulative_customer_value:d"),
    "cumulative_order_count": ("fact", "fact", "order_id cumulative_order_count:l"),
    "revenue_7row_average": ("daily", "daily", "date_day gross_revenue_7d_ma:d total_orders_7d_ma:d"),
    "revenue_lag_365": ("daily", "daily", "date_day gross_revenue:d gross_revenue_yoy:d"),
    "conditional_counts": ("daily", "daily", "date_day fulfilled_orders:l cancelled_orders:l returned_orders:l clean_orders:l vip_revenue:d"),
    "mode_within_group": ("summary", "summary", "order_id primary_carrier primary_shipping_method primary_delivery_speed"),
    "safe_ratio": ("daily", "daily", "date_day fulfillment_rate:d cancellation_rate:d return_rate:d revenue_realization_rate:d"),
}


def _monthly(w: Warehouse) -> DataFrame:
    days = dim_date(order_days(w))
    return w.fact.withColumn("date_key", F.date_format("order_date", "yyyyMMdd").cast("long")).join(F.broadcast(days), "date_key").groupBy("year", "month", "month_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("revenue")).orderBy("year", "month")  # a row for each day


def order_days(w: Warehouse) -> DataFrame:
    """The whole years in which orders were placed, as one row (first, last)."""
    day = F.to_date("order_date")
    return w.raw_orders.agg(F.trunc(F.min(day), "year").alias("first"), F.date_sub(F.add_months(F.trunc(F.max(day), "year"), 12), 1).alias("last"))


def dim_date(span: DataFrame) -> DataFrame:
    """A row for each day from first to last: key, parts, names, weekend."""
    days = span.select(F.explode(F.sequence("first", "last")).alias("date"))
    dow = F.dayofweek("date")
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("long").alias("date_key"), "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"), F.date_format("date", "MMMM").alias("month_name"),
        F.weekofyear("date").alias("week"), F.dayofyear("date").alias("day_of_year"), F.dayofmonth("date").alias("day"), (dow - 1).alias("day_of_week"), F.date_format("date", "EEEE").alias("day_name"), dow.isin(1, 7).alias("is_weekend"), F.lit(False).alias("is_holiday"),
    )


def _per_file(w: Warehouse) -> DataFrame:
    """Shipments stored with files of their own for each carrier, counted by file."""
    to = scratch(w.spark, "by-carrier")
    w.raw_shipments.write.partitionBy("carrier").parquet(to)  # as they are spread over tasks: a carrier may be most of the table
    name = F.regexp_extract(F.col("_metadata.file_path"), "carrier=([^/]+)/", 1)
    return w.spark.read.parquet(to).groupBy(name.alias("source_file")).count()


def _by_category(w: Warehouse) -> DataFrame:
    """Orders, revenue and margin of each category: sums of an order's items first, where its rows are."""
    n = w.order_items.count()  # by the files' footers
    products = w.dim_products.where("is_current").select("product_key", "category", R.product_margin("unit_price", "unit_cost").alias("margin"))
    items = spread(w.order_items.select("order_id", "product_key", "line_amount"), n, "product_key").join(products, "product_key").drop("product_key")
    items = spread(items, n, "order_id").groupBy("order_id", "category").agg(F.sum("line_amount").alias("revenue"), F.sum("margin").alias("margin"), F.count("margin").alias("margins"))
    orders = w.fact.groupBy("order_id").agg(F.count(F.lit(1)).alias("times"))
    by_order = items.join(orders, "order_id").withColumns({c: F.col(c) * F.col("times") for c in ("revenue", "margin", "margins")})
    return by_order.groupBy("category").agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"), F.try_divide(F.sum("margin"), F.sum("margins")).alias("margin"))


def _materialized(w: Warehouse) -> DataFrame:
    """A staging model as a view and a mart as a table, both read by name."""
    view, mart = (f"{n}_{uuid.uuid4().hex}" for n in ("stg_orders", "dim_customers"))
    materialize(w.stg_orders, view, "staging")
    materialize(w.dim, mart, "marts", path=scratch(w.spark, "marts"))
    return w.spark.table(mart).join(w.spark.table(view), "customer_id").groupBy("customer_id", "customer_segment").agg(F.count("order_id").alias("orders"))


DATE_SQL = """SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, d AS date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, monthname(d) AS month_name, weekofyear(d) AS week, dayofyear(d) AS day_of_year, day(d) AS day, dayofweek(d) AS day_of_week, dayname(d) AS day_name, dayofweek(d) IN (0, 6) AS is_weekend, false AS is_holiday FROM (SELECT CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT date_trunc('year', min(order_date)) AS low, date_trunc('year', max(order_date)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS high FROM raw_orders))"""
STATUSES = ["pending", "processing", "shipped", "delivered", "cancelled", "refunded"]

#: query: (function of the warehouse, columns, sql after the models)
OTHER = {
    "valid_row_filter": (lambda w: M.valid_rows(w.raw_orders), "order_id total_amount:d", "SELECT * FROM raw_orders WHERE is_valid"),
    "non_null_key_filter": (lambda w: M.with_key(w.stg_orders, "customer_id"), "order_id customer_id", "SELECT * FROM stg_orders WHERE customer_id IS NOT NULL"),
    "run_date_updates": (lambda w: w.stg_customers.where(F.to_date("last_login_date") >= F.date_sub(F.to_date(w.now), 1)), "customer_id last_login_date", f"SELECT * FROM stg_customers WHERE CAST(last_login_date AS DATE) >= CAST({NOW} AS DATE) - 1"),
    "run_date_filter": (lambda w: w.stg_orders.where(F.to_date("order_date") == F.date_sub(F.to_date(w.now), 1)), "order_id order_date total_amount:d", f"SELECT * FROM stg_orders WHERE CAST(order_date AS DATE) = CAST({NOW} AS DATE) - 1"),
    "monthly_order_trend": (_monthly, "year:l month:l month_name orders:l revenue:d", f"SELECT year, month, month_name, count(*) AS orders, sum(total_amount) AS revenue FROM fact JOIN ({DATE_SQL}) ON date_key = CAST(strftime(order_date, '%Y%m%d') AS BIGINT) GROUP BY 1, 2, 3"),
    "category_performance": (
        _by_category,
        "category orders:l revenue:d margin:d",
        "SELECT category, count(DISTINCT order_id) AS orders, sum(line_amount) AS revenue, avg(CASE WHEN unit_price > 0 THEN round((CAST(unit_price AS DOUBLE) - CAST(unit_cost AS DOUBLE)) / CAST(unit_price AS DOUBLE) * 100, 4) END) AS margin FROM fact JOIN order_items USING (order_id) JOIN dim_products USING (product_key) WHERE is_current GROUP BY 1",
    ),
    "orders_per_current_customer": (
        lambda w: w.dim.select("customer_id", R.customer_tier("total_order_value").alias("tier")).join(w.fact.select("customer_id", "order_id"), "customer_id", "left").groupBy("customer_id", "tier").agg(F.count("order_id").alias("orders")),
        "customer_id tier orders:l",
        "SELECT customer_id, CASE WHEN total_order_value = 0 THEN 'New' WHEN total_order_value >= 10000 THEN 'Platinum' WHEN total_order_value >= 5000 THEN 'Gold' WHEN total_order_value >= 1000 THEN 'Silver' ELSE 'Bronze' END AS tier, count(order_id) AS orders FROM dim LEFT JOIN fact USING (customer_id) GROUP BY 1, 2",
    ),
    "count_distinct": (lambda w: w.fact.groupBy("customer_country").agg(F.countDistinct("customer_id").alias("customers")), "customer_country customers:l", "SELECT customer_country, count(DISTINCT customer_id) AS customers FROM fact GROUP BY 1"),
    "clv_by_tier": (
        lambda w: w.dim.groupBy(R.customer_tier("total_order_value").alias("tier")).agg(F.count(F.lit(1)).alias("customers"), F.avg(F.col("total_order_value").cast("double")).alias("avg_clv")),
        "tier customers:l avg_clv:d",
        "SELECT CASE WHEN total_order_value = 0 THEN 'New' WHEN total_order_value >= 10000 THEN 'Platinum' WHEN total_order_value >= 5000 THEN 'Gold' WHEN total_order_value >= 1000 THEN 'Silver' ELSE 'Bronze' END AS tier, count(*) AS customers, avg(CAST(total_order_value AS DOUBLE)) AS avg_clv FROM dim GROUP BY 1",
    ),
    "records_per_source_file": (_per_file, "source_file count:l", "SELECT carrier AS source_file, count(*) AS count FROM raw_shipments GROUP BY 1"),
    "materialize_model": (_materialized, "customer_id customer_segment orders:l", "SELECT customer_id, customer_segment, count(order_id) AS orders FROM dim JOIN stg_orders USING (customer_id) GROUP BY 1, 2"),
    "pivot_order_status": (
        lambda w: R.pivot_counts(w.stg_orders, "customer_id", "order_status", STATUSES),
        "customer_id " + " ".join(f"{s}_count:l" for s in STATUSES),
        "SELECT customer_id, " + ", ".join(f"count(*) FILTER (order_status = '{s}') AS {s}_count" for s in STATUSES) + " FROM stg_orders GROUP BY 1",
    ),
    "dim_date": (lambda w: dim_date(order_days(w)), "date_key:l date year:l quarter:l month:l month_name week:l day_of_year:l day:l day_of_week:l day_name is_weekend:b is_holiday:b", DATE_SQL),
    "ordered_output": (lambda w: w.daily.orderBy("date_day"), "date_day total_orders:l", "SELECT * FROM daily"),
    "business_metric_checks": (
        lambda w: w.fact.agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("double").alias("v")).select(F.expr("stack(2, 'daily_orders', cast(n as double), n between 100 and 50000, 'daily_revenue', v, v between 1000 and 10000000) as (check_name, observed, passed)")),
        "check_name observed:d passed:b",
        "SELECT 'daily_orders' AS check_name, CAST(count(*) AS DOUBLE) AS observed, count(*) BETWEEN 100 AND 50000 AS passed FROM fact UNION ALL SELECT 'daily_revenue', CAST(sum(total_amount) AS DOUBLE), sum(total_amount) BETWEEN 1000 AND 10000000 FROM fact",
    ),
}


def queries():
    out = {name: (lambda s, d, f=frame, spec=spec: result(getattr(Warehouse(s, d), f), spec)) for name, (frame, _, spec) in PLAIN.items()}
    return out | {name: (lambda s, d, f=f, spec=spec: result(f(Warehouse(s, d)), spec)) for name, (f, spec, _) in OTHER.items()}


def oracle_sql():
    out = {name: f"WITH {MODELS_SQL} {result_sql(table, spec)}" for name, (_, table, spec) in PLAIN.items()}
    return out | {name: f"WITH {MODELS_SQL}, answer AS ({sql}) {result_sql('answer', spec)}" for name, (_, spec, sql) in OTHER.items()}
