"""Constraints of the warehouse's tables as row validators: a predicate in SQL for each name; null passes."""

from __future__ import annotations

import re

# fixed values: names, columns and limits of the constraints
CODE3, CODE2, EMAIL = "^[A-Z]{3}$", "^[A-Z]{2}$", "(?i)^[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}$"
CONSTRAINTS: dict[str, dict[str, str]] = {
    "raw_orders": {
        "chk_raw_orders_amount_positive": "total_amount >= 0",
        "chk_raw_orders_currency_format": f"regexp_like(currency, '{CODE3}')",
    },
    "raw_customers": {
        "chk_raw_customers_email_format": f"regexp_like(email, '{EMAIL}')",
        "chk_raw_customers_country_format": f"regexp_like(country, '{CODE2}')",
    },
    "raw_shipments": {
        "chk_raw_shipments_package_count_positive": "package_count > 0",
        "chk_raw_shipments_weight_positive": "total_weight >= 0",
        "chk_raw_shipments_cost_positive": "shipping_cost >= 0 AND insurance_cost >= 0",
        "chk_raw_shipments_currency_format": f"regexp_like(currency, '{CODE3}')",
        "chk_raw_shipments_delivery_logic": "shipment_status <> 'delivered' OR actual_delivery_date IS NOT NULL",
    },
    "staging_orders": {
        "chk_staging_orders_amount_positive": "total_amount >= 0",
        "chk_staging_orders_currency_valid": f"regexp_like(currency, '{CODE3}')",
        "chk_staging_orders_quality_score": "data_quality_score BETWEEN 0 AND 1",
        "chk_staging_orders_operation_type": "operation_type IN ('INSERT', 'UPDATE', 'DELETE')",
        "chk_staging_orders_effective_dates": "effective_from <= effective_to",
        "chk_staging_orders_country_format": f"regexp_like(shipping_country, '{CODE2}') AND regexp_like(billing_country, '{CODE2}')",
    },
    "staging_order_items": {
        "chk_staging_order_items_quantity_positive": "quantity > 0",
        "chk_staging_order_items_prices_positive": "unit_price >= 0 AND total_price >= 0",
    },
    "staging_customers": {
        "chk_staging_customers_email_valid": f"regexp_like(email, '{EMAIL}')",
        "chk_staging_customers_country_valid": f"regexp_like(country, '{CODE2}')",
    },
    "staging_products": {
        "chk_staging_products_price_positive": "price >= 0",
        "chk_staging_products_cost_positive": "cost >= 0",
        "chk_staging_products_weight_positive": "weight >= 0",
    },
    "staging_shipments": {
        "chk_staging_shipments_cost_positive": "shipping_cost >= 0",
        "chk_staging_shipments_currency_valid": f"regexp_like(currency, '{CODE3}')",
    },
    "dim_customers": {
        "chk_dim_customers_email_valid": f"regexp_like(email, '{EMAIL}')",
        "chk_dim_customers_country_valid": f"regexp_like(country, '{CODE2}')",
        "chk_dim_customers_dates_logical": "effective_date <= end_date AND first_order_date >= registration_date AND last_order_date >= first_order_date",
        "chk_dim_customers_metrics_positive": "total_orders >= 0 AND total_order_value >= 0 AND average_order_value >= 0 AND customer_lifetime_value >= 0",
    },
    "dim_products": {
        "chk_dim_products_prices_positive": "current_price >= 0 AND original_price >= 0 AND cost >= 0",
        "chk_dim_products_dimensions_positive": "weight >= 0 AND length >= 0 AND width >= 0 AND height >= 0",
        "chk_dim_products_dates_logical": "effective_date <= end_date AND launch_date >= created_date AND discontinued_date >= launch_date",
        "chk_dim_products_rating_valid": "average_rating BETWEEN 0 AND 5",
        "chk_dim_products_quantities_valid": "min_quantity >= 0 AND max_quantity >= min_quantity",
    },
    "fact_orders": {
        "chk_fact_orders_amounts_valid": "gross_amount >= 0 AND discount_amount >= 0 AND tax_amount >= 0 AND shipping_cost >= 0 AND total_amount >= 0",
        "chk_fact_orders_counts_positive": "item_count > 0 AND unique_products_count > 0 AND total_quantity > 0",
        "chk_fact_orders_currency_valid": f"regexp_like(currency, '{CODE3}')",
        "chk_fact_orders_data_quality": "data_quality_score BETWEEN 0 AND 1",
    },
}

_WORDS = {"AND", "OR", "IN", "IS", "NOT", "NULL", "BETWEEN", "regexp_like"}


def columns_of(predicate: str) -> set[str]:
    """The columns that a predicate reads."""
    return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", re.sub(r"'[^']*'", "", predicate))) - _WORDS


def checkable(table: str, columns: list[str]) -> dict[str, str]:
    """The constraints of ``table`` whose columns are all there."""
    return {name: sql for name, sql in CONSTRAINTS[table].items() if columns_of(sql) <= set(columns)}
