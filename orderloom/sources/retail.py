"""The raw retail tables, derived from the star-schema tables that are given.

All amounts are exact decimals; ``AS_OF`` stands for the current time of the models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import spread

AS_OF = "2001-08-02 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(cents: Column) -> Column:
    return (cents.cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")


def plus_days(day: Column, n: Column) -> Column:
    return day + F.make_dt_interval(n.cast("int"))


def key(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = o.withColumn("amt", F.when(c % 5 == 0, F.expr("cents div 2000")).when((c % 5).isin(1, 2), F.expr("cents div 500")).otherwise(F.expr("cents div 100")))
    status = F.when(k % 40 == 7, " Delivered ").when(k % 9 == 0, "pending").when(k % 9 == 1, "processing").when(k % 9 == 2, "shipped").when(k % 9 == 7, "cancelled").when(k % 9 == 8, "refunded").otherwise("delivered")
    return o.select(
        key("ORD-", k, 9).alias("order_id"),
        F.when(k % 97 != 0, key("CUST-", c, 7)).alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        status.alias("order_status"),
        money(F.col("amt")).alias("total_amount"),
        F.when(k % 11 != 0, money(F.expr("amt div 10"))).alias("discount_amount"),
        money(F.expr("amt * 8 div 100")).alias("tax_amount"),
        F.when(k % 13 != 0, (k % 25).cast("decimal(10,2)")).alias("shipping_cost"),
        F.when(c % 7 < 3, "usd ").when(c % 7 == 3, "EUR").otherwise("GBP").alias("currency"),
        F.when(k % 3 == 0, " Card").when(k % 3 == 1, "paypal").otherwise("transfer").alias("payment_method"),
        F.when(k % 2 == 0, "web").otherwise("store").alias("source_system"),
        (~((k % 50 == 0) | (c % 37 == 0))).alias("is_valid"),
    )


def raw_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    lines = spread(lines, lines.count(), "l_orderkey")  # counted by the files' footers
    one = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy(*one).orderBy("l_extendedprice", "l_quantity", "l_shipdate"))).where("nth = 1")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").where("o_orderkey % 9 between 2 and 6")
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    k, p, day = F.col("o_orderkey"), F.col("l_partkey"), F.col("o_orderdate")
    returned = (F.col("l_returnflag") == "R") & (p % 3 == 0)
    arrived = k % 9 >= 3
    return j.select(
        F.concat_ws("-", F.lit("SHP"), *one).alias("shipment_id"),
        key("ORD-", k, 9).alias("order_id"),
        F.element_at(F.array(*map(F.lit, ("ups", "fedex", "dhl", "usps"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("carrier"),
        F.when(p % 2 == 0, "express").otherwise("ground").alias("shipping_method"),
        F.when(returned, "returned").when(arrived, "delivered").when(p % 10 == 9, "pending").otherwise("in_transit").alias("shipment_status"),
        plus_days(day, p % 3 + 1).alias("shipped_date"),
        plus_days(day, p % 2 + 4).alias("estimated_delivery_date"),
        F.when(arrived, plus_days(day, p % 6 + 3)).alias("actual_delivery_date"),
        (p % 20).cast("decimal(10,2)").alias("shipping_cost"),
        F.when(p % 4 != 0, (p % 5).cast("decimal(10,2)")).alias("insurance_cost"),
        F.when(p % 7 != 0, F.col("l_linenumber").cast("int")).alias("package_count"),
        F.when(p % 5 != 0, returned).alias("is_return"),
        (k % 61 != 0).alias("is_valid"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    k, r = F.col("c_custkey"), F.col("n_regionkey")
    plain = F.concat(F.lit("Customer"), k.cast("string"), F.lit("@Example.com"))
    return j.select(
        key("CUST-", k, 7).alias("customer_id"),
        F.when(k % 29 == 0, "not-an-email").when(k % 31 == 0, F.lit(None)).when(k % 17 == 0, F.concat(F.lit(" "), plain, F.lit(" "))).otherwise(plain).alias("email"),
        F.concat(F.lit(" ada"), (k % 10).cast("string")).alias("first_name"),
        F.when(k % 23 != 0, F.lit("LOVELACE ")).alias("last_name"),
        F.concat(F.lit("+1 (555) "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-0100")).alias("phone"),
        F.when(r == 1, "us").when(r == 3, "DE").when(k % 41 == 0, F.lit(None)).otherwise("JP").alias("country"),
        plus_days(as_of(), -(k * 17 % 730)).alias("registration_date"),
        plus_days(as_of(), -(k * 7 % 60)).alias("last_login"),
        F.when(k % 9 != 0, k % 5 < 3).alias("marketing_consent"),
        F.when(k % 12 != 0, F.date_add(F.lit("1940-01-15").cast("date"), (k * 31 % 25000).cast("int"))).alias("date_of_birth"),
        (k % 53 != 0).alias("is_valid"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(key("ORD-", F.col("l_orderkey"), 9).alias("order_id"), F.col("l_partkey").alias("product_key"), F.col("l_quantity").cast("long").alias("quantity"), money(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("line_amount"))


def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_key"), "p_brand", F.col("p_type").alias("category"), money(cents).alias("unit_price"), money(F.floor(cents * 7 / 10).cast("long")).alias("unit_cost"), (F.col("p_partkey") % 10 != 0).alias("is_current"))


#: The same tables for the oracle, as common table expressions.
RAW_SQL = """
o1 AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
o2 AS (SELECT *, CASE WHEN o_custkey % 5 = 0 THEN cents // 2000 WHEN o_custkey % 5 IN (1, 2) THEN cents // 500 ELSE cents // 100 END AS amt FROM o1),
raw_orders AS (
  SELECT 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_id,
    CASE WHEN o_orderkey % 97 <> 0 THEN 'CUST-' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS customer_id, o_orderdate AS order_date,
    CASE WHEN o_orderkey % 40 = 7 THEN ' Delivered ' ELSE CASE o_orderkey % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'shipped' WHEN 7 THEN 'cancelled' WHEN 8 THEN 'refunded' ELSE 'delivered' END END AS order_status,
    CAST(amt AS DECIMAL(14,0)) * 0.01 AS total_amount,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(amt // 10 AS DECIMAL(14,0)) * 0.01 END AS discount_amount,
    CAST(amt * 8 // 100 AS DECIMAL(14,0)) * 0.01 AS tax_amount,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 25 AS DECIMAL(10,2)) END AS shipping_cost,
    CASE WHEN o_custkey % 7 < 3 THEN 'usd ' WHEN o_custkey % 7 = 3 THEN 'EUR' ELSE 'GBP' END AS currency,
    CASE o_orderkey % 3 WHEN 0 THEN ' Card' WHEN 1 THEN 'paypal' ELSE 'transfer' END AS payment_method,
    CASE WHEN o_orderkey % 2 = 0 THEN 'web' ELSE 'store' END AS source_system,
    NOT (o_orderkey % 50 = 0 OR o_custkey % 37 = 0) AS is_valid
  FROM o2),
s1 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice, l_quantity, l_shipdate) AS nth FROM lineitem),
raw_shipments AS (
  SELECT concat_ws('-', 'SHP', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS shipment_id, 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_id,
    CASE l_suppkey % 4 WHEN 0 THEN 'ups' WHEN 1 THEN 'fedex' WHEN 2 THEN 'dhl' ELSE 'usps' END AS carrier,
    CASE WHEN l_partkey % 2 = 0 THEN 'express' ELSE 'ground' END AS shipping_method,
    CASE WHEN l_returnflag = 'R' AND l_partkey % 3 = 0 THEN 'returned' WHEN o_orderkey % 9 >= 3 THEN 'delivered' WHEN l_partkey % 10 = 9 THEN 'pending' ELSE 'in_transit' END AS shipment_status,
    o_orderdate + CAST(l_partkey % 3 + 1 AS INTEGER) * INTERVAL 1 DAY AS shipped_date,
    o_orderdate + CAST(l_partkey % 2 + 4 AS INTEGER) * INTERVAL 1 DAY AS estimated_delivery_date,
    CASE WHEN o_orderkey % 9 >= 3 THEN o_orderdate + CAST(l_partkey % 6 + 3 AS INTEGER) * INTERVAL 1 DAY END AS actual_delivery_date,
    CAST(l_partkey % 20 AS DECIMAL(10,2)) AS shipping_cost,
    CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey % 5 AS DECIMAL(10,2)) END AS insurance_cost,
    CASE WHEN l_partkey % 7 <> 0 THEN l_linenumber END AS package_count,
    CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag = 'R' AND l_partkey % 3 = 0 END AS is_return,
    o_orderkey % 61 <> 0 AS is_valid
  FROM s1 JOIN orders ON l_orderkey = o_orderkey WHERE nth = 1 AND o_orderkey % 9 BETWEEN 2 AND 6),
raw_customers AS (
  SELECT 'CUST-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS customer_id,
    CASE WHEN c_custkey % 29 = 0 THEN 'not-an-email' WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN ' Customer' || c_custkey || '@Example.com ' ELSE 'Customer' || c_custkey || '@Example.com' END AS email,
    ' ada' || (c_custkey % 10) AS first_name, CASE WHEN c_custkey % 23 <> 0 THEN 'LOVELACE ' END AS last_name,
    '+1 (555) ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-0100' AS phone,
    CASE WHEN n_regionkey = 1 THEN 'us' WHEN n_regionkey = 3 THEN 'DE' WHEN c_custkey % 41 = 0 THEN NULL ELSE 'JP' END AS country,
    TIMESTAMP '2001-08-02' - CAST(c_custkey * 17 % 730 AS INTEGER) * INTERVAL 1 DAY AS registration_date,
    TIMESTAMP '2001-08-02' - CAST(c_custkey * 7 % 60 AS INTEGER) * INTERVAL 1 DAY AS last_login,
    CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 5 < 3 END AS marketing_consent,
    CASE WHEN c_custkey % 12 <> 0 THEN DATE '1940-01-15' + CAST(c_custkey * 31 % 25000 AS INTEGER) END AS date_of_birth,
    c_custkey % 53 <> 0 AS is_valid
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
order_items AS (SELECT 'ORD-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS order_id, l_partkey AS product_key, CAST(l_quantity AS BIGINT) AS quantity, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DECIMAL(14,0)) * 0.01 AS line_amount FROM lineitem),
dim_products AS (SELECT p_partkey AS product_key, p_brand, p_type AS category, CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS DECIMAL(14,0)) * 0.01 AS unit_price, CAST(CAST(round(p_retailprice * 100) AS BIGINT) * 7 // 10 AS DECIMAL(14,0)) * 0.01 AS unit_cost, p_partkey % 10 <> 0 AS is_current FROM part)
"""
