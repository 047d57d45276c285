"""Business rules on hand-computed cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from orderloom.functions import rules as R
from orderloom.operators import incremental as I
from orderloom.operators import models as M
from orderloom.operators import quality as Q
from orderloom.sources import api_orders


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text, want", [("O'brien mc-donald", "O'Brien Mc-Donald"), ("ada", "Ada"), ("", "")])
def test_title_case(spark, text, want):
    assert value(spark, R.title_case(F.lit(text))) == want


def test_tiers_and_regions(spark):
    assert value(spark, R.customer_tier(F.lit(7500))) == "Gold"
    assert value(spark, R.customer_tier(F.lit(None).cast("double"))) == "New"
    assert value(spark, R.region_from_country(F.lit("us"))) == "North America"
    assert value(spark, R.region_from_country(F.lit(None).cast("string"))) == "Other"
    assert value(spark, R.is_valid_email(F.lit("test@example.com")))
    assert value(spark, R.clean_phone(F.lit("(555) 123-4567"))) == "5551234567"
    assert value(spark, R.quality_score(F.lit(10), F.lit(2), F.lit(1), F.lit(0))) == 0.89
    assert value(spark, R.safe_divide(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, R.rfm_score(F.lit(10), F.lit(7), F.lit(1500))) == "545"


def test_age_group_turns_on_the_birthday(spark):
    born = F.lit("1983-08-02").cast("date")
    assert value(spark, R.age_group(born, F.lit("2001-08-01").cast("date"))) == "Under 18"
    assert value(spark, R.age_group(born, F.lit("2001-08-02").cast("date"))) == "18-24"


def test_delivery_performance(spark):
    day = lambda x: F.lit(x).cast("date")
    got = [value(spark, R.delivery_performance(day(a), day("2024-01-05"))) for a in (None, "2024-01-05", "2024-01-06", "2024-01-07")]
    assert got == ["not_delivered", "on_time", "slightly_late", "significantly_late"]


def test_date_formats(spark):
    formats = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd"]
    assert value(spark, R.parse_datetime(F.lit("2024-01-15T10:30:00Z"), formats)) == datetime.datetime(2024, 1, 15, 10, 30)
    assert value(spark, R.parse_datetime(F.lit("invalid-date"), formats)) is None


def test_segment_rule_order(spark):
    row = {"total_orders": 12, "loyalty_segment": "loyal", "customer_value_segment": "premium", "recency_segment": "recent", "customer_frequency_segment": "regular"}
    assert spark.createDataFrame([row]).select(M.customer_segment_rule().alias("s")).first().s == "vip"
    assert spark.createDataFrame([row | {"total_orders": 0}]).select(M.customer_segment_rule().alias("s")).first().s == "prospect"


def test_api_record_with_four_errors(spark):
    lines = spark.createDataFrame([('{"total": "invalid_amount", "currency": "INVALID", "email": "invalid_email"}',), ('{"id": "A1", "total": 99.99}',), ("{broken",)], "value string")
    rows = {r.order_id: r for r in api_orders.with_errors(api_orders.raw_orders(lines, "api", "b")).collect()}
    assert len(rows["A1"].errors) == 0 and rows["A1"].total_amount == "99.99" and len(rows["A1"].record_hash) == 64
    assert max(len(r.errors) for r in rows.values()) >= 1


def test_versions_close_the_earlier_one(spark):
    rows = [("T1", 150.0, "2024-01-01 00:00:00", 1, "INSERT"), ("T1", 175.0, "2024-01-02 00:00:00", 2, "UPDATE"), ("T2", 1.0, "2024-01-01 00:00:00", 3, "INSERT"), ("T2", 1.0, "2024-01-03 00:00:00", 4, "DELETE")]
    df = spark.createDataFrame(rows, "id string, amount double, at string, n int, operation_type string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {(r.id, r.record_version): r for r in I.versions(df, ["id"], "at", "n").collect()}
    assert not got["T1", 1].is_current and got["T1", 1].effective_to == got["T1", 2].effective_from and got["T1", 2].is_current
    assert not got["T2", 2].is_current


def test_upsert_twice_is_upsert_once(spark):
    target = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "k int, v int, at int")
    batch = spark.createDataFrame([(2, 21, 2), (2, 22, 3), (3, 30, 2)], "k int, v int, at int")
    once = I.upsert(target, batch, ["k"], ["at"])
    twice = I.upsert(once, batch, ["k"], ["at"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, 10, 1), (2, 22, 3), (3, 30, 2)]
    assert tuple(I.upsert_counts(target, batch, ["k"]).first()) == (1, 1)


def test_extract_keeps_ties_at_the_cut(spark):
    df = spark.createDataFrame([(i, f"2024-01-0{d} 00:00:00") for i, d in enumerate([1, 2, 2, 2, 3])], "i int, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert sorted(r.i for r in I.extract(df, "at", most=2).collect()) == [0, 1, 2, 3]


def test_consistency(spark):
    out = Q.consistency(spark.range(3).toDF("id"), spark.range(2).toDF("id"), ["id"]).first()
    assert (out.source_count, out.target_count, out.missing_in_target, out.passed) == (3, 2, 1, False)


def test_nulls_pass_value_checks(spark):
    df = spark.createDataFrame([(None,), (5,)], "v int")
    out = {r.check_name: r for r in Q.run_suite(df, "s", "t", [Q.between("v", 0, 9), Q.not_null("v")]).collect()}
    assert out["between"].success and not out["not_null"].success


def test_ingestion_counts_skipped_and_failed_rows(spark):
    totals = [("a", "5"), ("a", "5"), ("b", "-1"), ("b", "-1"), ("c", "-2"), ("d", "x"), ("", "1"), ("e", "-3"), ("e", "3"), (None, "4")]
    lines = spark.createDataFrame([(json.dumps({"id": i, "total": t}),) for i, t in totals], "value string")
    checked = api_orders.with_errors(api_orders.raw_orders(lines, "api", "b"))
    stored = spark.createDataFrame([("c",), ("c",)], "order_id string")
    got = api_orders.ingestion_stats(checked, stored).first()
    # a and e are inserted, b twice and e once break the constraint, c is stored, d and the two without id are invalid
    assert (got.fetched, got.valid, got.invalid, got.inserted, got.failed, got.skipped) == (10, 7, 3, 2, 3, 2)
    assert sorted((r.order_id, r.total_amount) for r in api_orders.new_orders(checked, stored).collect()) == [("a", "5"), ("e", "3")]
    none = api_orders.ingestion_stats(checked.limit(0), stored).first()
    assert (none.fetched, none.inserted, none.failed, none.success_rate) == (0, 0, 0, 0.0)
