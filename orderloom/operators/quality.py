"""Declarative data quality: all row checks of a table run in one aggregation pass; keys and references in one more each.

Every check gives a row (suite, check_name, table_name, column_name, success, observed, expected). A null passes value checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constraints import CONSTRAINTS, checkable

RESULT = "suite string, check_name string, table_name string, column_name string, success boolean, observed double, expected string"


@dataclass(frozen=True)
class Check:
    """A check: ``measure`` is an aggregate Column; it succeeds between ``low`` and ``high``."""

    name: str
    column: str
    measure: object  # a function that makes the Column, so that checks can be declared before a session exists
    low: float | None = 0
    high: float | None = 0

    @property
    def expected(self) -> str:
        return f"{'' if self.low is None else self.low}..{'' if self.high is None else self.high}"


def failing(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def not_null(c: str) -> Check:
    return Check("not_null", c, lambda: F.count_if(F.col(c).isNull()))


def accepted_values(c: str, values: list) -> Check:
    return Check("accepted_values", c, lambda: failing(~F.col(c).isin(*values)))


def between(c: str, low: float, high: float) -> Check:
    return Check("between", c, lambda: failing(~F.col(c).between(low, high)))


def matches(c: str, pattern: str) -> Check:
    return Check("regex", c, lambda: failing(~F.col(c).rlike(pattern)))


def row_count(low: float | None, high: float | None) -> Check:
    return Check("row_count", "*", lambda: F.count(F.lit(1)), low, high)


def parseable(c: str, kind: str = "date") -> Check:
    return Check("parseable_" + kind, c, lambda: failing(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()))


def null_percentage(c: str, most: float) -> Check:
    return Check("null_percentage", c, lambda: F.coalesce(F.avg(F.col(c).isNull().cast("double")) * 100, F.lit(0.0)), 0, most)


def run_suite(df: DataFrame, suite: str, table: str, checks: list[Check]) -> DataFrame:
    """One pass over ``df`` for all checks, then a row for each of them."""
    one = df.agg(*(c.measure().cast("double").alias(f"m{i}") for i, c in enumerate(checks)))
    rows = []
    for i, c in enumerate(checks):
        seen = F.col(f"m{i}")
        good = (F.lit(True) if c.low is None else seen >= c.low) & (F.lit(True) if c.high is None else seen <= c.high)
        rows.append(F.struct(F.lit(suite).alias("suite"), F.lit(c.name).alias("check_name"), F.lit(table).alias("table_name"), F.lit(c.column).alias("column_name"), good.alias("success"), seen.alias("observed"), F.lit(c.expected).alias("expected")))
    return one.select(F.inline(F.array(*rows)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n): keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rows_beyond_first(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose key is not null and has no parent."""
    known = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def consistency(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One row: counts, keys missing in the target, extra there, in both; passes if none is missing."""
    a, b = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((source, "s"), (target, "t")))
    j = a.join(b, keys, "full")
    out = j.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_count"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("target_count"),
        F.count_if(F.col("t").isNull()).alias("missing_in_target"),
        F.count_if(F.col("s").isNull()).alias("extra_in_target"),
        F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("matching"),
    )
    return out.withColumn("passed", F.col("missing_in_target") == 0)


def violated(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """``df`` with validation_errors: the names of constraints that a row breaks (null passes), and is_valid."""
    broken = F.array_compact(F.array(*(F.when(~holds, F.lit(name)) for name, holds in constraints.items())))
    return df.withColumn("validation_errors", broken).withColumn("is_valid", F.size("validation_errors") == 0)


def constraint_violations(df: DataFrame, table: str) -> DataFrame:
    """(table_name, constraint_name, checked, violations) in one pass: a row for each constraint of ``table``; not checked are those of columns that ``df`` lacks."""
    own = checkable(table, df.columns)
    counts = df.agg(*(failing(~F.expr(sql)).alias(name) for name, sql in own.items()), F.count(F.lit(1)).alias("rows_"))
    rows = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("constraint_name"), F.lit(c in own).alias("checked"), (F.col(c) if c in own else F.lit(None)).cast("long").alias("violations")) for c in CONSTRAINTS[table]]
    return counts.select(F.inline(F.array(*rows)))


def with_constraints(df: DataFrame, table: str) -> DataFrame:
    """``df`` with validation_errors, the names of the constraints of ``table`` that a row breaks, and is_valid."""
    return violated(df, {name: F.expr(sql) for name, sql in checkable(table, df.columns).items()})


def field_counts(lines: DataFrame, expected: int) -> DataFrame:
    """(fields, lines, as_expected): lines of CSV text (value) by their number of fields; commas inside quotes do not part fields."""
    n = F.regexp_count(F.regexp_replace("value", '"([^"]|"")*"', ""), F.lit(",")) + 1
    return lines.groupBy(n.cast("long").alias("fields")).agg(F.count(F.lit(1)).alias("lines")).withColumn("as_expected", F.col("fields") == expected)


def type_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(column_name, expected, found, missing, not_castable): values that do not cast to the expected type."""
    have = dict(df.dtypes)
    counts = [(failing(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(kind).isNull()) if c in have else F.lit(0)).alias(f"m{i}") for i, (c, kind) in enumerate(expected.items())]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("expected"), F.lit(have.get(c)).alias("found"), F.lit(c not in have).alias("missing"), F.col(f"m{i}").cast("long").alias("not_castable")) for i, (c, kind) in enumerate(expected.items())]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def save_results(results: DataFrame, path: str, batch: str, at: Column) -> None:
    results.withColumns({"batch_id": F.lit(batch), "run_time": at}).write.mode("append").parquet(path)
