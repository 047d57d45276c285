"""Results with types that compare alike across engines, from one short notation of columns.

"name:l" is a bigint, ":d" a double rounded to six places, ":s" text, ":b" boolean; "name:kind=expression" renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) if ":" in x else (x, "s") for x in spec.split()]


def result(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in parse(spec):
        c = F.col(name).cast(KINDS[kind])
        out.append((F.round(c, 6) if kind == "d" else c).alias(name))
    return df.select(*out)


def result_sql(source: str, spec: str, more: str = "") -> str:
    casts = {"l": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6)", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}
    return "SELECT " + ", ".join(casts[k].format(n) + f" AS {n}" for n, k in parse(spec)) + f" FROM {source} {more}"
