"""URL filters: host-suffix and path-prefix expressions, met by short hash prefixes and confirmed by full digests.

Every URL becomes all pairs of a suffix of its host (whole labels, as many as some rule has) and a prefix of its path (of
the lengths that rules have), so a host of a hundred thousand labels has no more expressions than another. Expressions and rules meet in an equi-join on the first 32 bits of SHA-256; the whole digest
confirms; of the rules that fit, the longest wins (then the one with the longer host). Where one host and path is given with
several verdicts, the last in code point order holds: block before allow.

Edge cases: a url that is null or has no ``://`` has an empty host and path and fits no rule; an empty path
fits only rules with an empty path; repeated rows and null ids stay separate rows; an empty table gives no rows; the names of
added columns are lengthened by _ where ``urls`` has such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, own_columns, table, with_rows

#: (verdict, host, path) of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Rules are broadcast up to this many; beyond it the join shuffles both sides, the expressions salted.
BROADCAST_RULES = 200_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def label_count(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All (host suffix)(path prefix) strings of so many labels and so long paths, as structs (host, path)."""
    suffixes = F.array(*(F.when(label_count(host) >= n, F.substring_index(host, ".", -n)) for n in labels))
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length(path))
    return F.flatten(F.transform(F.array_compact(suffixes), lambda h: F.transform(cuts, lambda n: F.struct(h.alias("host"), F.substr(path, F.lit(1), n).alias("path")))))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def short(d: Column) -> Column:
    return F.conv(F.substring(d, 1, 8), 16, 10).cast("long")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and verdict. ``rules``: (verdict, host, path), a row for each rule."""
    known = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("digest", digest(F.col("host"), F.col("path"))).withColumn("short", short(F.col("digest")))
    shapes = rules.select(label_count(F.col("host")), F.char_length("path")).distinct().collect()  # numbers of labels and lengths of paths, not rules
    labels, lengths = ({r[k] for r in shapes} - {None} or {0} for k in range(2))
    known = known.select(F.struct((F.char_length("host") + F.char_length("path")).alias("length"), F.char_length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict", "digest").alias("found"), "short")
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    row = free_name(urls, "row")
    numbered = with_rows(urls, row)
    rows = numbered.select(F.struct(*own_columns(urls)).alias("page"), F.col(row).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    tried = rows.select("row", F.explode(expressions(F.col("host"), F.col("path"), sorted(labels), sorted(lengths))).alias("e"))
    tried = tried.withColumn("digest", digest(F.col("e.host"), F.col("e.path"))).select("row", "digest", short(F.col("digest")).alias("short"))
    if few:
        met = tried.join(F.broadcast(known), "short")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = tried.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    best = met.where("digest = found.digest").groupBy("row").agg(F.max("found").alias("best"))
    out = rows.join(best, "row", "left")
    names = [free_name(urls, x) for x in ("host", "path", "rule", "verdict")]
    return out.select("page.*", *(c.alias(x) for c, x in zip([F.col("host"), F.col("path"), F.col("best.rule"), F.coalesce("best.verdict", F.lit(default))], names, strict=True)))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op5_url_filters": op5_url_filters}
SQL = {
    "op5_url_filters": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(v, h, q) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT n, max_by(h || q, length(h) + length(q)) AS rule, max_by(v, length(h) + length(q)) AS v
  FROM p JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""
}
