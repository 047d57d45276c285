"""Quality rules judged by host.

Each document is measured and held against five rules. Failures are added up by host and rule; the rate of a host is shrunk
towards the rate of all hosts with a beta prior, whose strength comes from how much hosts differ beyond chance (method of moments).
A host whose shrunk rate for any rule is above ``BLOCK``, and above STANDS_OUT times that of all hosts, is blocked: all of its documents go. Of other hosts, documents that fail a
rule go, unless hardly any document there does (rate below ``TRUST``); the base rules (short, repetitive) forgive nothing.

No host goes to one task: failures are pre-aggregated where documents are read, verdicts of hosts with more than one document in
HOT_SHARE of all (so fewer hosts than HOT_SHARE) are broadcast, and those of the others are joined.

Edge cases: a null text has no words and fails as short; a null host is a host of its own; repeated rows and ids are separate
documents; a host with few documents takes nearly the rates of all hosts; an empty table gives no rows; columns that are not kept
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, through_table

#: Rule: the failing documents, as SQL over the measures.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("short", "repetitive")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
BLOCK, STANDS_OUT, TRUST = 0.5, 2.0, 0.01
#: The prior counts as so many documents at least and at most.
WEAKEST, STRONGEST = 1.0, 1e6
HOT_SHARE = 64
PIECE_ROWS, PIECE_BYTES = 2_000, 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """MEASURES of each text."""
    ends = np.cumsum([len(t) for t in texts], dtype="i8")
    begins = ends - [len(t) for t in texts]
    line = np.frombuffer(b"".join(texts), "u1")

    def by_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype="i8")])
        return sums[ends] - sums[begins]

    words = [t.split() for t in texts]  # bytes split at exactly the six blanks
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_words = np.array([len(w) for w in words], "i8")
    n_lines = np.array([len(x) for x in lines], "i8")
    return {
        "n_words": n_words,
        "word_chars": by_text(~SPACE[line] & ((line & 0xC0) != 0x80)),
        "n_symbols": by_text(SYMBOL[line]),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.array([len(set(x)) for x in lines], "i8"),
        "n_repeat_words": repeated_words(words, n_words),
    }


def repeated_words(words: list[list[bytes]], n_words: np.ndarray) -> np.ndarray:
    """Words of each text inside windows of three that occur there twice or more."""
    number = {w: k for k, w in enumerate(set(chain.from_iterable(words)))}
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), "i8", int(n_words.sum()))
    owner = np.repeat(np.arange(len(words)), n_words)
    if len(ids) < 3:
        return np.zeros(len(words), "i8")
    # pairs by text, then pair and third word: exact numbers, no hashes
    pair = np.unique((owner[:-2] * len(number) + ids[:-2]) * len(number) + ids[1:-1], return_inverse=True)[1]
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    _, at, times = np.unique(pair[inside] * len(number) + ids[2:][inside], return_inverse=True, return_counts=True)
    first = inside[times[at] > 1]
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[first + k] = True
    return np.bincount(owner[covered], minlength=len(words)).astype("i8")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and MEASURES of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_ROWS, PIECE_BYTES, "text_"):
                got = measure(pc.fill_null(part.column("text_").cast(pa.binary()), b"").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(got[m]) for m in MEASURES)], [*keep, *MEASURES])

    schema = docs.select(*keep).schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    return docs.select(*keep, F.col("text").alias("text_")).mapInArrow(run, schema)


def host_rates(measures: DataFrame, host: str) -> DataFrame:
    """(host, n, all_n, rate_..., limit_...): the documents of each host and of all, its shrunk rates, and those above which it is blocked."""
    hosts = through_table(measures.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(sql)).alias(f"f_{r}") for r, sql in RULES.items())), "quality-hosts")
    n = F.col("n").cast("double")
    sums = [F.sum(n).alias("all_n"), F.count(F.lit(1)).cast("double").alias("all_hosts"), F.sum(n * n).alias("all_n2")]
    for r in RULES:
        f = F.col(f"f_{r}").cast("double")
        sums += [F.sum(f).alias(f"sum_{r}"), F.sum(f * f / n).alias(f"sum2_{r}")]
    both = hosts.join(F.broadcast(hosts.agg(*sums)))  # one row
    rates, limits = [], []
    for r in RULES:
        mean = F.col(f"sum_{r}") / F.col("all_n")
        strength = prior_strength(mean, F.col(f"sum2_{r}") - mean * F.col(f"sum_{r}"))
        rates.append(((F.col(f"f_{r}") + mean * strength) / (n + strength)).alias(f"rate_{r}"))
        limits.append(F.greatest(F.lit(BLOCK), mean * STANDS_OUT).alias(f"limit_{r}"))
    return both.select("host", "n", "all_n", *rates, *limits)


def prior_strength(mean: Column, spread: Column) -> Column:
    """a + b of the beta prior: from the spread of the hosts' rates, weighted by documents, less what chance alone gives."""
    chance = F.col("all_hosts") - 1
    alike = F.try_divide(F.try_divide(spread, mean * (1 - mean)) - chance, F.col("all_n") - chance - F.try_divide(F.col("all_n2"), F.col("all_n")))
    return F.when(alike > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / alike - 1))).otherwise(STRONGEST)


def judged(docs: DataFrame, keep: list[str], host: str = "source") -> DataFrame:
    """``keep`` (with ``host`` in it) and MEASURES of all documents, failed (names of rules), base_failed, host_blocked and kept."""
    measures = through_table(measured(docs, keep), "quality-measures")
    rates = through_table(host_rates(measures, host), "quality-rates")
    blocked = reduce(Column.__or__, (F.col(f"rate_{r}") > F.col(f"limit_{r}") for r in RULES))
    forgiven = F.array_compact(F.array(*(F.when(F.col(f"rate_{r}") < TRUST, F.lit(r)) for r in RULES if r not in BASE)))
    verdicts = rates.select("host", (F.col("n") * HOT_SHARE > F.col("all_n")).alias("hot"), blocked.alias("host_blocked"), forgiven.alias("forgiven"))
    same = F.col(host).eqNullSafe(F.col("host"))
    hot = F.broadcast(verdicts.where("hot"))  # fewer than HOT_SHARE rows
    whole = measures.join(hot, same).unionByName(measures.join(hot, same, "left_anti").join(verdicts.where("not hot"), same))
    failed = F.array_compact(F.array(*(F.when(F.expr(sql), F.lit(r)) for r, sql in RULES.items())))
    out = whole.withColumn("failed", failed).withColumn("base_failed", F.arrays_overlap("failed", F.array(*map(F.lit, BASE))))
    good = (F.size(F.array_except("failed", "forgiven")) == 0) & ~F.col("host_blocked")
    return out.withColumn("kept", good).select(*keep, *MEASURES, "failed", "base_failed", "host_blocked", "kept")


def kept_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    packed = docs.select(F.struct("*").alias("doc_"), F.col(host).alias("host_"), "text")
    return judged(packed, ["doc_", "host_"], "host_").where("kept").select("doc_.*")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return out.select("doc_id", *MEASURES, "base_failed", "kept", F.array_join("failed", ",").alias("failed"), "host_blocked")


def _sql() -> str:
    word, blank = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    sums = ", ".join(f"sum(CAST(f_{r} AS DOUBLE)) AS sum_{r}, sum(CAST(f_{r} AS DOUBLE) * f_{r} / n) AS sum2_{r}" for r in RULES)
    strength, rates = [], []
    for r in RULES:
        mean = f"(sum_{r} / all_n)"
        alike = f"((sum2_{r} - {mean} * sum_{r}) / nullif({mean} * (1 - {mean}), 0) - (all_hosts - 1)) / nullif(all_n - all_hosts + 1 - all_n2 / all_n, 0)"
        strength.append(f"CASE WHEN {alike} > 0 THEN greatest({WEAKEST}, least({STRONGEST}, 1 / ({alike}) - 1)) ELSE {STRONGEST} END AS k_{r}")
        rates.append(f"(f_{r} + {mean} * k_{r}) / (n + k_{r}) AS rate_{r}, {mean} AS mean_{r}")
    soft = [r for r in RULES if r not in BASE]
    blocked = " OR ".join(f"rate_{r} > greatest({BLOCK}, mean_{r} * {STANDS_OUT})" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT id, regexp_extract_all(text, '{word}') AS ws FROM d)),
windows AS (SELECT id, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
twice AS (SELECT id, pos FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY id, a, b, c) > 1),
again AS (SELECT id, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY id),
lines AS (SELECT id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY id),
m AS (SELECT doc_id, source, len(regexp_extract_all(text, '{word}')) AS n_words, length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lines.n, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (id) LEFT JOIN again USING (id)),
f AS (SELECT *, {", ".join(f"({sql}) AS is_{r}" for r, sql in RULES.items())} FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"count(*) FILTER (is_{r}) AS f_{r}" for r in RULES)} FROM f GROUP BY source),
t AS (SELECT sum(n) AS all_n, CAST(count(*) AS DOUBLE) AS all_hosts, sum(n * n) AS all_n2, {sums} FROM h),
k AS (SELECT *, {", ".join(strength)} FROM t),
r AS (SELECT source, {", ".join(rates)} FROM h, k)
SELECT doc_id, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in MEASURES)}, {" OR ".join(f"is_{x}" for x in BASE)} AS base_failed,
  NOT ({" OR ".join(f"is_{x}" for x in BASE)} OR {blocked} OR {" OR ".join(f"(is_{x} AND rate_{x} >= {TRUST})" for x in soft)}) AS kept,
  concat_ws(',', {", ".join(f"CASE WHEN is_{x} THEN '{x}' END" for x in RULES)}) AS failed, {blocked} AS host_blocked
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source"""


QUERIES = {"op11_quality_rules": op11_quality_rules}
SQL = {"op11_quality_rules": _sql()}
