"""Mixing sources to target weights, with DataFrame operations alone.

The words of each source are one long stream, cut into blocks of ``block_words`` words. Each source has
``round(target / block)`` slots in the mix. A slot draws its output shard from a seeded hash, which makes
the counts of the sources in the shards multinomial, conditioned on each source's total. The slot's block is
found by a pseudorandom permutation of the source's block indexes (one for each pass over the source), and
slots and blocks meet in an equi-join on (source, block index).

Edge cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, the
last in order; repeated rows, repeated or null ids are separate documents; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, own_columns, table, tasks_for, through_table, with_rows

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 128
BUCKETS = 2048
ROUNDS = 14
SEED = 20_011


def document_sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, bucket), written once: the only pass over the texts. ``row`` names a column made by ``with_rows``."""
    docs = docs if row else with_rows(docs.select("doc_id", "text", "source"))
    out = docs.select(
        F.col(row or "row").alias("row"),
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return through_table(out.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(BUCKETS)).cast("int")), "mix-sizes")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources in code point order, null last.

    A source is full at ``most`` times its size. Sorted by the level at which they fill, the sources before the
    first one that the remaining words cannot fill get their limit; the others share what is left by weight.
    The windows run over one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("fills_at", F.col("limit") / F.col("weight"))
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(every) * F.lit(float(share)),
            "limits_before": F.coalesce(F.sum("limit").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights_left": F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    per = per.withColumn("level", (F.col("total") - F.col("limits_before")) / F.col("weights_left"))
    # the level rises up to the first source that does not fill, then falls; all are full when there is none
    per = per.withColumn("last_level", F.max(F.when(F.col("fills_at") >= F.col("level"), F.col("level"))).over(every))
    target = F.when(F.col("last_level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("last_level")))
    return per.select("source", "source_size", target.alias("target"))


def pack_blocks(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, source, block, words, from_word): the pieces of documents in each block.

    A document's place in its source's stream is a two-level running sum: over hash buckets of a source, then
    within a bucket, so that no task gets a whole source.
    """
    bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.where("size > 0").withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(bucket, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    placed = placed.withColumn("first", F.col("base") + F.col("offset")).withColumn("end", F.expr("first + size"))
    pieces = placed.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block_words}"), F.expr(f"(end - 1) div {block_words}"))))
    pieces = pieces.withColumn("from_word", F.greatest(F.expr(f"block * {block_words} - first"), F.lit(0)))
    return pieces.select("row", "source", "block", "from_word", F.expr(f"least(end, (block + 1) * {block_words}) - greatest(first, block * {block_words})").alias("words"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap-or-not shuffle): each round swaps an index with its mirror image around a keyed centre, or leaves both."""

    def one(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - x, n)
        swap = F.pmod(F.xxhash64(F.lit(-SEED), r, F.greatest(x, mirror), *key), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), one)


def draw_slots(targets: DataFrame, shards: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, pass, k, shard, block): the mix's slots with the shard drawn and the block that the permutation gives."""
    per = targets.where("source_size > 0").select(
        "source",
        F.expr(f"(source_size + {block_words - 1}) div {block_words}").alias("blocks"),
        (F.col("target") / F.col("source_size")).alias("passes"),
    )
    per = per.withColumn("slots", F.round(F.col("passes") * F.col("blocks")).cast("long")).where("slots > 0")
    step = 4096  # slots are dealt out in runs of this many, whatever the size of a source
    runs = per.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {step}"))))
    runs = runs.repartition(tasks_for(targets.sparkSession), "source", "run")
    slots = runs.withColumn("k", F.explode(F.sequence(F.expr(f"run * {step}"), F.expr(f"least(slots, (run + 1) * {step}) - 1"))))
    slots = slots.withColumn("pass", F.expr("k div blocks"))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return slots.select(
        "source",
        "pass",
        "k",
        F.pmod(F.xxhash64(F.lit(SEED), F.lit("shard"), name, "k"), F.lit(shards)).cast("int").alias("shard"),
        permuted(F.expr("k % blocks"), F.col("blocks"), name, F.col("pass")).alias("block"),
    )


def mix(sizes: DataFrame, targets: DataFrame, shards: int = 64, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(shard, source, pass, k, block, row, from_word, words): every piece of every slot of the mix."""
    pieces = pack_blocks(sizes, block_words)
    slots = draw_slots(targets, shards, block_words).withColumnsRenamed({"source": "s", "block": "b"})
    met = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    # the slots grow with the corpus: never a broadcast
    return pieces.join(slots.hint("merge"), met).drop("s", "b")


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """(shard, source, k, words array): the blocks with their words. ``docs``: (row, text), with the row numbers that ``mixed`` has."""
    words = docs.select("row", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1)).alias("all"))
    cut = mixed.join(words, "row").withColumn("part", F.expr("slice(all, cast(from_word as int) + 1, cast(words as int))"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "row", "part")))  # at most block_words pieces
    return cut.groupBy("shard", "source", "k").agg(F.flatten(F.transform(pieces, lambda x: x["part"])).alias("words"))


def taken_words(docs: DataFrame, row: str | None = None, **how) -> DataFrame:
    """One row for each document: row, doc_id, source, size, source_size, target, taken."""
    sizes = document_sizes(docs, row)
    targets = source_targets(sizes)
    taken = mix(sizes, targets, **how).groupBy("row").agg(F.sum("words").alias("taken"))
    per = targets.select(F.col("source").alias("s"), "source_size", "target")
    out = sizes.join(taken, "row", "left").join(F.broadcast(per), F.col("source").eqNullSafe(F.col("s")), "left")  # a row for each source
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(with_rows(table(spark, sf_dir, "documents")), "row").select("doc_id", "size", "source_size", F.col("target").cast("double"), "taken", "source")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Documents as often as the mix takes them: words taken over size, with one more or none for the fraction, by a seeded draw. Blank texts stay once.

    Each document is expected as often as its words are taken, whatever its length, so that sources meet their targets in expectation.
    """
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.lit("copies"), "row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + draw))
    row, copies = free_name(docs, "row"), free_name(docs, "copies")
    numbered = with_rows(docs, row)
    kept = taken_words(numbered, row).select(F.col("row").alias(row), F.array_repeat(F.lit(1), times.cast("int")).alias(copies))
    return numbered.join(kept, row).withColumn(copies, F.explode(copies)).select(*own_columns(docs))


QUERIES = {"op7_mixing": op7_mixing}
SQL: dict[str, str] = {}
