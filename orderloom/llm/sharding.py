"""Resharding by minimum-cost flow.

Old shards have a size in bytes, new shards a capacity. Old shards are groups of the table's
files as they lie in storage. A flow network (old shards, new shards, cost 0 for
bytes that stay and 1 for bytes that move) is solved on the driver; it has one node for each shard, whatever
the size of the data. What leaves a shard is cut into runs of documents ("blocks"), smallest documents first,
so that the sizes come out even; only files of shards that gain or lose documents are rewritten, and the rows
written are counted.

Edge cases: a null text has 0 bytes (size 16, crc32 of nothing); repeated rows and equal texts are separate
documents and may part; a document larger than a shard's capacity goes whole to the shard that its middle byte falls to; null ids sort first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FILE_ROW_BITS, free_name, new_path, own_columns, table, tasks_for, text_bytes, text_crc32, through_table, with_rows

OLD_SHARDS = 32
SHARDS = 40
ROW_BYTES = 16
#: Documents of a shard fall into classes by size and buckets by hash, from 64 to 1,024 as the bytes grow; windows run inside a bucket.
SIZE_CLASSES, HASH_BUCKETS, MOST_BUCKETS = 48, 64, 1_024
#: A file of a shard has about this many bytes of text.
FILE_BYTES = 128 << 20


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes to send from each old shard to each new one: all supply, within capacity, moving the fewest bytes.

    Successive shortest paths with potentials over: source, old shards, new shards, sink. Old shard i reaches new
    shard i at cost 0 and every other one, by way of one shared hub, at cost 1.
    """
    if sum(capacity.values()) < sum(supply.values()):
        raise ValueError("the new capacities are less than the bytes")
    names = ["s", "hub", "t", *(("o", i) for i in sorted(supply)), *(("n", j) for j in sorted(capacity))]
    at = {x: k for k, x in enumerate(names)}
    edges: list[list[int]] = []  # to, room, cost; the edge back is at index ^ 1
    out: list[list[int]] = [[] for _ in names]

    def edge(a, b, room, cost):
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[at[x]].append(len(edges))
            edges.append([at[y], r, c])

    for i in sorted(supply):
        edge("s", ("o", i), supply[i], 0)
        if i in capacity:
            edge(("o", i), ("n", i), supply[i], 0)
        edge(("o", i), "hub", supply[i], 1)
    for j in sorted(capacity):
        edge("hub", ("n", j), capacity[j], 0)
        edge(("n", j), "t", capacity[j], 0)
    potential = [0] * len(names)
    while True:
        far: list[float] = [float("inf")] * len(names)
        far[at["s"]], via, heap = 0, [-1] * len(names), [(0, at["s"])]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                v, room, cost = edges[e]
                if room and (n := d + cost + potential[u] - potential[v]) < far[v]:
                    far[v], via[v] = n, e
                    heapq.heappush(heap, (n, v))
        if far[at["t"]] == float("inf"):
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        path, v = [], at["t"]
        while via[v] >= 0:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        flow = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= flow
            edges[e ^ 1][1] += flow
    sent: dict[tuple[int, int], int] = {}
    leaving, arriving = {}, {}
    for i in supply:
        for e in out[at["o", i]]:
            if e % 2 == 0 and edges[e ^ 1][1]:
                if edges[e][0] == at["hub"]:
                    leaving[i] = edges[e ^ 1][1]
                else:
                    sent[i, i] = edges[e ^ 1][1]
    for e in out[at["hub"]]:
        if e % 2 == 0 and edges[e ^ 1][1]:
            arriving[names[edges[e][0]][1]] = edges[e ^ 1][1]
    gaps = sorted(arriving.items())
    for i in sorted(leaving):  # through the hub every pairing costs the same
        left = leaving[i]
        while left:
            j, room = gaps[0]
            part = min(left, room)
            sent[i, j] = sent.get((i, j), 0) + part
            left -= part
            gaps[0] = (j, room - part)
            if room == part:
                gaps.pop(0)
    return sent


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


PLACE = ["old_shard", "size_class", "bucket"]


def with_places(rows: DataFrame, buckets: int, old_shards: int = OLD_SHARDS) -> DataFrame:
    """``rows`` (row, size, ...) with the old shard, a group of the table's files, and the bucket there: functions of row and size alone."""
    return rows.withColumns(
        {
            "old_shard": F.pmod(F.shiftright("row", FILE_ROW_BITS), F.lit(old_shards)).cast("int"),
            "size_class": F.least(F.floor(F.log2("size") * 2), F.lit(SIZE_CLASSES)).cast("int"),
            "bucket": F.pmod(F.xxhash64("row", F.lit(7)), F.lit(buckets)).cast("int"),
        }
    )


def old_layout(docs: DataFrame) -> tuple[DataFrame, int]:
    """(row, doc_id, size, text_crc32) and the place of each of ``docs`` (row, doc_id, text), without the texts; and the number of buckets."""
    sized = docs.select("row", "doc_id", (text_bytes(F.col("text")) + ROW_BYTES).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    sized = through_table(sized, "shard-sizes")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    buckets = min(MOST_BUCKETS, max(HASH_BUCKETS, total // (FILE_BYTES * SHARDS)))
    return with_places(sized, buckets), buckets


def plan_moves(sized: DataFrame, capacities: dict[int, int] | None = None, shards: int = SHARDS) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The new shard of each document and its slot there: the columns of ``sized`` with shard and slot; and the transfers."""
    spark = sized.sparkSession
    supply = {r.old_shard: r.bytes for r in sized.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}  # a row for each shard
    if not supply:
        return sized.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}), {}
    transfers = min_cost_flow(supply, capacities or even_capacities(sum(supply.values()), shards))

    # the line of an old shard: what leaves comes first, and small documents come first
    cuts, start = [], {}
    for (i, j), n in sorted(transfers.items(), key=lambda x: (x[0][0], x[0][0] == x[0][1], x[0][1])):
        cuts.append((i, start.get(i, 0), start.get(i, 0) + n, j))
        start[i] = start.get(i, 0) + n
    cuts = spark.createDataFrame(cuts, "i int, cut_from long, cut_to long, shard int")

    before = Window.partitionBy("old_shard").orderBy("size_class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.groupBy(*PLACE).agg(F.sum("size").alias("bytes")).select(*PLACE, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*PLACE).orderBy("size", "row")
    placed = sized.withColumn("middle", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.expr("size div 2"))
    # both sides lie by place already; of the cuts there is one row for each transfer
    placed = placed.join(bases, PLACE).withColumn("middle", F.col("base") + F.col("middle"))
    placed = placed.join(F.broadcast(cuts), F.expr("old_shard = i and middle >= cut_from and middle < cut_to")).drop("i", "cut_from", "cut_to", "middle", "base")
    placed = through_table(placed, "shard-moves")

    slots = placed.withColumn("nth", F.row_number().over(in_bucket())).join(slots_ahead(placed), ["shard", *PLACE])
    return slots.withColumn("slot", (F.col("ahead") + F.col("nth") - 1).cast("long")).drop("nth", "ahead"), transfers


def in_bucket(*more: str):
    return Window.partitionBy("shard", *more, *PLACE).orderBy("size", "row")


def slots_ahead(placed: DataFrame) -> DataFrame:
    """(shard, place, ahead): the documents of the shard in earlier buckets."""
    before = Window.partitionBy("shard").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("shard", *PLACE).count().select("shard", *PLACE, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))


def changed_shards(plan: DataFrame) -> DataFrame:
    """(shard): the shards that gain or lose documents."""
    moved = plan.where("shard <> old_shard")
    return moved.select("shard").union(moved.select(F.col("old_shard").alias("shard"))).distinct()


def rewrite(docs: DataFrame, plan: DataFrame, buckets: int, to: str) -> DataFrame:
    """Write the shards that change, as files below ``to``/shard=N with their slots; returns a reader of them.

    ``docs`` has the row numbers that the plan was made of. What goes from an old shard to a new one is a stretch of the old shard's
    order, so the ends of the stretches tell the shard, and the texts move once: to the files of their shard, several for a large one.
    """
    spark = docs.sparkSession
    key = F.struct("size_class", "bucket", "size", "row")
    ends = plan.groupBy("old_shard", "shard").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.join(changed_shards(plan), "shard").withColumnRenamed("old_shard", "i")  # a row for each transfer
    ahead = slots_ahead(plan)  # at most one row for each bucket and transfer
    found = plan.join(F.broadcast(changed_shards(plan)), "shard", "left_semi").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    files = found.bytes // (FILE_BYTES * SHARDS) + 1
    rows = docs.select("row", (text_bytes(F.col("text")) + ROW_BYTES).alias("size"), F.struct(*own_columns(docs.drop("row"))).alias("doc"))
    rows = with_places(rows, buckets).withColumn("key", key)
    rows = rows.join(F.broadcast(ends), F.expr("old_shard = i and key >= low and key <= high")).drop("i", "low", "high", "key")
    rows = rows.withColumn("part", F.pmod("bucket", F.lit(files))).repartition(max(SHARDS * files, tasks_for(spark)), "shard", "part")
    rows = rows.withColumn("nth", F.row_number().over(in_bucket("part"))).join(F.broadcast(ahead), ["shard", *PLACE])
    slot = (F.col("ahead") + F.col("nth") - 1).cast("long").alias("slot")
    rows.select("doc", "shard", slot).write.option("compression", "zstd").partitionBy("shard").parquet(to)
    written = spark.read.schema(rows.select("doc", slot, "shard").schema).parquet(to)
    if (n := written.count()) != found.rows:
        raise RuntimeError(f"{n} rows were written, {found.rows} were planned")
    return written


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_rows(table(spark, sf_dir, "documents")).select("row", "doc_id", "text")
    sized, buckets = old_layout(docs)
    plan = through_table(plan_moves(sized)[0], "shard-plan")
    written = rewrite(docs, plan, buckets, new_path(spark, "shards"))
    # shards that no document enters or leaves keep their files
    kept = plan.join(F.broadcast(changed_shards(plan)), "shard", "left_anti").select("doc_id", "size", "text_crc32", "shard", "slot")
    text = F.col("doc.text")
    back = written.select("doc.doc_id", (text_bytes(text) + ROW_BYTES).alias("size"), text_crc32(text).alias("text_crc32"), F.col("shard").cast("int"), "slot")
    return back.unionByName(kept).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """All rows of ``docs`` with shard and slot (lengthened by _ if ``docs`` has such columns)."""
    row, shard, slot = (free_name(docs, x) for x in ("row", "shard", "slot"))
    numbered = with_rows(docs, row)
    sized, _ = old_layout(numbered.select(F.col(row).alias("row"), "doc_id", "text"))
    plan, _ = plan_moves(sized)
    plan = plan.select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    return numbered.join(plan, row).select(*own_columns(docs), shard, slot)


QUERIES = {"op4_resharding": op4_resharding}
SQL: dict[str, str] = {}
