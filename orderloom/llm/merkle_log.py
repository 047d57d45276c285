"""A Merkle manifest of a dataset, kept as a postorder append log.

Each row is a leaf; the leaves of a language, by id, form a tree of ARITY children a node, and the roots of the languages form a tree on
top. Spark sorts the leaves once and numbers them from the counts of the sorted files. Aligned builders, one for each block of
ARITY ** LEVELS leaves, append nodes in the order in which they are complete; the roots of full blocks are the leaves of the next
round of builders. A node's place in its tree's log is known in closed form from its level, its index and the number of leaves
(``position``), so a reader finds the siblings of any node by their places, without an index. Proofs go down in the same blocks: the path above
a block is found once and shared by its leaves. ``manifest`` gives logs and leaves, ``verified`` proves all rows of another state
of the dataset against it.

Edge cases: nulls in any column are ``-``; rows with equal ids are ordered by their leaves, and equal rows are equal leaves, each with
its own place; null languages are a tree of their own, the first one; null ids sort first; long texts are hashed inside Spark;
a table without rows has no nodes and no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tasks_for, through_table

ARITY = 8
#: Levels that a builder adds, over ARITY ** LEVELS nodes.
LEVELS = 3
BLOCK = ARITY**LEVELS
NODE = "tree string, n long, block long, level int, i long, position long, digest string, is_root boolean"
ABOVE = "tree string, block long, path string, subroot string, root string, top_n long, top_i long"


def widths(n: int) -> list[int]:
    """Nodes of each level of a tree of ``n`` leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def height(n: int) -> int:
    return len(widths(n)) - 1


def position(n: int, level: int, i: int | np.ndarray) -> int | np.ndarray:
    """How many nodes of a tree of ``n`` leaves are complete before node ``i`` of ``level``."""
    end = np.minimum((np.asarray(i) + 1) * ARITY**level, n)
    inside = sum(-(-end // ARITY**g) for g in range(level + 1))
    before = sum(np.asarray(i) // ARITY ** (g - level) for g in range(level + 1, height(n) + 1))
    return inside + before - 1


def digest_of(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def places(n: int, i: int) -> list[tuple[int, int]]:
    """(place in its run, nodes of the run) of leaf ``i`` and of each node above it, below the root."""
    out = []
    for width in widths(n)[:-1]:
        begin = i // ARITY * ARITY
        out.append((i - begin, min(ARITY, width - begin)))
        i //= ARITY
    return out


def fold(digest: str, runs: list[tuple[int, int]], path: str) -> str:
    """The root that ``digest`` gives with the siblings in ``path``."""
    at = 0
    for place, size in runs:
        left, right = path[at : at + 64 * place], path[at + 64 * place : at + 64 * (size - 1)]
        digest = digest_of([left, digest, right])
        at += 64 * (size - 1)
    return digest


# --- leaves


def field(name: str, text: Column | None = None) -> Column:
    value = F.col(name).cast("string") if text is None else text
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    return F.sha2(F.concat(*(field(c) for c in ("doc_id", "source", "lang", "n_chars")), field("text", text)).cast("binary"), 256)


def ranked(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """``leaves`` (tree, digest, ...) with i, the place in its tree by ``order``, and n, the leaves of the tree."""
    by = [F.col("tree").asc_nulls_first(), *order, F.col("digest").asc(), F.col("tie")]
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())  # equal leaves may be in any order, and in several tasks
    placed = tied.repartitionByRange(tasks_for(leaves.sparkSession), *by).sortWithinPartitions(*by).drop("tie")
    stored = through_table(placed.withColumn("part", F.spark_partition_id()), "merkle-leaves")
    stored = stored.select("*", F.col("_metadata.row_index").alias("at"))  # a file for each task
    own = Window.partitionBy("tree").orderBy("part")  # a row for each task that has leaves of the tree
    parts = stored.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own_n"))
    parts = parts.select(
        F.col("tree").alias("tree_"),
        F.col("part").alias("part_"),
        (F.coalesce(F.sum("own_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("ahead"),
        F.sum("own_n").over(Window.partitionBy("tree")).alias("n"),
    )
    met = stored.join(parts, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("part") == F.col("part_")))
    return met.withColumn("i", F.col("at") + F.col("ahead")).drop("part", "at", "tree_", "part_", "ahead")


# --- builders


def build_block(tree: str | None, n: int, base: int, nodes: list[tuple[int, str]]) -> list[tuple]:
    """NODE rows that the nodes (i, digest) of a block of level ``base`` complete, in order; those of level 0 are appended themselves."""
    wide, top = widths(n), min(height(n), base + LEVELS)
    block, out = nodes[0][0] // BLOCK, []
    open_runs: list[list[str]] = [[] for _ in range(top - base + 1)]
    for i, digest in nodes:
        level = base
        while True:
            if level > base or base == 0:
                out.append((tree, n, block, level, i, int(position(n, level, i)), digest, level == len(wide) - 1))
            if level == top:
                break
            run = open_runs[level - base]
            run.append(digest)
            if (i + 1) % ARITY and i + 1 < wide[level]:
                break
            digest = digest_of(run)
            run.clear()
            i //= ARITY
            level += 1
    return out


def as_batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(columns), columns, strict=True)], [n for n, _ in columns])


NODE_TYPES = [("tree", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("position", pa.int64()), ("digest", pa.string()), ("is_root", pa.bool_())]


def append_log(leaves: DataFrame) -> list[DataFrame]:
    """The log of the trees of ``leaves`` (tree, n, i, digest): one table for each round of builders."""
    nodes, base, rounds = leaves.select("tree", "n", "i", "digest"), 0, []

    def builder(base: int):
        def build(block: pa.Table) -> pa.Table:
            block = block.sort_by("i")
            tree, n = block.column("tree")[0].as_py(), block.column("n")[0].as_py()
            return as_batch(build_block(tree, n, base, list(zip(block.column("i").to_pylist(), block.column("digest").to_pylist(), strict=True))), NODE_TYPES)

        return build

    while True:
        grouped = nodes.withColumn("block", F.expr(f"i div {BLOCK}")).groupBy("tree", "block")
        rounds.append(through_table(grouped.applyInArrow(builder(base), NODE), "merkle-log"))
        base += LEVELS
        nodes = rounds[-1].where((F.col("level") == base) & ~F.col("is_root")).select("tree", "n", "i", "digest")
        if nodes.isEmpty():
            return rounds


@dataclass
class Manifest:
    """leaves: (tree, n, i, digest, doc_id, ...); log: its rounds; tops and top_log: the same of the roots of the trees."""

    leaves: DataFrame
    log: list[DataFrame]
    tops: DataFrame
    top_log: list[DataFrame]


def manifest(leaves: DataFrame) -> Manifest:
    """``leaves``: (tree, doc_id, digest) and further columns, which stay on the leaves."""
    own = through_table(ranked(leaves, [F.col("doc_id").asc_nulls_first()]), "merkle-ranked")
    log = append_log(own)
    roots = None
    for part in log:
        found = part.where("is_root").select("tree", "n", "digest")
        roots = found if roots is None else roots.unionByName(found)
    tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("own_n"), "digest")
    tops = through_table(ranked(tops, [F.col("name").asc_nulls_first()]), "merkle-tops")
    return Manifest(own, log, tops, append_log(tops))


# --- proofs


def block_runs(n: int, base: int, block: int, digest_at: dict[int, str]) -> list[tuple[int, list[list[str]]]]:
    """For each level of a block, from ``base`` to below its root: the first run's number and the digests of the runs, found by position."""
    out, wide = [], widths(n)
    for level in range(base, min(height(n), base + LEVELS)):
        low = block * ARITY ** (LEVELS - (level - base))
        high = min(low + ARITY ** (LEVELS - (level - base)), wide[level])
        found = [digest_at[int(p)] for p in position(n, level, np.arange(low, high))]
        out.append((low // ARITY, [found[k : k + ARITY] for k in range(0, len(found), ARITY)]))
    return out


def own_path(runs: list[tuple[int, list[list[str]]]], i: int) -> str:
    """The siblings of node ``i`` and of those above it in its block."""
    path = []
    for first, level in runs:
        run, place = level[i // ARITY - first], i % ARITY
        path += run[:place] + run[place + 1 :]
        i //= ARITY
    return "".join(path)


ABOVE_TYPES = [("tree", pa.string()), ("block", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("top_n", pa.int64()), ("top_i", pa.int64())]


def segment(log: list[DataFrame], r: int) -> DataFrame:
    """(tree, n, block, position, digest): what the blocks of round ``r`` need, its own nodes and those that its block roots came from."""
    own = log[r].select("tree", "n", "block", "position", "digest")
    if r == 0:
        return own
    below = log[r - 1].where((F.col("level") == r * LEVELS) & ~F.col("is_root"))
    return own.unionByName(below.select("tree", "n", F.expr(f"i div {BLOCK}").alias("block"), "position", "digest"))


def with_above(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes and, with no position, the row that says what is above a block."""
    return nodes.unionByName(above, allowMissingColumns=True)


def split_above(rows: pa.Table) -> tuple[dict, dict[int, str], int, int]:
    """What is above a block, its digests by position, its leaves and its number."""
    at = rows.column("position").to_pylist()
    where = at.index(None)
    digests = rows.column("digest").to_pylist()
    up = {c: rows.column(c)[where].as_py() for c in ("path", "subroot", "root", "top_n", "top_i")}
    n = next(x for x in rows.column("n").to_pylist() if x is not None)
    return up, {p: d for p, d in zip(at, digests, strict=True) if p is not None}, n, rows.column("block")[0].as_py()


def paths_below(log: list[DataFrame], r: int, above: DataFrame) -> DataFrame:
    """ABOVE of the blocks of round ``r - 1``: for each node that the blocks of round ``r`` were built from, its path to the root."""
    base = r * LEVELS

    def extract(rows: pa.Table) -> pa.Table:
        up, digest_at, n, block = split_above(rows)
        runs, tree = block_runs(n, base, block, digest_at), rows.column("tree")[0].as_py()
        low, high = block * BLOCK, min((block + 1) * BLOCK, widths(n)[base])
        return as_batch([(tree, i, own_path(runs, i) + up["path"], up["subroot"], up["root"], up["top_n"], up["top_i"]) for i in range(low, high)], ABOVE_TYPES)

    return with_above(segment(log, r), above).groupBy("tree", "block").applyInArrow(extract, ABOVE)


def top_paths(m: Manifest) -> DataFrame:
    """(tree, own_n, path, subroot, root, top_n, top_i) of each tree: from its root to the root of all."""
    last = m.top_log[-1].where("is_root").select(F.col("digest").alias("root"))
    start = F.broadcast(last)  # one row
    above = start.select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("block"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), "root", F.lit(None).cast("long").alias("top_n"), F.lit(None).cast("long").alias("top_i"))
    for r in range(len(m.top_log) - 1, 0, -1):
        above = through_table(paths_below(m.top_log, r, above), "merkle-paths")
    rows = with_above(segment(m.top_log, 0), above)

    def extract(tops: pa.Table, rows: pa.Table) -> pa.Table:
        up, digest_at, n, block = split_above(rows)
        runs = block_runs(n, 0, block, digest_at)
        out = [(name, own_n, own_path(runs, i) + up["path"], digest, up["root"], n, i) for name, own_n, digest, i in zip(*(tops.column(c).to_pylist() for c in ("name", "own_n", "digest", "i")), strict=True)]
        return as_batch(out, [("tree", pa.string()), ("own_n", pa.int64()), *ABOVE_TYPES[2:]])

    tops = m.tops.withColumn("block", F.expr(f"i div {BLOCK}")).groupBy("tree", "block")
    return through_table(tops.cogroup(rows.groupBy("tree", "block")).applyInArrow(extract, "tree string, own_n long, " + ABOVE.split("block long, ")[1]), "merkle-top-paths")


def rounds_of(n: Column) -> Column:
    """The round of builders that completes a tree of ``n`` leaves."""
    return F.coalesce(*(F.when(n <= BLOCK ** (r + 1), F.lit(r)) for r in range(6)))


def verified(m: Manifest, claimed: str = "digest") -> DataFrame:
    """The leaves of ``m`` with doc_id, subroot, root, proof_sha256, folded_root (of the column ``claimed``), verified and position."""
    tops, above = top_paths(m), None
    for r in range(len(m.log) - 1, -1, -1):
        ends = tops.where(rounds_of(F.col("own_n")) == r).drop("own_n").withColumn("block", F.lit(0).cast("long"))
        above = ends if above is None else above.unionByName(ends)
        if r:
            above = through_table(paths_below(m.log, r, above), "merkle-paths")
    rows = with_above(segment(m.log, 0), above)
    kind = dict(m.leaves.dtypes)["doc_id"]

    def prove(leaves: pa.Table, rows: pa.Table) -> pa.Table:
        up, digest_at, n, block = split_above(rows)
        runs, top_runs, out = block_runs(n, 0, block, digest_at), places(up["top_n"], up["top_i"]), []
        for doc_id, digest, claim, i in zip(*(leaves.column(c).to_pylist() for c in ("doc_id", "digest", "claim_", "i")), strict=True):
            path = own_path(runs, i) + up["path"]
            folded = fold(claim, places(n, i) + top_runs, path)
            out.append((doc_id, digest, up["subroot"], up["root"], hashlib.sha256(path.encode()).hexdigest(), folded, folded == up["root"], int(position(n, 0, i))))
        columns = [("doc_id", leaves.schema.field("doc_id").type), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_()), ("position", pa.int64())]
        return as_batch(out, columns)

    leaves = m.leaves.select("tree", F.expr(f"i div {BLOCK}").alias("block"), "i", "doc_id", "digest", F.col(claimed).alias("claim_")).groupBy("tree", "block")
    return leaves.cogroup(rows.groupBy("tree", "block")).applyInArrow(prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long")


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0  # a null id is not tampered with
    claim = F.when(hit, leaf(tampered(F.col("text")))).otherwise(leaf())
    leaves = docs.select(F.col("lang").alias("tree"), "doc_id", leaf().alias("digest"), claim.alias("claim"))
    return verified(manifest(through_table(leaves, "merkle-digests")), "claim")


def _sql(levels: int = 7, top_levels: int = 3) -> str:
    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # the checksum, bit by bit: -1 is a shift
    bits = "flatten(list_transform(range(1, len(s) + 1), lambda k: [CAST(ascii(s[k]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
    out = [
        f"d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, {leaf_sql('text')} AS leaf FROM documents)",
        f"l0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, CASE WHEN s IS NOT NULL AND {crc} % 3 = 0 THEN {leaf_sql(lower)} ELSE leaf END AS claim FROM d)",
        "n0 AS (SELECT lang AS tree, i, leaf AS d FROM l0)",
    ]

    def rise(k: int, prefix: str, keys: str) -> list[str]:
        return [
            f"{prefix}r{k} AS (SELECT {keys}, i // 8 AS run, list(d ORDER BY i) AS ds, sum(count(*)) OVER (PARTITION BY {keys}) AS total FROM {prefix}n{k} GROUP BY {keys}, i // 8)",
            f"{prefix}n{k + 1} AS (SELECT {keys}, run AS i, CASE WHEN total > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {prefix}r{k})",
        ]

    for k in range(levels):
        out += rise(k, "", "tree")
    out.append(f"tn0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, tree AS name, d FROM n{levels})")
    for k in range(top_levels):
        out += rise(k, "t", "tree")
    out.append("p0 AS (SELECT l.doc_id, l.lang, l.leaf, l.i, t.i AS t, t.d AS subroot, l.claim AS cur, '' AS path FROM l0 l JOIN tn0 t ON l.lang IS NOT DISTINCT FROM t.name)")
    at = 0
    for prefix, count in (("", levels), ("t", top_levels)):
        for k in range(count):
            i, key = ("p.i", "r.tree IS NOT DISTINCT FROM p.lang") if not prefix else ("p.t", "true")
            place = f"(({i} // {8**k}) % 8)"
            others = f"array_to_string(ds[1:{place}], '')", f"array_to_string(ds[{place} + 2:8], '')"
            out.append(f"p{at + 1} AS (SELECT p.doc_id, p.lang, p.leaf, p.i, p.t, p.subroot, CASE WHEN total > 1 THEN sha256({others[0]} || cur || {others[1]}) ELSE cur END AS cur, CASE WHEN total > 1 THEN path || {others[0]} || {others[1]} ELSE path END AS path FROM p{at} p JOIN {prefix}r{k} r ON {key} AND r.run = {i} // {8 ** (k + 1)})")
            at += 1
    # the nodes complete before a leaf: the leaves and, on each level, the full nodes
    place = "i" + "".join(f" + CASE WHEN size > {8 ** (k - 1)} THEN i // {8**k} ELSE 0 END" for k in range(1, levels + 1))
    root = f"(SELECT d FROM tn{top_levels})"
    return f"WITH {', '.join(out)}, sizes AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang) SELECT doc_id, leaf, subroot, {root} AS root, sha256(path) AS proof_sha256, cur AS folded_root, cur = {root} AS verified, CAST({place} AS BIGINT) AS position FROM p{at} JOIN sizes ON p{at}.lang IS NOT DISTINCT FROM sizes.lang"


QUERIES = {"op12_merkle_log": op12_merkle_log}
SQL = {"op12_merkle_log": _sql()}
