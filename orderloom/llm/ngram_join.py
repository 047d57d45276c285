"""N-gram Jaccard join: exact links between documents, found with signature trees.

1. Each text becomes the set of 64-bit hashes of its word shingles. Equal sets form one class; one row for each class goes on.
2. Blocks: two sets with Jaccard similarity t or more share a token among the first ``n - ceil(t n) + 1`` tokens in
   any one order of all tokens. Tokens whose hash cell is crowded in the corpus come last, so blocks stay small.
   (The cells are a table of fixed size, filled from all documents; its numbers only decide the order.)
3. First round: each class goes, with its text, to the largest of its blocks. A task holds a bounded part of a block, builds a
   signature tree over it (OR-combined token bitmaps, size ranges), finds by a dual traversal the pairs whose largest
   possible overlap is enough, compares those exactly and gives out links that join components: fewer than it has members.
   The first member of a block visits all of its parts and so ties them together.
4. Second round: blocks that still hold several components meet again in full, by their bitmaps alone. Large ones are cut into parts;
   parts of the block's largest component never meet each other. The traversal also drops pairs of nodes in one component. What is
   left falls into groups of possible links, which many blocks share and which are taken once. Their texts are fetched and compared
   as in the first round.

A pair is dropped only if its bound rules out a link or both sides are already connected: components are exact. What a task gives
out grows with its members, never with their pairs.

Edge cases: null or blank texts have an empty set and are linked with nothing; shorter texts than a shingle are one shingle;
repeated rows and equal ids are linked if their sets are equal and not empty; a null id takes part and is the largest; an
empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, own_columns, pieces, table, tasks_for, through_table, with_rows

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
CELLS = 1 << 18
SLICES = 64
#: The tasks whose counts of a slice are added up in one group; then the groups' sums are added.
SUM_GROUPS = 64
#: A token whose cell has more entries than this is dealt to several tasks.
CELL_ROWS = 1_000_000
#: A task holds parts of a block of about this many members and shingles.
PART, PART_SHINGLES = 512, 4_000_000
FANOUT = 8
#: Bytes of text that are hashed at once, and texts whose sets are held at once.
PIECE, TEXTS = 1 << 20, 500

# --- 1. sets


def _byte_table(places: int) -> np.ndarray:
    return mixed(np.arange(places << 8, dtype=np.uint64) + np.uint64(1))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads its input over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z")), np.arange(256) + 32, np.arange(256)).astype("u1")
PLACES = 64
BYTE_HASH = _byte_table(PLACES)


def piece_end(data: np.ndarray, at: int) -> int:
    """Where a piece of about PIECE bytes from ``at`` on ends, so that no word is cut."""
    end = at + PIECE
    if end >= len(data):
        return len(data)
    cut = np.flatnonzero(SEPARATOR[data[at:end]])
    if len(cut):
        return at + int(cut[-1]) + 1
    while end < len(data):  # a word longer than a piece
        cut = np.flatnonzero(SEPARATOR[data[end : end + PIECE]])
        if len(cut):
            return end + int(cut[0])
        end += PIECE
    return len(data)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all ``texts``, A-Z lower-cased, and the number of words of each text.

    A word's hash is the sum of random numbers for its bytes at their places.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), "i8")
    data = np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = piece_end(data, at)
        own = data[at:end]
        letter = ~SEPARATOR[own]
        start = letter.copy()
        start[1:] &= ~letter[:-1] | first[at + 1 : end]
        where = np.flatnonzero(letter)
        if len(where):
            heads = np.flatnonzero(start)
            word = np.cumsum(start)[where] - 1
            place = where - heads[word]
            key = place << 8 | LOWER[own[where]]
            value = BYTE_HASH[np.minimum(key, len(BYTE_HASH) - 1)]
            if len(far := np.flatnonzero(place >= PLACES)):
                value[far] = mixed(key[far].astype(np.uint64) + np.uint64(1))
            hashes.append(mixed(np.add.reduceat(value, np.flatnonzero(start[where]))))
            begins.append(heads + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), "i8")
    owner = np.searchsorted(offsets, np.concatenate(begins), "right") - 1
    return np.concatenate(hashes), np.bincount(owner, minlength=len(texts))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k word hashes."""
    out = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
    for i in range(k):
        out = mixed(out ^ h[i : len(h) - k + 1 + i])
    return out


def shingle_sets(texts: pa.Array | list, n: int = SHINGLE) -> list[np.ndarray]:
    """For each whole text, the sorted distinct 64-bit hashes of its word n-grams."""
    h, counts = word_hashes(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))
    rolled = rolling(h, n) if len(h) >= n else np.zeros(0, np.uint64)
    out, at = [], 0
    for c in counts.tolist():
        x = np.sort(rolled[at : at + c - n + 1] if c >= n else rolling(h[at : at + c], c) if c else h[:0])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
        at += c
    return out


def overlap_needed(a, b, percent: int = PERCENT):
    """The least intersection with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def width_of(size: int) -> int:
    """Bits of a signature: a power of two over twice the size of the set."""
    return 1 << min(16, max(6, int(np.ceil(np.log2(2.5 * max(size, 1))))))


def bitmap(s: np.ndarray) -> bytes:
    width = width_of(len(s))
    bits = np.zeros(width, bool)
    bits[((s >> np.uint64(20)) % np.uint64(width)).astype("i8")] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A signature in fewer bytes: its halves are combined until it fits."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """One pass over the texts: a row (row, doc_id, size, digest, bits) for each document; and a row with
    row null for each slice of each task's cell counts, in bits, with the slice in size and the task in doc_id."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "size", "digest", "bits"]
        cells = np.zeros(CELLS, "i8")
        for part in (p for batch in batches for p in pieces(batch, TEXTS, PIECE)):
            found = shingle_sets(part.column("text"), n)
            np.add.at(cells, (np.concatenate(found) % np.uint64(CELLS)).astype("i8"), 1)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array(digests, pa.binary()), pa.array([bitmap(s) for s in found], pa.binary())], names)
        parts = [c.astype("<i4").tobytes() for c in cells.reshape(SLICES, -1)]
        task = pa.array([TaskContext.get().partitionId()] * SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), task, pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(parts, pa.binary())], names)

    rows = docs.select("row", F.col("doc_id").cast("long"), "text")
    return through_table(rows.mapInArrow(sets, "row long, doc_id long, size long, digest binary, bits binary"), "join-sets")


def cell_counts(made: DataFrame) -> np.ndarray:
    """The entries of each hash cell, over all documents. They are added up in two levels, so that no group has a row of every task."""

    def add(entry: str):
        def run(parts: pa.Table) -> pa.Table:
            total = np.zeros(CELLS // SLICES, "i8")
            for x in parts.column("bits"):
                total += np.frombuffer(x.as_py(), entry)
            return pa.table({"size": parts.column("size")[:1], "bits": pa.array([total.astype("<i8").tobytes()], pa.binary())})

        return run

    of_tasks = made.where("row is null").select("size", F.pmod("doc_id", F.lit(SUM_GROUPS)).alias("g"), "bits")
    sums = of_tasks.groupBy("size", "g").applyInArrow(add("<i4"), "size long, bits binary")
    got = sums.groupBy("size").applyInArrow(add("<i8"), "size long, bits binary").collect()  # SLICES rows of fixed size
    cells = np.zeros((SLICES, CELLS // SLICES), "i8")
    for r in got:
        cells[r["size"]] = np.frombuffer(r["bits"], "<i8")
    return cells.ravel()


def classes(made: DataFrame) -> DataFrame:
    """(row, doc_id, size, cls): documents with equal sets have the class of the first of them; null without a set."""
    rows = made.where("row is not null").select("row", "doc_id", "size", "digest")
    # a table, so that a large group of copies on the other side can be split
    first = through_table(rows.where("size > 0").groupBy("digest").agg(F.min("row").alias("cls")), "join-digests")
    return through_table(rows.join(first, "digest", "left").withColumn("cls", F.when(F.col("size") > 0, F.col("cls"))).drop("digest"), "join-classes")


# --- 2. blocks


def block_rows(texts: DataFrame, cells: np.ndarray, n: int, percent: int, own: DataFrame | None = None) -> DataFrame:
    """(token, salt, cls, size): each class of ``texts`` (cls, text), or those of them in ``own`` (cls), with the tokens of its prefix.
    Tokens of very full cells have salts from 1 on, others 0."""
    # how crowded each cell is: 0 up to twice the mean, then the binary logarithm of the ratio
    crowded = np.floor(np.log2(np.maximum(cells / max(1.0, cells.mean()), 1.0))).astype("u1")
    split = np.where(cells > CELL_ROWS, cells // CELL_ROWS + 1, 0).astype("u4")
    shared = texts.sparkSession.sparkContext.broadcast((crowded, split))  # CELLS rows

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, salts = shared.value
        for part in (p for batch in batches for p in pieces(batch, TEXTS, PIECE)):
            tokens, sizes = [], []
            for s in shingle_sets(part.column("text"), n):
                keep = len(s) - -(-percent * len(s) // 100) + 1
                # by crowding, then by hash; the set is sorted by hash already
                tokens.append(s[np.argsort(last[(s % np.uint64(CELLS)).astype("i8")], kind="stable")[:keep]])
                sizes.append(len(s))
            flat, offsets = np.concatenate(tokens), pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
            cls = np.repeat(part.column(0).to_numpy(), np.diff(offsets))
            ways = salts[(flat % np.uint64(CELLS)).astype("i8")].astype(np.uint64)
            salt = np.where(ways > 0, mixed(cls.astype(np.uint64)) % np.maximum(ways, np.uint64(1)) + np.uint64(1), np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat.view("i8"))), pa.ListArray.from_arrays(offsets, pa.array(salt.astype("i4")))],
                ["cls", "size", "tokens", "salts"],
            )

    rows = texts.select("cls", "text").mapInArrow(prefixes, "cls long, size int, tokens array<long>, salts array<int>")
    # prefixes are joined, not texts: a fifth of the tokens take less to shuffle than all words
    rows = rows.join(own.hint("merge"), "cls") if own is not None else rows
    return rows.select("cls", "size", "salts", F.posexplode("tokens").alias("at", "token")).select("token", F.get("salts", "at").alias("salt"), "cls", "size")


def shared_tokens(blocks: DataFrame) -> DataFrame:
    """(token, cls, size, n): the rows of ``blocks`` whose token another class may have, n telling how many."""
    found = blocks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token", "salt")))
    return through_table(found.where("n > 1 or salt > 0").drop("salt"), "join-blocks")


def home_groups(shared: DataFrame) -> DataFrame:
    """(g, h, cls, comp): each class in a part of its largest block, and the block's first member in all of its parts."""
    homes = shared.groupBy("cls").agg(F.max(F.struct("n", "token")).alias("home"), F.first("size").alias("size"))
    homes = through_table(homes.select("cls", "size", F.col("home.token").alias("g")), "join-homes")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum("size") / PART_SHINGLES))
    blocks = homes.groupBy("g").agg(F.count(F.lit(1)).alias("members"), parts.alias("parts"), F.min("cls").alias("pivot")).where("members > 1")
    # a table, so that the members of a large block can be split
    blocks = through_table(blocks.select("g", "parts", "pivot"), "join-homes")
    own = homes.join(blocks, "g").where("cls <> pivot").select("g", F.pmod(F.xxhash64("cls"), "parts").alias("h"), "cls")
    first = blocks.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("h"), F.col("pivot").alias("cls"))
    return own.union(first).withColumn("comp", F.col("cls"))


# --- 3. signature trees


class Tree:
    """A signature tree: on each level, for each node, OR-combined bitmaps, the range of sizes, the component if there is
    only one (else -1), and the most tokens of a member that share a bit with another one of its tokens."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, comps: np.ndarray, near: np.ndarray):
        self.order = np.lexsort((sizes, near))  # members with equal ``near`` are likely alike
        extra = sizes - np.bitwise_count(bits).sum(1, dtype="i8")
        self.levels = [(bits[self.order], sizes[self.order], sizes[self.order], comps[self.order], extra[self.order])]
        while len(self.levels[-1][0]) > 1:
            b, least, most, comp, extra = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            low, high = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            self.levels.append((np.bitwise_or.reduceat(b, at, 0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.where(low == high, low, -1), np.maximum.reduceat(extra, at)))

    def __len__(self):
        return len(self.order)


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Could a member of node i of level ``a`` and one of node j of level ``b`` link, and are they in different components?

    Tokens that two sets share fall on bits that both have, and at most ``extra`` of them on a bit that another one has taken.
    """
    (bits_a, least_a, most_a, comp_a, extra_a), (bits_b, least_b, most_b, comp_b, extra_b) = a, b
    good = (100 * most_a[i] >= percent * least_b[j]) & (100 * most_b[j] >= percent * least_a[i])
    good &= (comp_a[i] < 0) | (comp_a[i] != comp_b[j])
    at = np.flatnonzero(good)
    for k in range(0, len(at), 16_384):
        own = at[k : k + 16_384]
        x, y = i[own], j[own]
        both = np.bitwise_count(bits_a[x] & bits_b[y]).sum(1, dtype="i8") + np.minimum(extra_a[x], extra_b[y])
        # of sets within these ranges, the smallest need the least; neither is less than its own share of the other
        need = np.maximum(overlap_needed(least_a[x], least_b[y], percent), -(-percent * np.maximum(least_a[x], least_b[y]) // 100))
        good[own] = both >= need
    return good


def tree_pairs(a: Tree, b: Tree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Members of a and of b, in different components, whose link cannot be ruled out. With a tree and itself, each pair once."""
    same = a is b
    level_a, level_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, "i8"), np.zeros(1, "i8")

    def down(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        children = x[:, None] * FANOUT + np.arange(FANOUT)
        real = (children < count).ravel()
        return children.ravel()[real], np.repeat(y, FANOUT)[real]

    while True:
        keep = possible(a.levels[level_a], b.levels[level_b], i, j, percent)
        if same and level_a:  # a node meets itself for the sake of its children
            keep |= (i == j) & (a.levels[level_a][3][i] < 0)
        i, j = i[keep], j[keep]
        if not level_a and not level_b:
            return a.order[i], b.order[j]
        if same:
            level_a = level_b = level_a - 1
            i, j = down(i, j, len(a.levels[level_a][0]))
            j, i = down(j, i, len(a.levels[level_a][0]))
            once = i < j if not level_a else i <= j
            i, j = i[once], j[once]
        elif level_a >= level_b:
            level_a -= 1
            i, j = down(i, j, len(a.levels[level_a][0]))
        else:
            level_b -= 1
            j, i = down(j, i, len(b.levels[level_b][0]))


def candidates(sizes: np.ndarray, bitmaps: list[bytes], comps: np.ndarray, near: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of different components that may link. Sets that link have bitmaps of one width or of the next one:
    there is a tree for each width, and one for the folded bitmaps of the next width that it meets."""
    widths = np.array([len(b) for b in bitmaps])
    for width in np.unique(widths).tolist():
        own, next_ = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        tree = Tree(sizes[own], np.stack([np.frombuffer(bitmaps[k], "u1") for k in own]), comps[own], near[own])
        x, y = tree_pairs(tree, tree, percent)
        yield own[x], own[y]
        if len(next_):
            x, y = tree_pairs(tree, Tree(sizes[next_], np.stack([folded(np.frombuffer(bitmaps[k], "u1"), width) for k in next_]), comps[next_], near[next_]), percent)
            yield own[x], next_[y]


def group_links(sets: list[np.ndarray], comps: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Exact links between members, each of which joins two components."""
    sizes = np.array([len(s) for s in sets])
    root = np.unique(comps, return_inverse=True)[1]
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    own = np.zeros(int(tokens.max(initial=0)) + 1, bool)
    out = []
    # smallest hashes are equal for most sets that link
    near = root if root.max(initial=0) + 1 < len(root) else np.array([s[0] for s in sets])
    for x, y in candidates(sizes, [bitmap(s) for s in sets], root, near, percent):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        cuts = [*np.flatnonzero(np.diff(x, prepend=-1)).tolist(), len(x)]
        for head, end in zip(cuts, cuts[1:], strict=False):
            i, js = int(x[head]), y[head:end]
            js = js[root[js] != root[i]]
            if not len(js):
                continue
            own[tokens[begins[i] : begins[i + 1]]] = True
            for j in js.tolist():
                if root[j] != root[i]:
                    both = int(own[tokens[begins[j] : begins[j + 1]]].sum())
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        out.append((i, j))
                        root[root == root[j]] = root[i]
            own[tokens[begins[i] : begins[i + 1]]] = False
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``keys`` columns, as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[begin]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def edge_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def linked(groups: DataFrame, texts: DataFrame, n: int, percent: int, tasks: int) -> DataFrame:
    """(a, b): links between components of each group (g, h, cls, comp), written once. ``texts``: (cls, text)."""
    # one join with the texts, of one kind at every size
    met = texts.join(groups.hint("merge"), "cls").repartition(tasks, "g", "h").sortWithinPartitions("g", "h", "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 2):
            cls = group.column("cls").to_numpy()
            sets = [s for batch in group.to_batches() for part in pieces(batch, TEXTS, PIECE) for s in shingle_sets(part.column("text"), n)]
            found = group_links(sets, group.column("comp").to_numpy(), percent)
            yield edge_batch([int(cls[i]) for i, _ in found], [int(cls[j]) for _, j in found])

    return through_table(met.select("g", "h", "cls", "comp", "text").mapInArrow(compare, "a long, b long"), "join-links")


# --- 4. what is left


def open_cells(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(token, i, j, cls, size, comp): members of blocks with several components, in pairs of bounded parts."""
    rows = shared.drop("n").join(comps.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("c", "cls")).drop("c")
    rows = through_table(rows, "join-labelled")
    # blocks of the same members (the tokens of one shared passage) have the same pairs: one of them is enough
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.sum(F.xxhash64("cls", F.lit(1)).cast("decimal(38,0)")).alias("y")]
    several = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *members).where("low <> high")
    several = several.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")
    several = through_table(several, "join-open")
    rows = through_table(rows.join(several, "token"), "join-open-rows")
    load = F.greatest(F.col("n") / PART, F.col("s") / PART_SHINGLES)
    counted = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).withColumn("load", load)
    blocks = counted.groupBy("token").agg(F.max(F.struct("load", "comp")).alias("main"), F.sum("load").alias("all"))
    blocks = blocks.select(
        "token",
        F.col("main.comp").alias("main"),
        F.when(F.col("all") <= 1, 0).otherwise(F.ceil("main.load")).cast("int").alias("mains"),
        F.when(F.col("all") <= 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("main.load")))).cast("int").alias("others"),
    )
    placed = rows.join(through_table(blocks, "join-open"), "token")
    in_main = (F.col("mains") > 0) & (F.col("comp") == F.col("main"))
    placed = placed.withColumn("own", F.when(in_main, F.pmod(F.xxhash64("cls"), F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(F.xxhash64("cls"), "others")).cast("int"))
    # parts are numbered with those of the block's largest component first, which do not meet each other
    placed = placed.withColumn("met", F.explode(F.sequence(F.when(in_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)))
    return placed.select("token", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "cls", "size", "comp")


def open_groups(cells: DataFrame, signatures: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(g, h, cls, comp): members of each cell that possible links between different components connect."""
    met = cells.join(signatures, "cls").repartition(tasks, "token", "i", "j").sortWithinPartitions("token", "i", "j", "cls")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, 3):
            cls, comp = cell.column("cls").to_numpy(), cell.column("comp").to_numpy()
            sizes, bitmaps = cell.column("size").to_numpy().astype("i8"), cell.column("bits").to_pylist()
            root = np.arange(len(cls))
            own = np.unique(comp, return_inverse=True)[1]
            for x, y in candidates(sizes, bitmaps, own, own, percent):
                root = joined(root, x, y)
            keep, order = np.bincount(root, minlength=len(root))[root] > 1, np.argsort(root, kind="stable")
            order = order[keep[order]]
            cuts = np.flatnonzero(np.diff(root[order], prepend=-1))
            offsets = pa.array([*cuts.tolist(), len(order)], pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(cls[order]), pa.array(comp[order])], ["cls", "comp"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pairs)], ["members"])

    # at most two parts' members in an array
    groups = met.select("token", "i", "j", "cls", "size", "comp", "bits").mapInArrow(traverse, "members array<struct<cls: long, comp: long>>")
    groups = groups.withColumns({"g": F.xxhash64("members"), "h": F.xxhash64("members", F.lit(1))})
    groups = groups.groupBy("g", "h").agg(F.first("members").alias("members"))
    return through_table(groups.select("g", "h", F.explode("members").alias("m")).select("g", "h", "m.cls", "m.comp"), "join-candidates")


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member that each member reaches over ``root`` and the pairs (x, y)."""
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    return root


# --- components


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of ``edges`` (a, b) reaches. Alternating large and small stars."""
    spark = edges.sparkSession
    now = through_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("v", "u")) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least")).select("u", "m")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()

    before = state(now)
    while before[0]:
        now = through_table(star(star(now, True), False), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("u")).distinct().withColumn("v", F.col("u"))
    return spark.createDataFrame([], "v long, c long").union(now.union(roots).groupBy("u").agg(F.min("v")))


# --- the join


def class_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, size, cls) for every document, and (v, c) for the classes that link with others. ``docs``: row, doc_id, text."""
    tasks = tasks_for(docs.sparkSession)
    made = document_sets(docs, n)
    known = classes(made)
    own = known.where("row = cls").select("row")
    texts = docs.select(F.col("row").alias("cls"), "text")
    blocks = block_rows(texts, cell_counts(made), n, percent, own.select(F.col("row").alias("cls")))
    shared = shared_tokens(blocks)
    near = linked(home_groups(shared), texts, n, percent, tasks)
    first = through_table(components(near), "join-components")
    signatures = made.where("row is not null").select(F.col("row").alias("cls"), "bits")
    late = linked(open_groups(open_cells(shared, first), signatures, percent, tasks), texts, n, percent, tasks)
    return known, through_table(components(near.union(late)), "join-components")


def jaccard_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); ``row`` names a column made by ``with_rows``, if there is one."""
    docs = docs.select(F.col(row).alias("row"), "doc_id", "text") if row else with_rows(docs.select("doc_id", "text"))
    known, found = class_components(docs, n, percent)
    least = known.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("d"))
    least = through_table(least.join(found.withColumnRenamed("v", "cls"), "cls", "left").withColumn("c", F.coalesce("c", "cls")), "join-least")
    # tables, so that the rows of a large component can be split
    named = through_table(least.groupBy("c").agg(F.min("d").alias("component_id")), "join-named")
    named = through_table(least.join(named, "c").select("cls", "component_id"), "join-named")
    out = known.join(named, "cls", "left")
    return out.select("row", "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(with_rows(table(spark, sf_dir, "documents")), row="row").select("doc_id", "n_shingles", "component_id")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """One document of each component: the one with the smallest id (of equal rows, the first). Blank texts all stay."""
    row = free_name(docs, "row")
    numbered = with_rows(docs, row)
    found = jaccard_components(numbered, row=row)
    keep = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row")).alias("first")).select("first.row")
    keep = keep.union(found.where("n_shingles = 0").select("row")).withColumnRenamed("row", row)
    return numbered.join(keep, row).select(*own_columns(docs))


QUERIES = {"op8_ngram_join": op8_ngram_join}
SQL: dict[str, str] = {}
