"""Exact n-gram Jaccard join with count-vector R-trees.

Two texts link when their sets of word shingles have a Jaccard similarity of at least ``percent`` hundredths.

* Only sets of which other documents have most shingles can link: hashes of all shingles meet in buckets first, and what
  is left are near copies and texts made of common passages.
* Shingles are hashed, and equal ranges of the hash space are groups. Similar sets differ in few shingles, so of somewhat
  more ranges than they may differ in, at least one range holds the same shingles in both. Every set is announced under
  its ranges; sets that share none cannot link. What shares ranges, directly or through others, is a family.
* Within a family, the numbers of shingles in 64 groups are a set's point in an R-tree. The sum of the smaller coordinates
  bounds the overlap of two sets, and with a node's largest coordinates that of a set and all sets below the node.
  Pairs that pass the bound are verified on the sets.
* Equal sets are folded first. Large families are cut into blocks by the sizes of the sets, and every pair of blocks whose
  sizes allow a link is a task; a task returns the links that hold its parts together, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridsignal.llm import blobs
from gridsignal.llm.blobs import bounded_records, mix, text_bytes
from gridsignal.llm.exchange import bits_of, cut_keys, key_bits, shared_masks, with_masks
from gridsignal.llm.graph import components
from gridsignal.llm.shingles import shingle_sets
from gridsignal.session import settle

WORDS = 4
PERCENT = 85
GROUPS = 64
LEAF = 32
BLOCK = 8192  # sets of a block, where these have ``SHINGLES`` shingles at most; fewer of larger ones
SHINGLES = 1024
FLUSH_KEYS = 1 << 20
BUCKET_BYTES = 40 << 20
LEAST_BUCKETS = 128  # about the ranges of a text: more buckets do not repeat a pair more often

META = "doc_id long, n long, h1 long, h2 long, text string, id long"
SIGNATURES = "bucket int, keys binary, docs binary"


def texts_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    return bounded_records(docs).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def sets_of(rows: pa.RecordBatch | pa.Table, column: int = 1, words: int = WORDS) -> list[np.ndarray]:
    """Shingle sets of a batch, a few megabytes of text at a time."""
    data, offsets = text_bytes(rows.column(column))
    out, begin = [], 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + (1 << 20), "right")) - 1)
        out += shingle_sets(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], words)
        begin = end
    return out


# ---- what can link -------------------------------------------------------------------------------------------------


class Ranges:
    """Size classes and their numbers of hash ranges, for one threshold."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.spread = Fraction(2 * (100 - percent), 100 + percent)  # of two sets of one size: differing shingles to size

    def bounds(self, n: int) -> tuple[int, int]:
        """First size of the class of ``n`` and of the next one: powers of the square root of two, at least one apart."""
        k = max(0, math.floor(2 * math.log2(n)))
        while self.first(k + 1) <= n:
            k += 1
        while self.first(k) > n:
            k -= 1
        return self.first(k), self.first(k + 1)

    @staticmethod
    def first(k: int) -> int:
        return max(k + 1 if k < 4 else 0, math.isqrt(1 << k)) if k >= 0 else 0

    def differ(self, below: int) -> int:
        """In how many shingles two linked sets can differ when the larger has fewer than ``below``."""
        return math.floor(self.spread * (below - 1))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Hashes of the ranges under which a set is announced: those of its own size class, and those of larger ones
        while a set of that class could link to it. Poor ranges, with few shingles, are left out as far as the count allows: of
        two linked sets, one shared range is announced by both."""
        above = self.bounds(len(shingles))[1]
        found = [self.class_keys(shingles, above)]
        while 100 * len(shingles) >= self.percent * above:
            above = self.bounds(above)[1]
            found.append(self.class_keys(shingles, above))
        return np.concatenate(found)

    def class_keys(self, shingles: np.ndarray, below: int) -> np.ndarray:
        differ = self.differ(below)
        spare = -(-differ // 10)
        ranges = differ + 1 + spare
        width = (1 << 64) // ranges + 1
        edges = np.array([i * width for i in range(1, ranges)], dtype=np.uint64)
        at = np.concatenate([[0], np.searchsorted(shingles, edges), [len(shingles)]])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        counts = np.diff(at)
        least = next(c for c in (2, 1, 0) if (counts < c).sum() <= spare)
        chosen = np.flatnonzero(counts >= least)
        content = sums[at[chosen + 1]] - sums[at[chosen]]
        return mix(content + mix(chosen.astype(np.uint64) + np.uint64(below << 20)))


def candidate_edges(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """``u, v``: pairs of documents that hold together all that share a range."""
    ranges = Ranges(percent)
    raw = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(raw / BUCKET_BYTES))

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, owners, held, number
            key, owner = np.concatenate(keys), np.concatenate(owners)
            heads, hubs, edges = fold(key, owner)
            cut = blobs.bucket_edges(heads, buckets)
            filled = np.flatnonzero(np.diff(cut)).tolist()
            rows = {
                "bucket": filled + [-1 - number % buckets],
                "keys": [blobs.pack_sorted(heads[cut[b] : cut[b + 1]]) for b in filled] + [blobs.pack(edges[0])],
                "docs": [blobs.pack(hubs[cut[b] : cut[b + 1]]) for b in filled] + [blobs.pack(edges[1])],
            }
            keys, owners, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array(rows["bucket"], pa.int32()), "keys": pa.array(rows["keys"], pa.binary()), "docs": pa.array(rows["docs"], pa.binary())
            })

        for rows in batches:
            for doc_id, shingles in zip(rows.column(0).to_pylist(), sets_of(rows, words=words)):
                if len(shingles) and doc_id is not None:
                    keys.append(ranges.keys(shingles))
                    owners.append(np.full(len(keys[-1]), doc_id, np.int64))
                    held += len(keys[-1])
                    if held >= FLUSH_KEYS:
                        yield flush()
        if held:
            yield flush()

    def meet(key: tuple, parts: pa.Table) -> pa.Table:
        left = [blobs.unpack_sorted(b) if key[0].as_py() >= 0 else blobs.unpack(b, np.int64) for b in parts["keys"].to_pylist()]
        right = np.concatenate([blobs.unpack(b, np.int64) for b in parts["docs"].to_pylist()])
        left = np.concatenate(left)
        u, v = fold(left, right)[2] if key[0].as_py() >= 0 else (left, right)
        pairs = np.unique(np.column_stack([u, v]), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    return docs.mapInArrow(announce, SIGNATURES).groupBy("bucket").applyInArrow(meet, "u long, v long")


def fold(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys, the smallest owner of each, and edges from the other owners to it."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]])
    hub = owners[head][np.cumsum(head) - 1]
    other = owners != hub
    pairs = np.unique(np.column_stack([owners[other], hub[other]]), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return keys[head], owners[head], (np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))


# ---- what does link ------------------------------------------------------------------------------------------------


class Tree:
    """R-tree over points of group counts. Leaves hold ``LEAF`` points; a node keeps its largest coordinates and sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int) -> None:
        self.counts, self.sizes, self.percent = counts, sizes, percent
        self.left = np.ones(len(sizes), bool)
        order = self.tiles(np.arange(len(sizes)), 0)
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.upper = np.array([counts[x].max(axis=0) for x in self.leaves])
        self.low = np.array([sizes[x].min() for x in self.leaves])
        self.high = np.array([sizes[x].max() for x in self.leaves])
        self.nodes = [slice(i, i + LEAF) for i in range(0, len(self.leaves), LEAF)]
        self.node_upper = np.array([self.upper[x].max(axis=0) for x in self.nodes])
        self.node_low = np.array([self.low[x].min() for x in self.nodes])
        self.node_high = np.array([self.high[x].max() for x in self.nodes])

    def tiles(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Order points so that runs of them lie close together: halves by size first, then by one coordinate each."""
        if len(rows) <= LEAF:
            return rows
        by = self.sizes[rows] if depth < 2 else self.counts[rows, (depth - 2) % self.counts.shape[1]]
        rows = rows[np.argsort(by, kind="stable")]
        middle = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF
        return np.concatenate([self.tiles(rows[:middle], depth + 1), self.tiles(rows[middle:], depth + 1)])

    def may_link(self, point: np.ndarray, size: int, upper: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        p = self.percent
        fits = (100 * high >= p * size) & (p * low <= 100 * size)
        overlap = np.minimum(upper, point).sum(axis=1, dtype=np.int64)
        return fits & ((100 + p) * overlap >= p * (size + np.maximum(low, -(-p * size // 100))))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points still in the tree whose bound lets them link to ``point``."""
        found = []
        for node in np.flatnonzero(self.may_link(point, size, self.node_upper, self.node_low, self.node_high)):
            part = self.nodes[node]
            for leaf in np.flatnonzero(self.may_link(point, size, self.upper[part], self.low[part], self.high[part])) + part.start:
                rows = self.leaves[leaf]
                rows = rows[self.left[rows]]
                if len(rows):
                    found.append(rows[self.may_link(point, size, self.counts[rows], self.sizes[rows], self.sizes[rows])])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def group_counts(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=GROUPS)


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that hold together what links hold together: a search from every set among the sets not yet reached."""
    sizes = np.array([len(s) for s in sets], np.int64)
    counts = np.array([group_counts(s) for s in sets])
    tree = Tree(counts, sizes, percent)
    links = []
    for start in range(len(sets)):
        if not tree.left[start]:
            continue
        tree.left[start] = False
        waiting = [start]
        while waiting:
            x = waiting.pop()
            near = tree.search(counts[x], int(sizes[x]))
            if not len(near):
                continue
            joined = np.concatenate([sets[y] for y in near])
            at = np.minimum(np.searchsorted(sets[x], joined), len(sets[x]) - 1)
            common = np.add.reduceat((sets[x][at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            for y in near[(100 + percent) * common >= percent * (sizes[x] + sizes[near])].tolist():
                links.append((y, x))
                tree.left[y] = False
                waiting.append(y)
    return links


def placed_by_size(members: DataFrame, percent: int) -> DataFrame:
    """``doc_id, family, own, first, last``: the block of every member of a family, and the blocks it can link to.

    ``members`` has ``doc_id, family, n``. A family is laid out by the sizes of its sets and cut into blocks, so that a block
    meets only the few others whose sizes allow a link, and a text is sent that often.
    """
    weight, room = F.greatest("n", F.lit(SHINGLES)), F.lit(BLOCK * SHINGLES)
    whole, below = W.partitionBy("family"), W.partitionBy("family").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    sizes = members.groupBy("family", "n").agg(F.count("*").alias("same")).withColumns({
        "before": F.coalesce(F.sum(F.col("same") * weight).over(below), F.lit(0)), "members": F.sum("same").over(whole)}).where("members > 1")
    block = lambda at: F.floor((F.col("before") + at * weight) / room).cast("int")
    blocks = sizes.withColumn("own", F.explode(F.sequence(block(F.lit(0)), block(F.col("same") - 1))))
    blocks = blocks.groupBy("family", "own").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select("family", F.col("own").alias("k"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    fits = (100 * F.col("high") >= percent * F.col("other_low")) & (100 * F.col("other_high") >= percent * F.col("low"))
    reach = blocks.join(other, "family").where(fits).groupBy("family", "own").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    place = F.pmod(F.xxhash64("doc_id"), F.col("same"))
    placed = members.join(sizes, ["family", "n"]).withColumn("own", block(place))
    return placed.join(reach, ["family", "own"]).select("doc_id", "family", "own", "first", "last")


def verified_links(docs: DataFrame, members: DataFrame, percent: int, words: int) -> DataFrame:
    """``u, v``: links within families. ``members`` has ``doc_id, family``."""
    placed = placed_by_size(members.join(docs.select("doc_id", "n"), "doc_id").distinct(), percent).distinct()
    alone = F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j")))
    pairs = F.transform(F.sequence("first", "last"), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    pairs = F.filter(pairs, lambda p: p["i"] != p["j"])
    # the same plan at every size: Spark would broadcast the members of a small corpus only
    tasks = docs.join(placed.hint("shuffle_merge"), "doc_id").withColumn("pair", F.explode(F.when(F.col("first") == F.col("last"), alone).otherwise(pairs)))
    tasks = tasks.select("family", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "doc_id", "text")
    tasks = tasks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "doc_id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            found = spanning_links(sets, percent) if len(sets) > 1 else []
            if found:
                yield pa.RecordBatch.from_pydict({"u": pa.array([ids[a] for a, _ in found], pa.int64()), "v": pa.array([ids[b] for _, b in found], pa.int64())})

        for rows in batches:
            keys = zip(*(rows.column(c).to_pylist() for c in range(3)))
            for key, doc_id, shingles in zip(keys, rows.column(3).to_pylist(), sets_of(rows, 4, words)):
                if key != now:
                    yield from close()
                    now, ids, sets = key, [], []
                if len(shingles):
                    ids.append(doc_id)
                    sets.append(shingles)
        yield from close()

    return tasks.mapInArrow(link, "u long, v long")


def row_numbers(batch: int, rows: int) -> np.ndarray:
    """Numbers of a batch's rows that no other row has: the task that wrote the batch, the batch in it, and the row."""
    return (((batch >> 32) << 40) | ((batch & 0x3FFFFF) << 18)) + np.arange(rows, dtype=np.int64)


def batch_of(number: Column) -> Column:
    """The batch of a ``row_numbers`` number."""
    return F.shiftleft(F.shiftright(number, 40), 32).bitwiseOR(F.shiftright(number, 18).bitwiseAND(F.lit(0x3FFFFF).cast("long")))


def set_facts(batches: DataFrame, percent: int, words: int, id: str = "doc_id", text: str = "text", by_row: bool = False) -> DataFrame:
    """``doc_id, n, h1, h2, text, id``, settled: the size of every document's set and two sums of hashes that stand for its
    content. The text is kept where other documents have enough of the set's shingles for a link. ``doc_id`` is the id, or
    with ``by_row`` a number of the row, which no other row has."""
    raw = batches.agg(F.sum("raw")).first()[0] or 0
    buckets, bits = blobs.bucket_count(batches), key_bits(raw)

    def opened(blob: bytes) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]:
        table = blobs.unseal(blob)
        sets = sets_of(table, table.schema.get_field_index(text), words)
        keys = cut_keys(mix(np.concatenate([*sets, np.zeros(0, np.uint64)])), bits)
        return table, sets, *np.unique(keys, return_inverse=True)

    def keys_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        _, _, distinct, number = opened(blob)
        return distinct, np.bincount(number, minlength=len(distinct)) > 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for r in part.to_pylist():
                table, sets, distinct, number = opened(r["blob"])
                sizes = np.array([len(s) for s in sets], np.int64)
                shared = np.concatenate([[0], np.cumsum(bits_of(r["masks0"], distinct, buckets)[number])])
                ends = np.cumsum(sizes)
                enough = (sizes > 0) & (100 * (shared[ends] - shared[ends - sizes]) >= percent * sizes)
                total = lambda salt: [int(np.sum(mix(s ^ np.uint64(salt)), dtype=np.uint64).astype(np.int64)) for s in sets]  # noqa: B023, E731
                kept = pc.if_else(pa.array(enough), pc.cast(table[text].combine_chunks(), pa.string()), pa.scalar(None, pa.string()))
                ids = pc.cast(table[id].combine_chunks(), pa.int64())
                node = pa.array(row_numbers(r["batch"], len(sizes))) if by_row else ids
                yield pa.RecordBatch.from_arrays(
                    [node, pa.array(sizes), pa.array(total(0x1234567), pa.int64()), pa.array(total(0x89ABCDE), pa.int64()), kept, ids],
                    names=["doc_id", "n", "h1", "h2", "text", "id"],
                )

    return settle(with_masks(batches, shared_masks(batches, keys_of, buckets)).mapInArrow(run, META))


def join_components(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the component is the smallest id reachable by links.

    Null and empty texts have no shingles and no links; texts of fewer than ``words`` words are one shingle. A row without
    an id has neither component nor links. ``doc_id`` names a document: rows that repeat an id repeat its text. No
    documents give no rows. Other columns are ignored.
    """
    facts = set_facts(blobs.write_batches(texts_of(docs, id, text)), percent, words)
    placed = with_components(facts.drop("id"), percent, words)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def with_components(facts: DataFrame, percent: int, words: int) -> DataFrame:
    """The rows of ``facts`` (less ``text``) with their ``component``, the smallest ``doc_id`` reachable by links."""
    known = facts.where("n > 0 AND doc_id IS NOT NULL")
    first = known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = settle(known.join(first, ["h1", "h2", "n"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "first").distinct())
    likely = facts.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "n").join(copies.select("doc_id"), "doc_id", "left_anti")
    likely = settle(likely)
    families = components(candidate_edges(likely, percent, words))
    roots = families.select("component").distinct()
    members = families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")).unionByName(
        roots.select(F.col("component").alias("doc_id"), F.col("component").alias("family"))
    )
    found = components(verified_links(likely, settle(members), percent, words))
    sure = facts.drop("text").join(copies, "doc_id", "left").withColumn("node", F.coalesce("first", "doc_id"))
    return sure.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node", "first")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id, or any where none has one.

    Every row is a document of its own: of rows that repeat id and text one stays, and a text whose id another text has, too,
    goes only if it is a copy itself. Texts without words are no copies of each other and all stay.
    """
    batches = blobs.write_batches(docs, text)
    placed = with_components(set_facts(batches, percent, words, id, text, by_row=True), percent, words)
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"].alias("number"))
    chosen = best.groupBy(batch_of(F.col("number")).alias("batch")).agg(F.collect_list(F.col("number").bitwiseAND(F.lit((1 << 18) - 1).cast("long"))).alias("rows"))

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                yield from blobs.unseal(r["blob"]).take(pa.array(sorted(r["rows"]), pa.int64())).combine_chunks().to_batches()

    return batches.select("batch", "blob").join(chosen.hint("shuffle_hash"), "batch").select("blob", "rows").mapInArrow(pick, docs.schema)
