"""Grouping of spelling variants: words that one edit parts, found in a trie of letter counts.

Letters fall into groups, and the numbers of a word's letters in each group are its path in a trie. One edit changes a path
by at most one letter more in one group (surplus) and one less in another (deficit). A depth-first search walks the branches
that this budget allows, for all words of a node of the searched words' own trie together, and the words at the leaves are
compared letter by letter.

The counts of the first groups name a cell. A word is stored in the bucket of its own cell and searched for in the buckets of
its own and of the larger cells that the budget reaches; buckets with many words or searches are cut on both sides, so that
every search meets every stored word of such a cell in exactly one task. A pair is found once, from the word of the smaller
cell, or of one cell from the smaller word, and counts for both.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.session import settle

LETTERS = "A-Za-z\\u00C0-\\u00FF"  # every one is a byte of Latin-1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FREQUENT = "etaoinshrdlu"  # a group each; the other letters share the other groups
GROUPS = 18
CELL_GROUPS = 4  # groups whose counts name the cell
BUCKET_WORDS = 1 << 15  # stored words in one task
BUCKET_SEARCHES = 1 << 17  # searches in one task
LEAF_PAIRS = 2  # two nodes with no more pairs of words are leaves: comparing these is cheaper than the levels below
FRONTIER = 1 << 16  # states of the search that are looked at together
PAIR_BYTES = 1 << 24  # bytes of words that are compared together

GROUP_OF = len(FREQUENT) + np.arange(256) % (GROUPS - len(FREQUENT))
GROUP_OF[[ord(c) for c in FREQUENT]] = np.arange(len(FREQUENT))


# ---- words ---------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", every: int = 31, letters: int = 7, least: int = 2) -> DataFrame:
    """``word, n``: runs of at least ``letters`` letters that occur ``least`` times, in lower case (A to Z only).

    One occurrence in ``every`` has a letter missing, by the checksum of document and run; 0 leaves all as they are. Null
    texts have no words, a null id counts as an empty one.
    """
    name = F.concat(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")), F.lit(":"))
    # a shorter run has no word of this length, with or without a letter missing
    runs = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(f"[{LETTERS}]{{{letters},}}"), F.lit(0))
    rows = docs.select(name.alias("name"), F.explode(runs).alias("run")).select("name", F.translate("run", UPPER, LOWER).alias("run"))
    if every:
        h = F.crc32(F.concat("name", "run").cast("binary"))
        rows = rows.select("run", h.alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        rows = rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)
    else:
        rows = rows.select(F.col("run").alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class Words:
    """Words as one run of bytes with offsets, and their letter counts by group."""

    def __init__(self, words: list[str]) -> None:
        coded = [w.encode("latin-1") for w in words]
        self.size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(coded), np.uint8)
        row = np.repeat(np.arange(len(coded)), self.size)
        self.counts = np.bincount(row * GROUPS + GROUP_OF[self.data], minlength=len(coded) * GROUPS).reshape(len(coded), GROUPS)
        self.narrow = self.counts.astype(np.int32 if self.counts.max(initial=0) > 100 else np.int8)

    def letters(self, rows: np.ndarray, length: int) -> np.ndarray:
        return self.data[self.begin[rows][:, None] + np.arange(length)]


def reachable(counts: np.ndarray) -> np.ndarray:
    """Changes of the first counts by a surplus of at most one and a deficit of at most one that lead to larger cells, in the
    order of the counts: the surplus comes first. No change is the first of them."""
    k = counts.shape[1]
    unit = np.eye(k, dtype=np.int64)
    return np.concatenate([np.zeros((1, k), np.int64), unit, (unit[:, None] - unit[None, :])[np.triu_indices(k, 1)]])


def cell_buckets(cells: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of cells (last axis: counts)."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for j in range(cells.shape[-1]):
        h = (h ^ cells[..., j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int32)


# ---- search --------------------------------------------------------------------------------------------------------


class Trie:
    """Words by their counts. A node of a level is a run of words (in ``order``) with equal counts up to there, from
    ``begins`` to ``ends``; ``keys`` are the numbers of its parent and its own count, ascending, and ``inner`` says where a
    node's children begin in the next level."""

    def __init__(self, words: Words, width: int) -> None:
        self.order = np.lexsort(words.counts.T[::-1])
        counts = words.counts[self.order]
        self.keys, self.counts, self.begins, self.ends, self.inner = [], [], [], [], []
        node, parents = np.zeros(len(counts), np.int64), 1
        for level in range(GROUPS):
            key = node * width + counts[:, level]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            begins = np.flatnonzero(first)
            self.keys.append(key[first])
            self.counts.append(counts[begins, level])
            self.begins.append(begins)
            self.ends.append(np.append(begins[1:], len(counts)))
            self.inner.append(np.searchsorted(node[begins], np.arange(parents + 1)))
            node, parents = np.cumsum(first) - 1, len(begins)


def near_leaves(a: Trie, b: Trie, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of runs of words, begin and end in ``a`` and in ``b``, whose paths the budget lets differ, with that of ``b`` in no
    smaller cell as far as the paths go. Both tries are walked together, depth first: what words of a node have in common is
    looked at once for all of them."""
    none = np.zeros(1, bool)
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), none, none)]
    while stack:
        level, left, right, surplus, deficit = stack.pop()
        from_, to = a.inner[level][left], a.inner[level][left + 1]
        pick = np.repeat(np.arange(len(left)), to - from_)
        left = np.arange(len(pick)) - np.repeat(np.cumsum(to - from_) - to, to - from_)
        right, surplus, deficit, count = right[pick], surplus[pick], deficit[pick], a.counts[level][left]
        # within the cell's counts a deficit comes after the surplus
        fewer = ~deficit & (count > 0) & surplus if level < CELL_GROUPS else ~deficit & (count > 0)
        more, less = np.flatnonzero(~surplus), np.flatnonzero(fewer)
        key = np.concatenate([right * width + count, right[more] * width + count[more] + 1, right[less] * width + count[less] - 1])
        at = np.minimum(np.searchsorted(b.keys[level], key), len(b.keys[level]) - 1)
        hit = np.flatnonzero(b.keys[level][at] == key)
        left = np.concatenate([left, left[more], left[less]])[hit]
        right = at[hit]
        surplus = np.concatenate([surplus, np.ones(len(more), bool), surplus[less]])[hit]
        deficit = np.concatenate([deficit, deficit[more], np.ones(len(less), bool)])[hit]
        runs = a.begins[level][left], a.ends[level][left], b.begins[level][right], b.ends[level][right]
        small = (runs[1] - runs[0]) * (runs[3] - runs[2]) <= LEAF_PAIRS if level + 1 < GROUPS else np.ones(len(left), bool)
        if small.any():
            yield tuple(r[small] for r in runs)
        large = np.flatnonzero(~small)
        for i in range(0, len(large), FRONTIER):
            part = large[i : i + FRONTIER]
            stack.append((level + 1, left[part], right[part], surplus[part], deficit[part]))


def one_edit(a: Words, x: np.ndarray, b: Words, y: np.ndarray) -> np.ndarray:
    """Which pairs of words exactly one inserted, deleted or replaced letter parts."""
    near = np.zeros(len(x), bool)
    order = np.lexsort((b.size[y], a.size[x]))
    la, lb = a.size[x][order], b.size[y][order]
    cuts = np.append(np.flatnonzero(np.append(True, (la[1:] != la[:-1]) | (lb[1:] != lb[:-1]))), len(order)) if len(order) else [0]
    for begin, end in zip(cuts, cuts[1:]):
        m, n = int(la[begin]), int(lb[begin])
        if abs(m - n) > 1:
            continue
        step = max(1, PAIR_BYTES // max(m, n))
        for i in range(begin, end, step):
            rows = order[i : min(i + step, end)]
            left, right = a.letters(x[rows], m), b.letters(y[rows], n)
            if m == n:
                near[rows] = (left != right).sum(axis=1) == 1
                continue
            short, long = (left, right) if m < n else (right, left)
            ahead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
            behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            near[rows] = ahead + behind >= min(m, n)
    return near


class Best:
    """For each word of one list, how many of the other are one edit away, and which is the best of them (-1 for none): that
    of the largest ``n``, of equal ones the first. Lists ascend."""

    def __init__(self, words: int, other_n: np.ndarray) -> None:
        self.found = np.zeros(words, np.int64)
        self.order = np.lexsort((np.arange(len(other_n)), -other_n))
        self.place = np.empty(len(other_n), np.int64)
        self.place[self.order] = np.arange(len(other_n))
        self.least = np.full(words, len(other_n))

    def add(self, mine: np.ndarray, other: np.ndarray) -> None:
        np.add.at(self.found, mine, 1)
        np.minimum.at(self.least, mine, self.place[other])

    def best(self) -> np.ndarray:
        return np.where(self.found > 0, np.append(self.order, -1)[np.minimum(self.least, len(self.order))], -1)


def search(stored: list[str], stored_n: np.ndarray, asked: list[str], asked_n: np.ndarray) -> tuple[Best, Best]:
    """Pairs of a word of ``asked`` and one of ``stored`` that one edit parts, where the first stands in the smaller cell or is
    the smaller word of one cell: what they are for the asked and for the stored words. Both lists ascend."""
    ours, theirs = Best(len(asked), stored_n), Best(len(stored), asked_n)
    if not len(asked) or not len(stored):
        return ours, theirs
    a, b = Words(asked), Words(stored)
    after = np.array([bisect_right(stored, w) for w in asked], np.int64)
    width = int(max(a.counts.max(), b.counts.max())) + 2
    mine, other = Trie(a, width), Trie(b, width)
    for a_begin, a_end, b_begin, b_end in near_leaves(mine, other, width):
        wide = b_end - b_begin
        size = (a_end - a_begin) * wide
        upto = np.cumsum(size)
        begin = 0
        while begin < len(size):
            # some leaves at a time; two leaves hold no more than the words of a task, which are few with equal counts
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 16 * FRONTIER, "right")))
            n = size[begin:end]
            run = np.repeat(np.arange(begin, end), n)
            at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            x, y = mine.order[a_begin[run] + at // wide[run]], other.order[b_begin[run] + at % wide[run]]
            more = b.narrow[y] - a.narrow[x]
            fits = np.flatnonzero((np.abs(more).sum(axis=1, dtype=np.int64) <= 2) & (np.abs(more.sum(axis=1, dtype=np.int64)) <= 1))
            x, y, more = x[fits], y[fits], more[fits, :CELL_GROUPS]
            # no count differs by more than one here: the first that differs tells which cell is larger
            larger = more.astype(np.int64) @ 3 ** np.arange(CELL_GROUPS)[::-1]
            kept = np.flatnonzero((larger > 0) | (larger == 0) & (y >= after[x]))
            x, y = x[kept], y[kept]
            near = one_edit(a, x, b, y)
            ours.add(x[near], y[near])
            theirs.add(y[near], x[near])
            begin = end
    return ours, theirs


# ---- passes --------------------------------------------------------------------------------------------------------


def placed(words: DataFrame, buckets: int) -> DataFrame:
    """``word, n, bucket, home``: the bucket where each word is stored, and those where it is searched for."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = Words(batch.column(0).to_pylist()).counts[:, :CELL_GROUPS]
            cells = counts[:, None, :] + reachable(counts)[None]
            bucket = cell_buckets(cells, buckets)
            bucket[(cells < 0).any(axis=2)] = -1
            home = bucket[:, :1]
            reached = np.sort(bucket, axis=1)
            reached[:, 1:][reached[:, 1:] == reached[:, :-1]] = -1
            row, col = np.nonzero(reached >= 0)
            every = np.concatenate([np.arange(len(home)), row])
            where = np.concatenate([home[:, 0], reached[row, col]])
            kind = np.concatenate([np.ones(len(home), bool), np.zeros(len(row), bool)])
            pick = pa.array(every)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(where, pa.int32()), pa.array(kind)], names=["word", "n", "bucket", "home"])

    return words.select("word", "n").mapInArrow(place, "word string, n long, bucket int, home boolean")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n``: how many words are one edit away from each that has any, and the most frequent of
    them (of equally frequent ones the first in the order of code points). ``words`` (``word, n``) is a written table of
    distinct words of Latin letters."""
    total = words.count()
    buckets = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_WORDS))
    rows = placed(words, buckets)
    cut = lambda bound: F.ceil(F.count(F.lit(1)) / bound).cast("int")
    sizes = rows.groupBy("bucket").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("home") / BUCKET_WORDS).cast("int")).alias("stores"), cut(BUCKET_SEARCHES + BUCKET_WORDS).alias("asks")
    )
    sized = rows.join(settle(sizes), "bucket")
    part = lambda seed, of: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(of)).cast("int")
    all_of = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    stored = sized.withColumn("store", F.when(F.col("home"), F.array(part(1, "stores"))).otherwise(all_of("stores")))
    both = stored.withColumn("ask", F.when(F.col("home"), all_of("asks")).otherwise(F.array(part(2, "asks"))))
    tiles = both.select("bucket", F.explode("store").alias("store"), "ask", "home", "word", "n").select("bucket", "store", F.explode("ask").alias("ask"), "home", "word", "n")

    def tile(table: pa.Table) -> pa.Table:
        # the order of code points is that of UTF-8 bytes, by which Arrow sorts
        table = table.sort_by("word")
        home = np.asarray(table["home"].combine_chunks())
        lists = [(t["word"].to_pylist(), np.asarray(t["n"])) for t in (table.filter(pa.array(home)), table.filter(pa.array(~home)))]
        (stored, stored_n), (asked, asked_n) = lists
        columns: list[list] = [[], [], [], []]
        for side, words, others, n in zip(search(stored, stored_n, asked, asked_n), (asked, stored), (stored, asked), (stored_n, asked_n)):
            some = np.flatnonzero(side.found)
            best = side.best()[some]
            for column, values in zip(columns, ([words[i] for i in some], side.found[some].tolist(), [others[i] for i in best], n[best].tolist() if len(n) else [])):
                column += values
        return pa.table({"word": pa.array(columns[0], pa.string()), "n_near": pa.array(columns[1], pa.int64()), "near": pa.array(columns[2], pa.string()), "near_n": pa.array(columns[3], pa.int64())})

    found = tiles.groupBy("bucket", "store", "ask").applyInArrow(tile, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    grouped = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return grouped.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def spelling_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", times: int = 10, every: int = 31, letters: int = 7, least: int = 2
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are those of ``word_counts``. A word's ``form`` is its most frequent near word if that occurs ``times`` as often
    (2 at least), ``root`` the end of the chain of forms. Equal documents count as often as they stand there; null and empty
    texts have no words; runs of any length are words; ties go to the first word in the order of code points; no documents
    give no rows. Other columns are not read. Runs jobs when called.
    """
    words = settle(word_counts(docs, id, text, every, letters, least))
    near = near_words(words)
    given = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("near_n") >= F.col("n") * times, F.lit(False)))
    table = settle(given.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("is_form"), F.col("near")).alias("form"), F.when(F.col("is_form"), F.col("near_n")).alias("form_n"),
    ))
    most = table.agg(F.max("n")).first()[0] or 1
    # every form is `times` as frequent as its word, so chains are short
    steps = max(1, math.floor(math.log(most, times) + 1e-9))
    links = table.where("form IS NOT NULL").select(F.col("word").alias("at"), F.col("form").alias("next"))
    ends = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(steps - 1):
        ends = ends.join(links, ends["root"] == links["at"], "left").select("word", F.coalesce("next", "root").alias("root"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
