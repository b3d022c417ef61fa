"""Substring deduplication by sorting suffixes with hashed comparisons.

Of every ``length`` bytes, each document keeps the places where a short string has the smallest hash: anchors. Two equal
strings of ``length`` bytes have an anchor at the same place, so it is enough to sort the suffixes at anchors.

1. Hashes of the strings at anchors meet in buckets; only anchors that two documents share go on.
2. The bytes around shared anchors meet in buckets. Suffixes of one anchor string are merge-sorted: prefix hashes and a
   binary search give the common extension of two suffixes, and so their order, in logarithmic time. Common extensions to
   the right of the sorted neighbours, with hashes of the bytes to the left, tell which whole strings are equal and which
   document with the smallest id has them. Every equality is verified on the bytes.
   Anchors that meet with very many different surroundings are not sorted in one piece: each whole string around them
   meets under its own hash, in the same exchange.
3. Documents learn which strings a smaller document has, and lose the bytes that these cover.

Copies are folded inside a batch, so that a passage of very many documents arrives once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.llm import blobs
from gridsignal.llm.blobs import ids_of, mix, text_bytes
from gridsignal.llm.exchange import KEYS, MASKS, bits_of, cut_keys, key_bits, key_rows, shared_masks, with_masks
from gridsignal.llm.shingles import BASE, powers, prefix_hashes

LENGTH = 50
GRAM = 24
BEFORE = LENGTH - GRAM  # bytes before an anchor that a string of LENGTH bytes around it can have
SPAN = BEFORE + LENGTH
OUTSIDE = 255  # no byte of UTF-8
CHUNK = 1 << 13
SORT_ROWS = 1 << 14
PIECE = 1 << 19
HOT_HEADS = 1 << 16  # an anchor string with more different surroundings than this, counted batch by batch, is taken apart
HOT_BUCKET_STRINGS = 1 << 20

WEIGHTS = np.array([pow(int(BASE), i + 1, 1 << 64) for i in range(SPAN)], dtype=np.uint64)


# ---- anchors -------------------------------------------------------------------------------------------------------


def sliding(values: np.ndarray, width: int, choose: Callable) -> np.ndarray:
    """``choose`` (minimum or maximum) over every run of ``width`` values."""
    step = 1
    while step * 2 <= width:
        values = choose(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return choose(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose string has the smallest hash of some ``LENGTH`` bytes of its text, hashes of these strings, and hashes of
    their surroundings."""
    places, keys, around = [], [], []
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PIECE, "right")) - 1)
        at, h, w = _anchors(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
        places.append(at + offsets[begin])
        keys.append(h)
        around.append(w)
        begin = end
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(keys), np.concatenate(around)


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = prefix_hashes(data)
    _, down = powers(len(data))
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(data) - GRAM + 1])
    rank = np.maximum((grams >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    width = LENGTH - GRAM + 1
    least = sliding(rank, width, np.minimum)
    for edge in offsets[1:-1].tolist():
        least[max(0, edge - LENGTH + 1) : edge] = 0  # runs over the end of a text
    pad = np.zeros(width - 1, np.uint32)
    chosen = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == rank)
    row = np.searchsorted(offsets, chosen, "right") - 1
    begin, end = np.maximum(chosen - BEFORE, offsets[row]), np.minimum(chosen + LENGTH, offsets[row + 1])
    _, down = powers(len(data) + 1)
    around = mix((prefix[end] - prefix[begin]) * down[begin] + mix(((chosen - begin) * SPAN + end - chosen).astype(np.uint64)))
    # chosen hashes are small ones: mixed again, they fill the buckets evenly
    return chosen, mix(~grams[chosen]), around


class Batch:
    """Texts of a batch with their anchors. Keys are the upper ``bits`` of the hash; the others are 0."""

    def __init__(self, blob: bytes, id: str, text: str, bits: int = 64) -> None:
        self.table = blobs.unseal(blob)
        self.ids = ids_of(self.table[id])
        self.data, self.offsets = text_bytes(self.table[text])
        self.places, self.keys, self.content = anchors(self.data, self.offsets)
        self.keys = cut_keys(self.keys, bits)
        self.row = np.searchsorted(self.offsets, self.places, "right") - 1

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys ascending, which of them two documents of the batch share, and the number of each anchor's key."""
        keys, number = np.unique(self.keys, return_inverse=True)
        owner = self.ids[self.row]
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, number, owner)
        np.maximum.at(high, number, owner)
        return keys, low < high, number

    def key_facts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys ascending, which of them two documents of the batch share, and how many surroundings each has."""
        keys, twice, number = self.distinct_keys()
        order = np.lexsort((self.content, number))
        number, content = number[order], self.content[order]
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (content[1:] != content[:-1])
        return keys, twice, np.bincount(number[new], minlength=len(keys))

    def share(self, mask: np.ndarray) -> None:
        """Keep the anchors whose key is marked, ordered by key, surroundings and document, and fold equal surroundings:
        ``head`` marks the smallest document of each, ``fold`` is the number of an anchor's head."""
        _, _, number = self.distinct_keys()
        kept = mask[number]
        self.places, self.keys, self.row = self.places[kept], self.keys[kept], self.row[kept]
        around = np.empty((len(self.places), SPAN), np.uint8)
        low, high = self.offsets[self.row], self.offsets[self.row + 1]
        for i in range(0, len(self.places), CHUNK):
            part = slice(i, i + CHUNK)
            at = self.places[part, None] + np.arange(-BEFORE, LENGTH)
            inside = (at >= low[part, None]) & (at < high[part, None])
            around[part] = np.where(inside, self.data[np.clip(at, 0, max(len(self.data) - 1, 0))], OUTSIDE)
        order, head = fold_equal(self.keys, self.ids[self.row], around)
        self.places, self.keys, self.row = self.places[order], self.keys[order], self.row[order]
        self.around, self.head = around[order], head
        self.fold = np.cumsum(head) - 1

    def share_cool(self, masks: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """``share`` by the masks of buckets; the heads that do not have a hot key, and those that have."""
        keys, _, _ = self.distinct_keys()
        self.share(bits_of(masks, keys, buckets))
        warm = bits_of(masks, keys, buckets, "hot")[np.searchsorted(keys, self.keys[self.head])]
        return np.flatnonzero(~warm), np.flatnonzero(warm)

    def strings(self, heads: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Whole strings around the given heads by bucket of their hash: bucket, head and distance to the anchor of each
        string, their bytes and owners, and an order with marks of the smallest owner of each distinct string."""
        rows = np.flatnonzero(self.head)[heads]
        which, distance, keys = [], [], []
        for i in range(0, len(rows), CHUNK):
            around = self.around[rows[i : i + CHUNK]]
            fits = whole_strings(around)
            for o in range(BEFORE + 1):
                found = np.flatnonzero((fits >> np.uint32(o)) & np.uint32(1))
                which.append((found + i).astype(np.int32)), distance.append(np.full(len(found), o, np.int8))
                keys.append(row_hashes(around[found, BEFORE - o : BEFORE - o + LENGTH]))
        if not keys:
            return
        which, distance, keys = np.concatenate(which), np.concatenate(distance), np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        which, distance, keys = which[order], distance[order], keys[order]
        cut = blobs.bucket_edges(keys, buckets).tolist()
        for b, (begin, end) in enumerate(zip(cut, cut[1:])):
            if begin < end:
                w, o = which[begin:end], distance[begin:end].astype(np.int64)
                content = self.around[rows[w][:, None], (BEFORE - o)[:, None] + np.arange(LENGTH)]
                owner = self.ids[self.row[rows[w]]]
                yield b, heads[w], o, content, owner, *fold_equal(keys[begin:end], owner, content)

    def covered(self, masks: np.ndarray) -> np.ndarray:
        """Which bytes the strings cover that ``masks`` (one per head) or a smaller copy in this batch mark."""
        owner = self.ids[self.row]
        bits = masks[self.fold]
        smaller = np.flatnonzero(owner > owner[self.head][self.fold])
        for i in range(0, len(smaller), CHUNK):
            bits[smaller[i : i + CHUNK]] = whole_strings(self.around[smaller[i : i + CHUNK]])
        change = np.zeros(len(self.data) + 1, np.int32)
        some = np.flatnonzero(bits)
        for o in range(BEFORE + 1):
            start = self.places[some[(bits[some] >> np.uint32(o)) & np.uint32(1) == 1]] - o
            np.add.at(change, start, 1)
            np.add.at(change, start + LENGTH, -1)
        return np.cumsum(change[:-1]) > 0


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """One hash for the bytes of each row."""
    out = np.zeros(len(rows), np.uint64)
    for i in range(0, len(rows), CHUNK):
        out[i : i + CHUNK] = (rows[i : i + CHUNK].astype(np.uint64) * WEIGHTS[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)
    return mix(out)


def fold_equal(keys: np.ndarray, owner: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, bytes and owner, and marks of the first row of equal key and bytes."""
    content = row_hashes(around)
    order = np.lexsort((owner, content, keys))
    k, c = keys[order], content[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    same = np.flatnonzero(~head)
    if any((around[order[same[i : i + CHUNK]]] != around[order[same[i : i + CHUNK] - 1]]).any() for i in range(0, len(same), CHUNK)):
        # hashes of different bytes collide: sort by the bytes
        order = np.lexsort((owner, *around.T[::-1], keys))
        k, a = keys[order], around[order]
        head[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1]).any(axis=1)
    return order, head


def whole_strings(around: np.ndarray) -> np.ndarray:
    """For each anchor, a bit for every distance from a string's begin to the anchor at which the string lies in the text."""
    left = (around[:, :BEFORE] != OUTSIDE).sum(axis=1)
    right = (around[:, BEFORE:] != OUTSIDE).sum(axis=1)
    o = np.arange(BEFORE + 1)
    fits = (o <= left[:, None]) & (LENGTH - o <= right[:, None])
    return (fits.astype(np.uint32) << o.astype(np.uint32)).sum(axis=1, dtype=np.uint32)


# ---- sorting suffixes ----------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes at anchors, ``LENGTH`` bytes each, compared by hashes of their prefixes."""

    def __init__(self, right: np.ndarray) -> None:
        self.right = right
        self.prefix = np.zeros((len(right), LENGTH + 1), np.uint64)
        np.cumsum((right.astype(np.uint64) + np.uint64(1)) * WEIGHTS[:LENGTH], axis=1, out=self.prefix[:, 1:])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of pairs of suffixes: binary search for the longest prefix with equal hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            equal = self.prefix[x, middle] == self.prefix[y, middle]
            low, high = np.where(open_ & equal, middle, low), np.where(open_ & ~equal, middle - 1, high)

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        at = np.minimum(n, LENGTH - 1)
        return np.where(n == LENGTH, or_equal, self.right[x, at] < self.right[y, at])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Stable order of the suffixes within each group; groups are runs of equal numbers. A bottom-up merge sort: in
        every round, each suffix finds its place in the run that its own is merged with."""
        rows = np.arange(len(group))
        begin = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        start = np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(group) else rows
        size = np.bincount(np.cumsum(begin) - 1)[np.cumsum(begin) - 1] if len(group) else rows
        width, largest = 1, int(size.max(initial=0))
        while width < largest:
            local = np.arange(len(rows)) - start
            run = local // width
            other_low = start + np.minimum((run ^ 1) * width, size)
            other_high = start + np.minimum((run ^ 1) * width + width, size)
            active = np.flatnonzero(other_low < other_high)
            low, high, second = other_low[active].copy(), other_high[active].copy(), run[active] % 2 == 1
            mine = rows[active]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                # the second run's suffixes go after equal ones of the first
                before = self.less(rows[middle], mine[open_], second[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            place = np.arange(len(rows))
            pair = start[active] + (run[active] // 2) * 2 * width
            place[active] = pair + (local[active] - run[active] * width) + (low - other_low[active])
            merged = np.empty_like(rows)
            merged[place] = rows
            rows, width = merged, width * 2
        return rows


def equal_strings(group: np.ndarray, owner: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For rows in runs of one anchor string (``group``): a bit for every string around the anchor that a row of the same
    group with a smaller owner has, too."""
    right = np.ascontiguousarray(around[:, BEFORE:])
    suffixes = Suffixes(right)
    order = suffixes.sort(group)
    far = np.full(len(order), LENGTH)
    x, y = order[:-1], order[1:]
    far[1:] = np.where(group[x] == group[y], suffixes.common(x, y), -1)
    far[:1] = -1
    differ = right[x] != right[y]
    true = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    if ((far[1:] >= 0) & (far[1:] != true)).any():
        # prefix hashes of different bytes collide: sort by the bytes
        order = np.lexsort((*right.T[::-1], group))
        x, y = order[:-1], order[1:]
        differ = right[x] != right[y]
        far[1:] = np.where(group[x] == group[y], np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH), -1)
    around, owner, group = around[order], owner[order], group[order]
    fits = whole_strings(around)
    left = np.zeros(len(order), np.uint64)
    found = np.zeros(len(order), np.uint32)
    for o in range(BEFORE + 1):
        if o:
            left = left + (around[:, BEFORE - o].astype(np.uint64) + np.uint64(1)) * WEIGHTS[o]
        rows = np.flatnonzero((fits >> np.uint32(o)) & np.uint32(1))
        if len(rows) < 2:
            continue
        suffix_class = np.cumsum(far < LENGTH - o)[rows].astype(np.uint64)
        found[rows] |= smaller_exists(mix(left[rows] + mix(suffix_class)), owner[rows], around[rows, BEFORE - o : BEFORE - o + LENGTH]).astype(np.uint32) << np.uint32(o)
    out = np.empty_like(found)
    out[order] = found
    return out


def smaller_exists(content: np.ndarray, owner: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Whether an equal string of a smaller owner exists; ``content`` are hashes, verified on the bytes."""
    order = np.lexsort((owner, content))
    c = content[order]
    head = np.concatenate([[True], c[1:] != c[:-1]])
    first = order[head][np.cumsum(head) - 1]
    if (strings[order] != strings[first]).any():
        order = np.lexsort((owner, *strings.T[::-1]))
        head = np.concatenate([[True], (strings[order][1:] != strings[order][:-1]).any(axis=1)])
        first = order[head][np.cumsum(head) - 1]
    out = np.empty(len(order), bool)
    out[order] = owner[order] > owner[first]
    return out


def resolve(owner: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each row, the bits of the strings around its anchor that a row with a smaller owner has, too."""
    order, head = fold_equal(row_hashes(around[:, BEFORE : BEFORE + GRAM]), owner, around)
    fold = np.cumsum(head) - 1
    one = order[head]
    gram = row_hashes(around[one, BEFORE : BEFORE + GRAM])
    change = np.ones(len(one), bool)
    change[1:] = gram[1:] != gram[:-1]
    group = np.cumsum(change)
    first = one[np.flatnonzero(change)[group - 1]] if len(one) else one
    anchor = slice(BEFORE, BEFORE + GRAM)
    if any((around[one[i : i + CHUNK], anchor] != around[first[i : i + CHUNK], anchor]).any() for i in range(0, len(one), CHUNK)):
        # hashes of different anchor strings collide: tell them apart by the bytes
        _, content = np.unique(around[one, anchor], axis=0, return_inverse=True)
        resorted = np.argsort(content.ravel(), kind="stable")
        masks = np.zeros(len(one), np.uint32)
        masks[resorted] = by_groups(content.ravel()[resorted], owner[one][resorted], around, one[resorted])
    else:
        masks = by_groups(group, owner[one], around, one)
    out = np.empty(len(order), np.uint32)
    for i in range(0, len(order), CHUNK):
        rows, part = order[i : i + CHUNK], fold[i : i + CHUNK]
        out[rows] = np.where(owner[rows] > owner[one[part]], whole_strings(around[rows]), masks[part])
    return out


def by_groups(group: np.ndarray, owner: np.ndarray, around: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``equal_strings`` for some whole groups at a time; groups of one row have nothing to compare. ``place`` is where
    the bytes of each row lie in ``around``."""
    masks = np.zeros(len(group), np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
    ends = np.cumsum(sizes[sizes > 1])
    begin = 0
    while begin < len(rows):
        end = int(ends[min(np.searchsorted(ends, begin + SORT_ROWS), len(ends) - 1)])
        part = rows[begin:end]
        masks[part] = equal_strings(group[part], owner[part], around[place[part]])
        begin = end
    return masks


# ---- passes --------------------------------------------------------------------------------------------------------


def string_masks(batches: DataFrame, shared: DataFrame, id: str, text: str, buckets: int, strings: int, bits: int) -> DataFrame:
    """``batch, bucket, mask``: which strings around its shared anchors a smaller document of another batch has.

    The first ``buckets`` buckets are those of anchors: their surroundings meet, and the mask has bits for each folded
    anchor. The ``strings`` buckets after them are those of whole strings around hot anchors, with a mark for each
    distinct one; a batch sends a string once, so no string has more rows than there are batches.
    """

    def announce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for r in part.to_pylist():
                batch = Batch(r["blob"], id, text, bits)
                cool, warm = batch.share_cool(r["masks0"], buckets)
                rows_of = np.flatnonzero(batch.head)[cool]
                keys, owner, around = batch.keys[rows_of], batch.ids[batch.row[rows_of]], batch.around[rows_of]
                cut = blobs.bucket_edges(keys, buckets).tolist()
                filled = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                spans = [slice(cut[b], cut[b + 1]) for b in filled]
                yield key_rows(filled, r["batch"], [(b"", blobs.pack(owner[s]), blobs.deflate(around[s])) for s in spans])
                for b, _, _, content, owner, order, head in batch.strings(warm, strings):
                    one = order[head]
                    yield key_rows([buckets + b], r["batch"], [(b"", blobs.pack(owner[one]), blobs.deflate(content[one]))])

    def meet(key: tuple, parts: pa.Table) -> pa.Table:
        owners = [blobs.unpack(e, np.int64) for e in parts["extra"].to_pylist()]
        owner = np.concatenate(owners)
        whole = key[0].as_py() >= buckets
        content = np.concatenate([blobs.inflate(b, np.uint8).reshape(-1, LENGTH if whole else SPAN) for b in parts["bytes"].to_pylist()])
        if whole:
            order, head = fold_equal(np.zeros(len(owner), np.uint64), owner, content)
            found = np.empty(len(owner), bool)
            found[order] = owner[order] > owner[order[head]][np.cumsum(head) - 1]
        else:
            found = resolve(owner, content)
        cuts = np.cumsum([0, *map(len, owners)]).tolist()
        masks = [np.packbits(found[a:b]).tobytes() if whole else blobs.deflate(found[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table({"batch": parts["batch"], "bucket": parts["bucket"], "mask": pa.array(masks, pa.binary())})

    return with_masks(batches, shared).mapInArrow(announce, KEYS).groupBy("bucket").applyInArrow(meet, MASKS)


def removals(docs: DataFrame, id: str, text: str, finish: Callable[[Batch, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """Run ``finish`` on every batch of ``docs`` with the marks of the bytes that it loses."""
    batches = blobs.write_batches(docs, text)
    raw = batches.agg(F.sum("raw")).first()[0] or 0
    buckets, bits = blobs.bucket_count(batches), key_bits(raw)
    known = blobs.settle(shared_masks(batches, lambda blob: Batch(blob, id, text, bits).key_facts(), buckets, HOT_HEADS))
    hot_heads = known.agg(F.sum("hot_heads")).first()[0] or 0
    strings = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hot_heads * (BEFORE + 1) // HOT_BUCKET_STRINGS))
    shared = known.select("batch", "bucket", "mask", "hot")
    found = string_masks(batches, shared, id, text, buckets, strings, bits)

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for r in part.to_pylist():
                batch = Batch(r["blob"], id, text, bits)
                cool, warm = batch.share_cool(r["masks0"], buckets)
                heads = batch.keys[batch.head]
                cut = blobs.bucket_edges(heads[cool], buckets)
                strings_of = np.zeros(len(heads), np.uint32)
                marks = {m["bucket"]: m["mask"] for m in r["masks1"] or []}
                for b, m in marks.items():
                    if b < buckets:
                        strings_of[cool[int(cut[b]) : int(cut[b + 1])]] = blobs.inflate(m, np.uint32)
                for b, head_of, distance, _, owner, order, head in batch.strings(warm, strings):
                    group = np.cumsum(head) - 1
                    least = owner[order[head]][group]
                    smaller = np.unpackbits(np.frombuffer(marks[buckets + b], np.uint8))[: int(head.sum())].astype(bool)[group] | (owner[order] > least)
                    some = order[smaller]
                    np.bitwise_or.at(strings_of, head_of[some], np.uint32(1) << distance[some].astype(np.uint32))
                yield finish(batch, batch.covered(strings_of))

    return with_masks(batches, shared, found).mapInArrow(apply, schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """What each document loses: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes when a string of 50 bytes covers it that also starts in a document with a smaller id; texts are judged as
    they come. Null and empty texts have no bytes. Rows with the same id are no smaller than each other, and null ids are
    larger than all others. No documents give no rows; other columns are ignored.
    """

    def digest(batch: Batch, gone: np.ndarray) -> pa.RecordBatch:
        removed, spans, kept = [], [], []
        raw = batch.data
        for a, b in zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist()):
            marks = gone[a:b]
            removed.append(int(marks.sum()))
            spans.append(int(marks[:1].sum() + (marks[1:] & ~marks[:-1]).sum()))
            kept.append(hashlib.sha256((raw[a:b] if not removed[-1] else raw[a:b][~marks]).tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [pc.cast(batch.table[id].combine_chunks(), pa.int64()), pa.array(np.diff(batch.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
            names=[f.split()[0] for f in DIGEST.split(", ")],
        )

    return removals(docs.select(id, text), id, text, digest, DIGEST)


def dedup_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` without the repeated bytes, with all columns. A character stays whole unless all its bytes go. Documents
    that lose all their text are dropped; ``length`` names a column that is set to the number of characters left."""
    names = docs.columns

    def cut(batch: Batch, gone: np.ndarray) -> pa.RecordBatch:
        # a character goes if all its bytes are marked
        lead = (batch.data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        whole = np.bincount(char[~gone], minlength=int(lead.sum())) == 0 if len(gone) else np.zeros(0, bool)
        gone = whole[char] if len(gone) else gone
        texts = []
        for a, b, old in zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist(), batch.table[text].to_pylist()):
            texts.append(batch.data[a:b][~gone[a:b]].tobytes().decode() if gone[a:b].any() else old)
        table = batch.table
        changed = pa.array(texts, pa.string())
        empty = pa.array([t == "" and b > a for t, a, b in zip(texts, batch.offsets[:-1].tolist(), batch.offsets[1:].tolist())], pa.bool_())
        table = table.set_column(names.index(text), text, changed.cast(table.schema.field(text).type))
        if length in names:
            at = names.index(length)
            table = table.set_column(at, length, pc.utf8_length(changed).cast(table.schema.field(length).type))
        return table.filter(pc.invert(empty)).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if pc.sum(pc.invert(empty)).as_py() else table.schema.empty_table().to_batches()[0] if table.schema.empty_table().to_batches() else pa.RecordBatch.from_pylist([], schema=table.schema)

    return removals(docs, id, text, cut, docs.schema)
