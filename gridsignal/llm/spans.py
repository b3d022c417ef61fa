"""Substring deduplication by sliding sentence spans.

From every sentence, the shortest run of at least ``SENTENCES`` sentences and ``WORDS`` words is hashed. Runs meet in
buckets of the hash space, which learn the smallest document that has each; all later occurrences of a run lose the
sentences that it covers. A batch announces a run once, so that a passage of very many documents is no large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gridsignal.llm import blobs
from gridsignal.llm.blobs import ids_of, mix, text_bytes
from gridsignal.llm.exchange import KEYS, MASKS, bits_of, key_rows, with_masks
from gridsignal.llm.shingles import powers, prefix_hashes

SENTENCES = 2
WORDS = 10
PIECE = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 13]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begin, end, hash and number of words of every sentence, and the number of its text.

    Words are parted by spaces, tabs and line ends; a sentence ends where a word ends in ``.``, ``!`` or ``?``, or a line.
    """
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], solid[:-1]])[: len(data)]
    after = np.concatenate([solid[1:], [False]])[: len(data)]
    start = np.flatnonzero(solid & (~before | first[:-1]))
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(start), bool)
    opens[1:] = (row[1:] != row[:-1]) | STOP[data[end[:-1] - 1]] | (breaks[start[1:]] > breaks[end[:-1]])
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(start)) - 1 if len(at) else at
    begin, finish = start[at], end[last]
    prefix = prefix_hashes(data)
    _, down = powers(max(1, len(data)))
    content = mix((prefix[finish] - prefix[begin]) * down[begin] + (finish - begin).astype(np.uint64))
    return begin, finish, content, last - at + 1, row[at]


class Batch:
    """Texts of a batch with their sentences and runs."""

    def __init__(self, blob: bytes, id: str, text: str) -> None:
        self.table = blobs.unseal(blob)
        self.ids = ids_of(self.table[id])
        self.data, self.offsets = text_bytes(self.table[text])
        parts = []
        a = 0
        while a < len(self.offsets) - 1:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + PIECE, "right")) - 1)
            base = self.offsets[a]
            begin, end, content, words, row = sentences(self.data[base : self.offsets[b]], self.offsets[a : b + 1] - base)
            parts.append((begin + base, end + base, content, words, row + a))
            a = b
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
        self.begin, self.end, content, words, self.row = columns
        self.bounds = np.searchsorted(self.row, np.arange(len(self.offsets)))  # first sentence of each text
        total = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
        n = len(self.begin)
        stop = np.maximum(np.arange(n) + SENTENCES, np.searchsorted(total, total[:-1] + WORDS))
        whole = np.flatnonzero(stop <= self.bounds[1:][self.row]) if n else np.zeros(0, np.int64)
        self.first, self.stop = whole, stop[whole]  # runs as sentences from and to
        _, down = powers(max(1, n))
        up, _ = powers(max(1, n))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(content.astype(np.uint64) * up[:n], dtype=np.uint64)])
        self.keys = mix((sums[self.stop] - sums[self.first]) * down[self.first] + (self.stop - self.first).astype(np.uint64))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of runs by key, document and place; marks of the first run of each key; owners of these."""
        owner = self.ids[self.row[self.first]]
        order = np.lexsort((self.first, owner, self.keys))
        k = self.keys[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        return order, head, owner[order][head]

    def repeated(self, first_here: np.ndarray) -> np.ndarray:
        """Sentences that a run covers which is not the first of its key; ``first_here`` marks the distinct keys whose
        first run is in this batch."""
        order, head, _ = self.distinct()
        again = order[~(head & first_here[np.cumsum(head) - 1])] if len(order) else order
        change = np.zeros(len(self.begin) + 1, np.int64)
        np.add.at(change, self.first[again], 1)
        np.add.at(change, self.stop[again], -1)
        return np.cumsum(change[:-1]) > 0


def first_masks(batches: DataFrame, id: str, text: str, buckets: int) -> DataFrame:
    """``batch, bucket, mask``: which of a batch's distinct runs have their first occurrence in it."""

    def announce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for number, blob in zip(part.column(0).to_pylist(), part.column(1)):
                batch = Batch(blob.as_py(), id, text)
                order, head, owner = batch.distinct()
                keys = batch.keys[order][head]
                cut = blobs.bucket_edges(keys, buckets).tolist()
                filled = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                spans = [slice(cut[b], cut[b + 1]) for b in filled]
                yield key_rows(filled, number, [(blobs.pack_sorted(keys[s]), blobs.pack(owner[s]), None) for s in spans])

    def meet(key: tuple, parts: pa.Table) -> pa.Table:
        keys = [blobs.unpack_sorted(k) for k in parts["keys"].to_pylist()]
        owner = np.concatenate([blobs.unpack(e, np.int64) for e in parts["extra"].to_pylist()])
        batch = np.repeat(np.asarray(parts["batch"]), [len(k) for k in keys])
        joined = np.concatenate(keys)
        order = np.lexsort((batch, owner, joined))
        first = np.empty(len(joined), bool)
        k = joined[order]
        first[order] = np.concatenate([[True], k[1:] != k[:-1]])
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        masks = [np.packbits(first[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"batch": parts["batch"], "bucket": parts["bucket"], "mask": pa.array(masks, pa.binary())})

    return batches.select("batch", "blob").mapInArrow(announce, KEYS).groupBy("bucket").applyInArrow(meet, MASKS)


def removals(docs: DataFrame, id: str, text: str, finish: Callable[[Batch, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    batches = blobs.write_batches(docs, text)
    buckets = blobs.bucket_count(batches)
    masks = first_masks(batches, id, text, buckets)

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for r in part.to_pylist():
                batch = Batch(r["blob"], id, text)
                order, head, _ = batch.distinct()
                yield finish(batch, batch.repeated(bits_of(r["masks0"], batch.keys[order][head], buckets)))

    return with_masks(batches, masks).mapInArrow(apply, schema)


DIGEST = "doc_id long, n_sentences long, n_removed long, kept_sha256 string"


def dedup_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """What each document loses: ``doc_id, n_sentences, n_removed`` and the SHA-256 of the kept sentences, one on a line.

    The first occurrence of a run is the one in the document with the smallest id, and there the one that comes first;
    null ids are larger than all others, and of rows with the same id any one comes first. Null and empty texts have no
    sentences. No documents give no rows; other columns are ignored.
    """

    def digest(batch: Batch, gone: np.ndarray) -> pa.RecordBatch:
        raw = batch.data.tobytes()
        total, removed, kept = [], [], []
        for a, b in zip(batch.bounds[:-1].tolist(), batch.bounds[1:].tolist()):
            total.append(b - a)
            removed.append(int(gone[a:b].sum()))
            left = [raw[batch.begin[i] : batch.end[i]] for i in range(a, b) if not gone[i]]
            kept.append(hashlib.sha256(b"\n".join(left)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [pc.cast(batch.table[id].combine_chunks(), pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=[f.split()[0] for f in DIGEST.split(", ")],
        )

    return removals(docs.select(id, text), id, text, digest, DIGEST)


def dedup_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the sentences that later occurrences cover, with all columns. A removed sentence goes with the
    space up to the next one; null texts stay null."""
    names = docs.columns

    def cut(batch: Batch, gone: np.ndarray) -> pa.RecordBatch:
        raw, texts = batch.data.tobytes(), []
        for t, (a, b) in enumerate(zip(batch.bounds[:-1].tolist(), batch.bounds[1:].tolist())):
            low, high = int(batch.offsets[t]), int(batch.offsets[t + 1])
            ends = [*batch.begin[a + 1 : b].tolist(), high]
            head = raw[low : int(batch.begin[a])] if a < b else raw[low:high]
            texts.append((head + b"".join(raw[batch.begin[i] : ends[i - a]] for i in range(a, b) if not gone[i])).decode())
        table = batch.table
        given = table[text].combine_chunks()
        kept = pc.if_else(pc.is_null(given), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
        return table.set_column(names.index(text), text, kept.cast(given.type)).combine_chunks().to_batches(max_chunksize=1 << 30)[0]

    return removals(docs, id, text, cut, docs.schema)
