"""Exchanges between batches and buckets of a hash space: which keys of a batch do other documents have?"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.llm import blobs

KEYS = "bucket int, batch long, keys binary, extra binary, bytes binary"
MASKS = "batch long, bucket int, mask binary"
HOT_MASKS = MASKS + ", hot binary, hot_heads long"
SPARE_BITS = 12


def key_bits(raw: int) -> int:
    """Bits of a key that only filters: ``SPARE_BITS`` more than the corpus has bytes, so that few keys meet by chance."""
    return min(64, max(16, int(raw).bit_length() + SPARE_BITS))


def cut_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits`` of keys; the others are 0."""
    return keys & np.uint64((1 << 64) - (1 << (64 - bits)))


def key_rows(filled: list[int], number: int, values: list[tuple[bytes, bytes, bytes | None]]) -> pa.RecordBatch:
    keys, extra, content = zip(*values) if values else ((), (), ())
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(filled, pa.int32()), "batch": pa.array([number] * len(filled), pa.int64()), "keys": pa.array(keys, pa.binary()),
        "extra": pa.array(extra, pa.binary()), "bytes": pa.array(content, pa.binary()),
    })


def shared_masks(batches: DataFrame, keys_of: Callable[[bytes], tuple[np.ndarray, ...]], buckets: int, most: int | None = None) -> DataFrame:
    """``batch, bucket, mask``: which of a batch's distinct keys two documents have.

    ``keys_of`` gives the distinct keys of a batch, ascending, and marks of those that two of its documents have. With
    ``most``, it also gives how many heads the batch has of each key: rows that are to meet those of other batches. ``hot``
    marks the keys of which all batches have more than ``most`` heads (null for none), and ``hot_heads`` counts the
    batch's heads of them.
    """

    def announce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for number, blob in zip(part.column(0).to_pylist(), part.column(1)):
                keys, twice, *heads = keys_of(blob.as_py())
                counts = lambda s: blobs.pack(heads[0][s].astype(np.int64)) if heads else None
                cut = blobs.bucket_edges(keys, buckets).tolist()
                filled = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                yield key_rows(filled, number, [(blobs.pack_sorted(keys[cut[b] : cut[b + 1]]), np.packbits(twice[cut[b] : cut[b + 1]]).tobytes(), counts(slice(cut[b], cut[b + 1]))) for b in filled])

    def meet(key: tuple, parts: pa.Table) -> pa.Table:
        keys = [blobs.unpack_sorted(k) for k in parts["keys"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(e, np.uint8))[: len(k)].astype(bool) for e, k in zip(parts["extra"].to_pylist(), keys)]
        _, number, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[number[np.concatenate(twice)]] = True
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        masks = [np.packbits(shared[number[a:b]]).tobytes() for a, b in zip(cuts, cuts[1:])]
        out = pa.table({"batch": parts["batch"], "bucket": parts["bucket"], "mask": pa.array(masks, pa.binary())})
        if most is None:
            return out
        heads = np.concatenate([blobs.unpack(c, np.int64) for c in parts["bytes"].to_pylist()])
        total = np.zeros(len(count), np.int64)
        np.add.at(total, number, heads)
        hot = shared[number] & (total[number] > most)
        marks = [np.packbits(hot[a:b]).tobytes() if hot[a:b].any() else None for a, b in zip(cuts, cuts[1:])]
        sums = [int(heads[a:b][hot[a:b]].sum()) for a, b in zip(cuts, cuts[1:])]
        return out.append_column("hot", pa.array(marks, pa.binary())).append_column("hot_heads", pa.array(sums, pa.int64()))

    return batches.select("batch", "blob").mapInArrow(announce, KEYS).groupBy("bucket").applyInArrow(meet, MASKS if most is None else HOT_MASKS)


def with_masks(batches: DataFrame, *masks: DataFrame) -> DataFrame:
    """Batches with the masks that belong to them, as lists of bucket, mask and what other columns there are."""
    out = batches.select("batch", "blob")
    for i, mask in enumerate(masks):
        lists = mask.groupBy("batch").agg(F.collect_list(F.struct(*[c for c in mask.columns if c != "batch"])).alias(f"masks{i}"))
        out = out.join(lists.hint("shuffle_hash"), "batch", "left")
    return out


def bits_of(masks: list[dict] | None, keys: np.ndarray, buckets: int, field: str = "mask") -> np.ndarray:
    """The masks of a batch's buckets as marks of its distinct keys; a mask that is null marks none."""
    cut = blobs.bucket_edges(keys, buckets)
    out = np.zeros(len(keys), bool)
    for m in masks or []:
        if m[field] is None:
            continue
        begin, end = int(cut[m["bucket"]]), int(cut[m["bucket"] + 1])
        out[begin:end] = np.unpackbits(np.frombuffer(m[field], np.uint8))[: end - begin].astype(bool)
    return out
