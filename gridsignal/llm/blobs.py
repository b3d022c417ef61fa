"""Documents packed into batches, and number arrays packed into binary columns.

Passes that meet the same texts more than once read them from a table of batches, written once: a task that is repeated
after a lost executor sees the same batches with the same numbers. Exchanges carry packed arrays, one row per batch and
bucket, so that a row's overhead is paid once for many numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.session import settle

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
RECORDS = 1000

BATCHES = "batch long, raw long, blob binary"


def write_batches(df: DataFrame, text: str = "text", size: int = BATCH_BYTES) -> DataFrame:
    """``df`` as a settled table of batches: a number, the bytes of text, and the rows as a compressed Arrow stream.

    A batch ends when its texts reach ``size`` bytes; one row is never cut, so a longer text is a batch of its own.
    """

    def pack(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        held_bytes = 0
        for rows in tables:
            begin = 0
            lengths = np.asarray(pc.binary_length(rows.column(text)).fill_null(0), dtype=np.int64)
            for i, n in enumerate(lengths.tolist()):
                held_bytes += n
                if held_bytes >= size or i - begin >= 200_000:
                    held.append(rows.slice(begin, i + 1 - begin))
                    yield seal(first + made, held_bytes, held)
                    begin, made, held, held_bytes = i + 1, made + 1, [], 0
            if begin < rows.num_rows:
                held.append(rows.slice(begin))
        if held:
            yield seal(first + made, held_bytes, held)

    return settle(bounded_records(df).mapInArrow(pack, BATCHES))


def seal(number: int, raw: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(rows).combine_chunks()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_table(table)
    return pa.RecordBatch.from_pydict(
        {"batch": pa.array([number], pa.int64()), "raw": pa.array([raw], pa.int64()),
         "blob": pa.array([out.getvalue().to_pybytes()], pa.binary())}
    )


def unseal(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(blob)).read_all().combine_chunks()


def bucket_count(batches: DataFrame, weight: float = 1.0) -> int:
    """Buckets for an exchange: so many that one holds what ``BUCKET_BYTES`` of text give, and no fewer than the
    session's shuffle partitions."""
    raw = batches.agg(F.sum("raw")).first()[0] or 0
    least = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(raw * weight / BUCKET_BYTES), 1)


def bounded_records(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands at most ``RECORDS`` rows at a time to Python: rows hold whole texts here, and the
    default of 10,000 rows would have the JVM and the worker hold so many texts at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS))
    return df


# ---- packed numbers ------------------------------------------------------------------------------------------------


def pack(numbers: np.ndarray) -> bytes:
    """Eight-byte numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype=np.uint64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(memoryview(data)[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(dtype).reshape(n)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending unsigned numbers as compressed gaps."""
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def deflate(array: np.ndarray) -> bytes:
    """Any array as compressed bytes; the reader knows its type."""
    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def inflate(data: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(memoryview(data)[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(raw, dtype)


def bucket_edges(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the hash space begins and ends in ascending 64-bit hashes."""
    width = (1 << 64) // buckets + 1
    starts = np.array([i * width for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(ordered, starts), [len(ordered)]]).astype(np.int64)


# ---- texts as bytes ------------------------------------------------------------------------------------------------


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of the texts (one more than texts); null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array, "").cast(pa.large_string())
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Document ids as longs; null counts as larger than any other."""
    return np.asarray(pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).max), dtype=np.int64)


_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> _SHIFT)
    h *= _MULTIPLY
    h ^= h >> _SHIFT
    h *= _MULTIPLY
    return h ^ (h >> _SHIFT)
