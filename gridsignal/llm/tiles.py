"""Queries against all vectors, tile by tile: the exchange and the merging that the vector searches share.

Vectors go to shards and queries to blocks, both of bounded size. A tile is a pair of one shard and one block and gives
``k`` rows for each of its queries; the lists of a query are merged as a tree. No pair of rows leaves a tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SHARD_ROWS = 1 << 16
BLOCK_QUERIES = 1 << 12
FAN_IN = 32

FOUND = "query_id long, shard int, vec_id long, score double"


def usable(df: DataFrame, id: str, vector: str, nonzero: bool = False) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part: id and vector not null, every component finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    keep = F.col(id).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))
    if nonzero:
        keep = keep & F.exists(v, lambda x: x != 0)
    return df.where(keep).select(F.col(id).cast("long").alias("vec_id"), v.alias("v"))


def shard_count(rows: int, least: int, size: int = SHARD_ROWS) -> int:
    return max(1, math.ceil(rows / size), min(least, math.ceil(rows / 512)))


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """List column of equally long vectors as a matrix."""
    flat = np.asarray(pc.list_flatten(column), dtype=np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def sharded(vectors: DataFrame, shards: int) -> DataFrame:
    return vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))


def query_blocks(queries: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Queries with the number of their block. A repeated id is one query: the smallest of its vectors."""
    blocks = max(1, math.ceil(count / BLOCK_QUERIES))
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.select(
        F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block")
    ), blocks


def search_tiles(
    shards_of: DataFrame, shards: int, queries: DataFrame, count: int, k: int, tile: Callable[[pa.Table, pa.Table], pa.Table], found: str = FOUND
) -> DataFrame:
    """Run ``tile`` on every pair of a shard (rows of ``shards_of`` with ``shard``) and a block of queries."""
    blocked, blocks = query_blocks(queries, count)
    left = shards_of.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    lists = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(tile, found)
    return merge(lists, shards, k)


def merge(found: DataFrame, shards: int, k: int) -> DataFrame:
    """Merge the lists of each query, ``FAN_IN`` at a time, until one is left; rank from 1."""
    order = [F.col("score").desc(), F.col("vec_id")]
    while shards > FAN_IN:
        shards = math.ceil(shards / FAN_IN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        part = W.partitionBy("query_id", "shard").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
    best = W.partitionBy("query_id").orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def rows_of(query_id: np.ndarray, shard: int, vec_id: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({
        "query_id": pa.array(query_id, pa.int64()), "shard": pa.array(np.full(len(query_id), shard), pa.int32()),
        "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score),
    })


NOTHING = rows_of(np.zeros(0, np.int64), 0, np.zeros(0, np.int64), np.zeros(0))
