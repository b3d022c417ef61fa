"""Exact top-k by inner product: tiled matrix products, partial selection in each tile, tree merging of the lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.llm import tiles

STRIP = 256
FOUND = "query_id long, shard int, vec_id long, score long"


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors without rounding: doubles while they hold every sum, else longs."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if bound < 2.0**53:
        return queries @ vectors.T
    if bound < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    raise OverflowError("inner products do not fit a long")


def select(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the ``k`` largest entries of each row and which of them count; of equal ones the first come first."""
    k = min(k, score.shape[1])
    picked = np.empty((len(score), k), np.int64)
    real = np.empty((len(score), k), bool)
    every = np.arange(len(score))
    none = -np.inf if score.dtype == np.float64 else np.iinfo(np.int64).min
    for j in range(k):
        at = score.argmax(axis=1)
        picked[:, j], real[:, j] = at, score[every, at] > none
        score[every, at] = none
    return picked, real


def exact_topk(data: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of ``data`` with the highest inner product for each query: query_id, rank, vec_id, score (long).

    Components become ``floor(scale * x)``, so scores are whole numbers and ties are real; they go to the smaller id. A
    row is no result of the query with its own id. Rows whose id or vector is null, or with a null or non-finite
    component, take no part; queries without a candidate give no row; an empty table gives none. A repeated id counts as
    one query and as several candidates. All vectors have one length. Other columns are ignored.
    """
    whole = lambda df: tiles.usable(df, id, vector).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")))
    vectors, asked = whole(data), whole(queries)
    rows, count = vectors.count(), asked.count()
    shards = tiles.shard_count(rows, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def tile(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return tiles.rows_of(np.zeros(0, np.int64), 0, np.zeros(0, np.int64), np.zeros(0, np.int64))
        shard = shard.sort_by("vec_id")
        ids, x = np.asarray(shard["vec_id"]), tiles.matrix(shard["v"], shard.num_rows)
        asked_ids, q = np.asarray(block["query_id"]), tiles.matrix(block["v"], block.num_rows)
        parts = []
        for at in range(0, len(q), STRIP):
            own = asked_ids[at : at + STRIP]
            score = products(q[at : at + STRIP], x)
            begin, end = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            for i in np.flatnonzero(end > begin):
                score[i, begin[i] : end[i]] = -np.inf if score.dtype == np.float64 else np.iinfo(np.int64).min
            kept = score.copy()
            picked, real = select(score, k)
            row, col = np.nonzero(real)
            at_col = picked[row, col]
            parts.append(tiles.rows_of(own[row], shard["shard"][0].as_py(), ids[at_col], kept[row, at_col].astype(np.int64)))
        return pa.concat_tables(parts)

    return tiles.search_tiles(tiles.sharded(vectors, shards), shards, asked, count, k, tile, FOUND)
