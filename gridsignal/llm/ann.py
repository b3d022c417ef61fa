"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector is centred, rotated at random and kept as the signs of its coordinates, with two numbers: its length and the
inner product of the unit vector with its code. The inner product with a query is estimated from the signs alone; the
distribution of the random rotation bounds the error of the estimate. Vectors whose upper bound reaches the k-th best
exact score found so far are reranked on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.llm import tiles
from gridsignal.session import settle

ERROR_WIDTH = 1.9
STRIP = 128
INDEX = "shard int, rows long, ids binary, vectors binary, codes binary, lengths binary, aligned binary"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def build_index(data: DataFrame, id: str = "vec_id", vector: str = "embedding", seed: int = 17) -> tuple[DataFrame, dict]:
    """One settled row per shard with the ids, original vectors, packed one-bit codes and correction scalars of every
    usable row, and what a search needs besides: the centre (mean of all rows), the seed and the number of shards."""
    vectors = tiles.usable(data, id, vector, nonzero=True)
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    rows, dim = facts["n"], facts["dim"] or 0
    means = vectors.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("mean")).orderBy("pos").limit(dim).collect()
    centre = np.array([m["mean"] for m in means])
    shards = tiles.shard_count(rows, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def encode(key: tuple, shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("vec_id")
        x = tiles.matrix(shard["v"], shard.num_rows)
        turned = (x - centre) @ rotation(dim, seed).T
        lengths = np.linalg.norm(turned, axis=1)
        signs = turned > 0
        aligned = np.abs(turned).sum(axis=1) / np.sqrt(dim) / np.where(lengths > 0, lengths, 1)
        packed = np.packbits(signs, axis=1)
        one = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([len(x)], pa.int64()),
            "ids": one(np.asarray(shard["vec_id"], dtype=np.int64)), "vectors": one(x), "codes": one(packed),
            "lengths": one(lengths.astype(np.float32)), "aligned": one(np.where(lengths > 0, aligned, 1).astype(np.float32)),
        })

    index = settle(tiles.sharded(vectors, shards).groupBy("shard").applyInArrow(encode, INDEX))
    return index, {"centre": centre, "dim": dim, "seed": seed, "shards": shards, "rows": rows}


def search(index: DataFrame, facts: dict, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", width: float = ERROR_WIDTH) -> DataFrame:
    """The ``k`` nearest found for each query by inner product: query_id, rank, vec_id, score.

    ``width`` is the number of standard errors by which an estimate may miss; larger values rerank more and find more.
    Scores are exact inner products of the original vectors in double precision. Ties go to the smaller id, and equal
    vectors of a shard are scored once. A row is no result of the query with its own id. Rows whose id or vector is
    null, all zero, or has a null or non-finite component take no part. A repeated id counts as one query.
    """
    asked = tiles.usable(queries, id, vector, nonzero=True)
    dim, centre, seed = facts["dim"], facts["centre"], facts["seed"]

    def tile(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return tiles.NOTHING
        cell = lambda name, dtype: np.frombuffer(shard[name][0].as_py(), dtype)
        number, n = shard["shard"][0].as_py(), shard["rows"][0].as_py()
        ids, x = cell("ids", np.int64), cell("vectors", np.float64).reshape(n, dim)
        # rows are in the order of ids: the first k + 1 rows of equal vectors are all that one query can ask for
        _, first, group = np.unique(x.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        members = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[members], np.arange(len(first) + 1))
        bits = np.unpackbits(cell("codes", np.uint8).reshape(n, -1)[first], axis=1)[:, :dim]
        signs = (bits.astype(np.float32) * 2 - 1).T / np.float32(np.sqrt(dim))
        aligned = cell("aligned", np.float32)[first]
        factor = cell("lengths", np.float32)[first] / aligned
        error = factor * np.sqrt(np.maximum(1 - aligned**2, 0)) * np.float32(width / np.sqrt(max(dim - 1, 1)))
        unique = x[first]
        asked_ids, q = np.asarray(block["query_id"]), tiles.matrix(block["v"], block.num_rows)
        turn, probe = rotation(dim, seed), min(len(first), max(64, 3 * k))
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(q), STRIP):
            part = q[at : at + STRIP]
            estimate = ((part @ turn.T).astype(np.float32) @ signs) * factor + (part @ centre).astype(np.float32)[:, None]
            top = np.argpartition(estimate, len(first) - probe, axis=1)[:, len(first) - probe :]
            length = np.linalg.norm(part, axis=1).astype(np.float32)
            for i in range(len(part)):
                own = asked_ids[at + i]
                chosen = top[i]
                score = (unique[chosen] * part[i]).sum(axis=1)
                reach = kth(score, chosen, begin, k)
                upper = estimate[i] + length[i] * error
                upper[chosen] = -np.inf
                more = np.flatnonzero((upper >= reach) & (upper > -np.inf))  # those scored already have no bound
                if len(more):
                    chosen = np.concatenate([chosen, more])
                    score = np.concatenate([score, (unique[more] * part[i]).sum(axis=1)])
                order = np.argsort(-score)
                rows, values = expand(chosen[order], score[order], begin, members, k + 1)
                keep = ids[rows] != own
                rows, values = rows[keep], values[keep]
                best = np.lexsort((ids[rows], -values))[:k]
                out_q.append(np.full(len(best), own)), out_v.append(ids[rows[best]]), out_s.append(values[best])
        return tiles.rows_of(np.concatenate(out_q), number, np.concatenate(out_v), np.concatenate(out_s))

    return tiles.search_tiles(index, facts["shards"], asked, asked.count(), k, tile)


def kth(score: np.ndarray, groups: np.ndarray, begin: np.ndarray, k: int) -> float:
    """A score that at least ``k`` rows besides the query's own reach: a lower bound for the k-th best of the shard."""
    order = np.argsort(-score)
    rows = np.cumsum(begin[groups[order] + 1] - begin[groups[order]])
    at = int(np.searchsorted(rows, k + 1))
    return score[order[at]] if at < len(order) else -np.inf


def expand(groups: np.ndarray, score: np.ndarray, begin: np.ndarray, members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the best groups of equal vectors, ``most`` of each: no list of so many can need more."""
    sizes = np.minimum(begin[groups + 1] - begin[groups], most)
    enough = int(np.searchsorted(np.cumsum(sizes), most)) + 1
    if enough < len(groups):
        enough = int(np.searchsorted(-score, -score[enough - 1], "right"))  # with all that tie with the last one
    groups, score, sizes = groups[:enough], score[:enough], sizes[:enough]
    rows = np.concatenate([members[begin[g] : begin[g] + s] for g, s in zip(groups, sizes)]) if len(groups) else np.zeros(0, np.int64)
    return rows.astype(np.int64), np.repeat(score, sizes)


def neighbours(data: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", seed: int = 17, width: float = ERROR_WIDTH) -> DataFrame:
    """Index all of ``data`` and search it; see ``build_index`` and ``search``. Empty data gives no rows."""
    index, facts = build_index(data, id, vector, seed)
    return search(index, facts, queries, k, id, vector, width)
