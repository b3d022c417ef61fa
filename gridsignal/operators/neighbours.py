"""Exact k nearest neighbours by matrix products, block against block.

Points are described by their coordinates along a few leading directions and the length of what is left. The distance of
two descriptions bounds that of the points from below, in any number of dimensions: the leading parts differ at least as
they show, and the rests at least by the difference of their lengths. Points are cut into blocks of bounded size along the
first direction, and the boxes around their descriptions bound the distances between whole blocks.

Each block is searched against itself first, which gives every point an upper bound for its neighbours. A point then visits
only the blocks whose box is nearer than that. Copies of a vector are folded first, and a task returns only its best rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridsignal.operators.ordering import hash_draw
from gridsignal.session import settle

BLOCK_POINTS = 1 << 16
LEAST_POINTS = 256  # smaller blocks would cost more to start than to search
DIRECTIONS = 8
SAMPLE = 4096  # points from which the directions are taken; they change what is skipped, never what is found
STRIP_CELLS = 1 << 22

FOUND = "qid long, neighbour long, dist double"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def directions(points: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Middle and leading directions (columns) of a bounded sample: the points with the smallest keyed hashes."""
    rows = points.orderBy(hash_draw(seed, "direction", F.col("id")), "id").limit(SAMPLE).select("x").collect()
    x = np.array([r.x for r in rows], dtype="float64")
    middle = x.mean(axis=0)
    turn = np.linalg.svd(x - middle, full_matrices=False)[2][:DIRECTIONS].T
    return middle, turn


def described(points: DataFrame, middle: np.ndarray, turn: np.ndarray) -> DataFrame:
    """Points with their description ``y``: coordinates along the directions, and the length of the rest."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = matrix(batch.column("x")) - middle
                lead = away @ turn
                rest = np.sqrt(((away - lead @ turn.T) ** 2).sum(axis=1))
                y = np.column_stack([lead, rest])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), pa.list_(pa.float64()))], names=[*batch.schema.names, "y"])

    return points.mapInArrow(describe, "id long, x array<double>, _copy int, y array<double>")


def best_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, want: int) -> pa.Table:
    """The ``want`` nearest of ``x`` for each of ``q``, ties to the smaller id.

    Squared distances from one matrix product are good to rounding errors of the squares. What is within them of the last
    wanted one is measured again by differences, so that order and distances are as exact as those of a plain loop.
    """
    found = []
    take = min(want, len(ids))
    xx = (x * x).sum(axis=1)
    step = max(1, STRIP_CELLS // max(1, len(ids)))
    for lo in range(0, len(q), step):
        strip = q[lo : lo + step]
        qq = (strip * strip).sum(axis=1)
        about = qq[:, None] + xx[None, :] - 2 * (strip @ x.T)
        slack = 1e-13 * x.shape[1] * (qq + xx.max(initial=0.0))
        last = np.partition(about, take - 1, axis=1)[:, take - 1]
        row, col = np.nonzero(about <= (last + 2 * slack)[:, None])
        dist = np.empty(len(row))
        for i in range(0, len(row), max(1, STRIP_CELLS // x.shape[1])):
            part = slice(i, i + max(1, STRIP_CELLS // x.shape[1]))
            dist[part] = np.sqrt(((strip[row[part]] - x[col[part]]) ** 2).sum(axis=1))
        order = np.lexsort((ids[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < take
        found.append((qid[lo : lo + step][row[kept]], ids[col[kept]], dist[kept]))
    merged = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"qid": pa.array(merged[0], pa.int64()), "neighbour": pa.array(merged[1], pa.int64()), "dist": pa.array(merged[2], pa.float64())})


def blocks_of(points: DataFrame, count: int) -> DataFrame:
    """``points`` in ``count`` blocks of about equal size along the first direction, written once."""
    ranged = points.repartitionByRange(count, F.col("y")[0], "id")
    return settle(ranged.withColumn("block", F.spark_partition_id()))


def visits_of(placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """``qid, at``: the other blocks that each query has to visit. ``bounds`` has ``qid, bound``, distances that it needs
    nothing beyond."""
    width = len(placed.select("y").first()["y"])
    box = placed.groupBy("block").agg(*[f(F.col("y")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("lo", F.min), ("hi", F.max))])
    boxes = box.orderBy("block").collect()  # one row per block
    numbers = np.array([b.block for b in boxes], np.int32)
    low = np.array([[b[f"lo{i}"] for i in range(width)] for b in boxes])
    high = np.array([[b[f"hi{i}"] for i in range(width)] for b in boxes])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, own, bound = matrix(batch.column("y")), np.asarray(batch.column("block")), np.asarray(batch.column("bound"))
            rounding = 1e-12 * (np.abs(matrix(batch.column("x"))).max() + np.abs(low).max() + np.abs(high).max())
            step = max(1, STRIP_CELLS // (len(numbers) * width))
            for lo in range(0, len(y), step):
                part = slice(lo, lo + step)
                away = np.maximum(low[None] - y[part, None, :], 0) + np.maximum(y[part, None, :] - high[None], 0)
                near = np.sqrt((away * away).sum(axis=2))
                # descriptions and distances are rounded: a bound that is hardly reached does not count
                needed = near * (1 - 1e-9) - rounding <= bound[part, None]
                needed &= numbers[None] != own[part, None]
                row, col = np.nonzero(needed)
                pick = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("x").take(pick), pa.array(numbers[col])], names=["qid", "qx", "block"])

    asked = placed.where("_copy = 1").join(bounds.withColumnRenamed("qid", "id"), "id", "left").select("id", "x", "y", "block", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return asked.mapInArrow(visit, "qid long, qx array<double>, block int")


def searched(queries: DataFrame, placed: DataFrame, want: int, block_points: int) -> DataFrame:
    """Best rows of every query (``qid, qx, block``) in the block that it visits; blocks with many visits are several tasks."""
    sizes = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block_points).cast("int").alias("parts"))
    asked = queries.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
    left = asked.select(F.col("block").alias("at"), F.col("part").alias("of"), "qid", "qx")
    right = placed.select("block", "id", "x").join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", "id", "x")

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        return best_of(matrix(q["qx"]), np.asarray(q["qid"]), matrix(c["x"]), np.asarray(c["id"]), want)

    return left.groupBy("at", "of").cogroup(right.groupBy("block", "part")).applyInArrow(tile, FOUND)


def folded(points: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` smallest ids of every vector, written once; ``_copy`` numbers them from 1."""
    copies = W.partitionBy("x").orderBy("id")
    # a rank filter on row_number is applied on the map side too, so a vector with very many copies shuffles few rows
    return settle(points.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1))


def search(points: DataFrame, k: int, seed: int, block_points: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``qid, neighbour, dist`` with the best ``k + 1`` rows of every distinct vector in its own block and in those that it
    visits; the points in blocks; and the visits."""
    reps = folded(points, k)
    total = reps.count()
    if total == 0:
        raise ValueError("no points")
    least = math.ceil(total / max(1, 2 * points.sparkSession.sparkContext.defaultParallelism))
    size = min(block_points, max(LEAST_POINTS, least))
    placed = blocks_of(described(reps, *directions(reps, seed)), max(1, math.ceil(total / size)))
    queries = placed.where("_copy = 1").select(F.col("id").alias("qid"), F.col("x").alias("qx"), "block")
    own = settle(searched(queries, placed, k + 1, block_points))
    full = own.groupBy("qid").agg(F.max("dist").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("qid", "bound")
    visits = settle(visits_of(placed, full))
    return own.unionByName(searched(visits, placed, k + 1, block_points)), placed, visits


def nearest(points: DataFrame, k: int = 5, seed: int = 42, block_points: int = BLOCK_POINTS) -> DataFrame:
    """The ``k`` nearest other points of each point ``(id, x ARRAY<DOUBLE>)``: ``(id, rank, neighbour, dist)``.

    Equal distances go to the smaller id. Copies of a vector are folded first: only the ``k + 1`` smallest ids of a
    vector can be neighbours of anything, and all its copies share one search. Runs jobs when called.
    """
    points = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    found, placed, _ = search(points, k, seed, block_points)
    # a query has at most k + 1 rows from each block that it visits; the rank filter trims them on the map side first
    best = W.partitionBy("qid").orderBy("dist", "neighbour")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    near = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_r", "neighbour", "dist"))).alias("near"))
    queries = placed.where("_copy = 1").select(F.col("id").alias("qid"), "x")
    by_vector = queries.join(near, "qid").select("x", "near")

    def other(s: Column) -> Column:
        return s["neighbour"] != F.col("id")

    others = points.join(by_vector, "x").select("id", F.slice(F.filter("near", other), 1, k).alias("near"))
    return others.select("id", F.posexplode("near").alias("rank", "_s")).select("id", (F.col("rank") + 1).alias("rank"), "_s.neighbour", "_s.dist")


def search_effort(points: DataFrame, k: int = 5, seed: int = 42, block_points: int = BLOCK_POINTS) -> DataFrame:
    """What the search of ``nearest`` compares: ``pairs`` of a query and a point, ``compared`` ones, and the share ``skipped``."""
    points = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    _, placed, visits = search(points, k, seed, block_points)
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_copy") == 1).alias("own"))
    asked = visits.groupBy("block").agg(F.count(F.lit(1)).alias("asked"))
    cells = sizes.join(asked, "block", "left").agg(
        (F.sum("n") * F.sum("own")).alias("pairs"), F.sum(F.col("n") * (F.col("own") + F.coalesce("asked", F.lit(0)))).alias("compared")
    )
    return cells.withColumn("skipped", 1 - F.col("compared") / F.col("pairs"))
