"""Forests of many rows: every tree is grown whole by a task, and the nodes of all trees are a written table.

Spark's fit adds up a histogram over all tasks for every node, however few rows it has, and the driver holds all nodes of
all trees. Here the rows go to the tasks once, as numbers of their bins, a byte for each value, and the driver holds the
nodes of some trees at most. Where the bins are too many for a task, Spark fits some trees at a time.

The trees are Spark's: drawn rows, a random subset of the features at each node, cuts between bins, the gain in Gini
impurity, and leaves below a node that predict the same class are one leaf. Cuts come from the values of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.session import shared_path

PART_NODES = 1 << 18  # nodes of the trees that are sent to the tasks together, about 10 MB; a larger tree goes alone
BINS = 32  # of a feature
GROWN_BYTES = 1 << 27  # rows x features of which every task can hold the bins
GROUP_NODES = 1 << 19  # nodes of the trees that Spark fits together where there are more
CHUNK_CELLS = 1 << 22  # rows x features that are summed up or put into bins together
CHUNK_VALUES = 1 << 10  # values of a feature that such a sum keeps
HISTOGRAM_CELLS = 1 << 20  # nodes x features x bins that are searched together
SCORED_ROWS = 1 << 16  # rows that walk a tree together
LEAST_GAIN = 1e-12

Tree = dict[str, np.ndarray]

NODES = "tree int, id int, left int, right int, count double, feature int, cut double, gain double, value double"


class Forest:
    """A forest as a written table of its nodes, with what the library asks of a model."""

    def __init__(self, spark: SparkSession, path: str, width: int) -> None:
        self.spark, self.path, self.numFeatures = spark, path, width
        found = {r.tree: r["count"] for r in self.nodes.groupBy("tree").count().collect()}
        self.sizes = [found[i] for i in sorted(found)]
        self.treeWeights = [1.0] * len(self.sizes)

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.schema(NODES).parquet(self.path)

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by feature, weighted by rows; every tree's add up to one, and so do all."""
        total = np.zeros((len(self.sizes), self.numFeatures))
        for r in self.nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("count")).alias("s")).collect():
            total[r.tree, r.feature] = r.s
        sums = total.sum(axis=1, keepdims=True)
        found = np.divide(total, sums, out=np.zeros_like(total), where=sums > 0).sum(axis=0)
        return Vectors.dense(found / found.sum() if found.sum() > 0 else found)

    def probability(self, features: Column) -> Column:
        """Probability of class 1: the mean of the trees' leaves."""
        parts = [self.spark.sparkContext.broadcast(part) for part in tree_parts(self.spark, self)]

        @F.pandas_udf("double")
        def mean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for held in together(batches, SCORED_ROWS):
                x = np.stack([v for batch in held for v in batch]).astype("float64")
                total = np.zeros(len(x))
                for part in parts:
                    for tree in opened(part):
                        total += walk(tree, x)
                ends = np.cumsum([len(batch) for batch in held])
                yield from (pd.Series(p) for p in np.split(total, ends[:-1]))

        return mean(features.cast("array<double>"))

    def save(self, path: str) -> None:
        """Write the forest, replacing an older one."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.spark.createDataFrame([(self.numFeatures,)], "features int").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        return cls(spark, f"{path}/nodes", spark.read.parquet(f"{path}/about").first().features)


def opened(part: Broadcast) -> list[Tree]:
    """Trees read from the worker's copy on disk, without keeping it: a worker holds one part at a time."""
    found = part.value
    part.__dict__.pop("_value", None)
    return found


def together(batches: Iterator, rows: int) -> Iterator[list]:
    """Lists of batches that have about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield held
            held, n = [], 0
    if n:
        yield held


def gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have about so many rows."""
    for held in together(batches, rows):
        yield pd.concat(held, ignore_index=True)


def walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The values of the leaves that rows reach."""
    left, right, feature = (tree[c].astype(np.int64) for c in ("left", "right", "feature"))
    at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(open_ := open_[left[at[open_]] >= 0]):
        now = at[open_]
        at[open_] = np.where(x[open_, feature[now]] <= tree["cut"][now], left[now], right[now])
    return tree["value"][at]


# ---- nodes of a model ----------------------------------------------------------------------------------------------


def written_nodes(spark: SparkSession, path: str, boosted: bool) -> DataFrame:
    """The nodes of a model that Spark has written, numbered from 0 in each tree."""
    stats = F.col("nodeData.impurityStats")
    value = F.col("nodeData.prediction") if boosted else stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), "nodeData.id", F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.rawCount").cast("double").alias("count"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), "nodeData.gain", value.alias("value"),
    )


def tree_parts(spark: SparkSession, model) -> Iterator[list[Tree]]:
    """The trees of an ensemble as node arrays, some whole trees of about ``PART_NODES`` nodes at a time.

    ``value`` is a node's part of the model output: probability of class 1 for a forest, log-odds for boosted trees.
    """
    boosted = "GBT" in type(model).__name__
    if isinstance(model, Forest):
        nodes, sizes = model.nodes, model.sizes
    else:
        path = shared_path(spark, "model")
        model.write().save(path)
        nodes, sizes = written_nodes(spark, path, boosted), [tree.numNodes for tree in model.trees]
    weights = list(model.treeWeights)
    scale = [2.0 * w if boosted else 1.0 / len(weights) for w in weights]
    begin = 0
    while begin < len(sizes):
        end = begin + 1
        while end < len(sizes) and sum(sizes[begin : end + 1]) <= PART_NODES:
            end += 1
        rows = nodes.drop("gain").where(F.col("tree").between(begin, end - 1)).toPandas().sort_values(["tree", "id"])
        yield [{c: t[c].fillna(0).to_numpy() for c in ("left", "right", "count", "feature", "cut")} | {"value": scale[i] * t["value"].to_numpy()} for i, t in rows.groupby("tree")]
        begin = end


# ---- bins ----------------------------------------------------------------------------------------------------------


def kept_values(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their numbers; where they are many, some of them with the numbers of all up to them."""
    values, counts = np.unique(column, return_counts=True)
    if len(values) <= CHUNK_VALUES:
        return values, counts
    ends = np.cumsum(counts)
    at = np.unique(np.searchsorted(ends, np.linspace(ends[-1] / CHUNK_VALUES, ends[-1], CHUNK_VALUES)))
    at = np.unique(np.append(np.minimum(at, len(ends) - 1), len(ends) - 1))
    return values[at], np.diff(ends[at], prepend=0)


def cuts_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cuts between all values where these are few, else at the quantiles."""
    values, number = np.unique(values, return_inverse=True)
    ends = np.cumsum(np.bincount(number, counts))
    if len(values) <= BINS:
        at = np.arange(len(values) - 1)
    else:
        aim = ends[-1] / BINS * np.arange(1, BINS)
        at = np.minimum(np.searchsorted(ends, aim), len(values) - 2)
        at = np.unique(np.where((at > 0) & (aim - ends[at - 1] < ends[at] - aim), at - 1, at))
    cuts = (values[at] + values[at + 1]) / 2
    return np.unique(cuts[~np.isnan(cuts)])


def bins_of(df: DataFrame, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Cuts of every feature, bins of all rows, and labels."""
    rows, lines = max(1, CHUNK_CELLS // width), df.select("y", F.col("features").cast("array<double>").alias("features"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in gathered(batches, rows):
            x = np.stack(batch["features"].to_numpy())
            for f in range(x.shape[1]):
                values, counts = kept_values(x[:, f])
                yield pd.DataFrame({"feature": [f], "kept": [values.tobytes()], "counts": [counts.astype(np.int64).tobytes()]})

    found = lines.mapInPandas(summed, "feature int, kept binary, counts binary").toPandas()
    read = lambda cells, kind: np.concatenate([np.frombuffer(c, kind) for c in cells])
    cuts = [cuts_of(read(t["kept"], np.float64), read(t["counts"], np.int64)) for _, t in found.groupby("feature")]

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in gathered(batches, rows):
            x = np.stack(batch["features"].to_numpy())
            bins = np.column_stack([np.searchsorted(c, x[:, f]).astype(np.uint8) for f, c in enumerate(cuts)])
            yield pd.DataFrame({"bins": [bins.tobytes()], "y": [batch["y"].to_numpy().astype(np.uint8).tobytes()]})

    put_in = lines.mapInPandas(put, "bins binary, y binary").toPandas()
    return cuts, read(put_in["bins"], np.uint8).reshape(-1, width), read(put_in["y"], np.uint8)


# ---- growing -------------------------------------------------------------------------------------------------------


def best_cuts(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, times: np.ndarray, hits: np.ndarray, features: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The best cut of every node: gain, place in the node's ``features``, last bin of the left side, and its rows and
    positive rows. ``rows`` are at ``node``, drawn so many ``times``."""
    nodes, subset = features.shape
    count, positive = (np.empty((nodes, subset, BINS)) for _ in range(2))
    for j in range(subset):
        cell = node * BINS + bins[rows, features[node, j]]
        count[:, j] = np.bincount(cell, times, nodes * BINS).reshape(nodes, BINS)
        positive[:, j] = np.bincount(cell, hits, nodes * BINS).reshape(nodes, BINS)
    count, positive = count.cumsum(axis=2), positive.cumsum(axis=2)
    every, yes = count[:, :, -1:], positive[:, :, -1:]
    low, low_yes = count[:, :, :-1], positive[:, :, :-1]
    high, high_yes = every - low, yes - low_yes
    spread = low_yes * (low - low_yes) / np.maximum(low, 1) + high_yes * (high - high_yes) / np.maximum(high, 1)
    gain = 2 * (yes * (every - yes) / every - spread) / every
    gain = np.where((low >= least) & (high >= least), gain, -1.0).reshape(nodes, -1)
    best, each = gain.argmax(axis=1), np.arange(nodes)
    j, last = best // (BINS - 1), best % (BINS - 1)
    return gain[each, best], j, last, low[each, j, last], low_yes[each, j, last]


def grown_tree(bins: np.ndarray, y: np.ndarray, cuts: Sequence[np.ndarray], rng: np.random.Generator, depth: int, least: int, subset: int, bootstrap: bool) -> Tree:
    """One tree, level by level."""
    n, width = bins.shape
    times = rng.poisson(1.0, n) if bootstrap else np.ones(n, np.int64)
    rows = np.flatnonzero(times)
    times = times[rows].astype(np.float64)
    hits = times * y[rows]
    node = np.zeros(len(rows), np.int64)
    count, positive = np.array([times.sum()]), np.array([hits.sum()])
    cut_at = np.array([np.pad(c, (0, BINS - len(c))) for c in cuts])
    levels, begin, step = [], 0, max(1, HISTOGRAM_CELLS // (subset * BINS))
    while len(count):
        size = len(count)
        level = {"count": count, "value": positive / count, "yes": positive, "left": np.full(size, -1), "right": np.full(size, -1),
                 "feature": np.full(size, -1), "cut": np.zeros(size), "gain": np.full(size, -1.0)}
        levels.append(level)
        begin += size
        open_ = np.flatnonzero((len(levels) <= depth) & (positive > 0) & (positive < count) & (count >= 2 * least))
        # rows of closed nodes go, the others are in the order of their nodes
        number = np.full(size, -1)
        number[open_] = np.arange(len(open_))
        node = number[node]
        order = np.argsort(node, kind="stable")
        order = order[np.searchsorted(node[order], 0) :]
        rows, times, hits, node = rows[order], times[order], hits[order], node[order]
        drawn = np.argpartition(rng.random((len(open_), width)), subset - 1, axis=1)[:, :subset] if subset < width else np.tile(np.arange(width), (len(open_), 1))
        found = []
        for i in range(0, len(open_), step):
            a, b = np.searchsorted(node, [i, i + step])
            found.append(best_cuts(bins, rows[a:b], node[a:b] - i, times[a:b], hits[a:b], drawn[i : i + step], least))
        if not found:
            break
        gain, j, last, low, low_yes = (np.concatenate(c) for c in zip(*found))
        split = gain > LEAST_GAIN
        feature, at = drawn[np.arange(len(open_)), j], open_[split]
        child = 2 * (np.cumsum(split) - 1)  # place of the left child in the next level
        level["feature"][at], level["cut"][at], level["gain"][at] = feature[split], cut_at[feature, last][split], gain[split]
        level["left"][at], level["right"][at] = begin + child[split], begin + child[split] + 1
        stays = split[node]
        rows, times, hits, node = rows[stays], times[stays], hits[stays], node[stays]
        node = child[node] + (bins[rows, feature[node]] > last[node])
        count = np.column_stack([low, count[open_] - low])[split].ravel()
        positive = np.column_stack([low_yes, positive[open_] - low_yes])[split].ravel()
    return pruned(levels)


def pruned(levels: list[Tree]) -> Tree:
    """The nodes of all levels; leaves with one parent that predict the same class give way to it."""
    tree = {c: np.concatenate([level[c] for level in levels]) for c in levels[0]}
    left, right, says = tree["left"], tree["right"], 2 * tree["yes"] > tree["count"]
    ends = np.cumsum([len(level["count"]) for level in levels])
    for end, level in zip(ends[::-1], levels[::-1]):
        inner = np.arange(end - len(level["count"]), end)
        inner = inner[left[inner] >= 0]
        a, b = left[inner], right[inner]
        same = inner[(left[a] < 0) & (left[b] < 0) & (says[a] == says[b])]
        left[same] = right[same] = tree["feature"][same] = -1
        tree["gain"][same] = -1.0
    alive = np.zeros(len(left), bool)
    alive[0] = True
    for end, level in zip(ends, levels):
        inner = np.arange(end - len(level["count"]), end)
        inner = inner[alive[inner] & (left[inner] >= 0)]
        alive[left[inner]] = alive[right[inner]] = True
    number = np.append(np.cumsum(alive) - 1, -1)
    out = {c: v[alive] for c, v in tree.items() if c != "yes"}
    return out | {"left": number[out["left"]], "right": number[out["right"]]}


def grow(df: DataFrame, n: int, width: int, trees: int, seed: int, depth: int, least: int, subset: str, bootstrap: bool) -> Forest:
    """A forest of ``n`` rows ``(y, features)`` of both classes, ``width`` features each."""
    spark = df.sparkSession
    path = shared_path(spark, "forest")
    if n * width > GROWN_BYTES:
        return by_groups(df, n, width, trees, seed, depth, least, subset, bootstrap, path)
    cuts, bins, y = bins_of(df, width)
    held, some = spark.sparkContext.broadcast((bins, y)), width if subset == "all" else ceil(sqrt(width))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, y = held.value
        for batch in batches:
            for number in batch["id"].tolist():
                tree = grown_tree(bins, y, cuts, np.random.default_rng([seed, number]), depth, least, some, bootstrap)
                yield pd.DataFrame({"tree": number, "id": np.arange(len(tree["left"]))} | tree)

    tasks = min(trees, 4 * spark.sparkContext.defaultParallelism)
    spark.range(0, trees, 1, tasks).mapInPandas(run, NODES).write.parquet(path)
    held.destroy()
    return Forest(spark, path, width)


def by_groups(df: DataFrame, n: int, width: int, trees: int, seed: int, depth: int, least: int, subset: str, bootstrap: bool, path: str) -> Forest:
    """Spark's fit for some trees at a time, whose nodes the driver holds until they are written."""
    spark, size = df.sparkSession, max(1, GROUP_NODES * least // (2 * n))
    rows = df.withColumn("_x", array_to_vector(F.col("features").cast("array<double>")))
    for number, first in enumerate(range(0, trees, size)):
        model = RandomForestClassifier(
            featuresCol="_x", labelCol="y", numTrees=min(size, trees - first), maxDepth=depth, featureSubsetStrategy=subset, seed=seed + number,
            bootstrap=bootstrap, minInstancesPerNode=least, maxMemoryInMB=512, cacheNodeIds=True,
        ).fit(rows)
        model.write().save(one := shared_path(spark, "model"))
        nodes = written_nodes(spark, one, False).withColumn("tree", F.col("tree") + first)
        nodes.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in NODES.split(", ")]).write.mode("append").parquet(path)
    return Forest(spark, path, width)
