"""Shapley attributions for tree ensembles, and their summaries.

Per leaf the value of a set of known features is a product over the features of its path: one factor where the row (or the
background) is inside the leaf's bounds. A feature's attribution is a weighted sum of such products over all sets, which is
an integral of one product over a line from "all unknown" to "all known". It is a polynomial, so a Gauss-Legendre rule with
half as many nodes as the path has features gives it exactly; against background rows it has a closed form.

Both depend on a row only by which bounds it keeps. Rows that agree on a path share its product, and what a few splits or a
short path can give is worked out once for each pattern of their outcomes; rows look it up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.operators.forest import Tree, gathered, opened, tree_parts, walk
from gridsignal.operators.models import SMALL_FOREST_TREES, side_by_side, train_forest, union_all
from gridsignal.operators.resample import FOLDS
from gridsignal.session import settle

BLOCK_CELLS = 1 << 18  # rows x leaves x path features that are worked on together
ROWS = 256
TASK_CELLS = 1 << 21  # rows x features that a task explains together
BLOCK_SPLITS = 6  # splits of a subtree that are put into one table
BLOCK_GROWTH = 8  # entries of such a table, as a multiple of the rows
LEAST_CELLS = 32

# Background rows of the sampled explainer, features shown in the stability plot.
BACKGROUND_ROWS = 100
TOP_FEATURES = 20

Leaves = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


# ---- trees ---------------------------------------------------------------------------------------------------------


def leaves_of(tree: Tree) -> list[Leaves]:
    """Leaves of a tree by the number of features on their path: values, and for each feature its number, the bounds of the
    leaf and the share of the training rows that follow the path when the feature is unknown."""
    at = np.zeros(1, np.int64)
    feature, low, high, share = np.full((1, 0), -1), np.zeros((1, 0)), np.zeros((1, 0)), np.zeros((1, 0))
    done = []
    while len(at):
        ends = tree["left"][at] < 0
        known = (feature >= 0).sum(axis=1)
        for d in np.unique(known[ends]):
            rows = ends & (known == d)
            done.append((tree["value"][at[rows]], *(a[rows, :d] for a in (feature, low, high, share))))
        inner = np.flatnonzero(~ends)
        # a column more, for a feature that the path has not met; features fill the columns from the left
        add = lambda a, fill: np.column_stack([a[inner], np.full(len(inner), fill)])
        feature, low, high, share, at = add(feature, -1), add(low, -np.inf), add(high, np.inf), add(share, 1.0), at[inner]
        met, cut, every = tree["feature"][at].astype(np.int64), tree["cut"][at], np.arange(len(at))
        same = feature == met[:, None]
        slot = np.where(same.any(axis=1), same.argmax(axis=1), (feature >= 0).sum(axis=1))
        feature[every, slot] = met
        sides = []
        for child, bounds, tighten in ((tree["left"][at], high, np.minimum), (tree["right"][at], low, np.maximum)):
            of, part = bounds.copy(), share.copy()
            of[every, slot] = tighten(bounds[every, slot], cut)
            part[every, slot] *= tree["count"][child] / tree["count"][at]
            sides.append((child.astype(np.int64), *((low, of) if bounds is high else (of, high)), part))
        at, low, high, share = (np.concatenate([x, y]) for x, y in zip(*sides))
        feature = np.concatenate([feature, feature])
    by_size: dict[int, list[Leaves]] = {}
    for leaves in done:
        by_size.setdefault(leaves[1].shape[1], []).append(leaves)
    return [tuple(np.concatenate(c) for c in zip(*group)) for group in by_size.values()]


# ---- attributions of some rows -------------------------------------------------------------------------------------


def inside(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    """Whether rows are inside the bounds of each path feature: leaves x rows x features, as numbers."""
    _, feature, low, high, _ = leaves
    v = x.T[feature].transpose(0, 2, 1)
    return ((v > low[:, None, :]) & (v <= high[:, None, :])).astype(np.float64)


@lru_cache
def line_rule(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on the line from 0 to 1 that integrate the products of ``d`` path features exactly."""
    node, weight = np.polynomial.legendre.leggauss(max(1, (d + 1) // 2))
    return (node + 1) / 2, weight / 2


def bits_of(patterns: int) -> np.ndarray:
    """All patterns of so many outcomes, one in a row."""
    return (np.arange(1 << patterns)[:, None] >> np.arange(patterns) & 1).astype(bool)


class Shares:
    """Attributions of rows by one tree where unknown features follow the training shares.

    The tree is walked once. Going down, rows are grouped by the path bounds they keep, and a group has the product of the
    path's factors at the nodes of the rule. Coming up, a row has the sum of the products of the leaves below. A split adds
    to its feature that sum, weighted by the feature's own factor, which is one number for inside and one for outside.
    Subtrees of a few splits are not walked: their sums are tables over the patterns of the outcomes of their splits.
    """

    def __init__(self, x: np.ndarray, tree: Tree, width: int) -> None:
        self.x, self.tree, self.columns = x, tree, np.ascontiguousarray(x.T)
        self.phi, self.cells = np.zeros((width, len(x))), BLOCK_GROWTH * max(len(x), LEAST_CELLS)
        self.left, self.right, self.feature = (tree[c].astype(np.int64) for c in ("left", "right", "feature"))
        self.cut, self.count, self.value = tree["cut"], tree["count"], tree["value"]
        self.below, longest = [0] * len(self.left), 0
        stack = [(0, frozenset())]
        order = []
        while stack:
            at, met = stack.pop()
            order.append(at)
            if self.left[at] < 0:
                longest = max(longest, len(met))
            else:
                met = met | {int(self.feature[at])}
                stack += [(int(self.left[at]), met), (int(self.right[at]), met)]
        for at in reversed(order):
            if self.left[at] >= 0:
                self.below[at] = 1 + self.below[self.left[at]] + self.below[self.right[at]]
        self.t, self.weight = line_rule(longest)
        self.lost = -1 / (1 - self.t)  # a feature's own factor outside, whatever its share

    def run(self) -> tuple[np.ndarray, float, np.ndarray]:
        """Attributions by row and feature, expected output, and output by row."""
        rows = len(self.x)
        self.sums(0, np.zeros(rows, np.int64), np.zeros((1, 0), bool), [], [], np.ones((1, len(self.t))))
        ends = self.left < 0
        return self.phi.T, float(self.value[ends] @ self.count[ends] / self.count[0]), walk(self.tree, self.x)

    def factors(self, share: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factors outside and inside the bounds at the nodes of the rule."""
        out = np.multiply.outer(share, 1 - self.t)
        return out, out + self.t

    def sums(self, at: int, group: np.ndarray, kept: np.ndarray, known: list[int], share: list[float], product: np.ndarray) -> np.ndarray:
        """Sums of the leaves below a node, rows x nodes of the rule; attributions of the features split there are added.

        ``group`` is the group of each row. Groups have ``kept``, the bounds of the features ``known`` on the path that
        they keep, and ``product``; ``share`` is that of the training rows, by feature.
        """
        if self.below[at] == 0:
            return (product * (self.value[at] * self.weight))[group]
        if self.below[at] <= BLOCK_SPLITS and len(kept) << self.below[at] <= self.cells:
            found = self.block(at, group, kept, known, share, product)
            if found is not None:
                return found
        f = int(self.feature[at])
        low = self.columns[f] <= self.cut[at]
        high, old, again = ~low, 1.0, f in known
        if again:
            i = known.index(f)
            old, had = share[i], kept[group, i]
            low, high = low & had, high & had
        # groups part by the outcome, those without rows are left out
        code = 2 * group + low
        seen = np.zeros(2 * len(kept), bool)
        seen[code] = True
        new = np.flatnonzero(seen)
        group = (np.cumsum(seen) - 1)[code]
        was, hit, before = kept[new >> 1], (new & 1).astype(bool), product[new >> 1]
        held = was[:, i] if again else np.ones(len(new), bool)
        if again:
            out, within = self.factors(old)
            before = before / np.where(held[:, None], within, out)
            over = (1 - old) / within
        total = None
        for child, side, of in ((int(self.left[at]), hit, low), (int(self.right[at]), ~hit & held, high)):
            part = old * self.count[child] / self.count[at]
            out, within = self.factors(part)
            if again:
                now, parts, met = was.copy(), list(share), known
                now[:, i], parts[i] = side, part
            else:
                now, parts, met = np.column_stack([was, side]), [*share, part], [*known, f]
            found = self.sums(child, group, now, met, parts, before * np.where(side[:, None], within, out))
            # the nodes above add for a feature that is met again as if it were not
            own = found @ np.stack([(1 - part) / within, self.lost, *([over] if again else [])], axis=1)
            self.phi[f] += np.where(of, own[:, 0], own[:, 1])
            if again:
                self.phi[f] -= np.where(had, own[:, 2], own[:, 1])
            total = found if total is None else np.add(total, found, out=total)
        return total

    def block(self, top: int, group: np.ndarray, kept: np.ndarray, known: list[int], share: list[float], product: np.ndarray) -> np.ndarray | None:
        """What ``sums`` does, for a subtree of a few splits; nothing if its table would be too large."""
        tests, leaves, stack = [], [], [(top, ())]
        while stack:
            at, path = stack.pop()
            if self.left[at] < 0:
                leaves.append((at, path))
                continue
            sides = ((int(self.left[at]), True), (int(self.right[at]), False))
            stack += [(child, (*path, (len(tests), side, self.count[child] / self.count[at]))) for child, side in sides]
            tests.append(at)
        inner = list(dict.fromkeys(int(self.feature[at]) for at in tests))
        again = [f for f in inner if f in known]
        bits = len(tests) + len(again)
        if len(kept) << bits > 4 * self.cells:
            return None
        # the pattern of a row: outcomes of the splits, then whether it keeps the path's bounds of features met again
        code = np.zeros(len(group), np.int64)
        for k, at in enumerate(tests):
            code |= (self.columns[self.feature[at]] <= self.cut[at]).astype(np.int64) << k
        pattern = bits_of(bits)
        inside, part = np.ones((len(leaves), len(inner), 1 << bits), bool), np.ones((len(leaves), len(inner)))
        above = {}
        for j, f in enumerate(again, len(tests)):
            k, i = inner.index(f), known.index(f)
            code |= (kept[:, i].astype(np.int64) << j)[group]
            inside[:, k], part[:, k] = pattern[:, j], share[i]
            out, within = self.factors(share[i])
            product = product / np.where(kept[:, i, None], within, out)
            above[k] = np.where(pattern[:, j, None], (1 - share[i]) / within, self.lost)
        if again:
            rest = [i for i, f in enumerate(known) if f not in again]
            _, first, to = np.unique(kept[:, rest] @ (1 << np.arange(len(rest), dtype=np.int64)), return_index=True, return_inverse=True)
            group, product = to[group], product[first]
        for i, (_, path) in enumerate(leaves):
            for k, side, ratio in path:
                j = inner.index(int(self.feature[tests[k]]))
                inside[i, j] &= pattern[:, k] == side
                part[i, j] *= ratio
        out, within = self.factors(part)
        inside = inside[..., None]
        lines = np.where(inside, within[:, :, None], out[:, :, None]).prod(axis=1)  # leaves x patterns x nodes
        lines *= self.value[[at for at, _ in leaves], None, None] * self.weight
        total = lines.sum(axis=0)
        own = (lines[:, None] * np.where(inside, ((1 - part)[:, :, None] / within)[:, :, None], self.lost)).sum(axis=0)
        for k, step in above.items():
            own[k] -= total * step
        place = group << bits | code
        for k, f in enumerate(inner):
            self.phi[f] += (product @ own[k].T).ravel()[place]
        return product[group] * total[code]


@lru_cache
def line_weights(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Integrals over the line for ``p`` features that only the row and ``q`` that only the background has inside: for one of
    the ``p``, and for one of the ``q``."""
    own, other = np.zeros((d + 1, d + 1)), np.zeros((d + 1, d + 1))
    for p in range(d + 1):
        for q in range(d + 1 - p):
            if p:
                own[p, q] = factorial(p - 1) * factorial(q) / factorial(p + q)
            if q:
                other[p, q] = factorial(p) * factorial(q - 1) / factorial(p + q)
    return own, other


def by_background(o: np.ndarray, z: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Attributions (leaves x rows x features) where unknown features take the values of background rows (``z`` like ``o``)."""
    d = o.shape[2]
    both = o @ z.transpose(0, 2, 1)  # leaves x rows x background rows
    p, q = o.sum(axis=2)[:, :, None] - both, z.sum(axis=2)[:, None, :] - both
    # a feature that neither has inside leaves nothing of the product
    met = p + q + both == d
    own, other = line_weights(d)
    p, q = p.astype(np.int64), q.astype(np.int64)
    gain = np.where(met, own[p, q], 0.0) @ (1 - z)
    loss = np.where(met, other[p, q], 0.0) @ z
    scale = value[:, None, None] / z.shape[1]
    return np.where(o > 0, gain, -loss) * scale


def attribute(x: np.ndarray, tree: list[Leaves], width: int, background: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Attributions by row and feature, expected output, and output by row of one tree, against background rows.

    A leaf's part of a row depends on the path bounds that the row keeps: where these have fewer patterns than there are
    rows, the parts are worked out for the patterns.
    """
    phi, base, output = np.zeros((len(x), width)), 0.0, np.zeros(len(x))
    for leaves in tree:
        d = leaves[1].shape[1]
        if d == 0:
            base, output = base + leaves[0].sum(), output + leaves[0].sum()
            continue
        few = d < 31 and 1 << d <= len(x)
        step = max(1, BLOCK_CELLS // (max(1 << d if few else 0, min(len(x), ROWS)) * max(d, len(background))))
        for i in range(0, len(leaves[0]), step):
            some = tuple(a[i : i + step] for a in leaves)
            z = inside(background, some)
            base += float(z.prod(axis=2).mean(axis=1) @ some[0])
            if few:
                table = by_background(np.broadcast_to(bits_of(d).astype(np.float64), (len(z), 1 << d, d)), z, some[0])
            # add up the leaves' parts feature by feature
            names = some[1].ravel()
            order = np.argsort(names, kind="stable")
            first = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
            for j in range(0, len(x), ROWS):
                o = inside(x[j : j + ROWS], some)
                output[j : j + ROWS] += some[0] @ o.prod(axis=2)
                part = table[np.arange(len(z))[:, None], (o @ 2.0 ** np.arange(d)).astype(np.int64)] if few else by_background(o, z, some[0])
                lines = part.transpose(0, 2, 1).reshape(len(names), -1)[order]
                phi[j : j + ROWS, names[order][first]] += np.add.reduceat(lines, first, axis=0).T
    return phi, base, output


def tree_shap(
    model, df: DataFrame, features: str = "features", row_id: str = "row_id", background: Sequence[Sequence[float]] | None = None
) -> DataFrame:
    """Exact Shapley values of each row: ``(row_id, base, output, phi ARRAY<DOUBLE>)``, ``base + sum(phi) = output``.

    Without ``background`` unknown features follow the training shares of the tree; with it (a few rows, which every task
    gets) they take the values of the background rows, averaged. A task explains many rows together, as they share work;
    where these are fewer blocks of rows than the cluster has tasks, the trees of an ensemble are dealt out as well, and the
    parts of a row are added up. The nodes of the trees go to the tasks in parts of bounded size.
    """
    spark, width = df.sparkSession, model.numFeatures
    parts = [spark.sparkContext.broadcast(part) for part in tree_parts(spark, model)]
    reference = None if background is None else np.asarray(background, dtype="float64")
    # numbered, as ids may repeat
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), row_id, F.col(features).cast("array<double>").alias(features))
    rows = settle(numbered)
    blocks = max(1, -(-rows.count() * width // TASK_CELLS))
    deals = max(1, min(len(model.treeWeights), -(-2 * spark.sparkContext.defaultParallelism // blocks)))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in gathered(batches, max(ROWS, TASK_CELLS // width)):
            deal = int(batch["_deal"].iloc[0])  # one in a partition
            x = np.stack(batch[features].to_numpy()).astype("float64")
            phi, base, output = np.zeros((len(x), width)), 0.0, np.zeros(len(x))
            number = 0
            for part in parts:
                for tree in opened(part):
                    if number % deals == deal:
                        found = Shares(x, tree, width).run() if reference is None else attribute(x, leaves_of(tree), width, reference)
                        phi += found[0]
                        base += found[1]
                        output += found[2]
                    number += 1
            yield pd.DataFrame({"_row": batch["_row"], "_deal": deal, row_id: batch[row_id], "base": base, "output": output, "phi": list(phi)})

    kind = df.schema[row_id].dataType.simpleString()
    schema = f"_row long, _deal int, `{row_id}` {kind}, base double, output double, phi array<double>"
    cell = F.pmod(F.hash("_row"), F.lit(blocks)) * deals + F.col("_deal")
    dealt = rows.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).repartitionById(blocks * deals, cell)
    found = dealt.mapInPandas(explain, schema)
    if deals > 1:
        of = F.array_sort(F.collect_list(F.struct("_deal", "base", "output", "phi")))
        found = found.groupBy("_row").agg(F.first(row_id).alias(row_id), of.alias("_of"))
        added = lambda c: F.aggregate(f"_of.{c}", F.lit(0.0), lambda a, x: a + x).alias(c)
        zero = F.array_repeat(F.lit(0.0), width)
        phi = F.aggregate("_of.phi", zero, lambda a, x: F.zip_with(a, x, lambda u, v: u + v)).alias("phi")
        found = found.select(row_id, added("base"), added("output"), phi)
    return found.select(row_id, "base", "output", "phi")


def shap_long(explained: DataFrame, row_id: str = "row_id", keys: Sequence[str] = ()) -> DataFrame:
    """``(row_id, feature, phi)`` rows."""
    return explained.select(*keys, row_id, F.posexplode("phi").alias("feature", "phi"))


def mean_abs_shap(long: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Mean absolute attribution per group and feature."""
    return long.groupBy(*by, "feature").agg(F.avg(F.abs(F.col("phi"))).alias("mean_shap"))


def shap_summary(long: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return mean_abs_shap(long, ()).orderBy(F.desc("mean_shap"), "feature")


def importance_stability(per_fold: DataFrame, column: str = "mean_shap", top: int | None = None) -> DataFrame:
    """Mean and sample deviation over folds per feature, largest mean first; ``top`` keeps the first ones."""
    stats = per_fold.groupBy("feature").agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    ordered = stats.orderBy(F.desc("mean"), "feature")
    return ordered if top is None else ordered.limit(top)


def shap_by_fold(folds: DataFrame, k: int = FOLDS, trees: int = SMALL_FOREST_TREES) -> DataFrame:
    """Attributions of each test block by the forest trained before it: ``(fold, row_id, feature, phi)``."""

    def run(i: int) -> DataFrame:
        rows = folds.where(F.col("fold") == i)
        model = train_forest(rows.where("role = 'train'").select("row_id", "y", "features"), trees)
        explained = tree_shap(model, rows.where("role = 'test'")).withColumn("fold", F.lit(i))
        return shap_long(explained, keys=("fold",))

    return union_all(side_by_side(folds.sparkSession, [partial(run, i) for i in range(k)], folds.count()))


def shap_stability(folds: DataFrame, k: int = FOLDS, trees: int = SMALL_FOREST_TREES, top: int | None = None) -> DataFrame:
    """Stability of the mean absolute attributions over time folds."""
    return importance_stability(settle(mean_abs_shap(shap_by_fold(folds, k, trees))), top=top)
