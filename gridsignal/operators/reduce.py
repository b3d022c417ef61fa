"""Dimensionality reduction of very wide matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.functions.columns import mean_abs
from gridsignal.operators.features import MAX_STEPS
from gridsignal.operators.grid import to_grid

# Number of components of the job and of the exploratory variant.
COMPONENTS = 30
EXPLORATORY_COMPONENTS = 50


@dataclass
class WidePca:
    """Loadings ``(feature_id, block, cell_id, w ARRAY<DOUBLE>)`` and the variance of each component."""

    loadings: DataFrame
    explained_variance: list[float]
    explained_ratio: list[float]

    @property
    def k(self) -> int:
        return len(self.explained_variance)


def wide_pca(features: DataFrame, mask: Column | None = None, k: int = COMPONENTS, series: str = "z") -> WidePca:
    """Principal components of standardised feature rows, fitted on the masked time steps.

    The matrix is decomposed with features as rows, so its Gram matrix has the size of the time axis, whatever the
    number of features, and the loadings are the left singular vectors, which stay distributed. The right singular
    vectors (steps x k) are the only thing sent to the tasks. ``features`` is read several times: write it first.
    """
    steps = features.select(F.max(F.size(series))).first()[0]
    if steps > MAX_STEPS:
        raise ValueError(f"{steps} time steps are more than the {MAX_STEPS} this layout is meant for")
    fit = F.col(series)
    rows = features
    if mask is not None:
        rows = rows.withColumn("_mask", mask)
        fit = F.filter(F.zip_with(fit, "_mask", lambda v, m: F.when(m, v)), lambda v: v.isNotNull())
    rows = rows.withColumn("_x", fit)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("_x").alias("_v")), "_v")
    n = rows.select(F.max(F.size("_x"))).first()[0]
    svd = RowMatrix(vectors, 0, n).computeSVD(min(k, n), computeU=False)
    s = np.array(svd.s.toArray())
    v = np.array(svd.V.toArray())
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])  # fixed sign: largest entry positive
    total = rows.select(F.sum(F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    turn = v / s

    @F.pandas_udf("array<double>")
    def project(xs: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(xs.to_numpy()) @ turn))

    keep = [c for c in ("feature_id", "block", "cell_id") if c in features.columns]
    variance = s**2 / max(n - 1, 1)
    return WidePca(
        rows.select(*keep, project("_x").alias("w")), variance.tolist(), (s**2 / total).tolist()
    )


def component_residuals(features: DataFrame, pca: WidePca, mask: Column | None = None, series: str = "z") -> DataFrame:
    """How well the components solve the eigenproblem: ``(pc, variance, ratio, norm, overlap, residual)`` from 0.

    ``norm`` is a component's length, ``overlap`` its largest product with another one, ``residual`` the largest entry of
    (Gram matrix x component - eigenvalue x component) relative to the largest eigenvalue. Features and components meet
    by id; tasks add up products of components and look at residuals where the features are.
    """
    rows = features
    if mask is not None:
        rows = rows.withColumn("_mask", mask)
        rows = rows.withColumn(series, F.filter(F.zip_with(series, "_mask", lambda v, m: F.when(m, v)), lambda v: v.isNotNull()))
    pairs = rows.select("feature_id", F.col(series).alias("z")).join(pca.loadings.select("feature_id", "w"), "feature_id").select("z", "w")
    steps = rows.select(F.max(F.size(series))).first()[0]
    # one row per fitted step, checked by wide_pca
    scores = {r["pos"]: r["pcs"] for r in pca_project(rows.select("feature_id", series), pca.loadings, series).collect()}
    scored = np.array([scores[i] for i in range(steps)])
    values, k = np.array(pca.explained_variance) * max(steps - 1, 1), pca.k

    def partial(batches):
        products, worst = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if len(batch):
                z, w = np.stack(batch.z.to_numpy()), np.stack(batch.w.to_numpy())
                products += w.T @ w
                worst = np.maximum(worst, np.abs(z @ scored - w * values).max(axis=0))
        yield pd.DataFrame({"pc": np.arange(k, dtype="int32"), "worst": worst, "line": list(products)})

    lines = pairs.mapInPandas(partial, "pc int, worst double, line array<double>")
    cells = lines.select("pc", F.posexplode("line").alias("other", "v")).groupBy("pc", "other").agg(F.sum("v").alias("v"))
    shape = cells.groupBy("pc").agg(F.sqrt(F.sum(F.when(F.col("pc") == F.col("other"), F.col("v")))).alias("norm"),
                                    F.coalesce(F.max(F.when(F.col("pc") != F.col("other"), F.abs("v"))), F.lit(0.0)).alias("overlap"))
    facts = features.sparkSession.createDataFrame(
        [(i, float(v), float(r)) for i, (v, r) in enumerate(zip(pca.explained_variance, pca.explained_ratio))], "pc int, variance double, ratio double")
    residual = lines.groupBy("pc").agg((F.max("worst") / F.lit(float(values.max()))).alias("residual"))
    return facts.join(shape, "pc").join(residual, "pc")


def pca_project(features: DataFrame, loadings: DataFrame, series: str = "z") -> DataFrame:
    """Component scores of every time step: ``(pos, pcs ARRAY<DOUBLE>)``.

    Features meet their loadings by id. Each task multiplies its features with their loadings and passes on one row
    per time step, so the shuffle does not grow with the number of features.
    """
    pairs = features.select("feature_id", F.col(series).alias("z")).join(loadings.select("feature_id", "w"), "feature_id")

    def partial(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = np.stack(batch.z.to_numpy()).T @ np.stack(batch.w.to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"pos": np.arange(len(total), dtype="int64"), "part": list(total)})

    parts = pairs.select("z", "w").mapInPandas(partial, "pos long, part array<double>")
    # Element-wise sums of the partial scores: one row per time step, component and task.
    cells = parts.select("pos", F.posexplode("part").alias("pc", "v")).groupBy("pos", "pc").agg(F.sum("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pc", "v")))
    return cells.groupBy("pos").agg(F.transform(ordered, lambda c: c["v"]).alias("pcs"))


def mean_abs_loading(loadings: DataFrame, out: str = "contribution") -> DataFrame:
    """Mean absolute loading of each feature over the components."""
    return loadings.withColumn(out, mean_abs(F.col("w"))).drop("w")


def block_importance(contributions: DataFrame, column: str = "contribution") -> DataFrame:
    """Share of each block in the sum of all contributions."""
    total = contributions.agg(F.sum(column)).scalar()
    sums = contributions.groupBy("block").agg(F.sum(column).alias("score"))
    return sums.withColumn("share", F.col("score") / total)


def loading_map(cells: DataFrame, loadings: DataFrame, block: str, pc: int | None = None) -> DataFrame:
    """Contribution (or one component's loading) of a spatial block on the full grid, missing outside the mask."""
    rows = loadings.where((F.col("block") == block) & F.col("cell_id").isNotNull())
    value = mean_abs(F.col("w")) if pc is None else F.col("w")[pc]
    return to_grid(cells, rows.select("cell_id", value.alias("value")))
