"""Classifiers on component scores, and the tables that compare them.

Training rows are ``(row_id, y, features ARRAY<DOUBLE>)``. Loops run over folds, blocks or strategies, whose number is
fixed; each fit is a distributed job, and all metrics of a table come from one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from gridsignal.operators import forest
from gridsignal.operators.metrics import binary_metrics
from gridsignal.operators.ordering import with_position
from gridsignal.operators.resample import FOLDS, SEED, smote, time_series_folds, with_class_weight
from gridsignal.operators.windows import persistence_baseline
from gridsignal.session import settle

# Forest size, boosting rounds, depth and step, logistic iterations, component groups.
FOREST_TREES = 200
SMALL_FOREST_TREES = 100
BOOST_ROUNDS = 100
BOOST_DEPTH = 6
BOOST_STEP = 0.3
LOGISTIC_ITERATIONS = 500
COMPONENT_GROUPS = {"sst": 10, "sss": 8, "ssh": 6, "runoff": 5}

DEEPEST = 30  # trees grow until their leaves are pure or of the least size; this is the deepest Spark allows
LEAVES = 1 << 14  # leaves that a tree can have: a leaf holds at least the fitted rows over this
GROWN_ROWS = 1 << 14  # rows of a forest that Spark fits by itself
PART_ROWS = 1 << 20  # rows of a partition of a fit
ROUND_ROWS = 1 << 15  # rows of a task in the many short stages of a boosted fit

Fit = Callable[[DataFrame], object]


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col("features").cast("array<double>")))


def fitted_rows(df: DataFrame, leaves: int = LEAVES, task_rows: int = 1) -> tuple[DataFrame, int]:
    """All labelled rows, and the least size of a leaf where a tree has at most so many ``leaves``.

    They are in one partition per core at most, or in partitions of ``PART_ROWS`` where that is more, and no more than hold
    ``task_rows`` each: a fit shuffles the counts of its nodes for every partition and reports every task to the driver,
    which would else grow with the files that are read.
    """
    n = df.count()
    tasks = max(1, -(-n // PART_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // task_rows)))
    return df.coalesce(tasks), max(1, -(-n // leaves))


def train_forest(
    df: DataFrame, trees: int = FOREST_TREES, seed: int = SEED, depth: int = DEEPEST, weight: str | None = None,
    subset: str = "sqrt", bootstrap: bool = True,
):
    """Random forest with square-root feature subsets, fitted to all rows.

    Forests of more than ``GROWN_ROWS`` rows keep their nodes in a written table, see ``forest``.
    """
    chosen, least = fitted_rows(df)
    if weight is None:
        kinds = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
        if set(kinds) == {0, 1} and (n := sum(kinds.values())) > GROWN_ROWS:
            return forest.grow(chosen, n, len(df.first()["features"]), trees, seed, depth, least, subset, bootstrap)
    rf = RandomForestClassifier(
        featuresCol="_x", labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, seed=seed, bootstrap=bootstrap,
        minInstancesPerNode=least, maxMemoryInMB=512, cacheNodeIds=True,
    )
    return (rf.setWeightCol(weight) if weight else rf).fit(_vectors(chosen))


def train_boosted(
    df: DataFrame, rounds: int = BOOST_ROUNDS, depth: int = BOOST_DEPTH, step: float = BOOST_STEP, seed: int = SEED,
    weight: str | None = None,
):
    """Gradient-boosted trees with logistic loss, fitted to all rows."""
    chosen, least = fitted_rows(df, task_rows=ROUND_ROWS)
    gbt = GBTClassifier(
        featuresCol="_x", labelCol="y", lossType="logistic", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed,
        minInstancesPerNode=least, maxMemoryInMB=512,
    )
    return (gbt.setWeightCol(weight) if weight else gbt).fit(_vectors(chosen))


def train_logistic(df: DataFrame, iterations: int = LOGISTIC_ITERATIONS, n: int | None = None):
    """L2 logistic regression with unit inverse strength, features as they are."""
    n = df.count() if n is None else n
    return LogisticRegression(
        featuresCol="_x", labelCol="y", maxIter=iterations, regParam=1.0 / n, standardization=False
    ).fit(_vectors(df))


def score(model, df: DataFrame) -> DataFrame:
    """Rows with probability ``p`` of the positive class and hard prediction ``pred``.

    ``p`` is missing for a model that has seen no positive row: its folds keep their row, without ranking metrics.
    """
    if isinstance(model, forest.Forest):
        return df.withColumn("p", model.probability(F.col("features"))).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    out = model.transform(_vectors(df))
    p = F.get(vector_to_array("probability"), 1)
    return out.withColumns({"p": p, "pred": F.col("prediction").cast("int")}).drop(
        "_x", "rawPrediction", "probability", "prediction"
    )


def _table(scored: dict[object, DataFrame], key: str) -> DataFrame:
    """One metrics job for several scored frames."""
    parts = [s.select(F.lit(name).alias(key), "y", "p", "pred") for name, s in scored.items()]
    return binary_metrics(union_all(parts), by=[key])


def folds_of(df: DataFrame, k: int = FOLDS, order: Sequence[str] = ("ts", "row_id"), grain: str | float | None = None) -> DataFrame:
    """Rows with time-ordered folds, written once for the fits that read them."""
    return settle(time_series_folds(with_position(df, (), list(order), grain), k))


PARALLEL_FITS = 5
SIDE_ROWS = 50_000  # rows of all fits, up to which they run side by side


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], object]], rows: int = 0) -> list:
    """Results of independent fits, several submitted at a time so that their small stages share the cluster.

    The driver holds the nodes of the trees that are being fitted, whose number grows with ``rows``, those of all fits:
    beyond ``SIDE_ROWS`` a fit fills the cluster by itself, and they come one after another.
    """
    with ThreadPool(min(PARALLEL_FITS if rows <= SIDE_ROWS else 1, len(tasks))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(t) for t in tasks])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several frames."""
    return reduce(DataFrame.unionByName, frames)


def out_of_fold(folds: DataFrame, k: int, fit: Fit, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scored test rows of every fold, each by the model fitted on the rows before it.

    Scores are written at once, so that the driver need not keep a fold's model.
    """
    def run(i: int) -> DataFrame:
        rows = folds.where(F.col("fold") == i)
        train = rows.where("role = 'train'").select("row_id", "y", "features")
        model = fit(prepare(train) if prepare else train)
        return settle(score(model, rows.where("role = 'test'").select("fold", "row_id", "y", "features")).drop("features"))

    return union_all(side_by_side(folds.sparkSession, [partial(run, i) for i in range(k)], folds.count()))


def balanced(train: DataFrame, seed: int = SEED) -> DataFrame:
    """Training rows brought to class parity by ``smote``, written once."""
    return settle(smote(train, seed=seed).drop("synthetic"))


def time_cv(
    df: DataFrame, k: int = FOLDS, fit: Fit = train_forest, balance: bool = True, order: Sequence[str] = ("ts", "row_id"),
    grain: str | float | None = None,
) -> DataFrame:
    """Metrics per expanding time fold; balancing happens inside each training part only."""
    folds = folds_of(df, k, order, grain)
    return binary_metrics(out_of_fold(folds, k, fit, balanced if balance else None), by=["fold"])


def baseline_scores(
    df: DataFrame, groups: dict[str, list[int]], k: int = FOLDS, in_sample: bool = False,
    order: Sequence[str] = ("ts", "row_id"), grain: str | float | None = None,
) -> dict[str, DataFrame]:
    """Scored rows of the persistence, logistic and runoff-only logistic baselines.

    ``groups`` maps feature groups to feature positions. Scores are out of fold unless ``in_sample``.
    """
    placed = settle(with_position(df, (), list(order), grain))
    persist = persistence_baseline(placed, "y", by=()).withColumn("p", F.col("pred").cast("double"))
    scored = {"Persistence": persist}
    runs = {"Logistic": placed}
    if "runoff" in groups:
        picked = F.transform(F.array(*[F.lit(i) for i in groups["runoff"]]), lambda i: F.element_at("features", i + 1))
        runs["Runoff-only"] = placed.withColumn("features", picked)
    folds = None if in_sample else settle(time_series_folds(placed, k))
    for name, rows in runs.items():
        if in_sample:
            scored[name] = score(train_logistic(rows), rows)
        else:
            mine = folds if name == "Logistic" else folds.withColumn("features", picked)
            scored[name] = out_of_fold(mine, k, train_logistic)
    return scored


def baseline_table(df: DataFrame, groups: dict[str, list[int]], *args, **options) -> DataFrame:
    """Metrics of ``baseline_scores``: ``(model, auc, ap, precision, recall, f1)``."""
    return _table(baseline_scores(df, groups, *args, **options), "model")


def rebalancing_scores(
    df: DataFrame, k: int = FOLDS, in_sample: bool = False, rounds: int = BOOST_ROUNDS,
    order: Sequence[str] = ("ts", "row_id"), grain: str | float | None = None,
) -> dict[str, DataFrame]:
    """Scored rows of boosted trees with class weights, and of boosted trees on oversampled rows."""

    def weighted(train):
        return train_boosted(with_class_weight(train), rounds, weight="weight")

    def plain(train):
        return train_boosted(train, rounds)

    if in_sample:
        rows = settle(df.select("row_id", "y", "features"))
        return {"Weights": score(weighted(rows), rows), "SMOTE": score(plain(balanced(rows)), rows)}
    folds = folds_of(df, k, order, grain)
    return {"Weights": out_of_fold(folds, k, weighted), "SMOTE": out_of_fold(folds, k, plain, balanced)}


def rebalancing_table(df: DataFrame, *args, **options) -> DataFrame:
    """Metrics of ``rebalancing_scores`` by strategy."""
    return _table(rebalancing_scores(df, *args, **options), "strategy")


def ablation_scores(
    rows_without: dict[str, DataFrame], k: int = FOLDS, in_sample: bool = False, trees: int = SMALL_FOREST_TREES,
    order: Sequence[str] = ("ts", "row_id"), grain: str | float | None = None,
) -> dict[str, DataFrame]:
    """Rows scored by forests with one feature block removed: ``rows_without`` maps the block to the rows lacking it."""
    scored = {}
    for block, rows in rows_without.items():
        if in_sample:
            rows = settle(rows)
            scored[block] = score(train_forest(rows.select("row_id", "y", "features"), trees), rows)
        else:
            folds = folds_of(rows, k, order, grain)
            scored[block] = out_of_fold(folds, k, lambda t: train_forest(t, trees))
    return scored


def ablation_table(rows_without: dict[str, DataFrame], *args, **options) -> DataFrame:
    """Metrics of ``ablation_scores`` by the block that is removed."""
    return _table(ablation_scores(rows_without, *args, **options), "removed")


def importance_by_group(df: DataFrame, model, groups: dict[str, int] | None = None) -> DataFrame:
    """Model importances with the feature group they fall in: ``(feature, importance, block, index)``.

    ``groups`` gives the consecutive group sizes; features past the last group have no block. ``df`` names the session.
    """
    values = [float(v) for v in model.featureImportances.toArray()]
    blocks: list[tuple[str | None, int]] = []
    for name, size in (groups or COMPONENT_GROUPS).items():
        blocks += [(name, i) for i in range(size)]
    blocks += [(None, i) for i in range(max(0, len(values) - len(blocks)))]
    rows = [(i, v, *blocks[i]) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "feature int, importance double, block string, index int")
