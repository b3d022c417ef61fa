"""Composite jobs: features, reduction, training, sweep and the report tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import partial

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.functions.columns import MEGA, above, above_floor, interaction, normalize_day
from gridsignal.operators import asof, explain, features as feat, grid, labels, metrics, models, peaks, reduce, stats
from gridsignal.operators import resample, timeops, windows
from gridsignal.operators.models import union_all
from gridsignal.operators.ordering import with_position
from gridsignal.session import settle

# Variables of the fields, day margin of the overlap, names of the non-spatial features.
SPATIAL = ("sst", "sss", "ssh")
RUNOFF = "runoff"
OVERLAP_DAYS = 31
RUNOFF_FEATURES = ("runoff_sum", "runoff_lag1", "runoff_lag2", "runoff_x_sst")
BLOCK_SPAN = 1 << 40  # feature ids: block number times this plus the cell or feature number


@dataclass
class Prepared:
    """Feature rows ``(feature_id, block, cell_id, series)``, time axis ``(pos, ts, label)`` and the valid cells."""

    features: DataFrame
    times: DataFrame
    cells: DataFrame
    index: DataFrame


def align_index(times: DataFrame, index: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Index value nearest to every model time: ``(series_id, ts, value)``."""
    clean = index.select("ts", above_floor(F.col("value")).alias("value"))
    near = asof.asof_nearest(times.select("ts"), clean, ["value"], tolerance=tolerance, unique_left=True)
    return near.select(F.lit("t").alias("series_id"), "ts", "value")


def build_features(
    field: DataFrame,
    index: DataFrame,
    threshold: float = labels.BASE_THRESHOLD,
    custom_labels: DataFrame | None = None,
    spatial: Sequence[str] = SPATIAL,
    runoff: str = RUNOFF,
    tolerance: float | None = None,
) -> Prepared:
    """From raw fields ``(ts, cell_id, var, value)`` and an index ``(ts, value)`` to features and labels.

    Days are normalised before copies are dropped. ``custom_labels`` is ``(ts, label)``.
    """
    day = field.select(
        normalize_day(F.col("ts")).cast("timestamp_ntz").alias("ts"), F.col("ts").alias("_src"), "cell_id", "var", "value"
    )
    clean = settle(timeops.dedup_first(day, ["ts", "cell_id", "var"], "_src").drop("_src"))
    names = [*spatial, runoff]
    aligned = dict(zip(names, timeops.align_time([clean.where(F.col("var") == v) for v in names])))
    steps = settle(aligned[spatial[0]].select("ts").distinct())

    near = settle(align_index(steps, index, tolerance))

    field3 = feat.concat_blocks([aligned[v] for v in spatial])
    cells = settle(grid.valid_cells(field3, spatial))
    masked = settle(grid.keep_cells(field3, cells))
    total = grid.spatial_sum(aligned[runoff], scale=MEGA)
    mean = grid.spatial_mean(masked.where(F.col("var") == spatial[0]))
    # The time axis is small from here on: one row per step with index, total and mean.
    placed = settle(with_position(near.join(total, "ts").join(mean, "ts")))
    single = windows.lag_features(placed, ["total"], (1, 2))
    if custom_labels is None:
        single = labels.weak_labels(single, threshold=threshold)
    else:
        single = single.join(custom_labels.select("ts", "label"), "ts")
    single = single.select(
        "series_id", "ts", "label",
        F.col("total").alias(RUNOFF_FEATURES[0]),
        F.col("total_lag1").alias(RUNOFF_FEATURES[1]),
        F.col("total_lag2").alias(RUNOFF_FEATURES[2]),
        interaction(F.col("total"), F.col("mean")).alias(RUNOFF_FEATURES[3]),
    )
    single = settle(with_position(single.dropna(subset=list(RUNOFF_FEATURES))))  # the label is never missing
    times = single.select("pos", "ts", "label")

    spatial_no = F.element_at(F.create_map(*[x for i, v in enumerate(spatial) for x in (F.lit(v), F.lit(i))]), F.col("var"))
    spatial_rows = masked.join(times.select("ts", "pos"), "ts").select(
        (spatial_no.cast("long") * F.lit(BLOCK_SPAN) + F.col("cell_id")).alias("feature_id"),
        F.col("var").alias("block"), "cell_id", "pos", "value",
    )
    runoff_rows = single.unpivot(["pos"], list(RUNOFF_FEATURES), "name", "value")
    number = F.array_position(F.array(*[F.lit(n) for n in RUNOFF_FEATURES]), F.col("name")) - 1
    runoff_rows = runoff_rows.select(
        (F.lit(len(spatial) * BLOCK_SPAN) + number).alias("feature_id"),
        F.lit(runoff).alias("block"), F.lit(None).cast("long").alias("cell_id"), "pos", "value",
    )
    packed = feat.pack(spatial_rows.unionByName(runoff_rows))
    return Prepared(settle(packed), times, cells, near)


def split_times(prepared: Prepared, seed: int = resample.SEED) -> DataFrame:
    """Time axis with its stratified split: ``(row_id, pos, ts, y, split)``."""
    rows = prepared.times.select(F.col("pos").alias("row_id"), "pos", "ts", F.col("label").alias("y"))
    return settle(resample.stratified_split(rows, seed=seed))


@dataclass
class Reduced:
    """Split time axis, loadings and component scores ``(row_id, ts, y, split, features)``."""

    pca: reduce.WidePca
    loadings: DataFrame
    rows: DataFrame


def reduce_features(features: DataFrame, times: DataFrame, k: int = reduce.COMPONENTS) -> Reduced:
    """Standardise on the training steps, decompose, and project every step."""
    mask = feat.train_mask(times)
    scaled = settle(feat.standardize(features, mask))
    pca = reduce.wide_pca(scaled, mask, k)
    loadings = settle(pca.loadings)
    scores = reduce.pca_project(scaled, loadings)
    rows = scores.join(times, "pos").select("row_id", "ts", "y", "split", F.col("pcs").alias("features"))
    return Reduced(pca, loadings, settle(rows))


@dataclass
class Trained:
    """Models, scored test rows, metrics per model, block importance and attributions."""

    forest: object
    boosted: object
    scored: DataFrame
    metrics: DataFrame
    blocks: DataFrame
    shap: DataFrame


def train_evaluate(
    reduced: Reduced, trees: int = models.FOREST_TREES, rounds: int = models.BOOST_ROUNDS, seed: int = resample.SEED
) -> Trained:
    """Balance the training rows, fit both ensembles, score the test rows, explain the boosted one.

    Attributions are against the first ``explain.BACKGROUND_ROWS`` training rows.
    """
    train = reduced.rows.where("split = 'train'").select("row_id", "y", "features")
    test = reduced.rows.where("split = 'test'").select("row_id", "ts", "y", "features")
    balanced = models.balanced(train, seed)
    forest = models.train_forest(balanced, trees, seed)
    boosted = models.train_boosted(balanced, rounds, seed=seed)
    scored = settle(
        models.score(forest, test).withColumn("model", F.lit("forest")).unionByName(
            models.score(boosted, test).withColumn("model", F.lit("boosted"))
        )
    )
    contributions = reduce.mean_abs_loading(reduced.loadings)
    background = [r.features for r in train.orderBy("row_id").limit(explain.BACKGROUND_ROWS).select("features").collect()]
    return Trained(
        forest,
        boosted,
        scored,
        metrics.weighted_metrics(scored, by=["model"]),
        reduce.block_importance(contributions),
        explain.shap_long(explain.tree_shap(boosted, test, background=background)),
    )


def threshold_sweep(
    field: DataFrame,
    index: DataFrame,
    thresholds: Sequence[float] | None = None,
    k: int = reduce.COMPONENTS,
    trees: int = models.FOREST_TREES,
    rounds: int = models.BOOST_ROUNDS,
) -> DataFrame:
    """Weighted metrics for each threshold: ``(threshold, status, accuracy, precision, recall, f1_score)``.

    Features are built once; only labels, split and models change, and several thresholds run at a time. Thresholds that
    leave one class are not run; a degenerate fit is a row whose status says why.
    """
    thresholds = list(thresholds if thresholds is not None else labels.sweep_thresholds())
    prepared = build_features(field, index)
    indexed = prepared.times.select("pos", "ts").join(prepared.index.select("ts", "value"), "ts")
    swept = settle(labels.sweep(indexed, thresholds))
    # At most one row per threshold.
    usable = {r.threshold for r in labels.two_class_groups(swept).collect()}
    chosen = [float(th) for th in thresholds if th in usable]
    if not chosen:
        raise ValueError("no threshold leaves two classes")

    def run(th: float) -> DataFrame:
        key = F.lit(th).alias("threshold")
        try:
            mine = replace(prepared, times=swept.where(F.col("threshold") == th).select("pos", "ts", "label"))
            trained = train_evaluate(reduce_features(prepared.features, split_times(mine), k), trees, rounds)
            return settle(trained.metrics.where("model = 'boosted'").select(
                key, F.lit("ok").alias("status"), "accuracy", "precision", "recall", "f1_score"))
        except (ValueError, IllegalArgumentException) as failure:  # too few rows of a class
            none = [F.lit(None).cast("double").alias(c) for c in ("accuracy", "precision", "recall", "f1_score")]
            return swept.sparkSession.range(1).select(key, F.lit(f"failed: {failure}").alias("status"), *none)

    return union_all(models.side_by_side(swept.sparkSession, [partial(run, th) for th in chosen]))


def lead_time_report(
    scored: DataFrame,
    index: DataFrame | None = None,
    height: float = peaks.PEAK_HEIGHT,
    distance: int = peaks.PEAK_DISTANCE,
    max_lead: int = peaks.MAX_LEAD,
    edges: Sequence[float] = tuple(stats.LEAD_EDGES),
    grain: str | None = None,
) -> dict[str, DataFrame]:
    """Leads, their summary and histogram, and the overlay series from ``(series_id, ts, label, p)``.

    With an index, rows are clipped to its time range (with a margin) and overlaid with its min-max scaled values.
    Without a valid lead the summary has ``n = 0`` and ``found = false``.
    """
    rows = scored.select("series_id", "ts", "label", "p")
    if index is not None:
        rows = timeops.clip_to_overlap(rows, index, OVERLAP_DAYS)
    placed = settle(with_position(rows, grain=grain))
    leads = settle(peaks.lead_times(placed, peaks.find_peaks(placed, "p", height, distance), max_lead=max_lead))
    quartiles = stats.quantiles(leads, "lead", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    summary = quartiles.withColumns({"n": F.coalesce("n", F.lit(0)), "found": F.coalesce(F.col("n") > 0, F.lit(False))})
    out = {"leads": leads, "summary": summary, "histogram": stats.histogram(leads, "lead", list(edges))}
    if index is not None:
        clean = settle(index.select("ts", above_floor(F.col("value")).alias("value")))
        overlay = asof.asof_nearest(placed, clean, ["value"], grain=grain)
        out["overlay"] = timeops.minmax_scale(settle(overlay), "value", out="index_scaled").drop("value")
    return out


def post_model_report(scored: DataFrame, model=None, groups: dict[str, int] | None = None, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Confusion matrix, curves, ranking metrics, grouped importances and upward crossings of ``(row_id, ts, y, p, pred)``."""
    rows = settle(scored.select("row_id", "ts", "y", "p", "pred"))
    placed = with_position(rows, (), ["ts", "row_id"])
    out = {
        "confusion": metrics.confusion_matrix(rows),
        "roc": metrics.roc_curve(rows, drop_intermediate=True),
        "pr": metrics.pr_curve(rows),
        "ranking": metrics.ranking_metrics(rows),
        "crossings": windows.upward_crossings(placed, "p", threshold, ()).where("crossing").drop("crossing"),
    }
    if model is not None:
        out["importance"] = models.importance_by_group(rows, model, groups)
    return out


def robustness_tables(
    reduced: Reduced,
    prepared: Prepared,
    runoff_components: Sequence[int] = (),
    folds: int = resample.FOLDS,
    trees: int = models.FOREST_TREES,
    rounds: int = models.BOOST_ROUNDS,
    k: int = reduce.COMPONENTS,
) -> dict[str, DataFrame]:
    """Cross-validation, baselines, rebalancing, bootstrap, hit rate, ablation and attribution stability.

    All tables score rows that the model has not seen. Ablation removes a block before the decomposition. ``scored`` holds
    the rows that the tables of metrics share, ``(table, key, row_id, y, p, pred)``, written once; their metrics come from
    one job.
    """
    rows = reduced.rows.select("row_id", "ts", "y", "features")
    times = split_times(prepared)
    small = min(trees, models.SMALL_FOREST_TREES)
    cv_folds = models.folds_of(rows, folds)
    out_of_fold = settle(models.out_of_fold(cv_folds, folds, lambda t: models.train_forest(t, trees), models.balanced))
    positioned = settle(with_position(out_of_fold, (), "row_id", float(1 << 16)))
    blocks = [r.block for r in prepared.features.select("block").distinct().collect()]
    without = {
        b: reduce_features(feat.drop_block(prepared.features, b), times, k).rows.select("row_id", "ts", "y", "features")
        for b in sorted(blocks)
    }
    groups = {"runoff": list(runoff_components)} if runoff_components else {}
    series = prepared.times.withColumn("series_id", F.lit("t"))
    named = {
        "baselines": ("model", models.baseline_scores(rows, groups, folds)),
        "rebalancing": ("strategy", models.rebalancing_scores(rows, folds, rounds=rounds)),
        "ablation": ("removed", models.ablation_scores(without, folds, trees=small)),
    }
    cells = ["row_id", "y", "p", "pred"]
    parts = [out_of_fold.select(F.lit("time_cv").alias("table"), F.col("fold").cast("string").alias("key"), *cells)]
    parts += [s.select(F.lit(t).alias("table"), F.lit(key).alias("key"), *cells) for t, (_, found) in named.items() for key, s in found.items()]
    scored = settle(union_all(parts))
    measured = settle(metrics.binary_metrics(scored, by=["table", "key"]))
    of = lambda table: measured.where(F.col("table") == table).drop("table")
    return {
        "scored": scored,
        "time_cv": of("time_cv").withColumn("key", F.col("key").cast("int")).withColumnRenamed("key", "fold"),
        "bootstrap": resample.bootstrap_auc(positioned),
        "hit_rate": stats.hit_rate(series),
        "shap": explain.shap_stability(cv_folds, folds, small),
    } | {t: of(t).withColumnRenamed("key", name) for t, (name, _) in named.items()}


def significance_tables(
    index: DataFrame, scored: DataFrame, thresholds: Sequence[float] = labels.BALANCE_THRESHOLDS,
    permutations: int = resample.PERMUTATIONS, lead: int = windows.ALARM_LEAD, total_rows: int | None = None,
) -> dict[str, DataFrame]:
    """Class balance of the index ``(ts, value)``, permutation test and false alarms of ``(row_id, ts, y, p)``."""
    rows = settle(scored.select("row_id", "ts", "y", "p"))
    placed = with_position(rows, (), ["ts", "row_id"]).withColumn("pred", above(F.col("p")))
    return {
        "class_balance": labels.class_balance(index, thresholds),
        "permutation": resample.permutation_test(rows, n=permutations),
        "false_alarms": stats.false_alarm_rate(placed, label="y", lead=lead, total_rows=total_rows, by=()),
    }


def transport_series(
    df: DataFrame, columns: Sequence[str], floor: float = -99999.0, n: int = windows.RUNNING_ROWS, edge: str = "zero",
    grain: str | None = None,
) -> dict[str, DataFrame]:
    """Daily values with running means, and calendar month means, of parallel series ``(series_id, ts, columns)``."""
    clean = settle(df.select("series_id", "ts", *[above_floor(F.col(c), floor).alias(c) for c in columns]))
    long = clean.unpivot(["series_id", "ts"], list(columns), "column", "value")
    placed = settle(with_position(long, ["series_id", "column"], "ts", grain))
    full = timeops.impute_mean(placed, "value", ["series_id", "column"], "filled")
    smooth = windows.running_mean(full, "filled", n, edge, ["series_id", "column"])
    return {
        "daily": smooth.select("series_id", "column", "ts", "value", "running"),
        "monthly": timeops.resample_mean(clean, list(columns)),
    }


def contribution_maps(
    prepared: Prepared, loadings: DataFrame, cells: DataFrame, blocks: Sequence[str] = SPATIAL
) -> DataFrame:
    """Contribution of every grid cell for each spatial block: ``(block, cell columns, value)``, missing off the mask.

    Fails when the loadings do not cover exactly the features of the mask.
    """
    expected, found = prepared.features.count(), loadings.count()
    if expected != found:
        raise ValueError(f"{found} loadings for {expected} features")
    out = None
    for block in blocks:
        part = reduce.loading_map(cells, loadings, block).withColumn("block", F.lit(block))
        out = part if out is None else out.unionByName(part)
    return out
