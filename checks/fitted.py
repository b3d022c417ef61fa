"""Fits that SQL cannot repeat: what must hold of them, row by row, and what SQL can tell about them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from checks.common import Catalog, final
from checks.grids import ALL
from checks.learning import FEATURES, feature_rows, labelled
from checks.reports import INDEX_WEAK, PREPARED, order_index, prepared, raw_field
from checks.samples import draw
from gridsignal.operators import explain as E
from gridsignal.operators import features as X
from gridsignal.operators import labels, metrics, models, reduce
from gridsignal.operators import stats as S
from gridsignal.plans import jobs
from gridsignal.session import settle, shared_path
from gridsignal.sources.models import load_model, save_model

catalog = Catalog()
add = catalog.add


def near(a, b, slack=1e-8):
    """Equal up to rounding; missing values equal each other."""
    return F.coalesce(F.abs(a - b) <= slack, a.isNull() & b.isNull())


# ---- components ----------------------------------------------------------------------------------------------------

COMPONENT_SQL = f"""{FEATURES}, size AS (SELECT least({{k}}, count(*)) AS k, (SELECT sum(z * z) FROM z WHERE pos % 3 <> 2) AS total FROM steps WHERE pos % 3 <> 2)"""
COMPONENT_ROWS = "SELECT CAST(i AS INTEGER) AS pc, true AS unit, true AS apart, true AS solves, true AS falling, total FROM size, range((SELECT k FROM size)) t(i)"


def fitted(spark, d, k):
    f, times = feature_rows(spark, d)
    mask = X.train_mask(times)
    scaled = settle(X.standardize(f, mask))
    return scaled, mask, reduce.wide_pca(scaled, mask, k)


def component_facts(spark, d, k):
    """Components of length one, at right angles, that solve the eigenproblem, by falling variance; and the total that SQL adds up."""
    scaled, mask, pca = fitted(spark, d, k)
    facts = settle(reduce.component_residuals(scaled, pca, mask))
    steps = F.lit(float(feature_rows(spark, d)[1].where("split = 'train'").count() - 1))
    before = F.lag("variance").over(W.orderBy("pc"))  # one row per component
    return facts.withColumn("before", before).select(
        "pc", near(F.col("norm"), F.lit(1.0)).alias("unit"), (F.col("overlap") < 1e-7).alias("apart"), (F.col("residual") < 1e-7).alias("solves"),
        F.coalesce(F.col("variance") <= F.col("before") * (1 + 1e-12), F.lit(True)).alias("falling"), (F.col("variance") * steps / F.col("ratio")).alias("total"))


@add("wide_pca_holds", final(COMPONENT_SQL.format(k=reduce.COMPONENTS), COMPONENT_ROWS, ["total"]))
def wide_pca_holds(spark, d):
    return component_facts(spark, d, reduce.COMPONENTS)


@add("wide_pca_exploratory_holds", final(COMPONENT_SQL.format(k=reduce.EXPLORATORY_COMPONENTS), COMPONENT_ROWS, ["total"]))
def wide_pca_exploratory_holds(spark, d):
    return component_facts(spark, d, reduce.EXPLORATORY_COMPONENTS)


@add("fitted_contribution_maps", final(f"{FEATURES}, allcells AS (SELECT DISTINCT cell_id FROM grid)", f"""SELECT a.cell_id, b.block, a.cell_id IN ({ALL}) AS on_mask, true AS agrees
 FROM allcells a CROSS JOIN (VALUES ('sst'), ('sss'), ('ssh')) b(block)"""))
def fitted_contribution_maps(spark, d):
    """Maps of fitted loadings: values on the mask only, each the mean of its feature's absolute loadings."""
    f, times = feature_rows(spark, d)
    _, _, pca = fitted(spark, d, reduce.COMPONENTS)
    w = settle(pca.loadings)
    held = jobs.Prepared(f, times, f.select("cell_id").distinct(), times)
    maps = jobs.contribution_maps(held, w, raw_field(spark, d).select("cell_id").distinct())
    again = w.select("block", "cell_id", F.posexplode("w").alias("pc", "v")).groupBy("block", "cell_id").agg(F.avg(F.abs("v")).alias("again"))
    return maps.join(again, ["block", "cell_id"], "left").select(
        "cell_id", "block", F.col("value").isNotNull().alias("on_mask"), near(F.col("value"), F.col("again")).alias("agrees"))


@add("loading_map_of_one_component", final(f"{FEATURES}, allcells AS (SELECT DISTINCT cell_id FROM grid)", f"""SELECT a.cell_id, a.cell_id IN ({ALL}) AS on_mask, true AS agrees FROM allcells a"""))
def loading_map_of_one_component(spark, d):
    _, _, pca = fitted(spark, d, reduce.COMPONENTS)
    w = settle(pca.loadings)
    maps = reduce.loading_map(raw_field(spark, d).select("cell_id").distinct(), w, "ssh", pc=1)
    own = w.where("block = 'ssh'").select("cell_id", F.col("w")[1].alias("again"))
    return maps.join(own, "cell_id", "left").select("cell_id", F.col("value").isNotNull().alias("on_mask"), near(F.col("value"), F.col("again")).alias("agrees"))


@add("fitted_block_importance", final(FEATURES, "SELECT DISTINCT block, true AS agrees, true AS adds_up FROM f"))
def fitted_block_importance(spark, d):
    """Shares of the blocks in fitted loadings, again from single loadings."""
    _, _, pca = fitted(spark, d, reduce.COMPONENTS)
    w = settle(pca.loadings)
    shares = settle(reduce.block_importance(reduce.mean_abs_loading(w)))
    long = settle(w.select("block", F.explode("w").alias("v")).groupBy("block").agg(F.sum(F.abs("v")).alias("v")))
    every, total = long.agg(F.sum("v")).first()[0], shares.agg(F.sum("share")).first()[0]
    return shares.join(long, "block").select("block", near(F.col("share"), F.col("v") / every).alias("agrees"), near(F.lit(total), F.lit(1.0)).alias("adds_up"))


SPLIT_TIMES = f"""{PREPARED}, rk AS (SELECT pos, ts, label, row_number() OVER (PARTITION BY label ORDER BY {draw("'42'", 'pos')}, pos) AS r FROM tm),
sz AS (SELECT label, floor(count(*) * 0.3) AS base, round(count(*) * 0.3 - floor(count(*) * 0.3), 9) AS rest, count(*) AS n FROM tm GROUP BY label),
qt AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= ceil(round(sum(n) OVER () * 0.3, 9)) - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM sz),
split AS (SELECT pos, ts, label, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS split FROM rk JOIN qt USING (label))"""


@add("reduced_rows", final(SPLIT_TIMES, f"""SELECT pos AS row_id, ts, label AS y, split, CAST(least({reduce.COMPONENTS}, count(*) FILTER (WHERE split = 'train') OVER ()) AS INTEGER) AS components, true AS projected FROM split""", [], ["ts"]))
def reduced_rows(spark, d):
    """Rows of the reduction with their split, each the product of its standardised features and the loadings."""
    p = prepared(spark, d)
    times = jobs.split_times(p)
    reduced = jobs.reduce_features(p.features, times)
    scaled = X.standardize(p.features, X.train_mask(times))
    long = X.unpack(scaled, series="z").join(reduced.loadings.select("feature_id", "w"), "feature_id").select("pos", (F.col("value") * F.col("w")[0]).alias("v"))
    first = long.groupBy(F.col("pos").alias("row_id")).agg(F.sum("v").alias("again"))
    return reduced.rows.join(first, "row_id").select(
        "row_id", "ts", "y", "split", F.size("features").alias("components"), near(F.col("features")[0], F.col("again")).alias("projected"))


# ---- models --------------------------------------------------------------------------------------------------------

EVERY_ROW = "SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS y, true AS holds FROM embeddings"


@add("logistic_gradient", final("", "SELECT CAST(i AS INTEGER) AS feature, true AS flat FROM range((SELECT max(len(embedding)) + 1 FROM embeddings)) t(i)"))
def logistic_gradient(spark, d):
    """The penalised loss has no slope at the fitted coefficients; the last row is the intercept."""
    v = labelled(spark, d)
    model = models.train_logistic(v)
    w = [float(c) for c in model.coefficients.toArray()]
    scored = models.score(model, v)
    lines = scored.select((F.col("p") - F.col("y")).alias("e"), F.concat("features", F.array(F.lit(1.0))).alias("x"))
    slope = lines.select("e", F.posexplode("x").alias("feature", "x")).groupBy("feature").agg((F.sum(F.col("e") * F.col("x"))).alias("slope"), F.sum(F.abs(F.col("e") * F.col("x"))).alias("size"))
    pull = F.array(*[F.lit(c) for c in [*w, 0.0]])  # the penalty's share; the intercept has none
    return slope.select("feature", (F.abs(F.col("slope") + F.get(pull, F.col("feature"))) < 1e-3 * F.col("size")).alias("flat"))


@add("logistic_scores_hold", EVERY_ROW)
def logistic_scores_hold(spark, d):
    v = labelled(spark, d)
    model = models.train_logistic(v)
    w = F.array(*[F.lit(float(c)) for c in model.coefficients.toArray()])
    margin = F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(float(model.intercept)), lambda a, x: a + x)
    again = 1 / (1 + F.exp(-margin))
    return models.score(model, v).select("row_id", "y", (near(F.col("p"), again) & (F.col("pred") == (again > 0.5).cast("int"))).alias("holds"))


@add("stored_models_hold", EVERY_ROW)
def stored_models_hold(spark, d):
    """Models of all kinds give the same scores after they are written and read."""
    v = labelled(spark, d)
    fits = {"logistic": models.train_logistic(v), "forest": models.train_forest(v, 20), "boosted": models.train_boosted(v, 10)}
    out = v.select("row_id", "y").withColumn("holds", F.lit(True))
    for kind, model in fits.items():
        path = shared_path(spark, kind)
        save_model(model, path)
        same = models.score(model, v).select("row_id", F.col("p").alias("a")).join(models.score(load_model(kind, path), v).select("row_id", F.col("p").alias("b")), "row_id")
        out = out.join(same, "row_id").select("row_id", "y", (F.col("holds") & (F.col("a") == F.col("b"))).alias("holds"))
    return out


@add("forest_scores_hold", EVERY_ROW)
def forest_scores_hold(spark, d):
    """Scores of a forest are the means of its trees' leaves, walked one by one."""
    v = labelled(spark, d)
    model = models.train_forest(models.balanced(v))
    outputs = E.tree_shap(model, v).select("row_id", "output")
    return models.score(model, v).join(outputs, "row_id").select("row_id", "y", (near(F.col("p"), F.col("output")) & (F.col("pred") == (F.col("p") > 0.5).cast("int"))).alias("holds"))


@add("boosted_scores_hold", EVERY_ROW)
def boosted_scores_hold(spark, d):
    """Scores of boosted trees follow from the sum of their leaves."""
    v = labelled(spark, d)
    model = models.train_boosted(v)
    outputs = E.tree_shap(model, v).select("row_id", "output")
    return models.score(model, v).join(outputs, "row_id").select("row_id", "y", near(F.col("p"), 1 / (1 + F.exp(-F.col("output")))).alias("holds"))


def recomputed(scored, keys):
    """Metrics of scored rows by another way than the library's: ranks instead of running totals."""
    by = W.partitionBy(*keys)
    ranked = scored.withColumn("r", F.rank().over(by.orderBy("p"))).withColumn("ties", F.count(F.lit(1)).over(W.partitionBy(*keys, "p")))
    ranked = ranked.withColumn("mid", F.col("r") + (F.col("ties") - 1) / 2)
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    hit, called = F.sum(F.col("y") * F.col("pred")), F.sum("pred")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pos.cast("long").alias("positives"),
        F.when((pos > 0) & (neg > 0), (F.sum(F.col("y") * F.col("mid")) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc2"),
        safe(hit, called).alias("precision2"), safe(hit, pos).alias("recall2"),
    ).withColumn("f2", safe(2 * F.col("precision2") * F.col("recall2"), F.col("precision2") + F.col("recall2")))


def agree(table, scored, keys):
    return table.join(recomputed(scored, keys), keys).withColumn(
        "holds", near(F.col("auc"), F.col("auc2")) & near(F.col("precision"), F.col("precision2")) & near(F.col("recall"), F.col("recall2")) & near(F.col("f1"), F.col("f2")))


FOLDED = """o AS (SELECT vec_id, CAST(label = 0 AS INTEGER) AS y, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings),
f AS (SELECT o.*, CAST(i AS INTEGER) AS fold, n - (n // 6) * (5 - i) AS cut FROM o, range(5) t(i)),
tested AS (SELECT fold, y FROM f WHERE pos >= cut AND pos < cut + n // 6)"""


@add("time_cross_validation_holds", final(FOLDED, "SELECT fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, true AS holds FROM tested GROUP BY fold"))
def time_cross_validation_holds(spark, d):
    folds = models.folds_of(labelled(spark, d), order=("row_id",), grain=4096.0)
    scored = settle(models.out_of_fold(folds, 5, models.train_forest, models.balanced))
    return agree(metrics.binary_metrics(scored, by=["fold"]), scored, ["fold"]).select("fold", "n", "positives", "holds")


PERSISTENCE = """o AS (SELECT CAST(label = 0 AS INTEGER) AS y, lag(CAST(label = 0 AS INTEGER), 1, 0) OVER (ORDER BY vec_id) AS pred FROM embeddings),
c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE pred = 1) AS called, count(*) FILTER (WHERE y = 1) AS pos, count(*) AS n, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn FROM o),
m AS (SELECT tp / called AS precision, tp / pos AS recall, (tp / pos + tn / (n - pos)) / 2.0 AS auc FROM c)"""


@add("persistence_baseline_metrics", final(PERSISTENCE, "SELECT 'Persistence' AS model, auc, precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM m", ["auc", "precision", "recall", "f1"]))
def persistence_baseline_metrics(spark, d):
    table = models.baseline_table(labelled(spark, d), {"runoff": [0, 1, 2, 3]}, order=("row_id",), grain=4096.0)
    return table.where("model = 'Persistence'").select("model", "auc", "precision", "recall", "f1")


@add("baselines_hold", final(FOLDED, "SELECT model, CASE model WHEN 'Persistence' THEN (SELECT count(*) FROM o) ELSE (SELECT count(*) FROM tested) END AS n, true AS holds FROM (VALUES ('Persistence'), ('Logistic'), ('Runoff-only')) v(model)"))
def baselines_hold(spark, d):
    found = models.baseline_scores(labelled(spark, d), {"runoff": [0, 1, 2, 3]}, order=("row_id",), grain=4096.0)
    scored = settle(models.union_all([s.select(F.lit(m).alias("model"), "row_id", "y", "p", "pred") for m, s in found.items()]))
    return agree(metrics.binary_metrics(scored, by=["model"]), scored, ["model"]).select("model", "n", "holds")


@add("rebalancing_holds", final(FOLDED, "SELECT strategy, (SELECT count(*) FROM tested) AS n, true AS holds FROM (VALUES ('Weights'), ('SMOTE')) v(strategy)"))
def rebalancing_holds(spark, d):
    found = models.rebalancing_scores(labelled(spark, d), rounds=20, order=("row_id",), grain=4096.0)
    scored = settle(models.union_all([s.select(F.lit(m).alias("strategy"), "row_id", "y", "p", "pred") for m, s in found.items()]))
    return agree(metrics.binary_metrics(scored, by=["strategy"]), scored, ["strategy"]).select("strategy", "n", "holds")


GROUP_SQL = """sizes AS (SELECT max(len(embedding)) AS d FROM embeddings), groups(no, block, first, size) AS (VALUES (0, 'sst', 0, 10), (1, 'sss', 10, 8), (2, 'ssh', 18, 6), (3, 'runoff', 24, 5))"""


@add("importance_groups_hold", final(GROUP_SQL, """SELECT CAST(i AS INTEGER) AS feature, block, CAST(CASE WHEN block IS NULL THEN i - 29 ELSE i - first END AS INTEGER) AS index, true AS adds_up
 FROM range((SELECT d FROM sizes)) t(i) LEFT JOIN groups ON i >= first AND i < first + size"""))
def importance_groups_hold(spark, d):
    v = labelled(spark, d)
    table = settle(models.importance_by_group(v, models.train_forest(v, 50)))
    total = table.agg(F.sum("importance")).first()[0]
    return table.select("feature", "block", "index", (near(F.lit(total), F.lit(1.0)) & (F.col("importance") >= 0)).alias("adds_up"))


@add("post_model_importance", final(GROUP_SQL, """SELECT CAST(i AS INTEGER) AS feature, block, CAST(CASE WHEN block IS NULL THEN i - 29 ELSE i - first END AS INTEGER) AS index, true AS same
 FROM range((SELECT d FROM sizes)) t(i) LEFT JOIN groups ON i >= first AND i < first + size"""))
def post_model_importance(spark, d):
    """The importance part of the report on a fitted model: the model's own numbers with their groups."""
    v = labelled(spark, d)
    model = models.train_boosted(v, 10)
    scored = models.score(model, v).withColumn("ts", F.timestamp_seconds("row_id"))
    own = F.array(*[F.lit(float(x)) for x in model.featureImportances.toArray()])
    table = jobs.post_model_report(scored, model, models.COMPONENT_GROUPS)["importance"]
    return table.select("feature", "block", "index", (F.col("importance") == F.get(own, F.col("feature"))).alias("same"))


FEATURE_ROWS = "SELECT CAST(i AS INTEGER) AS feature, true AS holds FROM range((SELECT max(len(embedding)) FROM embeddings)) t(i)"


@add("attribution_summary_holds", FEATURE_ROWS)
def attribution_summary_holds(spark, d):
    """Mean absolute attributions, again from the arrays."""
    v = labelled(spark, d)
    explained = settle(E.tree_shap(models.train_forest(v, models.SMALL_FOREST_TREES), v))
    long = E.shap_long(explained)
    n = explained.count()
    again = explained.select(F.posexplode("phi").alias("feature", "v")).groupBy("feature").agg((F.sum(F.abs("v")) / n).alias("again"))
    return E.shap_summary(long).join(again, "feature").select("feature", near(F.col("mean_shap"), F.col("again")).alias("holds"))


@add("attribution_stability_holds", FEATURE_ROWS)
def attribution_stability_holds(spark, d):
    """Mean and deviation over folds, again from the sums of squares."""
    folds = models.folds_of(labelled(spark, d), order=("row_id",), grain=4096.0)
    per_fold = settle(E.mean_abs_shap(E.shap_by_fold(folds)))
    m, q, n = F.sum("mean_shap"), F.sum(F.col("mean_shap") * F.col("mean_shap")), F.count(F.lit(1))
    again = per_fold.groupBy("feature").agg((m / n).alias("m"), F.sqrt(F.greatest((q - m * m / n) / (n - 1), F.lit(0.0))).alias("s"))
    return E.importance_stability(per_fold).join(again, "feature").select("feature", (near(F.col("mean"), F.col("m")) & near(F.col("std"), F.col("s"), 1e-7)).alias("holds"))


# ---- jobs ----------------------------------------------------------------------------------------------------------


@add("train_and_evaluate_holds", final(SPLIT_TIMES, "SELECT model, count(*) AS n, true AS measures, true AS explained FROM split, (VALUES ('forest'), ('boosted')) v(model) WHERE split = 'test' GROUP BY model"))
def train_and_evaluate_holds(spark, d):
    """Metrics again from the scored test rows; attributions of the boosted model add up to its log-odds."""
    p = prepared(spark, d)
    trained = jobs.train_evaluate(jobs.reduce_features(p.features, jobs.split_times(p)))
    scored = trained.scored
    counts = scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("pred")).cast("int")).alias("accuracy2"))
    sums = trained.shap.groupBy("row_id").agg(F.sum("phi").alias("phi"))
    odds = F.ln(F.col("p") / (1 - F.col("p")))
    # outputs less attributions are the same base everywhere
    base = scored.where("model = 'boosted'").join(sums, "row_id").agg((F.max(odds - F.col("phi")) - F.min(odds - F.col("phi")) < 1e-6).alias("e")).first().e
    return trained.metrics.join(counts, "model").select("model", "n", near(F.col("accuracy"), F.col("accuracy2")).alias("measures"), F.lit(bool(base)).alias("explained"))


SWEEP = f"""{PREPARED}, ths AS (SELECT {INDEX_WEAK} * f AS threshold FROM (VALUES (0.8::DOUBLE), (0.9), (1.0), (1.1), (1.2)) v(f)),
labs AS (SELECT threshold, ts, CASE WHEN value < threshold THEN 1 ELSE 0 END AS label FROM near JOIN tm USING (ts), ths),
kinds AS (SELECT threshold, count(DISTINCT label) AS kinds FROM labs GROUP BY threshold)"""


@add("threshold_sensitivity_rows", final(SWEEP, "SELECT threshold, true AS in_range FROM kinds WHERE kinds = 2", ["threshold"]))
def threshold_sensitivity_rows(spark, d):
    """A row for every threshold that leaves two classes on the steps with features, with measures from 0 to 1 where the fit is possible."""
    table = jobs.threshold_sweep(raw_field(spark, d), settle(order_index(spark, d)), labels.sweep_thresholds(INDEX_WEAK), trees=20, rounds=10)
    inside = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1_score")]
    ok = (F.col("status") == "ok") & inside[0] & inside[1] & inside[2] & inside[3]
    failed = F.col("status").startswith("failed") & F.col("accuracy").isNull()
    return table.select("threshold", F.coalesce(ok | failed, F.lit(False)).alias("in_range"))


def robust(spark, d):
    p = prepared(spark, d)
    return jobs.robustness_tables(jobs.reduce_features(p.features, jobs.split_times(p)), p, range(4), trees=20, rounds=10)


@add("robustness_all_tables")
def robustness_all_tables(spark, d):
    """All seven tables as ``(table, key, metric, value)``."""
    found = robust(spark, d)
    wide = ["auc", "ap", "precision", "recall", "f1"]
    keys = {"time_cv": ("fold", wide), "baselines": ("model", wide), "rebalancing": ("strategy", wide), "ablation": ("removed", wide),
            "bootstrap": ("replicate", ["auc"]), "hit_rate": ("lead", ["hits", "events", "hit_rate"]), "shap": ("feature", ["mean", "std"])}
    parts = []
    for name, (key, cells) in keys.items():
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cells])).alias("m")
        parts.append(found[name].select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), long).select("table", "key", "m.*"))
    return models.union_all(parts)


ROBUST = f"""{PREPARED}, sized AS (SELECT count(*) AS n, count(*) // 6 * 5 AS tested FROM tm)"""


@add("robustness_metrics_hold", final(ROBUST, """SELECT "table", key, CASE WHEN "table" = 'time_cv' THEN n // 6 WHEN key = 'Persistence' THEN n ELSE tested END AS n, true AS holds FROM sized,
 (SELECT 'time_cv' AS "table", CAST(i AS VARCHAR) AS key FROM range(5) t(i) UNION ALL VALUES ('baselines', 'Persistence'), ('baselines', 'Logistic'), ('baselines', 'Runoff-only'),
 ('rebalancing', 'Weights'), ('rebalancing', 'SMOTE'), ('ablation', 'runoff'), ('ablation', 'ssh'), ('ablation', 'sss'), ('ablation', 'sst'))"""))
def robustness_metrics_hold(spark, d):
    """The four tables of metrics, again from the scored rows that they share."""
    found = robust(spark, d)
    keys = {"time_cv": "fold", "baselines": "model", "rebalancing": "strategy", "ablation": "removed"}
    tables = models.union_all([found[t].withColumn("table", F.lit(t)).withColumn("key", F.col(k).cast("string")).drop(k) for t, k in keys.items()])
    return agree(tables, found["scored"], ["table", "key"]).select("table", "key", "n", "holds")


@add("robustness_hit_rate", final(f"{PREPARED}", """SELECT lead, count(b.pos) AS hits, (SELECT CAST(sum(label) AS BIGINT) FROM tm) AS events, count(b.pos) / greatest((SELECT sum(label) FROM tm), 1) AS hit_rate
 FROM (SELECT CAST(i AS INTEGER) AS lead FROM range(1, 6) t(i)) LEFT JOIN tm a ON a.label = 1 LEFT JOIN tm b ON b.label = 1 AND b.pos = a.pos + lead GROUP BY lead""", ["hit_rate"]))
def robustness_hit_rate(spark, d):
    """The table of the robustness job that needs no model."""
    return S.hit_rate(prepared(spark, d).times.withColumn("series_id", F.lit("t"))).drop("series_id")
