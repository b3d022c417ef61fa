"""Features, reduction, models and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import GRID, GRID_VARS, Catalog, final, grid, table
from checks.grids import ALL
from checks.samples import vectors
from gridsignal.operators import explain as E
from gridsignal.operators import features as X
from gridsignal.operators import grid as G
from gridsignal.operators import metrics, models, reduce
from gridsignal.operators.ordering import with_position
from gridsignal.session import settle, shared_path
from gridsignal.sources.models import load_model, save_model

catalog = Catalog()
add = catalog.add


def feature_rows(spark, d):
    """Feature-major matrix of the masked grid, and its time axis with every third step held out."""
    g = settle(grid(spark, d))
    field = G.keep_cells(g.where("var <> 'runoff'"), G.valid_cells(g, GRID_VARS))
    times = g.select("ts").distinct().withColumn("series_id", F.lit("t"))
    times = settle(with_position(times).withColumn("split", F.when(F.col("pos") % 3 == 2, "test").otherwise("train")))
    number = F.array_position(F.array(*[F.lit(v) for v in GRID_VARS]), F.col("var")) - 1
    long = field.join(times.select("ts", "pos"), "ts").select(
        (number * 1000 + F.col("cell_id")).alias("feature_id"), F.col("var").alias("block"), "cell_id", "pos", "value")
    return settle(X.pack(long)), times


FEATURES = f"""{GRID}, steps AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM grid)),
f AS (SELECT CASE var WHEN 'sst' THEN 0 WHEN 'sss' THEN 1000 ELSE 2000 END + cell_id AS feature_id, var AS block, cell_id, pos, value
 FROM grid JOIN steps USING (ts) WHERE var <> 'runoff' AND cell_id IN ({ALL})),
st AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS s FROM f WHERE pos % 3 <> 2 GROUP BY feature_id),
z AS (SELECT f.*, (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM f JOIN st USING (feature_id)),
w AS (SELECT DISTINCT feature_id, block, cell_id, CAST(pc AS INTEGER) AS pc, ((feature_id * 7 + pc * 3) % 11 - 5) / 10.0 AS w FROM f, range(4) t(pc))"""


def loadings(features):
    """Fixed loadings, so that projections have exact expected values."""
    w = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: ((F.col("feature_id") * 7 + c * 3) % 11 - 5) / 10.0)
    return features.select("feature_id", "block", "cell_id", w.alias("w"))


@add("feature_matrix", final(FEATURES, "SELECT feature_id, block, pos, value FROM f", ["value"]))
def feature_matrix(spark, d):
    return X.unpack(feature_rows(spark, d)[0], ("feature_id", "block"))


@add("standardize_on_train", final(FEATURES, "SELECT feature_id, pos, z AS value FROM z", ["value"]))
def standardize_on_train(spark, d):
    f, times = feature_rows(spark, d)
    return X.unpack(X.standardize(f, X.train_mask(times)), series="z")


@add("standardize_rows", final("", """SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value FROM events""", ["value"]))
def standardize_rows(spark, d):
    return X.standardize_rows(table(spark, d, "events").select("event_id", "value"), ["value"])


@add("drop_feature_block", final(FEATURES, "SELECT DISTINCT feature_id, block FROM f WHERE block <> 'sss'"))
def drop_feature_block(spark, d):
    return X.drop_block(feature_rows(spark, d)[0], "sss").select("feature_id", "block")


@add("project_on_loadings", final(FEATURES, "SELECT pos, pc, sum(z * w) AS score FROM z JOIN w USING (feature_id) GROUP BY ALL", ["score"]))
def project_on_loadings(spark, d):
    f, times = feature_rows(spark, d)
    scaled = settle(X.standardize(f, X.train_mask(times)))
    scores = reduce.pca_project(scaled, loadings(f))
    return scores.select("pos", F.posexplode("pcs").alias("pc", "score"))


@add("mean_abs_loading", final(FEATURES, "SELECT feature_id, block, avg(abs(w)) AS contribution FROM w GROUP BY ALL", ["contribution"]))
def mean_abs_loading(spark, d):
    return reduce.mean_abs_loading(loadings(feature_rows(spark, d)[0])).select("feature_id", "block", "contribution")


@add("block_importance", final(FEATURES, "SELECT block, sum(c) AS score, sum(c) / sum(sum(c)) OVER () AS share FROM (SELECT feature_id, block, avg(abs(w)) AS c FROM w GROUP BY ALL) GROUP BY block", ["score", "share"]))
def block_importance(spark, d):
    return reduce.block_importance(reduce.mean_abs_loading(loadings(feature_rows(spark, d)[0])))


@add("loading_map", final(f"{FEATURES}, allcells AS (SELECT DISTINCT cell_id FROM grid)", """SELECT a.cell_id, c AS value FROM allcells a
 LEFT JOIN (SELECT cell_id, avg(abs(w)) AS c FROM w WHERE block = 'ssh' GROUP BY cell_id) b ON a.cell_id = b.cell_id""", ["value"]))
def loading_map(spark, d):
    cells = grid(spark, d).select("cell_id").distinct()
    return reduce.loading_map(cells, loadings(feature_rows(spark, d)[0]), "ssh")


@add("select_feature_block", final(FEATURES, "SELECT DISTINCT feature_id, cell_id FROM f WHERE block = 'ssh'"))
def select_feature_block(spark, d):
    return X.select_block(feature_rows(spark, d)[0], "ssh").select("feature_id", "cell_id")


@add("concat_feature_blocks", final(FEATURES, "SELECT DISTINCT feature_id, block FROM f WHERE block <> 'sss'"))
def concat_feature_blocks(spark, d):
    f = feature_rows(spark, d)[0]
    return X.concat_blocks([X.select_block(f, "ssh"), X.select_block(f, "sst")]).select("feature_id", "block")


@add("fold_mean_attribution", final("", "SELECT CAST(extract(day FROM ts) AS INTEGER) AS fold, event_type AS feature, avg(abs(value - 50)) AS mean_shap FROM events GROUP BY ALL", ["mean_shap"]))
def fold_mean_attribution(spark, d):
    long = table(spark, d, "events").select(F.dayofmonth("ts").alias("fold"), F.col("event_type").alias("feature"), (F.col("value") - 50).alias("phi"))
    return E.mean_abs_shap(long)


@add("wide_pca_variance")
def wide_pca_variance(spark, d):
    return _variance(spark, d, reduce.COMPONENTS)


@add("wide_pca_exploratory")
def wide_pca_exploratory(spark, d):
    return _variance(spark, d, reduce.EXPLORATORY_COMPONENTS)


def _variance(spark, d, components):
    f, times = feature_rows(spark, d)
    mask = X.train_mask(times)
    pca = reduce.wide_pca(settle(X.standardize(f, mask)), mask, components)
    ratio = F.array(*[F.lit(r) for r in pca.explained_ratio])
    k = F.size("w")
    return pca.loadings.groupBy(k.alias("components")).agg(
        F.count(F.lit(1)).alias("features"), F.sum(F.col("w")[0] * F.col("w")[0]).alias("norm_pc1"),
        F.sum(F.col("w")[0] * F.col("w")[1]).alias("dot_pc1_pc2")).withColumn("ratio", F.explode(ratio))


def labelled(spark, d):
    return settle(vectors(spark, d))


@add("random_forest_scores")
def random_forest_scores(spark, d):
    v = labelled(spark, d)
    return models.score(models.train_forest(models.balanced(v)), v).select("row_id", "y", "p", "pred")


@add("boosted_tree_scores")
def boosted_tree_scores(spark, d):
    v = labelled(spark, d)
    return models.score(models.train_boosted(v), v).select("row_id", "y", "p", "pred")


@add("logistic_scores")
def logistic_scores(spark, d):
    v = labelled(spark, d)
    return models.score(models.train_logistic(v), v).select("row_id", "y", "p", "pred")


@add("model_round_trip")
def model_round_trip(spark, d):
    v = labelled(spark, d)
    path = shared_path(spark, "logistic")
    save_model(models.train_logistic(v), path)
    return models.score(load_model("logistic", path), v).select("row_id", "y", "p", "pred")


@add("time_cross_validation")
def time_cross_validation(spark, d):
    v = labelled(spark, d)
    return models.time_cv(v, order=("row_id",), grain=4096.0)


@add("baseline_models")
def baseline_models(spark, d):
    return models.baseline_table(labelled(spark, d), {"runoff": [0, 1, 2, 3]}, order=("row_id",), grain=4096.0)


@add("importance_by_group")
def importance_by_group(spark, d):
    v = labelled(spark, d)
    return models.importance_by_group(v, models.train_forest(v))


@add("tree_attributions")
def tree_attributions(spark, d):
    v = labelled(spark, d)
    explained = E.tree_shap(models.train_forest(v), v)
    total = F.aggregate("phi", F.lit(0.0), lambda a, x: a + x)
    return explained.select("row_id", "base", "output", (F.col("base") + total).alias("rebuilt"))


ALL_HOLD = "SELECT vec_id AS row_id, true AS adds_up, true AS is_score, true AS base_is_mean FROM embeddings"


def attribution_facts(explained, scored, base, to_output):
    """Whether base and attributions add up to the output, the output is the model's, and the base is what it must be."""
    near = lambda a, b: F.abs(a - b) < 1e-8
    total = F.aggregate("phi", F.col("base"), lambda a, x: a + x)
    return explained.join(scored.select("row_id", to_output(F.col("p")).alias("want")), "row_id").select(
        "row_id", near(total, F.col("output")).alias("adds_up"), near(F.col("output"), F.col("want")).alias("is_score"),
        near(F.col("base"), F.lit(base)).alias("base_is_mean"))


@add("tree_attributions_hold", ALL_HOLD)
def tree_attributions_hold(spark, d):
    """Expectation by training shares: the forest's root share of class 1, averaged over its trees."""
    v = labelled(spark, d)
    model = models.train_forest(v)
    roots = [tree["value"][0] for part in E.tree_parts(spark, model) for tree in part]
    return attribution_facts(E.tree_shap(model, v), models.score(model, v), float(sum(roots)), lambda p: p)


@add("background_attributions", ALL_HOLD)
def background_attributions(spark, d):
    """Boosted trees against the background rows: the base is their mean log-odds."""
    v = labelled(spark, d)
    model = models.train_boosted(v)
    chosen = v.orderBy("row_id").limit(E.BACKGROUND_ROWS)  # the size of the background is the feature
    odds = lambda p: F.ln(p / (1 - p))
    base = models.score(model, chosen).agg(F.avg(odds(F.col("p")))).first()[0]
    explained = E.tree_shap(model, v, background=[r.features for r in chosen.select("features").collect()])
    return attribution_facts(explained, models.score(model, v), base, odds)


STUMPS = """f AS (SELECT event_id AS row_id, CASE WHEN value >= 60 THEN 1 ELSE 0 END AS y, extract(hour FROM ts) AS x0, extract(day FROM ts) AS x1, floor(value / 25) AS x2 FROM events),
long AS (SELECT row_id, y, 0 AS feature, x0 AS x FROM f UNION ALL SELECT row_id, y, 1, x1 FROM f UNION ALL SELECT row_id, y, 2, x2 FROM f),
vals AS (SELECT feature, x, count(*) AS n, sum(y) AS s FROM long GROUP BY ALL),
cuts AS (SELECT feature, (x + lead(x) OVER w) / 2.0 AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s FROM vals WINDOW w AS (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gains AS (SELECT *, sl * (1.0 - sl / nl) + (s - sl) * (1.0 - (s - sl) / (n - nl)) AS spread FROM cuts WHERE cut IS NOT NULL AND n > nl),
best AS (SELECT feature, cut, sl / nl AS low, (s - sl) / (n - nl) AS high FROM gains ORDER BY spread, feature, cut LIMIT 1),
sided AS (SELECT row_id, CASE WHEN CASE feature WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= cut THEN low ELSE high END AS q FROM f, best)"""


@add("shallow_trees", final(STUMPS.replace("lead(x) OVER w", "lead(x) OVER (PARTITION BY feature ORDER BY x)"), "SELECT row_id, q AS forest_p, 1 / (1 + exp(-2 * (2 * q - 1))) AS boosted_p FROM sided", ["forest_p", "boosted_p"]))
def shallow_trees(spark, d):
    """One split, where SQL can search all of them: the fit finds the best, in a forest and in boosted trees."""
    e = table(spark, d, "events").select(
        F.col("event_id").alias("row_id"), (F.col("value") >= 60).cast("int").alias("y"),
        F.array(F.hour("ts").cast("double"), F.dayofmonth("ts").cast("double"), F.floor(F.col("value") / 25).cast("double")).alias("features"))
    forest = models.train_forest(e, 1, depth=1, subset="all", bootstrap=False)
    boosted = models.train_boosted(e, 1, depth=1)
    return models.score(forest, e).select("row_id", F.col("p").alias("forest_p")).join(
        models.score(boosted, e).select("row_id", F.col("p").alias("boosted_p")), "row_id")


@add("attribution_summary")
def attribution_summary(spark, d):
    v = labelled(spark, d)
    return E.shap_summary(E.shap_long(E.tree_shap(models.train_forest(v, models.SMALL_FOREST_TREES), v)))


@add("fold_importance_stability", final("""s AS (SELECT CAST(extract(day FROM ts) AS INTEGER) AS fold, event_type AS feature, avg(abs(value)) AS mean_shap FROM events GROUP BY ALL)""",
 "SELECT feature, avg(mean_shap) AS mean, stddev_samp(mean_shap) AS std FROM s GROUP BY feature ORDER BY mean DESC LIMIT 20", ["mean", "std"]))
def fold_importance_stability(spark, d):
    long = table(spark, d, "events").select(F.dayofmonth("ts").alias("fold"), F.col("event_type").alias("feature"), F.col("value").alias("phi"))
    return E.importance_stability(E.mean_abs_shap(long), top=E.TOP_FEATURES)


@add("attribution_stability")
def attribution_stability(spark, d):
    return E.shap_stability(models.folds_of(labelled(spark, d), order=("row_id",), grain=4096.0))


@add("rebalancing_strategies")
def rebalancing_strategies(spark, d):
    return models.rebalancing_table(labelled(spark, d), order=("row_id",), grain=4096.0)
