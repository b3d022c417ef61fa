"""Metrics, sampling, reduction, models and attributions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.operators import explain as E
from gridsignal.operators import features as X
from gridsignal.operators import forest
from gridsignal.operators import metrics as M
from gridsignal.operators import models, reduce
from gridsignal.operators import resample as R
from gridsignal.operators import neighbours
from gridsignal.operators.neighbours import nearest, search_effort
from gridsignal.session import settle
from gridsignal.sources.models import load_model, save_model


@pytest.fixture(params=["one block", "small blocks"])
def blocks(request, monkeypatch):
    """The same results with everything in one block and with blocks of seven rows."""
    if request.param == "small blocks":
        from gridsignal.operators import ordering

        monkeypatch.setattr(ordering, "BLOCK_ROWS", 7)


def scored(spark, rows):
    return spark.createDataFrame([(float(p), int(y)) for p, y in rows], "p double, y int")


def plain_auc(p, y):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_tied_scores_by_hand(spark):
    row = M.ranking_metrics(scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.2, 0), (0.1, 1)])).first()
    assert row.auc == pytest.approx(0.5) and row.ap == pytest.approx(2 / 3, abs=1e-4)


def test_single_class_has_no_auc(spark):
    row = M.ranking_metrics(scored(spark, [(0.9, 1), (0.8, 1)])).first()
    assert row.auc is None and row.ap == 1.0
    assert M.ranking_metrics(scored(spark, [(0.9, 0), (0.8, 0)])).first().ap is None


def test_auc_by_group_equals_pair_counting(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(int(i % 3), float(rng.integers(0, 30)), int(rng.random() < 0.3)) for i in range(600)]
    got = M.ranking_metrics(spark.createDataFrame(rows, "g int, p double, y int"), by=["g"]).collect()
    for r in got:
        assert r.auc == pytest.approx(plain_auc([a for g, a, _ in rows if g == r.g], [b for g, _, b in rows if g == r.g]))


def test_one_score_on_most_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, 0.5).otherwise(F.rand(1)).alias("p"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    pdf = settle(df)
    p = pdf.toPandas()
    pos, neg = p[p.y == 1].p.to_numpy(), p[p.y == 0].p.to_numpy()
    expected = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    assert M.roc_auc(pdf).first().auc == pytest.approx(expected)


def test_curves(spark, blocks):
    df = scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1), (0.5, 1), (0.2, 0)])
    roc = sorted((r.fpr, r.tpr) for r in M.roc_curve(df).collect())
    assert roc == [(0, 0), (0, 0.25), (0.5, 0.25), (0.5, 0.5), (0.5, 0.75), (0.5, 1.0), (1.0, 1.0)]
    corners = sorted((r.fpr, r.tpr) for r in M.roc_curve(df, drop_intermediate=True).collect())
    assert corners == [(0, 0), (0, 0.25), (0.5, 0.25), (0.5, 1.0), (1.0, 1.0)]
    end = [r for r in M.pr_curve(df).collect() if r.threshold is None]
    assert [(r.precision, r.recall) for r in end] == [(1.0, 0.0)]


def test_report_without_predictions_of_a_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, pred int")
    row = M.weighted_metrics(df).first()
    assert (row.accuracy, row.precision, row.recall) == pytest.approx((2 / 3, 4 / 9, 2 / 3))
    assert {(r.y, r.pred): r.n for r in M.confusion(df).collect()} == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_stratified_split(spark):
    df = spark.range(103).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    splits = [R.stratified_split(df.repartition(n)).orderBy("row_id").toPandas() for n in (1, 4, 16)]
    assert splits[0].equals(splits[1]) and splits[0].equals(splits[2])
    test = splits[0][splits[0].split == "test"]
    assert len(test) == math.ceil(103 * 0.3) and len(test[test.y == 1]) == 6


def test_time_folds(spark):
    df = spark.range(23).select(F.col("id").alias("pos"))
    got = R.time_series_folds(df).toPandas()
    for i in range(5):
        fold = got[got.fold == i]
        first = 23 - 3 * (5 - i)
        assert sorted(fold[fold.role == "test"].pos) == list(range(first, first + 3))
        assert sorted(fold[fold.role == "train"].pos) == list(range(first))


@pytest.mark.parametrize("block_points", [8, 50, 4096])
def test_neighbours_equal_brute_force(spark, block_points, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_POINTS", 8)
    rng = np.random.default_rng(block_points)
    x = rng.normal(size=(150, 3))
    x[20:90] = x[20]  # nearly half of the rows are copies of one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r.id, r["rank"]): r.neighbour for r in nearest(df, 4, block_points=block_points).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(150):
        order = sorted((j for j in range(150) if j != i), key=lambda j: (d[i, j], j))[:4]
        assert [got[(i, r)] for r in range(1, 5)] == order


def test_neighbours_on_a_lattice_and_far_from_the_origin(spark, monkeypatch):
    """Many equal distances, and coordinates whose squares swallow their differences."""
    monkeypatch.setattr(neighbours, "LEAST_POINTS", 16)
    x = np.array([[a, b, c] for a in range(5) for b in range(5) for c in range(5)], dtype="float64") * 1e-3 + 1e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r.id, r["rank"]): (r.neighbour, r.dist) for r in nearest(df, 3, block_points=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:3]
        assert [got[(i, r)] for r in range(1, 4)] == [(j, pytest.approx(d[i, j], abs=0)) for j in order]


def test_bounds_skip_most_pairs_of_grouped_points(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_POINTS", 32)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(8, 64)) * 20, 40, axis=0) + rng.normal(size=(320, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    effort = search_effort(df, 5, block_points=40).first()
    assert effort.pairs == 320 * 320 and effort.skipped > 0.5


def test_smote_balances_with_points_on_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i < 12), rng.normal(size=2).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, y int, features array<double>")
    out = R.smote(df, k=3).toPandas()
    assert (out.y == 1).sum() == (out.y == 0).sum() == 48
    small = np.array([r[2] for r in rows if r[1]])
    for f in out[out.synthetic].features:
        f = np.array(f)
        pairs = itertools.permutations(small, 2)
        assert any(abs(np.linalg.norm(f - a) + np.linalg.norm(f - b) - np.linalg.norm(a - b)) < 1e-9 for a, b in pairs)


def test_permutation_p_value_of_a_perfect_score(spark, blocks):
    df = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") / 40).alias("p"), (F.col("id") >= 30).cast("int").alias("y"))
    got = {r.metric: r for r in R.permutation_test(df, n=60).collect()}
    assert got["AUC"].observed == 1.0 and got["AUC"].p_value == 0.0 and 0.3 < got["AUC"].null_mean < 0.7


def test_bootstrap(spark, blocks):
    df = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") / 50).alias("p"), (F.col("id") >= 25).cast("int").alias("y"))
    assert {r.auc for r in R.bootstrap_auc(df, replicates=20).collect()} == {1.0}
    noise = [r.auc for r in R.bootstrap_auc(df, replicates=40, mode="random").collect()]
    assert len(noise) == 40 and 0.4 < np.mean(noise) < 0.6


def matrix(spark, n_features=40, steps=30, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4, steps))
    x = rng.normal(size=(n_features, 4)) @ base + 0.1 * rng.normal(size=(n_features, steps))
    x[7] = 3.0  # constant feature
    rows = [(i, "ab"[i % 2], i, r.tolist()) for i, r in enumerate(x)]
    features = spark.createDataFrame(rows, "feature_id long, block string, cell_id long, series array<double>").repartition(6)
    times = spark.createDataFrame([(t, "test" if t % 4 == 3 else "train") for t in range(steps)], "pos long, split string")
    return x, features, times


def test_standardize_fits_on_train_only(spark):
    x, features, times = matrix(spark)
    got = X.standardize(features, X.train_mask(times)).orderBy("feature_id").toPandas()
    train = np.array([t % 4 != 3 for t in range(30)])
    std = x[:, train].std(axis=1, keepdims=True)
    z = (x - x[:, train].mean(axis=1, keepdims=True)) / np.where(std > 1e-12, std, 1.0)
    assert np.allclose(np.stack(got.z), z)
    assert np.allclose(np.stack(X.standardize(features).orderBy("feature_id").toPandas().z)[0].std(), 1.0)


def test_wide_pca_equals_svd(spark):
    _, features, times = matrix(spark)
    mask = X.train_mask(times)
    scaled = settle(X.standardize(features, mask))
    pca = reduce.wide_pca(scaled, mask, k=4)
    w = np.stack(pca.loadings.orderBy("feature_id").toPandas().w)
    z = np.stack(scaled.orderBy("feature_id").toPandas().z)
    train = np.array([t % 4 != 3 for t in range(30)])
    u, s, _ = np.linalg.svd(z[:, train], full_matrices=False)
    assert np.allclose(np.abs(w), np.abs(u[:, :4]), atol=1e-6)
    assert np.allclose(w.T @ w, np.eye(4), atol=1e-8)
    assert pca.explained_variance == pytest.approx((s[:4] ** 2 / (train.sum() - 1)).tolist())
    scores = reduce.pca_project(scaled, pca.loadings).orderBy("pos").toPandas()
    assert np.allclose(np.stack(scores.pcs), z.T @ w)


def test_longest_time_axis_is_checked(spark, monkeypatch):
    _, features, _ = matrix(spark)
    monkeypatch.setattr(reduce, "MAX_STEPS", 10)
    with pytest.raises(ValueError, match="time steps"):
        reduce.wide_pca(features.withColumnRenamed("series", "z"))


def training(spark, n=120, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=n) > 0.6).astype(int)
    rows = [(i, int(y[i]), x[i].tolist()) for i in range(n)]
    return x, y, settle(spark.createDataFrame(rows, "row_id long, y int, features array<double>"))


def leaves_one_by_one(spark, model):
    """Leaves by walking every path."""
    out = []
    for tree in (t for part in E.tree_parts(spark, model) for t in part):
        stack = [(0, {})]
        while stack:
            node, box = stack.pop()
            if tree["left"][node] < 0:
                out.append((tree["value"][node], [(f, *b) for f, b in box.items()]))
                continue
            feature, cut = int(tree["feature"][node]), tree["cut"][node]
            low, high, share = box.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((int(tree["left"][node]), (low, min(high, cut))), (int(tree["right"][node]), (max(low, cut), high))):
                stack.append((child, {**box, feature: (*bounds, share * tree["count"][child] / tree["count"][node])}))
    return out


def brute_shapley(leaves, x, width, background=None):
    """Shapley values from the definition: every subset of features."""

    def value(present):
        total = 0.0
        for leaf, path in leaves:
            weights = []
            for b in [None] if background is None else background:
                part = leaf
                for f, low, high, share in path:
                    if f in present:
                        part *= float(low < x[f] <= high)
                    else:
                        part *= share if b is None else float(low < b[f] <= high)
                weights.append(part)
            total += sum(weights) / len(weights)
        return total

    phi = np.zeros(width)
    for i in range(width):
        others = [j for j in range(width) if j != i]
        for size in range(width):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                phi[i] += w * (value({*s, i}) - value(set(s)))
    return phi, value(set())


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_attributions_equal_the_definition(spark, kind):
    x, _, df = training(spark)
    model = models.train_forest(df, 5, depth=4) if kind == "forest" else models.train_boosted(df, 4, 3)
    leaves = leaves_one_by_one(spark, model)
    for background in (None, x[:3].tolist()):
        got = E.tree_shap(model, df.where("row_id < 4"), background=background).orderBy("row_id").toPandas()
        for r in got.itertuples():
            phi, base = brute_shapley(leaves, x[r.row_id], 4, background)
            assert np.allclose(r.phi, phi) and r.base == pytest.approx(base)
            assert r.base + sum(r.phi) == pytest.approx(r.output)
    out = E.tree_shap(model, df).toPandas().set_index("row_id").output
    p = models.score(model, df).toPandas().set_index("row_id").p
    expected = p if kind == "forest" else np.log(p / (1 - p))
    assert np.allclose(out.loc[p.index], expected)


def by_leaves(tree, x, width):
    """Attributions by shares, leaf by leaf: the rule of the line, one product for each."""
    phi = np.zeros((len(x), width))
    for value, feature, low, high, share in (leaf for group in E.leaves_of(tree) for leaf in zip(*group)):
        t, weight = E.line_rule(len(feature))
        held = (x[:, feature] > low) & (x[:, feature] <= high)
        out = share[:, None] * (1 - t)
        factor = np.where(held[:, :, None], out + t, out)
        for j, f in enumerate(feature):
            own = np.where(held[:, j, None], (1 - share[j]) / (out[j] + t), -1 / (1 - t))
            phi[:, f] += value * ((factor.prod(axis=1) * own) @ weight)
    return phi


@pytest.mark.parametrize("rows", [1, 50, 3000])
def test_rows_share_the_work_of_a_tree(spark, rows, monkeypatch):
    """Deep trees that meet few features again and again: fewer sums than nodes, and the same attributions."""
    x, _, df = training(spark, 400, d=3)
    many = np.concatenate([x] * 8)[:rows] + np.random.default_rng(1).normal(size=(rows, 3))
    calls, own = [], E.Shares.sums
    monkeypatch.setattr(E.Shares, "sums", lambda self, *args: (calls.append(1), own(self, *args))[1])
    for tree in next(E.tree_parts(spark, models.train_forest(df, 3))):
        calls.clear()
        phi, base, output = E.Shares(many, tree, 3).run()
        assert np.allclose(phi, by_leaves(tree, many, 3)) and np.allclose(base + phi.sum(axis=1), output)
        assert rows == 1 or len(calls) < len(tree["left"])


def test_background_parts_are_worked_out_once_a_pattern(spark, monkeypatch):
    x, _, df = training(spark, 400)
    tree = E.leaves_of(next(E.tree_parts(spark, models.train_boosted(df, 1, 4)))[0])
    alone = np.concatenate([E.attribute(x[i : i + 1], tree, 4, x[:9])[0] for i in range(400)])
    seen, own = [], E.by_background
    monkeypatch.setattr(E, "by_background", lambda o, z, value: (seen.append(o.shape[1] <= 1 << o.shape[2]), own(o, z, value))[1])
    assert np.allclose(E.attribute(x, tree, 4, x[:9])[0], alone) and all(seen)


def test_attributions_keep_rows_with_the_same_or_no_id(spark, monkeypatch):
    """Also where the rows are in several blocks and the trees are dealt out."""
    x, _, df = training(spark)
    monkeypatch.setattr(E, "TASK_CELLS", 4 * 40)
    model = models.train_forest(df, 5, depth=4)
    odd = df.withColumn("row_id", F.when(F.col("row_id") > 9, F.col("row_id") % 50))
    got = E.tree_shap(model, odd)
    want = E.tree_shap(model, df).select("row_id", F.round("output", 9).alias("o")).collect()
    assert sorted((r.row_id % 50 if r.row_id > 9 else -1, r.o) for r in want) == sorted(
        (-1 if r.row_id is None else r.row_id, r.o) for r in got.select("row_id", F.round("output", 9).alias("o")).collect())
    assert got.where(F.abs(F.col("base") + F.aggregate("phi", F.lit(0.0), lambda a, v: a + v) - F.col("output")) > 1e-9).count() == 0


def test_fits_of_many_rows_come_one_by_one_and_their_scores_are_written(spark, monkeypatch):
    _, _, df = training(spark, 150)
    folds = models.folds_of(df, 3, ("row_id",), 1000.0)
    running, most = [], []

    def fit(train):
        running.append(1)
        most.append(len(running))
        model = models.train_forest(train, 3, depth=3)
        running.pop()
        return model

    monkeypatch.setattr(models, "SIDE_ROWS", 10)
    scored = models.out_of_fold(folds, 3, fit)
    assert max(most) == 1 and scored.count() == 3 * (150 // 4)
    assert "UDF" not in scored._jdf.queryExecution().toString()


def test_partitions_of_a_fit_do_not_grow_with_the_files(spark):
    _, _, df = training(spark, 150)
    cores = spark.sparkContext.defaultParallelism
    for rows in (1000, 100):
        chosen, _ = models.fitted_rows(df.repartition(5 * cores), rows)
        assert chosen.rdd.getNumPartitions() <= cores
        few, _ = models.fitted_rows(df.repartition(5 * cores), rows, task_rows=1000)
        assert few.rdd.getNumPartitions() == 1 and few.count() == chosen.count()


def test_trees_learn_from_all_rows(spark):
    """The few positive rows are in the fit wherever they stand, and the counts of the nodes are those of the table."""
    n = 210_000
    df = settle(spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 20 == 0).cast("int").alias("y"), F.array((F.col("id") % 20).cast("double")).alias("features")))
    assert models.fitted_rows(df)[0].count() == n
    for model in (models.train_forest(df, 1, depth=1, bootstrap=False), models.train_boosted(df, 1, depth=1)):
        tree = next(E.tree_parts(spark, model))[0]
        assert sorted(tree["count"]) == [n // 20, n - n // 20, n] and set(tree["cut"]) == {0.0, 0.5}


def few_values(spark, n=600):
    """Rows whose features have few values, so that all cuts between values are tried."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(n, 3)).astype(float)
    y = (x[:, 0] * 3 + x[:, 1] - x[:, 2] + rng.normal(size=n) * 4 > 20).astype(int)
    return x, y, settle(spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "row_id long, y int, features array<double>"))


def test_grown_trees_are_those_of_spark(spark, monkeypatch):
    _, _, df = few_values(spark)
    options = {"trees": 1, "depth": 6, "subset": "all", "bootstrap": False}
    own = models.train_forest(df, **options)
    monkeypatch.setattr(models, "GROWN_ROWS", 100)
    for cells in (1 << 20, 1):  # of one node after the other, too
        monkeypatch.setattr(forest, "HISTOGRAM_CELLS", cells)
        grown = models.train_forest(df, **options)
        assert isinstance(grown, forest.Forest) and not isinstance(own, forest.Forest)
        score = lambda m: {r.row_id: r.p for r in models.score(m, df).select("row_id", "p").collect()}
        assert score(grown) == pytest.approx(score(own)) and len(set(score(own).values())) > 5
        a, b = (next(E.tree_parts(spark, m))[0] for m in (grown, own))
        inner = [sorted(zip(t["feature"][t["left"] >= 0], t["cut"][t["left"] >= 0], t["count"][t["left"] >= 0])) for t in (a, b)]
        assert inner[0] == inner[1] and sorted(a["value"]) == pytest.approx(sorted(b["value"]))
        assert np.allclose(grown.featureImportances.toArray(), own.featureImportances.toArray())


@pytest.mark.parametrize("how", ["grown", "by groups"])
def test_forests_of_many_rows(spark, monkeypatch, tmp_path, how):
    """Their nodes are a table; scores, attributions, importances and stored forests are those of other models."""
    x, y, df = few_values(spark)
    monkeypatch.setattr(models, "GROWN_ROWS", 100)
    monkeypatch.setattr(forest, "PART_NODES", 150)
    monkeypatch.setattr(forest, "SCORED_ROWS", 100)
    if how == "by groups":
        monkeypatch.setattr(forest, "GROWN_BYTES", 0)
        monkeypatch.setattr(forest, "GROUP_NODES", 2 * 600 * 3)  # three trees at a time
    model = models.train_forest(df, 7)
    assert isinstance(model, forest.Forest) and len(model.sizes) == 7 and len(list(E.tree_parts(spark, model))) > 1
    scored = models.score(model, df).toPandas().set_index("row_id")
    assert (scored.pred == (scored.p > 0.5)).all() and (scored.pred == y[scored.index]).mean() > 0.8
    assert model.numFeatures == 3 and model.featureImportances.toArray().sum() == pytest.approx(1)
    for r in E.tree_shap(model, df).toPandas().itertuples():
        assert r.output == pytest.approx(scored.p[r.row_id]) and r.base + sum(r.phi) == pytest.approx(r.output)
    leaves = leaves_one_by_one(spark, model)
    for i in (0, 17):
        phi, base = brute_shapley(leaves, x[i], 3)
        got = E.tree_shap(model, df.where(F.col("row_id") == i)).first()
        assert np.allclose(got.phi, phi) and got.base == pytest.approx(base)
    for again in range(2):
        save_model(model, f"{tmp_path}/m")
    loaded = load_model("forest", f"{tmp_path}/m")
    assert models.score(loaded, df).toPandas().set_index("row_id").p.to_dict() == scored.p.to_dict()
    save_model(models.train_forest(df.limit(50), 2), f"{tmp_path}/m")
    assert not isinstance(load_model("forest", f"{tmp_path}/m"), forest.Forest)


def test_cuts_come_from_all_values(monkeypatch):
    """A value that few rows have is found, and cuts at quantiles hold up to the kept values."""
    values, counts = forest.kept_values(np.append(np.zeros(100_000), [1.0]))
    assert forest.cuts_of(values, counts).tolist() == [0.5]
    x = np.random.default_rng(0).normal(size=50_000)
    kept = [forest.kept_values(c) for c in np.split(x, 5)]
    cuts = forest.cuts_of(np.concatenate([v for v, _ in kept]), np.concatenate([c for _, c in kept]))
    assert len(cuts) == forest.BINS - 1 and sum(c.sum() for _, c in kept) == len(x)
    assert np.abs((x[:, None] <= cuts).mean(axis=0) - np.arange(1, 32) / 32).max() < 0.002


def test_models_learn_and_tables_have_their_rows(spark):
    _, _, df = training(spark, 150)
    cv = models.time_cv(df, 3, lambda t: models.train_forest(t, 10, depth=5), order=("row_id",), grain=1000.0).toPandas()
    assert len(cv) == 3 and cv.auc.mean() > 0.7
    base = {r.model: r for r in models.baseline_table(df, {"runoff": [3]}, 3, order=("row_id",), grain=1000.0).collect()}
    assert set(base) == {"Persistence", "Logistic", "Runoff-only"} and base["Logistic"].auc > base["Runoff-only"].auc
    fit = {r.model: r for r in models.baseline_table(df, {"runoff": [3]}, in_sample=True, order=("row_id",), grain=1000.0).collect()}
    assert fit["Logistic"].auc > 0.7
    reb = models.rebalancing_table(df, in_sample=True, rounds=3).collect()
    assert {r.strategy for r in reb} == {"Weights", "SMOTE"} and min(r.auc for r in reb) > 0.8
    rows = models.importance_by_group(df, models.train_forest(df, 5), {"a": 2, "b": 1}).orderBy("feature").collect()
    assert [(r.block, r["index"]) for r in rows] == [("a", 0), ("a", 1), ("b", 0), (None, 0)]


def test_logistic_matches_newton(spark):
    x, y, df = training(spark, 100)
    model = models.train_logistic(df)
    w = np.zeros(5)
    a = np.column_stack([x, np.ones(100)])
    penalty = np.diag([1.0] * 4 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    assert np.allclose(np.append(model.coefficients.toArray(), model.intercept), w, atol=1e-3)


def test_a_fold_trained_on_one_class_keeps_its_row(spark):
    rows = [(i, i, int(i >= 20 and i % 3 == 0), [float(i % 5), float(i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, ts long, y int, features array<double>")
    got = {r.fold: r for r in models.time_cv(df, 5, fit=models.train_logistic, balance=False).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert got[0].auc is None and got[4].auc is not None
