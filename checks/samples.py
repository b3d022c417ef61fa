"""Splits, folds, balancing and replicate tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import SCORED_EVENTS, SCORED_HOURS, Catalog, final, scored_events, scored_hours, table
from gridsignal.operators import resample as R
from gridsignal.operators.neighbours import nearest
from gridsignal.operators.ordering import with_position
from gridsignal.session import settle

catalog = Catalog()
add = catalog.add


def draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


SPLIT = f"""{SCORED_EVENTS}, rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {draw("'42'", 'row_id')}, row_id) AS r FROM scored),
sz AS (SELECT y, count(*) AS n, floor(count(*) * 0.3) AS base, round(count(*) * 0.3 - floor(count(*) * 0.3), 9) AS rest FROM scored GROUP BY y),
qt AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= ceil(round(sum(n) OVER () * 0.3, 9)) - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM sz),
split AS (SELECT rk.*, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS split FROM rk JOIN qt USING (y))"""


@add("stratified_split", final(SPLIT, "SELECT row_id, y, split FROM split"))
def stratified_split(spark, d):
    return R.stratified_split(scored_events(spark, d)).select("row_id", "y", "split")


@add("reassemble_splits", final(SPLIT, "SELECT row_id, y, p FROM split", ["p"]))
def reassemble_splits(spark, d):
    s = settle(R.stratified_split(scored_events(spark, d)).select("row_id", "y", "p", "split"))
    return R.reassemble(s.where("split = 'train'"), s.where("split = 'test'")).select("row_id", "y", "p")


FOLDS = f"""{SCORED_EVENTS}, o AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) - 1 AS pos, count(*) OVER () AS n FROM scored),
f AS (SELECT o.*, CAST(i AS INTEGER) AS fold, n - (n // 6) * (5 - i) AS cut FROM o, range(5) t(i)),
folds AS (SELECT row_id, y, p, pred, fold, CASE WHEN pos < cut THEN 'train' ELSE 'test' END AS role FROM f WHERE pos < cut + n // 6)"""


@add("time_series_folds", final(FOLDS, "SELECT row_id, fold, role FROM folds"))
def time_series_folds(spark, d):
    s = with_position(scored_events(spark, d).select("row_id", "ts"), (), ["ts", "row_id"])
    return R.time_series_folds(s).select("row_id", "fold", "role")


@add("class_weights", final(SCORED_EVENTS, """SELECT event_type, row_id, CASE WHEN y = 1 THEN (SELECT count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1) FROM scored) ELSE 1.0 END AS weight FROM scored""", ["weight"]))
def class_weights(spark, d):
    return R.with_class_weight(scored_events(spark, d)).select("event_type", "row_id", "weight")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("features"))


NEAR = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE {0}),
pairs AS (SELECT a.id, b.id AS neighbour, list_distance(a.x, b.x) AS dist FROM v a JOIN v b ON a.id <> b.id),
knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 5)"""


@add("nearest_neighbours", final(NEAR.format("true"), "SELECT id, rank, neighbour, dist FROM knn", ["dist"]))
def nearest_neighbours(spark, d):
    v = vectors(spark, d)
    return nearest(v.select(F.col("row_id").alias("id"), F.col("features").alias("x")))


SMOTE = f"""{NEAR.format('label = 0')}, c AS (SELECT count(*) FILTER (WHERE label = 0) AS have, count(*) FILTER (WHERE label <> 0) AS other FROM embeddings),
pl AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS base FROM v),
dr AS (SELECT j, {draw("'42'", "'base'", 'j')} % have AS base, {draw("'42'", "'near'", 'j')} % 5 + 1 AS rank, {draw("'42'", "'gap'", 'j')} / 1152921504606846976.0 AS u FROM c, range((SELECT other - have FROM c)) t(j)),
syn AS (SELECT dr.j AS row_id, 1 AS y, true AS synthetic, list_transform(list_zip(pl.x, nb.x), lambda p: p[1] + dr.u * (p[2] - p[1])) AS features FROM dr JOIN pl USING (base)
 JOIN knn ON knn.id = pl.id AND knn.rank = dr.rank JOIN v nb ON nb.id = knn.neighbour),
bal AS (SELECT * FROM syn UNION ALL SELECT vec_id, CAST(label = 0 AS INTEGER), false, CAST(embedding AS DOUBLE[]) FROM embeddings)"""


@add("smote", final(SMOTE, "SELECT row_id, y, synthetic, list_sum(features) AS total, features[1] AS f0, features[64] AS f63 FROM bal", ["total", "f0", "f63"]))
def smote(spark, d):
    s = R.smote(vectors(spark, d))
    return s.select("row_id", "y", "synthetic", F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("total"),
                    F.col("features")[0].alias("f0"), F.col("features")[63].alias("f63"))


REPL = """t AS (SELECT replicate, p, sum(y) AS pos, sum(1 - y) AS neg FROM drawn GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY replicate) AS np, sum(neg) OVER (PARTITION BY replicate) AS nn
 FROM t WINDOW w AS (PARTITION BY replicate ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT replicate, sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)) AS auc, sum(pos * tp / (tp + fp)) / max(np) AS ap FROM c GROUP BY replicate)"""

BOOT = f"""{SCORED_HOURS}, b AS (SELECT CAST(i // n AS INTEGER) AS replicate, {draw("'42'", "'boot'", 'i')} % n AS pos, i, n FROM (SELECT count(*) AS n FROM prob) k, range((SELECT count(*) * 200 FROM prob)) t(i))"""


@add("bootstrap_auc", final(f"{BOOT}, drawn AS (SELECT replicate, p, label AS y FROM b JOIN prob USING (pos)), {REPL}", "SELECT replicate, auc FROM m", ["auc"]))
def bootstrap_auc(spark, d):
    return R.bootstrap_auc(scored_hours(spark, d), label="label")


@add("bootstrap_auc_no_skill", final(f"{BOOT}, drawn AS (SELECT replicate, {draw(chr(39) + '42' + chr(39), chr(39) + 'noise' + chr(39), 'i')} AS p, label AS y FROM b JOIN prob USING (pos)), {REPL}", "SELECT replicate, auc FROM m", ["auc"]))
def bootstrap_auc_no_skill(spark, d):
    return R.bootstrap_auc(scored_hours(spark, d), label="label", mode="random")


PERM = f"""{SCORED_HOURS}, f AS (SELECT i AS replicate, p, pos AS row_id, row_number() OVER (PARTITION BY i ORDER BY {draw("'42'", 'i', 'pos')}, pos) AS r FROM prob, range(1000) t(i)),
drawn AS (SELECT replicate, p, CASE WHEN r <= (SELECT sum(label) FROM prob) THEN 1 ELSE 0 END AS y FROM f), {REPL}"""


@add("permutation_metrics", final(PERM, "SELECT CAST(replicate AS INTEGER) AS permutation, auc, ap FROM m", ["auc", "ap"]))
def permutation_metrics(spark, d):
    return R.permutation_metrics(scored_hours(spark, d), label="label", row_id="pos")


@add("permutation_test", final(f"""{PERM}, seen0 AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM prob GROUP BY p),
seen1 AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM seen0 WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
seen AS (SELECT sum(pos * ((SELECT sum(neg) FROM seen0) - fp + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM seen1)""",
 """SELECT 'AUC' AS metric, (SELECT auc FROM seen) AS observed, avg(auc) AS null_mean, avg(CASE WHEN auc >= (SELECT auc FROM seen) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p_value FROM m
 UNION ALL SELECT 'AP', (SELECT ap FROM seen), avg(ap), avg(CASE WHEN ap >= (SELECT ap FROM seen) - 1e-12 THEN 1.0 ELSE 0.0 END) FROM m""", ["observed", "null_mean", "p_value"]))
def permutation_test(spark, d):
    return R.permutation_test(scored_hours(spark, d), label="label", row_id="pos")
