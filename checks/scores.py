"""Metrics, curves and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import SCORED_EVENTS, SCORED_HOURS, TYPED, Catalog, final, scored_events, scored_hours, table, typed
from gridsignal.operators import labels as L
from gridsignal.operators import metrics as M
from gridsignal.operators import stats as S
from gridsignal.operators.windows import persistence_baseline
from gridsignal.session import settle

catalog = Catalog()
add = catalog.add

# Events by day of the month give the groups; positives are purchases.
DAILY = f"{SCORED_EVENTS}, day AS (SELECT *, CAST(extract(day FROM ts) AS INTEGER) AS fold FROM scored)"


def daily(spark, d):
    return scored_events(spark, d).withColumn("fold", F.dayofmonth("ts"))


CURVE = """t AS (SELECT fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM day GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS np, sum(neg) OVER (PARTITION BY fold) AS nn
 FROM t WINDOW w AS (PARTITION BY fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""

ALLCURVE = f"{SCORED_EVENTS}, day AS (SELECT *, 0 AS fold FROM scored), {CURVE}"


@add("ranking_metrics_by_group", final(f"{DAILY}, {CURVE}", """SELECT fold, CAST(max(np) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives,
 sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)) AS auc, sum(pos * tp / (tp + fp)) / max(np) AS ap FROM c GROUP BY fold""", ["auc", "ap"]))
def ranking_by_group(spark, d):
    return M.ranking_metrics(daily(spark, d), by=["fold"])


@add("roc_auc", final(ALLCURVE, "SELECT sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)) AS auc FROM c", ["auc"]))
def roc_auc(spark, d):
    return M.roc_auc(scored_events(spark, d))


@add("average_precision", final(ALLCURVE, "SELECT sum(pos * tp / (tp + fp)) / max(np) AS ap FROM c", ["ap"]))
def average_precision(spark, d):
    return M.average_precision(scored_events(spark, d))


@add("roc_curve", final(ALLCURVE, "SELECT p AS threshold, fp / nn AS fpr, tp / np AS tpr FROM c UNION ALL SELECT NULL, 0, 0", ["threshold", "fpr", "tpr"]))
def roc_curve(spark, d):
    return M.roc_curve(scored_events(spark, d))


@add("roc_curve_corners", final(f"{ALLCURVE}, n AS (SELECT *, lead(pos) OVER w AS p1, lead(neg) OVER w AS n1, row_number() OVER w AS i FROM c WINDOW w AS (ORDER BY p DESC))",
 "SELECT p AS threshold, fp / nn AS fpr, tp / np AS tpr FROM n WHERE i = 1 OR p1 IS NULL OR p1 <> pos OR n1 <> neg UNION ALL SELECT NULL, 0, 0", ["threshold", "fpr", "tpr"]))
def roc_curve_corners(spark, d):
    return M.roc_curve(scored_events(spark, d), drop_intermediate=True)


@add("pr_curve", final(f"{DAILY}, {CURVE}", "SELECT fold, p AS threshold, tp / (tp + fp) AS precision, tp / np AS recall FROM c UNION ALL SELECT DISTINCT fold, NULL, 1, 0 FROM day",
 ["threshold", "precision", "recall"]))
def pr_curve(spark, d):
    return M.pr_curve(daily(spark, d), by=["fold"])


@add("confusion", final(SCORED_EVENTS, "SELECT a.y, b.pred, count(s.y) AS n FROM (VALUES (0), (1)) a(y) CROSS JOIN (VALUES (0), (1)) b(pred) LEFT JOIN scored s ON s.y = a.y AND s.pred = b.pred GROUP BY ALL"))
def confusion(spark, d):
    return M.confusion(scored_events(spark, d))


@add("confusion_matrix", final(SCORED_EVENTS, "SELECT y, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1 FROM scored GROUP BY y"))
def confusion_matrix(spark, d):
    return M.confusion_matrix(scored_events(spark, d))


PER_CLASS = """cls AS (SELECT fold, c AS class, count(*) FILTER (WHERE y = c AND pred = c) AS tp, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE pred = c) AS called
 FROM day, (VALUES (0), (1)) v(c) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM cls),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


@add("classification_report", final(f"{SCORED_EVENTS}, day AS (SELECT *, 0 AS fold FROM scored), {PER_CLASS}", """
 SELECT CAST(class AS VARCHAR) AS row, precision, recall, f1, support FROM pc
 UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM pc
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc""",
 ["precision", "recall", "f1"]))
def classification_report(spark, d):
    return M.classification_report(scored_events(spark, d))


@add("weighted_metrics", final(f"{DAILY}, {PER_CLASS}", """SELECT fold, sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
 sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1_score FROM pc GROUP BY fold""", ["accuracy", "precision", "recall", "f1_score"]))
def weighted_metrics(spark, d):
    return M.weighted_metrics(daily(spark, d), by=["fold"])


BINARY = f"""{DAILY}, {CURVE}, {PER_CLASS}, rk AS (SELECT fold, sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)) AS auc, sum(pos * tp / (tp + fp)) / max(np) AS ap FROM c GROUP BY fold),
bin AS (SELECT fold, auc, ap, precision, recall, f1 FROM rk JOIN pc USING (fold) WHERE class = 1)"""
METRICS = ["auc", "ap", "precision", "recall", "f1"]


@add("binary_metrics", final(BINARY, "SELECT * FROM bin", METRICS))
def binary_metrics(spark, d):
    return M.binary_metrics(daily(spark, d), by=["fold"])


@add("melt_metrics", final(BINARY, "UNPIVOT bin ON auc, ap, precision, recall, f1 INTO NAME metric VALUE value", ["value"]))
def melt_metrics(spark, d):
    return S.unpivot_metrics(M.binary_metrics(daily(spark, d), by=["fold"]), ["fold"], METRICS)


@add("pivot_metrics", final(BINARY, "SELECT * FROM bin", METRICS))
def pivot_metrics(spark, d):
    long = S.unpivot_metrics(M.binary_metrics(daily(spark, d), by=["fold"]), ["fold"], METRICS)
    return S.pivot_metrics(long, ["fold"], METRICS)


@add("box_stats", final(f"{BINARY}, m AS (UNPIVOT bin ON auc, ap, precision, recall, f1 INTO NAME metric VALUE value), q AS (SELECT metric, count(*) AS n, min(value) AS minimum, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS maximum FROM m GROUP BY metric)",
 """SELECT q.*, min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_low, max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
 count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM q JOIN m USING (metric) GROUP BY ALL""",
 ["minimum", "q1", "median", "q3", "maximum", "whisker_low", "whisker_high"]))
def box_stats(spark, d):
    long = S.unpivot_metrics(M.binary_metrics(daily(spark, d), by=["fold"]), ["fold"], METRICS)
    return S.box_stats(settle(long))


@add("quantiles_by_group", final("", """SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90
 FROM events GROUP BY event_type""", ["q1", "median", "p90"]))
def quantiles_by_group(spark, d):
    return S.quantiles(table(spark, d, "events"), "value", {"q1": 0.25, "median": 0.5, "p90": 0.9}, ["event_type"])


@add("equal_width_histogram", final("r AS (SELECT min(value) AS lo, max(value) AS hi FROM events)", """SELECT CAST(i AS INTEGER) AS bin, lo + (hi - lo) / 20 * i AS lower, lo + (hi - lo) / 20 * (i + 1) AS upper,
 (SELECT count(*) FROM events WHERE least(floor((value - lo) / (hi - lo) * 20), 19) = i) AS n FROM range(20) t(i), r""", ["lower", "upper"]))
def equal_width_histogram(spark, d):
    return S.equal_width_histogram(table(spark, d, "events"), "value")


TH = "th AS (SELECT 12.0 * i AS threshold FROM (VALUES (3.0), (3.5), (4.0), (4.5), (5.0)) v(i))"
THRESHOLDS = [36.0, 42.0, 48.0, 54.0, 60.0]


@add("class_balance", final(f"{TYPED}, {TH}", """SELECT series_id, threshold, count(*) FILTER (WHERE value < threshold) AS weak_n, count(*) FILTER (WHERE value >= threshold) AS strong_n,
 100.0 * count(*) FILTER (WHERE value < threshold) / count(*) AS weak_pct FROM typed, th GROUP BY ALL""", ["threshold", "weak_pct"]))
def class_balance(spark, d):
    return L.class_balance(typed(spark, d), THRESHOLDS, by=["series_id"])


@add("threshold_sweep", final(f"{TYPED}, {TH}", "SELECT series_id, ts, threshold, CAST(value < threshold AS INTEGER) AS label FROM typed, th", ["threshold"], ["ts"]))
def threshold_sweep(spark, d):
    return L.sweep(typed(spark, d), THRESHOLDS).select("series_id", "ts", "threshold", "label")


@add("class_histogram", final(f"{TYPED}, {TH}", "SELECT threshold, CAST(value < threshold AS INTEGER) AS label, count(*) AS n FROM typed, th GROUP BY ALL", ["threshold"]))
def class_histogram(spark, d):
    return L.class_histogram(L.sweep(typed(spark, d), THRESHOLDS), by=["threshold"])


GUARD = [0.0, 48.0, 10000.0]


@add("single_class_guard", final(TYPED, """SELECT series_id, threshold, count(*) AS n, CAST(sum(CAST(value < threshold AS INTEGER)) AS BIGINT) AS weak
 FROM typed, (VALUES (0.0), (48.0), (10000.0)) v(threshold) GROUP BY ALL HAVING count(DISTINCT value < threshold) = 2""", ["threshold"]))
def single_class_guard(spark, d):
    s = L.sweep(settle(typed(spark, d)), GUARD)
    kept = L.drop_single_class(s, by=["series_id", "threshold"])
    return kept.groupBy("series_id", "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("weak"))


@add("best_threshold", final("""t AS (SELECT l_quantity AS threshold, avg(l_discount) AS f1_score FROM lineitem GROUP BY 1)""", "SELECT threshold, f1_score FROM t ORDER BY f1_score DESC, threshold LIMIT 1", ["threshold", "f1_score"]))
def best_threshold(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("threshold")).agg(F.avg("l_discount").alias("f1_score"))
    return S.best_threshold(t)


def _hits(condition):
    return final(f"{SCORED_HOURS}, n AS (SELECT count(*) AS n FROM prob)", f"""SELECT a.series_id, lead, count(b.pos) AS hits, count(*) AS events,
 count(b.pos) / greatest(count(*), 1) AS hit_rate FROM prob a CROSS JOIN n CROSS JOIN (SELECT CAST(i AS INTEGER) AS lead FROM range(1, 6) t(i))
 LEFT JOIN prob b ON b.label = 1 AND b.pos = {condition} WHERE a.label = 1 GROUP BY ALL""", ["hit_rate"])


@add("hit_rate", _hits("a.pos + lead"))
def hit_rate(spark, d):
    return S.hit_rate(scored_hours(spark, d))


@add("hit_rate_circular", _hits("(a.pos + lead) % n"))
def hit_rate_circular(spark, d):
    return S.hit_rate(scored_hours(spark, d), wrap=True)


@add("standard_error", final("", "SELECT event_type, stddev_samp(value) / sqrt(count(value)) AS standard_error FROM events GROUP BY 1", ["standard_error"]))
def standard_error(spark, d):
    return S.standard_error(table(spark, d, "events"), "value", ["event_type"])


@add("p_value", final("", "SELECT event_type, avg(CASE WHEN value >= 100.0 THEN 1.0 ELSE 0.0 END) AS p_value, avg(value) AS null_mean FROM events GROUP BY 1", ["p_value", "null_mean"]))
def p_value(spark, d):
    return S.p_value(table(spark, d, "events"), "value", F.lit(100.0), ["event_type"])


@add("false_alarms_per_decade", final(f"{SCORED_HOURS}, a AS (SELECT *, coalesce(lead(CAST(p > 0.5 AS INTEGER), 36) OVER (ORDER BY pos), 0) AS alarm FROM prob)",
 """SELECT series_id, count(*) FILTER (WHERE label = 1 AND alarm = 1) AS true_events, count(*) FILTER (WHERE label = 0 AND alarm = 1) AS false_alarms,
 round(count(*) FILTER (WHERE label = 0 AND alarm = 1) / (count(*) / 12.0 / 10.0), 2) AS false_alarms_per_decade FROM a GROUP BY 1""", ["false_alarms_per_decade"]))
def false_alarms_per_decade(spark, d):
    s = scored_hours(spark, d).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return S.false_alarm_rate(s)


@add("persistence_baseline_metrics", final(f"{SCORED_HOURS}, b AS (SELECT label AS y, coalesce(lag(label) OVER (ORDER BY pos), 0) AS pred FROM prob)", """SELECT
 count(*) FILTER (WHERE y = 1 AND pred = 1) / count(*) FILTER (WHERE pred = 1) AS precision, count(*) FILTER (WHERE y = 1 AND pred = 1) / count(*) FILTER (WHERE y = 1) AS recall,
 (count(*) FILTER (WHERE y = 1 AND pred = 1) / count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE y = 0 AND pred = 0) / count(*) FILTER (WHERE y = 0)) / 2 AS auc FROM b""", ["precision", "recall", "auc"]))
def persistence_baseline_metrics(spark, d):
    s = persistence_baseline(scored_hours(spark, d))
    return M.binary_metrics(s, "pred", "label", "pred").select("precision", "recall", "auc")
