"""Missing values and keys: NaN where a value is below a bound, NULL keys and stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import HOURLY, TYPED, WEAK, Catalog, final, grid, GRID, GRID_VARS, hourly, sql_positions, sql_weak, table, typed
from gridsignal.operators import grid as G
from gridsignal.operators import labels, peaks, stats, timeops, windows
from gridsignal.operators.asof import asof_nearest
from gridsignal.operators.ordering import with_position
from gridsignal.session import settle

catalog = Catalog()
add = catalog.add

BOUND = 48.5
NAN = float("nan")
GAPPED = f"{HOURLY}, gapped AS (SELECT series_id, ts, CASE WHEN value >= {BOUND} THEN value END AS value FROM hourly), {sql_positions('gapped')}"


def gapped(spark, d):
    """Hourly series with NaN for values under ``BOUND``."""
    return with_position(hourly(spark, d).withColumn("value", F.when(F.col("value") < BOUND, NAN).otherwise(F.col("value"))))


@add("rolling_mean_with_nan", final(GAPPED, """SELECT series_id, ts, avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smoothed FROM s""", ["smoothed"], ["ts"]))
def rolling_mean(spark, d):
    return windows.rolling_mean(gapped(spark, d), "value", 5).select("series_id", "ts", "smoothed")


@add("weak_labels_with_nan", final(f"{GAPPED}, {sql_weak('s', threshold=WEAK + 2)}", "SELECT series_id, ts, label FROM weak", [], ["ts"]))
def weak_labels(spark, d):
    return labels.weak_labels(gapped(spark, d), threshold=WEAK + 2).select("series_id", "ts", "label")


@add("class_balance_with_nan", final(GAPPED, """SELECT threshold, count(*) FILTER (WHERE value < threshold) AS weak_n, count(*) FILTER (WHERE value >= threshold) AS strong_n,
 100.0 * count(*) FILTER (WHERE value < threshold) / count(*) AS weak_pct FROM s, (VALUES (49.0), (50.0), (52.0)) v(threshold) GROUP BY ALL""", ["threshold", "weak_pct"]))
def class_balance(spark, d):
    return labels.class_balance(gapped(spark, d), [49.0, 50.0, 52.0])


@add("best_threshold_with_nan", final("f AS (SELECT CAST(l_linenumber AS DOUBLE) AS threshold, avg(l_discount) AS f1_score FROM lineitem GROUP BY 1)",
 "SELECT threshold, f1_score FROM f WHERE threshold NOT IN (2, 4) ORDER BY f1_score DESC, threshold LIMIT 1", ["threshold", "f1_score"]))
def best_threshold(spark, d):
    means = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("threshold")).agg(F.avg("l_discount").alias("f1_score"))
    return stats.best_threshold(means.withColumn("f1_score", F.when(F.col("threshold").isin(2, 4), NAN).otherwise(F.col("f1_score"))))


@add("find_peaks_with_nan", final(f"""{GAPPED}, runs AS (SELECT *, value IS DISTINCT FROM lag(value) OVER (PARTITION BY series_id ORDER BY pos) OR pos = 0 AS opens FROM s),
 numbered AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM runs),
 folded AS (SELECT series_id, run, min(pos) AS a, max(pos) AS b, any_value(value) AS value FROM numbered GROUP BY series_id, run),
 near AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM folded WINDOW w AS (PARTITION BY series_id ORDER BY run))""",
 "SELECT series_id, CAST((a + b) // 2 AS BIGINT) AS pos, value FROM near WHERE value > l AND value > r", ["value"]))
def find_peaks(spark, d):
    return peaks.find_peaks(gapped(spark, d), "value", None)


HOLES = f"{GRID}, holes AS (SELECT ts, cell_id, var, CASE WHEN value >= 14 OR var <> 'sst' THEN value END AS value FROM grid)"


def holes(spark, d):
    """Grid with NaN where one of its variables is low."""
    low = (F.col("var") == "sst") & (F.col("value") < 14)
    return settle(grid(spark, d)).withColumn("value", F.when(low, NAN).otherwise(F.col("value")))


@add("valid_cells_with_nan", final(HOLES, f"""SELECT cell_id FROM holes WHERE var IN {GRID_VARS} GROUP BY cell_id
 HAVING count(value) = {len(GRID_VARS)} * (SELECT count(DISTINCT ts) FROM holes)"""))
def valid_cells(spark, d):
    return G.valid_cells(holes(spark, d), GRID_VARS)


@add("spatial_sum_with_nan", final(HOLES, "SELECT ts, var, coalesce(sum(value), 0.0) AS total FROM holes GROUP BY ALL", ["total"], ["ts"]))
def spatial_sum(spark, d):
    return G.spatial_sum(holes(spark, d), ("ts", "var"), 1.0)


@add("spatial_mean_with_nan", final(HOLES, "SELECT ts, var, avg(value) AS mean FROM holes GROUP BY ALL", ["mean"], ["ts"]))
def spatial_mean(spark, d):
    return G.spatial_mean(holes(spark, d), ("ts", "var"))


KEYLESS = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS k, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate END AS ts FROM orders)"""


def keyless(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("k"), F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate")).alias("ts"))


@add("positions_with_missing_keys", final(KEYLESS, "SELECT o_orderkey, row_number() OVER (PARTITION BY k ORDER BY ts NULLS FIRST, o_orderkey) - 1 AS pos FROM o"))
def positions(spark, d):
    return with_position(keyless(spark, d), ["k"], ["ts", "o_orderkey"]).select("o_orderkey", "pos")


@add("asof_with_missing_keys", final("""r AS (SELECT CASE WHEN event_type <> 'view' THEN event_type ELSE '' END AS k, date_trunc('day', ts) AS ts, avg(value) AS mean FROM events GROUP BY ALL),
 l AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type ELSE '' END AS k, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts FROM events),
 p AS (SELECT l.*, a.ts AS pt, a.mean AS pm, b.ts AS nt, b.mean AS nm FROM l ASOF LEFT JOIN r a ON l.k = a.k AND l.ts >= a.ts ASOF LEFT JOIN r b ON l.k = b.k AND l.ts <= b.ts)""",
 "SELECT event_id, CASE WHEN pt IS NULL THEN nm WHEN nt IS NULL THEN pm WHEN nt - ts <= ts - pt THEN nm ELSE pm END AS mean FROM p", ["mean"]))
def asof(spark, d):
    e = table(spark, d, "events").withColumn("k", F.when(F.col("event_type") != "view", F.col("event_type")))
    right = e.groupBy("k", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("mean"))
    left = e.select("event_id", "k", F.when(F.col("event_id") % 50 != 0, F.col("ts")).cast("timestamp_ntz").alias("ts"))
    return asof_nearest(left, settle(right), ["mean"], by=["k"]).select("event_id", "mean")


@add("minmax_with_missing_series", final(TYPED, """SELECT CASE WHEN series_id <> 'view' THEN series_id END AS series_id, ts, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS value
 FROM typed WINDOW w AS (PARTITION BY series_id)""", ["value"], ["ts"]))
def minmax_scale(spark, d):
    rows = typed(spark, d).withColumn("series_id", F.when(F.col("series_id") != "view", F.col("series_id")))
    return timeops.minmax_scale(settle(rows), "value")
