"""Series operators: positions, windows, labels, peaks, leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import (
    HOURLY,
    SCORED_HOURS,
    TYPED,
    WEAK,
    Catalog,
    final,
    hourly,
    scored_hours,
    sql_positions,
    sql_weak,
    table,
    typed,
)
from gridsignal.functions import columns as C
from gridsignal.operators import labels, peaks, stats, windows
from gridsignal.operators.ordering import with_position
from gridsignal.session import settle

catalog = Catalog()
add = catalog.add

S = f"{HOURLY}, {sql_positions('hourly')}"
T = f"{TYPED}, {sql_positions('typed')}"


def positioned(spark, d):
    return with_position(hourly(spark, d))


def positioned_typed(spark, d):
    return with_position(typed(spark, d))


@add("weak_state_summary", final(
    f"{T}, {sql_weak('s')}",
    "SELECT series_id, count(*) AS hours, CAST(sum(label) AS BIGINT) AS weak_hours, 100.0 * sum(label) / count(*) AS weak_pct, "
    "CAST(count(*) FILTER (WHERE value < 48.0) AS BIGINT) AS below, min(ts) AS first_ts, max(ts) AS last_ts FROM weak GROUP BY series_id",
    ["weak_pct"], ["first_ts", "last_ts"]))
def weak_state_summary(spark, d):
    s = labels.weak_labels(positioned_typed(spark, d), threshold=WEAK)
    return s.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("hours"),
        F.sum("label").alias("weak_hours"),
        (100.0 * F.sum("label") / F.count(F.lit(1))).alias("weak_pct"),
        F.count_if(F.col("value") < WEAK).alias("below"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@add("weak_labels", final(f"{T}, {sql_weak('s')}", "SELECT series_id, ts, pos, label FROM weak", [], ["ts"]))
def weak_labels(spark, d):
    return labels.weak_labels(positioned_typed(spark, d), threshold=WEAK).select("series_id", "ts", "pos", "label")


@add("series_positions", final(T, "SELECT series_id, ts, pos FROM s", [], ["ts"]))
def series_positions(spark, d):
    return with_position(settle(typed(spark, d)), grain="day").select("series_id", "ts", "pos")


@add("event_positions", final("", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events"))
def event_positions(spark, d):
    events = table(spark, d, "events").select("event_type", "event_id", "ts")
    return with_position(events, ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "pos")


@add("lag_features", final(T, """SELECT series_id, ts, value,
 lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos)""",
    ["value", "value_lag1", "value_lag2"], ["ts"]))
def lag_features(spark, d):
    return windows.lag_features(positioned_typed(spark, d), ["value"], (1, 2)).select(
        "series_id", "ts", "value", "value_lag1", "value_lag2")


@add("rolling_mean_centred", final(T, """SELECT series_id, ts, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS smoothed
 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""", ["smoothed"], ["ts"]))
def rolling_mean_centred(spark, d):
    return windows.rolling_mean(positioned_typed(spark, d), "value", 4, 3).select("series_id", "ts", "smoothed")


@add("rolling_mean_trailing", final(T, """SELECT series_id, ts, avg(value) OVER w AS smoothed
 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", ["smoothed"], ["ts"]))
def rolling_mean_trailing(spark, d):
    return windows.rolling_mean(positioned_typed(spark, d), "value", 5, 1, False).select("series_id", "ts", "smoothed")


@add("persistence_filter", final(T, """SELECT series_id, ts, sum(CASE WHEN value < 48 THEN 1 ELSE 0 END) OVER w >= 2 AS persistent
 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""", [], ["ts"]))
def persistence_filter(spark, d):
    s = positioned_typed(spark, d).withColumn("low", F.col("value") < WEAK)
    return windows.persistence_filter(s, "low", 2).select("series_id", "ts", "persistent")


@add("threshold_label", final(T, "SELECT series_id, ts, coalesce(CAST(value < 48.0 AS INTEGER), 0) AS label FROM s", [], ["ts"]))
def threshold_label(spark, d):
    return typed(spark, d).select("series_id", "ts", C.threshold_label(F.col("value"), WEAK).alias("label"))


@add("circular_shift", final(T, """SELECT a.series_id, a.ts, b.value AS shifted FROM s a JOIN (SELECT series_id, count(*) AS n FROM s GROUP BY 1) c
 ON a.series_id = c.series_id JOIN s b ON a.series_id = b.series_id AND b.pos = (a.pos + 3) % c.n""", ["shifted"], ["ts"]))
def circular_shift(spark, d):
    return windows.circular_shift(positioned_typed(spark, d), "value", 3).select("series_id", "ts", "shifted")


@add("padded_lead", final(T, """SELECT series_id, ts, coalesce(lead(value, 36) OVER (PARTITION BY series_id ORDER BY pos), 0) AS ahead FROM s""", ["ahead"], ["ts"]))
def padded_lead(spark, d):
    return windows.padded_lead(positioned_typed(spark, d), "value").select("series_id", "ts", "ahead")


@add("persistence_baseline", final(f"{T}, {sql_weak('s')}", """SELECT series_id, ts, label,
 coalesce(lag(label, 1) OVER (PARTITION BY series_id ORDER BY pos), 0) AS pred FROM weak""", [], ["ts"]))
def persistence_baseline(spark, d):
    s = labels.weak_labels(positioned_typed(spark, d), threshold=WEAK)
    return windows.persistence_baseline(s).select("series_id", "ts", "label", "pred")


def _running(divisor):
    return final(T, f"""SELECT series_id, ts, sum(value) OVER w / {divisor} AS running
 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 45 PRECEDING AND 44 FOLLOWING)""", ["running"], ["ts"])


@add("running_mean_zero_padded", _running("90.0"))
def running_mean_zero_padded(spark, d):
    return windows.running_mean(positioned_typed(spark, d), "value").select("series_id", "ts", "running")


@add("running_mean_shrinking", _running("count(value) OVER w"))
def running_mean_shrinking(spark, d):
    return windows.running_mean(positioned_typed(spark, d), "value", edge="shrink").select("series_id", "ts", "running")


@add("upward_crossings", final(SCORED_HOURS, """SELECT series_id, ts, p > 0.5 AND coalesce(lag(p) OVER (PARTITION BY series_id ORDER BY pos) <= 0.5, false) AS crossing FROM prob""", [], ["ts"]))
def upward_crossings(spark, d):
    return windows.upward_crossings(scored_hours(spark, d)).select("series_id", "ts", "crossing")


PEAKS = f"""{SCORED_HOURS},
runs AS (SELECT series_id, p, min(pos) AS a, max(pos) AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY series_id, p ORDER BY pos) AS g FROM prob)
 GROUP BY series_id, p, g),
near AS (SELECT *, lag(p) OVER w AS l, lead(p) OVER w AS r FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY a)),
peaks AS (SELECT series_id, CAST(floor((a + b) / 2) AS BIGINT) AS pos, p AS value FROM near WHERE p > l AND p > r AND p >= 0.5)"""

LEADS = f"""{PEAKS},
leads AS (SELECT k.series_id, k.pos, CAST(min(w.pos) - k.pos AS INTEGER) AS lead FROM peaks k
 JOIN weak w ON k.series_id = w.series_id AND w.label = 1 AND w.pos > k.pos GROUP BY k.series_id, k.pos),
ok AS (SELECT * FROM leads WHERE lead <= 12)"""


@add("find_peaks", final(PEAKS, "SELECT series_id, pos, value FROM peaks", ["value"]))
def find_peaks(spark, d):
    return peaks.find_peaks(scored_hours(spark, d))


SPACED = f"""RECURSIVE {PEAKS}, taken AS (SELECT series_id, list_sort(list(struct_pack(v := value, place := pos)), 'DESC') AS left_, NULL::STRUCT(v DOUBLE, place BIGINT) AS best FROM peaks GROUP BY series_id
 UNION ALL SELECT series_id, [x FOR x IN left_ IF abs(x.place - left_[1].place) >= 6], left_[1] FROM taken WHERE len(left_) > 0)"""


@add("find_peaks_spaced", final(SPACED, "SELECT series_id, best.place AS pos, best.v AS value FROM taken WHERE best IS NOT NULL", ["value"]))
def find_peaks_spaced(spark, d):
    return peaks.find_peaks(scored_hours(spark, d), distance=6)


@add("lead_times", final(LEADS, "SELECT series_id, pos, lead FROM ok"))
def lead_times(spark, d):
    s = scored_hours(spark, d)
    return peaks.lead_times(s, peaks.find_peaks(s))


@add("lead_time_quartiles", final(LEADS, """SELECT count(*) AS n, quantile_cont(lead, 0.25) AS q1, quantile_cont(lead, 0.5) AS median,
 quantile_cont(lead, 0.75) AS q3 FROM ok""", ["q1", "median", "q3"]))
def lead_time_quartiles(spark, d):
    s = scored_hours(spark, d)
    leads = peaks.lead_times(s, peaks.find_peaks(s))
    return stats.quantiles(leads, "lead", {"q1": 0.25, "median": 0.5, "q3": 0.75})


def _hist_sql(n):
    return final(f"{LEADS}, bins AS (SELECT CAST(i AS INTEGER) AS bin, 0.5 + i AS lower, 1.5 + i AS upper FROM range({n}) t(i))",
        f"""SELECT bin, lower, upper, count(lead) AS n FROM bins LEFT JOIN ok ON lead >= lower AND (lead < upper OR (bin = {n - 1} AND lead = upper))
 GROUP BY ALL""", ["lower", "upper"])


@add("lead_time_histogram", _hist_sql(12))
def lead_time_histogram(spark, d):
    s = scored_hours(spark, d)
    return stats.histogram(peaks.lead_times(s, peaks.find_peaks(s)), "lead")


@add("lead_time_histogram_published_edges", _hist_sql(11))
def lead_time_histogram_published_edges(spark, d):
    s = scored_hours(spark, d)
    return stats.histogram(peaks.lead_times(s, peaks.find_peaks(s)), "lead", stats.REFERENCE_LEAD_EDGES)
