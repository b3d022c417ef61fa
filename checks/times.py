"""Time axes, cleaning, alignment and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import HOURLY, SCORED_HOURS, TYPED, Catalog, final, hourly, scored_hours, sql_positions, table, typed
from gridsignal.functions import columns as C
from gridsignal.operators import stats, timeops
from gridsignal.operators.asof import asof_nearest
from gridsignal.operators.features import complete_rows, first_rows
from gridsignal.operators.ordering import with_position
from gridsignal.operators.windows import lag_features
from gridsignal.session import settle

catalog = Catalog()
add = catalog.add


@add("convert_units", final("", "SELECT event_id, value - 273.15 AS celsius, value / 1e6 AS mega FROM events", ["celsius", "mega"]))
def convert_units(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", C.convert_units(F.col("value"), 1.0, C.KELVIN_OFFSET).alias("celsius"),
                    C.convert_units(F.col("value"), C.MEGA).alias("mega"))


@add("sentinel_to_missing", final("", """SELECT event_type, count(CASE WHEN value > 10.0 THEN value END) AS kept, count(*) AS n,
 avg(CASE WHEN value > 10.0 THEN value END) AS mean FROM events GROUP BY event_type""", ["mean"]))
def sentinel_to_missing(spark, d):
    e = table(spark, d, "events").withColumn("clean", C.above_floor(F.col("value"), 10.0))
    return e.groupBy("event_type").agg(F.count("clean").alias("kept"), F.count(F.lit(1)).alias("n"), F.avg("clean").alias("mean"))


@add("decode_numeric_time", final("", """SELECT event_id,
 make_timestamp(CAST(epoch_us(TIMESTAMP '2000-01-01 00:00:00') + event_id * 3600000000 + 1800000000 AS BIGINT)) AS from_hours,
 CASE WHEN event_type <> 'click' THEN make_timestamp(CAST(event_id AS BIGINT) * 1000000) END AS from_seconds,
 make_timestamp(epoch_us(TIMESTAMP '1950-01-01 00:00:00') + CAST(event_id * 86400000000 AS BIGINT)) AS from_days FROM events""",
    [], ["from_hours", "from_seconds", "from_days"]))
def decode_numeric_time(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id").cast("double")
    return e.select(
        "event_id",
        C.decode_cf_time(n + 0.5, "hours", "2000-01-01").alias("from_hours"),
        C.decode_cf_time(F.when(F.col("event_type") == "click", F.lit(1e30)).otherwise(n)).alias("from_seconds"),
        C.decode_cf_time(n, "days", "1950-01-01").alias("from_days"),
    )


@add("month_axis_by_position", final(f"{HOURLY}, {sql_positions('hourly')}", """SELECT pos, value,
 TIMESTAMP '1993-02-01' + to_months(CAST(pos AS INTEGER)) AS ts FROM s""", ["value"], ["ts"]))
def month_axis_by_position(spark, d):
    s = with_position(hourly(spark, d))
    return timeops.relabel_months(s, "1993-02-01").select("pos", "value", "ts")


@add("normalize_to_day", final("", "SELECT event_id, date_trunc('day', ts) AS day FROM events", [], ["day"]))
def normalize_to_day(spark, d):
    return table(spark, d, "events").select("event_id", C.normalize_day(F.col("ts")).alias("day"))


@add("dedup_first", final("", """SELECT o_custkey, month, o_orderkey, o_totalprice FROM (SELECT *, date_trunc('month', o_orderdate) AS month,
 row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""", ["o_totalprice"], ["month"]))
def dedup_first(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), "o_orderkey", "o_totalprice")
    return timeops.dedup_first(o, ["o_custkey", "month"], "o_orderkey")


DAYS = """o AS (SELECT date_trunc('day', o_orderdate) AS ts, count(*) AS orders FROM orders GROUP BY 1),
l AS (SELECT date_trunc('day', l_shipdate) AS ts, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
m AS (SELECT date_trunc('day', o_orderdate) + INTERVAL 60 DAYS AS ts, avg(o_totalprice) AS price FROM orders GROUP BY 1)"""


def _days(spark, d):
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz").alias("ts")
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    return [
        orders.groupBy(day("o_orderdate")).agg(F.count(F.lit(1)).alias("orders")),
        items.groupBy(day("l_shipdate")).agg(F.sum("l_quantity").alias("quantity")),
        orders.groupBy(day(F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))).agg(F.avg("o_totalprice").alias("price")),
    ]


@add("align_time", final(DAYS, "SELECT ts, orders, quantity, price FROM o JOIN l USING (ts) JOIN m USING (ts)", ["quantity", "price"], ["ts"]))
def align_time(spark, d):
    a, b, c = timeops.align_time(_days(spark, d))
    return a.join(b, "ts").join(c, "ts").select("ts", "orders", "quantity", "price")


@add("common_times", final(DAYS, "SELECT ts FROM o INTERSECT SELECT ts FROM l INTERSECT SELECT ts FROM m", [], ["ts"]))
def common_times(spark, d):
    return timeops.common_times(_days(spark, d))


MONTHS = """mon AS (SELECT date_trunc('month', l_shipdate) AS ts, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1),
days AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS ts FROM orders)"""


def _months(spark, d):
    return table(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.avg("l_quantity").alias("quantity"))


def _order_days(spark, d):
    return table(spark, d, "orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).distinct()


NEAREST = """pick AS (SELECT days.ts, p.ts AS pt, p.quantity AS pq, n.ts AS nt, n.quantity AS nq FROM days
 ASOF LEFT JOIN mon p ON days.ts >= p.ts ASOF LEFT JOIN mon n ON days.ts <= n.ts),
near AS (SELECT ts, CASE WHEN pt IS NULL THEN nq WHEN nt IS NULL THEN pq WHEN nt - ts <= ts - pt THEN nq ELSE pq END AS quantity,
 CASE WHEN pt IS NULL THEN nt - ts WHEN nt IS NULL THEN ts - pt WHEN nt - ts <= ts - pt THEN nt - ts ELSE ts - pt END AS gap FROM pick)"""


@add("asof_nearest", final(f"{MONTHS}, {NEAREST}", "SELECT ts, quantity FROM near", ["quantity"], ["ts"]))
def asof(spark, d):
    return asof_nearest(_order_days(spark, d), settle(_months(spark, d)), ["quantity"], grain="year")


@add("asof_nearest_tolerance", final(f"{MONTHS}, {NEAREST}", "SELECT ts, CASE WHEN gap <= INTERVAL 10 DAYS THEN quantity END AS quantity FROM near", ["quantity"], ["ts"]))
def asof_tolerance(spark, d):
    return asof_nearest(_order_days(spark, d), settle(_months(spark, d)), ["quantity"], tolerance=10 * 86400)


@add("asof_nearest_by_key", final("""r AS (SELECT event_type AS k, date_trunc('day', ts) AS ts, avg(value) AS mean FROM events GROUP BY ALL),
 l AS (SELECT event_id, event_type AS k, ts FROM events),
 p AS (SELECT l.*, a.ts AS pt, a.mean AS pm, b.ts AS nt, b.mean AS nm FROM l ASOF LEFT JOIN r a ON l.k = a.k AND l.ts >= a.ts ASOF LEFT JOIN r b ON l.k = b.k AND l.ts <= b.ts)""",
 "SELECT event_id, CASE WHEN pt IS NULL THEN nm WHEN nt IS NULL THEN pm WHEN nt - ts <= ts - pt THEN nm ELSE pm END AS mean FROM p", ["mean"]))
def asof_by_key(spark, d):
    e = table(spark, d, "events")
    right = e.groupBy(F.col("event_type").alias("k"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("mean"))
    left = e.select("event_id", F.col("event_type").alias("k"), "ts")
    return asof_nearest(left, settle(right), ["mean"], by=["k"]).select("event_id", "mean")


@add("clip_to_overlap", final("""ref AS (SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-09-01'),
 k AS (SELECT o.*, o_orderdate BETWEEN lo - INTERVAL 31 DAYS AND hi + INTERVAL 31 DAYS AS inside FROM orders o, ref)""",
 "SELECT o_orderkey, o_orderdate AS ts FROM k WHERE inside OR NOT (SELECT coalesce(bool_or(inside), false) FROM k)", [], ["ts"]))
def clip_to_overlap(spark, d):
    ref = table(spark, d, "lineitem").where(
        "l_shipdate > TIMESTAMP_NTZ '1996-03-01' AND l_shipdate < TIMESTAMP_NTZ '1996-09-01'"
    ).select(F.col("l_shipdate").alias("ts"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return timeops.clip_to_overlap(o, ref)


@add("clip_to_overlap_without_overlap", final("", "SELECT o_orderkey FROM orders"))
def clip_without_overlap(spark, d):
    ref = table(spark, d, "events").select("ts")
    return timeops.clip_to_overlap(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts")), ref).select("o_orderkey")


@add("clip_period", final("", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'"))
def clip_period(spark, d):
    return timeops.clip_period(table(spark, d, "orders"), "1994-01-01 00:00:00", "1996-12-31 00:00:00", "o_orderdate").select("o_orderkey")


@add("drop_leading", final(f"{TYPED}, {sql_positions('typed')}", "SELECT series_id, ts FROM s WHERE pos >= 7", [], ["ts"]))
def drop_leading(spark, d):
    return timeops.drop_leading(with_position(typed(spark, d)), 7).select("series_id", "ts")


@add("squeeze_dimension", final("", "SELECT event_id, value FROM events", ["value"]))
def squeeze_dimension(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.lit(0.5).alias("depth"))
    return timeops.squeeze_dim(e, "depth")


@add("resample_month_mean", final("""m AS (SELECT p_brand_like AS series_id, date_trunc('month', l_shipdate) AS u, avg(CASE WHEN l_discount > 0.02 THEN l_quantity END) AS quantity
 FROM (SELECT *, CAST(l_partkey % 40 AS VARCHAR) || l_returnflag AS p_brand_like FROM lineitem) GROUP BY ALL),
 e AS (SELECT series_id, unnest(generate_series(min(u), max(u), INTERVAL 1 MONTH)) AS u FROM m GROUP BY series_id)""",
 "SELECT e.series_id, CAST(last_day(e.u) AS TIMESTAMP) AS ts, quantity FROM e LEFT JOIN m ON e.series_id = m.series_id AND e.u = m.u", ["quantity"], ["ts"]))
def resample_month_mean(spark, d):
    s = table(spark, d, "lineitem").select(
        F.concat((F.col("l_partkey") % 40).cast("string"), "l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("quantity"))
    return timeops.resample_mean(s, ["quantity"])


@add("minmax_scale", final(TYPED, "SELECT series_id, ts, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS value FROM typed WINDOW w AS (PARTITION BY series_id)", ["value"], ["ts"]))
def minmax_scale(spark, d):
    return timeops.minmax_scale(settle(typed(spark, d)), "value")


WIDE = """wide AS (SELECT 'all' AS series_id, date_trunc('hour', ts) AS ts, avg(value) FILTER (WHERE event_type = 'click') AS gs,
 avg(value) FILTER (WHERE event_type = 'view') AS moc, avg(value) FILTER (WHERE event_type = 'purchase') AS ek,
 avg(value) FILTER (WHERE event_type = 'signup') AS umo FROM events GROUP BY 2)"""


def transports(spark, d):
    """Four parallel series with missing hours."""
    e = table(spark, d, "events").select("ts", "event_type", "value")
    pick = lambda t, n: F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(n)
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        pick("click", "gs"), pick("view", "moc"), pick("purchase", "ek"), pick("signup", "umo")
    ).withColumn("series_id", F.lit("all"))


@add("impute_mean", final(WIDE, "SELECT ts, coalesce(gs, avg(gs) OVER ()) AS gs FROM wide", ["gs"], ["ts"]))
def impute_mean(spark, d):
    return timeops.impute_mean(settle(transports(spark, d)), "gs").select("ts", "gs")


@add("probability_cut", final(SCORED_HOURS, "SELECT ts, CAST(p > 0.5 AS INTEGER) AS pred FROM prob", [], ["ts"]))
def probability_cut(spark, d):
    return scored_hours(spark, d).select("ts", C.above(F.col("p")).alias("pred"))


@add("half_even_rounding", final("", """SELECT event_id, (u // 10 + CASE WHEN u % 10 > 5 OR (u % 10 = 5 AND (u // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS rounded
 FROM (SELECT event_id, event_id * 125 AS u FROM events)""", ["rounded"]))
def half_even_rounding(spark, d):
    return table(spark, d, "events").select("event_id", C.round_half_even(F.col("event_id") * 0.125, 2).alias("rounded"))


@add("cast_and_sort_thresholds", final("", "SELECT CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS threshold, count(*) AS n FROM lineitem GROUP BY 1", ["threshold"]))
def cast_and_sort_thresholds(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_quantity").cast("string").alias("threshold"))
    return t.groupBy(F.col("threshold").cast("double").alias("threshold")).agg(F.count(F.lit(1)).alias("n")).orderBy("threshold")


@add("threshold_names", final("", "SELECT DISTINCT l_quantity * 0.9 AS threshold, printf('%.1f', l_quantity * 0.9) AS name, 'PC' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS component FROM lineitem", ["threshold"]))
def threshold_names(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select((q * 0.9).alias("threshold"), C.threshold_name(q * 0.9).alias("name"),
        C.component_name(q.cast("int") - 1).alias("component")).distinct()


@add("series_extent", final(TYPED, "SELECT series_id, min(ts) AS min_ts, max(ts) AS max_ts, min(value) AS min_value, max(value) AS max_value FROM typed GROUP BY 1", ["min_value", "max_value"], ["min_ts", "max_ts"]))
def series_extent(spark, d):
    return timeops.extent(typed(spark, d), ["ts", "value"], ["series_id"])


@add("interaction_feature", final("""a AS (SELECT date_trunc('month', l_shipdate) AS ts, sum(l_extendedprice) / 1e6 AS total FROM lineitem GROUP BY 1),
 b AS (SELECT date_trunc('month', o_orderdate) AS ts, avg(o_totalprice) AS mean FROM orders GROUP BY 1)""", "SELECT ts, total * mean AS interaction FROM a JOIN b USING (ts)", ["interaction"], ["ts"]))
def interaction_feature(spark, d):
    m = lambda c: F.date_trunc("month", c).cast("timestamp_ntz").alias("ts")
    a = table(spark, d, "lineitem").groupBy(m("l_shipdate")).agg(C.convert_units(F.sum("l_extendedprice"), C.MEGA).alias("total"))
    b = table(spark, d, "orders").groupBy(m("o_orderdate")).agg(F.avg("o_totalprice").alias("mean"))
    return a.join(b, "ts").select("ts", C.interaction(F.col("total"), F.col("mean")).alias("interaction"))


@add("kernel_density", final("""e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events),
 g AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 199 AS x FROM e, range(200) t(i))""",
 "SELECT point, x, sum(exp(-((x - value) / h) * ((x - value) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM g, e, events GROUP BY point, x", ["x", "density"]))
def kernel_density(spark, d):
    return stats.kde(table(spark, d, "events"), "value")


@add("feature_index_wrap", final("", "SELECT event_id, CAST(((user_id - 40) % 30 + 30) % 30 AS BIGINT) AS wrapped FROM events"))
def feature_index_wrap(spark, d):
    return table(spark, d, "events").select("event_id", C.wrap_index(F.col("user_id") - 40, 30).alias("wrapped"))


@add("fit_importance_length", final("", "SELECT vec_id, list_sum(CAST(embedding[1:50] AS DOUBLE[])) AS cut, CAST(80 AS INTEGER) AS filled, list_sum(CAST(embedding AS DOUBLE[])) AS whole FROM embeddings", ["cut", "whole"]))
def fit_importance_length(spark, d):
    x = F.col("embedding").cast("array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return table(spark, d, "embeddings").select("vec_id", total(C.fit_length(x, 50)).alias("cut"),
        F.size(C.fit_length(x, 80)).alias("filled"), total(C.fit_length(x, 80)).alias("whole"))


@add("complete_time_steps", final(f"{TYPED}, {sql_positions('typed')}, l AS (SELECT *, lag(value) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos))",
 "SELECT l.series_id, l.ts, l.value_lag2, CAST(l.value < 48.0 AS INTEGER) AS label FROM l WHERE value_lag1 IS NOT NULL AND value_lag2 IS NOT NULL", ["value_lag2"], ["ts"]))
def complete_time_steps(spark, d):
    s = settle(typed(spark, d))
    lagged = lag_features(with_position(s), ["value"], (1, 2))
    marked = s.select("series_id", "ts", C.threshold_label(F.col("value"), 48.0).alias("label"))
    full = complete_rows(lagged, marked, ["value_lag1", "value_lag2"], ("series_id", "ts"))
    return full.select("series_id", "ts", "value_lag2", "label")


@add("first_rows_sample", final("", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100", ["o_totalprice"]))
def first_rows_sample(spark, d):
    return first_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@add("sorted_series", final(TYPED, "SELECT series_id, ts, value FROM typed", ["value"], ["ts"]))
def sorted_series(spark, d):
    return typed(spark, d).orderBy("series_id", "ts")
