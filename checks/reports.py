"""Composite jobs, and scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import GRID, SCORED_EVENTS, SCORED_HOURS, TYPED, Catalog, final, grid, scored_events, scored_hours, table, typed
from checks.grids import ALL, DIM, feature_dim
from checks.learning import FEATURES, feature_rows, loadings
from checks.samples import catalog as samples
from checks.scores import CURVE
from checks.series import LEADS
from checks.times import WIDE, transports
from gridsignal.operators import labels
from gridsignal.operators.grid import block_table
from gridsignal.plans import jobs
from gridsignal.session import settle, shared_path
from gridsignal.sources import tables

catalog = Catalog()
add = catalog.add

INDEX_WEAK = 250000.0  # about the mean order price


def order_index(spark, d):
    """Daily index: mean order price."""
    o = table(spark, d, "orders").select("o_orderdate", "o_totalprice")
    return o.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.avg("o_totalprice").alias("value"))


def raw_field(spark, d):
    return grid(spark, d).select("ts", "cell_id", "var", "value")


def prepared(spark, d, threshold=INDEX_WEAK):
    return jobs.build_features(raw_field(spark, d), settle(order_index(spark, d)), threshold)


PREPARED = f"""{GRID}, ok AS ({ALL}), steps AS (SELECT DISTINCT ts FROM grid),
idx AS (SELECT date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1),
pick AS (SELECT s.ts, p.ts AS pt, p.value AS pv, n.ts AS nt, n.value AS nv FROM steps s ASOF LEFT JOIN idx p ON s.ts >= p.ts ASOF LEFT JOIN idx n ON s.ts <= n.ts),
near AS (SELECT ts, CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt - ts <= ts - pt THEN nv ELSE pv END AS value FROM pick),
sm AS (SELECT ts, avg(value) OVER (ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM near),
lab AS (SELECT ts, CASE WHEN sum(CASE WHEN m < {INDEX_WEAK} THEN 1 ELSE 0 END) OVER (ORDER BY ts ROWS 2 PRECEDING) >= 3 THEN 1 ELSE 0 END AS label FROM sm),
ro AS (SELECT ts, sum(value) / 1e6 AS total FROM grid WHERE var = 'runoff' GROUP BY ts),
ss AS (SELECT ts, avg(value) AS mean FROM grid WHERE var = 'sst' AND cell_id IN (FROM ok) GROUP BY ts),
one AS (SELECT ts, total AS a, lag(total) OVER (ORDER BY ts) AS b, lag(total, 2) OVER (ORDER BY ts) AS c, total * mean AS e FROM ro JOIN ss USING (ts)),
tm AS (SELECT one.*, label, row_number() OVER (ORDER BY ts) - 1 AS pos FROM one JOIN lab USING (ts) WHERE b IS NOT NULL AND c IS NOT NULL),
feats AS (SELECT var AS block, CASE var WHEN 'sst' THEN 0 WHEN 'sss' THEN 1 ELSE 2 END * {jobs.BLOCK_SPAN} + cell_id AS feature_id, cell_id, pos, value FROM grid JOIN tm USING (ts)
 WHERE var <> 'runoff' AND cell_id IN (FROM ok)
 UNION ALL SELECT 'runoff', 3 * {jobs.BLOCK_SPAN} + i, NULL, pos, CASE i WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE e END FROM tm, range(4) t(i))"""


@add("prepared_features", final(PREPARED, "SELECT CAST(feature_id AS BIGINT) AS feature_id, block, cell_id, pos, value FROM feats", ["value"]))
def prepared_features(spark, d):
    from gridsignal.operators.features import unpack

    return unpack(prepared(spark, d).features, ("feature_id", "block", "cell_id"))


@add("prepared_labels", final(PREPARED, "SELECT pos, ts, label FROM tm", [], ["ts"]))
def prepared_labels(spark, d):
    return prepared(spark, d).times


@add("reduced_components")
def reduced_components(spark, d):
    p = prepared(spark, d)
    return jobs.reduce_features(p.features, jobs.split_times(p)).rows.select("row_id", "ts", "y", "split", F.size("features").alias("components"))


@add("train_and_evaluate")
def train_and_evaluate(spark, d):
    p = prepared(spark, d)
    trained = jobs.train_evaluate(jobs.reduce_features(p.features, jobs.split_times(p)))
    return trained.metrics


@add("threshold_sensitivity")
def threshold_sensitivity(spark, d):
    return jobs.threshold_sweep(raw_field(spark, d), settle(order_index(spark, d)), labels.sweep_thresholds(INDEX_WEAK))


@add("robustness_bootstrap_and_cv")
def robustness(spark, d):
    p = prepared(spark, d)
    tables_ = jobs.robustness_tables(jobs.reduce_features(p.features, jobs.split_times(p)), p, range(4))
    cells = [
        tables_["time_cv"].select(F.lit("time_cv").alias("table"), F.col("fold").cast("string").alias("key"), "auc", "f1"),
        tables_["baselines"].select(F.lit("baselines").alias("table"), F.col("model").alias("key"), "auc", "f1"),
        tables_["rebalancing"].select(F.lit("rebalancing").alias("table"), F.col("strategy").alias("key"), "auc", "f1"),
        tables_["ablation"].select(F.lit("ablation").alias("table"), F.col("removed").alias("key"), "auc", "f1"),
    ]
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    return out


VIEWS = f"{TYPED.replace('typed AS', 'typed_ AS')}, ref AS (SELECT ts, CASE WHEN value > -9999 THEN value END AS value FROM typed_ WHERE series_id = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25')"


def view_index(spark, d):
    """Reference index that covers a part of the period only."""
    v = typed(spark, d).where("series_id = 'view' AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-25'")
    return settle(v.select("ts", "value"))


def lead_report(spark, d, index=False):
    return jobs.lead_time_report(scored_hours(spark, d), view_index(spark, d) if index else None)


@add("lead_time_summary", final(LEADS, """SELECT count(*) AS n, quantile_cont(lead, 0.25) AS q1, quantile_cont(lead, 0.5) AS median,
 quantile_cont(lead, 0.75) AS q3, count(*) > 0 AS found FROM ok""", ["q1", "median", "q3"]))
def lead_time_summary(spark, d):
    return lead_report(spark, d)["summary"]


@add("lead_time_overlay", final(f"{SCORED_HOURS}, {VIEWS}, pick AS (SELECT m.ts, m.p, p.ts AS pt, p.value AS pv, n.ts AS nt, n.value AS nv FROM prob m ASOF LEFT JOIN ref p ON m.ts >= p.ts ASOF LEFT JOIN ref n ON m.ts <= n.ts),"
 " near AS (SELECT ts, p, CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt - ts <= ts - pt THEN nv ELSE pv END AS v FROM pick)",
 "SELECT ts, p, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS index_scaled FROM near", ["p", "index_scaled"], ["ts"]))
def lead_time_overlay(spark, d):
    return lead_report(spark, d, True)["overlay"].select("ts", "p", "index_scaled")


@add("post_model_confusion", final(SCORED_EVENTS, "SELECT y, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1 FROM scored GROUP BY y"))
def post_model_confusion(spark, d):
    return jobs.post_model_report(scored_events(spark, d))["confusion"]


@add("post_model_ranking", final(f"{SCORED_EVENTS}, day AS (SELECT *, 0 AS fold FROM scored), {CURVE}", """SELECT CAST(max(np) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives,
 sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)) AS auc, sum(pos * tp / (tp + fp)) / max(np) AS ap FROM c""", ["auc", "ap"]))
def post_model_ranking(spark, d):
    return jobs.post_model_report(scored_events(spark, d))["ranking"]


@add("post_model_crossings", final(SCORED_EVENTS, """SELECT row_id, ts, y, p, pred, pos FROM (SELECT *, row_number() OVER w - 1 AS pos, lag(p) OVER w AS l FROM scored
 WINDOW w AS (ORDER BY ts, row_id)) WHERE p > 0.5 AND l <= 0.5""", ["p"], ["ts"]))
def post_model_crossings(spark, d):
    return jobs.post_model_report(scored_events(spark, d))["crossings"].select("row_id", "ts", "y", "p", "pred", "pos")


def significance(spark, d):
    s = scored_hours(spark, d).select(F.col("pos").alias("row_id"), "ts", F.col("label").alias("y"), "p")
    return jobs.significance_tables(settle(order_index(spark, d)), s, [200000.0, INDEX_WEAK, 300000.0])


@add("significance_class_balance", final("idx AS (SELECT date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1)",
 """SELECT threshold, count(*) FILTER (WHERE value < threshold) AS weak_n, count(*) FILTER (WHERE value >= threshold) AS strong_n,
 100.0 * count(*) FILTER (WHERE value < threshold) / count(*) AS weak_pct FROM idx, (VALUES (200000.0), (250000.0), (300000.0)) v(threshold) GROUP BY ALL""", ["threshold", "weak_pct"]))
def significance_class_balance(spark, d):
    return significance(spark, d)["class_balance"]


@add("significance_permutation", samples.sql["permutation_test"])
def significance_permutation(spark, d):
    return significance(spark, d)["permutation"]


@add("significance_false_alarms", final(f"{SCORED_HOURS}, a AS (SELECT *, coalesce(lead(CAST(p > 0.5 AS INTEGER), 36) OVER (ORDER BY pos), 0) AS alarm FROM prob)",
 """SELECT count(*) FILTER (WHERE label = 1 AND alarm = 1) AS true_events, count(*) FILTER (WHERE label = 0 AND alarm = 1) AS false_alarms,
 round(count(*) FILTER (WHERE label = 0 AND alarm = 1) / (count(*) / 12.0 / 10.0), 2) AS false_alarms_per_decade FROM a""", ["false_alarms_per_decade"]))
def significance_false_alarms(spark, d):
    return significance(spark, d)["false_alarms"]


TRANSPORT = f"""{WIDE}, long AS (UNPIVOT wide ON gs, moc, ek, umo INTO NAME "column" VALUE value),
allrows AS (SELECT w.ts, c AS "column", l.value FROM wide w CROSS JOIN (VALUES ('gs'), ('moc'), ('ek'), ('umo')) v(c) LEFT JOIN long l ON l.ts = w.ts AND l."column" = c),
fill AS (SELECT *, coalesce(value, avg(value) OVER (PARTITION BY "column")) AS f FROM allrows)"""


@add("transports_daily", final(TRANSPORT, """SELECT "column", ts, value, sum(f) OVER (PARTITION BY "column" ORDER BY ts ROWS BETWEEN 45 PRECEDING AND 44 FOLLOWING) / 90.0 AS running FROM fill""", ["value", "running"], ["ts"]))
def transports_daily(spark, d):
    return jobs.transport_series(transports(spark, d), ["gs", "moc", "ek", "umo"])["daily"].drop("series_id")


@add("transports_monthly", final(WIDE, """SELECT series_id, CAST(last_day(date_trunc('month', ts)) AS TIMESTAMP) AS ts, avg(gs) AS gs, avg(moc) AS moc, avg(ek) AS ek, avg(umo) AS umo FROM wide GROUP BY 1, 2""",
 ["gs", "moc", "ek", "umo"], ["ts"]))
def transports_monthly(spark, d):
    return jobs.transport_series(transports(spark, d), ["gs", "moc", "ek", "umo"])["monthly"]


@add("contribution_maps", final(f"{FEATURES}, allcells AS (SELECT DISTINCT cell_id FROM grid)", """SELECT a.cell_id, b.block, c AS value FROM allcells a CROSS JOIN (VALUES ('sst'), ('sss'), ('ssh')) b(block)
 LEFT JOIN (SELECT block, cell_id, avg(abs(w)) AS c FROM w GROUP BY ALL) x ON a.cell_id = x.cell_id AND b.block = x.block""", ["value"]))
def contribution_maps(spark, d):
    f, times = feature_rows(spark, d)
    held = jobs.Prepared(f, times, f.select("cell_id").distinct(), times)
    return jobs.contribution_maps(held, loadings(f), grid(spark, d).select("cell_id").distinct())


# ---- scans and sinks -----------------------------------------------------------------------------------------------


@add("grid_round_trip", final(GRID, "SELECT ts, cell_id, var, value FROM grid WHERE var IN ('sst', 'ssh')", ["value"], ["ts"]))
def grid_round_trip(spark, d):
    path = shared_path(spark, "grid")
    tables.write_grid(grid(spark, d), path)
    return tables.read_grid(spark, path, ["sst", "ssh"], ["ts", "cell_id", "var", "value"])


@add("series_scan", final("", "SELECT event_type AS series_id, ts, value FROM events", ["value"], ["ts"]))
def series_scan(spark, d):
    return tables.read_series(spark, f"{d}/events.parquet", series_id="event_type")


SWEEP_SQL = "t AS (SELECT l_quantity AS threshold, avg(l_discount) AS accuracy, avg(l_tax) AS precision, min(l_discount) AS recall, max(l_tax) AS f1_score FROM lineitem GROUP BY 1)"


@add("metrics_csv_round_trip", final(SWEEP_SQL, "SELECT * FROM t", ["threshold", "accuracy", "precision", "recall", "f1_score"]))
def metrics_csv_round_trip(spark, d):
    path = shared_path(spark, "csv")
    t = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("threshold")).agg(
        F.avg("l_discount").alias("accuracy"), F.avg("l_tax").alias("precision"), F.min("l_discount").alias("recall"), F.max("l_tax").alias("f1_score"))
    tables.write_table_csv(t, path)
    return tables.read_metrics_csv(spark, path)


@add("block_json_round_trip", final(DIM, "SELECT block, count(*) AS size FROM dim GROUP BY block"))
def block_json_round_trip(spark, d):
    path = shared_path(spark, "blocks")
    tables.write_blocks(block_table(settle(feature_dim(spark, d))), path)
    return tables.read_blocks(spark, path)


@add("bundle_round_trip", final("", "SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey", ["o_totalprice", "l_quantity"]))
def bundle_round_trip(spark, d):
    path = shared_path(spark, "bundle")
    tables.save_bundle(path, o=table(spark, d, "orders").select("o_orderkey", "o_totalprice"),
                       l=table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    b = tables.load_bundle(spark, path, ["o", "l"])
    return b["o"].join(b["l"], F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@add("batches_round_trip", final("", "SELECT o_orderkey AS row_id, o_totalprice AS x, CASE WHEN o_orderkey % 10 < 3 THEN 'test' ELSE 'train' END AS split FROM orders", ["x"]))
def batches_round_trip(spark, d):
    path = shared_path(spark, "batches")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("x"),
        F.when(F.col("o_orderkey") % 10 < 3, "test").otherwise("train").alias("split"))
    tables.write_batches(rows, path, rows=10_000)
    parts = [tables.read_batches(spark, path, s).select("row_id", "x", F.lit(s).alias("split")) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@add("report_round_trip", final(LEADS, "SELECT unnest(['median: ' || printf('%.1f', quantile_cont(lead, 0.5)), 'interquartile range: ' || printf('%.1f', quantile_cont(lead, 0.25)) || ' to ' || printf('%.1f', quantile_cont(lead, 0.75)), 'peaks: ' || count(*)]) AS value FROM ok"))
def report_round_trip(spark, d):
    path = shared_path(spark, "report")
    tables.write_text(tables.report_lines(lead_report(spark, d)["summary"]), path)
    return spark.read.text(path)
