"""Windows, labels, peaks and leads against plain Python."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsignal.operators import labels, peaks, stats, timeops, windows
from gridsignal.operators.ordering import hash_draw, range_chunks, running_totals, smallest_draws, with_position


def column(df, name, order=("series_id", "pos")):
    return [r[name] for r in df.orderBy(*order).collect()]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None), (a, b)
        assert x is None or x == pytest.approx(y, abs=1e-9)


def test_even_window_leans_back(series):
    s = windows.rolling_mean(series({"a": [float(i) for i in range(8)]}), "value", 4)
    sums = [1, 3, 6, 10, 14, 18, 22, 18]
    counts = [2, 3, 4, 4, 4, 4, 4, 3]
    close(column(s, "smoothed"), [a / b for a, b in zip(sums, counts)])


def test_centred_mean_skips_missing(series):
    values = [14.0, 14.0, 14.0, 16.0, None, None, None, 14.0, 14.0, 14.0]
    s = windows.rolling_mean(series({"a": values}), "value", 3)
    close(column(s, "smoothed"), [14, 14, 44 / 3, 15, 16, None, 14, 14, 14, 14])


@pytest.mark.parametrize("window,center,min_periods", [(1, True, 1), (2, True, 1), (5, True, 3), (6, False, 2), (9, True, 9)])
def test_rolling_across_blocks_equals_pandas(series, small_blocks, window, center, min_periods):
    rng = np.random.default_rng(window)
    values = {k: [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=40)] for k in ("a", "b")}
    s = windows.rolling_mean(series(values), "value", window, min_periods, center)
    expected = []
    for k in ("a", "b"):
        r = pd.Series(values[k], dtype="float64").rolling(window, min_periods=min_periods, center=center).mean()
        expected += [None if np.isnan(v) else v for v in r]
    close(column(s, "smoothed"), expected)


def test_running_mean_equals_convolution(series, small_blocks):
    x = np.random.default_rng(1).normal(size=60)
    s = windows.running_mean(series({"a": x.tolist()}), "value", 9)
    close(column(s, "running"), np.convolve(x, np.ones(9) / 9, mode="same").tolist())
    even = windows.running_mean(series({"a": x.tolist()}), "value", 10)
    close(column(even, "running"), np.convolve(x, np.ones(10) / 10, mode="same").tolist())


def test_impulse_reach_of_the_default_running_mean(series):
    x = [0.0] * 200
    x[100] = 1.0
    got = column(windows.running_mean(series({"a": x}), "value"), "running")
    assert [i for i, v in enumerate(got) if v] == list(range(56, 146))


def python_labels(values, threshold, persistence, smoothing):
    s = pd.Series(values, dtype="float64")
    smooth = s.rolling(smoothing, min_periods=1, center=True).mean() if smoothing and smoothing > 1 else s
    run, out = 0, []
    for v in smooth:
        run = run + 1 if v < threshold else 0
        out.append(0 if np.isnan(v) else int(run >= max(persistence or 1, 1)))
    return out


@pytest.mark.parametrize("persistence,smoothing", [(3, 3), (1, 1), (None, None), (4, 2), (2, 5)])
def test_weak_labels(series, small_blocks, persistence, smoothing):
    rng = np.random.default_rng(7)
    values = [None if rng.random() < 0.15 else float(v) for v in 15 + rng.normal(size=50)]
    got = labels.weak_labels(series({"a": values}), threshold=15.0, persistence=persistence, smoothing=smoothing)
    assert column(got, "label") == python_labels(values, 15.0, persistence, smoothing)


def test_first_rows_cannot_be_persistent(series):
    got = labels.weak_labels(series({"a": [1.0] * 5}), threshold=2.0, smoothing=1)
    assert column(got, "label") == [0, 0, 1, 1, 1]


def test_lags_leads_and_baseline(series, small_blocks):
    x = [float(i) for i in range(20)]
    s = windows.lag_features(series({"a": x, "b": x}), ["value"], (1, 9))
    assert column(s.where("series_id = 'b'"), "value_lag9") == [None] * 9 + x[:11]
    assert column(windows.padded_lead(series({"a": x}), "value", 15), "ahead") == x[15:] + [0.0] * 15
    base = windows.persistence_baseline(series({"a": x}), "value")
    assert column(base, "pred") == [0.0] + x[:-1]


def test_circular_shift_wraps(series):
    x = [1.0, 2.0, 3.0, 4.0, 5.0]
    assert column(windows.circular_shift(series({"a": x}), "value", 2), "shifted") == np.roll(x, -2).tolist()
    assert column(windows.circular_shift(series({"a": x}), "value", 12), "shifted") == np.roll(x, -12).tolist()


def test_crossings_need_a_rise_through_the_threshold(series, small_blocks):
    x = [0.9, 0.5, 0.6, 0.7, 0.2, 0.5, 0.50001, None, 0.9]
    assert [i for i, v in enumerate(column(windows.upward_crossings(series({"a": x}), "value"), "crossing")) if v] == [2, 6]


def plain_peaks(x, height, distance):
    found, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    found = [p for p in found if height is None or x[p] >= height]
    keep = set(found)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if p in keep:
            keep -= {q for q in keep if q != p and abs(q - p) < distance}
    return sorted(keep)


@pytest.mark.parametrize("distance", [1, 2, 3, 6, 11])
def test_peaks_with_plateaus(series, small_blocks, distance):
    rng = np.random.default_rng(distance)
    x = (rng.integers(0, 6, size=90) / 5).tolist()
    got = peaks.find_peaks(series({"a": x, "b": x[::-1]}), "value", 0.4, distance)
    for name, values in (("a", x), ("b", x[::-1])):
        assert column(got.where(F.col("series_id") == name), "pos") == plain_peaks(values, 0.4, distance)


def test_flat_series_has_no_peak(series):
    assert peaks.find_peaks(series({"a": [1.0] * 6}), "value").count() == 0
    assert peaks.find_peaks(series({"a": [1.0, 2.0]}), "value").count() == 0


def test_lead_times(series, small_blocks):
    rng = np.random.default_rng(3)
    p = rng.random(120).tolist()
    y = (rng.random(120) < 0.06).astype(int).tolist()
    s = series({"a": p}).withColumn("label", F.element_at(F.array(*[F.lit(v) for v in y]), F.col("pos").cast("int") + 1))
    found = peaks.find_peaks(s, "value")
    events = [i for i, v in enumerate(y) if v]
    expected = []
    for k in plain_peaks(p, 0.5, 2):
        after = [e for e in events if e > k]
        if after and after[0] - k <= 12:
            expected.append((k, after[0] - k))
    got = peaks.lead_times(s, found).orderBy("pos").collect()
    assert [(r.pos, r.lead) for r in got] == expected


def test_lead_of_twelve_and_the_bin_edges(spark):
    leads = spark.createDataFrame([(12,), (1,), (3,)], "lead int")
    assert stats.histogram(leads, "lead", stats.REFERENCE_LEAD_EDGES).agg(F.sum("n")).first()[0] == 2
    assert stats.histogram(leads, "lead").agg(F.sum("n")).first()[0] == 3
    assert np.histogram([12, 1], bins=np.arange(0.5, 12.5, 1))[0].sum() == 1


def test_positions_are_dense_and_independent_of_partitioning(spark, small_blocks):
    start = dt.datetime(2020, 1, 1)
    rows = [("ab"[i % 3 == 0], start + dt.timedelta(hours=7 * i), i) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, i int")
    expected = {}
    for k in "ab":
        for n, r in enumerate(sorted(r for r in rows if r[0] == k)):
            expected[r[2]] = n
    for parts in (1, 4, 16):
        for grain in ("month", None):
            got = {r.i: r.pos for r in with_position(df.repartition(parts), grain=grain).collect()}
            assert got == expected


def test_ranges_split_one_frequent_stamp(spark, small_blocks):
    df = spark.range(4000).select(F.lit("a").alias("series_id"), F.lit(7).alias("t"), "id").repartition(6)
    cut = range_chunks(df, ["series_id", "t", "id"])
    edges = cut.groupBy("_chunk").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("_chunk").collect()
    assert len(edges) == 4 and all(a.hi < b.lo for a, b in zip(edges, edges[1:]))


def test_positions_with_one_frequent_stamp(spark, small_blocks):
    df = spark.range(3000).select(F.lit("a").alias("series_id"), F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("t"), "id")
    got = with_position(df.repartition(6), on=["t", "id"])
    assert {r.id: r.pos for r in got.collect()} == {i: i for i in range(3000)}


def test_running_totals_both_ways(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    up = running_totals(range_chunks(df.repartition(5), ["v"]), ["k"], "_chunk", ["v"], {"c": F.col("v")})
    down = running_totals(range_chunks(df.repartition(5), ["v"]), ["k"], "_chunk", ["v"], {"c": F.col("v")}, descending=True)
    assert {r.v: r.c for r in up.collect()} == {v: sum(range(v % 2, v + 1, 2)) for v in range(1000)}
    assert {r.v: r.c for r in down.collect()} == {v: sum(range(v, 1000, 2)) for v in range(1000)}


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_smallest_draws_fill_the_quota(spark, monkeypatch, bits):
    monkeypatch.setattr("gridsignal.operators.ordering.HASH_BITS", bits)
    group = F.when(F.col("id") % 3 != 2, F.col("id") % 3)
    df = spark.range(500).withColumn("g", group).withColumn("d", hash_draw(1, F.col("id")))
    quota = spark.createDataFrame([(0, 0), (1, 17), (None, 166)], "g long, _quota long")
    rows = smallest_draws(df, ["g"], "d", ["id"], quota, "r").collect()
    assert len(rows) == 500
    for g, n in ((0, 0), (1, 17), (None, 166)):
        own = sorted((r.d, r.r) for r in rows if r.g == g)
        assert [r for _, r in own] == [True] * n + [False] * (len(own) - n)


@pytest.mark.parametrize("grain", ["month", None])
def test_positions_keep_rows_without_key_or_stamp(spark, small_blocks, grain):
    start = dt.datetime(2020, 1, 1)
    rows = [(None if i % 4 == 0 else "a", None if i == 5 else start + dt.timedelta(days=3 * i), i) for i in range(40)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, i int")
    expected = {}
    for k in (None, "a"):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or start))
        expected |= {r[2]: n for n, r in enumerate(own)}
    for parts in (1, 4, 16):
        assert {r.i: r.pos for r in with_position(df.repartition(parts), grain=grain).collect()} == expected


def test_missing_values_have_no_peak_at_or_beside_them(series):
    nan = float("nan")
    found = lambda x: column(peaks.find_peaks(series({"a": x}), "value", None), "pos")
    assert found([0.1, 0.9, None, 0.2]) == []
    assert found([0.1, nan, 0.2, 0.9, 0.3]) == [3]
    assert found([0.1, 0.9, nan, nan, 0.2, 0.4, 0.1]) == [5]


def test_nan_is_missing(series, spark):
    nan = float("nan")
    assert column(windows.rolling_mean(series({"a": [1.0, nan, 3.0, nan, nan, nan, 5.0]}), "value", 3), "smoothed") == [1.0, 2.0, 3.0, 3.0, None, 5.0, 5.0]
    assert column(labels.weak_labels(series({"a": [1.0, nan, 1.0, 1.0, 1.0]}), threshold=2.0, smoothing=1), "label") == [0, 0, 0, 0, 1]
    assert column(labels.weak_labels(series({"a": [1.0, nan, 1.0, 1.0, 1.0]}), threshold=2.0), "label") == [0, 0, 1, 1, 1]
    balance = labels.class_balance(series({"a": [1.0, nan, 3.0, None]}), [2.0]).first()
    assert (balance.weak_n, balance.strong_n, balance.weak_pct) == (1, 1, 25.0)
    scores = spark.createDataFrame([(1.0, nan), (2.0, 0.5), (3.0, 0.5), (4.0, None)], "threshold double, f1_score double")
    assert tuple(stats.best_threshold(scores).first()) == (2.0, 0.5)


def test_group_aggregates_reach_rows_without_key(series):
    rows = series({"a": [1.0, 3.0]}).withColumn("series_id", F.when(F.col("pos") == 0, F.lit("a")))
    assert sorted(column(timeops.impute_mean(rows, "value"), "value")) == [1.0, 3.0]


def test_resample_keeps_empty_months(spark):
    rows = [("a", dt.datetime(2020, 1, 5), 1.0), ("a", dt.datetime(2020, 1, 9), 3.0), ("a", dt.datetime(2020, 4, 1), None)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, v double")
    got = timeops.resample_mean(df, ["v"]).orderBy("ts").collect()
    assert [(r.ts.strftime("%Y-%m-%d"), r.v) for r in got] == [
        ("2020-01-31", 2.0), ("2020-02-29", None), ("2020-03-31", None), ("2020-04-30", None)
    ]


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c"), (1, 3, "z")], "k int, o int, v string")
    assert sorted(map(tuple, timeops.dedup_first(df, ["k"], "o").collect())) == [(1, 2, "a"), (2, 9, "c")]


def test_align_needs_a_time_column(spark):
    with pytest.raises(ValueError):
        timeops.align_time([spark.range(3)], "ts")


def test_squeeze_rejects_a_varying_dimension(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "i int, depth double")
    with pytest.raises(Exception, match="more than one value"):
        timeops.squeeze_dim(df, "depth").collect()


def test_minmax_of_a_constant_is_zero(series):
    assert column(timeops.minmax_scale(series({"a": [3.0, 3.0]}), "value"), "value") == [0.0, 0.0]


def test_month_axis(spark):
    got = [r.ts.strftime("%Y-%m-%d") for r in timeops.month_axis(spark, "1993-02-01", 370).orderBy("pos").collect()]
    assert got[0] == "1993-02-01" and got[11] == "1994-01-01" and len(got) == 370 and got[-1] == "2023-11-01"


def test_hit_rate_and_alarm_padding(series):
    y = [1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    s = series({"a": y}).withColumn("label", F.col("value").cast("int"))
    for wrap in (False, True):
        got = {r.lead: r.hit_rate for r in stats.hit_rate(s, wrap=wrap).collect()}
        for lead in stats.HIT_LEADS:
            shifted = np.roll(y, -lead) if wrap else np.array(y[lead:] + [0.0] * min(lead, 6))[:6]
            assert got[lead] == pytest.approx(float(((np.array(y) == 1) & (shifted == 1)).sum() / 4))
    row = stats.false_alarm_rate(s.withColumn("pred", F.lit(1)), lead=4, total_rows=240).first()
    assert (row.true_events, row.false_alarms, row.false_alarms_per_decade) == (1, 1, 0.5)


def test_quantiles_equal_numpy(spark):
    x = [1.0, 2.0, 2.0, 3.0, 7.0, 11.0]
    got = stats.quantiles(spark.createDataFrame([(v,) for v in x], "x double"), "x", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert (got.n, got.a, got.b, got.c) == (6, 2.0, 2.5, 6.0)
    r = np.random.default_rng(5).normal(size=3000)
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(r)], "x double, g int")
    for row in stats.quantiles(df, "x", {"q": 0.1}, ["g"]).collect():
        assert row.q == pytest.approx(np.percentile(r[row.g::2], 10))


def test_kde_equals_direct_sum(spark):
    x = np.random.default_rng(2).normal(size=80)
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    expected = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    got = stats.kde(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 50).orderBy("point").toPandas()
    assert np.allclose(got.density, expected) and np.allclose(got.x, grid)


def test_best_threshold_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([(12.0, 0.4), (13.5, 0.7), (15.0, 0.7), (18.0, None)], "threshold double, f1_score double")
    assert tuple(stats.best_threshold(df).first()) == (13.5, 0.7)


def test_single_class_thresholds_are_left_out(series):
    s = labels.sweep(series({"a": [1.0, 2.0, 3.0, None]}), [0.5, 2.5, 9.0])
    assert {r.threshold for r in labels.two_class_groups(s).collect()} == {2.5, 9.0}  # a missing value is labelled 0
    rows = {r.threshold: r for r in labels.class_balance(series({"a": [1.0, 2.0, 3.0, None]}), [2.0]).collect()}
    assert (rows[2.0].weak_n, rows[2.0].strong_n, rows[2.0].weak_pct) == (1, 2, 25.0)
    assert labels.sweep_thresholds() == pytest.approx([12.0, 13.5, 15.0, 16.5, 18.0])
