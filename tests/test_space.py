"""As-of joins, grids and cleaning."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsignal.functions import columns as C
from gridsignal.operators import grid as G
from gridsignal.operators.asof import asof_nearest


def stamp(day):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=day)


def test_tie_goes_to_the_later_stamp(spark):
    left = spark.createDataFrame([(stamp(1),)], "ts timestamp_ntz")
    right = spark.createDataFrame([(stamp(0), 1.0), (stamp(2), 2.0)], "ts timestamp_ntz, v double")
    assert asof_nearest(left, right, ["v"]).first().v == 2.0
    assert asof_nearest(left, right, ["v"], ties="earlier").first().v == 1.0


@pytest.mark.parametrize("grain", ["day", "month", "year", None])
def test_asof_equals_pandas_nearest(spark, grain, small_blocks):
    rng = np.random.default_rng(4)
    right_days = np.sort(rng.choice(900, 60, replace=False))
    left_days = np.sort(rng.choice(np.arange(-50, 1000), 300))
    values = [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=60)]
    right = spark.createDataFrame([(stamp(int(a)), v) for a, v in zip(right_days, values)], "ts timestamp_ntz, v double")
    left = spark.createDataFrame([(i, stamp(int(a))) for i, a in enumerate(left_days)], "i int, ts timestamp_ntz")
    index = pd.DatetimeIndex([stamp(int(a)) for a in right_days])
    expected = pd.Series(values, index=index, dtype="float64").reindex([stamp(int(a)) for a in left_days], method="nearest")
    got = [r.v for r in asof_nearest(left, right, ["v"], grain=grain).orderBy("i").collect()]
    assert [math.nan if v is None else v for v in got] == pytest.approx(expected.tolist(), nan_ok=True)


def test_asof_tolerance_and_range(spark):
    right = spark.createDataFrame([(10.0, 1), (20.0, 2)], "x double, v int")
    left = spark.createDataFrame([(0.0,), (12.0,), (19.5,), (31.0,)], "x double")
    near = lambda **k: [r.v for r in asof_nearest(left, right, ["v"], "x", (), 7.0, **k).orderBy("x").collect()]
    assert near() == [1, 1, 2, 2]
    assert near(tolerance=1.0) == [None, None, 2, None]
    assert near(extrapolate=False) == [None, 1, 2, None]


def test_asof_by_key_in_sampled_ranges(spark, small_blocks):
    rng = np.random.default_rng(9)
    right = [("ab"[i % 2], float(x), i) for i, x in enumerate(rng.choice(500, 60, replace=False))]
    left = [(i, "abc"[i % 3], float(x)) for i, x in enumerate(rng.integers(-20, 520, 150))]
    got = asof_nearest(spark.createDataFrame(left, "i int, k string, x double"), spark.createDataFrame(right, "k string, x double, v int"), ["v"], "x", ["k"])
    for r in got.collect():
        near = sorted((abs(x - r.x), -x, v) for k, x, v in right if k == r.k)
        assert r.v == (near[0][2] if near else None)


def test_asof_with_one_very_frequent_stamp(spark):
    left = spark.range(2000).select(F.lit(stamp(3)).cast("timestamp_ntz").alias("ts"), F.col("id"))
    right = spark.createDataFrame([(stamp(0), 1.0), (stamp(9), 2.0)], "ts timestamp_ntz, v double")
    got = asof_nearest(left, right, ["v"]).groupBy("v").count().collect()
    assert [tuple(r) for r in got] == [(1.0, 2000)]


def field(spark, values):
    rows = [(0, "v", i, j, values[i][j]) for i in range(len(values)) for j in range(len(values[0]))]
    return spark.createDataFrame(rows, "ts int, var string, lat_idx int, lon_idx int, value double")


def axis(spark, idx, name, coords):
    return spark.createDataFrame(list(enumerate(map(float, coords))), f"{idx} int, {name} double")


def test_linear_regrid_equals_bilinear(spark):
    rng = np.random.default_rng(0)
    lat, lon = np.array([0, 1, 3, 4.5]), np.array([10, 12, 13, 17.0])
    v = rng.normal(size=(4, 4))
    tlat, tlon = np.array([-1, 0, 0.4, 3.2, 4.5]), np.array([10, 11.5, 16.9, 20])
    rows = G.regrid(field(spark, v.tolist()), axis(spark, "lat_idx", "lat", lat), axis(spark, "lon_idx", "lon", lon),
                    axis(spark, "lat_idx", "lat", tlat), axis(spark, "lon_idx", "lon", tlon), "linear").collect()
    got = {(r.lat_idx, r.lon_idx): r.value for r in rows}
    along = np.array([np.interp(tlon, lon, row, left=np.nan, right=np.nan) for row in v])
    full = np.array([np.interp(tlat, lat, along[:, j], left=np.nan, right=np.nan) for j in range(len(tlon))]).T
    expected = {(i, j): full[i, j] for i in range(5) for j in range(4) if not np.isnan(full[i, j])}
    assert got == pytest.approx(expected)


def test_nearest_regrid(spark):
    got = G.regrid(field(spark, [[1.0, 2.0], [3.0, 4.0]]), axis(spark, "lat_idx", "lat", [0, 2]), axis(spark, "lon_idx", "lon", [0, 2]),
                   axis(spark, "lat_idx", "lat", [1.0, 1.5]), axis(spark, "lon_idx", "lon", [0.4, 2.5])).collect()
    assert {(r.lat_idx, r.lon_idx): r.value for r in got} == {(0, 0): 1.0, (1, 0): 3.0}  # ties down, outside missing


def test_missing_corner_gives_missing_value(spark):
    got = G.regrid(field(spark, [[1.0, None], [3.0, 4.0]]), axis(spark, "lat_idx", "lat", [0, 2]), axis(spark, "lon_idx", "lon", [0, 2]),
                   axis(spark, "lat_idx", "lat", [1.0]), axis(spark, "lon_idx", "lon", [0.0, 1.0]), "linear").collect()
    assert {(r.lat_idx, r.lon_idx): r.value for r in got} == {(0, 0): 2.0, (0, 1): None}
    with pytest.raises(ValueError):
        G.axis_weights(axis(spark, "lat_idx", "lat", [0]), axis(spark, "lat_idx", "lat", [0]), "lat_idx", "lat", "cubic")


def test_masks(spark):
    rows = []
    for t in range(3):
        for cell in range(4):
            for var in ("a", "b"):
                hole = (cell == 1 and t == 0 and var == "a") or (cell == 2 and t == 2) or cell == 3
                rows.append((t, cell, var, None if hole else 1.0))
    g = spark.createDataFrame(rows, "ts int, cell_id long, var string, value double")
    assert sorted(r.cell_id for r in G.valid_cells(g, ["a", "b"], "first").collect()) == [0, 2]
    assert sorted(r.cell_id for r in G.valid_cells(g, ["a", "b"]).collect()) == [0]
    sums = G.spatial_sum(g.where("cell_id = 3"), scale=1.0).collect()
    assert {r.total for r in sums} == {0.0}


def test_mesh_and_scatter(spark):
    cells = G.mesh(axis(spark, "lat_idx", "lat", [1, 2]), axis(spark, "lon_idx", "lon", [5, 6, 7]))
    assert sorted((r.cell_id, r.lat, r.lon) for r in cells.collect()) == [
        (i * 3 + j, float(1 + i), float(5 + j)) for i in range(2) for j in range(3)
    ]
    full = G.to_grid(cells, spark.createDataFrame([(4, 9.0)], "cell_id long, value double"))
    assert sorted((r.cell_id, r.value) for r in full.collect() if r.value is not None) == [(4, 9.0)] and full.count() == 6


def test_cf_time(spark):
    rows = [(0, 0.0), (1, 1.5), (2, 1e30), (3, float("nan"))]
    df = spark.createDataFrame(rows, "i int, n double")
    got = {r.i: r.t for r in df.select("i", C.decode_cf_time(F.col("n"), "days", "1950-01-01").alias("t")).collect()}
    assert got == {0: dt.datetime(1950, 1, 1), 1: dt.datetime(1950, 1, 2, 12), 2: None, 3: None}
    with pytest.raises(ValueError):
        C.decode_cf_time(F.col("n"), calendar="360_day")
    with pytest.raises(ValueError):
        C.decode_cf_time(F.col("n"), "fortnights")


def test_sentinel_boundary_and_rounding(spark):
    df = spark.createDataFrame([(-9999.0,), (-9998.9,), (float("nan"),), (2.5,)], "x double")
    assert [r[0] for r in df.select(C.above_floor(F.col("x"))).collect()] == [None, -9998.9, None, 2.5]
    got = spark.createDataFrame([(0.125,), (0.375,)], "x double").select(C.round_half_even(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.12, 0.38]


def test_feature_index_helpers(spark):
    row = spark.range(1).select(
        C.wrap_index(F.lit(-1), 30).alias("a"), C.as_index_list(F.lit(4)).alias("b"),
        C.fit_length(F.array(F.lit(1.0), F.lit(2.0)), 3).alias("c"), C.fit_length(F.array(F.lit(1.0), F.lit(2.0)), 1).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (29, [4], [1.0, 2.0, 0.0], [1.0])


def test_nan_cells_are_not_valid_and_not_summed(spark):
    nan = float("nan")
    rows = [(t, "v", c, v) for t, vs in enumerate([[1.0, nan, 3.0], [1.0, 2.0, None]]) for c, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "ts int, var string, cell_id long, value double")
    assert [r.cell_id for r in G.valid_cells(df, ["v"]).collect()] == [0]
    assert sorted(r.cell_id for r in G.valid_cells(df, ["v"], "first").collect()) == [0, 2]
    assert {r.ts: r.total for r in G.spatial_sum(df, scale=1.0).collect()} == {0: 4.0, 1: 3.0}
    assert {r.ts: r["mean"] for r in G.spatial_mean(df).collect()} == {0: 2.0, 1: 1.5}


@pytest.mark.parametrize("unique", [False, True])
def test_asof_keeps_rows_without_key_or_stamp(spark, small_blocks, unique):
    left = spark.createDataFrame([(i, None if i % 4 == 0 else "a", None if i == 5 else float(i)) for i in range(40)], "i int, k string, x double")
    right = spark.createDataFrame([("a", 10.0, 1), (None, 3.0, 2), (None, 30.0, 3), ("a", None, 9)], "k string, x double, v int")
    got = {r.i: r.v for r in asof_nearest(left.repartition(7), right, ["v"], "x", ["k"], unique_left=unique).collect()}
    assert got == {i: None if i == 5 else 1 if i % 4 else 2 if i < 17 else 3 for i in range(40)}


def test_shared_folder_must_be_named_on_a_cluster():
    from gridsignal.session import is_local

    assert is_local("local") and is_local("local[8]") and is_local("local[*]")
    assert not any(map(is_local, ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://https://host")))
