"""Gridded fields: cells, masks, aggregates, regridding, maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import AXES, GRID, GRID_VARS, NLON, Catalog, final, grid, lat_axis, lon_axis, table
from gridsignal.operators import grid as G
from gridsignal.session import settle

catalog = Catalog()
add = catalog.add


@add("grid_scan", final(GRID, "SELECT ts, cell_id, value FROM grid WHERE var = 'sst'", ["value"], ["ts"]))
def grid_scan(spark, d):
    return grid(spark, d).where("var = 'sst'").select("ts", "cell_id", "value")


@add("cell_ids", final("", f"SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS BIGINT) * {NLON} + l_partkey % {NLON} AS cell_id FROM lineitem"))
def cell_ids(spark, d):
    i = table(spark, d, "lineitem").withColumn("col", F.col("l_partkey") % NLON)
    return G.with_cell_id(i, NLON, "l_suppkey", "col").select("l_orderkey", "l_linenumber", "cell_id")


FIRST = "SELECT cell_id FROM grid WHERE var IN ('sst', 'sss', 'ssh') AND ts = (SELECT min(ts) FROM grid) GROUP BY cell_id HAVING count(value) = 3"
ALL = "SELECT cell_id FROM grid WHERE var IN ('sst', 'sss', 'ssh') GROUP BY cell_id HAVING count(value) = 3 * (SELECT count(DISTINCT ts) FROM grid)"


@add("valid_cells_first_step", final(GRID, FIRST))
def valid_cells_first(spark, d):
    return G.valid_cells(grid(spark, d), GRID_VARS, "first")


@add("valid_cells_all_steps", final(GRID, ALL))
def valid_cells_all(spark, d):
    return G.valid_cells(grid(spark, d), GRID_VARS)


@add("masked_field", final(GRID, f"SELECT ts, cell_id, var, value FROM grid WHERE var <> 'runoff' AND cell_id IN ({ALL})", ["value"], ["ts"]))
def masked_field(spark, d):
    g = settle(grid(spark, d))
    return G.keep_cells(g.where("var <> 'runoff'"), G.valid_cells(g, GRID_VARS)).select("ts", "cell_id", "var", "value")


@add("spatial_sum", final(GRID, "SELECT ts, coalesce(sum(value), 0) / 1e6 AS total FROM grid WHERE var = 'runoff' GROUP BY ts", ["total"], ["ts"]))
def spatial_sum(spark, d):
    return G.spatial_sum(grid(spark, d).where("var = 'runoff'"))


@add("spatial_mean", final(GRID, f"SELECT ts, avg(value) AS mean FROM grid WHERE var = 'sst' AND cell_id IN ({ALL}) GROUP BY ts", ["mean"], ["ts"]))
def spatial_mean(spark, d):
    g = settle(grid(spark, d))
    return G.spatial_mean(G.keep_cells(g.where("var = 'sst'"), G.valid_cells(g, GRID_VARS)))


@add("grid_mesh", final(AXES, f"SELECT lat_idx, lon_idx, lat, lon, CAST(lat_idx AS BIGINT) * {NLON} + lon_idx AS cell_id FROM lat, lon", ["lat", "lon"]))
def grid_mesh(spark, d):
    return G.mesh(lat_axis(spark, d), lon_axis(spark, d))


@add("scatter_to_grid", final(f"{GRID}, {AXES}", f"""SELECT m.cell_id, lat, lon, value FROM (SELECT *, CAST(lat_idx AS BIGINT) * {NLON} + lon_idx AS cell_id FROM lat, lon) m
 LEFT JOIN (SELECT cell_id, avg(value) AS value FROM grid WHERE var = 'sst' AND cell_id IN ({ALL}) GROUP BY 1) v ON m.cell_id = v.cell_id""", ["lat", "lon", "value"]))
def scatter_to_grid(spark, d):
    g = settle(grid(spark, d))
    means = G.keep_cells(g.where("var = 'sst'"), G.valid_cells(g, GRID_VARS)).groupBy("cell_id").agg(F.avg("value").alias("value"))
    return G.to_grid(G.mesh(lat_axis(spark, d), lon_axis(spark, d)), means).select("cell_id", "lat", "lon", "value")


def _targets(spark, d):
    lat = lat_axis(spark, d).withColumn("lat", F.col("lat") + 0.7)
    lon = lon_axis(spark, d).withColumn("lon", F.col("lon") + 0.9)
    return lat, lon


NEAR = """tlat AS (SELECT lat_idx, lat + 0.7 AS lat FROM lat), tlon AS (SELECT lon_idx, lon + 0.9 AS lon FROM lon),
wlat AS (SELECT * FROM (SELECT t.lat_idx AS to_i, s.lat_idx AS from_i, row_number() OVER (PARTITION BY t.lat_idx ORDER BY abs(s.lat - t.lat), s.lat) AS r
 FROM tlat t, lat s WHERE t.lat BETWEEN (SELECT min(lat) FROM lat) AND (SELECT max(lat) FROM lat)) WHERE r = 1),
wlon AS (SELECT * FROM (SELECT t.lon_idx AS to_i, s.lon_idx AS from_i, row_number() OVER (PARTITION BY t.lon_idx ORDER BY abs(s.lon - t.lon), s.lon) AS r
 FROM tlon t, lon s WHERE t.lon BETWEEN (SELECT min(lon) FROM lon) AND (SELECT max(lon) FROM lon)) WHERE r = 1)"""


@add("regrid_nearest", final(f"{GRID}, {AXES}, {NEAR}", """SELECT ts, var, wlat.to_i AS lat_idx, wlon.to_i AS lon_idx, value FROM grid
 JOIN wlat ON grid.lat_idx = wlat.from_i JOIN wlon ON grid.lon_idx = wlon.from_i""", ["value"], ["ts"]))
def regrid_nearest(spark, d):
    return G.regrid(grid(spark, d), lat_axis(spark, d), lon_axis(spark, d), *_targets(spark, d))


LINEAR = """wlat AS (SELECT t.lat_idx AS to_i, s.lat_idx AS from_i, 1 - abs(s.lat - t.lat) / 2.0 AS w FROM (SELECT lat_idx, lat + 0.7 AS lat FROM lat) t, lat s
 WHERE abs(s.lat - t.lat) < 2.0 AND t.lat <= (SELECT max(lat) FROM lat)),
wlon AS (SELECT t.lon_idx AS to_i, s.lon_idx AS from_i, 1 - abs(s.lon - t.lon) / 2.5 AS w FROM (SELECT lon_idx, lon + 0.9 AS lon FROM lon) t, lon s
 WHERE abs(s.lon - t.lon) < 2.5 AND t.lon <= (SELECT max(lon) FROM lon))"""


@add("regrid_linear", final(f"{GRID}, {AXES}, {LINEAR}", """SELECT ts, var, wlat.to_i AS lat_idx, wlon.to_i AS lon_idx,
 CASE WHEN count(value) = 4 THEN sum(wlat.w * wlon.w * value) END AS value FROM grid
 JOIN wlat ON grid.lat_idx = wlat.from_i JOIN wlon ON grid.lon_idx = wlon.from_i GROUP BY ALL""", ["value"], ["ts"]))
def regrid_linear(spark, d):
    return G.regrid(grid(spark, d), lat_axis(spark, d), lon_axis(spark, d), *_targets(spark, d), method="linear")


def feature_dim(spark, d):
    """Feature numbers per block: the valid cells of each variable, then four non-spatial features."""
    cells = G.valid_cells(grid(spark, d), GRID_VARS)
    nblock = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(v).alias("block")) for i, v in enumerate(GRID_VARS)])
    spatial = cells.withColumn("_b", F.explode(nblock)).select((F.col("_b.o") * 1000 + F.col("cell_id")).alias("feature_id"), "_b.block", "cell_id")
    runoff = spark.range(4).select((F.col("id") + 3000).alias("feature_id"), F.lit("runoff").alias("block"), F.lit(None).cast("long").alias("cell_id"))
    return spatial.unionByName(runoff)


DIM = f"""{GRID}, ok AS ({ALL}), dim AS (SELECT o * 1000 + cell_id AS feature_id, block, cell_id FROM ok, (VALUES (0, 'sst'), (1, 'sss'), (2, 'ssh')) v(o, block)
 UNION ALL SELECT 3000 + i, 'runoff', NULL FROM range(4) t(i))"""


@add("block_offsets", final(DIM, """SELECT block, size, CAST(coalesce(sum(size) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
 FROM (SELECT block, count(*) AS size, min(feature_id) AS f FROM dim GROUP BY block)"""))
def block_offsets(spark, d):
    return G.block_table(settle(feature_dim(spark, d)))
