"""Gridded fields as long tables: cells, masks, regridding and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.functions.columns import MEGA, null_if_nan
from gridsignal.operators.asof import asof_nearest, neighbours
from gridsignal.operators.windows import cumulative_offsets

MAX_AXIS = 200_000  # weights of one axis that every row can look up


def with_cell_id(df: DataFrame, nlon: int, lat_idx: str = "lat_idx", lon_idx: str = "lon_idx") -> DataFrame:
    """Row-major cell number."""
    cell = F.col(lat_idx).cast("long") * F.lit(nlon) + F.col(lon_idx)
    return df.withColumn("cell_id", cell)


def valid_cells(grid: DataFrame, variables: Sequence[str], when: str = "all", on: str = "ts") -> DataFrame:
    """Cells with a value (not NULL, not NaN) for every variable, at the first time step (``"first"``) or at every step (``"all"``).

    One map-side combined aggregation per cell; a cell valid at all times is also valid at the first, so ``"all"``
    needs no second pass.
    """
    rows = grid.where(F.col("var").isin(list(variables)))
    if when == "first":
        first = rows.agg(F.min(on)).scalar()
        filled = rows.where(F.col(on) == first).groupBy("cell_id").agg(F.count(null_if_nan(F.col("value"))).alias("_n"))
        return filled.where(F.col("_n") == len(variables)).select("cell_id")
    steps = rows.agg(F.count_distinct(F.col(on))).scalar()
    filled = rows.groupBy("cell_id").agg(F.count(null_if_nan(F.col("value"))).alias("_n"))
    return filled.where(F.col("_n") == steps * len(variables)).select("cell_id")


def keep_cells(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """Restrict a field to the given cells."""
    return grid.join(cells, "cell_id", "left_semi")


def spatial_sum(grid: DataFrame, by: Sequence[str] = ("ts",), scale: float = MEGA, out: str = "total") -> DataFrame:
    """Sum over space per time step; NULL and NaN count as 0."""
    return grid.groupBy(*by).agg((F.coalesce(F.sum(null_if_nan(F.col("value"))), F.lit(0.0)) * F.lit(scale)).alias(out))


def spatial_mean(grid: DataFrame, by: Sequence[str] = ("ts",), out: str = "mean") -> DataFrame:
    """Mean over space per time step; NULL and NaN are skipped."""
    return grid.groupBy(*by).agg(F.avg(null_if_nan(F.col("value"))).alias(out))


def mesh(lat: DataFrame, lon: DataFrame) -> DataFrame:
    """Every cell of a grid from its axes ``(lat_idx, lat)`` and ``(lon_idx, lon)``.

    The column numbers are generated per latitude and joined to the longitude axis by number.
    """
    size = lon.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    numbered = lat.withColumn("lon_idx", F.explode(F.sequence(F.lit(0), size - 1)))
    cells = numbered.join(lon, "lon_idx").withColumn("_nlon", size)
    cell = F.col("lat_idx").cast("long") * F.col("_nlon") + F.col("lon_idx")
    return cells.select("lat_idx", "lon_idx", "lat", "lon", cell.alias("cell_id"))


def to_grid(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Values on the full grid, missing elsewhere."""
    return cells.join(values, "cell_id", "left")


def axis_weights(
    source: DataFrame, target: DataFrame, idx: str, coord: str, method: str = "nearest", grain: float = 10.0
) -> DataFrame:
    """Source positions and weights for each position of a target axis: ``(_to, _from, _w, _of)``.

    Targets outside the source axis have no row. ``_of`` is the number of source positions used.
    """
    to = target.select(F.col(idx).alias("_to"), coord)
    source = source.select(F.col(idx).alias("_from"), coord)
    if method == "nearest":
        near = asof_nearest(to, source, ["_from"], coord, (), grain, ties="earlier", extrapolate=False)
        hit = near.where(F.col("_from").isNotNull())
        return hit.select("_to", "_from", F.lit(1.0).alias("_w"), F.lit(1).alias("_of"))
    if method != "linear":
        raise ValueError(f"method {method!r} is not supported; use 'nearest' or 'linear'")
    both = neighbours(to, source, ["_from"], coord, (), grain).where(
        F.col("_p").isNotNull() & F.col("_n").isNotNull()
    )
    width = F.col("_n._at") - F.col("_p._at")
    share = F.when(width > 0, (F.col(coord) - F.col("_p._at")) / width).otherwise(F.lit(0.0))
    sides = F.array(
        F.struct(F.col("_p._from").alias("_from"), (F.lit(1.0) - share).alias("_w")),
        F.struct(F.col("_n._from").alias("_from"), share.alias("_w")),
    )
    used = F.filter(sides, lambda s: s["_w"] > 0)
    spread = both.select("_to", used.alias("_used"))
    return spread.select("_to", F.size("_used").alias("_of"), F.explode("_used").alias("_s")).select(
        "_to", "_s._from", "_s._w", "_of"
    )


def axis_lookup(weights: DataFrame) -> tuple[Column, Column]:
    """The weights of an axis as one value that every row can carry: where a source position stands in the list of targets
    ``(_to, _w, _of)``. An axis has at most ``MAX_AXIS`` positions (checked), whatever the size of the field."""
    rows = weights.limit(MAX_AXIS + 1).collect()
    if len(rows) > MAX_AXIS:
        raise ValueError(f"more than {MAX_AXIS} weights of one axis; a field is regridded between axes, not lists of points")
    first = min((r["_from"] for r in rows), default=0)
    targets: list[list] = [[] for _ in range(max((r["_from"] for r in rows), default=first - 1) - first + 1)]
    for r in sorted(rows, key=lambda r: r["_to"]):
        targets[r["_from"] - first].append((r["_to"], float(r["_w"]), r["_of"]))
    one = weights.sparkSession.createDataFrame([(targets,)], "at array<array<struct<_to:int,_w:double,_of:int>>>")
    return one.agg(F.first("at")).scalar(), F.lit(first)


def regrid(
    field: DataFrame,
    source_lat: DataFrame,
    source_lon: DataFrame,
    target_lat: DataFrame,
    target_lon: DataFrame,
    method: str = "nearest",
    by: Sequence[str] = ("ts", "var"),
) -> DataFrame:
    """Interpolate a field ``(by, lat_idx, lon_idx, value)`` to the target axes, one axis at a time.

    The weights are worked out on the 1-D axes when this is called, and every row looks up its targets where it is: nearest
    moves nothing, linear only adds up the corners of each target cell. Nearest keeps the lower coordinate at equal
    distance. Cells outside the source range, or with a missing corner, have no value.
    """
    lat, lat_first = axis_lookup(axis_weights(source_lat, target_lat, "lat_idx", "lat", method))
    lon, lon_first = axis_lookup(axis_weights(source_lon, target_lon, "lon_idx", "lon", method))
    by = list(by)

    def targets(table: Column, first: Column, idx: str) -> Column:
        at = F.col(idx) - first
        return F.explode(F.when(at >= 0, F.get(table, at.cast("int"))))

    along = field.select(*by, "lon_idx", "value", targets(lat, lat_first, "lat_idx").alias("_lat"))
    both = along.select(*by, "value", "_lat", targets(lon, lon_first, "lon_idx").alias("_lon"))
    keys = [*by, F.col("_lat._to").alias("lat_idx"), F.col("_lon._to").alias("lon_idx")]
    if method == "nearest":
        return both.select(*keys, "value")
    corners = F.max(F.col("_lat._of") * F.col("_lon._of"))
    blended = both.groupBy(*keys).agg(
        F.sum(F.col("_lat._w") * F.col("_lon._w") * F.col("value")).alias("_v"),
        (F.count("value") == corners).alias("_whole"),
    )
    return blended.select(*by, "lat_idx", "lon_idx", F.when(F.col("_whole"), F.col("_v")).alias("value"))


def block_table(features: DataFrame) -> DataFrame:
    """Blocks with their size and start offset, in the order of their first feature."""
    sizes = features.groupBy("block").agg(
        F.count(F.lit(1)).alias("size"), F.min("feature_id").alias("_first")
    )
    return cumulative_offsets(sizes, "size", "_first", out="start").select("block", "size", "start")
