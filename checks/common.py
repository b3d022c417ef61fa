"""Shared inputs and formatting for the checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.session import settle

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries with their optional SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return present(fn(spark, sf_dir))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The engines add numbers in different orders. Means of two-decimal values often lie exactly between two roundings; this
# moves such values to the same side on both.
TIE = 2.3e-9


def present(df: DataFrame) -> DataFrame:
    """Results as compared: six decimals, time stamps as text."""
    cells = []
    for field in df.schema:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            column = F.round(column.cast("double") + F.lit(TIE), 6) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        cells.append(column.alias(field.name))
    return df.select(*cells)


def final(ctes: str, select: str, numbers: Sequence[str] = (), stamps: Sequence[str] = ()) -> str:
    """SQL with the same formatting as ``present``."""
    swaps = [f"round(CAST({c} AS DOUBLE) + {TIE}, 6) + 0.0 AS {c}" for c in numbers]
    swaps += [f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {c}" for c in stamps]
    head = f"WITH {ctes} " if ctes else ""
    star = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
    return f"{head}SELECT {star} FROM ({select}) AS result"


# ---- hourly series -------------------------------------------------------------------------------------------------

WEAK = 48.0  # threshold that marks about a fifth of the hours as weak


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """One series: mean event value per hour. At most one row per hour of the covered period."""
    events = table(spark, d, "events").select("ts", "value")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.avg("value").alias("value")
    ).select(F.lit("all").alias("series_id"), "ts", "value")


def typed(spark: SparkSession, d: str) -> DataFrame:
    """One series per event type, with gaps."""
    events = table(spark, d, "events").select("ts", "event_type", "value")
    return events.groupBy(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    ).agg(F.avg("value").alias("value"))


HOURLY = "hourly AS (SELECT 'all' AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL)"
TYPED = "typed AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL)"


def sql_positions(source: str, name: str = "s") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos FROM {source})"


def sql_weak(source: str, name: str = "weak", threshold: float = WEAK) -> str:
    """Weak-state labels, smoothing 3 and persistence 3."""
    return f"""
{name}_m AS (SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM {source}),
{name} AS (SELECT * EXCLUDE (sm), CASE WHEN sm IS NULL THEN 0 WHEN sum(CASE WHEN sm < {threshold} THEN 1 ELSE 0 END)
  OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END AS label FROM {name}_m)"""


# ---- probability series --------------------------------------------------------------------------------------------

SCORED_HOURS = f"""{HOURLY}, {sql_positions('hourly')}, {sql_weak('s')},
prob AS (SELECT series_id, ts, pos, label, least(value / 100.0, 1.0) AS p FROM weak)"""


def scored_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hourly probability ``p`` with weak-state labels and positions."""
    from gridsignal.operators.labels import weak_labels
    from gridsignal.operators.ordering import with_position

    s = weak_labels(with_position(hourly(spark, d)), threshold=WEAK)
    return settle(s.select("series_id", "ts", "pos", "label", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("p")))


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    """One scored row per event."""
    events = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return events.select(
        F.col("event_id").alias("row_id"),
        "ts",
        F.col("event_type"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") / 500.0).alias("p"),
    ).withColumn("pred", (F.col("p") > 0.1).cast("int"))


SCORED_EVENTS = """scored AS (SELECT event_id AS row_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y,
 value / 500.0 AS p, CASE WHEN value / 500.0 > 0.1 THEN 1 ELSE 0 END AS pred FROM events)"""

# ---- grid ----------------------------------------------------------------------------------------------------------

NLAT, NLON = 6, 8
GRID_VARS = ("sst", "sss", "ssh")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Long grid table: month, cell, variable, value."""
    items = table(spark, d, "lineitem")
    cells = items.groupBy(
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"),
        (F.col("l_suppkey") % NLAT).cast("int").alias("lat_idx"),
        (F.col("l_partkey") % NLON).cast("int").alias("lon_idx"),
    ).agg(
        F.avg("l_quantity").alias("sst"),
        F.avg("l_discount").alias("sss"),
        F.avg("l_tax").alias("ssh"),
        F.sum("l_extendedprice").alias("runoff"),
    )
    long = cells.unpivot(["ts", "lat_idx", "lon_idx"], ["sst", "sss", "ssh", "runoff"], "var", "value")
    return long.withColumn("cell_id", F.col("lat_idx").cast("long") * NLON + F.col("lon_idx"))


GRID = f"""cells AS (SELECT date_trunc('month', l_shipdate) AS ts, CAST(l_suppkey % {NLAT} AS INTEGER) AS lat_idx,
 CAST(l_partkey % {NLON} AS INTEGER) AS lon_idx, avg(l_quantity) AS sst, avg(l_discount) AS sss, avg(l_tax) AS ssh,
 sum(l_extendedprice) AS runoff FROM lineitem GROUP BY ALL),
grid AS (SELECT ts, lat_idx, lon_idx, var, value, CAST(lat_idx AS BIGINT) * {NLON} + lon_idx AS cell_id
 FROM (UNPIVOT cells ON sst, sss, ssh, runoff INTO NAME var VALUE value))"""


def lat_axis(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select((F.col("l_suppkey") % NLAT).cast("int").alias("lat_idx")).distinct()
    return items.withColumn("lat", 10 + 2.0 * F.col("lat_idx"))


def lon_axis(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select((F.col("l_partkey") % NLON).cast("int").alias("lon_idx")).distinct()
    return items.withColumn("lon", -60 + 2.5 * F.col("lon_idx"))


AXES = f"""lat AS (SELECT DISTINCT CAST(l_suppkey % {NLAT} AS INTEGER) AS lat_idx, 10 + 2.0 * (l_suppkey % {NLAT}) AS lat FROM lineitem),
lon AS (SELECT DISTINCT CAST(l_partkey % {NLON} AS INTEGER) AS lon_idx, -60 + 2.5 * (l_partkey % {NLON}) AS lon FROM lineitem)"""
