"""Time axes: generation, alignment, clipping, de-duplication and resampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.operators.groups import attach


def month_axis(spark: SparkSession, start: str, periods: int) -> DataFrame:
    """Month-start time axis ``(pos, ts)``."""
    return relabel_months(spark.range(periods).withColumnRenamed("id", "pos"), start)


def relabel_months(df: DataFrame, start: str, pos: str = "pos", ts: str = "ts") -> DataFrame:
    """Replace the time axis by month starts counted from ``start``, by position."""
    first = F.date_trunc("month", F.to_timestamp(F.lit(start)).cast("timestamp_ntz"))
    step = F.make_ym_interval(F.lit(0), F.col(pos).cast("int"))
    return df.withColumn(ts, (first + step).cast("timestamp_ntz"))


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the first row by ``order`` for each key.

    An aggregation, so copies are folded on the map side and a key with very many copies costs no more than others.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    first = F.min_by(F.struct(order, *rest), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def align_time(frames: Sequence[DataFrame], on: str = "ts") -> list[DataFrame]:
    """Restrict every dataset to the time stamps they all share."""
    for i, frame in enumerate(frames):
        if on not in frame.columns:
            raise ValueError(f"dataset {i} has no time column {on!r}")
    stamps = [f.select(on).where(F.col(on).isNotNull()).distinct() for f in frames]
    common = reduce(DataFrame.unionByName, stamps).groupBy(on).count().where(F.col("count") == len(frames)).select(on)
    return [f.join(common, on, "left_semi") for f in frames]


def common_times(frames: Sequence[DataFrame], on: str = "ts") -> DataFrame:
    """Sorted unique time stamps present in every dataset."""
    shared = reduce(DataFrame.intersect, [f.select(on).where(F.col(on).isNotNull()) for f in frames])
    return shared.orderBy(on)


def clip_period(df: DataFrame, start: str | None = None, end: str | None = None, on: str = "ts") -> DataFrame:
    """Keep rows in ``[start, end]``; pushed down to the scan."""
    if start is not None:
        df = df.where(F.col(on) >= F.lit(start).cast(df.schema[on].dataType))
    if end is not None:
        df = df.where(F.col(on) <= F.lit(end).cast(df.schema[on].dataType))
    return df


def clip_to_overlap(df: DataFrame, reference: DataFrame, days: int = 31, on: str = "ts") -> DataFrame:
    """Keep rows within the reference range widened by ``days``; keep everything when nothing overlaps."""
    span = reference.agg(F.struct(F.min(on).alias("lo"), F.max(on).alias("hi")).alias("span")).scalar()
    margin = F.make_dt_interval(F.lit(days))
    wide = df.withColumn("_span", span)
    inside = F.coalesce(
        F.col(on).between(F.col("_span.lo") - margin, F.col("_span.hi") + margin), F.lit(False)
    )
    any_inside = wide.agg(F.max(inside).alias("any")).scalar()
    return wide.where(inside | ~F.coalesce(any_inside, F.lit(False))).drop("_span")


def drop_leading(df: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    """Drop the first ``k`` rows of each series, by position."""
    return df.where(F.col(pos) >= k)


def squeeze_dim(df: DataFrame, dim: str) -> DataFrame:
    """Drop a dimension column that holds one value; fails at run time when it holds several."""
    single = df.agg(F.min(dim).eqNullSafe(F.max(dim)).alias("one"))
    guard = F.assert_true(single.scalar(), F.lit(f"dimension {dim} holds more than one value"))
    return df.where(guard.isNull()).drop(dim)


def resample_mean(
    df: DataFrame,
    columns: Sequence[str],
    unit: str = "month",
    by: Sequence[str] = ("series_id",),
    on: str = "ts",
) -> DataFrame:
    """Calendar means of the non-missing values, labelled with the last day of the unit for months.

    Units without data between the first and the last one are present with NULL values.
    """
    by = list(by)
    start = F.date_trunc(unit, F.col(on)).cast("timestamp_ntz")
    means = df.where(F.col(on).isNotNull()).groupBy(*by, start.alias("_u")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )
    step = F.expr(f"interval 1 {unit}")
    ends = means.groupBy(*by).agg(F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
    spine = ends.select(*by, F.explode(F.sequence("_lo", "_hi", step)).alias("_u"))
    out = spine.join(means, [*by, "_u"], "left")
    label = F.last_day("_u").cast("timestamp_ntz") if unit == "month" else F.col("_u")
    return out.select(*by, label.alias(on), *columns)


def extent(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Minimum and maximum of each column."""
    aggs = [f(c).alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*aggs)


def minmax_scale(df: DataFrame, column: str, by: Sequence[str] = ("series_id",), out: str | None = None) -> DataFrame:
    """Shift to a minimum of 0 and scale to a maximum of 1; 0 when the range is empty."""
    ranged = attach(df, by, {"_lo": F.min(column), "_hi": F.max(column)})
    width = F.col("_hi") - F.col("_lo")
    scaled = F.when(width > 0, (F.col(column) - F.col("_lo")) / width).otherwise(F.lit(0.0))
    return ranged.withColumn(out or column, scaled).drop("_lo", "_hi")


def impute_mean(df: DataFrame, column: str, by: Sequence[str] = ("series_id",), out: str | None = None) -> DataFrame:
    """Missing values become the mean of their series."""
    mean = attach(df, by, {"_mean": F.avg(column)})
    return mean.withColumn(out or column, F.coalesce(F.col(column), F.col("_mean"))).drop("_mean")
