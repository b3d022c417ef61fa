"""Feature matrices with features as rows.

The matrix is short and very wide: a few hundred time steps, up to millions of features. One row per feature with its
time series as an array keeps every per-feature step (standardise, project) free of shuffles, and the matrix never has
to be pivoted. The length of the arrays is the length of the time axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.operators.groups import attach

MAX_STEPS = 20_000  # longest time axis kept in one array


def pack(long: DataFrame, ids: Sequence[str] = ("feature_id", "block", "cell_id"), steps: int | None = None) -> DataFrame:
    """``(ids, pos, value)`` rows to ``(ids, series ARRAY<DOUBLE>)`` in time order.

    With ``steps`` only features with a value at every step are kept.
    """
    cells = F.array_sort(F.collect_list(F.struct("pos", "value")))
    packed = long.groupBy(*ids).agg(cells.alias("_cells"))
    if steps is not None:
        packed = packed.where(F.size("_cells") == steps)
    return packed.select(*ids, F.transform("_cells", lambda c: c["value"]).alias("series"))


def unpack(features: DataFrame, ids: Sequence[str] = ("feature_id",), series: str = "series") -> DataFrame:
    """``(ids, pos, value)`` rows from feature arrays."""
    return features.select(*ids, F.posexplode(series).alias("pos", "value"))


def train_mask(times: DataFrame) -> Column:
    """Array over the time axis telling which steps belong to the training split; one value per time step."""
    flags = F.array_sort(F.collect_list(F.struct("pos", (F.col("split") == "train").alias("on"))))
    return times.agg(F.transform(flags, lambda s: s["on"]).alias("mask")).scalar()


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` worked out once per row and not once per use."""
    return F.transform(F.array(value), body)[0]


def standardize(features: DataFrame, mask: Column | None = None, series: str = "series", out: str = "z") -> DataFrame:
    """Per-feature ``(x - mean) / population std``, fitted on the masked steps and applied to all.

    A constant feature is only centred. No shuffle: each row holds its own series.
    """
    if mask is None:
        df, fit = features, F.col(series)
    else:
        df = features.withColumn("_mask", mask)
        fit = F.filter(F.zip_with(series, "_mask", lambda v, m: F.when(m, v)), lambda v: v.isNotNull())

    def total(values: Column, term) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + term(v))

    def scaled(mean: Column, spread: Column) -> Column:
        unit = F.when(spread > 0, spread).otherwise(F.lit(1.0))
        return bind(unit, lambda u: F.transform(series, lambda v: (v - mean) / u))

    z = bind(fit, lambda f: bind(total(f, lambda v: v) / F.size(f), lambda mean: bind(
        F.sqrt(total(f, lambda v: (v - mean) * (v - mean)) / F.size(f)), lambda spread: scaled(mean, spread))))
    return df.withColumn(out, z).drop("_mask")


def standardize_rows(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Row-major variant for narrow tables: means and deviations from ``fit`` (default: all rows)."""
    aggs = {}
    for c in columns:
        aggs[f"_m_{c}"] = F.avg(c)
        aggs[f"_s_{c}"] = F.stddev_pop(c)
    wide = attach(df, (), aggs, source=fit)
    cells = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        for c in columns
    }
    return wide.withColumns(cells).drop(*aggs)


def select_block(features: DataFrame, block: str) -> DataFrame:
    """Features of one block."""
    return features.where(F.col("block") == block)


def drop_block(features: DataFrame, block: str) -> DataFrame:
    """All features but those of one block."""
    return features.where(F.col("block") != block)


def concat_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """Feature blocks under each other."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def complete_rows(features: DataFrame, labels: DataFrame, columns: Sequence[str], on: Sequence[str] = ("ts",)) -> DataFrame:
    """Time steps with every feature present, with their label."""
    return features.dropna(subset=list(columns)).join(labels, list(on))


def first_rows(df: DataFrame, order: str = "row_id", n: int = 100) -> DataFrame:
    """The first ``n`` rows by ``order``, the sample shown to an explainer as background."""
    return df.orderBy(order).limit(n)
