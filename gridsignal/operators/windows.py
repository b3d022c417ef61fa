"""Sliding operators on positioned series.

All take rows with a dense position (``with_position``) and run block by block (``over_blocks``), so a series of any
length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.functions.columns import null_if_nan
from gridsignal.operators.groups import attach
from gridsignal.operators.ordering import over_blocks, running_totals

SERIES = ("series_id",)

# Running-mean length in rows and shift used for early-warning alarms.
RUNNING_ROWS = 90
ALARM_LEAD = 36


def lag_features(
    df: DataFrame, columns: Sequence[str], ks: Sequence[int] = (1, 2), by: Sequence[str] = SERIES, pos: str = "pos"
) -> DataFrame:
    """``<column>_lag<k>`` for every column and lag; missing at the start of a series."""

    def build(block, window):
        return block.withColumns({f"{c}_lag{k}": F.lag(c, k).over(window) for c in columns for k in ks})

    return over_blocks(df, by, pos, max(ks), 0, build)


def rolling_frame(window: int, center: bool) -> tuple[int, int]:
    """Rows behind and ahead of a rolling window: centred windows of even length lean to the past."""
    return (window // 2, (window - 1) // 2) if center else (window - 1, 0)


def rolling_mean(
    df: DataFrame,
    column: str,
    window: int,
    min_periods: int = 1,
    center: bool = True,
    by: Sequence[str] = SERIES,
    pos: str = "pos",
    out: str = "smoothed",
) -> DataFrame:
    """Rolling mean of the values that are not missing (NULL or NaN); NULL with fewer than ``min_periods`` of them."""
    back, ahead = rolling_frame(window, center)

    def build(block, w):
        frame = w.rowsBetween(-back, ahead)
        value = null_if_nan(F.col(column))
        return block.withColumn(out, F.when(F.count(value).over(frame) >= min_periods, F.avg(value).over(frame)))

    return over_blocks(df, by, pos, back, ahead, build)


def persistence_filter(
    df: DataFrame, flag: str, k: int, by: Sequence[str] = SERIES, pos: str = "pos", out: str = "persistent"
) -> DataFrame:
    """True where ``flag`` held in each of the last ``k`` rows."""

    def build(block, w):
        held = F.sum(F.coalesce(F.col(flag).cast("int"), F.lit(0))).over(w.rowsBetween(-(k - 1), 0))
        return block.withColumn(out, held >= k)

    return over_blocks(df, by, pos, k - 1, 0, build)


def circular_shift(
    df: DataFrame, column: str, shift: int, by: Sequence[str] = SERIES, pos: str = "pos", out: str = "shifted"
) -> DataFrame:
    """Value ``shift`` rows ahead, wrapping around the end of the series (one match per row, by position)."""
    sized = attach(df, by, {"_n": F.count(F.lit(1))})
    source = df.select(*by, F.col(pos).alias("_at"), F.col(column).alias(out))
    return sized.withColumn("_at", F.pmod(F.col(pos) + shift, F.col("_n"))).join(source, [*by, "_at"]).drop("_at", "_n")


def padded_lead(
    df: DataFrame,
    column: str,
    k: int = ALARM_LEAD,
    fill: float = 0,
    by: Sequence[str] = SERIES,
    pos: str = "pos",
    out: str = "ahead",
) -> DataFrame:
    """Value ``k`` rows ahead, ``fill`` past the end."""

    def build(block, w):
        return block.withColumn(out, F.coalesce(F.lead(column, k).over(w), F.lit(fill)))

    return over_blocks(df, by, pos, 0, k, build)


def persistence_baseline(
    df: DataFrame, label: str = "label", by: Sequence[str] = SERIES, pos: str = "pos", out: str = "pred"
) -> DataFrame:
    """Forecast "same as the previous row", 0 for the first row."""

    def build(block, w):
        return block.withColumn(out, F.coalesce(F.lag(label, 1).over(w), F.lit(0)))

    return over_blocks(df, by, pos, 1, 0, build)


def running_mean(
    df: DataFrame,
    column: str,
    n: int = RUNNING_ROWS,
    edge: str = "zero",
    by: Sequence[str] = SERIES,
    pos: str = "pos",
    out: str = "running",
) -> DataFrame:
    """Running mean over ``n`` rows without missing values (see ``impute_mean``).

    ``edge="zero"`` always divides by ``n``, so the ends shrink towards zero; ``edge="shrink"`` divides by the rows
    present. Counts rows, not calendar time.
    """
    back, ahead = n // 2, (n - 1) // 2

    def build(block, w):
        frame = w.rowsBetween(-back, ahead)
        total = F.sum(column).over(frame)
        return block.withColumn(out, total / F.lit(float(n)) if edge == "zero" else total / F.count(column).over(frame))

    return over_blocks(df, by, pos, back, ahead, build)


def upward_crossings(
    df: DataFrame, column: str = "p", threshold: float = 0.5, by: Sequence[str] = SERIES, pos: str = "pos",
    out: str = "crossing",
) -> DataFrame:
    """True where the value rises above ``threshold`` from at or below it; False for the first row."""

    def build(block, w):
        was_low = F.coalesce(F.lag(column, 1).over(w) <= threshold, F.lit(False))
        return block.withColumn(out, F.coalesce(F.col(column) > threshold, F.lit(False)) & was_low)

    return over_blocks(df, by, pos, 1, 0, build)


def cumulative_offsets(df: DataFrame, size: str, order: str, by: Sequence[str] = (), out: str = "start") -> DataFrame:
    """Start offset of each row: the sum of the sizes before it."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / 4096).cast("long"))
    total = running_totals(chunked, by, "_chunk", [order], {out: F.col(size).cast("long")})
    return total.withColumn(out, F.col(out) - F.col(size)).drop("_chunk")
