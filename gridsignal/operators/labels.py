"""Weak-state labels, threshold fan-out and class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.functions.columns import null_if_nan, threshold_label
from gridsignal.operators.ordering import over_blocks
from gridsignal.operators.windows import SERIES, rolling_frame

# Base threshold, sweep factors, class-balance thresholds, labeler defaults.
BASE_THRESHOLD = 15.0
SWEEP_FACTORS = (0.8, 0.9, 1.0, 1.1, 1.2)
BALANCE_THRESHOLDS = (12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0)
PERSISTENCE = 3
SMOOTHING = 3


def sweep_thresholds(base: float = BASE_THRESHOLD) -> list[float]:
    """Base threshold and its variations of 10 and 20 percent."""
    return [base * f for f in SWEEP_FACTORS]


def weak_labels(
    df: DataFrame,
    column: str = "value",
    threshold: float = BASE_THRESHOLD,
    persistence: int | None = PERSISTENCE,
    smoothing: int | None = SMOOTHING,
    min_periods: int = 1,
    center: bool = True,
    by: Sequence[str] = SERIES,
    pos: str = "pos",
    out: str = "label",
) -> DataFrame:
    """1 where the smoothed value stayed below ``threshold`` for ``persistence`` rows, else 0.

    0 where the smoothed value is missing; NULL and NaN are skipped. Smoothing or persistence of None or 1 is off. Smoothing and persistence run
    in the same blocks, so the series is shuffled once.
    """
    window, runs = max(1, int(smoothing or 1)), max(1, int(persistence or 1))
    back, ahead = rolling_frame(window, center)
    needed = min_periods if window > 1 else 1

    def build(block, w):
        frame = w.rowsBetween(-back, ahead)
        value = null_if_nan(F.col(column))
        block = block.withColumn("_mean", F.when(F.count(value).over(frame) >= needed, F.avg(value).over(frame)))
        block = block.withColumn("_weak", F.coalesce((F.col("_mean") < threshold).cast("int"), F.lit(0)))
        held = F.sum("_weak").over(w.rowsBetween(-(runs - 1), 0)) >= runs
        return block.withColumn(out, F.when(F.col("_mean").isNull(), 0).otherwise(held.cast("int"))).drop(
            "_mean", "_weak"
        )

    return over_blocks(df, by, pos, back + runs - 1, ahead, build)


def sweep(df: DataFrame, thresholds: Sequence[float], column: str = "value", out: str = "label") -> DataFrame:
    """Every row under every threshold, with its plain label; one job for all thresholds."""
    fanned = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return fanned.withColumn(out, threshold_label(F.col(column), F.col("threshold")))


def class_balance(
    df: DataFrame,
    thresholds: Sequence[float] = BALANCE_THRESHOLDS,
    column: str = "value",
    by: Sequence[str] = (),
) -> DataFrame:
    """Weak and strong counts and the weak share for each threshold; missing values count in the total only.

    One pass with conditional counts: rows are not multiplied by the thresholds.
    """
    x = null_if_nan(F.col(column))
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(x < t).alias(f"_weak{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(x >= t).alias(f"_strong{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"_weak{i}").alias("weak_n"),
                F.col(f"_strong{i}").alias("strong_n"),
                (F.lit(100.0) * F.col(f"_weak{i}") / F.col("_n")).alias("weak_pct"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return counted.select(*by, F.explode(rows).alias("_row")).select(*by, "_row.*")


def class_histogram(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Rows per class."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def two_class_groups(df: DataFrame, label: str = "label", by: Sequence[str] = ("threshold",)) -> DataFrame:
    """Keys of the groups in which both classes occur."""
    spread = df.groupBy(*by).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    return spread.where(F.col("_lo") < F.col("_hi")).select(*by)


def drop_single_class(df: DataFrame, label: str = "label", by: Sequence[str] = ("threshold",)) -> DataFrame:
    """Remove groups with a single class."""
    return df.join(two_class_groups(df, label, by), list(by), "left_semi")
