"""Scalar expressions on columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion offset and scale, missing-value floors, time fill value, default time unit and epoch.
KELVIN_OFFSET = -273.15
MEGA = 1e-6
INDEX_FLOOR = -9999.0
TRANSPORT_FLOOR = -99999.0
TIME_FILL = 1e20
DEFAULT_TIME_UNIT = "seconds"
DEFAULT_EPOCH = "1970-01-01"

_UNIT_MICROS = {"seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}


def convert_units(column: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Affine unit conversion."""
    return column * F.lit(scale) + F.lit(offset)


def null_if_nan(column: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it and comparisons do not take it for a large number."""
    return F.when(~F.isnan(column), column)


def above_floor(column: Column, floor: float = INDEX_FLOOR) -> Column:
    """Keep values strictly above a sentinel floor; the sentinel and NaN become NULL."""
    return F.when((column > F.lit(floor)) & ~F.isnan(column), column)


def decode_cf_time(
    column: Column,
    unit: str = DEFAULT_TIME_UNIT,
    epoch: str = DEFAULT_EPOCH,
    calendar: str = "proleptic_gregorian",
) -> Column:
    """Numeric "units since epoch" time to TIMESTAMP; fill values above 1e20 and NaN become NULL."""
    if calendar not in ("proleptic_gregorian", "standard", "gregorian"):
        raise ValueError(f"calendar {calendar!r} is not supported")
    if unit not in _UNIT_MICROS:
        raise ValueError(f"time unit {unit!r} is not supported; use one of {sorted(_UNIT_MICROS)}")
    start = dt.datetime.fromisoformat(epoch)
    if calendar != "proleptic_gregorian" and start < dt.datetime(1582, 10, 15):
        raise ValueError("an epoch before 1582-10-15 is only supported in the proleptic calendar")
    base = (start - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    valid = F.when((column <= F.lit(TIME_FILL)) & ~F.isnan(column), column.cast("double"))
    whole = F.floor(valid)  # split so that large day counts keep microsecond precision
    micros = whole * F.lit(_UNIT_MICROS[unit]) + F.round((valid - whole) * F.lit(_UNIT_MICROS[unit])).cast("long")
    return F.timestamp_micros(micros + F.lit(base))


def normalize_day(ts: Column) -> Column:
    """Midnight of the day."""
    return F.date_trunc("DAY", ts)


def micros(ts: Column) -> Column:
    """Timestamp as whole microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def above(p: Column, threshold: float = 0.5) -> Column:
    """Hard prediction from a probability: strictly above the cut."""
    return (p > F.lit(threshold)).cast("int")


def threshold_label(x: Column, threshold: Column | float) -> Column:
    """Plain weak-state label: 1 below the threshold, 0 otherwise and where missing."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce((x < limit).cast("int"), F.lit(0))


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Banker's rounding, as used for report values."""
    return F.bround(x, digits)


def interaction(a: Column, b: Column) -> Column:
    """Product feature."""
    return a * b


def mean_abs(values: Column) -> Column:
    """Mean of absolute values of a numeric array."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.abs(v)) / F.size(values)


def threshold_name(threshold: Column) -> Column:
    """Threshold as text with one decimal."""
    return F.format_string("%.1f", F.bround(threshold, 1))


def component_name(index: Column) -> Column:
    """Name of a component with 0-based index: PC1, PC2, ..."""
    return F.concat(F.lit("PC"), (index + 1).cast("string"))


def wrap_index(index: Column, width: Column | int) -> Column:
    """Feature index wrapped into ``0 .. width - 1``."""
    return F.pmod(index, F.lit(width) if isinstance(width, int) else width)


def as_index_list(index: Column) -> Column:
    """A single feature index as a one-element list."""
    return F.array(index)


def fit_length(values: Column, n: int) -> Column:
    """Array cut or filled with zeros to ``n`` entries."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)
