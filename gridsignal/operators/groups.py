"""Attach per-group aggregates to rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.session import settle

SALTS = 8


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of rows with a table of one row per group in which missing keys match each other."""
    if not keys:
        raise ValueError("name the keys: without any, every row would meet every other")
    renamed = groups.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"_of_{k}" for k in keys])


def attach(df: DataFrame, by: Sequence[str], aggs: dict[str, Column], source: DataFrame | None = None) -> DataFrame:
    """Add group aggregates as columns: partial aggregation and an equi-join, never a window over the whole group.

    Missing keys are a group of their own. Without keys the aggregates are one row and become a scalar subquery.
    ``source`` is the frame to aggregate (default: ``df`` itself). With keys the group table is written when called, so
    that its size is known: Spark carries a small one to the rows. Where it is too large for that, the rows of a group
    are dealt to ``SALTS`` tasks, each with its own copy of the group's values.
    """
    source = df if source is None else source
    if by:
        groups = settle(source.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]))
        copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        return join_groups(salted, copies, [*by, "_salt"]).drop("_salt")
    row = source.agg(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("_row")).scalar()
    packed = df.withColumn("_row", row)
    return packed.withColumns({n: F.col("_row")[n] for n in aggs}).drop("_row")
