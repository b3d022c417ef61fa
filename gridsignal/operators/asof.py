"""Nearest as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridsignal.operators.groups import join_groups
from gridsignal.operators.ordering import chunk_of, range_chunks


def _carried(both: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per chunk the last right row before it and the first after it."""
    edges = both.groupBy(*by, "_chunk").agg(
        F.max_by("_r", F.col("_r._at")).alias("_last"), F.min_by("_r", F.col("_r._at")).alias("_first")
    )
    up = W.partitionBy(*by).orderBy(F.col("_chunk").asc()).rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*by).orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, -1)
    return edges.select(
        *by,
        "_chunk",
        F.last("_last", ignorenulls=True).over(up).alias("_carry_prev"),
        F.last("_first", ignorenulls=True).over(down).alias("_carry_next"),
    )


def neighbours(
    left: DataFrame, right: DataFrame, values: Sequence[str], on: str, by: Sequence[str], grain: str | float | None
) -> DataFrame:
    """Left rows with ``_p`` and ``_n``: the last right row at or before and the first at or after, as structs.

    Both sides are put into one stream and cut into chunks of the sort key (see ``with_position`` for ``grain``). Inside a chunk the neighbours come from two
    growing windows; neighbours beyond the chunk come from a table with the first and last right row of each chunk.
    No range join, no pair is ever formed, and a long series is spread over its chunks.
    """
    by = list(by)
    row = F.struct(F.col(on).alias("_at"), *values)
    sides = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(right.select(row).schema[0].dataType)})
    both = sides.unionByName(right.select(*by, on, F.lit(0).alias("_side"), row.alias("_r")), allowMissingColumns=True)
    if grain is None:
        both = range_chunks(both, [*by, on, "_side"])
    else:
        both = both.withColumn("_chunk", chunk_of(on, grain))

    parts = [*by, "_chunk"]
    both = join_groups(both, _carried(both, by), parts)
    inside = W.partitionBy(*parts).rowsBetween(W.unboundedPreceding, W.currentRow)
    prev = F.last("_r", ignorenulls=True).over(inside.orderBy(F.col(on).asc(), F.col("_side").asc()))
    following = F.last("_r", ignorenulls=True).over(inside.orderBy(F.col(on).desc(), F.col("_side").asc()))
    return (
        both.withColumns({"_p": prev, "_n": following})
        .where(F.col("_side") == 1)
        .withColumns({"_p": F.coalesce("_p", "_carry_prev"), "_n": F.coalesce("_n", "_carry_next")})
        .withColumn("_n", F.when(F.col("_p._at") == F.col(on), F.col("_p")).otherwise(F.col("_n")))
    )


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    on: str = "ts",
    by: Sequence[str] = (),
    grain: str | float | None = None,
    tolerance: float | None = None,
    ties: str = "later",
    extrapolate: bool = True,
    unique_left: bool = False,
) -> DataFrame:
    """Give every left row the ``values`` of the right row with the nearest ``on``.

    * Missing keys match each other; a left row without a stamp is kept and has no match.
    * ``right`` holds one row per key and ``on``; a missing value at the nearest stamp is taken as it is, not skipped.
    * Equal distance goes to the later stamp, or to the earlier one with ``ties="earlier"``.
    * ``tolerance`` (seconds for time stamps, plain units for numbers) turns farther matches into NULL.
    * ``extrapolate=False`` gives NULL outside the range of the right side.
    * Left rows are matched through their distinct stamps, so a stamp shared by very many rows is ranked once;
      ``unique_left=True`` says that stamps are unique already.
    """
    by = list(by)
    if not unique_left:
        stamps = left.select(*by, on).distinct()
        found = asof_nearest(stamps, right, values, on, by, grain, tolerance, ties, extrapolate, unique_left=True)
        return join_groups(left, found, [*by, on], "left").select(*left.columns, *values)
    fields = left.columns
    timed = left.schema[on].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    joined = neighbours(left, right.where(F.col(on).isNotNull()), values, on, by, grain)

    def gap(side: str):
        if timed:
            return F.abs(
                F.unix_micros(F.col(on).cast("timestamp")) - F.unix_micros(F.col(f"{side}._at").cast("timestamp"))
            )
        return F.abs(F.col(on) - F.col(f"{side}._at"))

    later = (gap("_n") <= gap("_p")) if ties == "later" else (gap("_n") < gap("_p"))
    near = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p"))
    near = near.when(later, F.col("_n")).otherwise(F.col("_p"))
    picked = joined.withColumn("_near", F.when(F.col(on).isNotNull(), near))
    if not extrapolate:
        within = F.col("_p").isNotNull() & F.col("_n").isNotNull()
        picked = picked.withColumn("_near", F.when(within, F.col("_near")))
    if tolerance is not None:
        limit = F.lit(int(tolerance * 1_000_000)) if timed else F.lit(tolerance)
        picked = picked.withColumn("_near", F.when(gap("_near") <= limit, F.col("_near")))
    return picked.select(*fields, *[F.col("_near")[v].alias(v) for v in values])
