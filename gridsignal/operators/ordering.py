"""Order-dependent building blocks that never hold a whole series in one task.

A series may be as long as the data, so a plain ``Window.partitionBy(series)`` would put it into a single task.
Everything ordered in this package goes through one of these shapes instead:

* *two-level running totals*: sort and accumulate inside chunks of the order key, add the chunk offsets, which come
  from a pre-aggregated table with one row per chunk;
* *dense positions*: running totals of ones;
* *halo windows*: cut positions into equal blocks, copy the few rows near a block edge into the neighbour block, and
  run any bounded window per block.

Chunks are contiguous ranges of the order key:

* ``range_chunks``: ranges that Spark samples from the full sort key. Works for any data, also when one key or stamp
  holds a third of all rows, and costs one written table;
* ``chunk_of``: a calendar unit or fixed width, for axes whose resolution bounds the rows in a unit (regular series,
  unique ids).

There is one path for every size. Missing keys and stamps are values like any other and come first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from gridsignal.operators.groups import join_groups
from gridsignal.session import settle

BLOCK_ROWS = 1 << 16


def chunk_of(on: str, grain: str | float) -> Column:
    """Chunk key of an order column: a ``date_trunc`` unit, or a fixed width for numbers."""
    if isinstance(grain, str):
        return F.date_trunc(grain, F.col(on))
    return F.floor(F.col(on) / F.lit(grain)).cast("long")


def range_chunks(df: DataFrame, keys: Sequence[str], out: str = "_chunk") -> DataFrame:
    """Cut rows into ranges of the sort key: the session's shuffle partitions, merged by Spark where they are small.

    The ranges come from a sample of the complete key, so a frequent leading value is split by the columns after it.
    The result is written to the shared folder with its range number: everything after it sees the same ranges.
    """
    return settle(df.repartitionByRange(*keys).withColumn(out, F.spark_partition_id()))


def hash_draw(*parts: Column | int | str) -> Column:
    """Uniform 60-bit integer keyed by the given parts: the same on every engine, partitioning and retry."""
    cells = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cells])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


HASH_SPAN = 1 << 60


def _sorted(columns: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    chunk: str,
    order: Sequence[str],
    totals: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``totals`` (name -> addend) per ``by`` group along ``order``.

    Two levels: per-chunk sums are map-side combined and accumulated over the chunk table (one row per chunk), rows
    are only sorted inside their chunk.
    """
    by = list(by)
    addends = {f"_a_{name}": expr for name, expr in totals.items()}
    df = df.withColumns(addends)
    sums = df.groupBy(*by, chunk).agg(*[F.sum(a).alias(f"_s{a}") for a in addends])
    before = (
        W.partitionBy(*by).orderBy(*_sorted([chunk], descending)).rowsBetween(W.unboundedPreceding, -1)
    )
    base = sums.select(
        *by, chunk, *[F.coalesce(F.sum(f"_s{a}").over(before), F.lit(0)).alias(f"_b{a}") for a in addends]
    )
    inside = (
        W.partitionBy(*by, chunk)
        .orderBy(*_sorted(order, descending))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    out = join_groups(df, base, [*by, chunk])
    out = out.withColumns({name: F.sum(f"_a_{name}").over(inside) + F.col(f"_b_a_{name}") for name in totals})
    return out.drop(*addends, *[f"_b{a}" for a in addends])


def with_position(
    df: DataFrame,
    by: Sequence[str] = ("series_id",),
    on: str | Sequence[str] = "ts",
    grain: str | float | None = None,
    pos: str = "pos",
) -> DataFrame:
    """Dense 0-based position of each row in its series, in the order of ``on`` (unique inside a series).

    Without ``grain`` the rows are written in sampled ranges. ``grain`` is for series whose resolution bounds the rows in
    one unit, such as hours in a day: nothing is written then, but the input is read twice, once for its keys only.
    """
    order = [on] if isinstance(on, str) else list(on)
    if grain is None:
        chunked = range_chunks(df, [*by, *order])
    else:
        chunked = df.withColumn("_chunk", chunk_of(order[0], grain))
    out = running_totals(chunked, by, "_chunk", order, {pos: F.lit(1).cast("long")})
    return out.withColumn(pos, F.col(pos) - 1).drop("_chunk")


def over_blocks(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    back: int,
    ahead: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    rows: int | None = None,
) -> DataFrame:
    """Run window expressions that look at most ``back`` rows behind and ``ahead`` rows ahead.

    ``build`` gets the block frame and a window partitioned by block and ordered by position, and returns the frame
    with its new columns. Rows within ``back`` (``ahead``) of a block edge are copied to the next (previous) block
    and dropped again afterwards, so each task holds one block whatever the length of the series.
    """
    rows = max(rows or BLOCK_ROWS, back, ahead, 1)
    home = F.floor(F.col(pos) / rows)
    inside = F.col(pos) % rows
    homes = [home]
    if back:
        homes.append(F.when(inside >= rows - back, home + 1))
    if ahead:
        homes.append(F.when(inside < ahead, home - 1))
    spread = df.withColumn("_block", F.explode(F.array_compact(F.array(*homes))))
    window = W.partitionBy(*by, "_block").orderBy(pos)
    return build(spread, window).where(F.col("_block") == home).drop("_block")


def smallest_draws(df: DataFrame, by: Sequence[str], draw: str, tie: Sequence[str], quota: DataFrame, out: str) -> DataFrame:
    """Mark, in ``out``, the rows with the smallest ``hash_draw`` of each group, as many as ``quota`` (``by``, ``_quota``) says.

    A histogram of the draws, combined on the map side, shows in which of its ranges the quota ends. Only the rows of
    that range are ranked, about one in ``HASH_BINS``; all others are marked where they are.
    """
    by = list(by)
    binned = df.withColumn("_bin", F.shiftright(draw, 60 - HASH_BITS))
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = join_groups(counts.withColumn("_upto", F.sum("_c").over(upto)), quota, by)
    ends = ends.where(F.col("_upto") >= F.col("_quota")).groupBy(*by).agg(
        F.min("_bin").alias("_end"), F.min_by(F.col("_quota") - F.col("_upto") + F.col("_c"), "_bin").alias("_need")
    )
    placed = join_groups(binned, ends, by)
    clear = placed.where(F.col("_bin") != F.col("_end")).withColumn(out, F.col("_bin") < F.col("_end"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(draw, *tie))
    edge = placed.where(F.col("_bin") == F.col("_end")).withColumn(out, rank <= F.col("_need"))
    return clear.unionByName(edge).drop("_bin", "_end", "_need")


HASH_BITS = 12
HASH_BINS = 1 << HASH_BITS
