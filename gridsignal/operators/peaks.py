"""Local maxima and forward lead times."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.functions.columns import null_if_nan
from gridsignal.operators.ordering import BLOCK_ROWS, over_blocks, running_totals
from gridsignal.operators.windows import SERIES
from gridsignal.session import settle

# Peak height, peak distance and longest accepted lead.
PEAK_HEIGHT = 0.5
PEAK_DISTANCE = 2
MAX_LEAD = 12


def find_peaks(
    df: DataFrame,
    column: str = "p",
    height: float | None = PEAK_HEIGHT,
    distance: int = PEAK_DISTANCE,
    by: Sequence[str] = SERIES,
    pos: str = "pos",
) -> DataFrame:
    """Peaks ``(by, pos, value)``: values above both neighbours, plateaus at their floor middle, ends excluded.

    Runs of equal values are first reduced to one row each; a run is a peak when it is higher than the runs next to
    it. A missing value (NULL or NaN) is a run of its own: there is no peak at or beside it. Two maxima are always two rows apart, so ``distance`` up to 2 removes nothing.
    """

    def starts(block, w):
        before = F.lag(column, 1).over(w)
        first = F.lag(pos, 1).over(w).isNull()
        return block.withColumns({"_before": before, "_start": first | ~before.eqNullSafe(F.col(column))})

    rows = df.select(*by, pos, null_if_nan(F.col(column)).alias(column))
    runs = over_blocks(rows, by, pos, 1, 0, starts).where("_start").drop("_start")
    runs = runs.withColumn("_chunk", F.floor(F.col(pos) / BLOCK_ROWS))
    runs = running_totals(runs, by, "_chunk", [pos], {"_run": F.lit(1).cast("long")}).drop("_chunk")

    def ends(block, w):
        return block.withColumns({"_next": F.lead(pos, 1).over(w), "_after": F.lead(column, 1).over(w)})

    runs = over_blocks(runs, by, "_run", 0, 1, ends)
    peaks = runs.where((F.col(column) > F.col("_before")) & (F.col(column) > F.col("_after")))
    if height is not None:
        peaks = peaks.where(F.col(column) >= height)
    middle = F.floor((F.col(pos) + F.col("_next") - 1) / 2).cast("long")
    peaks = peaks.select(*by, middle.alias(pos), F.col(column).alias("value"))
    return peaks if distance <= 2 else _thin(peaks, distance, by, pos)


def _thin(peaks: DataFrame, distance: int, by: Sequence[str], pos: str) -> DataFrame:
    """Keep peaks at least ``distance`` apart, higher ones first (equal heights: later ones first).

    A peak above all others nearer than ``distance`` stays, and these go. What is left falls into islands: peaks that are
    ``distance`` apart say nothing about each other. Each island is resolved on its own, from its highest peak down. No
    island reaches over a peak that dominates its neighbourhood, so islands are short unless heights rise or fall all along.
    """
    reach = distance - 1
    order = F.struct(F.col("value"), F.col(pos))

    def dominate(block, w):
        near = w.rangeBetween(-reach, reach)
        block = block.withColumn("_won", F.max(order).over(near) == order)
        return block.withColumn("_beaten", F.max("_won").over(near))

    first = settle(over_blocks(peaks, by, pos, 2 * reach, 2 * reach, dominate))

    def begins(block, w):
        return block.withColumn("_first", F.count(F.lit(1)).over(w.rangeBetween(-reach, -1)) == 0)

    undecided = over_blocks(first.where("NOT _won AND NOT _beaten"), by, pos, reach, 0, begins)
    chunked = undecided.withColumn("_chunk", F.floor(F.col(pos) / BLOCK_ROWS))
    islands = running_totals(chunked, by, "_chunk", [pos], {"_island": F.col("_first").cast("long")})
    placed = islands.repartition(*by, "_island").sortWithinPartitions(*by, "_island", pos)
    columns = [*by, pos, "value"]
    rows = placed.select(*columns, "_first")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = np.flatnonzero(table["_first"].to_numpy())
            # the last island may go on in the next batch
            whole = int(starts[-1]) if len(starts) else 0
            yield from kept_in(table.slice(0, whole)).to_batches()
            held = table.slice(whole)
        if held is not None:
            yield from kept_in(held).to_batches()

    def kept_in(table: pa.Table) -> pa.Table:
        at, height = table[pos].to_numpy(), table["value"].to_numpy()
        kept = highest_apart(np.append(np.flatnonzero(table["_first"].to_numpy()), table.num_rows), at, height, distance)
        return table.select(columns).filter(pa.array(kept))

    resolved = rows.mapInArrow(resolve, rows.select(*columns).schema)
    return first.where("_won").select(*columns).unionByName(resolved)


def highest_apart(edges: np.ndarray, at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """For islands of ascending positions between ``edges``: which peaks stay, going from the highest (of equals the later
    one) down and dropping what is nearer than ``distance`` to one that stays."""
    kept = np.zeros(len(at), bool)
    size = np.diff(edges)
    kept[edges[:-1][size == 1]] = True
    for begin, end in zip(edges[:-1][size > 1].tolist(), edges[1:][size > 1].tolist()):
        open_ = np.ones(end - begin, bool)
        places = at[begin:end]
        for i in np.lexsort((places, height[begin:end]))[::-1].tolist():
            if open_[i]:
                kept[begin + i] = True
                low, high = np.searchsorted(places, (places[i] - distance + 1, places[i] + distance))
                open_[low:high] = False
    return kept


def lead_times(
    df: DataFrame,
    peaks: DataFrame,
    label: str = "label",
    max_lead: int = MAX_LEAD,
    by: Sequence[str] = SERIES,
    pos: str = "pos",
) -> DataFrame:
    """Rows from each peak to the first event strictly after it, accepted up to ``max_lead``.

    Only ``max_lead`` rows ahead matter, so this is a bounded window, not a join of peaks with events.
    """

    def build(block, w):
        event = F.min(F.when(F.col(label) == 1, F.col(pos))).over(w.rowsBetween(1, max_lead))
        return block.withColumn("lead", (event - F.col(pos)).cast("int"))

    ahead = over_blocks(df.select(*by, pos, label), by, pos, 0, max_lead, build)
    found = ahead.where(F.col("lead").isNotNull())
    return found.join(peaks.select(*by, pos), [*by, pos], "left_semi").select(*by, pos, "lead")
