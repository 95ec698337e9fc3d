"""Nearest seed of every cell of a plane, exact, in two passes whose cost does not depend on how far the seed lies.

The first pass is two running windows along columns.  The second takes, on every row, the lowest of the parabolas that
stand on the columns: their lowest index grows with x, so halving the cells of a row over and over looks at each parabola
about once a level.  A task holds a block of rows of one plane.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 64  # rows of a plane in one task


def lowest(line: np.ndarray, x: np.ndarray, seed_line: np.ndarray, seed_x: np.ndarray, height: np.ndarray, scale: int) -> np.ndarray:
    """For every cell (sorted by line, x) the index of the first seed (sorted likewise) of its line with the least
    scale * (x - seed_x)^2 + height; -1 on a line without seeds."""
    first, last = np.searchsorted(seed_line, line, "left"), np.searchsorted(seed_line, line, "right") - 1
    start = np.searchsorted(line, line, "left")
    place, count = np.arange(len(line)) - start + 1, np.searchsorted(line, line, "right") - start
    best = np.full(len(line), -1, np.int64)
    step = 1 << int(place.max(initial=1)).bit_length()
    while step:
        at = np.flatnonzero((place % (2 * step) == step) & (first <= last))
        if len(at):
            before, after = at[place[at] > step], at[place[at] + step <= count[at]]
            low, high = first.copy(), last.copy()
            low[before], high[after] = best[before - step], best[after + step]
            low, sizes = low[at], high[at] - low[at] + 1
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(at)), sizes)
            seed = np.arange(len(owner)) + (low - starts)[owner]
            cost = scale * (x[at][owner] - seed_x[seed]) ** 2 + height[seed]
            hit = np.flatnonzero(cost == np.minimum.reduceat(cost, starts)[owner])
            best[at] = seed[hit[np.searchsorted(owner[hit], np.arange(len(at)))]]
        step //= 2
    return best


def nearest_seed(cells: DataFrame, plane: Sequence[str], seed: str, apart: Sequence[str] = ()) -> DataFrame:
    """``cells`` (plane, apart, y, x in whole numbers, ``seed``: null where a cell is no seed) with the nearest seed of
    the same plane and ``apart`` (ties: the least seed) and its ``distance``; both null where there is none.  The cells
    are the whole plane, or at least, with every cell, those between it and its nearest seed along its row."""
    column = Window.partitionBy(*plane, *apart, "x")
    mark = F.when(F.col(seed).isNotNull(), F.struct(F.col("y").alias("at"), F.col(seed).alias("seed")))
    d = cells.select(*plane, *apart, "y", "x", mark.alias("_mark"))
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.pow(F.col("y") - F.col(f"{side}.at"), F.lit(2)).cast("long").alias("g"), F.col(f"{side}.seed").alias("seed")))
    for side, order in (("_up", F.col("y").asc()), ("_down", F.col("y").desc())):
        d = d.withColumn(side, F.last("_mark", ignorenulls=True).over(column.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_near", F.least(far("_up"), far("_down")))
    d = d.select(*plane, *apart, "y", "x", F.col("_near.g").alias("_g"), F.col("_near.seed").alias(seed), F.floor(F.col("y") / ROWS).alias("_block"))
    kinds, keep = dict(d.dtypes), [*plane, *apart, "y", "x"]

    def rows(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*apart, "y", "x")])
        new = np.zeros(table.num_rows, bool)
        for c in (*apart, "y"):
            codes = pc.fill_null(table[c].combine_chunks().dictionary_encode().indices, -1).to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        line, x = np.cumsum(new), table["x"].to_numpy().astype(np.int64)
        seen = table["_g"].is_valid()
        seeds, g, at = table[seed].filter(seen), table["_g"].filter(seen).to_numpy().astype(np.int64), np.flatnonzero(seen.to_numpy())
        if not len(at):
            return table.select([*keep, seed]).append_column("distance", pa.nulls(table.num_rows, pa.float64()))
        rank = pc.rank(seeds.combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        scale = int(rank.max()) + 1
        got = lowest(line, x, line[at], x[at], scale * g + rank, scale)
        distance = np.sqrt((x - x[at][got]) ** 2.0 + g[got])
        out = table.select(keep).append_column(seed, seeds.take(pa.array(got, mask=got < 0)))
        return out.append_column("distance", pa.array(distance, mask=got < 0))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, seed)) + ", distance double"
    return d.groupBy(*plane, "_block").applyInArrow(rows, schema)
