"""Totals of a whole table beside its rows, and exact quantiles of a whole column in bounded steps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with aggregates over all its rows as columns.

    The aggregate is one row by construction, so broadcasting it is bounded, and the rows never meet in one task as
    they would under a window without a key.
    """
    one = df.agg(*[e.alias(k) for k, e in totals.items()])
    return df.join(F.broadcast(one))


def exact_quantiles(df: DataFrame, value: Column | str, at: Sequence[float], most: int = 200_000) -> list[float | None]:
    """Quantiles of a whole column (linear between neighbours, nulls left out), exact, in one job for all of ``at`` and a
    few more on what lies near them.

    A sketch of bounded size brackets each wanted place of the order, a count tells how many values lie below the
    bracket and in it, and only a bracket of at most ``most`` values is sorted; a larger one is bracketed again.  No
    task holds the values of the whole column.  The driver gets the brackets and the results.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(v.cast("double").alias("v")).where("v IS NOT NULL")
    n = rows.count()
    if not n:
        return [None] * len(at)
    places = sorted({k for q in at for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    found: dict[int, float] = {}
    todo = [(places, None, None, 0, n)]  # places, open bounds, values below the bracket, values in it
    while todo:
        want, lo, hi, below, held = todo.pop()
        part = rows
        if lo is not None:
            part = part.where(F.col("v") >= F.lit(lo))
        if hi is not None:
            part = part.where(F.col("v") <= F.lit(hi))
        if held <= most:
            ordered = part.agg(F.sort_array(F.collect_list("v")).alias("a"))  # ``most`` numbers at most
            found |= dict(zip(want, ordered.select([F.col("a")[k - below].alias(f"v{i}") for i, k in enumerate(want)]).head(), strict=True))
            continue
        share = [F.lit(min(1.0, max(0.0, (k - below) / (held - 1) + d))) for k in want for d in (-2e-4, 2e-4)]
        edges = part.agg(F.percentile_approx("v", F.array(*share), F.lit(20_000)).alias("q")).head()["q"]
        pairs = [(k, edges[2 * i], edges[2 * i + 1]) for i, k in enumerate(want)]
        told = part.agg(*[x.alias(f"{s}{i}") for i, (_, a, b) in enumerate(pairs) for s, x in (("b", F.count_if(F.col("v") < F.lit(a))), ("h", F.count_if(F.col("v").between(F.lit(a), F.lit(b)))))]).head()
        for i, (k, a, b) in enumerate(pairs):
            under, inside = below + told[f"b{i}"], told[f"h{i}"]
            if a == b and under <= k < under + inside:
                found[k] = float(a)
            elif under <= k < under + inside and inside < held:
                todo.append(([k], a, b, under, inside))
            else:  # the sketch missed the place: the values below or above the bracket hold it
                todo.append(([k], lo, a, below, told[f"b{i}"] + part.where(F.col("v") == F.lit(a)).count()) if k < under else ([k], b, hi, under + inside - part.where(F.col("v") == F.lit(b)).count(), held - (under - below) - inside + part.where(F.col("v") == F.lit(b)).count()))
    out = []
    for q in at:
        p = q * (n - 1)
        a, b = found[math.floor(p)], found[math.ceil(p)]
        out.append(a + (b - a) * (p - math.floor(p)))
    return out
