"""Exact quantiles inside groups of any size, by counting passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.operators.graph import cut

#: Values of a group up to which Spark's own aggregate, which holds them all in one task, is used.
MOST = 100_000
#: Bins of a counting pass, and values of a bin that are sorted.
BINS, FINAL = 1024, 10_000


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls equal; ``right`` has no other column of ``left``."""
    names = {k: f"_right_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True))
    return left.join(r, on, how).drop(*names.values())


def _maybe_broadcast(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df``, narrow rows in checkpoint, with a broadcast hint if at most ``most`` are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def group_quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, at: Sequence[float] | DataFrame, out: str = "q") -> DataFrame:
    """(keys, ``out``): the quantiles ``at`` (linear between neighbours, nulls left out) of every group that has values,
    as an array.  ``at`` may be a table (keys, at: array) with quantiles of its own for each group.

    The values of a group over ``MOST`` are never brought together: a pass counts them in ``BINS`` bins between the ends
    of the bracket (first the group's own) of each wanted place of the order, and the bin that holds the place is the
    next bracket, until it holds one distinct value or at most ``FINAL`` values, which are sorted.
    """
    g, v = [f"_g{i}" for i in range(len(keys))], F.col(value) if isinstance(value, str) else value
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, g, strict=True)], v.cast("double").alias("_v")).where("_v is not null")
    sizes = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    own = isinstance(at, DataFrame)
    if own:
        sizes = _join(sizes, at.select(*[F.col(k).alias(n) for k, n in zip(keys, g, strict=True)], "at"), g)
    else:
        sizes = sizes.withColumn("at", F.array(*map(F.lit, map(float, at))))
    sizes = cut(sizes)
    large = cut(sizes if own else sizes.where(F.col("n") > MOST))
    back = [F.col(n).alias(k) for k, n in zip(keys, g, strict=True)]
    plain = None
    if not own:
        few = rows if large.isEmpty() else _join(rows, _maybe_broadcast(large.select(*g)), g, "left_anti")
        plain = few.groupBy(*g).agg(F.percentile("_v", F.array(*map(F.lit, map(float, at)))).alias(out)).select(*back, out)
        if large.isEmpty():
            return plain

    place = F.transform("at", lambda q: q * (F.col("n") - 1))
    wanted = cut(large.select(*g, "n", "lo", "hi", F.posexplode(place).alias("i", "p")))
    ends = F.array(F.floor("p"), F.ceil("p"))
    todo = cut(wanted.select(*g, F.explode(ends).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held")).distinct())
    found = None
    while True:
        solved = todo.where("lo = hi").select(*g, "k", F.col("lo").alias("value"))
        sortable = todo.where(f"lo < hi and held <= {FINAL}")
        spans = _maybe_broadcast(sortable.select(*g, "lo", "hi").distinct())
        inside = _join(rows, spans, g).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        ordered = inside.groupBy(*g, "lo", "hi").agg(F.sort_array(F.collect_list("_v")).alias("a"))  # ``FINAL`` numbers at most
        picked = _join(sortable, ordered, [*g, "lo", "hi"]).select(*g, "k", F.expr("a[cast(k - below as int)]").alias("value"))
        got = cut(solved.union(picked))
        found = got if found is None else found.union(got)
        todo = todo.where(f"lo < hi and held > {FINAL}")
        if todo.isEmpty():
            break
        spans = _maybe_broadcast(cut(todo.select(*g, "lo", "hi").distinct()))
        inside = _join(rows, spans, g).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        part = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: the width stays finite
        counts = inside.groupBy(*g, "lo", "hi", F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo2"), F.max("_v").alias("hi2"))
        w = Window.partitionBy(*g, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # ``BINS`` rows at most
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
        there = F.col("k") - F.col("below") - F.col("before")
        todo = _join(todo, counts, [*g, "lo", "hi"]).where((there >= 0) & (there < F.col("c")))
        todo = cut(todo.select(*g, "k", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("held")))

    found = cut(found)
    side = lambda k: found.select(*g, F.col("k").alias(f"_{k}"), F.col("value").alias(k))
    both = _join(wanted.withColumn("_a", F.floor("p")).withColumn("_b", F.ceil("p")), side("a"), [*g, "_a"])
    both = _join(both, side("b"), [*g, "_b"])
    between = F.when(F.col("_a") == F.col("_b"), F.col("a")).otherwise((F.col("_b") - F.col("p")) * F.col("a") + (F.col("p") - F.col("_a")) * F.col("b"))
    made = both.groupBy(*g).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", between.alias("q")))), lambda x: x["q"]).alias(out)).select(*back, out)
    return made if plain is None else plain.union(made)


def with_group_quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, **at: float) -> DataFrame:
    """``df`` with a column a named quantile of its group, null where the group has no values."""
    q = group_quantiles(df, keys, value, list(at.values()), "_q").select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(at)])
    return _join(df, q, keys, "left")
