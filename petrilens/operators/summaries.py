"""Aggregates, windows, ordering and reshaping of measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.functions.broadcasts import with_totals
from petrilens.functions.quantiles import _join as join_keys
from petrilens.functions.quantiles import _maybe_broadcast as maybe_broadcast
from petrilens.functions.quantiles import group_quantiles
from petrilens.operators.graph import cut, dense_ids


def describe_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, sd, se, min, max, sum per group; ``n`` and so ``se`` count rows with a null value too."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"),
        (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"),
    )


def positive_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Smallest positive, largest and mean value per group."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(value) > 0, F.col(value))).alias("min_positive"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def two_level_mean(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Mean of the inner groups' means."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("n_inner"))


def best_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in an order that ends in a key, so that it is total."""
    return nth_row(df, keys, 1, *order)


def nth_row(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == n).drop("_rn")


def box_summary(df: DataFrame, keys: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last rows within ``k`` quartile distances, and the rows beyond them."""
    q = group_quantiles(df, keys, value, (0.25, 0.5, 0.75))
    d = df.join(q, list(keys))
    low, high = F.element_at("q", 1), F.element_at("q", 3)
    inside = F.col(value).between(low - k * (high - low), high + k * (high - low))
    return d.groupBy(*keys).agg(
        F.first(F.element_at("q", 1)).alias("q1"), F.first(F.element_at("q", 2)).alias("median"), F.first(F.element_at("q", 3)).alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"),
    )


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per bin of equal width between the smallest and largest value of the group, empty bins too; the last
    bin holds its right end.  Columns: keys, bin (from 0), bin_low, bin_high, n."""
    if keys:
        ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        d = df.join(ends, list(keys))
    else:
        ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        d = with_totals(df, _lo=F.min(value), _hi=F.max(value))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = d.where(F.col(value).isNotNull()).withColumn("bin", at).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*keys, "bin"], "left")
    return out.select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_high"), F.coalesce("_n", F.lit(0)).alias("n"))


def otsu(df: DataFrame, value: str, keys: Sequence[str], bins: int = 256) -> DataFrame:
    """Threshold per group: the middle of the bin with the largest between-class variance, ties to the lower bin."""
    h = histogram(df, value, bins, keys).withColumn("mid", (F.col("bin_low") + F.col("bin_high")) / 2)
    all_of, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("p", F.col("n") / F.sum("n").over(all_of))
    h = h.withColumn("w", F.sum("p").over(upto)).withColumn("m", F.sum(F.col("p") * F.col("mid")).over(upto)).withColumn("mt", F.sum(F.col("p") * F.col("mid")).over(all_of))
    between = F.coalesce(F.try_divide(F.pow(F.col("mt") * F.col("w") - F.col("m"), F.lit(2)), F.col("w") * (1 - F.col("w"))), F.lit(0.0))
    between = F.when((F.col("w") <= 1e-12) | (F.col("w") >= 1 - 1e-12), F.lit(0.0)).otherwise(between)
    return h.groupBy(*keys).agg(F.max_by("mid", F.struct(F.round(between, 9), -F.col("bin"))).alias("threshold"))


def otsu_trimmed(df: DataFrame, value: str, keys: Sequence[str], bins: int = 256, trim: float = 0.001) -> DataFrame:
    """Threshold per group from its values between the ``trim`` and 1 - ``trim`` quantiles; a group with fewer such values
    than ``bins`` has their mean."""
    ends = group_quantiles(df, keys, value, (trim, 1 - trim), "_q")
    d = df.join(ends, list(keys)).where(F.col(value).between(F.element_at("_q", 1), F.element_at("_q", 2))).drop("_q")
    mean = d.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    return mean.join(otsu(d, value, keys, bins), list(keys)).select(*keys, F.when(F.col("_n") < bins, F.col("_mean")).otherwise(F.col("threshold")).alias("threshold"))


def cluster_summary(df: DataFrame, keys: Sequence[str], *, distance: str, intensity: str, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Per cluster: mean distance, total intensity, pixels, intensity per pixel, centroid; nulls don't count."""
    total, n = F.coalesce(F.sum(intensity), F.lit(0.0)), F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.avg(distance).alias("mean_distance"), total.alias("total_intensity"), n.alias("area_pixels"), (total / n).alias("intensity_density"), F.avg(xy[0]).alias("cluster_centroid_x"), F.avg(xy[1]).alias("cluster_centroid_y"),
    )


def weighted_focus(df: DataFrame, weights: dict[str, float], keys: Sequence[str], fallback: str, out: str = "focus") -> DataFrame:
    """Adds the weighted sum of the robust z of several scores within the group; where a score is null, the robust z of
    ``fallback``."""
    names = list(dict.fromkeys([*weights, fallback]))
    d = robust_zs(df, {n: f"_z{i}" for i, n in enumerate(names)}, keys)
    z = lambda n: F.col(f"_z{names.index(n)}")
    total = sum((w * z(n) for n, w in weights.items()), F.lit(0.0))
    return d.withColumn(out, F.coalesce(total, z(fallback))).drop(*[f"_z{i}" for i in range(len(names))])


def histogram_gap(df: DataFrame, value: str, bins: int = 100, share: float = 0.1) -> DataFrame:
    """One row ``cutoff``: the low end of the first bin after which the count falls by more than ``share`` of the
    largest count; null if none does."""
    h = histogram(df, value, bins)
    w = Window.partitionBy().orderBy("bin")  # as many rows as bins
    h = h.withColumn("_fall", F.col("n") - F.lead("n").over(w)).withColumn("_most", F.max("n").over(Window.partitionBy()))
    return h.agg(F.min(F.when(F.col("_fall") > share * F.col("_most"), F.col("bin_low"))).alias("cutoff"))


def min_max(value: str, keys: Sequence[str]) -> Column:
    """(x - min) / (max - min) of the group, 0 for a constant one."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))


def robust_z(df: DataFrame, value: str, keys: Sequence[str], out: str, eps: float = 1e-9) -> DataFrame:
    """Adds (x - median) / (MAD + eps) within the group."""
    return robust_zs(df, {value: out}, keys, eps)


def robust_zs(df: DataFrame, values: dict[str, str], keys: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """Adds (x - median) / (MAD + eps) within the group for every column named, under the name beside it.  The medians of
    all columns come from the same passes, over narrow rows (keys, column, value) in checkpoint, and so do the MADs."""
    g = {k: f"_k{i}" for i, k in enumerate(keys)}
    long = F.array(*[F.struct(F.lit(i).alias("which"), F.col(n).cast("double").alias("v")) for i, n in enumerate(values)])
    rows = cut(df.select(*[F.col(k).alias(n) for k, n in g.items()], F.inline(long)).where("v is not null"))
    at = [*g.values(), "which"]
    med = cut(group_quantiles(rows, at, "v", (0.5,), "_q").select(*at, F.col("_q")[0].alias("_med")))
    off = cut(join_keys(rows, maybe_broadcast(med), at).withColumn("v", F.abs(F.col("v") - F.col("_med"))).drop("_med"))
    mad = group_quantiles(off, at, "v", (0.5,), "_q").select(*at, F.col("_q")[0].alias("_mad"))
    one = lambda i, c: F.max(F.when(F.col("which") == i, F.col(c))).alias(f"{c}{i}")
    told = join_keys(med, mad, at).groupBy(*g.values()).agg(*[one(i, c) for i in range(len(values)) for c in ("_med", "_mad")])
    told = told.withColumnsRenamed({n: k for k, n in g.items()})
    d = join_keys(df, maybe_broadcast(cut(told)), keys, "left")
    d = d.withColumns({out: (F.col(n) - F.col(f"_med{i}")) / (F.col(f"_mad{i}") + eps) for i, (n, out) in enumerate(values.items())})
    return d.drop(*[f"{c}{i}" for i in range(len(values)) for c in ("_med", "_mad")])


def z_score(value: str, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))


def composite_best(df: DataFrame, keys: Sequence[str], parts: Sequence[tuple[str, float]], *, edge: str | None = None, edge_weight: float = 1.0, order: Sequence[Column] = ()) -> DataFrame:
    """The row of each group with the best score: the weighed parts, each min-max normalised in its group, less
    ``edge_weight`` at the edge; ties by ``order``, which ends in a key.  Parts that the table lacks count 0."""
    score = F.lit(0.0)
    for n, weight in parts:
        if n in df.columns:
            score = score + weight * min_max(n, keys)
    if edge and edge in df.columns:
        score = score - F.when(F.col(edge), F.lit(edge_weight)).otherwise(0.0)
    return best_row(df.withColumn("composite_score", score), keys, F.desc("composite_score"), *order)


def trailing_mean(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str, width: int | None = None) -> DataFrame:
    """Adds the mean of the last ``width`` rows of the series; by default a fiftieth of the series, 10 at least."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if width is not None:
        return df.withColumn(out, F.avg(value).over(w.rowsBetween(-(width - 1), 0)))
    n = F.greatest(F.lit(10), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 50))
    d = df.withColumn("_w", n).withColumn("_i", F.row_number().over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(upto)).withColumn("_k", F.count(value).over(upto))
    back = d.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_i").alias("_bi"), F.col("_s").alias("_bs"), F.col("_k").alias("_bk"))
    on = [F.col(k) == F.col(f"_b_{k}") for k in keys] + [F.col("_i") - F.col("_w") == F.col("_bi")]
    j = d.join(back, on, "left")
    mean = F.try_divide(F.col("_s") - F.coalesce("_bs", F.lit(0.0)), F.col("_k") - F.coalesce("_bk", F.lit(0)))
    return j.withColumn(out, mean).select(*df.columns, out)


def rolling_mode(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str, half: int = 1) -> DataFrame:
    """Adds the most frequent value of the rows around, the frame cut at the ends; ties to the smallest."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    seen = F.collect_list(value).over(w)
    counted = F.transform(F.array_distinct("_seen"), lambda v: F.struct((-F.size(F.filter("_seen", lambda x: x == v))).alias("n"), v.alias("v")))
    return df.withColumn("_seen", seen).withColumn(out, F.array_min(counted)["v"]).drop("_seen")


def long_to_wide(df: DataFrame, keys: Sequence[str], names: str, values: Sequence[str], listed: Sequence[str], sep: str = " | ", fill=None) -> DataFrame:
    """One row per key; one column per listed name and value (named ``value | name`` if there are several values)."""
    made = [F.max(F.when(F.col(names) == n, F.col(v))).alias(n if len(values) == 1 else f"{v}{sep}{n}") for v in values for n in listed]
    out = df.groupBy(*keys).agg(*made)
    return out if fill is None else out.fillna(fill)


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Tables under each other by column name, missing columns null, with the name of each in ``tag``."""
    out = None
    for name, df in parts.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def normalised_tables(flat: DataFrame, *, experiment: Sequence[str], cell: Sequence[str], measures: Sequence[str], row: Sequence[str]) -> dict[str, DataFrame]:
    """The tables experiments, cells and measurements of a flat one.  Ids are 1, 2, ... in the order of the columns that
    name an experiment, a cell (beside its experiment) and a row; cells point to experiments, measurements to cells.  Few
    experiments (or cells), counted, are broadcast: as keys of a join they would deal all rows to as many tasks."""
    exp = maybe_broadcast(cut(dense_ids(flat.select(*experiment).distinct().withColumn("_k", F.struct(*experiment)), "_k", "experiment_id").drop("_k")))
    d = flat.join(exp, list(experiment))
    names = ["experiment_id", *cell]
    cells = maybe_broadcast(cut(dense_ids(d.select(*names).distinct().withColumn("_k", F.struct(*names)), "_k", "cell_id").drop("_k")))
    d = d.join(cells, names)
    made = dense_ids(d.withColumn("_k", F.struct("cell_id", *row)), "_k", "measurement_id").drop("_k")
    return {"experiments": exp.select("experiment_id", *experiment), "cells": cells.select("cell_id", *names), "measurements": made.select("measurement_id", "cell_id", *measures)}


def with_object_id(df: DataFrame, t: str, order: Sequence[str], out: str) -> DataFrame:
    """Adds ids such as t003_obj0042: the frame and the row's number in the whole table, from 0, in the order of the
    columns ``order``, which name a row.  Rows are numbered per range, so no task sees them all."""
    d = dense_ids(df.withColumn("_order", F.struct(*order)), "_order", "_number").drop("_order")
    return d.withColumn(out, F.format_string("t%03d_obj%04d", F.col(t), F.col("_number") - 1)).drop("_number")


def key_violations(df: DataFrame, key: Sequence[str], parent: DataFrame | None = None, parent_key: Sequence[str] | None = None) -> DataFrame:
    """One row: rows with a null key, keys that occur twice or more, and keys without a parent row."""
    nulls = df.where(" OR ".join(f"{k} IS NULL" for k in key)).agg(F.count(F.lit(1)).alias("null_keys"))
    twice = df.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_keys"))
    out = nulls.join(F.broadcast(twice))
    if parent is not None:
        names = list(parent_key or key)
        p = parent.select(*[F.col(k).alias(f"_p_{k}") for k in names]).distinct()
        on = [F.col(k) == F.col(f"_p_{k}") for k in names]
        orphans = df.where(" AND ".join(f"{k} IS NOT NULL" for k in names)).join(p, on, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
        out = out.join(F.broadcast(orphans))
    return out
