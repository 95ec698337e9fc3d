"""Comparison of conditions: tests per bin, adjusted p values, contrasts, analysis of variance, trends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.functions.cdf import f_p, t_p, z_p
from petrilens.functions.columns import stars
from petrilens.functions.quantiles import group_quantiles
from petrilens.operators.summaries import best_row, long_to_wide, nth_row


def welch(df: DataFrame, *, bin: str, condition: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per bin and pair (a, b): n, means, effect b - a, t, df, p, note.  Under two values on a side, an absent side or no
    variance on both leave t and p null, with a note."""
    g = df.where(F.col(value).isNotNull()).groupBy(bin, condition).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    contrasts = df.sparkSession.createDataFrame(list(pairs), "a string, b string")
    side = lambda s: g.select(F.col(bin).alias(f"_bin_{s}"), F.col(condition).alias(f"_c_{s}"), F.col("n").alias(f"n_{s}"), F.col("m").alias(f"mean_{s}"), F.col("v").alias(f"_v_{s}"))
    grid = g.select(bin).distinct().join(F.broadcast(contrasts))
    d = grid.join(side("a"), (F.col(bin) == F.col("_bin_a")) & (F.col("a") == F.col("_c_a")), "left").join(side("b"), (F.col(bin) == F.col("_bin_b")) & (F.col("b") == F.col("_c_b")), "left")
    n = [F.coalesce(f"n_{s}", F.lit(0)) for s in "ab"]
    se = [F.col(f"_v_{s}") / F.col(f"n_{s}") for s in "ab"]
    note = F.when((n[0] == 0) | (n[1] == 0), "one group").when((n[0] < 2) | (n[1] < 2), "too few values").when((F.col("_v_a") == 0) & (F.col("_v_b") == 0), "no variance")
    t = F.when(note.isNull(), F.try_divide(F.col("mean_b") - F.col("mean_a"), F.sqrt(se[0] + se[1])))
    dof = F.when(note.isNull(), F.try_divide(F.pow(se[0] + se[1], F.lit(2)), F.pow(se[0], F.lit(2)) / (F.col("n_a") - 1) + F.pow(se[1], F.lit(2)) / (F.col("n_b") - 1)))
    d = d.select(bin, "a", "b", n[0].alias("n_a"), n[1].alias("n_b"), "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("effect"), t.alias("t"), dof.alias("df"), note.alias("note"))
    return d.withColumn("p", t_p("t", "df"))


def rank_sum(df: DataFrame, *, bin: str, condition: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per bin and pair: n, u of side a, z with the tie and continuity corrections, p, difference of medians b - a.

    Equal values are counted before they are ranked, so a window holds a pair's distinct values and not its rows.
    """
    d = df.where(F.col(value).isNotNull())
    contrasts = d.sparkSession.createDataFrame(list(pairs), "a string, b string")
    cells = d.groupBy(bin, condition, value).agg(F.count(F.lit(1)).alias("_k"))
    j = cells.join(F.broadcast(contrasts), (F.col(condition) == F.col("a")) | (F.col(condition) == F.col("b")))
    v = j.groupBy(bin, "a", "b", value).agg(F.sum(F.when(F.col(condition) == F.col("a"), F.col("_k")).otherwise(0)).alias("_ka"), F.sum("_k").alias("_k"))
    w = Window.partitionBy(bin, "a", "b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("rank", F.sum("_k").over(w) - (F.col("_k") - 1) / 2)
    g = v.groupBy(bin, "a", "b").agg(F.sum("_ka").alias("n_a"), (F.sum("_k") - F.sum("_ka")).alias("n_b"), F.sum(F.col("_ka") * F.col("rank")).alias("_w"), F.sum(F.pow(F.col("_k").cast("double"), F.lit(3)) - F.col("_k")).alias("_t"))
    n = F.col("n_a") + F.col("n_b")
    u = F.col("_w") - F.col("n_a") * (F.col("n_a") + 1) / 2
    mean = F.col("n_a") * F.col("n_b") / 2
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.try_divide(F.col("_t"), (n * (n - 1)).cast("double"))))
    g = g.withColumn("u", u).withColumn("_d", F.col("u") - mean)
    g = g.withColumn("z", F.try_divide(F.col("_d") - F.signum("_d") * 0.5, sd))
    g = g.withColumn("p", F.least(F.lit(1.0), z_p("z"))).where("n_a > 0 AND n_b > 0")
    med = group_quantiles(d, (bin, condition), value, (0.5,)).select(bin, condition, F.col("q")[0].alias("_m"))
    for s in "ab":
        g = g.join(med.select(F.col(bin).alias(f"_x{s}"), F.col(condition).alias(f"_y{s}"), F.col("_m").alias(f"_m{s}")), (F.col(bin) == F.col(f"_x{s}")) & (F.col(s) == F.col(f"_y{s}")))
    return g.select(bin, "a", "b", "n_a", "n_b", "u", "z", "p", (F.col("_mb") - F.col("_ma")).alias("median_difference"))


def adjust_bh(df: DataFrame, family: Sequence[str], p: str, key: Sequence[str] = (), out: str = "p_adj") -> DataFrame:
    """Adds Benjamini-Hochberg p values within a family; null p values stay null and don't count.

    Equal p values share the adjusted one (that of the last rank among them), so the windows hold a family's distinct
    p values, and both run from one end.  The result does not depend on ``key``, the order of rows with equal p values."""
    names = {k: f"_f_{k}" for k in family}
    seen = df.where(F.col(p).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in names.items()], F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.partitionBy(*names.values()).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*names.values()).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    all_of = seen.groupBy(*[F.col(n).alias(f"{n}_") for n in names.values()]).agg(F.sum("_k").alias("_n"))
    same = lambda a, b: reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)], F.lit(True))
    d = seen.withColumn("_rn", F.sum("_k").over(upto)).join(all_of, same(names.values(), [f"{n}_" for n in names.values()]))
    d = d.withColumn("_q", F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_n") / F.col("_rn")).over(ahead))).select(*names.values(), "_p", "_q")
    return df.join(d, same([*family, p], [*names.values(), "_p"]), "left").withColumn(out, F.col("_q")).drop(*names.values(), "_p", "_q")


def contrast_table(df: DataFrame, *, bin: str, condition: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Welch tests with BH-adjusted p values per contrast and marks."""
    d = adjust_bh(welch(df, bin=bin, condition=condition, value=value, pairs=pairs), ["a", "b"], "p", [bin])
    return d.withColumn("contrast", F.concat_ws(" vs ", "a", "b")).withColumn("stars", stars("p_adj"))


def contrast_wide(table: DataFrame, bin: str, listed: Sequence[str], values: Sequence[str] = ("effect", "p_adj", "stars")) -> DataFrame:
    return long_to_wide(table, [bin], "contrast", list(values), listed)


def anova_two_way(df: DataFrame, *, y: str, x: str, condition: str, levels: Sequence[str]) -> DataFrame:
    """Sequential sums of squares of y ~ x + condition + x:condition (x numeric): term, df, ss, ms, f, p.

    The rows give one Gram matrix of at most 2 x levels columns; the nested fits are solved from it.
    """
    spark = df.sparkSession
    design = {"one": F.lit(1.0), "x": F.col(x).cast("double")}
    design |= {f"d{i}": (F.col(condition) == v).cast("double") for i, v in enumerate(levels[1:])}
    design |= {f"xd{i}": F.col(x) * (F.col(condition) == v).cast("double") for i, v in enumerate(levels[1:])}
    design["y"] = F.col(y).cast("double")
    names = list(design)
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(condition).isin(*levels)).select([e.alias(n) for n, e in design.items()])
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).head()
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    k = len(levels) - 1

    def rss(upto: int) -> float:
        a, b = gram[:upto, :upto], gram[:upto, -1]
        return float(gram[-1, -1] - b @ np.linalg.lstsq(a, b, rcond=None)[0])

    fits = [rss(1), rss(2), rss(2 + k), rss(2 + 2 * k)]
    rest = gram[0, 0] - (2 + 2 * k)
    ms = fits[3] / rest if rest > 0 else None
    terms = [(n, float(d), float(fits[i] - fits[i + 1]), float((fits[i] - fits[i + 1]) / d), float((fits[i] - fits[i + 1]) / d / ms) if ms else None) for i, (n, d) in enumerate(((x, 1), (condition, k), (f"{x}:{condition}", k)))]
    out = spark.createDataFrame([*terms, ("residuals", float(rest), fits[3], float(ms) if ms else None, None)], "term string, df double, ss double, ms double, f double")
    return out.withColumn("p", f_p("f", "df", F.lit(float(rest))))


def linear_trend(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def halo_rank(df: DataFrame, *, cluster: str, px_per_um: float, key: Sequence[str]) -> DataFrame:
    """Per cluster: the plane of its largest area; there, rows by area; with 8 rows or more, ranks 1, 4, 5 and 8 give the
    N/C value and the membrane and pore signals without background, also by the nucleus's perimeter."""
    top = best_row(df, [cluster], F.desc("Area"), *map(F.col, key)).select(F.col(cluster).alias("_c"), F.col("Slice").alias("_s"))
    d = df.join(top, (F.col(cluster) == F.col("_c")) & (F.col("Slice") == F.col("_s"))).drop("_c", "_s")
    w = Window.partitionBy(cluster).orderBy("Area", *key)
    d = d.withColumn("_rn", F.row_number().over(w))
    at = lambda c, k: F.max(F.when(F.col("_rn") == k, F.col(c))).alias(f"{c}{k}")
    cols = [at(c, k) for c in ("Area", "IntDen", "m_IntDen", "npc_IntDen") for k in (1, 4, 5, 8)] + [at("Mean", 4), at("XM", 1), at("YM", 1)]
    g = d.groupBy(cluster).agg(F.max("_rn").alias("_n"), F.first("Slice").alias("Slice"), *cols).where("_n >= 8")
    outer = F.try_divide(F.col("IntDen8") - F.col("IntDen5"), F.col("Area8") - F.col("Area5"))
    area = F.col("Area4") / F.lit(px_per_um * px_per_um)
    signal = lambda c: (F.col(f"{c}5") - F.col(f"{c}1")) - F.try_divide((F.col("Area5") - F.col("Area1")) * F.col(f"{c}1"), F.col("Area1"))
    perimeter = 2 * F.pi() * F.sqrt(area / F.pi())
    return g.select(
        cluster, F.try_divide(F.col("Mean4"), F.col("Mean4") + outer).alias("N_C_V2"), signal("m_IntDen").alias("Nuclear_Membrane"), F.try_divide(signal("m_IntDen"), perimeter).alias("Nuclear_Membrane_BG_Subtracted"),
        signal("npc_IntDen").alias("Nuclear_Pores"), F.try_divide(signal("npc_IntDen"), perimeter).alias("Nuclear_Pore_BG_Subtracted"), area.alias("Nuclear_Area"), "Slice", F.col("XM1").alias("X"), F.col("YM1").alias("Y"),
    )


__all__ = ["adjust_bh", "anova_two_way", "contrast_table", "contrast_wide", "halo_rank", "linear_trend", "nth_row", "rank_sum", "welch"]
