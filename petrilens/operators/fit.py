"""Growth curves: plateau fits, candidate models, smooth and monotone trends.

A curve in time needs only counts and sums per distinct time, so rows are aggregated to that first; everything after
runs on tables as small as the times of all groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.operators.graph import cut


def time_sums(df: DataFrame, keys: Sequence[str], time: str, value: str, weight: Column | None = None) -> DataFrame:
    """Per group and time: weighted n, sy, syy."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(*keys, F.col(time).cast("double").alias("t")).agg(F.sum(w).alias("n"), F.sum(w * F.col(value)).alias("sy"), F.sum(w * F.col(value) * F.col(value)).alias("syy"))


def plateau_from_sums(sums: DataFrame, keys: Sequence[str], *, k_range: tuple[float, float] = (1e-4, 2.0), points: int = 33, rounds: int = 6) -> DataFrame:
    """A and k of y = A (1 - exp(-k t)) per group: for a given k, A has a closed form, so each round puts a grid of k in
    the bracket around the best one of the round before, for all groups together.  Columns: keys, A, k, sse, n."""
    grid = sums.select(*keys).distinct().select(*keys, F.lit(float(np.log(k_range[0]))).alias("lo"), F.lit(float(np.log(k_range[1]))).alias("hi"))
    best = None
    for _ in range(rounds):
        g = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("lk", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("j") / (points - 1))
        gt = 1 - F.exp(-F.exp("lk") * F.col("t"))
        s = g.join(sums, list(keys)).groupBy(*keys, "lo", "hi", "lk").agg(F.sum(F.col("sy") * gt).alias("yg"), F.sum(F.col("n") * gt * gt).alias("gg"), F.sum("syy").alias("yy"), F.sum("n").alias("n"))
        s = s.withColumn("A", F.coalesce(F.try_divide(F.col("yg"), F.col("gg")), F.lit(0.0))).withColumn("sse", F.col("yy") - F.col("A") * F.col("yg"))
        best = cut(s.groupBy(*keys).agg(F.min_by(F.struct("lk", "lo", "hi", "A", "sse", "n"), F.struct("sse", "lk")).alias("b")).select(*keys, "b.*"))
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        grid = best.select(*keys, (F.col("lk") - step).alias("lo"), (F.col("lk") + step).alias("hi"))
    return best.select(*keys, "A", F.exp("lk").alias("k"), "sse", "n")


def fit_plateau(df: DataFrame, keys: Sequence[str], time: str, value: str, **params) -> DataFrame:
    return plateau_from_sums(cut(time_sums(df, keys, time, value)), keys, **params)


def growth_summary(fit: DataFrame) -> DataFrame:
    """Adds Amax, v0 = A k, t_half = ln 2 / k, v_half = v0 / 2."""
    return fit.withColumn("Amax", F.col("A")).withColumn("v0", F.col("A") * F.col("k")).withColumn("t_half", F.try_divide(F.lit(float(np.log(2))), F.col("k"))).withColumn("v_half", F.col("v0") / 2)


def predict_grid(fit: DataFrame, keys: Sequence[str], last: float, step: float = 0.5) -> DataFrame:
    """Fitted value and velocity on a grid from 0 to ``last``."""
    d = fit.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(int(last / step))))).withColumn("t", F.col("_i") * F.lit(step))
    e = F.exp(-F.col("k") * F.col("t"))
    return d.select(*keys, "t", (F.col("A") * (1 - e)).alias("fit"), (F.col("A") * F.col("k") * e).alias("velocity"))


def with_fitted(df: DataFrame, fit: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    f = fit.select(*[F.col(k).alias(f"_f_{k}") for k in keys], "A", "k")
    return df.join(f, [F.col(k) == F.col(f"_f_{k}") for k in keys]).withColumn("fitted", F.col("A") * (1 - F.exp(-F.col("k") * F.col(time)))).drop("A", "k", *[f"_f_{k}" for k in keys])


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 32-bit words: every bit of the word depends on all bits of the one given."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def replicate_weights(a: np.ndarray, b: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weights (rows x replicates) from a counter: the r-th draw of a row is a scramble of its two words and
    r.  Weights of 8 and more (one in 100,000) count as 8."""
    limits = np.ceil(np.cumsum([np.exp(-1.0) / math.factorial(i) for i in range(8)]) * 2.0**32).astype(np.uint32)
    steps = np.arange(1, replicates + 1, dtype=np.uint32) * np.uint32(0x9E3779B9)
    draws = _mix(_mix(a.astype(np.uint32)[:, None] + steps) ^ b.astype(np.uint32)[:, None])
    return sum((draws >= x).astype(np.uint8) for x in limits)


def replicate_sums(df: DataFrame, keys: Sequence[str], row: Sequence[str], time: str, value: str, *, replicates: int, seed: int) -> DataFrame:
    """keys, rep, t, n, sy, syy: ``time_sums`` of every replicate.  A row is never copied: it keeps two words of the md5
    of the columns ``row``, and tasks add up its weights in arrays by group and time, a batch at a time."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in row]))
    word = lambda i: F.conv(F.substring(digest, i, 8), 16, 10).cast("long")
    d = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    d = d.select(*keys, F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("_y"), word(1).alias("_a"), word(9).alias("_b"))
    groups = [*keys, "t"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([pc.fill_null(batch[c].dictionary_encode().indices, -1).to_numpy() for c in groups])
            order = np.lexsort(codes)
            codes = codes[:, order]
            starts = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(0)])
            y = batch["_y"].to_numpy()[order, None]
            w = replicate_weights(batch["_a"].to_numpy()[order], batch["_b"].to_numpy()[order], replicates).astype(float)
            sums = [np.add.reduceat(w * k, starts, axis=0) for k in (np.ones_like(y), y, y * y)]
            named = [batch[c].take(pa.array(order[starts])) for c in groups]
            ends = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * replicates)
            yield pa.RecordBatch.from_arrays([*named, *[pa.ListArray.from_arrays(ends, pa.array(s.ravel())) for s in sums]], [*groups, "n", "sy", "syy"])

    kinds = dict(d.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in groups) + ", n array<double>, sy array<double>, syy array<double>"
    some = d.mapInArrow(add_up, schema).select(*groups, F.posexplode(F.arrays_zip("n", "sy", "syy")).alias("rep", "s"))
    sums = some.groupBy(*keys, (F.col("rep") + 1).alias("rep"), "t").agg(*[F.sum(f"s.{c}").alias(c) for c in ("n", "sy", "syy")])
    return sums.where("n > 0")


def bootstrap_band(df: DataFrame, keys: Sequence[str], row: Sequence[str], time: str, value: str, *, replicates: int = 200, last: float, step: float = 1.0, seed: int = 123) -> DataFrame:
    """2.5 and 97.5 % of the plateau curve over replicates with Poisson(1) row weights, drawn from the columns ``row``,
    which name a row, and ``seed``."""
    g = [*keys, "rep"]
    fit = plateau_from_sums(cut(replicate_sums(df, keys, row, time, value, replicates=replicates, seed=seed)), g, rounds=4)
    p = predict_grid(fit, g, last, step)
    return p.groupBy(*keys, "t").agg(F.percentile("fit", F.lit(0.025)).alias("low"), F.percentile("fit", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("replicates"))


def _lag(t: np.ndarray, t0: float) -> np.ndarray:
    return np.maximum(t - t0, 0.0)


#: name -> (function of t and parameters, start from (largest mean, last time), low and high limits)
MODELS = {
    "exponential": (lambda t, p: p[0] * (1 - np.exp(-p[1] * _lag(t, p[2]))), lambda a, e: [a, 0.02, 0.05 * e], lambda a, e: ([0, 0, 0], [np.inf, np.inf, e])),
    "weibull": (lambda t, p: p[0] * (1 - np.exp(-((_lag(t, p[3]) / p[1]) ** p[2]))), lambda a, e: [a, 0.4 * e, 1.2, 0.02 * e], lambda a, e: ([0, 1e-6, 0.2, 0], [np.inf, np.inf, 8, e])),
    "richards": (lambda t, p: p[0] / (1 + p[1] * np.exp(-p[2] * _lag(t, p[4]))) ** (1 / p[3]), lambda a, e: [a, 2.0, 0.05, 1.0, 0.02 * e], lambda a, e: ([0, 1e-6, 0, 0.2, 0], [np.inf, np.inf, 1, 5, e])),
    "offset_exponential": (lambda t, p: p[0] + p[1] * (1 - np.exp(-p[2] * t)), lambda a, e: [0.0, a, 0.02], lambda a, e: ([-np.inf, 0, 0], [np.inf, np.inf, np.inf])),
    "offset_weibull": (lambda t, p: p[0] + p[1] * (1 - np.exp(-((t / p[2]) ** p[3]))), lambda a, e: [0.0, a, 0.4 * e, 1.2], lambda a, e: ([-np.inf, 0, 1e-6, 0.3], [np.inf, np.inf, np.inf, 8])),
}


def damped_fit(f, t: np.ndarray, n: np.ndarray, mean: np.ndarray, start: Sequence[float], low: Sequence[float], high: Sequence[float], steps: int = 200) -> tuple[np.ndarray, float]:
    """Weighted least squares of ``f`` at the means by damped Gauss-Newton steps, clipped to the limits."""
    p, damp = np.clip(np.array(start, float), low, high), 1e-2
    loss = lambda q: float((n * (mean - f(t, q)) ** 2).sum())
    now = loss(p)
    for _ in range(steps):
        base, h = f(t, p), 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(f(t, p + h * np.eye(len(p))[i]) - base) / h[i] for i in range(len(p))], 1)
        a, b = (jac * n[:, None]).T @ jac, jac.T @ (n * (mean - base))
        q = np.clip(p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), b, rcond=None)[0], low, high)
        new = loss(q)
        if new < now:
            done = now - new < 1e-12 * (1 + now)
            p, now, damp = q, new, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p, now


def fit_models(df: DataFrame, keys: Sequence[str], time: str, value: str, models: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """Per group and model: parameters, rss, aic, and whether it is the group's best.  A group reaches the fit as its
    sums per distinct time; fits that don't end in numbers are left out."""
    sums = time_sums(df, keys, time, value)
    kinds = dict(sums.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, n, mean = pdf["t"].to_numpy(), pdf["n"].to_numpy(), (pdf["sy"] / pdf["n"]).to_numpy()
        within, count, out = float((pdf["syy"] - pdf["sy"] ** 2 / pdf["n"]).sum()), float(n.sum()), []
        for name in models:
            f, start, limits = MODELS[name]
            with np.errstate(all="ignore"):
                try:
                    p, loss = damped_fit(f, t, n, mean, start(max(float(mean.max()), 1e-9), max(float(t.max()), 1e-9)), *limits(1.0, max(float(t.max()), 1e-9)))
                except np.linalg.LinAlgError:
                    continue
            rss = within + loss
            if np.isfinite(rss) and rss > 0 and np.isfinite(p).all():
                out.append({**{k: pdf[k].iloc[0] for k in keys}, "model": name, "params": p.tolist(), "rss": rss, "n": count, "aic": count * float(np.log(2 * np.pi * rss / count)) + count + 2 * (len(p) + 1)})
        return pd.DataFrame(out, columns=[*keys, "model", "params", "rss", "n", "aic"])

    got = sums.groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", model string, params array<double>, rss double, n double, aic double")
    w = Window.partitionBy(*keys).orderBy("aic", "model")
    return got.withColumn("best", F.row_number().over(w) == 1)


def loess(df: DataFrame, keys: Sequence[str], time: str, value: str, *, span: float = 0.35, step: float = 1.0) -> DataFrame:
    """Local quadratic trend per group on a grid over its times, with tricube weights of the nearest ``span`` of its
    rows, cut at 0."""
    sums = cut(time_sums(df, keys, time, value))
    ends = sums.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("n").alias("all_n"))
    grid = ends.withColumn("g", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step).cast("int")))).select(*keys, (F.col("lo") + F.col("g") * step).alias("g"), F.ceil(F.col("all_n") * span).alias("q"))
    d = grid.join(sums, list(keys)).withColumn("d", F.abs(F.col("t") - F.col("g")))
    near = Window.partitionBy(*keys, "g").orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_upto", F.sum("n").over(near))
    h = d.where(F.col("_upto") >= F.col("q")).groupBy(*keys, "g").agg(F.min("d").alias("h"))
    d = d.join(h, [*keys, "g"]).where((F.col("d") < F.col("h")) | (F.col("h") == 0) & (F.col("d") == 0))
    u = F.coalesce(F.try_divide(F.col("d"), F.col("h")), F.lit(0.0))
    d = d.withColumn("w", F.pow(1 - F.pow(u, F.lit(3)), F.lit(3))).withColumn("z", F.col("t") - F.col("g"))
    m = lambda k: F.sum(F.col("w") * F.col("n") * F.pow("z", F.lit(float(k)))).alias(f"s{k}")
    b = lambda k: F.sum(F.col("w") * F.col("sy") * F.pow("z", F.lit(float(k)))).alias(f"b{k}")
    s = d.groupBy(*keys, "g").agg(*[m(k) for k in range(5)], *[b(k) for k in range(3)])
    # value at z = 0 of the quadratic: Cramer's rule on the 3 x 3 moment matrix
    det = F.expr("s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)")
    top = F.expr("b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)")
    return s.select(*keys, F.col("g").alias("t"), F.greatest(F.lit(0.0), F.try_divide(top, det)).alias("trend"))


def monotone_trend(df: DataFrame, keys: Sequence[str], time: str, value: str, *, onset: float = 0.0) -> DataFrame:
    """Per group: the increasing step function of time since the onset that is nearest the means (weighed by their
    rows).  A group reaches the fit as its sums per distinct time."""
    sums = time_sums(df.withColumn("_t", F.greatest(F.lit(0.0), F.col(time) - onset)), keys, "_t", value)
    kinds = dict(sums.dtypes)

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        blocks: list[list[float]] = []
        for n, sy in zip(pdf["n"], pdf["sy"], strict=True):
            blocks.append([n, sy, 1])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
        fit = [sy / n for n, sy, k in blocks for _ in range(int(k))]
        return pdf[[*keys, "t"]].assign(trend=fit)

    return sums.groupBy(*keys).applyInPandas(pool, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t double, trend double")


def _rising(t: Column, step: Column, intervals: int) -> Column:
    """Values at t of ``intervals`` + 3 functions that rise from 0 to 1 (the first is 1): sums of the cubic B-splines on
    even knots from each one on."""

    def bell(u: Column) -> Column:
        a = F.abs(u)
        return F.when(a < 1, 2 / 3 - a * a + a * a * a / 2).when(a < 2, F.pow(2 - a, F.lit(3.0)) / 6).otherwise(0.0)

    bells = F.array(*[bell(t / step - j) for j in range(-1, intervals + 2)])
    return F.aggregate(F.reverse(bells), F.array().cast("array<double>"), lambda got, x: F.concat(F.array(x + F.coalesce(F.get(got, F.lit(0)), F.lit(0.0))), got))


def rising_solution(gram: np.ndarray, right: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients c, all but the first at least 0, of the least c'Gc - 2r'c + penalty * (differences of neighbours from
    the second on)^2, and the effective degrees of freedom of the free ones."""
    m = len(right)
    d = np.diff(np.eye(m)[1:], axis=0)
    scale = max(np.trace(gram) / m, 1e-300)
    full = gram + penalty * scale * d.T @ d + 1e-10 * scale * np.eye(m)
    free, c = np.zeros(m, bool), np.zeros(m)
    free[0] = True
    c[0] = right[0] / full[0, 0]
    for _ in range(10 * m):
        slope = right - full @ c
        slope[free] = 0
        if slope.max() <= 1e-9 * max(np.abs(right).max(), 1e-300):
            break
        free[slope.argmax()] = True
        while True:
            at = np.flatnonzero(free)
            want = np.linalg.solve(full[np.ix_(at, at)], right[at])
            bad = (want < 0) & (at > 0)
            if not bad.any():
                break
            now = c[at]
            share = (now[bad] / np.maximum(now[bad] - want[bad], 1e-300)).min()
            c[at] = now + share * (want - now)
            gone = at[bad & (c[at] <= 1e-14 * max(np.abs(c).max(), 1e-300))]
            free[gone if len(gone) else at[bad][:1]] = False
            c[~free] = 0
        c[:] = 0
        c[at] = want
    at = np.flatnonzero(free)
    return c, float(np.trace(np.linalg.solve(full[np.ix_(at, at)], gram[np.ix_(at, at)])))


def monotone_spline(
    df: DataFrame, keys: Sequence[str], time: str, value: str, *, onset: float = 0.0, intervals: int = 8, penalties: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)
) -> DataFrame:
    """Smooth increasing trend after ``onset`` per group, at its distinct times: a cubic spline on even knots whose
    increments are non-negative, penalised by their differences; the penalty has the least generalised cross validation.
    Columns: keys, t (time after the onset, 0 before it), trend, penalty.

    The normal equations are grouped sums over the distinct times; a task then solves (``intervals`` + 3) unknowns a
    group.  Rows with a null time or value are left out; a group with one time has its mean; null keys are a group;
    there is at least one key.
    """
    m = intervals + 3
    rows = df.withColumn("_since", F.greatest(F.lit(0.0), F.col(time).cast("double") - F.lit(float(onset))))
    sums = cut(time_sums(rows.where(F.col(time).isNotNull()), keys, "_since", value))
    named = lambda d, tag: d.select(*[F.col(k).alias(f"{tag}{k}") for k in keys], *[c for c in d.columns if c not in keys])
    every = lambda tag: [F.col(k).eqNullSafe(F.col(f"{tag}{k}")) for k in keys]
    ends = named(sums.groupBy(*keys).agg(F.max("t").alias("_end")), "_e_")
    step = F.when(F.col("_end") > 0, F.col("_end") / intervals).otherwise(1.0)
    based = sums.join(ends, every("_e_")).withColumn("b", _rising(F.col("t"), step, intervals)).select(*keys, "t", "n", "sy", "syy", "b")
    products = F.flatten(F.transform("b", lambda x: F.transform("b", lambda y: x * y * F.col("n"))))
    parts = F.concat(products, F.transform("b", lambda x: x * F.col("sy")), F.array("n", "syy"))
    added = based.select(*keys, F.posexplode(parts).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    equations = added.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("sums"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for told in batch["sums"]:
                g, r, (n, syy) = told[: m * m].reshape(m, m), told[m * m : m * m + m], told[-2:]
                tried = []
                for p in penalties:
                    c, freedom = rising_solution(g, r, p)
                    left = max(syy - 2 * c @ r + c @ g @ c, 0.0)
                    tried.append((n * left / max(n - freedom, 1e-9) ** 2, p, c))
                found.append(min(tried, key=lambda x: x[:2])[1:])
            yield batch.drop(columns="sums").assign(penalty=[float(p) for p, _ in found], c=[list(c) for _, c in found])

    kinds = dict(sums.dtypes)
    solved = equations.mapInPandas(solve, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "penalty double", "c array<double>"]))
    trend = F.aggregate(F.zip_with("b", "c", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return based.join(named(cut(solved), "_s_"), every("_s_")).select(*keys, "t", trend.alias("trend"), "penalty")
