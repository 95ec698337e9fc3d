"""Clusterings, principal components and the smoothed path of best planes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrilens.functions.quantiles import _join, _maybe_broadcast, group_quantiles
from petrilens.operators.graph import cut
from petrilens.operators.summaries import robust_z, rolling_mode


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with a vector column ``_v`` of the features at mean 0 and standard deviation 1; rows with nulls go."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="_raw", outputCol="_v", withMean=True, withStd=True).fit(rows).transform(rows)


def kmeans(df: DataFrame, features: Sequence[str], k: int, seed: int = 123, out: str = "cluster") -> DataFrame:
    """``df`` with k-means clusters of the standardised features, numbered in the order of their centroids."""
    from pyspark.ml.clustering import KMeans

    rows = standardised(df, features)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(rows)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    rank = F.array(*[F.lit(order.index(i)) for i in range(len(order))])
    return model.transform(rows).withColumn(out, F.element_at(rank, F.col("_c") + 1)).drop("_raw", "_v", "_c")


def pca(df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str]) -> DataFrame:
    """``keep`` and pc1 .. pck of the standardised features; a component's sign makes its largest loading positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = standardised(df, features)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    load = model.pc.toArray()
    signs = [1.0 if load[np.abs(load[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    p = model.transform(rows).withColumn("_a", vector_to_array("_p"))
    return p.select(*keep, *[F.round(F.col("_a")[j] * signs[j], 6).alias(f"pc{j + 1}") for j in range(k)])


def group_kmeans(df: DataFrame, *, keys: Sequence[str], features: Sequence[str], ks: Sequence[int], rounds: int = 12, least_rows: int = 10, drop: float = 0.1) -> DataFrame:
    """Per group: chosen k and, for every k, n, wss; and the relative drop against the k before.

    Features are standardised in their group.  All groups and all k run together: centroids (groups x k rows) meet
    the rows where they lie (broadcast, if the groups are few), and a round is one average; no task needs to hold a
    group.  First centroids lie at even quantiles of the first
    feature.  The elbow is the last k before the first drop under ``drop``, the largest k if there is none; groups
    with under ``least_rows`` rows get null.
    """
    dims = [f"_f{i}" for i in range(len(features))]
    d = cut(df.dropna(subset=list(features)).select(*keys, *features))
    told = [x for f, n in zip(features, dims, strict=True) for x in (F.avg(f).alias(f"_avg{n}"), F.stddev_samp(f).alias(f"_sd{n}"))]
    groups = cut(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *told))
    small = groups.where(F.col("_n") < least_rows).select(*keys)
    shaped = [F.coalesce(F.try_divide(F.col(f) - F.col(f"_avg{n}"), F.col(f"_sd{n}")), F.lit(0.0)).alias(n) for f, n in zip(features, dims, strict=True)]
    # a large group is no hot key: its rows stay where they lie and get the one row of their group
    rows = cut(_join(d, _maybe_broadcast(groups.where(F.col("_n") >= least_rows)), keys).select(*keys, *shaped))
    places = sorted({(j + 0.5) / k for k in ks for j in range(k)})
    q = group_quantiles(rows, keys, dims[0], places, "_q")
    q = _join(q, rows.groupBy(*keys).agg(*[F.avg(n).alias(f"m_{n}") for n in dims[1:]]), keys) if dims[1:] else q
    starts = [F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"), F.col("_q")[places.index((j + 0.5) / k)].alias(f"c{dims[0]}"), *[F.col(f"m_{n}").alias(f"c{n}") for n in dims[1:]]) for k in ks for j in range(k)]
    cent = q.select(*keys, F.inline(F.array(*starts)))
    names = [f"c{n}" for n in dims]
    cent = cut(cent.select(*keys, "k", "j", *names))

    def nearest(cent: DataFrame) -> DataFrame:
        """Rows with, for every k, their nearest centroid, found among the group's centroids beside the row."""
        sq = lambda c: sum(((F.col(n) - c[f"c{n}"]) * (F.col(n) - c[f"c{n}"]) for n in dims), F.lit(0.0))
        per = cent.groupBy(*keys, "k").agg(F.collect_list(F.struct("j", *names)).alias("cs")).groupBy(*keys).agg(F.collect_list(F.struct("k", "cs")).alias("all"))
        best = F.transform("all", lambda of: F.struct(of["k"].alias("k"), F.array_min(F.transform(of["cs"], lambda c: F.struct(sq(c).alias("d"), c["j"].alias("j")))).alias("b")))
        return _join(rows, _maybe_broadcast(cut(per)), keys).select(*keys, *dims, F.inline(best)).select(*keys, "k", "b.d", "b.j", *dims)

    for _ in range(rounds):
        cent = cut(nearest(cent).groupBy(*keys, "k", "j").agg(*[F.avg(n).alias(f"c{n}") for n in dims]))
    wss = nearest(cent).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("wss"))
    by_k = Window.partitionBy(*keys).orderBy("k")
    told = wss.withColumn("drop", F.try_divide(F.lag("wss").over(by_k) - F.col("wss"), F.lag("wss").over(by_k)))
    chosen = told.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("drop") < drop, F.col("k"))) - 1, F.max("k")).alias("best_k"))
    out = told.join(chosen, list(keys)).select(*keys, "k", "n", F.round("wss", 4).alias("wss"), F.round("drop", 6).alias("drop"), F.col("best_k").cast("int").alias("best_k"))
    return out.unionByName(small, allowMissingColumns=True)


def smooth_best_z(df: DataFrame, *, series: str, t: str, z: str, score: str, penalty: float, max_step: int | None = None) -> DataFrame:
    """Per series and time: the plane on the path with the highest sum of robust-z scores less ``penalty`` per plane of
    change, refined by a parabola through its neighbours, and the mode of three times around it."""
    d = robust_z(df.select(series, t, z, score), score, [series, t], "_s")

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=t, columns=z, values="_s", aggfunc="first").sort_index().sort_index(axis=1)
        zs, s = m.columns.to_numpy(float), m.fillna(-1e6).to_numpy()
        step = np.abs(zs[:, None] - zs[None])
        cost = penalty * step + (np.where(step > max_step, 1e9, 0) if max_step is not None else 0)
        best, back = s[0], []
        for row in s[1:]:
            total = best[None] - cost
            back.append(total.argmax(1))
            best = total.max(1) + row
        at = [int(best.argmax())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return pd.DataFrame({series: pdf[series].iloc[0], t: m.index, "best_z": zs[at[::-1]].astype(int)})

    kinds = dict(df.dtypes)
    chosen = d.groupBy(series).applyInPandas(path, f"{series} {kinds[series]}, {t} {kinds[t]}, best_z int")
    w = Window.partitionBy(series, t).orderBy(z)
    near = d.withColumn("_a", F.lag("_s").over(w)).withColumn("_b", F.lead("_s").over(w))
    shift = F.try_divide(0.5 * (F.col("_a") - F.col("_b")), F.col("_a") - 2 * F.col("_s") + F.col("_b"))
    near = near.withColumn("_shift", F.when(F.col("_a").isNull() | F.col("_b").isNull(), 0.0).otherwise(F.least(F.greatest(F.coalesce(shift, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))))
    out = chosen.join(near.select(series, t, F.col(z).alias("best_z"), "_shift"), [series, t, "best_z"])
    out = rolling_mode(out, "best_z", [series], [t], "mode_z")
    return out.select(series, t, "best_z", F.round(F.col("best_z") + F.col("_shift"), 6).alias("refined_z"), "mode_z")


__all__ = ["group_kmeans", "kmeans", "pca", "smooth_best_z", "standardised"]
