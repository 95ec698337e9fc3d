"""Tables for training sets: patch centres, cuts, splits, label composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(seed: int, *cols: str) -> Column:
    """60 bits of the seeded MD5 of the columns, as other engines can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])), 1, 15), 16, 10).cast("long")


def patch_centres(strata: DataFrame, plane: Sequence[str], quotas: dict[str, int], *, size: int, width: int, height: int, jitter: int = 0, seed: int = 7) -> DataFrame:
    """Seeded centres per plane: ``quotas`` many of each stratum of ``strata(plane, y, x, stratum)``; what a plane lacks is
    filled with other pixels of it (``fill``).  Centres are jittered and clamped so that a patch lies inside."""
    key = [*plane, "y", "x"]
    quota = F.coalesce(*[F.when(F.col("stratum") == k, F.lit(n)) for k, n in quotas.items()], F.lit(0))
    w = Window.partitionBy(*plane, "stratum").orderBy(_hash(seed, *key), *key)
    d = strata.withColumn("_rn", F.row_number().over(w)).withColumn("_in", F.col("_rn") <= quota)
    taken = d.where("_in")
    need = d.groupBy(*plane).agg((F.lit(sum(quotas.values())) - F.count_if("_in")).alias("_need")).where("_need > 0")
    rest = d.where("NOT _in").join(need, list(plane)).withColumn("_r", F.row_number().over(Window.partitionBy(*plane).orderBy(_hash(seed + 1, *key), *key))).where("_r <= _need").withColumn("stratum", F.lit("fill"))
    out = taken.select(*key, "stratum").union(rest.select(*key, "stratum"))
    half = size // 2
    move = lambda axis, k, n: F.least(F.greatest(F.col(axis) + (F.pmod(_hash(seed + k, *key), F.lit(2 * jitter + 1)) - jitter if jitter else F.lit(0)), F.lit(half)), F.lit(n - size + half)).cast("int")
    return out.select(*plane, "stratum", move("y", 2, height).alias("centre_y"), move("x", 3, width).alias("centre_x"))


def patches_per_time(times: DataFrame, weights: DataFrame, base: float) -> DataFrame:
    """times(t) with n_patches = base x weight, rounded half to even, 1 at least; without a weight 1."""
    d = times.join(F.broadcast(weights.select("t", "weight")), "t", "left")
    return d.select("t", F.greatest(F.lit(1), F.rint(F.coalesce("weight", F.lit(0.0)) * base).cast("int")).alias("n_patches"))


def hard_negatives(px: DataFrame, plane: Sequence[str], *, z: str, z_range: tuple[int, int], n: int, **params) -> DataFrame:
    """``n`` centres per plane of the z range, of one stratum ``negative``, label 0."""
    d = px.where(F.col(z).between(*z_range)).select(*plane, "y", "x", F.lit("negative").alias("stratum"))
    return patch_centres(d, plane, {"negative": n}, **params).withColumn("label", F.lit(0))


def cut_patches_at(centres: DataFrame, px: DataFrame, plane: Sequence[str], size: int, least_labelled: int = 0) -> DataFrame:
    """One row per pixel of each patch: the patch's key, in_y, in_x and the pixel's columns.  Pixels meet centres by
    tiles of the patch's size.  Patches with fewer than ``least_labelled`` labelled pixels (column label) go."""
    half = size // 2
    c = centres.withColumn("_y0", F.col("centre_y") - half).withColumn("_x0", F.col("centre_x") - half)
    tiles = lambda a: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + size - 1) / size))
    c = c.withColumn("_ty", F.explode(tiles("_y0"))).withColumn("_tx", F.explode(tiles("_x0")))
    p = px.withColumn("_py", F.floor(F.col("y") / size)).withColumn("_qx", F.floor(F.col("x") / size))
    p = p.select(*[F.col(k).alias(f"_p_{k}") for k in plane], *[F.col(k) for k in p.columns if k not in plane])
    on = [F.col(k) == F.col(f"_p_{k}") for k in plane] + [F.col("_ty") == F.col("_py"), F.col("_tx") == F.col("_qx"), F.col("y").between(F.col("_y0"), F.col("_y0") + size - 1), F.col("x").between(F.col("_x0"), F.col("_x0") + size - 1)]
    d = c.join(p, on).select(*centres.columns, *[k for k in px.columns if k not in plane], (F.col("y") - F.col("_y0")).alias("in_y"), (F.col("x") - F.col("_x0")).alias("in_x"))
    if least_labelled:
        ok = d.groupBy(*plane, "centre_y", "centre_x").agg(F.count_if(F.col("label") > 0).alias("_n")).where(F.col("_n") >= least_labelled).drop("_n")
        d = d.join(ok, [*plane, "centre_y", "centre_x"], "left_semi")
    return d


def split_by_time(df: DataFrame, validation: Sequence[int], t: str = "t") -> DataFrame:
    return df.withColumn("split", F.when(F.col(t).isin(*validation), "validation").otherwise("train"))


def split_random(df: DataFrame, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """``df`` with split: rows whose seeded hash lies under the fraction, and at least the least one, validate."""
    h = F.pmod(_hash(seed, *key), F.lit(1 << 30))
    least = df.agg(F.min(F.struct(h.alias("h"), *key)).alias("_least"))
    d = df.withColumn("_h", h).join(F.broadcast(least))
    first = F.struct(F.col("_h").alias("h"), *key) == F.col("_least")
    return d.withColumn("split", F.when((F.col("_h") < F.lit(fraction) * (1 << 30)) | first, "validation").otherwise("train")).drop("_h", "_least")


def compose_labels(grid: DataFrame, masks: dict[str, DataFrame], plane: Sequence[str], *, order: Sequence[tuple[str, int]], inside: dict[str, str] | None = None) -> DataFrame:
    """``grid(plane, y, x)`` with class_id: the class of the first mask in ``order`` that holds the pixel, 0 without one.
    ``inside`` names for a mask another that must hold the pixel too."""
    d = grid
    for name, mask in masks.items():
        d = d.join(mask.select(*plane, "y", "x", F.lit(True).alias(f"_m_{name}")), [*plane, "y", "x"], "left")
    has = lambda n: F.coalesce(F.col(f"_m_{n}"), F.lit(False))
    out = F.lit(0)
    for name, k in reversed(order):
        ok = has(name) & (has(inside[name]) if inside and name in inside else F.lit(True))
        out = F.when(ok, F.lit(k)).otherwise(out)
    return d.withColumn("class_id", out).drop(*[f"_m_{n}" for n in masks])
