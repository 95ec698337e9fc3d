"""Filters that clean measurement tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrilens.functions.broadcasts import exact_quantiles, with_totals
from petrilens.functions.columns import circularity, edge_touching, fill_fraction


def area_band(df: DataFrame, area: str, low: float | None, high: float | None) -> DataFrame:
    """Rows with an area in the band, ends included."""
    if low is not None:
        df = df.where(F.col(area) >= low)
    return df.where(F.col(area) <= high) if high is not None else df


def flag_area(df: DataFrame, *, area: str, t: str, large: float, small: float, late: float) -> DataFrame:
    """Adds too_large, and too_small for frames from ``late`` on."""
    return df.withColumn("too_large", F.col(area) > large).withColumn("too_small", (F.col(t) >= late) & (F.col(area) < small))


def staged_limits(df: DataFrame, *, t: str, stages: Sequence[tuple[float | None, dict[str, tuple[float | None, float | None]]]]) -> DataFrame:
    """Rows inside the limits of their time's stage.

    ``stages`` lists (end of the stage, {column: (low, high)}), the last one without an end; a missing time counts as
    the last stage, and limits of columns that the table lacks are passed over.
    """
    keep: Column | None = None
    for end, limits in reversed(stages):
        ok = F.lit(True)
        for col, (low, high) in limits.items():
            if col in df.columns:
                ok = ok & (F.col(col) >= low if low is not None else F.lit(True)) & (F.col(col) <= high if high is not None else F.lit(True))
        keep = ok if keep is None else F.when(F.col(t) < end, ok).otherwise(keep)
    return df.where(keep)


def border_distance(df: DataFrame, *, x: str, y: str, width: str, height: str, least: float) -> DataFrame:
    """Rows at least ``least`` from every side of the image."""
    return df.where((F.col(x) >= least) & (F.col(y) >= least) & (F.col(x) <= F.col(width) - least) & (F.col(y) <= F.col(height) - least))


def pre_clean(df: DataFrame, *, area: str, perimeter: str, box: Sequence[str], min_area: float, min_fill: float, min_circ: float, max_area: float, edge_buffer: int = 5) -> DataFrame:
    """Smallest area, fill and circularity; then rows at the edge of what is left; then the largest area.  The order is
    part of the result: the edge is where the rows left by the first three end."""
    r0, c0, r1, c1 = box
    df = df.withColumn("fill_fraction", fill_fraction(area, *box)).withColumn("circ", circularity(area, perimeter))
    df = df.where((F.col(area) >= min_area) & (F.col("fill_fraction") >= min_fill) & (F.col("circ") >= min_circ))
    return edge_touching(df, r0=r0, c0=c0, r1=r1, c1=c1, buffer=edge_buffer).where(~F.col("is_edge_touching") & (F.col(area) <= max_area))


def seen_on_planes(df: DataFrame, *, keys: Sequence[str], z: str, least: int) -> DataFrame:
    """Rows of groups that occur on ``least`` different planes or more."""
    missing = [k for k in (*keys, z) if k not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    ok = df.groupBy(*keys).agg(F.countDistinct(z).alias("_n")).where(F.col("_n") >= least).select(*keys)
    return df.join(ok, list(keys), "left_semi")


def drop_where(df: DataFrame, *rules: Column) -> DataFrame:
    """Rows to which no rule applies; a row for which a rule is unknown goes, as with a negated SQL condition."""
    return reduce(lambda d, r: d.where(~r), rules, df)


def all_at_least_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a negative value in the numeric columns."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    columns = columns or [n for n, k in df.dtypes if k in kinds]
    return df.where(reduce(lambda a, b: a & b, [F.col(n) >= 0 for n in columns], F.lit(True)))


def within_sd(df: DataFrame, columns: Sequence[str], k: float = 2.0) -> DataFrame:
    """Rows within ``k`` sample standard deviations of the mean in every column, all bounds from the same input."""
    totals = {f"_m{i}": F.avg(n) for i, n in enumerate(columns)} | {f"_s{i}": F.stddev_samp(n) for i, n in enumerate(columns)}
    out = with_totals(df, **totals)
    for i, n in enumerate(columns):
        out = out.where(F.abs(F.col(n) - F.col(f"_m{i}")) <= k * F.col(f"_s{i}"))
    return out.drop(*totals)


def within_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows inside the quartiles widened by ``k`` quartile distances, column after column: bounds come anew from what
    the column before left.  Bounds are found when the function is called."""
    for n in columns:
        low, high = exact_quantiles(df, n, (0.25, 0.75))
        df = df.where(F.col(n).between(F.lit(low) - k * (F.lit(high) - F.lit(low)), F.lit(high) + k * (F.lit(high) - F.lit(low)))) if low is not None else df.where(F.lit(False))
    return df


def _deviation(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """Median and median absolute deviation of a whole column."""
    (median,) = exact_quantiles(df, column, (0.5,))
    return median, None if median is None else exact_quantiles(df, F.abs(F.col(column) - F.lit(median)), (0.5,))[0]


def with_robust_z(df: DataFrame, column: str, out: str, scale: float = 1.4826) -> DataFrame:
    """Adds (x - median) / (scale * MAD); null where the MAD is 0.  Both are found when the function is called."""
    median, mad = _deviation(df, column)
    return df.withColumn(out, F.try_divide(F.col(column) - F.lit(median).cast("double"), F.lit(mad).cast("double") * scale))


def within_mad(df: DataFrame, column: str, limit: float = 3.5) -> DataFrame:
    return with_robust_z(df, column, "_z").where(F.abs("_z") <= limit).drop("_z")


def combined_keep(df: DataFrame, columns: Sequence[str], *, mad: float = 3.5, iqr: float = 1.5, quantiles: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Rows that pass the MAD, the quartile and the quantile rule in every column, all bounds from the same input and
    found when the function is called."""
    keep = F.lit(True)
    for n in columns:
        q1, median, q3, low, high = exact_quantiles(df, n, (0.25, 0.5, 0.75, *quantiles))
        if median is None:
            return df.where(F.lit(False))
        (spread,) = exact_quantiles(df, F.abs(F.col(n) - F.lit(median)), (0.5,))
        keep = keep & (F.abs(F.try_divide(F.col(n) - median, F.lit(spread * 1.4826))) <= mad) & F.col(n).between(q1 - iqr * (q3 - q1), q3 + iqr * (q3 - q1)) & F.col(n).between(low, high)
    return df.where(keep)


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(~F.col(column).isin(*values))


def only(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(*values))
