"""Derived columns of measured objects: unit conversions, shape measures, tiling, time, ratios.

Every function takes column names or Columns and returns a Column, unless it says otherwise.  Undefined results are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrilens.functions.broadcasts import with_totals


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def px_to_um2(area_px, um_per_px: float) -> Column:
    """Area in square micrometres."""
    return c(area_px) * F.lit(um_per_px * um_per_px)


def um2_to_px(area_um2, um_per_px: float) -> Column:
    return c(area_um2) / F.lit(um_per_px * um_per_px)


def um_to_px(length_um, um_per_px: float) -> Column:
    return c(length_um) / F.lit(um_per_px)


def equivalent_diameter(area) -> Column:
    """Diameter of the disk of this area."""
    return 2 * F.sqrt(c(area) / F.pi())


def circularity(area, perimeter) -> Column:
    """4 pi A / P^2, null without a perimeter."""
    return F.when(c(perimeter) > 0, 4 * F.pi() * c(area) / (c(perimeter) * c(perimeter)))


def bbox_area(r0, c0, r1, c1) -> Column:
    """Area of a bounding box whose sides count one at least."""
    return F.greatest(c(r1) - c(r0), F.lit(1)) * F.greatest(c(c1) - c(c0), F.lit(1))


def fill_fraction(area, r0, c0, r1, c1) -> Column:
    return c(area) / bbox_area(r0, c0, r1, c1)


def edge_touching(df: DataFrame, *, r0: str, c0: str, r1: str, c1: str, buffer: int = 5, out: str = "is_edge_touching") -> DataFrame:
    """Adds whether a box comes within ``buffer`` of the origin or of the table's largest extent; a box with a missing
    side doesn't touch."""
    near = (F.col(r0) <= buffer) | (F.col(c0) <= buffer) | (F.col(r1) >= F.col("_max_r") - buffer) | (F.col(c1) >= F.col("_max_c") - buffer)
    return with_totals(df, _max_r=F.max(r1), _max_c=F.max(c1)).withColumn(out, F.coalesce(near, F.lit(False))).drop("_max_r", "_max_c")


def tile_columns(x, y, *, width: int, height: int, rows: int, cols: int, serpentine: bool = True) -> tuple[Column, Column, Column]:
    """Tile row, column and index of a position; every second row (odd ones) runs backwards if serpentine."""
    col = F.least(F.floor(c(x) / (width / cols)), F.lit(cols - 1)).cast("int")
    row = F.least(F.floor(c(y) / (height / rows)), F.lit(rows - 1)).cast("int")
    along = F.when((row % 2 == 1) & F.lit(serpentine), cols - 1 - col).otherwise(col)
    return row, col, (row * cols + along).cast("int")


def tile_time(t, index, *, rows: int, cols: int, minutes: float, midpoint: bool = False) -> Column:
    """Minutes at which a tile of frame ``t`` was taken; ``midpoint`` adds half a tile."""
    return (c(t) * rows * cols + c(index) + F.lit(0.5 if midpoint else 0.0)) * F.lit(minutes)


def true_time_from_x(df: DataFrame, *, x: str, t: str, fields: int, serpentine: bool = False, minutes: float = 1.0) -> DataFrame:
    """Adds fov and true_time_min: the field of view by ``x`` over the table's widest x (reversed on odd frames if
    serpentine), and the minute t * fields + fov."""
    out = with_totals(df, _max_x=F.max(x))
    width = F.when(F.col("_max_x") > 0, F.col("_max_x")).otherwise(F.raise_error(F.lit("the widest x must be positive")).cast("double"))
    fov = F.least(F.greatest(F.floor(F.col(x) / (width / fields)), F.lit(0)), F.lit(fields - 1))
    if serpentine:
        fov = F.when(F.col(t) % 2 == 1, fields - 1 - fov).otherwise(fov)
    out = out.withColumn("fov", fov.cast("int"))
    return out.withColumn("true_time_min", (F.col(t) * fields + F.col("fov")) * F.lit(minutes)).drop("_max_x")


def region_of(x, y, boxes: Sequence[tuple[float, float, float, float, int]], otherwise: int | None = None) -> Column:
    """The first of the boxes (x from, x to, y from, y to, name) that holds a position, ends included."""
    out = F.lit(otherwise).cast("int")
    for x0, x1, y0, y1, name in reversed(boxes):
        out = F.when(c(x).between(x0, x1) & c(y).between(y0, y1), F.lit(name)).otherwise(out)
    return out


def time_bin(time, width: float = 6, least: float | None = None) -> Column:
    """Start of the time's bin; bins under ``least`` move up to it."""
    b = F.floor(c(time) / width) * F.lit(width)
    return F.greatest(b, F.lit(least)) if least is not None else b


def bin_label(start, width: int = 6) -> Column:
    return F.format_string("%d–%d", c(start).cast("int"), (c(start) + width).cast("int"))


def safe_log(x) -> Column:
    return F.when(c(x) > 0, F.log(c(x)))


def recode(x, names: Mapping[str, str]) -> Column:
    """Values renamed by the mapping; others stay."""
    out = c(x)
    for old, new in names.items():
        out = F.when(c(x) == old, F.lit(new)).otherwise(out)
    return out


#: Significance limits and marks, two scales.
STARS = ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*"))
STARS_SHORT = ((1e-3, "***"), (1e-2, "**"), (0.05, "*"))


def stars(p, scale: Sequence[tuple[float, str]] = STARS, none: str = "ns") -> Column:
    """Mark of the smallest limit over p; null has none."""
    out = F.lit(none)
    for limit, mark in reversed(scale):
        out = F.when(c(p) < limit, F.lit(mark)).otherwise(out)
    return F.when(c(p).isNull(), F.lit("")).otherwise(out)


def clip(x, low, high) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def object_id(t, n) -> Column:
    return F.format_string("t%03d_obj%04d", c(t).cast("int"), c(n).cast("int"))


def nc_ratio(n, cyt) -> Column:
    return F.try_divide(c(n), c(cyt))


def nc_fraction(n, cyt) -> Column:
    return F.try_divide(c(n), c(n) + c(cyt))


def nc_boundary(boundary, inner, outer, least: float = 1e-8) -> Column:
    """(boundary - outer) / (inner - outer), null if the denominator is at most ``least`` in size."""
    den = c(inner) - c(outer)
    return F.when(F.abs(den) > least, (c(boundary) - c(outer)) / den)


def unique_names(names: Sequence[str]) -> list[str]:
    """Column names with ``.1``, ``.2`` ... on repeats."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(f"{n}.{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def qc_score(df: DataFrame, *, area: str, circ: str, mean_prob: str, max_prob: str, fill: str, edge: str, area_range: tuple[float, float], weights: Sequence[float] = (0.25, 0.25, 0.2, 0.15, 0.15), edge_penalty: float = 0.25, keep: float = 0.5) -> DataFrame:
    """Adds qc_score and qc_keep: five sub-scores clipped to 0..1 (area in its band, circularity, mean and largest
    probability, fill), weighed, less a penalty at the edge."""
    low, high = area_range
    parts = [clip((F.col(area) - low) / (high - low), 0.0, 1.0), clip(circ, 0.0, 1.0), clip(mean_prob, 0.0, 1.0), clip(max_prob, 0.0, 1.0), clip(fill, 0.0, 1.0)]
    score = sum((F.coalesce(p, F.lit(0.0)) * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0))
    score = score - F.when(F.col(edge), F.lit(edge_penalty)).otherwise(0.0)
    return df.withColumn("qc_score", score).withColumn("qc_keep", F.col("qc_score") >= keep)
