"""Matching of objects by distance: range joins on grid cells, never a comparison of all pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.operators.graph import cut


def _cell(x: str, y: str, size: float) -> tuple[Column, Column]:
    return F.floor(F.col(x) / size), F.floor(F.col(y) / size)


def near_pairs(
    left: DataFrame, right: DataFrame, *, radius: float, on: Sequence[tuple[str, str]] = (), xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] | None = None, strict: bool = False, out: str = "distance"
) -> DataFrame:
    """Rows of both sides within ``radius`` (``<=``, or ``<`` if strict) that agree on the column pairs of ``on``.

    Column names of the sides must differ.  Cells are as wide as the radius; the right side is dealt to the 3 x 3
    cells around its own, so that equal cells find every pair once.
    """
    rx, ry = right_xy or xy
    lx, ly = xy
    cx, cy = _cell(lx, ly, radius)
    l = left.withColumn("_cx", cx).withColumn("_cy", cy)  # noqa: E741
    dx, dy = _cell(rx, ry, radius)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r = right.withColumn("_o", F.explode(around)).withColumn("_dx", dx + F.col("_o.i")).withColumn("_dy", dy + F.col("_o.j")).drop("_o")
    d2 = (F.col(lx) - F.col(rx)) * (F.col(lx) - F.col(rx)) + (F.col(ly) - F.col(ry)) * (F.col(ly) - F.col(ry))
    cond = (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy"))
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    cond = cond & (d2 < radius * radius if strict else d2 <= radius * radius)
    return l.join(r, cond).withColumn(out, F.sqrt(d2)).drop("_cx", "_cy", "_dx", "_dy")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(n).alias(prefix + n) for n in df.columns])


def match_one_to_one(pairs: DataFrame, source: str, target: str, distance: str = "distance") -> DataFrame:
    """Each source takes its nearest target (ties: least target); of the sources of a target the nearest stays (ties:
    least source), the others have none."""
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(distance, target))).where("_r = 1")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(target).orderBy(distance, source))).where("_r = 1").drop("_r")


def match_many_to_one(pairs: DataFrame, source: str, target: str, distance: str = "distance") -> DataFrame:
    """Each source with its nearest target, ties to the least target."""
    best = pairs.groupBy(source).agg(F.min(F.struct(F.col(distance), F.col(target))).alias("_b"))
    return best.select(source, F.col(f"_b.{target}").alias(target), F.col(f"_b.{distance}").alias(distance))


def flag_near(df: DataFrame, *, key: str, radius: float, on: Sequence[str] = (), xy: tuple[str, str] = ("x", "y"), out: str = "has_neighbour") -> DataFrame:
    """``df`` with whether another row of the same group lies within ``radius``, ends included."""
    slim = df.select(key, *on, *xy)
    other = prefixed(slim, "_n_")
    pairs = near_pairs(slim, other, radius=radius, on=[(c, f"_n_{c}") for c in on], xy=xy, right_xy=(f"_n_{xy[0]}", f"_n_{xy[1]}")).where(F.col(key) != F.col(f"_n_{key}"))
    hit = pairs.select(F.col(key).alias("_hit")).distinct()
    return df.join(hit, F.col(key) == F.col("_hit"), "left").withColumn(out, F.col("_hit").isNotNull()).drop("_hit")


#: Distinct locations up to which a cell of the tree is a leaf, and the most levels (each cuts a cell in 4 x 4).
LEAF, DEPTH = 64, 20


def _small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df``, rows of a few numbers in checkpoint, with a broadcast hint if at most ``most`` are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _gap2(x: Column, y: Column, box: Sequence[Column], far: bool) -> Column:
    """Squared distance from (x, y) to the nearest, or for ``far`` the farthest, point of the box (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = box
    if far:
        dx, dy = F.greatest(x - x0, x1 - x), F.greatest(y - y0, y1 - y)
    else:
        dx, dy = F.greatest(x0 - x, x - x1, F.lit(0.0)), F.greatest(y0 - y, y - y1, F.lit(0.0))
    return dx * dx + dy * dy


def _nearest(ask: DataFrame, other: DataFrame, groups: Sequence[str], same: bool) -> DataFrame:
    """(_k, _b) with _b the least (distance, key) of ``other`` in the row's group, for rows of ``ask`` (_k, groups, _x, _y)
    whose group has one.  With ``same`` a row is no neighbour of its own, and only the distance counts.

    A tree of counts over the distinct locations of ``other`` cuts a cell in 4 x 4 while it holds over ``LEAF`` of them,
    so cells are as small as the points lie dense.  A row goes down to the smallest cell around it: the nearest point
    of that leaf, or the farthest of the cell's box, bounds its distance.  Then it goes down again through all cells whose boxes come as near as the
    bound, and meets the points of the leaves among them.  Every level is one join on the cell; levels of few cells are
    broadcast, so that rows that share a large cell are no hot key.
    """
    x, y, box = F.col("_x"), F.col("_y"), [F.col(c) for c in ("_x0", "_x1", "_y0", "_y1")]
    spots = cut(other.groupBy(*groups, "_x", "_y").agg(F.min("_k").alias("key"), F.count(F.lit(1)).alias("m")))
    size, many, *ends = spots.agg(F.count(F.lit(1)), F.count_distinct(F.struct(F.lit(0), *groups)), F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).head()
    if not size:
        return ask.select("_k", F.lit(None).cast("struct<distance:double,key:bigint>").alias("_b")).where("false")
    width = max(ends[1] - ends[0], ends[3] - ends[2]) * 1.0001 or 1.0
    base = min(DEPTH, max(0, math.ceil(math.log(size / many / LEAF, 16))))  # the level of leaves if the points lie evenly
    cell = [*groups, "_i", "_j"]

    def at(level: int) -> dict[str, Column]:
        side, last = width / 4**level, float(4**level - 1)
        along = lambda v, low: F.least(F.greatest(F.floor((v - low) / side), F.lit(0.0)), F.lit(last)).cast("long")
        return {"_i": along(x, ends[0]), "_j": along(y, ends[2])}

    tree, left = [], spots
    while not tree or not left.isEmpty():
        placed, level = left.withColumns(at(base + len(tree))), base + len(tree)
        leaf = (F.count(F.lit(1)) <= LEAF) | F.lit(level >= DEPTH)
        counts = cut(placed.groupBy(*cell).agg(F.sum("m").alias("_m"), leaf.alias("_leaf"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1")))
        placed = cut(placed.join(_small(counts).select(*cell, "_leaf"), cell))
        tree.append((_small(counts), placed.where("_leaf").drop("_leaf").withColumnsRenamed({"_x": "_nx", "_y": "_ny"})))
        left = placed.where("not _leaf").drop("_leaf", "_i", "_j")
    above = tree[0][0]
    for level in range(base - 1, -1, -1):  # cells above hold what theirs hold; none is a leaf
        up = above.withColumns({c: F.shiftright(c, 2) for c in ("_i", "_j")}).groupBy(*cell)
        above = up.agg(F.sum("_m").alias("_m"), F.lit(False).alias("_leaf"), F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"))
        above = F.broadcast(above) if many * 16**level <= 50_000 else _small(cut(above))
        tree.insert(0, (above, None))

    d2 = (x - F.col("_nx")) * (x - F.col("_nx")) + (y - F.col("_ny")) * (y - F.col("_ny"))

    def meet(rows: DataFrame, points: DataFrame) -> DataFrame:
        pairs = rows.join(points, cell)
        return pairs.where((F.col("m") > 1) | (F.col("_nx") != x) | (F.col("_ny") != y)) if same else pairs

    now, bounded, own = ask.withColumn("_r2", F.lit(None).cast("double")), None, None
    for level, (counts, points) in enumerate(tree):
        met = now.withColumns(at(level)).join(counts, cell, "left")
        known = F.col("_m") >= (2 if same else 1)
        met = met.withColumn("_r2", F.when(known, _gap2(x, y, box, True) * (1 + 1e-9)).otherwise(F.col("_r2"))).withColumn("_on", F.coalesce(known & ~F.col("_leaf"), F.lit(False)))
        met = met.select(*ask.columns, "_i", "_j", "_r2", "_on")
        met = cut(met) if level % 3 == 2 else met
        done = met.where("not _on and _r2 is not null")
        if points is not None:  # the points of the own leaf bound better than its box
            near = meet(done, points).groupBy("_k").agg(F.min(d2).alias("_d2"))
            own = near if own is None else own.union(near)
        done = done.drop("_on", "_i", "_j")
        bounded, now = done if bounded is None else bounded.union(done), met.where("_on").drop("_on", "_i", "_j")

    bounded = bounded.join(own, "_k", "left").withColumn("_r2", F.least("_r2", F.col("_d2") * (1 + 1e-9))).drop("_d2").select(*ask.columns, "_r2")
    front, best = cut(bounded).withColumns({"_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long")}), None
    for level, (counts, points) in enumerate(tree):
        met = front.join(counts, cell).where(_gap2(x, y, box, False) <= F.col("_r2")).drop("_m", "_x0", "_x1", "_y0", "_y1")
        met = cut(met) if level % 3 == 2 else met
        if points is not None:
            found = meet(met.where("_leaf"), points).groupBy("_k").agg(F.min(F.struct(F.sqrt(d2).alias("distance"), "key")).alias("_b"))
            best = found if best is None else best.union(found)
        side = width / 4 ** (level + 1)
        inner = [F.struct((F.col("_i") * 4 + a).alias("_i"), (F.col("_j") * 4 + b).alias("_j")) for a in range(4) for b in range(4)]
        front = met.where("not _leaf").select(*ask.columns, "_r2", F.explode(F.array(*inner)).alias("_c")).select(*ask.columns, "_r2", "_c._i", "_c._j")
        corner = [v * side + low for v, low in ((F.col("_i"), ends[0]), (F.col("_i") + 1, ends[0]), (F.col("_j"), ends[2]), (F.col("_j") + 1, ends[2]))]
        front = front.where(_gap2(x, y, corner, False) <= F.col("_r2") + 1e-9 * width * width)
    return cut(best.groupBy("_k").agg(F.min("_b").alias("_b")))


def _slim(df: DataFrame, key: str, on: Sequence[str], xy: tuple[str, str]) -> DataFrame:
    return df.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(on)], F.col(xy[0]).alias("_x"), F.col(xy[1]).alias("_y"))


def nearest_neighbour(df: DataFrame, *, key: str, on: Sequence[str], xy: tuple[str, str] = ("x", "y"), out: str = "nearest_px") -> DataFrame:
    """``df`` with the distance to the nearest other row of the group, null if there is none."""
    slim, groups = cut(_slim(df, key, on, xy)), [f"_g{i}" for i in range(len(on))]
    found = _nearest(slim, slim, groups, True)
    return df.join(found, F.col(key) == F.col("_k"), "left").withColumn(out, F.col("_b.distance")).drop("_k", "_b")


def nearest_centroid(points: DataFrame, centroids: DataFrame, *, on: Sequence[str], point: str, centroid: str, xy: tuple[str, str], centroid_xy: tuple[str, str]) -> DataFrame:
    """``points`` with the nearest centroid of their group and its distance; null where the group has none, ties to the
    least centroid."""
    slim, other = cut(_slim(points, point, on, xy)), cut(_slim(centroids, centroid, on, centroid_xy))
    found = _nearest(slim, other, [f"_g{i}" for i in range(len(on))], False)
    return points.join(found, F.col(point) == F.col("_k"), "left").withColumn("nearest", F.col("_b.key")).withColumn("nearest_px", F.col("_b.distance")).drop("_k", "_b")


def nearest_within(
    left: DataFrame, right: DataFrame, *, source: str, target: str, radius: float, on: Sequence[tuple[str, str]] = (), xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] | None = None, strict: bool = False, out: str = "distance"
) -> DataFrame:
    """(source, target, distance): each row of ``left`` with its nearest row of ``right`` (ties: least target) that agrees
    on the column pairs of ``on`` and lies within ``radius``.  The pairs of ``near_pairs`` grow with the square of the
    density; this goes down a tree of counts and makes one row a source."""
    finite = F.abs("_x").between(0.0, 1.7e308) & F.abs("_y").between(0.0, 1.7e308)
    ask, other = cut(_slim(left, source, [a for a, _ in on], xy).where(finite)), cut(_slim(right, target, [b for _, b in on], right_xy or xy).where(finite))
    found = _nearest(ask, other, [f"_g{i}" for i in range(len(on))], False)
    near = F.col("_b.distance") < radius if strict else F.col("_b.distance") <= radius
    return found.where(near).select(F.col("_k").alias(source), F.col("_b.key").alias(target), F.col("_b.distance").alias(out))


def parent_by_overlap(children: DataFrame, parents: DataFrame, *, pixel: Sequence[str], child: str = "child", parent: str = "parent") -> DataFrame:
    """Each child label with the parent label that shares most pixels (ties: least label; 0 without any)."""
    shared = children.join(parents, list(pixel)).groupBy(child, parent).agg(F.count(F.lit(1)).alias("overlap"))
    best = shared.groupBy(child).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(parent).alias("p"))).alias("_b"))
    return children.select(child).distinct().join(best, child, "left").select(child, F.coalesce("_b.p", F.lit(0)).alias(parent), F.coalesce(-F.col("_b.o"), F.lit(0)).alias("overlap"))


def parent_at_centroid(objects: DataFrame, labels: DataFrame, *, x: str, y: str, width: int, height: int, on: Sequence[str] = (), parent: str = "label") -> DataFrame:
    """``objects`` whose centroid (rounded half to even, clamped to the image) lies on a labelled pixel, with its label."""
    o = objects.withColumn("_x", F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(width - 1.0)).cast("int")).withColumn("_y", F.least(F.greatest(F.rint(y), F.lit(0.0)), F.lit(height - 1.0)).cast("int"))
    l = labels.select(*[F.col(k).alias(f"_l_{k}") for k in on], F.col("x").alias("_lx"), F.col("y").alias("_ly"), F.col(parent).alias("parent"))  # noqa: E741
    cond = [F.col(k) == F.col(f"_l_{k}") for k in on] + [F.col("_x") == F.col("_lx"), F.col("_y") == F.col("_ly")]
    return o.join(l, cond).drop("_x", "_y", "_lx", "_ly", *[f"_l_{k}" for k in on])


def count_children(parents: DataFrame, children: DataFrame, *, parent: str, child_parent: str, most: int = 1) -> DataFrame:
    """``parents`` with n_children (0 without any) and whether that is over ``most``."""
    n = children.groupBy(F.col(child_parent).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    out = parents.join(n, F.col(parent) == F.col("_p"), "left").withColumn("n_children", F.coalesce("_n", F.lit(0)))
    return out.withColumn("excluded_multiple", F.col("n_children") > most).drop("_p", "_n")
