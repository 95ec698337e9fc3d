"""Queries of measurement on pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilens.operators import pixels as M
from petrilens.operators import spatial, summaries
from petrilens.operators.graph import cut
from petrilens.plans import fixtures as X
from petrilens.plans.relational import r

Q: dict = {}
SQL: dict[str, str] = {}
P = M.PLANE
T = ("t",)
K = ("t", "label")


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LAP = """n AS (SELECT *, CASE WHEN mx > mn THEN (intensity - mn) / (mx - mn) ELSE 0 END AS v FROM (SELECT *, min(intensity) OVER (PARTITION BY t) AS mn, max(intensity) OVER (PARTITION BY t) AS mx FROM pixels)),
 lap AS (SELECT *, coalesce(lag(v) OVER h, v) + coalesce(lead(v) OVER h, v) + coalesce(lag(v) OVER w, v) + coalesce(lead(v) OVER w, v) - 4 * v AS lap FROM n WINDOW h AS (PARTITION BY t, y ORDER BY x), w AS (PARTITION BY t, x ORDER BY y))"""
MASK = """mask AS (SELECT t, y, x, intensity FROM pixels JOIN (SELECT t AS pt, avg(intensity) AS m, stddev_pop(intensity) AS s FROM pixels GROUP BY 1) ON t = pt WHERE intensity > m + 1.8 * s)"""
COMPONENTS = """e AS (SELECT a.t, a.y * 16384 + a.x AS a, b.y * 16384 + b.x AS b FROM mask a JOIN mask b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 reach(t, node, head) AS (SELECT t, a, b FROM e UNION SELECT r.t, r.node, e.b FROM reach r JOIN e ON r.t = e.t AND r.head = e.a),
 comp AS (SELECT t, node, min(head) AS c FROM reach GROUP BY 1, 2), labels AS (SELECT t, node // 16384 AS y, node % 16384 AS x, dense_rank() OVER (PARTITION BY t ORDER BY c) AS label FROM comp)"""
LABELS = f"{MASK}, {COMPONENTS}"


def _conv(out: str, src: str, kernel, axis: str) -> str:
    """CTE ``out(t, y, x, v)``: taps along an axis of ``src``, mirrored at the ends (``sz`` holds the last places)."""
    half, other, at = len(kernel) // 2, "x" if axis == "y" else "y", f"p.{axis} + k.i"
    taps = ", ".join(f"({i - half}, {float(w)!r}::DOUBLE)" for i, w in enumerate(kernel) if w)
    return f"""{out} AS (SELECT p.t, p.y, p.x, sum(k.w * q.v) AS v FROM {src} p JOIN sz ON sz.t = p.t CROSS JOIN (VALUES {taps}) AS k(i, w) JOIN {src} q ON q.t = p.t AND q.{other} = p.{other}
  AND q.{axis} = CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} > sz.m{axis} THEN 2 * sz.m{axis} + 1 - ({at}) ELSE {at} END GROUP BY 1, 2, 3)"""


SIZE = "sz AS (SELECT t, max(y) AS my, max(x) AS mx FROM pixels GROUP BY 1), v0 AS (SELECT t, y, x, intensity AS v FROM pixels)"
#: Second derivative of ``v0``.
LAP0 = """lap0 AS (SELECT *, coalesce(lag(v) OVER h, v) + coalesce(lead(v) OVER h, v) + coalesce(lag(v) OVER w, v) + coalesce(lead(v) OVER w, v) - 4 * v AS lap FROM v0 WINDOW h AS (PARTITION BY t, y ORDER BY x), w AS (PARTITION BY t, x ORDER BY y))"""
#: Convex hulls of ``labels``: the ends of every row of pixel corners, and the edges that leave all of them on one side.
HULL = """hc AS (SELECT t, label, y + d AS py, min(x) - 0.5::DOUBLE AS lo, max(x) + 0.5::DOUBLE AS hi FROM labels CROSS JOIN (VALUES (-0.5::DOUBLE), (0.5::DOUBLE)) AS k(d) GROUP BY 1, 2, 3), pts AS (SELECT t, label, py, lo AS px FROM hc UNION SELECT t, label, py, hi FROM hc),
 ed AS (SELECT a.t, a.label, a.px * b.py - b.px * a.py AS turn FROM pts a JOIN pts b ON a.t = b.t AND a.label = b.label AND (a.px <> b.px OR a.py <> b.py) WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE c.t = a.t AND c.label = a.label AND ((b.px - a.px) * (c.py - a.py) - (b.py - a.py) * (c.px - a.px) < 0
  OR (b.px - a.px) * (c.py - a.py) - (b.py - a.py) * (c.px - a.px) = 0 AND (c.px - a.px) * (c.px - b.px) + (c.py - a.py) * (c.py - b.py) > 0))),
 sol AS (SELECT t, label, n / (sum(turn) / 2) AS solidity FROM ed JOIN (SELECT t, label, count(*) AS n FROM labels GROUP BY 1, 2) USING (t, label) GROUP BY t, label, n)"""


def _mask(spark: SparkSession, sf: str, k: float = 1.8) -> DataFrame:
    return M.above_mean_sd(X.pixels(spark, sf), k)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return cut(M.with_label(M.label_mask(_mask(spark, sf).select(*T, "y", "x"), T), T).select("t", "y", "x", F.col("label").cast("long").alias("label")))


def _px(spark: SparkSession, sf: str) -> DataFrame:
    return X.pixels(spark, sf).select("t", "y", "x", "intensity")


@query("focus_variance", f"WITH {X.PIXELS}, {LAP} SELECT t, round(var_pop(lap), 8) AS focus_score, var_pop(lap) >= 0.2 AS passes FROM lap GROUP BY 1")
def focus_variance(spark, sf):
    return M.focus_variance(X.pixels(spark, sf), least=0.2).select("t", r("focus_score", 8).alias("focus_score"), "passes")


@query("focus_bright", f"""WITH {X.PIXELS}, {LAP}, l AS (SELECT t AS lt, quantile_cont(v, 0.975) AS lim, var_pop(lap) AS var FROM lap GROUP BY 1), g AS (SELECT t, any_value(var) AS variance, sum(v * lap * lap) FILTER (WHERE v >= lim) / sum(v) FILTER (WHERE v >= lim) AS bright, count(*) FILTER (WHERE v >= lim) AS n FROM lap JOIN l ON t = lt GROUP BY 1)
 SELECT t, round(variance, 8) AS variance, round(CASE WHEN n < 50 THEN 0.25 * variance ELSE bright END, 8) AS bright, round(0.2 * variance + 0.8 * CASE WHEN n < 50 THEN 0.25 * variance ELSE bright END, 8) AS hybrid FROM g""")
def focus_bright(spark, sf):
    return M.focus_bright(X.pixels(spark, sf)).select("t", *[r(n, 8).alias(n) for n in ("variance", "bright", "hybrid")])


@query("focus_objects", f"""WITH RECURSIVE {X.PIXELS}, {SIZE}, {LAP}, nv AS (SELECT t, y, x, v FROM n), {_conv("sx", "nv", M.gaussian_kernel(1.5), "x")}, {_conv("sm", "sx", M.gaussian_kernel(1.5), "y")},
 st AS (SELECT l.t, avg(l.v) + 1.5 * stddev_pop(s.v) AS thr, avg(l.v) AS m, var_pop(l.lap) AS pv FROM lap l JOIN sm s ON l.t = s.t AND l.y = s.y AND l.x = s.x GROUP BY 1), lit AS (SELECT n.t FROM n JOIN st USING (t) GROUP BY 1 HAVING avg(CASE WHEN v > m THEN 1 ELSE 0 END) >= 0.005),
 mask AS (SELECT s.t, s.y, s.x FROM sm s JOIN st USING (t) JOIN lit USING (t) WHERE s.v > thr AND thr < 1), {COMPONENTS}, {HULL},
 g AS (SELECT l.t, l.label, count(*) AS a, avg(p.v) AS m, var_pop(p.lap) AS lv, var_pop(l.y) + 1 / 12.0::DOUBLE AS myy, var_pop(l.x) + 1 / 12.0::DOUBLE AS mxx, covar_pop(l.y, l.x) AS mxy FROM labels l JOIN lap p ON l.t = p.t AND l.y = p.y AND l.x = p.x GROUP BY 1, 2 HAVING count(*) BETWEEN 4 AND 2000),
 ec AS (SELECT *, sqrt(4 * mxy * mxy + (mxx - myy) * (mxx - myy)) AS rt FROM g), ob AS (SELECT t, a * ec.m * greatest(0.05, 1 - sqrt(1 - (mxx + myy - rt) / (mxx + myy + rt))) * greatest(0.05, solidity) * (1 + 0.5::DOUBLE * lv / (pv + 1e-12)) AS s FROM ec JOIN sol USING (t, label) JOIN st USING (t))
 SELECT st.t, round(coalesce(sum(s), 0), 4) AS object_focus, count(s) AS n_objects FROM st LEFT JOIN ob ON st.t = ob.t GROUP BY 1""")
def focus_objects(spark, sf):
    return M.focus_objects(X.pixels(spark, sf), area=(4, 2000)).select("t", r("object_focus", 4).alias("object_focus"), "n_objects")


@query("best_focus_window", f"""WITH {X.OBJECTS}, s AS (SELECT t, z, avg(area_px) AS score FROM objects GROUP BY 1, 2), e AS (SELECT *, min(z) OVER (PARTITION BY t) AS z0, max(z) OVER (PARTITION BY t) AS z1 FROM s), b AS (SELECT t AS bt, arg_max(z, score) AS bz FROM e WHERE z > z0 AND z < z1 GROUP BY 1)
 SELECT t, z, bz AS best_focus_z, round(score, 4) AS score FROM e JOIN b ON t = bt WHERE z BETWEEN greatest(bz - 1, least(z0 + 1, bz)) AND least(bz + 1, greatest(z1 - 1, bz))""")
def best_focus_window(spark, sf):
    s = X.objects(spark, sf).groupBy("t", "z").agg(F.avg("area_px").alias("score"))
    return M.best_focus_window(s, series=["t"], z="z", score="score", radius=1).select("t", "z", "best_focus_z", r("score", 4).alias("score"))


@query("keep_planes", f"""WITH {X.OBJECTS}, s AS (SELECT t, z, avg(area_px) AS score FROM objects GROUP BY 1, 2), g AS (SELECT t AS gt, quantile_cont(score, 0.4) AS c, min(z) AS z0, max(z) AS z1 FROM s GROUP BY 1) SELECT t, z, score >= c AS in_focus, z BETWEEN z0 + 1 AND z1 - 1 AS in_margin, score >= c AND z BETWEEN z0 + 1 AND z1 - 1 AS keep FROM s JOIN g ON t = gt""")
def keep_planes(spark, sf):
    s = X.objects(spark, sf).groupBy("t", "z").agg(F.avg("area_px").alias("score"))
    return M.keep_planes(s, series=["t"], z="z", score="score", q=0.4, margin=1).select("t", "z", "in_focus", "in_margin", "keep")


@query("convolve_gaussian", f"""WITH {X.PIXELS}, k AS (SELECT i, exp(-(i * i) / 2.0::DOUBLE) / (SELECT sum(exp(-(j * j) / 2.0::DOUBLE)) FROM (SELECT unnest(generate_series(-2, 2)) AS j)) AS w FROM (SELECT unnest(generate_series(-2, 2)) AS i)), n AS (SELECT t, max(y) + 1 AS h, max(x) + 1 AS wd FROM pixels GROUP BY 1),
 a AS (SELECT p.t, p.y, p.x, sum(k.w * q.intensity) AS v FROM pixels p JOIN n ON p.t = n.t CROSS JOIN k JOIN pixels q ON q.t = p.t AND q.y = p.y AND q.x = CASE WHEN p.x + i < 0 THEN -1 - (p.x + i) WHEN p.x + i >= wd THEN 2 * wd - 1 - (p.x + i) ELSE p.x + i END GROUP BY 1, 2, 3)
 SELECT p.t, p.y, p.x, round(sum(k.w * q.v), 6) AS smooth FROM a p JOIN n ON p.t = n.t CROSS JOIN k JOIN a q ON q.t = p.t AND q.x = p.x AND q.y = CASE WHEN p.y + i < 0 THEN -1 - (p.y + i) WHEN p.y + i >= h THEN 2 * h - 1 - (p.y + i) ELSE p.y + i END GROUP BY 1, 2, 3""")
def convolve_gaussian(spark, sf):
    d = M.separable(_px(spark, sf), "intensity", M.gaussian_kernel(1.0, 2), T, "smooth")
    return d.select("t", "y", "x", r("smooth").alias("smooth"))


@query("gradient_features", f"""WITH {X.PIXELS}, {SIZE}, {_conv("a1", "v0", [-1, 0, 1], "x")}, {_conv("gx", "a1", [1, 2, 1], "y")}, {_conv("a2", "v0", [-1, 0, 1], "y")}, {_conv("gy", "a2", [1, 2, 1], "x")}, {_conv("b1", "v0", M.gaussian_kernel(1.0), "x")}, {_conv("g1", "b1", M.gaussian_kernel(1.0), "y")},
 {_conv("b2", "v0", M.gaussian_kernel(2.0), "x")}, {_conv("g2", "b2", M.gaussian_kernel(2.0), "y")}, j AS (SELECT t, gx.v * gx.v + gy.v * gy.v AS e, g1.v - g2.v AS dog FROM gx JOIN gy USING (t, y, x) JOIN g1 USING (t, y, x) JOIN g2 USING (t, y, x))
 SELECT t, round(avg(e), 6) AS tenengrad, round(stddev_pop(dog), 6) AS dog_sd, round(avg(sqrt(e)), 6) AS gradient FROM j GROUP BY 1""")
def gradient_features(spark, sf):
    """Sobel energy and difference of Gaussians, per plane."""
    d = M.along(M.along(_px(spark, sf), "intensity", [-1, 0, 1], "x", T, "_gx0"), "_gx0", [1, 2, 1], "y", T, "gx")
    d = M.along(M.along(d, "intensity", [-1, 0, 1], "y", T, "_gy0"), "_gy0", [1, 2, 1], "x", T, "gy")
    d = M.separable(M.separable(d, "intensity", M.gaussian_kernel(1.0), T, "g1"), "intensity", M.gaussian_kernel(2.0), T, "g2")
    d = d.withColumn("energy", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).withColumn("dog", F.col("g1") - F.col("g2"))
    return d.groupBy("t").agg(r(F.avg("energy")).alias("tenengrad"), r(F.stddev_pop("dog")).alias("dog_sd"), r(F.avg(F.sqrt("energy"))).alias("gradient"))


@query("label_components", f"WITH RECURSIVE {X.PIXELS}, {LABELS} SELECT t, y, x, label FROM labels")
def label_components(spark, sf):
    return _labels(spark, sf)


REGION = """g AS (SELECT t, label, count(*) AS area_px, avg(y) AS cy, avg(x) AS cx, min(y) AS r0, min(x) AS c0, max(y) + 1 AS r1, max(x) + 1 AS c1 FROM labels GROUP BY 1, 2)"""

PERIMETER = """o AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS v(dy, dx)), b AS (SELECT DISTINCT l.t, l.label, l.y, l.x FROM labels l CROSS JOIN o WHERE NOT EXISTS (SELECT 1 FROM labels m WHERE m.t = l.t AND m.label = l.label AND m.y = l.y + dy AND m.x = l.x + dx)),
 w AS (SELECT a.t, a.label, a.y, a.x, 1 + 2 * count(*) FILTER (WHERE abs(a.y - c.y) + abs(a.x - c.x) = 1) + 10 * count(*) FILTER (WHERE abs(a.y - c.y) + abs(a.x - c.x) = 2) AS code FROM b a LEFT JOIN b c ON a.t = c.t AND a.label = c.label AND abs(a.y - c.y) <= 1 AND abs(a.x - c.x) <= 1 AND (a.y <> c.y OR a.x <> c.x) GROUP BY 1, 2, 3, 4),
 p AS (SELECT t, label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0::DOUBLE WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS per FROM w GROUP BY 1, 2)"""


@query("region_features", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, {REGION}, {PERIMETER}
 SELECT t, label, area_px, round(cy, 6) AS centroid_y_px, round(cx, 6) AS centroid_x_px, r0 AS bbox_min_row, c0 AS bbox_min_col, r1 AS bbox_max_row, c1 AS bbox_max_col, round(coalesce(per, 0), 6) AS perimeter_px, round(CASE WHEN per > 0 THEN 4 * pi() * area_px / (per * per) END, 6) AS circularity FROM g LEFT JOIN p USING (t, label) WHERE area_px >= 3""")
def region_features(spark, sf):
    d = M.regions(_labels(spark, sf), K, 3)
    return d.select("t", "label", "area_px", r("centroid_y_px").alias("centroid_y_px"), r("centroid_x_px").alias("centroid_x_px"), "bbox_min_row", "bbox_min_col", "bbox_max_row", "bbox_max_col", r("perimeter_px").alias("perimeter_px"), r("circularity").alias("circularity"))


@query("region_solidity", f"WITH RECURSIVE {X.PIXELS}, {LABELS}, {HULL} SELECT t, label, round(solidity, 6) AS solidity FROM sol")
def region_solidity(spark, sf):
    return M.solidity(_labels(spark, sf), K).select("t", "label", r("solidity").alias("solidity"))


@query("region_intensity", f"""WITH RECURSIVE {X.PIXELS}, {LABELS} SELECT l.t, label, count(intensity) AS n, round(sum(intensity), 6) AS intden, round(avg(intensity), 6) AS mean, round(median(intensity), 6) AS median, round(stddev_pop(intensity), 6) AS sd, round(max(intensity), 6) AS max FROM labels l LEFT JOIN pixels p ON l.t = p.t AND l.y = p.y AND l.x = p.x GROUP BY 1, 2""")
def region_intensity(spark, sf):
    return M.intensity_stats(_labels(spark, sf), _px(spark, sf), K, ["t", "y", "x"]).select("t", "label", "n", *[r(n).alias(n) for n in ("intden", "mean", "median", "sd", "max")])


@query("integrated_intensity", f"WITH {X.PIXELS} SELECT t, round(coalesce(sum(intensity) FILTER (WHERE intensity > 0.1), 0), 6) AS intden, count(*) FILTER (WHERE intensity > 0.1) AS n FROM pixels GROUP BY 1")
def integrated_intensity(spark, sf):
    return M.integrated_over(_px(spark, sf), T, 0.1).select("t", r("intden").alias("intden"), "n")


@query("otsu_threshold", f"""WITH {X.PIXELS}, l AS (SELECT t AS lt, min(intensity) AS lo, (max(intensity) - min(intensity)) / 64 AS w FROM pixels GROUP BY 1), c AS (SELECT t, least(floor((intensity - lo) / w), 63)::INT AS bin, count(*) AS n FROM pixels JOIN l ON t = lt GROUP BY 1, 2),
 h AS (SELECT lt AS t, b.bin, lo + b.bin * w AS lo2, (lo + b.bin * w + lo + (b.bin + 1) * w) / 2 AS mid, coalesce(n, 0) AS n FROM l CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS bin) b LEFT JOIN c ON c.t = lt AND c.bin = b.bin), p AS (SELECT *, n / sum(n) OVER (PARTITION BY t) AS p FROM h),
 q AS (SELECT *, sum(p) OVER u AS cw, sum(p * mid) OVER u AS cm, sum(p * mid) OVER (PARTITION BY t) AS mt FROM p WINDOW u AS (PARTITION BY t ORDER BY bin ROWS UNBOUNDED PRECEDING)), v AS (SELECT *, CASE WHEN cw <= 1e-12 OR cw >= 1 - 1e-12 THEN 0 ELSE (mt * cw - cm) * (mt * cw - cm) / (cw * (1 - cw)) END AS s FROM q),
 x AS (SELECT t, mid FROM v QUALIFY row_number() OVER (PARTITION BY t ORDER BY round(s, 9) DESC, bin) = 1) SELECT x.t, round(any_value(mid), 6) AS threshold, count(*) FILTER (WHERE intensity > mid) AS n_over FROM x JOIN pixels k ON x.t = k.t GROUP BY 1""")
def otsu_threshold(spark, sf):
    thr = summaries.otsu(_px(spark, sf), "intensity", T, 64)
    d = _px(spark, sf).join(thr, "t")
    return d.groupBy("t").agg(r(F.first("threshold")).alias("threshold"), F.count_if(F.col("intensity") > F.col("threshold")).alias("n_over"))


@query("class_map", f"""WITH {X.PIXELS}, {X.PROBS}, m AS (SELECT t, y, x, class_id, prob FROM probs QUALIFY row_number() OVER (PARTITION BY t, y, x ORDER BY prob DESC, class_id) = 1) SELECT t, class_id, count(*) AS n, round(avg(prob), 6) AS mean_prob FROM m GROUP BY 1, 2""")
def class_map(spark, sf):
    d = M.class_map(X.probs(X.pixels(spark, sf)), ["t", "y", "x"])
    return d.groupBy("t", "class_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("prob")).alias("mean_prob"))


@query("plane_index", f"""WITH {X.PIXELS}, {X.PROBS}, m AS (SELECT t, class_id FROM probs QUALIFY row_number() OVER (PARTITION BY t, y, x ORDER BY prob DESC, class_id) = 1), c AS (SELECT t, count(*) FILTER (WHERE class_id = 1) AS a, count(*) FILTER (WHERE class_id = 2) AS b FROM m GROUP BY 1),
 p AS (SELECT DISTINCT t // 5 AS s, t % 5 AS z, t FROM pixels), e AS (SELECT *, min(z) OVER (PARTITION BY s) AS z0, max(z) OVER (PARTITION BY s) AS z1, z = 2 AS inc FROM p)
 SELECT s, z, inc AS included, CASE WHEN inc THEN 'segmented' WHEN z = 1 AND s % 2 = 0 THEN 'skipped' WHEN z IN (z0, z1) THEN 'edge_z_excluded' ELSE 'outside_best_focus_window' END AS reason, CASE WHEN inc THEN a END AS nucleus_pixels, CASE WHEN inc THEN b END AS droplet_pixels FROM e JOIN c USING (t)""")
def plane_index(spark, sf):
    """Frames as stacks of five planes, the middle one segmented."""
    px = X.pixels(spark, sf).withColumn("s", F.floor(F.col("t") / 5)).withColumn("z", F.col("t") % 5)
    classes = M.class_map(X.probs(X.pixels(spark, sf)), ["t", "y", "x"]).select(F.floor(F.col("t") / 5).alias("s"), (F.col("t") % 5).alias("z"), "class_id")
    planes = px.select("s", "z").distinct()
    return M.plane_index(planes, planes.where("z = 2"), classes, ["s", "z"], {1: "nucleus", 2: "droplet"}, series=["s"], z="z", skipped=planes.where("z = 1 AND s % 2 = 0"))


@query("overlap_scores", f"""WITH {X.PIXELS}, {X.PROBS}, a AS (SELECT t, y, x, class_id FROM probs QUALIFY row_number() OVER (PARTITION BY t, y, x ORDER BY prob DESC, class_id) = 1), b AS (SELECT t, y, x, CASE WHEN intensity > 0.1 THEN 1 ELSE 0 END AS class_id FROM pixels), j AS (SELECT a.class_id AS tc, b.class_id AS pc FROM a JOIN b USING (t, y, x))
 SELECT k.class_id, round((2 * count(*) FILTER (WHERE tc = k.class_id AND pc = k.class_id) + 1.0::DOUBLE) / (count(*) FILTER (WHERE tc = k.class_id) + count(*) FILTER (WHERE pc = k.class_id) + 1), 6) AS dice, round((count(*) FILTER (WHERE tc = k.class_id AND pc = k.class_id) + 1.0::DOUBLE) / (count(*) FILTER (WHERE tc = k.class_id OR pc = k.class_id) + 1), 6) AS iou FROM j CROSS JOIN (VALUES (0), (1), (2)) AS k(class_id) GROUP BY 1""")
def overlap_scores(spark, sf):
    px = X.pixels(spark, sf)
    truth = M.class_map(X.probs(px), ["t", "y", "x"])
    pred = px.select("t", "y", "x", F.when(F.col("intensity") > 0.1, 1).otherwise(0).alias("class_id"))
    return M.overlap_scores(truth, pred, ["t", "y", "x"], [0, 1, 2]).select("class_id", r("dice").alias("dice"), r("iou").alias("iou"))


@query("overlap_totals", f"""WITH {X.PIXELS}, {X.PROBS}, a AS (SELECT t, y, x, class_id FROM probs QUALIFY row_number() OVER (PARTITION BY t, y, x ORDER BY prob DESC, class_id) = 1), b AS (SELECT t, y, x, CASE WHEN intensity > 0.1 THEN 1 ELSE 0 END AS class_id FROM pixels), j AS (SELECT a.class_id AS tc, b.class_id AS pc FROM a JOIN b USING (t, y, x)),
 s AS (SELECT k.class_id, w, (2 * count(*) FILTER (WHERE tc = k.class_id AND pc = k.class_id) + 1.0::DOUBLE) / (count(*) FILTER (WHERE tc = k.class_id) + count(*) FILTER (WHERE pc = k.class_id) + 1) AS dice, (count(*) FILTER (WHERE tc = k.class_id AND pc = k.class_id) + 1.0::DOUBLE) / (count(*) FILTER (WHERE tc = k.class_id OR pc = k.class_id) + 1) AS iou FROM j CROSS JOIN (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 4.0)) AS k(class_id, w) GROUP BY 1, 2)
 SELECT round(avg(dice), 6) AS mean_dice, round(sum(w * dice) / sum(w), 6) AS weighted_dice, round(avg(iou) FILTER (WHERE class_id <> 0), 6) AS macro_iou FROM s""")
def overlap_totals(spark, sf):
    px = X.pixels(spark, sf)
    truth = M.class_map(X.probs(px), ["t", "y", "x"])
    pred = px.select("t", "y", "x", F.when(F.col("intensity") > 0.1, 1).otherwise(0).alias("class_id"))
    d = M.overlap_totals(M.overlap_scores(truth, pred, ["t", "y", "x"], [0, 1, 2]), {0: 1.0, 1: 2.0, 2: 4.0})
    return d.select(*[r(n).alias(n) for n in ("mean_dice", "weighted_dice", "macro_iou")])


DIST = """d AS (SELECT p.t, p.y, p.x, l.label, any_value(p.intensity) AS intensity, min(sqrt((p.y - l.y) * (p.y - l.y) + (p.x - l.x) * (p.x - l.x))) AS distance FROM pixels p JOIN labels l ON p.t = l.t AND abs(p.y - l.y) <= 4 AND abs(p.x - l.x) <= 4 AND (p.y - l.y) * (p.y - l.y) + (p.x - l.x) * (p.x - l.x) <= 16 GROUP BY 1, 2, 3, 4)"""
#: Depth inside: distance to the nearest pixel of the image that is not of the label, up to 4.
DEPTH = """dep AS (SELECT l.t, l.label, l.y, l.x, min(sqrt((p.y - l.y) * (p.y - l.y) + (p.x - l.x) * (p.x - l.x))) AS depth FROM labels l JOIN pixels p ON p.t = l.t AND abs(p.y - l.y) <= 4 AND abs(p.x - l.x) <= 4 AND (p.y - l.y) * (p.y - l.y) + (p.x - l.x) * (p.x - l.x) <= 16
  LEFT JOIN labels m ON m.t = p.t AND m.y = p.y AND m.x = p.x AND m.label = l.label WHERE m.t IS NULL GROUP BY 1, 2, 3, 4),
 sd AS (SELECT t, label, y, x, intensity, distance AS sd FROM d WHERE distance > 0 UNION ALL SELECT i.t, i.label, i.y, i.x, p.intensity, -depth FROM dep i JOIN pixels p ON i.t = p.t AND i.y = p.y AND i.x = p.x)"""


#: The zones of the halo table, as conditions on distance (0 inside) and depth.
ZONES = {"nucleus": "distance = 0", "nucleus_eroded": "distance = 0 AND (depth IS NULL OR depth > 1)", "cytoplasm": "distance > 0"}
ZONES |= {f"halo_{k}_cum": f"distance > 0 AND distance <= {k}" for k in range(1, 5)} | {f"ring_{k}": f"distance > {k - 1} AND distance <= {k}" for k in range(1, 5)}
HALO_COLUMNS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}_area_px, round(coalesce(sum(intensity) FILTER (WHERE {c}), 0), 6) AS {n}_intden, round(avg(intensity) FILTER (WHERE {c}), 6) AS {n}_mean_intensity" for n, c in ZONES.items())


@query("halo_measurements", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, {DIST}, {DEPTH}, z AS (SELECT d.*, CASE WHEN d.distance = 0 THEN dep.depth END AS depth FROM d LEFT JOIN dep ON d.t = dep.t AND d.label = dep.label AND d.y = dep.y AND d.x = dep.x)
 SELECT t, label, {HALO_COLUMNS}, round(avg(intensity) FILTER (WHERE distance = 0) / nullif(avg(intensity) FILTER (WHERE distance > 0), 0), 4) AS nc_ratio,
 round(avg(intensity) FILTER (WHERE distance = 0) / nullif(avg(intensity) FILTER (WHERE distance = 0) + avg(intensity) FILTER (WHERE distance > 0), 0), 4) AS nc_ratio_fraction FROM z GROUP BY 1, 2""")
def halo_measurements(spark, sf):
    d = M.halos(_px(spark, sf), _labels(spark, sf), T, step=1.0, n=4, erode=1.0)
    told = [c for n in ZONES for c in (F.col(f"{n}_area_px"), r(f"{n}_intden").alias(f"{n}_intden"), r(f"{n}_mean_intensity").alias(f"{n}_mean_intensity"))]
    return d.select("t", "label", *told, r("nc_ratio", 4).alias("nc_ratio"), r("nc_ratio_fraction", 4).alias("nc_ratio_fraction"))


@query("signed_shells", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, {DIST}, {DEPTH}, g AS (SELECT DISTINCT t, label, k AS shell FROM labels CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS k))
 SELECT g.t, g.label, g.shell, CASE WHEN g.shell - 1 <= 0 THEN 'inside' WHEN g.shell - 2 >= 0 THEN 'outside' ELSE 'boundary' END AS side, count(sd) AS n, round(sum(intensity), 6) AS sum, round(avg(intensity), 6) AS mean, round(median(intensity), 6) AS median, round(stddev_pop(intensity), 6) AS sd
 FROM g LEFT JOIN sd s ON s.t = g.t AND s.label = g.label AND s.sd >= -2 AND s.sd < 2 AND floor(s.sd + 2)::INT = g.shell GROUP BY 1, 2, 3""")
def signed_shells(spark, sf):
    d = M.signed_shells(_px(spark, sf), _labels(spark, sf), T, radius=2.0, width=1.0)
    return d.select("t", "label", "shell", "side", "n", *[r(n).alias(n) for n in ("sum", "mean", "median", "sd")])


@query("boundary_halos", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, {DIST}, {DEPTH}, b AS (SELECT t, label, count(*) FILTER (WHERE sd > -2 AND sd <= 0) AS n1, avg(intensity) FILTER (WHERE sd > -2 AND sd <= 0) AS m1, count(*) FILTER (WHERE abs(sd) <= 0.5) AS n2, count(*) FILTER (WHERE sd > 0 AND sd <= 2) AS n3, avg(intensity) FILTER (WHERE sd > 0 AND sd <= 2) AS m3,
  count(*) FILTER (WHERE sd > 2 AND sd <= 4) AS n4, avg(intensity) FILTER (WHERE sd > 2 AND sd <= 4) AS m4, sum(intensity) FILTER (WHERE sd > 2 AND sd <= 4) AS s4 FROM sd GROUP BY 1, 2), u AS (SELECT l.t, l.label, count(*) AS n0, avg(intensity) AS m0 FROM labels l JOIN pixels p ON l.t = p.t AND l.y = p.y AND l.x = p.x GROUP BY 1, 2)
 SELECT t, label, n0 AS nuclear_area_px, round(m0, 6) AS nuclear_mean, n1 AS h1_area_px, round(m1, 6) AS h1_mean, n2 AS h2_area_px, n3 AS h3_area_px, round(m3, 6) AS h3_mean, n4 AS h4_area_px, round(m4, 6) AS h4_mean, n4 AS ring_area_px, round(s4 / nullif(n4, 0), 5) AS ring_mean, round(m0 / nullif(s4 / nullif(n4, 0), 0), 3) AS nc_ratio FROM u LEFT JOIN b USING (t, label)""")
def boundary_halos(spark, sf):
    d = M.boundary_halos(_px(spark, sf), _labels(spark, sf), T, step=2.0)
    return d.select("t", "label", "nuclear_area_px", "h1_area_px", "h2_area_px", "h3_area_px", "h4_area_px", "ring_area_px", *[r(n).alias(n) for n in ("nuclear_mean", "h1_mean", "h3_mean", "h4_mean")], r("ring_mean", 5).alias("ring_mean"), r("nc_ratio", 3).alias("nc_ratio"))


@query("droplet_territories", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, {DIST}, w AS (SELECT t, y, x, label, distance, intensity FROM d QUALIFY row_number() OVER (PARTITION BY t, y, x ORDER BY distance, label) = 1), h AS (SELECT t, label, (y // 40) * 2 + x // 40 AS home, count(*) AS n FROM labels GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY t, label ORDER BY n DESC, home) = 1),
 k AS (SELECT w.* FROM w JOIN h ON w.t = h.t AND w.label = h.label AND (w.y // 40) * 2 + w.x // 40 = home), g AS (SELECT k.t, k.label, any_value(home) AS home, count(*) AS n, avg(intensity) FILTER (WHERE distance = 0) AS a, avg(intensity) FILTER (WHERE distance > 0 AND distance <= 2) AS b FROM k JOIN h ON k.t = h.t AND k.label = h.label GROUP BY 1, 2)
 SELECT t, label AS nucleus_id, home::BIGINT AS droplet_id, n, round(a, 6) AS inner, round(b, 6) AS halo, round(a / nullif(b, 0), 3) AS nc_ratio FROM g""")
def droplet_territories(spark, sf):
    """Halos inside each nucleus's droplet, nearest nucleus first: N/C of inner and boundary zones."""
    px = _px(spark, sf)
    nuclei = _labels(spark, sf).withColumnRenamed("label", "nucleus_id")
    drops = px.select("t", "y", "x", (F.floor(F.col("y") / 40) * 2 + F.floor(F.col("x") / 40)).cast("long").alias("droplet_id"))
    d = M.territories(px, nuclei, drops, T, 4.0).join(px, ["t", "y", "x"])
    zone = lambda on: F.avg(F.when(on, F.col("intensity")))
    g = d.groupBy("t", "nucleus_id", "droplet_id").agg(F.count(F.lit(1)).alias("n"), zone(F.col("distance") == 0).alias("a"), zone((F.col("distance") > 0) & (F.col("distance") <= 2)).alias("b"))
    return g.select("t", "nucleus_id", "droplet_id", "n", r("a").alias("inner"), r("b").alias("halo"), r(F.try_divide(F.col("a"), F.col("b")), 3).alias("nc_ratio"))


@query("parent_overlap", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, o AS (SELECT t * 100000 + label AS child, (y // 30) * 3 + x // 30 + 1 AS parent, count(*) AS n FROM labels WHERE (y // 30 + x // 30) % 2 = 0 GROUP BY 1, 2), c AS (SELECT DISTINCT t * 100000 + label AS child FROM labels), b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) = 1)
 SELECT c.child, coalesce(b.parent, 0) AS parent, coalesce(b.n, 0) AS overlap FROM c LEFT JOIN b USING (child)""")
def parent_overlap(spark, sf):
    children = _labels(spark, sf).select("t", "y", "x", (F.col("t") * 100000 + F.col("label")).alias("child"))
    cell = _px(spark, sf).select("t", "y", "x", F.floor(F.col("y") / 30).alias("i"), F.floor(F.col("x") / 30).alias("j")).where("(i + j) % 2 = 0")
    parents = cell.select("t", "y", "x", (F.col("i") * 3 + F.col("j") + 1).alias("parent"))
    return spatial.parent_by_overlap(children, parents, pixel=["t", "y", "x"])


@query("parent_centroid", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, {REGION} SELECT g.t, g.label, p.label AS parent FROM g JOIN labels p ON g.t = p.t AND p.y = least(greatest(round_even(g.cy, 0), 0), 79)::INT AND p.x = least(greatest(round_even(g.cx, 0), 0), 79)::INT""")
def parent_centroid(spark, sf):
    lab = _labels(spark, sf)
    d = spatial.parent_at_centroid(M.regions(lab, K), lab, x="centroid_x_px", y="centroid_y_px", width=80, height=80, on=["t"])
    return d.select("t", "label", "parent")


SIDES = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS o(dy, dx)"


def _reach(out: str, src: str, steps: int) -> str:
    """CTEs: ``out(t, y, x, n)``, the places of ``src`` with how many they reach over 4-neighbours in ``steps`` steps."""
    return f"""{out}_r(t, y, x, a, b, k) AS (SELECT t, y, x, y, x, 0 FROM {src} UNION SELECT r.t, r.y, r.x, s.y, s.x, k + 1 FROM {out}_r r CROSS JOIN {SIDES} JOIN {src} s ON s.t = r.t AND s.y = r.a + dy AND s.x = r.b + dx WHERE k < {steps}),
 {out} AS (SELECT t, y, x, count(DISTINCT a * 16384 + b) AS n FROM {out}_r GROUP BY 1, 2, 3)"""


GRID = "(SELECT DISTINCT t FROM kept) CROSS JOIN (SELECT unnest(generate_series(0, 79)) AS y) CROSS JOIN (SELECT unnest(generate_series(0, 79)) AS x)"
CROSS = "(VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) AS o(dy, dx)"


@query("clean_mask", f"""WITH RECURSIVE {X.PIXELS}, {MASK.replace("mask AS", "mask0 AS", 1).replace("1.8", "0.5")}, {_reach("m1", "mask0", 2)}, kept AS (SELECT t, y, x FROM m1 WHERE n >= 3), back AS (SELECT t, y, x FROM {GRID} EXCEPT SELECT t, y, x FROM kept), {_reach("b1", "back", 5)}, filled AS (SELECT t, y, x FROM kept UNION ALL SELECT t, y, x FROM b1 WHERE n < 6),
 eroded AS (SELECT f.t, f.y, f.x FROM filled f CROSS JOIN {CROSS} LEFT JOIN filled q ON q.t = f.t AND q.y = f.y + dy AND q.x = f.x + dx GROUP BY 1, 2, 3 HAVING bool_and(q.t IS NOT NULL OR f.y + dy NOT BETWEEN 0 AND 79 OR f.x + dx NOT BETWEEN 0 AND 79)),
 opened AS (SELECT DISTINCT t, y + dy AS y, x + dx AS x FROM eroded CROSS JOIN {CROSS} WHERE y + dy BETWEEN 0 AND 79 AND x + dx BETWEEN 0 AND 79), back2 AS (SELECT t, y, x FROM {GRID.replace("kept", "opened")} EXCEPT SELECT t, y, x FROM opened),
 sea(t, y, x) AS (SELECT t, y, x FROM back2 WHERE y IN (0, 79) OR x IN (0, 79) UNION SELECT b.t, b.y, b.x FROM sea s CROSS JOIN {SIDES} JOIN back2 b ON b.t = s.t AND b.y = s.y + dy AND b.x = s.x + dx), mask AS (SELECT t, y, x FROM {GRID.replace("kept", "opened")} EXCEPT SELECT t, y, x FROM sea), {COMPONENTS}, {PERIMETER},
 good AS (SELECT l.t, l.label FROM labels l JOIN p USING (t, label) GROUP BY 1, 2 HAVING count(*) >= 3 AND 4 * pi() * count(*) / (any_value(per) * any_value(per)) >= 0.45)
 SELECT t, count(*) AS n, sum(y)::BIGINT AS sum_y, sum(x)::BIGINT AS sum_x FROM labels SEMI JOIN good USING (t, label) GROUP BY 1""")
def clean_mask(spark, sf):
    d = M.clean_mask(_mask(spark, sf, 0.5), T, width=80, height=80, small=3, hole=6, opening=1, least_circularity=0.45)
    return d.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


SQUARE = "(SELECT a AS dy, b AS dx FROM (VALUES (-1), (0), (1)) AS u(a) CROSS JOIN (VALUES (-1), (0), (1)) AS w(b)) o"


@query("rim_contrast", f"""WITH {X.PIXELS}, {MASK}, {SIZE}, {LAP0}, near AS (SELECT DISTINCT m.t, m.y, m.x, m.y + dy AS qy, m.x + dx AS qx FROM mask m CROSS JOIN {SQUARE} WHERE m.y + dy BETWEEN 0 AND 79 AND m.x + dx BETWEEN 0 AND 79), off AS (SELECT n.* FROM near n LEFT JOIN mask k ON k.t = n.t AND k.y = n.qy AND k.x = n.qx WHERE k.t IS NULL),
 rims AS (SELECT DISTINCT t, y, x, 'in' AS rim FROM off UNION ALL SELECT DISTINCT t, qy, qx, 'out' FROM off), g AS (SELECT l.t, sum(lap * lap) FILTER (WHERE rim = 'in') AS i, sum(lap * lap) FILTER (WHERE rim = 'out') AS o FROM lap0 l JOIN rims USING (t, y, x) GROUP BY 1)
 SELECT sz.t, round(i, 6) AS inner, round(o, 6) AS outer, round((i - o) / nullif(i + o, 0), 6) AS contrast, CASE WHEN i IS NULL THEN 'empty-mask' ELSE 'ok' END AS tag FROM sz LEFT JOIN g ON sz.t = g.t""")
def rim_contrast(spark, sf):
    d = M.laplacian(_px(spark, sf), "intensity", T).withColumn("energy", F.col("lap") * F.col("lap"))
    return M.rim_contrast(d, _mask(spark, sf), T, value="energy", half=1, width=80, height=80).select("t", r("inner").alias("inner"), r("outer").alias("outer"), r("contrast").alias("contrast"), "tag")


FIVE = "PARTITION BY t ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"


@query("tail_clip", f"""WITH {X.PIXELS}, {LAP}, d AS (SELECT t, v FROM n WHERE v > 0), c AS (SELECT t, least(floor(v * 64), 63)::INT AS bin, count(*) AS k FROM d GROUP BY 1, 2), g AS (SELECT a.t, b.bin, coalesce(k, 0) AS k FROM (SELECT DISTINCT t FROM d) a CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS bin) b LEFT JOIN c ON c.t = a.t AND c.bin = b.bin),
 h AS (SELECT t, bin, ln(1 + sum(k) OVER ({FIVE}) / 5.0::DOUBLE) AS s FROM g), sl AS (SELECT t, bin, (bin + 0.5::DOUBLE) / 64 AS mid, (coalesce(lead(s) OVER w, s) - coalesce(lag(s) OVER w, s)) * 64 / CASE WHEN bin IN (0, 63) THEN 1 ELSE 2 END AS slope FROM h WINDOW w AS (PARTITION BY t ORDER BY bin)),
 q AS (SELECT t, quantile_cont(v, 0.9) AS f, count(*) AS k FROM d GROUP BY 1), tl AS (SELECT t, bin, mid, sum(slope) OVER ({FIVE}) / 5 AS fall, count(*) OVER (PARTITION BY t) AS nb FROM sl JOIN q USING (t) WHERE mid >= f), st AS (SELECT t, mid AS raw, nb FROM tl QUALIFY row_number() OVER (PARTITION BY t ORDER BY round(fall, 9), bin) = 1),
 sh AS (SELECT d.t, avg(CASE WHEN v <= raw THEN 1.0::DOUBLE ELSE 0 END) AS share, any_value(nb) AS nb FROM d JOIN st USING (t) GROUP BY 1), ch AS (SELECT q.t, k, CASE WHEN coalesce(nb, 0) < 5 THEN 0.999::DOUBLE ELSE least(greatest(share, 0.95::DOUBLE), 0.999::DOUBLE) END AS qt FROM q LEFT JOIN sh USING (t)),
 rk AS (SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY v) - 1 AS i, lead(v) OVER (PARTITION BY t ORDER BY v) AS nx FROM d), cu AS (SELECT t, v + (coalesce(nx, v) - v) * (qt * (k - 1) - floor(qt * (k - 1))) AS cutoff, qt FROM rk JOIN ch USING (t) WHERE i = floor(qt * (k - 1))),
 cl AS (SELECT n.t, least(n.v, coalesce(cutoff, 1)) AS c, coalesce(cutoff, 1) AS cutoff, coalesce(qt, 1) AS qt FROM n LEFT JOIN cu USING (t)), e AS (SELECT *, min(c) OVER (PARTITION BY t) AS lo, max(c) OVER (PARTITION BY t) AS hi FROM cl)
 SELECT t, round(any_value(cutoff), 6) AS cutoff, round(any_value(qt), 6) AS quantile, round(avg(CASE WHEN hi > lo THEN (c - lo) / (hi - lo) ELSE 0 END), 6) AS mean, count(*) FILTER (WHERE c >= hi AND hi > lo) AS at_top FROM e GROUP BY 1""")
def tail_clip(spark, sf):
    d = M.clip_tail(_px(spark, sf), T)
    return d.groupBy("t").agg(r(F.first("cutoff")).alias("cutoff"), r(F.first("quantile")).alias("quantile"), r(F.avg("clipped")).alias("mean"), F.count_if(F.col("clipped") >= 1.0).alias("at_top"))


@query("parent_threshold", f"""WITH {X.PIXELS}, d AS (SELECT *, (y // 20) * 4 + x // 20 AS droplet_id FROM pixels), g AS (SELECT t AS gt, droplet_id AS gd, avg(intensity) + stddev_pop(intensity) AS lim, max(intensity) - min(intensity) AS rng FROM d GROUP BY 1, 2) SELECT t, droplet_id, count(*) AS n, round(sum(intensity), 6) AS intden FROM d JOIN g ON t = gt AND droplet_id = gd WHERE rng >= 1e-6 AND intensity > lim GROUP BY 1, 2""")
def parent_threshold(spark, sf):
    px = _px(spark, sf)
    drops = px.select("t", "y", "x", (F.floor(F.col("y") / 20) * 4 + F.floor(F.col("x") / 20)).alias("droplet_id"))
    return M.parent_threshold(px, drops, T, k=1.0).groupBy("t", "droplet_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("intensity")).alias("intden"))


@query("max_projection", f"WITH {X.PIXELS} SELECT t // 2 AS t2, c, y, x, round(max(intensity), 6) AS intensity FROM pixels GROUP BY 1, 2, 3, 4")
def max_projection(spark, sf):
    px = X.pixels(spark, sf).withColumn("z", F.col("t") % 2).withColumn("t", F.floor(F.col("t") / 2))
    return M.max_projection(px).select(F.col("t").alias("t2"), "c", "y", "x", r("intensity").alias("intensity"))


@query("patch_stitch", f"""WITH {X.PIXELS}, s AS (SELECT * FROM (VALUES (0), (16), (32), (48)) AS v(s)), p AS (SELECT t, y, x, intensity, a.s AS py, b.s AS px FROM pixels JOIN s a ON y >= a.s AND y < a.s + 32 JOIN s b ON x >= b.s AND x < b.s + 32), n AS (SELECT *, max(intensity) OVER (PARTITION BY t, py, px) AS top FROM p)
 SELECT t, y, x, round(avg(CASE WHEN top > 0 THEN intensity / top ELSE intensity END), 6) AS intensity, count(*) AS n_patches FROM n GROUP BY 1, 2, 3""")
def patch_stitch(spark, sf):
    d = M.cut_patches(_px(spark, sf), width=80, height=80, size=32, stride=16)
    return M.stitch(M.normalise_patch(d, ["t", "patch_y", "patch_x"]), ["t", "y", "x"], "intensity").select("t", "y", "x", r("intensity").alias("intensity"), "n_patches")


@query("droplet_focus", f"""WITH {X.PIXELS}, {LAP}, a AS (SELECT *, (y // 20) * 4 + x // 20 AS droplet_id, (y // 20 + x // 20) % 2 = 0 AS inm FROM lap), edge AS (SELECT DISTINCT p.t, p.y, p.x FROM a p JOIN a q ON p.t = q.t AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 WHERE p.inm AND NOT q.inm),
 s AS (SELECT a.t // 2 AS t, a.t % 2 AS z, droplet_id, avg(lap * lap) FILTER (WHERE e.t IS NULL) AS laplacian, avg(lap * lap) FILTER (WHERE e.t IS NOT NULL) AS ring, avg(v) FILTER (WHERE e.t IS NULL) / (avg(v) FILTER (WHERE e.t IS NOT NULL) + 1e-6) AS contrast FROM a LEFT JOIN edge e ON e.t = a.t AND e.y = a.y AND e.x = a.x WHERE inm GROUP BY 1, 2, 3),
 k AS (SELECT *, max(laplacian) OVER (PARTITION BY t) AS peak FROM s), m AS (SELECT *, CASE WHEN peak < 0.35 THEN 'ring' WHEN peak < 0.52 THEN 'contrast' ELSE 'laplacian' END AS metric FROM k), c AS (SELECT *, CASE metric WHEN 'ring' THEN ring WHEN 'contrast' THEN contrast ELSE laplacian END AS score FROM m)
 SELECT t, droplet_id::BIGINT AS droplet_id, metric, round(peak, 6) AS peak, z AS best_z, round(score, 6) AS score FROM c WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t, droplet_id ORDER BY score DESC, z) = 1 AND score >= 0.3""")
def droplet_focus(spark, sf):
    """Focus of each droplet on the planes of a series (frames taken in pairs), and its best plane."""
    px = _px(spark, sf).withColumn("z", F.col("t") % 2).withColumn("t", F.floor(F.col("t") / 2))
    cell = px.withColumn("i", F.floor(F.col("y") / 20)).withColumn("j", F.floor(F.col("x") / 20)).where("(i + j) % 2 = 0")
    drops = cell.select("t", "z", "y", "x", (F.col("i") * 4 + F.col("j")).alias("droplet_id"))
    s = M.droplet_focus(px, drops, ["t", "z"])
    d = M.best_droplet_plane(s, series=["t"], z="z", signal=0.35, texture=0.52, floor=0.3)
    return d.select("t", "droplet_id", "metric", r("peak").alias("peak"), "best_z", r("score").alias("score"))


@query("parent_otsu", f"""WITH RECURSIVE {X.PIXELS}, d AS (SELECT t * 100 + (y // 20) * 4 + x // 20 AS g, t AS t0, y, x, intensity FROM pixels), l AS (SELECT g AS lg, min(intensity) AS lo, (max(intensity) - min(intensity)) / 64 AS w FROM d GROUP BY 1 HAVING max(intensity) - min(intensity) >= 1e-6), c AS (SELECT g, least(floor((intensity - lo) / w), 63)::INT AS bin, count(*) AS n FROM d JOIN l ON g = lg GROUP BY 1, 2),
 h AS (SELECT lg AS g, b.bin, (lo + b.bin * w + lo + (b.bin + 1) * w) / 2 AS mid, coalesce(n, 0) AS n FROM l CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS bin) b LEFT JOIN c ON c.g = lg AND c.bin = b.bin), p AS (SELECT *, n / sum(n) OVER (PARTITION BY g) AS p FROM h),
 q AS (SELECT *, sum(p) OVER u AS cw, sum(p * mid) OVER u AS cm, sum(p * mid) OVER (PARTITION BY g) AS mt FROM p WINDOW u AS (PARTITION BY g ORDER BY bin ROWS UNBOUNDED PRECEDING)), v AS (SELECT *, CASE WHEN cw <= 1e-12 OR cw >= 1 - 1e-12 THEN 0 ELSE (mt * cw - cm) * (mt * cw - cm) / (cw * (1 - cw)) END AS s FROM q),
 th AS (SELECT g, mid FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(s, 9) DESC, bin) = 1), mask AS (SELECT d.g AS t, y, x FROM d JOIN th ON d.g = th.g WHERE intensity > mid), nb(t, y, x, a, b, k) AS (SELECT t, y, x, y, x, 0 FROM mask UNION SELECT r.t, r.y, r.x, s.y, s.x, k + 1 FROM nb r CROSS JOIN {SQUARE} JOIN mask s ON s.t = r.t AND s.y = r.a + dy AND s.x = r.b + dx WHERE k < 3),
 sz4 AS (SELECT t, y, x, count(DISTINCT a * 16384 + b) AS n FROM nb GROUP BY 1, 2, 3) SELECT (t // 100)::INT AS t, t % 100 AS droplet_id, count(*) AS n, sum(y)::BIGINT AS sum_y, sum(x)::BIGINT AS sum_x FROM sz4 WHERE n >= 4 GROUP BY 1, 2""")
def parent_otsu(spark, sf):
    px = _px(spark, sf)
    drops = px.select("t", "y", "x", (F.floor(F.col("y") / 20) * 4 + F.floor(F.col("x") / 20)).alias("droplet_id"))
    d = M.parent_otsu(px, drops, T, bins=64, area=(4, 400))
    return d.groupBy("t", "droplet_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


@query("derive_mask")
def derive_mask(spark, sf):
    """Masks by the global rule: smooth, robust z, over Otsu, components of some size, small holes filled."""
    d = M.derive_mask(_px(spark, sf), T, sigma=1.0, factor=1.0, least_area=5, hole=4, width=80, height=80)
    return d.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


@query("pixel_features", f"""WITH {X.PIXELS}, {SIZE}, {_conv("b1", "v0", M.gaussian_kernel(1.0), "x")}, {_conv("g1", "b1", M.gaussian_kernel(1.0), "y")}, {_conv("b2", "v0", M.gaussian_kernel(2.0), "x")}, {_conv("g2", "b2", M.gaussian_kernel(2.0), "y")}, {_conv("x1", "g1", [-0.5, 0, 0.5], "x")}, {_conv("y1", "g1", [-0.5, 0, 0.5], "y")}, {_conv("x2", "g2", [-0.5, 0, 0.5], "x")}, {_conv("y2", "g2", [-0.5, 0, 0.5], "y")},
 md AS (SELECT a.t, a.y, a.x, median(b.v) AS m FROM v0 a CROSS JOIN {SQUARE} JOIN v0 b ON b.t = a.t AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3)
 SELECT t, y, x, round(g1.v, 6) AS smooth_0, round(sqrt(x1.v * x1.v + y1.v * y1.v), 6) AS gradient_0, round(g2.v, 6) AS smooth_1, round(sqrt(x2.v * x2.v + y2.v * y2.v), 6) AS gradient_1, round(m, 6) AS median FROM g1 JOIN x1 USING (t, y, x) JOIN y1 USING (t, y, x) JOIN g2 USING (t, y, x) JOIN x2 USING (t, y, x) JOIN y2 USING (t, y, x) JOIN md USING (t, y, x)""")
def pixel_features(spark, sf):
    d = M.pixel_features(_px(spark, sf), T)
    return d.select("t", "y", "x", *[r(n).alias(n) for n in ("smooth_0", "gradient_0", "smooth_1", "gradient_1", "median")])


@query("choose_planes", f"""WITH {X.OBJECTS}, s AS (SELECT t, z, sum(area_px) AS mask, max(area_px) AS top FROM objects GROUP BY 1, 2), m AS (SELECT t, z, row_number() OVER (PARTITION BY t ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM s)
 SELECT t, (SELECT arg_max(z, (mask, -z)) FROM s a WHERE a.t = m.t) AS max_mask_z, (SELECT arg_max(z, (top, -z)) FROM s a WHERE a.t = m.t) AS largest_area_z, z AS middle_z FROM m WHERE i = n // 2""")
def choose_planes(spark, sf):
    s = X.objects(spark, sf).groupBy("t", "z").agg(F.sum("area_px").alias("mask"), F.max("area_px").alias("top"))
    one = lambda name, **how: M.choose_plane(s, series=["t"], z="z", **how).withColumnRenamed("chosen_z", name)
    return one("max_mask_z", mode="largest", score="mask").join(one("largest_area_z", mode="largest", score="top"), "t").join(one("middle_z", mode="middle"), "t")
