"""Queries of axis, radial, Fourier, training-set and table input/output operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilens.operators import axes, pixels, radial, training
from petrilens.operators.graph import shared_dir
from petrilens.plans import fixtures as X
from petrilens.plans.pixel import LABELS, _labels, _px
from petrilens.plans.relational import r
from petrilens.sources import tables

Q: dict = {}
SQL: dict[str, str] = {}
T = ("t",)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"


def _stacks(spark: SparkSession, sf: str) -> DataFrame:
    px = X.pixels(spark, sf)
    return px.withColumn("stack_id", F.concat(F.lit("s"), (F.col("t") % 2).cast("string"))).withColumn("t", F.floor(F.col("t") / 2).cast("int"))


@query("axes_concat", f"""WITH {X.PIXELS}, s AS (SELECT concat('s', t % 2) AS stack_id, t // 2 AS t, y, x, intensity FROM pixels), n AS (SELECT max(t) + 1 AS k FROM s WHERE stack_id = 's0')
 SELECT 'joined' AS stack_id, CASE WHEN stack_id = 's1' THEN t + k ELSE t END AS t, count(*) AS n, round(sum(intensity), 6) AS total FROM s, n GROUP BY 1, 2""")
def axes_concat(spark, sf):
    manifest = spark.createDataFrame([("e1", 1, "s0", "joined"), ("e1", 2, "s1", "joined"), ("e2", 1, "none", "lost")], "experiment_id string, `order` int, input_file string, output_file string")
    px, _ = axes.concat_from_manifest(_stacks(spark, sf), manifest)
    return px.groupBy("stack_id", F.col("t").cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("intensity")).alias("total"))


@query("axes_concat_log", f"""WITH {X.PIXELS}, s AS (SELECT DISTINCT concat('s', t % 2) AS stack FROM pixels), m AS (SELECT DISTINCT t, concat('s', (t + k) % 3) AS input FROM pixels CROSS JOIN (VALUES (0), (1)) AS u(k)), j AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE stack IS NULL) AS lost FROM m LEFT JOIN s ON input = stack GROUP BY 1)
 SELECT 'e' || t AS experiment_id, 'out' || t AS output_file, n::INT AS n_inputs, CASE WHEN lost > 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN lost > 0 THEN lost || ' inputs missing' END AS error FROM j""")
def axes_concat_log(spark, sf):
    """A job per frame, two stacks each, one of which does not exist for two jobs in three."""
    frames = X.pixels(spark, sf).select("t").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    manifest = frames.select(name("e", F.col("t")).alias("experiment_id"), F.col("k").alias("order"), name("s", (F.col("t") + F.col("k")) % 3).alias("input_file"), name("out", F.col("t")).alias("output_file"))
    _, log = axes.concat_from_manifest(_stacks(spark, sf), manifest)
    return log.select("experiment_id", "output_file", F.col("n_inputs").cast("int").alias("n_inputs"), "status", "error")


@query("axes_summary", f"WITH {X.PIXELS} SELECT stack_id, max(t) + 1 AS size_t, max(z) + 1 AS size_z, max(c) + 1 AS size_c, max(y) + 1 AS size_y, max(x) + 1 AS size_x, count(*) AS n_pixels, round(min(intensity), 6) AS min, round(max(intensity), 6) AS max FROM pixels GROUP BY 1")
def axes_summary(spark, sf):
    d = axes.stack_summary(axes.ensure_axes(X.pixels(spark, sf).drop("z", "c")))
    return d.select("stack_id", *[f"size_{a}" for a in axes.AXES], "n_pixels", r("min").alias("min"), r("max").alias("max"))


@query("axes_split", f"""WITH {X.PIXELS} SELECT t // 2 AS part, t % 2 AS t, y % 2 AS stream, count(*) AS n, round(sum(intensity), 6) AS total FROM pixels WHERE x = 3 GROUP BY 1, 2, 3""")
def axes_split(spark, sf):
    d = axes.deinterleave(axes.split_blocks(axes.extract(X.pixels(spark, sf), "x", 3), 2), 2, "y")
    return d.groupBy("part", "t", "stream").agg(F.count(F.lit(1)).alias("n"), r(F.sum("intensity")).alias("total"))


@query("axes_layers", f"""WITH {X.PIXELS} SELECT t, (t % 3)::INT AS z, count(*) AS n, round(sum(intensity), 6) AS total FROM pixels GROUP BY 1, 2""")
def axes_layers(spark, sf):
    """Frames in blocks of three, each block's frames as wide layers of one row a pixel."""
    px = X.pixels(spark, sf).withColumn("block", F.floor(F.col("t") / 3)).withColumn("layer_t", F.col("t") % 3)
    names = ["t0_z0_c0", "t1_z1_c0", "t2_z2_c0"]
    wide = px.groupBy("block", "y", "x").agg(*[F.max(F.when(F.col("layer_t") == i, F.col("intensity"))).alias(n) for i, n in enumerate(names)])
    layers = axes.layer_grid(spark, {"t": 3, "z": 3, "c": 1}).where("t = z").select("layer")
    long = axes.layers_to_long(wide, layers, keys=("block", "y", "x")).where("intensity IS NOT NULL")
    d = long.select((F.col("block") * 3 + axes.parse_layer("layer", "t")).cast("int").alias("t"), axes.parse_layer("layer", "z").alias("z"), "intensity")
    return d.groupBy("t", "z").agg(F.count(F.lit(1)).alias("n"), r(F.sum("intensity")).alias("total"))


def _centres(spark: SparkSession, sf: str, keep_size: bool = False, labels: DataFrame | None = None) -> DataFrame:
    g = (_labels(spark, sf) if labels is None else labels).groupBy("t", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2").withColumn("object_id", F.col("label")).drop("label", *([] if keep_size else ["n"]))


KEYS = ["t", "object_id"]


def _modes(spark: SparkSession, sf: str, energy: int | None = None) -> DataFrame:
    prof = radial.sample_bilinear(_centres(spark, sf), _px(spark, sf), T, 80, 80, angles=36, radii=8, first=2.0)
    return radial.angular_modes(prof, KEYS, 36, 6, energy)


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return radial.sample_nearest(_centres(spark, sf), _px(spark, sf), T, KEYS, angles=36, radii=30)


PROFILE = f"""{LABELS}, cen AS (SELECT t, label AS object_id, avg(x) AS cx, avg(y) AS cy FROM labels GROUP BY 1, 2 HAVING count(*) >= 2),
 grid AS (SELECT t, object_id, a AS theta_index, q AS r_index, q::DOUBLE AS distance_px, round_even(cx + q * cos(a * {2 * math.pi / 36!r}::DOUBLE), 0)::INT AS x, round_even(cy + q * sin(a * {2 * math.pi / 36!r}::DOUBLE), 0)::INT AS y FROM cen CROSS JOIN (SELECT unnest(generate_series(0, 35)) AS a) CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS q)),
 smp AS (SELECT g.*, p.intensity FROM grid g LEFT JOIN pixels p ON g.t = p.t AND g.y = p.y AND g.x = p.x), prof AS (SELECT * FROM (SELECT *, min(CASE WHEN intensity IS NULL THEN r_index END) OVER (PARTITION BY t, object_id, theta_index) AS ex FROM smp) WHERE ex IS NULL OR r_index < ex)"""


@query("radial_summary", f"""WITH RECURSIVE {X.PIXELS}, {PROFILE}, m AS (SELECT t, object_id, r_index, avg(intensity) AS m FROM prof GROUP BY 1, 2, 3), pk AS (SELECT t, object_id, r_index::DOUBLE AS radial_peak_distance_px FROM m QUALIFY row_number() OVER (PARTITION BY t, object_id ORDER BY round(m, 9) DESC, r_index) = 1),
 ln AS (SELECT t, object_id, avg(len) AS l FROM (SELECT DISTINCT t, object_id, len FROM (SELECT t, object_id, theta_index, max(distance_px) AS len FROM prof GROUP BY 1, 2, 3)) GROUP BY 1, 2)
 SELECT t, object_id, count(*) AS n_samples, round(avg(intensity), 6) AS radial_mean_intensity, round(max(intensity), 6) AS radial_max_intensity, round(any_value(l), 6) AS radial_mean_ray_length_px, any_value(radial_peak_distance_px) AS radial_peak_distance_px FROM prof JOIN ln USING (t, object_id) JOIN pk USING (t, object_id) GROUP BY 1, 2""")
def radial_summary(spark, sf):
    d = radial.radial_summary(_profile(spark, sf), KEYS)
    return d.select(*KEYS, "n_samples", *[r(n).alias(n) for n in ("radial_mean_intensity", "radial_max_intensity", "radial_mean_ray_length_px")], "radial_peak_distance_px")


@query("radial_compaction", f"""WITH RECURSIVE {X.PIXELS}, {PROFILE}, p AS (SELECT t, object_id, theta_index, max(intensity) AS peak FROM prof GROUP BY 1, 2, 3) SELECT t, object_id, round(stddev_pop(peak) / nullif(avg(peak), 0), 5) AS compaction FROM p GROUP BY 1, 2""")
def radial_compaction(spark, sf):
    return radial.compaction(_profile(spark, sf), KEYS).select(*KEYS, r("compaction", 5).alias("compaction"))


@query("radial_metrics", f"""WITH RECURSIVE {X.PIXELS}, {PROFILE}, m AS (SELECT t, object_id, r_index, avg(intensity) AS m FROM prof GROUP BY 1, 2, 3), ev AS (SELECT t, object_id, r_index AS er, m AS ep FROM m WHERE r_index < 12 QUALIFY row_number() OVER (PARTITION BY t, object_id ORDER BY m DESC, r_index) = 1),
 b AS (SELECT t, object_id, avg(m) AS base FROM m WHERE r_index < 3 GROUP BY 1, 2), o AS (SELECT p.t, p.object_id, p.theta_index, p.intensity FROM prof p JOIN ev USING (t, object_id) WHERE r_index > er AND r_index < 28), h AS (SELECT t, object_id, stddev_pop(intensity) / nullif(abs(avg(intensity)), 0) AS het FROM o GROUP BY 1, 2),
 a AS (SELECT t, object_id, stddev_pop(m) / nullif(abs(avg(m)), 0) AS asy FROM (SELECT t, object_id, theta_index, avg(intensity) AS m FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT t, object_id, er AS envelope_radius, round(ep, 6) AS envelope_peak, round(base, 6) AS baseline, round((ep - base) / nullif(abs(base), 0), 4) AS sharpness, round(het, 4) AS heterogeneity, round(asy, 3) AS asymmetry FROM ev LEFT JOIN b USING (t, object_id) LEFT JOIN h USING (t, object_id) LEFT JOIN a USING (t, object_id)""")
def radial_metrics(spark, sf):
    d = radial.radial_metrics(_profile(spark, sf), KEYS, search=12, inner=3, outer=28)
    return d.select(*KEYS, "envelope_radius", r("envelope_peak").alias("envelope_peak"), r("baseline").alias("baseline"), r("sharpness", 4).alias("sharpness"), r("heterogeneity", 4).alias("heterogeneity"), r("asymmetry", 3).alias("asymmetry"))


@query("best_plane_metrics", f"""WITH RECURSIVE {X.PIXELS}, {PROFILE}, top AS (SELECT t AS bt, label AS object_id, n, t // 2 AS s FROM (SELECT t, label, count(*) AS n FROM labels GROUP BY 1, 2 HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY t // 2 ORDER BY n DESC, t, label) = 1),
 p AS (SELECT s, t, theta_index, max(intensity) AS peak FROM prof JOIN top ON t = bt AND prof.object_id = top.object_id GROUP BY 1, 2, 3), m AS (SELECT s, r_index, avg(intensity) AS m FROM prof JOIN top ON t = bt AND prof.object_id = top.object_id GROUP BY 1, 2)
 SELECT p.s AS series, any_value(t) AS best_plane, round(stddev_pop(peak) / nullif(avg(peak), 0), 5) AS compaction, any_value(er) AS envelope_radius FROM p JOIN (SELECT s, r_index AS er FROM m WHERE r_index < 12 QUALIFY row_number() OVER (PARTITION BY s ORDER BY m DESC, r_index) = 1) e ON p.s = e.s GROUP BY 1""")
def best_plane_metrics(spark, sf):
    """Planes in series of two: the plane with the largest object, and that object's compaction and envelope."""
    c = _centres(spark, sf, keep_size=True).withColumn("series", F.floor(F.col("t") / 2))
    best = c.groupBy("series").agg(F.min(F.struct((-F.col("n")).alias("n"), "t", "object_id", "cx", "cy")).alias("b")).select("series", "b.t", "b.object_id", "b.cx", "b.cy")
    prof = radial.sample_nearest(best, _px(spark, sf), T, ["series", *KEYS], angles=36, radii=30)
    keys = ["series", *KEYS]
    d = radial.compaction(prof, keys).join(radial.radial_metrics(prof, keys, search=12, inner=3, outer=28), keys)
    return d.select("series", F.col("t").alias("best_plane"), r("compaction", 5).alias("compaction"), "envelope_radius")


@query("radial_rays_to_edge", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, cen AS (SELECT t, label AS object_id, avg(x) AS cx, avg(y) AS cy FROM labels GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT *, floor(round_even(cy, 0) / 40)::BIGINT * 2 + floor(round_even(cx, 0) / 40)::BIGINT AS droplet_id FROM cen),
 grid AS (SELECT t, object_id, droplet_id, a, q, q::DOUBLE AS dist, round_even(cx + q * cos(a * {2 * math.pi / 36!r}::DOUBLE), 0)::INT AS x, round_even(cy + q * sin(a * {2 * math.pi / 36!r}::DOUBLE), 0)::INT AS y FROM c CROSS JOIN (SELECT unnest(generate_series(0, 35)) AS a) CROSS JOIN (SELECT unnest(generate_series(0, 39)) AS q)),
 s AS (SELECT g.*, p.intensity, p.t IS NULL OR (g.y // 40) * 2 + g.x // 40 <> droplet_id AS outside FROM grid g LEFT JOIN pixels p ON p.t = g.t AND p.y = g.y AND p.x = g.x), xt AS (SELECT *, min(CASE WHEN outside THEN q END) OVER (PARTITION BY t, object_id, a) AS ex FROM s), k AS (SELECT *, max(dist) OVER (PARTITION BY t, object_id, a) AS len FROM xt WHERE ex IS NULL OR q < ex)
 SELECT t, object_id, droplet_id, count(*) AS n, round(avg(intensity), 6) AS mean, round(avg(dist / nullif(len, 0)), 6) AS mean_norm, round(max(len), 6) AS longest FROM k ANTI JOIN labels l ON l.t = k.t AND l.y = k.y AND l.x = k.x GROUP BY 1, 2, 3""")
def radial_rays_to_edge(spark, sf):
    px = _px(spark, sf)
    drops = px.select("t", "y", "x", (F.floor(F.col("y") / 40) * 2 + F.floor(F.col("x") / 40)).alias("droplet_id"))
    labels = _labels(spark, sf)
    c = _centres(spark, sf, labels=labels).withColumn("droplet_id", F.floor(F.rint("cy") / 40) * 2 + F.floor(F.rint("cx") / 40))
    d = radial.rays_to_edge(c, px, drops, labels, T, angles=36, radii=40)
    return d.groupBy(*KEYS, "droplet_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("intensity")).alias("mean"), r(F.avg("distance_norm")).alias("mean_norm"), r(F.max("ray_length_px")).alias("longest"))


#: Rings of bilinear samples (radius 2 to 9, 36 angles), and their angular modes 0 to 6.
RINGS = f"""{LABELS}, cen AS (SELECT t, label AS object_id, avg(x) AS cx, avg(y) AS cy FROM labels GROUP BY 1, 2 HAVING count(*) >= 2), g AS (SELECT t, object_id, a, q, least(greatest(cx + (2.0::DOUBLE + q) * cos(a * {2 * math.pi / 36!r}::DOUBLE), 0), 79) AS gx, least(greatest(cy + (2.0::DOUBLE + q) * sin(a * {2 * math.pi / 36!r}::DOUBLE), 0), 79) AS gy
  FROM cen CROSS JOIN (SELECT unnest(generate_series(0, 35)) AS a) CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS q)), f AS (SELECT *, least(floor(gx), 78)::INT AS x0, least(floor(gy), 78)::INT AS y0 FROM g),
 smp AS (SELECT f.t, f.object_id, f.a, f.q, sum((CASE WHEN p.x = x0 THEN 1 - (gx - x0) ELSE gx - x0 END) * (CASE WHEN p.y = y0 THEN 1 - (gy - y0) ELSE gy - y0 END) * p.intensity) AS v FROM f JOIN pixels p ON p.t = f.t AND p.y BETWEEN y0 AND y0 + 1 AND p.x BETWEEN x0 AND x0 + 1 GROUP BY 1, 2, 3, 4),
 modes AS (SELECT t, object_id, q, m, sum(v * cos({-2 * math.pi / 36!r}::DOUBLE * m * a)) AS re, sum(v * sin({-2 * math.pi / 36!r}::DOUBLE * m * a)) AS im FROM smp CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS m) GROUP BY 1, 2, 3, 4)"""


@query("fourier_modes", f"""WITH RECURSIVE {X.PIXELS}, {RINGS}, p AS (SELECT t, object_id, m, sum((re * re + im * im) / 36) AS p FROM modes GROUP BY 1, 2, 3), d AS (SELECT t, object_id, m AS dm FROM p WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY t, object_id ORDER BY p DESC, m) = 1),
 s AS (SELECT t, object_id, max(p) FILTER (WHERE m > 0) AS top, sum(p) FILTER (WHERE m > 0) AS turning, sum(p) AS whole FROM p GROUP BY 1, 2), c AS (SELECT t, object_id, avg(pow(2.0::DOUBLE / 36 * (re * cos({4 * math.pi / 36!r}::DOUBLE * a) - im * sin({4 * math.pi / 36!r}::DOUBLE * a)), 2)) AS m2 FROM smp JOIN modes USING (t, object_id, q) WHERE m = 2 GROUP BY 1, 2)
 SELECT t, object_id, dm::INT AS dominant_mode, round(top / turning, 6) AS dominant_share, round(turning / whole, 6) AS anisotropy_index, round(m2, 6) AS mode2_power FROM d JOIN s USING (t, object_id) JOIN c USING (t, object_id)""")
def fourier_modes(spark, sf):
    """Rings by bilinear samples, angular modes, the dominant mode, and the mean square of its second mode's part."""
    d = radial.dominant_mode(_modes(spark, sf, 2), KEYS, "mode2_power")
    return d.select(*KEYS, "dominant_mode", *[r(n).alias(n) for n in ("dominant_share", "anisotropy_index", "mode2_power")])


@query("fourier_mode_profile", f"""WITH RECURSIVE {X.PIXELS}, {RINGS} SELECT t, object_id, q::INT AS r_index, round(2 * sqrt(re * re + im * im) / 36, 6) AS amplitude, round(atan2(im, re), 4) AS phase FROM modes WHERE m = 2""")
def fourier_mode_profile(spark, sf):
    d = radial.mode_profile(_modes(spark, sf), 2, 36)
    return d.select(*KEYS, "r_index", r("amplitude").alias("amplitude"), r("phase", 4).alias("phase"))


@query("fourier_spectrum", f"""WITH {X.PIXELS}, k AS (SELECT t AS kt, max(y) + 1 AS h, max(x) + 1 AS w, avg(intensity) AS m FROM pixels GROUP BY 1), d AS (SELECT t, y, x, h, w, intensity - m AS v FROM pixels JOIN k ON t = kt),
 a AS (SELECT t, h, w, y, u, sum(v * cos({2 * math.pi!r}::DOUBLE * ((u * x) % w) / w)) AS re, -sum(v * sin({2 * math.pi!r}::DOUBLE * ((u * x) % w) / w)) AS im FROM d, unnest(generate_series(0, w - 1)) AS j(u) GROUP BY 1, 2, 3, 4, 5),
 b AS (SELECT t, h, w, u, v, sum(re * cos({2 * math.pi!r}::DOUBLE * ((v * y) % h) / h) + im * sin({2 * math.pi!r}::DOUBLE * ((v * y) % h) / h)) AS re, sum(im * cos({2 * math.pi!r}::DOUBLE * ((v * y) % h) / h) - re * sin({2 * math.pi!r}::DOUBLE * ((v * y) % h) / h)) AS im FROM a, unnest(generate_series(0, h - 1)) AS j(v) GROUP BY 1, 2, 3, 4, 5),
 s AS (SELECT t, (CASE WHEN 2 * u >= w THEN u - w ELSE u END) * (1.0::DOUBLE / w) AS fx, (CASE WHEN 2 * v >= h THEN v - h ELSE v END) * (1.0::DOUBLE / h) AS fy, (re * re + im * im) / (h * w) AS power FROM b), f AS (SELECT *, sqrt(fx * fx + fy * fy) AS f FROM s),
 g AS (SELECT t, coalesce(sum(power) FILTER (WHERE f >= 0 AND f < 0.1::DOUBLE), 0) AS band_0, coalesce(sum(power) FILTER (WHERE f >= 0.1::DOUBLE AND f < 0.25::DOUBLE), 0) AS band_1, coalesce(sum(power) FILTER (WHERE f >= 0.25::DOUBLE AND f < 0.5::DOUBLE), 0) AS band_2, sum(f * power) / sum(power) AS centroid, sum(CASE WHEN abs(fx) > abs(fy) THEN power ELSE -power END) / sum(power) AS anisotropy FROM f GROUP BY 1),
 p AS (SELECT t, floor(f * 2 * 20) AS bin, avg(power) AS p, avg(f) AS f FROM f WHERE f > 0 GROUP BY 1, 2), l AS (SELECT t, regr_slope(ln(p), ln(f)) AS slope FROM p WHERE p > 0 GROUP BY 1)
 SELECT t, round(band_0, 5) AS band_0, round(band_1, 5) AS band_1, round(band_2, 5) AS band_2, round(centroid, 5) AS centroid, round(anisotropy, 5) AS anisotropy, round(slope, 5) AS slope FROM g JOIN l USING (t)""")
def fourier_spectrum(spark, sf):
    d = radial.spectral_features(radial.power_spectrum(_px(spark, sf), T), T)
    return d.select("t", *[r(n, 5).alias(n) for n in ("band_0", "band_1", "band_2", "centroid", "anisotropy", "slope")])


def _h(seed: int, *cols: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(cols)})), 1, 15))::BIGINT"


def _move(axis: str, seed: int, cols: tuple[str, ...], jitter: int) -> str:
    shift = f" + {_h(seed, *cols)} % {2 * jitter + 1} - {jitter}" if jitter else ""
    return f"least(greatest({axis}{shift}, 8), 72)::INT AS centre_{axis}"


@query("training_patches", f"""WITH RECURSIVE {X.PIXELS}, {LABELS}, px AS (SELECT p.t, p.y, p.x, coalesce(label, 0) AS label, intensity FROM pixels p LEFT JOIN labels l ON l.t = p.t AND l.y = p.y AND l.x = p.x), st AS (SELECT t, y, x, CASE WHEN label > 0 THEN 'object' WHEN intensity > 0.1 THEN 'context' ELSE 'negative' END AS stratum FROM px),
 rn AS (SELECT *, row_number() OVER (PARTITION BY t, stratum ORDER BY {_h(7, "t", "y", "x")}, y, x) <= CASE stratum WHEN 'object' THEN 6 WHEN 'context' THEN 4 ELSE 3 END AS inn FROM st), need AS (SELECT t, 13 - count(*) FILTER (WHERE inn) AS k FROM rn GROUP BY 1),
 rest AS (SELECT rn.t, y, x, k, row_number() OVER (PARTITION BY rn.t ORDER BY {_h(8, "rn.t", "y", "x")}, y, x) AS o FROM rn JOIN need USING (t) WHERE NOT inn), tk AS (SELECT t, y, x, stratum FROM rn WHERE inn UNION ALL SELECT t, y, x, 'fill' FROM rest WHERE o <= k),
 mv AS (SELECT t, stratum, {_move("y", 9, ("t", "y", "x"), 2)}, {_move("x", 10, ("t", "y", "x"), 2)} FROM tk), c AS (SELECT t, centre_y, centre_x, min(stratum) AS stratum FROM mv GROUP BY 1, 2, 3),
 pt AS (SELECT c.*, count(*) AS n, count(*) FILTER (WHERE label > 0) AS lab FROM c JOIN px ON px.t = c.t AND px.y BETWEEN centre_y - 8 AND centre_y + 7 AND px.x BETWEEN centre_x - 8 AND centre_x + 7 GROUP BY ALL)
 SELECT t, CASE WHEN t IN (1, 3) THEN 'validation' ELSE 'train' END AS split, stratum, count(*) AS patches, sum(n)::BIGINT AS n_pixels, sum(lab)::BIGINT AS labelled FROM pt WHERE lab >= 1 GROUP BY 1, 2, 3""")
def training_patches(spark, sf):
    """Seeded centres, their patches, a split by time and the summary per frame and kind."""
    px = _px(spark, sf).join(_labels(spark, sf), ["t", "y", "x"], "left").fillna(0, subset=["label"])
    strata = px.select("t", "y", "x", F.when(F.col("label") > 0, "object").when(F.col("intensity") > 0.1, "context").otherwise("negative").alias("stratum"))
    c = training.patch_centres(strata, T, {"object": 6, "context": 4, "negative": 3}, size=16, width=80, height=80, jitter=2)
    c = c.groupBy("t", "centre_y", "centre_x").agg(F.min("stratum").alias("stratum"))
    cut = training.cut_patches_at(c, px, T, 16, 1)
    d = training.split_by_time(cut, [1, 3])
    return d.groupBy("t", "split", "stratum").agg(F.countDistinct("centre_y", "centre_x").alias("patches"), F.count(F.lit(1)).alias("n_pixels"), F.count_if(F.col("label") > 0).alias("labelled"))


@query("training_negatives", f"""WITH {X.PIXELS}, rn AS (SELECT t, z, y, x FROM pixels QUALIFY row_number() OVER (PARTITION BY t, z ORDER BY {_h(7, "t", "z", "y", "x")}, y, x) <= 5), d AS (SELECT t, {_move("y", 9, ("t", "z", "y", "x"), 0)}, {_move("x", 10, ("t", "z", "y", "x"), 0)} FROM rn),
 h AS (SELECT *, {_h(11, "t", "centre_y", "centre_x")} % 1073741824 AS h FROM d), k AS (SELECT *, h < 0.2 * 1073741824 OR row_number() OVER (ORDER BY h, t, centre_y, centre_x) = 1 AS val FROM h)
 SELECT t, CASE WHEN val THEN 'validation' ELSE 'train' END AS split, count(*) AS n, min(centre_y) AS least_y, 0 AS label FROM k GROUP BY 1, 2""")
def training_negatives(spark, sf):
    px = X.pixels(spark, sf).select("t", "z", "y", "x")
    d = training.hard_negatives(px, ["t", "z"], z="z", z_range=(0, 1), n=5, size=16, width=80, height=80)
    d = training.split_random(d, ["t", "centre_y", "centre_x"], 0.2, 11)
    return d.groupBy("t", "split").agg(F.count(F.lit(1)).alias("n"), F.min("centre_y").alias("least_y"), F.max("label").alias("label"))


@query("training_quota", f"WITH {X.PIXELS}, w AS (SELECT DISTINCT t, CASE t WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.25 WHEN 2 THEN 0.35 END AS weight FROM pixels) SELECT t, greatest(1, round_even(coalesce(weight, 0) * 10, 0))::INT AS n_patches FROM w")
def training_quota(spark, sf):
    w = spark.createDataFrame([(0, 0.05), (1, 0.25), (2, 0.35)], "t int, weight double")
    return training.patches_per_time(_px(spark, sf).select("t").distinct(), w, 10.0)


@query("training_labels", f"""WITH {X.PIXELS} SELECT t, CASE WHEN intensity > 0.2 AND intensity > 0.05 THEN 2 WHEN intensity > 0.05 THEN 1 ELSE 0 END AS class_id, count(*) AS n FROM pixels GROUP BY 1, 2""")
def training_labels(spark, sf):
    px = _px(spark, sf)
    masks = {"nucleus": px.where("intensity > 0.2"), "droplet": px.where("intensity > 0.05")}
    d = training.compose_labels(px.select("t", "y", "x"), masks, T, order=[("nucleus", 2), ("droplet", 1)], inside={"nucleus": "droplet"})
    return d.groupBy("t", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("training_labels_four", f"""WITH {X.PIXELS}, k AS (SELECT t, abs(intensity) > 0.25 AS pore, intensity > 0.1 AS nucleus, abs(intensity) > 0.05 AND x >= 8 AS droplet FROM pixels) SELECT t, CASE WHEN pore AND droplet THEN 2 WHEN nucleus AND droplet THEN 3 WHEN droplet THEN 1 ELSE 0 END AS class_id, count(*) AS n FROM k GROUP BY 1, 2""")
def training_labels_four(spark, sf):
    """Four classes: pores win over the nucleus, both only inside the droplet."""
    px = _px(spark, sf)
    masks = {"pore": px.where("abs(intensity) > 0.25"), "nucleus": px.where("intensity > 0.1"), "droplet": px.where("abs(intensity) > 0.05 AND x >= 8")}
    d = training.compose_labels(px.select("t", "y", "x"), masks, T, order=[("pore", 2), ("nucleus", 3), ("droplet", 1)], inside={"pore": "droplet", "nucleus": "droplet"})
    return d.groupBy("t", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query("bundle_round_trip", f"""WITH {X.OBJECTS} SELECT 'best' AS stage, z, count(*) AS n, round(avg(area_px), 6) AS mean_area, 0.0::DOUBLE AS minute FROM objects GROUP BY 2""")
def bundle_round_trip(spark, sf):
    """Stage tables saved as a bundle and loaded by the first name present, with an absent time column added."""
    folder = _folder(spark)
    o = X.objects(spark, sf)
    tables.export_bundle({"best": o, "frames": o.select("t").distinct()}, folder, {"eps": 46.3})
    d, name = tables.load_bundle(spark, folder, ["tracked", "best", "frames"], {"true_time_min": F.lit(0.0)})
    return d.groupBy(F.lit(name).alias("stage"), "z").agg(F.count(F.lit(1)).alias("n"), r(F.avg("area_px")).alias("mean_area"), F.max("true_time_min").alias("minute"))


@query("csv_measurements", f"""WITH {X.MEASUREMENTS} SELECT Condition, count(*) AS n, round(sum(Nuclear_Area), 2) AS area FROM measurements GROUP BY 1""")
def csv_measurements(spark, sf):
    """One folder of CSV files for each remainder of the slice, read as one table."""
    folder = _folder(spark)
    m = X.measurements(spark, sf).select("Condition", "Nuclear_Area", "Slice")
    for k in range(3):
        m.where(F.col("Slice") % 3 == k).write.option("header", True).csv(f"{folder}/part{k}")
    d = tables.read_measurements(spark, [f"{folder}/part{k}" for k in range(3)], "Condition string, Nuclear_Area double, Slice int")
    return d.groupBy("Condition").agg(F.count(F.lit(1)).alias("n"), r(F.sum("Nuclear_Area"), 2).alias("area"))


@query("file_groups", f"""WITH {X.OBJECTS} SELECT (t % 10)::VARCHAR AS "group", string_agg('frame_' || t || '.parquet', ',' ORDER BY t) AS files, count(*)::INT AS n_files FROM (SELECT DISTINCT t FROM objects) GROUP BY 1""")
def file_groups(spark, sf):
    """Files of one frame each, listed, and grouped by the last digit of the frame in natural order."""
    folder = _folder(spark)
    X.objects(spark, sf).withColumn("frame", F.col("t")).repartition("frame").write.partitionBy("frame").parquet(folder)
    found = tables.file_inventory(spark, folder, "*.parquet").withColumn("name", F.concat(F.lit("frame_"), F.regexp_extract("path", "frame=([0-9]+)", 1), F.lit(".parquet")))
    d = tables.group_files(found, r"([0-9])\.parquet$")
    return d.select("group", F.array_join("files", ",").alias("files"), "n_files")


@query("resume_ledger", f"""WITH {X.OBJECTS} SELECT DISTINCT t FROM objects WHERE t NOT IN (SELECT t FROM objects WHERE t % 3 = 0)""")
def resume_ledger(spark, sf):
    path = _folder(spark)
    frames = X.objects(spark, sf).select("t").distinct()
    done = tables.stage(spark, path, lambda: frames.where("t % 3 = 0"))
    return tables.pending(frames, tables.stage(spark, path, lambda: done), ["t"])
