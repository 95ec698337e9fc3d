"""Queries of the column, filter, aggregate, window and reshaping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilens.functions import columns as P
from petrilens.functions.broadcasts import exact_quantiles
from petrilens.operators import clean, summaries
from petrilens.plans import fixtures as X

Q: dict = {}
SQL: dict[str, str] = {}

BOX = ("bbox_min_row", "bbox_min_col", "bbox_max_row", "bbox_max_col")
FILL = "area_px / (greatest(bbox_max_row - bbox_min_row, 1) * greatest(bbox_max_col - bbox_min_col, 1))"
CIRC = "CASE WHEN perimeter_px > 0 THEN 4 * pi() * area_px / (perimeter_px * perimeter_px) END"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r(x, n: int = 6):
    return F.round(P.c(x), n)


PRE = f"""{X.OBJECTS}, a AS (SELECT *, {FILL} AS fill_fraction, {CIRC} AS circ FROM objects), b AS (SELECT * FROM a WHERE area_px >= 5000 AND fill_fraction >= 0.3 AND circ >= 0.5),
 c AS (SELECT *, coalesce(bbox_min_row <= 5 OR bbox_min_col <= 5 OR bbox_max_row >= mr - 5 OR bbox_max_col >= mc - 5, FALSE) AS e FROM b, (SELECT max(bbox_max_row) AS mr, max(bbox_max_col) AS mc FROM b)),
 pre AS (SELECT * FROM c WHERE NOT e AND area_px <= 22000)"""
COMPOSITE = """s AS (SELECT *, 0.45 * coalesce((area_px - mn_a) / nullif(mx_a - mn_a, 0), 0) + 0.25 * coalesce((circ - mn_c) / nullif(mx_c - mn_c, 0), 0) + 0.30 * coalesce((fill_fraction - mn_f) / nullif(mx_f - mn_f, 0), 0) AS score
 FROM (SELECT *, min(area_px) OVER w AS mn_a, max(area_px) OVER w AS mx_a, min(circ) OVER w AS mn_c, max(circ) OVER w AS mx_c, min(fill_fraction) OVER w AS mn_f, max(fill_fraction) OVER w AS mx_f
  FROM pre WINDOW w AS (PARTITION BY nucleus_3d_id))),
 best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY nucleus_3d_id ORDER BY score DESC, area_px DESC, circ DESC, label) = 1)"""


def _pre(spark: SparkSession, sf: str) -> DataFrame:
    return clean.pre_clean(X.objects(spark, sf), area="area_px", perimeter="perimeter_px", box=BOX, min_area=5000, min_fill=0.3, min_circ=0.5, max_area=22000)


def _best(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("area_px", 0.45), ("circ", 0.25), ("fill_fraction", 0.30)]
    return summaries.composite_best(_pre(spark, sf), ["nucleus_3d_id"], parts, order=[F.desc("area_px"), F.desc("circ"), F.col("label")])


@query("flagship_area_over_time", f"""WITH {PRE}, {COMPOSITE}, m AS (SELECT *, least(greatest(floor(centroid_x_px / (mx / 5)), 0), 4)::INT AS fov FROM best, (SELECT max(centroid_x_px) AS mx FROM best)),
 v AS (SELECT *, t * 5 + fov AS true_time_min FROM m), f AS (SELECT * FROM v WHERE CASE WHEN t < 10 THEN area_px BETWEEN 5000 AND 20000 WHEN t < 20 THEN area_px BETWEEN 6000 AND 21000 ELSE area_px >= 7000 AND circ >= 0.55 END)
 SELECT t, count(*) AS n, round(avg(area_px), 6) AS mean_area, median(area_px) AS median_area, round(avg(true_time_min), 6) AS mean_time FROM f GROUP BY t""")
def flagship(spark, sf):
    """Objects, cleaned, best plane of each, true time, limits by stage, area over time."""
    timed = P.true_time_from_x(_best(spark, sf), x="centroid_x_px", t="t", fields=5)
    stages = [(10, {"area_px": (5000, 20000), "solidity": (0.9, None)}), (20, {"area_px": (6000, 21000)}), (None, {"area_px": (7000, None), "circ": (0.55, None)})]
    kept = clean.staged_limits(timed, t="t", stages=stages)
    return kept.groupBy("t").agg(F.count(F.lit(1)).alias("n"), r(F.avg("area_px")).alias("mean_area"), F.median("area_px").alias("median_area"), r(F.avg("true_time_min")).alias("mean_time"))


@query("derive_shape", f"""WITH {X.OBJECTS} SELECT label, round(area_px * 0.108 * 0.108, 6) AS area_um2, round(2 * sqrt(area_px / pi()), 6) AS diameter, round({CIRC}, 6) AS circ, round({FILL}, 6) AS fill,
 coalesce(bbox_min_row <= 5 OR bbox_min_col <= 5 OR bbox_max_row >= mr - 5 OR bbox_max_col >= mc - 5, FALSE) AS edge, format('t{{:03d}}_obj{{:04d}}', t, label) AS object_id
 FROM objects, (SELECT max(bbox_max_row) AS mr, max(bbox_max_col) AS mc FROM objects)""")
def derive_shape(spark, sf):
    d = P.edge_touching(X.objects(spark, sf), r0=BOX[0], c0=BOX[1], r1=BOX[2], c1=BOX[3])
    return d.select("label", r(P.px_to_um2("area_px", 0.108)).alias("area_um2"), r(P.equivalent_diameter("area_px")).alias("diameter"), r(P.circularity("area_px", "perimeter_px")).alias("circ"), r(P.fill_fraction("area_px", *BOX)).alias("fill"), F.col("is_edge_touching").alias("edge"), P.object_id("t", "label").alias("object_id"))


@query("derive_tiles", f"""WITH {X.OBJECTS}, a AS (SELECT label, t, least(floor(centroid_x_px / (5600 / 4.0)), 3)::INT AS tile_col, least(floor(centroid_y_px / (3800 / 3.0)), 2)::INT AS tile_row FROM objects),
 b AS (SELECT *, tile_row * 4 + CASE WHEN tile_row % 2 = 1 THEN 3 - tile_col ELSE tile_col END AS tile_index FROM a) SELECT label, tile_row, tile_col, tile_index, (t * 12 + tile_index) * 0.5 AS minute, (t * 12 + tile_index + 0.5) * 0.5 AS mid_minute FROM b""")
def derive_tiles(spark, sf):
    row, col, index = P.tile_columns("centroid_x_px", "centroid_y_px", width=5600, height=3800, rows=3, cols=4)
    d = X.objects(spark, sf).select("label", "t", row.alias("tile_row"), col.alias("tile_col"), index.alias("tile_index"))
    return d.select("label", "tile_row", "tile_col", "tile_index", P.tile_time("t", "tile_index", rows=3, cols=4, minutes=0.5).alias("minute"), P.tile_time("t", "tile_index", rows=3, cols=4, minutes=0.5, midpoint=True).alias("mid_minute"))


@query("derive_true_time", f"""WITH {X.OBJECTS}, a AS (SELECT label, t, least(greatest(floor(centroid_x_px / (mx / 5)), 0), 4)::INT AS f FROM objects, (SELECT max(centroid_x_px) AS mx FROM objects)),
 b AS (SELECT label, t, (CASE WHEN t % 2 = 1 THEN 4 - f ELSE f END)::INT AS fov FROM a) SELECT label, fov, (t * 5 + fov) * 1.0::DOUBLE AS true_time_min FROM b""")
def derive_true_time(spark, sf):
    return P.true_time_from_x(X.objects(spark, sf), x="centroid_x_px", t="t", fields=5, serpentine=True).select("label", "fov", "true_time_min")


#: Example region boxes (x from, x to, y from, y to, region) and minutes per region.
REGIONS = ((0, 1899, 0, 1899, 1), (1901, 3800, 0, 1899, 2), (3801, 5732, 0, 1899, 3), (0, 1899, 1900, 3890, 4), (1901, 3800, 1900, 3890, 5))
MINUTES = ((1, 1.0), (2, 4.0), (3, 7.0), (4, 10.0), (5, 13.0), (6, 16.0))


@query("derive_regions", f"""WITH {X.FIJI}, a AS (SELECT suppkey, row_key, Slice, CASE WHEN XM BETWEEN 0 AND 1899 AND YM BETWEEN 0 AND 1899 THEN 1 WHEN XM BETWEEN 1901 AND 3800 AND YM BETWEEN 0 AND 1899 THEN 2 WHEN XM BETWEEN 3801 AND 5732 AND YM BETWEEN 0 AND 1899 THEN 3
 WHEN XM BETWEEN 0 AND 1899 AND YM BETWEEN 1900 AND 3890 THEN 4 WHEN XM BETWEEN 1901 AND 3800 AND YM BETWEEN 1900 AND 3890 THEN 5 ELSE 6 END AS region FROM fiji)
 SELECT region, minute, count(*) AS n, sum(Slice * 0.5) AS time_sum FROM a JOIN (VALUES (1, 1.0::DOUBLE), (2, 4.0), (3, 7.0), (4, 10.0), (5, 13.0), (6, 16.0)) AS m(k, minute) ON region = k GROUP BY region, minute""")
def derive_regions(spark, sf):
    m = spark.createDataFrame(MINUTES, "k int, minute double")
    d = X.fiji_rows(spark, sf).withColumn("region", P.region_of("XM", "YM", REGIONS, 6)).join(F.broadcast(m), F.col("region") == F.col("k"))
    return d.groupBy("region", "minute").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("Slice") * 0.5).alias("time_sum"))


@query("derive_time_bins", f"""WITH {X.MEASUREMENTS} SELECT greatest(floor(Time / 6) * 6, 6) AS bin, format('{{:d}}–{{:d}}', greatest(floor(Time / 6) * 6, 6)::INT, (greatest(floor(Time / 6) * 6, 6) + 6)::INT) AS label, Condition, count(*) AS n, round(avg(Nuclear_Area), 4) AS mean_area FROM measurements GROUP BY 1, 2, 3""")
def derive_time_bins(spark, sf):
    d = X.measurements(spark, sf).withColumn("bin", P.time_bin("Time", 6, 6.0))
    return d.groupBy("bin", P.bin_label("bin").alias("label"), "Condition").agg(F.count(F.lit(1)).alias("n"), r(F.avg("Nuclear_Area"), 4).alias("mean_area"))


@query("derive_strings", """SELECT p_partkey, regexp_extract(p_brand, '^[A-Za-z]+') AS prefix, CASE WHEN regexp_extract(p_brand, '^[A-Za-z]+') = 'Brand' THEN 'B' ELSE regexp_extract(p_brand, '^[A-Za-z]+') END AS recoded, contains(p_type, 'STEEL') AS steel,
 replace(p_type, ' ', '_') AS type_name, TRY_CAST(regexp_extract(p_brand, '[0-9]+$') AS INT) AS brand_no, round(sqrt(p_size) + ln(1 + p_size) + atan2(p_size, p_retailprice) + sqrt(p_size * p_size + 9), 6) AS math, least(greatest(p_size, 10), 40) AS clipped FROM part""")
def derive_strings(spark, sf):
    p = X.table(spark, sf, "part")
    prefix = F.regexp_extract(F.trim("p_brand"), "^[A-Za-z]+", 0)
    math = F.sqrt("p_size") + F.log1p("p_size") + F.atan2(F.col("p_size").cast("double"), F.col("p_retailprice")) + F.hypot(F.col("p_size").cast("double"), F.lit(3.0))
    return p.select("p_partkey", prefix.alias("prefix"), P.recode(prefix, {"Brand": "B"}).alias("recoded"), F.col("p_type").contains("STEEL").alias("steel"), F.regexp_replace("p_type", " ", "_").alias("type_name"), F.regexp_extract("p_brand", "[0-9]+$", 0).try_cast("int").alias("brand_no"), r(math).alias("math"), P.clip("p_size", 10, 40).alias("clipped"))


@query("derive_ratios", f"""WITH {X.FIJI} SELECT row_key, Slice, suppkey, round(m_IntDen / nullif(npc_IntDen, 0), 6) AS nc, round(m_IntDen / nullif(m_IntDen + npc_IntDen, 0), 6) AS nc_fraction, CASE WHEN abs(IntDen - npc_IntDen) > 1e-8 THEN round((m_IntDen - npc_IntDen) / (IntDen - npc_IntDen), 6) END AS nc_boundary, round(Area, 2) AS area FROM fiji""")
def derive_ratios(spark, sf):
    return X.fiji_rows(spark, sf).select("row_key", "Slice", "suppkey", r(P.nc_ratio("m_IntDen", "npc_IntDen")).alias("nc"), r(P.nc_fraction("m_IntDen", "npc_IntDen")).alias("nc_fraction"), r(P.nc_boundary("m_IntDen", "IntDen", "npc_IntDen")).alias("nc_boundary"), r("Area", 2).alias("area"))


@query("derive_qc_score", f"""WITH {X.OBJECTS}, a AS (SELECT *, {FILL} AS fill, {CIRC} AS circ, (label % 10) / 10.0::DOUBLE AS mp, (label % 7) / 7.0::DOUBLE AS xp, bbox_min_row <= 0 OR bbox_min_col <= 0 AS e FROM objects),
 b AS (SELECT label, 0.25 * least(greatest((area_px - 4000.0::DOUBLE) / 16000.0::DOUBLE, 0), 1) + 0.25 * least(greatest(circ, 0), 1) + 0.2 * mp + 0.15 * xp + 0.15 * least(greatest(fill, 0), 1) - CASE WHEN e THEN 0.25 ELSE 0 END AS s FROM a)
 SELECT label, round(s, 6) AS qc_score FROM b WHERE s >= 0.5""")
def derive_qc_score(spark, sf):
    d = X.objects(spark, sf).withColumn("fill", P.fill_fraction("area_px", *BOX)).withColumn("circ", P.circularity("area_px", "perimeter_px"))
    d = d.withColumn("mp", F.col("label") % 10 / 10).withColumn("xp", F.col("label") % 7 / 7).withColumn("e", (F.col(BOX[0]) <= 0) | (F.col(BOX[1]) <= 0))
    s = P.qc_score(d, area="area_px", circ="circ", mean_prob="mp", max_prob="xp", fill="fill", edge="e", area_range=(4000.0, 20000.0))
    return s.where("qc_keep").select("label", r("qc_score").alias("qc_score"))


@query("derive_object_ids", f"WITH {X.OBJECTS} SELECT label, printf('t%03d_obj%04d', t, row_number() OVER (ORDER BY t, label) - 1) AS object_id FROM objects")
def derive_object_ids(spark, sf):
    """Ids of the frame and the object's number in the whole table, from 0, in the order of frame and label."""
    return summaries.with_object_id(X.objects(spark, sf).select("t", "label"), "t", ["t", "label"], "object_id").select("label", "object_id")


@query("scale_factor", f"""WITH {X.MEASUREMENTS} SELECT round(max(N_C_V2) / max(Nuclear_Area), 9) AS max_ratio, round(quantile_cont(N_C_V2, 0.99) / quantile_cont(Nuclear_Area, 0.99), 9) AS q99_ratio FROM measurements""")
def scale_factor(spark, sf):
    m = X.measurements(spark, sf)
    (a,), (b,) = exact_quantiles(m, "N_C_V2", (0.99,)), exact_quantiles(m, "Nuclear_Area", (0.99,))
    return m.agg(r(F.try_divide(F.max("N_C_V2"), F.max("Nuclear_Area")), 9).alias("max_ratio")).withColumn("q99_ratio", r(F.try_divide(F.lit(a).cast("double"), F.lit(b).cast("double")), 9))


@query("clean_pre", f"WITH {PRE} SELECT label, round(fill_fraction, 6) AS fill_fraction, round(circ, 6) AS circ FROM pre")
def clean_pre(spark, sf):
    return _pre(spark, sf).select("label", r("fill_fraction").alias("fill_fraction"), r("circ").alias("circ"))


@query("clean_area_flags", f"WITH {X.OBJECTS} SELECT label, area_px > 20000 AS too_large, t >= 15 AND area_px < 6000 AS too_small FROM objects WHERE area_px BETWEEN 4500 AND 23000 AND centroid_x_px BETWEEN 60 AND 5540 AND centroid_y_px BETWEEN 60 AND 3740")
def clean_area_flags(spark, sf):
    d = clean.area_band(X.objects(spark, sf), "area_px", 4500, 23000).withColumn("w", F.lit(5600)).withColumn("h", F.lit(3800))
    d = clean.border_distance(d, x="centroid_x_px", y="centroid_y_px", width="w", height="h", least=60)
    return clean.flag_area(d, area="area_px", t="t", large=20000, small=6000, late=15).select("label", "too_large", "too_small")


@query("clean_seen_on_planes", f"WITH {X.OBJECTS} SELECT label, nucleus_3d_id FROM objects WHERE nucleus_3d_id IN (SELECT nucleus_3d_id FROM objects GROUP BY 1 HAVING count(DISTINCT z) >= 3)")
def clean_seen_on_planes(spark, sf):
    return clean.seen_on_planes(X.objects(spark, sf), keys=["nucleus_3d_id"], z="z", least=3).select("label", "nucleus_3d_id")


@query("clean_rules", f"""WITH {X.MEASUREMENTS} SELECT Condition, count(*) AS n, round(sum(Nuclear_Area), 2) AS area FROM measurements WHERE NOT (Time > 30 AND N_C_V2 < 0.5) AND NOT (Time < 15 AND Nuclear_Area > 60000) AND N_C_V2 > 0 AND Time >= 0 AND Nuclear_Area >= 0 AND Time NOT IN (7, 8) AND Slice IN (1, 2, 3, 4, 5) GROUP BY 1""")
def clean_rules(spark, sf):
    d = clean.drop_where(X.measurements(spark, sf), (F.col("Time") > 30) & (F.col("N_C_V2") < 0.5), (F.col("Time") < 15) & (F.col("Nuclear_Area") > 60000))
    d = clean.only(clean.exclude(clean.all_at_least_zero(d, ["Time", "Nuclear_Area"]), "Time", [7, 8]), "Slice", [1, 2, 3, 4, 5]).dropna(subset=["N_C_V2"]).where("N_C_V2 > 0")
    return d.groupBy("Condition").agg(F.count(F.lit(1)).alias("n"), r(F.sum("Nuclear_Area"), 2).alias("area"))


@query("clean_sd", f"""WITH {X.MEASUREMENTS} SELECT Condition, count(*) AS n, round(avg(Nuclear_Area), 4) AS area FROM measurements, (SELECT avg(Nuclear_Area) AS m, stddev_samp(Nuclear_Area) AS s, avg(Time) AS m2, stddev_samp(Time) AS s2 FROM measurements)
 WHERE abs(Nuclear_Area - m) <= 1.5 * s AND abs(Time - m2) <= 1.5 * s2 GROUP BY 1""")
def clean_sd(spark, sf):
    return clean.within_sd(X.measurements(spark, sf), ["Nuclear_Area", "Time"], 1.5).groupBy("Condition").agg(F.count(F.lit(1)).alias("n"), r(F.avg("Nuclear_Area"), 4).alias("area"))


@query("clean_iqr", f"""WITH {X.MEASUREMENTS}, a AS (SELECT m.* FROM measurements m, (SELECT quantile_cont(Nuclear_Area, 0.25) AS q1, quantile_cont(Nuclear_Area, 0.75) AS q3 FROM measurements) WHERE Nuclear_Area BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)),
 b AS (SELECT a.* FROM a, (SELECT quantile_cont(Time, 0.25) AS q1, quantile_cont(Time, 0.75) AS q3 FROM a) WHERE Time BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)) SELECT Condition, count(*) AS n, round(avg(Time), 6) AS time FROM b GROUP BY 1""")
def clean_iqr(spark, sf):
    return clean.within_iqr(X.measurements(spark, sf), ["Nuclear_Area", "Time"], 0.5).groupBy("Condition").agg(F.count(F.lit(1)).alias("n"), r(F.avg("Time")).alias("time"))


@query("clean_mad", f"""WITH {X.MEASUREMENTS}, a AS (SELECT *, (SELECT median(Nuclear_Area) FROM measurements) AS med FROM measurements), b AS (SELECT *, (SELECT median(abs(Nuclear_Area - med)) FROM a) AS mad FROM a)
 SELECT Condition, count(*) AS n, round(avg((Nuclear_Area - med) / nullif(1.4826 * mad, 0)), 6) AS z FROM b WHERE abs((Nuclear_Area - med) / nullif(1.4826 * mad, 0)) <= 1.2 GROUP BY 1""")
def clean_mad(spark, sf):
    d = clean.within_mad(clean.with_robust_z(X.measurements(spark, sf), "Nuclear_Area", "z"), "Nuclear_Area", 1.2)
    return d.groupBy("Condition").agg(F.count(F.lit(1)).alias("n"), r(F.avg("z")).alias("z"))


@query("clean_combined", f"""WITH {X.MEASUREMENTS}, q AS (SELECT quantile_cont(Nuclear_Area, 0.05) AS lo, quantile_cont(Nuclear_Area, 0.25) AS q1, median(Nuclear_Area) AS md, quantile_cont(Nuclear_Area, 0.75) AS q3, quantile_cont(Nuclear_Area, 0.95) AS hi FROM measurements),
 d AS (SELECT median(abs(Nuclear_Area - md)) AS mad FROM measurements, q) SELECT Condition, count(*) AS n, round(sum(Nuclear_Area), 2) AS area FROM measurements, q, d
 WHERE abs((Nuclear_Area - md) / nullif(mad * 1.4826, 0)) <= 3.5 AND Nuclear_Area BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AND Nuclear_Area BETWEEN lo AND hi GROUP BY 1""")
def clean_combined(spark, sf):
    return clean.combined_keep(X.measurements(spark, sf), ["Nuclear_Area"]).groupBy("Condition").agg(F.count(F.lit(1)).alias("n"), r(F.sum("Nuclear_Area"), 2).alias("area"))


HIST = """h AS (SELECT b.bin, lo + b.bin * w AS bin_low, lo + (b.bin + 1) * w AS bin_high, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, 39)) AS bin) b CROSS JOIN (SELECT min(Nuclear_Area) AS lo, (max(Nuclear_Area) - min(Nuclear_Area)) / 40 AS w FROM measurements)
 LEFT JOIN (SELECT least(floor((Nuclear_Area - lo) / w), 39)::INT AS bin, count(*) AS n FROM measurements, (SELECT min(Nuclear_Area) AS lo, (max(Nuclear_Area) - min(Nuclear_Area)) / 40 AS w FROM measurements) GROUP BY 1) c ON b.bin = c.bin)"""


@query("agg_histogram", f"WITH {X.MEASUREMENTS}, {HIST} SELECT bin::INT AS bin, round(bin_low, 4) AS bin_low, round(bin_high, 4) AS bin_high, n FROM h")
def agg_histogram(spark, sf):
    return summaries.histogram(X.measurements(spark, sf), "Nuclear_Area", 40).select("bin", r("bin_low", 4).alias("bin_low"), r("bin_high", 4).alias("bin_high"), "n")


@query("clean_gap", f"WITH {X.MEASUREMENTS}, {HIST}, g AS (SELECT bin_low, n - lead(n) OVER (ORDER BY bin) AS fall, max(n) OVER () AS most FROM h) SELECT round(min(bin_low), 4) AS cutoff FROM g WHERE fall > 0.1 * most")
def clean_gap(spark, sf):
    return summaries.histogram_gap(X.measurements(spark, sf), "Nuclear_Area", 40).select(r("cutoff", 4).alias("cutoff"))


@query("agg_groups", f"""WITH {X.MEASUREMENTS} SELECT Condition, Slice, count(*) AS n, round(avg(Nuclear_Area), 4) AS mean, round(median(Nuclear_Area), 4) AS median, round(stddev_samp(Nuclear_Area), 4) AS sd, round(stddev_samp(Nuclear_Area) / sqrt(count(*)), 4) AS se, min(Nuclear_Area) AS min, max(Nuclear_Area) AS max, round(sum(Nuclear_Area), 2) AS sum FROM measurements GROUP BY 1, 2""")
def agg_groups(spark, sf):
    d = summaries.describe_groups(X.measurements(spark, sf), ["Condition", "Slice"], "Nuclear_Area")
    return d.select("Condition", "Slice", "n", *[r(n, 4).alias(n) for n in ("mean", "median", "sd", "se")], "min", "max", r("sum", 2).alias("sum"))


@query("agg_conditional", f"""WITH {X.MEASUREMENTS} SELECT Condition, min(N_C_V2) FILTER (WHERE N_C_V2 > 0) AS min_positive, max(N_C_V2) AS max, round(avg(N_C_V2), 6) AS mean, count(DISTINCT cluster) AS clusters, count(*) FILTER (WHERE Time > 20) AS late FROM measurements GROUP BY 1""")
def agg_conditional(spark, sf):
    m = X.measurements(spark, sf)
    more = m.groupBy("Condition").agg(F.countDistinct("cluster").alias("clusters"), F.count_if(F.col("Time") > 20).alias("late"))
    return summaries.positive_range(m, ["Condition"], "N_C_V2").join(more, "Condition").select("Condition", "min_positive", "max", r("mean").alias("mean"), "clusters", "late")


@query("agg_two_level", f"WITH {X.REPLICATES} SELECT condition, round(avg(m), 4) AS mean, count(*) AS n_inner FROM (SELECT condition, replicate, avg(value) AS m FROM replicates GROUP BY 1, 2) GROUP BY 1")
def agg_two_level(spark, sf):
    return summaries.two_level_mean(X.replicates(spark, sf), ["condition"], ["replicate"], "value").select("condition", r("mean", 4).alias("mean"), "n_inner")


@query("agg_argmax", f"WITH {X.OBJECTS} SELECT nucleus_3d_id, label, z, area_px FROM objects QUALIFY row_number() OVER (PARTITION BY nucleus_3d_id ORDER BY area_px DESC, label) = 1")
def agg_argmax(spark, sf):
    return summaries.best_row(X.objects(spark, sf), ["nucleus_3d_id"], F.desc("area_px"), F.col("label")).select("nucleus_3d_id", "label", "z", "area_px")


@query("agg_box", f"""WITH {X.MEASUREMENTS}, q AS (SELECT Condition, quantile_cont(Nuclear_Area, 0.25) AS q1, median(Nuclear_Area) AS md, quantile_cont(Nuclear_Area, 0.75) AS q3 FROM measurements GROUP BY 1)
 SELECT Condition, round(any_value(q1), 4) AS q1, round(any_value(md), 4) AS median, round(any_value(q3), 4) AS q3, min(Nuclear_Area) FILTER (WHERE Nuclear_Area BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)) AS low, max(Nuclear_Area) FILTER (WHERE Nuclear_Area BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)) AS high,
 count(*) FILTER (WHERE NOT (Nuclear_Area BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1))) AS outliers FROM measurements JOIN q USING (Condition) GROUP BY 1""")
def agg_box(spark, sf):
    d = summaries.box_summary(X.measurements(spark, sf), ["Condition"], "Nuclear_Area", 0.4)
    return d.select("Condition", r("q1", 4).alias("q1"), r("median", 4).alias("median"), r("q3", 4).alias("q3"), "low", "high", "outliers")


@query("agg_stage_counts", f"""WITH {PRE}, {COMPOSITE} SELECT 'objects' AS stage, count(*) AS n, count(DISTINCT nucleus_3d_id) AS nuclei, min(t) AS t_min, max(t) AS t_max FROM objects UNION ALL SELECT 'pre_clean', count(*), count(DISTINCT nucleus_3d_id), min(t), max(t) FROM pre UNION ALL SELECT 'best', count(*), count(DISTINCT nucleus_3d_id), min(t), max(t) FROM best""")
def agg_stage_counts(spark, sf):
    tagged = summaries.union_tagged({"objects": X.objects(spark, sf), "pre_clean": _pre(spark, sf), "best": _best(spark, sf)}, "stage")
    return tagged.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("nucleus_3d_id").alias("nuclei"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


@query("best_plane_composite", f"WITH {PRE}, {COMPOSITE} SELECT nucleus_3d_id, label, z, round(score, 6) AS composite_score FROM best")
def best_plane_composite(spark, sf):
    return _best(spark, sf).select("nucleus_3d_id", "label", "z", r("composite_score").alias("composite_score"))


@query("window_normalise", f"""WITH {X.OBJECTS}, a AS (SELECT *, median(area_px) OVER (PARTITION BY nucleus_3d_id) AS med FROM objects), b AS (SELECT *, median(abs(area_px - med)) OVER (PARTITION BY nucleus_3d_id) AS mad, min(area_px) OVER w AS mn, max(area_px) OVER w AS mx, avg(area_px) OVER w AS av, stddev_samp(area_px) OVER w AS sd, count(*) OVER w AS size FROM a WINDOW w AS (PARTITION BY nucleus_3d_id))
 SELECT label, round(coalesce((area_px - mn) / nullif(mx - mn, 0)::DOUBLE, 0), 6) AS scaled, round((area_px - med) / (mad + 1e-9), 3) AS robust, round((area_px - av) / nullif(sd, 0), 6) AS z, size FROM b WHERE mad > 0""")
def window_normalise(spark, sf):
    from pyspark.sql import Window

    k = ["nucleus_3d_id"]
    d = summaries.robust_z(X.objects(spark, sf), "area_px", k, "robust")
    d = d.withColumn("scaled", summaries.min_max("area_px", k)).withColumn("z", summaries.z_score("area_px", k)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*k)))
    spread = d.withColumn("_mad", F.max(F.abs("robust")).over(Window.partitionBy(*k)))
    return spread.where("_mad > 0 AND _mad < 1e8").select("label", r("scaled").alias("scaled"), r("robust", 3).alias("robust"), r("z").alias("z"), "size")


@query("window_ranks", f"""WITH {X.OBJECTS} SELECT label, row_number() OVER (PARTITION BY t ORDER BY area_px DESC, label) AS area_rank, area_px - lag(area_px) OVER w AS step, sum(area_px) OVER (PARTITION BY nucleus_3d_id ORDER BY z, label ROWS UNBOUNDED PRECEDING) AS running, round(avg(area_px) OVER (PARTITION BY nucleus_3d_id ORDER BY z, label ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS trailing
 FROM objects WINDOW w AS (PARTITION BY nucleus_3d_id ORDER BY z, label)""")
def window_ranks(spark, sf):
    from pyspark.sql import Window

    d = summaries.trailing_mean(X.objects(spark, sf), "area_px", ["nucleus_3d_id"], ["z", "label"], "trailing", 3)
    w = Window.partitionBy("nucleus_3d_id").orderBy("z", "label")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("area_px"), "label"))
    return d.select("label", rank.alias("area_rank"), (F.col("area_px") - F.lag("area_px").over(w)).alias("step"), F.sum("area_px").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), r("trailing").alias("trailing"))


@query("window_moving_average", f"""WITH {X.MEASUREMENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY Time, row_key, Slice, Nuclear_Area) AS i, greatest(10, floor(count(*) OVER (PARTITION BY cluster) / 50)) AS w FROM measurements)
 SELECT x.cluster, x.i, round(avg(y.Nuclear_Area), 4) AS smooth FROM a x JOIN a y ON x.cluster = y.cluster AND y.i > x.i - x.w AND y.i <= x.i GROUP BY 1, 2""")
def window_moving_average(spark, sf):
    from pyspark.sql import Window

    order = ["Time", "row_key", "Slice", "Nuclear_Area"]
    d = summaries.trailing_mean(X.measurements(spark, sf), "Nuclear_Area", ["cluster"], order, "smooth")
    return d.select("cluster", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)).alias("i"), r("smooth", 4).alias("smooth"))


@query("window_rolling_mode", f"""WITH {X.OBJECTS}, a AS (SELECT label, nucleus_3d_id, row_number() OVER (PARTITION BY nucleus_3d_id ORDER BY label) AS i, z FROM objects), b AS (SELECT x.label, y.z, count(*) AS n FROM a x JOIN a y ON x.nucleus_3d_id = y.nucleus_3d_id AND abs(x.i - y.i) <= 1 GROUP BY 1, 2)
 SELECT label, z AS mode_z FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, z) = 1""")
def window_rolling_mode(spark, sf):
    return summaries.rolling_mode(X.objects(spark, sf), "z", ["nucleus_3d_id"], ["label"], "mode_z").select("label", "mode_z")


@query("topn_in_group", f"WITH {X.FIJI} SELECT suppkey, Area, IntDen FROM fiji QUALIFY row_number() OVER (PARTITION BY suppkey ORDER BY Area, row_key, Slice) = 4")
def topn_in_group(spark, sf):
    return summaries.nth_row(X.fiji_rows(spark, sf), ["suppkey"], 4, F.col("Area"), F.col("row_key"), F.col("Slice")).select("suppkey", "Area", "IntDen")


@query("reshape_wide", f"""WITH {X.MEASUREMENTS} SELECT Slice, coalesce(max(n) FILTER (WHERE Condition = 'Control'), 0) AS "n | Control", coalesce(max(n) FILTER (WHERE Condition = 'P150'), 0) AS "n | P150", max(m) FILTER (WHERE Condition = 'Control') AS "m | Control", max(m) FILTER (WHERE Condition = 'P150') AS "m | P150" FROM (SELECT Condition, Slice, count(*) AS n, max(Nuclear_Area) AS m FROM measurements GROUP BY 1, 2) GROUP BY 1""")
def reshape_wide(spark, sf):
    g = X.measurements(spark, sf).groupBy("Condition", "Slice").agg(F.count(F.lit(1)).alias("n"), F.max("Nuclear_Area").alias("m"))
    return summaries.long_to_wide(g, ["Slice"], "Condition", ["n", "m"], ["Control", "P150"]).fillna(0, subset=["n | Control", "n | P150"])


@query("reshape_long", f"""WITH {X.MEASUREMENTS} SELECT measure, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT 'Nuclear_Area' AS measure, Nuclear_Area AS value FROM measurements UNION ALL SELECT 'N_C_V2', N_C_V2 FROM measurements UNION ALL SELECT 'Time', Time FROM measurements) GROUP BY 1""")
def reshape_long(spark, sf):
    m = X.measurements(spark, sf).unpivot(["Condition"], ["Nuclear_Area", "N_C_V2", "Time"], "measure", "value")
    return m.groupBy("measure").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


@query("union_conditions", f"""WITH {X.MEASUREMENTS} SELECT grp, count(*) AS n, count(N_C_V2) AS with_ratio, count(DISTINCT cluster) AS clusters FROM (SELECT 'early' AS grp, N_C_V2, cluster FROM measurements WHERE Time < 10 UNION ALL SELECT 'late', NULL, cluster FROM measurements WHERE Time >= 40) GROUP BY 1""")
def union_conditions(spark, sf):
    m = X.measurements(spark, sf)
    d = summaries.union_tagged({"early": m.where("Time < 10"), "late": m.where("Time >= 40").drop("N_C_V2")}, "grp")
    return d.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("N_C_V2").alias("with_ratio"), F.countDistinct("cluster").alias("clusters"))


@query("cluster_summary", f"""WITH {X.OBJECTS} SELECT t, z, label % 4 AS cluster, round(avg(sqrt(centroid_x_px * centroid_x_px + centroid_y_px * centroid_y_px)), 4) AS mean_distance, round(sum(perimeter_px), 3) AS total_intensity, count(*) AS area_pixels, round(sum(perimeter_px) / count(*), 4) AS intensity_density, round(avg(centroid_x_px), 4) AS cluster_centroid_x, round(avg(centroid_y_px), 4) AS cluster_centroid_y FROM objects GROUP BY 1, 2, 3""")
def cluster_summary(spark, sf):
    o = X.objects(spark, sf).withColumn("cluster", F.col("label") % 4).withColumn("d", F.hypot("centroid_x_px", "centroid_y_px"))
    d = summaries.cluster_summary(o, ["t", "z", "cluster"], distance="d", intensity="perimeter_px", xy=("centroid_x_px", "centroid_y_px"))
    return d.select("t", "z", "cluster", r("mean_distance", 4).alias("mean_distance"), r("total_intensity", 3).alias("total_intensity"), "area_pixels", *[r(n, 4).alias(n) for n in ("intensity_density", "cluster_centroid_x", "cluster_centroid_y")])


@query("weighted_focus", f"""WITH {X.OBJECTS}, s AS (SELECT t, label, CASE WHEN label % 7 = 0 THEN NULL ELSE area_px::DOUBLE END AS a, perimeter_px AS p FROM objects), m AS (SELECT *, median(a) OVER w AS ma, median(p) OVER w AS mp FROM s WINDOW w AS (PARTITION BY t)), d AS (SELECT *, median(abs(a - ma)) OVER w AS da, median(abs(p - mp)) OVER w AS dp FROM m WINDOW w AS (PARTITION BY t))
 SELECT label, round(coalesce(0.7::DOUBLE * ((a - ma) / (da + 1e-9)) + 0.3::DOUBLE * ((p - mp) / (dp + 1e-9)), (p - mp) / (dp + 1e-9)), 5) AS focus FROM d""")
def weighted_focus(spark, sf):
    """Focus of objects from two scores, one of which is missing now and then."""
    o = X.objects(spark, sf).withColumn("a", F.when(F.col("label") % 7 != 0, F.col("area_px").cast("double")))
    return summaries.weighted_focus(o, {"a": 0.7, "perimeter_px": 0.3}, ["t"], "perimeter_px").select("label", r("focus", 5).alias("focus"))


@query("otsu_trimmed", f"""WITH {X.MEASUREMENTS}, e AS (SELECT cluster % 40 AS g, quantile_cont(Nuclear_Area, 0.001) AS lo, quantile_cont(Nuclear_Area, 0.999) AS hi FROM measurements GROUP BY 1), d AS (SELECT cluster % 40 AS g, Nuclear_Area AS v FROM measurements JOIN e ON cluster % 40 = e.g AND Nuclear_Area BETWEEN lo AND hi), l AS (SELECT g AS lg, min(v) AS lo, (max(v) - min(v)) / 256 AS w, count(*) AS k, avg(v) AS m FROM d GROUP BY 1),
 c AS (SELECT g, least(floor((v - lo) / w), 255)::INT AS bin, count(*) AS n FROM d JOIN l ON g = lg GROUP BY 1, 2), h AS (SELECT lg AS g, b.bin, (lo + b.bin * w + lo + (b.bin + 1) * w) / 2 AS mid, coalesce(n, 0) AS n FROM l CROSS JOIN (SELECT unnest(generate_series(0, 255)) AS bin) b LEFT JOIN c ON c.g = lg AND c.bin = b.bin), p AS (SELECT *, n / sum(n) OVER (PARTITION BY g) AS p FROM h),
 q AS (SELECT *, sum(p) OVER u AS cw, sum(p * mid) OVER u AS cm, sum(p * mid) OVER (PARTITION BY g) AS mt FROM p WINDOW u AS (PARTITION BY g ORDER BY bin ROWS UNBOUNDED PRECEDING)), v AS (SELECT *, CASE WHEN cw <= 1e-12 OR cw >= 1 - 1e-12 THEN 0 ELSE (mt * cw - cm) * (mt * cw - cm) / (cw * (1 - cw)) END AS s FROM q),
 x AS (SELECT g, mid FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(s, 9) DESC, bin) = 1) SELECT g, round(CASE WHEN k < 256 THEN m ELSE mid END, 4) AS threshold FROM x JOIN l ON g = lg""")
def otsu_trimmed(spark, sf):
    m = X.measurements(spark, sf).withColumn("g", F.col("cluster") % 40)
    return summaries.otsu_trimmed(m, "Nuclear_Area", ["g"]).select("g", r("threshold", 4).alias("threshold"))


@query("column_surgery", f"""WITH {X.FIJI} SELECT suppkey AS cluster_id, count(*) AS n, round(sum("Mean"), 4) AS mean_total, round(sum(Area / 1000), 4) AS area_k, round(sum(Mean + 1), 4) AS "Mean.1" FROM fiji GROUP BY 1""")
def column_surgery(spark, sf):
    """Columns dropped if present, renamed, made unique, reordered and derived in one go."""
    f = X.fiji_rows(spark, sf).drop("npc_IntDen", "not_there").withColumnsRenamed({"suppkey": "cluster_id"})
    f = f.select([c for c in f.columns if not c.startswith("m_")])
    wide = f.select("cluster_id", "Mean", (F.col("Area") / 1000).alias("area_k"), (F.col("Mean") + 1).alias("Mean")).toDF(*P.unique_names(["cluster_id", "Mean", "area_k", "Mean"]))
    return wide.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("Mean"), 4).alias("mean_total"), r(F.sum("area_k"), 4).alias("area_k"), r(F.sum("`Mean.1`"), 4).alias("Mean.1"))


@query("unnest_values", f"""WITH {X.MEASUREMENTS}, g AS (SELECT cluster, avg(Nuclear_Area) AS m FROM measurements GROUP BY 1) SELECT d.cluster, Slice, count(*) AS n, round(any_value(m), 4) AS cluster_mean, round(max(Nuclear_Area) - any_value(m), 4) AS over FROM measurements d JOIN g USING (cluster) GROUP BY 1, 2""")
def unnest_values(spark, sf):
    """Lists of a cluster's slices unnested to rows again, features bound by key."""
    m = X.measurements(spark, sf).groupBy("cluster", "Slice").agg(F.count(F.lit(1)).alias("n"), F.max("Nuclear_Area").alias("top"))
    nested = m.groupBy("cluster").agg(F.collect_list(F.struct("Slice", "n", "top")).alias("res"))  # a cluster has a few slices
    features = X.measurements(spark, sf).groupBy("cluster").agg(F.avg("Nuclear_Area").alias("m"))
    flat = nested.join(features, "cluster").select("cluster", "m", F.inline("res"))
    return flat.select("cluster", "Slice", "n", r("m", 4).alias("cluster_mean"), r(F.col("top") - F.col("m"), 4).alias("over"))


@query("normalised_rows", f"""WITH {X.MEASUREMENTS}, e AS (SELECT Condition, dense_rank() OVER (ORDER BY Condition) AS experiment_id FROM (SELECT DISTINCT Condition FROM measurements)), c AS (SELECT Condition, experiment_id, cluster, Slice, row_number() OVER (ORDER BY experiment_id, cluster, Slice) AS cell_id FROM (SELECT DISTINCT Condition, cluster, Slice FROM measurements) JOIN e USING (Condition))
 SELECT cell_id, experiment_id, cluster, Slice, count(*) AS n, round(sum(Nuclear_Area), 2) AS area, count(DISTINCT row_number) AS ids FROM (SELECT c.*, Nuclear_Area, row_number() OVER (ORDER BY cell_id) AS row_number FROM measurements m JOIN c USING (Condition, cluster, Slice)) GROUP BY 1, 2, 3, 4""")
def normalised_rows(spark, sf):
    """Experiments, cells and measurements made of the flat table, and joined again by their ids."""
    t = summaries.normalised_tables(X.measurements(spark, sf), experiment=["Condition"], cell=["cluster", "Slice"], measures=["Nuclear_Area"], row=["row_key", "Time", "Nuclear_Area", "N_C_V2"])
    back = t["measurements"].join(t["cells"], "cell_id").join(t["experiments"], "experiment_id")
    return back.groupBy("cell_id", "experiment_id", "cluster", "Slice").agg(F.count(F.lit(1)).alias("n"), r(F.sum("Nuclear_Area"), 2).alias("area"), F.countDistinct("measurement_id").alias("ids"))


@query("normalise_tables", """SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated_keys, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans""")
def normalise_tables(spark, sf):
    parent = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return summaries.key_violations(X.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], parent, ["l_orderkey"])
