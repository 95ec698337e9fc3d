"""Queries of joins, spatial matching, grouping, tracking and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrilens.operators import cluster, spatial, summaries, track
from petrilens.plans import fixtures as X
from petrilens.plans.relational import r

Q: dict = {}
SQL: dict[str, str] = {}
XY = ("centroid_x_px", "centroid_y_px")


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


D2 = "(a.centroid_x_px - b.centroid_x_px) * (a.centroid_x_px - b.centroid_x_px) + (a.centroid_y_px - b.centroid_y_px) * (a.centroid_y_px - b.centroid_y_px)"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every object, and every object under the plane before its own."""
    o = X.objects(spark, sf).select("t", "z", "label", *XY, "area_px")
    return o, spatial.prefixed(o.withColumn("z", F.col("z") - 1), "b_")


def _near(spark: SparkSession, sf: str, radius: float, strict: bool = False) -> DataFrame:
    a, b = _sides(spark, sf)
    return spatial.nearest_within(a, b, source="label", target="b_label", radius=radius, on=[("t", "b_t"), ("z", "b_z")], xy=XY, right_xy=("b_centroid_x_px", "b_centroid_y_px"), strict=strict)


@query("match_one_to_one", f"""WITH {X.OBJECTS}, p AS (SELECT a.label, b.label AS b_label, sqrt({D2}) AS distance FROM objects a JOIN objects b ON a.t = b.t AND b.z = a.z + 1 AND {D2} <= 92.6 * 92.6),
 f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, b_label) = 1) SELECT label, b_label, round(distance, 6) AS distance FROM f QUALIFY row_number() OVER (PARTITION BY b_label ORDER BY distance, label) = 1""")
def match_one_to_one(spark, sf):
    return spatial.match_one_to_one(_near(spark, sf, 92.6), "label", "b_label").select("label", "b_label", r("distance").alias("distance"))


@query("match_many_to_one", f"""WITH {X.OBJECTS}, p AS (SELECT a.label, b.label AS b_label, sqrt({D2}) AS distance FROM objects a JOIN objects b ON a.t = b.t AND b.z = a.z + 1 AND {D2} < 92.6 * 92.6)
 SELECT label, b_label, round(distance, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, b_label) = 1""")
def match_many_to_one(spark, sf):
    return spatial.match_many_to_one(_near(spark, sf, 92.6, True), "label", "b_label").select("label", "b_label", r("distance").alias("distance"))


@query("flag_close", f"""WITH {X.OBJECTS} SELECT a.label, EXISTS (SELECT 1 FROM objects b WHERE a.t = b.t AND a.label <> b.label AND {D2} <= 50 * 50) AS has_neighbour FROM objects a""")
def flag_close(spark, sf):
    return spatial.flag_near(X.objects(spark, sf), key="label", radius=50, on=["t"], xy=XY).select("label", "has_neighbour")


@query("nearest_in_frame", f"""WITH {X.OBJECTS} SELECT a.label, round(min(sqrt({D2})), 6) AS nearest_px, coalesce(min(sqrt({D2})) < 60, FALSE) AS is_close FROM objects a LEFT JOIN objects b ON a.t = b.t AND a.label <> b.label GROUP BY 1""")
def nearest_in_frame(spark, sf):
    d = spatial.nearest_neighbour(X.objects(spark, sf), key="label", on=["t"], xy=XY)
    return d.select("label", r("nearest_px").alias("nearest_px"), F.coalesce(F.col("nearest_px") < 60, F.lit(False)).alias("is_close"))


@query("nearest_centroid", f"""WITH {X.OBJECTS}, p AS (SELECT a.label, b.label AS c, sqrt({D2}) AS d FROM objects a LEFT JOIN (SELECT * FROM objects WHERE label % 50 = 0) b ON a.t = b.t AND a.z = b.z)
 SELECT label, c AS nearest, round(d, 6) AS nearest_px FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY d NULLS LAST, c) = 1""")
def nearest_centroid(spark, sf):
    o = X.objects(spark, sf)
    return spatial.nearest_centroid(o, o.where("label % 50 = 0"), on=["t", "z"], point="label", centroid="label", xy=XY, centroid_xy=XY).select("label", "nearest", r("nearest_px").alias("nearest_px"))


@query("old_new_comparison", f"""WITH {X.OBJECTS}, o AS (SELECT * FROM objects QUALIFY row_number() OVER (PARTITION BY nucleus_3d_id ORDER BY area_px DESC, label) = 1), n AS (SELECT * FROM objects QUALIFY row_number() OVER (PARTITION BY nucleus_3d_id ORDER BY label) = 1)
 SELECT o.nucleus_3d_id, o.z AS old_z, n.z AS new_z, o.z IS DISTINCT FROM n.z AS z_changed, o.area_px IS DISTINCT FROM n.area_px AS area_changed FROM o JOIN n USING (nucleus_3d_id)""")
def old_new_comparison(spark, sf):
    o = X.objects(spark, sf).select("nucleus_3d_id", "z", "area_px", "label")
    old = summaries.best_row(o, ["nucleus_3d_id"], F.desc("area_px"), F.col("label")).select("nucleus_3d_id", F.col("z").alias("old_z"), F.col("area_px").alias("old_a"))
    new = summaries.best_row(o, ["nucleus_3d_id"], F.col("label")).select("nucleus_3d_id", F.col("z").alias("new_z"), F.col("area_px").alias("new_a"))
    return old.join(new, "nucleus_3d_id").select("nucleus_3d_id", "old_z", "new_z", (~F.col("old_z").eqNullSafe(F.col("new_z"))).alias("z_changed"), (~F.col("old_a").eqNullSafe(F.col("new_a"))).alias("area_changed"))


@query("best_plane_join", f"""WITH {X.OBJECTS}, b AS (SELECT nucleus_3d_id, t, z AS best_z FROM objects QUALIFY row_number() OVER (PARTITION BY nucleus_3d_id, t ORDER BY area_px DESC, label) = 1), k AS (SELECT o.* FROM objects o JOIN b ON o.nucleus_3d_id = b.nucleus_3d_id AND o.t = b.t AND o.z = best_z)
 SELECT nucleus_3d_id, count(*) AS n, count(*) > 1 AS excluded FROM k WHERE nucleus_3d_id IN (SELECT nucleus_3d_id FROM objects WHERE area_px > 9000) GROUP BY 1""")
def best_plane_join(spark, sf):
    o = X.objects(spark, sf)
    best = summaries.best_row(o, ["nucleus_3d_id", "t"], F.desc("area_px"), F.col("label")).select("nucleus_3d_id", "t", "z")
    kept = o.join(best, ["nucleus_3d_id", "t", "z"]).join(o.where("area_px > 9000").select("nucleus_3d_id"), "nucleus_3d_id", "left_semi")
    parents = kept.select("nucleus_3d_id").distinct()
    d = spatial.count_children(parents, kept, parent="nucleus_3d_id", child_parent="nucleus_3d_id")
    return d.select("nucleus_3d_id", F.col("n_children").alias("n"), F.col("excluded_multiple").alias("excluded"))


RECURSE = "SELECT node, min(head) AS cluster FROM reach GROUP BY 1"


@query("eps_clusters", f"""WITH RECURSIVE {X.FIJI}, s AS (SELECT suppkey AS k, any_value(XM) AS x, any_value(YM) AS y FROM fiji GROUP BY 1), e AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 120 * 120),
 reach(node, head) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.head = e.a) SELECT node AS suppkey, min(head) AS cluster FROM reach GROUP BY 1""")
def eps_clusters(spark, sf):
    s = X.fiji_rows(spark, sf).groupBy("suppkey").agg(F.first("XM").alias("x"), F.first("YM").alias("y"))
    return track.eps_clusters(s, key="suppkey", eps=120, out="cluster").select("suppkey", "cluster")


PLANES = f"""r AS (SELECT *, dense_rank() OVER (PARTITION BY t ORDER BY z) AS p FROM objects), c AS (SELECT b.label AS child, a.label AS parent, sqrt({D2}) AS d FROM r a JOIN r b ON a.t = b.t AND b.p = a.p + 1 AND {D2} < 20 * 20)"""


def _chains(links: str) -> str:
    return f"""up(node, head) AS (SELECT child, parent FROM l UNION ALL SELECT up.node, l.parent FROM up JOIN l ON up.head = l.child), heads AS (SELECT o.label, coalesce((SELECT min(h.head) FROM up h WHERE h.node = o.label AND h.head NOT IN (SELECT child FROM l)), o.label) AS head FROM objects o)"""


@query("group_planes", f"""WITH RECURSIVE {X.OBJECTS}, {PLANES}, f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY child ORDER BY d, parent) = 1), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY parent ORDER BY d, child) = 1), {_chains('l')}
 SELECT label, dense_rank() OVER (ORDER BY head) AS nucleus_3d_id FROM heads""")
def group_planes(spark, sf):
    o = X.objects(spark, sf).drop("nucleus_3d_id")
    return track.group_over_z(o, key="label", xy=XY, radius=20).select("label", "nucleus_3d_id")


@query("group_planes_forest", f"""WITH RECURSIVE {X.OBJECTS}, {PLANES}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY child ORDER BY d, parent) = 1), {_chains('l')}
 SELECT label, dense_rank() OVER (ORDER BY head) AS nucleus_3d_id FROM heads""")
def group_planes_forest(spark, sf):
    o = X.objects(spark, sf).drop("nucleus_3d_id")
    return track.group_over_z(o, key="label", xy=XY, radius=20, one_to_one=False).select("label", "nucleus_3d_id")


@query("track_simple", f"""WITH RECURSIVE {X.OBJECTS}, c AS (SELECT b.label AS child, a.label AS parent, sqrt({D2}) AS d FROM objects a JOIN objects b ON b.t = a.t + 1 AND {D2} < 15 * 15), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY child ORDER BY d, parent) = 1),
 l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY parent ORDER BY d, child) = 1), {_chains('l')} SELECT label, dense_rank() OVER (ORDER BY head) AS track_id FROM heads""")
def track_simple(spark, sf):
    return track.track_simple(X.objects(spark, sf), key="label", t="t", xy=XY, radius=15).select("label", "track_id")


@query("track_hybrid")
def track_hybrid(spark, sf):
    d = track.track_hybrid(X.objects(spark, sf), key="label", t="t", xy=XY, area="area_px", gate=46.3, eps=46.3)
    return d.select("label", "track_id", r("track_link_distance_px").alias("track_link_distance_px"), r("track_link_cost").alias("track_link_cost"), "track_dbscan_cluster_size", "track_dbscan_is_crowded", "track_link_method")


@query("track_optimal")
def track_optimal(spark, sf):
    return track.track_optimal(X.objects(spark, sf).select("label", "t", *XY), key="label", t="t", xy=XY, most=12.0).select("label", "track_id")


@query("tracking_summary")
def tracking_summary(spark, sf):
    return track.tracking_summary(track.track_hybrid(X.objects(spark, sf), key="label", t="t", xy=XY, area="area_px", gate=46.3, eps=46.3))


def _lloyd(rounds: int = 12) -> str:
    """CTEs ``near0`` to ``near<rounds>``: rows with their nearest centroid, from centroids at even quantiles."""
    start = " UNION ALL ".join(f"SELECT Condition, {k} AS k, {j} AS j, quantile_cont(f0, {(j + 0.5) / k!r}::DOUBLE) AS c0, avg(f1) AS c1 FROM d GROUP BY 1" for k in range(1, 6) for j in range(k))
    out = [f"cent0 AS ({start})"]
    for i in range(rounds + 1):
        gap = "(f0 - c0) * (f0 - c0) + (f1 - c1) * (f1 - c1)"
        out.append(f"near{i} AS MATERIALIZED (SELECT d.*, k, j, {gap} AS gap FROM d JOIN cent{i} USING (Condition) QUALIFY row_number() OVER (PARTITION BY Condition, cluster, Slice, k ORDER BY {gap}, j) = 1)")
        out.append(f"cent{i + 1} AS (SELECT Condition, k, j, avg(f0) AS c0, avg(f1) AS c1 FROM near{i} GROUP BY 1, 2, 3)")
    return ",\n ".join(out[:-1])


@query("kmeans_groups", f"""WITH {X.MEASUREMENTS}, m AS (SELECT Condition, cluster, Slice, avg(Nuclear_Area) AS a, avg(N_C_V2) AS n FROM measurements GROUP BY 1, 2, 3), d AS (SELECT Condition, cluster, Slice, coalesce((a - avg(a) OVER w) / nullif(stddev_samp(a) OVER w, 0), 0) AS f0, coalesce((n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0), 0) AS f1 FROM m WINDOW w AS (PARTITION BY Condition)),
 {_lloyd()}, s AS (SELECT Condition, k, count(*) AS n, sum(gap) AS wss FROM near12 GROUP BY 1, 2), f AS (SELECT *, (lag(wss) OVER w - wss) / nullif(lag(wss) OVER w, 0) AS fall FROM s WINDOW w AS (PARTITION BY Condition ORDER BY k))
 SELECT Condition, k, n, round(wss, 4) AS wss, round(fall, 6) AS drop, coalesce(min(CASE WHEN fall < 0.1 THEN k END) OVER (PARTITION BY Condition) - 1, max(k) OVER (PARTITION BY Condition))::INT AS best_k FROM f""")
def kmeans_groups(spark, sf):
    """Clusters of measurements per condition, all groups and numbers of clusters together, with the elbow's choice."""
    m = X.measurements(spark, sf).groupBy("Condition", "cluster", "Slice").agg(F.avg("Nuclear_Area").alias("a"), F.avg("N_C_V2").alias("n"))
    return cluster.group_kmeans(m, keys=["Condition"], features=["a", "n"], ks=[1, 2, 3, 4, 5])


@query("kmeans_foreground")
def kmeans_foreground(spark, sf):
    m = X.pixels(spark, sf).withColumn("i2", F.col("intensity") * F.col("intensity"))
    d = cluster.kmeans(m, ["intensity", "i2"], 3, seed=123)
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.avg("intensity"), 4).alias("mean")).withColumn("foreground", F.col("mean") == F.max("mean").over(Window.partitionBy()))


@query("pca_components")
def pca_components(spark, sf):
    m = X.fiji_rows(spark, sf)
    return cluster.pca(m, ["Area", "IntDen", "m_IntDen", "npc_IntDen", "Mean"], 5, keep=["row_key", "Slice"])


@query("best_z_path", f"""WITH RECURSIVE {X.OBJECTS}, o AS (SELECT label % 16 AS series, t, z, avg(area_px) AS score FROM objects GROUP BY 1, 2, 3), m AS (SELECT *, median(score) OVER (PARTITION BY series, t) AS med FROM o), d AS (SELECT series, t, z, (score - med) / (median(abs(score - med)) OVER (PARTITION BY series, t) + 1e-9) AS s FROM m),
 g AS (SELECT a.series, a.t, a.i, b.z, coalesce(d.s, -1e6) AS s FROM (SELECT series, t, dense_rank() OVER (PARTITION BY series ORDER BY t) AS i FROM (SELECT DISTINCT series, t FROM d)) a JOIN (SELECT DISTINCT series, z FROM d) b USING (series) LEFT JOIN d ON d.series = a.series AND d.t = a.t AND d.z = b.z),
 fw(series, i, z, best, back) AS (SELECT series, i, z, s, z FROM g WHERE i = 1 UNION ALL SELECT series, i, z, best, back FROM (SELECT g.series, g.i, g.z, f.best - 0.2::DOUBLE * abs(g.z - f.z) - CASE WHEN abs(g.z - f.z) > 2 THEN 1e9 ELSE 0 END AS before, g.s + before AS best, f.z AS back FROM fw f JOIN g ON g.series = f.series AND g.i = f.i + 1) QUALIFY row_number() OVER (PARTITION BY series, i, z ORDER BY before DESC, back) = 1),
 bt(series, i, z) AS (SELECT series, i, z FROM (SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY series ORDER BY i DESC, best DESC, z) = 1) UNION ALL SELECT b.series, b.i - 1, f.back FROM bt b JOIN fw f ON f.series = b.series AND f.i = b.i AND f.z = b.z WHERE b.i > 1),
 n AS (SELECT series, t, z, s, lag(s) OVER w AS a, lead(s) OVER w AS b FROM d WINDOW w AS (PARTITION BY series, t ORDER BY z)), c AS (SELECT DISTINCT bt.series, g.t, bt.z AS best_z FROM bt JOIN g ON g.series = bt.series AND g.i = bt.i),
 r AS (SELECT c.series, c.t, c.best_z, c.best_z + CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE least(greatest(coalesce(0.5::DOUBLE * (a - b) / nullif(a - 2 * s + b, 0), 0), -1), 1) END AS refined FROM c JOIN n ON n.series = c.series AND n.t = c.t AND n.z = c.best_z),
 k AS (SELECT *, lag(best_z) OVER w AS p, lead(best_z) OVER w AS q FROM r WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT series, t, best_z, round(refined, 6) AS refined_z, CASE WHEN p = best_z OR q = best_z THEN best_z WHEN p = q THEN p ELSE least(p, best_z, q) END AS mode_z FROM k""")
def best_z_path(spark, sf):
    o = X.objects(spark, sf).groupBy((F.col("label") % 16).alias("series"), "t", "z").agg(F.avg("area_px").alias("score"))
    return cluster.smooth_best_z(o, series="series", t="t", z="z", score="score", penalty=0.2, max_step=2)
