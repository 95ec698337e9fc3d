"""Hand cases of the operators: empty tables, one row, constant groups, zero denominators, ties, borders."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrilens.functions import cdf
from petrilens.functions import columns as P
from petrilens.operators import axes, clean, compare, fit, graph, pixels, spatial, summaries, track
from petrilens.sources import tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_columns_guards(spark):
    d = spark.createDataFrame([(0.0, 0.0, 4.0), (3.0, 1.0, None)], "a double, b double, p double")
    got = d.select(P.nc_ratio("a", "b").alias("r"), P.nc_fraction("a", "b").alias("f"), P.circularity("a", "p").alias("c"), P.nc_boundary("a", "b", "b").alias("n")).collect()
    assert got[0]["r"] is None and got[0]["f"] is None and got[1]["c"] is None and got[0]["n"] is None
    assert got[1]["r"] == 3.0


def test_serpentine_tiles(spark):
    d = spark.createDataFrame([(10.0, 10.0), (390.0, 10.0), (10.0, 150.0), (390.0, 299.0)], "x double, y double")
    row, col, index = P.tile_columns("x", "y", width=400, height=300, rows=3, cols=4)
    assert rows(d, row, col, index) == sorted([(0, 0, 0), (0, 3, 3), (1, 0, 7), (2, 3, 11)])


def test_true_time_needs_positive_extent(spark):
    d = spark.createDataFrame([(0.0, 0)], "x double, t int")
    with pytest.raises(Exception, match="widest x"):
        P.true_time_from_x(d, x="x", t="t", fields=3).collect()


def test_stars_and_names(spark):
    d = spark.createDataFrame([(0.00001,), (0.04,), (0.5,), (None,)], "p double")
    assert [r[0] for r in d.select(P.stars("p")).collect()] == ["****", "*", "ns", ""]
    assert P.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "k long, x double, y double, v double")
    assert clean.within_sd(d, ["v"]).count() == 0
    assert clean.within_iqr(d, ["v"]).count() == 0
    assert clean.combined_keep(d, ["v"]).count() == 0
    assert summaries.histogram(d, "v", 5).where("n > 0").count() == 0
    assert track.eps_clusters(d, key="k", eps=1.0).count() == 0
    assert compare.rank_sum(d.withColumn("c", F.lit("a")), bin="k", condition="c", value="v", pairs=[("a", "b")]).count() == 0


def test_constant_group(spark):
    d = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0)], "g int, v double")
    assert rows(d.withColumn("s", summaries.min_max("v", ["g"])), "g", "s") == [(1, 0.0), (1, 0.0), (2, 0.0)]
    assert clean.within_mad(d.where("g = 1"), "v").count() == 0  # a MAD of 0 leaves nothing


def test_staged_limits_missing_time_is_late(spark):
    d = spark.createDataFrame([(1, 5.0), (9, 5.0), (None, 5.0)], "t int, a double")
    got = clean.staged_limits(d, t="t", stages=[(5, {"a": (None, 6)}), (None, {"a": (6, None), "absent": (1, 2)})])
    assert rows(got, "t") == [(1,)]


def test_histogram_last_bin_holds_its_end(spark):
    d = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10)], "v double")
    assert [r["n"] for r in summaries.histogram(d, "v", 5).orderBy("bin").collect()] == [2, 1, 0, 0, 1]


def test_rolling_mode_tie_takes_smallest(spark):
    d = spark.createDataFrame([(0, 3), (1, 1), (2, 2)], "i int, z int").withColumn("g", F.lit(1))
    assert [r["m"] for r in summaries.rolling_mode(d, "z", ["g"], ["i"], "m").orderBy("i").collect()] == [1, 1, 1]


def test_near_pairs_equal_brute_force(spark):
    r = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-30, 30, (120, 2)))]
    d = spark.createDataFrame(pts, "k int, x double, y double")
    got = rows(spatial.near_pairs(d, spatial.prefixed(d, "b_"), radius=7.0, right_xy=("b_x", "b_y")), "k", "b_k")
    assert got == sorted((a, b) for (a, x, y), (b, u, v) in itertools.product(pts, pts) if (x - u) ** 2 + (y - v) ** 2 <= 49)


def test_one_to_one_conflict(spark):
    d = spark.createDataFrame([(1, 10, 2.0), (2, 10, 1.0), (1, 11, 5.0)], "s int, t int, distance double")
    assert rows(spatial.match_one_to_one(d, "s", "t"), "s", "t") == [(2, 10)]  # the other source stays without one


def test_nearest_neighbour_far_and_alone(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 900.0, 0.0), (3, 1, 5.0, 5.0)], "k int, t int, x double, y double")
    assert rows(spatial.nearest_neighbour(d, key="k", on=["t"]), "k", "nearest_px") == [(1, 900.0), (2, 900.0), (3, None)]


def test_components_long_chain_and_loop(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (900, 900)], "a long, b long")
    got = dict((r["node"], r["component"]) for r in graph.connected_components(e).collect())
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and got[900] == 900 and len(got) == 204


def test_chain_heads(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(30, 5)], "child long, parent long")
    got = {r["node"]: r["head"] for r in graph.chain_heads(links, "child", "parent").collect()}
    assert set(got.values()) == {0} and len(got) == 22


def test_assignment_equals_brute_force():
    r = np.random.default_rng(3)
    for _ in range(200):
        n, m = map(int, r.integers(1, 5, 2))
        cost = np.where(r.random((n, m)) < 0.35, np.inf, r.integers(1, 20, (n, m)).astype(float))
        got = track.assign(cost)
        if n <= m:
            options = [[(i, p[i]) for i in range(n) if np.isfinite(cost[i, p[i]])] for p in itertools.permutations(range(m), n)]
        else:
            options = [[(p[j], j) for j in range(m) if np.isfinite(cost[p[j], j])] for p in itertools.permutations(range(n), m)]
        key = lambda o: (-len(o), sum(cost[a, b] for a, b in o))
        assert key(got) == min(map(key, options))


def test_track_hybrid_links_and_methods(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0), (2, 1, 1.0, 0.0, 11.0), (3, 1, 50.0, 0.0, 9.0), (4, 2, 1.5, 0.0, 500.0)], "k long, t int, x double, y double, a double")
    got = {r["k"]: r for r in track.track_hybrid(d, key="k", t="t", xy=("x", "y"), area="a", gate=5.0, eps=5.0).collect()}
    assert got[1]["track_id"] == got[2]["track_id"] and got[1]["track_link_method"] == "seed" and got[2]["track_link_method"] == "hybrid_dbscan"
    assert got[4]["track_id"] != got[2]["track_id"] and got[4]["track_link_method"] == "new_track_unmatched"  # area ratio


def _plane(text):
    return [(0, y, x) for y, line in enumerate(text.split()) for x, c in enumerate(line) if c == "#"]


def test_ring_hole_and_neighbourhoods(spark):
    ring = spark.createDataFrame(_plane(".....\n.###.\n.#.#.\n.###.\n....."), "t int, y int, x int")
    assert pixels.clean_mask(ring, ["t"], width=5, height=5, small=2, hole=3).count() == 9
    diagonal = spark.createDataFrame(_plane("#..\n.#.\n..#"), "t int, y int, x int")
    assert pixels.label_mask(diagonal, ["t"], 8).select("component").distinct().count() == 1
    assert pixels.label_mask(diagonal, ["t"], 4).select("component").distinct().count() == 3


def test_region_of_a_square(spark):
    sq = spark.createDataFrame([(0, 1, y, x) for y in range(2, 6) for x in range(3, 7)], "t int, label int, y int, x int")
    r = pixels.regions(sq, ["t", "label"]).first()
    assert (r["area_px"], r["centroid_y_px"], r["bbox_min_row"], r["bbox_max_col"], r["perimeter_px"]) == (16, 3.5, 2, 7, 12.0)
    assert pixels.solidity(sq, ["t", "label"]).first()["solidity"] == pytest.approx(1.0)


def test_halos_overlap_between_neighbours(spark):
    px = spark.createDataFrame([(0, 0, x, 1.0) for x in range(5)], "t int, y int, x int, intensity double")
    lab = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 3, 2)], "t int, y int, x int, label int")
    got = {r["label"]: r for r in pixels.halos(px, lab, ["t"], step=1.0, n=2, erode=1.0).collect()}
    assert got[1]["ring_1_area_px"] == 2 and got[2]["ring_1_area_px"] == 2 and got[1]["nucleus_area_px"] == 1


def test_patch_starts():
    assert pixels.patch_starts(80, 32, 16) == [0, 16, 32, 48] and pixels.patch_starts(70, 32, 16) == [0, 16, 32, 38] and pixels.patch_starts(20, 32, 16) == [0]


def test_distribution_functions():
    assert cdf.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert cdf.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert cdf.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert cdf.t_two_sided(float("nan"), 3) is None


def test_welch_notes(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0), (3, "a", 2.0), (3, "a", 2.0), (3, "b", 2.0), (3, "b", 2.0)], "g int, c string, v double")
    got = compare.welch(d, bin="g", condition="c", value="v", pairs=[("a", "b")])
    assert rows(got, "g", "note", "p") == [(1, "too few values", None), (2, "one group", None), (3, "no variance", None)]


def test_bh_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.01), (3, 0.5), (4, None)], "k int, p double").withColumn("f", F.lit(1))
    got = {r["k"]: r["p_adj"] for r in compare.adjust_bh(d, ["f"], "p", ["k"]).collect()}
    assert got[4] is None and got[1] == got[2] == pytest.approx(0.015) and got[3] == pytest.approx(0.5)


def test_plateau_recovers_parameters(spark):
    d = spark.createDataFrame([("a", float(t), 200 * (1 - math.exp(-0.07 * t))) for t in range(60)], "g string, t double, v double")
    r = fit.fit_plateau(d, ["g"], "t", "v").first()
    assert r["A"] == pytest.approx(200, rel=1e-4) and r["k"] == pytest.approx(0.07, rel=1e-4)
    best = fit.fit_models(d, ["g"], "t", "v", ["exponential", "offset_exponential"]).where("best").first()
    assert best["rss"] < 1e-6


def test_concat_rejects_other_shapes(spark):
    px = spark.createDataFrame([("a", 0, 0, 0, 0, 0, 1.0), ("b", 0, 0, 0, 0, 1, 1.0)], "stack_id string, t int, z int, c int, y int, x int, intensity double")
    jobs = spark.createDataFrame([("j", 1, "a"), ("j", 2, "b")], "job string, `order` int, stack_id string")
    with pytest.raises(Exception, match="shapes differ"):
        axes.concat_stacks(px, jobs).collect()
    with pytest.raises(ValueError, match="unknown axes"):
        axes.ensure_axes(px.withColumn("wavelength", F.lit(1)))


def test_tables_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    stem = f"file://{tmp_path}/stage"
    assert tables.read_table(spark, stem) == (None, None)
    tables.save_table(d, stem)
    back, path = tables.read_table(spark, stem)
    assert path.endswith(".parquet") and rows(back, "k", "v") == [(1, "a"), (2, "b")]
    calls = []
    make = lambda: calls.append(1) or d
    tables.stage(spark, f"{stem}2", make)
    assert tables.stage(spark, f"{stem}2", make).count() == 2 and len(calls) == 1


def test_natural_order(spark):
    d = spark.createDataFrame([("A_t10.tif",), ("A_t9.tif",), ("B_1.tif",), ("none",)], "name string")
    got = {r["group"]: r["files"] for r in tables.group_files(d, "^([A-Z])_").collect()}
    assert got == {"A": ["A_t9.tif", "A_t10.tif"], "B": ["B_1.tif"]}
