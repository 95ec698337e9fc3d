"""Operators that SQL can't express, against brute force in numpy and enumeration."""

import itertools
import math
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from petrilens.functions.broadcasts import exact_quantiles
from petrilens.operators import cluster, fit, pixels, summaries, track


def test_exact_quantiles(spark):
    r = np.random.default_rng(1)
    for values in (r.normal(0, 1, 5000), np.repeat([1.0, 2.0, 3.0], 2000), np.concatenate([np.zeros(4000), r.exponential(1, 100)]), np.array([7.0])):
        d = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        at = (0.0, 0.05, 0.25, 0.5, 0.731, 0.95, 1.0)
        for most in (100_000, 50):
            assert exact_quantiles(d, "v", at, most=most) == pytest.approx(np.quantile(values, at).tolist(), abs=1e-12)
    assert exact_quantiles(d.where("v > 100"), "v", (0.5,)) == [None]


def test_optimal_links(spark):
    """All ways to link two frames: the most pairs within the distance, then the least total."""
    r = np.random.default_rng(2)
    for _ in range(3):
        a, b = r.uniform(0, 10, (5, 2)), r.uniform(0, 10, (6, 2))
        cost = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
        best = (0, 0.0)
        for to in itertools.permutations(range(6), 5):
            ok = [cost[i, j] for i, j in enumerate(to) if cost[i, j] <= 3]
            best = min(best, (-len(ok), sum(ok)))
        rows = [(i, 0, *map(float, p)) for i, p in enumerate(a)] + [(10 + i, 1, *map(float, p)) for i, p in enumerate(b)]
        got = track.track_optimal(spark.createDataFrame(rows, "k long, t int, x double, y double"), key="k", t="t", xy=("x", "y"), most=3.0).toPandas()
        linked = [g["k"].tolist() for _, g in got.groupby("track_id") if len(g) == 2]
        assert (-len(linked), pytest.approx(sum(cost[min(p), max(p) - 10] for p in linked))) == best


def test_crowded_gate(spark):
    """Two objects of one frame in a cluster make it crowded, and its gate narrower."""
    rows = [(1, 0, 0.0, 0.0, 100.0), (2, 1, 8.0, 0.0, 100.0), (3, 0, 100.0, 0.0, 100.0), (4, 1, 108.0, 0.0, 100.0), (5, 1, 109.0, 0.0, 100.0), (6, 1, 500.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "k long, t int, x double, y double, a double")
    got = {r["k"]: r for r in track.track_hybrid(d, key="k", t="t", xy=("x", "y"), area="a", gate=10.0, eps=10.0, crowded_gate=0.65).collect()}
    assert [got[k]["track_link_method"] for k in (1, 2, 4, 5, 6)] == ["seed", "hybrid_dbscan", "new_track_unmatched", "new_track_unmatched", "new_track_unmatched"]
    assert got[2]["track_id"] == got[1]["track_id"] and not got[2]["track_dbscan_is_crowded"] and got[4]["track_dbscan_is_crowded"] and got[4]["track_dbscan_cluster_size"] == 3


def test_tracking_summary(spark):
    rows = [(1, False, "seed"), (1, True, "hybrid_dbscan"), (1, False, "hybrid_dbscan"), (2, False, "new_track_unmatched")]
    got = track.tracking_summary(spark.createDataFrame(rows, "track_id long, track_dbscan_is_crowded boolean, track_link_method string")).head()
    assert (got["rows"], got["tracks"], got["median_length"], got["mean_length"], got["crowded_fraction"], got["new_fraction"]) == (4, 2, 2.0, 2.0, 0.25, 0.25)


def test_components_of_features(spark):
    r = np.random.default_rng(3)
    m = r.normal(0, 1, (200, 4)) @ r.normal(0, 1, (4, 4))
    d = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(m)], "k long, a double, b double, c double, d double")
    got = cluster.pca(d, ["a", "b", "c", "d"], 3, ["k"]).toPandas().sort_values("k")
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    w, v = np.linalg.eigh(np.cov(z.T))
    for j, col in enumerate(np.argsort(-w)[:3]):
        load = v[:, col] * (1 if v[np.abs(v[:, col]).argmax(), col] > 0 else -1)
        assert got[f"pc{j + 1}"].to_numpy() == pytest.approx(z @ load, abs=1e-5)


def test_kmeans_of_clear_groups(spark):
    r = np.random.default_rng(4)
    m = np.concatenate([r.normal(c, 0.1, (60, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    d = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(m)], "k long, a double, b double")
    got = cluster.kmeans(d, ["a", "b"], 3).toPandas().sort_values("k")["cluster"].to_numpy()
    assert [len(set(got[i : i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(got)) == 3 and got[0] < got[60]
    told = cluster.group_kmeans(d.withColumn("g", F.lit(1)), keys=["g"], features=["a", "b"], ks=[1, 2, 3, 4]).toPandas()
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    groups = np.repeat([0, 1, 2], 60)
    wss = sum(((z[groups == g] - z[groups == g].mean(0)) ** 2).sum() for g in range(3))
    assert told.set_index("k")["wss"][3] == pytest.approx(wss, abs=1e-3) and told.set_index("k")["wss"][1] == pytest.approx(2 * 179, abs=1e-3)
    few = cluster.group_kmeans(d.limit(5).withColumn("g", F.lit(2)), keys=["g"], features=["a", "b"], ks=[1, 2]).collect()
    assert len(few) == 1 and few[0]["best_k"] is None


def test_best_path_equals_all_paths(spark):
    r = np.random.default_rng(5)
    score = r.normal(0, 1, (5, 4))
    d = spark.createDataFrame([(1, t, z, float(score[t, z])) for t in range(5) for z in range(4)], "s int, t int, z int, score double")
    got = cluster.smooth_best_z(d, series="s", t="t", z="z", score="score", penalty=0.4, max_step=2).toPandas().sort_values("t")
    med = np.median(score, axis=1, keepdims=True)
    n = (score - med) / (np.median(np.abs(score - med), axis=1, keepdims=True) + 1e-9)
    paths = [p for p in itertools.product(range(4), repeat=5) if all(abs(a - b) <= 2 for a, b in itertools.pairwise(p))]
    best = max(paths, key=lambda p: sum(n[t, z] for t, z in enumerate(p)) - 0.4 * sum(abs(a - b) for a, b in itertools.pairwise(p)))
    assert tuple(got["best_z"]) == best


def test_growth_models_recover_a_curve(spark):
    r = np.random.default_rng(6)
    t = np.repeat(np.arange(0, 50), 20)
    y = 80 * (1 - np.exp(-0.08 * np.maximum(t - 4.0, 0))) + r.normal(0, 1, len(t))
    d = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(t, y, strict=True)], "g string, t double, y double")
    got = {x["model"]: x for x in fit.fit_models(d, ["g"], "t", "y").collect()}
    assert got["exponential"]["params"] == pytest.approx([80, 0.08, 4], rel=0.05) and got["exponential"]["aic"] <= min(x["aic"] for x in got.values()) + 5
    rss = sum((y - got["exponential"]["params"][0] * (1 - np.exp(-got["exponential"]["params"][1] * np.maximum(t - got["exponential"]["params"][2], 0)))) ** 2)
    assert got["exponential"]["rss"] == pytest.approx(rss, rel=1e-6)


def test_bootstrap_band_covers_the_fit(spark):
    r = np.random.default_rng(7)
    t = np.repeat(np.arange(0, 40), 8)
    y = 60 * (1 - np.exp(-0.1 * t)) + r.normal(0, 3, len(t))
    d = spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, y, strict=True))], "g string, i long, t double, y double")
    band = fit.bootstrap_band(d, ["g"], ["i"], "t", "y", replicates=60, last=40, step=10.0).toPandas().sort_values("t")
    f = fit.predict_grid(fit.fit_plateau(d, ["g"], "t", "y"), ["g"], 40, 10.0).toPandas().sort_values("t")
    assert (band["low"].to_numpy() <= f["fit"].to_numpy() + 1e-9).all() and (f["fit"].to_numpy() <= band["high"].to_numpy() + 1e-9).all()
    # A plain bootstrap in numpy has a band of about this width.
    k = np.geomspace(0.02, 0.4, 200)
    wide = []
    for _ in range(60):
        w = r.poisson(1.0, len(t))
        g = 1 - np.exp(-k[:, None] * t[None])
        a = (w * y * g).sum(1) / (w * g * g).sum(1)
        best = ((w * (y - a[:, None] * g) ** 2).sum(1)).argmin()
        wide.append(a[best] * (1 - np.exp(-k[best] * 20)))
    assert (band["high"] - band["low"]).to_numpy()[2] == pytest.approx(np.diff(np.quantile(wide, [0.025, 0.975]))[0], rel=0.6)


def _components(mask, diagonal):
    seen, out = set(), []
    for start in sorted(mask):
        if start in seen:
            continue
        todo, comp = deque([start]), []
        seen.add(start)
        while todo:
            y, x = todo.popleft()
            comp.append((y, x))
            for i, j in itertools.product((-1, 0, 1), repeat=2):
                p = (y + i, x + j)
                if p in mask and p not in seen and (diagonal or abs(i) + abs(j) == 1):
                    seen.add(p)
                    todo.append(p)
        out.append(comp)
    return out


def test_mask_by_rule(spark):
    """Smoothed, robust z, over Otsu, components of some size, small holes filled: by loops over a small image."""
    r = np.random.default_rng(8)
    n = 24
    img = r.normal(0, 0.3, (n, n))
    yy, xx = np.mgrid[:n, :n]
    for cy, cx, rad in ((6, 6, 4), (16, 15, 5)):
        img[(yy - cy) ** 2 + (xx - cx) ** 2 <= rad * rad] += 4
    img[16, 15] -= 9
    px = spark.createDataFrame([(0, y, x, float(img[y, x])) for y in range(n) for x in range(n)], "t int, y int, x int, intensity double")
    got = {(q["y"], q["x"]) for q in pixels.derive_mask(px, ["t"], sigma=0.6, factor=1.0, least_area=5, hole=6, width=n, height=n, bins=64).collect()}
    k = np.array(pixels.gaussian_kernel(0.6))
    half = len(k) // 2
    at = lambda i: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    row = np.array([[sum(k[d] * img[y, at(x + d - half)] for d in range(len(k))) for x in range(n)] for y in range(n)])
    g = np.array([[sum(k[d] * row[at(y + d - half), x] for d in range(len(k))) for x in range(n)] for y in range(n)])
    z = (g - np.median(g)) / (np.median(np.abs(g - np.median(g))) + 1e-9)
    counts, edges = np.histogram(z, 64)
    mid, p = (edges[1:] + edges[:-1]) / 2, counts / counts.sum()
    w, m = np.cumsum(p), np.cumsum(p * mid)
    with np.errstate(all="ignore"):
        between = np.where((w > 1e-12) & (w < 1 - 1e-12), (m[-1] * w - m) ** 2 / (w * (1 - w)), 0)
    mask = {(y, x) for y in range(n) for x in range(n) if z[y, x] > mid[np.round(between, 9).argmax()]}
    mask = {q for c in _components(mask, True) if len(c) >= 5 for q in c}
    mask = {q for c in _components(mask, False) if len(c) >= 5 for q in c}
    back = {(y, x) for y in range(n) for x in range(n)} - mask
    mask |= {q for c in _components(back, False) if len(c) < 6 for q in c}
    assert got == mask and (16, 15) in mask


def test_stencils_on_short_lines(spark):
    """Taps longer than the image, mirrored once, then the end pixel."""
    img = [3.0, 5.0]
    d = spark.createDataFrame([(0, x, v) for x, v in enumerate(img)], "y int, x int, v double")
    got = {q["x"]: q["o"] for q in pixels.along(d, "v", [1, 10, 100, 1000, 10000], "x", [], "o").collect()}
    at = lambda i: img[min(1, max(0, -1 - i if i < 0 else 3 - i if i > 1 else i))]
    assert got == {x: sum(w * at(x + o) for o, w in zip(range(-2, 3), (1, 10, 100, 1000, 10000), strict=True)) for x in (0, 1)}


def test_normalised_tables_hold_every_row(spark):
    d = spark.createDataFrame([("b", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", 1, 4.0)], "e string, c int, v double")
    t = summaries.normalised_tables(d, experiment=["e"], cell=["c"], measures=["v"], row=["v"])
    back = t["measurements"].join(t["cells"], "cell_id").join(t["experiments"], "experiment_id").select("e", "c", "v").toPandas()
    assert sorted(map(tuple, back.to_numpy().tolist())) == sorted([("b", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", 1, 4.0)])
    for name, key in (("experiments", "experiment_id"), ("cells", "cell_id"), ("measurements", "measurement_id")):
        v = summaries.key_violations(t[name], [key]).head()
        assert (v["null_keys"], v["repeated_keys"]) == (0, 0)


def test_trimmed_otsu_of_few_values(spark):
    d = pd.DataFrame({"g": [1] * 10 + [2] * 600, "v": [float(i) for i in range(10)] + [float(i % 2 * 10 + i % 7 / 10) for i in range(600)]})
    got = {q["g"]: q["threshold"] for q in summaries.otsu_trimmed(spark.createDataFrame(d), "v", ["g"]).collect()}
    assert got[1] == pytest.approx(4.5) and 0.6 <= got[2] < 10 and not math.isnan(got[2])
