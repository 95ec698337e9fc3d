"""Operators on skewed inputs: large components, clusters with outliers, hubs and hot groups."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from petrilens.functions import quantiles
from petrilens.operators import auction, graph, pixels, spatial, track


def _frames(rng, n, gate):
    a, b = rng.uniform(0, 1, (n, 2)), rng.uniform(0, 1, (n, 2))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    return [(0, int(i), int(j), float(d[i, j]), float(a[i, 0]), float(b[j, 0])) for i, j in zip(*np.nonzero(d <= gate), strict=True)]


def _chain(rng, n):
    pairs = [(i, j) for i in range(n) for j in (i, i - 1) if j >= 0 and j % 7]
    return [(0, i, j, float(rng.uniform()), float(i), float(j)) for i, j in pairs]


def _cost(edges, links):
    cost = {e[1:3]: e[3] for e in edges}
    assert len({a for a, _ in links}) == len({b for _, b in links}) == len(links)
    return len(links), pytest.approx(sum(cost[x] for x in links), abs=1e-6)


@pytest.mark.parametrize("make, cell", [(lambda r: _frames(r, 150, 0.13), 1000), (lambda r: _chain(r, 400), 120)])
def test_auction_equals_the_matrix_solver(spark, monkeypatch, make, cell):
    monkeypatch.setattr(auction, "CELL", cell)
    edges = make(np.random.default_rng(1))
    matrix = np.full((500, 500), np.inf)
    for _, a, b, c, *_ in edges:
        matrix[a, b] = c
    df = spark.createDataFrame(edges, "component long, k0 long, k1 long, cost double, x0 double, x1 double")
    got = [tuple(r) for r in auction.assign_cells(df).collect()]
    assert _cost(edges, got) == _cost(edges, track.assign(matrix))


def test_auction_settles_news_between_cells():
    """Two columns, three rows in two cells: the dearest row stays out."""
    outside = 10**6
    cells = {0: auction.Cell([(0, 1, 1, 50), (2, 1, 1, 10), (2, 3, 1, 40)], outside), 1: auction.Cell([(1, 0, 0, 50), (1, 2, 0, 10), (1, 4, 1, 20), (3, 2, 0, 40), (3, 4, 1, 90), (4, 1, 1, 20), (4, 3, 1, 90)], outside)}
    for increment in (1000, 100, 10, 1):
        news, fresh = {}, True
        while fresh or any(news.values()):
            told = [x for k in cells for x in auction.settle({k: cells[k]}, news.get(k, ()), increment, fresh)]
            news, fresh = {k: [t for to, t in told if to == k] for k in cells}, False
    links = {(person, place) for c in cells.values() for place, (person, _) in c.owner.items() if place % 2 and not person % 2}
    assert links == {(2, 3), (4, 1)}


def test_tracks_of_large_components(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i + 1000 * t, t, float(x), float(y), 100.0) for t in range(3) for i, (x, y) in enumerate(rng.uniform(0, 30, (60, 2)))]
    d = spark.createDataFrame(rows, "k long, t int, x double, y double, a double")
    run = lambda: track.track_optimal(d, key="k", t="t", xy=("x", "y"), most=6.0).select("k", "track_id").orderBy("k").collect()
    dense = run()
    monkeypatch.setattr(track, "DENSE", 10)
    assert run() == dense


def _nearest(points, others, same):
    out = []
    for i, (x, y) in enumerate(points):
        d = np.hypot(others[:, 0] - x, others[:, 1] - y)
        if same:
            d[i] = np.inf
        out.append((d.min(), int(d.argmin())))
    return out


@pytest.mark.parametrize("leaf", [16, 64])
def test_nearest_under_skew(spark, monkeypatch, leaf):
    """A tight cluster, outliers far away, repeated locations, a group of one."""
    monkeypatch.setattr(spatial, "LEAF", leaf)
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(500, 0.1, (400, 2)), rng.uniform(0, 1000, (40, 2)), np.full((100, 2), 77.5)])
    rows = [(i, 0, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(10**6, 1, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "k long, g int, x double, y double")
    got = {r["k"]: r["nearest_px"] for r in spatial.nearest_neighbour(df, key="k", on=["g"]).collect()}
    want = _nearest(pts, pts.copy(), True)
    assert got.pop(10**6) is None
    assert [got[i] for i in range(len(pts))] == pytest.approx([d for d, _ in want], rel=1e-9)
    centroids = spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(pts[::7])], "c long, g int, cx double, cy double")
    far = df.withColumn("x", F.col("x") * 3 - 1e3)
    told = {r["k"]: (r["nearest_px"], r["nearest"]) for r in spatial.nearest_centroid(far, centroids, on=["g"], point="k", centroid="c", xy=("x", "y"), centroid_xy=("cx", "cy")).collect()}
    assert told.pop(10**6) == (None, None)
    want = _nearest(pts * [3, 1] - [1e3, 0], pts[::7], False)
    assert [told[i][0] for i in range(len(pts))] == pytest.approx([d for d, _ in want], rel=1e-9)
    assert sum(told[i][1] == c for i, (_, c) in enumerate(want)) == len(pts)


@pytest.mark.parametrize("hub", [0, 7, 10**6])
def test_components_and_chains_with_a_hub(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "_FEW", 10)
    monkeypatch.setattr(graph, "_HOT", 20)
    edges = [(hub, i) for i in range(1, 400) if i != hub] + [(2000 + i, 2001 + i) for i in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    star = {hub, *range(1, 400)}
    assert {got[i] for i in star} == {min(star)} and {got[2000 + i] for i in range(31)} == {2000} and len(got) == len(star) + 31
    links = spark.createDataFrame([(i, hub) for i in range(1, 400) if i != hub] + [(5000 + i, 5001 + i) for i in range(40)] + [(5040, hub)], "c long, p long")
    heads = {r["node"]: r["head"] for r in graph.chain_heads(links, "c", "p").collect()}
    assert set(heads.values()) == {hub} and len(heads) == len(star) + 41


@pytest.mark.parametrize("most, bins, final", [(100_000, 1024, 10_000), (40, 8, 5), (0, 3, 2)])
def test_quantiles_of_groups(spark, monkeypatch, most, bins, final):
    for name, n in (("MOST", most), ("BINS", bins), ("FINAL", final)):
        monkeypatch.setattr(quantiles, name, n)
    rng = np.random.default_rng(4)
    groups = {"hot": rng.normal(0, 1, 500), "steps": np.repeat([1.0, 2.0, 5.0], 60), "far": np.concatenate([np.zeros(50), [1e300, -1e300]]), "one": np.array([7.0]), None: rng.exponential(1, 90)}
    rows = [(k, 1, float(v)) for k, values in groups.items() for v in values] + [("none", 1, None), ("hot", 1, None)]
    d = spark.createDataFrame(rows, "g string, h int, v double")
    at = (0.0, 0.1, 0.5, 0.975, 1.0)
    got = {r["g"]: r["q"] for r in quantiles.group_quantiles(d, ["g", "h"], "v", at).collect()}
    assert set(got) - {"none"} == set(groups)
    for k, values in groups.items():
        assert got[k] == pytest.approx(np.quantile(values, at).tolist(), rel=1e-12)
    own = spark.createDataFrame([("hot", 1, [0.25]), ("steps", 1, [0.9])], "g string, h int, at array<double>")
    assert {r["g"]: r["q"][0] for r in quantiles.group_quantiles(d, ["g", "h"], "v", own).collect()} == {"hot": pytest.approx(np.quantile(groups["hot"], 0.25)), "steps": 5.0}
    told = quantiles.with_group_quantiles(d, ["g", "h"], F.abs("v"), _m=0.5).where("g = 'none' or g is null").select("g", "_m").distinct().collect()
    assert {r["g"]: r["_m"] for r in told} == {"none": None, None: pytest.approx(np.median(groups[None]))}


def test_median_of_squares(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 50, (7, 9)).astype(float)
    d = spark.createDataFrame([("s", y, x, float(image[y, x])) for y in range(7) for x in range(9)] + [("t", 0, 0, 3.0)], "stack string, y int, x int, v double")
    for half in (1, 2):
        got = {(r["stack"], r["y"], r["x"]): r["m"] for r in pixels.median_filter(d, "v", ["stack"], "m", half).collect()}
        assert got.pop(("t", 0, 0)) == 3.0
        assert got == {("s", y, x): np.median(image[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]) for y in range(7) for x in range(9)}


@pytest.mark.parametrize("shape", [pixels.disk(2), pixels.square(1), pixels.disk(4)])
def test_morphology_by_runs(spark, shape):
    rng = np.random.default_rng(6)
    mask = rng.uniform(size=(9, 12)) < 0.7
    mask[3:9, 2:11] |= rng.uniform(size=(6, 9)) < 0.9
    mask[2] = False
    d = spark.createDataFrame([("s", int(y), int(x)) for y, x in np.argwhere(mask)], "stack string, y int, x int")
    offsets = [(dy, dx) for dy, half in shape for dx in range(-half, half + 1)]

    def want(erode):
        held = lambda y, x: [mask[y + i, x + j] for i, j in offsets if 0 <= y + i < 9 and 0 <= x + j < 12]
        return {(y, x) for y in range(9) for x in range(12) if (all if erode else any)(held(y, x))}

    for erode in (False, True):
        got = [(r["y"], r["x"]) for r in pixels.morph(d, ["stack"], shape, width=12, height=9, erode=erode).collect()]
        assert len(got) == len(set(got)) and set(got) == want(erode)
