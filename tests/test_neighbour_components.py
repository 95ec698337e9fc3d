"""Clusters of cells, components tied in place and the sparse assignment, against plain ways."""

import numpy as np

from petrilens.operators import graph, track
from petrilens.operators.graph import connected_components, connected_neighbours


def test_eps_clusters_shuffle_no_pairs(spark):
    """60 rows at one place and one within eps of them: 1 edge of cells, no pair of rows is grouped; no place, own cluster."""
    r = np.random.default_rng(5)
    rows = [(i, int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(np.round(r.uniform(-40, 40, (300, 2))))]
    rows += [(1000 + i, 0, 500.0, 500.0) for i in range(60)] + [(2000, 0, 503.0, 504.0), (2001, 0, None, 1.0), (2002, None, 500.0, 500.0), (2003, 0, float("nan"), 500.0)]
    d = spark.createDataFrame(rows, "k long, g int, x double, y double")
    got = {r["k"]: r["cluster"] for r in track.eps_clusters(d, key="k", eps=5.0, on=("g",)).collect()}
    up = {k: k for k, *_ in rows}

    def top(k):
        return k if up[k] == k else top(up[k])

    for a, ga, xa, ya in rows:
        for b, gb, xb, yb in rows:
            if None not in (ga, gb, xa, xb) and ga == gb and (xa - xb) ** 2 + (ya - yb) ** 2 <= 25:
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    assert got == {k: top(k) for k in up}
    assert got[2000] == 1000 and [got[k] for k in (2001, 2002, 2003)] == [2001, 2002, 2003]


def test_neighbours_tied_across_calls(spark, monkeypatch):
    monkeypatch.setattr(graph, "_NEAR", 5)
    r = np.random.default_rng(6)
    rows = [(float(i), int(i), int(i + r.integers(1, 3))) for i in range(0, 400, 2)] + [(float(i), i, i) for i in (900, 901)]
    e = spark.createDataFrame(rows, "p double, a long, b long")
    assert sorted(map(tuple, connected_neighbours(e, ["p"]).collect())) == sorted(map(tuple, connected_components(e.select("a", "b")).select("node", "component").collect()))


def test_components_of_many_pairs_without_a_matrix():
    """2,000 rows in a chain and rows that stay out: the least cost, by a few steps a row; near-equal costs don't turn in circles."""
    rows, cols = [i for i in range(2000) for _ in (0, 1)], [i + j for i in range(2000) for j in (0, 1)]
    got = track.assign_pairs(rows, cols, [float(j) for _ in range(2000) for j in (2, 1)])
    assert got == {(i, i + 1) for i in range(2000)}
    r = np.random.default_rng(7)
    for _ in range(50):
        xy = r.integers(0, 6, (2, 40, 2))
        cost = np.hypot(*(xy[0][:, None] - xy[1][None, :25]).transpose(2, 0, 1))
        i, j = np.nonzero(cost <= 3)
        links = track.assign_pairs(i.tolist(), j.tolist(), cost[i, j].tolist())
        assert len({a for a, _ in links}) == len({b for _, b in links}) == len(links)
