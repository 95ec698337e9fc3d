"""k-means in groups: no window over a group's rows, first centroids by counting passes where a group is large."""

import numpy as np
import pytest
from pyspark.sql import Window

from petrilens.functions import quantiles
from petrilens.operators import cluster


def test_large_groups_stay_where_they_lie(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [("a", float(x), float(y)) for m in (0, 8) for x, y in r.normal(m, 1, (150, 2))] + [(None, float(i % 3), 1.0) for i in range(30)] + [("few", 1.0, 2.0)] * 4 + [("a", None, 1.0)]
    d = spark.createDataFrame(rows, "g string, a double, b double")
    run = lambda: sorted(cluster.group_kmeans(d, keys=["g"], features=["a", "b"], ks=[1, 2, 3], rounds=4).collect(), key=str)
    plain, windows, real = run(), [], Window.partitionBy
    monkeypatch.setattr(Window, "partitionBy", staticmethod(lambda *c: windows.append(c) or real(*c)))
    monkeypatch.setattr(quantiles, "MOST", 50)
    monkeypatch.setattr(quantiles, "FINAL", 20)
    assert run() == plain
    assert windows.count(("g",)) == 1  # over the numbers of clusters
    a = np.array([x[1:] for x in rows if x[0] == "a" and x[1] is not None])
    told = {x["k"]: x for x in plain if x["g"] == "a"}
    assert told[1]["n"] == 300 and told[1]["wss"] == pytest.approx(2 * 299, abs=1e-3)
    z = (a - a.mean(0)) / a.std(0, ddof=1)
    assert told[2]["wss"] == pytest.approx(sum(((z[i : i + 150] - z[i : i + 150].mean(0)) ** 2).sum() for i in (0, 150)), rel=1e-3)
    assert [x["k"] for x in plain if x["g"] == "few"] == [None]
