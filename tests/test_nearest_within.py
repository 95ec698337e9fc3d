"""Matches within a radius without all pairs."""

import numpy as np

from petrilens.operators import spatial


def test_nearest_within_makes_one_row_a_source(spark):
    """300 targets at two places within the radius of 300 sources: one row a source, as the matches over all pairs give."""
    r = np.random.default_rng(8)
    a = [(i, int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(r.integers(0, 40, (200, 2)))] + [(300 + i, 0, 100.0, 100.0) for i in range(300)] + [(700, 0, 500.0, 500.0), (701, 0, None, 1.0)]
    b = [(i, int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(r.integers(0, 40, (200, 2)))] + [(300 + i, 0, 100.0 + i % 2, 103.0) for i in range(300)] + [(701, 0, 1.0, None)]
    left, right = spark.createDataFrame(a, "s long, g int, x double, y double"), spark.createDataFrame(b, "u long, h int, p double, q double")
    for strict in (False, True):
        how = {"radius": 3.0, "on": [("g", "h")], "right_xy": ("p", "q"), "strict": strict}
        every = spatial.near_pairs(left, right, **how)
        near = spatial.nearest_within(left, right, source="s", target="u", **how).cache()
        assert near.count() == near.select("s").distinct().count() <= every.count()
        for match in (spatial.match_one_to_one, spatial.match_many_to_one):
            rows = lambda d: sorted(map(tuple, match(d, "s", "u").select("s", "u", "distance").collect()))  # noqa: B023, E731
            assert rows(near) == rows(every)
