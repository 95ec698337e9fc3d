"""The smooth increasing trend against the rows it is fitted to."""

import numpy as np
import pytest

from petrilens.operators import fit


def _basis(t, end, k):
    """Rising functions by the recursion of B-splines, suffix sums over them."""
    h = end / k if end > 0 else 1.0
    knots = h * np.arange(-3, k + 4)
    b = ((t[:, None] >= knots[:-1]) & (t[:, None] < knots[1:])).astype(float)
    for d in range(1, 4):
        left = (t[:, None] - knots[: -d - 1]) / (d * h) * b[:, :-1]
        right = (knots[d + 1 :] - t[:, None]) / (d * h) * b[:, 1:]
        b = left + right
    return b[:, ::-1].cumsum(1)[:, ::-1]


def test_monotone_spline_is_the_constrained_least(spark):
    rng = np.random.default_rng(8)
    t = np.repeat(np.arange(0.0, 30.0), 6)
    groups = {"grows": 40 * (1 - np.exp(-t / 8)) + rng.normal(0, 1, len(t)), "falls": 50 - t + rng.normal(0, 1, len(t)), None: np.where(t < 15, 3.0, 9.0) + rng.normal(0, 0.2, len(t))}
    rows = [(g, float(a), float(y)) for g, ys in groups.items() for a, y in zip(t + 2, ys, strict=True)] + [("grows", None, 1.0), ("grows", 3.0, None), ("one", 5.0, 4.0), ("one", 5.0, 6.0)]
    made = fit.monotone_spline(spark.createDataFrame(rows, "g string, time double, y double"), ["g"], "time", "y", onset=2.0).collect()
    for g, ys in groups.items():
        mine = sorted((r["t"], r["trend"], r["penalty"]) for r in made if r["g"] == g)
        assert [a for a, _, _ in mine] == list(range(30))
        trend = np.array([b for _, b, _ in mine])
        assert (np.diff(trend) >= -1e-7).all()
        b = _basis(np.minimum(t, 29 - 1e-9), 29.0, 8)
        gram, right = b.T @ b, b.T @ ys
        c, _ = fit.rising_solution(gram, right, mine[0][2])
        assert trend == pytest.approx((_basis(np.minimum(np.arange(30.0), 29 - 1e-9), 29.0, 8) @ c).tolist(), abs=1e-5)
        # The conditions of the least: no free slope, none downhill at a bound.
        d = np.diff(np.eye(len(c))[1:], axis=0)
        scale = np.trace(gram) / len(c)
        slope = (gram + mine[0][2] * scale * d.T @ d + 1e-10 * scale * np.eye(len(c))) @ c - right
        assert (c[1:] >= 0).all() and abs(slope[0]) < 1e-5 * abs(right).max()
        assert (np.abs(slope[1:][c[1:] > 0]) < 1e-5 * abs(right).max()).all() and (slope[1:] > -1e-5 * abs(right).max()).all()
    grown = np.array([r["trend"] for r in sorted((r for r in made if r["g"] == "grows"), key=lambda r: r["t"])])
    assert np.abs(grown - 40 * (1 - np.exp(-np.arange(30) / 8))).max() < 1.5
    fallen = [r["trend"] for r in made if r["g"] == "falls"]
    assert max(fallen) - min(fallen) < 1e-6 and fallen[0] == pytest.approx(groups["falls"].mean(), abs=1e-4)
    assert [round(r["trend"], 4) for r in made if r["g"] == "one"] == [5.0]


def test_monotone_spline_of_nothing(spark):
    assert fit.monotone_spline(spark.createDataFrame([], "g string, time double, y double"), ["g"], "time", "y").count() == 0
