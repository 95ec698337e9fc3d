"""Robust z of several columns in the same passes."""

import numpy as np
import pytest

from petrilens.functions import quantiles
from petrilens.operators import summaries


def test_robust_z_of_several_columns_in_one_set_of_passes(spark, monkeypatch):
    """Before, every column had passes of its own, and each pass read the columns before anew."""
    monkeypatch.setattr(quantiles, "MOST", 10)
    monkeypatch.setattr(quantiles, "FINAL", 5)
    calls, real = [], summaries.group_quantiles
    monkeypatch.setattr(summaries, "group_quantiles", lambda *a, **k: calls.append(1) or real(*a, **k))
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=60), rng.integers(0, 9, 60).astype(float)
    rows = [("g", i, None if i % 7 == 0 else float(a[i]), float(b[i])) for i in range(60)] + [(None, 99, 1.0, 2.0)]
    d = spark.createDataFrame(rows, "t string, k int, a double, b double")
    got = {r["k"]: r["focus"] for r in summaries.weighted_focus(d, {"a": 0.7, "b": 0.3}, ["t"], "b").collect()}
    assert len(calls) == 2

    def z(v):
        m = np.nanmedian(v)
        return (v - m) / (np.nanmedian(abs(v - m)) + 1e-9)

    za, zb = z(np.array([np.nan if i % 7 == 0 else a[i] for i in range(60)])), z(b)
    want = {i: zb[i] if i % 7 == 0 else 0.7 * za[i] + 0.3 * zb[i] for i in range(60)} | {99: 0.0}
    assert got == pytest.approx(want)
