"""Component labels by blocks of rows, and hulls, many groups in a call, against brute force."""

import numpy as np
import pytest

from petrilens.functions import chunks
from petrilens.operators import pixels


def _by_search(on, neighbours):
    """{pixel: least pixel that it reaches} of one plane."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (neighbours == 8 or not (i and j))]
    out = {}
    for p in sorted(on):
        if p in out:
            continue
        todo, out[p] = [p], p
        while todo:
            y, x = todo.pop()
            for q in ((y + i, x + j) for i, j in steps):
                if q in on and q not in out:
                    out[q] = p
                    todo.append(q)
    return out


@pytest.mark.parametrize("neighbours", [4, 8])
@pytest.mark.parametrize("block, rows", [(64, 100_000), (2, 3), (1, 50)])
def test_labels_by_blocks_equal_search(spark, monkeypatch, neighbours, block, rows):
    monkeypatch.setattr(pixels, "BLOCK", block)
    monkeypatch.setattr(chunks, "ROWS", rows)
    rng = np.random.default_rng(block + neighbours)
    planes = {t: {(int(y) - 3, int(x)) for y, x in zip(*np.nonzero(rng.uniform(size=(23, 17)) < p), strict=True)} for t, p in ((0, 0.45), (1, 0.6), (2, 0.3))}
    d = spark.createDataFrame([(t, y, x) for t, on in planes.items() for y, x in on], "t int, y int, x int")
    got = {(r["t"], r["y"], r["x"]): (r["component"]["t"], r["component"]["y"], r["component"]["x"]) for r in pixels.label_mask(d, ["t"], neighbours).collect()}
    assert got == {(t, *p): (t, *q) for t, on in planes.items() for p, q in _by_search(on, neighbours).items()}


def test_labels_need_no_rounds(spark, monkeypatch):
    """A path across all blocks: before, every round of tying pixels was several jobs (the driver's memory grew with them)."""
    monkeypatch.setattr(pixels, "BLOCK", 4)
    d = spark.range(300).selectExpr("0 AS t", "cast(id as int) AS y", "0 AS x")
    spark.sparkContext.setJobGroup("labels", "labels")
    assert pixels.label_mask(d, ["t"]).select("component").distinct().count() == 1
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("labels")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) <= 12


def test_hulls_of_many_regions(spark, monkeypatch):
    monkeypatch.setattr(chunks, "ROWS", 4)
    shapes = {1: [(0, 0)], 2: [(0, 0), (0, 1), (1, 0)], 3: [(0, 0), (1, 1)], 4: [(0, 2), (1, 0), (1, 1), (1, 2), (1, 3), (2, 2)]}
    d = spark.createDataFrame([(k, y, x) for k, on in shapes.items() for y, x in on], "label int, y int, x int")
    got = {r["label"]: r["solidity"] for r in pixels.solidity(d, ["label"]).collect()}
    assert got == pytest.approx({1: 1.0, 2: 3 / 3.5, 3: 2 / 3, 4: 6 / 9})
