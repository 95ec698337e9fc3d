"""Operators that work line by line (distances, spectra, hulls, replicate sums) against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from petrilens.operators import fit, nearest_seed, pixels, radial


def _labels(spark, lab):
    """Rows (t, y, x, label) of the pixels of an array that are not 0."""
    return spark.createDataFrame([(0, int(y), int(x), int(lab[y, x])) for y, x in zip(*np.nonzero(lab), strict=True)], "t int, y int, x int, label int")


def _plane(spark, shape):
    return spark.range(shape[0] * shape[1]).select(F.lit(0).alias("t"), F.floor(F.col("id") / shape[1]).cast("int").alias("y"), (F.col("id") % shape[1]).cast("int").alias("x"))


@pytest.mark.parametrize("density, rows", [(0.02, 64), (0.3, 4), (0.0005, 7)])
def test_nearest_seed_equals_all_pairs(spark, monkeypatch, density, rows):
    monkeypatch.setattr(nearest_seed, "ROWS", rows)
    rng = np.random.default_rng(3)
    lab = np.where(rng.uniform(size=(31, 45)) < density, rng.integers(1, 6, (31, 45)), 0)
    lab[17, 40] = 3
    cells = _plane(spark, lab.shape).join(_labels(spark, lab), ["t", "y", "x"], "left").withColumn("name", F.format_string("n%02d", "label")).withColumn("name", F.when(F.col("label").isNotNull(), F.col("name")))
    got = {(r["y"], r["x"]): (r["distance"], r["name"]) for r in nearest_seed.nearest_seed(cells, ["t"], "name").collect()}
    seeds = [(y, x, lab[y, x]) for y, x in zip(*np.nonzero(lab), strict=True)]
    want = {(y, x): min(((y - a) ** 2 + (x - b) ** 2, f"n{s:02d}") for a, b, s in seeds) for y in range(31) for x in range(45)}
    assert got == {k: (np.sqrt(d), s) for k, (d, s) in want.items()}


def test_nearest_seed_of_planes_without_seeds_and_of_nothing(spark):
    cells = _plane(spark, (3, 4)).withColumn("s", F.lit(None).cast("long"))
    got = nearest_seed.nearest_seed(cells, ["t"], "s").collect()
    assert len(got) == 12 and all(r["s"] is None and r["distance"] is None for r in got)
    assert nearest_seed.nearest_seed(cells.where("y > 9"), ["t"], "s").count() == 0


@pytest.mark.parametrize("bounded", [False, True])
def test_inside_distance_equals_all_pairs(spark, bounded):
    rng = np.random.default_rng(5)
    lab = np.kron(rng.integers(0, 3, (5, 6)), np.ones((5, 4), int))
    lab[rng.uniform(size=lab.shape) < 0.04] = 0
    px = _plane(spark, lab.shape) if bounded else None
    got = {(r["y"], r["x"]): r["depth"] for r in pixels.inside_distance(_labels(spark, lab), ["t"], 3.0, px=px).collect()}
    wide = np.pad(lab, 1)
    outside = lambda s: [(y - 1, x - 1) for y, x in zip(*np.nonzero(wide != s), strict=True) if not bounded or (0 < y <= lab.shape[0] and 0 < x <= lab.shape[1])]
    far = {s: np.array(outside(s)) for s in (1, 2)}
    want = {(y, x): np.sqrt(((far[lab[y, x]] - (y, x)) ** 2).sum(1).min()) for y, x in zip(*np.nonzero(lab), strict=True)}
    assert got == {k: d if d <= 3 else 4.0 for k, d in want.items()}


def test_territories_give_pixels_to_the_nearest_nucleus_of_their_droplet(spark):
    rng = np.random.default_rng(8)
    nuc, drop = np.zeros((24, 30), int), np.repeat([[1] * 15 + [2] * 15], 24, 0)
    for k in range(1, 7):
        nuc[rng.integers(0, 24), rng.integers(0, 30)] = k
    ids = {s: drop[nuc == s][0] for s in np.unique(nuc[nuc > 0])}
    got = pixels.territories(_plane(spark, nuc.shape), _labels(spark, nuc).withColumnRenamed("label", "nucleus_id"), _labels(spark, drop).withColumnRenamed("label", "droplet_id"), ["t"], 9.0)
    want = {}
    for y in range(24):
        for x in range(30):
            d, s = min(((y - a) ** 2 + (x - b) ** 2, nuc[a, b]) for a, b in zip(*np.nonzero(nuc), strict=True))
            if d <= 81 and ids[s] == drop[y, x]:
                want[y, x] = (s, np.sqrt(d))
    assert {(r["y"], r["x"]): (r["nucleus_id"], r["distance"]) for r in got.collect()} == want


@pytest.mark.parametrize("shape", [(12, 16), (9, 11), (10, 7), (1, 5)])
def test_power_spectrum_equals_the_transform_of_the_plane(spark, monkeypatch, shape):
    monkeypatch.setattr(radial, "LINES", 4)
    img = np.random.default_rng(2).normal(size=shape)
    img[0, 1] = 0.0
    rows = [(1, y + 3, x, float(img[y, x])) for y in range(shape[0]) for x in range(shape[1]) if (y, x) != (0, 1)]  # one is missing
    got = radial.power_spectrum(spark.createDataFrame(rows, "t int, y int, x int, intensity double"), ["t"]).toPandas()
    p = np.abs(np.fft.fft2(img - img.mean())) ** 2 / img.size
    want = pd.DataFrame([(fy, fx, p[i, j]) for i, fy in enumerate(np.fft.fftfreq(shape[0])) for j, fx in enumerate(np.fft.fftfreq(shape[1]))], columns=["fy", "fx", "want"])
    both = got.merge(want, on=["fy", "fx"], how="outer")
    assert len(both) == img.size and np.allclose(both["power"], both["want"], atol=1e-9)


def test_solidity_of_a_bent_region(spark):
    rows = [(0, 1, y, 0) for y in range(6)] + [(0, 1, 5, x) for x in range(1, 6)]
    got = pixels.solidity(spark.createDataFrame(rows, "t int, label int, y int, x int"), ["t", "label"]).first()["solidity"]
    assert got == pytest.approx(11 / (36 - 12.5))  # the hull lacks a triangle of legs 5


def test_replicate_sums_equal_sums_over_copied_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 7 == 0 else f"g{i % 3}", i, float(i % 5), float(rng.normal(10, 2))) for i in range(900)] + [("g1", 900, None, 1.0), ("g1", 901, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, i long, t double, y double").repartition(5)
    got = {(r["g"], r["rep"], r["t"]): (r["n"], r["sy"], r["syy"]) for r in fit.replicate_sums(df, ["g"], ["i"], "t", "y", replicates=30, seed=9).collect()}
    words = df.where("t is not null and y is not null").select("g", "t", "y", F.md5(F.concat_ws("|", F.lit("9"), F.col("i").cast("string"))).alias("m")).toPandas()
    w = fit.replicate_weights(words["m"].str[:8].map(lambda s: int(s, 16)).to_numpy(), words["m"].str[8:16].map(lambda s: int(s, 16)).to_numpy(), 30).astype(float)
    want = {}
    for k, (g, t, y) in enumerate(zip(words["g"], words["t"], words["y"], strict=True)):
        for rep in range(30):
            if w[k, rep]:
                s = want.setdefault((None if pd.isna(g) else g, rep + 1, t), [0.0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + w[k, rep], s[1] + w[k, rep] * y, s[2] + w[k, rep] * y * y
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_replicate_weights_are_poisson_and_apart():
    rng = np.random.default_rng(6)
    w = fit.replicate_weights(rng.integers(0, 1 << 32, 20000), rng.integers(0, 1 << 32, 20000), 50).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w.T) - np.eye(50)).max() < 0.04


def _ragged(rng):
    """A plane whose last rows and one inner place are missing, as a dict, with rows for a table."""
    img = {(y, x): float(rng.normal()) for y in range(9) for x in range(12) if not (y > 5 and x > 4) and (y, x) != (3, 6)}
    return img, [(0, y, x, v) for (y, x), v in img.items()]


@pytest.mark.parametrize("axis", ["x", "y"])
def test_taps_on_a_plane_that_is_no_rectangle(spark, axis):
    """Taps go by place and are mirrored at the plane's ends; a missing pixel adds nothing."""
    img, rows = _ragged(np.random.default_rng(6))
    kernel, last = [0.1, 0.2, 0.4, 0.2, 0.1], {"y": 8, "x": 11}[axis]

    def at(p):
        return -1 - p if p < 0 else 2 * last + 1 - p if p > last else p

    want = {(y, x): sum(w * img.get((at(y + o), x) if axis == "y" else (y, at(x + o)), 0.0) for o, w in zip(range(-2, 3), kernel, strict=True)) for y, x in img}
    d = spark.createDataFrame(rows, "t int, y int, x int, v double")
    got = {(r["y"], r["x"]): r["o"] for r in pixels.along(d, "v", kernel, axis, ["t"], "o").collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("half", [1, 2])
def test_median_on_a_plane_that_is_no_rectangle(spark, half):
    img, rows = _ragged(np.random.default_rng(7))
    want = {(y, x): float(np.median([v for (a, b), v in img.items() if abs(a - y) <= half and abs(b - x) <= half])) for y, x in img}
    got = {(r["y"], r["x"]): r["m"] for r in pixels.median_filter(spark.createDataFrame(rows, "t int, y int, x int, v double"), "v", ["t"], "m", half).collect()}
    assert got == pytest.approx(want)


def test_halos_erode_from_pixels_of_the_image_only(spark):
    """A nucleus at the image's edge is not eroded from beyond it."""
    lab = np.zeros((6, 6), int)
    lab[0:3, 0:3] = 1
    px = _plane(spark, lab.shape).withColumn("intensity", F.lit(1.0))
    got = pixels.halos(px, _labels(spark, lab), ["t"], step=1.0, n=2, erode=1.0).first()
    assert got["nucleus_eroded_area_px"] == 4
