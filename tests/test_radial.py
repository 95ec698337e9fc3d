"""Samples around objects against one lookup a sample; nothing but pixels and objects is shuffled before they are summed up."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrilens.operators import radial


def _scene(spark):
    r = np.random.default_rng(8)
    px = {(t, y, x): float(r.normal()) for t in (0, 1) for y in range(20) for x in range(23) if r.random() > 0.02 or t}
    px[1, 7, 9] = None
    objects = [(t, 10 * t + i, float(x), float(y)) for t in (0, 1) for i, (x, y) in enumerate([(3.5, 4.0), (11.2, 9.9), (19.0, 17.5), (0.0, 0.0)])]
    return px, objects, spark.createDataFrame([(*k, v) for k, v in px.items()], "t int, y int, x int, intensity double"), spark.createDataFrame(objects, "t int, object_id long, cx double, cy double")


def _places(o, angles, radii):
    for a in range(angles):
        for q in range(radii):
            yield a, q, o[2] + q * math.cos(2 * math.pi / angles * a), o[3] + q * math.sin(2 * math.pi / angles * a)


def test_rays_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(radial, "TILE", 5)
    px, objects, pixels, centres = _scene(spark)
    inside = {(o[1], t, y, x) for o in objects for t, y, x in px if t == o[0] and abs(y - o[3]) + abs(x - o[2]) < 6}
    mask = spark.createDataFrame([(t, y, x, o) for o, t, y, x in inside], "t int, y int, x int, object_id long")
    drops = pixels.select("t", "y", "x", (F.floor(F.col("x") / 8)).alias("droplet_id"))
    homed = centres.withColumn("droplet_id", F.floor(F.rint("cx") / 8))
    nuclei = pixels.where("(x + y) % 3 = 0")
    want, masked, edge = {}, {}, {}
    for o in objects:
        stop, left, out = set(), set(), {}
        for a, q, gx, gy in _places(o, 12, 9):
            p = (o[0], round(gy), round(gx))
            if px.get(p) is None:
                stop.add(a)
            if (o[1], *p) not in inside or a in stop:
                left.add(a)
            if a not in stop:
                want[o[1], a, q] = px[p]
            if a not in left:
                masked[o[1], a, q] = px[p]
            if p not in px or p[2] // 8 != round(o[2]) // 8:
                out.setdefault(a, q)
            elif a not in out and sum(p[1:]) % 3:
                edge[o[1], a, q] = px[p]
    key = lambda r: (r["object_id"], r["theta_index"], r["r_index"])
    told = lambda d: {key(r): r["intensity"] for r in d.collect()}
    size = {"angles": 12, "radii": 9}
    assert told(radial.sample_nearest(centres, pixels, ["t"], ["t", "object_id"], **size)) == want
    assert told(radial.sample_nearest(centres, pixels, ["t"], ["t", "object_id"], mask=mask, **size)) == masked
    got = radial.rays_to_edge(homed, pixels, drops, nuclei, ["t"], **size)
    assert told(got) == edge
    assert all(r["distance_norm"] == (r["distance_px"] / r["ray_length_px"] if r["ray_length_px"] else None) for r in got.collect())
    twice = pixels.union(pixels.where("x = 4"))
    assert radial.sample_nearest(centres, twice, ["t"], ["t", "object_id"], **size).count() > len(want)


def test_rings_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(radial, "TILE", 5)
    px, objects, pixels, centres = _scene(spark)
    prof = radial.sample_bilinear(centres, pixels, ["t"], 23, 20, angles=12, radii=5)
    got, want = {(r["object_id"], r["theta_index"], r["r_index"]): r["intensity"] for r in prof.collect()}, {}
    for o in objects:
        for a, q, gx, gy in _places(o, 12, 5):
            gx, gy = min(max(gx, 0.0), 22.0), min(max(gy, 0.0), 19.0)
            x, y = min(math.floor(gx), 21), min(math.floor(gy), 18)
            near = [((gx - x if i else 1 - gx + x) * (gy - y if j else 1 - gy + y), px.get((o[0], y + j, x + i), "none")) for i in (0, 1) for j in (0, 1)]
            if any(v != "none" for _, v in near):
                want[o[1], a, q] = sum(w * v for w, v in near if v not in ("none", None))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    modes = radial.angular_modes(prof, ["object_id"], 12, 3, energy=2)
    mean = radial.reconstruct(prof, modes, ["object_id"], 12, 2).groupBy("object_id").agg(F.avg(F.col("mode_component") ** 2).alias("e"))
    assert {r[0]: r[1] for r in mean.collect()} == pytest.approx({r["object_id"]: r["e"] for r in radial.dominant_mode(modes, ["object_id"], "e").collect()})


def test_peak_of_an_even_image_is_the_nearest_ring(spark):
    pixels = spark.createDataFrame([(0, y, x, 0.1) for y in range(40) for x in range(40)], "t int, y int, x int, intensity double")
    centres = spark.createDataFrame([(0, 1, 20.3, 19.6)], "t int, object_id long, cx double, cy double")
    prof = radial.sample_nearest(centres, pixels, ["t"], ["t", "object_id"], angles=36, radii=30)
    [row] = radial.radial_summary(prof, ["t", "object_id"]).collect()
    assert row["radial_peak_distance_px"] == 0.0 and row["n_samples"] == prof.count()
    plan = radial.radial_summary(prof, ["t", "object_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
