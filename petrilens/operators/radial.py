"""Radial sampling around objects and angular Fourier measures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrilens.functions.chunks import by_groups, starts

KEYS = ("object_id",)


#: Side of the tiles of a plane, and samples that are taken at once.
TILE, AT_ONCE = 128, 500_000
_OBJECT, _PIXEL, _MASK, _SKIP = range(4)


class _Places:
    """Pixels of one kind in a table of tiles, found by their tile and place in it; a pixel may be there several times."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(codes, kind="stable")
        self.codes, self.first, self.count = np.unique(codes[self.order], return_index=True, return_counts=True)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the distinct pixels each code is, and whether it is one."""
        if not len(self.codes):
            return np.zeros(code.shape, np.int64), np.zeros(code.shape, bool)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return at, self.codes[at] == code

    def all(self, found: np.ndarray) -> np.ndarray:
        """Of each distinct pixel, whether all its rows are so."""
        return np.logical_and.reduceat(found[self.order], self.first) if len(self.codes) else np.zeros(0, bool)

    def total(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v[self.order], self.first) if len(self.codes) else np.zeros(0)

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the pixels ``at``, and which place of ``at`` each belongs to."""
        n = self.count[at]
        which = np.repeat(np.arange(len(at)), n)
        return self.order[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(len(which))], which


def _sampled(objects: DataFrame, plane: Sequence[str], sides: dict[int, DataFrame], by: Sequence[str], rays: tuple[int, int, float, float], size: tuple[int, int] | None, take, told: str) -> DataFrame:
    """``objects`` (columns cx, cy and others) with the samples that ``take`` makes of tiles of a plane: objects are dealt
    to the tile of their centre, pixels to the tiles whose objects reach them.  So samples, many for each object, are
    made where they are summed up, and only pixels and objects are shuffled.  With ``size`` (width, height) places are clamped to the image."""
    angles, radii, step, first = rays
    reach, held, kinds = math.ceil(abs(first) + abs(step) * (radii - 1)) + 2, list(objects.columns), list(sides)
    edge, side, place = TILE, TILE + 2 * reach + 1, [*plane, "_ty", "_tx"]
    inside = lambda c, n: F.col(c) if size is None else F.least(F.greatest(c, F.lit(0.0)), F.lit(n - 1.0))
    tile = lambda v: F.floor(v / TILE).cast("long")
    width, height = size or (0, 0)
    rows = objects.where(F.abs("cx").between(0.0, 1e15) & F.abs("cy").between(0.0, 1e15)).withColumns({"_kind": F.lit(_OBJECT), "_ty": tile(inside("cy", height)), "_tx": tile(inside("cx", width))})
    for kind, df in sides.items():
        for c, name in (("y", "_ty"), ("x", "_tx")):
            df = df.withColumn(name, F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))))
        rows = rows.unionByName(df.withColumn("_kind", F.lit(kind)), allowMissingColumns=True)
    rows = rows.dropna(subset=list(plane))
    # the C library's functions, as in SQL
    turn = [2 * math.pi / angles * a for a in range(angles)]
    cos, sin, distance = np.array([math.cos(a) for a in turn]), np.array([math.sin(a) for a in turn]), first + np.arange(radii) * step

    def work(table: pa.Table) -> Iterator[pa.Table]:
        kind, group = table["_kind"].to_numpy(), np.cumsum(starts(table, place))
        ty, tx = table["_ty"].to_numpy() * edge - reach, table["_tx"].to_numpy() * edge - reach
        same = np.zeros(table.num_rows, np.int64)
        for c in by:  # equal numbers: equal values of ``by``
            codes = pc.fill_null(table[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            same = np.unique(same * (int(codes.max(initial=0)) + 2) + codes, return_inverse=True)[1]
        who, most = np.flatnonzero(kind == _OBJECT), int(same.max(initial=0)) + 1
        if not len(who):
            return
        code = lambda g, y, x: (g * side + y) * side + x
        found = {}
        for k in kinds:
            at = np.flatnonzero(kind == k)
            y, x = (pc.cast(table[c].take(pa.array(at)), pa.int64()).to_numpy() for c in ("y", "x"))
            codes = code(group[at], y - ty[at], x - tx[at])
            part = table.take(pa.array(at))
            found[k] = (_Places(codes * most + same[at] if k == _MASK else codes), part)
        cx, cy = table["cx"].to_numpy(zero_copy_only=False), table["cy"].to_numpy(zero_copy_only=False)
        n = max(1, AT_ONCE // (angles * radii))
        for i in range(0, len(who), n):
            o = who[i : i + n]
            spread = lambda v: v[o][:, None, None]  # noqa: E731, B023
            gx = spread(cx) + distance * cos[:, None]
            gy = spread(cy) + distance * sin[:, None]
            at = lambda y, x: code(spread(group), y.astype(np.int64) - spread(ty), x.astype(np.int64) - spread(tx))  # noqa: E731, B023
            ray, made = take(gx, gy, at, found, spread(same), most)
            index, turned, ring = np.unravel_index(ray, gx.shape)
            own = table.select(held).take(pa.array(o[index]))
            for name, v in (("theta_index", turned.astype(np.int32)), ("r_index", ring.astype(np.int32)), ("distance_px", distance[ring])):
                own = own.append_column(name, pa.array(v))
            for name, v in made.items():
                own = own.append_column(name, v)
            yield own

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema] + ["theta_index int", "r_index int", "distance_px double", told])
    return by_groups(rows, place, ["_kind", "y", "x"], work, schema)


def _values(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Intensities (0 for null) and whether they are there."""
    v = pc.cast(part["intensity"].combine_chunks(), pa.float64())
    return pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False)


def _unbroken(fine: np.ndarray) -> np.ndarray:
    """Flat places of the samples before the first of their ray that is not fine."""
    return np.flatnonzero(np.logical_and.accumulate(fine, axis=2))


def sample_nearest(objects: DataFrame, px: DataFrame, plane: Sequence[str], keys: Sequence[str], *, angles: int, radii: int, step: float = 1.0, first: float = 0.0, mask: DataFrame | None = None) -> DataFrame:
    """``objects(…, cx, cy)`` times angles and radii with the intensity of the nearest pixel (half to even): theta_index,
    r_index, distance_px, intensity.  A ray stops where it leaves the image (or the mask of its own object, if given as
    plane, y, x, keys) and at a null."""
    own, masked = [k for k in keys if k not in plane], mask is not None
    sides = {_PIXEL: px.select(*plane, "y", "x", "intensity")} | ({_MASK: mask.select(*plane, "y", "x", *own)} if masked else {})

    def take(gx, gy, at, found, same, most):
        code, (places, part) = at(np.rint(gy), np.rint(gx)), found[_PIXEL]
        v, known = _values(part)
        where, fine = places.find(code)
        if len(places.codes):
            fine &= places.all(known)[where]
        if masked:
            fine &= found[_MASK][0].find(code * most + same)[1]
        ray = _unbroken(fine)
        row, which = places.rows(where.ravel()[ray])
        return ray[which], {"intensity": pa.array(v[row])}

    return _sampled(objects, plane, sides, own if masked else (), (angles, radii, step, first), None, take, "intensity double")


def sample_bilinear(objects: DataFrame, px: DataFrame, plane: Sequence[str], width: int, height: int, *, angles: int, radii: int, step: float = 1.0, first: float = 0.0) -> DataFrame:
    """As ``sample_nearest``, with the intensity between the four pixels around, coordinates clamped to the image: a sample
    for every place with one of the four."""

    def take(gx, gy, at, found, same, most):
        places, part = found[_PIXEL]
        v, known = _values(part)
        v, known = places.total(v), places.total(known.astype(float)) > 0
        x, y = np.clip(gx, 0.0, width - 1.0), np.clip(gy, 0.0, height - 1.0)
        x0, y0 = np.minimum(np.floor(x), width - 2), np.minimum(np.floor(y), height - 2)
        total, there, valued = np.zeros(gx.shape), np.zeros(gx.shape, bool), np.zeros(gx.shape, bool)
        for i in (0, 1):
            for j in (0, 1):
                where, hit = places.find(at(y0 + j, x0 + i))
                w = (x - x0 if i else 1 - (x - x0)) * (y - y0 if j else 1 - (y - y0))
                if len(places.codes):
                    total += np.where(hit, w * v[where], 0.0)
                    valued |= hit & known[where]
                there |= hit
        ray = np.flatnonzero(there)
        return ray, {"intensity": pa.array(total.ravel()[ray], mask=~valued.ravel()[ray])}

    return _sampled(objects, plane, {_PIXEL: px.select(*plane, "y", "x", "intensity")}, (), (angles, radii, step, first), (width, height), take, "intensity double")


def rays_to_edge(objects: DataFrame, px: DataFrame, droplets: DataFrame, nuclei: DataFrame, plane: Sequence[str], *, angles: int, radii: int, step: float = 1.0, first: float = 0.0) -> DataFrame:
    """Samples from each nucleus's centre to the first exit from its droplet, nucleus pixels left out, with
    distance_norm (share of the ray) and ray_length_px.  ``objects`` and ``droplets`` carry droplet_id."""
    sides = {_PIXEL: px.select(*plane, "y", "x", "intensity"), _MASK: droplets.select(*plane, "y", "x", "droplet_id"), _SKIP: nuclei.select(*plane, "y", "x")}
    distance = first + np.arange(radii) * step

    def take(gx, gy, at, found, same, most):
        code, (places, part) = at(np.rint(gy), np.rint(gx)), found[_PIXEL]
        v, known = _values(part)
        kept = np.logical_and.accumulate(found[_MASK][0].find(code * most + same)[1], axis=2)
        length = np.where(kept, distance, -np.inf).max(axis=2, keepdims=True)
        where, hit = places.find(code)
        ray = np.flatnonzero(kept & hit & ~found[_SKIP][0].find(code)[1])
        row, which = places.rows(where.ravel()[ray])
        ray = ray[which]
        length, far = np.broadcast_to(length, code.shape).ravel()[ray], distance[ray % radii]
        norm = np.divide(far, length, out=np.zeros(len(far)), where=length != 0)
        return ray, {"intensity": pa.array(v[row], mask=~known[row]), "ray_length_px": pa.array(length), "distance_norm": pa.array(norm, mask=length == 0)}

    return _sampled(objects, plane, sides, ("droplet_id",), (angles, radii, step, first), None, take, "intensity double, ray_length_px double, distance_norm double")


def radial_summary(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per object: mean, max, mean of the distinct ray lengths, and distance of the peak of the mean profile (means that
    agree to 9 decimals: the nearest).  Rings, rays and objects are summed up in one pass over the samples."""
    sets = [[*keys, "r_index"], [*keys, "theta_index"], list(keys)]
    parts = [F.avg("intensity").alias("m"), F.max("intensity").alias("top"), F.count(F.lit(1)).alias("n"), F.max("distance_px").alias("d")]
    g = profile.groupingSets(sets, *keys, "r_index", "theta_index").agg(*parts)
    ring, ray = F.col("r_index").isNotNull(), F.col("theta_index").isNotNull()
    whole = lambda c: F.max(F.when(~ring & ~ray, F.col(c)))
    lengths = F.collect_set(F.when(ray, F.col("d")))
    return g.groupBy(*keys).agg(
        whole("m").alias("radial_mean_intensity"), whole("top").alias("radial_max_intensity"), whole("n").alias("n_samples"),
        (F.aggregate(lengths, F.lit(0.0), lambda a, b: a + b) / F.size(lengths)).alias("radial_mean_ray_length_px"),
        F.max_by("d", F.when(ring, F.struct(F.round("m", 9), -F.col("r_index")))).alias("radial_peak_distance_px"),
    )


def angle_peaks(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ray: its peak and the peak's distance (ties: nearest)."""
    return profile.groupBy(*keys, "theta_index").agg(F.max("intensity").alias("peak"), F.max_by("distance_px", F.struct("intensity", -F.col("r_index"))).alias("peak_distance_px"))


def compaction(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coefficient of variation of the rays' peaks."""
    p = angle_peaks(profile, keys)
    return p.groupBy(*keys).agg(F.try_divide(F.stddev_pop("peak"), F.avg("peak")).alias("compaction"))


def radial_metrics(profile: DataFrame, keys: Sequence[str], *, search: int = 20, inner: int = 5, outer: int = 60) -> DataFrame:
    """Envelope (radius of the largest mean within ``search``), its peak, the baseline (mean of means within ``inner``),
    sharpness, heterogeneity outside (cv of samples from the envelope to ``outer``) and angular asymmetry there."""
    per_r = profile.groupBy(*keys, "r_index").agg(F.avg("intensity").alias("m"))
    e = per_r.where(F.col("r_index") < search).groupBy(*keys).agg(F.max(F.struct("m", (-F.col("r_index")).alias("n"))).alias("_e"), F.avg(F.when(F.col("r_index") < inner, F.col("m"))).alias("baseline"))
    e = e.select(*keys, (-F.col("_e.n")).alias("envelope_radius"), F.col("_e.m").alias("envelope_peak"), "baseline").withColumn("sharpness", F.try_divide(F.col("envelope_peak") - F.col("baseline"), F.abs("baseline")))
    out = profile.join(e.select(*keys, "envelope_radius"), list(keys)).where((F.col("r_index") > F.col("envelope_radius")) & (F.col("r_index") < outer))
    h = out.groupBy(*keys).agg(F.try_divide(F.stddev_pop("intensity"), F.abs(F.avg("intensity"))).alias("heterogeneity"))
    a = out.groupBy(*keys, "theta_index").agg(F.avg("intensity").alias("m")).groupBy(*keys).agg(F.try_divide(F.stddev_pop("m"), F.abs(F.avg("m"))).alias("asymmetry"))
    return e.join(h, list(keys), "left").join(a, list(keys), "left")


def angular_modes(profile: DataFrame, keys: Sequence[str], angles: int, modes: int, energy: int | None = None) -> DataFrame:
    """Per ring and mode 0..modes: real and imaginary part of the angular Fourier sum, power / n, phase.  One aggregate
    holds all modes, so the samples aren't multiplied.  With ``energy`` also that mode's part of the samples (as
    ``reconstruct`` gives it), squared and summed over the ring, and their number, from the same pass."""
    arg = lambda m: F.lit(-2 * math.pi * m / angles) * F.col("theta_index")
    sums = [x for m in range(modes + 1) for x in (F.sum(F.col("intensity") * F.cos(arg(m))).alias(f"re{m}"), F.sum(F.col("intensity") * F.sin(arg(m))).alias(f"im{m}"))]
    more = []
    if energy is not None:
        c, s = F.cos(-arg(energy)), F.sin(-arg(energy))
        sums += [F.sum(c * c).alias("_cc"), F.sum(c * s).alias("_cs"), F.sum(s * s).alias("_ss"), F.count(F.lit(1)).alias("_n")]
        re, im = F.col(f"re{energy}"), F.col(f"im{energy}")
        more = [(4.0 / angles**2 * (re * re * F.col("_cc") - 2 * re * im * F.col("_cs") + im * im * F.col("_ss"))).alias("energy"), F.when(re.isNotNull(), F.col("_n")).alias("n")]
    g = profile.groupBy(*keys, "r_index").agg(*sums)
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"re{m}").alias("re"), F.col(f"im{m}").alias("im")) for m in range(modes + 1)])
    d = g.select(*keys, "r_index", *more, F.explode(rows).alias("m")).select(*keys, "r_index", "m.*", *(["energy", "n"] if more else []))
    return d.withColumn("power", (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / angles).withColumn("phase", F.atan2("im", "re"))


def dominant_mode(modes: DataFrame, keys: Sequence[str], energy: str | None = None) -> DataFrame:
    """Per object: the mode with the most power over all rings (from mode 1), its share, and the anisotropy index (share
    of all modes from 1 in the whole power); as ``energy``, the mean of the energy of ``angular_modes`` over its samples."""
    p = modes.groupBy(*keys, "mode").agg(F.sum("power").alias("p"), *([F.try_divide(F.sum("energy"), F.sum("n")).alias("e")] if energy else []))
    return p.groupBy(*keys).agg(
        F.max_by("mode", F.when(F.col("mode") > 0, F.struct("p", -F.col("mode")))).alias("dominant_mode"),
        F.try_divide(F.max(F.when(F.col("mode") > 0, F.col("p"))), F.sum(F.when(F.col("mode") > 0, F.col("p")))).alias("dominant_share"),
        F.try_divide(F.sum(F.when(F.col("mode") > 0, F.col("p"))), F.sum("p")).alias("anisotropy_index"), *([F.max("e").alias(energy)] if energy else []),
    )


def reconstruct(profile: DataFrame, modes: DataFrame, keys: Sequence[str], angles: int, mode: int) -> DataFrame:
    """``profile`` with mode_component: the mode's part of each sample, 2 / n (re cos + im' sin)."""
    m = modes.where(F.col("mode") == mode).select(*keys, "r_index", "re", "im")
    arg = F.lit(2 * math.pi * mode / angles) * F.col("theta_index")
    d = profile.join(m, [*keys, "r_index"])
    return d.withColumn("mode_component", 2.0 / angles * (F.col("re") * F.cos(arg) - F.col("im") * F.sin(arg))).drop("re", "im")


def mode_profile(modes: DataFrame, mode: int, angles: int) -> DataFrame:
    """One mode by ring: its amplitude (2 / n times the modulus) and phase."""
    m = modes.where(F.col("mode") == mode)
    return m.withColumn("amplitude", 2.0 / angles * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).withColumn("phase", F.atan2("im", "re"))


LINES = 64  # lines of a plane that one task transforms


def power_spectrum(px: DataFrame, plane: Sequence[str]) -> DataFrame:
    """Centred 2-D power spectrum of each mean-removed plane (the rectangle around its pixels; missing ones count 0):
    plane, fy, fx (cycles per pixel), power.  Blocks of rows are transformed along x, the coefficients are dealt by
    frequency, and blocks of columns are transformed along y, so a task holds ``LINES`` lines and never a plane.  Of a
    real line half the frequencies are enough; the others mirror them.  The mean is the coefficient at 0, which is left
    out."""
    size = px.groupBy(*plane).agg(F.min("y").alias("_y0"), (F.max("y") - F.min("y") + 1).cast("int").alias("h"), F.min("x").alias("_x0"), (F.max("x") - F.min("x") + 1).cast("int").alias("w"))
    value = F.coalesce(F.nanvl(F.col("intensity").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v")
    d = px.join(size, list(plane)).select(*plane, (F.col("y") - F.col("_y0")).cast("int").alias("y"), (F.col("x") - F.col("_x0")).cast("int").alias("x"), "h", "w", value)
    head = ", ".join(f"{k} {dict(px.dtypes)[k]}" for k in plane)

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int(pdf["w"].iloc[0])
        y, line = np.unique(pdf["y"].to_numpy(), return_inverse=True)
        img = np.zeros((len(y), w))
        img[line, pdf["x"].to_numpy()] = pdf["v"].to_numpy()
        f = np.fft.rfft(img, axis=1)
        known = {k: pdf[k].iloc[0] for k in (*plane, "h", "w")}
        return pd.DataFrame({**known, "y": np.repeat(y, f.shape[1]), "u": np.tile(np.arange(f.shape[1]), len(y)), "re": f.real.ravel(), "im": f.imag.ravel()})

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0])
        u, column = np.unique(pdf["u"].to_numpy(), return_inverse=True)
        half = np.zeros((h, len(u)), complex)
        half[pdf["y"].to_numpy(), column] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        p = np.abs(np.fft.fft(half, axis=0)) ** 2 / (h * w)
        p[0, u == 0] = 0.0
        fy, fx, twin = np.fft.fftfreq(h), np.fft.fftfreq(w), (u > 0) & (2 * u < w)
        at = np.concatenate([fx[u], fx[w - u[twin]]])
        power = np.concatenate([p, p[-np.arange(h) % h][:, twin]], axis=1)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in plane}, "fy": np.repeat(fy, len(at)), "fx": np.tile(at, h), "power": power.ravel()})

    lines = d.groupBy(*plane, F.floor(F.col("y") / LINES).alias("_block")).applyInPandas(rows, f"{head}, h int, w int, y int, u int, re double, im double")
    return lines.groupBy(*plane, F.floor(F.col("u") / LINES).alias("_block")).applyInPandas(columns, f"{head}, fy double, fx double, power double")


def spectral_features(spec: DataFrame, plane: Sequence[str], bins: int = 20, bands: Sequence[tuple[float, float]] = ((0, 0.1), (0.1, 0.25), (0.25, 0.5))) -> DataFrame:
    """Per plane: power per band, centroid frequency, log-log slope of the radial profile, and anisotropy (difference of
    power along x and y over their sum)."""
    d = spec.withColumn("f", F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")))
    part = [F.coalesce(F.sum(F.when((F.col("f") >= a) & (F.col("f") < b), F.col("power"))), F.lit(0.0)).alias(f"band_{i}") for i, (a, b) in enumerate(bands)]
    wide = F.abs("fx") > F.abs("fy")
    g = d.groupBy(*plane).agg(*part, F.try_divide(F.sum(F.col("f") * F.col("power")), F.sum("power")).alias("centroid"), F.try_divide(F.sum(F.when(wide, F.col("power")).otherwise(-F.col("power"))), F.sum("power")).alias("anisotropy"))
    prof = d.where("f > 0").withColumn("bin", F.floor(F.col("f") * 2 * bins)).groupBy(*plane, "bin").agg(F.avg("power").alias("p"), F.avg("f").alias("f")).where("p > 0")
    slope = prof.groupBy(*plane).agg(F.regr_slope(F.log("p"), F.log("f")).alias("slope"))
    return g.join(slope, list(plane))
