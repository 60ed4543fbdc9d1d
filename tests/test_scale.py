"""Operators whose plans were made to scale, against brute force; and the migration of sections."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataframe.operators import aggregates, joins, solutions, spectral


@pytest.mark.parametrize("k", [1, 3, 900])
def test_neighbours_of_a_cluster_and_one_outlier(spark, k):
    rng = np.random.default_rng(k)
    p = np.concatenate([rng.normal(0, 0.01, (500, 2)), [[1e5, -3e4], [0.5, 0.5], [0.5, 0.5]]])
    t = np.concatenate([rng.normal(0, 0.01, (40, 2)), [[9e4, 0.0], [-500.0, 7.0], [0.5, 0.5], [1e5, -3e4]]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "point int, x double, y double")
    targets = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(t)], "target int, x double, y double")
    got = {(r.target, r["rank"]): (r.point, r.distance) for r in joins.nearest_neighbours(targets, points, k, "target", "point", 0.02).collect()}
    assert len(got) == len(t) * min(k, len(p))
    for i, at in enumerate(t):
        away = np.hypot(*(p - at).T)
        order = np.lexsort([np.arange(len(p)), away])[:k]
        assert [got[i, n + 1][0] for n in range(len(order))] == order.tolist()
        assert np.allclose([got[i, n + 1][1] for n in range(len(order))], away[order])
    assert joins.nearest_neighbours(targets, points.limit(0), k, "target", "point", 1.0).count() == 0
    assert joins.nearest_neighbours(targets.limit(0), points, k, "target", "point", 1.0).count() == 0


def test_lower_envelope_is_the_least_parabola():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9, 60):
        place = np.sort(rng.choice(200, n, replace=False)) * 0.5
        height = np.where(rng.random((30, n)) < 0.4, np.inf, rng.integers(0, 40, (30, n)).astype(float) ** 2)
        height[0], height[1] = np.inf, 0.0
        best = solutions.lower_envelope(place, height)
        cost = (place[None, :, None] - place[None, None, :]) ** 2 + height[:, None, :]
        for r in range(30):
            if np.isinf(height[r]).all():
                assert (best[r] == -1).all()
            else:
                assert np.allclose(np.take_along_axis(cost[r], best[r][:, None], 1)[:, 0], cost[r].min(1))


def test_distance_over_grids_of_other_shapes(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g, (ny, nx) in {"a": (13, 17), "b": (5, 30)}.items():
        cells = [(i, j) for i in range(ny) for j in range(nx)]
        marks = {c for c in cells if rng.random() < 0.03}
        rows += [(g, i, j, (i, j) in marks) for i, j in cells]
        want |= {(g, i, j): min(np.hypot((i - a) * 3.0, (j - b) * 2.0) for a, b in marks) for i, j in cells}
    rows += [("none", 0, j, False) for j in range(4)]
    df = spark.createDataFrame(rows, "grid_id string, i int, j int, f boolean")
    got = {(r.grid_id, r.i, r.j): r.distance for r in solutions.distance_to_features(df, F.col("f"), 2.0, 3.0).collect()}
    assert all(got["none", 0, j] is None for j in range(4))
    assert all(np.isclose(got[c], d) for c, d in want.items())


def _migrated(section, dx, dt, v):
    """The same by plain sums over frequencies and wavenumbers, one at a time."""
    nt, nx = section.shape
    wide = np.fft.fft2(section, s=(2 * nt, nx))
    out = np.zeros_like(wide)
    for j, cycles in enumerate(np.fft.fftfreq(nx, dx)):
        for n, f in enumerate(np.fft.fftfreq(2 * nt, dt)):
            source = np.sign(f) * np.hypot(f, v * cycles) * 2 * nt * dt
            low = int(np.floor(source))
            if f == 0 or source < -nt or source > nt - 1:
                continue
            high = min(low + 1, nt - 1)
            read = wide[low % (2 * nt), j] * (1 - source + low) + wide[high % (2 * nt), j] * (source - low)
            out[n, j] = read * abs(f) / np.hypot(f, v * cycles)
    return np.fft.ifft2(out).real[:nt]


@pytest.mark.parametrize("zero_offset", [True, False])
def test_stolt_against_sums(spark, zero_offset):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(12, 9))
    cells = spark.createDataFrame([("s", i, j, float(z[i, j])) for i in range(12) for j in range(9)], "grid_id string, i int, j int, value double")
    got = spectral.stolt(cells, 12.5, 0.004, 2400.0, zero_offset).toPandas().pivot(index="i", columns="j", values="migrated").to_numpy()
    assert np.allclose(got, _migrated(z, 12.5, 0.004, 1200.0 if zero_offset else 2400.0), atol=1e-10)


def test_a_diffraction_collapses(spark):
    nt, nx, dt, dx, v = 96, 48, 0.004, 10.0, 2000.0
    z = np.zeros((nt, nx))
    for j in range(nx):
        t = np.hypot(0.12, 2 * (j - 24) * dx / v) / dt
        if t < nt - 1:
            z[int(t), j], z[int(t) + 1, j] = 1 - t % 1, t % 1
    cells = spark.createDataFrame([("s", i, j, float(z[i, j])) for i in range(nt) for j in range(nx)], "grid_id string, i int, j int, value double")
    got = spectral.stolt(cells, dx, dt, v).toPandas().pivot(index="i", columns="j", values="migrated").to_numpy()
    assert np.unravel_index(np.abs(got).argmax(), got.shape) in [(i, 24) for i in (29, 30, 31)]


@pytest.mark.parametrize("limit", [5, 10**6])
def test_exact_percentiles_of_large_and_small_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(aggregates, "SMALL_GROUP", limit)
    monkeypatch.setattr(aggregates, "BINS", 7)
    rng = np.random.default_rng(1)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 40 + [6.0] * 3, "wide": list(rng.normal(size=300) * 10.0 ** rng.integers(-9, 9, 300)), "even": list(map(float, range(100))), "tiny": [1e-300 * k for k in range(30)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.p for r in aggregates.exact_percentiles(df, ["g"], "v", [0.05, 0.5, 0.95, 1.0]).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert np.allclose(got[g], np.percentile(vs, [5, 50, 95, 100]), rtol=1e-12), g
    whole = aggregates.exact_percentiles(df, [], "v", [0.25]).collect()
    assert np.isclose(whole[0].p[0], np.percentile([v for vs in groups.values() for v in vs], 25))


@pytest.mark.parametrize("block", [7, 1000])
def test_variogram_of_blocks_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "PAIR_BLOCK", block)
    rng = np.random.default_rng(block)
    p = np.concatenate([rng.uniform(-400, 900, (150, 2)), rng.normal(50, 3, (60, 2)), [[0.0, 0.0], [300.0, 0.0]]])
    v = rng.normal(size=len(p))
    rows = [(k, float(x), float(y), float(z)) for k, ((x, y), z) in enumerate(zip(p, v, strict=True))] + [(900, 1.0, 1.0, None), (901, None, 1.0, 1.0)]
    got = {r.bin: (r.n, r.h, r.gamma) for r in joins.variogram(spark.createDataFrame(rows, "id int, x double, y double, z double"), "id", "z", 300.0, 6, 3).collect()}
    i, j = np.triu_indices(len(p), 1)
    h, g = np.hypot(*(p[i] - p[j]).T), (v[i] - v[j]) ** 2 / 2
    for k in range(6):
        hit = (h <= 300) & (np.minimum(h // 50, 5) == k)
        assert got[k][0] == hit.sum() and np.allclose(got[k][1:], [h[hit].mean(), g[hit].mean()])


def test_nearest_points_of_targets_far_from_all_points(spark):
    """A block of far targets meets few leaves, and gets the same points as by plain search; ties go to the smaller id."""
    rng = random.Random(8)
    near = [(i, float(rng.randrange(50)), float(rng.randrange(40))) for i in range(3000)]
    asks = [(i, 2.0 * (i % 25), 25.0 * (i // 25)) for i in range(2000)]
    points, targets = spark.createDataFrame(near, "pid long, x double, y double"), spark.createDataFrame(asks, "tid long, x double, y double")
    got = collections.defaultdict(list)
    for r in joins.nearest_neighbours(targets, points, 4, "tid", "pid", 600.0).orderBy("tid", "rank").collect():
        got[r.tid].append((r.distance, r.pid))
    for i, x, y in asks:
        assert got[i] == sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), p) for p, u, v in near)[:4]
    at = np.array([(1.0, x, x + 1, y, y + 1) for x in range(50) for y in range(40)]).T
    box = pa.RecordBatch.from_pydict({"cx": [0], "cy": [0], "level": [0], "part": [0], "x1": [0.0], "x2": [50.0], "y1": [2000.0], "y2": [2050.0]})
    assert sum(b.num_rows for b in joins._met_leaves(at, 4)([box])) < at.shape[1] / 10
