"""Tides, paths, first arrivals, depth migration, cokriging and control points against independent computations."""

import datetime
import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import gridding, grids, iterate, solutions, traces


def tide_by_ephemeris(when: datetime.datetime, latitude: float, longitude: float) -> float:
    """Luni-solar tide in mGal from low-precision positions of the almanac kind (J2000 series, degrees)."""
    d = (when - datetime.datetime(2000, 1, 1, 12)).total_seconds() / 86400
    t = d / 36525
    sin, cos = (lambda x: math.sin(math.radians(x))), (lambda x: math.cos(math.radians(x)))
    lon = 218.32 + 481267.881 * t + 6.29 * sin(135.0 + 477198.87 * t) - 1.27 * sin(259.3 - 413335.36 * t) + 0.66 * sin(235.7 + 890534.22 * t) + 0.21 * sin(269.9 + 954397.74 * t) - 0.19 * sin(357.5 + 35999.05 * t) - 0.11 * sin(186.5 + 966404.03 * t)
    lat = 5.13 * sin(93.3 + 483202.02 * t) + 0.28 * sin(228.2 + 960400.89 * t) - 0.28 * sin(318.3 + 6003.15 * t) - 0.17 * sin(217.6 - 407332.21 * t)
    parallax = 0.9508 + 0.0518 * cos(135.0 + 477198.87 * t) + 0.0095 * cos(259.3 - 413335.36 * t) + 0.0078 * cos(235.7 + 890534.22 * t) + 0.0028 * cos(269.9 + 954397.74 * t)
    g = 357.528 + 0.9856003 * d
    sun_lon, sun_au = 280.460 + 0.9856474 * d + 1.915 * sin(g) + 0.020 * sin(2 * g), 1.00014 - 0.01671 * cos(g) - 0.00014 * cos(2 * g)
    sidereal = 280.46061837 + 360.98564736629 * d + longitude

    def zenith(lon, lat):
        x, y, z = cos(lat) * cos(lon), cos(lat) * sin(lon), sin(lat)
        y, z = y * cos(23.439) - z * sin(23.439), y * sin(23.439) + z * cos(23.439)
        return sin(latitude) * z + cos(latitude) * (x * cos(sidereal) + y * sin(sidereal))

    r = 6.378137e6 / math.sqrt(1 + 0.006738 * math.sin(math.radians(latitude)) ** 2)

    def pull(gm, distance, c):
        return gm * r / distance**3 * (3 * c * c - 1) + 1.5 * gm * r * r / distance**4 * (5 * c**3 - 3 * c)

    return 1.16e5 * (pull(4.9028e12, 6.378137e6 / math.sin(math.radians(parallax)), zenith(lon, lat)) + pull(1.32712e20, 1.495978707e11 * sun_au, zenith(sun_lon, 0.0)))


def test_tide_against_an_ephemeris(spark):
    times = [datetime.datetime(1995, 3, 1) + datetime.timedelta(hours=31 * k) for k in range(250)]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(times)], "k int, t timestamp")
    for place in ((30.0, 31.0), (-52.0, -70.5)):
        got = {r.k: r.v for r in d.select("k", traces.longman_tide(F.col("t"), *place).alias("v")).collect()}
        want = [tide_by_ephemeris(x, *place) for x in times]
        assert max(want) - min(want) > 0.15
        assert max(abs(got[k] - w) for k, w in enumerate(want)) < 0.006


def surface(ny, nx, seed=1):
    return np.random.default_rng(seed).uniform(1, 9, (ny, nx))


def table(spark, a, name="g"):
    return spark.createDataFrame([(name, i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "grid_id string, i int, j int, value double")


def shortest(cost, start, offsets):
    total, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        t, (i, j) = heapq.heappop(heap)
        if t > total[i, j]:
            continue
        for a, b in offsets:
            if 0 <= i + a < cost.shape[0] and 0 <= j + b < cost.shape[1]:
                n = t + (cost[i, j] + cost[i + a, j + b]) / 2 * math.hypot(a * 10, b * 10)
                if n < total.get((i + a, j + b), math.inf) - 1e-12:
                    total[i + a, j + b] = n
                    heapq.heappush(heap, (n, (i + a, j + b)))
    return total


@pytest.mark.parametrize("tile", [64, 4])
def test_least_cost_path_over_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(iterate, "TILE", tile)
    a = surface(11, 13)
    want = shortest(a, (0, 0), solutions.EIGHT)
    got = {(r.i, r.j): r.total for r in iterate.cost_distance(table(spark, a), (F.col("i") == 0) & (F.col("j") == 0), 10.0, 10.0).collect()}
    assert got == pytest.approx(want)
    path = sorted((r.total, r.i, r.j) for r in iterate.least_cost_path(table(spark, a), (0, 0), (10, 12), 10.0, 10.0).collect())
    assert path[0][1:] == (0, 0) and path[-1][1:] == (10, 12)
    assert all(max(abs(p[1] - q[1]), abs(p[2] - q[2])) == 1 for p, q in zip(path, path[1:]))
    assert sum((a[p[1:]] + a[q[1:]]) / 2 * 10 * math.hypot(p[1] - q[1], p[2] - q[2]) for p, q in zip(path, path[1:])) == pytest.approx(want[10, 12])


def test_fill_and_regions_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(iterate, "TILE", 4)
    a = np.round(surface(9, 12, 3), 2)
    want = np.where(np.pad(np.zeros((7, 10), bool), 1, constant_values=True), a, np.inf)
    for _ in range(200):
        for i in range(9):
            for j in range(12):
                low = min(want[p, q] for p in range(max(i - 1, 0), min(i + 2, 9)) for q in range(max(j - 1, 0), min(j + 2, 12)) if (p, q) != (i, j))
                want[i, j] = min(want[i, j], max(a[i, j], low + 1e-6))
    got = {(r.i, r.j): r.filled for r in iterate.fill_depressions(table(spark, a)).collect()}
    assert got == pytest.approx({(i, j): want[i, j] for i in range(9) for j in range(12)})
    label = {(i, j): i * 12 + j for i in range(9) for j in range(12) if a[i, j] > 5}
    for _ in range(100):
        label = {(i, j): min(label.get((i + p, j + q), 999) for p in (-1, 0, 1) for q in (-1, 0, 1)) for i, j in label}
    assert {(r.i, r.j): r.component for r in iterate.connected_cells(table(spark, a), F.col("value") > 5).collect()} == label


def test_first_arrivals_and_depth_image(spark):
    v = 1000 + 100 * surface(6, 8, 5)
    steps = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if math.gcd(a, b) == 1]
    want = {s: shortest(1 / v, (0, s), steps) for s in (1, 6)}
    times = None
    for s in want:
        t = iterate.travel_times(table(spark, v), (F.col("i") == 0) & (F.col("j") == s), 10.0, 10.0)
        assert {(r.i, r.j): r.total for r in t.collect()} == pytest.approx(want[s])
        t = t.select(F.lit(10.0 * s).alias("position"), "i", "j", (10.0 * F.col("j")).alias("x"), "total")
        times = t if times is None else times.unionByName(t)
    amp = np.random.default_rng(2).normal(size=(2, 40))
    heads = [(0, 10.0, 60.0), (1, 60.0, 60.0)]
    d = spark.createDataFrame([(*h, k, float(amp[h[0], k])) for h in heads for k in range(40)], "trace int, sx double, rx double, k int, amp double")
    image = {}
    for n, sx, rx in heads:
        for i in range(6):
            for j in range(8):
                p = (want[int(sx / 10)][i, j] + want[int(rx / 10)][i, j]) / 0.004
                if abs((sx + rx) / 2 - 10 * j) <= 35 and p <= 39:
                    image[i, j] = image.get((i, j), 0.0) + np.interp(p, np.arange(40), amp[n])
    got = {(r.i, r.j): r.migrated for r in solutions.kirchhoff_depth(d, times, "k", "amp", 0.004, 35.0).collect()}
    assert got == pytest.approx(image)


def test_control_points(spark):
    points = [(c, r, 5 + 2 * c - r + 0.01 * c * r, 7 + 3 * r + 0.5 * c) for c, r in ((0, 0), (9, 0), (0, 9), (9, 9), (4, 5), (6, 2), (2, 7))]
    x, y = grids.transform_fit(points, 2)
    assert x == pytest.approx([5, 2, -1, 0.01, 0, 0], abs=1e-9) and y == pytest.approx([7, 0.5, 3, 0, 0, 0], abs=1e-9)
    with pytest.raises(ValueError):
        grids.transform_fit(points[:2])
    plane = spark.createDataFrame([(i, j, float(3 * i + j)) for i in range(5) for j in range(6)], "i int, j int, value double")
    got = grids.rectify(plane, [(0, 0, 100, 50), (5, 0, 150, 50), (0, 4, 100, 90)], 5.0).collect()
    assert len(got) == 11 * 9 and all(r.value == pytest.approx(3 * (r.y - 50) / 10 + (r.x - 100) / 10) for r in got if r.value is not None)


def test_cokriging_honours_points_and_weights(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 100, (30, 2))
    f = lambda x, y: x / 10 + y / 20
    rows = [(n, float(x), float(y), float(5 + 2 * f(x, y)), float(f(x, y))) for n, (x, y) in enumerate(p)]
    points = spark.createDataFrame(rows, "id int, x double, y double, value double, second double")
    targets = spark.createDataFrame([(0, *rows[3][1:3], rows[3][4]), (1, 50.0, 50.0, f(50, 50))], "target int, x double, y double, second double")
    got = {r.target: r.value for r in gridding.cokriging(targets, points, "target", "id", "value", "second", 8, 30.0, "spherical", 0.0, 10.0, 60.0).collect()}
    assert got[0] == pytest.approx(rows[3][3], abs=1e-6) and got[1] == pytest.approx(5 + 2 * f(50, 50), abs=0.05)


def test_a_narrow_grid_takes_few_rounds(spark, monkeypatch):
    """Tiles of a grid narrower than a tile are longer, so a path crosses few of them."""
    monkeypatch.setattr(iterate, "TILE", 16)
    rounds, write = [], iterate.written
    monkeypatch.setattr(iterate, "written", lambda df: rounds.append(1) or write(df))
    a = np.ones((700, 3))
    got = {(r.i, r.j): r.total for r in iterate.cost_distance(table(spark, a), (F.col("i") == 0) & (F.col("j") == 0), 10.0, 10.0).collect()}
    assert got == pytest.approx(shortest(a, (0, 0), solutions.EIGHT))
    assert len(rounds) <= 14
