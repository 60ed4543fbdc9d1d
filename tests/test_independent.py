"""Kriging, splines, components, prediction filters and dikes against independent computations."""

import math

import numpy as np
import pytest

from strataframe.operators import gridding, learning, solutions, spectral


def scattered(spark, n, of):
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 1000, (n, 2))
    rows = [(k, float(x), float(y), float(of(x, y))) for k, (x, y) in enumerate(xy)]
    return np.array(rows), spark.createDataFrame(rows, "id long, x double, y double, value double")


def nearest(points, x, y, k):
    return points[np.argsort(np.hypot(points[:, 1] - x, points[:, 2] - y))[:k]]


def test_kriging_solves_its_system(spark):
    """Each target alone, by the covariance form: C w + mu = c, sum w = 1."""
    points, d = scattered(spark, 60, lambda x, y: math.sin(x / 200) * 50 + y / 10)
    targets = [(1, 500.0, 500.0), (2, 10.0, 990.0), (3, float(points[7, 1]), float(points[7, 2]))]
    nugget, sill, reach = 2.0, 100.0, 400.0
    t = spark.createDataFrame(targets, "target long, x double, y double")
    got = {r.target: r for r in gridding.kriging(t, d, "target", "id", "value", 8, 300.0, "spherical", nugget, sill, reach).collect()}

    def cov(h):
        return nugget + sill if h == 0 else 0.0 if h >= reach else sill * (1 - 1.5 * h / reach + 0.5 * (h / reach) ** 3)

    for name, x, y in targets:
        near = nearest(points, x, y, 8)
        c = np.array([[cov(math.hypot(a[1] - b[1], a[2] - b[2])) for b in near] for a in near])
        to = np.array([cov(math.hypot(a[1] - x, a[2] - y)) for a in near])
        inverse = np.linalg.inv(c)
        mu = (1 - inverse.sum(0) @ to) / inverse.sum()
        w = inverse @ (to + mu)
        assert got[name].value == pytest.approx(w @ near[:, 3], abs=1e-6)
        assert got[name].variance == pytest.approx(max(0.0, nugget + sill - w @ to + mu), abs=1e-6)
    assert got[3].value == pytest.approx(points[7, 3], abs=1e-6)


def test_spline_keeps_points_and_planes(spark):
    points, d = scattered(spark, 50, lambda x, y: 3 + 0.2 * x - 0.1 * y)
    t = spark.createDataFrame([(1, 432.1, 567.8), (2, 20.0, 30.0)], "target long, x double, y double")
    got = {r.target: r.value for r in gridding.radial_spline(t, d, "target", "id", "value", 12, 300.0).collect()}
    assert got[1] == pytest.approx(3 + 0.2 * 432.1 - 56.78, abs=1e-6) and got[2] == pytest.approx(4.0, abs=1e-6)
    points, d = scattered(spark, 50, lambda x, y: math.sin(x / 100) * y)
    at = points[11]
    t = spark.createDataFrame([(1, float(at[1]), float(at[2]))], "target long, x double, y double")
    assert gridding.radial_spline(t, d, "target", "id", "value", 12, 300.0).first().value == pytest.approx(at[3], abs=1e-5)


def test_components_by_singular_values(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 3)) @ np.array([[2.0, 1, 0], [0, 1, 1], [0, 0, 0.3]])
    d = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(v)], "k int, a double, b double, c double")
    scores, load, shares = learning.pca(d, ["a", "b", "c"], 2)
    z = (v - v.mean(0)) / v.std(0)
    u, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert shares == pytest.approx((s**2 / (s**2).sum())[:2], rel=1e-6)
    got = np.array([(r.pc1, r.pc2) for r in scores.orderBy("k").collect()])
    for n in range(2):
        sign = np.sign(vt[n][np.abs(vt[n]).argmax()])
        assert np.allclose([load[r][n] for r in range(3)], sign * vt[n], atol=1e-6)
        want = sign * u[:, n] * s[n]
        assert abs(np.corrcoef(got[:, n], want)[0, 1]) == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("lag", [1, 4])
def test_prediction_error_by_least_squares(spark, lag):
    """The filter is the one that predicts the trace with the least squared error over its whole, padded length."""
    rng = np.random.default_rng(lag)
    v, size, n, white = np.convolve(rng.normal(size=80), [1, 0.7, 0.4, 0.2])[:80], 6, 80, 0.01
    rows = [(1, k, float(x)) for k, x in enumerate(v)] + [(2, k, 0.0) for k in range(n)]
    got = spectral.deconvolution(spark.createDataFrame(rows, "trace int, k int, amp double"), ["trace"], "k", "amp", size, lag, white).orderBy("trace", "sample").collect()
    past = np.zeros((n + size + lag, size))
    for k in range(size):
        past[lag + k : lag + k + n, k] = v
    want = np.concatenate([v, np.zeros(size + lag)])
    f = np.linalg.solve(past.T @ past + white * (v @ v) * np.eye(size), past.T @ want)
    assert np.allclose([r.decon for r in got if r.trace == 1], (want - past @ f)[:n], atol=1e-9)
    assert all(r.decon == 0 for r in got if r.trace == 2)


def test_dike_is_found(spark):
    """A thin dike's field is (a (x - x0) + b z) / ((x - x0)^2 + z^2): every window gives its place and depth."""
    x0, z, rows = 310.0, 40.0, []
    for k in range(61):
        x = 10.0 * k
        rows.append((1, x, (30 * (x - x0) + 500 * z) / ((x - x0) ** 2 + z * z)))
    got = solutions.werner(spark.createDataFrame(rows, "line int, x double, v double"), ["line"], "x", "v").collect()
    assert len(got) >= 5
    assert all(r.x0 == pytest.approx(x0, abs=0.01) and r.depth == pytest.approx(z, abs=0.01) for r in got)


def test_station_means_are_those_of_the_written_decimals(spark):
    rng = np.random.default_rng(11)
    groups = {(float(g), 0.0): [int(c) / 100 for c in rng.integers(10**5, 5 * 10**7, 8)] for g in range(300)}
    groups |= {(0.0, 1.0): [0.1] * 10, (1.0, 1.0): [1 / 3, 2 / 3], (2.0, 1.0): [1e300, 3e300], (3.0, 1.0): [float("inf"), 1.0]}
    rows = [(x, y, v) for (x, y), vs in groups.items() for v in vs] + [(9.0, 9.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, v double").coalesce(1)
    got = {(r.x, r.y): r.value for r in gridding.clean_stations(df, "x", "y", "v").collect()}
    assert got.keys() == groups.keys()
    for (x, y), vs in groups.items():
        if y == 0.0 or x == 0.0:
            assert got[x, y] == sum(round(v * 100) for v in vs) / 100 / len(vs)
    assert got[1.0, 1.0] == pytest.approx(0.5) and got[2.0, 1.0] == pytest.approx(2e300) and got[3.0, 1.0] == float("inf")
