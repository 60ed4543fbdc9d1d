"""Closed-form answers and invariants of the engine proper."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import aggregates, grids, iterate, joins, physics, quality, solutions, spectral, traces


def cells_of(spark, z, step=100.0):
    rows = [("g", i, j, j * step, i * step, float(z[i][j])) for i in range(len(z)) for j in range(len(z[0]))]
    return spark.createDataFrame(rows, "grid_id string, i int, j int, x double, y double, value double")


def array_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("i", "j", column).collect():
        out[r.i, r.j] = np.nan if r[column] is None else r[column]
    return out


def test_normal_gravity_and_slab(spark):
    r = spark.range(1).select(physics.normal_gravity(F.lit(0.0)).alias("a"), physics.normal_gravity(F.lit(90.0)).alias("b"), physics.slab(F.lit(100.0)).alias("s")).first()
    assert r.a == pytest.approx(978032.67715, abs=1e-5)
    assert r.b == pytest.approx(983218.6368, abs=1e-2)
    assert r.s == pytest.approx(11.19, abs=0.01)


def test_small_cube_is_a_point_mass(spark):
    s = spark.createDataFrame([(1, 300.0, -200.0, 0.0)], "id int, x double, y double, z double")
    p = spark.createDataFrame([(-50.0, 50.0, -50.0, 50.0, 950.0, 1050.0, 1000.0)], "x1 double, x2 double, y1 double, y2 double, z1 double, z2 double, rho double")
    got = physics.prism_effects(s, p, "id", physics.prism_gz, "rho").first().effect
    r = math.sqrt(300**2 + 200**2 + 1000**2)
    assert abs(got) == pytest.approx(6.674e-11 * 1e9 * 1000 / r**3 * 1e5, rel=1e-3)


def test_half_space_response(spark):
    d = spark.createDataFrame([(1.0, [100.0, 100.0], [500.0])], "f double, rho array<double>, thick array<double>")
    r = physics.mt_layers(d, "f", "rho", "thick").first()
    assert r.rho_a == pytest.approx(100.0) and r.phase == pytest.approx(45.0)


def test_plus_minus_recovers_a_flat_refractor(spark):
    v1, v2, h = 500.0, 2500.0, 20.0
    cos = math.sqrt(1 - (v1 / v2) ** 2)
    delay, end = h * cos / v1, 200.0
    rows = [(1, x, x / v2 + 2 * delay, (end - x) / v2 + 2 * delay) for x in np.arange(0, end + 1, 10).tolist()]
    d = spark.createDataFrame(rows, "s int, x double, tf double, tr double")
    got = physics.plus_minus(d, ["s"], "x", "tf", "tr", v1).toPandas()
    assert np.allclose(got.v2, v2) and np.allclose(got.depth, h)


def test_gradient_of_a_plane_is_exact(spark):
    z = [[i * 2.0 + j * 3.0 for j in range(6)] for i in range(5)]
    d = grids.gradients(cells_of(spark, z), 100.0, 100.0)
    assert np.allclose(array_of(d, "gx", (5, 6)), 0.03) and np.allclose(array_of(d, "gy", (5, 6)), 0.02)


def test_filter_matches_numpy_and_splits_into_two_parts(spark):
    z = np.random.default_rng(1).normal(size=(9, 12))
    cells = cells_of(spark, z)
    up = array_of(spectral.apply_response(cells, 100.0, 100.0, spectral.upward(150.0)), "filtered", z.shape)
    p = np.pad(z, [(4, 4), (6, 6)], mode="reflect")
    k = np.hypot(*np.meshgrid(np.fft.fftfreq(p.shape[1], 100.0), np.fft.fftfreq(p.shape[0], 100.0))) * 2 * np.pi
    want = np.fft.ifft2(np.fft.fft2(p) * np.exp(-150 * k)).real[4:-4, 6:-6]
    assert np.allclose(up, want)
    pole = array_of(spectral.apply_response(cells, 100.0, 100.0, spectral.reduce_to_pole(90.0, 0.0)), "filtered", z.shape)
    assert np.allclose(pole, z)


def test_moran_of_a_smooth_field_is_positive(spark):
    z = [[float(i + j) for j in range(8)] for i in range(8)]
    assert grids.moran(cells_of(spark, z), grids.distance_band(100.0, 100.0, 150.0, False)).first().moran_i > 0.5


def test_running_mean_repeats_its_ends(spark):
    d = spark.createDataFrame([(1, float(k), float(v)) for k, v in enumerate([1, 3, 5, 7, 9])], "p int, d double, v double")
    got = [r.mean for r in traces.running_mean(d, ["p"], "d", "v", 3).orderBy("d").collect()]
    assert np.allclose(got, [5 / 3, 3, 5, 7, 25 / 3])


def test_interpolation_is_flat_outside(spark):
    k = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, 30.0)], "g int, x double, v double")
    q = spark.createDataFrame([(1, x) for x in (0.0, 1.0, 2.0, 3.0, 9.0)], "g int, x double")
    got = [r.v for r in joins.interpolate(k, q, ["g"], "x", "v", []).orderBy("x").collect()]
    assert got == [10.0, 10.0, 20.0, 30.0, 30.0]


def test_map_algebra_refuses_what_it_does_not_know():
    for bad in ("a; drop", "reflect(a)", "b + 1", "a ** 2", "__import__(a)"):
        with pytest.raises(ValueError):
            quality.algebra_sql(bad, {"a"})


def test_nearest_neighbours_cross_sparse_tiles(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(0, 50, (40, 2)), rng.uniform(900, 1000, (5, 2))])
    q = rng.uniform(0, 1000, (30, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "pid int, x double, y double")
    targets = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "tid int, x double, y double")
    got = {(r.tid, r["rank"]): r.pid for r in joins.nearest_neighbours(targets, points, 3, "tid", "pid", 40.0).collect()}
    for i, t in enumerate(q):
        order = np.lexsort((np.arange(len(p)), np.hypot(*(p - t).T)))[:3]
        assert [got[i, k + 1] for k in range(3)] == order.tolist()


def test_residual_verdict_on_a_trend(spark):
    d = spark.createDataFrame([(i, float(i), 0.0) for i in range(40)], "n int, o double, p double")
    r = aggregates.residual_report(d, "n", "o", "p", F.lit(1.0)).first()
    assert r.verdict == "underfit" and r.lag1 > 0.5 and r.durbin_watson < 0.1


def test_contour_of_a_plane_is_one_straight_line(spark):
    from strataframe.operators.contours import contour_lines

    z = [[float(j) for j in range(5)] for _ in range(4)]
    rows = contour_lines(cells_of(spark, z), [1.5]).collect()
    assert len({r.line_id for r in rows}) == 1 and not any(r.ring for r in rows)
    assert [(r.seq, r.x) for r in sorted(rows, key=lambda r: r.seq)] == [(k, 150.0) for k in range(4)]


def test_reciprocal_method_recovers_a_flat_refractor(spark):
    v1, v2, h, end = 500.0, 2500.0, 20.0, 200.0
    delay = h * math.sqrt(1 - (v1 / v2) ** 2) / v1
    rows = [(1, x, x / v2 + 2 * delay, (end - x) / v2 + 2 * delay) for x in np.arange(0, end + 1, 10).tolist()]
    d = spark.createDataFrame(rows, "s int, x double, tf double, tr double")
    got = physics.generalised_reciprocal(d, ["s"], "x", "tf", "tr", v1, [0.0, 20.0]).toPandas()
    assert len(got) >= 4 and np.allclose(got.v2, v2) and np.allclose(got.depth, h)


def test_body_columns_of_a_box(spark):
    v = spark.createDataFrame([("b", n, x, z) for n, (x, z) in enumerate([(0.0, 10.0), (40.0, 10.0), (40.0, 30.0), (0.0, 30.0)])], "body string, seq int, x double, z double")
    got = physics.body_columns(v, 10.0, 5.0).collect()
    assert len(got) == 4 and {(r.z1, r.z2, r.y1, r.y2) for r in got} == {(10.0, 30.0, -5.0, 5.0)}


def test_trend_surface_is_exact_for_a_parabola(spark):
    z = [[1 + 2 * j + 3 * i + 0.5 * i * j + j * j for j in range(6)] for i in range(5)]
    d = grids.trend_surface(cells_of(spark, z), 2)
    assert np.allclose(array_of(d, "residual", (5, 6)), 0, atol=1e-8)


def seen(z, oi, oj, eye, steps):
    """Cells that no terrain on the way hides, by walking every ray."""
    out = np.ones(z.shape, bool)
    for i, j in np.ndindex(z.shape):
        n = steps(i, j)
        for k in range(1, n):
            y, x = oi + (i - oi) * k / n, oj + (j - oj) * k / n
            a, b = min(int(y), z.shape[0] - 2), min(int(x), z.shape[1] - 2)
            fy, fx = y - a, x - b
            ground = (1 - fy) * ((1 - fx) * z[a, b] + fx * z[a, b + 1]) + fy * ((1 - fx) * z[a + 1, b] + fx * z[a + 1, b + 1])
            out[i, j] &= ground <= z[oi, oj] + eye + (z[i, j] - z[oi, oj] - eye) * k / n + 1e-6
    return out


def test_viewshed_sees_a_ridge_of_one_cell_on_long_rays(spark):
    z = np.zeros((3, 260))
    z[:, 101] = 50.0
    got = array_of(solutions.viewshed(cells_of(spark, z), 1, 0, 100.0, 100.0, 10.0), "visible", z.shape)
    assert (got == seen(z, 1, 0, 10.0, lambda i, j: 10 * max(abs(i - 1), j, 1))).all()
    assert got[:, :102].all() and not got[:, 102:].any()


def test_viewshed_of_two_grids_matches_every_ray(spark):
    z = np.random.default_rng(4).uniform(0, 30, (2, 9, 11))
    both = cells_of(spark, z[0]).union(cells_of(spark, z[1]).withColumn("grid_id", F.lit("h")))
    got = solutions.viewshed(both, 2, 3, 100.0, 100.0, 5.0)
    for name, one in zip("gh", z, strict=True):
        assert (array_of(got.filter(F.col("grid_id") == name), "visible", one.shape) == seen(one, 2, 3, 5.0, lambda i, j: 199)).all()


def test_ridges_match_a_walk_over_the_grid(spark):
    z = np.random.default_rng(5).normal(size=(13, 17)).cumsum(0).cumsum(1)
    gy, gx = np.gradient(z, 100.0, 100.0, edge_order=2)
    g = np.hypot(gx, gy)
    gi, gj = np.gradient(g)
    angle = (np.round(np.degrees(np.arctan2(gi, gj)) / 45) * 45) % 180
    pad, want = np.pad(g, 1, mode="edge"), np.zeros(g.shape, bool)
    for i, j in np.ndindex(g.shape):
        a, b = {0: (0, 1), 45: (1, 1), 90: (1, 0), 135: (1, -1)}[int(angle[i, j])]
        want[i, j] = g[i, j] >= max(pad[1 + i + a, 1 + j + b], pad[1 + i - a, 1 + j - b], np.percentile(g, 85))
    assert want.any() and (array_of(grids.ridges(cells_of(spark, z), 100.0, 100.0), "ridge", z.shape) == want).all()


def test_lineament_of_a_step_has_its_ends(spark):
    z = [[1 / (1 + math.exp(7 - j)) for j in range(15)] for _ in range(12)]
    cells = grids.ridges(cells_of(spark, z), 100.0, 100.0)
    r = iterate.lineaments(cells, iterate.connected_cells(cells, F.col("ridge"))).collect()
    assert len(r) == 1 and r[0].n == 12 and r[0].azimuth == pytest.approx(0)
    assert [r[0].length, r[0].x1, r[0].y1, r[0].x2, r[0].y2, r[0].linearity] == pytest.approx([1100, 700, 0, 700, 1100, 1])
