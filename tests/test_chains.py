"""Lists, forests, drainage and ordered contours against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import iterate
from strataframe.operators.chains import led_to, list_ranks, subtree_sums
from strataframe.operators.contours import class_outlines, contour_lines
from strataframe.operators.drainage import basins, flow_accumulation


def test_lists_and_rings_of_many_lengths(spark):
    rng = random.Random(0)
    links, want, n = [], {}, 0
    for size, ring in [(1, True), (2, True), (2, False), (3, True), (17, False), (64, True), (65, True), (700, False), (700, True)]:
        names = list(range(n, n + size))
        n += size
        rng.shuffle(names)
        if ring:
            k = names.index(min(names))
            names = names[k:] + names[:k]
        links += list(zip(names, names[1:] + names[:1] if ring else names[1:], strict=False))
        want |= {x: (names[0], r, ring) for r, x in enumerate(names)}
    rng.shuffle(links)
    got = {r.node: (r.head, r["rank"], r.ring) for r in list_ranks(spark.createDataFrame(links, "node int, nxt int")).collect()}
    assert got == want


def test_forest_sums_and_marks(spark):
    rng = random.Random(1)
    parent = {k: rng.randint(max(0, k - 4), k - 1) if k else None for k in range(1500)}
    parent |= {k: k - 1 if k > 1500 else None for k in range(1500, 1900)}
    total, mark = {k: k % 7 for k in parent}, {k: k if rng.random() < 0.03 else None for k in parent}
    rows = [(k, p, k % 7, mark[k]) for k, p in parent.items()]
    for k in sorted(parent, reverse=True):
        if parent[k] is not None:
            total[parent[k]] += total[k]

    def first(k):
        while k is not None and mark[k] is None:
            k = parent[k]
        return k

    df = spark.createDataFrame(rows, "node int, p int, w long, mark long")
    assert {r.node: r.total for r in subtree_sums(df, "w").collect()} == total
    assert {r.node: r.mark for r in led_to(df, "mark").collect()} == {k: first(k) for k in parent}


def _cells(spark, z, name="g"):
    return spark.createDataFrame([(name, i, j, float(j), float(i), None if np.isnan(v) else float(v)) for i, row in enumerate(z) for j, v in enumerate(row)], "grid_id string, i int, j int, x double, y double, value double")


def _drained(z):
    """Accumulation of each cell and its way down."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    to, rows, cols = {}, *z.shape
    for i in range(rows):
        for j in range(cols):
            best = max(((z[i, j] - z[i + a, j + b]) / np.hypot(a, b), -n, (i + a, j + b)) for n, (a, b) in enumerate(steps) if 0 <= i + a < rows and 0 <= j + b < cols)
            if best[0] > 0:
                to[i, j] = best[2]
    total = {(i, j): 1 for i in range(rows) for j in range(cols)}
    for c in sorted(total, key=lambda c: -z[c]):
        if c in to:
            total[to[c]] += total[c]
    return to, total


@pytest.mark.parametrize("side", [5, 64])
def test_drainage_over_many_tiles(spark, monkeypatch, side):
    import strataframe.operators.drainage as drainage

    monkeypatch.setattr(drainage, "TILE", side)
    rng = np.random.default_rng(side)
    z = rng.permutation(37 * 41).reshape(37, 41) * 0.01 + np.add.outer(np.arange(37), np.arange(41)) * 2.0
    to, total = _drained(z)
    cells = _cells(spark, z)
    got = {(r.i, r.j): r.cells_above for r in flow_accumulation(cells, 1.0, 1.0).collect()}
    assert got == total
    pours = {(0, 0): 1, (12, 20): 2, (5, 5): 3, (30, 40): 4}
    rows = [("g", i, j, p) for (i, j), p in pours.items()]

    def first(c):
        while c is not None and c not in pours:
            c = to.get(c)
        return pours.get(c)

    basin = {(r.i, r.j): r.basin for r in basins(cells, spark.createDataFrame(rows, "grid_id string, i int, j int, pour int"), 1.0, 1.0).collect()}
    assert basin == {c: first(c) for c in total if first(c) is not None}


def test_a_way_of_five_thousand_cells(spark):
    cells = spark.range(5000).select(F.lit("g").alias("grid_id"), F.lit(0).alias("i"), F.col("id").cast("int").alias("j"), (-F.col("id")).cast("double").alias("value"))
    got = {r.j: r.cells_above for r in flow_accumulation(cells, 1.0, 1.0).collect()}
    assert got == {j: j + 1 for j in range(5000)}
    assert not hasattr(iterate, "contour_lines")


def _area(points):
    return sum(x * v - u * y for (x, y), (u, v) in zip(points, points[1:], strict=False)) / 2


def test_doughnut_has_an_outer_ring_and_a_hole(spark):
    y, x = np.mgrid[0:40, 0:50]
    away = np.hypot(x - 24, y - 20)
    z = ((away < 15) & (away > 6)).astype(float)
    rows = class_outlines(_cells(spark, z), [1.0]).collect()
    lines = {}
    for r in sorted(rows, key=lambda r: r.seq):
        lines.setdefault((r.line_id, r.ring, r.hole), []).append((r.x, r.y))
    assert sorted((ring, hole) for _, ring, hole in lines) == [(True, False), (True, True)]
    for (_, _, hole), points in lines.items():
        assert points[0] == points[-1] and len(set(points)) == len(points) - 1
        assert all(np.hypot(a - c, b - d) <= 1.0 for (a, b), (c, d) in zip(points, points[1:], strict=False))
        assert (_area(points) < 0) == hole
        assert abs(abs(_area(points)) - np.pi * (6 if hole else 15) ** 2) < 40


def test_contours_of_a_rough_field_keep_high_ground_left(spark):
    rng = np.random.default_rng(4)
    z = rng.random((23, 31))
    z[5, 7] = np.nan
    z[9, 9] = 0.5
    rows = contour_lines(_cells(spark, z), [0.5, 0.8]).collect()
    lines = {}
    for r in sorted(rows, key=lambda r: r.seq):
        lines.setdefault((r.level, r.line_id), []).append(r)
    crossings = 0
    for level in (0.5, 0.8):
        up = z >= level
        known = ~np.isnan(z)
        block = known[:-1, :-1] & known[1:, :-1] & known[:-1, 1:] & known[1:, 1:]
        beside = np.zeros((24, 32), bool)
        beside[1:-1, 1:-1] = block
        crossings += ((up[:, 1:] != up[:, :-1]) & (beside[:-1, 1:-1] | beside[1:, 1:-1])).sum() + ((up[1:] != up[:-1]) & (beside[1:-1, :-1] | beside[1:-1, 1:])).sum()
    assert sum(len(v) - v[0].ring for v in lines.values()) == crossings
    for (level, _), points in lines.items():
        assert [p.seq for p in points] == list(range(len(points)))
        for p, q in zip(points, points[1:], strict=False):
            j, i = int(min(p.x, q.x)), int(min(p.y, q.y))
            assert abs(p.x - q.x) <= 1 and abs(p.y - q.y) <= 1
            corner = [(a, b) for a in (i, i + 1) for b in (j, j + 1) if a < 23 and b < 31 and (q.x - p.x) * (a - p.y) - (q.y - p.y) * (b - p.x) > 1e-9]
            if len(corner) == 1:
                assert z[corner[0]] >= level
