"""Classifiers, facies and patches."""

import numpy as np
from pyspark.sql import functions as F

from strataframe.operators import learning as L


def _rings(spark, n=1600):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(n):
        inner = k % 2 == 0
        r, a = (1.0 if inner else 2.2) + rng.normal(0, 0.12), rng.uniform(0, 2 * np.pi)
        rows.append((k, float(r * np.cos(a)), float(r * np.sin(a)), None if k % 11 == 0 else "" if k % 13 == 0 else "in" if inner else "out"))
    return spark.createDataFrame([*rows, (n, None, 1.0, "in")], "k int, a double, b double, rock string")


def test_round_classes_need_a_kernel(spark):
    df = _rings(spark)
    share = {}
    for kernel in ("rbf", "poly", "linear"):
        got = L.classify(df, ["a", "b"], "rock", kernel=kernel)
        share[kernel] = L.confusion(got, "rock").first().accuracy
        if kernel == "rbf":
            rows = {r.k: r for r in got.collect()}
    assert share["rbf"] > 0.95 and share["poly"] > 0.95 > share["linear"]
    assert len(rows) == 1600 and all(r.held_out is None for k, r in rows.items() if k % 11 == 0 or k % 13 == 0)
    right = [r.predicted == ("in" if k % 2 == 0 else "out") for k, r in rows.items() if r.held_out is None]
    assert np.mean(right) > 0.95


def test_every_row_has_its_nearest_unit_and_its_facies(spark):
    rng = np.random.default_rng(1)
    centres = [(0, 0, 0), (8, 0, 3), (0, 9, 6)]
    rows = [(k, *[float(v + rng.normal(0, 0.4)) for v in centres[k % 3]], 5.0) for k in range(600)]
    df = spark.createDataFrame([*rows, (600, None, 1.0, 1.0, 5.0)], "k int, a double, b double, c double, d double")
    columns = ["a", "b", "c", "d"]
    got = {r.k: r for r in L.som_facies(df, columns, 3, 3, 3, 6).collect()}
    assert len(got) == 601 and got[600].som_node is None and got[600].som_facies is None
    w = np.array(L.batch_som(df, columns, 3, 3, 6))
    x = np.array([r[1:] for r in rows])
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    away = ((z[:, None] - w[None]) ** 2).sum(2)
    assert all(away[k, got[k].som_node] <= away[k].min() + 1e-9 for k in range(600))
    facies = [{got[k].som_facies for k in range(m, 600, 3)} for m in range(3)]
    assert all(len(f) == 1 for f in facies) and len(set.union(*facies)) == 3


def test_patches_and_their_mean_by_hand(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(19, 14))
    cells = [("s", i, j, None if (i, j) == (2, 11) else float(v[i, j])) for i in range(19) for j in range(14)]
    df = spark.createDataFrame(cells, "line string, i int, k int, amp double")
    got = {(r.pi, r.pj): r.pixels for r in L.patches(df, ["line"], "i", "k", "amp", 6, 4).collect()}
    want = {}
    for a in range(0, 19 - 5, 4):
        for b in range(0, 14 - 5, 4):
            if not (a <= 2 < a + 6 and b <= 11 < b + 6):
                p = v[a : a + 6, b : b + 6].ravel()
                want[a, b] = p / np.abs(p).max()
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_fault_stands_out(spark):
    rng = np.random.default_rng(3)
    n, depth, size = 60, 48, 12
    layers = np.convolve(rng.normal(size=depth + 60), np.hanning(7), "same")
    tilted = lambda i, throw: layers[20 + throw + (np.arange(depth) + i // 8) % depth]
    section = np.array([tilted(i, 5 if i >= 33 else 0) for i in range(n)])
    taught = []
    for _ in range(500):
        other = np.convolve(rng.normal(size=60), np.hanning(7), "same")
        throw, at = int(rng.integers(3, 8)) * (rng.random() < 0.5), int(rng.integers(4, 9))
        p = np.array([other[12 + (throw if i >= at else 0) + np.arange(size) + i // 8] for i in range(size)])
        taught.append(((p / np.abs(p).max()).ravel().tolist(), int(throw > 0)))
    cells = spark.createDataFrame([(1, i, k, float(section[i, k])) for i in range(n) for k in range(depth)], "line int, i int, k int, amp double")
    labelled = spark.createDataFrame(taught, "pixels array<double>, label int")
    out = L.patch_probability(cells, labelled, ["line"], "i", "k", "amp", size, 4, (32,), 80).toPandas()
    assert len(out) == n * depth
    count = lambda x, m: sum(1 for a in range(0, m - size + 1, 4) if a <= x < a + size)
    assert all(r.n == count(r.i, n) * count(r.k, depth) for r in out.itertuples())
    by_trace = out.groupby("i").probability.mean()
    assert by_trace[31:36].mean() > by_trace[2:18].mean() + 0.3
