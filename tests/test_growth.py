"""Steps whose work must grow no faster than their input, and the values they give."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import contours, iterate, joins, learning, physics, solutions, traces
from strataframe.sources import surveys


def plan_of(df) -> str:
    return df._jdf.queryExecution().analyzed().toString().lower()


def test_interpolate_has_no_frame_to_the_end_of_its_partition(spark):
    rng = np.random.default_rng(3)
    x, v, q = np.sort(rng.uniform(0, 100, 300)), rng.normal(size=300), rng.uniform(-5, 105, 200)
    knots = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, v, strict=True)], "g int, x double, v double")
    asks = spark.createDataFrame([(1, float(a), n) for n, a in enumerate([*q, *x[:20]])], "g int, x double, n int")
    found = joins.interpolate(knots, asks, ["g"], "x", "v", ["n"])
    assert "unboundedfollowing" not in plan_of(found)
    got = {r["n"]: r["v"] for r in found.collect()}
    assert np.allclose([got[n] for n in range(220)], np.interp([*q, *x[:20]], x, v))


def test_distance_has_no_frame_to_the_end_of_its_partition(spark):
    cells = spark.range(600).select(F.lit("a").alias("grid_id"), (F.col("id") / 6).cast("int").alias("i"), (F.col("id") % 6).cast("int").alias("j"))
    found = solutions.distance_to_features(cells, (F.col("i") * 7 + F.col("j")) % 53 == 0, 3.0, 2.0)
    assert "unboundedfollowing" not in plan_of(found)
    marks = [(i, j) for i in range(100) for j in range(6) if (i * 7 + j) % 53 == 0]
    for r in found.collect():
        assert r["distance"] == pytest.approx(min(np.hypot(2 * (r["i"] - i), 3 * (r["j"] - j)) for i, j in marks))


def test_reciprocal_method_deals_each_spread_once_and_matches_plain_arrays(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.uniform(3, 7, 80))
    f, r = 0.02 + x / 1500 + rng.normal(0, 1e-4, 80), 0.02 + (x[-1] - x) / 1500 + rng.normal(0, 1e-4, 80)
    df = spark.createDataFrame([("a", *map(float, t)) for t in zip(x, f, r, strict=True)] + [("b", 1.0, 0.1, 0.2), ("b", 2.0, None, 0.2)], "line string, x double, f double, r double")
    found = physics.generalised_reciprocal(df, ["line"], "x", "f", "r", 500.0, [0.0, 10.0, 20.0, 30.0])
    assert "window" not in plan_of(found) and "join" not in plan_of(found)
    tried = []
    for xy in (0.0, 10.0, 20.0, 30.0):
        p = x[(x + xy / 2 <= x[-1]) & (x - xy / 2 >= x[0])]
        tf, tr = np.interp(p + xy / 2, x, f), np.interp(p - xy / 2, x, r)
        slope, start = np.polyfit(p, (tf - tr + f[-1]) / 2, 1)
        tried.append((np.std((tf - tr + f[-1]) / 2 - start - slope * p), xy, 1 / slope, p, (tf + tr - f[-1] - xy * slope) / 2))
    roughness, xy, v2, p, time = min(tried, key=lambda t: t[:2])
    got = sorted(found.collect(), key=lambda r: r["x"])
    assert [g["line"] for g in got] == ["a"] * len(p) and {g["xy"] for g in got} == {xy}
    assert np.allclose([g["v2"] for g in got], v2) and np.allclose([g["roughness"] for g in got], roughness)
    assert np.allclose([g["x"] for g in got], p) and np.allclose([g["depth"] for g in got], time * 500 * v2 / np.sqrt(v2 * v2 - 500**2))


def test_classify_teaches_each_different_row_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b), "in" if a * a + b * b < 1.2 else "out") for a, b in np.round(rng.normal(size=(300, 2)), 2)]
    df = spark.createDataFrame(rows, "a double, b double, rock string")
    kept, fit = [], learning.OneVsRest.fit
    monkeypatch.setattr(learning.OneVsRest, "fit", lambda self, d, *rest: (kept.append(d.count()), fit(self, d, *rest))[1])
    many = df.crossJoin(spark.range(20)).drop("id")
    once, often = (learning.classify(d, ["a", "b"], "rock").select("a", "b", "rock", "predicted").distinct().collect() for d in (df, many))
    assert kept[1] == kept[0] <= len(set(rows))
    assert len(set(once) & set(often)) >= 0.99 * len(set(once))
    assert np.mean([r["rock"] == r["predicted"] for r in often]) > 0.9


def test_viewshed_tests_few_samples_of_cells_that_a_ridge_hides(spark, monkeypatch):
    z = [[0.0 if j < 40 else 500.0 if j < 60 else 1.0 * (j % 7) for j in range(100)] for _ in range(4)]
    cells = spark.createDataFrame([("a", i, j, v) for i, row in enumerate(z) for j, v in enumerate(row)], "grid_id string, i int, j int, value double")
    asked, read = [], joins.bilinear
    monkeypatch.setattr(joins, "bilinear", lambda points, *rest: (asked.append(points.count()), read(points, *rest))[1])
    seen = {(r["i"], r["j"]) for r in solutions.viewshed(cells, 1, 0, 10.0, 10.0, 5.0).filter("visible").collect()}
    assert {(i, j) for i in range(4) for j in range(41)} <= seen and not any(j > 60 for _, j in seen)
    assert sum(asked) < 0.7 * 400 * 198


def test_arrivals_of_a_deep_model_meet_only_the_cells_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(2)
    model = [("m", i, j, 10.0 * j, float(v)) for i, row in enumerate(rng.uniform(1000, 3000, (60, 30))) for j, v in enumerate(row)]
    cells = spark.createDataFrame(model, "grid_id string, i int, j int, x double, value double")
    whole = {p: {(r.i, r.j): r.total for r in iterate.travel_times(cells, (F.col("i") == 0) & (F.col("x") == p), 10.0, 10.0).collect()} for p in (0.0, 150.0)}
    met, settle = [], iterate.travel_times
    monkeypatch.setattr(iterate, "travel_times", lambda models, *rest, **named: (met.append(models.count()), settle(models, *rest, **named))[1])
    found = iterate.arrivals(cells, spark.createDataFrame([(0.0,), (150.0,)], "position double"), 10.0, 10.0, 0.03)
    got = {(r.position, r.i, r.j): r.total for r in found.collect()}
    assert met[0] < 2 * 1800 / 4
    assert got == pytest.approx({(p, i, j): t for p, ts in whole.items() for (i, j), t in ts.items() if t <= 0.03}) and len(got) > 50


def test_depth_migration_reads_the_sum_of_traces_with_one_source_and_receiver(spark):
    rng = np.random.default_rng(6)
    rows = [(n, 0.0, 10.0 * (n % 2), k, float(a)) for n in range(40) for k, a in enumerate(rng.normal(size=6 + n % 3)) if (n, k) != (4, 2)]
    traces = spark.createDataFrame(rows, "trace int, sx double, rx double, k int, amp double")
    times = spark.createDataFrame([(p, i, j, 10.0 * j, 0.5 * p / 10 + 0.7 * i + 0.5 * j) for p in (0.0, 10.0) for i in range(3) for j in range(3)], "position double, i int, j int, x double, total double")
    found = solutions.kirchhoff_depth(traces, times, "k", "amp", 1.0, 100.0)
    image, held = {}, {}
    for n, _, rx, k, a in rows:
        held.setdefault((n, rx), []).append((k, a))
    for (n, rx), samples in held.items():
        for i in range(3):
            for j in range(3):
                p = 2 * (0.7 * i + 0.5 * j) + 0.5 * rx / 10
                at = [q for q, (k, _) in enumerate(samples) if k == int(p)]
                if at and (p == int(p) or at[0] + 1 < len(samples)):
                    v = samples[at[0]][1]
                    image[i, j] = image.get((i, j), 0.0) + (v if p == int(p) else v + (samples[at[0] + 1][1] - v) * (p - int(p)))
    assert {(r.i, r.j): r.migrated for r in found.collect()} == pytest.approx(image)
    assert "aggregate [sx" in plan_of(found)


def test_logs_are_read_without_a_shuffle_one_a_file_or_many(spark, tmp_path):
    log = "# by hand\n~Version\nVERS. 2.0 :\n~Well\n WELL.  {} : name\nNULL. -9.5 :\n\n~curve\nDEPT.M : d\n GR.API : g\n# no data\n~ASCII\n 1.0  20\n1.5\n-9.5 \n 2.0 x\n"
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.las").write_text(log.format("A 1"))
    (tmp_path / "one" / "b.las").write_text(log.format("B").replace("\n", "\r\n"))
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "all.txt").write_bytes("".join(log.format(n) + "\x1e" for n in ("A 1", "B", "C")).encode())
    want = [(s, c, v) for s, row in enumerate([(1.0, 20.0), (1.5, None), (2.0, None)]) for c, v in zip(("DEPT", "GR"), row, strict=True)]
    for folder, separator, names in (("one", None, ("a.las", "b.las")), ("many", "\x1e", ("A 1", "B", "C"))):
        found = surveys.read_las(spark, f"file://{tmp_path}/{folder}", separator)
        assert "window" not in plan_of(found) and "join" not in plan_of(found).replace("array_join", "")
        for name in names:
            assert sorted((r["seq"], r["curve"], r["value"]) for r in found.collect() if r["well"].endswith(name)) == sorted(want, key=lambda x: x[:2])


def test_radius_join_deals_a_crowded_tile_to_many_keys(spark, monkeypatch):
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(0, 4, (150, 2)), rng.uniform(-30, 30, (150, 2))])
    df = spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate(xy)], "a int, x double, y double")
    monkeypatch.setattr(joins, "MET_TOGETHER", 16)
    found = joins.radius_join(df, df.withColumnRenamed("a", "b"), 5.0, "a", "b")
    away = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    got = {(r["a"], r["b"]): r["distance"] for r in found.collect()}
    assert found.count() == len(got) and got == pytest.approx({(int(a), int(b)): away[a, b] for a, b in zip(*np.nonzero(away <= 5), strict=True)})
    assert "_np" in plan_of(found)


def test_radius_join_broadcasts_neither_side(spark, tmp_path):
    """Points of one small file are 25 rows each once exploded; those rows are not broadcast to the few tasks that read the others."""
    spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y")).write.parquet(f"{tmp_path}/points")
    df = spark.read.parquet(f"{tmp_path}/points")
    found = joins.radius_join(df, df.withColumnRenamed("a", "b"), 3.0, "a", "b")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a in range(50) for b in range(50) if (a - b) ** 2 + (a % 7 - b % 7) ** 2 <= 9}


def test_mechanisms_of_many_events_share_their_rays(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(e, float(37 * k % 360), float(13 * k % 85 + 3), int(rng.choice([-1, 1]))) for e in range(7) for k in range(20 + e)] + [(7, *map(float, rng.uniform(3, 85, 2)), 1) for _ in range(30)]
    df = spark.createDataFrame(rows, "event int, az double, up double, p int")
    read = lambda: sorted(solutions.focal_mechanisms(df, "event", "az", "up", "p", (30, 30, 60), 5).collect())
    assert "flatmapgroupsinpandas" not in plan_of(solutions.focal_mechanisms(df, "event", "az", "up", "p"))
    whole = read()
    assert len(whole) == 40
    for e, s, d, r, misfit, _ in ((x["event"], *np.radians([x["strike"], x["dip"], x["rake"]]), x["misfit"], x["rank"]) for x in whole):
        n = np.array([-np.sin(d) * np.sin(s), np.sin(d) * np.cos(s), -np.cos(d)])
        u = np.array([np.cos(r) * np.cos(s) + np.cos(d) * np.sin(r) * np.sin(s), np.cos(r) * np.sin(s) - np.cos(d) * np.sin(r) * np.cos(s), -np.sin(r) * np.sin(d)])
        g = np.array([[np.sin(i) * np.cos(a), np.sin(i) * np.sin(a), np.cos(i), p] for ev, a, i, p in ((ev, np.radians(a), np.radians(i), p) for ev, a, i, p in rows) if ev == e])
        amp = (g[:, :3] @ n) * (g[:, :3] @ u)
        assert misfit == pytest.approx(np.mean(np.where(np.abs(amp) < 1e-9, 0, np.sign(amp)) != g[:, 3]))
    monkeypatch.setattr(solutions, "EVENTS", 3)
    monkeypatch.setattr(solutions, "RAYS", 8)
    monkeypatch.setattr(solutions, "OBSERVATIONS", 9)
    assert read() == whole


def test_a_map_learns_from_each_different_row_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(b), 3.0) for a, b in rng.integers(0, 9, (200, 2))], "a double, b double, c double")
    kept, write = [], iterate.written
    monkeypatch.setattr(iterate, "written", lambda d: (out := write(d), kept.append(out.count()))[0])
    once, often = (learning.batch_som(d, ["a", "b", "c"], 2, 2, 4) for d in (df, df.crossJoin(spark.range(30)).drop("id")))
    assert kept[0] == kept[1] <= 81 and np.allclose(once, often) and np.allclose(np.array(once)[:, 2], 0)


def test_main_field_is_worked_out_over_arrays(spark):
    c = spark.createDataFrame([(2000.0, 1, 0, -30000.0, 0.0), (2005.0, 1, 0, -29000.0, 0.0)], "epoch double, n int, m int, g double, h double")
    d = spark.createDataFrame([(0, 0.0, 90.0, 2000.0), (1, 0.0, 90.0, 2002.5), (2, 0.0, 90.0, 2006.0), (3, None, 90.0, 2000.0)], "id int, lon double, lat double, y double")
    found = physics.main_field(d, c, year=F.col("y"))
    got = {r.id: r.main_field for r in found.collect()}
    far = (6371.2 / 6356.752314245) ** 3
    assert got[0] == pytest.approx(60000 * far) and got[1] == pytest.approx(59000 * far) and got[2] is None and got[3] is None
    assert "sizes(" in plan_of(found) and "lambdafunction" not in plan_of(found)


def test_layered_search_finds_the_spread_of_a_task_once(spark):
    """One table of responses for all soundings of the same frequencies, exact slopes, and tasks that are not cut down by size."""
    rng = np.random.default_rng(4)
    models, omega = rng.normal(4, 1, (6, 5)), 2 * np.pi * np.logspace(-2, 3, 9)
    slopes = solutions._response_slopes(models, 3, omega)
    for k in range(5):
        up, down = models + 1e-5 * np.eye(5)[k], models - 1e-5 * np.eye(5)[k]
        assert np.allclose(slopes[:, k], (solutions._responses(up, 3, omega) - solutions._responses(down, 3, omega)) / 2e-5, atol=1e-7)
    rows = [(n, float(f), 100.0 + n + f, 45.0 - n) for n in range(40) for f in (1, 2, 4, 8, 16, 32)]
    found = solutions.layered_search(spark.createDataFrame(rows, "site int, f double, rho double, angle double"), ["site"], "f", "rho", "angle", models=256, keep=4, steps=8)
    assert found.count() == 40 and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_werner_solves_whole_profiles_as_arrays(spark):
    """No list for each sample, and windows stay within their profile; unknown samples have no window."""
    rows = [(line, 10.0 * k, 500.0 * line / ((10.0 * k - 97.0) ** 2 + 40.0**2) if k != 19 else None) for line in (1, 2) for k in range(20)]
    found = solutions.werner(spark.createDataFrame(rows, "line int, x double, v double"), ["line"], "x", "v")
    assert "window" not in plan_of(found) and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = found.collect()
    assert sum(abs(r.x0 - 97) < 1e-3 and abs(r.depth - 40) < 1e-3 for r in got if r.line == 2) == 12 == sum(r.line == 1 for r in got)


def test_starlet_of_traces_has_no_join_and_matches_a_grid_of_one_column(spark):
    """Traces of unlike lengths, one with a missing value and one with a missing sample, as the joins of a grid do them."""
    rng = np.random.default_rng(11)
    rows = [(t, k, 0, None if (t, k) == (2, 5) else float(rng.normal())) for t, n in ((1, 30), (2, 21), (3, 1), (4, 30)) for k in range(n) if (t, k) != (4, 7)]
    df = spark.createDataFrame(rows, "trace int, k int, j int, v double")
    found = traces.starlet(df, ["trace"], "k", "v", 2)
    assert "join" not in plan_of(found) and found.schema["k"].dataType == df.schema["k"].dataType
    want = {(r.trace, r.k): r.denoised for r in traces.starlet(df, ["trace"], ["k", "j"], "v", 2).collect()}
    got = {(r.trace, r.k): r.denoised for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all(got[n] == pytest.approx(want[n], abs=1e-9) for n in got)


def test_dmo_sends_a_trace_to_a_target_once(spark):
    """No row for each sample and factor, and the sums are those of plain loops."""
    rng = np.random.default_rng(8)
    amp = {n: rng.normal(size=12) for n in range(6)}
    rows = [(n, 30.0 * n, 100.0, k, float(amp[n][k])) for n in amp for k in range(12)]
    found = solutions.dmo(spark.createDataFrame(rows, "trace int, pos double, off double, k int, v double"), "trace", "pos", "off", "k", "v", 30.0, 9)
    assert "window" not in plan_of(found)
    want = {n: np.zeros(12) for n in amp}
    for n in amp:
        for b in (-50 + 100 * m / 8 for m in range(1, 8)):
            to = 30.0 * n + b
            if 0 <= to <= 150:
                at = min(amp, key=lambda o: (abs(30.0 * o - to), o))
                place = np.arange(12) / np.sqrt(1 - (b / 50) ** 2)
                want[at] += np.where(place <= 11, np.interp(place, np.arange(12), amp[n]), 0.0) / 7
    for r in found.collect():
        assert r.dmo == pytest.approx(want[r.trace][r.k], abs=1e-9)


def test_outlines_are_put_together_in_tiles(spark, monkeypatch):
    """Lines that cross tiles are those of one tile, where only the empty list of crossing chains is ranked."""
    rng = np.random.default_rng(2)
    z = rng.integers(0, 3, (14, 11))
    z[4:11, 2:9], z[6:9, 4:7] = 7, 1
    cells = spark.createDataFrame([("g", i, j, 10.0 * j, 10.0 * i, float(z[i, j])) for i in range(14) for j in range(11) if (i, j) != (12, 5)], "grid_id string, i int, j int, x double, y double, value double")
    ranked, rank = [], contours.list_ranks
    monkeypatch.setattr(contours, "list_ranks", lambda links, *a: (ranked.append(links.count()), rank(links, *a))[1])
    outlines = lambda: sorted(map(tuple, contours.class_outlines(cells, [0.0, 1.0, 7.0]).collect()))
    whole = outlines()
    monkeypatch.setattr(contours, "TILE", 3)
    assert outlines() == whole and {r[6] for r in whole} == {r[7] for r in whole} == {True, False}
    lines = sum(not r[6] and r[3] == 0 for r in whole)
    assert ranked[0] == lines < ranked[1]


def test_tide_is_worked_out_as_arrays(spark):
    """The tide is one call over a column, not a lambda for each row; an unknown time has none."""
    d = spark.sql("SELECT timestamp_micros(1000000 * id) AS t FROM range(1000000000, 1000000003) UNION ALL SELECT NULL")
    told = d.select(traces.longman_tide(F.col("t"), 30.0, 31.0).alias("v"))
    assert "lambda" not in plan_of(told)
    got = [r.v for r in told.collect()]
    assert got.count(None) == 1 and sum(abs(v) < 0.3 for v in got if v is not None) == 3


def test_viewshed_broadcasts_no_table_of_cells(spark, tmp_path, monkeypatch):
    """Cells that are small as a file and large as rows meet by sorting; only a row for each grid may be broadcast."""
    spark.range(60).select(F.lit("a").alias("grid_id"), (F.col("id") / 6).cast("int").alias("i"), (F.col("id") % 6).cast("int").alias("j"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    joined = lambda df: re.findall(r"(\w+Join) \[([^\]]*)\]", df._jdf.queryExecution().sparkPlan().toString())
    plans, write = [], iterate.written
    monkeypatch.setattr(iterate, "written", lambda df: (plans.append(joined(df)), write(df))[1])
    found = solutions.viewshed(cells, 1, 0, 10.0, 10.0, 5.0, samples=20)
    assert found.filter("visible").count() == 60
    plans.append(joined(found))
    assert len(plans) > 3 and any(kind == "SortMergeJoin" for kind, _ in sum(plans, []))
    assert {re.sub(r"#\d+", "", keys) for kind, keys in sum(plans, []) if kind == "BroadcastHashJoin"} <= {"grid_id"}
