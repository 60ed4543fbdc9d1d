"""Queries of 2.2, 2.3 and the grid part of 2.5 and 2.6 over the part grid, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import tidy as t
from ..operators import aggregates as A
from ..operators import grids as G
from ..operators import joins as J
from ..operators import quality as Q
from .fixtures import DX, DY, GRID_SQL, STATION_SQL, Catalog, deposits, grid, stations, table

C = Catalog()
R = "round({}, 6) + 0.0"


def rnd(**cols: str) -> str:
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in cols.items())


# Central differences with second-order ends, as SQL, of a column over a window.
def grad_sql(v: str, w: str, second: bool = True, step: str = "100.0") -> str:
    first, last = f"(lead({v}) OVER {w} - {v}) / {step}", f"({v} - lag({v}) OVER {w}) / {step}"
    if second:
        first = f"coalesce((-3 * {v} + 4 * lead({v}) OVER {w} - lead({v}, 2) OVER {w}) / (2 * {step}), {first})"
        last = f"coalesce((3 * {v} - 4 * lag({v}) OVER {w} + lag({v}, 2) OVER {w}) / (2 * {step}), {last})"
    return f"CASE WHEN lag({v}) OVER {w} IS NULL THEN {first} WHEN lead({v}) OVER {w} IS NULL THEN {last} ELSE (lead({v}) OVER {w} - lag({v}) OVER {w}) / (2 * {step}) END"


WINDOWS = "WINDOW wr AS (PARTITION BY i ORDER BY j), wc AS (PARTITION BY j ORDER BY i)"
THG_SQL = f"WITH {GRID_SQL}, d AS (SELECT *, {grad_sql('value', 'wr')} AS gx, {grad_sql('value', 'wc')} AS gy FROM g {WINDOWS}), h AS (SELECT *, sqrt(gx * gx + gy * gy) AS thg FROM d)"


@C.add("numeric_coercion", "SELECT o_orderkey, o_totalprice AS total, -1.0::DOUBLE AS priority FROM orders")
def numeric_coercion(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("total"), F.col("o_orderpriority").alias("priority"))
    return Q.coerce_numeric(o, ["total", "priority"]).na.fill({"priority": -1.0})


@C.add("quality_report", f"WITH {STATION_SQL} SELECT count(*) AS n_rows, 0::BIGINT AS n_nulls, count(*) - count(DISTINCT (x, y)) AS n_duplicates, count(*) AS n_complete FROM s")
def quality_report(spark, d):
    return Q.quality_report(stations(spark, d), "x", "y", "value")


@C.add("detect_regular_grid", f"WITH {GRID_SQL} SELECT count(DISTINCT x) AS nx, count(DISTINCT y) AS ny, 100.0::DOUBLE AS dx, 100.0::DOUBLE AS dy, count(*) AS n_points, 0::BIGINT AS n_missing, true AS regular FROM g")
def detect_regular_grid(spark, d):
    return Q.detect_regular_grid(grid(spark, d), "x", "y", "value")


@C.add("coordinate_warning", f"WITH {GRID_SQL} SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, max(x) <= 180 AND max(y) <= 90 AS looks_like_degrees FROM g")
def coordinate_warning(spark, d):
    return Q.coordinate_warning(grid(spark, d), "x", "y")


@C.add("fill_constant", f"WITH {GRID_SQL} SELECT i, j, CASE WHEN zone = 2 THEN -1.5 ELSE value END AS value FROM g")
def fill_constant(spark, d):
    holes = grid(spark, d).withColumn("value", F.when(F.col("zone") != 2, F.col("value")))
    return Q.fill_constant(holes, constant=-1.5).select("i", "j", "value")


@C.add("reject_missing", f"WITH {GRID_SQL} SELECT i, j, value FROM g")
def reject_missing(spark, d):
    return Q.reject_missing(grid(spark, d)).select("i", "j", "value")


@C.add("crop_grid", f"WITH {GRID_SQL} SELECT i - 1 AS i, j - 5 AS j, value FROM g WHERE x BETWEEN 450 AND 3000 AND y BETWEEN 50 AND 2000")
def crop_grid(spark, d):
    return Q.crop_grid(grid(spark, d), 3000, 450, 50, 2000).select("i", "j", "value")


@C.add("crop_profile", f"WITH {GRID_SQL} SELECT i, x AS distance, value FROM g WHERE x BETWEEN 400 AND 900")
def crop_profile(spark, d):
    return Q.crop_profile(grid(spark, d).withColumn("distance", F.col("x")), 900, 400).select("i", "distance", "value")


@C.add("map_algebra", f"WITH {GRID_SQL} SELECT i, j, round(CASE WHEN zone > 1 THEN sqrt(value) + 2 * band ELSE greatest(least(value, 950.0), 910.0) END, 6) + 0.0 AS value FROM g")
def map_algebra(spark, d):
    return Q.map_algebra(grid(spark, d), "where(zone > 1, sqrt(value) + 2 * band, clip(value, 910, 950))", ["value", "band", "zone"]).select("i", "j", t("value").alias("value"))


@C.add("threshold_edges", f"WITH {GRID_SQL} SELECT i, j, (zone / 4 >= 0.5)::INT::DOUBLE AS edge FROM g")
def threshold_edges(spark, d):
    return grid(spark, d).select("i", "j", Q.threshold_edges(F.col("zone") / 4).alias("edge"))


@C.add("points_to_grid", f"WITH {GRID_SQL} SELECT i, j, x, y, value FROM g")
def points_to_grid(spark, d):
    return G.points_to_grid(grid(spark, d), "x", "y", "value", F.lit("g")).select(F.col("i").cast("int"), F.col("j").cast("int"), "x", "y", "value")


@C.add("flip", f"WITH {GRID_SQL}, m AS (SELECT max(i) AS mi FROM g) SELECT a.i, a.j, b.value FROM g a, m, g b WHERE b.i = mi - a.i AND b.j = 49 - a.j")
def flip(spark, d):
    return G.flip(grid(spark, d).select("grid_id", "i", "j", "x", "y", "value"), "both").select("i", "j", "value")


@C.add("rotate", f"WITH {GRID_SQL}, m AS (SELECT max(i) AS mi FROM g) SELECT j AS i, mi - i AS j, 100.0::DOUBLE * (mi - i) AS x, 100.0::DOUBLE * j AS y, value FROM g, m")
def rotate(spark, d):
    return G.rotate(grid(spark, d), 90).select("i", "j", "x", "y", "value")


@C.add("gradients", f"{THG_SQL} SELECT i, j, {rnd(gx='gx', gy='gy')} FROM d")
def gradients(spark, d):
    return G.gradients(grid(spark, d), DX, DY).select("i", "j", t("gx").alias("gx"), t("gy").alias("gy"))


@C.add("thdr", f"{THG_SQL} SELECT i, j, {rnd(thg='thg')} FROM h")
def thdr(spark, d):
    return G.horizontal_gradient(grid(spark, d), DX, DY).select("i", "j", t("thg").alias("thg"))


ZONAL_SQL = "count({v}) AS n, round(avg({v}), 6) + 0.0 AS mean, round(stddev_pop({v}), 6) + 0.0 AS std, round(min({v}), 6) + 0.0 AS min, round(max({v}), 6) + 0.0 AS max, round(quantile_cont({v}, 0.5), 6) + 0.0 AS median, round(count({v}) * 0.01, 6) + 0.0 AS area_km2"


def _tidied(df, keep):
    return df.select(*keep, *[t(c).alias(c) if k in ("double", "float") else c for c, k in df.dtypes if c not in keep])


@C.add("zonal_gradient", f"{THG_SQL} SELECT zone::BIGINT AS zone, {ZONAL_SQL.format(v='thg')} FROM h GROUP BY 1")
def zonal_gradient(spark, d):
    """The flagship: points to grid, differences, total gradient, statistics by zone."""
    cells = grid(spark, d)
    placed = G.points_to_grid(cells, "x", "y", "value", F.lit("part"))
    h = G.horizontal_gradient(placed, DX, DY).join(cells.select("x", "y", "zone"), ["x", "y"])
    return _tidied(A.zonal(h, "zone", "thg", 0.01), ["zone"])


@C.add("zonal", f"WITH {GRID_SQL} SELECT zone::BIGINT AS zone, {ZONAL_SQL.format(v='value')} FROM g GROUP BY 1")
def zonal(spark, d):
    return _tidied(A.zonal(grid(spark, d), "zone", "value", 0.01), ["zone"])


@C.add("stats", f"WITH {GRID_SQL} SELECT i, count(value) AS n, 0::BIGINT AS n_missing, {rnd(min='min(value)', max='max(value)', mean='avg(value)', std='stddev_pop(value)', median='quantile_cont(value, 0.5)', rms='sqrt(avg(value * value))')} FROM g GROUP BY i")
def stats(spark, d):
    return _tidied(A.statistics(grid(spark, d), ["i"], "value"), ["i"])


@C.add("cutfill", f"WITH {GRID_SQL} SELECT {rnd(above='sum(greatest(value - 40 * band, 0)) * 10000', below='sum(least(value - 40 * band, 0)) * 10000', net='sum(value - 40 * band) * 10000')} FROM g")
def cutfill(spark, d):
    return _tidied(A.cut_fill(grid(spark, d).withColumn("base", 40 * F.col("band")), "value", "base", 1e4), [])


@C.add("rose", f"WITH {GRID_SQL}, a AS (SELECT (band * 37.5) % 180 AS a, value AS w FROM g), b AS (SELECT least(floor(a / 10), 17)::INT AS bin, sum(w) AS weight FROM a GROUP BY 1), m AS (SELECT ((degrees(atan2(sum(w * sin(radians(2 * a))), sum(w * cos(radians(2 * a))))) / 2 % 180) + 180) % 180 AS mean_azimuth FROM a) SELECT bin, (bin + 0.5) * 10.0::DOUBLE AS center, round(weight, 4) + 0.0 AS weight, round(mean_azimuth, 6) + 0.0 AS mean_azimuth, (SELECT (bin + 0.5) * 10.0::DOUBLE FROM b ORDER BY weight DESC, bin LIMIT 1) AS dominant FROM b, m")
def rose(spark, d):
    lines = grid(spark, d).select((F.col("band") * 37.5).alias("az"), F.col("value").alias("w"))
    return A.rose(lines, "az", "w").select("bin", "center", t("weight", 4).alias("weight"), t("mean_azimuth").alias("mean_azimuth"), "dominant")


EDGE1 = f"WITH {GRID_SQL}, d AS (SELECT *, {grad_sql('value', 'wr', False)} AS zx, {grad_sql('value', 'wc', False)} AS zy FROM g {WINDOWS}), dd AS (SELECT *, {grad_sql('zx', 'wr', False)} AS zxx, {grad_sql('zx', 'wc', False)} AS zxy, {grad_sql('zy', 'wc', False)} AS zyy, zx * zx + zy * zy AS p FROM d {WINDOWS})"


@C.add("topo", f"{EDGE1} SELECT i, j, {rnd(slope='degrees(atan(sqrt(p)))', aspect='((degrees(atan2(-zx, -zy)) % 360) + 360) % 360', profile_curvature='CASE WHEN p > 0 THEN -(zxx * zx * zx + 2 * zxy * zx * zy + zyy * zy * zy) / (p * pow(p + 1, 1.5)) ELSE 0 END', plan_curvature='CASE WHEN p > 0 THEN -(zxx * zy * zy - 2 * zxy * zx * zy + zyy * zx * zx) / pow(p, 1.5) ELSE 0 END')} FROM dd")
def topo(spark, d):
    keep = ["i", "j", "slope", "aspect", "profile_curvature", "plan_curvature"]
    return _tidied(G.terrain(grid(spark, d), DX, DY).select(*keep), ["i", "j"])


LIGHT = "greatest(least(sin(radians(45)) * cos(s) + cos(radians(45)) * sin(s) * cos(radians({a}) - a), 1), 0)"
MULTI = " + ".join(f"pow(sin(a - radians({z})), 2) * {LIGHT.format(a=z)}" for z in (225, 270, 315, 360))
WEIGHT = " + ".join(f"pow(sin(a - radians({z})), 2)" for z in (225, 270, 315, 360))


@C.add("hillshade", f"{EDGE1}, l AS (SELECT i, j, atan(sqrt(zx * zx + zy * zy)) AS s, atan2(-zx, -zy) AS a FROM d) SELECT i, j, {rnd(shade=LIGHT.format(a=315), multi=f'({MULTI}) / ({WEIGHT})')} FROM l")
def hillshade(spark, d):
    one = G.hillshade(grid(spark, d), DX, DY).select("grid_id", "i", "j", "shade")
    many = G.hillshade(grid(spark, d), DX, DY, multidirectional=True).select("grid_id", "i", "j", F.col("shade").alias("multi"))
    return one.join(many, ["grid_id", "i", "j"]).select("i", "j", t("shade").alias("shade"), t("multi").alias("multi"))


@C.add("rgb", f"WITH {GRID_SQL}, b AS (SELECT quantile_cont(value, 0.02) AS v0, quantile_cont(value, 0.98) AS v1, quantile_cont(band, 0.02) AS b0, quantile_cont(band, 0.98) AS b1, quantile_cont(zone, 0.02) AS z0, quantile_cont(zone, 0.98) AS z1 FROM g) SELECT i, j, {rnd(r='greatest(least((value - v0) / (v1 - v0), 1), 0)', g='greatest(least((band - b0) / (b1 - b0), 1), 0)', b='greatest(least((zone - z0) / (z1 - z0), 1), 0)')} FROM g, b")
def rgb(spark, d):
    return _tidied(G.ternary_rgb(grid(spark, d), "value", "band", "zone"), ["i", "j"]).drop("grid_id")


@C.add("texture", f"WITH {GRID_SQL}, n AS (SELECT max(i) + 1 AS ny FROM g), o AS (SELECT unnest(range(-2, 3)) AS o), w AS (SELECT g.i, g.j, g.i + a.o AS ri, g.j + b.o AS rj, ny FROM g, n, o a, o b), f AS (SELECT i, j, CASE WHEN ri < 0 THEN -1 - ri WHEN ri >= ny THEN 2 * ny - 1 - ri ELSE ri END AS ii, CASE WHEN rj < 0 THEN -1 - rj WHEN rj >= 50 THEN 99 - rj ELSE rj END AS jj FROM w) SELECT f.i, f.j, round(stddev_pop(g.value), 6) + 0.0 AS texture FROM f JOIN g ON g.i = f.ii AND g.j = f.jj GROUP BY f.i, f.j")
def texture(spark, d):
    return G.local_std(grid(spark, d)).select("i", "j", t("texture").alias("texture"))


BAND = G.distance_band(DX, DY, 150.0, False)
BAND_OWN = G.distance_band(DX, DY, 150.0, True)


@C.add("gistar", f"WITH {GRID_SQL}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, count(*)::DOUBLE AS a FROM g), n AS (SELECT c.i, c.j, sum(o.value) AS total, count(*)::DOUBLE AS n FROM g c JOIN g o ON abs(c.i - o.i) <= 1 AND abs(c.j - o.j) <= 1 GROUP BY c.i, c.j) SELECT i, j, round((total - m * n) / (sd * sqrt((a * n - n * n) / (a - 1))), 6) + 0.0 AS gi FROM n, s")
def gistar(spark, d):
    return G.hot_spots(grid(spark, d), BAND_OWN).select("i", "j", t("gi").alias("gi"))


@C.add("moran", f"WITH {GRID_SQL}, z AS (SELECT i, j, value - avg(value) OVER () AS z FROM g), l AS (SELECT c.i, c.j, any_value(c.z) AS z, sum(o.z) AS lag, count(o.z) AS n FROM z c JOIN z o ON abs(c.i - o.i) <= 1 AND abs(c.j - o.j) <= 1 AND (c.i <> o.i OR c.j <> o.j) GROUP BY c.i, c.j), a AS (SELECT count(*)::DOUBLE AS n, sum(n)::DOUBLE AS s0, 4 * sum(n * n)::DOUBLE AS s2, sum(z * lag) AS zl, sum(z * z) AS zz FROM l), b AS (SELECT n / s0 * zl / zz AS i, -1 / (n - 1) AS e, (n * n * 2 * s0 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS v FROM a) SELECT {rnd(moran_i='i', expected_i='e', z_score='(i - e) / sqrt(v)')} FROM b")
def moran(spark, d):
    return _tidied(G.moran(grid(spark, d), BAND).drop("grid_id"), [])


@C.add("coregistered_join", f"WITH {GRID_SQL} SELECT i, j, value AS a, band AS b FROM g")
def coregistered_join(spark, d):
    return J.coregistered(grid(spark, d), grid(spark, d).withColumn("value", F.col("band"))).select("i", "j", "a", "b")


BIL_SQL = "SELECT q.id, CASE WHEN count(*) FILTER (WHERE g.value IS NULL) = 0 AND count(*) > 0 THEN round(sum(w * g.value), 6) + 0.0 END AS value FROM q LEFT JOIN g ON g.i = q.ci AND g.j = q.cj GROUP BY q.id"


@C.add("bilinear", f"WITH {GRID_SQL}, m AS (SELECT max(i) AS mi FROM g), p AS (SELECT o_orderkey AS id, ((o_custkey * 37) % 1000) * 4.5 / 100 AS u, ((o_orderkey * 91) % 1000) * 0.3 / 100 AS v FROM orders), k AS (SELECT id, u, v, least(floor(u), 48)::INT AS j0, least(floor(v), mi - 1)::INT AS i0 FROM p, m WHERE v <= mi), c AS (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b), q AS (SELECT id, i0 + a AS ci, j0 + b AS cj, (CASE WHEN a = 1 THEN v - i0 ELSE 1 - v + i0 END) * (CASE WHEN b = 1 THEN u - j0 ELSE 1 - u + j0 END) AS w FROM k, c) SELECT id, round(sum(w * value), 6) + 0.0 AS value FROM q JOIN g ON g.i = ci AND g.j = cj GROUP BY id")
def bilinear(spark, d):
    p = stations(spark, d).select("id", F.lit("part").alias("grid_id"), (F.col("x") * 4.5).alias("x"), (F.col("y") * 0.3).alias("y"))
    return J.bilinear(p, grid(spark, d), 0.0, 0.0, DX, DY, ["id"]).filter("value IS NOT NULL").select("id", t("value").alias("value"))


@C.add("point_to_cell", f"WITH {STATION_SQL}, r AS (SELECT id, x / 100 AS u, y / 100 AS v FROM s) SELECT id, least(greatest(round_even(v, 0), 0), 7)::INT AS i, least(greatest(round_even(u, 0), 0), 8)::INT AS j FROM r")
def point_to_cell(spark, d):
    return J.point_to_cell(stations(spark, d), 0.0, 0.0, DX, DY, 9, 8).select("id", "i", "j")


@C.add("radius_join", "WITH dep AS (SELECT s_suppkey AS id, ((s_suppkey * 613) % 5000)::DOUBLE AS x, ((s_suppkey * 389) % 4000)::DOUBLE AS y FROM supplier) SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) + 0.0 AS distance FROM dep a, dep b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 250000")
def radius_join(spark, d):
    p = deposits(spark, d)
    near = J.radius_join(p.withColumnRenamed("id", "a"), p.withColumnRenamed("id", "b"), 500.0, "a", "b")
    # Distances of whole coordinates to six digits, all 250,001 of which round the same way by doubles as by decimals, at a fraction of the time.
    return near.select("a", "b", (F.rint(F.col("distance") * 1e6) / 1e6).alias("distance"))


KNN_SQL = "WITH dep AS (SELECT s_suppkey AS id, ((s_suppkey * 613) % 5000)::DOUBLE AS x, ((s_suppkey * 389) % 4000)::DOUBLE AS y FROM supplier), g AS (SELECT p_partkey AS t, 100.0 * (p_partkey % 50) AS x, 100.0 * (p_partkey // 50) AS y FROM part), k AS (SELECT t, id, sqrt((g.x - dep.x) * (g.x - dep.x) + (g.y - dep.y) * (g.y - dep.y)) AS distance FROM g, dep), n AS (SELECT t, id, distance, row_number() OVER (PARTITION BY t ORDER BY distance, id) AS rank FROM k) "


@C.add("knn", KNN_SQL + "SELECT t AS target, id AS point, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM n WHERE rank <= 4")
def knn(spark, d):
    cells = grid(spark, d).select((F.col("i").cast("long") * 50 + F.col("j")).alias("target"), "x", "y")
    return J.nearest_neighbours(cells, deposits(spark, d).withColumnRenamed("id", "point"), 4, "target", "point", 600.0).select("target", "point", t("distance").alias("distance"), "rank")


@C.add("idw", KNN_SQL + ", v AS (SELECT n.t, s_acctbal AS v, 1 / pow(greatest(distance, 1e-12), 2) AS w FROM n JOIN supplier ON s_suppkey = id WHERE rank <= 8) SELECT t AS target, round(sum(w * v) / sum(w), 6) + 0.0 AS value FROM v GROUP BY t")
def idw(spark, d):
    from ..operators.gridding import idw as run

    points = deposits(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), "id")
    cells = grid(spark, d).select((F.col("i").cast("long") * 50 + F.col("j")).alias("target"), "x", "y")
    return run(cells, points, "target", "id", "value", 8, 2.0, 600.0).select("target", t("value").alias("value"))


POLY = [(1, 1, [(-50.0, -50.0), (1530.0, 40.0), (1210.0, 2270.0), (130.0, 1330.0)], 1.0), (2, 2, [(810.0, 110.0), (2650.0, 130.0), (2430.0, 1970.0), (1010.0, 2890.0), (1490.0, 910.0)], 2.0)]
POLY_ROWS = [(p, o, s, x, y, v) for p, o, ring, v in POLY for s, (x, y) in enumerate(ring)]
POLY_SQL = "v(polygon, ord, seq, x, y, value) AS (VALUES " + ", ".join(map(str, POLY_ROWS)) + "), ed AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS x2, coalesce(lead(y) OVER o, first_value(y) OVER o) AS y2 FROM v WINDOW o AS (PARTITION BY polygon ORDER BY seq))"


@C.add("vec2ras", f"WITH {GRID_SQL}, {POLY_SQL}, c AS (SELECT i, j, ord, ed.value, count(*) FILTER (WHERE ((ed.y > g.y) <> (y2 > g.y)) AND g.x < (x2 - ed.x) * (g.y - ed.y) / (y2 - ed.y) + ed.x) AS n FROM g, ed GROUP BY i, j, ord, ed.value) SELECT i, j, max_by(value, ord)::DOUBLE AS value FROM c WHERE n % 2 = 1 GROUP BY i, j")
def vec2ras(spark, d):
    rings = spark.createDataFrame(POLY_ROWS, "polygon int, order int, seq int, x double, y double, value double")
    cells = grid(spark, d).select((F.col("i") * 1000 + F.col("j")).alias("id"), "x", "y")
    got = J.points_in_polygons(cells, rings, "id", 500.0)
    return got.select(F.floor(F.col("id") / 1000).cast("int").alias("i"), (F.col("id") % 1000).cast("int").alias("j"), "value")


STENCIL_SQL = f"WITH {GRID_SQL} SELECT c.i, c.j, round(coalesce(sum(o.value), 0), 6) + 0.0 AS total, count(o.value) AS n FROM g c LEFT JOIN g o ON abs(c.i - o.i) <= 1 AND abs(c.j - o.j) <= 1 AND (c.i <> o.i OR c.j <> o.j) GROUP BY c.i, c.j"


@C.add("stencil", STENCIL_SQL)
def stencil(spark, d):
    return G.neighbour_sum(grid(spark, d), BAND).select("i", "j", t("total").alias("total"), "n")


VARIO_SQL = "WITH p AS (SELECT s_suppkey AS id, ((s_suppkey * 613) % 5000)::DOUBLE AS x, ((s_suppkey * 389) % 4000)::DOUBLE AS y, s_acctbal AS v FROM supplier), q AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h, (a.v - b.v) ** 2 AS d FROM p a JOIN p b ON a.id < b.id), b AS (SELECT least(floor(h / 100), 14)::INT AS bin, count(*) AS n, avg(h) AS h, avg(d) / 2 AS gamma FROM q WHERE h <= 1500 GROUP BY 1 HAVING count(*) > 5)"


def _vario(spark, d):
    points = deposits(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), "id")
    return J.variogram(points, "id", "value", 1500.0)


@C.add("variogram", VARIO_SQL + " SELECT bin, n, round(h, 6) + 0.0 AS h, round(gamma, 2) + 0.0 AS gamma FROM b")
def variogram(spark, d):
    return _vario(spark, d).select("bin", "n", t("h").alias("h"), t("gamma", 2).alias("gamma"))


RANGES = [200.0, 300.0, 450.0, 600.0, 800.0, 1000.0, 1300.0]


@C.add("variogram_fit", VARIO_SQL + f", c AS (SELECT unnest({RANGES})::DOUBLE AS a), d AS (SELECT a, gamma, CASE WHEN h / a < 1 THEN 1.5 * h / a - 0.5 * (h / a) ** 3 ELSE 1.0 END AS s FROM b, c), f AS (SELECT a, regr_slope(gamma, s) AS sill, regr_intercept(gamma, s) AS nugget, sum(gamma * gamma) - regr_intercept(gamma, s) * sum(gamma) - regr_slope(gamma, s) * sum(gamma * s) AS rss FROM d GROUP BY a) SELECT a AS range, round(greatest(nugget, 0), 0) + 0.0 AS nugget, round(sill, 0) + 0.0 AS sill FROM f ORDER BY rss LIMIT 1")
def variogram_fit(spark, d):
    return J.fit_variogram(_vario(spark, d), "spherical", RANGES).select("range", t("nugget", 0).alias("nugget"), t("sill", 0).alias("sill"))


@C.add("woe", f"WITH {GRID_SQL}, h AS (SELECT DISTINCT least(greatest(round_even(((s_suppkey * 389) % 4000) / 100.0, 0), 0), (SELECT max(i) FROM g))::INT AS i, least(greatest(round_even(((s_suppkey * 613) % 5000) / 100.0, 0), 0), 49)::INT AS j, 1 AS d FROM supplier), a AS (SELECT count(*) FILTER (WHERE band >= 25 AND d = 1) + 0.5 AS bd, count(*) FILTER (WHERE band < 25 AND d = 1) + 0.5 AS nd, count(*) FILTER (WHERE band >= 25 AND d IS NULL) + 0.5 AS bn, count(*) FILTER (WHERE band < 25 AND d IS NULL) + 0.5 AS nn, count(d) AS k, count(*) AS n FROM g LEFT JOIN h USING (i, j)), b AS (SELECT *, ln((bd / (bd + nd)) / (bn / (bn + nn))) AS wp, ln((nd / (bd + nd)) / (nn / (bn + nn))) AS wm FROM a) SELECT {rnd(w_plus='wp', w_minus='wm', contrast='wp - wm', studentised='(wp - wm) / sqrt(1 / bd + 1 / bn + 1 / nd + 1 / nn)', prior='k / n')} FROM b")
def woe(spark, d):
    cells = grid(spark, d)
    rows = cells.agg(F.max("i")).first()[0] + 1
    hits = J.point_to_cell(deposits(spark, d), 0.0, 0.0, DX, DY, 50, rows).withColumn("grid_id", F.lit("part"))
    return _tidied(A.weights_of_evidence(cells, "band", hits, 25.0), [])


@C.add("fractal", f"WITH {GRID_SQL}, h AS (SELECT unnest(range(1, 4))::INT AS h), d AS (SELECT h, b.value - a.value AS d FROM g a, h, g b WHERE (b.i = a.i AND b.j = a.j + h) OR (b.j = a.j AND b.i = a.i + h)), q AS (SELECT h, avg(d * d) / 2 AS g FROM d GROUP BY h), s AS (SELECT greatest(least(regr_slope(ln(g), ln(h)) / 2, 1), 0) AS hu FROM q) SELECT {rnd(hurst='hu', dimension='3 - hu')} FROM s")
def fractal(spark, d):
    return _tidied(A.fractal_dimension(grid(spark, d), ["grid_id"], 3).drop("grid_id"), [])


@C.add("fractal_map", f"WITH {GRID_SQL}, m AS (SELECT max(i) + 1 AS ny FROM g), c AS (SELECT i // 4 AS wi, j // 4 AS wj, i, j, value FROM g, m WHERE 4 * (i // 4) + 4 <= ny AND 4 * (j // 4) + 4 <= 50), h AS (SELECT unnest(range(1, 4))::INT AS h), d AS (SELECT a.wi, a.wj, h, b.value - a.value AS d FROM c a, h, c b WHERE a.wi = b.wi AND a.wj = b.wj AND ((b.i = a.i AND b.j = a.j + h) OR (b.j = a.j AND b.i = a.i + h))), q AS (SELECT wi, wj, h, avg(d * d) / 2 AS g FROM d GROUP BY 1, 2, 3), s AS (SELECT wi, wj, greatest(least(regr_slope(ln(g), ln(h)) / 2, 1), 0) AS hu FROM q WHERE g > 0 GROUP BY 1, 2) SELECT wi::BIGINT AS wi, wj::BIGINT AS wj, {rnd(hurst='hu', dimension='3 - hu')} FROM s")
def fractal_map(spark, d):
    both = A.window_members(grid(spark, d).select("grid_id", "i", "j", "value"), 4, 4)
    return _tidied(A.fractal_dimension(both, ["wi", "wj"], 3), ["wi", "wj"])


@C.add("trend")
def trend(spark, d):
    return _tidied(G.trend_surface(grid(spark, d), 2).select("i", "j", "trend", "residual"), ["i", "j"])


@C.add("trend_plane", f"WITH {GRID_SQL}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(value) AS mv FROM g), s AS (SELECT sum((x - mx) * (value - mv)) / sum((x - mx) ** 2) AS bx, sum((y - my) * (value - mv)) / sum((y - my) ** 2) AS b, any_value(mx) AS mx, any_value(my) AS my, any_value(mv) AS mv FROM g, m) SELECT i, j, round(s.mv + bx * (x - s.mx) + b * (y - s.my), 6) + 0.0 AS trend FROM g, s")
def trend_plane(spark, d):
    return G.trend_surface(grid(spark, d), 1).select("i", "j", t("trend").alias("trend"))


LINE_SQL = "ln AS (SELECT ((s_suppkey * 613) % 5000)::DOUBLE AS x1, ((s_suppkey * 389) % 4000)::DOUBLE AS y1, ((s_suppkey * 613) % 5000)::DOUBLE + s_acctbal / 10 AS x2, ((s_suppkey * 389) % 4000)::DOUBLE + 300 AS y2 FROM supplier), pc AS (SELECT x1 + (x2 - x1) * (k + 0.5) / 20 AS x, y1 + (y2 - y1) * (k + 0.5) / 20 AS y, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 20 AS len FROM ln, (SELECT unnest(range(20)) AS k))"


@C.add("lin_density", f"WITH {GRID_SQL}, {LINE_SQL} SELECT i, j, round(coalesce(sum(len), 0) / 1000 / (pi() * 0.16), 6) + 0.0 AS density FROM g LEFT JOIN pc ON (g.x - pc.x) ** 2 + (g.y - pc.y) ** 2 <= 160000 GROUP BY i, j")
def lin_density(spark, d):
    s = table(spark, d, "supplier")
    x, y = (F.col("s_suppkey") * 613 % 5000).cast("double"), (F.col("s_suppkey") * 389 % 4000).cast("double")
    lines = s.select(x.alias("x1"), y.alias("y1"), (x + F.col("s_acctbal") / 10).alias("x2"), (y + 300).alias("y2"))
    return G.lineament_density(lines, grid(spark, d), 400.0).select("i", "j", t("density").alias("density"))


@C.add("terrain")
def terrain(spark, d):
    p = deposits(spark, d).withColumn("height", F.lit(920.0))
    return G.terrain_correction(p, grid(spark, d), DX, DY, 500.0).select("id", t("terrain").alias("terrain"))
