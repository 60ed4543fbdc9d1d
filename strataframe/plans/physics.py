"""Queries of the row-wise physics (2.8), and their oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalar import tidy as t
from ..operators import physics as P
from .fixtures import GRID_SQL, SECTION_SQL, STATION_SQL, WELL_SQL, Catalog, grid, section, stations, table, wells
from .grids import _tidied, rnd

C = Catalog()
MU0 = P.MU0
G = 6.674e-11

GRAV_SQL = f"{STATION_SQL}, b AS (SELECT id, x * 0.09 - 45 AS lat, y * 2 AS h, 979000 + value / 1000 AS g FROM s), a AS (SELECT *, pow(sin(radians(lat)), 2) AS s2 FROM b), n AS (SELECT *, 978032.67715::DOUBLE * (1 + 0.001931851353::DOUBLE * s2) / sqrt(1 - 0.0066943800229::DOUBLE * s2) AS normal, (0.3087691::DOUBLE - 0.0004398::DOUBLE * s2) * h - 7.2125e-8::DOUBLE * h * h AS fa FROM a)"


def _gravity(spark, d):
    return stations(spark, d).select("id", (F.col("x") * 0.09 - 45).alias("lat"), (F.col("y") * 2).alias("h"), (979000 + F.col("value") / 1000).alias("g"))


@C.add("free_air", f"WITH {GRAV_SQL} SELECT id, {rnd(normal='normal', free_air_correction='fa', free_air_anomaly='g - normal + fa')} FROM n")
def free_air(spark, d):
    return _tidied(P.gravity_anomalies(_gravity(spark, d), "lat", "h", "g").select("id", "normal", "free_air_correction", "free_air_anomaly"), ["id"])


@C.add("bouguer", f"WITH {GRAV_SQL} SELECT id, {rnd(bouguer=f'g - normal + fa - {2 * math.pi * G * 2670 * 1e5!r}::DOUBLE * h - (1.464e-3 * h - 3.533e-7 * h * h + 1.002e-13 * h * h * h)', complete_bouguer=f'g - normal + fa - {2 * math.pi * G * 2670 * 1e5!r}::DOUBLE * h - (1.464e-3 * h - 3.533e-7 * h * h + 1.002e-13 * h * h * h) + h / 1000')} FROM n")
def bouguer(spark, d):
    b = _gravity(spark, d).withColumn("tc", F.col("h") / 1000)
    return _tidied(P.gravity_anomalies(b, "lat", "h", "g", with_curvature=True, terrain="tc").select("id", "bouguer", "complete_bouguer"), ["id"])


PRISMS = [(300.0, 400.0, 350.0, 500.0, 100.0, 260.0, 400.0), (600.0, 800.0, 100.0, 300.0, 50.0, 120.0, -250.0)]
PRISM_SQL = "pr(x1, x2, y1, y2, z1, z2, rho) AS (VALUES " + ", ".join(map(str, PRISMS)) + "), co AS (SELECT id, rho, CASE WHEN (a + b + c) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sg, CASE WHEN a = 0 THEN x1 ELSE x2 END - x AS dx, CASE WHEN b = 0 THEN y1 ELSE y2 END - y AS dy, CASE WHEN c = 0 THEN z1 ELSE z2 END AS dz FROM s, pr, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)), k AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) + 1e-9 AS r FROM co)"
LN = "ln(greatest({}, 1e-300))"


def _prisms(spark):
    return spark.createDataFrame(PRISMS, "x1 double, x2 double, y1 double, y2 double, z1 double, z2 double, rho double")


@C.add("prism_gravity", f"WITH {STATION_SQL}, {PRISM_SQL} SELECT id, round({G!r}::DOUBLE * 1e5 * sum(sg * rho * (dx * {LN.format('dy + r')} + dy * {LN.format('dx + r')} - dz * atan2(dx * dy, dz * r))), 6) + 0.0 AS effect FROM k GROUP BY id")
def prism_gravity(spark, d):
    s = stations(spark, d).select("id", "x", "y", F.lit(0.0).alias("z"))
    return P.prism_effects(s, _prisms(spark), "id", P.prism_gz, "rho").select("id", t("effect").alias("effect"))


_I, _D = math.radians(60), math.radians(10)
_F = (math.cos(_I) * math.cos(_D), math.cos(_I) * math.sin(_D), math.sin(_I))
_T = {"xx": "-atan2(dy * dz, dx * r)", "yy": "-atan2(dx * dz, dy * r)", "zz": "-atan2(dx * dy, dz * r)"}
MAG_SQL = " + ".join(
    [f"{-_F[a] * _F[a]!r}::DOUBLE * ({_T[n]})" for a, n in enumerate(("xx", "yy", "zz"))]
    + [f"{2 * _F[a] * _F[b]!r}::DOUBLE * {LN.format(v)}" for a, b, v in ((0, 1, "dz + r"), (0, 2, "dy + r"), (1, 2, "dx + r"))]
)


@C.add("prism_magnetic", f"WITH {STATION_SQL}, {PRISM_SQL} SELECT id, round(100 * sum(sg * rho / 1000 * ({MAG_SQL})), 5) + 0.0 AS effect FROM k GROUP BY id")
def prism_magnetic(spark, d):
    s = stations(spark, d).select("id", "x", "y", F.lit(0.0).alias("z"))
    p = _prisms(spark).withColumn("m", F.col("rho") / 1000)
    f = lambda x, y, z, c: P.prism_magnetic(x, y, z, c, 60.0, 10.0)
    return P.prism_effects(s, p, "id", f, "m").select("id", t("effect", 5).alias("effect"))


@C.add("heat_flow", f"WITH {GRID_SQL} SELECT i, j, round((2.5 * 565 / (value * 20) + 1e-6 * value * 20 / 2) * 1000, 6) + 0.0 AS q FROM g")
def heat_flow(spark, d):
    return grid(spark, d).select("i", "j", t(P.heat_flow(F.col("value") * 20, production=1.0)).alias("q"))


RADIO = "SELECT well, seq, phi * 20 AS k, gr / 40 AS u, rt / 5 AS th FROM w"


NINE = "round({}, 9) + 0.0 AS {}"
GAMMA_SQL = ", ".join(NINE.format(e, n) for n, e in {"u_k": "u / greatest(k, 1e-6)", "th_k": "th / greatest(k, 1e-6)", "u_th": "u / greatest(th, 1e-6)", "f_parameter": "k * u / greatest(th, 1e-6)", "dose_rate": "13.078 * k + 5.675 * u + 2.494 * th"}.items())


@C.add("gamma_spec", f"WITH {WELL_SQL}, r AS ({RADIO}) SELECT well, seq, {GAMMA_SQL} FROM r")
def gamma_spec(spark, d):
    w = wells(spark, d).select("well", "seq", (F.col("phi") * 20).alias("k"), (F.col("gr") / 40).alias("u"), (F.col("rt") / 5).alias("th"))
    g = P.gamma_spectrometry(w, "k", "u", "th")
    return g.select("well", "seq", *[t(c, 9).alias(c) for c in ("u_k", "th_k", "u_th", "f_parameter", "dose_rate")])


@C.add("heat_prod_table", f"WITH {WELL_SQL}, r AS ({RADIO}) SELECT well, seq, round(0.0267 * (9.52 * u + 2.56 * th + 3.48 * k), 6) + 0.0 AS a FROM r")
def heat_prod_table(spark, d):
    return wells(spark, d).select("well", "seq", t(P.heat_production(F.col("phi") * 20, F.col("gr") / 40, F.col("rt") / 5)).alias("a"))


@C.add("heat_prod", f"WITH {GRID_SQL} SELECT i, j, round(0.0267 * (9.52 * band + 2.56 * zone + 3.48 * value / 1000), 6) + 0.0 AS a FROM g")
def heat_prod(spark, d):
    return grid(spark, d).select("i", "j", t(P.heat_production(F.col("value") / 1000, F.col("band"), F.col("zone"))).alias("a"))


@C.add("vsh_gr", f"WITH {WELL_SQL}, q AS (SELECT well, quantile_cont(gr, 0.05) AS a, quantile_cont(gr, 0.95) AS b FROM w GROUP BY well), g AS (SELECT well, seq, greatest(least((gr - a) / greatest(b - a, 1e-12), 1), 0) AS igr FROM w JOIN q USING (well)) SELECT well, seq, {rnd(igr='igr', vsh='greatest(least(0.083 * (pow(2, 3.7 * igr) - 1), 1), 0)')} FROM g")
def vsh_gr(spark, d):
    return _tidied(P.shale_volume(wells(spark, d), ["well"], "gr", method="larionov_tertiary").select("well", "seq", "igr", "vsh"), ["well", "seq"])


@C.add("archie", f"WITH {WELL_SQL}, a AS (SELECT well, seq, rt, greatest(least(phi, 1), 1e-4) AS p FROM w), b AS (SELECT *, 0.05 / pow(p, 2) AS ro FROM a), c AS (SELECT *, greatest(least(sqrt(ro / rt), 1), 0) AS sw FROM b) SELECT well, seq, {rnd(ro='ro', sw='sw', sh='1 - sw', bvw='p * sw')} FROM c")
def archie(spark, d):
    return _tidied(P.archie(wells(spark, d), "rt", "phi").select("well", "seq", "ro", "sw", "sh", "bvw"), ["well", "seq"])


@C.add("dn", f"WITH {WELL_SQL}, a AS (SELECT well, seq, rhob, phi * 100 / 100 AS n, (2.65 - rhob) / 1.65 AS phid FROM w), b AS (SELECT *, n < phid - 0.02 AS gas, CASE WHEN n < phid - 0.02 THEN sqrt((n * n + phid * phid) / 2) ELSE (n + phid) / 2 END AS p FROM a), c AS (SELECT *, (rhob - p) / (1 - p) AS ma FROM b), l AS (SELECT unnest(['sandstone', 'limestone', 'dolomite', 'anhydrite', 'halite']) AS name, unnest([2.65, 2.71, 2.87, 2.98, 2.03])::DOUBLE AS v) SELECT well, seq, {rnd(phid='any_value(phid)', phi='greatest(least(any_value(p), 0.5), 0)', rho_ma='any_value(ma)')}, any_value(gas) AS gas, min_by(name, (abs(ma - v), name)) AS lithology FROM c, l GROUP BY well, seq")
def dn(spark, d):
    w = wells(spark, d).withColumn("nphi", F.col("phi") * 100)
    return _tidied(P.density_neutron(w, ["well"], "rhob", "nphi").select("well", "seq", "phid", "phi", "rho_ma", "gas", "lithology"), ["well", "seq", "gas", "lithology"])


CS_SQL = f"{SECTION_SQL}, c AS (SELECT trace, k, k + 1.0 AS f, 0.2 * pow((1 + abs(amp)) / 0.05, 2) / (k + 1.0) AS rho FROM tr), n AS (SELECT *, ln(1 / f) AS x, ln(rho) AS y FROM c), h AS (SELECT *, x - lag(x) OVER w AS hl, lead(x) OVER w - x AS hr, y - lag(y) OVER w AS dl, lead(y) OVER w - y AS dr FROM n WINDOW w AS (PARTITION BY trace ORDER BY 1 / f)), m AS (SELECT *, greatest(least(CASE WHEN hl IS NULL THEN dr / hr WHEN hr IS NULL THEN dl / hl ELSE (hl * hl * dr + hr * hr * dl) / (hl * hr * (hl + hr)) END, 0.99), -0.99) AS m FROM h)"


@C.add("csamt", f"WITH {CS_SQL} SELECT trace, k, {rnd(rho='rho', skin_depth='503 * sqrt(rho / f)', bostick_rho='rho * (1 + m) / (1 - m)', bostick_depth=f'sqrt(rho / ({2 * math.pi * MU0!r}::DOUBLE * f))')}, 5000 > 4 * 503 * sqrt(rho / f) AS far_field FROM m")
def csamt(spark, d):
    s = section(spark, d).select("trace", "k", (F.col("k") + 1.0).alias("f"), (1 + F.abs("amp")).alias("ex"), F.lit(0.05).alias("hy"))
    return _tidied(P.csamt(s, ["trace"], "f", "ex", "hy").drop("f", "ex", "hy"), ["trace", "k", "far_field"])


TEM_SQL = f"{SECTION_SQL}, v AS (SELECT trace, k, 1e-5 * pow(1.1, k) AS t, 1e-6 * exp(-0.1 * k) * (1 + abs(amp)) AS v FROM tr), r AS (SELECT *, {MU0 / (4 * math.pi)!r}::DOUBLE / t * pow({2 * MU0 * 1e4 / 5!r}::DOUBLE / (t * v), 2.0 / 3) AS rho, row_number() OVER (PARTITION BY trace ORDER BY k DESC) <= 6 AS late FROM v), f AS (SELECT trace, regr_slope(ln(v), t) AS s, regr_slope(ln(v), ln(t)) AS p FROM r WHERE late GROUP BY trace)"


@C.add("tem", f"WITH {TEM_SQL} SELECT r.trace, k, {rnd(rho='rho', diffusion_depth=f'sqrt(2 * rho * t / {MU0!r}::DOUBLE)', power='p')}, round(-1 / s, 9) + 0.0 AS decay_constant FROM r JOIN f USING (trace)")
def tem(spark, d):
    s = section(spark, d).select("trace", "k", (1e-5 * F.pow(F.lit(1.1), F.col("k"))).alias("t"), (1e-6 * F.exp(-0.1 * F.col("k")) * (1 + F.abs("amp"))).alias("v"))
    r = P.late_time_tem(s, ["trace"], "k", "t", "v")
    return r.select("trace", "k", t("rho").alias("rho"), t("diffusion_depth").alias("diffusion_depth"), t("power").alias("power"), t("decay_constant", 9).alias("decay_constant"))


@C.add("aem_cdt", f"WITH {SECTION_SQL}, v AS (SELECT trace, 1e-5 * pow(1.1, k) AS t, 1e-3 * exp(-0.1 * k) AS v FROM tr), r AS (SELECT *, {MU0 / (4 * math.pi)!r}::DOUBLE / t * pow({2 * MU0 * 5e5 / 5!r}::DOUBLE / (t * v), 2.0 / 3) AS rho FROM v), q AS (SELECT trace, 0.707 * sqrt(2 * rho * t / {MU0!r}::DOUBLE) AS z, 1 / rho AS sg FROM r), a AS (SELECT trace, min(z) AS a, max(z) AS b FROM q GROUP BY trace), d AS (SELECT trace, a, b, n * 2.0::DOUBLE AS z FROM a, (SELECT unnest(range(151)) AS n)), l AS (SELECT d.trace, d.z, max_by(struct_pack(z := q.z, s := sg), q.z) FILTER (WHERE q.z <= d.z) AS lo, min_by(struct_pack(z := q.z, s := sg), q.z) FILTER (WHERE q.z >= d.z) AS hi FROM d JOIN q USING (trace) WHERE d.z BETWEEN a AND b GROUP BY 1, 2) SELECT trace, z AS depth, round(CASE WHEN lo.z = hi.z THEN lo.s ELSE lo.s + (hi.s - lo.s) * (z - lo.z) / (hi.z - lo.z) END, 9) + 0.0 AS sigma FROM l")
def aem_cdt(spark, d):
    s = section(spark, d).select("trace", (1e-5 * F.pow(F.lit(1.1), F.col("k"))).alias("t"), (1e-3 * F.exp(-0.1 * F.col("k"))).alias("v"))
    return P.conductivity_depth(s, ["trace"], "t", "v", step=2.0).filter("sigma IS NOT NULL").select("trace", "depth", t("sigma", 9).alias("sigma"))


_W = 2 * math.pi * 9800


@C.add("fdem", f"WITH {GRID_SQL}, a AS (SELECT i, j, 4 * band * 1e-3 / {_W * MU0 * 3.66**2!r}::DOUBLE AS s FROM g) SELECT i, j, {rnd(sigma='s', induction_number=f'3.66 * sqrt({_W * MU0 / 2!r}::DOUBLE * s)')}, 3.66 * sqrt({_W * MU0 / 2!r}::DOUBLE * s) < 0.3 AS low_induction FROM a")
def fdem(spark, d):
    return _tidied(P.fdem(grid(spark, d), "band").select("i", "j", "sigma", "induction_number", "low_induction"), ["i", "j", "low_induction"])


MT_SQL = f"{SECTION_SQL}, a AS (SELECT trace, k, {2 * math.pi * MU0!r}::DOUBLE * (k + 1) AS wm, 50 + 100 * abs(amp) AS r1, 10 + off AS r2, 200.0::DOUBLE AS h FROM tr), b AS (SELECT *, sqrt(wm * r1 / 2) AS z1, sqrt(wm * r2 / 2) AS z2, sqrt(wm / (2 * r1)) * h AS g FROM a), c AS (SELECT *, CASE WHEN g > 20 THEN 1 ELSE sinh(2 * g) / (cosh(2 * g) + cos(2 * g)) END AS ta, CASE WHEN g > 20 THEN 0 ELSE sin(2 * g) / (cosh(2 * g) + cos(2 * g)) END AS tb FROM b), d AS (SELECT *, z2 + z1 * (ta - tb) AS na, z2 + z1 * (ta + tb) AS nb, z1 + z2 * ta - z2 * tb AS da, z1 + z2 * tb + z2 * ta AS db FROM c), e AS (SELECT *, (na * da + nb * db) / (da * da + db * db) AS qa, (nb * da - na * db) / (da * da + db * db) AS qb FROM d), f AS (SELECT *, z1 * (qa - qb) AS re, z1 * (qa + qb) AS im FROM e)"


@C.add("mt_layers", f"WITH {MT_SQL} SELECT trace, k, {rnd(rho_a='(re * re + im * im) / wm', phase='degrees(atan2(im, re))')} FROM f")
def mt_layers(spark, d):
    s = section(spark, d).select("trace", "k", (F.col("k") + 1.0).alias("f"), F.array(50 + 100 * F.abs("amp"), 10 + F.col("off")).alias("rho"), F.array(F.lit(200.0)).alias("thick"))
    return _tidied(P.mt_layers(s, "f", "rho", "thick").select("trace", "k", "rho_a", "phase"), ["trace", "k"])


AVO_SQL = "m AS (SELECT p_partkey AS id, 2400.0 + p_size AS vp1, 1200.0 + p_size * 2 AS vs1, 2300.0 AS rho1, 1300 + p_retailprice AS vp2, 1400.0 AS vs2, 2100.0 + p_size * 3 AS rho2 FROM part), a AS (SELECT *, n * 5.0 AS an FROM m, (SELECT unnest(range(9)) AS n)), b AS (SELECT *, (vp1 + vp2) / 2 AS vp, (vs1 + vs2) / 2 AS vs, (rho1 + rho2) / 2 AS rho, pow(sin(radians(an)), 2) AS s2 FROM a), c AS (SELECT *, 0.5 * ((vp2 - vp1) / vp + (rho2 - rho1) / rho) + (0.5 * (vp2 - vp1) / vp - 4 * (vs / vp) * (vs / vp) * (vs2 - vs1) / vs - 2 * (vs / vp) * (vs / vp) * (rho2 - rho1) / rho) * s2 + 0.5 * (vp2 - vp1) / vp * pow(tan(radians(an)), 2) * s2 AS r FROM b)"


@C.add("avo_model", f"WITH {AVO_SQL}, f AS (SELECT id, regr_intercept(r, s2) AS a, regr_slope(r, s2) AS b FROM c GROUP BY id) SELECT id, {rnd(intercept='a', gradient='b')}, CASE WHEN a > 0.02 THEN CASE WHEN b < 0 THEN 'I' ELSE 'none' END WHEN a BETWEEN -0.02 AND 0.02 THEN 'II' WHEN b < 0 THEN 'III' ELSE 'IV' END AS class FROM f")
def avo_model(spark, d):
    p = table(spark, d, "part")
    m = p.select(F.col("p_partkey").alias("id"), (2400.0 + F.col("p_size")).alias("vp1"), (1200.0 + F.col("p_size") * 2).alias("vs1"), F.lit(2300.0).alias("rho1"), (1300 + F.col("p_retailprice")).alias("vp2"), F.lit(1400.0).alias("vs2"), (2100.0 + F.col("p_size") * 3).alias("rho2"))
    a = m.withColumn("angle", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: n * F.lit(5.0))))
    a = a.withColumns({"r": P.aki_richards(a, "angle"), "s2": F.pow(F.sin(F.radians("angle")), F.lit(2.0))})
    f = a.groupBy("id").agg(F.regr_intercept("r", "s2").alias("a"), F.regr_slope("r", "s2").alias("b"))
    return f.select("id", t("a").alias("intercept"), t("b").alias("gradient"), P.avo_class(F.col("a"), F.col("b")).alias("class"))


@C.add("hyperbola_velocity", f"WITH {GRID_SQL} SELECT i, j, round(2 * band / (value * 1e-9) / 1e6, 6) + 0.0 AS v FROM g")
def hyperbola_velocity(spark, d):
    return grid(spark, d).select("i", "j", t(P.hyperbola_velocity(F.col("band"), F.col("value") * 1e-9) / 1e6).alias("v"))


PM_SQL = f"{WELL_SQL}, a AS (SELECT well, seq, 5.0::DOUBLE * seq AS x, 0.02 + 0.002 * seq + gr * 1e-6 AS tf, 0.02 + 0.002 * (1000 - seq) + rt * 1e-6 AS tr FROM w), b AS (SELECT well, max_by(tf, x) AS rt, 2 / regr_slope(tf - tr, x) AS v2 FROM a GROUP BY well)"


@C.add("plus_minus", f"WITH {PM_SQL} SELECT well, seq, round(v2, 4) AS v2, round((tf + tr - rt) * 500 / (2 * sqrt(1 - pow(500 / v2, 2))), 6) + 0.0 AS depth FROM a JOIN b USING (well)")
def plus_minus(spark, d):
    w = wells(spark, d).select("well", "seq", (5.0 * F.col("seq")).alias("x"), (0.02 + 0.002 * F.col("seq") + F.col("gr") * 1e-6).alias("tf"), (0.02 + 0.002 * (1000 - F.col("seq")) + F.col("rt") * 1e-6).alias("tr"))
    return P.plus_minus(w, ["well"], "x", "tf", "tr", 500.0).select("well", "seq", F.round("v2", 4).alias("v2"), t("depth").alias("depth"))


@C.add("magnetisation", f"WITH {GRID_SQL} SELECT i, j, round(band / 100 * 50000 * 1e-9 / {MU0!r}::DOUBLE, 6) + 0.0 AS m FROM g")
def magnetisation(spark, d):
    return grid(spark, d).select("i", "j", t(P.susceptibility_to_magnetisation(F.col("band") / 100, 50000.0)).alias("m"))


@C.add("grm")
def grm(spark, d):
    w = wells(spark, d).select("well", (5.0 * F.col("seq")).alias("x"), (0.02 + 0.002 * F.col("seq") + F.col("gr") * 1e-6).alias("tf"), (0.02 + 0.002 * (1000 - F.col("seq")) + F.col("rt") * 1e-6).alias("tr"))
    r = P.generalised_reciprocal(w, ["well"], "x", "tf", "tr", 500.0, [0.0, 10.0, 20.0, 30.0])
    return r.select("well", "xy", F.round("v2", 4).alias("v2"), "x", t("depth", 4).alias("depth"))


BODY = [("a", s, x, z) for s, (x, z) in enumerate([(200.0, 100.0), (700.0, 80.0), (620.0, 300.0), (310.0, 260.0)])]


@C.add("forward25d")
def forward25d(spark, d):
    body = spark.createDataFrame(BODY, "body string, seq int, x double, z double")
    prisms = P.body_columns(body, 25.0, 2000.0).withColumn("rho", F.lit(300.0))
    s = stations(spark, d).select("id", "x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return P.prism_effects(s, prisms, "id", P.prism_gz, "rho").select("id", t("effect").alias("effect"))


def _field_model(spark, d):
    """25 terms, one for each nation, at five epochs: an input like any other table of coefficients."""
    k = F.col("n_nationkey") + 1
    n = F.floor((F.sqrt(8.0 * k + 1) - 1) / 2).cast("int")
    m = (k - n * (n + 1) / 2).cast("int")
    c = table(spark, d, "nation").select(n.alias("n"), m.alias("m"), F.col("n_regionkey").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("e"))
    size = 30000.0 / F.pow(F.col("n").cast("double"), F.lit(3.0))
    return c.select((2000.0 + 5 * F.col("e")).alias("epoch"), "n", "m", (-size + 10 * F.col("e") + F.col("r")).alias("g"), (size / 3 - 4 * F.col("e") * F.col("r")).alias("h"))


FIELD_SQL = f"""WITH RECURSIVE {STATION_SQL}, k AS (SELECT n_nationkey + 1 AS k, n_regionkey AS r FROM nation), nm AS (SELECT floor((sqrt(8.0 * k + 1) - 1) / 2)::INT AS n, k, r FROM k), cf AS (SELECT n, (k - n * (n + 1) / 2)::INT AS m, r, 30000.0 / pow(n, 3) AS size FROM nm),
tm AS (SELECT row_number() OVER (ORDER BY g.m, g.n) AS t, g.n, g.m, r, size FROM (SELECT a.m, b.n FROM (SELECT unnest(range(7))::INT AS m) a, (SELECT unnest(range(7))::INT AS n) b WHERE b.n >= a.m) g LEFT JOIN cf ON cf.n = g.n AND cf.m = g.m),
st AS (SELECT id, radians(x * 0.36 - 180) AS lam, radians(y * 0.16 - 80) AS phi, value / 1000000 AS h, (2000 + id % 20 + 0.5 - 2000) / 5 AS e, value FROM s),
be AS (SELECT *, 6378.137::DOUBLE ** 2 / sqrt(6378.137::DOUBLE ** 2 * cos(phi) ** 2 + 6356.752314245::DOUBLE ** 2 * sin(phi) ** 2) AS bend FROM st),
xz AS (SELECT *, (bend + h) * cos(phi) AS px, (6356.752314245::DOUBLE ** 2 / 6378.137::DOUBLE ** 2 * bend + h) * sin(phi) AS pz FROM be),
rc AS (SELECT *, sqrt(px * px + pz * pz) AS r FROM xz), q AS (SELECT id, lam, e, value, r, pz / r AS c, px / r AS s FROM rc),
w AS (SELECT id, 0::BIGINT AS t, 0.0::DOUBLE AS pm, 0.0::DOUBLE AS dm, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS d2, 0.0::DOUBLE AS br, 0.0::DOUBLE AS bt, 0.0::DOUBLE AS bp FROM q
UNION ALL SELECT id, t, CASE WHEN n = m THEN p ELSE pm END, CASE WHEN n = m THEN dp ELSE dm END, p, dp, CASE WHEN n = m THEN 0 ELSE p1 END, CASE WHEN n = m THEN 0 ELSE d1 END,
  br + (n + 1) * f * (g * cos(m * lam) + hh * sin(m * lam)) * p, bt - f * (g * cos(m * lam) + hh * sin(m * lam)) * dp, bp + f * m * (g * sin(m * lam) - hh * cos(m * lam)) * p / s
FROM (SELECT *, CASE WHEN n = m AND m = 0 THEN 1 WHEN n = m THEN st * s * pm ELSE ((2 * n - 1) * c * p1 - sqrt(abs((n - 1) ** 2 - m ** 2)) * p2) / sqrt(n * n - m * m) END AS p,
    CASE WHEN n = m AND m = 0 THEN 0 WHEN n = m THEN st * (s * dm + c * pm) ELSE ((2 * n - 1) * (c * d1 - s * p1) - sqrt(abs((n - 1) ** 2 - m ** 2)) * d2) / sqrt(n * n - m * m) END AS dp
  FROM (SELECT w.*, tm.n, tm.m, lam, c, s, pow(6371.2 / q.r, n + 2) AS f, coalesce(-size + 10 * e + tm.r, 0) AS g, coalesce(size / 3 - 4 * e * tm.r, 0) AS hh, CASE WHEN m > 1 THEN sqrt((2 * m - 1) / (2.0 * m)) ELSE 1 END AS st
    FROM (SELECT id, t + 1 AS t, pm, dm, p1, d1, p2, d2, br, bt, bp FROM w) w JOIN tm USING (t) JOIN q USING (id))))"""


@C.add("igrf", FIELD_SQL + " SELECT w.id, round(sqrt(br * br + bt * bt + bp * bp), 4) AS main_field, round(q.value - sqrt(br * br + bt * bt + bp * bp), 4) + 0.0 AS magnetic_anomaly FROM w JOIN q USING (id) WHERE t = 28 AND e <= 4")
def igrf(spark, d):
    """The field of a model of degree 6 taken off stations; those after its last epoch have none."""
    s = stations(spark, d).select("id", (F.col("x") * 0.36 - 180).alias("lon"), (F.col("y") * 0.16 - 80).alias("lat"), F.col("value").alias("total_field"))
    r = P.magnetic_anomaly(s, _field_model(spark, d), height_m=F.col("total_field") / 1000, year=2000.5 + F.col("id") % 20)
    return r.filter("main_field IS NOT NULL").select("id", t("main_field", 4).alias("main_field"), t("magnetic_anomaly", 4).alias("magnetic_anomaly"))
