"""Queries of the moving-window solutions, searches, seismic moves and iterative operators (2.9), and their oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalar import tidy as t
from ..operators import contours as O
from ..operators import drainage as D
from ..operators import grids as G
from ..operators import iterate as I
from ..operators import joins as J
from ..operators import solutions as S
from .fixtures import DEPOSIT_SQL, GRID_SQL, SECTION_SQL, SERIES_SQL, Catalog, deposits, grid, section, series
from .grids import _tidied, rnd

C = Catalog()
TWO_PI = 2 * math.pi


@C.add("distance", f"WITH {GRID_SQL} SELECT c.i, c.j, round(min(100 * sqrt((c.i - o.i) ** 2 + (c.j - o.j) ** 2)), 6) + 0.0 AS distance FROM g c, g o WHERE o.band >= 45 GROUP BY c.i, c.j")
def distance(spark, d):
    return S.distance_to_features(grid(spark, d), F.col("band") >= 45, 100.0, 100.0).select("i", "j", t("distance").alias("distance"))


@C.add("buffer", f"WITH {GRID_SQL} SELECT c.i, c.j, min((c.i - o.i) ** 2 + (c.j - o.j) ** 2) <= 2.5 * 2.5 AS inside FROM g c, g o WHERE o.band >= 45 GROUP BY c.i, c.j")
def buffer(spark, d):
    return S.distance_to_features(grid(spark, d), F.col("band") >= 45, 100.0, 100.0).select("i", "j", (F.col("distance") <= 250.0).alias("inside"))


@C.add("buffer_pts", f"WITH {GRID_SQL}, dep AS (SELECT ((s_suppkey * 613) % 5000)::DOUBLE AS x, ((s_suppkey * 389) % 4000)::DOUBLE AS y FROM supplier) SELECT DISTINCT i, j FROM g, dep WHERE (g.x - dep.x) ** 2 + (g.y - dep.y) ** 2 <= 90000")
def buffer_pts(spark, d):
    from ..operators.joins import radius_join

    cells = grid(spark, d).select((F.col("i") * 1000 + F.col("j")).alias("cell"), "x", "y")
    hit = radius_join(deposits(spark, d), cells, 300.0, "id", "cell").select("cell").distinct()
    return hit.select(F.floor(F.col("cell") / 1000).cast("int").alias("i"), (F.col("cell") % 1000).cast("int").alias("j"))


MEMBER_SQL = "m AS (SELECT i, j, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS a, (band - min(band) OVER ()) / (max(band) OVER () - min(band) OVER ()) AS b, (zone - min(zone) OVER ()) / (max(zone) OVER () - min(zone) OVER ()) AS c FROM g)"


@C.add("fuzzy", f"WITH {GRID_SQL}, {MEMBER_SQL} SELECT i, j, {rnd(low='least(a, b, c)', high='greatest(a, b, c)', gamma='pow(1 - (1 - a) * (1 - b) * (1 - c), 0.9) * pow(a * b * c, 0.1)')} FROM m")
def fuzzy(spark, d):
    m = S.membership(grid(spark, d), ["value", "band", "zone"])
    v = [F.col(f"{c}_m") for c in ("value", "band", "zone")]
    return m.select("i", "j", t(S.fuzzy(v, "and")).alias("low"), t(S.fuzzy(v, "or")).alias("high"), t(S.fuzzy(v, "gamma")).alias("gamma"))


AHP = [[1.0, 3.0, 5.0], [1 / 3, 1.0, 2.0], [1 / 5, 1 / 2, 1.0]]
AHP_W = S.ahp_weights(AHP)[0]


@C.add("ahp", f"WITH {GRID_SQL}, {MEMBER_SQL} SELECT i, j, round({AHP_W[0]!r} * a + {AHP_W[1]!r} * b + {AHP_W[2]!r} * c, 6) + 0.0 AS suitability FROM m")
def ahp(spark, d):
    m = S.membership(grid(spark, d), ["value", "band", "zone"])
    w, _ = S.ahp_weights(AHP)
    total = sum((F.col(f"{c}_m") * x for c, x in zip(("value", "band", "zone"), w, strict=True)), F.lit(0.0))
    return m.select("i", "j", t(total).alias("suitability"))


NMO_SQL = f"{SECTION_SQL}, a AS (SELECT trace, k, cmp, k * 0.004 AS t0, sqrt(k * 0.004 * k * 0.004 + pow(off / 2500, 2)) AS t, off FROM tr), b AS (SELECT *, floor(t / 0.004)::INT AS q, t / 0.004 - floor(t / 0.004) AS f, CASE WHEN t0 > 0 THEN (t - t0) / t0 > 0.5 ELSE off > 0 END AS m FROM a), n AS (SELECT b.trace, b.k, b.cmp, CASE WHEN m THEN 0 ELSE coalesce(CASE WHEN f = 0 THEN u.amp ELSE u.amp + (v.amp - u.amp) * f END, 0) END AS nmo FROM b LEFT JOIN tr u ON u.trace = b.trace AND u.k = q LEFT JOIN tr v ON v.trace = b.trace AND v.k = q + 1)"


@C.add("nmo", f"WITH {NMO_SQL} SELECT trace, k, round(nmo, 6) + 0.0 AS nmo FROM n")
def nmo(spark, d):
    return S.nmo(section(spark, d), ["trace"], "k", "off", "amp", 0.004, 2500.0).select("trace", "k", t("nmo").alias("nmo"))


@C.add("stack", f"WITH {NMO_SQL} SELECT cmp, k, round(sum(nmo) / greatest(count(*) FILTER (WHERE nmo <> 0), 1), 6) + 0.0 AS stack FROM n GROUP BY cmp, k")
def stack(spark, d):
    n = S.nmo(section(spark, d), ["trace", "cmp"], "k", "off", "amp", 0.004, 2500.0)
    return S.cmp_stack(n, ["cmp"], "k", "nmo").select("cmp", "k", t("stack").alias("stack"))


KIR_SQL = f"{SECTION_SQL}, h AS (SELECT DISTINCT trace, 40.0 * trace - off / 2 AS sx, 40.0 * trace + off / 2 AS rx FROM tr), im AS (SELECT DISTINCT trace // 5 AS image, (trace // 5) * 200.0 AS x FROM tr), q AS (SELECT image, trace, k, sqrt(pow(k * 0.002, 2) + pow((sx - x) / 2000, 2)) + sqrt(pow(k * 0.002, 2) + pow((rx - x) / 2000, 2)) AS t FROM h, im, (SELECT unnest(range(64)) AS k) WHERE abs((sx + rx) / 2 - x) <= 400), p AS (SELECT *, floor(t / 0.004)::INT AS b, t / 0.004 - floor(t / 0.004) AS f FROM q)"


@C.add("prestm", f"WITH {KIR_SQL} SELECT image, p.k::INT AS k, round(sum((CASE WHEN f = 0 THEN u.amp ELSE u.amp + (v.amp - u.amp) * f END) * CASE WHEN t > 0 THEN p.k * 0.004 / t ELSE 0 END), 6) + 0.0 AS migrated FROM p JOIN tr u ON u.trace = p.trace AND u.k = b LEFT JOIN tr v ON v.trace = p.trace AND v.k = b + 1 WHERE f = 0 OR v.amp IS NOT NULL GROUP BY image, p.k")
def prestm(spark, d):
    s = section(spark, d).select("trace", (40.0 * F.col("trace") - F.col("off") / 2).alias("sx"), (40.0 * F.col("trace") + F.col("off") / 2).alias("rx"), "k", "amp")
    images = s.select(F.floor(F.col("trace") / 5).alias("image")).distinct().withColumn("x", F.col("image") * 200.0)
    return S.kirchhoff_time(s, images, "k", "amp", 0.004, 2000.0, 400.0, 64).select("image", F.col("k").cast("int").alias("k"), t("migrated").alias("migrated"))


FOCAL_SQL = f"""{SERIES_SQL}, o AS (SELECT station, radians(((k * 37) % 360)::DOUBLE) AS a, radians(((k * 13) % 85 + 3)::DOUBLE) AS i, CASE WHEN value >= 50 THEN 1 ELSE -1 END AS p FROM e),
y AS (SELECT station, p, sin(i) * cos(a) AS g1, sin(i) * sin(a) AS g2, cos(i) AS g3, count(*) AS w FROM o GROUP BY ALL),
c AS (SELECT strike, dip, rake, radians(strike) AS s, radians(dip) AS d, radians(rake) AS r FROM (SELECT unnest(range(0, 360, 5))::DOUBLE AS strike), (SELECT unnest(range(5, 91, 5))::DOUBLE AS dip), (SELECT unnest(range(-180, 180, 10))::DOUBLE AS rake)),
v AS (SELECT strike, dip, rake, -sin(d) * sin(s) AS n1, sin(d) * cos(s) AS n2, -cos(d) AS n3, cos(r) * cos(s) + cos(d) * sin(r) * sin(s) AS s1, cos(r) * sin(s) - cos(d) * sin(r) * cos(s) AS s2, -sin(r) * sin(d) AS s3 FROM c),
f AS (SELECT station, strike, dip, rake, p, w, (g1 * n1 + g2 * n2 + g3 * n3) * (g1 * s1 + g2 * s2 + g3 * s3) AS amp FROM y, v),
m AS (SELECT station, strike, dip, rake, sum(CASE WHEN (CASE WHEN abs(amp) < 1e-9 THEN 0 ELSE sign(amp) END) <> p THEN w ELSE 0 END) / sum(w) AS misfit FROM f GROUP BY 1, 2, 3, 4)"""


@C.add("focal", f"WITH {FOCAL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY misfit, strike, dip, rake)::INT AS rank FROM m) SELECT station, strike, dip, rake, round(misfit, 6) + 0.0 AS misfit, rank FROM n WHERE rank <= 20")
def focal(spark, d):
    e = series(spark, d).select("station", (F.col("k") * 37 % 360).cast("double").alias("az"), (F.col("k") * 13 % 85 + 3).cast("double").alias("takeoff"), F.when(F.col("value") >= 50, 1).otherwise(-1).alias("p"))
    return S.focal_mechanisms(e, "station", "az", "takeoff", "p").select("station", "strike", "dip", "rake", t("misfit").alias("misfit"), "rank")


def _search_sql(head: str, data: str, models: list[tuple], axes: dict[str, S.Axis], rows: str, sums: str, rounds: int) -> str:
    """CTEs of a search by S.best_models(); best{rounds} is (trace, the axes, a, rms).

    data(trace, ...) is held against the models by rows, a select list over both; sums gives a and rms of them.
    """
    names = ", ".join(axes)
    out = [head, f"m0({names}) AS (VALUES {', '.join(map(str, models))})", f"c0 AS (SELECT DISTINCT trace, {names} FROM {data}, m0)"]
    for r in range(rounds + 1):
        if r:
            at = lambda n, a: f"{n} * pow({a.step ** 0.5**r!r}::DOUBLE, o_{n})" if a.factor else f"{n} + o_{n} * {a.step * 0.5**r!r}::DOUBLE"  # noqa: B023, E731
            moves = ", ".join(f"(SELECT unnest([-1, 0, 1]) AS o_{n})" for n in axes)
            out.append(f"c{r} AS (SELECT DISTINCT trace, {', '.join(f'least(greatest({at(n, a)}, {a.low!r}::DOUBLE), {a.high!r}::DOUBLE) AS {n}' for n, a in axes.items())} FROM best{r - 1}, {moves})")
        out.append(f"r{r} AS (SELECT trace, {names}, {sums} FROM (SELECT trace, {names}, {rows} FROM {data} JOIN c{r} USING (trace)) GROUP BY trace, {names})")
        out.append(f"best{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY rms, {names}) AS n FROM r{r}) WHERE n = 1)")
    return ", ".join(out)


#: The reach and the first step of each parameter; two rounds of half steps follow the table of models.
ROUNDS = 2
PROJECTED = "sum(amp * b) / sum(b * b) AS a, sqrt(greatest(sum(amp * amp) - sum(amp * b) ** 2 / sum(b * b), 0) / count(*)) AS rms"
SP_C = [(float(x), float(z), float(a)) for x in (10, 20, 30, 40, 50) for z in (3, 8, 15) for a in (20, 60, 110)]
SP_AXES = {"x0": S.Axis(10.0, 0.0, 63.0), "depth": S.Axis(5.0, 1.0, 40.0), "angle": S.Axis(40.0, 0.0, 180.0)}
SP_SQL = _search_sql(SECTION_SQL, "tr", SP_C, SP_AXES, "amp, ((k - x0) * cos(radians(angle)) + depth * sin(radians(angle))) / pow((k - x0) ** 2 + depth * depth, 1.5) AS b", PROJECTED, ROUNDS)


@C.add("sp_model", f"WITH {SP_SQL} SELECT trace, x0::DOUBLE AS x0, depth::DOUBLE AS depth, angle::DOUBLE AS angle, round(a, 5) + 0.0 AS amplitude, round(rms, 6) + 0.0 AS rms FROM best{ROUNDS}")
def sp_model(spark, d):
    c = spark.createDataFrame(SP_C, "x0 double, depth double, angle double")
    r = S.sp_bodies(section(spark, d), c, ["trace"], "k", "amp", 1.5, SP_AXES, ROUNDS)
    return r.select("trace", "x0", "depth", "angle", t("amplitude", 5).alias("amplitude"), t("rms").alias("rms"))


SA_C = [(float(x), float(z), q) for x in (10, 20, 30, 40, 50) for z in (3, 8, 15) for q in (0.5, 1.0, 1.5)]
SA_AXES = {"x0": S.Axis(10.0, 0.0, 63.0), "depth": S.Axis(5.0, 1.0, 40.0), "q": S.Axis(0.5, 0.5, 1.5)}
SA_SQL = _search_sql(SECTION_SQL, "tr", SA_C, SA_AXES, "amp, depth / pow((k - x0) ** 2 + depth * depth, q) AS b", PROJECTED, ROUNDS)


@C.add("sa", f"WITH {SA_SQL} SELECT trace, x0::DOUBLE AS x0, depth::DOUBLE AS depth, q::DOUBLE AS q, round(a, 5) + 0.0 AS amplitude, round(rms, 6) + 0.0 AS rms FROM best{ROUNDS}")
def sa(spark, d):
    c = spark.createDataFrame(SA_C, "x0 double, depth double, q double")
    r = S.gravity_bodies(section(spark, d), c, ["trace"], "k", "amp", SA_AXES, ROUNDS)
    return r.select("trace", "x0", "depth", "q", t("amplitude", 5).alias("amplitude"), t("rms").alias("rms"))


SIP_C = [(m, tau, c) for m in (0.1, 0.3, 0.6) for tau in (0.01, 0.1, 1.0) for c in (0.3, 0.6)]
SIP_AXES = {"m": S.Axis(0.3, 0.0, 0.95), "tau": S.Axis(10.0, 1e-4, 1e3, True), "c": S.Axis(0.3, 0.1, 1.0)}
SIP_HEAD = f"{SECTION_SQL}, sp AS (SELECT trace, v * cos(ph / 1000) AS dr, v * sin(ph / 1000) AS di, f FROM (SELECT trace, 100 + 50 * amp AS v, -20 - 30 * abs(amp) AS ph, 0.1 * (k + 1) AS f FROM tr))"
_SIP_W = f"pow({TWO_PI!r} * f * tau, c)"
_SIP_P, _SIP_Q = f"(1 + {_SIP_W} * cos(c * {math.pi / 2!r}))", f"({_SIP_W} * sin(c * {math.pi / 2!r}))"
_SIP_S = f"({_SIP_P} * {_SIP_P} + {_SIP_Q} * {_SIP_Q})"
SIP_SQL = _search_sql(SIP_HEAD, "sp", SIP_C, SIP_AXES, f"dr, di, 1 - m * (1 - {_SIP_P} / {_SIP_S}) AS re, -m * {_SIP_Q} / {_SIP_S} AS im", "sum(dr * re + di * im) / sum(re * re + im * im) AS a, sqrt(greatest(sum(dr * dr + di * di) - pow(sum(dr * re + di * im), 2) / sum(re * re + im * im), 0) / count(*)) AS rms", ROUNDS)


@C.add("sip", f"WITH {SIP_SQL} SELECT trace, round(m, 9)::DOUBLE AS m, round(tau, 9)::DOUBLE AS tau, round(c, 9)::DOUBLE AS c, round(a, 5) + 0.0 AS rho0, round(rms, 5) + 0.0 AS rms FROM best{ROUNDS}")
def sip(spark, d):
    c = spark.createDataFrame(SIP_C, "m double, tau double, c double")
    s = section(spark, d).select("trace", (100 + 50 * F.col("amp")).alias("v"), (-20 - 30 * F.abs("amp")).alias("ph"), (0.1 * (F.col("k") + 1)).alias("f"))
    r = S.cole_cole(s, c, ["trace"], "f", "v", "ph", SIP_AXES, ROUNDS)
    return r.select("trace", t("m", 9).alias("m"), t("tau", 9).alias("tau"), t("c", 9).alias("c"), t("rho0", 5).alias("rho0"), t("rms", 5).alias("rms"))


@C.add("ga")
def ga(spark, d):
    """Three layers to each trace, searched for in the whole space."""
    s = section(spark, d).select("trace", (F.col("k") + 1.0).alias("f"), (100 + 50 * F.col("amp")).alias("obs_rho"), (45 + 10 * F.col("amp")).alias("obs_phase"))
    r = S.layered_search(s, ["trace"], "f", "obs_rho", "obs_phase", 3, models=2048, keep=8, steps=15)
    return r.select("trace", *[t(F.col("layers_rho")[n], 4).alias(f"rho{n + 1}") for n in range(3)], *[t(F.col("layers_thick")[n], 4).alias(f"thick{n + 1}") for n in range(2)], t("misfit").alias("misfit"))


_READ = lambda p: f"(CASE WHEN {p} >= 63 THEN a[64] ELSE a[floor({p})::INT + 1] + (a[floor({p})::INT + 2] - a[floor({p})::INT + 1]) * ({p} - floor({p})) END)"
HK_SQL = f"{SECTION_SQL}, l AS (SELECT trace, list(amp ORDER BY k) AS a FROM tr GROUP BY trace), q AS (SELECT 20 + nh * 0.25::DOUBLE AS h, 1.6::DOUBLE + nk * 0.005::DOUBLE AS kappa, sqrt(1 / (6.3::DOUBLE * 6.3) - 0.0036) AS qp, sqrt(pow((1.6::DOUBLE + nk * 0.005::DOUBLE) / 6.3, 2) - 0.0036) AS qs FROM (SELECT unnest(range(161)) AS nh), (SELECT unnest(range(81)) AS nk)), p AS (SELECT h, kappa, 2 * h * (qs - qp) AS t1, 2 * h * (qs + qp) AS t2, 4 * h * qs AS t3 FROM q), s AS (SELECT trace, h, kappa, 0.7 * {_READ('t1')} + 0.2 * {_READ('t2')} - 0.1 * {_READ('t3')} AS stack FROM l, p), n AS (SELECT trace, max_by(struct_pack(h := h, kappa := kappa, stack := stack), stack) AS b FROM s GROUP BY trace)"


@C.add("hk", f"WITH {HK_SQL} SELECT trace, b.h AS h, round(b.kappa, 6) AS kappa, round(b.stack, 6) + 0.0 AS stack FROM n")
def hk(spark, d):
    r = S.h_kappa(section(spark, d), ["trace"], "k", "amp", 2.0, 6.3, 0.06)
    return r.select("trace", "h", t("kappa").alias("kappa"), t("stack").alias("stack"))


@C.add("werner")
def werner(spark, d):
    p = grid(spark, d).select("i", F.col("x").alias("distance"), (F.col("value") + 3 * F.col("band")).alias("v"))
    return _tidied(S.werner(p, ["i"], "distance", "v"), ["i"])


EULER_SQL = f"""WITH {GRID_SQL}, {DEPOSIT_SQL}, q AS (SELECT g.i, g.j, (g.x - dep.x) ** 2 + (g.y - dep.y) ** 2 + 22500 AS q FROM g JOIN dep ON (g.x - dep.x) ** 2 + (g.y - dep.y) ** 2 <= 2250000),
f AS (SELECT i, j, 1e6::DOUBLE * sum(150 / pow(q, 1.5)) AS v, 1e6::DOUBLE * sum(67500 / pow(q, 2.5) - 1 / pow(q, 1.5)) AS tz FROM q GROUP BY i, j),
n AS (SELECT i, j, v, tz, lag(v) OVER r AS l, lead(v) OVER r AS m, lag(v) OVER c AS b, lead(v) OVER c AS u, max(i) OVER () + 1 AS ny, max(j) OVER () + 1 AS nx FROM f WINDOW r AS (PARTITION BY i ORDER BY j), c AS (PARTITION BY j ORDER BY i)),
t AS (SELECT i, j, v, tz, ny, nx, CASE WHEN l IS NULL THEN (m - v) / 100 WHEN m IS NULL THEN (v - l) / 100 ELSE (m - l) / 200 END AS tx, CASE WHEN b IS NULL THEN (u - v) / 100 WHEN u IS NULL THEN (v - b) / 100 ELSE (u - b) / 200 END AS ty FROM n),
wi AS (SELECT *, unnest(range(greatest(ceil((i - 5) / 2.0), 0)::INT, least(i // 2, (ny - 6) // 2)::INT + 1)) AS wi FROM t), w AS (SELECT *, unnest(range(greatest(ceil((j - 5) / 2.0), 0)::INT, least(j // 2, (nx - 6) // 2)::INT + 1)) AS wj FROM wi),
e AS (SELECT *, (wj * 2 + 2.5) * 100 AS cx, (wi * 2 + 2.5) * 100 AS cy FROM w), y AS (SELECT *, (j * 100 - cx) * tx + (i * 100 - cy) * ty + 2 * v AS y FROM e),
s AS (SELECT wi, wj, cx, cy, count(*) AS n, var_pop(y) AS yy, var_pop(tx) AS a, covar_pop(tx, ty) AS b, covar_pop(tx, tz) AS c, var_pop(ty) AS d, covar_pop(ty, tz) AS e, var_pop(tz) AS f, covar_pop(tx, y) AS p, covar_pop(ty, y) AS q, covar_pop(tz, y) AS r FROM y GROUP BY wi, wj, cx, cy),
k AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s),
z AS (SELECT *, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS x0, (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det AS y0, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS z0 FROM k)"""


@C.add("euler", EULER_SQL + " SELECT wi::BIGINT AS wi, wj::BIGINT AS wj, round(cx + x0, 3) AS x, round(cy + y0, 3) AS y, round(z0, 3) AS depth FROM z WHERE z0 > 0 AND sqrt(greatest(yy - x0 * p - y0 * q - z0 * r, 0) / (n - 4) * (a * d - b * b) / det) / z0 <= 0.3 AND sqrt(x0 * x0 + y0 * y0) <= 900")
def euler(spark, d):
    """Depths of the point masses that make a field: one at each supplier, 150 m deep, felt within 1,500 m."""
    cells = grid(spark, d).select("grid_id", "i", "j", "x", "y", (F.col("i").cast("long") * 50 + F.col("j")).alias("cell"))
    near = J.radius_join(cells, deposits(spark, d), 1500.0, "cell", "id").withColumn("q", F.col("distance") * F.col("distance") + 150.0 * 150.0)
    field = near.groupBy("cell").agg((F.sum(150.0 / F.pow("q", F.lit(1.5))) * 1e6).alias("value"), (F.sum(3 * 150.0 * 150.0 / F.pow("q", F.lit(2.5)) - 1 / F.pow("q", F.lit(1.5))) * 1e6).alias("tz"))
    r = S.euler(cells.join(field, "cell").drop("cell"), 100.0, 100.0, 2.0, 6, 2, 0.3)
    return r.select("wi", "wj", *[t(c, 3).alias(c) for c in ("x", "y", "depth")])


@C.add("steepest", f"WITH {GRID_SQL}, nb AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS a, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS b, unnest(range(8)) AS n), x AS (SELECT c.i, c.j, c.i + a AS ti, c.j + b AS tj, (c.value - o.value) / (100 * sqrt(a * a + b * b)) AS dr, n FROM g c, nb, g o WHERE o.i = c.i + a AND o.j = c.j + b), y AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY dr DESC, n) AS r FROM x WHERE dr > 0) SELECT g.i, g.j, coalesce(ti, -1)::INT AS to_i, coalesce(tj, -1)::INT AS to_j FROM g LEFT JOIN y ON g.i = y.i AND g.j = y.j AND r = 1")
def steepest(spark, d):
    return S.steepest(grid(spark, d), 100.0, 100.0).select("i", "j", F.coalesce("to_i", F.lit(-1)).alias("to_i"), F.coalesce("to_j", F.lit(-1)).alias("to_j"))


DMO_SQL = f"""{SECTION_SQL}, h AS (SELECT DISTINCT trace, 40.0 * trace AS pos, off AS panel FROM tr), m AS (SELECT panel, min(pos) AS lo, max(pos) AS hi, count(*) AS c FROM h GROUP BY panel),
a AS (SELECT h.trace, h.panel, n, c, lo, hi, pos + (-h.panel / 2 + 2 * (h.panel / 2) * n / 20) AS p, sqrt(1 - pow((-h.panel / 2 + 2 * (h.panel / 2) * n / 20) / (h.panel / 2), 2)) AS f FROM h JOIN m USING (panel), (SELECT unnest(range(1, 20)) AS n)),
r AS (SELECT a.trace, f, o.trace AS target, row_number() OVER (PARTITION BY a.trace, n ORDER BY abs(o.pos - p), o.pos) AS r FROM a JOIN h o USING (panel) WHERE c > 1 AND p BETWEEN lo AND hi AND abs(o.pos - p) <= 480),
b AS (SELECT trace, target, k, k / f AS q FROM r, (SELECT unnest(range(64)) AS k) WHERE r = 1),
s AS (SELECT target, b.k, sum(CASE WHEN q = floor(q) THEN u.amp ELSE u.amp + (v.amp - u.amp) * (q - floor(q)) END) / 19 AS s FROM b JOIN tr u ON u.trace = b.trace AND u.k = floor(q) LEFT JOIN tr v ON v.trace = b.trace AND v.k = floor(q) + 1 WHERE q = floor(q) OR v.amp IS NOT NULL GROUP BY 1, 2)"""


@C.add("dmo", f"WITH {DMO_SQL} SELECT tr.trace, tr.k, round(CASE WHEN c > 1 THEN coalesce(s, 0) ELSE amp END, 6) + 0.0 AS dmo FROM tr JOIN m ON m.panel = tr.off LEFT JOIN s ON s.target = tr.trace AND s.k = tr.k")
def dmo(spark, d):
    s = section(spark, d).withColumn("pos", 40.0 * F.col("trace"))
    return S.dmo(s, "trace", "pos", "off", "k", "amp", 960.0).select("trace", "k", t("dmo").alias("dmo"))


def _velocities(spark, d):
    """The part grid as a depth model, 2000 to 5000 m/s."""
    return grid(spark, d).withColumn("value", 2000.0 + 60.0 * F.col("band"))


@C.add("travel_times")
def travel_times(spark, d):
    r = I.travel_times(_velocities(spark, d), (F.col("i") == 0) & (F.col("j") == 25), 100.0, 100.0)
    return r.select("i", "j", t("total").alias("time"))


@C.add("presdm")
def presdm(spark, d):
    """Depth images of the section's traces, dealt to 25 surface positions, through first arrivals of the model."""
    k = F.col("trace")
    s = section(spark, d).select("trace", (200.0 * (k % 25)).alias("sx"), (200.0 * (k * 7 % 25)).alias("rx"), "k", "amp")
    at = s.select(F.explode(F.array("sx", "rx")).alias("position")).distinct()
    end = 0.02 * (s.agg(F.max("k")).first()[0] or 0) * (1 + 1e-9)
    times = I.arrivals(_velocities(spark, d), at, 100.0, 100.0, end)
    return S.kirchhoff_depth(s, times, "k", "amp", 0.02, 1000.0).select("i", "j", t("migrated").alias("migrated"))


GCPS = [(0.0, 0.0, 500000.0, 200000.0), (49.0, 0.0, 500980.0, 200049.0), (0.0, 30.0, 499970.0, 200600.0), (49.0, 30.0, 500950.0, 200649.0), (20.0, 10.0, 500390.0, 200220.0)]
_FW, _BW = G.transform_fit(GCPS), G.transform_fit([(x, y, c, r) for c, r, x, y in GCPS])
_W = lambda k: f"({k[0]!r}::DOUBLE + {k[1]!r}::DOUBLE * j + {k[2]!r}::DOUBLE * i)"
_P = lambda k: f"({k[0]!r}::DOUBLE + {k[1]!r}::DOUBLE * x + {k[2]!r}::DOUBLE * y)"
GEO_SQL = f"""{GRID_SQL}, b AS (SELECT min({_W(_FW[0])}) AS x0, max({_W(_FW[0])}) AS x1, min({_W(_FW[1])}) AS y0, max({_W(_FW[1])}) AS y1, max(i) AS mi, max(j) AS mj FROM g),
n AS (SELECT gi::INT AS gi, gj::INT AS gj, x0 + gj * 25.0::DOUBLE AS x, y0 + gi * 25.0::DOUBLE AS y, mi, mj FROM b, LATERAL (SELECT unnest(range(ceil((y1 + 12.5 - y0) / 25.0)::INT)) AS gi), LATERAL (SELECT unnest(range(ceil((x1 + 12.5 - x0) / 25.0)::INT)) AS gj)),
u AS (SELECT *, {_P(_BW[0])} AS c, {_P(_BW[1])} AS r FROM n), q AS (SELECT *, least(floor(c)::INT, mj - 1) AS j0, least(floor(r)::INT, mi - 1) AS i0 FROM u WHERE c >= 0 AND r >= 0 AND c <= mj AND r <= mi)"""


@C.add("georef", f"WITH {GEO_SQL} SELECT gi, gj, round(q.x, 4) AS x, round(q.y, 4) AS y, round((1 - r + i0) * ((1 - c + j0) * a.value + (c - j0) * b.value) + (r - i0) * ((1 - c + j0) * e.value + (c - j0) * f.value), 4) + 0.0 AS value FROM q JOIN g a ON a.i = i0 AND a.j = j0 JOIN g b ON b.i = i0 AND b.j = j0 + 1 JOIN g e ON e.i = i0 + 1 AND e.j = j0 JOIN g f ON f.i = i0 + 1 AND f.j = j0 + 1")
def georef(spark, d):
    r = G.rectify(grid(spark, d).select("i", "j", "value"), GCPS, 25.0).filter("value IS NOT NULL")
    return r.select("gi", "gj", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), t("value", 4).alias("value"))


@C.add("lcp")
def lcp(spark, d):
    """The cheapest way across the grid."""
    cells = grid(spark, d).select("grid_id", "i", "j", F.col("band").alias("value"))
    last = cells.agg(F.max("i"), F.max("j")).first()
    return I.least_cost_path(cells, (0, 0), (last[0], last[1]), 100.0, 100.0).select("i", "j", t("total").alias("total"))


@C.add("viewshed")
def viewshed(spark, d):
    return S.viewshed(grid(spark, d), 2, 10, 100.0, 100.0, 60.0).select("i", "j", "visible")


def _small(spark, d):
    """A rough surface with a slope, so that the iterative operators have something to settle."""
    return grid(spark, d).withColumn("value", F.col("band") + F.col("i") * 3.0 + F.col("j") * 0.5).select("grid_id", "i", "j", "value")


@C.add("fill_depressions")
def fill_depressions(spark, d):
    return I.fill_depressions(_small(spark, d)).select("i", "j", t("filled").alias("filled"))


SMALL_SQL = f"WITH RECURSIVE {GRID_SQL}, z AS (SELECT i, j, band + i * 3.0 + j * 0.5 AS value FROM g), nb AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS a, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS b, unnest(range(8)) AS n), x AS (SELECT c.i, c.j, c.i + a AS ti, c.j + b AS tj, (c.value - o.value) / (100 * sqrt(a * a + b * b)) AS dr, n FROM z c, nb, z o WHERE o.i = c.i + a AND o.j = c.j + b), fl AS (SELECT i, j, ti, tj FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY dr DESC, n) AS r FROM x WHERE dr > 0) WHERE r = 1), way AS (SELECT i, j, i AS ci, j AS cj FROM z UNION ALL SELECT way.i, way.j, fl.ti, fl.tj FROM way JOIN fl ON fl.i = way.ci AND fl.j = way.cj)"


@C.add("watershed", f"{SMALL_SQL} SELECT ci AS i, cj AS j, count(*) AS cells_above, round(log10(count(*)), 6) AS accumulation FROM way GROUP BY ci, cj")
def watershed(spark, d):
    return D.flow_accumulation(_small(spark, d), 100.0, 100.0).select("i", "j", "cells_above", t(F.log10("cells_above")).alias("accumulation"))


@C.add("watershed_basin", f"{SMALL_SQL}, pours AS (SELECT i, j, i * 50 + j AS pour FROM g WHERE band = 1), hits AS (SELECT way.i, way.j, pour, z.value FROM way JOIN pours ON pours.i = ci AND pours.j = cj JOIN z ON z.i = ci AND z.j = cj) SELECT i, j, max_by(pour, value)::BIGINT AS basin FROM hits GROUP BY i, j")
def watershed_basin(spark, d):
    """The cells above each of the lowest cells, up to the next of them."""
    pours = grid(spark, d).filter("band = 1").select("grid_id", "i", "j", (F.col("i") * 50 + F.col("j")).alias("pour"))
    return D.basins(_small(spark, d), pours, 100.0, 100.0).select("i", "j", "basin")


@C.add("cost_distance")
def cost_distance(spark, d):
    """Least cost from the nearest tall cell."""
    cells = grid(spark, d).select("grid_id", "i", "j", F.col("band").alias("value"))
    return I.cost_distance(cells, F.col("value") >= 48, 100.0, 100.0).select("i", "j", t("total").alias("total"))


@C.add("lineaments")
def lineaments(spark, d):
    cells = G.ridges(grid(spark, d).select("grid_id", "i", "j", "x", "y", "value"), 100.0, 100.0)
    parts = I.connected_cells(cells, F.col("ridge"))
    return _tidied(I.lineaments(cells, parts, 4), ["grid_id", "component", "n"])


def _contour_sql(cells: str, levels: str, key: str) -> str:
    """Rows of ordered contours: crossings of block sides, links inside blocks, and each list walked from its head."""
    return f"""WITH RECURSIVE {GRID_SQL}, c AS ({cells}), n AS (SELECT max(j) + 1 AS w FROM g), lv AS (SELECT unnest({levels}::DOUBLE[]) AS level),
bl AS (SELECT a.{key}, a.i, a.j, a.x AS x0, b.x AS x1, a.y AS y0, e.y AS y1, a.value AS a, b.value AS b, d.value AS c, e.value AS e FROM c a JOIN c b ON b.{key} = a.{key} AND b.i = a.i AND b.j = a.j + 1 JOIN c e ON e.{key} = a.{key} AND e.i = a.i + 1 AND e.j = a.j JOIN c d ON d.{key} = a.{key} AND d.i = a.i + 1 AND d.j = a.j + 1),
sd AS (SELECT {key}, i, j, level, unnest([0, 1, 2, 3]) AS k, unnest([a, b, c, e]) AS p, unnest([b, c, e, a]) AS q, ((a + b + c + e) / 4 >= level) = (a >= level) AS joined,
  unnest([(i * w + j) * 2, (i * w + j + 1) * 2 + 1, ((i + 1) * w + j) * 2, (i * w + j) * 2 + 1]) AS "at",
  unnest([x0 + (x1 - x0) * (level - a) / (b - a), x1, x0 + (x1 - x0) * (level - e) / (c - e), x0]) AS px,
  unnest([y0, y0 + (y1 - y0) * (level - b) / (c - b), y1, y0 + (y1 - y0) * (level - a) / (e - a)]) AS py FROM bl, lv, n),
st AS (SELECT *, count(*) OVER (PARTITION BY {key}, i, j, level) AS two FROM sd WHERE p >= level AND q < level), en AS (SELECT * FROM sd WHERE p < level AND q >= level),
lk AS (SELECT s.{key}, s.level, s.at AS a, e.at AS b FROM st s JOIN en e ON e.{key} = s.{key} AND e.level = s.level AND e.i = s.i AND e.j = s.j AND (s.two = 1 OR e.k = CASE WHEN s.joined THEN xor(s.k, 1) ELSE 3 - s.k END)),
pt AS (SELECT {key}, level, "at", min(px) AS x, min(py) AS y FROM (SELECT * FROM st UNION ALL BY NAME SELECT * FROM en) GROUP BY {key}, level, "at"),
reach AS (SELECT {key}, level, a, b FROM lk UNION SELECT r.{key}, r.level, r.a, l.b FROM reach r JOIN lk l ON l.{key} = r.{key} AND l.level = r.level AND l.a = r.b),
heads AS (SELECT {key}, level, a AS head, false AS ring FROM lk l WHERE NOT EXISTS (SELECT 1 FROM lk o WHERE o.{key} = l.{key} AND o.level = l.level AND o.b = l.a) UNION ALL SELECT {key}, level, min(b), true FROM (SELECT *, bool_or(a = b) OVER (PARTITION BY {key}, level, a) AS r FROM reach) WHERE r GROUP BY {key}, level, a),
walk AS (SELECT DISTINCT {key}, level, head, ring, head AS "at", 0::BIGINT AS seq FROM heads UNION ALL SELECT w.{key}, w.level, head, ring, l.b, seq + 1 FROM walk w JOIN lk l ON l.{key} = w.{key} AND l.level = w.level AND l.a = w.at WHERE seq = 0 OR w.at <> head),
out AS (SELECT {key}, level, head::BIGINT AS line_id, seq, x, y, ring FROM walk JOIN pt USING ({key}, level, "at")),
ar AS (SELECT {key}, level, line_id, sum(x * ny - nx * y) / 2 AS area FROM (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM out WHERE ring WINDOW o AS (PARTITION BY {key}, level, line_id ORDER BY seq)) GROUP BY {key}, level, line_id)"""


@C.add("contour", _contour_sql("SELECT i, j, x, y, value, 0 AS one FROM g", "[910, 930]", "one") + " SELECT level, line_id, seq, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, ring FROM out")
def contour(spark, d):
    r = O.contour_lines(grid(spark, d).select("grid_id", "i", "j", "x", "y", "value"), [910.0, 930.0])
    return r.select("level", "line_id", "seq", t("x", 4).alias("x"), t("y", 4).alias("y"), "ring")


@C.add("ras2vec", _contour_sql("SELECT i, j, x, y, (zone = class)::DOUBLE AS value, class FROM g, (SELECT unnest(range(5))::DOUBLE AS class)", "[0.5]", "class") + " SELECT class, line_id, seq, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, ring, coalesce(area < 0, false) AS hole FROM out LEFT JOIN ar USING (class, level, line_id)")
def ras2vec(spark, d):
    r = O.class_outlines(grid(spark, d).select("grid_id", "i", "j", "x", "y", F.col("zone").alias("value")), [0.0, 1.0, 2.0, 3.0, 4.0])
    return r.select("class", "line_id", "seq", t("x", 4).alias("x"), t("y", 4).alias("y"), "ring", "hole")
