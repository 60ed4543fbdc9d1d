"""Queries of the profile, trace and log operators (2.3, 2.5, 2.6), and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import tidy as t
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import traces as T
from .fixtures import GRID_SQL, SECTION_SQL, SERIES_SQL, WELL_SQL, Catalog, grid, section, series, wells
from .grids import _tidied, rnd

C = Catalog()


@C.add("prof_avg", f"WITH {GRID_SQL}, o AS (SELECT unnest(range(-3, 3)) AS o) SELECT a.i, a.j, round(avg(b.value), 6) + 0.0 AS mean FROM g a, o, g b WHERE b.i = a.i AND b.j = least(greatest(a.j + o.o, 0), 49) GROUP BY a.i, a.j")
def prof_avg(spark, d):
    return T.running_mean(grid(spark, d), ["i"], "x", "value", 6).select("i", "j", t("mean").alias("mean"))


@C.add("prof_detrend", f"WITH {GRID_SQL}, f AS (SELECT i, regr_slope(value, x) AS s, regr_intercept(value, x) AS c FROM g GROUP BY i) SELECT i, j, {rnd(trend='c + s * x', residual='value - c - s * x')} FROM g JOIN f USING (i)")
def prof_detrend(spark, d):
    return _tidied(T.linear_trend(grid(spark, d), ["i"], "x", "value").select("i", "j", "trend", "residual"), ["i", "j"])


@C.add(
    "prof_poly",
    f"WITH {GRID_SQL}, a AS (SELECT i, avg(x) AS m, (max(x) - min(x)) / 2 AS r FROM g GROUP BY i), b AS (SELECT g.i, g.j, (x - m) / r AS t, value AS v FROM g JOIN a USING (i)), s AS (SELECT i, count(*)::DOUBLE AS s0, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(v) AS v0, sum(v*t) AS v1, sum(v*t*t) AS v2 FROM b GROUP BY i), c AS (SELECT i, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det, v0*(s2*s4-s3*s3) - s1*(v1*s4-s3*v2) + s2*(v1*s3-s2*v2) AS d0, s0*(v1*s4-s3*v2) - v0*(s1*s4-s3*s2) + s2*(s1*v2-v1*s2) AS d1, s0*(s2*v2-v1*s3) - s1*(s1*v2-v1*s2) + v0*(s1*s3-s2*s2) AS d2 FROM s) SELECT b.i, b.j, round((d0 + d1 * t + d2 * t * t) / det, 6) + 0.0 AS trend FROM b JOIN c USING (i)",
)
def prof_poly(spark, d):
    return T.quadratic_trend(grid(spark, d), ["i"], "x", "value").select("i", "j", t("trend").alias("trend"))


@C.add("prof_flip", f"WITH {GRID_SQL} SELECT i, 4900.0::DOUBLE - x AS distance, value FROM g")
def prof_flip(spark, d):
    return T.flip_profile(grid(spark, d).withColumn("distance", F.col("x")), ["i"], "distance").select("i", "distance", "value")


KNOTS_SQL = f"{SERIES_SQL}, q AS (SELECT station, min(t) AS a, max(t) AS b FROM e GROUP BY station)"


@C.add("prof_interp", f"WITH {KNOTS_SQL}, n AS (SELECT station, a, b, unnest(range(floor((b - a) / 5000 + 1e-9)::BIGINT + 1)) AS n FROM q), ax AS (SELECT station, a + n * 5000.0::DOUBLE AS t FROM n UNION ALL SELECT station, b FROM q WHERE a + floor((b - a) / 5000 + 1e-9) * 5000.0 < b - 5e-6), l AS (SELECT ax.station, ax.t, max_by(struct_pack(t := e.t, v := e.value), e.t) AS lo FROM ax JOIN e ON e.station = ax.station AND e.t <= ax.t GROUP BY 1, 2), h AS (SELECT ax.station, ax.t, min_by(struct_pack(t := e.t, v := e.value), e.t) AS hi FROM ax JOIN e ON e.station = ax.station AND e.t >= ax.t GROUP BY 1, 2) SELECT l.station, round(l.t, 3) AS t, round(CASE WHEN lo.t = hi.t THEN lo.v ELSE lo.v + (hi.v - lo.v) * (l.t - lo.t) / (hi.t - lo.t) END, 4) + 0.0 AS value FROM l JOIN h ON l.station = h.station AND l.t = h.t")
def prof_interp(spark, d):
    return T.resample(series(spark, d).select("station", "t", "value"), ["station"], "t", "value", 5000.0).select("station", F.round("t", 3).alias("t"), t("value", 4).alias("value"))


@C.add("asof_interpolate", f"WITH {SERIES_SQL}, k AS (SELECT station, t, value FROM e WHERE event_type <> 'error'), q AS (SELECT station, k, t FROM e WHERE event_type = 'error'), l AS (SELECT q.station, q.k, q.t, max_by(struct_pack(t := k.t, v := k.value), k.t) FILTER (WHERE k.t <= q.t) AS lo, min_by(struct_pack(t := k.t, v := k.value), k.t) FILTER (WHERE k.t >= q.t) AS hi FROM q JOIN k USING (station) GROUP BY 1, 2, 3) SELECT station, k, round(CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) * (t - lo.t) / (hi.t - lo.t) END, 4) + 0.0 AS value FROM l")
def asof_interpolate(spark, d):
    e = series(spark, d)
    knots = e.filter("event_type <> 'error'").select("station", "t", "value")
    asks = e.filter("event_type = 'error'").select("station", "t", "k")
    return J.interpolate(knots, asks, ["station"], "t", "value", ["k"]).filter("value IS NOT NULL").select("station", "k", t("value", 4).alias("value"))


@C.add("las_curve", f"WITH {WELL_SQL} SELECT well, 1500 + 0.5::DOUBLE * seq AS distance, gr AS value FROM w")
def las_curve(spark, d):
    return wells(spark, d).select("well", F.col("depth").alias("distance"), F.col("gr").alias("value"))


STALTA_SQL = f"{SECTION_SQL}, r AS (SELECT trace, k, amp, CASE WHEN k + 1 >= 20 AND avg(amp * amp) OVER (PARTITION BY trace ORDER BY k ROWS 19 PRECEDING) > 0 THEN avg(amp * amp) OVER (PARTITION BY trace ORDER BY k ROWS 3 PRECEDING) / avg(amp * amp) OVER (PARTITION BY trace ORDER BY k ROWS 19 PRECEDING) ELSE 0 END AS ratio FROM tr)"


@C.add("sta_lta", f"WITH {STALTA_SQL} SELECT trace, k, round(ratio, 6) + 0.0 AS ratio FROM r")
def sta_lta(spark, d):
    return T.sta_lta(section(spark, d), ["trace"], "k", "amp", 4, 20).select("trace", "k", t("ratio").alias("ratio"))


def aic_sql(source: str) -> str:
    return f"ai AS (SELECT trace, k, CASE WHEN n >= 2 AND n <= m - 3 AND vb > 0 AND va > 0 THEN n * ln(vb) + (m - n - 1) * ln(va) END AS aic FROM (SELECT trace, k, row_number() OVER o - 1 AS n, count(*) OVER (PARTITION BY trace) AS m, var_pop(amp) OVER (PARTITION BY trace ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS vb, var_pop(amp) OVER (PARTITION BY trace ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS va FROM {source} WINDOW o AS (PARTITION BY trace ORDER BY k)))"


@C.add("aic_pick", f"WITH {SECTION_SQL}, {aic_sql('tr')} SELECT trace, min_by(k, (aic, k)) AS pick FROM ai WHERE aic IS NOT NULL GROUP BY trace")
def aic_pick(spark, d):
    return T.aic_pick(section(spark, d), ["trace"], "k", "amp")


@C.add("first_break", f"WITH {STALTA_SQL}, o AS (SELECT trace, min(k) AS trigger FROM r WHERE ratio > 2 GROUP BY trace), near AS (SELECT tr.trace, tr.k, tr.amp FROM tr JOIN o USING (trace) WHERE tr.k >= trigger - 40 AND tr.k < trigger + 20), {aic_sql('near')}, p AS (SELECT trace, min_by(k, (aic, k)) AS pick FROM ai WHERE aic IS NOT NULL GROUP BY trace) SELECT trace, trigger, coalesce(pick, trigger) AS pick FROM o LEFT JOIN p USING (trace)")
def first_break(spark, d):
    return T.first_arrivals(section(spark, d), ["trace"], "k", "amp", 4, 20, 2.0)


@C.add("coherence", f"WITH {SECTION_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY cmp, k ORDER BY trace) AS r, count(*) OVER (PARTITION BY cmp, k) AS m FROM tr), x AS (SELECT a.cmp, a.trace, a.k, sum(b.amp) AS s, sum(b.amp * b.amp) AS e FROM n a, (SELECT unnest([-1, 0, 1]) AS o) o, n b WHERE b.cmp = a.cmp AND b.k = a.k AND b.r = least(greatest(a.r + o.o, 1), a.m) GROUP BY 1, 2, 3) SELECT trace, k, round(sum(s * s) OVER w / (3 * sum(e) OVER w), 6) + 0.0 AS semblance FROM x WINDOW w AS (PARTITION BY cmp, trace ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def coherence(spark, d):
    return T.coherence(section(spark, d), ["cmp"], "trace", "k", "amp").select("trace", "k", t("semblance").alias("semblance"))


@C.add("dewow", f"WITH {SECTION_SQL} SELECT a.trace, a.k, round(any_value(a.amp) - avg(b.amp), 6) + 0.0 AS dewowed FROM tr a, (SELECT unnest(range(-3, 4)) AS o) o, tr b WHERE b.trace = a.trace AND b.k = least(greatest(a.k + o.o, 0), 63) GROUP BY a.trace, a.k")
def dewow(spark, d):
    return T.dewow(section(spark, d), ["trace"], "k", "amp", 7).select("trace", "k", t("dewowed").alias("dewowed"))


@C.add("bgr", f"WITH {SECTION_SQL} SELECT trace, k, round(amp - avg(amp) OVER (PARTITION BY cmp, k), 6) + 0.0 AS cleaned FROM tr")
def bgr(spark, d):
    return T.remove_background(section(spark, d), ["cmp"], "trace", "k", "amp").select("trace", "k", t("cleaned").alias("cleaned"))


@C.add("vlf", f"WITH {SECTION_SQL} SELECT trace, (k1 + k2) / 2.0::DOUBLE AS middle, round(a2 + a3 - amp - a1, 6) + 0.0 AS fraser FROM (SELECT trace, amp, lead(amp, 1) OVER w AS a1, lead(amp, 2) OVER w AS a2, lead(amp, 3) OVER w AS a3, lead(k, 1) OVER w AS k1, lead(k, 2) OVER w AS k2 FROM tr WINDOW w AS (PARTITION BY trace ORDER BY k)) WHERE a3 IS NOT NULL")
def vlf(spark, d):
    return T.fraser(section(spark, d), ["trace"], "k", "amp").select("trace", "middle", t("fraser").alias("fraser"))


SONIC_SQL = f"WITH {WELL_SQL}, s AS (SELECT well, seq, dt * 1e-6 / 0.3048 AS s, CASE WHEN seq = 1 THEN 0 ELSE 0.5 END * dt * 1e-6 / 0.3048 AS step FROM w), o AS (SELECT well, seq, sum(step) OVER r AS owt, 1 / s AS vi, sum(step / s / s) OVER r AS q FROM s WINDOW r AS (PARTITION BY well ORDER BY seq ROWS UNBOUNDED PRECEDING))"


@C.add("sonic", f"{SONIC_SQL} SELECT well, seq, round(owt, 9) + 0.0 AS owt, round(2 * owt, 9) + 0.0 AS twt, round(vi, 4) AS v_interval, CASE WHEN owt > 0 THEN round(sqrt(q / owt), 4) ELSE -1 END AS v_rms FROM o")
def sonic(spark, d):
    s = T.sonic(wells(spark, d), ["well"], "depth", "dt")
    return s.select("well", "seq", t("owt", 9).alias("owt"), t("twt", 9).alias("twt"), F.round("v_interval", 4).alias("v_interval"), F.coalesce(F.round("v_rms", 4), F.lit(-1.0)).alias("v_rms"))


@C.add("sp_baseline", f"WITH {WELL_SQL}, q AS (SELECT well, seq, gr - 90 AS sp, quantile_cont(gr - 90, 0.9) OVER (PARTITION BY well ORDER BY seq ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS q, count(*) OVER (PARTITION BY well) AS m FROM w), b AS (SELECT a.well, a.seq, a.sp, median(b.q) AS baseline FROM q a, (SELECT unnest(range(-3, 4)) AS o) o, q b WHERE b.well = a.well AND b.seq = least(greatest(a.seq + o.o, 1), a.m) GROUP BY 1, 2, 3), c AS (SELECT *, sp - baseline AS c, min(sp - baseline) OVER (PARTITION BY well) AS ssp FROM b) SELECT well, seq, {rnd(baseline='baseline', sp_corrected='c', vsh='CASE WHEN ssp < 0 THEN greatest(least(1 - c / ssp, 1), 0) ELSE 1 END')}, c < -15 AS permeable FROM c")
def sp_baseline(spark, d):
    w = wells(spark, d).withColumn("sp", F.col("gr") - 90)
    return _tidied(T.sp_baseline(w, ["well"], "seq", "sp", 15).select("well", "seq", "baseline", "sp_corrected", "vsh", "permeable"), ["well", "seq", "permeable"])


def starlet_sql(levels: int) -> str:
    out, src = [], "(SELECT trace, k, amp AS c, 0.0::DOUBLE AS acc FROM tr)"
    for j in range(levels):
        step = 2**j
        out.append(f"s{j} AS (SELECT a.trace, a.k, any_value(a.c) AS c, any_value(a.acc) AS acc, sum(o.w * b.c) AS nx FROM {src} a, (SELECT unnest([-2, -1, 0, 1, 2]) * {step} AS o, unnest([1, 4, 6, 4, 1]) / 16.0 AS w) o, {src} b WHERE b.trace = a.trace AND b.k = least(((a.k + o.o) % 126 + 126) % 126, 126 - ((a.k + o.o) % 126 + 126) % 126) GROUP BY a.trace, a.k)")
        out.append(f"m{j} AS (SELECT trace, median(c - nx) AS med FROM s{j} GROUP BY trace), l{j} AS (SELECT trace, 3 * median(abs(c - nx - med)) / 0.6745 AS lim FROM s{j} JOIN m{j} USING (trace) GROUP BY trace), c{j} AS (SELECT s{j}.trace, k, nx AS c, acc + CASE WHEN abs(c - nx) >= lim THEN c - nx ELSE 0 END AS acc FROM s{j} JOIN l{j} USING (trace))")
        src = f"c{j}"
    return f"WITH {SECTION_SQL}, {', '.join(out)} SELECT trace, k, round(c + acc, 6) + 0.0 AS denoised FROM {src}"


@C.add("wavelet", starlet_sql(2))
def wavelet(spark, d):
    return T.starlet(section(spark, d), ["trace"], "k", "amp", 2).select("trace", "k", t("denoised").alias("denoised"))


def starlet_grid_sql(levels: int) -> str:
    out, src = [], "(SELECT i, j, ln(value) AS c, 0.0::DOUBLE AS acc FROM g)"
    for n in range(levels):
        taps = f"(SELECT unnest([-2, -1, 0, 1, 2]) * {2**n} AS o, unnest([1, 4, 6, 4, 1]) / 16.0::DOUBLE AS w) o"
        fold = lambda x, p: f"least((({x} + o.o) % {p} + {p}) % {p}, {p} - (({x} + o.o) % {p} + {p}) % {p})"
        out.append(f"x{n} AS (SELECT a.i, a.j, sum(o.w * b.c) AS v FROM {src} a, {taps}, {src} b WHERE b.i = a.i AND b.j = {fold('a.j', '98')} GROUP BY a.i, a.j)")
        out.append(f"y{n} AS (SELECT a.i, a.j, sum(o.w * b.v) AS nx FROM (SELECT *, 2 * (SELECT max(i) FROM g) AS p FROM x{n}) a, {taps}, x{n} b WHERE b.j = a.j AND b.i = {fold('a.i', 'a.p')} GROUP BY a.i, a.j)")
        out.append(f"d{n} AS (SELECT s.i, s.j, s.c, s.acc, nx FROM {src} s JOIN y{n} USING (i, j)), m{n} AS (SELECT median(c - nx) AS med FROM d{n}), l{n} AS (SELECT 3 * median(abs(c - nx - med)) / 0.6745 AS lim FROM d{n}, m{n}), c{n} AS (SELECT i, j, nx AS c, acc + CASE WHEN abs(c - nx) >= lim THEN c - nx ELSE 0 END AS acc FROM d{n}, l{n})")
        src = f"c{n}"
    return f"WITH {GRID_SQL}, {', '.join(out)} SELECT i, j, round(c + acc, 6) + 0.0 AS denoised FROM {src}"


@C.add("wavelet_grid", starlet_grid_sql(2))
def wavelet_grid(spark, d):
    return T.starlet(grid(spark, d).withColumn("value", F.ln("value")), ["grid_id"], ["i", "j"], "value", 2).select("i", "j", t("denoised").alias("denoised"))


_BACK = lambda x, n: f"CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"
VOLUME_SQL = f"""{SECTION_SQL}, v AS (SELECT trace // 20 AS il, trace % 20 AS xl, k, amp, (SELECT max(trace // 20) + 1 FROM tr) AS n FROM tr),
a AS (SELECT a.il, a.xl, a.k, sum(b.amp) AS s, sum(b.amp * b.amp) AS e FROM v a, (SELECT unnest([-1, 0, 1]) AS o) o, v b WHERE b.k = a.k AND b.xl = a.xl AND b.il = {_BACK('(a.il + o.o)', 'a.n')} GROUP BY 1, 2, 3),
b AS (SELECT a.il, a.xl, a.k, sum(b.s) AS s, sum(b.e) AS e FROM a, (SELECT unnest([-1, 0, 1]) AS o) o, a b WHERE b.k = a.k AND b.il = a.il AND b.xl = {_BACK('(a.xl + o.o)', '20')} GROUP BY 1, 2, 3),
c AS (SELECT a.il, a.xl, a.k, sum(b.s * b.s) AS s, sum(b.e) AS e FROM b a, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) o, b WHERE b.il = a.il AND b.xl = a.xl AND b.k = {_BACK('(a.k + o.o)', '64')} GROUP BY 1, 2, 3)"""


@C.add("coherence_volume", f"WITH {VOLUME_SQL} SELECT il * 20 + xl AS trace, k, round(CASE WHEN e > 0 THEN s / (9 * e) ELSE 0 END, 6) + 0.0 AS semblance FROM c")
def coherence_volume(spark, d):
    """The section's traces as a volume of 20 crosslines."""
    s = section(spark, d).withColumns({"inline": F.floor(F.col("trace") / 20), "crossline": F.col("trace") % 20})
    return T.coherence_volume(s, [], "inline", "crossline", "k", "amp").select("trace", "k", t("semblance").alias("semblance"))


@C.add("drift", f"WITH {SERIES_SQL}, b AS (SELECT station, t, value FROM e WHERE event_type = 'signup'), ok AS (SELECT station, min_by(value, t) AS f FROM b GROUP BY station HAVING count(*) >= 2), l AS (SELECT e.station, e.t, e.value, any_value(f) AS f, max_by(struct_pack(t := b.t, v := b.value), b.t) FILTER (WHERE b.t <= e.t) AS lo, min_by(struct_pack(t := b.t, v := b.value), b.t) FILTER (WHERE b.t >= e.t) AS hi FROM e JOIN ok USING (station) JOIN b USING (station) GROUP BY 1, 2, 3), r AS (SELECT *, CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL OR lo.t = t THEN lo.v ELSE lo.v + (hi.v - lo.v) * (t - lo.t) / (hi.t - lo.t) END - f AS drift FROM l) SELECT station, round(t, 3) AS t, round(drift, 4) + 0.0 AS drift, round(value - drift, 4) + 0.0 AS corrected FROM r")
def drift(spark, d):
    e = series(spark, d)
    enough = e.filter("event_type = 'signup'").groupBy("station").count().filter("count >= 2").select("station")
    r = T.drift_correction(e.join(enough, "station"), ["station"], "t", "value", F.col("event_type") == "signup")
    return r.select("station", F.round("t", 3).alias("t"), t("drift", 4).alias("drift"), t("corrected", 4).alias("corrected"))


@C.add("avo", f"WITH {SECTION_SQL}, a AS (SELECT cmp, k, amp, pow(sin(radians(off / 40)), 2) AS s FROM tr), f AS (SELECT cmp, k, regr_intercept(amp, s) AS a, regr_slope(amp, s) AS b FROM a GROUP BY cmp, k) SELECT cmp, k, {rnd(intercept='a', gradient='b', product='a * b')} FROM f")
def avo(spark, d):
    s = section(spark, d).withColumn("angle", F.col("off") / 40)
    return _tidied(A.avo(s, ["cmp", "k"], "angle", "amp"), ["cmp", "k"])


DIP_SQL = "s AS (SELECT well, count(*)::DOUBLE AS n, sum(c) AS sc, sum(s) AS ss, sum(c*c) AS scc, sum(s*s) AS sss, sum(c*s) AS scs, sum(z) AS sz, sum(z*c) AS szc, sum(z*s) AS szs, sum(z*z) AS szz FROM p GROUP BY well HAVING count(*) >= 3), q AS (SELECT *, n*(scc*sss-scs*scs) - sc*(sc*sss-scs*ss) + ss*(sc*scs-scc*ss) AS det, sz*(scc*sss-scs*scs) - sc*(szc*sss-scs*szs) + ss*(szc*scs-scc*szs) AS d0, n*(szc*sss-scs*szs) - sz*(sc*sss-scs*ss) + ss*(sc*szs-szc*ss) AS d1, n*(scc*szs-szc*scs) - sc*(sc*szs-szc*ss) + sz*(sc*scs-scc*ss) AS d2 FROM s)"


@C.add("dipmeter", f"WITH {WELL_SQL}, p AS (SELECT well, cos(radians((seq * 37) % 360)) AS c, sin(radians((seq * 37) % 360)) AS s, gr / 100 AS z FROM w), {DIP_SQL} SELECT well, n::BIGINT AS n_picks, {rnd(depth='d0 / det', dip='degrees(atan(2 * sqrt(d1 * d1 + d2 * d2) / abs(det) / 0.216))')}, round((degrees(atan2(d2 / det, d1 / det)) + 360) % 360, 4) + 0.0 AS azimuth, round(sqrt((szz - d0 / det * sz - d1 / det * szc - d2 / det * szs) / n), 5) + 0.0 AS rms FROM q")
def dipmeter(spark, d):
    w = wells(spark, d).select("well", (F.col("seq") * 37 % 360).cast("double").alias("az"), (F.col("gr") / 100).alias("z"))
    f = A.dipmeter(w, ["well"], "az", "z")
    return f.select("well", "n_picks", t("depth").alias("depth"), t("dip").alias("dip"), t("azimuth", 4).alias("azimuth"), t("rms", 5).alias("rms"))


@C.add("residual_qc", f"WITH {GRID_SQL}, r AS (SELECT i * 50 + j AS n, value - 900 - band AS r, lag(value - 900 - band) OVER (ORDER BY i * 50 + j) AS p FROM g), a AS (SELECT count(*) AS n, sqrt(avg(r * r)) AS rms, sum(r * r / 2500) AS chi2, sum((r - p) * (r - p)) / sum(r * r) AS dw, corr(r, p) AS lag1 FROM r) SELECT n, {rnd(rms='rms', chi2='chi2', normalised_rms='sqrt(chi2 / n)', durbin_watson='dw', lag1='lag1')}, CASE WHEN sqrt(chi2 / n) < 0.8 THEN 'overfit' WHEN sqrt(chi2 / n) > 1.2 THEN 'underfit' ELSE 'balanced' END AS verdict FROM a")
def residual_qc(spark, d):
    g = grid(spark, d).withColumns({"n": F.col("i") * 50 + F.col("j"), "p": 900 + F.col("band")})
    r = A.residual_report(g, "n", "value", "p", F.lit(50.0))
    return _tidied(r.drop("normal_p"), ["n", "verdict"])


@C.add("tipper", f"WITH {SECTION_SQL} SELECT trace, k, {rnd(arrow_x='-sin(amp)', arrow_y='-amp', arrow_length='sqrt(amp * amp + sin(amp) * sin(amp))')} FROM tr")
def tipper(spark, d):
    s = section(spark, d).withColumns({"ty": F.sin("amp"), "period": F.col("k") + 1.0})
    return _tidied(A.tipper_arrows(s, "amp", "ty", "period", 10.0).select("trace", "k", "arrow_x", "arrow_y", "arrow_length"), ["trace", "k"])


@C.add("section", f"WITH {GRID_SQL}, q AS (SELECT n, 150.0 + n * 4000.0 / 40 AS x, 120.0 + n * 220.0 / 40 AS y FROM (SELECT unnest(range(41)) AS n)), c AS (SELECT n, floor(x / 100)::INT + b AS j, floor(y / 100)::INT + a AS i, (CASE WHEN a = 1 THEN y / 100 - floor(y / 100) ELSE 1 - y / 100 + floor(y / 100) END) * (CASE WHEN b = 1 THEN x / 100 - floor(x / 100) ELSE 1 - x / 100 + floor(x / 100) END) AS w FROM q, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b)) SELECT n::INT AS n, round(sum(w * value), 6) + 0.0 AS value FROM c JOIN g USING (i, j) GROUP BY n")
def cross_section(spark, d):
    n = F.sequence(F.lit(0), F.lit(40))
    ends = grid(spark, d).select("grid_id").distinct().select("grid_id", F.explode(n).alias("n"))
    p = ends.withColumns({"x": 150.0 + F.col("n") * 4000.0 / 40, "y": 120.0 + F.col("n") * 220.0 / 40})
    return J.bilinear(p, grid(spark, d), 0.0, 0.0, 100.0, 100.0, ["n"]).select("n", t("value").alias("value"))


@C.add("vsp", f"WITH {SECTION_SQL}, f AS (SELECT trace, k - (trace % 7 + 3) AS p, amp, trace % 7 + 3 AS fb, cmp FROM tr), m AS (SELECT f.*, quantile_cont(amp, 0.5) OVER (PARTITION BY cmp, p ORDER BY trace ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS down FROM f) SELECT cmp, (p + 2 * fb)::BIGINT AS sample, round(avg(amp - down), 6) + 0.0 AS stack, count(*) AS fold FROM m WHERE p >= 0 AND p < 20 GROUP BY 1, 2")
def vsp(spark, d):
    s = section(spark, d).withColumn("fb", (F.col("trace") % 7 + 3).cast("double"))
    return T.vsp_corridor(s, ["cmp"], "trace", "k", "amp", "fb", 5, 20).select("cmp", "sample", t("stack").alias("stack"), "fold")


@C.add("drift_tide")
def drift_tide(spark, d):
    """Drift with the tide of each reading's time at one place taken into account."""
    e = series(spark, d)
    enough = e.filter("event_type = 'signup'").groupBy("station").count().filter("count >= 2").select("station")
    tide = T.longman_tide(F.timestamp_micros((F.col("t") * 1e6).cast("long")), 30.0, 31.0)
    r = T.drift_correction(e.join(enough, "station"), ["station"], "t", "value", F.col("event_type") == "signup", tide)
    return r.select("station", F.round("t", 3).alias("t"), t("reading", 4).alias("reading"), t("drift", 4).alias("drift"), t("corrected", 4).alias("corrected"))
