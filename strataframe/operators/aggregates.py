"""Statistics, regressions and quality figures by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clip, finite, solve3


#: Values of a group whose percentiles one aggregate may hold, and the bins of a histogram of a larger group.
SMALL_GROUP, BINS = 100_000, 4096


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by and p: the percentiles (shares of 0 to 1, linear between neighbours) of the group's values that are not null.

    Groups of up to SMALL_GROUP values are one aggregate. In a larger one each wanted rank is looked for in a histogram
    between bounds, which close in on its bin until few values are left or all are the same: the work is counted in Spark,
    and no task holds a group. Groups without a value are absent.
    """
    from .iterate import dropped, written

    d = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    sizes = d.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("_n > 0")
    sizes = written(sizes)
    plain = lambda x: x.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in shares])).alias("p"))
    large = sizes.filter(F.col("_n") > SMALL_GROUP)
    if large.isEmpty():
        return plain(d).filter("p IS NOT NULL")
    meet = lambda a, b: a.join(b, by) if by else a.crossJoin(b)  # noqa: E731  (b is then one row or a row for each rank)
    small = plain(meet(d, sizes.filter(F.col("_n") <= SMALL_GROUP).select(*by))) if by else None
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(q)), F.ceil(at(q))) for q in shares])))
    state = written(large.select(*by, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_m"), "_lo", "_hi"))
    narrow = (F.col("_m") <= SMALL_GROUP) | (F.col("_lo") == F.col("_hi"))
    while not state.filter(~narrow).isEmpty():
        wide = state.filter(~narrow)
        inside = meet(d, wide).filter("_v BETWEEN _lo AND _hi")
        # The bins' edges only need to be the same for all rows of a round; halves keep a span of the largest values finite.
        part = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.coalesce(F.least(F.floor(part * BINS), F.lit(BINS - 1)), F.when(F.col("_v") > F.col("_lo"), BINS - 1).otherwise(0)).cast("int")
        keys = [*by, "_rank"]
        bins = inside.groupBy(*keys, "_below", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_below")
        hit = bins.withColumn("_b", before).filter((F.col("_rank") >= F.col("_b")) & (F.col("_rank") < F.col("_b") + F.col("_m")))
        last, state = state, written(state.filter(narrow).unionByName(hit.select(*keys, F.col("_b").alias("_below"), "_m", "_lo", "_hi")))
        dropped(last)
    same = state.filter("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_v"))
    few = meet(d, state.filter("_lo < _hi")).filter("_v BETWEEN _lo AND _hi")
    place = F.row_number().over(Window.partitionBy(*by, "_rank").orderBy("_v")) - 1
    found = same.unionByName(few.withColumn("_k", place).filter(F.col("_k") + F.col("_below") == F.col("_rank")).select(*by, "_rank", "_v"))
    values = meet(found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_of")), large.select(*by, "_n"))
    get = lambda r: F.element_at("_of", r)
    line = lambda q: get(F.floor(at(q))) + (get(F.ceil(at(q))) - get(F.floor(at(q)))) * (at(q) - F.floor(at(q)))
    out = values.select(*by, F.array(*[line(q) for q in shares]).alias("p"))
    return out if small is None else out.unionByName(small)


def statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, n_missing, min, max, mean, std (population), median, rms over finite values; all null where there are none."""
    d = df.withColumn("_v", finite(value))
    v = F.col("_v")
    one = d.groupBy(*by).agg(F.count("_v").alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.sqrt(F.avg(v * v)).alias("rms"))
    middle = exact_percentiles(d, by, "_v", [0.5]).select(*by, F.col("p")[0].alias("median"))
    both = one.join(middle, by, "left") if by else one.join(middle, F.lit(True), "left")
    return both.select(*by, "n", "n_missing", "min", "max", "mean", "std", "median", "rms")


def zonal(cells: DataFrame, zone: str, value: str, cell_km2: float) -> DataFrame:
    """By zone (halves to even): count, mean, std, min, max, median and area of finite values."""
    d = cells.select(F.bround(zone).cast("long").alias("zone"), finite(value).alias("_v")).filter("_v IS NOT NULL AND zone IS NOT NULL")
    one = d.groupBy("zone").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"), (F.count("_v") * cell_km2).alias("area_km2"))
    middle = exact_percentiles(d, ["zone"], "_v", [0.5]).select("zone", F.col("p")[0].alias("median"))
    return one.join(middle, "zone").select("zone", "n", "mean", "std", "min", "max", "median", "area_km2")


def cut_fill(cells: DataFrame, upper: str, lower: str, area: float) -> DataFrame:
    """One row: volumes where upper is above lower, where it is below, and their sum."""
    d = F.col(upper) - F.col(lower)
    return cells.agg((F.sum(F.greatest(d, F.lit(0.0))) * area).alias("above"), (F.sum(F.least(d, F.lit(0.0))) * area).alias("below"), (F.sum(d) * area).alias("net"))


def rose(lines: DataFrame, azimuth_col: str, weight: str | None, width: float = 10.0) -> DataFrame:
    """bin, center, weight of azimuths modulo 180; the mean direction by doubled angles and the dominant bin on each row."""
    w = F.col(weight) if weight else F.lit(1.0)
    a = F.pmod(F.col(azimuth_col), F.lit(180.0))
    last = int(round(180 / width)) - 1
    d = lines.select(F.least(F.floor(a / width), F.lit(last)).cast("int").alias("bin"), w.alias("w"), a.alias("a"))
    whole = d.agg(F.pmod(F.degrees(F.atan2(F.sum(F.col("w") * F.sin(F.radians(F.col("a") * 2))), F.sum(F.col("w") * F.cos(F.radians(F.col("a") * 2))))) / 2, F.lit(180.0)).alias("mean_azimuth"))
    bins = d.groupBy("bin").agg(F.sum("w").alias("weight")).withColumn("center", (F.col("bin") + 0.5) * width)
    top = bins.agg(F.max_by("center", F.struct("weight", -F.col("bin"))).alias("dominant"))
    return bins.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(top)).select("bin", "center", "weight", "mean_azimuth", "dominant")


def weights_of_evidence(cells: DataFrame, evidence: str, deposits: DataFrame, threshold: float) -> DataFrame:
    """One row: W+, W-, contrast, studentised contrast, prior. deposits: grid_id, i, j; a cell counts once."""
    hit = deposits.select("grid_id", "i", "j").distinct().withColumn("_d", F.lit(1))
    d = cells.join(hit, ["grid_id", "i", "j"], "left")
    inside, dep = F.col(evidence) >= threshold, F.col("_d").isNotNull()
    n = lambda c: F.count_if(c).cast("double") + 0.5
    one = d.filter(F.col(evidence).isNotNull()).agg(n(inside & dep).alias("bd"), n(~inside & dep).alias("nd"), n(inside & ~dep).alias("bn"), n(~inside & ~dep).alias("nn"), F.count_if(dep).alias("n_hit"), F.count(F.lit(1)).alias("n_cells"))
    bd, nd, bn, nn = (F.col(c) for c in ("bd", "nd", "bn", "nn"))
    plus = F.ln((bd / (bd + nd)) / (bn / (bn + nn)))
    minus = F.ln((nd / (bd + nd)) / (nn / (bn + nn)))
    sd = F.sqrt(1 / bd + 1 / bn + 1 / nd + 1 / nn)
    return one.select(plus.alias("w_plus"), minus.alias("w_minus"), (plus - minus).alias("contrast"), ((plus - minus) / sd).alias("studentised"), (F.col("n_hit") / F.col("n_cells")).alias("prior"))


def posterior(cells: DataFrame, evidence: str, weights: DataFrame, threshold: float) -> DataFrame:
    """Posterior probability of each cell from the weights."""
    d = cells.crossJoin(F.broadcast(weights))
    logit = F.ln(F.col("prior") / (1 - F.col("prior"))) + F.when(F.col(evidence) >= threshold, F.col("w_plus")).otherwise(F.col("w_minus"))
    return d.withColumn("posterior", F.when(F.col(evidence).isNotNull(), 1 / (1 + F.exp(-logit)))).drop(*weights.columns)


def fractal_dimension(cells: DataFrame, by: list[str], max_lag: int = 10) -> DataFrame:
    """By group: Hurst exponent (0..1) and dimension 3 - H from the pooled variogram along rows and columns."""
    row, column = Window.partitionBy(*by, "i").orderBy("j"), Window.partitionBy(*by, "j").orderBy("i")
    v = F.col("value")
    steps = F.array(*[F.struct(F.lit(h).alias("h"), (F.lead(v, h).over(w) - v).alias("d")) for h in range(1, max_lag + 1) for w in (row, column)])
    d = cells.select(*by, steps.alias("_steps")).select(*by, F.explode("_steps").alias("s")).filter("s.d IS NOT NULL").groupBy(*by, F.col("s.h").alias("h")).agg((F.avg(F.col("s.d") * F.col("s.d")) / 2).alias("g"))
    slope = F.regr_slope(F.ln("g"), F.ln("h"))
    return d.filter("g > 0").groupBy(*by).agg(slope.alias("slope")).select(*by, clip(F.col("slope") / 2, 0.0, 1.0).alias("hurst"), (3 - clip(F.col("slope") / 2, 0.0, 1.0)).alias("dimension"))


def window_members(cells: DataFrame, size: int, step: int) -> DataFrame:
    """Each cell once for every whole window (wi, wj) that it is in; windows start at multiples of step."""
    shape = cells.groupBy("grid_id").agg((F.max("i") + 1).alias("ny"), (F.max("j") + 1).alias("nx"))
    d = cells.join(shape, "grid_id")
    first = lambda c: F.greatest(F.ceil((F.col(c) - size + 1) / step), F.lit(0))
    last = lambda c, n: F.least(F.floor(F.col(c) / step), F.floor((F.col(n) - size) / step))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("wi", F.explode(span(first("i"), last("i", "ny"))))
    return d.withColumn("wj", F.explode(span(first("j"), last("j", "nx")))).drop("ny", "nx")


def following(df: DataFrame, order: str, value: str) -> DataFrame:
    """Column p: the value of the row before in the whole table's order.

    Rows are dealt to ranges of the order and written, so that a range is the same whenever it is read; each range is sorted
    by itself, and its first row takes the last value of the range before from a table of one row a range.
    """
    from .iterate import written

    d = written(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    last = d.groupBy("_range").agg(F.max_by(value, F.struct(order, value)).alias("_last"))
    before = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_before"))
    w = Window.partitionBy("_range").orderBy(order, value)
    place = F.row_number().over(w)
    got = d.withColumns({"p": F.lag(value).over(w), "_first": place == 1}).join(F.broadcast(before), "_range")
    return got.withColumn("p", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("p"))).drop("_range", "_first", "_before")


def residual_report(df: DataFrame, order: str, observed: str, predicted: str, sigma: Column) -> DataFrame:
    """One row: rms, chi2, normalised rms and its verdict, Durbin-Watson, lag-1 correlation, normality p."""
    d = following(df.select(order, (F.col(observed) - F.col(predicted)).alias("r"), sigma.alias("s")), order, "r")
    r, n = F.col("r"), F.col("n")
    a = d.agg(F.count("r").alias("n"), F.sqrt(F.avg(r * r)).alias("rms"), F.sum(r * r / (F.col("s") * F.col("s"))).alias("chi2"), (F.sum((r - F.col("p")) * (r - F.col("p"))) / F.sum(r * r)).alias("durbin_watson"), F.corr("r", "p").alias("lag1"), F.skewness("r").alias("_g1"), F.kurtosis("r").alias("_g2"))
    norm = F.sqrt(F.col("chi2") / n)
    verdict = F.when(norm < 0.8, "overfit").when(norm > 1.2, "underfit").otherwise("balanced")
    # The K2 statistic of D'Agostino and Pearson.
    y = F.col("_g1") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3.0) * (n + 5))
    x = (F.col("_g2") + 3 - e) / F.sqrt(var)
    rb = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    aa = 6 + 8 / rb * (2 / rb + F.sqrt(1 + 4 / (rb * rb)))
    t = (1 - 2 / aa) / (1 + x * F.sqrt(2 / (aa - 4)))
    z2 = (1 - 2 / (9 * aa) - F.signum(t) * F.pow(F.abs(t), F.lit(1 / 3))) / F.sqrt(2 / (9 * aa))
    p = F.when(n >= 20, F.exp(-(z1 * z1 + z2 * z2) / 2))
    return a.select("n", "rms", "chi2", norm.alias("normalised_rms"), verdict.alias("verdict"), F.when(n >= 3, F.col("durbin_watson")).alias("durbin_watson"), F.when(n >= 3, F.col("lag1")).alias("lag1"), p.alias("normal_p"))


def dipmeter(picks: DataFrame, by: list[str], azimuth_col: str, depth_col: str, diameter: float = 0.216) -> DataFrame:
    """By feature of 3 or more picks: depth, dip and azimuth of the plane z0 + c cos a + s sin a, and the rms of the fit."""
    c, s, z = F.cos(F.radians(azimuth_col)), F.sin(F.radians(azimuth_col)), F.col(depth_col)
    sums = {"n": F.count(F.lit(1)).cast("double"), "sc": F.sum(c), "ss": F.sum(s), "scc": F.sum(c * c), "sss": F.sum(s * s), "scs": F.sum(c * s), "sz": F.sum(z), "szc": F.sum(z * c), "szs": F.sum(z * s), "szz": F.sum(z * z)}
    d = picks.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()]).filter("n >= 3")
    k = {x: F.col(x) for x in sums}
    m = [[k["n"], k["sc"], k["ss"]], [k["sc"], k["scc"], k["scs"]], [k["ss"], k["scs"], k["sss"]]]
    z0, a, b = solve3(m, [k["sz"], k["szc"], k["szs"]])
    d = d.withColumns({"z0": z0, "a": a, "b": b})
    rss = k["szz"] - F.col("z0") * k["sz"] - F.col("a") * k["szc"] - F.col("b") * k["szs"]
    return d.select(*by, F.col("n").cast("long").alias("n_picks"), F.col("z0").alias("depth"), F.degrees(F.atan(2 * F.hypot("a", "b") / diameter)).alias("dip"), F.pmod(F.degrees(F.atan2("b", "a")), F.lit(360.0)).alias("azimuth"), F.sqrt(F.greatest(rss, F.lit(0.0)) / k["n"]).alias("rms"))


def avo(samples: DataFrame, by: list[str], angle: str, amplitude: str) -> DataFrame:
    """By sample: intercept, gradient and their product of R = A + B sin(angle)^2."""
    s = F.sin(F.radians(angle)) * F.sin(F.radians(angle))
    d = samples.withColumn("_s", s).groupBy(*by).agg(F.regr_intercept(amplitude, "_s").alias("intercept"), F.regr_slope(amplitude, "_s").alias("gradient"))
    return d.withColumn("product", F.col("intercept") * F.col("gradient"))


def tipper_arrows(df: DataFrame, tx: str, ty: str, period: str, near: float | None = None) -> DataFrame:
    """Induction arrows; with near, in order of the distance to that period."""
    d = df.withColumns({"arrow_x": -F.col(ty), "arrow_y": -F.col(tx), "arrow_length": F.hypot(tx, ty)})
    return d.orderBy(F.abs(F.col(period) - near)) if near is not None else d
