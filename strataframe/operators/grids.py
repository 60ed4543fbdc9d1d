"""Grid geometry, stencils and map products over cell tables (grid_id, i, j, x, y, value)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import azimuth, clip, finite
from .aggregates import exact_percentiles



def along_row():
    return Window.partitionBy("grid_id", "i").orderBy("j")


def along_column():
    return Window.partitionBy("grid_id", "j").orderBy("i")


def points_to_grid(df: DataFrame, x: str, y: str, value: str, grid_id: Column) -> DataFrame:
    """Cells of points on a full regular grid. Rows with nulls are dropped; a duplicate point fails the job."""
    full = df.select(grid_id.alias("grid_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), finite(F.col(value).cast("double")).alias("value")).dropna()
    one = full.groupBy("grid_id", "x", "y").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    one = one.withColumn("value", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.lit("duplicate point")).cast("double"))).drop("n")
    rank = lambda c, name: full.select("grid_id", c).distinct().withColumn(name, F.row_number().over(Window.partitionBy("grid_id").orderBy(c)) - 1)
    return one.join(rank("x", "j"), ["grid_id", "x"]).join(rank("y", "i"), ["grid_id", "y"]).select("grid_id", "i", "j", "x", "y", "value")


def _shape(cells: DataFrame) -> DataFrame:
    return cells.groupBy("grid_id").agg((F.max("i") + 1).alias("ny"), (F.max("j") + 1).alias("nx"))


def _replaced(cells: DataFrame, i: Column, j: Column) -> DataFrame:
    """Values moved to new (i, j), coordinates as they are."""
    moved = cells.join(_shape(cells), "grid_id").select("grid_id", i.alias("i"), j.alias("j"), "value")
    return cells.drop("value").join(moved, ["grid_id", "i", "j"])


def flip(cells: DataFrame, axis: str) -> DataFrame:
    """Values mirrored along x, y or both."""
    j = F.col("nx") - 1 - F.col("j") if axis in ("x", "both") else F.col("j")
    i = F.col("ny") - 1 - F.col("i") if axis in ("y", "both") else F.col("i")
    return _replaced(cells, i, j)


def rotate(cells: DataFrame, degrees: int) -> DataFrame:
    """Values turned clockwise by a multiple of 90 degrees, on axes that start at the grid's least coordinates."""
    quarter = degrees // 90 % 4
    if degrees % 90:
        raise ValueError("only multiples of 90 degrees")
    frame = cells.groupBy("grid_id").agg((F.max("i") + 1).alias("ny"), (F.max("j") + 1).alias("nx"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    d = cells.join(frame, "grid_id")
    dx, dy = (F.col("x1") - F.col("x0")) / F.greatest(F.col("nx") - 1, F.lit(1)), (F.col("y1") - F.col("y0")) / F.greatest(F.col("ny") - 1, F.lit(1))
    i, j, nx, ny = F.col("i"), F.col("j"), F.col("nx"), F.col("ny")
    new_i, new_j = [(i, j), (j, ny - 1 - i), (ny - 1 - i, nx - 1 - j), (nx - 1 - j, i)][quarter]
    sx, sy = (dy, dx) if quarter % 2 else (dx, dy)
    return d.select("grid_id", new_i.alias("i"), new_j.alias("j"), (F.col("x0") + new_j * sx).alias("x"), (F.col("y0") + new_i * sy).alias("y"), "value")


def _difference(v: Column, step: Column | float, w, second: bool) -> Column:
    """Central inside; at the ends one-sided, of second order where three nodes are there and it is asked for."""
    left, right, right2, left2 = F.lag(v, 1).over(w), F.lead(v, 1).over(w), F.lead(v, 2).over(w), F.lag(v, 2).over(w)
    inner = (right - left) / (2 * step)
    first, last = (right - v) / step, (v - left) / step
    if second:
        first = F.when(right2.isNotNull(), (-3 * v + 4 * right - right2) / (2 * step)).otherwise(first)
        last = F.when(left2.isNotNull(), (3 * v - 4 * left + left2) / (2 * step)).otherwise(last)
    return F.when(left.isNotNull() & right.isNotNull(), inner).when(left.isNull(), first).otherwise(last)


def gradients(cells: DataFrame, dx: float, dy: float, value: str = "value", second: bool = True, names: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    """Horizontal derivatives of a complete grid."""
    v = F.col(value)
    return cells.withColumns({names[0]: _difference(v, F.lit(float(dx)), along_row(), second), names[1]: _difference(v, F.lit(float(dy)), along_column(), second)})


def horizontal_gradient(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Total horizontal gradient as column thg."""
    return gradients(cells, dx, dy).withColumn("thg", F.hypot("gx", "gy"))


def ridges(cells: DataFrame, dx: float, dy: float, percentile: float = 85.0, total: bool = True) -> DataFrame:
    """Column ridge: cells of a complete grid whose thg (with total False: value) is no less than both neighbours along its
    own gradient, in the nearest of four directions, and than the grid's percentile. Edges repeat outwards."""
    d = horizontal_gradient(cells, dx, dy) if total else cells.withColumn("thg", F.col("value"))
    d = gradients(d.withColumn("thg", F.when(~F.isnan("thg"), F.col("thg"))), 1.0, 1.0, "thg", False, ("_gj", "_gi"))

    def beside(name: str, step: int, w) -> Column:
        there = F.lag(F.struct(F.col(name).alias("v")), -step).over(w)
        return F.when(there.isNull(), F.col(name)).otherwise(there["v"])

    d = d.withColumns({"_r": beside("thg", 1, along_row()), "_l": beside("thg", -1, along_row())})
    d = d.withColumns({f"_{k}{v}": beside(name, step, along_column()) for k, name in (("c", "thg"), ("r", "_r"), ("l", "_l")) for v, step in (("u", 1), ("d", -1))})
    angle = F.pmod(F.rint(F.degrees(F.atan2("_gi", "_gj")) / 45) * 45, F.lit(180.0))
    pairs = {0.0: ("_r", "_l"), 45.0: ("_ru", "_ld"), 90.0: ("_cu", "_cd"), 135.0: ("_lu", "_rd")}
    top = F.lit(False)
    for a, (fore, back) in pairs.items():
        top = top | ((angle == a) & (F.col("thg") >= F.col(fore)) & (F.col("thg") >= F.col(back)))
    limits = exact_percentiles(d, ["grid_id"], "thg", [percentile / 100]).select("grid_id", F.col("p")[0].alias("_limit"))
    d = d.join(limits, "grid_id").withColumn("ridge", F.coalesce(top & (F.col("thg") >= F.col("_limit")), F.lit(False)))
    return d.select(*cells.columns, "ridge")


def terrain(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Slope (degrees), aspect, profile and plan curvature, from first-order edges; flat cells have curvature 0."""
    d = gradients(cells, dx, dy, second=False, names=("zx", "zy"))
    d = gradients(d, dx, dy, "zx", False, ("zxx", "zxy"))
    d = gradients(d, dx, dy, "zy", False, ("zyx", "zyy"))
    zx, zy, zxx, zyy, zxy = (F.col(c) for c in ("zx", "zy", "zxx", "zyy", "zxy"))
    p = zx * zx + zy * zy
    profile = -(zxx * zx * zx + 2 * zxy * zx * zy + zyy * zy * zy) / (p * F.pow(p + 1, F.lit(1.5)))
    plan = -(zxx * zy * zy - 2 * zxy * zx * zy + zyy * zx * zx) / F.pow(p, F.lit(1.5))
    return d.withColumns({
        "slope": F.degrees(F.atan(F.sqrt(p))),
        "aspect": azimuth(F.degrees(F.atan2(-zx, -zy))),
        "profile_curvature": F.when(p > 0, profile).otherwise(0.0),
        "plan_curvature": F.when(p > 0, plan).otherwise(0.0),
    })


def hillshade(cells: DataFrame, dx: float, dy: float, azimuth_deg: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, multidirectional: bool = False) -> DataFrame:
    """Lambert shading 0..1 as column shade; with multidirectional, four lights weighted by the aspect."""
    d = gradients(cells, dx, dy, second=False, names=("zx", "zy"))
    zx, zy = F.col("zx") * z_factor, F.col("zy") * z_factor
    slope, aspect = F.atan(F.hypot(zx, zy)), F.atan2(-zx, -zy)
    up = F.radians(F.lit(float(altitude)))

    def light(a: float) -> Column:
        return clip(F.sin(up) * F.cos(slope) + F.cos(up) * F.sin(slope) * F.cos(F.radians(F.lit(float(a))) - aspect), 0.0, 1.0)

    if not multidirectional:
        return d.withColumn("shade", light(azimuth_deg))
    lights = (225.0, 270.0, 315.0, 360.0)
    weight = lambda a: F.pow(F.sin(aspect - F.radians(F.lit(a))), F.lit(2.0))
    total = sum((weight(a) for a in lights[1:]), weight(lights[0]))
    mixed = sum((weight(a) * light(a) for a in lights[1:]), weight(lights[0]) * light(lights[0]))
    return d.withColumn("shade", clip(F.when(total > 0, mixed / total).otherwise(light(azimuth_deg)), 0.0, 1.0))


def ternary_rgb(cells: DataFrame, red: str, green: str, blue: str, percent: float = 2.0) -> DataFrame:
    """Channels stretched between their p and 100 - p percentiles, 0..1; missing values are 0."""
    p = percent / 100
    names = dict(zip("rgb", (red, green, blue), strict=True))
    d = cells
    for k, c in names.items():
        d = d.join(exact_percentiles(cells, ["grid_id"], c, [p, 1 - p]).withColumnRenamed("p", f"_{k}"), "grid_id", "left")
    stretch = lambda k, c: F.coalesce(clip((F.col(c) - F.col(f"_{k}")[0]) / F.greatest(F.col(f"_{k}")[1] - F.col(f"_{k}")[0], F.lit(1e-12)), 0.0, 1.0), F.lit(0.0))
    return d.select("grid_id", "i", "j", *[stretch(k, c).alias(k) for k, c in names.items()])


def neighbour_sum(cells: DataFrame, offsets: list[tuple[int, int]], value: str = "value") -> DataFrame:
    """grid_id, i, j, total, n: sum and count of the values at (i + di, j + dj); cells off the grid count nothing.

    Each cell sends its value to its neighbours, so one exchange after a local explode does the whole stencil.
    """
    table = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in offsets])
    sent = cells.select("grid_id", "i", "j", F.col(value).alias("v"), F.explode(table).alias("o")).select("grid_id", (F.col("i") - F.col("o.di")).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"), "v")
    got = sent.groupBy("grid_id", "i", "j").agg(F.sum("v").alias("total"), F.count("v").alias("n"))
    return cells.select("grid_id", "i", "j").join(got, ["grid_id", "i", "j"], "left").na.fill({"total": 0.0, "n": 0})


def distance_band(dx: float, dy: float, radius: float, own: bool) -> list[tuple[int, int]]:
    """Offsets of the cells within a radius."""
    a, b = int(radius / dy), int(radius / dx)
    return [(i, j) for i in range(-a, a + 1) for j in range(-b, b + 1) if (own or i or j) and (i * dy) ** 2 + (j * dx) ** 2 <= radius * radius * (1 + 1e-12)]


def moran(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """One row for each grid: global Moran I over a binary band without the cell itself, its expectation and z-score."""
    mean = cells.groupBy("grid_id").agg(F.avg("value").alias("mean"))
    z = cells.join(mean, "grid_id").withColumn("z", F.col("value") - F.col("mean"))
    d = z.join(neighbour_sum(z, offsets, "z"), ["grid_id", "i", "j"])
    n = F.count("z")
    s0, s2 = F.sum("n"), F.sum(F.col("n") * F.col("n")) * 4
    one = d.groupBy("grid_id").agg(n.cast("double").alias("n"), s0.cast("double").alias("s0"), s2.cast("double").alias("s2"), F.sum(F.col("z") * F.col("total")).alias("zl"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    i = F.col("n") / F.col("s0") * F.col("zl") / F.col("zz")
    e = -1 / (F.col("n") - 1)
    s1 = 2 * F.col("s0")
    variance = (F.col("n") * F.col("n") * s1 - F.col("n") * F.col("s2") + 3 * F.col("s0") * F.col("s0")) / ((F.col("n") * F.col("n") - 1) * F.col("s0") * F.col("s0")) - e * e
    return one.select("grid_id", i.alias("moran_i"), e.alias("expected_i"), ((i - e) / F.sqrt(variance)).alias("z_score"))


def hot_spots(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Getis-Ord Gi* z-scores as column gi; the band includes the cell itself."""
    whole = cells.groupBy("grid_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("all"))
    d = cells.join(neighbour_sum(cells, offsets), ["grid_id", "i", "j"]).join(whole, "grid_id")
    n = F.col("n")
    down = F.col("sd") * F.sqrt((F.col("all") * n - n * n) / (F.col("all") - 1))
    return d.withColumn("gi", F.when(F.col("value").isNotNull() & (down > 0), (F.col("total") - F.col("mean") * n) / down))


def local_std(cells: DataFrame, half: int = 2) -> DataFrame:
    """Population standard deviation in a square window as column texture; the edge is mirrored with its own cell."""
    shape = _shape(cells)
    span = F.sequence(F.lit(-half), F.lit(half))
    mirror = lambda c, n: F.when(c < 0, -1 - c).when(c >= n, 2 * n - 1 - c).otherwise(c)
    want = cells.join(shape, "grid_id").select("grid_id", "i", "j", "ny", "nx", F.explode(span).alias("a")).select("*", F.explode(span).alias("b"))
    want = want.select("grid_id", "i", "j", mirror(F.col("i") + F.col("a"), F.col("ny")).alias("ii"), mirror(F.col("j") + F.col("b"), F.col("nx")).alias("jj"))
    from_cells = cells.select("grid_id", F.col("i").alias("ii"), F.col("j").alias("jj"), "value")
    return want.join(from_cells, ["grid_id", "ii", "jj"]).groupBy("grid_id", "i", "j").agg(F.stddev_pop("value").alias("texture"))


def trend_terms(order: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(order + 1) for b in range(order + 1 - a)]


def trend_surface(cells: DataFrame, order: int = 2) -> DataFrame:
    """Columns trend and residual: all x^a y^b with a + b <= order on centred, scaled axes, by least squares.

    One aggregate of moments for each grid; the small normal system is solved for each grid's one row.
    """
    import numpy as np

    axes = cells.groupBy("grid_id").agg(*[f for c in "xy" for f in (F.avg(c).alias(f"_m{c}"), F.greatest(F.max(c) - F.min(c), F.lit(1e-12)).alias(f"_r{c}"))])
    u, v = (F.col("x") - F.col("_mx")) / F.col("_rx"), (F.col("y") - F.col("_my")) / F.col("_ry")
    d = cells.join(axes, "grid_id").withColumns({"_u": u, "_v": v})
    power = lambda c, n: F.lit(1.0) if n == 0 else F.pow(F.col(c), F.lit(float(n)))
    terms = trend_terms(order)
    moments = sorted({(a + c, b + e) for a, b in terms for c, e in terms})
    sums = d.filter(F.col("value").isNotNull()).groupBy("grid_id").agg(*[F.sum(power("_u", a) * power("_v", b)).alias(f"s{a}_{b}") for a, b in moments], *[F.sum(F.col("value") * power("_u", a) * power("_v", b)).alias(f"t{a}_{b}") for a, b in terms])

    def solve(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                m = np.array([[row[f"s{a + c}_{b + e}"] for c, e in terms] for a, b in terms])
                out.append(np.linalg.lstsq(m, np.array([row[f"t{a}_{b}"] for a, b in terms]), rcond=None)[0].tolist())
            yield pa.RecordBatch.from_arrays([batch["grid_id"], pa.array(out, pa.list_(pa.float64()))], ["grid_id", "_c"])

    fit = sums.mapInArrow(solve, "grid_id string, _c array<double>")
    surface = sum((F.col("_c")[n] * power("_u", a) * power("_v", b) for n, (a, b) in enumerate(terms)), F.lit(0.0))
    d = d.join(fit, "grid_id").withColumn("trend", surface)
    return d.withColumn("residual", F.col("value") - F.col("trend")).drop("_u", "_v", "_mx", "_my", "_rx", "_ry", "_c")


def lineament_density(lines: DataFrame, cells: DataFrame, radius: float, pieces: int = 20) -> DataFrame:
    """grid_id, i, j, density in km of line per km2 within the radius; lines: x1, y1, x2, y2 as `pieces` equal parts."""
    from math import pi

    from .joins import radius_join

    part = F.explode(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: (k + 0.5) / pieces)).alias("s")
    p = lines.select("*", part).select(F.monotonically_increasing_id().alias("piece"), (F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("s")).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("s")).alias("y"), (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / pieces).alias("length"))
    c = cells.select(F.concat_ws(":", "grid_id", "i", "j").alias("cell"), "grid_id", "i", "j", "x", "y")
    # Lengths ride along through the join as the other side's id, so the numbering is never joined back.
    tagged = p.select(F.struct("piece", "length").alias("piece"), "x", "y")
    near = radius_join(c.select("cell", "x", "y"), tagged, radius, "cell", "piece")
    total = near.groupBy("cell").agg((F.sum("piece.length") / 1e3 / (pi * radius * radius / 1e6)).alias("density"))
    return c.join(total, "cell", "left").select("grid_id", "i", "j", F.coalesce("density", F.lit(0.0)).alias("density"))


def terrain_correction(stations: DataFrame, cells: DataFrame, dx: float, dy: float, radius: float, density: float = 2670.0) -> DataFrame:
    """id, terrain: sum of |gz| of the prisms between each station's height and the cells' heights within the radius.

    stations: id, x, y, height. Cells nearer than half a cell and prisms thinner than 1e-6 m are left out.
    """
    from .joins import radius_join
    from .physics import prism_gz

    c = cells.select(F.struct("i", "j", "x", "y", "value").alias("cell"), "x", "y")
    s = stations.select(F.struct("id", "x", "y", "height").alias("station"), "x", "y")
    d = radius_join(s, c, radius, "station", "cell").filter(F.col("distance") > min(dx, dy) / 2)
    top, base = F.least("station.height", "cell.value"), F.greatest("station.height", "cell.value")
    p = {"x1": F.col("cell.x") - dx / 2, "x2": F.col("cell.x") + dx / 2, "y1": F.col("cell.y") - dy / 2, "y2": F.col("cell.y") + dy / 2, "z1": F.col("station.height") - base, "z2": F.col("station.height") - top}
    d = d.filter(base - top > 1e-6).select("station.id", F.abs(prism_gz(F.col("station.x"), F.col("station.y"), F.lit(0.0), p) * density).alias("g"))
    got = d.groupBy("id").agg(F.sum("g").alias("terrain"))
    return stations.select("id").join(got, "id", "left").na.fill(0.0, ["terrain"])


def transform_fit(points: list[tuple[float, float, float, float]], order: int = 1) -> tuple[list[float], list[float]]:
    """Least-squares coefficients of x and y in 1, a, b (and ab, a^2, b^2 for order 2) from control points (a, b, x, y)."""
    a = np.array([_terms(p[0], p[1], order) for p in points], float)
    if len(points) < a.shape[1]:
        raise ValueError(f"{a.shape[1]} control points are needed")
    return tuple(np.linalg.lstsq(a, np.array([p[k] for p in points], float), rcond=None)[0].tolist() for k in (2, 3))


def _terms(a, b, order: int) -> list:
    return [1.0, a, b] + ([a * b, a * a, b * b] if order == 2 else [])


def rectify(cells: DataFrame, points: list[tuple[float, float, float, float]], spacing: float, order: int = 1) -> DataFrame:
    """gi, gj, x, y, value: an image (i: row, j: column) on a world grid, by control points (column, row, x, y).

    The world grid covers the transformed pixels; each of its nodes is read between pixels, and nodes outside are absent.
    """
    from .joins import bilinear

    forward, back = transform_fit(points, order), transform_fit([(x, y, c, r) for c, r, x, y in points], order)
    placed = lambda k, a, b: sum((F.lit(c) * t for c, t in zip(k, _terms(a, b, order), strict=True)), F.lit(0.0))
    wx, wy = (placed(k, F.col("j"), F.col("i")) for k in forward)
    x0, x1, y0, y1 = cells.agg(F.min(wx), F.max(wx), F.min(wy), F.max(wy)).first()
    if x0 is None:
        return cells.select(F.col("i").alias("gi"), F.col("j").alias("gj"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "value").limit(0)
    nx, ny = (math.ceil((b + spacing / 2 - a) / spacing) for a, b in ((x0, x1), (y0, y1)))
    nodes = cells.sparkSession.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("gi"), (F.col("id") % nx).cast("int").alias("gj"))
    nodes = nodes.select("gi", "gj", (F.lit(x0) + F.col("gj") * spacing).alias("_wx"), (F.lit(y0) + F.col("gi") * spacing).alias("_wy"))
    asked = nodes.select(F.lit("image").alias("grid_id"), "gi", "gj", "_wx", "_wy", placed(back[0], F.col("_wx"), F.col("_wy")).alias("x"), placed(back[1], F.col("_wx"), F.col("_wy")).alias("y"))
    got = bilinear(asked, cells.select(F.lit("image").alias("grid_id"), "i", "j", "value"), 0.0, 0.0, 1.0, 1.0, ["gi", "gj", "_wx", "_wy"])
    return got.select("gi", "gj", F.col("_wx").alias("x"), F.col("_wy").alias("y"), "value")
