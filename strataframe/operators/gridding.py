"""Gridding of scattered stations on top of the nearest-neighbour join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import nearest_neighbours


def _mean(c: Column) -> Column:
    """The mean of the values as they are written, whatever the order of the rows: their decimals are added up, not their doubles.

    Groups with a value of over 18 whole or over 10 decimal digits, infinite or NaN have their doubles' plain mean.
    """
    written = c.try_cast("decimal(28, 10)")
    whole = F.count_if(F.coalesce(written.cast("double") != c, F.lit(True))) == 0
    return F.when(whole, F.sum(written).cast("double") / F.count(c)).otherwise(F.avg(c))


def clean_stations(df: DataFrame, x: str, y: str, value: str, least: int = 3) -> DataFrame:
    """x, y, value: rows with nulls dropped, duplicates averaged; fewer than `least` stations fail the job."""
    full = df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(n) for c, n in ((x, "x"), (y, "y"), (value, "value"))]).dropna()
    one = full.groupBy("x", "y").agg(_mean(F.col("value")).alias("value"))
    n = F.broadcast(one.agg(F.count(F.lit(1)).alias("_n")))
    guard = F.when(F.col("_n") >= least, F.col("value")).otherwise(F.raise_error(F.lit("too few stations")).cast("double"))
    return one.crossJoin(n).select("x", "y", guard.alias("value"))


def last_stations(df: DataFrame, order: str) -> DataFrame:
    """Of stations at one place the last in the given order."""
    w = Window.partitionBy("x", "y").orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def idw(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, value: str, k: int, power: float, tile: float) -> DataFrame:
    """target_id, value: inverse-distance mean of the k nearest points."""
    near = nearest_neighbours(targets, points, k, target_id, point_id, tile)
    w = 1 / F.pow(F.greatest(F.col("distance"), F.lit(1e-12)), F.lit(float(power)))
    d = near.join(points.select(point_id, F.col(value).alias("_v")), point_id).withColumn("_w", w)
    return d.groupBy(target_id).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("value"))


def nearest_grid(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, value: str, tile: float) -> DataFrame:
    """target_id, value of the nearest point."""
    near = nearest_neighbours(targets, points, 1, target_id, point_id, tile)
    return near.join(points.select(point_id, F.col(value).alias("value")), point_id).select(target_id, "value")


def fill_nearest(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """cells (i, j, value) with missing values taken from the nearest cell that has one (ties: the smaller row, column)."""
    at = F.struct("i", "j")
    placed = cells.select("*", (F.col("j") * dx).alias("x"), (F.col("i") * dy).alias("y"), at.alias("_cell"))
    known = F.col("value").isNotNull() & ~F.isnan("value")
    points = placed.filter(known).select(F.col("_cell").alias("_point"), "x", "y", F.col("value").alias("_value"))
    near = nearest_neighbours(placed.filter(~known).select("_cell", "x", "y"), points, 1, "_cell", "_point", 2 * max(dx, dy))
    found = near.join(points.select("_point", "_value"), "_point").select("_cell", "_value")
    return placed.join(found, "_cell", "left").withColumn("value", F.when(known, F.col("value")).otherwise(F.col("_value"))).select(*cells.columns)


def _shape(model: str, h: np.ndarray, a: float) -> np.ndarray:
    r = h / a
    if model == "spherical":
        return np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0)
    return 1 - np.exp(-3 * r) if model == "exponential" else 1 - np.exp(-3 * r * r)


def _gathered(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, value: str, k: int, tile: float) -> DataFrame:
    """One row for each target with the arrays of its k nearest points."""
    near = nearest_neighbours(targets, points, k, target_id, point_id, tile)
    d = near.join(points.select(point_id, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(value).cast("double").alias("_v")), point_id)
    rows = d.groupBy(target_id).agg(F.array_sort(F.collect_list(F.struct("rank", "_x", "_y", "_v"))).alias("near"))
    return targets.join(rows, target_id).select(F.col(target_id).alias("id"), "x", "y", *["extra"] * ("extra" in targets.columns), F.col("near._x").alias("px"), F.col("near._y").alias("py"), F.col("near._v").alias("pv"))


def _solved(gathered: DataFrame, solve, target_id: str, columns: str) -> DataFrame:
    """Batched small dense systems: targets with as many neighbours are solved together, a batch at a time."""

    def kernel(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(v) for v in batch["px"]])
            out = None
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                part = batch.take(pa.array(at))
                px, py, pv = (part[c].flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) for c in ("px", "py", "pv"))
                more = [part["extra"].to_numpy()] if "extra" in part.schema.names else []
                got = solve(part["x"].to_numpy(), part["y"].to_numpy(), px, py, pv, *more)
                out = np.full((batch.num_rows, len(got)), np.nan) if out is None else out
                for c, g in enumerate(got):
                    out[at, c] = g
            names = [c.split()[0] for c in columns.split(", ")]
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(out[:, c]) for c in range(out.shape[1]))], ["id", *names])

    kind = dict(gathered.dtypes)["id"]
    return gathered.mapInArrow(kernel, f"id {kind}, {columns}").withColumnRenamed("id", target_id)


def kriging(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, value: str, k: int, tile: float, model: str, nugget: float, sill: float, reach: float) -> DataFrame:
    """target_id, value, variance: ordinary kriging from the k nearest points with a fitted variogram."""

    def solve(x, y, px, py, pv):
        n = px.shape[1]
        gamma = lambda h: np.where(h > 0, nugget + sill * _shape(model, h, reach), 0.0)
        a = np.ones((len(x), n + 1, n + 1))
        a[:, n, n] = 0
        a[:, :n, :n] = gamma(np.hypot(px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :]))
        b = np.ones((len(x), n + 1))
        b[:, :n] = gamma(np.hypot(px - x[:, None], py - y[:, None]))
        w = np.einsum("tij,tj->ti", np.linalg.pinv(a, hermitian=True), b)
        return (w[:, :n] * pv).sum(1), np.maximum((w * b).sum(1), 0.0)

    return _solved(_gathered(targets, points, target_id, point_id, value, k, tile), solve, target_id, "value double, variance double")


def cokriging(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, value: str, secondary: str, k: int, tile: float, model: str, nugget: float, sill: float, reach: float) -> DataFrame:
    """target_id, value: collocated ordinary cokriging under the first Markov model from the k nearest points.

    targets and points carry the secondary variable; it is put into the primary's units by a line through the points, and
    the weights of the points and of the target's own secondary value sum to 1.
    """
    fit = points.agg(F.corr(value, secondary).alias("r"), F.regr_slope(value, secondary).alias("b"), F.regr_intercept(value, secondary).alias("a")).first()
    rho = fit["r"] or 0.0
    calibrated = targets.select(target_id, "x", "y", (F.col(secondary) * F.lit(fit["b"] or 0.0) + F.lit(fit["a"] or 0.0)).alias("extra"))
    c0 = nugget + sill

    def solve(x, y, px, py, pv, own):
        n = px.shape[1]
        cov = lambda h: np.where(h > 0, sill - sill * _shape(model, h, reach), c0)
        to = cov(np.hypot(px - x[:, None], py - y[:, None]))
        a, b = np.zeros((len(x), n + 2, n + 2)), np.ones((len(x), n + 2))
        a[:, :n, :n] = cov(np.hypot(px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :]))
        a[:, :n, n] = a[:, n, :n] = rho * to
        a[:, n, n], a[:, : n + 1, n + 1], a[:, n + 1, : n + 1] = c0, 1, 1
        b[:, :n], b[:, n] = to, rho * c0
        w = np.einsum("tij,tj->ti", np.linalg.pinv(a, hermitian=True), b)
        return ((w[:, :n] * pv).sum(1) + w[:, n] * own,)

    return _solved(_gathered(calibrated, points, target_id, point_id, value, k, tile), solve, target_id, "value double")


def radial_spline(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, value: str, k: int, tile: float, kernel: str = "thin_plate_spline", smoothing: float = 0.0) -> DataFrame:
    """target_id, value: local radial-basis spline with a plane, from the k nearest points."""

    def phi(r):
        if kernel == "thin_plate_spline":
            return np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1.0)), 0.0)
        return r**3 if kernel == "cubic" else -r

    def solve(x, y, px, py, pv):
        n = px.shape[1]
        mx, my = px.mean(1, keepdims=True), py.mean(1, keepdims=True)
        scale = np.maximum(np.abs(np.concatenate([px - mx, py - my], 1)).max(1, keepdims=True), 1e-12)
        px, py, tx, ty = (px - mx) / scale, (py - my) / scale, (x - mx[:, 0]) / scale[:, 0], (y - my[:, 0]) / scale[:, 0]
        a = np.zeros((len(x), n + 3, n + 3))
        a[:, :n, :n] = phi(np.hypot(px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :])) + smoothing * np.eye(n)
        plane = np.stack([np.ones_like(px), px, py], 2)
        a[:, :n, n:], a[:, n:, :n] = plane, plane.transpose(0, 2, 1)
        c = np.einsum("tij,tj->ti", np.linalg.pinv(a, hermitian=True), np.concatenate([pv, np.zeros((len(x), 3))], 1))
        base = phi(np.hypot(px - tx[:, None], py - ty[:, None]))
        return ((c[:, :n] * base).sum(1) + c[:, n] + c[:, n + 1] * tx + c[:, n + 2] * ty,)

    return _solved(_gathered(targets, points, target_id, point_id, value, k, tile), solve, target_id, "value double")
