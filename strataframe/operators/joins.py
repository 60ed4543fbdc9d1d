"""Spatial and as-of joins, all as equi-joins on derived keys or as windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clip


def coregistered(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two same-shape grids cell by cell; a cell that one of them lacks fails the job."""
    keys = ["grid_id", "i", "j"]
    a, b = first.select(*keys, F.col("value").alias(names[0]), F.lit(1).alias("_a")), second.select(*keys, F.col("value").alias(names[1]), F.lit(1).alias("_b"))
    both = a.join(b, keys, "full")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.withColumn(names[0], F.when(ok, F.col(names[0])).otherwise(F.raise_error(F.lit("grids differ in shape")).cast("double"))).drop("_a", "_b")


def bilinear(points: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float, keys: list[str]) -> DataFrame:
    """keys, value: grid values at the points' x and y from four corners; null where a corner is missing.

    points: keys, grid_id, x, y. A point on the last row or column uses the cell before it. The corners are put together for
    each cell once, so a point is one row of one join. That join is not left to Spark's choice by size: a grid's files can be
    far smaller than its rows, which would then all go through the driver.
    """
    shape = cells.groupBy("grid_id").agg(F.max("i").alias("_mi"), F.max("j").alias("_mj"))
    u, v = (F.col("x") - x0) / dx, (F.col("y") - y0) / dy
    p = points.join(shape, "grid_id", "left").withColumns({"_u": u, "_v": v})
    inside = (F.col("_u") >= 0) & (F.col("_v") >= 0) & (F.col("_u") <= F.col("_mj")) & (F.col("_v") <= F.col("_mi"))
    first = lambda c, most: F.when(inside, F.least(F.floor(c), F.greatest(F.col(most) - 1, F.lit(0)).cast("long"))).otherwise(F.floor(c))
    p = p.withColumns({"_j": first("_u", "_mj"), "_i": first("_v", "_mi"), "_in": inside}).withColumns({"_fu": F.col("_u") - F.col("_j"), "_fv": F.col("_v") - F.col("_i")})
    sides = [(a, b) for a in (0, 1) for b in (0, 1)]
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sides])
    known = cells.select("grid_id", "i", "j", F.col("value").alias("_value"), F.explode(corners).alias("c"))
    known = known.select("grid_id", (F.col("i") - F.col("c.a")).cast("long").alias("_i"), (F.col("j") - F.col("c.b")).cast("long").alias("_j"), "c", "_value")
    met = known.groupBy("grid_id", "_i", "_j").agg(*[F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col("_value"))).alias(f"_z{a}{b}") for a, b in sides])
    weight = {(a, b): (F.col("_fv") if a else 1 - F.col("_fv")) * (F.col("_fu") if b else 1 - F.col("_fu")) for a, b in sides}
    value = sum((F.when(weight[a, b] > 0, weight[a, b] * F.col(f"_z{a}{b}")).otherwise(0.0) for a, b in sides), F.lit(0.0))
    return p.join(met.hint("merge"), ["grid_id", "_i", "_j"], "left").select(*keys, F.when(F.col("_in"), value).alias("value"))


def interpolate(knots: DataFrame, queries: DataFrame, by: list[str], at: str, value: str, keep: list[str]) -> DataFrame:
    """Linear between neighbouring knots, flat outside (as-of in both directions), in two windows over their union.

    knots: by, at, value (non-null); queries: by, at, keep. Returns by, at, keep and value. Equal places: the last knot.
    """
    k = knots.filter(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(value).alias(value))
    marks = k.select(*by, at, *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in keep], F.struct(F.col(at).alias("p"), F.col(value).alias("v")).alias("_k"), F.lit(0).alias("_q"))
    asks = queries.select(*by, at, *keep, F.lit(None).cast(marks.schema["_k"].dataType).alias("_k"), F.lit(1).alias("_q"))
    back = F.last("_k", True).over(Window.partitionBy(*by).orderBy(at, "_q").rowsBetween(Window.unboundedPreceding, 0))
    # A frame to the end of its partition is gone through again for each row; backwards it grows by one row.
    ahead = F.last("_k", True).over(Window.partitionBy(*by).orderBy(F.desc(at), F.desc("_q")).rowsBetween(Window.unboundedPreceding, 0))
    d = marks.unionByName(asks).withColumns({"_back": back, "_ahead": ahead}).filter("_q = 1")
    b, f, p = F.col("_back"), F.col("_ahead"), F.col(at)
    line = b.v + (f.v - b.v) * (p - b.p) / (f.p - b.p)
    return d.select(*by, at, *keep, F.when(b.isNull(), f.v).when(f.isNull() | (b.p == p), b.v).otherwise(line).alias(value))


#: Rows of either side that meet as one key of a radius join.
MET_TOGETHER = 2048


def radius_join(points: DataFrame, others: DataFrame, radius: float, point_id: str, other_id: str, by: tuple[str, ...] = ()) -> DataFrame:
    """point_id, other_id, distance of pairs within a radius: tiles of half its size, the points' 5 x 5 tiles exploded.

    Both sides of a tile are dealt to parts of about MET_TOGETHER rows and each two parts meet as a key of their own, so a
    tile with many rows is the work of many tasks. All pairs of near rows are told, so they grow with the square of density.
    """
    tile = lambda c: F.floor(F.col(c) / (radius / 2))
    key = [*by, "_tx", "_ty"]
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])
    p = points.select(*by, point_id, F.col("x").alias("_px"), F.col("y").alias("_py"), tile("x").alias("_tx"), tile("y").alias("_ty"), F.explode(shifts).alias("_s"))
    p = p.select(*by, point_id, "_px", "_py", (F.col("_tx") + F.col("_s.a")).alias("_tx"), (F.col("_ty") + F.col("_s.b")).alias("_ty"))
    o = others.select(*by, other_id, F.col("x").alias("_ox"), F.col("y").alias("_oy"), tile("x").alias("_tx"), tile("y").alias("_ty"))
    counted = lambda d, name: d.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / MET_TOGETHER).cast("int").alias(name))
    parts = counted(p, "_np").join(counted(o, "_no").hint("merge"), key).hint("merge")
    dealt = lambda d, row, own, other: d.join(parts, key).withColumn(own[1:], F.pmod(F.xxhash64(*row), F.col(own)).cast("int")).withColumn(other[1:], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_np", "_no")
    # The points are exploded here and both sides are dealt to parts, so they are far larger than Spark takes them for: nothing
    # is broadcast, and pairs are made in as many tasks as there are shuffle partitions, not in the few that read the files.
    spread = dealt(p, [point_id, "_px", "_py"], "_np", "_no").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "np", "no")
    d = spread.join(dealt(o, [other_id, "_ox", "_oy"], "_no", "_np").hint("merge"), [*key, "np", "no"])
    dx, dy = F.col("_px") - F.col("_ox"), F.col("_py") - F.col("_oy")
    return d.filter(dx * dx + dy * dy <= float(radius) * float(radius)).select(*by, point_id, other_id, F.sqrt(dx * dx + dy * dy).alias("distance"))


#: Targets of a block, leaves of the points' tree (about), halvings of a side for blocks and leaves.
BLOCK_TARGETS, POINT_LEAVES, BLOCK_BITS, LEAF_BITS = 8192, 2048, 12, 24
#: Targets of a block that are answered together, and distances held at once.
NEAR_TARGETS, NEAR_DISTANCES = 128, 1 << 21


def _square(df: DataFrame) -> tuple[float, float, float] | None:
    """Corner and side of the square around x and y."""
    x0, x1, y0, y1 = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return None if x0 is None else (x0, y0, max(x1 - x0, y1 - y0) * (1 + 1e-9) or 1.0)


def _quadtree(df: DataFrame, square: tuple[float, float, float], bits: int, most: int) -> DataFrame:
    """df with cx, cy, level: the largest cell of a tree of 4 x 4 parts that holds at most `most` rows, or a finest one."""
    x0, y0, side = square
    finest = lambda c, o: F.floor((F.col(c) - F.lit(o)) / F.lit(side) * 2**bits)
    placed = df.withColumns({"_cx": finest("x", x0), "_cy": finest("y", y0)})
    counts = placed.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("n"))
    up = lambda c: F.call_function("shiftrightunsigned", F.col(c), F.lit(bits) - F.col("level"))
    tree = counts.withColumn("level", F.explode(F.array(*[F.lit(n) for n in range(0, bits + 1, 2)])))
    tree = tree.select("_cx", "_cy", "n", "level", up("_cx").alias("cx"), up("_cy").alias("cy"))
    full = tree.groupBy("level", "cx", "cy").agg(F.sum("n").alias("_n")).filter(F.col("_n") > most).drop("_n")
    split = tree.join(full, ["level", "cx", "cy"], "left_semi").groupBy("_cx", "_cy").agg(F.max("level").alias("_split"))
    cells = counts.join(split, ["_cx", "_cy"], "left").select("_cx", "_cy", F.least(F.coalesce(F.col("_split") + 2, F.lit(0)), F.lit(bits)).alias("level"))
    return placed.join(cells, ["_cx", "_cy"]).withColumns({"cx": up("_cx"), "cy": up("_cy")}).drop("_cx", "_cy")


def _met_leaves(leaves: np.ndarray, want: int):
    """The leaves (n, x1, x2, y1, y2) that may hold one of the nearest points of some target in each block's box.

    |t - q|**2 - |t - p|**2 is linear in t: what is nearer at a box's four corners is nearer at every target in it. So a
    leaf is left out where `want` points near the box's middle are nearer at each corner than any point of the leaf.
    """
    n, x1, x2, y1, y2 = leaves

    def kernel(batches):
        for batch in batches:
            boxes = np.stack([batch[c].to_numpy() for c in ("x1", "x2", "y1", "y2")], 1)
            block, leaf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b, (u1, u2, v1, v2) in enumerate(boxes):
                most = lambda u, v: np.hypot(np.maximum(np.abs(u - x1), np.abs(u - x2)), np.maximum(np.abs(v - y1), np.abs(v - y2)))
                least = lambda u, v: np.hypot(np.maximum(np.maximum(x1 - u, u - x2), 0), np.maximum(np.maximum(y1 - v, v - y2), 0))
                order = np.argsort(most((u1 + u2) / 2, (v1 + v2) / 2))
                own = order[: int(np.searchsorted(np.cumsum(n[order]), want)) + 1]
                met = np.zeros(len(n), bool)
                for u in (u1, u2):
                    for v in (v1, v2):
                        met |= least(u, v) <= most(u, v)[own].max() * (1 + 1e-9)
                leaf.append(np.flatnonzero(met))
                block.append(np.full(len(leaf[-1]), b))
            at = np.concatenate(block)
            for a in range(0, len(at), 1 << 16):
                some = batch.select(["cx", "cy", "level", "part"]).take(pa.array(at[a : a + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.concatenate(leaf)[a : a + (1 << 16)].astype(np.int32))], ["cx", "cy", "level", "part", "leaf"])

    return kernel


def _by_id(column: pa.ChunkedArray) -> np.ndarray:
    """The order of ids, which may be structs."""
    flat = pa.table(column.combine_chunks().flatten() if pa.types.is_struct(column.type) else [column], [f"c{k}" for k in range(column.type.num_fields if pa.types.is_struct(column.type) else 1)])
    return pa.compute.sort_indices(flat, sort_keys=[(c, "ascending") for c in flat.column_names]).to_numpy()


def _nearest_of_block(want: int):
    """The nearest points of each target of a block, from the points of the leaves that its box meets."""

    def kernel(targets: pa.Table, met: pa.Table) -> pa.Table:
        points = pa.Table.from_struct_array(met["points"].combine_chunks().flatten())
        points = points.take(pa.array(_by_id(points["id"])))
        px, py = points["x"].to_numpy(), points["y"].to_numpy()
        x, y = targets["x"].to_numpy(), targets["y"].to_numpy()
        # Targets along strips of tiles, so that those answered together stand together.
        wide = max(np.ptp(x), np.ptp(y)) / max((len(x) / NEAR_TARGETS) ** 0.5, 1) or 1.0
        order = np.lexsort((x, np.floor((y - y.min()) / wide)))
        asked, found, far = [], [], []
        for a in range(0, len(x), NEAR_TARGETS):
            at = order[a : a + NEAR_TARGETS]
            box = [(u, v) for u in (x[at].min(), x[at].max()) for v in (y[at].min(), y[at].max())]
            middle = np.hypot(px - (box[0][0] + box[3][0]) / 2, py - (box[0][1] + box[3][1]) / 2)
            own = np.argpartition(middle, want - 1)[:want]
            near = np.zeros(len(px), bool)
            for u, v in box:
                distance = np.hypot(px - u, py - v)
                near |= distance <= distance[own].max() * (1 + 1e-9)
            near = np.flatnonzero(near)
            step = max(NEAR_DISTANCES // len(near), 1)
            for b in range(0, len(at), step):
                some = at[b : b + step]
                ex, ey = x[some][:, None] - px[near][None, :], y[some][:, None] - py[near][None, :]
                distance = np.sqrt(ex * ex + ey * ey)
                best = np.argsort(distance, axis=1, kind="stable")[:, :want]
                asked.append(np.repeat(some, want))
                found.append(near[best].ravel())
                far.append(np.take_along_axis(distance, best, 1).ravel())
        asked, found = pa.array(np.concatenate(asked)), pa.array(np.concatenate(found))
        rank = np.tile(np.arange(1, want + 1, dtype=np.int32), len(x))
        return pa.table([targets["id"].take(asked), points["id"].take(found), pa.array(np.concatenate(far)), pa.array(rank)], ["target", "point", "distance", "rank"])

    return kernel


def nearest_neighbours(targets: DataFrame, points: DataFrame, k: int, target_id: str, point_id: str, tile: float) -> DataFrame:
    """target_id, point_id, distance, rank of the k nearest points (ties: the smaller id).

    Blocks of targets and leaves of points are cells of two trees, split where there are many rows, however uneven they are
    (`tile`, once the width of a cell, is not needed). About POINT_LEAVES boxes of leaves tell each block which leaves
    can matter to it, whether it lies among the points or far from them; one join brings these to the block. Of points at
    one place the k smallest ids are kept. A target gets all points where there are fewer than k. Rows without a place
    take no part.
    """
    placed = lambda df, name: df.select(F.col(name).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    p, t = placed(points, point_id), placed(targets, target_id)
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).filter(F.col("_r") <= k).drop("_r")
    n, here, there = p.count(), _square(p), _square(t)
    want = min(k, n)
    kinds = dict(t.dtypes)["id"], dict(p.dtypes)["id"]
    if not want or there is None:
        return targets.sparkSession.createDataFrame([], f"`{target_id}` {kinds[0]}, `{point_id}` {kinds[1]}, distance double, rank int")
    leaf = ["cx", "cy", "level"]
    tree = _quadtree(p, here, LEAF_BITS, max(n // POINT_LEAVES, 16))
    full = tree.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.collect_list(F.struct("id", "x", "y")).alias("points"))
    boxes = full.drop("points").orderBy("level", "cx", "cy").collect()
    numbers = F.broadcast(targets.sparkSession.createDataFrame([(r.cx, r.cy, r.level, i) for i, r in enumerate(boxes)], "cx long, cy long, level int, leaf int"))
    arrays = np.array([[r[c] for r in boxes] for c in ("n", "x1", "x2", "y1", "y2")], float)
    part = [*leaf, "part"]
    dealt = _quadtree(t, there, BLOCK_BITS, BLOCK_TARGETS)
    parts = dealt.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / BLOCK_TARGETS).alias("_parts"))
    dealt = dealt.join(parts, leaf).withColumn("part", F.pmod(F.xxhash64("id"), "_parts").cast("int")).drop("_parts")
    blocks = dealt.groupBy(*part).agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    asks = blocks.repartition(*part).mapInArrow(_met_leaves(arrays, want), "cx long, cy long, level int, part int, leaf int")
    met = asks.join(full.join(numbers, leaf).select("leaf", "points"), "leaf").select(*part, "points")
    near = dealt.select(*part, "id", "x", "y").groupBy(*part).cogroup(met.groupBy(*part)).applyInArrow(_nearest_of_block(want), f"target {kinds[0]}, point {kinds[1]}, distance double, rank int")
    return near.withColumnsRenamed({"target": target_id, "point": point_id})


def point_to_cell(points: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int) -> DataFrame:
    """points with the nearest cell's i and j: halves to even, clipped to the grid."""
    return points.withColumns({"i": clip(F.bround((F.col("y") - y0) / dy).cast("int"), 0, ny - 1), "j": clip(F.bround((F.col("x") - x0) / dx).cast("int"), 0, nx - 1)})


def points_in_polygons(points: DataFrame, vertices: DataFrame, point_id: str, tile: float) -> DataFrame:
    """point_id, value of the last polygon (by order) that holds the point; points in none are absent.

    vertices: polygon, order, seq, x, y, value. Crossing parity; polygons meet points by the tiles of their boxes.
    """
    ring = Window.partitionBy("polygon").orderBy("seq")
    whole = Window.partitionBy("polygon")
    edges = vertices.withColumns({"x2": F.coalesce(F.lead("x").over(ring), F.first("x").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), "y2": F.coalesce(F.lead("y").over(ring), F.first("y").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))})
    first = F.first("value").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = edges.withColumns({"value": first, "_x0": F.min("x").over(whole), "_x1": F.max("x").over(whole)})
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / tile), F.floor(F.greatest(a, b) / tile))
    # An edge matters to points of its rows of tiles, from the polygon's left end to its right one.
    e = edges.select("polygon", "order", "value", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"), F.explode(span(F.col("y"), F.col("y2"))).alias("_ty"), span(F.col("_x0"), F.col("_x1")).alias("_txs")).select("*", F.explode("_txs").alias("_tx")).drop("_txs")
    p = points.select(point_id, "x", "y", F.floor(F.col("x") / tile).alias("_tx"), F.floor(F.col("y") / tile).alias("_ty"))
    d = p.join(e, ["_tx", "_ty"])
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    inside = d.groupBy(point_id, "polygon", "order", "value").agg(F.count_if(crosses).alias("n")).filter("n % 2 = 1")
    return inside.groupBy(point_id).agg(F.max_by("value", "order").alias("value"))


def pairs_within(points: DataFrame, max_lag: float, point_id: str, value: str) -> DataFrame:
    """Pairs a < b within max_lag with their distance and values."""
    other = points.select(F.col(point_id).alias("_b"), "x", "y")
    d = radius_join(points, other, max_lag, point_id, "_b").filter(F.col(point_id) < F.col("_b"))
    va = points.select(point_id, F.col(value).alias("va"))
    vb = points.select(F.col(point_id).alias("_b"), F.col(value).alias("vb"))
    return d.join(va, point_id).join(vb, "_b").select(F.col(point_id).alias("a"), F.col("_b").alias("b"), "distance", "va", "vb")


#: Points of a block whose pairs with another block one task counts at a time.
PAIR_BLOCK = 1024
#: The tile itself and one of each two opposite neighbours.
_HALF = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


MOMENTS = pa.schema([("bin", pa.int32()), ("n", pa.int64()), ("h", pa.float64()), ("g", pa.float64())])


def _packed_points(table: pa.Table) -> pa.Table:
    own = table.slice(0, 1).select(["tx", "ty", "block"])
    for c in ("x", "y", "v"):
        own = own.append_column(c, pa.array([table[c].to_numpy().astype(float).tobytes()], pa.binary()))
    return own


def _lag_moments(max_lag: float, lags: int):
    """Counts and sums of the pairs of two blocks (or of one with itself) by lag class."""

    def kernel(table: pa.Table) -> pa.Table:
        way, low, high = (table[c][0].as_py() for c in ("way", "low", "high"))
        itself = way == 0 and low == high
        if table.num_rows < 2 and not itself:  # the other block has no points: blocks are dealt by hash
            return MOMENTS.empty_table()
        x, y, v = ([np.frombuffer(b, float) for b in table[c].to_pylist()] for c in ("x", "y", "v"))
        h = np.hypot(x[0][:, None] - x[-1][None, :], y[0][:, None] - y[-1][None, :])
        met = h <= max_lag
        if itself:
            met = np.triu(met, 1)
        h, apart = h[met], ((v[0][:, None] - v[-1][None, :]) ** 2)[met]
        bin_ = np.minimum((h / (max_lag / lags)).astype(np.int64), lags - 1)
        n = np.bincount(bin_, minlength=lags)
        sums = [np.bincount(bin_, weights=w, minlength=lags)[n > 0] for w in (h, apart)]
        return pa.table([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0].astype(np.int64)), *[pa.array(w, pa.float64()) for w in sums]], schema=MOMENTS)

    return kernel


def variogram(points: DataFrame, point_id: str, value: str, max_lag: float, lags: int = 15, least: int = 5) -> DataFrame:
    """bin, n, h, gamma: mean distance and semivariance of equal lags with more than `least` pairs.

    Points travel in blocks of a tile of the lag's size, one row each. Two blocks of a tile or of neighbouring tiles meet in
    one task, which tells their counts and sums by lag class; no pair leaves it. Rows with a null are left out.
    """
    tile = lambda c: F.floor(F.col(c) / max_lag).cast("long")
    p = points.select(point_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("double").alias("v")).dropna(subset=["x", "y", "v"]).withColumns({"tx": tile("x"), "ty": tile("y")})
    blocks = p.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    placed = p.join(blocks, ["tx", "ty"]).withColumn("block", F.pmod(F.xxhash64(point_id), "blocks").cast("int"))
    packed = placed.select("tx", "ty", "block", "x", "y", "v").groupBy("tx", "ty", "block").applyInArrow(_packed_points, "tx long, ty long, block int, x binary, y binary, v binary")
    ways = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("way"), F.lit(first).alias("first")) for n, (a, b) in enumerate(_HALF) for first in ((True, False) if n else (True,))])
    sign = F.when(F.col("w.first"), 1).otherwise(-1)
    asks = packed.withColumn("w", F.explode(ways)).withColumns({"ox": F.col("tx") + sign * F.col("w.a"), "oy": F.col("ty") + sign * F.col("w.b")})
    met = asks.join(blocks.select(F.col("tx").alias("ox"), F.col("ty").alias("oy"), "blocks"), ["ox", "oy"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own, first = F.col("w.way") == 0, F.col("w.first")
    low = F.when(own, F.least("block", "other")).when(first, F.col("block")).otherwise(F.col("other"))
    high = F.when(own, F.greatest("block", "other")).when(first, F.col("other")).otherwise(F.col("block"))
    keyed = met.select(F.when(first, F.col("tx")).otherwise(F.col("ox")).alias("kx"), F.when(first, F.col("ty")).otherwise(F.col("oy")).alias("ky"), F.col("w.way").alias("way"), low.alias("low"), high.alias("high"), "x", "y", "v")
    sums = keyed.groupBy("kx", "ky", "way", "low", "high").applyInArrow(_lag_moments(max_lag, lags), "bin int, n long, h double, g double")
    g = sums.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"))
    return g.filter(F.col("n") > least).select("bin", "n", (F.col("h") / F.col("n")).alias("h"), (F.col("g") / F.col("n") / 2).alias("gamma"))


def shape_of(model: str, h: Column, a: Column) -> Column:
    """The unit variogram of a model at distance h and range a."""
    r = h / a
    if model == "spherical":
        return F.when(r < 1, 1.5 * r - 0.5 * r * r * r).otherwise(1.0)
    return 1 - F.exp(-3 * r) if model == "exponential" else 1 - F.exp(-3 * r * r)


def fit_variogram(bins: DataFrame, model: str, ranges: list[float]) -> DataFrame:
    """One row: range, nugget, sill, rss. For a given range the model is linear; the best of the candidate ranges wins."""
    spark = bins.sparkSession
    c = F.broadcast(spark.createDataFrame([(float(r),) for r in ranges], "a double"))
    d = bins.crossJoin(c).withColumn("s", shape_of(model, F.col("h"), F.col("a")))
    fit = d.groupBy("a").agg(F.regr_slope("gamma", "s").alias("sill"), F.regr_intercept("gamma", "s").alias("nugget"), F.sum("gamma").alias("sg"), F.sum(F.col("gamma") * F.col("gamma")).alias("sgg"), F.sum(F.col("gamma") * F.col("s")).alias("sgs"))
    fit = fit.withColumn("rss", F.col("sgg") - F.col("nugget") * F.col("sg") - F.col("sill") * F.col("sgs"))
    best = fit.agg(F.min_by(F.struct("a", "nugget", "sill", "rss"), F.struct("rss", "a")).alias("f"))
    return best.select(F.col("f.a").alias("range"), F.greatest(F.col("f.nugget"), F.lit(0.0)).alias("nugget"), F.col("f.sill").alias("sill"), F.col("f.rss").alias("rss"))
