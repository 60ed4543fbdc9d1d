"""Operators that repeat a step until nothing changes; each round is a written table, so no round depends on an executor.

Distances, fills and regions are settled tile by tile: a round solves every tile whole, with the cells around it as they
were, so there are as many rounds as a path crosses tiles, not cells.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .solutions import EIGHT

MAX_ROUNDS = 2000
#: Cells of a tile's side: a tile is one task's group. A grid narrower than that has longer tiles of as many cells.
TILE = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without it a new one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataframe-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table behind written(); nothing must read it any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _settled(state: DataFrame, step, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """step(state) until its column `moved` is nowhere true; raises beyond max_rounds."""
    state = written(state)
    for _ in range(max_rounds):
        last, state = state, written(step(state.drop("moved")))
        dropped(last)
        if state.filter("moved").isEmpty():
            return state.drop("moved")
    raise RuntimeError("the iteration did not settle")


def _relaxing(kind: str, offsets, dx: float, dy: float, epsilon: float):
    """Settle a tile by the smallest total first: what a cell offers its neighbours is a path's cost, a water level or a label.

    One pass over whole arrays finds the cells that some neighbour improves; only from these on cells are settled one by
    one, so a tile that nothing enters costs that pass alone.
    """
    steps = [(a, b, math.hypot(a * dy, b * dx)) for a, b in offsets]
    reach = max(max(abs(a), abs(b)) for a, b in offsets)

    def kernel(table: pa.Table) -> pa.Table:
        i, j, c, total, own = (table[n].to_numpy() for n in ("i", "j", "c", "total", "own"))
        i0, j0 = int(i.min()) - reach, int(j.min()) - reach
        high, wide = int(i.max()) - i0 + reach + 1, int(j.max()) - j0 + reach + 1
        at = (i.astype(np.int64) - i0) * wide + (j - j0)
        # Places without a cell, and a rim as wide as the longest step, can't be improved and offer nothing.
        there, before, cost, source = np.zeros(high * wide, bool), np.full(high * wide, np.inf), np.zeros(high * wide), np.full(high * wide, -1, np.int64)
        there[at], before[at], cost[at] = True, total, c
        best, near = before.copy(), np.flatnonzero(there)
        for a, b, length in steps:
            of = near - (a * wide + b)
            t = before[of]
            new = t + (cost[of] + cost[near]) / 2 * length if kind == "cost" else np.maximum(cost[near], t + epsilon) if kind == "fill" else t
            less = new < best[near]
            best[near[less]], source[near[less]] = new[less], of[less]
        fresh = np.flatnonzero(best < before)
        if len(fresh):
            best[~there] = -np.inf
            value, price, back = best.tolist(), cost.tolist(), source.tolist()
            moves = [(a * wide + b, length) for a, b, length in steps]
            heap = [(value[n], n) for n in fresh.tolist()]
            heapify(heap)
            while heap:
                t, n = heappop(heap)
                if t > value[n]:
                    continue
                here = price[n]
                for move, length in moves:
                    m = n + move
                    new = t + (here + price[m]) / 2 * length if kind == "cost" else max(price[m], t + epsilon) if kind == "fill" else t
                    if new < value[m]:
                        value[m], back[m] = new, n
                        heappush(heap, (new, m))
            best, source = np.array(value), np.array(back)
        moved, source = best[at] < total, source[at]
        old_i, old_j = (table[n].to_numpy(zero_copy_only=False).astype(float) for n in ("from_i", "from_j"))
        from_i, from_j = np.where(moved, source // wide + i0, old_i), np.where(moved, source % wide + j0, old_j)
        kept = [table[n] for n in ("grid_id", "i", "j", "c")]
        shape = [table[n] for n in ("th", "tw")]
        place = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v)).cast(pa.int32())
        out = pa.table([*kept, pa.array(best[at]), place(from_i), place(from_j), *shape, pa.array(moved)], ["grid_id", "i", "j", "c", "total", "from_i", "from_j", "th", "tw", "moved"])
        return out.filter(pa.array(own))

    return kernel


def _tile_of(column: str, shift: int = 0) -> Column:
    return F.floor((F.col(column) + shift) / F.col({"i": "th", "j": "tw"}[column]))


def _tiled(cells: DataFrame) -> DataFrame:
    """cells with th, tw: rows and columns of their grid's tiles, TILE x TILE or as many cells along a narrow grid."""
    high, wide = ((F.max(c) - F.min(c) + 1).cast("int") for c in ("i", "j"))
    shape = cells.groupBy("grid_id").agg(high.alias("_h"), wide.alias("_w"))
    along = lambda own, other: F.when(F.col(other) < TILE, F.greatest(F.floor(F.lit(TILE * TILE) / F.col(other)), F.lit(TILE))).otherwise(F.lit(TILE)).cast("int")
    return cells.join(shape.select("grid_id", along("_h", "_w").alias("th"), along("_w", "_h").alias("tw")), "grid_id")


def _relaxed(cells: DataFrame, kind: str, dx: float = 1.0, dy: float = 1.0, offsets=EIGHT, epsilon: float = 0.0) -> DataFrame:
    """cells (grid_id, i, j, c, total) with the least totals, and from_i, from_j of the cell that gave it."""
    kinds = dict(cells.dtypes)
    start = cells.select("grid_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("c").cast("double").alias("c"), F.col("total").cast("double").alias("total"), F.lit(None).cast("int").alias("from_i"), F.lit(None).cast("int").alias("from_j"))
    reach = max(max(abs(a), abs(b)) for a, b in offsets)
    schema = f"grid_id {kinds['grid_id']}, i int, j int, c double, total double, from_i int, from_j int, th int, tw int, moved boolean"
    shifts = (-reach, 0, reach)

    def step(s: DataFrame) -> DataFrame:
        tiles = F.array_distinct(F.array(*[F.struct(_tile_of("i", a).alias("ti"), _tile_of("j", b).alias("tj")) for a in shifts for b in shifts]))
        sent = s.select("*", F.explode(tiles).alias("t")).select(*s.columns, "t.*")
        sent = sent.withColumn("own", (F.col("ti") == _tile_of("i")) & (F.col("tj") == _tile_of("j")))
        return sent.groupBy("grid_id", "ti", "tj").applyInArrow(_relaxing(kind, offsets, dx, dy, epsilon), schema)

    return _settled(_tiled(start), step)


def fill_depressions(cells: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Column filled: the lowest surface above the terrain that drains over the border, by epsilon a step."""
    shape = cells.groupBy("grid_id").agg(F.max("i").alias("_mi"), F.max("j").alias("_mj"))
    border = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == F.col("_mi")) | (F.col("j") == F.col("_mj"))
    start = cells.join(shape, "grid_id").select("grid_id", "i", "j", F.col("value").alias("c"), F.when(border, F.col("value")).otherwise(float("inf")).alias("total"))
    return _relaxed(start, "fill", epsilon=epsilon).select("grid_id", "i", "j", F.col("c").alias("value"), F.col("total").alias("filled"))


def cost_distance(cells: DataFrame, source: Column, dx: float, dy: float, cost: str = "value", offsets=EIGHT) -> DataFrame:
    """Columns total, from_i, from_j: least cost from the source cells, an edge being the mean cost times its length.

    A missing cost counts 1e12. The predecessors lead back to a source.
    """
    start = cells.select("grid_id", "i", "j", F.coalesce(F.col(cost), F.lit(1e12)).alias("c"), F.when(source, 0.0).otherwise(float("inf")).alias("total"))
    return _relaxed(start, "cost", dx, dy, offsets).select("grid_id", "i", "j", "total", "from_i", "from_j")


def travel_times(cells: DataFrame, source: Column, dx: float, dy: float, velocity: str = "value", radius: int = 3) -> DataFrame:
    """grid_id, i, j, total: first arrivals by shortest paths over all coprime steps of at most `radius` cells (Moser 1991)."""
    steps = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if math.gcd(a, b) == 1]
    return cost_distance(cells.withColumn("_slow", 1 / F.col(velocity)), source, dx, dy, "_slow", steps).select("grid_id", "i", "j", "total")


def arrivals(cells: DataFrame, positions: DataFrame, dx: float, dy: float, within: float, velocity: str = "value", radius: int = 3) -> DataFrame:
    """position, i, j, x, total: the first arrivals by `within` from each surface position (a cell's x in row 0), as travel_times().

    No way is shorter than the straight one or faster than the fastest cell, so cells beyond that reach are no part of a
    position's model, whatever the size of the whole; the ways that arrive in time lie within it.
    """
    fastest = cells.agg(F.max(velocity)).first()[0] or 0.0
    reach = max(within * fastest, dx) * (1 + 1e-9)
    tile = lambda c: F.floor(F.col(c) / reach)
    at = positions.select("position").distinct().withColumn("_t", F.explode(F.array(*[tile("position") + k for k in (-1, 0, 1)])))
    near = cells.select("i", "j", "x", velocity, tile("x").alias("_t")).filter(F.col("i") * dy <= reach).join(at, "_t").filter(F.hypot(F.col("x") - F.col("position"), F.col("i") * dy) <= reach)
    models = near.select(F.col("position").cast("string").alias("grid_id"), "position", "i", "j", "x", F.col(velocity).alias("value"))
    times = travel_times(models, (F.col("i") == 0) & (F.col("x") == F.col("position")), dx, dy, radius=radius).filter(F.col("total") <= within)
    kind = positions.schema["position"].dataType
    return times.select(F.col("grid_id").cast(kind).alias("position"), "i", "j", (F.col("j") * dx).alias("x"), "total")


def _walking(table: pa.Table) -> pa.Table:
    """The cells of a tile on the way back from its fresh cells, and the first cell beyond it of each way (fresh)."""
    if not pa.compute.any(table["fresh"]).as_py():
        table = table.slice(0, 0)
    i, j, from_i, from_j, fresh = (table[n].to_pylist() for n in ("i", "j", "from_i", "from_j", "fresh"))
    back = dict(zip(zip(i, j, strict=True), zip(from_i, from_j, strict=True), strict=True))
    out: dict[tuple[int, int], bool] = {}
    for cell in (c for c, f in zip(back, fresh, strict=True) if f):
        while cell in back and cell not in out:
            out[cell] = False
            cell = back[cell]
        if cell[0] is not None and cell not in back:
            out[cell] = True
    return pa.table({"grid_id": pa.array([table["grid_id"][0].as_py() for _ in out], table["grid_id"].type), "i": pa.array([c[0] for c in out], pa.int32()), "j": pa.array([c[1] for c in out], pa.int32()), "_on": pa.array(list(out.values()), pa.bool_())})


def least_cost_path(cells: DataFrame, start: tuple[int, int], end: tuple[int, int], dx: float, dy: float) -> DataFrame:
    """grid_id, i, j, total of the cells on the cheapest path, walked back along the predecessors, a tile a round."""
    table = cost_distance(cells, (F.col("i") == start[0]) & (F.col("j") == start[1]), dx, dy)
    at_end = (F.col("i") == end[0]) & (F.col("j") == end[1])
    state = _tiled(table).withColumns({"on": at_end, "fresh": at_end})
    schema = f"grid_id {dict(table.dtypes)['grid_id']}, i int, j int, _on boolean"

    def step(s: DataFrame) -> DataFrame:
        walked = s.withColumns({"ti": _tile_of("i"), "tj": _tile_of("j")}).groupBy("grid_id", "ti", "tj").applyInArrow(_walking, schema)
        marks = walked.groupBy("grid_id", "i", "j").agg(F.bool_and("_on").alias("_fresh"))
        d = s.join(marks, ["grid_id", "i", "j"], "left").withColumn("_new", F.coalesce("_fresh", F.lit(False)) & ~F.col("on"))
        return d.select("grid_id", "i", "j", "total", "from_i", "from_j", "th", "tw", (F.col("on") | F.col("_fresh").isNotNull()).alias("on"), F.col("_new").alias("fresh"), F.col("_new").alias("moved"))

    return _settled(state, step).filter("on").select("grid_id", "i", "j", "total")


def connected_cells(cells: DataFrame, member: Column) -> DataFrame:
    """grid_id, i, j, component of member cells: eight-connected regions named by their smallest row-major cell number."""
    wide = cells.groupBy("grid_id").agg((F.max("j") + 1).cast("long").alias("_nx"))
    start = cells.filter(member).join(wide, "grid_id").select("grid_id", "i", "j", F.lit(0.0).alias("c"), (F.col("i") * F.col("_nx") + F.col("j")).alias("total"))
    return _relaxed(start, "label").select("grid_id", "i", "j", F.col("total").cast("long").alias("component"))


def lineaments(cells: DataFrame, component_cells: DataFrame, least: int = 8) -> DataFrame:
    """grid_id, component, n, x_center, y_center, azimuth, length, x1, y1, x2, y2, linearity of connected edge cells.

    The main axis is the covariance's in closed form, length and end points are the cells' extremes along it, and
    linearity is the larger singular value's share of both.
    """
    placed = component_cells.join(cells.select("grid_id", "i", "j", "x", "y"), ["grid_id", "i", "j"])
    g = placed.groupBy("grid_id", "component").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x_center"), F.avg("y").alias("y_center"), F.var_pop("x").alias("a"), F.covar_pop("x", "y").alias("b"), F.var_pop("y").alias("c")).filter(F.col("n") >= least)
    half, diff = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2.0)) + F.col("b") * F.col("b"))
    large, small = F.sqrt(half + diff), F.sqrt(F.greatest(half - diff, F.lit(0.0)))
    g = g.select("grid_id", "component", "n", "x_center", "y_center", (0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).alias("_t"), F.when(large > 0, large / (large + small)).otherwise(0.0).alias("linearity"))
    along = (F.col("x") - F.col("x_center")) * F.cos("_t") + (F.col("y") - F.col("y_center")) * F.sin("_t")
    ends = placed.join(g, ["grid_id", "component"]).groupBy("grid_id", "component").agg(F.min(along).alias("_p"), F.max(along).alias("_q"))
    at = lambda p: [(F.col("x_center") + F.cos("_t") * F.col(p)), (F.col("y_center") + F.sin("_t") * F.col(p))]
    (x1, y1), (x2, y2) = at("_p"), at("_q")
    out = g.join(ends, ["grid_id", "component"])
    return out.select("grid_id", "component", "n", "x_center", "y_center", F.pmod(90 - F.degrees("_t"), F.lit(180.0)).alias("azimuth"), (F.col("_q") - F.col("_p")).alias("length"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "linearity")
