"""Drainage over steepest descents by contraction: tiles are solved whole, and only their border cells meet in Spark.

A cell whose water leaves its tile is an exit; it leads to a cell of another tile and from there, inside that tile, to the
next exit. These links between exits are a forest of a few cells a tile, whose sums and ends take logarithmic rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import led_to, subtree_sums
from .iterate import dropped, written
from .solutions import steepest

_CELL = ["grid_id", "i", "j"]
#: Cells of a tile's side.
TILE = 64


class _Tile:
    """Cells of a tile as a forest: the place of the next cell inside the tile, or -1."""

    def __init__(self, table: pa.Table):
        self.i, self.j = table["i"].to_numpy(), table["j"].to_numpy()
        i0, j0 = self.i.min(), self.j.min()
        wide = int(self.j.max() - j0) + 1
        at = np.full(((int(self.i.max() - i0) + 1), wide), -1, np.int64)
        at[self.i - i0, self.j - j0] = np.arange(len(self.i))
        to_i = table["to_i"].to_numpy(zero_copy_only=False).astype(float)
        to_j = table["to_j"].to_numpy(zero_copy_only=False).astype(float)
        flows = ~np.isnan(to_i)
        a, b = np.where(flows, to_i - i0, -1).astype(np.int64), np.where(flows, to_j - j0, -1).astype(np.int64)
        inside = flows & (a >= 0) & (b >= 0) & (a < at.shape[0]) & (b < wide)
        self.next = np.where(inside, at[np.where(inside, a, 0), np.where(inside, b, 0)], -1)
        self.leaves = flows & (self.next < 0)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """weight of each cell and of all cells above it in the tile."""
        total, at = weight.astype(np.int64), self.next.copy()
        while (at >= 0).any():
            on = at >= 0
            total = total + np.bincount(at[on], weights=total[on], minlength=len(total)).astype(np.int64)
            at = np.where(on, at[at], -1)
        return total

    def last(self, stop: np.ndarray | None = None) -> np.ndarray:
        """The cell at which each cell's way ends in the tile, or meets a cell of stop."""
        own = np.arange(len(self.next))
        at = np.where(self.next < 0, own, self.next)
        at = at if stop is None else np.where(stop, own, at)
        while True:
            further = at[at]
            if (further == at).all():
                return at
            at = further


def _links(with_marks: bool):
    """The cells that water leaves or enters, with the tile's last cell on their way and the weight of the tile at exits."""

    def kernel(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        stop = table["pour"].is_valid().to_numpy() if with_marks else None
        last = tile.last(stop)
        use = tile.leaves | table["entry"].to_numpy(zero_copy_only=False)
        weight = np.where(tile.leaves, tile.sums(np.ones(len(last))), 0)
        leaves = tile.leaves[last] if stop is None else tile.leaves[last] & ~stop[last]
        mark = table["pour"].take(pa.array(last)) if with_marks else pa.nulls(len(last), pa.int64())
        found = pa.table({"grid_id": table["grid_id"], "i": table["i"], "j": table["j"], "last_i": pa.array(tile.i[last], pa.int32(), mask=~leaves), "last_j": pa.array(tile.j[last], pa.int32(), mask=~leaves), "to_i": table["to_i"], "to_j": table["to_j"], "leaves": pa.array(tile.leaves), "weight": pa.array(weight, pa.int64()), "mark": mark})
        return found.filter(pa.array(use))

    return kernel


def _flow(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    flow = steepest(cells, dx, dy).select("grid_id", *[F.col(c).cast("int").alias(c) for c in ("i", "j", "to_i", "to_j")])
    flow = flow.withColumns({"ti": tile("i"), "tj": tile("j")})
    crossing = F.col("to_i").isNotNull() & ((tile("to_i") != F.col("ti")) | (tile("to_j") != F.col("tj")))
    entries = flow.filter(crossing).select("grid_id", F.col("to_i").alias("i"), F.col("to_j").alias("j")).distinct().withColumn("entry", F.lit(True))
    return flow.join(entries, _CELL, "left").na.fill(False, ["entry"])


def _node(*columns: str) -> Column:
    return F.when(F.col(columns[1]).isNotNull(), F.struct(*[F.col(c).alias(n) for c, n in zip(columns, _CELL, strict=True)]))


def _forest(flow: DataFrame, with_marks: bool) -> DataFrame:
    """node (an exit), p (the next exit on its way), weight, mark (of the tile that it leads to), and the entry it leads to."""
    kind = flow.schema["grid_id"].dataType.simpleString()
    tiles = flow.groupBy("grid_id", "ti", "tj")
    links = written(tiles.applyInArrow(_links(with_marks), f"grid_id {kind}, i int, j int, last_i int, last_j int, to_i int, to_j int, leaves boolean, weight long, mark long"))
    exits = links.filter("leaves").select("grid_id", F.col("to_i").alias("ei"), F.col("to_j").alias("ej"), _node("grid_id", "i", "j").alias("node"), "weight")
    enters = links.select("grid_id", F.col("i").alias("ei"), F.col("j").alias("ej"), _node("grid_id", "last_i", "last_j").alias("p"), "mark")
    out = written(exits.join(enters, ["grid_id", "ei", "ej"], "left"))
    dropped(links)
    return out


def _summed(table: pa.Table) -> pa.Table:
    total = _Tile(table).sums(1 + table["inflow"].to_numpy())
    return pa.table({"grid_id": table["grid_id"], "i": table["i"], "j": table["j"], "to_i": table["to_i"], "to_j": table["to_j"], "cells_above": pa.array(total, pa.int64())})


def flow_accumulation(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """grid_id, i, j, to_i, to_j, cells_above: the cells whose way down leads through a cell, with itself."""
    flow = written(_flow(cells, dx, dy))
    kind = flow.schema["grid_id"].dataType.simpleString()
    forest = _forest(flow, False)
    inflow = subtree_sums(forest, "weight").join(forest.select("node", "grid_id", "ei", "ej"), "node").groupBy("grid_id", F.col("ei").alias("i"), F.col("ej").alias("j")).agg(F.sum("total").alias("inflow"))
    fed = flow.join(inflow, _CELL, "left").na.fill(0, ["inflow"])
    return fed.groupBy("grid_id", "ti", "tj").applyInArrow(_summed, f"grid_id {kind}, i int, j int, to_i int, to_j int, cells_above long")


def _reached(table: pa.Table) -> pa.Table:
    tile, pour = _Tile(table), table["pour"]
    last = tile.last(pour.is_valid().to_numpy())
    mark = pa.compute.coalesce(pour, table["far"]).take(pa.array(last))
    out = pa.table({"grid_id": table["grid_id"], "i": table["i"], "j": table["j"], "basin": mark})
    return out.filter(mark.is_valid())


def basins(cells: DataFrame, pours: DataFrame, dx: float, dy: float) -> DataFrame:
    """grid_id, i, j, basin: the first of the pour points (grid_id, i, j, pour) on a cell's way down, itself included.

    Cells whose water meets no pour point are left out.
    """
    at = pours.select("grid_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("pour").cast("long").alias("pour"))
    flow = written(_flow(cells, dx, dy).join(at, _CELL, "left"))
    kind = flow.schema["grid_id"].dataType.simpleString()
    forest = _forest(flow, True)
    far = led_to(forest, "mark").filter("mark IS NOT NULL").select("node.*", F.col("mark").alias("far"))
    return flow.join(far, _CELL, "left").groupBy("grid_id", "ti", "tj").applyInArrow(_reached, f"grid_id {kind}, i int, j int, basin long")
