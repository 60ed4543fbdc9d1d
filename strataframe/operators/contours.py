"""Contours and outlines: marching squares give directed segments between crossings of cell edges; tiles order
them as arrays, and list ranking the chains that cross tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chains import list_ranks
from .iterate import written

_SIDES = range(4)
#: Rows and columns of the tiles in which segments are put together as arrays.
TILE = 512


def contour_segments(cells: DataFrame, levels: list[float], keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """keys, level, i, j, a, b, ax, ay, bx, by: a segment of each 2 x 2 block from crossing a to b, higher values on its left.

    A crossing is numbered by its cell edge, so segments of neighbouring blocks share it. A value at the level counts as
    above it. Saddles are joined by the block's mean. Blocks with a missing value have no segments.
    """
    row, column = Window.partitionBy(*keys, "i").orderBy("j"), Window.partitionBy(*keys, "j").orderBy("i")
    wide = cells.groupBy(*keys).agg((F.max("j") + 1).cast("long").alias("_n"))
    next_to = F.lead("j").over(row) == F.col("j") + 1
    above = F.lead("i").over(column) == F.col("i") + 1
    d = cells.withColumns({"_r": F.when(next_to, F.lead("value").over(row)), "_x": F.lead("x").over(row), "_u": F.when(above, F.lead("value").over(column)), "_y": F.lead("y").over(column), "_above": above})
    d = d.withColumn("_d", F.when(F.col("_above"), F.lead("_r").over(column))).filter("value IS NOT NULL AND _r IS NOT NULL AND _u IS NOT NULL AND _d IS NOT NULL").join(wide, list(keys))
    d = d.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    lv, a, b, c, e = F.col("level"), F.col("value"), F.col("_r"), F.col("_d"), F.col("_u")
    part = lambda p, q: (lv - p) / F.when(q != p, q - p)
    x0, x1, y0, y1 = F.col("x"), F.col("_x"), F.col("y"), F.col("_y")
    at = lambda di, dj, upright: ((F.col("i") + di) * F.col("_n") + F.col("j") + dj) * 2 + upright
    lying = lambda p, q, y: (x0 + (x1 - x0) * part(p, q), y)
    upright = lambda p, q, x: (x, y0 + (y1 - y0) * part(p, q))
    # Counter-clockwise from the bottom: first and second corner, crossing, point.
    sides = [(a, b, at(0, 0, 0), lying(a, b, y0)), (b, c, at(0, 1, 1), upright(b, c, x1)), (c, e, at(1, 0, 0), lying(e, c, y1)), (e, a, at(0, 0, 1), upright(a, e, x0))]
    # A segment begins where the way around the block leaves the high side, and ends where it comes back to it.
    begins = [(p >= lv) & (q < lv) for p, q, _, _ in sides]
    ends = [(p < lv) & (q >= lv) for p, q, _, _ in sides]
    end = [F.when(ends[k], F.struct(n.alias("b"), x.alias("bx"), y.alias("by"))) for k, (_, _, n, (x, y)) in enumerate(sides)]
    saddle = sum((k.cast("int") for k in begins), F.lit(0)) == 2
    joined = ((a + b + c + e) / 4 >= lv) == (a >= lv)
    only = F.coalesce(*end)
    segment = lambda k: F.struct(sides[k][2].alias("a"), sides[k][3][0].alias("ax"), sides[k][3][1].alias("ay"), F.when(saddle, F.when(joined, end[k ^ 1]).otherwise(end[3 - k])).otherwise(only).alias("end"))
    made = F.array_compact(F.array(*[F.when(begins[k], segment(k)) for k in _SIDES]))
    return d.select(*keys, "level", "i", "j", F.explode(made).alias("s")).select(*keys, "level", "i", "j", "s.a", "s.end.b", "s.ax", "s.ay", "s.end.bx", "s.end.by")


def contour_lines(cells: DataFrame, levels: list[float], keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """keys, level, line_id, seq, x, y, ring, area: the vertices of each line in order, higher values on its left.

    A ring starts at its least crossing and repeats it at the end; other lines run from border to border (or gap). area is
    signed and of rings only: negative where the ring goes clockwise, so that it surrounds lower values (a hole).
    """
    name = [*keys, "level"]
    segments = contour_segments(cells, levels, keys)
    tiled = segments.select(*name, F.floor(F.col("i") / TILE).alias("_ti"), F.floor(F.col("j") / TILE).alias("_tj"), "a", "b", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    kinds = ", ".join(f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in name)
    parts = written(tiled.groupBy(*name, "_ti", "_tj").applyInPandas(_tile_chains(name), f"{kinds}, start long, at long, seq long, x double, y double, is_end boolean, n long, area double, least long, least_seq long"))
    told = lambda d, line, seq, ring: d.select(*name, line.alias("line_id"), seq.alias("seq"), "x", "y", ring.alias("ring"), "area")
    inside = told(parts.filter("n IS NOT NULL"), F.col("start"), F.col("seq"), F.lit(True))
    # Chains that leave their tile are one link each between the crossings where they meet others.
    node = lambda c: F.struct(*name, F.col(c).alias("at"))
    chains = parts.filter("is_end").select(*name, "start", F.col("at").alias("end"), F.col("seq").alias("length"), "area", "least", "least_seq", F.col("x").alias("_ex"), F.col("y").alias("_ey"))
    ranks = written(list_ranks(chains.select(node("start").alias("node"), node("end").alias("nxt"), "length"), "length"))
    ranked = chains.withColumn("node", node("start")).join(ranks, "node").drop("node")
    whole = ranked.filter("ring").groupBy("head").agg(F.sum("length").alias("n"), F.sum("area").alias("_area"), F.min(F.struct("least", (F.col("rank") + F.col("least_seq")).alias("first"))).alias("_l"))
    before = chains.select(*name, F.col("end").alias("start"), "_ex", "_ey")
    ranked = ranked.drop("area", "least", "least_seq", "_ex", "_ey").join(whole, "head", "left").join(before, [*name, "start"], "left")
    ranked = written(ranked.select(*name, "start", "end", "ring", F.coalesce("_l.least", F.col("head")["at"]).alias("line_id"), (F.col("rank") - F.coalesce("_l.first", F.lit(0))).alias("_from"), F.col("n").alias("_n"), F.col("_area").alias("area"), "_ex", "_ey"))
    at_start = F.col("seq") == 0
    shared = lambda c, e: F.when(at_start, F.least(c, e)).otherwise(F.col(c)).alias(c)
    rank = F.col("_from") + F.col("seq")
    rank = F.when(F.col("ring"), F.pmod(rank, "_n")).otherwise(rank)
    open_parts = parts.filter("n IS NULL").drop("area", "n", "least", "least_seq")
    across = open_parts.filter("NOT is_end").join(ranked, [*name, "start"]).select(*name, "line_id", rank.alias("seq"), shared("x", "_ex"), shared("y", "_ey"), "ring", "area", "_n")
    closing = across.filter("ring AND seq = 0").withColumn("seq", F.col("_n"))
    # The last crossing of a line that is open: an end where no chain starts.
    ends = open_parts.filter("is_end").join(chains.select(*name, F.col("start").alias("at")), [*name, "at"], "left_anti")
    ends = ends.join(ranked.select(*name, "start", "line_id", "_from", "area"), [*name, "start"])
    return inside.unionByName(across.drop("_n")).unionByName(closing.drop("_n")).unionByName(told(ends, F.col("line_id"), F.col("_from") + F.col("seq"), F.lit(False)))


def _ranked(back: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Heads, ranks, least names and whether in a ring, of links whose predecessors are back (-1: none), by pointer doubling."""
    p, head, rank, least = back.copy(), np.arange(len(back)), (back >= 0).astype(np.int64), name.copy()
    on = np.flatnonzero(p >= 0)
    head[on], least[on] = p[on], np.minimum(name[on], name[p[on]])
    while len(on):
        there = p[on]
        smaller = np.minimum(least[on], least[there])
        moved = (p[there] < 0) | (smaller < least[on])
        if not moved.any():
            break
        rank[on], head[on], least[on], p[on] = rank[on] + rank[there], head[there], smaller, p[there]
        on = on[p[on] >= 0]
    return head, rank, least, p >= 0


def _tile_chains(name: list[str]):
    """The chains of a tile's segments: a row for each crossing they start from and one for the end of each chain.

    Rings inside the tile start at their least crossing, carry their length n and area and are closed.
    """

    def kernel(d: pd.DataFrame) -> pd.DataFrame:
        a, b = d["a"].to_numpy(), d["b"].to_numpy()
        ax, ay, bx, by = (d[c].to_numpy(float) for c in ("ax", "ay", "bx", "by"))
        order = np.argsort(a, kind="stable")
        place = np.minimum(np.searchsorted(a, b, sorter=order), len(a) - 1)
        follows = a[order[place]] == b
        back = np.full(len(a), -1)
        back[order[place[follows]]] = np.flatnonzero(follows)
        head, rank, least, ring = _ranked(back, a)
        if ring.any():
            cut = back.copy()
            cut[ring & (a == least)] = -1
            rings = np.flatnonzero(ring)
            local = np.full(len(a), -1)
            local[rings] = np.arange(len(rings))
            h, r, _, _ = _ranked(np.where(cut[rings] >= 0, local[cut[rings]], -1), a[rings])
            head[rings], rank[rings] = rings[h], r
        x, y = np.where(back >= 0, np.fmin(ax, bx[back]), ax), np.where(back >= 0, np.fmin(ay, by[back]), ay)
        area = np.bincount(head, (ax * by - bx * ay) / 2, len(a))
        size = np.bincount(head, minlength=len(a))
        lowest = a.copy()
        np.minimum.at(lowest, head, a)
        low_at = np.zeros(len(a), np.int64)
        is_low = a == lowest[head]
        low_at[head[is_low]] = rank[is_low]
        closing, ends = np.flatnonzero(ring & (head == np.arange(len(a)))), np.flatnonzero(~ring & ~follows)
        rows = np.arange(len(a))
        got = np.concatenate([rows, closing, ends])
        h, n_rows = head[got], len(a)
        in_ring, is_end = ring[got], np.arange(len(got)) >= n_rows + len(closing)
        out = {
            "start": a[h],
            "at": np.concatenate([a, a[closing], b[ends]]),
            "seq": np.concatenate([rank, size[closing], rank[ends] + 1]),
            "x": np.concatenate([x, x[closing], bx[ends]]),
            "y": np.concatenate([y, y[closing], by[ends]]),
            "is_end": is_end,
            "n": pd.array(size[h], "Int64"),
            "area": area[h],
            "least": lowest[h],
            "least_seq": low_at[h],
        }
        out["n"][~in_ring] = pd.NA
        return pd.DataFrame({k: d[k].iloc[0] for k in name} | out)[[*name, *out]]

    return kernel


def class_outlines(cells: DataFrame, classes: list[float]) -> DataFrame:
    """grid_id, class, line_id, seq, x, y, ring, hole: the outlines of the cells of each class, the class on their left."""
    mask = cells.withColumn("class", F.explode(F.array(*[F.lit(float(k)) for k in classes]))).withColumn("value", (F.col("value") == F.col("class")).cast("double"))
    found = contour_lines(mask, [0.5], ("grid_id", "class"))
    return found.select("grid_id", "class", "line_id", "seq", "x", "y", "ring", F.coalesce(F.col("area") < 0, F.lit(False)).alias("hole"))
