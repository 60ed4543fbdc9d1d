"""Connected components by alternating large and small stars (Kiveris et al. 2014), each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import drop_written, written

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v, each once. Link neighbours to the smallest of each node's neighbourhood."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in an edge that is not its component's smallest; the smallest ids are absent.

    Edges with a null end and loops are ignored. No edges: no rows. Raises if MAX_ROUNDS do not settle it.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    e = written(e.filter(F.col("ok") & (F.col("u") != F.col("v"))).select("u", "v").distinct(), "edges")
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        last, e = e, written(_stars(_stars(e, True), False), "stars")
        drop_written(last)
        new = _mark(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
