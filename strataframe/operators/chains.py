"""Lists and forests whose links are a table: pointer doubling, so a path of n links takes about log2(n) rounds.

Each round is a written table. A node's pointer is used by one node only in a list, so its joins have no hot key; in a
forest, nodes leave the join once their pointer has passed the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import dropped, written


def _rounds(state: DataFrame, step, unsettled: str) -> DataFrame:
    """step(state), with the column moved, until no row moved; rounds are few, so there is no bound on them."""
    state = written(state)
    while not state.filter(unsettled).isEmpty():
        last, state = state, written(step(state))
        dropped(last)
        if state.filter("moved").isEmpty():
            break
    return state


def list_ranks(links: DataFrame, length: str | None = None) -> DataFrame:
    """node, head, rank, ring of every node of links (node, nxt): each node has at most one link out and one in.

    Lists begin at the node without a link to it; a ring begins at its least node. rank counts from 0 at the head, by one a
    link or by its length.
    """
    back = links.select(F.col("nxt").alias("node"), F.col("node").alias("p"), (F.col(length) if length else F.lit(1)).cast("long").alias("n"))
    ends = links.select("node").join(back.select("node"), "node", "left_anti")
    start = back.unionByName(ends.select("node", F.lit(None).cast(back.schema["p"].dataType).alias("p"), F.lit(0).cast("long").alias("n")))
    kept = written(start)
    first = F.coalesce("p", "node")

    def begin(d: DataFrame) -> DataFrame:
        return d.select("node", "p", F.when(F.col("p").isNull(), 0).otherwise(F.col("n")).alias("rank"), first.alias("head"), F.least("node", first).alias("least"), F.col("p").isNotNull().alias("moved"))

    def step(s: DataFrame) -> DataFrame:
        there = s.select(F.col("node").alias("p"), F.col("p").alias("_p"), F.col("rank").alias("_r"), F.col("head").alias("_h"), F.col("least").alias("_l"))
        j = s.join(there, "p", "left")
        on = F.col("p").isNotNull()
        least = F.least("least", "_l")
        return j.select("node", F.col("_p").alias("p"), (F.col("rank") + F.coalesce("_r", F.lit(0))).alias("rank"), F.coalesce("_h", "head").alias("head"), least.alias("least"), (on & (F.col("_p").isNull() | (least < F.col("least")))).alias("moved"))

    found = _rounds(begin(kept), step, "p IS NOT NULL")
    open_lists = found.filter("p IS NULL").select("node", "head", "rank", F.lit(False).alias("ring"))
    if found.filter("p IS NOT NULL").isEmpty():
        return open_lists
    rings = found.filter("p IS NOT NULL").select("node", "least")
    cut = kept.join(rings, "node").select("node", F.when(F.col("node") != F.col("least"), F.col("p")).alias("p"), "n")
    closed = _rounds(begin(cut), step, "p IS NOT NULL").select("node", "head", "rank", F.lit(True).alias("ring"))
    return open_lists.unionByName(closed)


def subtree_sums(forest: DataFrame, weight: str) -> DataFrame:
    """node, total of forest (node, p, weight): the weights of a node and of all nodes whose way along p leads through it."""

    def step(s: DataFrame) -> DataFrame:
        arrived = s.filter("p IS NOT NULL").groupBy(F.col("p").alias("node")).agg(F.sum("total").alias("_t"))
        there = s.filter("p IS NOT NULL").select(F.col("node").alias("p"), F.col("p").alias("_p"))
        j = s.join(arrived, "node", "left").join(there, "p", "left")
        return j.select("node", F.col("_p").alias("p"), (F.col("total") + F.coalesce("_t", F.lit(0))).alias("total"), F.col("p").isNotNull().alias("moved"))

    start = forest.select("node", "p", F.col(weight).alias("total"), F.lit(True).alias("moved"))
    return _rounds(start, step, "p IS NOT NULL").select("node", "total")


def led_to(forest: DataFrame, mark: str) -> DataFrame:
    """node, mark of forest (node, p, mark): a node's own mark, or else the first one on its way along p; null without any."""

    def step(s: DataFrame) -> DataFrame:
        there = s.select(F.col("node").alias("p"), F.col("p").alias("_p"), F.col("mark").alias("_m"))
        j = s.join(there, "p", "left")
        mark = F.coalesce("mark", "_m")
        return j.select("node", F.when(mark.isNull(), F.col("_p")).alias("p"), mark.alias("mark"), F.col("p").isNotNull().alias("moved"))

    start = forest.select("node", F.when(F.col(mark).isNull(), F.col("p")).alias("p"), F.col(mark).alias("mark"), F.lit(True).alias("moved"))
    return _rounds(start, step, "p IS NOT NULL").select("node", F.col("mark").alias(mark))
