"""Embedding near-dedup by int8 tile products with rigorous error bounds.

A unit vector x is s*q + e with q in -127..127. For two of them |x.y - sx*sy*(qx.qy)| <= |ex| + (1 + |ex|)*|ey|. Tiles of two
blocks take integer products (exact in float32: 127 * 127 * dimension < 2**24 up to 1040 dimensions, in double beyond),
and only pairs whose product plus bound reaches the threshold are computed again in double precision. A tile tells how
many links each vector has in it and a spanning forest of them, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import written
from .components import connected_components

BLOCK_ROWS = 1024
PAIRS_AT_ONCE = 1 << 16


def _pack(table: pa.Table) -> pa.Table:
    order = np.argsort(table["rep"].to_numpy(), kind="stable")
    vectors = table["vec"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)[order]
    # By a power of two each, which changes no digit, so that no square is too large or too small.
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])
    return pa.table(
        {name: table[name].slice(0, 1) for name in ("label", "dim", "block", "blocks")}
        | {
            "ids": pa.array([table["rep"].to_numpy()[order].tobytes()], pa.binary()),
            "copies": pa.array([table["copies"].to_numpy()[order].tobytes()], pa.binary()),
            "vecs": pa.array([vectors.astype(np.float64).tobytes()], pa.binary()),
        }
    )


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 codes, scales, and the norms of what the codes leave out."""
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - codes * scale[:, None]
    return unit, codes, scale, np.sqrt((rest * rest).sum(1)) + 1e-12


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine >= threshold (i < j if the blocks are the same)."""
    ux, qx, sx, ex = quantised(x)
    uy, qy, sy, ey = (ux, qx, sx, ex) if same else quantised(y)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    product = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64)
    product *= sx[:, None]
    product *= sy[None, :]
    product += (ex[:, None] + 1e-9) + (1 + ex[:, None]) * ey[None, :]
    i, j = np.nonzero(product >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), PAIRS_AT_ONCE):
        b = slice(a, a + PAIRS_AT_ONCE)
        p, q = x[i[b]], y[j[b]]
        keep[b] = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1)) >= threshold
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        np.minimum.at(fresh, i, low)
        np.minimum.at(fresh, j, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _tile(threshold: float):
    def kernel(table: pa.Table) -> pa.Table:
        blocks = [[np.frombuffer(table[c][r].as_py(), t) for c, t in (("ids", np.int64), ("copies", np.int64), ("vecs", np.float64))] for r in np.argsort(table["block"].to_numpy())]
        (ids, copies, x), (ids2, copies2, y) = blocks[0], blocks[-1]
        same = len(blocks) == 1
        i, j = tile_links(x.reshape(len(ids), -1), y.reshape(len(ids2), -1), threshold, same)
        links, links2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
        np.add.at(links, i, copies2[j])
        np.add.at(links if same else links2, j, copies[i])
        every = ids if same else np.concatenate([ids, ids2])
        count = links if same else np.concatenate([links, links2])
        root = every[forest(len(every), i, j if same else j + len(ids))]
        use = count > 0
        return pa.table({"id": every[use], "n": count[use], "root": root[use]})

    return kernel


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Link vectors with equal labels and cosine >= threshold in double precision.

    Returns one row for each row of vectors: id_col, n_links (other rows linked directly), component_id (smallest id
    reachable, its own included), kept. Rows whose label or vector is null, whose vector is empty or zero or holds null
    or non-finite components link with nothing; so do vectors of different lengths. Equal vectors are one class that is
    compared once and counts all its rows. Other columns are not read. An empty table gives an empty table.
    """
    vec = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall("vec", lambda v: v == 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec"))
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad & ~zero, F.lit(False)))
    keys = [F.when(F.col("valid"), x).alias(n) for n, x in (("h1", F.xxhash64("vec")), ("h2", F.xxhash64(F.lit(17), "vec")))]
    classes = rows.filter("valid").select("id", "label", "vec", *keys).groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"), F.size(F.first("vec")).alias("dim"))
    classes = written(classes, "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    kind = classes.schema["label"].dataType.simpleString()
    packed = placed.select("label", "dim", "block", "blocks", "rep", "copies", "vec").groupBy("label", "dim", "block").applyInArrow(_pack, f"label {kind}, dim int, block int, blocks int, ids binary, copies binary, vecs binary")
    tiles = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = written(tiles.groupBy("label", "dim", "lo", "hi").applyInArrow(_tile(threshold), "id long, n long, root long"), "vector-links")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = classes.select("label", "h1", "h2", "rep", "copies").join(links, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    out = rows.select("id", "label", "valid", *keys).join(told, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("valid"), F.col("copies") - 1 + F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
