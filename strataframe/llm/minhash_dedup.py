"""MinHash near-dedup with tensored banding.

Two small collections A and B of HASHES groups of BAND minhashes each give HASHES**2 table keys (A[i], B[j]), so
2 * HASHES * BAND minhashes do the work of HASHES**2 * 2 * BAND. Two sets of similarity J meet in some table with
probability (1 - (1 - J**BAND)**HASHES)**2: 0.9998 at 0.85, 0.99999 at 0.9. Documents with equal shingle sets are one
class from the start. A packed exchange joins the classes of each key to the key's smallest id; what these edges connect
is a candidate group. Groups are compared on their full sets, in tiles where they are large, and a tile tells a spanning
forest of its links, never its pairs; so no candidate is left out, and no group is spelt out in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import U64, Words, column_slices, mix, random_key, release, shingle_sets, trimmed
from ._frames import among, heads_of, packed_by_frame, packed_schema, partitions, spans_of, to_buckets, unpacked, written
from .components import connected_components
from .embedding_dedup import forest

HASHES, BAND = 10, 3
FRAME_ROWS, BUCKET_KEYS = 4096, 400_000
#: Up to so many candidates (16 bytes each) are broadcast to read their texts; beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Classes in a cell of a large group, and in a task of small groups.
CELL, SMALL_ROWS = 512, 256
#: A value in this many pairs of sets is counted by a matrix product of so many columns; other values in so many at once.
DENSE_PAIRS, DENSE_COLUMNS, SPARSE_ENTRIES = 64, 4096, 1 << 16


def _minhashes(row: np.ndarray, value: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest permuted hash of each row's set for each seed; rows are sorted."""
    heads = heads_of(row)
    out = np.empty((len(heads), len(seeds)), U64)
    for n, seed in enumerate(seeds):
        x = (value ^ seed) * U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        out[:, n] = np.minimum.reduceat(x, heads)
    return out


def _bands(minhashes: np.ndarray) -> np.ndarray:
    """Fold each BAND minhashes into one value."""
    out = np.zeros((len(minhashes), minhashes.shape[1] // BAND), U64)
    for b in range(BAND):
        out = mix(out * U64(0xD1342543DE82EF95) + minhashes[:, b::BAND])
    return out


def _sketch(shingle: int, key: int):
    seeds = mix(np.arange(1, 2 * HASHES * BAND + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in column_slices(batch["text"]):
                row, value = shingle_sets(Words(raw, offsets, fold=True, key=key), shingle)
                size = np.bincount(row, minlength=j - i).astype(np.int64)
                h1, h2, bands = np.zeros(j - i, U64), np.zeros(j - i, U64), [None] * (j - i)
                if len(row):
                    heads = heads_of(row)
                    own = row[heads]
                    h1[own] = np.add.reduceat(mix(value ^ U64(0x1234567)), heads)
                    h2[own] = np.add.reduceat(mix(value * U64(0xD1342543DE82EF95) + U64(99)), heads)
                    for r, x in zip(own, _bands(_minhashes(row, value, seeds)), strict=True):
                        bands[r] = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(i, j - i), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(bands, pa.binary())],
                    ["id", "n_shingles", "h1", "h2", "bands"],
                )
        release()

    return kernel


def _tables(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Class index and key of all HASHES**2 tables."""
    bands = unpacked(table["bands"])[0].reshape(-1, 2 * HASHES)
    number = (np.arange(HASHES * HASHES, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    keys = mix(bands[:, :HASHES, None] * U64(0xD1342543DE82EF95) + bands[:, None, HASHES:]).reshape(len(bands), -1)
    return np.repeat(np.arange(len(bands)), HASHES * HASHES), mix(keys ^ number[None, :]).ravel()


def _own_keys(buckets: int):
    """Each distinct key of a frame with the smallest id that has it, and 1 where two classes of the frame have it."""

    def kernel(table: pa.Table) -> pa.Table:
        owner, keys = _tables(table)
        reps = table["rep"].to_numpy()[owner]
        order = np.lexsort((reps, keys))
        keys, reps = keys[order], reps[order]
        heads = heads_of(keys)
        twice = (np.maximum.reduceat(reps, heads) != reps[heads]).astype(np.uint8)
        return to_buckets(table["frame"][0].as_py(), buckets, keys[heads], reps[heads], twice)

    return kernel


def _hubs(table: pa.Table) -> pa.Table:
    """The smallest id of each key that two classes have, told to every frame that has the key."""
    keys, sizes = unpacked(table["c0"])
    reps, _ = unpacked(table["c1"], np.int64)
    twice, _ = unpacked(table["c2"], np.uint8)
    frame = np.repeat(table["frame"].to_numpy(), sizes)
    order = np.lexsort((reps, keys))
    keys, reps, twice, frame = keys[order], reps[order], twice[order], frame[order]
    heads = heads_of(keys)
    counts = np.diff([*heads, len(keys)])
    use = np.repeat((counts > 1) | (np.maximum.reduceat(twice, heads) > 0), counts)
    hubs = np.repeat(reps[heads], counts)
    return packed_by_frame(frame[use], keys[use], hubs[use])


def _edges(table: pa.Table, told: pa.Table) -> pa.Table:
    """Each class of the frame joined to the hubs of its keys."""
    owner, keys = _tables(table)
    pool, hubs = unpacked(told["c0"])[0], unpacked(told["c1"], np.int64)[0]
    order = np.argsort(pool, kind="stable")
    pool, hubs = pool[order], hubs[order]
    use = among(keys, pool)
    reps = table["rep"].to_numpy()[owner[use]]
    hub = hubs[np.searchsorted(pool, keys[use])]
    pairs = np.unique(np.stack([reps, hub], 1)[reps != hub], axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


class Sets:
    """Shingle sets end to end, with where each begins."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def take(self, which: np.ndarray) -> Sets:
        at = np.concatenate([[0], np.cumsum(self.sizes)])
        parts = [self.values[at[k] : at[k + 1]] for k in which]
        return Sets(np.concatenate(parts) if parts else self.values[:0], self.sizes[which])


def sets_of(column, shingle: int, key: int) -> Sets:
    values, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j, raw, offsets in column_slices(column):
        row, value = shingle_sets(Words(raw, offsets, fold=True, key=key), shingle)
        values.append(value)
        sizes.append(np.bincount(row, minlength=j - i))
    return Sets(np.concatenate(values), np.concatenate(sizes))


def intersections(a: Sets, b: Sets) -> np.ndarray:
    """Sizes of all intersections. Values in many sets of both sides are counted by matrix products, others one by one."""
    out = np.zeros((len(a.sizes), len(b.sizes)), np.int64)
    common = np.intersect1d(a.values, b.values)
    if not len(common):
        return out
    (col_a, doc_a), (col_b, doc_b) = ((np.searchsorted(common, s.values[u]), s.owner[u]) for s in (a, b) for u in [among(s.values, common)])
    n_a, n_b = np.bincount(col_a, minlength=len(common)), np.bincount(col_b, minlength=len(common))
    often = n_a * n_b >= DENSE_PAIRS
    place = np.cumsum(often) - 1
    for low in range(0, int(often.sum()), DENSE_COLUMNS):
        sides = []
        for col, doc, n in ((col_a, doc_a, len(a.sizes)), (col_b, doc_b, len(b.sizes))):
            use = often[col] & (place[col] >= low) & (place[col] < low + DENSE_COLUMNS)
            m = np.zeros((n, DENSE_COLUMNS), np.float32)
            m[doc[use], place[col[use]] - low] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    use_a, use_b = ~often[col_a], ~often[col_b]
    col_a, doc_a, col_b, doc_b = col_a[use_a], doc_a[use_a], col_b[use_b], doc_b[use_b]
    order = np.argsort(col_b, kind="stable")
    col_b, doc_b = col_b[order], doc_b[order]
    first = np.searchsorted(col_b, col_a)
    for low in range(0, len(col_a), SPARSE_ENTRIES):
        part = slice(low, low + SPARSE_ENTRIES)
        times = n_b[col_a[part]]
        shift = np.cumsum(times) - times
        other = doc_b[np.repeat(first[part] - shift, times) + np.arange(times.sum())]
        cell = np.repeat(doc_a[part], times) * len(b.sizes) + other
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    return out


def linked_roots(ids: np.ndarray, a: Sets, b: Sets | None, numerator: int, denominator: int) -> np.ndarray:
    """For each id (of a, then of b) the smallest that links inside a, or between a and b, reach."""
    both = intersections(a, a if b is None else b)
    sizes_b = (a if b is None else b).sizes
    i, j = np.nonzero(denominator * both >= numerator * (a.sizes[:, None] + sizes_b[None, :] - both))
    if b is not None:
        j = j + len(a.sizes)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return ids[order][forest(len(ids), rank[i], rank[j])[rank]]


def _small_groups(shingle: int, key: int, numerator: int, denominator: int):
    """Whole candidate groups of at most CELL classes, many in one task."""

    def kernel(table: pa.Table) -> pa.Table:
        ids, group = table["rep"].to_numpy(), table["group"].to_numpy()
        sets = sets_of(table["text"], shingle, key)
        order = np.argsort(group, kind="stable")
        out_a, out_b = [], []
        for x, y in spans_of(group[order]):
            own = order[x:y]
            root = linked_roots(ids[own], sets.take(own), None, numerator, denominator)
            out_a.append(ids[own])
            out_b.append(root)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return kernel


def _cell(shingle: int, key: int):
    def kernel(table: pa.Table) -> pa.Table:
        sets = sets_of(table["text"], shingle, key)
        one = {name: table[name].slice(0, 1) for name in ("group", "step", "block", "same", "above", "below")}
        packed = {"ids": table["rep"].to_numpy(), "sizes": sets.sizes.astype(np.int64), "sets": sets.values}
        return pa.table(one | {k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()})

    return kernel


def _cell_pair(numerator: int, denominator: int):
    def kernel(table: pa.Table) -> pa.Table:
        read = lambda name, r, kind: np.frombuffer(table[name][r].as_py(), kind)
        ids = [read("ids", r, np.int64) for r in range(table.num_rows)]
        sets = [Sets(read("sets", r, U64), read("sizes", r, np.int64)) for r in range(table.num_rows)]
        every = np.concatenate(ids)
        root = linked_roots(every, sets[0], sets[1] if len(sets) > 1 else None, numerator, denominator)
        return pa.table({"a": every[every != root], "b": root[every != root]})

    return kernel


def _linked(members: DataFrame, shingle: int, key: int, numerator: int, denominator: int) -> DataFrame:
    """members (rep, group, n, text) -> (a, b): a spanning forest of the links inside every candidate group.

    Larger groups are dealt to cells by steps of set size (a step is the largest ratio of linked sizes, so links stay in
    a step or go to the next) and by a hash; pairs of cells are compared, each telling no more edges than it has ids.
    """
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("m"))
    sized = members.join(sizes, "group")
    n_small = sizes.filter(F.col("m") <= CELL).agg(F.sum("m")).first()[0] or 0
    bins = max(1, -(-n_small // SMALL_ROWS))
    small = sized.filter(F.col("m") <= CELL).select(F.pmod(F.xxhash64("group"), F.lit(bins)).cast("int").alias("bin"), "rep", "group", "text")
    links = small.groupBy("bin").applyInArrow(trimmed(_small_groups(shingle, key, numerator, denominator)), "a long, b long")

    step = F.floor(F.log("n") / F.log(F.lit(denominator / numerator)) + 1e-9).cast("int")
    large = sized.filter(F.col("m") > CELL).select("rep", "group", "text", step.alias("step"))
    cells = large.groupBy("group", "step").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("same"))
    shifted = lambda by, name: cells.select("group", (F.col("step") - by).alias("step"), F.col("same").alias(name))
    cells = cells.join(shifted(1, "above"), ["group", "step"], "left").join(shifted(-1, "below"), ["group", "step"], "left").na.fill(0, ["above", "below"])
    dealt = large.join(cells, ["group", "step"]).withColumn("block", F.pmod(F.xxhash64("rep"), "same").cast("int"))
    packed = dealt.groupBy("group", "step", "block").applyInArrow(trimmed(_cell(shingle, key)), "group long, step int, block int, same int, above int, below int, ids binary, sizes binary, sets binary")
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    b, s = F.col("block"), F.col("step")
    tiles = F.concat(
        F.transform(every("same"), lambda o: F.struct(s.alias("step"), F.least(b, o).alias("low"), F.greatest(b, o).alias("high"), F.lit(0).alias("up"))),
        F.transform(every("above"), lambda o: F.struct(s.alias("step"), b.alias("low"), o.alias("high"), F.lit(1).alias("up"))),
        F.transform(every("below"), lambda o: F.struct((s - 1).alias("step"), o.alias("low"), b.alias("high"), F.lit(1).alias("up"))),
    )
    tiled = packed.select("group", F.explode(tiles).alias("t"), "ids", "sizes", "sets").select("group", "t.*", "ids", "sizes", "sets")
    return links.unionByName(tiled.groupBy("group", "step", "low", "high", "up").applyInArrow(trimmed(_cell_pair(numerator, denominator)), "a long, b long"))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """Link documents whose sets of distinct word shingles have intersection / union >= threshold (as a fraction).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a text of fewer words than the shingle
    has its whole sequence as its one shingle.

    Returns one row for each row of docs: id_col, n_shingles, component_id (smallest id reachable by links, its own
    included), kept (id is component_id). Null, empty and blank texts have no shingles and link with nothing. Rows that
    repeat an id are each compared; an id's rows may so join components. Other columns are not read. An empty table
    gives an empty table. Rows without an id are returned with a null component and not kept.
    """
    spark, key = docs.sparkSession, random_key()
    numerator, denominator = threshold
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sketched = written(texts.mapInArrow(_sketch(shingle, key), "id long, n_shingles long, h1 long, h2 long, bands binary"), "sketches")
    same = ["h1", "h2", "n_shingles"]
    classes = sketched.filter("n_shingles > 0 AND id IS NOT NULL").groupBy(same).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    n_classes = classes.count()

    parts = partitions(spark)
    frames = max(1, -(-n_classes // FRAME_ROWS))
    buckets = max(1, -(-n_classes * HASHES * HASHES // BUCKET_KEYS))
    framed = classes.select(F.pmod(F.xxhash64("rep"), F.lit(frames)).cast("int").alias("frame"), "rep", "bands").repartition(parts, "frame")
    told = framed.groupBy("frame").applyInArrow(trimmed(_own_keys(buckets)), packed_schema(3)).groupBy("bucket").applyInArrow(trimmed(_hubs), packed_schema(2)).repartition(parts, "frame")
    edges = framed.groupBy("frame").cogroup(told.groupBy("frame")).applyInArrow(trimmed(_edges, 2), "a long, b long")
    groups = connected_components(edges)

    heads = groups.select(F.col("component").alias("id")).distinct()
    grouped = written(groups.select("id", F.col("component").alias("group")).unionByName(heads.select("id", F.col("id").alias("group"))), "groups")
    near = F.broadcast(grouped) if grouped.count() <= BROADCAST_IDS else grouped
    sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n_shingles").alias("n"))
    members = texts.join(near, "id").join(sizes, "id").select(F.col("id").alias("rep"), "group", "n", "text")
    links = connected_components(_linked(written(members, "candidates"), shingle, key, numerator, denominator))

    found = classes.select("rep", *same).join(links.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select(*same, F.coalesce("component", "rep").alias("component"))
    out = sketched.drop("bands").join(found, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
