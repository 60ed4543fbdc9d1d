"""K-d tree sharding, in DataFrame operations alone.

Rows of equal text are one unit: they have one place in the tree and go to one shard. A node is split at the weighted
median along its widest metadata dimension, in proportion to the shards on either side, until each leaf holds the bytes
of one shard. Medians are found in passes over the slim table of units: a histogram of the leading bits of the key, then
of the next bits inside the bin that holds the median. The driver sees no rows, only a histogram of at most 2**PASS_BITS
sums for each node, however many rows there are.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._frames import drop_written, written

#: The key has DIM_BITS of the dimension and TIE_BITS of a hash of the text; a pass resolves PASS_BITS of it.
DIM_BITS, TIE_BITS, PASS_BITS, PASSES = 24, 18, 14, 3
_TOP = (1 << DIM_BITS) - 1
NUMBERED_ROWS = 4096
#: Equal texts of more than this share of a shard are split by a hash of the id, into units of PART_SHARE of a shard.
GROUP_SHARE, PART_SHARE = 1 / 3, 1 / 8
#: Up to so many split groups are broadcast; there are no more than shards / GROUP_SHARE of them.
BROADCAST_GROUPS = 100_000
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
GROUP = ("_h1", "_h2")


def _scaled(column: Column, kind: str, low, high) -> Column:
    """A column as an integer of DIM_BITS bits that keeps its order (numbers) or its equality (anything else); null is lowest."""
    if kind in NUMBERS:
        span = float(high) - float(low) if low is not None else 0.0
        value = column.cast("double")
        value = F.when(F.isnan(value), F.lit(None)).otherwise(value)
        share = (value - F.lit(float(low or 0))) / F.lit(span) if span > 0 else value * 0.0
        return F.coalesce(F.floor(share * (_TOP - 1)).cast("long") + 1, F.lit(0))
    return F.when(column.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(column), F.lit(_TOP)) + 1).cast("long")


def _by_node(values: dict, default) -> Column:
    """A column that looks _node up in a dictionary of the driver's (one entry for each shard at most)."""
    out = F.lit(default)
    for node, value in values.items():
        out = F.when(F.col("_node") == node, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def _cuts(units: DataFrame, key: Column, goal: dict[int, float]) -> dict[int, int]:
    """For each node the least key of its right side, so that the left side's bytes are as near to its goal as can be."""
    keyed = units.filter(F.col("_node").isin(list(goal))).select("_node", "_bytes", key.alias("_key"))
    prefix, before = dict.fromkeys(goal, 0), dict.fromkeys(goal, 0)
    for turn in range(PASSES):
        shift = DIM_BITS + TIE_BITS - PASS_BITS * (turn + 1)
        inside = keyed.filter(F.shiftright("_key", shift + PASS_BITS) == _by_node(prefix, -1))
        bins = defaultdict(list)
        for row in inside.groupBy("_node", F.shiftright("_key", shift).alias("_b")).agg(F.sum("_bytes").alias("_s")).collect():
            bins[row["_node"]].append((row["_b"], row["_s"]))
        for node, own in bins.items():
            for b, s in sorted(own):
                if before[node] + s >= goal[node] or b == max(own)[0]:
                    # In the last pass the median's bin goes to the side that leaves both nearer to their goals.
                    nearer_left = turn == PASSES - 1 and abs(before[node] + s - goal[node]) < abs(before[node] - goal[node])
                    prefix[node] = b + nearer_left
                    break
                before[node] += s
    return {node: p << DIM_BITS + TIE_BITS - PASS_BITS * PASSES for node, p in prefix.items()}


def _grown(units: DataFrame, columns: list[str], shards: int) -> DataFrame:
    """units with _node, the shard: the tree is grown level by level, each level a written table."""
    units = written(units.withColumn("_node", F.lit(0)), "kd-units")
    share = {0: shards}
    while max(share.values()) > 1:
        boxes = units.groupBy("_node").agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns], F.sum("_bytes").alias("_bytes")).collect()
        split = [b for b in boxes if share[b["_node"]] > 1]
        if not split:
            break
        widest = {b["_node"]: max(columns, key=lambda c: b[c] or 0) for b in split}  # noqa: B023
        key = _by_node({n: F.col(c) for n, c in widest.items()}, 0).cast("long") * F.lit(1 << TIE_BITS) + F.col("_tie")
        cut = _cuts(units, key, {b["_node"]: b["_bytes"] * (share[b["_node"]] // 2) / share[b["_node"]] for b in split})
        half = {n: share[n] // 2 for n in cut}
        right = (key >= _by_node(cut, 0)) & F.col("_node").isin(list(cut))
        last, units = units, written(units.withColumn("_node", F.col("_node") + F.when(right, _by_node(half, 0)).otherwise(0)), "kd-level")
        drop_written(last)
        share = {n: s for n, s in share.items() if n not in half} | {n: h for n, h in half.items()} | {n + h: share[n] - h for n, h in half.items()}
    return units


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("n_chars", "source", "lang"), shards: int = 16) -> DataFrame:
    """Deal rows to `shards` shards of near equal bytes.

    Returns one row for each row of docs: id_col, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, law
    ('bytes'), shard (0 to shards - 1), slot (gapless from 0 in each shard), grown_shard (null).
    Rows of equal text (null counts as empty) go to one shard, placed by the least of their metadata, unless together they
    hold more than GROUP_SHARE of a shard: then, by a hash of the id, in parts of about PART_SHARE of a shard. Units of
    equal metadata are split by a hash of the text, so a source that holds a third of the bytes is divided. Missing dims
    are skipped, null dims sort below all values. Repeated rows are dealt each. An empty table gives an empty table.
    """
    dims = tuple(d for d in dims if d in docs.columns)
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h1"),
        F.xxhash64(F.lit(17), text).alias("_h2"),
        F.xxhash64(F.lit(29), id_col).alias("_h3"),
        *[F.col(f"`{d}`").alias(f"_d{i}") for i, d in enumerate(dims)],
    )
    slim = written(slim, "kd-slim")
    count, total, *bounds = slim.agg(F.count(F.lit(1)), F.sum("size"), *[f(f"_d{i}") for i in range(len(dims)) for f in (F.min, F.max)]).first()
    shard_bytes = max(1, (total or 0) / shards)

    sizes = slim.groupBy(*GROUP).agg(F.sum("size").alias("_bytes")).filter(F.col("_bytes") > shard_bytes * GROUP_SHARE)
    large = written(sizes.select(*GROUP, F.ceil(F.col("_bytes") / (shard_bytes * PART_SHARE)).cast("int").alias("_parts")), "kd-large")
    large = F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large
    rows = slim.join(large, list(GROUP), "left")
    rows = rows.withColumn("_part", F.pmod(F.col("_h3"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")

    scaled = [_scaled(F.col(f"_d{i}"), kinds[d], bounds[2 * i], bounds[2 * i + 1]).alias(f"_d{i}") for i, d in enumerate(dims)]
    units = rows.groupBy(*GROUP, "_part").agg(F.sum("size").alias("_bytes"), *[F.min(f"_d{i}").alias(f"_d{i}") for i in range(len(dims))])
    units = units.select(*GROUP, "_part", "_bytes", *scaled)
    columns = [f"_d{i}" for i in range(len(dims))] or ["_tie"]
    units = units.withColumn("_tie", F.pmod(F.xxhash64(*GROUP, "_part"), F.lit(1 << TIE_BITS)))
    shard = _grown(units, columns, shards).select(*GROUP, "_part", F.col("_node").cast("int").alias("shard"))
    dealt = written(rows.drop(*[f"_d{i}" for i in range(len(dims))]).join(shard, [*GROUP, "_part"]), "kd-dealt")

    parts = max(1, -(-count // (NUMBERED_ROWS * shards)))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_h3", "_h1"), F.lit(parts)).cast("int"))
    sums = dealt.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    first = sums.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_h3", "_h1", "_id", "text_crc32", "size"))
    return dealt.join(first, ["shard", "_block"]).select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
