"""Merkle manifests by a butterfly exchange.

Rows become leaf digests, a forest has one tree for each group (a source; then one tree over the sources' roots). Leaves are
sorted by range, so a leaf's place in its group is its place in its partition and the counts of the partitions before it.
A group is cut into aligned blocks of fanout**BLOCK_LEVELS leaves. A block hashes its own leaves up to one node; then the
blocks swap nodes round by round: in round r a block gets, from a block below each sibling of its ancestor of level r, that
sibling's digest, and hashes the ancestor of level r + 1 itself, as all blocks below it do. So after the last round every
block holds its upper proof and the group's root, with no pass back down; its leaves then get their proofs in the block.
Blocks are bounded, and no exchange holds more than fanout rows of a block, whatever the size of a group.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import drop_written, partitions, written

#: Levels of the tree inside a block: at fanout 3 it has 2,187 leaves.
BLOCK_LEVELS = 7
#: Range partitions of sorted leaves hold about so many rows.
LEAVES_PER_PARTITION = 200_000
#: Up to so many rows (runs of leaves, or groups) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def field(value: Column) -> Column:
    """A value as part of a leaf: its UTF-8 byte count, a colon and the value; - where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _node(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def _levels(digests: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The nodes of each level, leaves first."""
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([_node(last[a : a + fanout]) for a in range(0, len(last), fanout)])
    return out


def _height(n: int, fanout: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def proof_of(levels: list[list[str]], at: int, fanout: int) -> list[list[str]]:
    """For each level below the top [place among its run, *siblings]; the place is a decimal string."""
    out = []
    for nodes in levels[:-1]:
        place = at % fanout
        run = nodes[at - place : at - place + fanout]
        out.append([str(place), *run[:place], *run[place + 1 :]])
        at //= fanout
    return out


def fold(digest: str, proof: list[list[str]]) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for place, *siblings in proof:
        siblings.insert(int(place), digest)
        digest = _node(siblings)
    return digest


def _local_root(fanout: int, levels: int):
    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        high = min(levels, _height(table["n"][0].as_py(), fanout))
        root = _levels(table["digest"].to_pylist(), fanout, high)[-1][0]
        return table.slice(0, 1).select(["grp", "block", "n"]).append_column("digest", pa.array([root]))

    return kernel


def _ancestor(fanout: int):
    """A block's own row (which is its ancestor's digest) and its siblings' digests to the next ancestor, and one more proof step."""

    def kernel(table: pa.Table) -> pa.Table:
        own = table.filter(table["own"]).slice(0, 1)
        members = sorted(zip(table["place"].to_pylist(), table["digest"].to_pylist(), strict=True))
        place = own["place"][0].as_py()
        step = [str(place), *(d for p, d in members if p != place)]
        proof = (own["proof"][0].as_py() or []) + [step]
        return pa.table({"grp": own["grp"], "block": own["block"], "n": own["n"], "blocks": own["blocks"], "digest": pa.array([_node([d for _, d in members])]), "proof": pa.array([proof], PROOF_ARROW)})

    return kernel


BLOCK = "grp string, block long, n long"
PROOF, PROOF_ARROW = "array<array<string>>", pa.list_(pa.list_(pa.string()))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _butterfly(state: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, digest of the root, proof above the block) of every block."""
    most = state.agg(F.max("blocks")).first()[0] or 1
    for r in range(_height(most, fanout)):
        span = fanout**r
        at = F.expr(f"block div {span}")
        rising = F.col("blocks") > span
        place = F.pmod(at, F.lit(fanout)).cast("int")
        nodes = F.expr(f"(blocks + {span - 1}) div {span}")
        # The member of a node that answers block b is the one as far into it as b is into its own, modulo the node's size.
        size = lambda node: F.least(F.lit(span).cast("long"), F.col("blocks") - node * span)
        inside, own_size = F.pmod("block", F.lit(span)), size(at)
        first = (at - place).cast("long")
        siblings = F.filter(F.sequence(first, F.least(first + fanout - 1, nodes - 1)), lambda s: s != at)
        targets = F.flatten(F.transform(siblings, lambda s: F.when(inside < size(s), F.sequence(s * span + inside, s * span + size(s) - 1, own_size)).otherwise(F.array().cast("array<long>"))))
        own = state.filter(rising).select("grp", "block", "n", "blocks", F.lit(True).alias("own"), place.alias("place"), "digest", "proof")
        sent = state.filter(rising).select("grp", F.explode(targets).alias("block"), "n", "blocks", F.lit(False).alias("own"), place.alias("place"), "digest", F.lit(None).cast(PROOF).alias("proof"))
        raised = own.unionByName(sent).groupBy("grp", "block").applyInArrow(_ancestor(fanout), f"{BLOCK}, blocks long, digest string, proof {PROOF}")
        last, state = state, written(raised.unionByName(state.filter(~rising)), "merkle-round")
        drop_written(last)
    return state


def _placed(leaves: DataFrame, order: list[str], per_partition: int) -> DataFrame:
    """leaves with pos (place in grp by order) and n (leaves of grp)."""
    spark = leaves.sparkSession
    parts = max(1, -(-leaves.count() // per_partition))
    dealt = leaves.repartitionByRange(max(parts, min(parts * 8, partitions(spark))), "grp", *order).sortWithinPartitions("grp", *order)
    at = written(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "merkle-sorted")
    runs = at.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    found = at.join(_small(written(runs, "merkle-runs")), ["grp", "part"]).withColumn("pos", F.col("row") + F.col("shift"))
    out = written(found.drop("row", "part", "shift"), "merkle-placed")
    drop_written(at)
    return out


def _proofs(fanout: int, levels: int, more: list[str], folded: str | None):
    """Each leaf's proof, what its row in `folded` (or else its digest) leads to, and the roots of its block."""

    def kernel(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        high = min(levels, _height(table["n"][0].as_py(), fanout))
        nodes = _levels(table["digest"].to_pylist(), fanout, high)
        upper = above["proof"][0].as_py() or []
        proofs = [proof_of(nodes, k, fanout) + upper for k in range(table.num_rows)]
        out = table.select(["digest", *more])
        out = out.append_column("proof", pa.array(proofs, PROOF_ARROW))
        if folded:
            now = pa.compute.coalesce(table[folded], table["digest"]).to_pylist()
            out = out.append_column("folded_root", pa.array(list(map(fold, now, proofs)), pa.string()))
            together = ("".join(d for step in p for d in step[1:]) for p in proofs)
            out = out.append_column("proof_sha256", pa.array([sha256(s.encode()).hexdigest() for s in together], pa.string()))
        for root in ("subroot", "root"):
            out = out.append_column(root, pa.array([above[root][0].as_py()] * table.num_rows, pa.string()))
        return out

    return kernel


def _grown(leaves: DataFrame, order: list[str], fanout: int, block_levels: int, per_partition: int) -> tuple[DataFrame, DataFrame]:
    """(leaves with their place and block, each block's proof and its group's root)."""
    width = fanout**block_levels
    placed = _placed(leaves, order, per_partition).withColumn("block", F.expr(f"pos div {width}"))
    local = placed.select("grp", "block", "pos", "n", "digest").groupBy("grp", "block").applyInArrow(_local_root(fanout, block_levels), f"{BLOCK}, digest string")
    local = local.withColumn("blocks", F.expr(f"(n + {width - 1}) div {width}")).withColumn("proof", F.lit(None).cast(PROOF))
    return placed, _butterfly(written(local, "merkle-blocks"), fanout)


def _proved(placed: DataFrame, above: DataFrame, columns: list[str], fanout: int, block_levels: int, folded: str | None = None) -> DataFrame:
    kinds = "".join(f", `{f}` {placed.schema[f].dataType.simpleString()}" for f in columns)
    schema = f"digest string{kinds}, proof {PROOF}{', folded_root string, proof_sha256 string' if folded else ''}, subroot string, root string"
    used = placed.select("grp", "block", "pos", "n", "digest", *columns, *[folded] * bool(folded))
    return used.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_proofs(fanout, block_levels, columns, folded), schema)


def merkle_forest(leaves: DataFrame, order: list[str], fanout: int = 3, block_levels: int = BLOCK_LEVELS, per_partition: int = LEAVES_PER_PARTITION) -> DataFrame:
    """The trees over leaves (grp string not null, digest, order columns): one for each grp, its leaves in order.

    While several nodes remain, each fanout consecutive ones become the digest of their digests put together; the last run
    may be shorter. Returns digest, the order columns, proof (for each level [place in the run, siblings ..] from the leaf
    up) and root. Leaves equal in order come in any order. No leaves: no rows.
    """
    placed, state = _grown(leaves, order, fanout, block_levels, per_partition)
    above = state.select("grp", "block", "proof", F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    return _proved(placed, above, [c for c in order if c != "digest"], fanout, block_levels).drop("subroot")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Column | None = None, fanout: int = 3, block_levels: int = BLOCK_LEVELS, per_partition: int = LEAVES_PER_PARTITION) -> DataFrame:
    """A manifest of docs: each row's leaf, its group's subroot, the root over all groups, and the proof between them.

    fields make the leaf, in order. Groups are ordered by their bytes, null first; leaves by id_col, null first, rows of one
    id by their leaf. altered: the leaf of the same row as it is found now (null: unchanged), folded over the proof.

    Returns id_col, leaf, subroot, root, proof (array of [place, siblings ..]), proof_sha256 (of all siblings together),
    folded_root (what altered, or else the leaf, leads to), verified (it equals root). Null and empty values are told apart.
    Texts of any length are one leaf. Columns beside id_col, group_col and fields are not read. No rows give no rows.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    found = altered if altered is not None else F.lit(None).cast("string")
    slim = written(docs.select(group.alias("grp"), F.col(id_col).alias("id"), leaf_digest(*[F.col(c) for c in fields]).alias("digest"), found.alias("altered")), "merkle-leaves")
    placed, state = _grown(slim, ["id", "digest"], fanout, block_levels, per_partition)
    tops = state.filter("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest")
    tops = written(merkle_forest(written(tops, "merkle-tops"), ["key"], fanout, block_levels, per_partition), "merkle-roots")
    tops = tops.select(F.col("key").alias("grp"), F.col("proof").alias("upper"), "root")
    state = state.join(_small(tops), "grp").select("grp", "block", F.concat(F.coalesce("proof", F.array().cast(PROOF)), "upper").alias("proof"), F.col("digest").alias("subroot"), "root")
    out = _proved(placed, state, ["id"], fanout, block_levels, "altered")
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "proof", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
