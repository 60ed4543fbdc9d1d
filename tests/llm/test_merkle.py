"""Merkle manifests against a plain tree, at block sizes that make several rounds of the exchange."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strataframe.llm.merkle import fold, leaf_digest, merkle_forest, merkle_manifest

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, each leaf's siblings level by level) by the contract's words."""
    proofs, where, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(nodes)))
            proofs[k] += [nodes[j] for j in run if j != at]
            where[k] = at // 3
        nodes = [H(nodes[a : a + 3]) for a in range(0, len(nodes), 3)]
    return nodes[0], proofs


def leaf(row):
    return H(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def by_hand(rows):
    """rows of (doc_id, source, lang, n_chars, text): (doc_id, leaf, subroot, root, proof_sha256, verified), sorted."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *tree([leaf(r) for r in own]))
    root, upper = tree([trees[s][1] for s in order])
    out = []
    for s, up in zip(order, upper, strict=True):
        own, subroot, proofs = trees[s]
        for r, proof in zip(own, proofs, strict=True):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None and "\n" in r[4]
            out.append((r[0], leaf(r), subroot, root, H(proof + up), not cut))
    return sorted(out, key=repr)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, grp int, pos string, block string"


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(5)
    tampered = leaf_digest(*[F.col(c) for c in FIELDS[:-1]], F.replace("text", F.lit("\n"), F.lit("")))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest(df, altered=F.when(even, tampered), **how)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_is_the_plain_tree(spark, levels):
    rng = random.Random(levels)
    rows = []
    for i in range(420):
        source = "hot" if i % 3 else rng.choice([None, "", "é", "z", "a", "single"][: 1 + i % 6])
        text = rng.choice([None, "", "x\ny" * rng.randint(1, 4), "žluť\n", "plain", "long " * 3000])
        rows.append((i, source, rng.choice([None, "en"]), rng.choice([None, 5]), text))
    rows += [(None, "hot", None, None, None), (None, None, None, None, "\n"), rows[7], rows[7], (7, "hot", "en", 1, "another of this id")]
    out = found(spark, rows, block_levels=levels, per_partition=40).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in out], key=repr) == by_hand(rows)
    for r in out:
        assert (r.folded_root == r.root) == r.verified
        assert fold(r.leaf, [list(s) for s in r.proof]) == r.root


def test_one_row_no_rows_and_ragged_sizes(spark):
    one = found(spark, [(5, None, None, None, None)]).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == H([]) and one[0].verified
    assert found(spark, []).collect() == []
    for n in (2, 3, 4, 9, 10, 27, 28, 82):
        rows = [(i, "s", None, None, str(i)) for i in range(n)]
        out = found(spark, rows, block_levels=1, per_partition=7).collect()
        assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in out], key=repr) == by_hand(rows), n


def test_forest_of_other_fanout(spark):
    leaves = spark.createDataFrame([("g", k, H([str(k)])) for k in range(23)], "grp string, k int, digest string")
    out = merkle_forest(leaves, ["k"], fanout=2, block_levels=1, per_partition=6).collect()
    nodes = [H([str(k)]) for k in range(23)]
    while len(nodes) > 1:
        nodes = [H(nodes[a : a + 2]) for a in range(0, len(nodes), 2)]
    assert {r.root for r in out} == set(nodes)
    assert all(fold(r.digest, [list(s) for s in r.proof]) == nodes[0] for r in out)
