"""Collocations against plain counting, with frames, buckets and sorted partitions small enough to cut everywhere."""

import collections
import random
import re

import pytest

from strataframe.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, most, covered):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, g), a in good.items():
        for size in range(2, len(g)):
            for s in range(len(g) - size + 1):
                if 100 * a >= covered * f[lang, g[s : s + size]]:
                    gone.add((lang, g[s : s + size]))
    found = collections.defaultdict(list)
    for (lang, g), a in good.items():
        if (lang, g) not in gone:
            score, k = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            found[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out = []
    for lang, some in found.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(some)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def text(rng, vocab):
    words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 6)):
        words.insert(rng.randint(0, len(words)), rng.choice(["new york city hall", "Hot Hot hot hot", "in spite of", "\x01 \x00x", "é ü A\tb", "x.", ",y", "of the"]))
    return rng.choice([" ", "  ", "\t"]).join(words) + rng.choice(["", "\n", "! ", "\r\n"])


@pytest.mark.parametrize("least,most,covered", [(4, 2000, 80), (2, 15, 100), (7, 40, 30)])
def test_against_plain_counting(spark, monkeypatch, least, most, covered):
    monkeypatch.setattr(co, "STREAM_ROWS", 60)
    rng = random.Random(least)
    vocab = ["the", "of", "a", "hot", *("w" + chr(97 + k % 26) + str(k % 7) for k in range(40))]
    rows = [(rng.choice(["en", "en", "en", None, "", "de"]), rng.choice([None, "", text(rng, vocab), text(rng, vocab), text(rng, vocab)])) for _ in range(260)]
    rows += [("en", "copied again and again. " * 9)] * 5 + [("fr", "only three words")]
    df = spark.createDataFrame([(lang, t, 1, "x", 2, "y") for lang, t in rows], "lang string, text string, f int, w1 string, part int, size string").repartition(7)
    got = sorted(map(tuple, co.collocations(df, least=least, most=most, covered=covered).collect()))
    assert got == by_hand(rows, least, most, covered)


def test_small_frames_of_many_languages(spark):
    """The kernels with frames of one text each, in one process."""
    import pyarrow as pa

    rng = random.Random(1)
    rows = [(f"l{rng.randint(0, 30)}", text(rng, ["a", "b", "c d", "e"])) for _ in range(300)]
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    kept, co.FRAME_BYTES = co.FRAME_BYTES, 200
    try:
        frames = [f for b in co._frames(batch.slice(k, 3) for k in range(0, 300, 3)) for f in b.to_pylist()]
    finally:
        co.FRAME_BYTES = kept
    words = collections.Counter()
    for f in frames:
        some, codes = co._split_lines(f["words"]).to_pylist(), co._plain(f["text"]).astype(int)
        words.update((f["lang"], some[c - 1]) for c in codes if c)
    plain = collections.Counter((lang, w) for lang, t in rows for w in re.split("[.,;:!?\n\x0b\x0c\r \t]", t.translate(LOWER)) if w)
    assert words == plain and len(frames) > 60


def test_no_rows_and_nothing_frequent(spark):
    df = spark.createDataFrame([("en", "some words"), (None, None)], "lang string, text string")
    assert co.collocations(df).collect() == []
    assert co.collocations(df.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    """The score's product is exact where it passes 64 bits."""
    row = spark.sql("SELECT (cast(2000000 as decimal(10,0)) * cast(9000000000000000 as decimal(20,0))) div (cast(9000000000000001 as decimal(20,0)) + cast(9000000000000000 as decimal(20,0))) AS s").first()
    assert row.s == 2000000 * 9000000000000000 // 18000000000000001
